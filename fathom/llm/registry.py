"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from fathom.llm import embeddings, lines, minhash, mixing, packing, periodic, pii, quality_rules, resampling, secret_scan, substrings, urls, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_url_filters": urls.op3_url_filters,
    "op4_minhash": minhash.op4_minhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_pii": pii.op6_pii,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_warc": warc.op10_warc,
    "op11_resampling": resampling.op11_resampling,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op7_embedding_dedup": embeddings.OP7_SQL,
    "op9_line_dedup": lines.OP9_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
