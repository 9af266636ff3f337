"""Quality rules kept as a bitmask ledger.

Every document is measured once; every rule is evaluated once and leaves one bit in ``failed_bits``
(set: the document fails the rule). A policy is a mask of the bits that reject. Policies can be
added or changed later and ablations computed from the ledger alone, without another look at the
texts. All of it is DataFrame expressions: one narrow pass, no shuffle.

Defined results: a null or empty text has no words, fails ``few_words`` and is rejected by every
policy with that rule. Repeated rows are judged each for itself. Extra columns of the input are not
looked at; names that clash with the ledger's do no harm since only id and text are selected. An
empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import texts

GRAM = 5


def _hashes(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def _grams(hashes: Column) -> Column:
    """A hash for each window of five words."""
    return texts.let(
        hashes,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (GRAM - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, GRAM)]),
        ),
    )


def _covered(grams: Column) -> Column:
    """Words in windows that occur at least twice. Looks at positions only where some window repeats."""

    def positions(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = texts.let(
            pairs,
            lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def length(p: Column) -> Column:
        return texts.total(F.transform(p, lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(p, k + 1) - x, F.lit(GRAM)))))

    return texts.let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(texts.let(positions(g), length)),
    )


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row a document with what the rules look at, after the columns ``carry``."""
    text = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(texts.WORD))
    return (
        docs.select(F.struct(*carry, F.lit(0)).alias("carried"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("t"))
        .select("carried", "doc_id", "t", texts.words(F.col("t")).alias("w"), lines.alias("lines"))
        .select(
            *["carried"] * bool(carry),
            "doc_id",
            F.size("w").cast("long").alias("n_words"),
            texts.total(F.transform("w", lambda w: F.length(w))).alias("word_chars"),
            texts.count_of(text, "#*$%&|<>").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _covered(_grams(_hashes(F.col("w")))).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            texts.count_of(text, "!").alias("n_exclaims"),
            (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        )
    )


#: Rules in bit order; a rule is true where the document fails. New rules go at the end, as ledgers keep bit numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "exclamations": "10 * n_exclaims > 3 * n_words",
    "upper_case": "10 * n_upper > 4 * word_chars",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "exclamations", "upper_case"),
    "v3": tuple(RULES),
}
CURRENT = "v3"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """Measures and ``failed_bits`` for each document."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measures(docs, id_column, text_column, carry).withColumn("failed_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: str = CURRENT, column: str = "kept") -> DataFrame:
    """Add whether a document passes a policy."""
    return book.withColumn(column, F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def kept_documents(docs: DataFrame, policy: str = CURRENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` that a policy keeps, same columns. No join: what the rules measure travels with the row."""
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    judged = ledger(docs, id_column, text_column, tuple(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    return judged.where(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0).select(*[f"carried.{n}" for n in names]).toDF(*docs.columns)


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of a policy does: how many fail it, and how many only this rule rejects.

    One pass: the ledger is first summed by bit pattern (at most 2^rules rows), then looked at bitwise.
    """
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_documents"),
        )
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's base measures, the base verdict and the current policy's verdict."""
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("failed_bits").bitwiseAND(F.lit(sum(BIT[r] for r in BASE))) != 0
    return apply_policy(book).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (F.col("kept") & ~base).alias("kept"), "n_lines", "n_exclaims", "n_upper", "failed_bits",
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS gram FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM k),
c AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM r WHERE n > 1),
s AS (SELECT doc_id, sum(n)::BIGINT AS n FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(s.n, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
        (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper
      FROM w LEFT JOIN s ON w.doc_id = s.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 10 * n_upper > 4 * word_chars THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 2 * word_chars < 3 * n_words THEN 64 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 128 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, n_exclaims, n_upper, failed_bits FROM b
"""
