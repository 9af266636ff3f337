"""Fixed patterns against the plain expressions; random strings are found, digests, identifiers and words are left alone."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest

from fathom.llm import secret_scan

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def strings(rng, alphabet, size, n):
    out = ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n)]
    return [x for x in out if re.search("[0-9]", x) and re.search("[A-Za-z]", x)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    pieces = ["password", "PassWD", "token", "TOKEN", "secret", "api_key", "apikey", "api__key", "ſecret", "toKen", "=", " = ", ":", " ", "  ", "\"", "'", "\n", "é", "ß", "𝄞", "abcdefgh", "a.b-c_d=", "1234567", "12345678", "AKIA", "AKIAABCDEFGHIJKL", "akia", "0123456789abcdef" * 2,
              "0123456789abcdef0", "f" * 31, "f" * 33, "F" * 40, "x"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    out += [None, "", "token", "token = ", "= abcdefghij", "password" * 5000 + "=abcdefghi", "token" + " " * 3000 + "=" + "a" * 3000, "é" * 9000 + "token=12345678"]
    return [(i, t, "k", 1) for i, t in enumerate(out)]


def test_base_spans_and_counts(spark, rows, tmp_path):
    spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, spans string, start int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = secret_scan.op12_secret_scan(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + 1
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        spans = base(texts[r["doc_id"]])
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), texts[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        every = [x.split(":") for x in r["spans"].split(",") if x]
        assert [x for x in every if x[0] != "random"] == [x.split(":") for x in joined.split(",") if x]
        taken = [(s, e) for s, _, e in spans]
        assert all(e <= int(x[1]) or int(x[2]) <= s for x in every if x[0] == "random" for s, e in taken)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.spans(df, VOCABULARY).collect()}
    return [[t[s:e] for k, s, e in got[i] if k == "random"] for i, t in enumerate(texts)]


def test_random_strings_are_found_whole(spark):
    rng = random.Random(2)
    secrets = [x for a in (UPPER + LOWER + DIGITS, LOWER + DIGITS, UPPER + DIGITS) for n in (20, 24, 40, 64) for x in strings(rng, a, n, 100)]
    secrets += [p + x for p in ("ghp_", "sk-live-", "xoxb-") for x in strings(rng, UPPER + LOWER + DIGITS, 32, 50)] + [x + "==" for x in strings(rng, UPPER + LOWER + DIGITS + "+/", 43, 100)]
    texts = [f"été : « {x} » et la suite" for x in secrets]
    hits = sum(f == [x] for f, x in zip(found(spark, texts), secrets))
    assert hits >= 0.98 * len(secrets), (hits, len(secrets))


def test_words_digests_and_identifiers_are_left(spark):
    rng = random.Random(6)
    h = hashlib.sha256(b"x")
    clean = ["user_profile_image_128x128", "getElementsByClassName2", "x86_64-unknown-linux-gnu", "python3-numpy-1-24-3", "covid19-vaccination-rates-2021", "Windows-NT-10-0-Win64-x64", "IMG_20231224_153012_HDR", "123e4567-e89b-12d3-a456-426614174000", "2024-03-11T12-33-41Z",
             "12345678901234567890kg", "Donaudampfschifffahrtsgesellschaft2", h.hexdigest().upper(), hashlib.md5(b"x").hexdigest().upper(), "sha256-" + strings(rng, UPPER + LOWER + DIGITS, 43, 1)[0], "integrity=" + strings(rng, UPPER + LOWER + DIGITS, 43, 1)[0],
             "https://example.org/watch/" + strings(rng, UPPER + LOWER + DIGITS, 22, 1)[0], strings(rng, LOWER + DIGITS, 22, 1)[0] + "@example.org", "data:image/png;base64," + strings(rng, UPPER + LOWER + DIGITS, 900, 1)[0], "1234-5678-9012-3456", "a" * 40, "0" * 40]
    assert found(spark, clean) == [[] for _ in clean]


def test_long_runs_null_ids_and_no_rows(spark):
    rng = random.Random(4)
    long = "".join(rng.choice(UPPER + LOWER + DIGITS) for _ in range(300_000))
    assert found(spark, [f"x {long} y", "a1" * 100_000])[0] == [long]
    assert secret_scan.spans(spark.createDataFrame([(None, "token=12345678")], "doc_id long, text string"), VOCABULARY).first()["spans"][0]["kind"] == "assign"
    assert secret_scan.spans(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
