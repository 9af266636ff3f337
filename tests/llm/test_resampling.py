"""Weights, scores and the draw against plain Python; numbering of the drawn rows over many ranges and ties."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fathom.llm import resampling, scratch

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def counted(texts):
    out = [0] * 10_000
    for t in texts:
        for f in features(t)[1]:
            out[zlib.crc32(f.encode()) % 10_000] += 1
    return out


def expected(docs, target, percent=5, least=20):
    s, t = counted(x[1] for x in docs), counted(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10_000.0) / ((a + 1.0) * (sum(t) + 10_000.0)))) for a, b in zip(s, t)]
    rows, fit = [], []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None])
        if len(w) >= least:
            fit.append(rows[-1])
    fit.sort(key=lambda r: (-r[3], -(10**18) if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdéÉßABÀ9İK") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "-", "\n", "\x7f", "\x00", "_", "'"]) for _ in range(n))
    docs = [(i * 7, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 200]))) for i in range(400)]
    docs += [(5000, None), (5001, ""), (5002, " .. "), (5003, "one"), (5004, text(9000)), (None, text(30)), (-4, text(40)), docs[6], docs[6]]
    return docs, [text(rng.randint(1, 50)) for _ in range(30)] + [None, ""]


def test_query_against_plain_python(spark, some, tmp_path):
    docs, target = some
    spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, row string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in resampling.op11_resampling(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(docs, target)


def test_drawn_rows_keep_their_columns(spark, some):
    docs, target = some
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, row string")
    to = spark.createDataFrame([(t,) for t in target], "text string")
    ids = {r[0] for r in expected(docs, target, 30) if r[4]}
    got = resampling.drawn(df, to, percent=30)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == ids


def test_ranks_over_ties_and_ranges(spark):
    rng = random.Random(1)
    rows = [(None if i == 17 else i, rng.choice([3, 3, 3, 9, -5])) for i in range(3000)]
    df = scratch.table(spark.createDataFrame(rows, "doc_id long, score long").repartition(5), "test")
    order = sorted(rows, key=lambda r: (-r[1], -1 if r[0] is None else r[0]))
    for k in (0, 1, 700, 2400, 3000, 4000):
        got = {r["doc_id"]: r["rank"] for r in resampling.ranked(df, k).collect()}
        assert got == {d: i + 1 if i < k else None for i, (d, _) in enumerate(order)}


def test_nothing_to_draw_from_or_towards(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    r = resampling.resampled(one, none, percent=100, min_words=1).first()
    assert r["rank"] == 1 and r["n_features"] == 6 and r["weight"] == expected([(1, "a b c")], [])[0][2]


def test_scoring_explodes_and_shuffles_nothing(spark, some):
    df = spark.createDataFrame(some[0], "doc_id long, text string")
    plan = resampling.scored(df, [0] * 10_000).select(F.sum("score"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "split(0,0" not in plan
