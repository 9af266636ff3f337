"""Runs against an enumeration of all stretches, on small alphabets, and the query's rows against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fathom.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def plain_runs(w, exponent, min_length):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            k = i
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k + p - i >= max(exponent * p, min_length) and smallest_period(w[i : k + p]) == p:
                out.append((i, k + p - i, p))
            i = k + 1
    return sorted(out)


def samples(rng, n):
    out = []
    for _ in range(n):
        kind, size = rng.random(), rng.randint(0, 60)
        if kind < 0.4:
            w = [rng.choice("ab") for _ in range(size)]
        elif kind < 0.6:
            w = [rng.choice("abc") for _ in range(size)]
        else:
            w = []
            while len(w) < size:
                part = w[rng.randrange(len(w)) :][: rng.randint(1, 9)] if w and rng.random() < 0.6 else [rng.choice("abcd") for _ in range(rng.randint(1, 3))]
                w += part * rng.randint(1, 5)
        out.append(w)
    return out


@pytest.mark.parametrize("exponent, min_length", [(2, 1), (3, 1), (4, 6), (4, 1)])
def test_all_runs_of_many_documents_at_once(exponent, min_length):
    rng = random.Random(exponent * 100 + min_length)
    docs = samples(rng, 1500) + [list("a" * 300), list("ab" * 100 + "c" + "ab" * 100), list("aab" * 40 + "b" + "aab" * 40)]
    for k in range(0, len(docs), 7):
        some = docs[k : k + 7]
        found = periodic._some([[x.encode() for x in w] for w in some], exponent, min_length)
        assert found == [plain_runs(w, exponent, min_length) for w in some], some


def test_suffixes_and_previous_factors():
    rng = random.Random(9)
    for w in samples(rng, 200):
        if len(w) < 2:
            continue
        codes = np.array([ord(c) for c in w])
        s = periodic.Suffixes(codes)
        assert s.array.tolist() == sorted(range(len(w)), key=lambda i: [*map(ord, w[i:])])
        length, source = periodic.previous_factors(s)
        for i in range(len(w)):
            best = max((next((k for k in range(len(w) - i) if w[j + k] != w[i + k]), len(w) - i) for j in range(i)), default=0)
            assert length[i] == best and (not best or (source[i] < i and w[source[i] : source[i] + best] == w[i : i + best]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 4, 6)
    over = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in over)))


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(w).replace("d d", "d\n\x0b d") for w in samples(rng, 400)]
    texts += [None, "", " \n ", "word", "no no no no no", "no " * 6, "é ß é ß é ß é ß é ß", "A a A a A a A a", "x y z " * 300 + "end", " ".join(str(i) for i in range(3000)), "one word " * 9]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, start string, length int, runs string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(expected(r[0], r[1]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 100 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)


def test_empty_table_null_id_and_texts_over_a_step(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(none).count() == 0
    monkeypatch.setattr(periodic, "STEP", 64)
    rows = [(None, "a b " * 50), (1, "a b " * 50), (2, None), (3, "c " * 9)]
    found = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [("1", [(0, 100, 2)], "a b"), ("2", [], ""), ("3", [(0, 9, 1)], "c"), ("None", [(0, 100, 2)], "a b")]
