"""The random field on sentences that no template gives, the query's columns by brute force, and texts of great length."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import crf, pii, wordhash

HELD_OUT = [
    ("phone", "please ring me on (743) 555-3824 before nine", "(743) 555-3824"),
    ("phone", "Our office: 212-664-7665, ask for the manager", "212-664-7665"),
    ("email", "you can write to julia (at) posteo (dot) net if needed", "julia (at) posteo (dot) net"),
    ("email", "mail goes to bob99 [at] example.org thanks", "bob99 [at] example.org"),
    ("ip", "the box answers under 10[.]20[.]30[.]40 only", "10[.]20[.]30[.]40"),
    ("secret", 'deploy with API_KEY = "Zk3vQ9aP1xYb7LmN2cRt5wEd" set', "Zk3vQ9aP1xYb7LmN2cRt5wEd"),
    ("secret", "token: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b here", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"),
    ("secret", "set ghp_a8Kd93LmQ02xZrT6vB1nC4yW7uE5 as a variable", "ghp_a8Kd93LmQ02xZrT6vB1nC4yW7uE5"),
    ("name", "the letter for Mrs. Jane Thornbury was lost", "Jane Thornbury"),
    ("street", "they moved to 221 Baker Street last spring", "221 Baker Street"),
    ("street", "der Laden in der Lindenstraße 45 hat zu", "Lindenstraße 45"),
]
CLEAN = [
    "In 2019, 1,204 people met 3 times; 45% said yes on 2020-01-31 at 10:30.", "Licensed under the Apache License, Version 2.0.", "GO NOW!! BUY IT ALL!! NOW!!", "de de de de de de de de de de", "A, A, A, A, A, A",
    "| one | two | 3 | 4.5 |", "The order 2390409500648960 failed", "a name, a key and a street are words", "x = 3 and y = 4", "look at the dot on the map",
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(pii.training_table(spark))


def found(model, texts):
    words, out = pii._Words(model), []
    for _, data, at in wordhash.parts(pa.array(texts)):
        out += pii._chunk_spans(model, words, data, at)
    return out


def test_field_on_held_out_sentences(model):
    got = found(model, [t for _, t, _ in HELD_OUT])
    hit = [any(pii.KINDS[k] == kind and text[lo:hi] == want for lo, k, hi in spans) for (kind, text, want), spans in zip(HELD_OUT, got)]
    assert sum(hit) >= 0.8 * len(hit), [(h[1], [(pii.KINDS[k], h[1][lo:hi]) for lo, k, hi in s]) for h, s, ok in zip(HELD_OUT, got, hit) if not ok]
    assert sum(map(bool, found(model, CLEAN))) == 0


def test_every_word_is_decoded_whatever_the_batch(model, monkeypatch):
    """Chunks, groups of chains and chains decoded by themselves change nothing."""
    texts = [f"{'blend in ' * 40}{t} {'ordinary words ' * 30}\n{t}" for _, t, _ in HELD_OUT]
    whole = found(model, texts)
    assert all(len(s) >= 2 for s, (_, t, _) in zip(whole, HELD_OUT) if found(model, [t])[0])
    monkeypatch.setattr(crf, "CELLS", 150)
    assert found(model, texts) == whole
    monkeypatch.setattr(wordhash, "STEP", 10)
    assert found(model, texts) == whole


def test_query_columns_by_brute_force(spark, model, tmp_path):
    rng = random.Random(3)
    parts = ["ana@x.org", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (212) 664-7665", "é", "word", "\n", "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", "12"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(40)] + [None, "", " \n"]
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)] + [(3, texts[3], "x", [1]), (None, "1.2.3.4", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, kind array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pii.op6_pii(spark, str(tmp_path)).collect()), key=str)
    expected = []
    for doc, text, *_ in rows:
        t = text or ""
        base = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(t)]
        base += [(m.start(), 1, m.end()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        base += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        base += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
        more = [s for s in found(model, [t])[0] if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        line = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        expected.append((doc, *(sum(b[1] == k for b in base) for k in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(base + more)))
    assert got == sorted(expected, key=str)
    assert any("secret" in r[-1] for r in got)


def test_long_texts_take_time_in_proportion(model):
    began = time.monotonic()
    assert pii.base_spans("7" * 1_000_000) == [] and pii.base_spans("1.2." * 250_000)
    assert pii.base_spans("a" * 500_000 + "@") == []
    numbers = " ".join(str(n) for n in np.random.default_rng(1).integers(0, 10**6, 200_000))
    found(model, [numbers, *["12 3"] * 511])
    assert time.monotonic() - began < 60


def small_field(rng, k=4, words=9):
    tags = tuple("abcd"[:k])
    table = rng.normal(size=(words, 3, k)).astype(np.float32)
    return crf.Model(tags, {crf.AGAIN: 0}, rng.normal(size=(1, 3, k)), rng.normal(size=(k + 1, k))), table


def score(field, table, row, again, path):
    """What the field gives a path of tags over one chain, word by word."""
    total = field.moves[-1, path[0]] + sum(field.moves[a, b] for a, b in zip(path, path[1:]))
    for t, tag in enumerate(path):
        total += table[row[t], 0, tag] + crf.CAUTION * (tag == 0) + field.weights[0, 0, tag] * again[t]
        total += table[row[t - 1], 1, tag] if t else 0
        total += table[row[t + 1], 2, tag] if t + 1 < len(path) else 0
    return float(total)


def test_viterbi_equals_all_paths(monkeypatch):
    """Chains of one to six words against the best of all paths: in one group, in groups, each by itself, and by either way to take a step."""
    rng = np.random.default_rng(5)
    field, table = small_field(rng)
    sizes = rng.integers(1, 7, 60)
    row, fresh = rng.integers(0, len(table), sizes.sum()), np.zeros(sizes.sum(), bool)
    fresh[np.cumsum(sizes) - sizes] = True
    again = (np.diff(row, prepend=-1) == 0) & ~fresh
    want = []
    for lo, n in zip(np.cumsum(sizes) - sizes, sizes):
        paths = itertools.product(range(4), repeat=int(n))
        want += max(paths, key=lambda p: score(field, table, row[lo : lo + n], again[lo : lo + n], p))
    for cells, few in ((200_000, 0), (200_000, 100), (11, 0), (11, 16), (3, 16), (1, 0)):
        monkeypatch.setattr(crf, "CELLS", cells)
        monkeypatch.setattr(crf, "FEW", few)
        assert field.decode(table, row, fresh, iter(()), again).tolist() == want, (cells, few)


def test_a_line_is_one_chain_however_long(model, monkeypatch):
    """A span in the middle of a line of many thousand words; the whole path scores at least as well as any that changes one tag."""
    rng = np.random.default_rng(6)
    field, table = small_field(rng)
    row = rng.integers(0, len(table), 3000)
    fresh, again = np.arange(3000) == 0, np.diff(row, prepend=-1) == 0
    path = field.decode(table, row, fresh, iter(()), again)
    monkeypatch.setattr(crf, "CELLS", 700)
    assert (field.decode(table, row, fresh, iter(()), again) == path).all()
    best = score(field, table, row, again, path)
    for t in rng.integers(0, 3000, 25):
        for tag in range(4):
            other = path.copy()
            other[t] = tag
            assert score(field, table, row, again, other) <= best + 1e-3
    texts = [f"{'ordinary words ' * 4000}{t} {'blend in ' * 4000}" for _, t, _ in HELD_OUT]
    assert [len(s) for s in found(model, texts)] == [len(s) for s in found(model, [f"{'ordinary words ' * 20}{t} {'blend in ' * 20}" for _, t, _ in HELD_OUT])]


def test_long_runs_of_numbers_are_summed_to_their_end():
    for digits in ("4111111111111111", "4111111111111112", "7" * 300 + "12", "0" * 14, "59" * 401):
        assert crf._check_digit(digits.encode()) == pii.luhn(digits)
    body = "1234 " * 80
    assert {crf._run(f"{body}{d}".encode()) for d in range(10)} == {"r=20,True", "r=20,False"}


def test_marks_behind_a_span_are_not_in_it(model):
    text = 'deploy with API_KEY = "Zk3vQ9aP1xYb7LmN2cRt5wEd"### set'
    assert [text[lo:hi] for lo, _, hi in found(model, [text])[0]] == ["Zk3vQ9aP1xYb7LmN2cRt5wEd"]
