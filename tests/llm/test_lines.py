"""Line dedup against brute force: edits by length, keys that many lines share, columns with clashing names."""

from __future__ import annotations

import random

import pytest

from fathom.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near_lines(seed=3):
    """Lines of 15 to 70 bytes, most of them some edits away from another, and templates with numbers."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)).strip() or "x" for n in (15, 19, 20, 21, 24, 30, 38, 39, 40, 41, 47, 48, 50, 63, 64, 70)]
    out = []
    for b in base:
        for _ in range(12):
            s = list(b)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "q", "é"])
            out.append("".join(s).strip() or "y")
    out += [f"Order {rng.randrange(10**6):06d} was shipped on a {d}" for d in ("Monday", "Friday", "cold and rainy Wednesday") for _ in range(25)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("common", [2, 64])
def test_near_lines_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(lines, "COMMON", common)
    rows = [(i, x) for i, x in enumerate(near_lines())]
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    raw = {x: x.encode() for x in first}
    late = set()
    for x in first:
        for y in first:
            if first[y] < first[x] and (limit := min(2, min(len(raw[x]), len(raw[y])) // 20)) and abs(len(raw[x]) - len(raw[y])) <= limit and edits(raw[x], raw[y]) <= limit:
                late.add(x)
    expected = {i: (int(first[x] != i), int(first[x] == i and x in late)) for i, x in rows}
    got = {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and sum(n for _, n in got.values()) > 60


def test_long_document_of_repeats_and_clashing_columns(spark):
    shared = "\n".join(f"line {i} {'abcdefghij'[i % 10] * 12} {i * 7919}" for i in range(3000))
    df = spark.createDataFrame([(1, shared, 1, "p"), (2, f"own a\n{shared}\n\nown b", 2, "q"), (None, "", 3, "r")], "doc_id long, text string, _in_0 int, rid string")
    out = {r["doc_id"]: (r["text"], r["_in_0"], r["rid"]) for r in lines.deduplicate(df).collect()}
    assert out[2] == ("own a\n\nown b", 2, "q") and out[None] == ("", 3, "r") and out[1][1:] == (1, "p")
