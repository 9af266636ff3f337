"""The trees on suffixes and hosts that they never saw, where features tell the labels; and that hosts of the given pages can be held out."""

from __future__ import annotations

import os
import random

import pytest

from fathom.llm import urls

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize("by", ["host_suffix", "host"])
def test_trees_on_what_they_never_saw(spark, by):
    rng = random.Random(5)
    rules = tuple((f"s{i}.com", "/", "block" if i % 3 == 0 else "allow") for i in range(36))
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for i in range(36):
        for _ in range(40):
            bad = (i % 3 == 0) == (rng.random() < 0.97)  # some labels are wrong
            host = f"{word('0123456789abcdef-', 14) if bad else word('aeioulrn', 6)}.s{i}.com"
            rows.append((len(rows), f"http://{host}/{word('0123456789', 9) + '?a=1&b=2&c=3' if bad else word('aeioulrn', 7) + '/' + word('aeioulrn', 5)}", "x"))
    found = urls.held_out(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules=rules, by=by).first()
    assert found["n"] > 200 and found["n_right"] > 0.93 * found["n"] > found["n_common"] + 0.1 * found["n"]


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables here")
def test_hosts_of_the_given_pages(spark):
    found = urls.held_out(spark.read.parquet(PAGES), by="host").first()
    assert 0 < found["n_right"] <= found["n"]
