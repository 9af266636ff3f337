"""Exact order statistics of a column without sorting it: histograms that are refined around the wanted ranks.

Every pass counts the values of the bins that are still looked at, with each bin's least and greatest value; bins that hold a
wanted rank are cut again, between those two, until they hold one value only or few rows. Only those few rows are
sorted. A pass shuffles one row a bin and task, so no task ever holds all values; all ranks share the passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, dealt out among the ranges it looks at, and rows that are sorted at the end.
BINS, FEW = 4096, 20_000


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value between ``low`` and ``high``. Each step of the arithmetic is monotone, so bins keep the order of values; halves keep it finite."""
    width = high / 2 - low / 2
    return F.least(F.floor((x / 2 - F.lit(low) / 2) / F.lit(width) * bins).cast("int"), F.lit(bins - 1))


def at_ranks(rows: DataFrame, value: Column | str, ranks: Sequence[int]) -> list:
    """The values at these places (from 0) of the ascending order of ``value`` (a number), nulls and NaN left out.

    Longs are compared as doubles within 2**53. A rank that doesn't exist gives None; infinite values are in order like others.
    """
    x = F.col("_x")
    column = F.col(value) if isinstance(value, str) else value
    kept = rows.select(column.alias("_x")).where(x.isNotNull() & ~F.isnan(x.cast("double"))).persist()
    endless = x.cast("double").isin(float("inf"), float("-inf"))
    n, below, low, high = kept.agg(F.count("*"), F.count_if(x.cast("double") == float("-inf")), F.min(F.when(~endless, x)), F.max(F.when(~endless, x))).first()
    found: dict[int, object] = {}
    finite = kept.where(~endless)
    above = finite.count() + below if n else 0
    for r in set(ranks):
        if not 0 <= r < n:
            found[r] = None
        elif r < below or r >= above:
            found[r] = float("-inf") if r < below else float("inf")
        elif low == high:
            found[r] = low
    #: Ranges still looked at: (least value, greatest value, rank of the least, rows).
    ranges = [(low, high, below, above - below)] if len(found) < len(set(ranks)) else []
    while ranges:
        if sum(count for *_, count in ranges) <= FEW:
            some = finite.where(_within(x, ranges)).orderBy("_x").collect()
            values = [r[0] for r in some]
            at = 0
            for _, _, first, count in ranges:
                found |= {r: values[at + r - first] for r in set(ranks) - found.keys() if first <= r < first + count}
                at += count
            break
        bins = max(2, BINS // len(ranges))
        cell = F.coalesce(*[F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("range"), _bin(x.cast("double"), float(lo), float(hi), bins).alias("bin"))) for i, (lo, hi, _, _) in enumerate(ranges)])
        counts = finite.where(_within(x, ranges)).groupBy(cell.alias("cell")).agg(F.min(x), F.max(x), F.count("*")).orderBy("cell").collect()
        following, first, before = [], 0, -1
        for (i, _), lo, hi, count in ((tuple(c[0]), *c[1:]) for c in counts):
            if i != before:
                before, first = i, ranges[i][2]
            wanted = [r for r in set(ranks) - found.keys() if first <= r < first + count]
            if wanted and lo == hi:
                found |= dict.fromkeys(wanted, lo)
            elif wanted:
                following.append((lo, hi, first, count))
            first += count
        ranges = following
    kept.unpersist()
    return [found[r] for r in ranks]


def _within(x: Column, ranges: list[tuple]) -> Column:
    out = F.lit(False)
    for lo, hi, *_ in ranges:
        out = out | ((x >= lo) & (x <= hi))
    return out


def quantiles(rows: DataFrame, value: Column | str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours, all in one selection; None where there are no values."""
    x = F.col(value) if isinstance(value, str) else value
    kept = rows.select(x.cast("double").alias("_q")).where(F.col("_q").isNotNull() & ~F.isnan("_q")).persist()
    n = kept.count()
    places = [s * (n - 1) for s in shares]
    wanted = [r for p in places for r in (math.floor(p), math.ceil(p))] if n else []
    values = at_ranks(kept, "_q", wanted)
    kept.unpersist()
    return [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in zip(places, values[::2], values[1::2])] if n else [None] * len(shares)
