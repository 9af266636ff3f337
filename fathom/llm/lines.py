"""Removing lines that an earlier document, or an earlier place of the same one, has up to a few edits.

Segment-partition edit join, in DataFrame expressions only. Lines are allowed an edit for each ``PER_EDIT`` bytes
of the shorter one, at most ``THRESHOLD``. A line is split into threshold-plus-one segments; a line within that
many edits of it must hold one of them unchanged, near its own place. Segments are indexed by length class: a
class begins at L, the line's length without all but its three leading bits, and the segments' sizes follow from
L alone, so that one row serves all lengths of a class. With two edits: the first L/3 bytes, the last L/3 bytes
(neither moves where it is unchanged), and a middle one, which moves by a byte at most, since an edit lies on
either side of it; it is probed at three places. With one edit: the first and the last half. Lines whose length
less the threshold falls in the class below are indexed there as well. That makes some six rows a line.

Rows that meet another line's go on, few in all. Keys that more than ``COMMON`` lines share are refined: beyond
the segment in common as many edits are left for the rest, which is split in the same way, and both hashes form
the key. Pairs whose lengths and letter parities allow so few edits (an edit changes two of 64 parity bits at
most) are verified by a banded bit-parallel automaton: a word of ``2 * threshold + 1`` bits for each number of
edits, a bit for each diagonal, one step for each byte.

Lines are compared without the white space around them, in UTF-8 bytes; equal lines count whatever their length.
They are first brought down to one row by 128-bit hashes, so a line that a third of all documents hold is one
candidate. A line goes if it isn't the first of its equals by (doc_id, place), or if another line within its
edits has an earlier first place.

Defined results: null text has no lines; lines without a word are neither counted nor removed; of
repeated rows with one id lines at the same place don't remove each other; a null id comes before all
others; an empty table gives an empty result; other columns are ignored or handed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch, texts

#: Edits at most, and bytes of the shorter line for each of them.
THRESHOLD = 2
PER_EDIT = 20
#: Lines that may share a key before it is refined.
COMMON = 64


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """All of ``docs`` under names of our own, with doc (the id), text and rid (a hash of both), stored in buckets of rid."""
    own = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(docs.columns)]
    doc, text = F.col(f"`{id_column}`").cast("long"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return scratch.bucketed(docs.select(*own, doc.alias("doc"), text.alias("text"), F.xxhash64(doc, text).alias("rid")), "rid", "line-rows")


def _bytes(line: Column) -> Column:
    return F.btrim(line, F.lit(texts.SPACES)).cast("binary")


def occurrences(rows: DataFrame) -> DataFrame:
    """h and g (hashes of the line), n (its bytes), doc, rid, pos for each line with a word."""
    each = rows.select("doc", "rid", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc", "rid", "pos", _bytes(F.col("line")).alias("b"))
    return each.where(F.octet_length("b") > 0).select(F.xxhash64("b").alias("h"), F.xxhash64(F.lit(1), "b").alias("g"), F.octet_length("b").alias("n"), "doc", "rid", "pos")


def _with_bytes(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` (h, g, first) with their bytes b, looked up at their first place."""
    by_row = lines.groupBy(F.col("first.rid").alias("_r")).agg(F.collect_list(F.struct("h", "g", "first")).alias("_p"))
    # the join is on rid alone, by which rows lie in buckets; ids are compared where they meet
    met = rows.select("doc", "rid", "text").join(by_row, F.col("rid") == F.col("_r")).withColumn("places", F.filter("_p", lambda p: p["first"]["doc"].eqNullSafe(F.col("doc"))))
    each = met.select(F.explode(texts.let(F.split("text", "\n"), lambda t: F.transform("places", lambda p: F.struct(p.alias("line"), F.get(t, p["first"]["pos"]).alias("t"))))).alias("x"))
    return each.select("x.line.h", "x.line.g", "x.line.first", _bytes(F.col("x.t")).alias("b"))


def _class(n: Column) -> Column:
    """The least length of the class that ``n`` is in: its three leading bits. Classes are a quarter of their least length wide."""
    shift = F.greatest(F.length(F.bin(n)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n.cast("int"), shift), shift)


def _edits(n: Column, threshold: int) -> Column:
    return F.least(F.lit(threshold), F.floor(n / PER_EDIT).cast("int"))


#: What a key row stands for: indexed in the class below its own; in its own class; in its own class, a byte aside.
#: Two rows with a key make a pair unless both are of the first or both of the last kind.
BELOW, OWN, ASIDE = 0, 1, 2


def _split(at: Column, end: Column, least: Column, edits: int, kind: Column) -> list[tuple[Column, Column, Column]]:
    """(place, size, kind) of the segments of the bytes at..end, of which there are ``least`` at least."""
    size = F.floor(least / (edits + 1)).cast("int")
    out = [(at, size, kind), (end - size, size, kind)]
    if edits == 2:
        middle = (least - 2 * size).cast("int")
        out += [(at + size, middle, kind)]
        out += [(at + size + off, middle, F.when(kind == OWN, F.lit(ASIDE))) for off in (-1, 1)]
    return out


def _keys(least: Column, edits: int, kind: Column) -> Column:
    """Key rows of the line ``b`` of ``n`` bytes in the class that begins at ``least``."""
    zero = F.lit(0)
    rows = [
        F.struct(F.lit(i).alias("part"), place.alias("place"), size.alias("size"), F.xxhash64(F.lit(min(i, 2)), least, F.substring(F.col("b"), place + 1, size)).alias("key"), k.cast("int").alias("kind"))
        for i, (place, size, k) in enumerate(_split(zero, F.col("n"), least, edits, kind))
    ]
    return F.array(*rows)


def segments(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """h, least, edits and the key rows of distinct lines h, b: in their own class, and in the one below that their partners may be in."""
    if not 0 <= threshold <= 2:
        raise ValueError("lines are joined within two edits at most")
    if not threshold:
        return lines.sparkSession.createDataFrame([], "h long, least int, edits int, part int, place int, size int, key long, kind int")
    sized = lines.select("h", "b", F.octet_length("b").alias("n")).where(F.col("n") >= PER_EDIT)
    own, below = _class(F.col("n")), _class(F.col("n") - threshold)
    classes = F.array(F.struct(own.alias("least"), F.lit(OWN).alias("as")), F.struct(below.alias("least"), F.lit(BELOW).alias("as")))
    # a class is split for the edits that its longest lines are allowed
    placed = sized.select("h", "b", "n", F.inline(F.when(below < own, classes).otherwise(F.slice(classes, 1, 1))))
    placed = placed.withColumn("edits", _edits(F.col("least") + F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin("least")) - 3, F.lit(0))) - 1, threshold))
    made = [placed.where(F.col("edits") == e).select("h", "least", "edits", F.inline(_keys(F.col("least"), e, F.col("as")))) for e in range(1, threshold + 1)]
    return reduce(DataFrame.unionByName, made).where("kind IS NOT NULL")


_MEET = "l.key = r.key AND l.h <> r.h AND NOT (l.kind = r.kind AND l.kind <> 1)"


def hits(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The key rows that meet some other line's. ``lines``: distinct lines h, b.

    A semi-join of the rows with themselves, so both sides share one shuffle and no more rows come out than
    went in, however many lines have a segment in common.
    """
    rows = segments(lines, threshold)
    return rows.alias("l").join(rows.alias("r"), F.expr(_MEET), "left_semi")


def refined(common: DataFrame) -> DataFrame:
    """Key rows of two segments for key rows of one. ``common``: key rows with the line's b and n."""

    def rows(edits: int, parts: tuple[int, ...]) -> DataFrame:
        kind, n, least, place, size = (F.col(c) for c in ("kind", "n", "least", "place", "size"))
        if parts == (0,):  # the first segment is unchanged: what follows is split
            cut = _split(size, n, least - size, edits, kind)
        elif parts == (1,):  # the last one is: what precedes is
            cut = _split(F.lit(0), n - size, least - size, edits, kind)
        else:  # one edit lies before the middle, so half of that is unchanged, from the start or up to the middle
            half = F.floor((least - size) / 4).cast("int")
            cut = [(F.lit(0), half, kind), (place - half, half, kind)]
        own = common.where((F.col("edits") == edits) & F.col("part").isin(*parts))
        made = [F.struct(F.xxhash64("key", F.lit(min(i, 2)), F.substring(F.col("b"), at + 1, m)).alias("key"), k.cast("int").alias("kind")) for i, (at, m, k) in enumerate(cut)]
        return own.select("h", F.inline(F.array(*made))).where("kind IS NOT NULL")

    return reduce(DataFrame.unionByName, [rows(1, (0,)), rows(1, (1,)), rows(2, (0,)), rows(2, (1,)), rows(2, (2, 3, 4))])


def parities(b: Column) -> Column:
    """A bit for each byte value modulo 64: whether it occurs an odd number of times. An edit changes two bits at most."""
    letters = F.split(F.decode(b, "ISO-8859-1"), "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def candidates(found: DataFrame, signed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs x < y of line hashes that share a key and whose lengths and parities allow so few edits, with the edits they are
    allowed. ``found``: stored hits; ``signed``: stored h, b, n and parity of their lines."""
    often = found.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > COMMON).select("key")
    seldom = found.join(often, "key", "left_anti").select("h", "key", "kind")
    fine = refined(found.join(often, "key", "left_semi").join(signed.select("h", "b", "n"), "h"))
    rows = seldom.unionByName(fine).join(signed.select("h", "n", "parity"), "h")
    l, r = rows.alias("l"), rows.alias("r")
    edits = _edits(F.least("l.n", "r.n"), threshold)
    few = (F.abs(F.col("l.n") - F.col("r.n")) <= edits) & (F.expr("bit_count(l.parity ^ r.parity)") <= 2 * edits)
    return l.join(r, F.expr(_MEET.replace("<>", "<", 1)) & few).select(F.col("l.h").alias("x"), F.col("r.h").alias("y"), edits.alias("edits")).distinct()


def within(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether two binaries are at most ``threshold`` edits apart: banded, bit-parallel.

    Bit d of word e, after i bytes of ``a``: the first i bytes of ``a`` and the first i + d - threshold bytes
    of ``b`` are at most e edits apart.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    letters = [F.split(F.decode(x, "ISO-8859-1"), "") for x in (a, b)]
    gap = F.octet_length(b) - F.octet_length(a)

    def step(state: Column, letter: Column, other: Column) -> Column:
        at = state["i"]
        same = [F.when(F.get(other, at + (d - threshold)) == letter, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
        equal = reduce(lambda x, y: x + y, same)

        def words(m: Column) -> Column:
            out = []
            for e in range(threshold + 1):
                word = state[f"w{e}"].bitwiseAND(m)
                if e:
                    below = state[f"w{e - 1}"]
                    # substituted, deleted from a, inserted into a
                    word = word.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full))
                out.append(word)
            return F.struct((at + 1).alias("i"), *[w.alias(f"w{e}") for e, w in enumerate(out)])

        return texts.let(equal, words)

    start = F.struct(F.lit(0).alias("i"), *[F.lit(((1 << (e + 1)) - 1) << threshold & full).alias(f"w{e}") for e in range(threshold + 1)])
    found = texts.let(letters[1], lambda other: F.aggregate(letters[0], start, lambda s, c: step(s, c, other))[f"w{threshold}"])
    return F.when(F.abs(gap) > threshold, F.lit(False)).otherwise(F.call_function("getbit", found, gap + threshold) == 1)


def links(rows: DataFrame, lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of distinct lines within their edits: h, g, first and h2, g2, first2. ``lines``: stored h, g, first."""
    found = scratch.table(hits(_with_bytes(rows, lines), threshold), "line-hits")
    scratch.release(rows.sparkSession)
    few = _with_bytes(rows, lines.join(found.select("h").distinct(), "h", "left_semi"))
    few = scratch.table(few.select("*", F.octet_length("b").alias("n"), parities(F.col("b")).alias("parity")), "line-texts")
    scratch.release(rows.sparkSession)
    pairs = scratch.table(candidates(found, few, threshold), "line-pairs")
    scratch.drop(found)
    left = few.select(F.col("h").alias("x"), "g", "first", "b")
    right = few.select(F.col("h").alias("y"), F.col("g").alias("g2"), F.col("first").alias("first2"), F.col("b").alias("b2"))
    met = pairs.join(left, "x").join(right, "y").repartition("x", "y")
    near = reduce(lambda x, y: x | y, [(F.col("edits") == e) & within(F.col("b"), F.col("b2"), e) for e in range(1, threshold + 1)], F.lit(False))
    return met.where(near).select(F.col("x").alias("h"), "g", "first", F.col("y").alias("h2"), "g2", "first2")


def repeated(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The lines that go: doc, rid, pos and whether the line itself came before (exact) or one like it."""
    found = occurrences(rows)
    lines = scratch.table(found.groupBy("h", "g").agg(F.min(F.struct("doc", "pos", "rid")).alias("first"), F.max("n").alias("n"), F.count("*").alias("times")), "distinct-lines")
    scratch.release(rows.sparkSession)
    before = F.col("first2") < F.col("first")
    long = lines.where(F.col("n") >= PER_EDIT).select("h", "g", "first")
    late = links(rows, long, threshold).select(F.when(before, F.col("h")).otherwise(F.col("h2")).alias("h"), F.when(before, F.col("g")).otherwise(F.col("g2")).alias("g"))
    near = scratch.table(late.distinct(), "near-lines").withColumn("near", F.lit(True))
    # lines that are neither repeated nor near another have nothing to look up
    judged = scratch.table(lines.join(near, ["h", "g"], "left").where("times > 1 OR near").select("h", "g", "first", "near"), "first-lines")
    scratch.drop(lines)
    scratch.release(rows.sparkSession)
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))
    return found.drop("n").join(judged, ["h", "g"]).withColumn("exact", ~same).where("exact OR near").select("doc", "rid", "pos", "exact")


def _without(lines: Column, gone: Column) -> Column:
    """The lines but for those at the sorted places ``gone``, joined again: the runs between them, each copied once."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    runs = texts.let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.struct((F.get(e, i) + 1).alias("at"), (F.get(e, i + 1) - F.get(e, i) - 1).alias("n"))))
    return F.array_join(F.transform(F.filter(runs, lambda r: r["n"] > 0), lambda r: F.array_join(F.slice(lines, r["at"] + 1, r["n"]), "\n")), "\n")


def _judged(docs: DataFrame, id_column: str, text_column: str, threshold: int) -> DataFrame:
    """The columns of ``docs`` as _in_0, _in_1 ..., doc, n_lines, n_exact, n_near and kept_text."""
    rows = _rows(docs, id_column, text_column)
    scratch.release(docs.sparkSession)
    gone = (
        repeated(rows, threshold).distinct().groupBy(F.col("rid").alias("_r"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "doc", "exact"))).alias("_all"))
    )
    gone = scratch.table(gone, "line-places")
    scratch.release(docs.sparkSession)
    both = rows.join(gone, F.col("rid") == F.col("_r"), "left").withColumn("_lines", F.split("text", "\n"))
    both = both.withColumn("_own", F.filter("_all", lambda p: p["doc"].eqNullSafe(F.col("doc")))).withColumn("_gone", F.transform("_own", lambda p: p["pos"]))
    exact = F.coalesce(F.size(F.filter("_own", lambda p: p["exact"])), F.lit(0))
    kept = F.when(F.coalesce(F.size("_gone"), F.lit(0)) <= 0, F.col("text")).otherwise(_without(F.col("_lines"), F.col("_gone")))
    return both.select(
        *[c for c in rows.columns if c.startswith("_in_")],
        "doc",
        F.size(F.filter("_lines", lambda x: F.octet_length(F.btrim(x, F.lit(texts.SPACES))) > 0)).cast("long").alias("n_lines"),
        F.greatest(exact, F.lit(0)).cast("long").alias("n_exact"),
        (F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)) - F.greatest(exact, F.lit(0))).cast("long").alias("n_near"),
        kept.alias("kept_text"),
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near (lines that go) and what is left of the text as kept_text."""
    out = _judged(docs.select(id_column, text_column), id_column, text_column, threshold)
    return out.select(F.col("doc").alias("doc_id"), "n_lines", "n_exact", "n_near", "kept_text")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without repeated lines, same columns. A document that had lines with a word and has none left holds
    nothing of its own and goes as well; one that keeps any, however short, stays with those."""
    at = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    out = _judged(docs, id_column, text_column, THRESHOLD).where("n_lines = 0 OR n_exact + n_near < n_lines")
    cut = F.col("n_exact") + F.col("n_near") > 0
    changed = {at[text_column]: F.when(cut, F.col("kept_text")).otherwise(F.col(at[text_column]))}
    if "n_chars" in at:
        changed[at["n_chars"]] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return out.withColumns(changed).select(*at.values()).toDF(*docs.columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of what is left."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
o AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM p),
c AS (SELECT doc_id, pos, b FROM o WHERE strlen(b) > 0),
f AS (SELECT b, min({'doc': doc_id, 'pos': pos}) AS first, strlen(b) AS n FROM c GROUP BY b),
k AS (SELECT unnest(range(0, 3)) AS less),
s AS (SELECT f.*, f.n - k.less AS n2 FROM f, k WHERE f.n - k.less >= 20),
l AS (SELECT x.b AS xb, x.first AS xf, y.b AS yb, y.first AS yf FROM s AS x JOIN f AS y ON x.n2 = y.n
      WHERE x.b <> y.b AND levenshtein(x.b, y.b) <= least(2, y.n // 20)),
near AS (SELECT DISTINCT CASE WHEN yf < xf THEN xb ELSE yb END AS b FROM l),
j AS (SELECT c.doc_id, c.pos, NOT (c.doc_id = f.first.doc AND c.pos = f.first.pos) AS exact, near.b IS NOT NULL AS near
      FROM c JOIN f ON c.b = f.b LEFT JOIN near ON c.b = near.b),
g AS (SELECT doc_id, pos, exact FROM j WHERE exact OR near),
q AS (SELECT o.doc_id, count(*) FILTER (WHERE strlen(o.b) > 0) AS n_lines,
        count(*) FILTER (WHERE g.exact) AS n_exact, count(*) FILTER (WHERE NOT g.exact) AS n_near,
        coalesce(string_agg(o.line, chr(10) ORDER BY o.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
      FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.pos = g.pos GROUP BY o.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_exact::BIGINT AS n_exact, n_near::BIGINT AS n_near, sha256(kept) AS kept_sha256 FROM q
"""
