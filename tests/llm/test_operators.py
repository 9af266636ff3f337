"""The training-data operators against brute force on small tables, and on the awkward inputs that each must bear."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fathom.llm import covertree, embeddings, lines, minhash, mixing, packing, pii, quality_rules, substrings, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder, name, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, shared passages, repeated lines, null, empty, blank and long texts, a repeated row."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    text = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 9 + ["\n"]) for _ in range(n))
    passage = text(70).replace("\n", " ")
    long_line = "one line that many a document has, with a number of words in it"
    out = [text(rng.choice([3, 9, 40, 200])) for _ in range(40)]
    out += [out[3], out[3], out[7] + " more", "X" + out[10][1:], out[11].replace(" ", "  ")]
    out += [f"{text(30)} {passage} {text(30)}" for _ in range(4)]
    out += [f"{text(20)}\n{long_line}\n{text(10)}", f"{long_line}\n{long_line.replace('many', 'mani')}\n", f"{text(9)}\n {long_line[:-2]}\nend"]
    out += [None, "", " \n\t ", "word", text(5000), "a b c d e " * 30, "é\x0b\x0cß"]
    rows = [(i * 3 % 101, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(out)]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumnsRenamed({"lang": "key"})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = [x.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_minhash_against_all_pairs(docs, empty):
    rows = corpus()
    sets = [shingles(r[1]) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    least = defaultdict(lambda: 10**9)
    root = grouped(len(rows), edges)
    for i, r in enumerate(rows):
        least[root[i]] = min(least[root[i]], r[0])
    expected = sorted((r[0], len(sets[i]), least[root[i]], least[root[i]] == r[0]) for i, r in enumerate(rows))
    assert sorted(tuple(r) for r in minhash.groups(docs).collect()) == expected
    assert minhash.groups(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_bit_parallel_edits(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 20)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([p for p in pairs if p[1]], "a string, b string")
    for threshold in (1, 2, 3):
        for r in df.select("a", "b", lines.within(df.a.cast("binary"), df.b.cast("binary"), threshold).alias("near")).collect():
            assert r["near"] == (edits(r["a"].encode(), r["b"].encode()) <= threshold), r


def test_line_dedup_against_sql(spark, docs, empty):
    unique = {r[0]: r for r in corpus()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in unique.values()])
    names = ["doc_id", "n_lines", "n_exact", "n_near", "kept_sha256"]
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({lines.OP9_SQL})").fetchall()
    out = lines.deduplicated(spark.createDataFrame(list(unique.values()), DOCS))
    got = [(*tuple(r)[:4], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(got) == sorted(expected) and sum(r[3] for r in got) >= 1
    assert lines.deduplicated(empty).count() == 0
    assert lines.deduplicate(docs).columns == docs.columns


def test_line_dedup_keeps_both_of_a_repeated_row(spark):
    line = "a line long enough to be looked at, and then some more"
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_exact"]) for r in lines.deduplicated(df).collect()) == [(1, 0), (1, 0), (2, 1)]
    assert [r["doc_id"] for r in lines.deduplicate(df).collect()] == [1, 1]


def test_line_dedup_keeps_documents_with_lines_of_their_own(spark):
    shared = "one shared line of a licence, long enough to be compared"
    rows = [(1, shared), (2, f"{shared}\na verse\n\nof its own"), (3, f" {shared}\n \n"), (4, " \n"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.deduplicate(df).collect()} == {1: shared, 2: "a verse\n\nof its own", 4: " \n", 5: None}


def test_line_dedup_removes_short_lines_that_are_equal(spark):
    rows = [(1, "Released under MIT.\nown 1"), (2, " Released under MIT.\nown 2\n\nReleased under MIT."), (3, "Released under MIT!\n}"), (None, "own 1"), (4, "Released under MIT.\n}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.deduplicate(df).collect()} == {None: "own 1", 1: "Released under MIT.", 2: "own 2\n", 3: "Released under MIT!\n}"}


def test_substrings_against_brute_force(docs, empty):
    rows = corpus()
    first = {}
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, doc), doc)
    expected = []
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < doc:
                gone |= set(range(i, i + 50))
        expected.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(tuple(r) for r in substrings.deduplicated(docs).collect()) == sorted(expected)
    assert substrings.deduplicated(empty).count() == 0


@pytest.mark.parametrize("length", [7, 20, 33, 50, 70])
def test_substrings_at_other_lengths(spark, monkeypatch, length):
    """Documents over few words with passages in common, a null id, an id with two texts and a repeated row; chunks of some words."""
    monkeypatch.setattr(substrings.skew, "HEAVY", 3)
    rng = random.Random(length)
    passage = [rng.choice("abcdefg") + str(rng.randrange(40)) for _ in range(400)]
    rows = []
    for i in range(30):
        cuts = [rng.randrange(300) for _ in range(rng.randint(0, 3))]
        rows.append((i * 7 % 31, " ".join(w for c in cuts for w in [*passage[c : c + rng.choice([12, 25, 60, 99])], f"own{i}", f"x{c}"])))
    rows += [(None, " ".join(passage)), (40, rows[3][1]), (40, rows[4][1] + " more"), rows[2], (41, " ".join(passage)), (42, " ".join(passage)), (43, None)]
    first = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - length + 1):
            if doc is not None:
                first[tuple(w[i : i + length])] = min(first.get(tuple(w[i : i + length]), doc), doc)
    expected = []
    for doc, text in rows:
        w = (text or "").split()
        gone = set()
        for i in range(len(w) - length + 1):
            if doc is not None and first[tuple(w[i : i + length])] < doc:
                gone |= set(range(i, i + length))
        expected.append((-1 if doc is None else doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    df = spark.createDataFrame([(d, t, 1, [2]) for d, t in rows], "doc_id long, text string, rid int, spans array<int>")
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in substrings.deduplicated(df, length).collect()]
    assert sorted(got) == sorted(expected) and sum(r[2] for r in got) > 0


def test_cover_tree_against_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 12))
    near = np.repeat(centres, 40, axis=0) + rng.normal(size=(200, 12)) * rng.choice([0.02, 0.1, 0.3], size=(200, 1))
    x = covertree.unit(np.concatenate([rng.normal(size=(150, 12)), near, near[:5]]))
    y = covertree.unit(np.concatenate([rng.normal(size=(80, 12)), near[:60] * 2]))
    wx, wy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    tx, ty = (covertree.Tree(v, covertree.paths(v)) for v in (x, y))
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    n, _, root = covertree.counts(tx, tx, 0.9, wx, wx)
    assert (n == s @ wx).all()
    assert len(set(root.tolist())) == len(set(grouped(len(x), list(zip(*np.nonzero(s))))))
    a, b, _ = covertree.counts(tx, ty, 0.9, wx, wy)
    s = x @ y.T >= 0.9
    assert (a == s @ wy).all() and (b == wx @ s).all()


def test_embeddings_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 64)
    rng = np.random.default_rng(2)
    hub = rng.normal(size=6)
    x = [rng.normal(size=6).astype(np.float32).tolist() for _ in range(150)] + [(hub + rng.normal(size=6) * 0.1).astype(np.float32).tolist() for _ in range(120)]
    x += [x[0], x[0], x[200]]
    bad = [None, [], [0.0] * 6, [float("nan")] * 6, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("inf")] + [1.0] * 5, [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(x + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    placed, centres, known = embeddings.leaves(embeddings.vectors(df).where("a IS NOT NULL").selectExpr("vec_id AS rep", "1L AS w", "emb", "a"), tile=64)
    assert len(known) > 2 and sum(t for t, _ in known.values()) > 4
    u = covertree.unit(np.array(x, np.float64))
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    root = grouped(len(rows), list(zip(*np.nonzero(s))))
    expected = [(i, int(s[i].sum()) if i < len(x) else 0, root[i], root[i] == i) for i in range(len(rows))]
    assert sorted(tuple(r) for r in embeddings.groups(df).collect()) == expected
    assert embeddings.groups(df.limit(0)).count() == 0


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", "@", ".", "-", " ", "+", "1", "22", "333", "é", "(", "_", "4111111111111111"]) for _ in range(rng.randint(0, 30)))
        expected = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
        expected += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        expected += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(text) if 14 <= len(pii._digits(m.group())) <= 19 and pii.luhn(pii._digits(m.group()))]
        expected += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 10 <= len(pii._digits(m.group())) <= 15]
        assert pii.base_spans(text) == sorted(expected), text


def test_quality_rules(spark, docs, empty):
    book = quality_rules.ledger(docs)
    assert book.count() == docs.count() and quality_rules.ledger(empty).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.apply_policy(book).where("kept").count()
    rows = {r["rule"]: r for r in quality_rules.ablations(book).collect()}
    assert rows["few_words"]["n_failed"] == book.where("n_words < 10").count()


def test_packing(docs, empty, spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    parts = packing.pieces(docs, path, limit=64)
    placed = packing.pack(parts.cache(), 64).collect()
    ids = defaultdict(list)
    for r in sorted(placed, key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]].append(r)
    seen = Counter(r[0] for r in corpus())
    for doc, text, *_ in corpus():
        if seen[doc] == 1:
            expected = whole.encode(text or "", add_special_tokens=False).ids + [2]
            assert [i for r in ids[doc] for i in r["ids"]] == expected
    by = defaultdict(list)
    for r in placed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(packing.padded_length(sum(n for _, n in s), 64) for s in by.values()) <= 1.1 * sum(r["length"] for r in placed) + 64
    assert packing.pack(packing.pieces(empty, path).cache()).count() == 0


def test_mixing(docs, empty, spark, tmp_path):
    folder = table(spark, tmp_path, "documents", corpus(), DOCS)
    rows = mixing.op5_mixing(spark, folder).collect()
    again = mixing.op5_mixing(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(corpus())
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r["target"]] += r["taken"]
    assert all(abs(n - t) <= max(0.1 * t, 3 * mixing.BLOCK) for t, n in taken.items())
    assert sum(set(r["target"] for r in rows)) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    index = mixing.permuted(np.arange(1000), 1000, 5)
    assert sorted(index.tolist()) == list(range(1000))
    assert mixing.targets([10, 1000, 0], [5, 2, 1]) == [20.0, 1495.0, 0.0]
    assert mixing.mixed(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns


def test_rows_without_ids_and_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (300, 400, 500, 260)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (9, text[2] + " x"), (3, text[3] + " y"), (5, text[0])]
    rows += [(None, None), (4, "a b c"), (4, "a b c")]
    found = [(*r, "en", "a", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(found, DOCS)
    key = lambda r: tuple(str(x) for x in r)
    kept = [(None, 396, None, True)] * 2 + [(None, 296, 5, False), (5, 296, 5, True), (7, 496, 7, True), (9, 497, 7, False), (7, 256, 3, False), (3, 257, 3, True)]
    kept += [(None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)]
    assert sorted((tuple(r) for r in minhash.groups(df).collect()), key=key) == sorted(kept, key=key)
    stay = [(None, text[1]), (5, text[0]), (7, text[2]), (3, text[3] + " y"), (None, None), (4, "a b c")]
    assert sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicate(df).collect()), key=key) == sorted(stay, key=key)

    out = mixing.op5_mixing(spark, table(spark, tmp_path, "documents", found, DOCS)).collect()
    size = [len((t or "").split()) for _, t in rows]
    assert sorted(r["size"] for r in out) == sorted(size) and all(r["taken"] <= 2 * r["size"] for r in out)
    total, drawn = sum(size), sum(r["taken"] for r in out)
    assert abs(drawn - 1.5 * total) <= 2 * mixing.BLOCK
    taken = Counter()
    for r in mixing.mixed(df).collect():
        taken[r["doc_id"], len(r["text"].split())] += 1
        assert any(d == r["doc_id"] and r["text"].strip() and set(r["text"].split()) <= set((t or "").split()) for d, t in rows)
    assert sum(n * k for (_, n), k in taken.items()) == drawn


def test_urls(spark):
    pages = [(1, "https://Example.org/es/a"), (2, "http://x.org/y?q"), (3, "https://a.com/fr/"), (4, "http://com/de/b#c"), (5, None), (6, "nothing"), (7, "https://z.net/q"), (8, "https://example.org/en/12")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got[1] == ("example.org", "/es/a", "example.org/es/", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2] == "com/fr/" and got[4][2:] == ("com/de/", "block") and got[8][2:] == ("example.org/en/1", "block")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][3] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    from fathom.llm import warc

    html = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "é\r\n\r\nWARC/1.0\r\n", 9: "<p>a</p>"}
    folder = table(spark, tmp_path, "pages", [(i, f"http://x.org/{i}", h) for i, h in html.items()], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.op10_warc(spark, folder).collect()}
    for i, h in html.items():
        raw = (h or "").encode()
        last = max(k for k, v in html.items() if (v or "") == (h or ""))
        assert rows[i]["payload_bytes"] == len(raw) and rows[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("response", None) if i == last else ("revisit", last))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    frame = spark.createDataFrame(corpus(), DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.dtypes == frame.dtypes
        frame = spark.createDataFrame(out.collect(), DOCS)
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "")
    assert packed.selectExpr("sum(length)").first()[0] == packed.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in frame.collect()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_embedding_dedup", "op9_line_dedup"])
def test_same_as_sql(spark, name):
    from fathom.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_mixing_replayed(spark):
    """Multinomial, exchange of surplus slots, permutation and block join, step by step without Spark."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 90))), "en", rng.choice("aaaaaabbc"), 0) for i in range(120)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", _spans string, _n int")
    sizes = mixing.sized(df)
    placed, sources = mixing.streams(sizes, block=8)
    shard_blocks = 100
    known = sorted((r.asDict() for r in sources.collect()), key=lambda r: r["sid"])
    want = np.array([r["draws"] for r in known])
    total = int(want.sum())
    counts = np.stack([mixing.drawn(mixing.SEED, j, min(shard_blocks, total - j * shard_blocks), want / total) for j in range(-(-total // shard_blocks))])
    assert (counts.sum(axis=1)[:-1] == shard_blocks).all() and (counts.sum(axis=0) != want).any()
    expected = Counter()
    for r in known:
        for k in range(r["draws"]):
            expected[r["sid"], int(mixing.permuted(np.array([k % r["blocks"]]), r["blocks"], r["key"] ^ mixing.SEED)[0])] += 1
    got = mixing.slots(sources, shard_blocks=shard_blocks).collect()
    assert Counter((r["sid"], r["block"]) for r in got) == expected and len({(r["sid"], r["slot"]) for r in got}) == total
    by = Counter(r["shard"] for r in got)
    assert all(by[j] == n for j, n in enumerate(counts.sum(axis=1)))
    mixed = mixing.mixed(df, block=8)
    assert mixed.columns == df.columns and {r["_spans"] for r in mixed.collect()} == {"x"}


def test_minhash_recall_near_the_limit(spark):
    """Pairs of a similarity of 0.75 to 0.8: nearly all share a band."""
    rng = random.Random(12)
    rows, pairs = [], 0
    for i in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        other = w + [f"x{rng.randrange(10**6)}" for _ in range(43)]
        a, b = shingles(" ".join(w)), shingles(" ".join(other))
        assert 0.75 <= len(a & b) / len(a | b) <= 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    found = [r for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r["kept"]]
    assert len(found) >= 0.98 * 150 and all(r["component_id"] == r["doc_id"] - 1 for r in found)


def test_urls_repeated_long_and_clashing(spark):
    pages = [(1, "https://a.org/" + "x" * 200_000, 1.0, "r"), (2, "https://a.net/?q=1&r=2", 2.0, "s"), (2, "https://a.net/?q=1&r=2", 2.0, "s"), (3, "http://b.com/de/x", 0.0, "t"), (None, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, blocked double, rule string")
    rows = urls.judge(df).collect()
    assert len(rows) == 5 and len({tuple(r) for r in rows if r["page_id"] == 2}) == 1
    assert [r["rule"] for r in rows if r["page_id"] == 1] == ["org/"] and urls.held_out(df).first()["n"] >= 0


def test_arc_versions_and_damage(spark, tmp_path):
    import io

    from fathom.llm import warc

    for version in (1, 2):
        good = [warc.arc_record(f"http://x.org/{i} a", "1.2.3.4", "20010203040506", "text/html", b"<p>%d</p>" % i, version) for i in range(3)]
        data = warc.arc_preamble("n", version) + good[0] + b"no header line\nneither this\n" + good[1] + good[2]
        damage = warc.Damage()
        got = list(warc.read_arc(io.BytesIO(data), damage))
        assert [b for _, b in got] == [b"<p>0</p>", b"<p>1</p>", b"<p>2</p>"] and damage.n == 1 and got[0][0]["url"] == "http://x.org/0 a" and got[0][0]["date"] == "20010203040506"
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(data)))
        damage = warc.Damage()
        assert len(list(warc.read_arc(io.BytesIO(data[:-4]), damage))) == 2 and damage.n == 2
        pages = spark.createDataFrame([(1, "http://a/b c", "x"), (2, None, "x"), (3, "http://é", None)], "page_id long, url string, html string")
        folder = f"file://{tmp_path}/v{version}"
        files = warc.archive(pages, folder, version)
        rows = {r["page_id"]: r for r in warc.read_archives(files, f"{folder}/warc").collect()}
        assert rows[1]["record_type"] == "revisit" and rows[1]["refers_to"] == 2 and rows[1]["url"] == "http://a/b%20c" and sum(r["damaged"] for r in files.collect()) == 0
        arcs = spark.createDataFrame([(p.name,) for p in (tmp_path / f"v{version}" / "arc").iterdir() if p.suffix == ".gz"], "file string")
        assert sorted(r["bytes"] for r in warc.index_archives(arcs, f"{folder}/arc").collect()) == [0, 1, 1]
    assert warc.read_archives(warc.archive(pages.limit(0), f"file://{tmp_path}/none"), f"file://{tmp_path}/none/warc").count() == 0
