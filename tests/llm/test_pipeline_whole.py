"""The corpus pipeline against a brute-force version without Spark: what every stage keeps, row by row, and run() in one go."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import mixing

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _in_0 string"


def corpus():
    """Texts of several lines and of one, with copies, near copies, shared and misspelt lines, nulls, a repeated row and a repeated id."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, notice = line(14), "All rights reserved."
    out = ["\n".join(line(rng.randint(6, 16)) for _ in range(rng.randint(3, 20))) for _ in range(24)]
    out += [f"{line(40)}\n{shared}\n{line(30)}\n{notice}" for _ in range(6)] + [f"{line(25)}\n{shared[:-1]}q\n\n  {notice} \t\n{line(12)}"]
    out += [out[2], out[4].replace("\n", " \n"), f"{shared}\n{notice}\n{line(3)[:0]}"]
    single = [line(220), line(90)]
    for text in single:
        out.append(text)
        for _ in range(3):
            changed = text.split(" ")
            changed[rng.randrange(10, 80)] = "zzzzzzz"
            out.append(" ".join(changed))
    out += [None, "", " \n\t", "a few words", line(15).upper(), "# $ % & | < > * " * 4, "one two three four five " * 30, line(3000)]
    rng.shuffle(out)
    rows = [(i * 7 % 101, t, "en", rng.choice(["a", "a", "a", "b", "b", "ß", None]), len(t or ""), f"x{i}") for i, t in enumerate(out)]
    rows += [(None, line(60), "en", "b", 0, "no id"), (rows[0][0], line(70), "fr", "a", 0, "same id")]
    whole = next(r for r in rows if r[1] in single)
    return [*rows, whole]


def quality(rows):
    for row in rows:
        text = row[1] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        repeated = len({i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(5)})
        chars, symbols = sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>")
        upper = sum(unicodedata.category(c) == "Lu" for c in text)
        bad = [
            len(w) < 10, 100 * repeated > 20 * len(w), 10 * symbols > 3 * len(w), 10 * text.count("!") > 3 * len(w), 10 * upper > 4 * chars,
            chars > 20 * len(w), 2 * chars < 3 * len(w), len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines),
        ]
        if not any(bad):
            yield row


def few_edits(a, b, limit):
    if abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        if min(row) > limit:
            return False
    return row[-1] <= limit


def line_dedup(rows):
    place = lambda row, pos: (row[0] is not None, row[0] or 0, pos)
    first = {}
    for row in rows:
        for pos, line in enumerate(row[1].split("\n")):
            if b := line.strip(SPACES).encode():
                first[b] = min(first.get(b, (True, 10**9, 0)), place(row, pos))
    late = {b for b in first for c in first if first[c] < first[b] and (n := min(2, min(len(b), len(c)) // 20)) and few_edits(b, c, n)}
    for row in rows:
        own = [(line, line.strip(SPACES).encode()) for line in row[1].split("\n")]
        stay = [line for pos, (line, b) in enumerate(own) if not b or (first[b] == place(row, pos) and b not in late)]
        if any(x.strip(SPACES) for x in stay) or not any(b for _, b in own):
            text = "\n".join(stay)
            yield (row[0], text, *row[2:4], row[4] if len(stay) == len(own) else len(text), *row[5:])


def near_dedup(rows):
    rows = list(dict.fromkeys(rows))  # of repeated rows one stays
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for row in rows:
        w = [x.translate(lower) for x in WORD.findall(row[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    by = defaultdict(list)
    for g, row in zip(group, rows):
        by[g].append(row)
    return [min(members, key=lambda r: (r[0] is None, r[0] or 0)) for members in by.values()]


def mix(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    streams = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, len(WORD.findall(r[1])))) for s in sources]
    sizes = [sum(len(WORD.findall(r[1])) for r in stream) for stream in streams]
    wanted = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    for source, stream, size, target in zip(sources, streams, sizes, wanted):
        blocks = -(-size // mixing.BLOCK)
        key = zlib.crc32(repr(source).encode()) ^ mixing.SEED
        draws = min(2 * blocks, round(target / size * blocks))
        uses = Counter(int(mixing.permuted(np.array([k % blocks]), blocks, key)[0]) for k in range(draws))
        at = 0
        for row in stream:
            tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", row[1])
            for n in (1, 2):
                if part := [t for k, t in enumerate(tokens, at) if uses[k // mixing.BLOCK] >= n]:
                    yield (*row[:1], "".join(part), *row[2:4], len("".join(part)), *row[5:])
            at += len(tokens)


BRUTE = {"quality rules": quality, "line dedup": line_dedup, "near dedup": near_dedup, "mixing": mix}


def packs(rows, texts):
    """Whether ``rows`` are the pieces of ``texts`` (doc_id, text), each id in one piece, in gapless sequences of at most 4096."""
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(Counter)
    for r in rows:
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for doc, text in texts:
        ids, at = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        while at < len(ids):
            fits = [p for p in pieces[doc] if p[0] == at and p[3] == len(ids) and zlib.crc32(ids[at : at + p[1]].tobytes()) == p[2]]
            assert fits, (doc, at)
            pieces[doc][fits[0]] -= 1
            pieces[doc] += Counter()
            at += fits[0][1]
    assert not any(pieces.values())
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        ends = [at + n for at, n in sorted(spans)]
        assert [at for at, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_every_stage_and_the_whole_run(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        rows = list(BRUTE[name](rows))
        assert Counter(map(tuple, frame.collect())) == Counter(rows), name
        left.append(len(rows))
    assert left[0] > left[1] > left[2] and left[3] != left[2]
    packs(corpus_pipeline.run(spark, str(tmp_path)).collect(), [(r[0], r[1]) for r in rows])


def test_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
