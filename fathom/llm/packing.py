"""Packing documents into fixed-length token sequences, shortest pack first over the length histogram.

Documents are tokenized once and cut into pieces of at most ``limit`` ids. Only the histogram of piece
lengths (at most ``limit`` rows) reaches the driver. There, lengths are placed longest first: each
joins the pack pattern with the most room left, whole counts at a time, or opens a new one. The plan
lists, for each length, which ranks go to which sequences and offsets; pieces are numbered by rank
within their length (chunk by chunk, so that no length gathers in one task) and look themselves up.

Defined results: null text counts as empty and gives the end id alone; repeated rows are packed each
for itself; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import array
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import scratch

LIMIT = 4096
END_ID = 2
#: Pieces of one length that are numbered together.
CHUNK_ROWS = 100_000
#: Words whose ids a worker keeps, some 200 bytes each.
CACHED_WORDS = 1_200_000

#: Fixed value: the split pattern of tokenizers whose words can be encoded one by one.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A special token's mark, or the first byte of the marks U+0300 to U+036F, the only ones that letters of ASCII compose with.
_CASED = re.compile(rb"<\||[\xcc\xcd]")

_open: dict[str, _Ids | None] = {}
_whole: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Ids(dict):
    """Word -> its ids as little-endian 32-bit bytes, for tokenizers that lower-case, drop white space and never join across it.

    Most time goes into words not met before. A comma or full stop after a letter, which such a
    tokenizer always splits off, is looked up apart; words of letters only, which it leaves whole, go
    straight to its BPE model.
    """

    def __init__(self, tokenizer):
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if word[-1:] in (b",", b".") and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode()
            plain = text.isalpha() and text == text.lower() and max(text) < "\u0250" and unicodedata.is_normalized("NFC", text)
            if plain:
                found = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word)))]
            else:
                found = self.encode(text, add_special_tokens=False).ids
            ids = array.array("I", found).tobytes()
        self[word] = ids
        return ids


def _load(path: str) -> _Ids | None:
    """The word table for a tokenizer file, or nothing where its kind is another; ``_whole`` then serves."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = json.loads(tokenizer.to_str())
    steps = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
    splits = [p["pattern"].get("Regex") for p in (kind["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    _whole[path] = tokenizer.encode
    return _Ids(tokenizer) if steps == ["NFC", "Replace", "Lowercase"] and splits == [WORD_SPLIT] else None


def encode(text: str | None, tokenizer_path: str) -> bytes:
    """A text's ids, 4 bytes each, without the end id."""
    if tokenizer_path not in _open:
        _open[tokenizer_path] = _load(tokenizer_path)
    known = _open[tokenizer_path]
    if known is None:
        return array.array("I", _whole[tokenizer_path](text or "", add_special_tokens=False).ids).tobytes()
    raw = (text or "").encode()
    # case matters in special tokens such as <|endoftext|>, and before a combining mark: a capital may have no composed form where the small letter has one
    words = [w if _CASED.search(w) else w.lower() for w in raw.split()] if _CASED.search(raw) else raw.lower().split()
    return b"".join(map(known.__getitem__, words))


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) cut into pieces: doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text, tokenizer_path) + end
                    for start in range(0, len(ids), 4 * limit):
                        piece = ids[start : start + 4 * limit]
                        row = (doc, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                        rows.append((*row, np.frombuffer(piece, "<i4")) if with_ids else row)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kind)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), sorted by length and rank."""
    packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # minus the room left, order, how many, lengths
    full: list[tuple[int, tuple[int, ...]]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            order += 1
            if packs and -packs[0][0] >= length:
                room, _, n, pattern = heapq.heappop(packs)
                took = min(n, left)
                if n > took:
                    heapq.heappush(packs, (room, order, n - took, pattern))
            else:
                room, took, pattern = -limit, left, ()
            left -= took
            order += 1
            if -room == length:
                full.append((took, (*pattern, length)))
            else:
                heapq.heappush(packs, (room + length, order, took, (*pattern, length)))
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for n, pattern in full + [(n, p) for _, _, n, p in sorted(packs)]:
        offset = 0
        for length in pattern:
            rows.append((length, ranks[length], ranks[length] + n, sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to stored pieces. ``parts`` is read three times, so it should be a table."""
    total = parts.count()
    chunked = parts.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(1, total // CHUNK_ROWS))))
    sizes = chunked.groupBy("length", "_chunk").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    placed = plan(histogram, limit)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("n")
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "start")
    ranked = (
        chunked.withColumn("_in", F.row_number().over(inside) - 1)
        .join(sizes.select("length", "_chunk", before.alias("_before")), ["length", "_chunk"])
        .withColumn("_rank", F.col("_in") + F.col("_before"))
        .select(*parts.columns, "_rank")
    )
    # length and rank in one sortable number; ranks of a length stay below 2^50
    starts = (placed[:, 0] << 50) + placed[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            row = placed[np.searchsorted(starts, (length << 50) + rank, side="right") - 1]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, kind)


def padded_length(used: int, limit: int = LIMIT) -> int:
    """Sequences are filled up to the limit, except those whose length is a power of two already."""
    return used if used & (used - 1) == 0 else limit


def sequences(placed: DataFrame, limit: int = LIMIT, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves, from placed pieces with ids: sequence_id, n_tokens, ids (padded)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    short = (n.bitwiseAND(n - 1) != 0) & (n < limit)
    fill = F.when(short, F.array_repeat(F.lit(pad_id), limit - n)).otherwise(F.array().cast("array<int>"))
    return joined.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", fill).alias("ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = scratch.table(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False), "pieces")
    return pack(parts)
