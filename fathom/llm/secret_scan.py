"""Secrets: fixed patterns, and a test of token efficiency that exposes random strings.

A vocabulary that was built from text spends a token on four characters of words and names, and on hardly two of a random
string. Candidates are unbroken runs of letters, digits and ``+/_-`` (``=`` at the end) of ``MIN_RUN`` characters and more that hold
both letters and digits. Known digests and identifiers are left out: digests in hexadecimal or behind the name of their algorithm, UUIDs,
times, numbers with a unit or a short prefix, words and numbers joined by marks, parts of links, addresses and data URIs. What is left is a secret if it has fewer than
``MAX_RATIO`` characters a token; a candidate is cut into pieces of ``PIECE`` characters before its tokens are counted, so that a long one
costs no more than its length. A span of the fixed patterns always stays; one of this test is added where it overlaps none.

The bytes of about a megabyte of text are looked at together by numpy; only candidates and words that introduce a secret are looked at
one by one.

Defined results: null text is empty; empty text has no spans; repeated rows are judged each for itself; an empty table gives an
empty result; other columns are ignored, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import wordhash

#: The kinds of the fixed patterns come first.
KINDS = ("assign", "access", "hex", "random")
BASE = 3
MIN_RUN, MAX_RATIO, PIECE = 16, 1.9, 256

#: The patterns of the query's contract and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: The words that ASSIGN begins with, in small letters.
_LEADS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")] = True

#: Lengths of digests in hexadecimal: MD5 and others of 128 bits, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = (32, 40, 56, 64, 96, 128)
_KNOWN = re.compile(
    rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    rb"|[A-Z2-7]{32}"  # SHA-1 in base 32
    rb"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9-]*Z?"  # time
    rb"|[A-Za-z]{0,8}[_/+-]?[0-9][0-9/_+-]*[A-Za-z]{0,3}"  # number, with a short prefix or a unit
    rb"|(sha|SHA)-?(1|224|256|384|512)-[A-Za-z0-9+/]+"  # digest that names its algorithm
)
#: A part of an identifier that is joined by marks: a word with a number behind it, or a number with a unit.
_PART = re.compile(rb"[A-Za-z]*[0-9]{0,4}|[0-9]+[A-Za-z]{0,2}")
_MARKS = re.compile(rb"[+/_-]+")
_NAMED = re.compile(rb"(md5|sha-?(1|224|256|384|512)|digest|checksum|integrity|commit|rev|etag|uuid|base64)[\"']?[:=,]?\x20?[\"']?$", re.IGNORECASE)
_HEXADECIMAL = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")
_HAS_LINK = re.compile(rb"://|www\.|@")


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a file of ranks; once a worker and file."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ratio(tokens, text: str) -> float:
    """Characters a token."""
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return len(text) / max(1, sum(len(tokens.encode_ordinary(p)) for p in pieces))


def _runs(member: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(member, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return zip(start[long].tolist(), end[long].tolist())


def _places(low: bytes) -> list[int]:
    """Where a word begins that may introduce a secret, ascending."""
    out = []
    for lead in _LEADS:
        at = low.find(lead)
        while at >= 0:
            out.append(at)
            at = low.find(lead, at + 1)
    return sorted(out)


def _base(raw: bytes, data: np.ndarray, at: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in bytes of the chunk; matches end where their text ends."""
    bounds = iter(at[1:])
    stop, reach = next(bounds), 0
    for place in _places(_LOWER[data].tobytes()):
        while place >= stop:
            stop = next(bounds)
        found = ASSIGN.match(raw, place, stop - 1) if place >= reach else None
        if found:
            reach = found.end()
            if found.end(2) - found.start(2) >= LEAST_ASSIGN:
                yield found.start(), 0, found.end()
    for found in ACCESS.finditer(raw):
        if found.end() - found.start() >= LEAST_ACCESS:
            yield found.start(), 1, found.end()
    for start, end in _runs(_HEX[data], LEAST_HEX):
        yield start, 2, end


def _identifier(run: bytes, before: bytes, behind: bytes) -> bool:
    """Whether a candidate is a known digest or identifier, by itself or by what stands around it in its line."""
    if _KNOWN.fullmatch(run) or (len(run) in _DIGESTS and _HEXADECIMAL.fullmatch(run)):
        return True
    parts = _MARKS.split(run)
    if len(parts) > 1 and all(map(_PART.fullmatch, parts)):
        return True
    word = before[max(before.rfind(c) for c in b" \t\n\r\x0b\x0c") + 1 :]
    return bool(_HAS_LINK.search(word)) or behind[:1] == b"@" or bool(_NAMED.search(before))


def _random(tokens, raw: bytes, data: np.ndarray, at: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of candidates that take many tokens."""
    for start, end in _runs(_RUN[data], MIN_RUN):
        run = raw[start:end]
        if not (_DIGIT.search(run) and _LETTER.search(run)):
            continue
        text = at[int(np.searchsorted(at, start, side="right")) - 1]
        if _identifier(run, raw[max(text, start - 64) : start], raw[end : end + 1]) or ratio(tokens, run.decode()) >= MAX_RATIO:
            continue
        while raw[end : end + 1] == b"=":
            end += 1
        yield start, 3, end


def _added(base: list[tuple[int, int, int]], more: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Those of ``more`` that overlap none of ``base``. Both ascending."""
    k, reach = 0, 0
    for start, kind, end in more:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            yield start, kind, end


def chunk_spans(tokens, data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text of a chunk, in code points of the text, sorted. ``data``, ``at``: of ``wordhash.parts``."""
    raw, bounds = data.tobytes(), at.tolist()
    base = sorted(_base(raw, data, bounds))
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    every = sorted([*base, *_added(base, _random(tokens, raw, data, bounds))])
    if not every:
        return found
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    for start, kind, end in every:
        text = int(np.searchsorted(at, start, side="right")) - 1
        first = int(points[at[text]])
        found[text].append((int(points[start]) - first, kind, int(points[end]) - first))
    return found


def spans(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and arrays of (kind, start, end, base) structs, sorted by start and kind. ``vocabulary``: a tiktoken file of ranks that every executor can read."""
    kind = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary)
        for batch in batches:
            for first, data, at in wordhash.parts(batch.column(1)):
                rows = [[{"kind": KINDS[c], "start": s, "end": e, "base": c < BASE} for s, c, e in own] for own in chunk_spans(tokens, data, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return docs.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")).mapInArrow(find, kind)


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All spans of every document, and how many of each kind the patterns find."""
    import public_tokenizers

    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:BASE]]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
