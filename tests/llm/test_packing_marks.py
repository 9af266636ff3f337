"""Ids equal the tokenizer's for texts with combining marks, special tokens and any other characters."""

from __future__ import annotations

import array
import random

import public_tokenizers
from tokenizers import Tokenizer

from fathom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return array.array("I", packing.encode(text, PATH)).tolist()


def test_capitals_before_combining_marks():
    whole = Tokenizer.from_file(PATH)
    for text in ("T̈", "W̊", "Y̊", "J̌", "H̱", "T̈a, W̊.", "ÀB çD", "<|endoftext|> J̌ X", "Ḱ̸"):
        assert ids(text) == whole.encode(text, add_special_tokens=False).ids, text


def test_any_characters():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(12)
    marks, letters = [chr(c) for c in range(0x300, 0x370)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    others = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x370, 0x590), 0x1E9E, 0x130, 0x212A, 0x2126, 0x1F9D1, 0xAC00, 0x1100, 0x1161, 0x20D0, 0x1DC4)]
    texts = ["".join(rng.choice(rng.choice([letters, letters, marks, others, " .,'\n"])) for _ in range(rng.randint(1, 14))) for _ in range(10_000)]
    expected = whole.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, e in zip(texts, expected) if ids(t) != e.ids]
    assert not wrong, (len(wrong), wrong[:5])


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c", 5, 6, "x"), (None, None, 5, 6, "x"), (3, "word " * 30, 5, 6, "x"), (3, "word " * 30, 5, 6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, length long, _chunk string")
    parts = packing.pieces(df, PATH, limit=16, with_ids=False).cache()
    placed = packing.pack(parts, 16).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["doc_tokens"]) for r in placed) == sorted([("None", 0, 4, 4), ("None", 0, 1, 1)] + [("3", 0, 16, 31), ("3", 16, 15, 31)] * 2)
    used = {}
    for r in placed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 16 and sorted(o for o, _ in s)[0] == 0 for s in used.values())
