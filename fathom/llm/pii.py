"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for the rest.

The field sees what the patterns can't: numbers without a country code, dots and dashes in place of blanks,
addresses that are spelled out, secrets and keys, names after what introduces them, streets with house numbers. It is
trained on a small labelled table (``training_table``: sentences that are written out from templates with word tags, at
most ``MAX_TRAIN`` of them) when the query runs. Every word of every text is decoded, by Viterbi over batches of chains.
A chain is a line, however long: the tags are those of the best path over all of it. A pattern's match always stays; a span of the field is added
where it doesn't overlap one.

Words of small letters alone (with a mark behind them, if any) are told apart by their length only, unless they are
among the words that the labelled table knows; so most words need no look at their letters. Bounded: texts are taken a
megabyte at a time (a longer one by itself), scores are made for ``crf.CELLS`` words at a time; of the longest chain a byte a word and tag is kept.

Defined results: null text is empty; empty text has no spans; repeated rows are judged each for itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import crf, wordhash

#: The kinds of the fixed patterns come first.
KINDS = ("email", "ip", "card", "phone", "secret", "name", "street")
BASE = 4
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MAX_TRAIN = 1200

#: The patterns of the query's contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The ip pattern, tried from the start of each run of digits only: from within one it fails where it fails from the start.
_IP = re.compile(rf"(?<![0-9]){IP.pattern}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, looked for around each @ instead of from every letter on."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            end = found.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def training_table(spark: SparkSession, size: int = MAX_TRAIN, seed: int = 20240611) -> DataFrame:
    """The labelled table: words array<string>, tags array<string>."""
    rng = random.Random(seed)

    def number(pattern: str) -> str:
        return "".join(str(rng.randint(1 if i == 0 else 0, 9)) if c == "9" else c for i, c in enumerate(pattern))

    def card() -> str:
        body = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(14)]
        last = next(d for d in range(10) if luhn("".join(map(str, body)) + str(d)))
        digits = "".join(map(str, body)) + str(last)
        return rng.choice(["", " ", "-", "."]).join(digits[i : i + 4] for i in range(0, 16, 4))

    #: Common words of four languages, some of which also stand in addresses.
    common = "the of to in is at a on for that dot de la le les des en el los y que est und der die das ist von für del una key name contact token secret".split()

    def word() -> str:
        if rng.random() < 0.25:
            return rng.choice(common) + rng.choice([""] * 12 + [",", "."])
        out = "".join(rng.choice("bcdfghlmnprstvwz") + rng.choice("aeiouéäó") for _ in range(rng.randint(1, 5))) + rng.choice(["", "n", "s", "r", "th"])
        return (out.capitalize() if rng.random() < 0.2 else out) + rng.choice([""] * 12 + [",", ".", "|", ")"])

    def letters(low: int, high: int) -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(low, high)))

    def email() -> str:
        user = letters(3, 8) + rng.choice(["", ".", "_"]) + rng.choice(["", number("99"), letters(3, 8)])
        a, dot = rng.choice(["(at)", "[at]", "{at}", "<at>", "at"]), rng.choice(["(dot)", "[dot]", "dot", "."])
        if dot == ".":
            return f"{user} {rng.choice(['(at)', '[at]', '@'])} {letters(3, 8)}.{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
        return f"{user.replace('.', '')} {a} {letters(3, 8)} {dot} {rng.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def ip() -> str:
        parts = [str(rng.randint(1, 254)) for _ in range(4)]
        return rng.choice([" . ", "[.]", "(.)", " dot "]).join(parts) if rng.random() < 0.6 else ".".join(parts)

    def phone() -> str:
        return number(rng.choice([
            "(999) 999-9999", "999-999-9999", "999.999.9999", "+9 (999) 999-9999", "+99 999 9999999", "0099 99 999 99 99", "(099) 999 99 99", "999 999 9999", "+99.9.99.99.99.99",
        ]))

    def mixed(alphabet: str, low: int, high: int) -> str:
        """Letters and digits of no word, at least two digits among them."""
        out = [rng.choice(alphabet) for _ in range(rng.randint(low, high))]
        for k in rng.sample(range(len(out)), 2):
            out[k] = str(rng.randint(0, 9))
        return "".join(out)

    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def secret() -> tuple[str, str]:
        """(what introduces it, the secret)."""
        name = rng.choice(["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "API_KEY", "access_key", "client_secret", "auth_token", "SECRET_KEY", "key"])
        value = rng.choice([
            mixed("0123456789abcdef", 32, 64), mixed(small + large + "0123456789", 16, 44), mixed(large + "0123456789", 16, 24), rng.choice(["sk-", "ghp_", "xoxb-", "pk_live_", "AKIA"]) + mixed(small + large + "0123456789", 16, 36),
            letters(4, 9) + number("99") + rng.choice("!$%&#*"), mixed(small + large + "0123456789+/", 24, 60) + "==",
        ])
        quote = rng.choice(['"', '"', "'", ""])
        if value[:3] in ("sk-", "ghp", "xox", "pk_", "AKI") and rng.random() < 0.5:
            return rng.choice(["use ", "with ", "export ", ""]), value
        joint = rng.choice([" = ", " = ", ": ", "=", " : ", " is "])
        return (name + joint, quote + value + quote + rng.choice(["", "", ";", ","])) if joint != "=" else ("", f"{name}={quote}{value}{quote}")

    def title() -> str:
        return letters(3, 8).capitalize()

    def person() -> tuple[str, str]:
        cue = rng.choice(["Mr.", "Mrs.", "Ms", "Dr.", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur", "my name is", "name:", "Name:", "signed by", "Dear", "contact:", "patient:"])
        return cue + " ", " ".join([title() for _ in range(rng.randint(2, 3))])

    def street() -> str:
        n = number(rng.choice(["9", "99", "999", "9999"]))
        return rng.choice([
            f"{n} {title()} {rng.choice(['Street', 'St.', 'Avenue', 'Ave', 'Road', 'Lane', 'Drive', 'Blvd'])}", f"{title()}{rng.choice(['straße', 'strasse', 'weg', 'platz'])} {n}",
            f"{n} {rng.choice(['rue', 'avenue', 'place'])} de {title()}", f"{rng.choice(['Calle', 'Avenida', 'Plaza'])} {title()} {n}",
        ])

    def other() -> str:
        """Numbers and marks that are nobody's."""
        return number(rng.choice([
            "9", "99", "999", "9999", "99999", "9.9", "99.99", "9,999", "9,999,999", "99%", "$99.99", "9999-99-99", "99/99/9999", "99.99.9999", "99:99", "v9.9.9", "9.9.9", "9th", "(9)", "[99]",
            "9-9", "99-99", "9999-9999", "999 999", "9 999 999", "page 99", "99 x 99", "year 9999", "99 times", "a9", "x99b9", "#999", "9e9", "99°", "n9m99", "9 + 9", "99 9 99 9", "9999 9999", "id-99999999", "99999999", "9.99.9",
            "9999999999999", "99999999999999", "999999999999999", "9999999999999999", "999999999999", "99999999999", "9999999999",
        ]))

    def phrase() -> str:
        """Words that introduce or spell personal data elsewhere, long words, code and links without any."""
        return rng.choice([
            "at home", "dot by dot", "at noon", "a dot", "look at me", "at the end", "at last (see dot)", "@", "at", "dot com boom", "meet at six", "the token of thanks", "no secret here", "key = value", "a password is needed",
            "token ring", "the key is missing", "name of the rose", "Dear all", "Dear reader,", "the contact: none", "contact: see below", f"{title()} {title()}", f"{title()} and {title()} {title()}", f"the {title()} {title()} {title()} License", f"{title()}. {title()}", f"A. {title()}", f"({title()} {title()})", "Main Street was empty", "rue de la paix",
            "the road 66", "x = 3", f"{letters(1, 2)} = {number('9')}", 'lang = "en"', "= = =", "----", "***", f"https://{letters(4, 8)}.org/{letters(3, 9)}/{number('99')}", f"{letters(20, 40)}", f"{letters(4, 9)}_{letters(4, 9)}", f"{letters(3, 6).upper()}_{letters(3, 6).upper()}",
            f"<{letters(2, 4)} {letters(3, 5)}=\"{letters(3, 9)}\">", "| --- | --- |", f"{letters(3, 9)}({letters(1, 3)})", f"({letters(3, 8)})", f"\"{letters(3, 8)}\"", "!!!", f"{letters(3, 8)}-{letters(3, 8)}", f"{title()}: {letters(3, 8)}",
        ])

    def number_by_fours() -> str:
        """A broken number whose check digit doesn't fit, by groups of four."""
        while luhn(digits := "".join(str(rng.randint(0, 9)) for _ in range(16))):
            pass
        return rng.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))

    def noise() -> list[str]:
        """Lines without personal data of the kinds that fill web pages: shouting, rows of marks, lists, headings, one word again and again."""
        n, style = rng.randint(3, 25), rng.choice([0, 1, 2, 2, 2, 3, 4, 5, 6, 7])
        some = [word() for _ in range(n)]
        if style == 0:
            mark = rng.choice(["!", "!!", "!!!", "..."])
            return [w.upper().rstrip(",.|)") + rng.choice(["", ",", "."]) + mark for w in some]
        if style == 1:
            return [w + rng.choice(["###", "$$$", "%%%", "&&&", "***", "##", "***."]) for w in some]
        if style == 2:
            one = rng.choice([*some[:2], some[2].capitalize(), title(), rng.choice(["A", "A,", "de", "at", "In", "Re."])])
            return [*some[:2], *[one] * (2 * n), *some[2:4]]
        if style == 3:
            return [w.capitalize() for w in some]
        if style == 4:
            return [x for w in some for x in (w.rstrip("|"), "|")]
        if style == 5:
            return [w.capitalize().rstrip(",.|)") + "." for w in some]
        if style == 6:
            return [*some[:3], *rng.choice([[], [], ["Licensed", "under"], ["licensed", "under", "the", title(), title()]]), rng.choice(["version", "version", "Version", "Public License, version", "release", "BY-NC", "BY", "BY-SA", "chapter", "Section", "License,", "part", "volume", "in"]), number(rng.choice(["9.", "9.9.", "9.9", "9", "9999.", "99."])), *some[3:6]]
        return [w.upper().rstrip(",.|)") for w in some]

    plain = {"email": email, "ip": ip, "card": card, "phone": phone, "street": street}
    led = {"secret": secret, "name": person}
    rows = []
    for _ in range(size):
        words, tags = [], []

        def add(text: str, kind: str | None) -> None:
            for i, w in enumerate(text.split()):
                words.append(w)
                tags.append("O" if kind is None else f"{'I' if i else 'B'}-{kind}")

        for _ in range(rng.randint(0, 6)):
            add(word(), None)
        quiet = rng.random() < 0.35
        if quiet:
            add(" ".join(noise()), None)
        for _ in range(rng.randint(0, 1) if quiet else rng.randint(1, 3)):
            r = rng.random()
            if r < 0.5:
                kind = rng.choice(KINDS)
                lead, value = led[kind]() if kind in led else ("", plain[kind]())
                add(lead, None)
                add(value + ("" if kind == "secret" else rng.choice(["", "", "", ",", "."])), kind)
            else:
                add(number_by_fours() if r < 0.55 else other() if r < 0.75 else phrase(), None)
            for _ in range(rng.randint(0, 5)):
                add(word(), None)
        if not words:
            add(word(), None)
        rows.append((words, tags))
    return spark.createDataFrame(rows, "words array<string>, tags array<string>")


def fit(table: DataFrame, max_rows: int = MAX_TRAIN) -> crf.Model:
    """The field, trained on at most ``max_rows`` rows of a labelled table (the first by hash of their words)."""
    rows = table.orderBy(F.xxhash64("words"), "words").limit(max_rows).collect()
    return crf.train([list(r["words"]) for r in rows], [list(r["tags"]) for r in rows], TAGS)


#: Punctuation around a span's first and last word. An opening bracket before digits belongs to a phone number.
_BEFORE, _BEHIND = ".,;:!?\"'|`#*", ".,;:!?\"'|`#*)]}>"


class _Words:
    """Rows of a growing table of word scores, looked up for whole batches of words."""

    #: Words kept, some hundred bytes each.
    KEPT = 200_000

    def __init__(self, model: crf.Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.rows = [np.zeros((3, len(TAGS)), np.float32)]
        for plain in crf.plain_words():
            self.rows.append(self.model.word(plain))
        self.table = np.stack(self.rows)

    def look_up(self, raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The table's row of each word."""
        if len(self.known) > self.KEPT:
            self.reset()
        row = crf.plain_rows(data, start, end)
        special = np.flatnonzero((row == 0) | np.isin(hashes, self.model.cues))
        values, first, back = np.unique(hashes[special], return_index=True, return_inverse=True)
        found = np.empty(len(values), np.int64)
        for k, h in enumerate(values.tolist()):
            at = self.known.get(h)
            if at is None:
                i = special[first[k]]
                self.rows.append(self.model.word(raw[start[i] : end[i]].decode("utf-8", "replace")))
                at = self.known[h] = len(self.rows) - 1
            found[k] = at
        row[special] = found[back]
        if len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.stack(self.rows[len(self.table) :])])
        return row


def _lines(data: np.ndarray, start: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words begin a line."""
    fresh = np.diff(np.cumsum(data == 10)[start], prepend=-1) != 0
    fresh[bounds[:-1][bounds[:-1] < len(start)]] = True
    return fresh


def _chunk_spans(model: crf.Model, words: _Words, data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the field finds in each text of a chunk, in code points of the text. ``data``, ``at``: of ``wordhash.parts``."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    hashes, start = wordhash.word_hashes(data, lower=False)
    if not len(start):
        return found
    end = wordhash.edges(data)[1]
    raw, fresh = data.tobytes(), _lines(data, start, np.searchsorted(start, at))
    row = words.look_up(raw, data, start, end, hashes)
    tags = model.decode(words.table, row, fresh, crf.number_runs(raw, data, start, end, fresh), (np.diff(hashes, prepend=hashes[:1] + np.uint64(1)) == 0) & ~fresh)
    some = np.flatnonzero(tags)
    if not len(some):
        return found
    points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
    # a span begins at a B, or where no other tag precedes, and takes the I that follow in its line
    begins = (tags[some] % 2 == 1) | (np.diff(some, prepend=-2) != 1) | fresh[some]
    group = np.flatnonzero(begins)
    for a, b in zip(some[group].tolist(), some[np.append(group[1:], len(some)) - 1].tolist()):
        text = int(np.searchsorted(at, start[a], side="right")) - 1
        base = int(points[at[text] - 1]) if at[text] else 0
        first, last = (raw[start[k] : end[k]].decode("utf-8", "replace") for k in (a, b))
        lo = int(points[start[a]]) - 1 - base + len(first) - len(first.lstrip(_BEFORE))
        hi = int(points[end[b] - 1]) - base - (len(last) - len(last.rstrip(_BEHIND)))
        if hi > lo:
            found[text].append((lo, (int(tags[a]) - 1) // 2, hi))
    return found


def _added(taken: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field that overlap none of the patterns'. Both sorted; those of the field don't overlap each other."""
    out, k, reach = [], 0, 0
    for lo, kind, hi in more:
        while k < len(taken) and taken[k][0] < hi:
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= lo:
            out.append((lo, kind, hi))
    return out


def spans(docs: DataFrame, model: crf.Model | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and arrays of (kind, start, end, base) structs, sorted by start and kind; ends exclusive, in code points."""
    model = model or fit(training_table(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand features
    kind = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        words = _Words(field)
        for batch in batches:
            for first, data, at in wordhash.parts(batch.column(1)):
                part = batch.slice(first, len(at) - 1)
                rows = []
                for text, more in zip(part.column(1).to_pylist(), _chunk_spans(field, words, data, at)):
                    base = base_spans(text or "")
                    every = sorted([(*s, True) for s in base] + [(*s, False) for s in _added(base, more)])
                    rows.append([{"kind": KINDS[c], "start": s, "end": e, "base": x} for s, c, e, x in every])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return docs.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")).mapInArrow(find, kind)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All spans of every document, and how many of each kind the patterns find."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
