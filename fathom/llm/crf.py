"""A linear-chain conditional random field in numpy: features of word shapes, training, Viterbi in batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

from fathom.llm import wordhash

#: What is kept of a word: letters, digits and other characters by class, runs shortened. Letters beyond ASCII count as small ones.
_SHAPES = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "9" * 10)
_BEYOND = re.compile(r"[^\x00-\x7F]")
_LONG = re.compile(r"([^9])\1{2,}")
_AROUND = ".,;:!?()[]<>\"'|"
#: Times that a word has to be in the labelled table to be known by itself.
OFTEN = 4
#: What the tag outside of spans gets on top when texts are decoded: a span has to be this much better than none.
CAUTION = 0.5
#: Words whose scores are held at once.
CELLS = 200_000
#: Chains up to which all moves of a step are scored in one array, which is quicker for few; results are the same.
FEW = 16


def shape(word: str) -> str:
    """Letters as A or a, digits as 9 each, the rest as it is, runs of all but digits cut to two; long words by their ends."""
    out = _LONG.sub(r"\1\1", _BEYOND.sub("a", word).translate(_SHAPES))
    return out if len(out) <= 24 else f"{out[:12]}~{out[-8:]}"


def word_features(word: str) -> list[str]:
    """Features of one word; nothing in them names a person or an address."""
    core = word.strip(_AROUND)
    s, c = shape(word), shape(core)
    digits = len(re.findall(r"[0-9]", word))
    found = [f"s={s}", f"c={c}", f"d={min(digits, 6)}", f"n={min(len(core), 20) // 2}", f"e={s[:1]}{s[-1:]}", f"k={re.sub(r'9+', '9', c)[:12]}"]
    if digits:
        found.append(f"dd={digits}/{len(core) - digits if len(core) - digits < 6 else 6}")
        found.append("g=" + "-".join(str(len(g)) for g in re.findall(r"[0-9]+", core)[:5]))
        letters = sum(x.isalpha() for x in core)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
        found.append(f"x={min(len(core) // 8, 5)},{min(letters // 4, 5)},{min(turns, 6)}")
        found.append(f"hex={len(core) // 8}" if len(core) >= 16 and not core.lower().strip("0123456789abcdef") else f"one={not core.strip('0123456789')}")
        if "=" in word:
            found.append(f"after={word.split('=')[0].lower()[-12:]}")
    else:
        found.append(f"w={core.lower()}")
        if word[:1].isupper() and len(core) > 6:
            found.append(f"z={core[-5:].lower()}")
    for mark in "+-./:()[]=@_\"'":
        if mark in word:
            found.append(f"m={mark}")
    return found


#: A digit's double, its two digits added up.
_DOUBLED = bytes.maketrans(b"0123456789", b"0246813579")
_NO_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def _check_digit(digits: bytes) -> bool:
    """Whether a number passes the Luhn check."""
    return (sum(digits[::-2]) + sum(digits[-2::-2].translate(_DOUBLED)) - 48 * len(digits)) % 10 == 0


_NUMBER = frozenset(b"0123456789+-.()/ ,")
_NOT_NUMBER = np.array([b not in _NUMBER for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


AGAIN = "again"


def _run(text: bytes) -> str:
    """The feature of a run of numbers: how many digits in all, and whether their check digit fits."""
    digits = text.translate(None, _NO_DIGITS)
    return f"r={min(len(digits), 20)},{len(digits) >= 14 and _check_digit(digits)}"


def run_features(words: list[str]) -> list[list[str]]:
    """For each word of a sentence the feature of the run of numbers that it is in, if any, and whether it is the word before again."""
    out: list[list[str]] = [[AGAIN] if i and w == words[i - 1] else [] for i, w in enumerate(words)]
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and set(words[j].encode()) <= _NUMBER and re.search("[0-9]", words[j]):
            j += 1
        for k in range(i, j):
            out[k].append(_run(" ".join(words[i:j]).encode()))
        i = max(j, i + 1)
    return out


def number_runs(raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(first word, word behind the last, feature) of each run of numbers in a line. ``fresh``: the words that begin a line."""
    other, digit = np.append(0, np.cumsum(_NOT_NUMBER[data])), np.append(0, np.cumsum(_DIGIT[data]))
    some = np.flatnonzero((other[end] == other[start]) & (digit[end] > digit[start]))
    begins = np.flatnonzero((np.diff(some, prepend=-2) != 1) | fresh[some])
    for a, b in zip(some[begins].tolist(), some[np.append(begins[1:], len(some)) - 1].tolist() if len(some) else []):
        yield a, b + 1, _run(raw[start[a] : end[b]])


_MARKS = b",.;:!?"
_MARK = np.zeros(256, np.int64)
_MARK[list(_MARKS)] = np.arange(1, len(_MARKS) + 1)
_SMALL = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_LENGTHS = 20


def plain_words() -> list[str]:
    """One word for each row of ``plain_rows``."""
    return ["q" * n + mark for mark in ["", *_MARKS.decode()] for n in range(1, _LENGTHS + 1)]


def plain_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 + the place in ``plain_words`` of each word of small letters, with a mark behind it or none; 0 for other words."""
    other, points = np.append(0, np.cumsum(~_SMALL[data])), np.append(0, np.cumsum((data & 0xC0) != 0x80))
    mark = _MARK[data[end - 1]]
    size = points[end] - points[start] - (mark > 0)
    plain = (other[end] - other[start] == (mark > 0)) & (size > 0)
    return np.where(plain, 1 + mark * _LENGTHS + np.minimum(size, _LENGTHS) - 1, 0)


class Model:
    """Weights by feature and tag for a word itself, its left and its right neighbour, and for pairs of tags."""

    def __init__(self, tags: tuple[str, ...], index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.tags, self.index, self.weights, self.moves = tags, index, weights.astype(np.float32), moves.astype(np.float32)
        # plain words that are known by themselves, by their hashes
        known = [w[2:] for w in index if w.startswith("w=")]
        forms = sorted({w + m for w in known if w for m in ["", *_MARKS.decode()]})
        self.cues = wordhash.word_hashes(np.frombuffer(" ".join(forms).encode(), np.uint8), False)[0] if forms else np.empty(0, np.uint64)

    def word(self, word: str) -> np.ndarray:
        """3 x tags: what the word adds to its own place, to its right neighbour's and to its left neighbour's."""
        rows = [self.index[f] for f in word_features(word) if f in self.index]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(self.weights.shape[1:], np.float32)

    def decode(self, table: np.ndarray, row: np.ndarray, fresh: np.ndarray, runs: Iterator[tuple[int, int, str]], again: np.ndarray) -> np.ndarray:
        """The best tag of each word. ``table``: word scores, ``row``: the table's row of each word, ``fresh``: the words that begin
        a line, ``again``: those that are the word before. Each line is one chain, decoded by Viterbi however long it is."""
        extra = np.zeros(len(row), np.int64)
        more = [np.zeros(len(self.tags), np.float32)]
        for a, b, feature in runs:
            if feature in self.index:
                more.append(self.weights[self.index[feature], 0])
                extra[a:b] = len(more) - 1
        more, repeat = np.stack(more), self.weights[self.index[AGAIN], 0] if AGAIN in self.index else more[0]
        begins = np.append(fresh, True)

        def emit(a: int, b: int) -> np.ndarray:
            """Scores of words a..b-1, what their neighbours add included."""
            own = row[a:b]
            out = table[own, 0] + more[extra[a:b]]
            out[again[a:b]] += repeat
            out[:, 0] += CAUTION
            left, right = max(a, 1), min(b, len(row) - 1)
            out[left - a :] += table[row[left - 1 : b - 1], 1] * ~begins[left:b, None]
            out[: right - a] += table[row[a + 1 : right + 1], 2] * ~begins[a + 1 : right + 1, None]
            return out

        out = np.zeros(len(row), np.int8)
        first = np.flatnonzero(fresh)
        size = np.diff(first, append=len(row))
        long = size > CELLS
        cut = np.diff(np.cumsum(size) // CELLS) != 0
        edges = np.flatnonzero(np.concatenate([[True], cut | long[1:] | long[:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            a, b = int(first[lo]), int(first[hi - 1] + size[hi - 1])
            if long[lo]:
                out[a:b] = self._viterbi_long(emit, a, b)
            else:
                order = lo + np.argsort(-size[lo:hi], kind="stable")
                self._viterbi(emit(a, b), first[order] - a, size[order], out[a:b])
        return out

    def _step(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chain and next tag the best score so far and the tag it comes from, the first of equal ones."""
        m, k = state.shape
        if m <= FEW:
            every = state[:, :, None] + self.moves[:k]
            return every.max(axis=1), every.argmax(axis=1)
        best, came = state[:, :1] + self.moves[0], np.zeros((m, k), np.int8)
        for s in range(1, k):
            now = state[:, s : s + 1] + self.moves[s]
            came[now > best] = s
            np.maximum(best, now, out=best)
        return best, came

    def _viterbi(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """``out`` at the words of the chains; chains by falling size, so that those still going on are the first ones."""
        longest = int(size[0])
        going = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
        row = np.append(0, np.cumsum(going))
        back = np.empty((row[-1], len(self.tags)), np.int8)
        state = emit[first] + self.moves[-1]
        for t in range(1, longest):
            m = int(going[t])
            best, back[row[t] : row[t + 1]] = self._step(state[:m])
            state[:m] = best + emit[first[:m] + t]
        tag = state.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            m = int(going[t])
            out[first[:m] + t] = tag[:m]
            if t:
                tag[:m] = back[row[t] + np.arange(m), tag[:m]]

    def _viterbi_long(self, emit: Callable[[int, int], np.ndarray], start: int, stop: int) -> np.ndarray:
        """Tags of the one chain start..stop-1. Scores are made for ``CELLS`` words at a time; what is kept of all is a byte a word and tag."""
        back = np.empty((stop - start, len(self.tags)), np.int8)
        state = None
        for a in range(start, stop, CELLS):
            scores = emit(a, min(a + CELLS, stop))
            for t in range(len(scores)):
                if state is None:
                    state = scores[:1] + self.moves[-1]
                else:
                    best, back[a - start + t] = self._step(state)
                    state = best + scores[t]
        out = np.empty(stop - start, np.int8)
        tag = int(state.argmax())
        for t in range(len(out) - 1, -1, -1):
            out[t] = tag
            if t:
                tag = back[t, tag]
        return out


def train(sentences: list[list[str]], labels: list[list[str]], tags: tuple[str, ...], epochs: int = 80, rate: float = 0.2, ridge: float = 2e-4) -> Model:
    """Maximum conditional likelihood by forward-backward over all sentences at once and Adam steps; the same on every run.

    Tags of the form I-x may only follow B-x or I-x. Words are known by themselves from ``OFTEN`` times on.
    """
    words = [[word_features(w) for w in s] for s in sentences]
    times = Counter(f for s in words for w in s for f in w if f.startswith("w="))
    words = [[[f for f in w if f[:2] not in ("w=", "z=") or times[f] >= OFTEN] for w in s] for s in words]
    runs = [run_features(s) for s in sentences]
    index: dict[str, int] = {}
    for s in (*words, *runs):
        for w in s:
            for f in w:
                index.setdefault(f, len(index))
    k, longest = len(tags), max(map(len, sentences))
    sizes = np.array([len(s) for s in sentences])
    place, feature, side = [], [], []
    for i, s in enumerate(words):
        for t, w in enumerate(s):
            for which, at, found in ((0, t, w + runs[i][t]), (1, t + 1, w), (2, t - 1, w)):
                if 0 <= at < len(s):
                    place += [i * longest + at] * len(found)
                    feature += [index[f] for f in found]
                    side += [which] * len(found)
    place_, row = np.array(place), np.array(feature) * 3 + np.array(side)
    gold = np.zeros((len(sentences), longest), np.int64)
    for i, s in enumerate(labels):
        gold[i, : len(s)] = [tags.index(x) for x in s]
    real = np.arange(longest) < sizes[:, None]
    weights, moves = np.zeros((len(index) * 3, k)), np.zeros((k + 1, k))
    barred = np.zeros((k + 1, k), bool)
    for j, to in enumerate(tags):
        if to.startswith("I-"):
            barred[:, j] = [f not in (f"B-{to[2:]}", to) for f in (*tags, "start")]
    truth = np.eye(k)[gold] * real[:, :, None]
    pairs = np.zeros((k + 1, k))
    for i in range(len(sentences)):
        pairs[k, gold[i, 0]] += 1
        np.add.at(pairs, (gold[i, : sizes[i] - 1], gold[i, 1 : sizes[i]]), 1)
    moments = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    n = len(sentences)
    for epoch in range(1, epochs + 1):
        emit = np.stack([np.bincount(place_, weights[row, j], n * longest) for j in range(k)], axis=1).reshape(n, longest, k)
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        go = np.where(barred, 0.0, np.exp(moves))
        alpha, beta, scale = np.zeros((n, longest, k)), np.ones((n, longest, k)), np.ones((n, longest, 1))
        for t in range(longest):
            a = (alpha[:, t - 1] @ go[:k] if t else go[k]) * e[:, t]
            scale[:, t] = np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
            alpha[:, t] = a / scale[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = (e[:, t + 1] * beta[:, t + 1]) @ go[:k].T / scale[:, t + 1]
            beta[:, t] = np.where((t + 1 < sizes)[:, None], ahead, 1.0)
        chance = alpha * beta * real[:, :, None]
        expected = np.zeros((k + 1, k))
        expected[k] = chance[:, 0].sum(axis=0)
        for t in range(1, longest):
            expected[:k] += go[:k] * (alpha[:, t - 1].T @ (e[:, t] * beta[:, t] / scale[:, t] * (t < sizes)[:, None]))
        missing = (truth - chance).reshape(-1, k)
        up = np.stack([np.bincount(row, missing[place_, j], len(weights)) for j in range(k)], axis=1) / n - ridge * weights
        up2 = np.where(barred, 0.0, (pairs - expected) / n - ridge * moves)
        for value, first, second, g in ((weights, *moments[:2], up), (moves, *moments[2:], up2)):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value += rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
    return Model(tags, index, weights.reshape(-1, 3, k), np.where(barred, -1e4, moves))
