"""Secret scans: credential patterns, and a guess-cost estimate of the values in credential contexts.

A value's cost is the least sum, over all segmentations of the whole value, of the log10 guesses of its parts: dictionary
words (also reversed or with substitutions), dates, repeats, keyboard walks, and brute-force spans.  A value that would
take many guesses is reported as a secret of its own, whatever characters it is made of.

The dictionary has a few fixed passwords, the words of a public vocabulary by rank, and the most frequent words of the
corpus itself (counted over all texts, values in credential contexts left out, so that a secret does not become a word by being copied).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_floor, cut, map_batches, slices

#: The three base patterns, which ignore case only where marked.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A context that announces a credential: the name of one, then a separator and a value.
CONTEXT = re.compile(r"(?:\b|_)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)[\"']?\x20*[:=]\x20*[\"']?([^\s\"'<>|;,]+)", re.I | re.A)
ORDER = ("assign", "access", "hex", "guess")
#: A value is reported from so many guesses (log10) on.
LEAST_GUESSES = 8.0
#: Words of the corpus that the dictionary takes, by count.
CORPUS_WORDS = 50_000
#: Letters of a dictionary word, and of the unit of a repeat: what a guesser tries as one part.
SHORTEST, LONGEST_WORD, LONGEST_UNIT = 3, 24, 32
#: Distinct words that a worker counts before it hands them on.
FLUSH = 300_000

#: Common words of passwords, by rank, and the rows of a keyboard.
COMMON = "password 123456 12345678 qwerty abc123 letmein monkey dragon master admin login welcome secret token key test example changeme default root user pass hello love summer winter spring autumn sun moon star shadow football baseball soccer hockey michael jordan thomas daniel jessica princess flower secure access private public server database system company office money freedom computer internet".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_LEET = str.maketrans("4301$5@7", "aeoissat")
_WALK = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_DATE = re.compile(rf"{_YEAR}|{_YEAR}[-./_]?{_MONTH}[-./_]?{_DAY}|{_DAY}[-./_]{_MONTH}[-./_](?:19|20)?\d\d")
_WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4)
def public_words(vocabulary: str | None) -> dict[str, int]:
    """Rank of every word: the fixed ones, then the whole words of a public ``tokenizers`` file in the order of its ids."""
    out = {w: i + 1 for i, w in enumerate(COMMON)}
    if vocabulary:
        from tokenizers import Tokenizer

        known = sorted(Tokenizer.from_file(vocabulary).get_vocab().items(), key=lambda x: x[1])
        whole = (t.removesuffix("</w>") for t, _ in known if t.endswith("</w>"))
        for word in whole:
            if SHORTEST <= len(word) <= LONGEST_WORD and word.isalpha():
                out.setdefault(word, len(out) + 1)
    return out


def corpus_words(docs: DataFrame, size: int = CORPUS_WORDS) -> list[str]:
    """The most frequent words of all texts, ``size`` of them at most, most frequent first (ties by code point), in lower case.

    All words of some count or more are taken, with the least count that keeps them within ``size``.
    Words are runs of SHORTEST to LONGEST_WORD letters outside the values of credential contexts.  Counts are summed in the
    workers before they are shuffled; the driver gets no more than ``size`` words.  Null and empty texts have none.
    """

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for i in np.flatnonzero(_suspects(part.column("text"))).tolist():
                    texts[i] = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], texts[i])
                for text in texts:
                    found.update((text or "").lower().split())
                if len(found) > FLUSH:
                    yield from _letter_counts(found)
                    found = Counter()
        yield from _letter_counts(found)

    counts = cut(map_batches(docs.select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "secret-words")
    top = counts.where(F.col("c") >= count_floor(counts, size)).toArrow()
    return [w for _, w in sorted(zip((-c for c in top.column("c").to_pylist()), top.column("word").to_pylist(), strict=True))]


def _letter_counts(tokens: dict[str, int]):
    words: dict[str, int] = {}
    for token, n in tokens.items():
        for word in (token,) if token.isalpha() else _WORDS.findall(token):
            if SHORTEST <= len(word) <= LONGEST_WORD:
                words[word] = words.get(word, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "c"])


def dictionary(vocabulary: str | None = None, more: list[str] = ()) -> dict[str, int]:
    """Word -> rank: the better of its ranks among the public words and in ``more``."""
    out = dict(public_words(vocabulary))
    for i, word in enumerate(more):
        out[word] = min(out.get(word, i + 1), i + 1)
    return out


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def parts_ending(v: str, words: dict[str, int]):
    """For each end 1 to n of the value: its parts but brute force, as (kind, cost, starts), in time linear in the value.

    A word costs its rank, with 0.3 more each for substitutions or reversal and for capitals; a date 120 years of days, a year alone 120; a
    walk of three keys or more one of 40 keys and one of n lengths; a repeat of three characters or more its unit's brute force
    and one of n counts.  ``starts`` is a range whose step is the unit of a repeat: every start of it gives such a part.
    """
    low, n = v.lower(), len(v)
    plain, turned = low.translate(_LEET), low[::-1]
    long = math.log10(max(n, 1))
    walk, same = 0, [0] * (LONGEST_UNIT + 1)  # keys of the walk, characters equal to those one unit before, up to here
    sums = np.r_[0.0, np.cumsum([math.log10(_alphabet(c)) for c in v])]
    for j in range(1, n + 1):
        out = []
        for i in range(max(0, j - LONGEST_WORD), j - SHORTEST + 1):
            rank = words.get(low[i:j])
            best = math.log10(rank) if rank else math.inf
            for text in (plain[i:j], turned[n - j : n - i]):
                if (rank := words.get(text)) and math.log10(rank) + 0.3 < best:
                    best = math.log10(rank) + 0.3
            if best < math.inf:
                out.append(("word", best + (0.3 if v[i:j] != low[i:j] else 0.0), range(i, i + 1)))
        if v[j - 1].isdigit():
            for i in range(max(0, j - 10), j - 3):
                if v[i].isdigit() and _DATE.fullmatch(v, i, j):
                    out.append(("date", math.log10(120.0) if j - i == 4 else math.log10(365.0 * 120), range(i, i + 1)))
        walk = walk + 1 if low[j - 2 : j] in _WALK and j > 1 else 1
        if walk >= 3:
            out.append(("walk", math.log10(40.0) + long, range(j - walk, j - 2)))
        for u in range(1, min(LONGEST_UNIT, j - 1) + 1):
            same[u] = same[u] + 1 if v[j - 1] == v[j - 1 - u] else 0
            if same[u] >= u and same[u] + u >= 3:
                far = j - u * ((same[u] + u) // u)
                out.append(("repeat", float(sums[j] - sums[j - u]) + long, range(far, j - max(2 * u, 3) + 1, u)))
        yield out


def guess_cost(value: str, words: dict[str, int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses of the cheapest segmentation, and its parts (kind, start, end).  Empty: 0 and none.

    Each part after the first costs one more doubling, so few long parts beat many short ones.  The whole value is
    looked at, in time linear in its length: the least cost among the starts of a growing walk or repeat is carried along.
    """
    v, n, join = value, len(value), math.log10(2.0)
    words = public_words(None) if words is None else words
    # two states at each place: whether the part that ends there is a brute-force span
    cost, came = [[0.0, math.inf]] + [[math.inf, math.inf] for _ in range(n)], [[None, None] for _ in range(n + 1)]
    carried: dict[tuple, tuple] = {}  # (kind, unit, remainder) -> least start cost so far, where, first start, next start to look at

    def begin(i: int) -> float:
        return min(cost[i]) + (join if i else 0.0)

    for j, found in enumerate(parts_ending(v, words), 1):
        for kind, c, starts in found:
            if kind in ("word", "date"):
                i = starts.start
                least = begin(i)
            else:
                key = (kind, starts.step if kind == "repeat" else 0, starts.start % starts.step)
                least, i, first, at = carried.get(key, (math.inf, -1, -1, 0))
                if first != starts.start:
                    least, i, at = math.inf, -1, starts.start
                for k in range(at, starts.stop, starts.step):
                    if begin(k) < least:
                        least, i = begin(k), k
                    at = k + starts.step
                carried[key] = (least, i, starts.start, at)
            if least + c < cost[j][0]:
                cost[j][0], came[j][0] = least + c, (i, 0 if cost[i][0] <= cost[i][1] else 1, kind)
        one = math.log10(_alphabet(v[j - 1]))
        for s in (0, 1):
            total = cost[j - 1][s] + one + (join if s == 0 and j > 1 else 0.0)
            if total < cost[j][1]:
                cost[j][1], came[j][1] = total, (j - 1, s, "brute")
    out, at, s = [], n, 0 if cost[n][0] <= cost[n][1] else 1
    best = cost[n][s]
    while at:
        i, before, kind = came[at][s]
        if out and kind == "brute" == out[-1][0]:
            out[-1] = ("brute", i, out[-1][2])
        else:
            out.append((kind, i, at))
        at, s = i, before
    return best, out[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns by start, then kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return _sorted(spans)


def guessed_spans(text: str, words: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """Values in credential contexts that take many guesses, less the punctuation that ends a sentence."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,:;!?)]}")
        if guess_cost(value, words)[0] >= LEAST_GUESSES:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return out


def _sorted(spans):
    return sorted(spans, key=lambda s: (s[1], ORDER.index(s[0]), s[2]))


def find(text: str, words: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    return _sorted(base_spans(text) + guessed_spans(text, words))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


#: One linear-time pattern each that every text with a match of that family has.
_HINTS = (r"(?i)pass|pwd|secret|token|api|key|credential|auth", r"AKIA", r"[0-9a-f]{32}")
_HINT_ASSIGN = r"(?i)(?:pass[a-z]*|pwd|secret|token|key|credentials?|auth)[\"']?\x20*[:=]"


def _suspects(col: pa.Array) -> np.ndarray:
    """Which texts can have any span at all; the rest need no further look."""
    col = pc.fill_null(col, "")
    hit = None
    for pattern in (_HINT_ASSIGN, _HINTS[1], _HINTS[2]):
        found = pc.match_substring(col, pattern) if pattern == "AKIA" else pc.match_substring_regex(col, pattern)
        hit = found if hit is None else pc.or_(hit, found)
    return hit.to_numpy(zero_copy_only=False)


def scan(docs: DataFrame, vocabulary: str | None = None, more: list[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    ``vocabulary`` and ``more`` make the dictionary (see ``dictionary``).  A null text counts as empty; an empty table gives an empty
    one; repeated rows and null ids are kept as they are; other columns are left out.  Spans are code points, the end exclusive; of spans with the same start the kinds stand
    as in ORDER.  Spans of different kinds may overlap; those of one kind do not.
    """
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        words = dictionary(vocabulary, more)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                counts, digest, spans = np.zeros((4, n), np.int64), [empty] * n, [""] * n
                col = part.column("text")
                for i in np.flatnonzero(_suspects(col)).tolist():
                    text = col[i].as_py()
                    base = base_spans(text)
                    found = _sorted(base + guessed_spans(text, words))
                    for kind, _, _ in found:
                        counts[ORDER.index(kind), i] += 1
                    digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    rows = docs.select("doc_id", "text")
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(docs: DataFrame, vocabulary: str | None = None, more: list[str] = ()) -> DataFrame:
    """The rows of ``docs`` (all columns), each found span of the text replaced; n_chars, where there is one, follows the text.

    Every row stays, repeated ones and those with a null id or text included.
    """

    def run(batches):
        words = dictionary(vocabulary, more)
        for batch in batches:
            for part in slices(batch, "text"):
                col, new = part.column("text"), {}
                for i in np.flatnonzero(_suspects(col)).tolist():
                    text = col[i].as_py()
                    if spans := find(text, words):
                        new[i] = redacted(text, spans)
                if new:
                    texts = col.to_pylist()
                    for i, text in new.items():
                        texts[i] = text
                    at = part.schema.get_field_index("text")
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                    if (k := part.schema.get_field_index("n_chars")) >= 0:
                        lengths = part.column(k).to_pylist()
                        for i, text in new.items():
                            lengths[i] = len(text)
                        part = part.set_column(k, part.schema.field(k), pa.array(lengths, part.schema.field(k).type))
                yield part

    return map_batches(docs, run, docs.schema)


