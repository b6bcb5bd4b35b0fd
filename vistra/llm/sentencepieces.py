"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The public vocabulary ships merge ranks; ``pieces.rank_log_scores`` turns them into log scores by rule.
A space is the marker; one is put before the text and taken off again.  Characters without a piece,
and a literal marker character, are spelled in byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces
from .common import Pool, WordTable, map_batches, slices, text_bytes

#: A longer run without spaces is encoded place by place, not in a batch.
LONG = 256
#: Words whose lattices are held at once.
CHUNK = 8_000

_RUNS = re.compile(rb" +[^ \n]*|\n[^ \n]*")


def _segments(text: bytes) -> list[bytes]:
    """The marked text cut before each run of spaces and each newline; a run loses its first space (see ``_marked``)."""
    if not text:
        return []
    if b"  " in text or text[0] == 32 or text[-1] == 32:
        return [x[1:] if x[0] == 32 else x for x in _RUNS.findall(b" " + text)]
    return text.replace(b"\n", b" \n").split(b" ")


def _marked(segment: bytes) -> bytes:
    """A segment as it stands in the text: those that start with a newline have no space before them."""
    return segment if segment[:1] == b"\n" else b" " + segment


class Encoder:
    """Encodes batches of texts; segments are remembered, at most ``limit`` at a time.

    No piece has a space after another character or holds a newline, so the best segmentation of a text is made of the best ones
    of its segments.
    """

    def __init__(self, vocab: str, limit: int = 200_000):
        self.vocab, self.trie = vocab, pieces.trie(vocab)
        self.score, self.zero = pieces.rank_log_scores(vocab), pieces.vocabulary(vocab)[2]
        self.byte_score = float(self.score[self.zero])
        self.pool = Pool(np.int32)
        self.table = WordTable(_segments, self._new, self._reset, limit)

    def _reset(self) -> None:
        self.pool = Pool(np.int32)

    def _new(self, words: list[bytes]) -> None:
        for a in range(0, len(words), CHUNK):
            part = [_marked(w) for w in words[a : a + CHUNK]]
            short = [w if len(w) <= LONG else b"" for w in part]
            flat, sizes = self._viterbi(short)
            if any(len(w) > LONG for w in part):
                cuts = np.split(flat, np.cumsum(sizes)[:-1])
                cuts = [self._long(w) if len(w) > LONG else c for w, c in zip(part, cuts, strict=True)]
                flat, sizes = np.concatenate(cuts), np.array([len(c) for c in cuts])
            self.pool.add(flat, sizes)

    def _viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lat = pieces.Lattice(words, self.trie)
        bare = lat.value < 0
        score = np.where(bare, self.byte_score * lat.length, self.score[np.maximum(lat.value, 0)])
        edges, count = lat.best(score)
        value, length, bare = lat.value[edges], lat.length[edges], bare[edges]
        width = np.where(bare, length, 1)
        at = lat.start[edges] - lat.word[edges]
        where = np.repeat(at - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        ids = np.where(np.repeat(bare, width), self.zero + lat.data[np.minimum(where, max(len(lat.data) - 1, 0))] if len(lat.data) else 0, np.repeat(value, width))
        per_word = np.bincount(np.repeat(lat.word[edges], width), minlength=len(words))
        return ids.astype(np.int32), per_word

    def _long(self, word: bytes) -> np.ndarray:
        """The same recursion over one long run, with plain numbers and a node at a time."""
        trie, n = self.trie, len(word)
        base, check, value = trie.base, trie.check, trie.value
        total, came, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        total[0] = 0.0
        for i in range(n):
            if total[i] == float("-inf"):
                continue
            width = next((k for k in range(1, 5) if i + k >= n or word[i + k] & 0xC0 != 0x80), 1)
            state, alone = 0, False
            for j in range(i, n):
                after = int(base[state]) + word[j]
                if base[state] <= 0 or check[after] != state:
                    break
                state = after
                v = int(value[state])
                if v >= 0:
                    alone |= j + 1 - i == width
                    s = total[i] + self.score[v]
                    if s > total[j + 1]:
                        total[j + 1], came[j + 1], piece[j + 1] = s, i, v
            if not alone:
                s = total[i] + self.byte_score * width
                if s > total[i + width]:
                    total[i + width], came[i + width], piece[i + width] = s, i, -1
        out, at = [], n
        while at:
            i = came[at]
            out += [piece[at]] if piece[at] >= 0 else [self.zero + b for b in reversed(word[i:at])]
            at = i
        return np.array(out[::-1], np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        flat, lengths = self.table.batch(texts)
        ids, sizes = self.pool.take(flat)
        ends = np.r_[0, np.cumsum(sizes)]
        stops = np.cumsum(lengths)
        return ids, ends[stops] - ends[stops - lengths]


class Decoder:
    """Ids back to bytes."""

    def __init__(self, vocab: str):
        names, ids, zero = pieces.vocabulary(vocab)
        by_id = {i: p for i, p in zip(ids, names, strict=True)} | {zero + b: bytes([b]) for b in range(256)}
        rows = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.pool = Pool(np.uint8)
        self.pool.add(np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows)))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts whose ids stand one after the other."""
        flat, width = self.pool.take(ids)
        data, ends = flat.tobytes(), np.r_[0, np.cumsum(width)]
        stops = np.cumsum(sizes)
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[stops - sizes].tolist(), ends[stops].tolist(), strict=True)]


def encode(docs: DataFrame, vocab: str) -> DataFrame:
    """One row per input row: doc_id, ids, n_ids, n_bytes, round_trip (decoding gave the text again).

    A null text counts as empty and has no ids.  Texts of any length, ties (the longer last piece wins),
    repeated rows and null ids are kept; other columns are left out.
    """

    def run(batches):
        encoder, decoder = Encoder(vocab), Decoder(vocab)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_bytes(part.column("text")).to_pylist()
                ids, sizes = encoder.encode(texts)
                same = [a == b for a, b in zip(texts, decoder.decode(ids, sizes), strict=True)]
                offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(sizes, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(same)],
                    ["doc_id", "ids", "n_ids", "n_bytes", "round_trip"],
                )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, ids array<int>, n_ids long, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def run(batches):
        decoder = Decoder(vocab)
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("ids").to_pylist()
                sizes = np.array([len(r or ()) for r in rows])
                flat = np.array([i for r in rows for i in r or ()], np.int64)
                texts = [None if r is None else t.decode("utf-8", "replace") for r, t in zip(rows, decoder.decode(flat, sizes), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, text string")
