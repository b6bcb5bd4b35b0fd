"""A double-array trie of vocabulary pieces, and lattices of all their occurrences in words."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


class Trie:
    """Double array over UTF-8 bytes: child of node s by byte b is t = base[s] + b if check[t] == s."""

    def __init__(self, pieces: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for piece, v in zip(pieces, values, strict=True):
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][b]
            value[node] = v
        size = len(children) + 4096
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used, place, first, dense = bytearray(size), {0: 0}, 257, 1
        used[0] = 1
        for node in range(len(children)):
            kids = children[node]
            slot = place[node]
            self.value[slot] = value[node]
            if not kids:
                self.base[slot] = 0
                continue
            codes = sorted(kids)
            while used[first]:
                first += 1
            b = max(1, first - codes[0]) if len(codes) == 1 else dense  # nodes of one child fill the gaps
            while True:
                if b + 256 >= len(used):
                    used.extend(bytes(len(used)))
                if not any(used[b + c] for c in codes):
                    break
                b += 1
            if len(used) > len(self.base):
                more = len(used) - len(self.base)
                self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                self.check, self.value = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (self.check, self.value))
            self.base[slot] = b
            if len(codes) > 1:
                dense = b
            for c in codes:
                used[b + c] = 1
                self.check[b + c] = slot
                place[kids[c]] = b + c
        end = max(place.values()) + 257
        self.base, self.check, self.value = (np.ascontiguousarray(x[:end]) if len(x) >= end else np.concatenate([x, np.full(end - len(x), -1, np.int32)]) for x in (self.base, self.check, self.value))
        self.longest = max(map(len, pieces), default=0)

    def occurrences(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece at every place: (start, length, value).  ``ends[i]`` is where the word of byte i stops."""
        at = np.arange(len(data))
        state = np.zeros(len(data), np.int64)
        found = []
        for k in range(self.longest):
            inside = at + k < ends[at]
            at, state = at[inside], state[inside]
            if not len(at):
                break
            after = self.base[state] + data[at + k]
            good = (self.check[after] == state) & (self.base[state] > 0)
            at, state = at[good], after[good].astype(np.int64)
            hit = self.value[state] >= 0
            found.append((at[hit], np.full(int(hit.sum()), k + 1), self.value[state[hit]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Lattice:
    """All pieces of a batch of words; nodes are byte places, ``node[i] + i`` of word i's first to its last.

    A character that no piece spells alone gets an edge of its own with value -1.
    Edges are sorted by place within the word, then by end node, so that each step of a recursion is one slice.
    """

    def __init__(self, words: list[bytes], trie: Trie):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        stops = np.cumsum(sizes)
        start, length, value = trie.occurrences(data, stops[word])
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = (stops - sizes)[sizes > 0]
        if ((data[first] & 0xC0) == 0x80).any():  # a word may start inside a character
            lead = np.union1d(lead, first)
        width = np.diff(np.r_[lead, len(data)])
        width = np.minimum(width, stops[word[lead]] - lead) if len(lead) else width
        alone = np.zeros(len(data) + 1, bool)
        spelled = np.zeros(len(data) + 1, np.int64)
        spelled[lead] = width
        alone[start[spelled[start] == length]] = True
        bare = ~alone[lead]
        start = np.r_[start, lead[bare]]
        length = np.r_[length, width[bare]]
        value = np.r_[value, np.full(int(bare.sum()), -1)]
        w = word[start]
        inner = start - (stops - sizes)[w]
        order = np.argsort(((inner + length) * (len(data) + 1) + start + length) * 64 + length)
        self.start, self.end = (start + w)[order], (start + w + length)[order]
        self.value, self.length, self.word = value[order], length[order], w[order]
        rank = (inner + length)[order]
        self.steps = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
        self.first, self.last = stops - sizes + np.arange(len(words)), stops + np.arange(len(words))
        self.nodes, self.sizes, self.data = len(data) + len(words), sizes, data

    def runs(self):
        """Slices of edges that end at the same place of their words."""
        yield from zip(self.steps, np.r_[self.steps[1:], len(self.start)][: len(self.steps)], strict=True)

    def forward(self, weight: np.ndarray, logs: bool = False) -> np.ndarray:
        """Sums over all segmentations up to each node; ``weight`` has a row of factors for each edge.

        With ``logs`` weights and sums are logarithms, which hold for words of any length.
        """
        add, times = (np.logaddexp, np.add) if logs else (np.add, np.multiply)
        alpha = np.full((self.nodes, weight.shape[1]), -np.inf if logs else 0.0)
        alpha[self.first] = 0.0 if logs else 1.0
        for a, b in self.runs():
            end = self.end[a:b]
            heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
            alpha[end[heads]] = add.reduceat(times(alpha[self.start[a:b]], weight[a:b]), heads, axis=0)
        return alpha

    def backward(self, weight: np.ndarray, logs: bool = False) -> np.ndarray:
        """Sums over all segmentations from each node to its word's end, as ``forward`` does up to it."""
        add, times = (np.logaddexp, np.add) if logs else (np.add, np.multiply)
        beta = np.full((self.nodes, weight.shape[1]), -np.inf if logs else 0.0)
        beta[self.last] = 0.0 if logs else 1.0
        tail = self.sizes[self.word] - (self.start - self.first[self.word])
        order = np.lexsort((self.start, tail))
        tail, start, end, weight = tail[order], self.start[order], self.end[order], weight[order]
        cuts = np.flatnonzero(np.r_[True, tail[1:] != tail[:-1]]) if len(tail) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.r_[cuts[1:], len(tail)][: len(cuts)], strict=True):
            s = start[a:b]
            heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            beta[s[heads]] = add.reduceat(times(beta[end[a:b]], weight[a:b]), heads, axis=0)
        return beta

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi: the chosen edges, word after word in reading order, and how many each word has.

        Of equal sums the one whose last piece is longest wins, at each place.
        """
        total = np.full(self.nodes, -np.inf)
        total[self.first] = 0.0
        came = np.full(self.nodes, -1)
        for a, b in self.runs():
            end, sums = self.end[a:b], total[self.start[a:b]] + score[a:b]
            heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
            top = np.maximum.reduceat(sums, heads)
            total[end[heads]] = top
            group = np.cumsum(np.r_[True, end[1:] != end[:-1]]) - 1
            hit = np.flatnonzero(sums == top[group])
            came[end[hit]] = a + hit  # the last hit is the longest piece
        at, live, chosen, whose = self.last.copy(), np.flatnonzero(self.sizes > 0), [], []
        while len(live):
            edge = came[at[live]]
            chosen.append(edge)
            whose.append(live)
            at[live] = self.start[edge]
            live = live[at[live] > self.first[live]]
        if not chosen:
            return np.zeros(0, np.int64), np.zeros(len(self.sizes), np.int64)
        chosen, whose = np.concatenate(chosen[::-1]), np.concatenate(whose[::-1])
        order = np.argsort(whose, kind="stable")
        return chosen[order], np.bincount(whose, minlength=len(self.sizes))


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> tuple[tuple[bytes, ...], tuple[int, ...], int]:
    """A SentencePiece model's ordinary pieces with their marker as a space, their ids, and the id of byte piece 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    zero = next(i for i in range(model.get_piece_size()) if model.is_byte(i))
    return tuple(model.id_to_piece(i).replace("▁", " ").encode() for i in ids), tuple(ids), zero


@lru_cache(maxsize=4)
def trie(model_file: str) -> Trie:
    pieces, ids, _ = vocabulary(model_file)
    return Trie(list(pieces), list(ids))


def rank_log_scores(model_file: str) -> np.ndarray:
    """A log score for every id of a public vocabulary that ships merge ranks: a Zipf law of the rank.

    Entry r of n, from 0, has probability 1 / ((r + 2) * H), where H makes the sum 1.  Bytes cost
    twice the rarest piece, so that a byte is taken only where no piece fits.
    """
    _, ids, _ = vocabulary(model_file)
    order = np.argsort(np.asarray(ids), kind="stable")
    weight = 1.0 / (np.arange(len(ids)) + 2.0)
    out = np.full(max(ids) + 1, 2 * math.log(weight[-1] / weight.sum()))
    out[np.asarray(ids)[order]] = np.log(weight / weight.sum())
    return out
