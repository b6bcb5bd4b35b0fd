"""LM scoring with a hashed maximum-entropy model and class-factored softmax.

The corpus's words are counted first, all of them.  The most frequent ones, the end of a text and a symbol for all others are what
the model predicts: first the class of the next symbol, then the symbol in its class, each by a softmax over sums of weight rows.  The
features of a class are the bias, the word before, and where both are of the model's words the word before that (a skip) and the two together;
those of a member are the bias and the word before.  A rare word before is a context of its own hash, so a text's rare words say something too.
A feature's row of class weights is found by a hash of the feature, its row of member weights by one among the rows of the class.

The bias is the logarithms of the counted shares.  Then every training text is used in one round: the rounds' texts are dealt by a hash,
Spark sums a round's gradient over them, and the driver makes a step.  The probability of the symbol for all others is spread
over the words that it stands for by their counts, so the score is a proper log probability.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, count_floor, keep, map_batches, segment_sums, slices, text_bytes

#: Words whose counts are sent to every worker, at most, and the bytes of the longest of them; all others are joined.
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Classes, and members of each: the softmax has WIDTH * WIDTH symbols.
WIDTH = 64
END, OTHER = 0, 1
#: Bits of a context word's number, and of a symbol's.
CONTEXT_BITS, SYMBOL_BITS = 20, 13
#: The word before that, where it does not count.
NONE = (1 << CONTEXT_BITS) - 1
#: Rows of class weights and of member weights.
CLASS_ROWS, MEMBER_ROWS = 1 << 13, 1 << 15
ROUNDS, RATE, RIDGE = 5, 1.0, 3.0
#: Rows of a gradient that travel together, tokens whose gradient is computed together, and rows of weights that are looked up together.
BLOCK, TOKENS, PART = 32, 400_000, 4_096
#: Bytes of encoded text for each task of a round, so that gradients stay small beside what they are taken from.
TASK_BYTES = 128 << 20
#: Distinct words that a worker counts before it hands them on.
FLUSH = 500_000


def is_training(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is not 2; a null id counts as training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c over all training texts, and the end once for each text under the null word."""

    def run(batches):
        found: Counter = Counter()
        texts = 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts += part.num_rows
                for text in text_bytes(part.column("text")).to_pylist():
                    found.update(text.lower().split())
                if len(found) > FLUSH:
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])

    rows = docs.where(is_training(F.col("doc_id"))).select("text")
    return map_batches(rows, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counts(found: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])


@dataclass
class Model:
    total: int  # N
    distinct: int  # V
    end: int  # count of the end
    floor: int  # words counted at least so often, and not too long, are in ``frequent``
    frequent: dict[bytes, int]
    symbols: dict[bytes, int]
    rest_total: int  # counts outside the model's list
    rest_distinct: int
    width: int = WIDTH
    shares: np.ndarray | None = None  # counted share of each symbol, a row for each class
    weights: tuple[np.ndarray, np.ndarray] | None = None

    def log_base(self, c) -> np.ndarray:
        return np.log10(np.asarray(c, float) + 1.0)

    @property
    def base_norm(self) -> float:
        return math.log10(self.total + 1.0 * (self.distinct + 1))

    @property
    def rest_norm(self) -> float:
        return math.log10(self.rest_total + self.rest_distinct + 1.0)

    def places(self) -> np.ndarray:
        """Where each class's hashed rows of member weights start, and where the last ends; a class has rows by the root of its share."""
        root = np.sqrt(self.shares.sum(1))
        return self.width + np.r_[0, np.floor(np.cumsum(root) / root.sum() * (MEMBER_ROWS - self.width) + 1e-6)].astype(np.int64)

    def typical(self) -> np.ndarray:
        """The counted shares that belong to each row of class weights, then of member weights."""
        by_class, members = self.shares.sum(1), self.shares / self.shares.sum(1, keepdims=True)
        whose = np.r_[np.arange(self.width), np.repeat(np.arange(self.width), np.diff(self.places()))]
        return np.concatenate([np.broadcast_to(by_class, (CLASS_ROWS, self.width)), members[whose]]).astype(np.float32)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights before training: the bias rows hold the logarithms of the counted shares, all others are 0."""
        cls, member = np.zeros((CLASS_ROWS, self.width), np.float32), np.zeros((MEMBER_ROWS, self.width), np.float32)
        cls[0] = np.log(self.shares.sum(1))
        member[: self.width] = np.log(self.shares / self.shares.sum(1, keepdims=True))
        return cls, member


def vocabulary(counts: DataFrame, width: int = WIDTH) -> Model:
    """The model's symbols: END, OTHER, then the most frequent words (ties by their bytes), as many as the softmax has room for."""
    words = counts.where("word is not null").where(F.length("word") <= FREQUENT_BYTES)
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("end")).collect()[0]
    floor = count_floor(words, FREQUENT)
    table = words.where(F.col("c") >= floor).toArrow()
    frequent = dict(zip(table.column("word").to_pylist(), table.column("c").to_pylist(), strict=True))
    top = sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[: width * width - 2]
    inside = sum(c for _, c in top) + (sums["end"] or 0)
    total, distinct = sums["n"] or 0, sums["v"]
    shares = np.full(width * width, 0.1)
    shares[: 2 + len(top)] += [sums["end"] or 0, total - inside, *(c for _, c in top)]
    symbols = {w: i + 2 for i, (w, _) in enumerate(top)}
    return Model(total, distinct, sums["end"] or 0, floor, frequent, symbols, total - inside, distinct - len(top) - (1 if sums["end"] else 0), width, (shares / shares.sum()).reshape(width, width))


class Reader:
    """Texts as numbers: a word of the model's list has its symbol, any other word one that is made from its hash."""

    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(lambda t: t.lower().split(), self._new, self._reset, limit=300_000)
        self._reset()

    def _reset(self) -> None:
        self.number, self.count, self.words = np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def _new(self, words: list[bytes]) -> None:
        m, first = self.model, self.model.width**2 + 1
        room = NONE - first
        numbers = (s if (s := m.symbols.get(w)) is not None else first + xxhash.xxh32_intdigest(w) % room for w in words)
        self.number = np.concatenate([self.number, np.fromiter(numbers, np.int32, len(words))])
        self.count = np.concatenate([self.count, np.fromiter((m.frequent.get(w, -1) for w in words), np.int64, len(words))])
        self.words += words


def token_keys(numbers: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """One number for each token, the end of each text included: the word before, the word before that, and the symbol that follows.

    The word before that counts only where both are of the model's words or the start; it is NONE else.
    """
    start, n = symbols, lengths + 1
    stops = np.cumsum(n)
    here = np.full(int(n.sum()), END, np.int64)
    inner = np.ones(len(here), bool)
    inner[stops - 1] = False
    here[inner] = numbers
    one, two = np.r_[start, here[:-1]], np.r_[start, start, here[:-2]][: len(here)]
    first = stops - n
    one[first] = two[first] = start
    two[first[n > 1] + 1] = start
    two[(one > start) | (two > start)] = NONE
    return ((one << CONTEXT_BITS | two) << SYMBOL_BITS) | np.where(here < symbols, here, OTHER)


def _hashed(x: np.ndarray, rows) -> np.ndarray:
    mixed = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)).astype(np.int64)) % rows


def class_rows(context: np.ndarray) -> list[np.ndarray]:
    """Rows of class weights of each context: the bias, the word before, the word before that, and both; row 1 is for none and stays 0."""
    one, two = context >> CONTEXT_BITS, context & ((1 << CONTEXT_BITS) - 1)
    there = two != NONE
    found = (_hashed(one << 2 | 1, CLASS_ROWS - 2), _hashed(two << 2 | 2, CLASS_ROWS - 2), _hashed(context << 2 | 3, CLASS_ROWS - 2))
    return [np.zeros(len(context), np.int64), 2 + found[0], *(np.where(there, 2 + f, 1) for f in found[1:])]


def member_rows(one: np.ndarray, cls: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Rows of member weights in a class: the bias, and the word before."""
    first = places[cls]
    room = np.maximum(places[cls + 1] - first, 1)
    return [cls, np.minimum(first + _hashed(one << 2 | 1, room), MEMBER_ROWS - 1)]


def activations(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of rows of weights, less the greatest of each sum."""
    total = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        total += weights.take(r, axis=0)
    total -= total.max(1, keepdims=True)
    return total


def log_softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    total = activations(weights, rows)
    return total - np.log(np.exp(total).sum(1, keepdims=True))


def _parts(model: Model, key: np.ndarray):
    """For both tables, in parts: the number of the table, the rows of each distinct context (or word before and class), which of them each
    key belongs to, its target, and the keys' places.  Keys are distinct, so what they share is looked up once for all of them."""
    w, places = model.width, model.places()
    context, symbol = key >> SYMBOL_BITS, key & ((1 << SYMBOL_BITS) - 1)
    for level, unit, target in ((0, context, symbol // w), (1, (context >> CONTEXT_BITS) * w + symbol // w, symbol % w)):
        order = np.argsort(unit, kind="stable")
        unit = unit[order]
        heads = np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
        for a in range(0, len(heads) - 1, PART):
            ends = heads[a : a + PART + 1]
            mine = unit[ends[:-1]]
            rows = member_rows(mine // w, mine % w, places) if level else class_rows(mine)
            part = order[ends[0] : ends[-1]]
            yield level, rows, np.repeat(np.arange(len(mine)), np.diff(ends)), target[part], part


def token_logs(model: Model, key: np.ndarray) -> np.ndarray:
    """Natural log probability of each of the sorted, distinct keys."""
    out = np.zeros(len(key))
    for level, rows, group, target, part in _parts(model, key):
        total = activations(model.weights[level], rows)
        asked = total[group, target]
        out[part] += asked - np.log(np.exp(total, out=total).sum(1))[group]
    return out


def add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] += values.T`` where rows may repeat: sums of equal rows are taken along the columns, which lie in one piece."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
    if len(first):
        table[rows[first]] += np.add.reduceat(values.take(order, axis=1), first, axis=1).T


def add_pairwise(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] += values`` where rows may repeat, best where few do; ``values`` is used up: those of equal rows are added up in pairs, then pairs of pairs."""
    at = np.argsort(rows, kind="stable")
    rows = rows[at]
    place = np.arange(len(rows))
    place -= np.maximum.accumulate(np.where(np.r_[True, rows[1:] != rows[:-1]], place, 0)) if len(rows) else 0
    while len(second := np.flatnonzero(place & 1)):
        values[at[second - 1]] += values.take(at[second], axis=0)
        first = np.flatnonzero(place & 1 == 0)
        at, rows, place = at[first], rows[first], place[first] >> 1
    table[rows] += values.take(at, axis=0)


def add_gradient(sums, visits, model: Model, key: np.ndarray, n: np.ndarray) -> None:
    """Adds what the sorted, distinct keys, each found ``n`` times, give to the hashed rows of both tables: counts less the model's expectation, and tokens."""
    w = model.width
    for level, rows, group, target, part in _parts(model, key):
        units = len(rows[0])
        tokens = np.bincount(group, n[part], units).astype(np.float32)
        more = activations(model.weights[level], rows)
        np.exp(more, out=more)
        more *= (-tokens / more.sum(1))[:, None]
        np.add.at(more.reshape(-1), group * w + target, n[part].astype(np.float32))
        for i, r in enumerate(rows[1:], 2):
            there = np.flatnonzero(r != 1) if level == 0 else slice(None)  # row 1 of the class weights is for features that are not there
            visits[level] += np.bincount(r[there], tokens[there], len(visits[level])).astype(np.float32)
            if len(r := r[there]):
                add_pairwise(sums[level], r, more if i == len(rows) and level else more[there])


def read(docs: DataFrame, model: Model) -> DataFrame:
    """One row per text, null ones as empty: doc_id, held_out, turn, one and two (hashes of id and text), part and nr (which tell repeated rows apart within
    a reading), ids (the numbers of its words), and what the frequent words give: known, base, log_other; rare has the words that are to be joined."""

    def run(batches):
        reader, number = Reader(model), 0
        for batch in batches:
            for part in slices(batch, "text"):
                flat, lengths = reader.table.batch(text_bytes(part.column("text")).to_pylist())
                n, count = lengths + 1, reader.count[flat]
                logs = np.where(count >= 0, model.log_base(np.maximum(count, 0)), 0.0)
                other = np.where(reader.number[flat] >= model.width**2, logs - model.rest_norm, 0.0)  # a rare word's own log is joined later
                base = segment_sums(logs, lengths) + float(model.log_base(model.end)) - n * model.base_norm
                known = segment_sums((count > 0).astype(np.int64), lengths) + (1 if model.end else 0)
                rare = np.flatnonzero(count < 0)
                per = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[rare], minlength=len(lengths))
                words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), pa.array([reader.words[i] for i in flat[rare].tolist()], pa.binary()))
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(reader.number[flat], pa.int32()))
                nr = pa.array(np.arange(number, number + len(n)))
                number += len(n)
                cols = [*(part.column(c) for c in ("doc_id", "held_out", "turn", "one", "two", "part")), nr, ids, pa.array(known), pa.array(base), pa.array(segment_sums(other, lengths)), words]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "turn", "one", "two", "part", "nr", "ids", "known", "base", "log_other", "rare"])

    turn = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)).cast("int")
    whole = F.coalesce("text", F.lit(""))
    one, two = F.xxhash64("doc_id", whole), F.xxhash64(whole, "doc_id")
    rows = docs.select("doc_id", "text", (~is_training(F.col("doc_id"))).alias("held_out"), turn.alias("turn"), one.alias("one"), two.alias("two"), F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return keep(map_batches(rows, run, f"doc_id {kind}, held_out boolean, turn int, one long, two long, part int, nr long, ids array<int>, known long, base double, log_other double, rare array<binary>"))


def train(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one step for each round's texts (turn, ids; a kept table).

    The driver holds the weights, some MB whatever the corpus, and gets their gradient, of that size, each round.
    """
    width, typical = model.width, model.typical()
    spark = texts.sparkSession
    schema = "block int, sums binary"
    size = texts.agg(F.sum(F.size("ids"))).collect()[0][0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(4 * size / ROUNDS / TASK_BYTES))

    def gradient(model):
        def run(batches):
            sums = [np.zeros((rows, width), np.float32) for rows in (CLASS_ROWS, MEMBER_ROWS)]
            visits = [np.zeros(rows, np.float32) for rows in (CLASS_ROWS, MEMBER_ROWS)]
            held, n = [], 0

            def add():
                key, c = np.unique(np.concatenate(held), return_counts=True)
                add_gradient(sums, visits, model, key, c)

            for batch in batches:
                ids = batch.column("ids")
                held.append(token_keys(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), width * width))
                n += len(held[-1])
                if n > TOKENS:
                    add()
                    held, n = [], 0
            if held:
                add()
            blocks = np.concatenate([np.concatenate(sums), np.concatenate(visits)[:, None]], axis=1).reshape(-1, BLOCK * (width + 1))
            used = np.flatnonzero(blocks.any(1))
            for a in range(0, len(used), 256):
                yield sent(used[a : a + 256].tolist(), blocks)

        return run

    def sent(numbers, blocks):
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([blocks[b].astype(np.float32).tobytes() for b in numbers], pa.binary())], ["block", "sums"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32).astype(np.float64)
                sums[block] = sums[block] + x if block in sums else x
        yield sent(list(sums), sums)

    model = replace(model, frequent={}, symbols={}, weights=model.start())  # what a round's tasks need
    for turn in range(ROUNDS):
        mine = texts.where(F.col("turn") == turn).select("ids").coalesce(tasks)
        sums = map_batches(map_batches(mine, gradient(model), schema).repartition("block"), total, schema).toArrow()
        joint = np.concatenate(model.weights)
        for block, x in zip(sums.column("block").to_pylist(), sums.column("sums").to_pylist(), strict=True):
            at, x = slice(block * BLOCK, (block + 1) * BLOCK), np.frombuffer(x, np.float32).reshape(BLOCK, width + 1)
            more, usual = x[:, :width], x[:, width:] * typical[at]
            # a step of the size of the counts' log ratio to the usual ones, shared by the features that are on at once
            joint[at] += RATE * more / (np.maximum(usual + more, usual) + RIDGE)
        model = replace(model, weights=(joint[:CLASS_ROWS], joint[CLASS_ROWS:]))
    return model.weights


def fit(docs: DataFrame, width: int = WIDTH) -> tuple[Model, DataFrame]:
    """The model, with ``width`` classes of as many members, and the table of all counted words."""
    return _fitted(docs, width)[:2]


def _fitted(docs: DataFrame, width: int) -> tuple[Model, DataFrame, DataFrame]:
    counts = keep(word_counts(docs))
    model = vocabulary(counts, width)
    texts = read(docs, model)
    model.weights = train(texts.where("not held_out").select("turn", "ids"), model)
    return model, counts, texts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null text counts as empty: its only token is the end.  Null ids count as training rows.  Repeated rows are scored alike, and learned
    from as often as they stand; an empty table gives an empty one; other columns are left out.  Words of the frequent list are
    scored in the worker; the rest are joined with the counts of all words.
    """
    return _scored(read(docs, model), model, counts)


def fit_and_score(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``score`` of ``docs`` by a model of their own training rows; texts are read once for both."""
    model, counts, texts = _fitted(docs, width)
    return _scored(texts, model, counts)


def _scored(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    small = replace(model, frequent={}, symbols={})

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            lengths, flat, at = np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy(), 0
            for a, b in _runs(lengths):
                part, n = batch.slice(a, b - a), lengths[a:b] + 1
                total = int(lengths[a:b].sum())
                key, place = np.unique(token_keys(flat[at : at + total], lengths[a:b], small.width**2), return_inverse=True)
                at += total
                scores = segment_sums((token_logs(small, key) / math.log(10))[place], n) + part.column("log_other").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "one", "two")), pa.array(n), part.column("known"), part.column("base"), pa.array(scores)], ["doc_id", "held_out", "one", "two", "n_tokens", "known", "base", "log_p"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = map_batches(texts.drop("turn", "part", "nr", "rare"), run, f"doc_id {kind}, held_out boolean, one long, two long, n_tokens long, known long, base double, log_p double")
    # kept texts may be computed again in another order, so places tell repeated rows apart only within one reading; rows meet by their hashes
    place = F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("nr"))
    rare = texts.select("one", "two", place.alias("place"), F.explode("rare").alias("word"))
    found = counts.where((F.col("c") < model.floor) | (F.length("word") > FREQUENT_BYTES)).where(F.col("word").isNotNull())
    hits = rare.join(found, "word").groupBy("one", "two", "place").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    hits = hits.groupBy("one", "two").agg(F.max("more").alias("more"), F.max("logs").alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return rows.join(hits, ["one", "two"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("log_p") + logs).alias("score"),
    )


def _runs(lengths: np.ndarray):
    """First and last row of runs with about TOKENS tokens each."""
    part = (np.cumsum(lengths + 1) - lengths - 1) // TOKENS
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)], strict=True) if len(part) else ()
