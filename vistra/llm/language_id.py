"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability
is the sum over all its segmentations into pieces (forward algorithm), a text's the product over its
words.  The probabilities are fitted by expectation maximisation over the same lattices.  Short words are summed side by
side as plain numbers, longer ones as logarithms, so words of any length are summed whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import WordTable, map_batches, segment_sums, slices, text_bytes

#: Bound of the fitted sample: about so many labelled documents of each language, chosen by a hash of doc_id; their texts are read whole.
TRAIN_DOCS = 400
EM_ROUNDS = 4
#: Words of up to so many bytes are summed as plain numbers; at 1e-12 a byte, the least there is, they stay in range.
PLAIN = 24
#: Probability of a character that the vocabulary does not have, in every language.
UNKNOWN = 1e-6
#: A text whose fit falls below this for each of its words is in no learned language: so much worse than plain pieces only strange words are.
LEAST_FIT = -1.5
#: Bytes of the words whose lattices are held at once.
CHUNK_BYTES = 80_000

_LETTERS = re.compile(r"[^\W\d_]+")


def clean(word: bytes) -> list[bytes]:
    """The letter runs of a token, lower-cased, with a leading space as the vocabulary has it."""
    return [b" " + run.encode() for run in _LETTERS.findall(word.decode("utf-8", "replace").lower())]


def is_training(doc_id: Column) -> Column:
    """Documents that may be learned from: crc32 of the id as text, modulo 5, is not 0 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def word_sums(words: list[bytes], log_p: np.ndarray, vocab: str) -> np.ndarray:
    """log of each word's probability, summed over all its segmentations, by column of ``log_p`` (piece, language)."""
    out = np.zeros((len(words), log_p.shape[1]))
    for part, logs in _chunks(words):
        lat = pieces.Lattice([words[i] for i in part], pieces.trie(vocab))
        end = lat.forward(_weights(lat, log_p, logs), logs)[lat.last]
        out[part] = end if logs else np.log(end)
    return out


def _chunks(words: list[bytes]):
    """Row numbers of words to be summed together, and whether as logarithms."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for logs in (False, True):
        rows = np.flatnonzero((sizes > PLAIN) == logs)
        rows = rows[np.argsort(sizes[rows], kind="stable")] if logs else rows
        part = (np.cumsum(sizes[rows]) - sizes[rows]) // CHUNK_BYTES
        yield from ((x, logs) for x in np.split(rows, np.flatnonzero(np.diff(part)) + 1) if len(x))


def _weights(lat: pieces.Lattice, log_p: np.ndarray, logs: bool) -> np.ndarray:
    """Edge factors: the piece's probability, or UNKNOWN."""
    table = log_p if logs else np.exp(log_p)
    out = table[np.maximum(lat.value, 0)]
    out[lat.value < 0] = math.log(UNKNOWN) if logs else UNKNOWN
    return out


class Model:
    """``log_p``: per language a row of log probabilities by piece id."""

    def __init__(self, langs: list[str], log_p: np.ndarray, prior: np.ndarray, vocab: str):
        self.langs, self.log_p, self.prior, self.vocab = langs, log_p, prior, vocab

    def word_logs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each token the summed log probability by language and, last, by the public vocabulary's own scores; and its number of letter runs."""
        runs = [clean(w) for w in words]
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        table = np.concatenate([self.log_p, pieces.rank_log_scores(self.vocab)[None]]).T
        return segment_sums(word_sums([r for x in runs for r in x], np.ascontiguousarray(table), self.vocab), counts), counts


def _fit_one(words: list[bytes], counts: np.ndarray, vocab: str, n: int) -> np.ndarray:
    """EM for one language: expected piece counts over all segmentations, with add-0.05 smoothing."""
    log_p = pieces.rank_log_scores(vocab)
    log_p = log_p - np.logaddexp.reduce(log_p)
    chunks = [(pieces.Lattice([words[i] for i in part], pieces.trie(vocab)), counts[part], logs) for part, logs in _chunks(words)]
    for _ in range(EM_ROUNDS):
        expected = np.zeros(n)
        for lat, c, logs in chunks:
            w = _weights(lat, log_p[:, None], logs)
            alpha, beta = lat.forward(w, logs)[:, 0], lat.backward(w, logs)[:, 0]
            z, w = alpha[lat.last], w[:, 0]
            if logs:
                share = np.exp(alpha[lat.start] + w + beta[lat.end] - z[lat.word]) * c[lat.word]
            else:
                share = alpha[lat.start] * w * beta[lat.end] * (c / z)[lat.word]
            known = lat.value >= 0
            expected += np.bincount(lat.value[known], share[known], minlength=n)
        log_p = np.log((expected + 0.05) / (expected.sum() + 0.05 * n))
    return log_p


def fit(docs: DataFrame, vocab: str, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from a bounded sample of the labelled training rows.

    The sample takes, per language, the documents whose hash lies under train_docs / (rows of the
    language); their number does not grow with the input, and their words are counted by the workers over whole texts.
    Rows with a null text, lang or doc_id are not learned from.
    """
    rows = docs.select("doc_id", "text", "lang").where(is_training(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros(0), vocab)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[tuple[str, bytes], int] = {}
                for lang, text in zip(part.column("lang").to_pylist(), text_bytes(part.column("text")).to_pylist(), strict=True):
                    for token in text.split():
                        for run in clean(token):
                            found[lang, run] = found.get((lang, run), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "run", "n"])

    counted = map_batches(rows.where(pick).select("lang", "text"), count, "lang string, run binary, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    found: dict[str, dict[bytes, int]] = {lang: {} for lang in langs}
    for lang, run, n in sorted(zip(*(c.to_pylist() for c in counted.columns), strict=True)):
        found[lang][run] = n
    n = len(pieces.rank_log_scores(vocab))
    log_p = np.stack([_fit_one(list(found[lang]), np.array(list(found[lang].values()), float), vocab, n) for lang in langs])
    prior = np.log(np.array([sizes[lang] for lang in langs], float) / sum(sizes.values()))
    return Model(langs, log_p, prior, vocab)


def _scored(batches, model: Model):
    """For each slice of the batches: the rows, the best language's number, its posterior, its fit and the number of letter runs.

    The fit is the log10 probability of the text in that language less that under the public vocabulary's own scores.
    """
    k = len(model.langs)
    logs, letters = np.zeros((0, k + 1)), np.zeros(0, np.int64)

    def new(words):
        nonlocal logs, letters
        more, n = model.word_logs(words)
        logs, letters = np.concatenate([logs, more]), np.concatenate([letters, n])

    def reset():
        nonlocal logs, letters
        logs, letters = logs[:0].copy(), letters[:0].copy()

    table = WordTable(lambda t: t.lower().split(), new, reset, limit=200_000)
    for batch in batches:
        for part in slices(batch, "text"):
            flat, lengths = table.batch(text_bytes(part.column("text")).to_pylist())
            sums = segment_sums(logs[flat], lengths)
            joint = sums[:, :k] + model.prior
            top = joint.argmax(1)
            post = 1.0 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
            fit = (sums[np.arange(len(top)), top] - sums[:, k]) / math.log(10)
            yield part, top, post, fit, segment_sums(letters[flat], lengths)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, fit, n_words.

    lang_pred is ``und`` with score and fit 0 where the text is null or has no letter, or where nothing could be
    learned; else the language of the highest posterior, the first by name of equal ones.  score is that posterior; fit tells how
    much better the language explains the text than plain pieces of the public vocabulary do (log10).
    Repeated rows and null ids are kept as they are (held_out of a null id is false); an empty table gives an empty one.
    """

    def row(part, pred, score, fit, words):
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(fit), pa.array(words)], ["doc_id", "held_out", "lang_pred", "score", "fit", "n_words"]
        )

    def run(batches):
        if not model.langs:
            for batch in batches:
                n = batch.num_rows
                yield row(batch, ["und"] * n, np.zeros(n), np.zeros(n), np.zeros(n, np.int64))
            return
        names = np.array(model.langs, object)
        for part, top, post, fit, words in _scored(batches, model):
            some = words > 0
            yield row(part, np.where(some, names[top], "und"), np.where(some, post, 0.0), np.where(some, fit, 0.0), words)

    rows = docs.select("doc_id", "text", (F.coalesce(~is_training(F.col("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull()).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, fit double, n_words long")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, least_fit: float = LEAST_FIT) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is found; the rest go.

    Texts that go are null, have no letter, have a score under ``least``, or fit no learned language: their fit is under ``least_fit`` a word.
    Repeated rows and null ids are treated like any other; an empty table, or one without training rows, gives an empty one.
    """

    def run(batches):
        for part, _, post, fit, words in _scored(batches, model):
            yield part.filter(pa.array((words > 0) & (post >= least) & (fit >= least_fit * words)))

    if not model.langs:
        return docs.where(F.lit(False))
    return map_batches(docs, run, docs.schema)
