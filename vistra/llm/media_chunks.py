"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last bytes says so, so equal stretches give equal chunks wherever
they stand.  A chunk is known by its digest.  Digests that occur once stay with their payload, in one compressed
pack; digests that occur more often are stored once, in a table of shared chunks, and joined back.  The stored form of a
payload is its manifest (the ordered list of its chunks), its pack, and the frames of its shared chunks, all of them bytes on
disk; reading puts the chunks together again and verifies each digest.

Which digests occur more often is counted over all payloads by Spark.  Workers are told through a Bloom filter, sized by
their number up to a bound: a chunk it takes for shared goes to the shared table even if it is not (that costs a join, nothing
else), so every payload is read back the same however full the filter is.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, slices, text_bytes

PAD = 64
#: Least and greatest bytes of a chunk (the last may be smaller); a cut needs MASK_BITS zero bits, about 2 KB on average.
LEAST, MOST, MASK_BITS = 512, 8192, 11
#: Bytes that the rolling hash looks back on.
WINDOW = 32
DIGEST = 16
#: Least and greatest bits of the filter of shared digests, bits for each of them, and places of each: at most 32 MB go to a worker.
FILTER_LEAST, FILTER_MOST, FILTER_SHARE, FILTER_PLACES = 1 << 16, 1 << 28, 16, 3
#: Shared chunks that a worker remembers to have handed on.
REMEMBERED = 200_000
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
MAGIC = b"CDC2"


def payload(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def cuts(data: bytes) -> list[int]:
    """Where chunks end.  The hash at a byte is the sum of the gear values of the last WINDOW bytes, each shifted by its age."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span)
        h = h + older
        span *= 2
    places = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    for place in places.tolist():
        while place - at > MOST:
            at += MOST
            out.append(at)
        if place - at >= LEAST and place < n:
            out.append(at := place)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def manifest(n_bytes: int, sizes: list[int], digests: list[bytes], shared: list[bool]) -> bytes:
    """The head of the stored form: magic, bytes of the text, number of chunks, then size, digest and whereabouts of each."""
    return b"".join([MAGIC, struct.pack("<QI", n_bytes, len(sizes)), *(struct.pack("<I?", n, s) + d for n, d, s in zip(sizes, digests, shared, strict=True))])


def parse(head: bytes) -> tuple[int, list[int], list[bytes], list[bool]]:
    if head[:4] != MAGIC:
        raise ValueError("not a manifest")
    n_bytes, count = struct.unpack_from("<QI", head, 4)
    rows = list(struct.iter_unpack(f"<I?{DIGEST}s", head[16:]))
    if len(rows) != count:
        raise ValueError("a stored manifest is damaged")
    return n_bytes, [r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows]


_OUT = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_OUT_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_OUT_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def filter_bits(n: int) -> int:
    """A power of two with FILTER_SHARE bits for each of ``n`` digests, within the bounds."""
    return min(max(FILTER_LEAST, 1 << (FILTER_SHARE * max(n, 1) - 1).bit_length()), FILTER_MOST)


def _filter_words(often: DataFrame) -> np.ndarray:
    """The filter's bits in 64-bit words: at most FILTER_MOST / 64 rows reach the driver."""
    size = filter_bits(often.count())
    place = [F.pmod(F.conv(F.hex(F.substring("digest", 1 + 4 * k, 4)), 16, 10).cast("long"), F.lit(size)) for k in range(FILTER_PLACES)]
    bits = often.select(F.explode(F.array(*place)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


def _maybe_shared(digests: list[bytes], words: np.ndarray) -> np.ndarray:
    places = np.frombuffer(b"".join(digests), ">u4").reshape(-1, DIGEST // 4)[:, :FILTER_PLACES].astype(np.int64) % (64 * len(words))
    return ((words[places >> 6] >> (places & 63)) & 1).all(1)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs (one row per document) and shared chunks, both written in the shared folder.

    Packs: doc_id, manifest, pack (the chunks that are not shared, compressed; empty if all are), payload_key (the same for
    equal payloads) and joins (whether any chunk is shared).  Shared: digest, chunk (compressed), each digest once.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def payloads(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part, text_bytes(part.column("text")).to_pylist()

    def listed(batches):
        for _, found in payloads(batches):
            n = Counter(digest(c) for t in found for c in chunks(payload(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["digest", "n"])

    counted = map_batches(rows, listed, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    words = _filter_words(cut(counted.where("n > 1").select("digest"), "media-often"))

    def away(batches):
        """Shared chunks, each once as far as the worker remembers."""
        press, handed = zstandard.ZstdCompressor(level=6), set()
        for _, found in payloads(batches):
            out: dict[bytes, bytes] = {}
            for text in found:
                parts = chunks(payload(text))
                digests = [digest(c) for c in parts]
                for i in np.flatnonzero(_maybe_shared(digests, words)).tolist():
                    if digests[i] not in handed and digests[i] not in out:
                        out[digests[i]] = press.compress(parts[i])
            handed.update(out)
            if len(handed) > REMEMBERED:
                handed.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "chunk"])

    def packed(batches):
        press = zstandard.ZstdCompressor(level=6)
        for part, found in payloads(batches):
            out: list[list] = [[] for _ in range(4)]
            for text in found:
                parts = chunks(payload(text))
                digests = [digest(c) for c in parts]
                shared = _maybe_shared(digests, words).tolist()
                here = b"".join(c for c, s in zip(parts, shared, strict=True) if not s)
                head = manifest(len(text), [len(c) for c in parts], digests, shared)
                for column, value in zip(out, (head, press.compress(here) if here else b"", hashlib.sha256(head).digest(), any(shared)), strict=True):
                    column.append(value)
            cols = [pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "manifest", "pack", "payload_key", "joins"])

    shared = cut(map_batches(rows, away, "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk")), "media-shared")
    return cut(map_batches(rows, packed, f"doc_id {kind}, manifest binary, pack binary, payload_key binary, joins boolean"), "media-packs"), shared


def rebuilt(head: bytes, pack: bytes, fetched: dict[int, bytes]) -> tuple[int, bytes]:
    """Bytes of the text, and the payload, from a stored form; each chunk's size and digest are verified."""
    n_bytes, sizes, digests, shared = parse(head)
    unpress = zstandard.ZstdDecompressor()
    here, at, parts = unpress.decompress(pack) if pack else b"", 0, []
    for i, (size, d, away) in enumerate(zip(sizes, digests, shared, strict=True)):
        if away:
            chunk = unpress.decompress(fetched[i])
        else:
            chunk, at = here[at : at + size], at + size
        if len(chunk) != size or digest(chunk) != d:
            raise ValueError("a stored chunk is damaged")
        parts.append(chunk)
    return n_bytes, b"".join(parts)


def features(head: bytes, pack: bytes, fetched: dict[int, bytes]) -> tuple:
    """What is told of a stored payload: bytes, digests of the payload and of the stored form, and a feature of its 8-bit samples."""
    n_bytes, data = rebuilt(head, pack, fetched)
    stored = [head, pack, *(fetched[i] for i in sorted(fetched))]
    media = hashlib.sha256()
    for x in stored:
        media.update(x)
    samples = np.frombuffer(data, np.uint8)
    changes = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    feature = f"chunks={len(parse(head)[1])};mean={float(samples.mean()):.4f};peak={int(samples.max())};zero_crossings={changes}"
    return n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), sum(map(len, stored)), media.hexdigest(), feature


def _stored(batch: pa.RecordBatch):
    """Manifest, pack and fetched frames by place, a row at a time."""
    head, pack = batch.column("manifest"), batch.column("pack")
    got = batch.column("fetched") if "fetched" in batch.schema.names else None
    for i in range(batch.num_rows):
        frames = got[i].as_py() if got is not None else None
        yield head[i].as_py(), pack[i].as_py(), {x["at"]: x["chunk"] for x in frames or ()}


def _fetched(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """payload_key and the frames (at, chunk) of its shared chunks, for distinct payloads."""

    def places(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, head in zip(batch.column("payload_key").to_pylist(), batch.column("manifest").to_pylist(), strict=True):
                _, _, digests, away = parse(head)
                out += [(key, i, d) for i, (d, s) in enumerate(zip(digests, away, strict=True)) if s]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["payload_key", "at", "digest"])

    wanted = map_batches(rows.select("payload_key", "manifest"), places, "payload_key binary, at int, digest binary")
    return wanted.join(shared, "digest").groupBy("payload_key").agg(F.collect_list(F.struct("at", "chunk")).alias("fetched"))


def _distinct(packs: DataFrame) -> DataFrame:
    return cut(packs.where("joins").groupBy("payload_key").agg(F.first("manifest").alias("manifest"), F.first("pack").alias("pack")), "media-distinct")


def read(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id and the features of every stored payload, read back from the packs and the shared chunks.

    Payloads without shared chunks are rebuilt where they lie.  Of the others each distinct one is rebuilt once, so that a
    large group of copies moves small rows only.
    """

    def told(key):
        def run(batches):
            for batch in batches:
                rows = [features(*x) for x in _stored(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_OUT_TYPES))], [key, *_OUT])

        return run

    kind = packs.schema["doc_id"].dataType.simpleString()
    alone = map_batches(packs.where("not joins").select("doc_id", "manifest", "pack"), told("doc_id"), f"doc_id {kind}, {_OUT_SCHEMA}")
    theirs, distinct = packs.where("joins").select("doc_id", "payload_key"), _distinct(packs)
    again = map_batches(distinct.join(_fetched(distinct, shared), "payload_key"), told("payload_key"), f"payload_key binary, {_OUT_SCHEMA}")
    return alone.unionByName(theirs.join(again, "payload_key").drop("payload_key"))


def texts(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id and text of every stored payload (an empty text for a null one)."""

    def run(batches):
        for batch in batches:
            out = [data[:n].decode("utf-8", "replace") for n, data in (rebuilt(*x) for x in _stored(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = packs.join(_fetched(_distinct(packs), shared), "payload_key", "left").select("doc_id", "manifest", "pack", "fetched")
    return map_batches(rows, run, f"doc_id {packs.schema['doc_id'].dataType.simpleString()}, text string")


def media(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and the features of its payload, stored and read back.

    The stored form of a payload is its manifest, its pack and the frames of its shared chunks in order, as they lie on disk; media_bytes
    and media_sha256 are those of the bytes that were read.  A null text counts as empty, whose payload is 64 zero bytes.  Equal
    texts give equal values.  Repeated rows and null ids are kept as they are; an empty table gives an empty one; other columns are left out.
    """
    return read(*store(docs))
