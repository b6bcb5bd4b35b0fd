"""Token ids as length-delimited binary records, with an offset index.

A record is: length (8 bytes), masked CRC-32C of the length (4), data, masked CRC-32C of the data (4), all
little-endian.  The data of one record is one document: the kind of its id (1 byte: 0 none, 1 a number, 2 a text), the id (a number in 8 bytes,
signed; a text as its length in 4 bytes and UTF-8), its number of token ids (4), the width of one in bytes (1: 2 or 4), then the ids.  Beside each file ``x.records`` stands
``x.index``: 16 bytes for each record, its offset and its whole length, for reads in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, Pool, WordTable, last_keys, map_batches, new_path, ranges, segment_sums, slices, text_bytes

#: Fixed values of CRC-32C (reflected polynomial) and of the mask that record files use.
CASTAGNOLI = 0x82F63B78
MASK_ADD = 0xA282EAD8

#: Bytes of a block whose checksum is put together from table rows.
BLOCK = 64
#: Records whose checksums are computed together, in bytes.
BATCH_BYTES = 2 << 20
END_ID = 2


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """``t[k][b]``: what byte b does to the checksum when k bytes of its block follow it."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(CASTAGNOLI), crc >> 1)
    out = np.zeros((BLOCK, 256), np.uint32)
    out[0] = crc
    for k in range(1, BLOCK):
        out[k] = (out[k - 1] >> 8) ^ crc[out[k - 1] & 0xFF]
    return out


@lru_cache(maxsize=32)
def _shift(level: int) -> np.ndarray:
    """Four tables that move a checksum over ``BLOCK * 2**level`` zero bytes."""
    if not level:
        return np.stack([_tables()[BLOCK - 1 - i] for i in range(4)])
    once = _shift(level - 1)
    return np.stack([_moved(row, once) for row in once])


def _moved(crc: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return shift[0][crc & 0xFF] ^ shift[1][crc >> 8 & 0xFF] ^ shift[2][crc >> 16 & 0xFF] ^ shift[3][crc >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, of four bytes or more.

    The checksum is linear and zero bytes in front do not change it, so the parts are filled up to whole blocks, all blocks
    are looked up side by side, and neighbours are joined in rounds.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = -(-sizes // BLOCK)
    data = bytearray().join([x for p, pad in zip(parts, (n * BLOCK - sizes).tolist(), strict=True) for x in (bytes(pad), p)])
    raw = np.frombuffer(data, np.uint8)
    raw[(np.cumsum(n) * BLOCK - sizes)[:, None] + np.arange(4)] ^= 0xFF
    columns, table = np.ascontiguousarray(raw.reshape(-1, BLOCK).T), _tables()
    crc = np.zeros(columns.shape[1], np.uint32)
    for j in range(BLOCK):
        crc ^= table[BLOCK - 1 - j][columns[j]]
    level = 0
    while len(crc) > len(parts):
        odd, half = n % 2, (n + 1) // 2
        i = ranges(np.zeros(len(n), np.int64), half)
        low = np.repeat(np.cumsum(n) - n + 1 - odd, half) + 2 * i
        alone = (i == 0) & np.repeat(odd == 1, half)
        high = np.where(alone, 0, crc[low - 1]).astype(np.uint32)
        crc, n, level = _moved(high, _shift(level)) ^ crc[low], half, level + 1
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> list[int]:
    wide = crc.astype(np.uint64)
    return (((wide >> np.uint64(15) | wide << np.uint64(17)) + np.uint64(MASK_ADD)) & np.uint64(0xFFFFFFFF)).tolist()


def frames(records: list[bytes]) -> list[bytes]:
    sizes = [struct.pack("<Q", len(r)) for r in records]
    both = zip(sizes, masked(crc32c(sizes)), records, masked(crc32c(records)), strict=True) if records else ()
    return [size + struct.pack("<I", a) + data + struct.pack("<I", b) for size, a, data, b in both]


def serialize(doc_id: int | str | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    if isinstance(doc_id, str):
        name = doc_id.encode()
        head = struct.pack("<BI", 2, len(name)) + name
    else:
        head = b"\0" if doc_id is None else struct.pack("<Bq", 1, doc_id)
    return head + struct.pack("<IB", len(ids), width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | str | None, np.ndarray]:
    kind, at, doc_id = data[0], 1, None
    if kind == 1:
        (doc_id,), at = struct.unpack_from("<q", data, 1), 9
    elif kind == 2:
        (size,) = struct.unpack_from("<I", data, 1)
        doc_id, at = data[5 : 5 + size].decode(), 5 + size
    n, width = struct.unpack_from("<IB", data, at)
    return doc_id, np.frombuffer(data, f"<u{width}", n, at + 5).astype("<u4")


def read_records(stream, most: int | None = None):
    """The data of each record of an open file from where it stands, at most ``most`` records, checksums verified."""
    batch, held, left = [], 0, most
    while left is None or left > 0:
        head = stream.read(12)
        if head:
            size, a = struct.unpack("<QI", head)
            data = stream.read(size)
            batch.append((head[:8], a, data, struct.unpack("<I", stream.read(4))[0]))
            held, left = held + size, left and left - 1
        if batch and (not head or held > BATCH_BYTES or left == 0):
            sizes, a, datas, b = map(list, zip(*batch, strict=True))
            if masked(crc32c(sizes)) != a or masked(crc32c(datas)) != b:
                raise ValueError("a record is damaged")
            yield from datas
            batch, held = [], 0
        if not head:
            return


def read_at(path: str, number: int) -> tuple[int | str | None, np.ndarray]:
    """Record ``number`` of a file, through its index."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(re.sub(r"records$", "index", name)) as index:
        index.seek(16 * number)
        offset, _ = struct.unpack("<QQ", index.read(16))
    with store.open_input_file(name) as stream:
        stream.seek(offset)
        return parse(next(read_records(stream, 1)))


def _letters(word: bytes) -> bool:
    """Letters only, and still so in lower case (a few capitals turn into a letter and a mark)."""
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text.lower().isalpha() and "\ufffd" not in text


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file, word by word where that gives the same ids as the whole text.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words.  Words
    are remembered (``limit`` at a time).  ASCII letters are lowered first, as the tokenizer does; texts that
    hold the opening of a special token are encoded whole.
    """

    _AFTER_WORD = b".,!?;:&|()[]{}*#=+/<>\""

    def __init__(self, tokenizer_file: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = WordTable(lambda t: t.lower().split(), self._new, self._reset, limit)
        self._reset()

    def _reset(self) -> None:
        self.parts, self.part_ids, self.pool = Ids(), Pool(np.uint32), Pool(np.uint32)

    def _new(self, words: list[bytes]) -> None:
        """A word of letters with punctuation after it has the ids of both, one after the other."""
        known, number, rows, double, after = len(self.parts), self.parts.__getitem__, [], [], self._AFTER_WORD
        for word in words:
            core = word.rstrip(after)
            if len(core) < len(word) and (core.isalpha() or _letters(core)):
                rows.append(number(core))
                rows.append(number(word[len(core) :]))
                double.append(2)
            else:
                rows.append(number(word))
                double.append(1)
        self.part_ids.add(*self._encode_parts(last_keys(self.parts, len(self.parts) - known)))
        flat, sizes = self.part_ids.take(np.array(rows))
        self.pool.add(flat, segment_sums(sizes, np.array(double)))

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each part.  Words of letters are encoded side by side in one text: each ends in an id of a word's end, and in one only."""
        plain = np.fromiter((p.isalpha() or _letters(p) for p in parts), bool, len(parts))
        words = [p for p, x in zip(parts, plain, strict=True) if x]
        flat, stops = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if words:
            texts = [b" ".join(words[a : a + 1000]).decode() for a in range(0, len(words), 1000)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[flat]) + 1
            if len(stops) != len(words):
                plain[:] = False
        others = [p.decode("utf-8", "replace") for p, x in zip(parts, plain, strict=True) if not x]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
        sizes, starts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if plain.any():
            sizes[plain], starts[plain] = np.diff(stops, prepend=0), np.r_[0, stops[:-1]]
        else:
            flat = flat[:0]
        sizes[~plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        starts[~plain] = len(flat) + np.cumsum(sizes[~plain]) - sizes[~plain]
        pool = np.concatenate([flat, np.fromiter(chain.from_iterable(rest), np.uint32)])
        return pool[ranges(starts, sizes)], sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each."""
        whole = {i: np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if b"<|" in t}
        flat, lengths = self.table.batch([b"" if i in whole else t for i, t in enumerate(texts)])
        ids, sizes = self.pool.take(flat)
        ends, stops = np.r_[0, np.cumsum(sizes)], np.cumsum(lengths)
        counts = ends[stops] - ends[stops - lengths]
        if whole:
            rows = np.split(ids, np.cumsum(counts)[:-1])
            rows = [whole.get(i, r) for i, r in enumerate(rows)]
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, counts


@lru_cache(maxsize=1)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder for all tasks of a worker process, so that known words stay known."""
    return WordEncoder(tokenizer_file)


def write(docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append the end id, and write record files in ascending doc_id order.

    Returns the manifest: part, path, n_docs, n_ids, id_type (long or string), one row per file; file ``part`` holds larger ids than those
    before it.  Ids are numbers or texts; null ones come first; equal ids stand in the order of a hash of their texts.  Null texts count as empty.  Each attempt of a
    task writes a file of its own and only finished ones are in the manifest, so lost executors do no harm.
    Records of an empty table: no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    id_type = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    rows = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        encoder, name, stream, index = None, None, None, None
        n_docs = n_ids = at = 0
        for batch in batches:
            for part in slices(batch, "text"):
                if stream is None:
                    encoder, number = word_encoder(tokenizer_file), part.column("part")[0].as_py()
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.records"
                    stream, index = store.open_output_stream(f"{root}/{name}"), store.open_output_stream(f"{root}/{name[:-8]}.index")
                ids, sizes = encoder.encode(text_bytes(part.column("text")).to_pylist())
                stops = np.cumsum(sizes)
                rows = zip(part.column("doc_id").to_pylist(), (stops - sizes).tolist(), stops.tolist(), strict=True)
                out = frames([serialize(doc_id, np.append(ids[a:b], np.uint32(END_ID))) for doc_id, a, b in rows])
                ends = at + np.cumsum([len(r) for r in out])
                places = np.stack([np.r_[at, ends[:-1]], np.diff(np.r_[at, ends])], 1)
                at = int(ends[-1])
                stream.write(b"".join(out))
                index.write(places.astype("<u8").tobytes())
                n_docs, n_ids = n_docs + len(sizes), n_ids + int(sizes.sum()) + len(sizes)
        if stream is not None:
            stream.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids], "id_type": [id_type]})

    return map_batches(dealt, run, "part int, path string, n_docs long, n_ids long, id_type string")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back from the files of a manifest.

    The manifest is one small row per file; the driver adds up the ids of the files before each.
    """
    spark = manifest.sparkSession
    files, start, id_type = [], 0, "long"
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((row["path"], start))
        start, id_type = start + row["n_ids"], row["id_type"]
    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))

    def run(batches):
        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with store.open_input_stream(name, buffer_size=1 << 20) as stream:
                    for data in read_records(stream):
                        doc_id, ids = parse(data)
                        for key, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            out[key].append(value)
                        start += len(ids)
                        if len(out["start"]) == 10_000:
                            yield _rows(out, id_type)
                            out = {k: [] for k in out}
                yield _rows(out, id_type)

    return listed.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _rows(out: dict[str, list], id_type: str) -> pa.RecordBatch:
    kind = pa.string() if id_type == "string" else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(v, kind if k == "doc_id" else pa.int64()) for k, v in out.items()], list(out))
