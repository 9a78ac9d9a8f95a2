"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A file is a row of records. A record is the payload's length (unsigned 64-bit), the masked CRC-32C of these 8 bytes (unsigned
32-bit), the payload, and the payload's masked CRC-32C: the framing that readers of tf.data records expect. A payload is a
document's id (signed 64-bit), a byte that is 1 if there is an id, a byte with the width of a token id (2 or 4), two zero
bytes, and the token ids. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import shared_dir, slices, written
from graphloom.llm.packing import token_encoder

#: Bytes of payloads that are framed, or checked, at once.
BLOCK_BYTES = 4 << 20
#: The reflected polynomial of CRC-32C and the constant that a mask adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
HEAD, HEAD_BYTES = "<qBBxx", 12
LOWEST = -(1 << 63)


@lru_cache(1)
def _by_two_bytes() -> np.ndarray:
    """What 16 bits in the register become after 16 steps."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(64)
def _past(step: int, level: int) -> np.ndarray:
    """Tables by byte of the register: what it becomes after `step` * 2 ** `level` zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if level:
        half = _past(step, level - 1)
        bits = _moved(half, _moved(half, bits))
    else:
        for _ in range(step // 2):
            bits = _by_two_bytes()[bits & 0xFFFF] ^ (bits >> 16)
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k >> 3] ^= np.where(np.arange(256) >> (k & 7) & 1, bits[k], np.uint32(0)).astype(np.uint32)
    return out


def crc32c(parts: list[bytes], step: int = 64) -> np.ndarray:
    """CRC-32C of each of `parts`, of 4 bytes at least.

    All parts are cut into chunks of `step` bytes, the first filled up with zeros in front, which leave an empty register as
    it is. The chunks run side by side; then neighbours join, the left one moved past as many zero bytes as the right one has.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    if not sizes.size:
        return np.zeros(0, np.uint32)
    if sizes.min() < 4:
        raise ValueError("a part of under 4 bytes")
    counts = -(-sizes // step)
    fill = bytes(step)
    data = np.frombuffer(b"".join([x for p, n, c in zip(parts, sizes.tolist(), counts.tolist(), strict=True) for x in (fill[: c * step - n], p)]), np.uint8).copy()
    first = np.cumsum(counts * step) - sizes
    for k in range(4):
        data[first + k] ^= 255  # the register begins with all ones
    words, table = data.view("<u2").reshape(-1, step // 2).T.astype(np.uint32), _by_two_bytes()
    crc = np.zeros(words.shape[1], np.uint32)
    for column in words:
        crc = table[(crc ^ column) & 0xFFFF] ^ (crc >> 16)
    level = 0
    while counts.max() > 1:
        odd, begin = counts & 1, np.cumsum(counts) - counts
        halves = (counts + odd) // 2
        which = np.repeat(np.arange(len(counts)), halves)
        j = np.arange(len(which)) - np.repeat(np.cumsum(halves) - halves, halves)
        right = begin[which] + 2 * j + 1 - odd[which]
        left = np.where((odd[which] > 0) & (j == 0), np.uint32(0), crc[np.maximum(right - 1, 0)])
        crc, counts, level = _moved(_past(step, level), left) ^ crc[right], halves, level + 1
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum that may itself be checksummed: turned right by 15 bits, plus a constant."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths, 8)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, t.tobytes())) for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


def checked(records: list[bytes]) -> list[bytes]:
    """The payloads of records; ValueError if a length or a checksum is wrong."""
    if any(len(r) < 20 or struct.unpack_from("<Q", r)[0] != len(r) - 16 for r in records):
        raise ValueError("a record's length is wrong")
    payloads = [r[12:-4] for r in records]
    for parts, at, step in (([r[:8] for r in records], 8, 8), (payloads, -4, 64)):
        told = np.frombuffer(b"".join([r[at : at + 4 or None] for r in records]), "<u4")
        if (masked(crc32c(parts, step)) != told).any():
            raise ValueError("a record's checksum is wrong")
    return payloads


def packed(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(HEAD, doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = struct.unpack_from(HEAD, payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=HEAD_BYTES).astype("<u4")


def _store(folder: str):
    """The file system of a qualified path, as tasks reach it, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.LocalFileSystem(), folder
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else folder)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme that Spark would read it by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def _tokenised(path: str, end: int, bounds: list[int]):
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path)
        width = 2 if max(encoder.size, end + 1) <= 1 << 16 else 4
        last = np.array([end], "<u4")
        for part in slices(batches, "text"):
            ids, out = part.column("doc_id").to_pylist(), []
            for i, text in zip(ids, part.column("text").to_pylist(), strict=True):
                out.append(packed(i, np.concatenate([np.frombuffer(encoder.encode(text or ""), "<u4"), last]), width))
            keys = np.array([LOWEST if i is None else i for i in ids], np.int64)
            low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
            spread = np.array([zlib.crc32(p) for p in out], np.int64) % (high - low + 1)
            yield pa.RecordBatch.from_arrays([pa.array(low + spread, pa.int32()), part.column("doc_id"), pa.array(out, pa.binary())], ["part", "doc_id", "payload"])

    return run


def _writer(folder: str):
    names = ["part", "file", "record", "offset", "size", "doc_id", "n_tokens", "tokens_before"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, open_part, name, record, offset, before = None, None, "", 0, 0, 0
        try:
            for batch in slices(batches, "payload", BLOCK_BYTES):
                parts, ids, payloads = (batch.column(k).to_pylist() for k in ("part", "doc_id", "payload"))
                rows = []
                for part, i, payload, frame in zip(parts, ids, payloads, frames(payloads), strict=True):
                    if part != open_part:
                        if out:
                            out.close()
                        # an attempt has names of its own, and only the attempt whose index rows Spark commits is ever read
                        name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.records"
                        out, open_part, record, offset, before = store.open_output_stream(f"{base}/{name}"), part, 0, 0, 0
                    out.write(frame)
                    n = (len(payload) - HEAD_BYTES) // payload[9]
                    rows.append((part, name, record, offset, len(frame), i, n, before))
                    record, offset, before = record + 1, offset + len(frame), before + n
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        finally:
            if out:
                out.close()

    return run


INDEX = "part int, file string, record long, offset long, size long, doc_id long, n_tokens long, tokens_before long"


def write_sequences(documents: DataFrame, tokenizer: str, folder: str, end: int = 0, files: int | None = None) -> DataFrame:
    """Writes the token ids of every text of `documents` (doc_id, text), then `end`, as records in ascending doc_id order; returns the index.

    `folder` (created, on a store that all executors share) gets `data`, with at most `files` files
    (spark.sql.shuffle.partitions, if not given), and `index`, a Parquet table of one row a record: part (the files' order), file,
    record (place in the file), offset and size in bytes, doc_id, n_tokens, tokens_before (in the file). Files are cut at
    quantiles of doc_id, which only that column is read for. Rows of one doc_id, or without any, may be a third of all: quantiles then
    repeat, and the rows are spread over the files between them. A file's rows are sorted on disk where memory is short.

    A task that is run again writes under another name; what a lost attempt left is in no index row and is never read.
    A null text counts as empty: its record holds `end` alone. Rows without an id come first; rows of equal doc_id stand side by side, each
    with a record of its own. Token ids take two bytes where the vocabulary has at most 65,536. Other columns are ignored. An empty table gives no file.
    """
    spark = documents.sparkSession
    folder = qualified(spark, folder)
    store, base = _store(folder)
    store.create_dir(f"{base}/data", recursive=True)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit(LOWEST))
    bounds = texts.agg(F.percentile_approx(key, [k / files for k in range(1, files)], 20 * files)).first()[0] if files > 1 else None
    bounds = sorted(bounds or [])
    rows = texts.mapInArrow(_tokenised(tokenizer, end, bounds), "part int, doc_id long, payload binary").repartitionById(files, "part")
    index = rows.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "payload").mapInArrow(_writer(f"{folder}/data"), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


_READ = "part int, record long, doc_id long, ids binary"
_READ_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _unpacked_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    out = [(part, record, *unpacked(p)) for (part, record, _), p in zip(rows, checked([r[2] for r in rows]), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((a, b, c, d.tobytes()) for a, b, c, d in out), strict=True), _READ_TYPES, strict=True)], ["part", "record", "doc_id", "ids"])


def _whole_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as data:
                    rows, held, record = [], 0, 0
                    while head := data.read(12):
                        rest = struct.unpack_from("<Q", head)[0] + 4 if len(head) == 12 else 0
                        rows.append((part, record, head + data.read(rest)))
                        held, record = held + rest, record + 1
                        if held >= BLOCK_BYTES:
                            yield _unpacked_rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _unpacked_rows(rows)

    return run


def _picked_records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        opened: dict = {}
        try:
            for batch in batches:
                rows, held = [], 0
                for part, name, record, offset, size in zip(*(batch.column(k).to_pylist() for k in ("part", "file", "record", "offset", "size")), strict=True):
                    if name not in opened:
                        if len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        opened[name] = store.open_input_file(f"{base}/{name}")
                    rows.append((part, record, opened[name].read_at(size, offset)))
                    held += size
                    if held >= BLOCK_BYTES:
                        yield _unpacked_rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _unpacked_rows(rows)
        finally:
            for f in opened.values():
                f.close()

    return run


def read_sequences(spark: SparkSession, folder: str, shuffled: int | None = None) -> DataFrame:
    """part, record, doc_id and ids (little-endian unsigned 32-bit) of every record that `write_sequences` put in `folder`.

    Files are read whole, one task a file, in blocks. With `shuffled`, a seed, the index is put in a random order first (by a hash of the seed
    and the record's place, so the order is the same each time) and each task reads its share record by record, by offset.
    A wrong length or checksum raises.
    """
    folder = qualified(spark, folder)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    if shuffled is not None:
        places = index.withColumn("_by", F.xxhash64(F.lit(shuffled), "part", "record")).repartition(F.col("_by")).sortWithinPartitions("_by").drop("_by")
        return places.select("part", "file", "record", "offset", "size").mapInArrow(_picked_records(f"{folder}/data"), _READ)
    files = index.groupBy("part", "file").agg(F.count(F.lit(1)).alias("records"))
    n = (index.agg(F.max("part")).first()[0] or 0) + 1
    return files.select("part", "file").repartitionById(n, "part").mapInArrow(_whole_files(f"{folder}/data"), _READ)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, checksum and, as a task reads its files record after record, the tokens before each record in its file."""
    names, types = ["part", "doc_id", "before", "n_tokens", "ids_crc32"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    now, before = None, 0
    for batch in batches:
        rows = []
        for part, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "ids")), strict=True):
            if part != now:
                now, before = part, 0
            rows.append((part, doc_id, before, n := len(ids) // 4, zlib.crc32(ids)))
            before += n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def sequence_report(documents: DataFrame, tokenizer: str, end: int = 0, files: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with `end`) and ids_crc32 of every document, from files written to the shared folder and read back.

    A record's start is the sum of what its task's file holds before it and of the files before, which are at most `files` rows. Nulls, repeated rows
    and empty tables as in `write_sequences`.
    """
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    write_sequences(documents, tokenizer, folder, end, files)
    found = written(read_sequences(spark, folder).mapInArrow(_measured, "part int, doc_id long, before long, n_tokens long, ids_crc32 long"), "read-back")
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
