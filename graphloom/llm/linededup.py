"""Corpus-wide line deduplication: Bloom filters of keys seen once and twice, then exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import aside, slices, with_fields, written

#: White space that is stripped from a line's ends.
SPACE = " \t\n\x0b\x0c\r"
#: Bits of each filter. Both are bounded whatever the input; a fuller filter only lets more suspects through.
FILTER_BITS = 1 << 26
#: Filters travel and merge in chunks of so many bits.
CHUNK_BITS = 1 << 20
#: A key with at least this part of all repeated lines is hot: there are at most so many, and their verdicts (24 bytes each) are broadcast.
HOT = 4096
#: Partial filters of one chunk first merge in so many groups.
FAN = 16


def line_keys(text: str | None, least: int) -> tuple[list[str], list[str]]:
    """The lines of a text and their keys; a key of under `least` code points is ''."""
    text = text or ""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    keys = [k if len(k := x.strip(SPACE)) >= least else "" for x in low.split("\n")]
    return text.split("\n"), keys


def _places(keys: list[str], bits: int) -> np.ndarray:
    """Two bit positions of each key: an (n, 2) array."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask], 1).astype(np.int64)


def _partial_filters(least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, any_rows = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), False
        for part in slices(batches, "text"):
            keys: list[str] = []
            for text in part.column("text").to_pylist():
                keys += {k for k in line_keys(text, least)[1] if k}
            if not keys:
                continue
            any_rows = True
            places, first, counts = np.unique(_places(keys, bits), axis=0, return_index=True, return_counts=True)
            at, bit = places >> 3, (128 >> (places & 7)).astype(np.uint8)
            again = (counts > 1) | ((once[at] & bit) > 0).all(1)
            np.bitwise_or.at(twice, at[again].ravel(), bit[again].ravel())
            np.bitwise_or.at(once, at.ravel(), bit.ravel())
        if not any_rows:
            return
        task = xxhash.xxh3_64_intdigest(once.tobytes()) % FAN
        rows, size = [], min(bits, CHUNK_BITS) // 8
        for chunk in range(bits // CHUNK_BITS or 1):
            a, b = (x[chunk * size : (chunk + 1) * size] for x in (once, twice))
            if a.any():
                rows.append((chunk, task, _thin(a), _thin(b)))
        for i in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 16], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "part", "once", "twice"])

    return run


def _thin(bitmap: np.ndarray) -> bytes:
    """A bitmap as 'd' and its bytes, or 's' and the 32-bit places of its set bytes and their values, if shorter."""
    at = np.flatnonzero(bitmap).astype(np.uint32)
    if len(at) * 5 < len(bitmap):
        return b"s" + at.tobytes() + bitmap[at].tobytes()
    return b"d" + bitmap.tobytes()


def _thick(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, np.uint8, offset=1)
    n = (len(data) - 1) // 5
    out = np.zeros(size, np.uint8)
    out[np.frombuffer(data[1 : 1 + 4 * n], np.uint32)] = np.frombuffer(data[1 + 4 * n :], np.uint8)
    return out


def _merge(size: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
                a, b = _thick(a.as_py(), size), _thick(b.as_py(), size)
                twice |= b | (once & a)
                once |= a
        chunk = key[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([0], pa.int32()), pa.array([_thin(once)], pa.binary()), pa.array([_thin(twice)], pa.binary())], ["chunk", "part", "once", "twice"])

    return run


def twice_seen(documents: DataFrame, least: int = 20, bits: int = FILTER_BITS) -> np.ndarray:
    """The packed filter of keys that more than one document may hold; `bits` / 8 bytes on the driver."""
    schema = "chunk int, part int, once binary, twice binary"
    size = min(bits, CHUNK_BITS) // 8
    parts = documents.select("text").mapInArrow(_partial_filters(least, bits), schema)
    merged = parts.groupBy("chunk", "part").applyInArrow(_merge(size), schema).groupBy("chunk").applyInArrow(_merge(size), schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("chunk", "twice").collect():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = _thick(bytes(row["twice"]), size)
    return out


def _suspects(packed, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(packed.value, np.uint8)

        def held(at: np.ndarray) -> np.ndarray:
            return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

        for part in slices(batches, "text"):
            keys, ids = [], []
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = {k for k in line_keys(text, least)[1] if k}
                keys += found
                ids += [i] * len(found)
            if not keys:
                continue
            places = _places(keys, bits)
            kept = np.flatnonzero(held(places[:, 0]) & held(places[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in kept], pa.int64()), pa.array([xxhash.xxh3_128_digest(keys[i]) for i in kept], pa.binary())], ["doc_id", "digest"])

    return run


def _apply(least: int, digest: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, drops = part.column("text").to_pylist(), part.column("_drop").to_pylist()
            lines_n, dropped_n, kept = [], [], []
            for text, drop in zip(texts, drops, strict=True):
                if not drop:
                    lines_n.append((text or "").count("\n") + 1)
                    dropped_n.append(0)
                    kept.append(text)
                    continue
                lines, keys = line_keys(text, least)
                drop = set(drop)
                left = [x for x, k in zip(lines, keys, strict=True) if not k or xxhash.xxh3_128_digest(k) not in drop]
                lines_n.append(len(lines))
                dropped_n.append(len(lines) - len(left))
                kept.append("\n".join(left))
            if digest:
                kept = [hashlib.sha256((x or "").encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
            arrays = [pa.array(kept, pa.string()) if c == "text" else part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64())], [*columns, "n_lines", "n_dropped"])

    return run


def dedup_lines(documents: DataFrame, least: int = 20, documents_least: int = 3, bits: int = FILTER_BITS, digest: bool = False) -> DataFrame:
    """Drops repeated lines from `documents` (doc_id, text, any others); adds n_lines and n_dropped.

    A line's key is the line stripped of white space at both ends, with A-Z lower-cased. Keys of at least
    `least` code points that at least `documents_least` documents hold lose all their lines, except in the
    largest doc_id that holds them. What stays is joined by newlines, byte for byte. With `digest`, text is
    replaced by the SHA-256 of what stays.

    Two passes read the texts for the filters and for the suspects; only suspects (keys that the filter of
    twice-seen keys holds) shuffle, as 128-bit digests, which are written once: two of 10 ** 12 keys share one with odds of
    some 10 ** -15. Counting combines on the map side, so a line in a third of all documents
    costs one row a task; the verdicts on hot keys, at most HOT of them, are broadcast, and those on others are joined by digest.

    A null or empty text is one empty line and is left as it is. Rows with equal doc_id count as documents of
    their own, and all keep the line if theirs is the largest id. A null doc_id is smaller than any other; if
    only null ids hold a key, nothing is dropped for it.
    """
    spark = documents.sparkSession
    documents, back = aside(documents, ("doc_id", "text"), ("n_lines", "n_dropped"))
    columns = documents.columns
    packed = spark.sparkContext.broadcast(twice_seen(documents, least, bits).tobytes())
    suspects = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_suspects(packed, least, bits), "doc_id long, digest binary"), "suspects")
    repeated = written(suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_last")).where(F.col("_n") >= documents_least).where(F.col("_last").isNotNull()), "repeated")
    total = repeated.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(repeated.where(F.col("_n") * HOT >= total).select("digest", "_last"))
    others = suspects.join(hot.select("digest"), "digest", "left_anti").join(repeated.where(F.col("_n") * HOT < total).select("digest", "_last"), "digest")
    drops = (
        suspects.join(hot, "digest").union(others)
        .where(~F.col("doc_id").eqNullSafe(F.col("_last")))
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("_drop"))
        .withColumnRenamed("doc_id", "_doc")
    )
    joined = documents.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left").select(*columns, "_drop")
    return back(joined.mapInArrow(_apply(least, digest, columns), with_fields(documents, "n_lines long, n_dropped long")))


def line_dedup_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    done = dedup_lines(documents.select("doc_id", "text"), digest=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_sha256"))
