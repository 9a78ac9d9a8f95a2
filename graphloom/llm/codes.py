"""Vector code compression: product codes from codebooks that are refined by walks over tries of distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Vectors whose parts a task holds, and whose tries it walks, at once.
BLOCK_ROWS = 1 << 15
#: A subtree of a trie with at most so many leaves is walked a level at a time and not a node at a time.
LEAVES = 1 << 12
#: Integer components are at most so large, so that no sum of squares leaves 64 bits.
LARGEST = 1 << 26
#: Labels of which the sums of errors are broadcast; more are joined over salted keys.
BROADCAST_LABELS, SALTS = 100_000, 32


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the first of equals) of each of the distinct, lexicographically sorted `parts`, and its squared distance.

    The rows are the leaves of a trie with a component a level. A depth-first walk carries, for each node, the distances of its
    prefix to all entries, so that rows with a common prefix share them; subtrees of at most LEAVES leaves go a level at a time.
    """
    rows, width = parts.shape
    best, distance = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    stack = [(0, rows, 0, np.zeros((1, len(book)), np.int64))]
    while stack:
        a, b, depth, shared = stack.pop()
        if b - a > LEAVES and depth < width:
            column = parts[a:b, depth]
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1), b - a]
            for i in range(len(cuts) - 2, -1, -1):
                stack.append((a + int(cuts[i]), a + int(cuts[i + 1]), depth + 1, shared + (book[:, depth] - column[cuts[i]]) ** 2))
            continue
        leaves, parent, fresh = parts[a:b], np.zeros(b - a, np.int64), np.zeros(b - a, bool)
        fresh[:1] = True
        for k in range(depth, width):
            fresh[1:] |= leaves[1:, k] != leaves[:-1, k]
            first = np.flatnonzero(fresh)
            shared = shared[parent[first]] + (leaves[first, k, None] - book[None, :, k]) ** 2
            parent = np.cumsum(fresh) - 1
        entry = shared.argmin(1)
        best[a:b], distance[a:b] = entry[parent], shared[np.arange(len(entry)), entry][parent]
    return best, distance


def _sorted_parts(block: np.ndarray, position: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts of the vectors at one position in lexicographic order, how often each occurs, and each vector's part."""
    own = block[:, position * width : (position + 1) * width]
    order = np.lexsort(own.T[::-1]) if width else np.arange(len(own))
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[order[1:]] != own[order[:-1]]).any(1)
    which = np.empty(len(own), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return own[order[fresh]], np.bincount(which, minlength=int(fresh.sum())), which


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in blocks of about BLOCK_ROWS, with their vectors as rows of a matrix, filled up with zeros to `width`."""

    def block(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        column = rows.column("_ints").combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(lengths), width), np.int64)
        out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return rows, out

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block(held)
            held, n = [], 0
    if n:
        yield block(held)


def _moved_sums(books, width: int):
    """For each entry that a block's parts are assigned to: how many they are, and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, total = books.value.shape[0], None
        for _, block in _blocks(batches, width * positions):
            if total is None:
                total = np.zeros((positions, books.value.shape[1], width + 1), np.int64)
            for p, book in enumerate(books.value):
                parts, weights, _ = _sorted_parts(block, p, width)
                entry, _ = nearest_entries(parts, book)
                np.add.at(total[p], entry, np.hstack([weights[:, None], parts * weights[:, None]]))
        if total is not None:
            at = np.argwhere(total[:, :, 0] > 0)
            sums = total[at[:, 0], at[:, 1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width + 1), pa.int32()), pa.array(sums.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), lists], ["position", "entry", "sums"])

    return run


def _coded(books, width: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = books.value.shape[0]
        for rows, block in _blocks(batches, width * positions):
            codes, error = np.zeros((len(block), positions), np.uint8), np.zeros(len(block), np.int64)
            for p, book in enumerate(books.value):
                parts, _, which = _sorted_parts(block, p, width)
                entry, distance = nearest_entries(parts, book)
                codes[:, p] = entry[which]
                error += distance[which]
            done = rows.select(keep).append_column("code", pa.array([c.tobytes().hex() for c in codes], pa.string())).append_column("error", pa.array(error, pa.int64()))
            yield from done.to_batches(max_chunksize=1 << 13)

    return run


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; a component beyond LARGEST raises."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    return F.transform(vector, lambda x: F.when(F.abs(whole(x)) <= LARGEST, whole(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for integer codes")).cast("int")))


def kept_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """`vectors` that are not null and hold no null or non-finite component, as integers in `_ints`."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(good).withColumn("_ints", integers(x, scale)).drop("embedding")


def fit_codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks, an array (part, entry, component), of the rows that `kept_vectors` gives.

    They start as the parts of the rows with the `entries` smallest vec_id (those without an id come last; repeated ids in order of their
    components). In each round all tasks walk the tries of the distinct parts of their vectors, block by block, and
    add up the weighted parts of each entry; the partial sums, at most `parts` * `entries` rows a task, are summed by Spark, and the driver gets one row
    an entry. An entry becomes its parts' floor(sum / count) by component; one without parts stays. Shorter vectors count as filled up with zeros,
    to a multiple of `parts` components.
    """
    first = [r["_ints"] for r in rows.select("vec_id", "_ints").orderBy(F.asc_nulls_last("vec_id"), "_ints").limit(entries).collect()]
    longest = rows.agg(F.max(F.size("_ints"))).first()[0] or 0
    width = -(-longest // parts)
    start = np.zeros((len(first), width * parts), np.int64)
    for row, values in zip(start, first, strict=True):
        row[: len(values)] = values
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        partial = rows.select("_ints").mapInArrow(_moved_sums(shared, width), "position int, entry int, sums array<long>")
        sums = partial.groupBy("position", "entry").agg(F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(width + 1))).alias("sums"))
        for r in sums.collect():
            count, *total = r["sums"]
            books[r["position"], r["entry"]] = [x // count for x in total]
    return books


def compress_vectors(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """`rows` of `kept_vectors` with code (two hex digits for each part's nearest entry) and error (squared distances summed over parts) for `_ints`."""
    if books.shape[1] > 256:
        raise ValueError("an entry's number has to fit in two hex digits")
    keep = [c for c in rows.columns if c != "_ints"]
    names = {c: f"_aside{i}" for i, c in enumerate(keep)}
    shared = rows.sparkSession.sparkContext.broadcast(books)
    plain = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), "_ints")
    schema = [*(f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in names.items()), "code string", "error long"]
    done = plain.mapInArrow(_coded(shared, books.shape[2], list(names.values())), ", ".join(schema))
    return done.select(*(F.col(n).alias(c) for c, n in names.items()), "code", "error")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def reconstructed(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """`codes` with vector: the entries that a code names, one after another, as integers."""
    table = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in book.tolist())) for book in books))
    entry = lambda k: F.get(F.get(table, k - 1), F.conv(F.substring("code", 2 * k - 1, 2), 16, 10).cast("int"))
    return codes.withColumn("vector", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(len(books))), entry)))


def code_report(vectors: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels) and codebooks_sha256 of every vector that takes part.

    `vectors` has vec_id, embedding and label; other columns are ignored. Vectors that are null or hold null or non-finite components take no part; an empty
    vector has errors of 0 to entries of zeros. Repeated rows count as often as they occur; rows without an id, or without a label (these
    are one group), are coded like others. An empty table gives no row. With under `entries` rows a codebook is as short. A component beyond
    LARGEST after scaling raises. Codes are written once; errors are added up before they shuffle, and a label with a third of
    all rows costs one row a task. Sums for up to BROADCAST_LABELS labels are broadcast, more are joined on salted labels.
    """
    rows = kept_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), scale)
    books = fit_codebooks(rows, parts, entries, rounds)
    coded = written(compress_vectors(rows, books), "codes") if books.size or books.shape[1] else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salt, same = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"), F.col("_label").eqNullSafe(F.col("label"))
    totals = totals.select(F.col("label").alias("_label"), "label_error")
    if totals.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(totals), same)
    else:
        spread = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = coded.withColumn("_own", salt).join(spread, same & (F.col("_own") == F.col("_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
