"""Exact substring deduplication with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, written

#: Bytes of the pieces whose least hash anchors a string.
PIECE = 24
#: Bytes of contexts that are suffix-sorted together.
SORTED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are taken in stretches of so many bytes: places then fit in 24 bits.
STRETCH = 4 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Anchors:
    """Anchors of byte stretches: for each string of `length` bytes, its piece of least hash, the leftmost of equal ones."""

    def __init__(self, length: int):
        self.length, self.span = length, length - PIECE + 1
        self.powers, self.inverse = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the anchor, its place, first start that it anchors, number of these); [starts, ends) are the texts in data."""
        n = len(data)
        none = np.empty(0, np.int64)
        if n < self.length:
            return none, none, none, none
        if len(self.powers) < n + 1:
            self.powers, self.inverse = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.inverse[:n], out=total[1:])
        h = (total[PIECE:] - total[:-PIECE]) * self.powers[: n - PIECE + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= self.span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < self.span:
            least = np.minimum(least[: len(least) - (self.span - width)], least[self.span - width :])
        owner = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        good = np.zeros(len(owner) + 1, np.int32)
        long = ends - starts >= self.length
        np.add.at(good, starts[long], 1)
        np.add.at(good, ends[long] - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(good[:-1]) > 0)
        if not at.size:
            return none, none, none, none
        own = owner[at]
        cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(at) != 1)) + 1
        first = np.concatenate([[0], cut])
        many = np.diff(np.concatenate([first, [len(at)]]))
        place = own[first]
        return h[place].view(np.int64), place, at[first], many


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length)
        for part in slices(batches, "text"):
            stretches, total = [], 0
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for a in range(0, max(1, len(raw) - length + 1), STRETCH):
                    piece = raw[a : a + STRETCH + length - 1]
                    if len(piece) < length:
                        continue
                    if total + len(piece) > STRETCH and stretches:
                        yield _rows(finder, stretches, length)
                        stretches, total = [], 0
                    stretches.append((doc, a, piece))
                    total += len(piece)
            if stretches:
                yield _rows(finder, stretches, length)

    return run


def _rows(finder: Anchors, stretches: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    joined = b"".join(x[2] for x in stretches)
    ends = np.cumsum([len(x[2]) for x in stretches])
    starts = ends - np.array([len(x[2]) for x in stretches])
    hashes, place, first, many = finder.find(np.frombuffer(joined, np.uint8), starts, ends)
    which = np.searchsorted(ends, first, "right")
    seeds = (place - first) * 128 + many
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    contexts = np.fromiter((digest(view[a : a + n + length - 1], s) for a, n, s in zip(first.tolist(), many.tolist(), seeds.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
    docs = np.array([x[0] for x in stretches], np.int64)[which] if len(which) else np.empty(0, np.int64)
    offsets = np.array([x[1] for x in stretches], np.int64) - starts
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes, contexts, docs, first + (offsets[which] if len(which) else 0))] + [pa.array(many, pa.int32())], ["anchor", "context", "doc", "at", "many"])


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, context, doc and at: later rows of a context, all of whose strings are repeats (context null), and the first rows of contexts whose anchor has several.

    Only the last row's state is kept, however many rows an anchor has.
    """
    last: tuple | None = None  # anchor, context, doc and at of the running context's first row, its many, and whether it has been passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, context, doc, at, many = (batch.column(c).to_numpy() for c in ("anchor", "context", "doc", "at", "many"))
        if last:
            anchor, context, doc, at, many = (np.concatenate([[x], y]) for x, y in zip(last[:5], (anchor, context, doc, at, many), strict=True))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
        firsts = np.flatnonzero(new)
        of = firsts[np.cumsum(new) - 1]
        later = ~new & ((doc != doc[of]) | (at != at[of]))
        groups = np.cumsum(new_anchor)[firsts]
        several = np.zeros(len(firsts), bool)
        pairs = groups[1:] == groups[:-1]
        several[1:] |= pairs
        several[:-1] |= pairs
        passed = bool(last and last[5])
        out = firsts[several]
        if passed and len(out) and out[0] == 0:
            out = out[1:]
        k = firsts[-1]
        # an anchor that goes on after this batch: its first row is passed on as soon as a second context shows up
        handed = bool(several[-1]) or (k == 0 and passed)
        last = (anchor[k], context[k], doc[k], at[k], many[k], handed)
        rows = np.concatenate([np.flatnonzero(later), out])
        asked = np.concatenate([np.zeros(int(later.sum()), bool), np.ones(len(out), bool)])
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(anchor[rows], pa.int64()), pa.array(doc[rows], pa.int64()), pa.array(at[rows], pa.int64()), pa.array(many[rows], pa.int32()), pa.array(asked)], ["anchor", "doc", "at", "many", "asked"])


def _contexts(length: int):
    """The bytes that asked rows stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for doc, text, asked in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("_asked").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(x["anchor"], doc, x["at"], x["many"], raw[x["at"] : x["at"] + x["many"] + length - 1]) for x in asked]
            for k in range(0, len(out), 20_000):
                columns = zip(*out[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "doc", "at", "many", "bytes"])

    return run


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of `text` in order, right to `depth` bytes, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly; one scan over the buckets of first bytes, from left to
    right, puts each remaining suffix behind its successor's place.
    """
    n = len(text)
    t = np.frombuffer(text, np.uint8)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    sign[-1] = -1
    known = np.where(sign != 0, np.arange(n), n)
    smaller = sign[np.minimum.accumulate(known[::-1])[::-1]] > 0
    counts = np.bincount(t, minlength=256)
    heads = np.concatenate([[0], np.cumsum(counts)])[:256].tolist()
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: text[i : i + depth])
    out = [-1] * n
    first = np.bincount(t[smaller], minlength=256)
    tails = np.cumsum(counts) - first
    at = 0
    for byte in np.flatnonzero(first).tolist():
        m, place = int(first[byte]), int(tails[byte])
        out[place : place + m] = direct[at : at + m]
        at += m
    large = (~smaller).tolist()
    last = text[n - 1]
    out[heads[last]] = n - 1
    heads[last] += 1
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and large[j]:
            byte = text[j]
            out[heads[byte]] = j
            heads[byte] += 1
    return np.array(out, np.int64)


def repeated_starts(rows: list[tuple[int, int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(doc, at, many) of runs of starts whose string also starts earlier, among contexts (anchor, doc, at, many, bytes)."""
    text = b"\xff".join(r[4] for r in rows) + b"\xff"
    sizes = np.array([len(r[4]) + 1 for r in rows])
    begin = np.cumsum(sizes) - sizes
    many = np.array([r[3] for r in rows])
    valid = np.zeros(len(text) + 1, np.int32)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + many, -1)
    valid = np.cumsum(valid[:-1]) > 0
    order = suffix_array(text, length)
    order = order[valid[order]]
    if len(order) < 2:
        return []
    t = np.frombuffer(text, np.uint8)
    # adjacent common prefixes, as far as they matter: at least `length` or not
    equal = np.empty(len(order) - 1, bool)
    reach = np.arange(length)
    for a in range(0, len(equal), 4096):
        here = t[order[a : a + 4097, None] + reach]
        equal[a : a + 4096] = (here[1:] == here[:-1]).all(1)
    same = np.cumsum(np.concatenate([[True], ~equal])) - 1
    which = np.searchsorted(begin, order, "right") - 1
    doc = np.array([r[1] for r in rows], np.int64)[which]
    start = np.array([r[2] for r in rows], np.int64)[which] + order - begin[which]
    by = np.lexsort([start, doc, same])
    doc, start, same = doc[by], start[by], same[by]
    first = np.concatenate([[True], same[1:] != same[:-1]])
    of = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (doc != doc[of]) | (start != start[of])
    doc, start = doc[later], start[later]
    by = np.lexsort([start, doc])
    doc, start = doc[by], start[by]
    if not len(doc):
        return []
    cut = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) > 1)) + 1])
    ends = np.concatenate([cut[1:], [len(doc)]]) - 1
    return list(zip(doc[cut].tolist(), start[cut].tolist(), (start[ends] - start[cut] + 1).tolist(), strict=True))


def _sorted_contexts(length: int):
    """Suffix-sorts the contexts of whole anchors, some SORTED_BYTES at once, from rows that come by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0

        def done(part: list) -> pa.RecordBatch:
            found = repeated_starts(part, length)
            columns = zip(*found, strict=True) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc", "at", "many"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "at", "many", "bytes")), strict=True):
                if rows and rows[-1][0] != r[0]:
                    if size >= SORTED_BYTES:
                        yield done(rows)
                        rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield done(rows)

    return run


def _covered(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for text, runs in zip(part.column("text").to_pylist(), part.column("_runs").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, spans = [], 0, 0
                if runs:
                    mark = np.zeros(len(raw) + 1, np.int32)
                    a = np.minimum([x["at"] for x in runs], len(raw))
                    b = np.minimum([x["at"] + x["many"] + length - 1 for x in runs], len(raw))
                    np.add.at(mark, a, 1)
                    np.add.at(mark, b, -1)
                    inside = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
                    edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
                    spans = len(edge)
                    for x, y in edge.tolist():
                        kept.append(raw[at:x])
                        at = y
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest() if digest else left))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


#: Stands for a null doc_id while rows are compared: smaller than any other.
NULL_ID = -(1 << 63)


def remove_repeats(documents: DataFrame, length: int = 100, digest: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or the bytes that are left, `kept`) of every document.

    Removed is each UTF-8 byte covered by a string of `length` bytes that also starts earlier: in a smaller doc_id, or earlier in
    the same document. Strings are judged on the input; matches never cross documents.

    Each string is anchored at its piece of least hash, so equal strings have equal anchors at equal places; rows of (anchor,
    digest of what it anchors) shuffle, about one for 40 bytes. All but the first of equal contexts are repeats as a whole. Where an anchor has
    several contexts, their first occurrences' bytes are fetched and suffix-sorted by two-stage sorting, and adjacent common prefixes of
    `length` bytes tell which strings start earlier. Rows of an anchor stream through a sorted partition, so none is held whole.

    A null text is empty; a text under `length` bytes loses nothing. A null doc_id is smaller than any other. Rows of equal doc_id
    are earlier than none of each other; what any of them loses is cut from all at the same places. Other columns are ignored.
    """
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    anchors = texts.mapInArrow(_anchored(length), "anchor long, context long, doc long, at long, many int")
    sifted = written(anchors.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "at").mapInArrow(_sifted, "anchor long, doc long, at long, many int, asked boolean"), "sifted")
    asked = sifted.where("asked").groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "many")).alias("_asked"))
    contexts = texts.join(asked, texts["doc_id"] == asked["doc"]).select("doc_id", "text", "_asked").mapInArrow(_contexts(length), "anchor long, doc long, at long, many int, bytes binary")
    compared = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_contexts(length), "doc long, at long, many long")
    runs = sifted.where("not asked").select("doc", "at", F.col("many").cast("long").alias("many")).union(compared)
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "many")).alias("_runs"))
    kept = "kept_sha256 string" if digest else "kept binary"
    out = texts.join(by_doc, texts["doc_id"] == by_doc["doc"], "left").select("doc_id", "text", "_runs").mapInArrow(_covered(length, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
