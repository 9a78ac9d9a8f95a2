"""Benchmark decontamination with a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import aside, slices, with_fields, written

#: Words of the lower-cased UTF-8 bytes: digits, a-z and everything that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Text bytes of benchmark items that one broadcast may hold; more are taken in several passes.
BROADCAST_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Grams:
    """Windows of the benchmark's words: a vocabulary, and by window length a set of windows with their items."""

    def __init__(self, items: list[tuple[str, str]], length: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            n = min(length, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.windows.setdefault(n, {}).setdefault(ids[i : i + n].tobytes(), set()).add(item)

    def scan(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(first word, words, items) of every occurring window. ids: words of many texts; ends: each word's text's end."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        found = []
        for n, windows in self.windows.items():
            if len(ids) < n:
                continue
            start = np.arange(len(ids) - n + 1)
            start = start[(unknown[n:] == unknown[: len(ids) - n + 1]) & (start + n <= ends[: len(start)])]
            for i in start.tolist():
                if items := windows.get(ids[i : i + n].tobytes()):
                    found.append((i, n, items))
        return found


def _mark(shared, columns: list[str]):
    """Adds what a part of the benchmark hits to _hit (word places) and _items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Grams = shared.value
        known = grams.vocabulary.get
        for part in slices(batches, "text"):
            all_ids, lengths = [], []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                lengths.append(len(words))
                all_ids += [known(w, 0) for w in words]
            ends = np.cumsum(lengths)
            found = grams.scan(np.array(all_ids, np.int32), np.repeat(ends, lengths))
            hits = [set(x or ()) for x in part.column("_hit").to_pylist()]
            items = [set(x or ()) for x in part.column("_items").to_pylist()]
            if found:
                rows = np.searchsorted(ends, [x[0] for x in found], "right").tolist()
                for k, (i, n, which) in zip(rows, found, strict=True):
                    first = i - int(ends[k] - lengths[k])
                    hits[k].update(range(first, first + n))
                    items[k] |= which
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array(lengths, pa.int64()), pa.array([sorted(x) for x in hits], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*columns, "n_words", "_hit", "_items"],
            )

    return run


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, length: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`documents` (doc_id, text, any others) with n_words, _hit (places of hit words) and _items (ids as strings).

    A window is `length` consecutive words of an item, or all words of a shorter one. Windows of benchmark parts
    of at most `broadcast_bytes` of text are broadcast; a larger benchmark is taken part by part, with the marks
    written between passes. A null text has no words; an item without words, or with a null id, is ignored.
    """
    spark = documents.sparkSession
    documents, back = aside(documents, ("doc_id", "text"), ("n_words", "_hit", "_items"))
    columns = documents.columns
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(total) // broadcast_bytes) or 1
    schema = with_fields(documents, "n_words long, _hit array<int>, _items array<string>")
    marked = documents.withColumns({"_hit": F.lit(None).cast("array<int>"), "_items": F.lit(None).cast("array<string>")})
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) if parts > 1 else items
        shared = spark.sparkContext.broadcast(Grams([(r["item"], r["text"]) for r in part.collect()], length))
        if k:
            marked = written(marked, "benchmark-hits")
        marked = marked.mapInArrow(_mark(shared, columns), schema)
    return back(marked)


#: A document is contaminated if hit words are at least one in so many.
SHARE = 20


def _contaminated():
    hit = F.size("_hit")
    return (hit > 0) & (hit * SHARE >= F.col("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, length: int = 13, remove: str = "documents") -> DataFrame:
    """`documents` without contaminated ones, or (`remove="spans"`) with their hit words cut out of the texts.

    A document is contaminated if a twentieth of its words or more lie in occurring windows. Extra columns stay
    as they are; an empty benchmark removes nothing. A cut takes whole runs of hit words and what stands between them.
    """
    plain, back = aside(documents, ("doc_id", "text"), ())
    marked = benchmark_hits(plain, benchmark, length)
    if remove == "documents":
        return back(marked.where(~_contaminated()))
    return back(marked.select(*plain.columns, "_hit").mapInArrow(_cut(plain.columns), plain.schema))


def _cut(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            for k, hit in enumerate(part.column("_hit").to_pylist()):
                if not hit:
                    continue
                raw, out, at, last = texts[k].encode("utf-8", "surrogatepass"), [], 0, -2
                spans = [m.span() for m in WORD.finditer(raw.lower())]
                for w in hit:
                    if w != last + 1:
                        out.append(raw[at : spans[w][0]])
                    at, last = spans[w][1], w
                texts[k] = b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns], columns)

    return run


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    marked = benchmark_hits(documents.select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id", "n_words", F.size("_hit").cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"),
    )
