"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import range_width, ranked, slices, written

#: The pattern that byte-level BPE splits text by before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A run of white space so long that the backtracking of `tiktoken` would overflow its stack at some hundred thousands.
LONG_GAP = re.compile(r"(?<!\s)\s{20000}")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, for a byte-level BPE file of the `tokenizers` library.

    `tiktoken` runs the same merges from the file's vocabulary, whose ids are the merges' ranks, in a quarter of the time; a
    text that holds an added token or a LONG_GAP goes to `tokenizers` itself. Tests hold the ids of one against the other.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as the characters of the same number
        others = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added) or (len(text) >= 20_000 and LONG_GAP.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@lru_cache(1)
def token_encoder(path: str) -> Encoder:
    """The encoder of a file, made once in a worker."""
    return Encoder(path)


def _pieces(path: str, end: int, capacity: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path)
        for part in slices(batches, "text"):
            out = []
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = zip(*out, strict=True)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised_pieces(documents: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document: its ids, then `end`. Only longer ones are cut, and the first piece takes the rest."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, end, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many, lengths) of the bins that pack `counts` pieces of each length.

    A bin takes the longest piece left and then, again and again, the longest that fits. While a gap is left, its
    smallest piece is put back for two unpacked ones that fill the widened gap more tightly. As only lengths
    matter, a filling is repeated as often as its pieces last: the work depends on `capacity`, not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while (present := np.flatnonzero(left)).size:
        take = left.copy()
        lengths, gap = [], capacity
        while gap and (i := np.searchsorted(present, gap, "right")):
            fits = present[:i]
            fits = fits[take[fits] > 0]
            if not fits.size:
                break
            best = int(fits[-1])
            lengths.append(best)
            take[best] -= 1
            gap -= best
        while gap and len(lengths) > 1:
            smallest = min(lengths)
            room, options = gap + smallest, present[take[present] > 0]
            a = options[(options < room)]
            if not a.size:
                break
            at = np.searchsorted(options, room - a, "right") - 1
            ok = at >= 0
            a, b = a[ok], options[at[ok]]
            same = (a == b) & (take[a] < 2)
            total = np.where(same, 0, a + b)
            if not total.size or total.max() <= smallest:
                break
            k = int(total.argmax())
            lengths.remove(smallest)
            take[smallest] += 1
            for x in (int(a[k]), int(b[k])):
                lengths.append(x)
                take[x] -= 1
            gap = capacity - sum(lengths)
        used, many = np.unique(lengths, return_counts=True)
        times = int((left[used] // many).min())
        left[used] -= times * many
        bins.append((times, sorted(lengths, reverse=True)))
    return bins


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length, ids_crc32, any others).

    The driver gets one count for each length, at most `capacity` of them, and sends back the places of each
    length's pieces by rank: each filling uses up a length, so they are at most `capacity` fillings of `capacity` pieces, whatever
    the input. Ranks come from ranges of doc_id, so no window holds all pieces of a length.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, used, base = [], dict.fromkeys(counts, 0), 0
    for times, lengths in best_two_fit(counts, capacity):
        offset = 0
        for length in lengths:
            rows.append((length, used[length], used[length] + times, base, offset))
            used[length] += times
            offset += length
        base += times
    places = spark.createDataFrame(rows, "length long, _from long, _to long, _base long, offset long")
    numbered = ranked(pieces, ["length"], "doc_id", [F.col("piece"), F.col("ids_crc32")], range_width(pieces, "doc_id"), "_rank")
    return (
        numbered.join(F.broadcast(places), (numbered["length"] == places["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("sequence_id", F.col("_base") + F.col("_rank") - F.col("_from"))
        .select(*(pieces[c] for c in pieces.columns), "sequence_id", "offset")
    )


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens by best-two-fit.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null or empty text is the end token
    alone. Repeated rows, and rows without an id, are packed each for itself; other columns are ignored. Pieces are written
    to the shared folder (no text, some 30 bytes a piece), so texts are tokenised once.
    """
    return pack_pieces(written(tokenised_pieces(documents, tokenizer, capacity, end), "pieces"), capacity)
