"""N-gram Jaccard join: prefix lists of word shingles in blocks by size, skipped by position, with answers derived from a similar set's."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, written

#: Documents that hold a shingle which goes behind the rarer ones of its set, and how many such shingles are told apart at most (10 bytes each, on the driver and in every worker).
FREQUENT, FREQUENT_MOST = 8, 1 << 21
#: Shingles that one task counts before it passes them on, and that a bucket of the count holds at most on the average.
COUNTED, BUCKET = 1 << 20, 1 << 22
#: Nodes of a list from which each of them is compared with a leader, even if the two can't link: the others derive from that.
CROWD = 16
#: Bits of a set's parities: a bit tells whether an odd number of its shingles have that hash.
PARITY_BITS = 2048
#: Bits of the filter of documents whose texts a verification needs: eight for each id, in these bounds. A fuller filter only lets more texts through.
WANTED_LEAST, WANTED_MOST = 1 << 20, 1 << 28
#: Bytes of a text whose words are hashed at once, and bytes of a word from which it is hashed alone.
STRETCH, LONG_WORD = 8 << 20, 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GAP = re.compile(rb"[\t-\r ]")


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the words between white space, A-Z taken as a-z."""
    places, hashes, at = [], [], 0
    while at < len(raw):
        end = len(raw)
        if at + STRETCH < end and (gap := _GAP.search(raw, at + STRETCH)):
            end = gap.start()
        low = raw[at:end].lower()
        inside = np.concatenate([[False], ~_SPACE[np.frombuffer(low, np.uint8)], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        # eight bytes from every place on
        loads = np.lib.stride_tricks.as_strided(np.frombuffer(low + bytes(8), np.uint8, 8).view(np.uint64), (len(low) + 1,), (1,)) if low else np.empty(0, np.uint64)
        h = size.astype(np.uint64) * _MIX[2]
        live, k = np.flatnonzero(size < LONG_WORD), 0
        while live.size:
            x = (loads[start[live] + k] & _MASK[np.minimum(size[live] - k, 8)]) ^ h[live]
            x *= _MIX[0]
            x ^= x >> np.uint64(32)
            h[live] = x * _MIX[3]
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size >= LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(low[start[i] : start[i] + size[i]])
        h ^= h >> np.uint64(29)
        places.append(start + at)
        hashes.append(h)
        at = end
    return np.concatenate([*places, np.empty(0, np.int64)]), np.concatenate([*hashes, np.empty(0, np.uint64)])


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles: runs of `words` words, or all words of a shorter text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    place, h = word_hashes(b" ".join(raw))
    last = np.searchsorted(place, ends)
    first = np.concatenate([[0], last[:-1]])
    sums: dict[int, np.ndarray] = {}

    def shingles(n: int) -> np.ndarray:
        if n not in sums:
            total = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                x = h[k : len(h) - n + 1 + k] * _MIX[k % 8]
                x ^= x >> np.uint64(29)
                x *= _MIX[(k + 3) % 8]
                total += x
            total ^= total >> np.uint64(31)
            sums[n] = total * _MIX[1]
        return sums[n]

    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = min(words, b - a)
        out.append(np.unique(shingles(n)[a : b - n + 1]) if n else np.empty(0, np.uint64))
    return out


def _counted(words: int, bits: int):
    """Shingles of whole documents as 32-bit rests in 2 ** `bits` buckets, by the top bits of their hashes."""

    def passed(found: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(found)
        found.clear()
        keys.sort()
        keys >>= np.uint64(32 - bits)
        rest = keys.astype(np.uint32)
        bucket = np.right_shift(keys, np.uint64(32), out=keys)
        at = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
        ends = [*at[1:].tolist(), len(rest)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array([rest[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)], pa.binary())], ["bucket", "rests"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for part in slices(batches, "text"):
            for s in shingle_sets(part.column("text").to_pylist(), words):
                found.append(s)
                n += len(s)
            if n >= COUNTED:
                yield passed(found)
                n = 0
        if n:
            yield passed(found)

    return run


def _frequent(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's shingles of FREQUENT documents or more, by the logarithm of that number."""
    rests = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for b in batches for x in b.column("rests")]))
    at = np.flatnonzero(np.diff(rests, prepend=np.uint32(~rests[0])))
    many = np.diff(np.append(at, len(rests)))
    at, many = at[many >= FREQUENT], many[many >= FREQUENT]
    size = np.log2(many).astype(np.int32)
    keys = (np.uint64(key[0].as_py()) << np.uint64(32)) | rests[at].astype(np.uint64)
    kinds = np.unique(size)
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([int((size == k).sum()) for k in kinds], pa.int64()), pa.array([keys[size == k].tobytes() for k in kinds], pa.binary())], ["size", "n", "keys"])


def frequent_shingles(documents: DataFrame, words: int, most: int = FREQUENT_MOST) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of a bucket, and the sorted keys of frequent shingles with the logarithms of their numbers of documents, counted over all documents.

    If more than `most` are frequent, the least frequent go, by powers of two. They only shape the order of lists: any order gives the same links.
    """
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(6, math.ceil(math.log2(max(1, int(total) // 4 / BUCKET)))))
    counted = documents.select("text").mapInArrow(_counted(words, bits), "bucket long, rests binary")
    kinds = written(counted.groupBy("bucket").applyInArrow(_frequent, "size int, n long, keys binary"), "frequent")
    sizes, left = [], most
    for r in kinds.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("size")).collect():
        left -= r["n"]
        if left < 0:
            break
        sizes.append(r["size"])
    rows = kinds.where(F.col("size").isin(sizes)).select("size", "n", "keys").collect() if sizes else []
    keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in rows)])
    size = np.concatenate([np.empty(0, np.uint8), *(np.full(r["n"], r["size"], np.uint8) for r in rows)])
    order = np.argsort(keys)
    return bits, keys[order], size[order]


def _sets(words: int, percent: int, frequent):
    """doc_id, n, digest of the set, and its prefix: the first shingles in the global order, so many that linked sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, keys, sizes = frequent.value
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            lengths = [len(s) for s in sets]
            ends = np.cumsum([0, *lengths])
            rank = np.zeros(ends[-1], np.uint8)
            if keys.size:
                asked = np.concatenate(sets) >> np.uint64(32 - bits)
                at = np.minimum(np.searchsorted(keys, asked), keys.size - 1)
                rank = np.where(keys[at] == asked, sizes[at], np.uint8(0))
            digests, prefixes, parities = [], [], []
            for s, a, b in zip(sets, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1
                parities.append(np.packbits(odd).view(np.int64))
                mine = rank[a:b]
                if mine.any():
                    s = s[np.argsort(mine, kind="stable")]
                prefixes.append(s[:keep].view(np.int64))
            values = pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(parities, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "prefix", "bits"])

    return run


def _wanted(ids: DataFrame, size: int) -> bytes:
    """A bitmap of hashed ids, built on the executors in 4 KB buckets: `size` / 8 bytes on the driver."""
    place = F.pmod(F.xxhash64("id"), F.lit(size)) + 1  # these functions count from 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def _only_wanted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column("_place").to_numpy(zero_copy_only=False)
            held = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            if held.any():
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"]).filter(pa.array(held))

    return run


def _overlaps(words: int, apart: bool):
    """a, b and the number of shared shingles, and with `apart` those that one of two similar sets lacks; the last text's set is kept, as pairs come sorted by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.empty(0, np.uint64)
        for part in slices(batches, "text_b"):
            a, b, out, rest = part.column("a").to_pylist(), part.column("b").to_pylist(), [], []
            others = shingle_sets(part.column("text_b").to_pylist(), words)
            for i, ta, other in zip(a, part.column("text_a").to_pylist(), others, strict=True):
                if last != (i, ta):
                    last, kept = (i, ta), shingle_sets([ta], words)[0]
                both = np.concatenate([kept, other])
                both.sort(kind="stable")
                twice = both[1:] == both[:-1]
                shared = int(twice.sum())
                out.append((shared, len(kept), len(other)))
                if apart:
                    similar = 2 * shared >= max(len(kept), len(other))
                    rest.append(both[~(np.append(twice, False) | np.append(False, twice))].view(np.int64) if similar else None)
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3))]
            names = ["a", "b", "shared", "n_a", "n_b"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rest, pa.list_(pa.int64()))], [*names, "apart"]) if apart else pa.RecordBatch.from_arrays(columns, names)

    return run


def _verified(pairs: DataFrame, documents: DataFrame, words: int, apart: bool = False) -> DataFrame:
    """a, b, shared, n_a, n_b of every pair, counted on the whole sets. Only texts that some pair needs shuffle."""
    spark = documents.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    size = min(WANTED_MOST, max(WANTED_LEAST, 1 << (8 * ids.count()).bit_length()))
    shared = spark.sparkContext.broadcast(_wanted(ids, size))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    texts = documents.select("doc_id", "text", place.alias("_place")).mapInArrow(_only_wanted(shared), "doc_id long, text string").dropDuplicates(["doc_id", "text"])
    first, second = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return both.mapInArrow(_overlaps(words, apart), "a long, b long, shared long, n_a long, n_b long" + ", apart array<long>" * apart)


def _prefix(percent: int, n: Column) -> Column:
    """Length of the prefix of a set of n shingles."""
    return n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1


def _possible(percent: int, lists: Column, x: Column, y: Column) -> Column:
    """Whether sets of x and y shingles whose prefixes share `lists` shingles may link.

    What both sets hold up to the end of the prefix that ends first is among these; behind it are the other shingles of that set.
    """
    need = F.ceil((x + y) * percent / F.lit(100.0 + percent) - 1e-9)
    rest = F.greatest(x - _prefix(percent, x), y - _prefix(percent, y))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (lists + rest >= need)


def _near_enough(percent: int, p: Column, q: Column, x: Column, y: Column) -> Column:
    """Whether sets of x and y shingles with the parities p and q may link: each differing bit takes a shingle that one set lacks."""
    differing = F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    return F.coalesce(x + y - differing >= 2 * F.ceil((x + y) * percent / F.lit(100.0 + percent) - 1e-9), F.lit(True))


def _block(n: Column, percent: int) -> Column:
    """The block of a list that sets of n shingles stand in."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)) if percent < 100 else n.cast("long")


def _blocks(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries of lists (token, node, n, pos) as the smaller and as the larger set of a pair, with the block of the list that they stand in or read.

    A block holds a list's sets whose sizes lie in one step of the link's ratio. An entry stands in one block and, as the smaller set, reads its own
    and those of larger sets up to the largest that its size and its position still let it link with. All other blocks are skipped.
    """

    n = F.col("n").cast("long")
    most = F.floor((n - F.col("pos")) * (100 + percent) / F.lit(percent) + 1e-9) - n
    top = F.least(most, F.floor(n * 100 / F.lit(percent) + 1e-9))
    smaller = entries.where(top >= n).withColumn("block", F.explode(F.sequence(_block(n, percent), _block(top, percent))))
    larger = entries.where(most * 100 >= n * percent).withColumn("block", _block(n, percent))
    return smaller, larger


def _linked(percent: int, shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared * 100 >= (n_a + n_b - shared) * percent


def _alike(compared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among sets that were compared with one anchor and are similar to it, between different components.

    Answers come from the anchor's: of sets of n and m shingles that share w and v with an anchor of l, the two share w + v - l and those that both
    differ in from the anchor. So they link if they have enough differences in common, and sets link that share none only if both link with the anchor.
    `apart` lists a set's differences. They are few, are indexed rare ones first, and a prefix of them is enough to meet. A set that doesn't link with the
    anchor needs more of them with another such set (its short prefix) than with one that links (its long prefix).
    """
    n, l, w = F.col("n"), F.col("l"), F.col("w")
    each = compared.select(F.col("b").alias("node"), F.col("a").alias("anchor"), F.col("n_b").alias("n"), F.col("n_a").alias("l"), F.col("shared").alias("w"), "apart")
    held = each.select("anchor", F.explode("apart").alias("token")).groupBy("anchor", "token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    common = each.select("node", "anchor", F.explode("apart").alias("token")).join(held, ["anchor", "token"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("tokens"))
    joined = _linked(percent, w, l, n)
    # differences that a partner shares at least: one that doesn't link with the anchor, and any
    few = F.greatest(F.floor(((n - l) * percent + l * (100 + percent)) / F.lit(100.0 + percent) - w + 1e-9) + 1, F.lit(1))
    least = F.ceil((n + l) * percent / F.lit(100.0 + percent) - 1e-9) - w
    size = F.size("apart")
    sets = written(
        each.join(common, "node").join(found, "node", "left").select(
            "node", "anchor", "n", "l", "w", joined.alias("joined"), F.coalesce("component", "node").alias("component"), size.alias("size"), (size - F.size("tokens")).alias("alone"),
            F.transform("tokens", lambda t: t.token).alias("tokens"), few.alias("few"), least.alias("least"),
        ), "apart",
    )

    def prefix(frame: DataFrame, need: str) -> DataFrame:
        length = F.col("size") - F.col(need) + 1 - F.col("alone")
        kept = frame.where(length > 0).select("node", "anchor", "n", "l", "w", "component", "size", "alone", F.posexplode(F.slice("tokens", F.lit(1), F.least(length, F.size("tokens")).cast("int"))).alias("at", "token"))
        return kept.withColumn("behind", F.col("size") - F.col("alone") - F.col("at")).drop("size", "alone", "at")

    def need(x: str, y: str) -> Column:
        return F.ceil((F.col(f"{x}n") + F.col(f"{y}n")) * percent / F.lit(100.0 + percent) - 1e-9) - F.col(f"{x}w") - F.col(f"{y}w") + F.col(f"{x}l")

    loose = sets.where("not joined")
    short = prefix(loose, "few")
    meet = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (F.least("x.behind", "y.behind") >= need("x.", "y."))
    pick = [F.col("x.node").alias("x"), F.col("y.node").alias("y")]
    pairs = short.alias("x").join(short.alias("y"), meet & (F.col("x.node") < F.col("y.node"))).select(*pick).union(prefix(loose, "least").alias("x").join(prefix(sets.where("joined"), "few").alias("y"), meet).select(*pick)).distinct()
    one, two = (sets.select(*(F.col(c).alias(f"{v}{'' if c == 'node' else '_' + c}") for c in ("node", "n", "l", "w", "tokens"))) for v in "xy")
    shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return pairs.join(one, "x").join(two, "y").where(shared >= need("x_", "y_")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node that links (a, b) reach from it, for nodes with links; by alternating large and small stars.

    Each round is two joins with the least neighbour of a node, and is written; rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        seen = now


def jaccard_components(documents: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (doc_id, text; other columns are ignored).

    A document's set: its distinct shingles of `words` words (white space splits, A-Z is lower-cased); with fewer words all as
    one. Two documents link when the sets share `percent` in a hundred of their union; component_id is the smallest doc_id
    that links reach. Sets are of 64-bit hashes.

    1. Equal sets become one node, by a digest, whatever their number.
    2. Each node is listed under the first shingles of its set, rare ones first; linked nodes share a list. In every list, a node
       meets the list's leader only, and is compared with the leader that it shares most lists with: a comparison for each node.
    3. Sets that were compared with one leader derive their answers for each other from what each lacks and has besides it (see `_alike`).
    4. Lists whose nodes are all in one component, or all were compared with one leader, are done. In the others, which are cut into blocks by size,
       nodes of different components and leaders meet, but for blocks that a node's size and position let it skip. Pairs that share
       too few lists or whose parities differ in too many bits go; the rest are counted.

    Documents without words or text
    have 0 shingles and their own component. Without doc_id, a row has no component (null) and links with nothing. Rows with equal
    doc_id are rows of their own, except that representatives of one doc_id are one node.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_shingles(documents, words))
    sets = written(documents.mapInArrow(_sets(words, percent, frequent), "doc_id long, n long, digest binary, prefix array<long>, bits array<long>"), "sets")
    real = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    lists = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    leaders = lists.groupBy("token").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").select("token", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), (F.col("many") >= CROWD).alias("crowded"))
    shared = written(lists.join(leaders, "token"), "lists")

    # in a crowded list, sets of one size also have a leader of that size
    crowd = shared.where("crowded").withColumn("block", _block(F.col("n"), percent))
    heads = crowd.groupBy("token", "block").agg(F.min(F.struct("node", "n")).alias("first")).select("token", "block", F.col("first.node").alias("head"), F.col("first.n").alias("head_n"))
    seen = shared.select("node", "n", "leader", "leader_n", "crowded").union(crowd.join(heads, ["token", "block"]).where("head <> leader").select("node", "n", "head", "head_n", "crowded"))
    possible = _possible(percent, F.col("lists"), F.col("n"), F.col("leader_n"))
    alike_size = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    met = seen.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("lists"), F.first("n").alias("n"), F.first("leader_n").alias("leader_n"), F.max("crowded").alias("crowded")).where(possible | (F.col("crowded") & alike_size)).withColumn("possible", possible)
    best = met.groupBy("node").agg(F.max(F.struct("possible", "lists", (-F.col("leader")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("a"), F.col("node").alias("b"))
    first = written(_verified(best, documents, words, apart=True), "overlaps")
    links = first.where(_linked(percent, F.col("shared"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    found = components(links)

    # a node of several sets, which repeated ids make, has several rows and no anchor
    compared = first.groupBy("b").agg(F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("a", "shared", "n_a", "n_b", "apart"))).where("rows = 1 and apart is not null")
    compared = written(compared, "compared")
    alike = written(_alike(compared, found, percent), "alike")
    groups = compared.select(F.col("b").alias("node"), F.col("a").alias("group"))
    # written where a plan would hold it several times
    states = shared.select("node").distinct().join(groups, "node", "left").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("group", "node").alias("group"))
    states = written(states, "states")
    # lists that are not done, each with the anchor that most of its nodes have
    parts = shared.join(states, "node").groupBy("token", "group").agg(F.count(F.lit(1)).alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_tokens = parts.groupBy("token").agg(F.max(F.struct("many", "group")).alias("most"), F.count(F.lit(1)).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high")).where("parts > 1 and low < high").select("token", F.col("most.group").alias("main"))
    # in lists that are not done, block by block
    rest = written(shared.drop("leader", "leader_n", "crowded").join(open_tokens, "token").join(states, "node").withColumn("main", F.col("group") == F.col("main")), "rest")
    small, large = F.col("x.n"), F.col("y.n")
    need = F.ceil((small + large) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
    # the first shingle that linked sets share has so many others behind it in both
    skip = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.group") != F.col("y.group"))
        & ((small < large) | ((small == large) & (F.col("x.node") < F.col("y.node"))))
        & (large * percent <= small * 100)
        & (small - F.col("x.pos") >= need)
        & (large - F.col("y.pos") >= need)
    )
    columns = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("node", "n")]
    # a node of several sets has no parities and passes
    parities = nodes.groupBy("node").agg(F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits"))
    mine = written(shared.groupBy("node").agg(F.collect_list("token").alias("tokens")).join(parities, "node"), "mine").hint("merge")
    x, y = _blocks(rest, percent)
    # nodes of a list's main group never meet each other, however many there are
    meetings = x.where("not main").alias("x").join(y.alias("y"), skip).select(*columns).union(x.where("main").alias("x").join(y.where("not main").alias("y"), skip).select(*columns))
    pairs = (
        meetings.distinct()
        .join(mine.toDF("node_x", "tokens_x", "bits_x"), "node_x").join(mine.toDF("node_y", "tokens_y", "bits_y"), "node_y")
        .where(_possible(percent, F.size(F.array_intersect("tokens_x", "tokens_y")), F.col("n_x"), F.col("n_y")))
        .where(_near_enough(percent, F.col("bits_x"), F.col("bits_y"), F.col("n_x"), F.col("n_y")))
    )
    asked = written(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")), "pairs")
    more = alike.union(_verified(asked, documents, words).where(_linked(percent, F.col("shared"), F.col("n_a"), F.col("n_b"))).select("a", "b"))
    all_links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = components(all_links)

    by_set = nodes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(by_set, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`documents` with the smallest doc_id of each component; rows without doc_id, words or links stay."""
    found = jaccard_components(documents, words, percent).select(F.col("doc_id").alias("_doc"), "component_id").dropDuplicates(["_doc"])
    return documents.join(found.where(F.col("_doc") != F.col("component_id")).select("_doc"), F.col("doc_id").cast("long") == F.col("_doc"), "left_anti")
