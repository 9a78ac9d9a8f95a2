"""Periodic runs of words, found on the grammar that Re-Pair gives for a text."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import aside, slices, with_fields

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
#: Words of the shortest window that a run repeats at the distance of its period.
GRAM = 8
#: Texts of up to so many words keep the hashes of all their windows; up to so many candidates at a boundary are compared word by word.
KEPT_WORDS, FEW = 1 << 17, 16
#: Odd 64-bit numbers of the window hashes; what they tell is checked on the words.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def word_ids(text: str | None, known: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    """The words between ASCII white space, and a number for each."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return words, np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def repeated_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of LEAST words or more, each in a window of GRAM words that the text holds twice.

    A run of length at least LEAST and TIMES periods has at least 2 * GRAM words that repeat at the distance of its period, so that each of its words
    lies in such a window: no run leaves a stretch. Equal hashes only lengthen stretches.
    """
    n = len(ids)
    if n < LEAST:
        return []
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(BASE) + (h[step:] ^ (h[step:] >> np.uint64(31)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    steps = np.zeros(n + 1, np.int64)
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + GRAM, -1)
    inside = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= LEAST]


def re_pair(ids: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules and the sequence that is left: the most frequent pair of neighbours becomes a new symbol until no pair occurs twice.

    Symbols below the count of distinct words are words (numbers from 0); rule k makes symbol words + k. Of pairs equally frequent, the smaller goes first.
    Neighbours are linked, each pair knows the places it may stand at, and a heap holds counts, some of them out of date.
    """
    n, fresh = len(ids), max(ids, default=-1) + 1
    symbol, left, right = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        places[symbol[i], symbol[i + 1]].add(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        told, pair = heappop(heap)
        at = places.get(pair, ())
        if -told != len(at):
            if len(at) > 1:
                heappush(heap, (-len(at), pair))
            continue
        a, b = pair
        if a == b:  # of overlapping occurrences every second one counts
            kept, last = [], -2
            for i in sorted(at):
                if i != last:
                    kept.append(i)
                    last = right[i]
        else:
            kept = sorted(at)
        del places[pair]
        if len(kept) < 2:
            continue
        touched = set()
        for i in kept:
            j = right[i]
            before, after = left[i], right[j]
            if before >= 0:
                places[symbol[before], a].discard(before)
                places[symbol[before], fresh].add(before)
                touched.add((symbol[before], fresh))
            if after >= 0:
                places[b, symbol[after]].discard(j)
                places[fresh, symbol[after]].add(i)
                touched.add((fresh, symbol[after]))
                left[after] = i
            symbol[i], symbol[j], right[i] = fresh, -1, after
        rules.append(pair)
        fresh += 1
        for p in touched:
            if len(places[p]) > 1:
                heappush(heap, (-len(places[p]), p))
    return rules, [s for s in symbol if s >= 0]


def derivation(words: int, rules: list[tuple[int, int]], sequence: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left length, length, places) of every nonterminal that spells LEAST words or more; places are where its expansion stands in the text.

    Neighbours of the sequence join two by two under further nonterminals, until one spells the whole text.
    """
    rules, sizes = list(rules), [1] * words
    for a, b in rules:
        sizes.append(sizes[a] + sizes[b])
    while len(sequence) > 1:
        joined = []
        for k in range(0, len(sequence) - 1, 2):
            rules.append((sequence[k], sequence[k + 1]))
            sizes.append(sizes[sequence[k]] + sizes[sequence[k + 1]])
            joined.append(len(sizes) - 1)
        sequence = joined + sequence[len(sequence) & ~1 :]
    if not sequence or sequence[0] < words:
        return
    places: dict[int, list[np.ndarray]] = {sequence[0]: [np.zeros(1, np.int64)]}
    for k in range(len(rules) - 1, -1, -1):
        found = places.pop(words + k, None)
        if found is None or sizes[words + k] < LEAST:
            continue
        at, (a, b) = np.concatenate(found), rules[k]
        yield sizes[a], sizes[words + k], at
        places.setdefault(a, []).append(at)
        places.setdefault(b, []).append(at + sizes[a])


class Windows:
    """Hashes of all windows of a text, and how far two places agree."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD)
            mixed ^= mixed >> np.uint64(32)
            self.powers = np.full(n + 1, BASE, np.uint64)
            self.powers[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            # sums of mixed[i] * BASE ** (n - 1 - i): a window's difference times BASE ** its start is its hash
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.powers[:n][::-1])])

        self.kept: dict[int, np.ndarray] = {}

    def hashes(self, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.powers[starts]

    def between(self, low: int, high: int, size: int) -> np.ndarray:
        """Hashes of the windows of `size` words that start at low .. high - 1; those of shorter texts are worked out once."""
        if len(self.ids) > KEPT_WORDS:
            return (self.sums[low + size : high + size] - self.sums[low:high]) * self.powers[low:high]
        if size not in self.kept:
            self.kept[size] = (self.sums[size:] - self.sums[: len(self.ids) - size + 1]) * self.powers[: len(self.ids) - size + 1]
        return self.kept[size][low:high]

    def ahead(self, a: int, b: int, most: int) -> int:
        """How many words agree from places a and b on, of `most`."""
        done, step = 0, 64
        while done < most:
            n = min(step, most - done)
            apart = self.ids[a + done : a + done + n] != self.ids[b + done : b + done + n]
            if (k := int(apart.argmax())) or apart[0]:
                return done + k
            done, step = done + n, 4 * step
        return most

    def behind(self, a: int, b: int, most: int) -> int:
        """How many words agree before places a and b, of `most`."""
        done, step = 0, 64
        while done < most:
            n = min(step, most - done)
            apart = (self.ids[a - done - n : a - done] != self.ids[b - done - n : b - done])[::-1]
            if (k := int(apart.argmax())) or apart[0]:
                return done + k
            done, step = done + n, 4 * step
        return most

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, at most `most`, agree from places a and b on (or, `back`, before them)."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            half = np.where(open_, (low + high + 1) // 2, low)
            same = self.hashes(a - half, half) == self.hashes(b - half, half) if back else self.hashes(a, half) == self.hashes(b, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def boundary_runs(text: Windows, lo: int, middle: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches in [lo, hi) that cross `middle` with at least LEAST words and TIMES periods, as far as they go in there.

    A run of period q reaches q words or more to one side of the boundary. With what agrees before and after the boundary at distance q, that is
    at least 2 * q words together, so one of both is a window of q words, at least GRAM: equal windows give the candidates.
    """
    found: list[tuple[int, int, int]] = []
    most, candidates, g = (hi - lo) // TIMES, ([], []), GRAM
    while (low := 1 if g == GRAM else g) <= most:
        high = min(2 * g, most + 1)
        for start in (middle, middle - g):
            if lo <= start and start + g <= hi:
                own = text.between(start, start + 1, g)[0]
                if (last := min(high, hi - g - start + 1)) > low:
                    candidates[0].append(low + np.flatnonzero(text.between(start + low, start + last, g) == own))
                if (last := min(high, start - lo + 1)) > low:
                    candidates[1].append(low + np.flatnonzero(text.between(start - last + 1, start - low + 1, g)[::-1] == own))
        g *= 2
    for sign, parts in zip((1, -1), candidates, strict=True):
        at = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        at = at[(middle + sign * at >= lo) & (middle + sign * at <= hi)]
        if 0 < len(at) <= FEW:
            for q in at.tolist():
                a, b = min(middle, middle + sign * q), max(middle, middle + sign * q)
                s, e = a - text.behind(a, b, a - lo), b + text.ahead(a, b, hi - b)
                if s < middle < e and e - s >= max(LEAST, TIMES * q):
                    found.append((s, e, q))
        elif len(at):
            here, there = np.full(len(at), middle), middle + sign * at
            after = text.agree(here, there, hi - np.maximum(here, there), False)
            before = text.agree(here, there, np.minimum(here, there) - lo, True)
            start, end = np.minimum(here, there) - before, np.maximum(here, there) + after
            long = (start < middle) & (end > middle) & (end - start >= np.maximum(LEAST, TIMES * at))
            found += zip(start[long].tolist(), end[long].tolist(), at[long].tolist(), strict=True)
    least: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        least[s, e] = min(q, least.get((s, e), q))
    return [(s, e, q) for (s, e), q in least.items()]


def merged(found: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Stretches of one period that overlap by it or more as one; of periods of the same stretch, the smallest."""
    if not found:
        return []
    rows = np.unique(np.concatenate(found), axis=0)
    best: dict[tuple[int, int], int] = {}
    a = b = period = -1
    for q, s, e in [*rows[:, [2, 0, 1]][np.lexsort((rows[:, 0], rows[:, 2]))].tolist(), (-1, -1, -1)]:
        if q == period and s <= b - q:
            b = max(b, e)
            continue
        if period > 0:
            best[a, b] = min(period, best.get((a, b), period))
        a, b, period = s, e, q
    return sorted((s, e, q) for (s, e), q in best.items())


def grammar_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the numbers `ids`, in order of start and period.

    The text's repeated stretches are compressed by Re-Pair. A run in a text lies across the boundary of the smallest nonterminal that spells it,
    as far as it goes, so the stretches across each nonterminal's boundary, found once on one of its occurrences, give all runs where that
    nonterminal stands; pieces of them, found on smaller nonterminals, merge into them.
    """
    out = []
    for a, b in repeated_stretches(ids):
        _, own = np.unique(ids[a:b], return_inverse=True)
        rules, sequence = re_pair(own.tolist())
        text, found = Windows(own), []
        for left, size, places in derivation(int(own.max()) + 1, rules, sequence):
            lo = int(places[0])
            for s, e, q in boundary_runs(text, lo, lo + left, lo + size):
                if not (np.array_equal(own[s : e - q], own[s + q : e])):
                    raise ArithmeticError("equal hashes of unequal windows")
                moved = places - lo
                found.append(np.stack([s + moved, e + moved, np.full(len(moved), q)], 1))
        out += [(s + a, e + a, q) for s, e, q in merged(found)]
    return out


def _described(columns: list[str]):
    fields = (("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            known: dict[bytes, int] = defaultdict(count().__next__)
            rows = []
            for text in part.column("text").to_pylist():
                words, ids = word_ids(text, known)
                runs = sorted((s, q, e - s) for s, e, q in grammar_runs(ids))
                if runs:
                    s, q, n = runs[0]
                    for t, p, m in runs[1:]:
                        if m * q > n * p:  # a greater length / period; of equal ones the first stays
                            s, q, n = t, p, m
                    kept = np.ones(len(words) + 1, np.int64)
                    marks = np.zeros(len(words) + 1, np.int64)
                    for t, p, m in runs:
                        marks[t + p] += 1
                        marks[t + m] -= 1
                    kept = np.cumsum(marks)[:-1] == 0
                    words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
                    best = (s, n, q, 1000 * n // q)
                else:
                    best = (None,) * 4
                rows.append((len(runs), *best, [{"start": s, "length": n, "period": q} for s, q, n in runs], b" ".join(words).decode("utf-8", "surrogatepass")))
            columns_ = [part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns_, *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True))], [*columns, *(n for n, _ in fields)])

    return run


ADDED = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(documents: DataFrame) -> DataFrame:
    """`documents` (text, any others) with the periodic runs of each whole text's words.

    A run is a stretch of words with smallest period q and at least LEAST words and TIMES * q, that no neighbour extends. n_runs counts them,
    runs lists them by start and period, collapsed is the text's words that no run holds after its first q, joined by one space. start, length, period and
    exponent_milli (1000 * length / period, rounded down) tell of the run with the greatest length / period; of equal ones the first, then the one with the smallest period; they are null without a run.

    A text is worked on by itself, in slices of some MB of texts, so rows neither shuffle nor meet: copies and hot sources cost what their rows cost. Of a text, only the
    stretches that may hold runs are compressed. Null and empty texts have no runs and collapse to an empty text; repeated rows are described each for itself, and other
    columns stay, but that an old column of an added name is replaced.
    """
    documents, back = aside(documents, ("text",), tuple(f.strip().split()[0] for f in ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")))
    return back(documents.mapInArrow(_described(documents.columns), with_fields(documents, ADDED)))


def collapse_runs(documents: DataFrame) -> DataFrame:
    """`documents` with each text's runs cut to their first period; texts without a run stay byte for byte."""
    old = F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(documents.columns)))
    done = periodic_runs(documents.select(old.alias("_old"), "text"))
    kept = F.when(F.col("n_runs") > 0, F.col("collapsed")).otherwise(F.col("text"))
    return done.select(*((kept if c == "text" else F.col(f"_old._{i}")).alias(c) for i, c in enumerate(documents.columns)))


def run_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 (every run's `start,length,period` and a line feed) and collapsed_sha256 of every document."""
    found = periodic_runs(documents.select("doc_id", "text"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
