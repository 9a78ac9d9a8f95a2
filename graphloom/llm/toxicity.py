"""Toxicity scores: Levenshtein automata over a learned lexicon trie, with context windows for quotation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import aside, remainder, slices, with_fields, written
from graphloom.llm.quality import labelled_texts

#: Labelled rows that lexicon and weights are learned from at most, the first by a hash of doc_id.
TRAINING_ROWS = 16_000
#: A term is in at least so many of the toxic texts (all, if they are fewer) and in such a share of them, and its log odds ratio is at least so high.
LEAST_TEXTS, LEAST_SHARE, LEAST_WEIGHT = 4, 0.01, 3.5
#: Training texts of one label with such a share of words in common, or more, count once.
COPIES = 0.8
#: Longer tokens are looked up each time they come.
REMEMBERED_SIZE = 64
#: Lengths of the word beginnings that count as terms besides whole words.
STEMS = (4, 5, 6)
REMEMBERED = 300_000
#: Tokens on either side of a hit that tell quotation from abuse, and what a quoted hit counts.
WINDOW, QUOTED = 8, 0.3
#: Weight of one more edit.
EDIT = 0.5

TOKEN = re.compile(r"[\w@$*]+|[\"“”„«»‹›]")
MARKS = frozenset("\"“”„«»‹›")
#: Words that report speech or mention a word.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term sagte schrieb nannte wort zitat dit écrit appelé mot terme dijo escribió llamó palabra término".split())
#: Characters that stand for letters.
STANDS_FOR = str.maketrans("013457@$", "oieastas")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def plain(token: str) -> str:
    return token.strip("@$*_")


class Trie:
    """Terms and stems; finds the nearest within an edit budget by running a Levenshtein automaton down the trie."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.root: dict = {}
        self.exact: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        self.parts: dict[tuple[int, int], dict[str, list[tuple[int, int]]]] = {}
        self.tails: dict[str, list[tuple[int, int]]] = {}
        for term, stem, weight in terms:
            (self.stems if stem else self.exact)[term] = weight
            if len(term) < 5:
                continue
            edits = 1 if stem or len(term) < 8 else 2
            # at each node: the most edits, and the least and greatest word length, of what lies below
            low, high = (len(term) + 1, 1 << 30) if stem else (len(term) - edits, len(term) + edits)
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
                was = node.get(2, (0, low, high))
                node[2] = (max(was[0], edits), min(was[1], low), max(was[2], high))
            node[1 if stem else 0] = (weight, len(term))
            cuts = [len(term) * k // (edits + 1) for k in range(edits + 2)]
            for a, b in pairwise(cuts):
                if b == len(term) and not stem:
                    self.tails.setdefault(term[a:], []).append((low, high))
                    continue
                for start in range(a - edits, a + edits + 1) if a else (0,):
                    self.parts.setdefault((start, b - a), {}).setdefault(term[a:b], []).append((low, high))
        for ranges in (self.tails, *self.parts.values()):
            for part, found in ranges.items():
                ranges[part] = sorted(set(found))
        self.longest = max((len(t) for t, _, _ in terms), default=0)
        self.sizes = sorted({len(x) for x in self.tails})
        self.heads = [(a, a + n, parts) for (a, n), parts in sorted(self.parts.items())]
        self.lengths = sorted({len(x) for x in self.stems})

    def exactly(self, word: str) -> float:
        """The largest weight of the word as a term or of a stem that it begins with; 0 if none."""
        best, size = self.exact.get(word, 0.0), len(word)
        for n in self.lengths:
            if size > n and (found := self.stems.get(word[:n])) and found > best:
                best = found
        return best

    def _may_be_near(self, word: str) -> bool:
        """Whether a part of a term stands in the word at its place, and the word's length allows the term."""
        size = len(word)
        for a, b, parts in self.heads:
            if found := parts.get(word[a:b]):
                for low, high in found:
                    if low <= size <= high:
                        return True
        for n in self.sizes:
            if found := self.tails.get(word[-n:]):
                for low, high in found:
                    if low <= size <= high:
                        return True
        return False

    def nearly(self, word: str) -> float:
        """The largest weight of a term of 5 characters or more one edit away (two from 8 characters), less by EDIT for each; 0 if none.

        A term is cut into one part more than it may take edits, so that one part is left whole, moved by as many places as
        there are edits at most: at the start for the first part, at the end of the word for the last (a stem's stands inside).
        Words without any such part of a term that their length allows are passed over at once, and the walk leaves out what is too far off or of other lengths. A word longer than all terms by three is cut there: no whole term is within two edits
        of it, and a stem is looked for at its beginning. A row of distances holds the five cells around the diagonal.
        """
        whole = len(word)
        if whole < 4 or not self._may_be_near(word):
            return 0.0
        word = word[: self.longest + 3]
        best, size = 0.0, len(word)
        far = [3] * (size + 2)
        stack = [(self.root, 0, [*range(min(3, size + 1)), *far][: size + 1])]
        while stack:
            node, depth, row = stack.pop()
            for c, child in node.items():
                if c == 0:
                    weight, length = child
                    if 0 < row[size] <= (2 if length >= 8 else 1):
                        best = max(best, weight * EDIT ** row[size])
                elif c == 2:
                    continue
                elif c == 1:
                    weight, length = child
                    if size > length and min(row[length - 1 : length + 2]) == 1:
                        best = max(best, weight * EDIT)
                else:
                    edits, low, high = child[2]
                    if not low <= whole <= high:
                        continue
                    at = depth + 1
                    new = far[: size + 1]
                    if at <= edits:
                        new[0] = at
                    near = new[0]
                    for k in range(max(1, at - edits), min(size, at + edits) + 1):
                        x = row[k - 1] + (word[k - 1] != c)
                        if x > (y := new[k - 1] + 1):
                            x = y
                        if x > (y := row[k] + 1):
                            x = y
                        if x < 3:
                            new[k] = x
                            if x < near:
                                near = x
                    if near <= edits:
                        stack.append((child, at, new))
        return best


class Scorer:
    """Evidence of a text: log sums of the weights of exact and of misspelled hits."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.trie = Trie(terms)
        self.known: dict[str, tuple[float, bool] | None] = {}

    def _new(self, token: str) -> tuple[float, bool] | None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        word = plain(token)
        spelled = word.translate(STANDS_FOR)
        out = None
        if exact := self.trie.exactly(word):
            out = (exact, True)
        elif near := max(self.trie.exactly(spelled) if spelled != word else 0.0, self.trie.nearly(spelled)):
            out = (near, False)
        if len(token) <= REMEMBERED_SIZE:
            self.known[token] = out
        return out

    def of(self, text: str | None) -> tuple[float, float]:
        known, new = self.known, self._new
        tokens = tokens_of(text)
        hits = [(i, h) for i, t in enumerate(tokens) if (h := known[t] if t in known else new(t))]
        exact = near = 0.0
        for i, (weight, sure) in hits:
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            quoted = not MARKS.isdisjoint(before) and not MARKS.isdisjoint(after) or not REPORTING.isdisjoint(before[-4:])
            weight *= QUOTED if quoted else 1.0
            if sure:
                exact += weight
            else:
                near += weight
        return math.log1p(exact), math.log1p(near)


#: Odd numbers that make four orders of word hashes.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hashes of a text's words and a digest of four of their min-hashes, that near copies mostly share."""
    for part in slices(batches, "text"):
        words = [np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in set(tokens_of(t))], np.uint64)) for t in part.column("text").to_pylist()]
        signs = [xxhash.xxh3_64_intdigest((w[:, None] * ORDERS).min(0).tobytes()) >> 1 if w.size else 0 for w in words]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label")), pa.array([w.astype(np.int64) for w in words], pa.list_(pa.int64())), pa.array(signs, pa.int64())], ["doc_id", "label", "words", "sig"])


def without_copies(labelled: DataFrame) -> DataFrame:
    """Rows (doc_id, label, text) less near copies: of rows of one label and signature, those go whose words agree with the first one's in a share of COPIES of both together.

    Unlike texts with one signature stay, so that only copies are lost. `labelled` is a bounded sample: no text shuffles, and the ids that stay are broadcast.
    """
    rows = labelled.mapInArrow(_signature, "doc_id long, label int, words array<long>, sig long")
    first = rows.groupBy("sig", "label").agg(F.min("doc_id").alias("_first"), F.min_by("words", "doc_id").alias("_words"))
    common, both = F.size(F.array_intersect("words", "_words")), F.size(F.array_union("words", "_words"))
    kept = rows.join(first, ["sig", "label"]).where((F.col("doc_id") == F.col("_first")) | (common < COPIES * both)).select("doc_id", "label").distinct()
    return labelled.join(F.broadcast(kept), ["doc_id", "label"], "left_semi").select("doc_id", "label", "text")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold each word and each stem, by slice."""
    for part in slices(batches, "text"):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
            words = {w for t in set(tokens_of(text)) if len(w := plain(t)) > 2}
            counts[y].update(words | {"^" + w[:n] for w in words for n in STEMS if len(w) > n})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][w] for w in names], pa.int64()) for y in (0, 1))], ["term", "clean", "toxic"])


def train_toxicity(labelled: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[tuple[str, bool, float]], list[float]]:
    """(term, is a stem, weight) of the lexicon, and bias and weights of the evidence, from doc_id, text and label.

    At most `rows` rows are used, the first by a hash of doc_id, less near copies. A term is a word or a beginning of words that toxic texts hold more often than
    clean ones by LEAST_WEIGHT, and that LEAST_TEXTS and LEAST_SHARE of the toxic texts hold. There is no cap on terms: the share alone bounds them, by a hundred times the words of a toxic text. Without any
    toxic row the lexicon is empty and all texts score the share of toxic rows, smoothed.
    """
    labelled = labelled.where(F.col("label").isin(0, 1))
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    chosen = written(labelled.join(F.broadcast(ids), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text"), "toxicity-sample")
    single = written(without_copies(chosen), "toxicity-training").select("label", "text")
    totals = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean_n, toxic_n = totals.get(0, 0), totals.get(1, 0)
    weight = F.log((F.col("toxic") + 0.5) / (toxic_n + 1.0)) - F.log((F.col("clean") + 0.5) / (clean_n + 1.0))
    counted = single.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = max(1, min(LEAST_TEXTS, toxic_n), LEAST_SHARE * toxic_n)
    best = counted.withColumn("weight", weight).where((F.col("toxic") >= least) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc("weight"), "term")
    terms = [(r["term"].lstrip("^"), r["term"].startswith("^"), float(r["weight"])) for r in best.collect()]
    evidence = np.array([(r["exact"], r["near"], r["label"]) for r in _evidence(single, terms).select("exact", "near", "label").collect()], float).reshape(-1, 3)
    return terms, logistic(evidence[:, :2], evidence[:, 2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Bias and weights by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w.tolist()


def _evidence(documents: DataFrame, terms: list[tuple[str, bool, float]]) -> DataFrame:
    keep = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            found = [scorer.of(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], [*keep, "exact", "near"])

    return documents.mapInArrow(run, with_fields(documents, "exact double, near double"))


def score_toxicity(documents: DataFrame, terms: list[tuple[str, bool, float]], weights: list[float]) -> DataFrame:
    """`documents` with score, from 0 to 1: higher if toxic is likelier. A null text counts as empty. The lexicon, words of the sampled toxic texts, is broadcast."""
    z = F.lit(weights[0]) + F.lit(weights[1]) * F.col("exact") + F.lit(weights[2]) * F.col("near")
    documents, back = aside(documents, ("text",), ("score",))
    return back(_evidence(documents, terms).withColumn("score", 1 / (1 + F.exp(-z))))


#: Of labelled rows, those whose crc32(doc_id) modulo the first value is the second are held out of training.
HELD_OUT = (5, 0)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of one half) of every document."""
    terms, weights = train_toxicity(labelled_texts(documents, labels, "toxic", HELD_OUT))
    return score_toxicity(documents.select("doc_id", "text"), terms, weights).select(
        "doc_id", F.coalesce(remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
