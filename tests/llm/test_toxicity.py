"""The toxicity search against plain distances on long tokens, and what training keeps."""

import random
import time

import pytest

from graphloom.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_nearly(terms, word):
    best = 0.0
    for term, stem, weight in terms:
        if len(term) < 5 or len(word) < 4:
            continue
        if stem:
            found = [distance(term, word[:n]) for n in range(len(term) - 1, len(term) + 2) if n <= len(word)]
            if len(word) > len(term) and found and min(found) == 1:
                best = max(best, weight * toxicity.EDIT)
        elif 0 < (d := distance(term, word)) <= (2 if len(term) >= 8 else 1):
            best = max(best, weight * toxicity.EDIT**d)
    return best


def test_words_of_any_length():
    rng = random.Random(3)
    letters = "abcde"
    terms = [("".join(rng.choice(letters) for _ in range(rng.randrange(5, 13))), rng.random() < 0.3, rng.choice([3.0, 4.5, 6.0])) for _ in range(60)]
    terms = [(t, s, w) for t, s, w in terms if not s or len(t) <= 6]
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        term = rng.choice(terms)[0]
        word = list(term) + [rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 2, 5, 30]))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word))
            word[at : at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(3)
        word = "".join(word)
        assert trie.nearly(word) == plain_nearly(terms, word), word


def test_a_million_letters():
    rng = random.Random(1)
    terms = [("".join(rng.choice("abcdefghij") for _ in range(9)), False, 5.0) for _ in range(2000)]
    scorer = toxicity.Scorer(terms)
    began = time.time()
    assert scorer.of(terms[0][0] + "".join(rng.choice("abcdefghij") for _ in range(1_000_000))) == (0.0, 0.0)
    assert time.time() - began < 2 and not scorer.known
    assert scorer.of("x" * 100 + " " + terms[0][0])[0] > 0


def test_copies_count_once_and_only_copies_go(spark):
    base = [f"word{k}" for k in range(60)]
    rows = [(1, 1, " ".join(base)), (2, 1, " ".join(base) + " "), (3, 1, " ".join([*base[:-1], "other"])), (4, 0, " ".join(base)), (5, 1, "a b"), (6, 1, "a c"), (7, 1, "a d"), (8, 1, ""), (9, 1, "?!")]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "doc_id long, label int, text string")).collect()
    texts = sorted((r["label"], r["text"]) for r in kept)
    assert (0, " ".join(base)) in texts and texts.count((1, " ".join(base))) == 1 and (1, " ".join(base) + " ") not in texts
    assert {(1, "a b"), (1, "a c"), (1, "a d")} <= set(texts) and len([t for t in texts if t[1] in ("", "?!")]) == 1


@pytest.mark.parametrize("toxic", [0, 3])
def test_few_toxic_rows(spark, toxic):
    rng = random.Random(2)
    words = [f"plain{k}" for k in range(300)]
    text = lambda *more: " ".join([*rng.sample(words, 40), *more])
    rows = [(k, 0, text()) for k in range(200)] + [(200 + k, 1, text("grumbleworth", "grumbleworth")) for k in range(toxic)]
    terms, weights = toxicity.train_toxicity(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    assert bool(terms) == bool(toxic) and all(t[0].startswith("grum") for t in terms)
    documents = spark.createDataFrame([(1, text()), (2, text("grumbleworth")), (3, text("grumblewrth")), (4, None)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents, terms, weights).collect()}
    assert (len(set(scores.values())) == 1) if not toxic else (scores[2] > scores[1] and scores[3] > scores[1] and scores[4] == scores[1])
