"""Vector codes, periodic runs and token records against plain versions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import codes, periods, records
from graphloom.llm.queries import tokenizer_path, with_planted_runs
from tests.llm.test_operators import got, ordered



def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max((len(v) for _, _, v in kept), default=0)
    width = -(-longest // parts)
    kept = [(i, label, v + [0] * (width * parts - len(v))) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, v)[1] for p in range(parts)] for _, _, v in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, _, v), at in zip(kept, found, strict=True) if at[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, label, v in kept:
        at = [nearest(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sum(r[3] for r in out if r[1] == label), digest) for i, label, c, e in out]


def vectors_of(n, width, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(4)) if rng.random() < 0.8 else None, (rng.integers(-8, 9, width) / 16).tolist()) for i in rng.permutation(n)]
    return rows + [(n, 1, None), (n + 1, 1, [float("nan")] * width), (n + 2, 2, [None] + [0.5] * (width - 1)), (n + 3, 0, [float("inf")] * width), (None, 1, [0.25] * width), (5, 2, [0.25] * width), (n + 4, 3, [0.5] * (width - 3)), (n + 5, None, [])]


@pytest.mark.parametrize("width", [32, 40, 16])
def test_codes(spark, width, monkeypatch):
    rows = vectors_of(150, width)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as code", "1 as _ints", "2 as _label").repartition(3)
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    expected = ordered(plain_codes(rows))
    assert got(codes.code_report(frame), *names) == expected
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert got(codes.code_report(frame), *names) == expected
    few = frame.where("vec_id < 7")
    assert got(codes.code_report(few), *names) == ordered(plain_codes([r for r in rows if r[0] is not None and r[0] < 7]))
    assert codes.code_report(frame.limit(0)).collect() == []


def test_codes_hold_what_they_name(spark):
    rows = codes.kept_vectors(spark.createDataFrame(vectors_of(100, 32), "vec_id long, label int, embedding array<double>"), 256)
    books = codes.fit_codebooks(rows, 4, 16, 3)
    found = codes.reconstructed(codes.compress_vectors(rows.select("*", rows["_ints"].alias("was")), books), books).where("size(was) = 32").collect()
    assert found and all(sum((x - y) ** 2 for x, y in zip(r["was"], r["vector"], strict=True)) == r["error"] for r in found)
    with pytest.raises(Exception, match="too large"):
        codes.code_report(spark.createDataFrame([(1, 1, [1e9])], "vec_id long, label int, embedding array<double>")).collect()


def test_trie_walk(monkeypatch):
    monkeypatch.setattr(codes, "LEAVES", 7)
    rng = np.random.default_rng(5)
    parts = np.unique(rng.integers(-3, 4, (500, 4)), axis=0)
    book = rng.integers(-3, 4, (20, 4))
    best, distance = codes.nearest_entries(parts, book)
    plain = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (best == plain.argmin(1)).all() and (distance == plain.min(1)).all()


def plain_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                best[s, i + q] = min(q, best.get((s, i + q), q))
            i += 1
    return sorted((s, q, e - s) for (s, e), q in best.items())


def plain_report(doc_id, text, plant):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
    told = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs(spark, sf):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 8000").select("doc_id", "text").collect()]
    odd = [None, "", " \t\x0b", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 12, "x " * 30 + "y " * 30, "a b c d e f g h i " * 2 + "a b c d e f g h", " ".join(f"w{i % 9}" for i in range(26)), " ".join(f"w{i % 9}" for i in range(27)), "a b a " * 40 + "c " + "a b a b " * 9, "é\x1f\x85 " * 25]
    rows = real + [(20_000 + i, t) for i, t in enumerate(odd)] + [(20_007, odd[7]), (None, odd[11])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(periods.run_report(with_planted_runs(documents)), *RUN_COLUMNS) == ordered(plain_report(i, t, True) for i, t in rows)
    assert got(periods.run_report(documents), *RUN_COLUMNS) == ordered(plain_report(i, t, False) for i, t in rows)
    assert periods.run_report(documents.limit(0)).collect() == []
    clash = documents.selectExpr("*", "1 as start", "'q' as runs", "2 as `a.b`")
    assert periods.collapse_runs(clash).columns == clash.columns
    short = {r["doc_id"]: r["text"] for r in periods.collapse_runs(clash).where("doc_id >= 20000").collect()}
    assert short[20_003] == odd[3] and short[20_004] == "a" and short[20_000] is None and short[20_005] == "a b"
    assert periods.periodic_runs(clash).columns == ["doc_id", "text", "a.b", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]


def test_grammar():
    rng = random.Random(7)
    for _ in range(1500):
        letters, n = rng.choice([1, 2, 3, 5, 40]), rng.randrange(140)
        x = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 30 else 0):
            a, p = rng.randrange(n), rng.choice([1, 2, 3, 7, 8, 9, 16, 25])
            for i in range(a + p, min(n, a + rng.randrange(20, 110))):
                x[i] = x[i - p]
        assert sorted((s, q, e - s) for s, e, q in periods.grammar_runs(np.array(x, np.int64))) == plain_runs(x)
        if x:
            rules, left = periods.re_pair(x)
            words = max(x) + 1

            def spelled(s, rules=rules, words=words):
                return [s] if s < words else spelled(rules[s - words][0], rules, words) + spelled(rules[s - words][1], rules, words)

            assert [w for s in left for w in spelled(s)] == x
            pairs = [p for k, p in enumerate(zip(left, left[1:], strict=False)) if left[k - 1 : k + 1] != left[k : k + 2] or k == 0]
            assert len(pairs) == len(set(pairs))


def test_checksums():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    parts = [random.Random(k).randbytes(k) for k in [4, 5, 8, 63, 64, 65, 127, 128, 129, 1000, 4097]]
    assert records.crc32c(parts).tolist() == [slow(p) for p in parts] == records.crc32c(parts, 8).tolist()
    framed = records.frames(parts)
    assert records.checked(framed) == parts
    for at in (0, 9, 14, -1):
        wrong = bytearray(framed[-1])
        wrong[at] ^= 1
        with pytest.raises(ValueError, match="record"):
            records.checked([bytes(wrong)])


def test_records(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "no id"), (None, None), (3, "again"), (3, ""), (-5, "long " * 30_000), (99_999, "é😀 <|endoftext|>")] + [(7, f"same {k % 3}") for k in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as ids").repartition(5)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    index = records.write_sequences(documents, tokenizer_path(), str(tmp_path / "a"), files=6)
    placed = [(r["part"], r["record"], r["doc_id"], r["n_tokens"]) for r in index.collect()]
    keys = [d if d is not None else -(1 << 62) for *_, d, _ in sorted(placed)]
    assert keys == sorted(keys) and len(placed) == len(rows)
    assert 1 < index.select("part").distinct().count() <= 6
    told = ordered((i, np.array(ids[t], "<u4").tobytes()) for i, t in rows)
    whole = records.read_sequences(spark, str(tmp_path / "a"))
    assert got(whole.selectExpr("doc_id", "ids"), "doc_id", "ids") == told
    mixed = records.read_sequences(spark, str(tmp_path / "a"), shuffled=4).collect()
    assert ordered((r["doc_id"], r["ids"]) for r in mixed) == told
    assert [(r["part"], r["record"]) for r in mixed] != sorted((r["part"], r["record"]) for r in mixed)
    found = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in records.sequence_report(documents, tokenizer_path(), files=6).collect()), key=lambda r: r[0])
    assert ordered((i, n, c) for _, i, n, c in found) == ordered((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    assert [r[0] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1]]
    assert [r[1] is not None for r in found] == sorted(r[1] is not None for r in found)
    assert records.sequence_report(documents.limit(0), tokenizer_path()).collect() == []
    one = next(p for p in (tmp_path / "a" / "data").iterdir() if p.suffix == ".records" and p.stat().st_size)
    data = bytearray(one.read_bytes())
    data[30] ^= 1
    one.write_bytes(bytes(data))
    sidecar = one.with_name(f".{one.name}.crc")
    if os.path.exists(sidecar):
        os.remove(sidecar)
    with pytest.raises(Exception, match="checksum"):
        records.read_sequences(spark, str(tmp_path / "a")).count()
