"""The pipeline's stages, each on what its predecessor kept."""

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from graphloom.llm import jaccard  # noqa: E402
from tests.llm.test_operators import brute_contamination, brute_jaccard, brute_lines, ordered  # noqa: E402


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        if k < 4:
            assert docs.columns == seen[0].columns
        seen.append(docs)
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in seen[:5]]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {i for i, _ in rows[1]}
    judged = [(i in kept) == bool(labels[i]) for i, _ in rows[0] if i in labels]
    assert sum(judged) > 0.93 * len(judged) and set(rows[1]) <= set(rows[0])
    assert sorted(i for i, _ in rows[2]) == sorted(i for i, _ in rows[1])
    assert sorted(i for i, _ in rows[3]) == sorted({c for _, _, c in brute_jaccard(rows[2], 5, 80)})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows[4]) == sorted(x[0] for x in brute_contamination(rows[3], items) if not x[5])
    assert {r["doc_id"] for r in seen[5].select("doc_id").collect()} == {i for i, _ in rows[4]}
    assert jaccard.jaccard_components(seen[4], 5, 80).where("doc_id <> component_id").count() == 0


def test_line_stage(spark):
    import hashlib

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = corpus_pipeline.lines(spark, docs, folder).collect()
    assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in found) == sorted((x[0], x[3]) for x in brute_lines(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=lambda s: s.__name__)
def test_workers_get_small_batches(spark, stage):
    """After any stage is asked for, 30 MB of texts don't reach a Python worker at once, and all of them reach it."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    folder = "/root/testdata/sf0.001"
    stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(20), folder)
    texts = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('a', 100000) as text")
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 300
    assert max(r["size"] for r in found) < 6 << 20
