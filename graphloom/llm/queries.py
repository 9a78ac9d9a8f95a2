"""The registered queries of the corpus operators and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.codes import code_report
from graphloom.llm.common import table
from graphloom.llm.decontam import contamination_report
from graphloom.llm.htmltext import extract_pages
from graphloom.llm.jaccard import jaccard_components
from graphloom.llm.linededup import line_dedup_report
from graphloom.llm.packing import pack_documents
from graphloom.llm.periods import run_report
from graphloom.llm.quality import quality_report
from graphloom.llm.records import sequence_report
from graphloom.llm.sharding import shard_documents
from graphloom.llm.suffixdedup import remove_repeats
from graphloom.llm.topk import exact_top_k
from graphloom.llm.toxicity import toxicity_report


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Documents with h = crc32(doc_id as text) divisible by 10 repeat, from word a = g % n on, their p = 1 + (n - a) // (3 + g % 8) words there, g being h // 10 and n the number of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = documents.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), 1)))
    n, g, words = F.size("_words"), F.floor(h / 10), F.col("_words")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return chosen.withColumn("text", F.when(n > 0, F.concat_ws(" ", F.concat(F.slice(words, F.lit(1), a), repeated))).otherwise(F.col("text"))).drop("_words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_report(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_top_k, op2_decontamination, op3_suffix_dedup, op4_toxicity, op5_html_extraction, op6_jaccard_join, op7_quality, op8_best_fit_packing, op9_line_dedup, op10_sharding, op11_code_compression, op12_periodic_runs, op13_token_records)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS t FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 5
"""

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS a FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[a + 1:a + n], ' ') AS g FROM i),
p AS (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS a FROM d, (SELECT DISTINCT n FROM g)),
m AS (SELECT p.doc_id, p.a, p.n, g.item FROM (SELECT doc_id, a, n, array_to_string(w[a + 1:a + n], ' ') AS g FROM p) p JOIN g ON g.n = p.n AND g.g = p.g),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(a, a + n)) AS at FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_LINES = f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS pos FROM x),
k AS (SELECT *, {_low("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
o AS (SELECT doc_id, line, pos, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM o GROUP BY 1
"""

_DISTANCE = " + ".join(f"(p.x{k} - c.x{k}) * (p.x{k} - c.x{k})" for k in range(1, 5))


def _nearest(book: str) -> str:
    """Each part's entry of a codebook and its squared distance."""
    return f"SELECT vec_id, pos, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM (SELECT p.vec_id, p.pos, c.e, {_DISTANCE} AS d FROM p JOIN {book} c USING (pos)) GROUP BY 1, 2"


def _moved(book: str, near: str) -> str:
    means = ", ".join(f"CAST(floor(coalesce(CAST(sum(p.x{k}) AS DOUBLE) / count(p.x{k}), any_value(c.x{k}))) AS BIGINT) AS x{k}" for k in range(1, 5))
    return f"SELECT c.pos, c.e, {means} FROM {book} c LEFT JOIN ({near} n JOIN p USING (vec_id, pos)) ON n.pos = c.pos AND n.e = c.e GROUP BY 1, 2"


#: For the 64 components of the tables, in 16 parts.
_CODES = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, pos, t[4 * pos + 1] AS x1, t[4 * pos + 2] AS x2, t[4 * pos + 3] AS x3, t[4 * pos + 4] AS x4 FROM v, range(16) r(pos)),
c0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, x1, x2, x3, x4 FROM p QUALIFY e < 64),
n0 AS MATERIALIZED ({_nearest("c0")}), c1 AS MATERIALIZED ({_moved("c0", "n0")}),
n1 AS MATERIALIZED ({_nearest("c1")}), c2 AS MATERIALIZED ({_moved("c1", "n1")}),
n2 AS MATERIALIZED ({_nearest("c2")}),
o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 JOIN v USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY pos, e)) FROM c2) AS codebooks_sha256 FROM o
"""

_RUNS = """
WITH RECURSIVE r(k, c, s) AS (SELECT k, k, 0 FROM range(256) x(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM r WHERE s < 8),
t AS (SELECT list(c ORDER BY k) AS t FROM r WHERE s = 8),
h AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, t),
d AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM d),
w AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) END AS w FROM f),
k AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS k, unnest(range(0, greatest(len(w) - 7, 0))) AS i FROM w),
p AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i > a.i),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 8 + q - min(i) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS y FROM p) GROUP BY doc_id, q, y),
u AS MATERIALIZED (SELECT doc_id, s, n, min(q) AS q FROM s WHERE n >= greatest(24, 3 * q) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(s, z) AS start, arg_min(n, z) AS length, arg_min(q, z) AS period, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n / q DESC, s, q) AS z FROM u) GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM u),
y AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM w),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM y ANTI JOIN x USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: The others can't be written in SQL, or are too slow on whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_exact_top_k": _TOP_K, "op2_decontamination": _CONTAMINATION, "op9_line_dedup": _LINES, "op11_code_compression": _CODES, "op12_periodic_runs": _RUNS}
