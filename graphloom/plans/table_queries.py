"""Registered queries of `operators.tables` and of feature preparation on them, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import nonzero
from graphloom.operators import invariants as inv
from graphloom.operators import preparation as prep
from graphloom.operators import tables as tb
from graphloom.plans import structure_queries  # noqa: F401  (the wide row's SQL is made of theirs)
from graphloom.plans.queries import DARTS, DEG, DEN, NUM, ORACLE_SQL, TRI, query
from graphloom.sources.collections import _pairs, den_edges, graph_labels, num_edges, table

TOTAL = "tot AS (SELECT graph_id, u, v FROM den UNION ALL SELECT graph_id, u, v FROM num)"
GRAPHS = "graphs AS (SELECT DISTINCT CAST(o_orderkey // 6 AS BIGINT) AS graph_id FROM orders)"
LABELS = "lab AS (SELECT CAST(o_orderkey // 6 AS BIGINT) AS graph_id, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 1 ELSE 0 END) AS y FROM orders GROUP BY 1)"
COEFF = "coeff AS (SELECT CAST(o_orderkey // 6 AS BIGINT) AS graph_id, o_orderkey, CAST(o_custkey % 7 - 3 AS DOUBLE) / (1 + o_orderkey % 4) AS c FROM orders)"


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 6").alias("graph_id")).distinct()


def layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    den, num = den_edges(spark, sf_dir), num_edges(spark, sf_dir).select("graph_id", "u", "v")
    return {"den": den, "num": num, "total": den.union(num)}


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, layer, u, v): the edges of `layers` with the numbers of their layers, from one shuffle by graph_id; an edge of both kinds of lines is the first layer's."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber is not null")
    pairs = _pairs(lines, (F.col("l_linenumber") % 4 != 0).alias("den")).repartition("graph_id").groupBy("graph_id", "u", "v").agg(F.bool_or("den").alias("den"))
    return pairs.select("graph_id", F.explode(F.when(F.col("den"), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("layer"), "u", "v")


def coefficient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, text): the coefficients of six orders as "{a/b, ..}"."""
    one = F.concat_ws("/", (F.col("o_custkey") % 7 - 3).cast("string"), (1 + F.col("o_orderkey") % 4).cast("string"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", one.alias("c")))), lambda x: x.c), ", ")
    return table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 6").alias("graph_id")).agg(F.concat(F.lit("{"), listed, F.lit("}")).alias("text"))


#: The SQL of one layer's columns by group: what the query is called whose SQL it is, or the SQL, and the columns.
_C = "CAST(c AS DOUBLE)"
_GROUPS = {
    "degree_summary": ["n_nodes", "n_edges", "deg_min", "deg_max", "deg_avg", "deg_std", "deg_skew", "density", "edges_per_node"],
    "degree_entropy": ["entropy", "entropy_norm"], "degree_assortativity": ["assortativity"], "degree_gini": ["gini"],
    "triangle_counts": ["triangles", "open_wedges", "triangle_share"], "four_cycles": ["four_cycles"], "distance_summary": ["components", "connected", "diameter", "wiener"],
    "edge_embeddedness": ["emb_mean", "emb_std", "emb_none", "emb_two", "double_triangles"], "distance_profile": ["radius", "mean_distance", "ecc_mean", "ecc_std", "ecc_p90", "radius_ratio", "effective_diameter"],
    "cut_counts": ["cut_points", "bridges", "cut_share", "bridge_share"], "euler_summary": ["cyclomatic", "faces", "planar_possible"],
}
_CLUSTER = ORACLE_SQL["vertex_clustering"].split("SELECT graph_id, v, deg, round")[0] + f"SELECT graph_id, round(avg({_C}), 6) AS clustering_mean, round(quantile_cont({_C}, 0.5), 6) AS clustering_q50, round(quantile_cont({_C}, 0.9), 6) AS clustering_q90, round(avg(CAST(c = 0 AS DOUBLE)), 6) AS clustering_zero FROM lc GROUP BY 1"
_SCALED = f"WITH {DEG}, n AS (SELECT graph_id, count(*) AS n, min(deg) AS lo, max(deg) AS hi, avg(deg) AS mean, stddev_pop(deg) AS sd FROM deg GROUP BY 1) SELECT graph_id, round(lo / (n - 1), 6) AS deg_min_norm, round(hi / (n - 1), 6) AS deg_max_norm, round(mean / (n - 1), 6) AS deg_avg_norm, round(sd / (n - 1), 6) AS deg_std_norm FROM n"
_SHARE = "WITH q AS (" + ORACLE_SQL["four_cycles"] + f"), k AS (WITH {DEG} SELECT graph_id, CAST(count(*) AS DOUBLE) AS n FROM deg GROUP BY 1) SELECT graph_id, CASE WHEN n > 3 THEN round(four_cycles / list_product([(n - i) / (i + 1) for i in range(4)]), 6) END AS four_cycle_share FROM q JOIN k USING (graph_id)"


def _wide_sql() -> str:
    edges = {"den": DEN, "num": f"{DEN.replace('den AS', 'den0 AS')}, {NUM.replace('FROM den d', 'FROM den0 d')}, den AS (SELECT graph_id, u, v FROM num)"}
    edges["total"] = f"{DEN.replace('den AS', 'den0 AS')}, {NUM.replace('FROM den d', 'FROM den0 d')}, den AS (SELECT graph_id, u, v FROM den0 UNION ALL SELECT graph_id, u, v FROM num)"
    parts = [(ORACLE_SQL[q], c) for q, c in _GROUPS.items()]
    parts += [(_CLUSTER, ["clustering_mean", "clustering_q50", "clustering_q90", "clustering_zero"]), (_SCALED, ["deg_min_norm", "deg_max_norm", "deg_avg_norm", "deg_std_norm"]), (_SHARE, ["four_cycle_share"])]
    fours = ["path", "star", "cycle", "tailed_triangle", "diamond", "clique", "connected_sets"]
    parts += [(f"SELECT graph_id, {', '.join(f'{c} AS induced_{c}' for c in fours)} FROM ({ORACLE_SQL['induced_four']})", [f"induced_{c}" for c in fours])]
    columns, joins = [], ""
    for layer, held in edges.items():
        for k, (sql, names) in enumerate(parts):
            name = f"{layer}{k}"
            columns += [f"{name}.{c} AS {layer}_{c}" for c in names]
            joins += f" LEFT JOIN ({sql.replace(DEN, held)}) {name} ON {name}.graph_id = g.graph_id"
    return f"WITH {GRAPHS} SELECT g.graph_id, {', '.join(columns)} FROM graphs g{joins}"


@query(_wide_sql())
def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.layered_features(graphs(spark, sf_dir), layered_edges(spark, sf_dir), ["den", "num", "total"], "counted")


@query()
def spectral_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra and vertex scores of all layers, as columns of one row a graph."""
    return tb.graph_features(graphs(spark, sf_dir), layers(spark, sf_dir), ["spectrum", "centrality"])


@query(f"WITH {DEG}, n AS (SELECT graph_id, count(*) AS n, CAST(sum(deg) // 2 AS BIGINT) AS m FROM deg GROUP BY 1), l AS (SELECT graph_id, avg(deg) AS a, n, m FROM deg JOIN n USING (graph_id) GROUP BY ALL) "
       "SELECT 'basic' AS category, 4 AS features UNION ALL SELECT 'degree', 9 UNION ALL SELECT 'entropy', 2 UNION ALL SELECT 'inequality', 1")  # fmt: skip
def feature_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tb.graph_features(graphs(spark, sf_dir), {"den": den_edges(spark, sf_dir)}, "fast")
    counted = wide.agg(*(F.count(c).alias(c) for c in wide.columns if c != "graph_id"))
    names = counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in counted.columns))).alias("x")).where("x.n > 0")
    return names.groupBy(tb.feature_categories(F.col("x.name")).alias("category")).agg(F.count(F.lit(1)).cast("int").alias("features"))


@query(f"WITH {DARTS}, s AS (SELECT DISTINCT graph_id, src AS v FROM darts), r AS (SELECT graph_id, v, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY v) - 1 AS INT) AS k FROM s) SELECT d.graph_id, a.k AS u, b.k AS v FROM den d JOIN r a ON a.graph_id = d.graph_id AND a.v = d.u JOIN r b ON b.graph_id = d.graph_id AND b.v = d.v")
def dense_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices named far apart (v to 100000 * v + 7) come back as 0, 1, .."""
    return tb.relabelled(den_edges(spark, sf_dir).select("graph_id", *((F.col(c) * 100_000 + 7).alias(c) for c in "uv")))


@query(f"WITH {DEN} SELECT graph_id, CAST(u * 11 - u * (u - 1) // 2 + v - u AS INT) AS k, u, v FROM den")
def index_decoded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = den_edges(spark, sf_dir).join(F.broadcast(tb.pair_index(graphs(spark, sf_dir), 12)), ["u", "v"])
    texts = coded.groupBy("graph_id").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("k")).cast("array<string>"), ", "), F.lit("}")).alias("text"))
    return tb.decoded_edges(texts, 12)


@query("SELECT o_orderkey AS graph_id, 0 AS position, CAST(o_custkey % 7 + 1 AS INT) AS k FROM orders UNION ALL SELECT o_orderkey, 0, CAST(o_custkey % 5 + 8 AS INT) FROM orders UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 9 AS INT) END FROM orders")
def numerator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("o_orderkey") % 9 > 0, (F.col("o_orderkey") % 9).cast("string")).otherwise("")
    text = F.concat(F.lit("{{"), (F.col("o_custkey") % 7 + 1).cast("string"), F.lit(", "), (F.col("o_custkey") % 5 + 8).cast("string"), F.lit("}, {"), last, F.lit("}}"))
    return tb.numerators(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), text.alias("text")))


@query(f"WITH {COEFF} SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY o_orderkey) - 1 AS INT) AS position, round(c, 6) AS value FROM coeff")
def coefficient_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.coefficients(coefficient_texts(spark, sf_dir))


@query(f"WITH {DEN} SELECT * FROM den WHERE graph_id >= 20 AND graph_id < 120")
def graph_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of a collection that one job of many takes."""
    return den_edges(spark, sf_dir).where("graph_id >= 20 and graph_id < 120")


@query("SELECT o_orderkey, CAST((o_custkey % 7 - 3) * (m // (1 + o_orderkey % 4)) AS BIGINT) AS scaled FROM orders, (SELECT max(1 + o_orderkey % 4) AS m FROM orders)")
def scaled_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions times the largest denominator over their own, as whole numbers."""
    held = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7 - 3).alias("a"), (1 + F.col("o_orderkey") % 4).alias("b"))
    most = held.agg(F.max("b").alias("m"))
    return held.join(F.broadcast(most)).select("o_orderkey", F.expr("a * (m div b)").cast("long").alias("scaled"))


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, CASE WHEN o_orderkey % 4 > 0 THEN round(CAST(o_custkey AS DOUBLE) / (o_orderkey % 4), 6) END AS b FROM orders")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns read as numbers or fractions; those without any number (the priority, and an empty column) go."""
    frame = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.concat_ws("/", "o_custkey", F.col("o_orderkey") % 4).alias("b"), F.col("o_orderpriority").alias("c"), F.lit(None).cast("string").alias("d"))
    return prep.numeric_only(frame, ["o_orderkey"])


@query("SELECT o_orderkey, CAST(o_custkey % 3 <> 0 AS INT) AS a, o_orderpriority AS c FROM orders")
def binary_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of which half the texts or more are fractions turn into 0 and 1; others stay."""
    frame = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", F.col("o_custkey") % 3, 1 + F.col("o_orderkey") % 4).alias("a"), F.col("o_orderpriority").alias("c"))
    return prep.fraction_transform(frame, ["a", "c"], "binary")


@query(f"WITH {DEG}, s AS (SELECT graph_id, list(CAST(deg AS INT) ORDER BY deg DESC, v) AS l FROM deg GROUP BY 1) SELECT graph_id, '[' || array_to_string(list_resize(l, 14, 0), ',') || ']' AS degrees, len(l) AS n_nodes FROM s")
def padded_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in descending order, filled up to 14 as JSON, and their number after the padding is taken off again."""
    listed = inv.degrees(den_edges(spark, sf_dir)).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.col("deg").cast("int")), asc=False).alias("l"))
    full = listed.select("graph_id", tb.padded(F.col("l"), 14).alias("full"), F.size("l").alias("n"))
    return full.select("graph_id", F.to_json("full").alias("degrees"), F.size(F.slice("full", F.lit(1), F.col("n"))).cast("long").alias("n_nodes"))


@query(f"WITH {DEG}, s AS (SELECT graph_id, list((CAST(v AS INT) * 5 + 3) % 12 ORDER BY v) AS l FROM deg GROUP BY 1), t AS (SELECT graph_id, l, list_reverse(l) AS r, range(0, len(l)) AS i FROM s) SELECT graph_id, array_to_string(list_sort(list_concat(list_transform(i, lambda k: list_concat(l[k + 1:], l[1:k])), list_transform(i, lambda k: list_concat(r[k + 1:], r[1:k]))))[1], ',') AS turned FROM t")
def least_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least rotation, either way round, of each graph's vertices (taken as a face in the order 5 v + 3)."""
    faces = inv.degrees(den_edges(spark, sf_dir)).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("v", ((F.col("v") * 5 + 3) % 12).alias("x")))).alias("l"))
    return faces.select("graph_id", F.array_join(tb.least_rotation(F.transform("l", lambda s: s.x)).cast("array<string>"), ",").alias("turned"))


@query(f"WITH {DEN}, {NUM} SELECT graph_id, u, v, CAST(r.k AS INT) AS copy FROM num, range(1, 20) r(k) WHERE r.k <= mult")
def multiplied_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.multiplied(num_edges(spark, sf_dir))


@query(f"WITH {DEN}, n AS (SELECT DISTINCT CAST(l_orderkey // 6 AS BIGINT) AS graph_id, CAST(least(l_suppkey % 12, l_partkey % 12) AS INT) AS u, CAST(greatest(l_suppkey % 12, l_partkey % 12) AS INT) AS v FROM lineitem WHERE l_linenumber % 4 = 0 AND l_suppkey % 12 <> l_partkey % 12) SELECT graph_id, count(*) AS conflicts FROM den JOIN n USING (graph_id, u, v) GROUP BY 1")
def layer_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = _pairs(table(spark, sf_dir, "lineitem").where("l_linenumber % 4 = 0")).distinct()
    return tb.layer_conflicts(den_edges(spark, sf_dir), second)


@query(f"WITH {DARTS}, s AS (SELECT DISTINCT graph_id, src AS v FROM darts), r AS (SELECT s.graph_id, s.v, k, CAST(d.dst IS NOT NULL AS INT) AS x FROM s CROSS JOIN range(0, 12) t(k) LEFT JOIN darts d ON d.graph_id = s.graph_id AND d.src = s.v AND d.dst = k) SELECT graph_id, v, string_agg(CAST(x AS VARCHAR), '' ORDER BY k) AS adjacency, CAST(sum(x) AS BIGINT) AS deg FROM r GROUP BY 1, 2")
def adjacency_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex's adjacency with its degree behind it: a matrix part, then scalars, as one array; here as text."""
    rows = tb.adjacency_rows(den_edges(spark, sf_dir), 12)
    features = rows.select("graph_id", "v", F.array_append("row", F.aggregate("row", F.lit(0), lambda a, x: a + x)).alias("x"))
    return features.select("graph_id", "v", F.array_join(F.slice("x", 1, 12).cast("array<string>"), "").alias("adjacency"), F.element_at("x", -1).cast("long").alias("deg"))


@query(f"WITH {DEN}, {NUM}, e AS (SELECT graph_id, u, v, 0 AS l FROM den UNION ALL SELECT graph_id, u, v, 1 FROM num), d AS (SELECT graph_id, u AS s, v AS t, l FROM e UNION ALL SELECT graph_id, v, u, l FROM e), k AS (SELECT graph_id, s AS t, count(*) AS deg FROM d GROUP BY 1, 2) SELECT graph_id, s AS v, CAST(sum(CASE WHEN l = 0 THEN deg ELSE 0 END) AS BIGINT) AS sum_den, CAST(sum(CASE WHEN l = 1 THEN deg ELSE 0 END) AS BIGINT) AS sum_num FROM d JOIN k USING (graph_id, t) GROUP BY 1, 2")
def typed_neighbour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = layers(spark, sf_dir)
    return tb.typed_sums({"den": held["den"], "num": held["num"]})


@query(f"WITH {DEG}, c AS (SELECT d.graph_id, d.u, d.v, count(x.dst) AS k FROM den d LEFT JOIN (SELECT a.graph_id, a.src AS u, b.src AS v, a.dst FROM darts a JOIN darts b ON a.graph_id = b.graph_id AND a.dst = b.dst) x ON x.graph_id = d.graph_id AND x.u = d.u AND x.v = d.v GROUP BY 1, 2, 3) SELECT c.graph_id, c.u, c.v, CAST(a.deg + b.deg - 2 - 2 * k AS BIGINT) AS unshared FROM c JOIN deg a ON a.graph_id = c.graph_id AND a.v = c.u JOIN deg b ON b.graph_id = c.graph_id AND b.v = c.v")
def unshared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.unshared_neighbours(den_edges(spark, sf_dir))


@query(f"WITH {DARTS}, p3 AS (SELECT a.graph_id, a.src AS a, a.dst AS b, b.dst AS c, c.dst AS d FROM darts a JOIN darts b ON b.graph_id = a.graph_id AND b.src = a.dst AND b.dst <> a.src JOIN darts c ON c.graph_id = a.graph_id AND c.src = b.dst AND c.dst <> a.src AND c.dst <> a.dst), p4 AS (SELECT p.*, x.dst AS e FROM p3 p JOIN darts x ON x.graph_id = p.graph_id AND x.src = d AND x.dst NOT IN (a, b, c)), p5 AS (SELECT p.graph_id FROM p4 p JOIN darts x ON x.graph_id = p.graph_id AND x.src = e AND x.dst NOT IN (a, b, c, d)) "
       "SELECT graph_id, 3 AS length, count(*) // 2 AS paths FROM p3 GROUP BY 1 UNION ALL SELECT graph_id, 4, count(*) // 2 FROM p4 GROUP BY 1 UNION ALL SELECT graph_id, 5, count(*) // 2 FROM p5 GROUP BY 1")  # fmt: skip
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.path_counts(den_edges(spark, sf_dir))


_K4 = f"{TRI}, k4 AS (SELECT t.graph_id, a, b, c, x.v AS d FROM tri t JOIN den x ON x.graph_id = t.graph_id AND x.u = a JOIN den y ON y.graph_id = t.graph_id AND y.u = b AND y.v = x.v JOIN den z ON z.graph_id = t.graph_id AND z.u = c AND z.v = x.v)"


@query(f"WITH {_K4}, k5 AS (SELECT q.graph_id FROM k4 q JOIN den x ON x.graph_id = q.graph_id AND x.u = a JOIN den y ON y.graph_id = q.graph_id AND y.u = b AND y.v = x.v JOIN den z ON z.graph_id = q.graph_id AND z.u = c AND z.v = x.v JOIN den w ON w.graph_id = q.graph_id AND w.u = d AND w.v = x.v), k AS (SELECT graph_id, 2 AS k FROM den UNION ALL SELECT graph_id, 3 FROM tri UNION ALL SELECT graph_id, 4 FROM k4 UNION ALL SELECT graph_id, 5 FROM k5) SELECT graph_id, CAST(max(k) AS INT) AS largest FROM k GROUP BY 1")
def largest_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.largest_clique(den_edges(spark, sf_dir))


def _walks_sql(edges: str, kind: str, most: int = 11) -> str:
    steps = "".join(f", w{k} AS (SELECT a.graph_id, a.src, b.dst, sum(w) AS w FROM w{k - 1} a JOIN darts b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY 1, 2, 3)" for k in range(2, most // 2 + 2))
    pairs = [(k // 2, k - k // 2) for k in range(2, most + 1)]
    traces = " UNION ALL ".join(f"SELECT a.graph_id, {i + j} AS k, sum(a.w * b.w) AS walks FROM w{i} a JOIN w{j} b USING (graph_id, src, dst) GROUP BY 1" for i, j in pairs)
    return f"WITH {edges}, darts AS (SELECT graph_id, u AS src, v AS dst FROM {kind} UNION ALL SELECT graph_id, v, u FROM {kind}), w1 AS (SELECT graph_id, src, dst, 1 AS w FROM darts){steps} SELECT graph_id, CAST(k AS INT) AS k, CAST(walks AS BIGINT) AS walks FROM ({traces})"


@query(f"SELECT 'den' AS layer, * FROM ({_walks_sql(DEN, 'den')}) UNION ALL SELECT 'total', * FROM ({_walks_sql(f'{DEN}, {NUM}, {TOTAL}', 'tot')})")
def long_closed_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed walks of 2 to 11 steps on the first layer and on both; a length without any has no row."""
    held, out = layers(spark, sf_dir), None
    for name in ("den", "total"):
        part = tb.walk_traces(held[name]).select(F.lit(name).alias("layer"), "graph_id", F.posexplode("walks").alias("k", "walks")).where("walks > 0").withColumn("k", F.col("k") + 2)
        out = part if out is None else out.union(part)
    return out


#: The parts of each graph on vertices 0 to 3, 4 to 7 and 8 to 11 as graphs of their own.
BLOCKS = DEN.replace("den AS", "whole AS", 1) + ", den AS (SELECT graph_id * 3 + u // 4 AS graph_id, u % 4 AS u, v % 4 AS v FROM whole WHERE u // 4 = v // 4)"


def block_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_labels(spark, sf_dir).select(F.explode(F.sequence(F.col("graph_id") * 3, F.col("graph_id") * 3 + 2)).alias("graph_id"), "y")


@query(f"WITH {BLOCKS}, {LABELS}, s AS (SELECT graph_id, string_agg(u || '-' || v, ' ' ORDER BY u, v) AS e FROM den GROUP BY 1), g AS (SELECT b.graph_id, coalesce(e, '') AS e FROM (SELECT graph_id * 3 + k AS graph_id FROM lab, range(3) r(k)) b LEFT JOIN s USING (graph_id)) SELECT min(graph_id) AS first, count(*) AS graphs FROM g GROUP BY e")
def unique_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edge sets among the parts of the graphs on four vertices each, that together hold all vertices."""
    return tb.unique_graphs(tb.blocks(den_edges(spark, sf_dir), 4, 3), block_graphs(spark, sf_dir).select("graph_id"))


@query(f"WITH w AS ({_walks_sql(BLOCKS, 'den', 4)}), s AS (SELECT graph_id, string_agg(k || ':' || walks, ' ' ORDER BY k) AS walks FROM w GROUP BY 1), {LABELS} SELECT min(s.graph_id) AS first, count(*) AS graphs, count(DISTINCT y) AS labels FROM s JOIN lab ON lab.graph_id = s.graph_id // 3 GROUP BY walks HAVING count(*) > 1")
def cospectral_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts of the graphs on four vertices each."""
    return tb.cospectral_groups(tb.blocks(den_edges(spark, sf_dir), 4, 3), block_graphs(spark, sf_dir), 4)


@query(f"WITH {DEN}, n AS (SELECT graph_id, count(*) AS n FROM den GROUP BY 1) SELECT graph_id, n, CAST(coalesce(sum(n) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM n")
def flat_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first flat index of each graph's block of edges."""
    sizes = den_edges(spark, sf_dir).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return tb.running_totals(sizes, "graph_id", "n")


@query(f"WITH {COEFF} SELECT CAST(5 + graph_id % 6 AS INT) AS loop, round(min(c), 6) AS low, round(max(c), 6) AS high FROM coeff GROUP BY 1")
def coefficient_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tb.coefficients(coefficient_texts(spark, sf_dir))
    return held.groupBy((F.col("graph_id") % 6 + 5).cast("int").alias("loop")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH {COEFF} SELECT graph_id, CAST(max(CAST(c <> 0 AS INT)) AS INT) AS label, count(*) AS numerators FROM coeff GROUP BY 1")
def denominator_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A denominator counts as 1 if any graph on it has a coefficient other than zero."""
    return tb.coefficients(coefficient_texts(spark, sf_dir)).groupBy("graph_id").agg(F.max(nonzero(F.col("value"))).alias("label"), F.count(F.lit(1)).alias("numerators"))


@query("SELECT l_discount AS value, count(*) AS n, round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS mean_label FROM lineitem GROUP BY 1")
def label_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("mean_label"))


@query("SELECT label, count(DISTINCT len(embedding)) AS widths, CAST(max(len(embedding)) AS INT) AS width FROM embeddings GROUP BY 1")
def feature_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.countDistinct(F.size("embedding")).alias("widths"), F.max(F.size("embedding")).alias("width"))


@query("SELECT event_type AS name, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, count(*) AS n FROM events GROUP BY 1")
def stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum(F.octet_length("props")).alias("bytes"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DEG}, {LABELS}, n AS (SELECT graph_id, count(*) AS nodes, CAST(sum(deg) // 2 AS BIGINT) AS edges FROM deg GROUP BY 1) SELECT graph_id, CASE WHEN y = 1 AND edges >= 17 THEN 'hit' WHEN y = 1 THEN 'missed' ELSE 'false' END AS kind, nodes, edges FROM n JOIN lab USING (graph_id) WHERE y = 1 OR edges >= 17")
def error_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives found and missed and false alarms of the rule "17 edges or more", with the graphs' sizes."""
    sizes = inv.degree_summary(den_edges(spark, sf_dir)).select("graph_id", F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"))
    judged = sizes.join(graph_labels(spark, sf_dir), "graph_id").where("y = 1 or edges >= 17")
    return judged.select("graph_id", F.when((F.col("y") == 1) & (F.col("edges") >= 17), "hit").when(F.col("y") == 1, "missed").otherwise("false").alias("kind"), "nodes", "edges")


@query("SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) < 'cccccccc' AS train, CAST(5 + o_orderkey // 6 % 6 AS INT) AS loop, 5 + o_orderkey // 6 % 6 = 10 AND md5(CAST(o_orderkey AS VARCHAR)) < '4ccccccc' AS validation FROM orders")
def hashed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 to 20 by a digest of the id, and of the last loop three tenths for validation: a row's place depends on its id alone."""
    frame = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.expr("o_orderkey div 6") % 6 + 5).cast("int").alias("loop"))
    return frame.select("id", prep.hashed_share("id", 0.8).alias("train"), "loop", ((F.col("loop") == 10) & prep.hashed_share("id", 0.3)).alias("validation"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))), 'sum'), 3) AS norm, round(abs(CAST(embedding[1] AS DOUBLE)) / list_aggregate(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))), 'sum'), 6) AS first FROM embeddings")
def row_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scaled to a sum of absolute values of one: the sum, and the first scaled value's size."""
    norm = F.aggregate(F.transform("embedding", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 3).alias("norm"), (F.abs(F.get("embedding", F.lit(0)).cast("double")) / norm).alias("first"))


_LONG = "l AS (SELECT vec_id, label % 2 AS y, 'f' || (unnest(range(0, len(embedding)))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_LONG} SELECT feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(quantile_cont(x, 0.5), 6) AS median, round(max(x), 6) AS high FROM l GROUP BY 1")
def described_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the vectors, each described in one row."""
    long = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("k", "x")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), F.col("x").cast("double").alias("x"))
    return long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("high"))


@query(f"WITH {_LONG}, c AS (SELECT feature, corr(x, y) AS corr FROM l GROUP BY 1) SELECT feature, round(corr, 6) AS corr, CAST(rank() OVER (ORDER BY round(abs(corr), 9) DESC, feature) AS INT) AS place FROM c WHERE abs(corr) >= 0.02")
def ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose correlation with the label is 0.02 or more either way, the strongest first; a row a feature, so one window holds them."""
    long = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("k", "x"))
    found = long.groupBy(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature")).agg(F.corr(F.col("x").cast("double"), "y").alias("corr")).where(F.abs("corr") >= 0.02)
    return found.withColumn("place", F.rank().over(Window.orderBy(F.round(F.abs("corr"), 9).desc(), "feature")))
