"""Registered queries of `operators.isomorphism` and `operators.growth`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import growth as gr
from graphloom.operators import isomorphism as iso
from graphloom.operators import tables as tb
from graphloom.operators import topology as tp
from graphloom.operators.invariants import darts
from graphloom.plans.queries import DARTS, DEN, NUM, query
from graphloom.plans.topology_queries import FACES
from graphloom.sources.collections import den_edges, num_edges, table

#: Parts of the graphs on vertices 0 to 4, 5 to 9, and 10 and 11, which together hold all vertices.
FIVES = DEN.replace("den AS", "whole AS", 1) + ", den AS (SELECT graph_id * 3 + u // 5 AS graph_id, u % 5 AS u, v % 5 AS v FROM whole WHERE u // 5 = v // 5)"
#: The least code of each part under all 120 orders of five vertices; bit 5 u + v stands for an edge.
_ORDERS = "perm AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS p, row_number() OVER () AS i FROM range(5) a(x), range(5) b(x), range(5) c(x), range(5) d(x), range(5) e(x) WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5)"
CODES = f"{FIVES}, {_ORDERS}, code AS (SELECT graph_id, min(c) AS code FROM (SELECT graph_id, i, sum(1::BIGINT << (5 * least(p[u + 1], p[v + 1]) + greatest(p[u + 1], p[v + 1]))) AS c FROM den, perm GROUP BY 1, 2) GROUP BY 1)"


def signed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, u, v, exponent): the first layer with exponent -1, the second with its multiplicity."""
    return den_edges(spark, sf_dir).withColumn("exponent", F.lit(-1).cast("long")).union(num_edges(spark, sf_dir).select("graph_id", "u", "v", F.col("mult").cast("long")))


def turned_rotation(edges: DataFrame) -> DataFrame:
    """A rotation system for graphs that come without one: neighbours in another order than by number."""
    order = Window.partitionBy("graph_id", "src").orderBy(gr.turned_order("dst"))
    return darts(edges).select("graph_id", F.col("src").alias("v"), (F.row_number().over(order) - 1).alias("pos"), F.col("dst").alias("nbr"))


@query(f"WITH {CODES} SELECT graph_id, min(graph_id) OVER w AS class_id, count(*) OVER w AS members FROM code WINDOW w AS (PARTITION BY code)")
def isomorphism_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso.isomorphism_classes(tb.blocks(den_edges(spark, sf_dir), 5, 3))


@query(f"WITH {DEN} SELECT graph_id, CAST(1 AS BIGINT) AS renamed, CAST(0 AS BIGINT) AS reduced FROM den GROUP BY 1 HAVING count(*) > 1")
def relabelled_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every whole graph is one class with a copy of it under other vertex names, and with such a copy that lacks an edge."""
    den = den_edges(spark, sf_dir)
    a, b = iso.permuted(F.col("u"), 5, 1, 12), iso.permuted(F.col("v"), 5, 1, 12)
    named = lambda frame, k: frame.select((F.col("graph_id") * 3 + k).alias("graph_id"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    last = den.groupBy("graph_id").agg(F.max(F.struct("u", "v")).alias("e")).select("graph_id", "e.u", "e.v")
    classes = iso.isomorphism_classes(den.select((F.col("graph_id") * 3).alias("graph_id"), "u", "v").union(named(den, 1)).union(named(den.join(last, ["graph_id", "u", "v"], "left_anti"), 2)))
    of = lambda k: F.max(F.when(F.col("graph_id") % 3 == k, F.col("class_id")))
    found = classes.groupBy(F.expr("graph_id div 3").alias("graph_id")).agg(of(0).alias("x"), of(1).alias("y"), of(2).alias("z"))
    return found.where("z is not null").select("graph_id", (F.col("x") == F.col("y")).cast("long").alias("renamed"), (F.col("x") == F.col("z")).cast("long").alias("reduced"))


_FOURS = f"{DEN}, {NUM}, whole AS (SELECT graph_id, u, v, -1 AS c FROM den UNION ALL SELECT graph_id, u, v, mult FROM num), part AS (SELECT graph_id * 3 + u // 4 AS graph_id, u % 4 AS u, v % 4 AS v, c FROM whole WHERE u // 4 = v // 4)"


@query(f"WITH {_FOURS}, perm AS (SELECT [a.x, b.x, c.x, d.x] AS p, row_number() OVER () AS i FROM range(4) a(x), range(4) b(x), range(4) c(x), range(4) d(x) WHERE len(list_distinct([a.x, b.x, c.x, d.x])) = 4), "
       "text AS (SELECT graph_id, i, string_agg(e, ' ' ORDER BY e) AS t FROM (SELECT graph_id, i, least(p[u + 1], p[v + 1]) || '-' || greatest(p[u + 1], p[v + 1]) || '*' || c AS e FROM part, perm) GROUP BY 1, 2), "
       "code AS (SELECT graph_id, min(t) AS code FROM text GROUP BY 1) SELECT min(graph_id) AS class_id, count(*) AS members FROM code GROUP BY code")  # fmt: skip
def coloured_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the parts on four vertices each, with the numerator's multiplicities respected."""
    signed = signed_edges(spark, sf_dir)
    colours = signed.where("u div 4 = v div 4").select((F.col("graph_id") * 3 + F.expr("u div 4")).alias("graph_id"), (F.col("u") % 4).alias("u"), (F.col("v") % 4).alias("v"), F.col("exponent").alias("colour"))
    return iso.canonical_forms(colours).groupBy("key").agg(F.min("graph_id").alias("class_id"), F.count(F.lit(1)).alias("members")).select("class_id", "members")


@query(f"WITH {CODES}, known AS (SELECT code, min(graph_id) AS position FROM code WHERE graph_id % 6 = 0 GROUP BY 1) SELECT graph_id, position FROM code LEFT JOIN known USING (code)")
def canonical_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part's class stands in the list of the first parts of even graphs; null for classes that it lacks."""
    forms = iso.canonical_forms(tb.blocks(den_edges(spark, sf_dir), 5, 3))
    return iso.looked_up(forms, forms.where("graph_id % 6 = 0").select(F.col("graph_id").alias("position"), "key"))


@query(f"WITH {DEN}, {NUM} SELECT graph_id, u, v, CAST(-1 AS BIGINT) AS colour FROM den UNION ALL SELECT graph_id, u, v, mult FROM num")
def decorated_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerator edges as paths, and back."""
    return iso.undecorated(iso.decorated(signed_edges(spark, sf_dir).withColumnRenamed("exponent", "colour")))


TURNED = FACES.replace("coalesce(lead(dst) OVER w, min(dst) OVER (PARTITION BY graph_id, src)) AS c FROM darts WINDOW w AS (PARTITION BY graph_id, src ORDER BY dst)", "coalesce(lead(dst) OVER w, first_value(dst) OVER w) AS c FROM darts WINDOW w AS (PARTITION BY graph_id, src ORDER BY (dst * 5 + 1) % 12)")


@query(f"WITH RECURSIVE {TURNED} SELECT graph_id, count(*) AS n_faces, round(avg(size), 6) AS face_mean, max(size) AS face_max, count(*) FILTER (size = 3) AS faces_3, count(*) FILTER (size = 4) AS faces_4, count(*) FILTER (size = 5) AS faces_5 FROM face GROUP BY 1")
def rotation_text_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of rotation systems that were written as texts and read back."""
    rotation = turned_rotation(den_edges(spark, sf_dir)).select("graph_id", (F.col("v") + 1).alias("v"), "pos", (F.col("nbr") + 1).alias("nbr"))
    return tp.face_summary(gr.parsed_rotation(gr.rotation_texts(rotation)))


_STEP = f"{DARTS}, step AS (SELECT graph_id, dst AS a, src AS b, coalesce(lead(dst) OVER w, first_value(dst) OVER w) AS c FROM darts WINDOW w AS (PARTITION BY graph_id, src ORDER BY (dst * 5 + 1) % 12))"
PLACES = f"""{_STEP}, tri AS (SELECT x.graph_id, x.a AS p, x.b AS q, x.c AS r FROM step x JOIN step y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b = x.c AND y.c = x.a JOIN step z ON z.graph_id = x.graph_id AND z.a = x.c AND z.b = x.a AND z.c = x.b),
place AS (SELECT x.graph_id, x.a, x.b, x.c, y.c AS d, 'square' AS kind FROM step x JOIN step y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b = x.c JOIN step z ON z.graph_id = x.graph_id AND z.a = y.b AND z.b = y.c AND z.c = x.a JOIN step w ON w.graph_id = x.graph_id AND w.a = y.c AND w.b = x.a AND w.c = x.b
 WHERE x.a = least(x.a, x.b, x.c, y.c) AND len(list_distinct([x.a, x.b, x.c, y.c])) = 4
 UNION ALL SELECT s.graph_id, s.p, t.r, s.q, s.r, 'triangles' FROM tri s JOIN tri t ON t.graph_id = s.graph_id AND t.p = s.q AND t.q = s.p WHERE s.p < s.q AND s.r <> t.r)"""


@query(f"WITH {PLACES}, top AS (SELECT graph_id, max(v) + 1 AS z FROM den GROUP BY 1), signed AS (SELECT p.*, e.u, e.v, -1 AS k FROM place p JOIN den e USING (graph_id)" + "".join(f" UNION ALL SELECT p.*, {c}, z, -1 FROM place p JOIN top USING (graph_id)" for c in "abcd") + " UNION ALL SELECT p.*, least(a, c), greatest(a, c), 1 FROM place p UNION ALL SELECT p.*, least(b, d), greatest(b, d), 1 FROM place p) "
       "SELECT graph_id, a, b, c, d, kind, u, v, CAST(sum(k) AS BIGINT) AS exponent FROM signed GROUP BY 1, 2, 3, 4, 5, 6, 7, 8 HAVING sum(k) <> 0")  # fmt: skip
def grown_at_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rung rule at the square faces and pairs of triangular faces of all graphs."""
    den = den_edges(spark, sf_dir)
    return gr.grown_exponents(den.withColumn("exponent", F.lit(-1).cast("long")), gr.growth_places(turned_rotation(den)))


@query()
def grown_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, graphs, denominators, parents): two levels grown from all graphs, with the coefficients of their first orders."""
    den = den_edges(spark, sf_dir)
    first = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 6").alias("graph_id")).agg(F.min_by(F.col("o_custkey") % 7 - 3, "o_orderkey").cast("long").alias("coefficient"))
    start = gr.Level(den.withColumn("exponent", F.lit(-1).cast("long")), turned_rotation(den), first.where("coefficient <> 0"))
    out = None
    for k, level in enumerate(gr.levels(start, 2)):
        held = level.graphs.agg(F.lit(k + 1).alias("level"), F.count(F.lit(1)).alias("graphs"), F.sum("parents").alias("parents"))
        part = held.join(gr.unique_denominators(level.signed).agg(F.count(F.lit(1)).alias("denominators")))  # one row each
        out = part if out is None else out.union(part)
    return out.select("level", "graphs", "denominators", "parents")


#: Two graphs over one another, so that there are enough edges.
DOUBLED = DEN.replace("den AS", "whole AS", 1) + ", den AS (SELECT DISTINCT graph_id // 2 AS graph_id, u, v FROM whole), darts AS (SELECT graph_id, u AS src, v AS dst FROM den UNION ALL SELECT graph_id, v, u FROM den)"


def _hexagon_sql() -> str:
    order, steps, last = [1, 8, 4, 7, 2, 3, 5, 6], "m1 AS (SELECT DISTINCT graph_id, src AS p1 FROM darts)", 1
    for i, v in enumerate(order[1:], 1):
        near = [w for w in order[:i] if (w, v) in gr.HEXAGON or (v, w) in gr.HEXAGON]
        joins = "".join(f" JOIN darts e{k} ON e{k}.graph_id = m.graph_id AND e{k}.src = m.p{w}" + (" AND e0.dst = e%d.dst" % k if k else "") for k, w in enumerate(near))
        apart = " AND ".join(f"e0.dst <> m.p{w}" for w in order[:i])
        steps += f", m{v} AS (SELECT m.*, e0.dst AS p{v} FROM m{last} m{joins} WHERE {apart})"
        last = v
    return steps + f", hit AS (SELECT * FROM m{last})"


def doubled(edges: DataFrame) -> DataFrame:
    return edges.select(F.expr("graph_id div 2").alias("graph_id"), "u", "v").distinct()


@query(f"WITH {DOUBLED}, {_hexagon_sql()} SELECT graph_id, CAST(count(*) // 4 AS BIGINT) AS matches FROM hit GROUP BY 1")
def hexagon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexagons with two vertices inside, by pair of graphs; the pattern has four symmetries."""
    return gr.pattern_matches(doubled(den_edges(spark, sf_dir)), gr.HEXAGON).groupBy("graph_id").agg(F.count(F.lit(1)).alias("matches"))


@query(f"WITH {DOUBLED}, {NUM.replace('num AS', 'nums AS', 1).replace('FROM den', 'FROM whole').replace('JOIN den', 'JOIN whole')}, num AS (SELECT graph_id // 2 AS graph_id, u, v, sum(mult) AS mult FROM nums GROUP BY 1, 2, 3), extra AS (SELECT n.* FROM num n ANTI JOIN den d USING (graph_id, u, v)), {_hexagon_sql()}, "
       "free AS (SELECT * FROM hit m WHERE NOT EXISTS (SELECT 1 FROM extra o WHERE o.graph_id = m.graph_id AND o.u = least(m.p1, m.p4) AND o.v = greatest(m.p1, m.p4))), "
       "moved AS (SELECT f.graph_id, CASE o.u WHEN p7 THEN p8 WHEN p8 THEN p7 ELSE o.u END AS a, CASE o.v WHEN p7 THEN p8 WHEN p8 THEN p7 ELSE o.v END AS b, mult FROM free f JOIN extra o USING (graph_id)) "
       "SELECT graph_id, least(a, b) AS u, greatest(a, b) AS v, CAST(sum(mult) // 4 AS BIGINT) AS exponent FROM moved GROUP BY 1, 2, 3")  # fmt: skip
def sideways_numerators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numerators of all graphs that the sideways rule makes from a pair of graphs, added up."""
    den = doubled(den_edges(spark, sf_dir))
    num = num_edges(spark, sf_dir).groupBy(F.expr("graph_id div 2").alias("graph_id"), "u", "v").agg(F.sum("mult").alias("exponent")).join(den, ["graph_id", "u", "v"], "left_anti")
    signed = den.withColumn("exponent", F.lit(-1).cast("long")).union(num.select("graph_id", "u", "v", "exponent"))
    return gr.sideways(signed).where("exponent > 0").groupBy("graph_id", "u", "v").agg(F.sum("exponent").alias("exponent"))


@query("WITH p AS (SELECT l_orderkey AS relation, list(CAST(l_partkey % 5 AS INT) ORDER BY l_linenumber) AS points FROM lineitem GROUP BY 1), w AS (SELECT relation, points, unnest(range(0, 1 << len(points))) AS b FROM p), "
       "s AS (SELECT DISTINCT relation, list_sort([points[i + 1] for i in range(len(points)) if (b >> i) & 1 = 1]) AS one, list_sort([points[i + 1] for i in range(len(points)) if (b >> i) & 1 = 0]) AS two FROM w WHERE bit_count(b) = len(points) // 2) SELECT relation, array_to_string(one, ',') AS one, array_to_string(two, ',') AS two FROM s")  # fmt: skip
def redistributed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All different ways to share out an order's points to two vertices, half to the first."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("relation")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 5).cast("int").alias("p")))).alias("x"))
    points = rows.select("relation", F.lit(0).alias("v"), F.lit(1).alias("w"), F.transform("x", lambda r: r.p).alias("points"), F.expr("size(x) div 2").alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return gr.redistributed(points).select("relation", text("first").alias("one"), text("second").alias("two"))


@query("WITH l AS (SELECT o_orderkey // 6 AS relation, sum(o_custkey % 7 - 3) AS s, count(*) AS n FROM orders GROUP BY 1) SELECT relation, CAST(s AS BIGINT) AS left_sum, CAST(s + CASE WHEN relation % 97 = 0 THEN 1 ELSE 0 END AS BIGINT) AS right_sum, n + 1 AS terms, CAST(0 AS BIGINT) AS unknown, relation % 97 <> 0 AS holds FROM l")
def relation_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of related graphs against that of the graph one level below; one relation of 97 is planted not to hold."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 6").alias("relation"), (F.col("o_custkey") % 7 - 3).cast("decimal(20,0)").alias("coefficient"))
    below = orders.groupBy("relation").agg((F.sum("coefficient") + F.when(F.col("relation") % 97 == 0, 1).otherwise(0)).cast("decimal(20,0)").alias("coefficient"))
    relations = orders.select("relation", F.lit("left").alias("side"), F.col("o_orderkey").alias("graph_id")).union(below.select("relation", F.lit("right"), -1 - F.col("relation")))
    held = orders.select(F.col("o_orderkey").alias("graph_id"), "coefficient").union(below.select(-1 - F.col("relation"), "coefficient"))
    found = gr.relation_residuals(relations, held)
    return found.withColumns({c: F.col(c).cast("long") for c in ("left_sum", "right_sum")})
