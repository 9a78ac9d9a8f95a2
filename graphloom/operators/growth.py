"""Rotation systems in texts, growth of signed graphs over levels, pattern search and relations between coefficients.

A signed graph is a table (graph_id, u, v, exponent), u < v: exponents below 0 are its edges proper (the denominator), those above 0
the numerator's, with multiplicity. A rotation system (graph_id, v, pos, nbr) orders the edges proper around each vertex.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.isomorphism import canonical_forms
from graphloom.operators.structure import neighbour_masks
from graphloom.operators.topology import merged_exponents
from graphloom.sources.files import materialized


def parsed_rotation(texts: DataFrame) -> DataFrame:
    """(graph_id, v, pos, nbr) of texts "{{2, 3}, {1, 3}, ..}" (graph_id, text): the k-th inner list holds the neighbours of vertex k, from 1, in cyclic order. Null and empty texts have no rows."""
    lists = texts.select("graph_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\{([\d,\s]*)\}"), F.lit(1))).alias("v", "list"))
    return lists.select("graph_id", (F.col("v") + 1).alias("v"), F.posexplode(F.regexp_extract_all("list", F.lit(r"(\d+)"), F.lit(1))).alias("pos", "nbr")).select("graph_id", "v", "pos", F.col("nbr").cast("int").alias("nbr"))


def rotation_texts(rotation: DataFrame) -> DataFrame:
    """(graph_id, text): the text that `parsed_rotation` reads, for vertices from 1; one without neighbours has an empty list."""
    lists = rotation.groupBy("graph_id", "v").agg(F.array_sort(F.collect_list(F.struct("pos", "nbr"))).alias("n"))
    by_vertex = lists.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    one = lambda v: F.concat(F.lit("{"), F.array_join(F.transform(F.coalesce(F.get(F.array(F.col("m")[v]), F.lit(0)), F.expr("cast(array() as array<struct<pos:int,nbr:int>>)")), lambda x: x.nbr.cast("string")), ", "), F.lit("}"))
    return by_vertex.select("graph_id", F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.array_max(F.map_keys("m"))), one), ", "), F.lit("}")).alias("text"))


def rotation_faults(rotation: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, v, nbr, fault): where a rotation isn't one of the graph of `edges`: a neighbour twice around a vertex ("repeated"), one without an edge ("no edge"), an edge that is missing at an end ("missing")."""
    from graphloom.operators.invariants import darts

    told = rotation.groupBy("graph_id", "v", "nbr").agg(F.count(F.lit(1)).alias("n"))
    real = darts(edges).select("graph_id", F.col("src").alias("v"), F.col("dst").alias("nbr"), F.lit(1).alias("e"))
    both = told.join(real, ["graph_id", "v", "nbr"], "full_outer")
    fault = F.when(F.col("e").isNull(), "no edge").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("graph_id", "v", "nbr", fault.alias("fault")).where("fault is not null")


def _following(rotation: DataFrame) -> DataFrame:
    """(graph_id, a, b, c): along a face, the dart (b, c) comes after (a, b)."""
    around, whole = Window.partitionBy("graph_id", "v").orderBy("pos"), Window.partitionBy("graph_id", "v")
    return rotation.select("graph_id", F.col("nbr").alias("a"), F.col("v").alias("b"), F.coalesce(F.lead("nbr").over(around), F.min_by("nbr", "pos").over(whole)).alias("c"))


def growth_places(rotation: DataFrame) -> DataFrame:
    """(graph_id, a, b, c, d, kind): where a vertex can be put in: the square faces (a, b, c, d), along the face from their least vertex, and as "triangles" the two triangular faces (a, c, d) and (c, a, b) on both sides of an edge a < c."""
    step = _following(rotation)
    two = step.join(step.toDF("graph_id", "b", "c", "d"), ["graph_id", "b", "c"])
    squares = two.join(step.toDF("graph_id", "c", "d", "a"), ["graph_id", "c", "d", "a"]).join(step.toDF("graph_id", "d", "a", "b"), ["graph_id", "d", "a", "b"])
    squares = squares.where("a < b and a < c and a < d and b <> d and b <> c and c <> d").select("graph_id", "a", "b", "c", "d", F.lit("square").alias("kind"))
    # a triangle by each of its darts (p, q), with its apex
    apex = step.join(step.toDF("graph_id", "b", "c", "a"), ["graph_id", "a", "b", "c"]).join(step.toDF("graph_id", "c", "a", "b"), ["graph_id", "a", "b", "c"]).toDF("graph_id", "p", "q", "x")
    pairs = apex.join(apex.toDF("graph_id", "q", "p", "y"), ["graph_id", "p", "q"]).where("p < q and x <> y")
    return squares.union(pairs.select("graph_id", F.col("p").alias("a"), F.col("y").alias("b"), F.col("q").alias("c"), F.col("x").alias("d"), F.lit("triangles").alias("kind")))


def grown_exponents(signed: DataFrame, places: DataFrame) -> DataFrame:
    """(the columns of `places`, u, v, exponent): the rung rule at each of `places` (graph_id, a, b, c, d, any others).

    A new vertex, one above the largest, joins a, b, c and d with exponent -1, and (a, c) and (b, d) are multiplied in with exponent 1; exponents that cancel are gone.
    """
    keys = places.columns
    top = signed.groupBy("graph_id").agg((F.max("v") + 1).alias("z"))
    new = F.expr("array(" + ", ".join(f"struct({c} as u, z as v, -1L as exponent)" for c in "abcd") + ", " + ", ".join(f"struct(least({p}, {q}) as u, greatest({p}, {q}) as v, 1L as exponent)" for p, q in ("ac", "bd")) + ")")
    added = places.join(top, "graph_id").select(*keys, F.inline(new))
    old = places.join(signed.select("graph_id", "u", "v", F.col("exponent").cast("long").alias("exponent")), "graph_id")
    return merged_exponents(added.union(old.select(*keys, "u", "v", "exponent")), keys)


def grown_rotation(rotation: DataFrame, places: DataFrame, children: DataFrame) -> DataFrame:
    """The rotation of each child (graph_id: its number, column `child` of `places` and `children`), from that of its parent.

    The new vertex z lies in the square (a, b, c, d), so it comes after a around b, after b around c, and so on; edges of the parent that the child has no
    longer, as their exponents cancelled, go from the orders of their ends. `children` is what `grown_exponents` gives.
    """
    z = children.groupBy("child").agg(F.max("v").alias("z"))
    held = places.select("graph_id", "child", "a", "b", "c", "d").join(z, "child")
    old = rotation.join(held.select("graph_id", "child"), "graph_id").select("child", "v", F.col("pos").cast("double").alias("pos"), "nbr")
    proper = children.where("exponent < 0").select("child", F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("nbr")), F.struct(F.col("v"), F.col("u").alias("nbr")))).alias("d")).select("child", "d.v", "d.nbr")
    corner = held.select("child", "z", F.explode(F.array(*(F.struct(F.col(p).alias("nbr"), F.col(q).alias("v")) for p, q in ("ab", "bc", "cd", "da")))).alias("k")).select("child", "z", "k.nbr", "k.v")
    put_in = corner.join(old, ["child", "v", "nbr"]).select("child", "v", (F.col("pos") + 0.5).alias("pos"), F.col("z").alias("nbr"))
    around = held.select("child", F.col("z").alias("v"), F.posexplode(F.array("a", "d", "c", "b")).alias("pos", "nbr")).select("child", "v", F.col("pos").cast("double").alias("pos"), "nbr")
    rows = old.join(proper, ["child", "v", "nbr"], "left_semi").unionByName(put_in.select("child", "v", "pos", "nbr")).unionByName(around)
    place = F.row_number().over(Window.partitionBy("child", "v").orderBy("pos")) - 1
    return rows.select(F.col("child").alias("graph_id"), "v", place.alias("pos"), "nbr")


class Level(NamedTuple):
    """Graphs of one level: their exponents, rotations and (graph_id, coefficient, key, parents)."""

    signed: DataFrame
    rotation: DataFrame
    graphs: DataFrame


def next_level(level: Level, kinds: tuple[str, ...] = ("square", "triangles")) -> Level:
    """All graphs that the rung rule makes from those of a level, each once: a child has its parent's coefficient, and children with equal coefficients and canonical forms are one.

    Graphs get new numbers and canonical vertices. Places, children, canonical forms and what stays of them are written to the shared folder, so that a level costs what its own
    rows cost and its numbers stay the same when a task runs again.
    """
    places = growth_places(level.rotation).where(F.col("kind").isin(*kinds))
    places = materialized(places.withColumn("child", F.monotonically_increasing_id()), "places")
    children = materialized(grown_exponents(level.signed, places), "children")
    forms = materialized(canonical_forms(children.select(F.col("child").alias("graph_id"), "u", "v", F.col("exponent").alias("colour"))), "forms")
    parents = places.select("graph_id", "child").join(level.graphs.select("graph_id", "coefficient"), "graph_id")
    keyed = forms.select(F.col("graph_id").alias("child"), "key").join(parents, "child")
    kept = keyed.groupBy("coefficient", "key").agg(F.min("child").alias("child"), F.countDistinct("graph_id").alias("parents"))
    kept = materialized(kept.withColumn("graph_id", F.monotonically_increasing_id()), "level")
    form = forms.select(F.col("graph_id").alias("child"), "vertices", "edges").join(kept.select("child", "graph_id"), "child")
    signed = materialized(form.select("graph_id", F.inline("edges")).withColumnRenamed("colour", "exponent"), "signed")
    names = form.select("child", F.col("graph_id").alias("new"), F.posexplode("vertices").alias("name", "old"))
    turned = grown_rotation(level.rotation, places.join(kept.select("child"), "child", "left_semi"), children.join(kept.select("child"), "child", "left_semi")).withColumnRenamed("graph_id", "child")
    turned = turned.join(names.select("child", "new", F.col("old").alias("v"), F.col("name").alias("to")), ["child", "v"]).join(names.select("child", F.col("old").alias("nbr"), F.col("name").alias("to_nbr")), ["child", "nbr"])
    rotation = materialized(turned.select(F.col("new").alias("graph_id"), F.col("to").alias("v"), "pos", F.col("to_nbr").alias("nbr")), "rotation")
    return Level(signed, rotation, kept.select("graph_id", "coefficient", "key", "parents"))


def levels(start: Level, count: int) -> list[Level]:
    """The next `count` levels after `start`, whose `graphs` need graph_id and coefficient."""
    out = []
    for _ in range(count):
        start = next_level(start)
        out.append(start)
    return out


def unique_denominators(signed: DataFrame) -> DataFrame:
    """(key, graphs, first): the different edges proper of a level, up to renaming of vertices, how many graphs have them and the least of these."""
    forms = canonical_forms(signed.where("exponent < 0").select("graph_id", "u", "v", F.col("exponent").alias("colour")))
    return forms.groupBy("key").agg(F.count(F.lit(1)).alias("graphs"), F.min("graph_id").alias("first"))


#: A hexagon 1..6 with two vertices inside, 8 next to 1, 2, 3, 4 and 7 next to 4, 5, 6, 1, that are next to each other.
HEXAGON = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1), (1, 8), (2, 8), (3, 8), (4, 8), (4, 7), (5, 7), (6, 7), (1, 7), (7, 8)]


def pattern_matches(edges: DataFrame, pattern: list[tuple[int, int]]) -> DataFrame:
    """(graph_id, p1, p2, ..): the vertices that stand for those of `pattern`, in ascending order of its names, wherever all its edges are in the graph; other edges may be there too. Vertex ids to 62.

    Matches that a symmetry of the pattern turns into each other are one: the one with the least vertices is kept. Pattern vertices are placed one after another, each next to as many placed ones as can
    be: what may stand for it are common neighbours not used yet, a few bits of one row, so that rows only grow by what fits, and no join is needed.
    """
    names = sorted({v for e in pattern for v in e})
    near = {v: {w for e in pattern for w in e if v in e and w != v} for v in names}
    order: list[int] = []
    while len(order) < len(names):
        order.append(max((v for v in names if v not in order), key=lambda v: (len(near[v] & set(order)), len(near[v]), -v)))
    symmetries = _symmetries(names, near)
    rows = neighbour_masks(edges).withColumn("used", F.lit(0).cast("long"))
    for i, v in enumerate(order):
        placed = [w for w in order[:i] if w in near[v]]
        common = " & ".join([f"nbr[p{w}]" for w in placed] + ["~used"])
        rows = rows.withColumn(f"p{v}", F.explode(F.expr(f"filter(sequence(0, size(nbr) - 1), j -> nbr[j] <> 0 and getbit({common}, j) = 1)")))
        rows = rows.where(f"bit_count(nbr[p{v}]) >= {len(near[v])}").withColumn("used", F.expr(f"used | shiftleft(1L, p{v})"))
    own = F.array(*(F.col(f"p{v}") for v in names))
    images = [F.array(*(F.col(f"p{s[v]}") for v in names)) for s in symmetries if any(s[v] != v for v in names)]
    if images:
        rows = rows.where(own <= F.array_min(F.array(*images)))
    return rows.select("graph_id", *(f"p{v}" for v in names))


def _symmetries(names: list[int], near: dict[int, set[int]]) -> list[dict[int, int]]:
    """All renamings of a pattern's vertices that keep its edges."""
    out: list[dict[int, int]] = [{}]
    for v in names:
        out = [s | {v: w} for s in out for w in names if w not in s.values() and len(near[w]) == len(near[v]) and all((s[x] in near[w]) == (x in near[v]) for x in s)]
    return out


def sideways(signed: DataFrame) -> DataFrame:
    """(graph_id, p1 .. p8, u, v, exponent): for each HEXAGON of a graph's edges proper whose numerator doesn't have the edge of its corners 1 and 4, the graph with the inner vertices 7 and 8 exchanged in its numerator."""
    matches = pattern_matches(signed.where("exponent < 0").select("graph_id", "u", "v"), HEXAGON)
    keys = matches.columns
    blocked = signed.where("exponent > 0").select("graph_id", F.col("u").alias("_u"), F.col("v").alias("_v"))
    low, high = F.least("p1", "p4"), F.greatest("p1", "p4")
    open_ = matches.withColumn("_u", low).withColumn("_v", high).join(blocked, ["graph_id", "_u", "_v"], "left_anti").select(*keys)
    all_edges = open_.join(signed, "graph_id")
    swap = lambda c: F.when(F.col(c) == F.col("p7"), F.col("p8")).when(F.col(c) == F.col("p8"), F.col("p7")).otherwise(F.col(c))
    top = F.col("exponent") > 0
    a, b = F.when(top, swap("u")).otherwise(F.col("u")), F.when(top, swap("v")).otherwise(F.col("v"))
    return all_edges.select(*keys, F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "exponent")


def redistributed(points: DataFrame) -> DataFrame:
    """(relation, v, w, first, second): every way to share out the multiset `points` (relation, v, w, points array, n) with n points for v and the others for w; equal ways count once. At most 24 points.

    The ways are the subsets of n bits of the places of `points`.
    """
    bits = F.explode(F.expr("filter(sequence(0L, if(size(points) <= 24, shiftleft(1L, size(points)) - 1, raise_error('more than 24 points'))), b -> bit_count(b) = n)"))
    ways = points.select("relation", "v", "w", "points", bits.alias("b"))
    pick = lambda keep: F.array_sort(F.expr(f"transform(filter(sequence(0, size(points)), i -> i < size(points) and getbit(b, i) = {keep}), i -> points[i])"))
    return ways.select("relation", "v", "w", pick(1).alias("first"), pick(0).alias("second")).distinct()


def relation_residuals(relations: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(relation, left_sum, right_sum, terms, unknown, holds) of relations (relation, side, graph_id): the coefficients of the graphs on side "left" should add up to those on side "right".

    `coefficients` is (graph_id, coefficient decimal). A graph without one counts as 0 and as unknown; a relation holds if both sums are equal. Sums combine before the shuffle by relation.
    """
    held = relations.join(coefficients, "graph_id", "left")
    total = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("coefficient"))), F.lit(0))
    found = held.groupBy("relation").agg(total("left").alias("left_sum"), total("right").alias("right_sum"), F.count(F.lit(1)).alias("terms"), F.count_if(F.col("coefficient").isNull()).alias("unknown"))
    return found.withColumn("holds", F.col("left_sum") == F.col("right_sum"))


def turned_order(name: str = "dst", factor: int = 5, shift: int = 1, n: int = 12) -> Column:
    """An order of neighbours other than by number, for collections that come without a rotation."""
    return (F.col(name) * factor + shift) % n
