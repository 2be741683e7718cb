"""Connected components over edge tables.

Two solvers share the edge convention ``(u, v)`` (any ids that compare). Every round's state is written to the shared folder
before the next round reads it. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, measured_cut, skew_safe, tidy


def simple(edges: DataFrame) -> DataFrame:
    """Each undirected edge once as ``(u < v)``; loops and edges with a null end go."""
    ok = edges.where("u is not null and v is not null and u <> v")
    return ok.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, exploded within the row so that the edges are read once."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer jumping: ``(x, p)`` until every p is a root (a row with x = p). Depth halves each round."""
    while True:
        up = parents.select(F.col("x").alias("p"), F.col("p").alias("g"))
        nxt, seen = measured_cut(parents.join(up, "p").select("x", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")), "jump", moved=F.count_if("moved"))
        drop_cut(parents)
        parents = nxt.select("x", "p")
        if not seen["moved"]:
            return parents


@tidy
def hook_and_shortcut(edges: DataFrame) -> DataFrame:
    """``x, p`` for each vertex of ``edges``: p is the smallest vertex of its component.

    A round hooks each vertex below its smallest neighbour if that is smaller (a grouped minimum, pre-aggregated before the
    shuffle, so a hub costs no more than a row per task), shortcuts the parent table by joining it to itself until all
    trees are stars, and contracts edges to the roots. The remaining edges shrink every round; no round depends on
    component size or diameter. Edgeless input gives an empty result.
    """
    spark = edges.sparkSession
    with skew_safe(spark):
        left, size = measured_cut(simple(edges), "edges")
        rounds: list[DataFrame] = []
        while size["n"]:
            hooks = _both(left).groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p"))
            stars = _flatten(cut(hooks, "hooks"))
            rounds.append(stars)
            a = stars.select(F.col("x").alias("u"), F.col("p").alias("pu"))
            b = stars.select(F.col("x").alias("v"), F.col("p").alias("pv"))
            nxt, size = measured_cut(simple(left.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))), "edges")
            drop_cut(left)
            left = nxt
        if not rounds:
            return edges.select(F.col("u").alias("x"), F.col("u").alias("p")).limit(0)
        labels = rounds[-1]
        for stars in reversed(rounds[:-1]):
            later = labels.select(F.col("x").alias("p"), F.col("p").alias("r"))
            labels = cut(stars.join(later, "p", "left").select("x", F.coalesce("r", "p").alias("p")), "labels")
        return labels


def _chains(two: DataFrame) -> DataFrame | None:
    """List ranking of degree-two chains.

    ``two(x, a, b)`` has each inner vertex with its neighbours. A vertex stays an end if it is not inner, or if its hash is
    smaller than those of both neighbours (so a ring has an end too, and chain parts are short). Each inner vertex gets a
    pointer per direction, doubled by joins until both reach an end. Returns ``x, e1, e2`` for the inner vertices left out, or
    None if there are none.
    """
    h = lambda c: F.struct(F.xxhash64(c), F.col(c))
    inner = two.select("x").withColumn("inner", F.lit(True))
    t = two.join(inner.select(F.col("x").alias("a"), F.col("inner").alias("ia")), "a", "left").join(inner.select(F.col("x").alias("b"), F.col("inner").alias("ib")), "b", "left")
    lowest = F.coalesce("ia", F.lit(False)) & F.coalesce("ib", F.lit(False)) & (h("x") < h("a")) & (h("x") < h("b"))
    t, found = measured_cut(t.where(~lowest).select("x", "a", "b"), "inner")
    if not found["n"]:
        return None
    # An arc (x from f) leads on to the other neighbour n of x.
    arcs = t.select("x", F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("b").alias("n")), F.struct(F.col("b").alias("f"), F.col("a").alias("n")))).alias("e")).select("x", "e.f", "e.n")
    # Pointer: the arc reached last, (at, came) with at = n, came = x; it is done if `at` is no inner vertex any more.
    ptr = cut(arcs.select("x", "f", F.col("n").alias("at"), F.col("x").alias("came")), "arcs")
    while True:
        up = ptr.select(F.col("x").alias("at"), F.col("f").alias("came"), F.col("at").alias("at2"), F.col("came").alias("came2"))
        nxt, seen = measured_cut(ptr.join(up, ["at", "came"], "left").select("x", "f", F.coalesce("at2", "at").alias("at"), F.coalesce("came2", "came").alias("came"), F.col("at2").isNotNull().alias("moved")), "arcs", moved=F.count_if("moved"))
        drop_cut(ptr)
        ptr = nxt.drop("moved")
        if not seen["moved"]:
            return ptr.groupBy("x").agg(F.min("at").alias("e1"), F.max("at").alias("e2"))


@tidy
def strip_compress_solve(edges: DataFrame) -> DataFrame:
    """``x, p`` for each vertex: p is the smallest vertex of its component.

    Strips degree-one vertices and compresses degree-two chains until neither is left, solves the reduced core by
    hooking and shortcutting, and hands labels back to the removed vertices. Each removal keeps one pointer to a vertex that
    outlived it; the pointers form a forest that is flattened by pointer jumping, so restoring takes logarithmically many
    joins. Both removals of a round use the same degrees. Degrees come from a pre-aggregated count; edges are removed by their (unique) pair of ends, so a hub is never a
    join key until its own leaves look it up.
    """
    spark = edges.sparkSession
    with skew_safe(spark):
        left = cut(simple(edges), "edges")
        vertices = cut(_both(left).select("x").distinct(), "vertices")
        pointers: list[DataFrame] = []
        while True:
            ends, kinds = measured_cut(_both(left).groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b")), "degrees", one=F.count_if(F.col("n") == 1), two=F.count_if(F.col("n") == 2))
            gone, short = [], None
            two = ends.where("n = 2").select("x", "a", "b")
            if kinds["one"]:
                leaves = ends.where("n = 1")
                # Of a component that is a single edge only the larger end is stripped.
                single = leaves.select(F.col("x").alias("a"), F.lit(1).alias("both"))
                leaves = cut(leaves.join(single, "a", "left").where("both is null or x > a").select("x", F.col("a").alias("p")), "leaves")
                pointers.append(leaves)
                gone.append(leaves.select(F.least("x", "p").alias("u"), F.greatest("x", "p").alias("v")))
                # A vertex that a leaf points to stays this round.
                two = two.join(leaves.select(F.col("p").alias("x")).distinct(), "x", "left_anti")
            inner = _chains(two) if kinds["two"] else None
            if inner is not None:
                inner = cut(inner, "chains")
                pointers.append(inner.select("x", F.col("e1").alias("p")))
                gone.append(inner.join(ends, "x").select("x", F.explode(F.array("a", "b")).alias("y")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
                short = simple(inner.select(F.col("e1").alias("u"), F.col("e2").alias("v")))
            if not gone:
                drop_cut(ends)
                break
            rest = left
            for g in gone:
                rest = rest.join(g, ["u", "v"], "left_anti")
            nxt = cut(rest.unionByName(short).distinct() if short is not None else rest, "edges")
            drop_cut(left)
            drop_cut(ends)
            left = nxt
        core = hook_and_shortcut(left)
        removed = pointers[0] if pointers else left.select(F.col("u").alias("x"), F.col("v").alias("p")).limit(0)
        for p in pointers[1:]:
            removed = removed.unionByName(p)
        roots = vertices.join(removed.select("x"), "x", "left_anti").join(core, "x", "left").select("x", F.coalesce("p", "x").alias("p"))
        forest = _flatten(cut(removed.unionByName(roots), "forest"))
        # The core's label is the smallest core vertex; the component's is the smallest of all.
        least = cut(forest.groupBy("p").agg(F.min("x").alias("g")), "least")
        return cut(forest.join(least, "p").select("x", F.col("g").alias("p")), "labels")


@tidy
def pair_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``sample_id, group_id`` of every id in a row with both sides present; an id matched only with itself is its own group. Repeats, order and other columns do not matter."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    linked = strip_compress_solve(rows)
    alone = rows.where("u = v").select(F.col("u").alias("x")).distinct().join(linked, "x", "left_anti").select("x", F.col("x").alias("p"))
    return linked.unionByName(alone).select(F.col("x").alias("sample_id"), F.col("p").alias("group_id"))
