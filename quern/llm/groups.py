"""Problem 2: one group id for all records linked directly or through others.

Rake and compress: vertices of degree one are stripped (each remembers its neighbour), chains of
vertices of degree two are ranked by pointer doubling and replaced by one edge between their ends,
until only a core of vertices of degree three or more is left. The core is solved by contracting
every vertex into its smallest neighbour; then the labels go back down the recorded parents.
Every step is a join or an aggregation; the edge table shrinks by a constant factor per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.words import strip
from quern.workspace import Workspace


def clean_links(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(a, b) with a < b, each link once; pairs with a missing end or two equal ends are left out."""
    x, y = strip(F.col(a).cast("string")), strip(F.col(b).cast("string"))
    return (
        pairs.select(x.alias("x"), y.alias("y"))
        .where("x <> '' AND y <> '' AND x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _degrees(edges: DataFrame) -> DataFrame:
    """(v, deg, lo, hi): degree, smallest and largest neighbour; combined before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e"))
    return ends.select("e.v", "e.w").groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("lo"), F.max("w").alias("hi"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges of which neither end is in ``gone`` (v)."""
    gone = gone.select(F.col("v").alias("g"))
    return edges.join(gone, edges.a == F.col("g"), "left_anti").join(gone, edges.b == F.col("g"), "left_anti")


def _doubled(arcs: DataFrame) -> DataFrame:
    """The arcs with their pointers doubled; lower tells whether the smallest vertex on the way fell."""
    nxt = arcs.select(F.col("s").alias("nt"), F.col("t").alias("o"), F.col("nt").alias("nt2"), F.col("o").alias("o2"), F.col("rank").alias("rank2"), F.col("least").alias("least2"))
    on = arcs.where("o IS NOT NULL").join(nxt, ["nt", "o"])
    stepped = on.select("s", "t", F.col("nt2").alias("nt"), F.col("o2").alias("o"), (F.col("rank") + F.col("rank2")).alias("rank"), F.least("least", "least2").alias("least"), (F.col("lower") | (F.col("least2") < F.col("least"))).alias("lower"))
    return stepped.unionByName(arcs.where("o IS NULL"))


def _rank_chains(work: Workspace, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over the arcs of all chains of vertices of degree two.

    chain: (v, lo, hi). An arc (s, t) starts in a chain vertex s and leads to its neighbour t; if
    t is a chain vertex the arc goes on to t's other neighbour. Returns (v, parent) of every chain
    vertex and the (a, b) edges between chain ends. A cycle of chain vertices has no end: its
    vertices get the cycle's smallest vertex as parent.
    """
    arcs = chain.select("v", F.explode(F.array("lo", "hi")).alias("t"))
    inner = chain.select(F.col("v").alias("t"), F.col("lo").alias("l"), F.col("hi").alias("h"))
    arcs = arcs.join(inner, "t", "left").select(
        F.col("v").alias("s"),
        "t",
        # the next arc is (t, o); at an end o is NULL
        F.col("t").alias("nt"),
        F.when(F.col("l").isNotNull(), F.when(F.col("l") == F.col("v"), F.col("h")).otherwise(F.col("l"))).alias("o"),
        F.lit(1).cast("bigint").alias("rank"),
        F.least("v", "t").alias("least"),
    )
    arcs = _doubled(arcs.withColumn("lower", F.lit(False)))
    arcs, seen = work.save_counted(arcs, open=F.count_if(F.col("o").isNotNull()))
    still = seen["open"]
    while still:
        # two steps a job
        stepped = _doubled(_doubled(arcs.withColumn("lower", F.lit(False))))
        new, seen = work.save_counted(stepped, open=F.count_if(F.col("o").isNotNull()), lower=F.count_if(F.col("lower")))
        work.drop(arcs)
        arcs = new
        if seen["open"] == still and not seen["lower"]:
            break  # only cycles are open, and each arc has seen its whole cycle
        still = seen["open"]
    # both arcs of a vertex: the ends of its chain; the nearer end (then the smaller) is its parent
    ends = arcs.groupBy("s").agg(
        F.min(F.when(F.col("o").isNull(), F.struct("rank", "nt"))).alias("near"),
        F.min(F.when(F.col("o").isNull(), F.col("nt"))).alias("e1"),
        F.max(F.when(F.col("o").isNull(), F.col("nt"))).alias("e2"),
        F.min("least").alias("least"),
    )
    ends = work.save(ends)
    work.drop(arcs)
    parents = ends.select(F.col("s").alias("v"), F.coalesce("near.nt", "least").alias("parent"))
    edges = ends.where("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b")).distinct()
    return parents, edges


def _solve_core(work: Workspace, edges: DataFrame, deg: DataFrame) -> list[DataFrame]:
    """Parents of the core's vertices: each round joins every vertex to its smallest neighbour and contracts the roots.

    edges and deg are saved tables; edges stays.
    """
    tables, seen, given = [], {"n": 1}, edges
    while seen["n"]:
        up = deg.select("v", F.least("v", "lo").alias("p"))
        up, left = work.save_counted(up, open=F.count_if(F.col("p") != F.col("v")))
        while left["open"]:  # pointer jumping to the roots; p never exceeds v, so there are no cycles
            jump = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.p").alias("p"), (F.col("y.p") != F.col("x.p")).alias("moved"))
            new, left = work.save_counted(jump, open=F.count_if("moved"))
            work.drop(up)
            up = new.drop("moved")
            up._quern_path = new._quern_path
        tables.append(up.where("p <> v").select("v", F.col("p").alias("parent")))
        x, y = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        merged = edges.join(x, "a").join(y, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        new, seen = work.save_counted(merged)
        if edges is not given:
            work.drop(edges)
        edges, deg = new, _degrees(new)
    return tables


def linked_groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(group_id, id): every id that is linked to another, with the smallest id of its group.

    White space around ids is ignored; pairs with a missing end or two equal ends link nothing,
    repeated and reversed pairs count once, other columns are ignored. An empty table gives an
    empty result. The smallest id of a group is a row of the result too.
    """
    work = Workspace(pairs.sparkSession, "groups")
    links, seen = work.save_counted(clean_links(pairs, a, b))
    edges, parents = links, []

    def degrees(of: DataFrame) -> tuple[DataFrame, dict]:
        return work.save_counted(_degrees(of), leaves=F.count_if(F.col("deg") == 1), chain=F.count_if(F.col("deg") == 2))

    deg, kinds = degrees(edges) if seen["n"] else (None, {})
    while seen["n"]:
        if not kinds["leaves"] and not kinds["chain"]:
            parents.extend(_solve_core(work, edges, deg))
            break
        if kinds["leaves"]:
            leaves = deg.where("deg = 1").select("v", F.col("lo").alias("parent"))
            # of an edge that stands alone the smaller end stays
            alone = leaves.alias("x").join(leaves.alias("y"), F.expr("x.parent = y.v AND y.parent = x.v AND x.v < y.v"), "left_semi")
            gone = work.save(leaves.join(alone.select("v"), "v", "left_anti").select("v", "parent"))
            parents.append(gone)
            rest, seen = work.save_counted(_without(edges, gone))
            if not seen["n"]:
                break
            work.drop(deg)
            edges = rest
            deg, kinds = degrees(edges)
        if kinds["chain"]:
            chain = deg.where("deg = 2").select("v", "lo", "hi")
            up, short = _rank_chains(work, chain)
            parents.append(up.where("v <> parent"))
            edges, seen = work.save_counted(_without(edges, chain).unionByName(short).distinct())
            if not seen["n"]:
                break
            work.drop(deg)
            deg, kinds = degrees(edges)
    # labels come back from the last round to the first; what has no parent is a root
    vertices = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = None
    for level, up in enumerate(reversed(parents)):
        if labels is None:
            labels = up.select("v", F.col("parent").alias("root"))
        else:
            down = up.join(labels.select(F.col("v").alias("parent"), "root"), "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
            labels = labels.unionByName(down)
            labels = work.save(labels) if level % 2 == 0 else labels  # what is read twice a level is written every second one
    if labels is None:
        return links.select(F.col("a").alias("group_id"), F.col("b").alias("id"))
    full = work.save(vertices.join(labels, "v", "left").select("v", F.coalesce("root", "v").alias("root")))
    least = full.groupBy("root").agg(F.min("v").alias("group_id"))
    return full.join(least, "root").select("group_id", F.col("v").alias("id"))


def group_members(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(group_id, id): the members of the groups of :func:`linked_groups` other than the smallest."""
    return linked_groups(pairs, a, b).where("id <> group_id")
