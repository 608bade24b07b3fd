"""Connected components by small and large stars, and the post groups that near duplicates link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import py_strip, short_hash
from quern.workspace import Workspace


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node linked to each node of the (a, b) edges.

    Alternating large-star and small-star steps; every step is an aggregation and a join, the
    smallest neighbours are found with partial sums, and hot nodes are left to the adaptive skew
    join. Self links and NULL ends link nothing.
    """
    work = Workspace(edges.sparkSession, "stars")
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, seen = work.save_counted(clean, digest=F.bit_xor(F.xxhash64("hi", "lo")))
    while seen["n"]:
        # large star: the larger neighbours of a node are linked to its smallest neighbour or itself
        both = now.select(F.explode(F.array(F.struct(F.col("hi").alias("v"), F.col("lo").alias("w")), F.struct(F.col("lo").alias("v"), F.col("hi").alias("w")))).alias("e")).select("e.v", "e.w")
        least = both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        large = both.where("w > v").join(least, "v").select(F.col("w").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(least, "hi")
        small = linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        new, fresh = work.save_counted(small, digest=F.bit_xor(F.xxhash64("hi", "lo")))
        work.drop(now)
        now = new
        if fresh == seen:
            break
        seen = fresh
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def connected_posts(rows: DataFrame, all_rows: DataFrame, pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(post_id, split_component): posts linked by near-duplicate pairs or historical duplicates share a component.

    The component is a hash of its smallest post. Blank posts link nothing; a blank post in
    ``rows`` or an unknown id in ``pairs`` is an error.
    """
    if rows.where(F.coalesce(py_strip(F.col("post_id")), F.lit("")) == "").limit(1).count():
        raise ValueError("a row has no post")
    posts = all_rows.groupBy("id").agg(F.max("post_id").alias("post"))
    a, b = posts.select(F.col("id").alias("id_a"), F.col("post").alias("a")), posts.select(F.col("id").alias("id_b"), F.col("post").alias("b"))
    joined = pairs.select("id_a", "id_b").join(a, "id_a", "left").join(b, "id_b", "left")
    if joined.where("a IS NULL OR b IS NULL").limit(1).count():
        raise ValueError("a pair has an unknown id")
    edges = joined.select("a", "b")
    if history is not None:
        own = history.select(F.col("canonical_id").alias("id_a"), F.col("post_id").alias("b")).join(a, "id_a", "left")
        edges = edges.unionByName(own.select("a", "b"))
    edges = edges.where("a <> '' AND b <> ''")
    labels = components(edges)
    wanted = rows.select("post_id").distinct()
    return wanted.join(labels, wanted.post_id == labels.node, "left").select("post_id", short_hash("split_component_", F.coalesce("component", "post_id"), 16).alias("split_component"))
