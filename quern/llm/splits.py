"""Problem 3: splits that keep related records together.

Records that share an entity (a post, an author, a source, a content) form components. Components
come from hash-to-min over the entities; weighted rendezvous hashing gives each component its
split. A component's split depends on nothing but itself and the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.words import strip, words
from quern.labels import LABELS
from quern.workspace import Workspace

SPLITS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
# How far a split's share of the rows may be from the wanted one; the seeds that are tried for it at once, and the passes.
BALANCE, SEEDS, PASSES = 0.02, 32, 12


def post_key(c: Column) -> Column:
    """A post without white space at its ends and in lower case; NULL if nothing is left."""
    key = F.lower(strip(c))
    return F.when(key != "", key)


def hash_to_min(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the connected component of every node of the (a, b) edges.

    The cluster of a node is kept as rows (node, member). In each round a node sends its cluster
    to the cluster's smallest member and that member to all others, until no cluster changes;
    then the smallest node of a component holds the whole of it and each other node only that.
    """
    work = Workspace(edges.sparkSession, "mins")
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("member")), F.struct(F.col("b").alias("node"), F.col("a").alias("member")), F.struct(F.col("a").alias("node"), F.col("a").alias("member")), F.struct(F.col("b").alias("node"), F.col("b").alias("member")))
    clusters = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(both).alias("e")).select("e.node", "e.member").distinct()
    clusters, seen = work.save_counted(clusters)
    if not seen["n"]:
        return clusters.select("node", F.col("member").alias("component"))
    while True:
        least = clusters.groupBy("node").agg(F.min("member").alias("m"))
        sent = clusters.join(least, "node").select(
            F.explode(F.array(F.struct(F.col("m").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("m").alias("member")))).alias("e")
        )
        new = sent.select("e.node", "e.member").distinct()
        # a round without change repeats the same rows, so their number and their digest stay the same
        digest = F.bit_xor(F.xxhash64("node", "member"))
        new, now = work.save_counted(new, digest=digest)
        work.drop(clusters)
        clusters = new
        if now == seen:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
        seen = now


def _components_of(edges: DataFrame) -> DataFrame:
    """(node, component) by :func:`hash_to_min`; entities that are linked to one other only take its component afterwards."""
    work = Workspace(edges.sparkSession, "links")
    edges = work.save(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
    once = ends.where("deg = 1").select("v")
    x, y = once.select(F.col("v").alias("a"), F.lit(True).alias("a1")), once.select(F.col("v").alias("b"), F.lit(True).alias("b1"))
    marked = edges.join(x, "a", "left").join(y, "b", "left")
    # of an edge that stands alone the smaller end stays
    leaf = F.when(F.col("b1") & (F.col("a1").isNull() | (F.col("a") < F.col("b"))), F.struct(F.col("b").alias("leaf"), F.col("a").alias("at"))).when(F.col("a1"), F.struct(F.col("a").alias("leaf"), F.col("b").alias("at")))
    marked = work.save(marked.select("a", "b", leaf.alias("l")))
    mins = hash_to_min(marked.where("l IS NULL").select("a", "b"))
    leaves = marked.where("l IS NOT NULL").select("l.leaf", "l.at")
    kept = leaves.select(F.col("at").alias("node")).distinct().join(mins, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rest = leaves.join(kept, leaves["at"] == kept.node).select(F.col("leaf").alias("node"), "component")
    return mins.unionByName(kept).unionByName(rest).distinct()


def components(records: DataFrame, id_col: str, keys: Sequence[Column]) -> DataFrame:
    """(id, component): records that share a value of one of the keys, directly or through others, share a component.

    Entities are the vertices, so a value shared by a third of all rows is one vertex and no row
    group. A record links its entities; one without any entity is a component of its own. Rows
    with one id are one record.
    """
    named = [F.concat(F.lit(f"{n}:"), k.cast("string")) for n, k in enumerate(keys)]
    work = Workspace(records.sparkSession, "entities")
    entities = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.array_compact(F.array(*named)).alias("es"))
    entities = work.save(entities)
    links = entities.where(F.size("es") > 1).select(F.col("es")[0].alias("a"), F.explode("es").alias("b")).where("a <> b").distinct()
    spread = entities.select("id", F.explode("es").alias("e")).groupBy("id").agg(F.min("e").alias("a"), F.max("e").alias("z"))
    # rows of one id that name several entities link them as well
    own = entities.select("id", F.explode("es").alias("b")).join(spread.where("a <> z").select("id", "a"), "id").select("a", "b").where("a <> b").distinct()
    mins = _components_of(links.unionByName(own).distinct())
    per_id = entities.groupBy("id").agg(F.min(F.get("es", F.lit(0))).alias("e"))
    out = per_id.join(mins, per_id.e == mins.node, "left")
    return out.select("id", F.coalesce("component", "e", F.concat(F.lit("id:"), F.col("id"))).alias("component"))


def rendezvous(component: Column, weights: Sequence[tuple[str, float | Column]], seed: int | Column) -> Column:
    """The split with the largest -weight / ln(u), u a hash of component and split in (0, 1)."""
    scored = []
    for name, w in weights:
        u = (F.shiftrightunsigned(F.xxhash64(component, F.lit(name), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
        scored.append(F.struct((-F.lit(w) / F.ln(u)).alias("score"), F.lit(name).alias("split")))
    return F.array_max(F.array(*scored))["split"]


def content_key(text: Column, least_words: int = 8) -> Column:
    """A digest of a text's words in order; NULL for texts of fewer words, which say nothing of where they are from."""
    ws = words(text)
    return F.when(F.size(ws) >= least_words, F.substring(F.sha2(F.array_join(ws, " "), 256), 1, 32))


def choose_seed(sizes: DataFrame, n_labels: int, splits: Sequence[tuple[str, float]] = SPLITS, seed: int = 0, balance: float = BALANCE) -> tuple[int, list[tuple[str, float]]]:
    """The seed and the weights of the rendezvous hashing that suit (component, n, n_0, n_1, ...).

    They suit if each split holds every label that at least as many components as splits hold,
    and no split's share of the rows is off by more than ``balance``. SEEDS seeds, counted from
    ``seed``, are judged in one pass, of which only sums reach the driver; the weights are the
    wanted shares at first, and are scaled by wanted over actual share for the next pass, so that
    the splits without a very large component get the more of the others. After PASSES passes the
    best balanced seed with all those labels is taken; if there is none, it is a ValueError.
    """
    counts = [f"n_{i}" for i in range(n_labels)]
    seen = sizes.agg(F.sum("n").alias("n"), *[F.count_if(F.col(c) > 0).alias(c) for c in counts]).first()
    total = seen["n"] or 0
    if not total:
        return seed, list(splits)
    needed = [c for c in counts if seen[c] >= len(splits)]
    weights = {seed + i: list(splits) for i in range(SEEDS)}
    best: tuple[float, int, list[tuple[str, float]]] | None = None
    for _ in range(PASSES):
        table = F.array(*[F.struct(F.lit(x).alias("seed"), *[F.lit(v).alias(name) for name, v in w]) for x, w in weights.items()])
        each = sizes.select("component", "n", *counts, F.explode(table).alias("e"))
        split = rendezvous(F.col("component"), [(name, F.col(f"e.{name}")) for name, _ in splits], F.col("e.seed"))
        held: dict[int, dict[str, dict]] = {x: {} for x in weights}
        for row in each.groupBy(F.col("e.seed").alias("seed"), split.alias("split")).agg(*[F.sum(c).alias(c) for c in ("n", *counts)]).collect():  # one row a seed and split
            held[row["seed"]][row["split"]] = row.asDict()
        for x, w in weights.items():
            share = {name: held[x].get(name, {}).get("n", 0) / total for name, _ in splits}
            if all(held[x].get(name, {}).get(c) for name, _ in splits for c in needed):
                off = max(abs(share[name] - wanted) for name, wanted in splits)
                if best is None or off < best[0]:
                    best = (off, x, w)
                if off <= balance:
                    return x, w
            weights[x] = [(name, v * min(3.0, max(1 / 3, wanted / max(share[name], 1e-6)))) for (name, v), (_, wanted) in zip(w, splits)]
    if best is None:
        raise ValueError(f"none of {SEEDS} seeds gives all splits all labels")
    return best[1:]


def grouped_splits(
    records: DataFrame,
    id_col: str = "id",
    keys: Sequence[Column] | None = None,
    label: str = "label",
    splits: Sequence[tuple[str, float]] = SPLITS,
    seed: int = 0,
    labels: Sequence[str] = LABELS,
    balance: float = BALANCE,
) -> DataFrame:
    """(id, component, label, split) of every labelled record; no component lies in two splits.

    ``keys`` are the entities of a record; by default its post. Rows with one id are one record;
    rows whose label is none of ``labels`` are left out. Every component is placed by weighted
    rendezvous hashing under one seed and one set of weights, see :func:`choose_seed`: labels that fewer components than
    splits hold, or none, are not asked for. An empty table gives an empty one.
    """
    work = Workspace(records.sparkSession, "splits")
    keys = [post_key(F.col("post_id"))] if keys is None else keys
    labelled = records.where(F.col(label).isin(*labels) & F.col(id_col).isNotNull())
    one = labelled.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(label).alias("label"))
    rows = work.save(components(labelled, id_col, keys).join(one, "id"))
    sizes = work.save(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == x).alias(f"n_{i}") for i, x in enumerate(labels)]))
    chosen, weights = choose_seed(sizes, len(labels), splits, seed, balance)
    return rows.select("id", "component", "label", rendezvous(F.col("component"), weights, chosen).alias("split"))


def broken_posts(split_rows: DataFrame) -> DataFrame:
    """(post_id): posts whose records stand in more than one split of an earlier splitting.

    The entities of a row are its post and, where it has a post, the earlier split_component; the
    components that :func:`hash_to_min` makes of them are what a right splitting keeps together.
    Components with rows in more than one split are the candidates; an exact count per post
    follows. Rows without a post are left out.
    """
    work = Workspace(split_rows.sparkSession, "broken")
    src = split_rows.select("id", post_key(F.col("post_id")).alias("post"), "split_component", "split").where("post IS NOT NULL AND split IS NOT NULL")
    used = work.save(src.groupBy("post", "split_component", "split").agg(F.count(F.lit(1)).alias("n")))
    edges = used.select(F.concat(F.lit("p:"), "post").alias("a"), F.concat(F.lit("s:"), "split_component").alias("b")).distinct()
    mins = work.save(hash_to_min(edges))
    rows = used.join(mins.withColumnRenamed("node", "a"), F.concat(F.lit("p:"), used.post) == F.col("a"), "left")
    rows = rows.select("post", "split", F.coalesce("component", F.concat(F.lit("p:"), "post")).alias("component"))
    broken = rows.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select("component")
    posts = rows.join(broken, "component", "left_semi").groupBy("post").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return posts.where("lo < hi").select(F.col("post").alias("post_id"))
