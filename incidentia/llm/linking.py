"""Links inside buckets without listing their pairs, and the classes that links form.

A bucket holds nodes that may be alike. A round compares all nodes of a bucket with one of them, its
centre, so it costs as many comparisons as the bucket has nodes. The links found join nodes to
classes. A bucket whose nodes are all of one class is done, since further links in it change
nothing; otherwise its centre, now compared with everything, leaves. Rounds go on while they leave
less than half of the pairs of different classes. What is left is compared inside a join on the
bucket, in blocks: only links leave the join, and a large bucket is spread over many tasks. Every
pair of a bucket is thus compared or already in one class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentia.llm.common import Work, small

#: Nodes of a bucket that one task compares with all of the bucket.
BLOCK_NODES = 256


def link_buckets(
    buckets: DataFrame,
    items: DataFrame,
    alike: Callable[[Column, Column], Column],
    work: Work,
    early: Sequence[DataFrame] = (),
) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and the classes (node, label) of linked nodes; label: the least node.

    ``buckets`` holds distinct (bucket, node) with long values, ``items`` an (node, item) for each
    node, and ``alike`` tells from two items whether they are linked. ``early`` are parts of
    ``buckets`` that get one round each beforehand; where nodes share many buckets, the classes found
    there spare most comparisons in the others.
    """
    left = buckets.select("bucket", "node")
    links = labels = None
    before, waiting = float("inf"), list(early)
    while True:
        at_work = waiting[0].select("bucket", "node") if waiting else left
        named = at_work.withColumn("label", F.col("node"))
        if labels is not None:
            named = at_work.join(labels, "node", "left").select(
                "bucket", "node", F.coalesce("label", "node").alias("label")
            )
        cells = named.groupBy("bucket", "label").agg(
            F.count("*").alias("n"), F.min("node").alias("node")
        )
        state = cells.groupBy("bucket").agg(
            F.sum("n").alias("n"),
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
            # The centre is of the largest class, so that most others are compared with another.
            F.max_by(F.struct("node", "label"), F.struct("n", -F.col("node"))).alias("centre"),
        )
        state, seen = work.counted(state.filter("pairs > 0"), "mixed", pairs=F.sum("pairs"))
        if not seen["rows"]:
            if waiting:
                waiting.pop(0)
                continue
            break
        state = small(state.select("bucket", "n", "centre"), seen["rows"])
        mixed = named.join(state, "bucket")
        last = not waiting and seen["pairs"] > before / 2
        if last:
            found = _in_blocks(mixed, items, alike)
        else:
            pairs = mixed.filter("label != centre.label").select(
                F.least("node", "centre.node").alias("a"),
                F.greatest("node", "centre.node").alias("b"),
            )
            one = items.select(F.col("node").alias("a"), F.col("item").alias("x"))
            two = items.select(F.col("node").alias("b"), F.col("item").alias("y"))
            both = pairs.distinct().join(one, "a").join(two, "b")
            found = both.filter(alike(F.col("x"), F.col("y"))).select("a", "b")
        found = work.table(found, "links")
        links = found if links is None else links.unionByName(found)
        labels, count = components(links, work)
        if last:
            break
        if waiting:
            waiting.pop(0)
        else:
            before = seen["pairs"]
            left = work.table(mixed.filter("node != centre.node").select("bucket", "node"), "left")
        labels = small(labels, count)
    if links is None:
        nothing = buckets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        return nothing, nothing.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return links, labels


def _in_blocks(mixed: DataFrame, items: DataFrame, alike) -> DataFrame:
    """Links between nodes of different classes in a bucket, a block of nodes against all others."""
    held = mixed.join(items, "node")
    blocks = F.ceil(F.col("n") / BLOCK_NODES)
    one = held.select(
        "bucket",
        F.pmod(F.xxhash64("node"), blocks).alias("block"),
        F.col("node").alias("a"),
        F.col("label").alias("la"),
        F.col("item").alias("x"),
    )
    two = held.select(
        "bucket",
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"),
        F.col("node").alias("b"),
        F.col("label").alias("lb"),
        F.col("item").alias("y"),
    )
    meet = (one["bucket"] == two["bucket"]) & (one["block"] == two["block"])
    meet = meet & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
    return one.join(two, meet & alike(F.col("x"), F.col("y"))).select("a", "b").distinct()


def components(links: DataFrame, work: Work) -> tuple[DataFrame, int]:
    """The least node (``label``) that each node of the links (a, b) is connected to, and how many
    nodes there are.

    Labels travel along the links and are then replaced by the labels of the nodes that they name,
    which halves the length of a chain in each round.
    """
    edges = links.filter("a != b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = work.table(both.distinct(), "edges")
    labels, seen = work.counted(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
        "labels",
    )
    count, moved = seen["rows"], seen["rows"]
    while moved:
        theirs = small(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), count)
        near = both.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = work.table(
            labels.join(near, "node").select(
                "node", "label", F.least("label", "near").alias("lower")
            ),
            "lower",
        )
        named = small(lower.select(F.col("node").alias("lower"), F.col("lower").alias("jump")), count)
        jumped, seen = work.counted(
            lower.join(named, "lower").select(
                "node", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("moved")
            ),
            "labels",
            moved=F.count_if("moved"),
        )
        work.drop(labels, lower)
        labels, moved = jumped.drop("moved"), seen["moved"]
    work.drop(both)
    return labels, count
