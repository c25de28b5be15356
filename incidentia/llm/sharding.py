"""Balanced label propagation: shards of even size that keep linked documents together.

Documents are linked through groups: all members of a group are neighbours. Every document starts
in a shard drawn from a hash. In each round a join brings each linked document the sizes of its
groups in every shard, and it asks to move where most of its neighbours are. A shard admits those
that gain most until its quota is full. Documents without a link then fill the shards up evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentia.llm.common import Work, fresh, small

SHARDS = 8
ROUNDS = 10
#: Members of a group that meet in one task of the join with its sizes.
SALT_ROWS = 20_000
#: Places among which requests and fillers are ordered by a hash; the grain of a quota.
PLACES = 1024
FILL_PLACES = 16_384
#: A filler above this share of a shard is placed by itself, largest first.
LARGE = 1_000


def balanced_shards(
    docs: DataFrame, links: DataFrame, work: Work, shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """Adds ``shard`` to ``docs`` (row, size, ...), a written table with unique non-null ``row``.

    Further columns stay, but for one named ``shard``.
    ``links`` holds (row, group): rows of one group are linked, a row may be in several groups.
    Groups of one row and null groups link nothing. Sizes are positive; shard sizes end within about
    a thousandth of each other, or the largest document's size if that is more, however large a
    group is: a group beyond a shard's quota is split. An empty table gives no rows.
    """
    docs = docs.drop("shard")
    total, count = docs.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return docs.withColumn("shard", F.lit(0))  # no rows
    members = links.filter("group IS NOT NULL").dropDuplicates(["row", "group"])
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    # Salts spread the members of a large group over tasks; its sizes are copied to each.
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    groups, seen = work.counted(sizes.select("group", salts.alias("salts")), "groups")
    many = seen["rows"]
    members = members.join(small(groups, many), "group").select(
        "row", "group", "salts", F.pmod(F.xxhash64("row"), F.col("salts")).alias("salt")
    )
    members = work.table(
        members.join(docs.select("row", "size"), "row").withColumn("shard", _drawn(shards)),
        "members",
    )
    quota = total / shards
    for number in range(rounds):
        moved, members_next = _round(members, groups, many, quota, shards, number, work)
        work.drop(members)
        members = members_next
        if not moved:
            break
    linked = work.table(members.groupBy("row").agg(F.first("shard").alias("shard")), "linked")
    return _filled(docs, linked, total, shards, work)


def _drawn(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), F.col("row")), F.lit(shards)).cast("int")


def _round(members, groups, many, quota, shards, number, work):
    """One exchange of sizes, requests and admissions; how many rows moved, and all members."""
    cells = [F.sum(F.when(F.col("shard") == s, F.col("size")).otherwise(0)) for s in range(shards)]
    # Partial sums shrink a group to a row per task before the shuffle.
    held = members.groupBy("group").agg(F.array(*cells).alias("held"))
    held = held.join(small(groups, many), "group").select(
        "group", "held", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    seen = work.table(
        members.join(held, ["group", "salt"])
        .groupBy("row")
        .agg(
            F.first("shard").alias("shard"),
            F.first("size").alias("size"),
            F.array(*(F.sum(F.col("held")[s]) for s in range(shards))).alias("near"),
            F.min("group").alias("group"),
        ),
        "seen",
    )
    loads = seen.groupBy("shard").agg(F.sum("size").alias("size")).collect()
    room = [float(quota)] * shards
    for r in loads:
        room[r["shard"]] -= r["size"]
    # The shard with the most of a row's neighbours, among its own and those with room. All members
    # of a group break ties alike, so that they do not pass each other.
    free = [F.col("size") <= room[s] for s in range(shards)]
    liked = F.array_max(
        F.array(
            *(
                F.when(
                    free[s] | (F.col("shard") == s),
                    F.struct(
                        F.col("near")[s].alias("near"),
                        F.xxhash64("group", F.lit(s)).alias("tie"),
                        F.lit(s).alias("to"),
                    ),
                )
                for s in range(shards)
            )
        )
    )
    gain = F.col("x.near") - F.col("near")[F.col("shard")]
    wish = seen.select("row", "shard", "size", "near", liked.alias("x")).select(
        "row", "shard", "size", F.col("x.to").alias("to"), gain.alias("gain")
    )
    place = F.pmod(F.xxhash64(F.lit(number), F.col("row")), F.lit(PLACES))
    # Gains by powers of two, in a fixed number of steps.
    step = F.least(F.lit(62), F.floor(F.log2(F.col("gain") + 1))).cast("int")
    asks = F.col("to") != F.col("shard")
    wish = wish.withColumns({"step": step, "place": place, "asks": asks})
    rooms = F.array(*map(F.lit, room))[F.col("to")]
    first = Window.partitionBy("to").orderBy(F.desc("step"), "place")
    admitted = (
        wish.filter("asks")
        .groupBy("to", "step", "place")
        .agg(F.sum("size").alias("size"))
        .withColumn("after", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("after") <= rooms)
        .select("to", "step", "place", F.lit(True).alias("admitted"))
    )
    # At most shards x 63 x PLACES rows.
    decided = wish.join(F.broadcast(admitted), ["to", "step", "place"], "left").select(
        "row",
        F.when(F.col("asks") & F.col("admitted"), F.col("to")).otherwise(F.col("shard")).alias("new"),
    )
    changed = members.join(decided, "row").select(
        "group", "row", "salts", "salt", "size", F.col("new").alias("shard"),
        (F.col("new") != F.col("shard")).alias("moved"),
    )
    after, counts = work.counted(changed, "members", moved=F.count_if("moved"))
    work.drop(seen)
    return counts["moved"], after.drop("moved")


def _filled(docs, linked, total, shards, work):
    """Gives the rows without a link to the shards that have room."""
    spot, one, heap = (fresh(docs, c) for c in ("_place", "_one", "_heap"))
    placed = docs.join(linked, "row", "left")
    large = total / shards / LARGE
    place = F.pmod(F.xxhash64(F.lit("fill"), F.col("row")), F.lit(FILL_PLACES)).cast("int")
    placed = work.table(
        placed.withColumn(spot, F.when(F.col("shard").isNull() & (F.col("size") <= large), place)),
        "placed",
    )
    work.drop(linked)
    loads = [0] * shards
    for r in placed.filter("shard IS NOT NULL").groupBy("shard").agg(F.sum("size").alias("n")).collect():
        loads[r["shard"]] = r["n"]
    # Fewer than shards x LARGE rows can be this large.
    big = placed.filter(F.col("shard").isNull() & F.col(spot).isNull()).select("row", "size").collect()
    chosen = []
    for r in sorted(big, key=lambda r: (-r["size"], r["row"])):
        at = loads.index(min(loads))
        loads[at] += r["size"]
        chosen.append((r["row"], at))
    fill = placed.filter(F.col(spot).isNotNull()).groupBy(spot).agg(F.sum("size").alias("n"))
    # At most FILL_PLACES rows.
    heaps = sorted((r["n"], r[spot]) for r in fill.collect())
    slots = []
    for n, at_place in reversed(heaps):
        at = loads.index(min(loads))
        loads[at] += n
        slots.append((at_place, at))
    spark = docs.sparkSession
    by_row = spark.createDataFrame(chosen, f"row long, {one} int")
    by_place = spark.createDataFrame(slots, f"{spot} int, {heap} int")
    return (
        placed.join(F.broadcast(by_row), "row", "left")
        .join(F.broadcast(by_place), spot, "left")
        .withColumn("shard", F.coalesce("shard", one, heap))
        .drop(spot, one, heap)
    )


def with_slots(sharded: DataFrame, work: Work, places: int = 256) -> DataFrame:
    """Adds ``slot``: the rows of a shard from 0 without gaps, ordered by a hash of ``row``."""
    spot, number, start = (fresh(sharded, c) for c in ("_place", "_number", "_from"))
    place = F.pmod(F.xxhash64(F.lit("slot"), F.col("row")), F.lit(places)).cast("int")
    rows = work.table(sharded.withColumn(spot, place), "slotless")
    counts = rows.groupBy("shard", spot).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(spot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", spot, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)
    )
    inside = Window.partitionBy("shard", spot).orderBy("row")
    return (
        rows.withColumn(number, F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", spot])
        .withColumn("slot", F.col(start) + F.col(number) - 1)
        .drop(spot, number, start)
    )
