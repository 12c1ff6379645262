"""Sharding by balanced label propagation, in DataFrame operations.

Documents with equal texts are linked. They start in shards given by a hash; in each round the links
of a text are counted by shard, and its documents move towards the shard that holds most of them. A
shard admits no more documents than it has room for: where more want to move in, whole texts are
admitted by a seeded draw. Texts with more copies than a tenth of a shard, of which there are at most ten
for each shard, get the fewest shards that hold them first, and take that room from the others. Links are never
listed pair by pair: a text is the hub of its copies.

Then the `rows` law is made exact: documents are numbered within their shard, linked ones first, and
those beyond the shard's quota, which are unlinked wherever possible, fill up the other shards. Counts
then differ by one at most, and slots are gapless.

Null texts have size 16, checksum 0 and are linked as empty ones are. Repeated rows are documents of
their own. Placement depends on ids and texts only, not on how the table is split; rows that agree in both are
interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import join_on_hot, stage

ROUNDS = 4
SEED = 37
#: Parts of a shard that are numbered on their own.
PARTS = 64


def reserve(large: list[tuple[int, int]], n_shards: int, room: int) -> tuple[list[int], list[tuple[int, int, float, float]]]:
    """Shards for texts with many copies, the largest first, each in as few shards as hold it: the room left
    in every shard, and (key, shard, from, to) of the seeded draw of a row."""
    free, ranges = [room] * n_shards, []
    for key, copies in sorted(large, key=lambda x: (-x[1], x[0])):
        left = copies
        while left > 0:
            s = max(range(n_shards), key=lambda i: (free[i], -i))
            part = min(left, free[s]) if free[s] > 0 else left
            ranges.append((key, s, (copies - left) / copies, (copies - left + part) / copies))
            free[s], left = free[s] - part, left - part
    return [max(f, 0) for f in free], ranges


def propagate(linked: DataFrame, n_shards: int, room: int, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """linked (rid, key, copies, ...) with shard: at most about `room` rows in each."""
    spark, start = linked.sparkSession, F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n_shards)).cast("int")
    copies = linked.groupBy("key").agg(F.first("copies").alias("copies"))
    # texts with over a tenth of a shard: at most ten times as many as there are shards
    large = [tuple(r) for r in copies.where(F.col("copies") * 10 > max(room, 1)).select("key", "copies").collect()]
    free, ranges = reserve(large, n_shards, max(room, 1))
    draw = F.shiftrightunsigned(F.xxhash64("rid", F.lit(seed + 7)), 11).cast("double") / float(1 << 53)
    fixed = spark.createDataFrame(ranges, "key long, shard int, first double, end double")
    hot = linked.where(F.col("copies") * 10 > max(room, 1)).withColumn("draw", draw).join(F.broadcast(fixed), "key").where("draw >= first and draw < end").drop("draw", "first", "end")
    state = stage(linked.where(F.col("copies") * 10 <= max(room, 1)).withColumn("shard", start), "shard")
    for turn in range(rounds):
        # the shard that holds most copies of a text, among those with room
        open_to = F.element_at(F.array(*[F.lit(f > 0) for f in free]), F.col("shard") + 1)
        held = state.groupBy("key", "shard").agg(F.count("*").alias("n"))
        best = held.groupBy("key").agg(F.max(F.struct(open_to.alias("o"), "n", F.xxhash64("key", "shard").alias("h"), "shard")).alias("best"))
        asked = state.join(best.select("key", F.col("best.shard").alias("to")), "key")
        # n_shards rows: what a shard holds, and what wants in
        load = asked.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()
        own, new = [0] * n_shards, [0] * n_shards
        for r in load:
            own[r["shard"]] += r["n"]
            new[r["to"]] += r["n"] * (r["to"] != r["shard"])
        if not any(new):
            break
        admit = [min(1.0, max(0, free[s] - own[s]) / max(new[s], 1)) for s in range(n_shards)]
        luck = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed + turn)), 11).cast("double") / float(1 << 53)  # rows of a text move together
        moves = luck < F.element_at(F.array(*[F.lit(p) for p in admit]), F.col("to") + 1)
        state = stage(asked.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard"))).drop("to"), "shard")
    return state.unionByName(hot)


def shards(docs: DataFrame, n_shards: int = 40, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, copies: one row for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    # rows that agree in all of this are interchangeable: counted and numbered, whatever task they came from
    light = light.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("times")).withColumn("nth", F.explode(F.expr("sequence(1, times)")))
    light = stage(light.select("doc_id", "size", "text_crc32", "key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "key", "nth").alias("rid")), "shard")
    several = light.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").withColumn("__n", F.col("copies"))
    light = stage(join_on_hot(light, several, ["key"], "__n").drop("__n"), "shard")
    total = light.count()
    base, more = divmod(total, n_shards)
    quota = [base + (s < more) for s in range(n_shards)]
    linked = propagate(light.where("copies is not null"), n_shards, base, rounds, seed)
    alone = light.where("copies is null").withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n_shards)).cast("int"))
    placed = linked.unionByName(alone)
    placed = stage(placed.withColumn("part", F.when(F.col("copies").isNull(), PARTS).otherwise(0) + F.pmod(F.xxhash64("rid", F.lit(seed + 99)), F.lit(PARTS))), "shard")
    # positions within a shard: counts of its parts, and the place within a part
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # n_shards * 2 * PARTS rows at most
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = F.broadcast(parts.select("shard", "part", F.coalesce(start, F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid", "doc_id", "key")) - 1
    placed = placed.withColumn("place", place).join(parts, ["shard", "part"]).withColumn("place", F.col("start") + F.col("place"))
    have = {r["shard"]: r["n"] for r in light_counts(placed)}
    have = [have.get(s, 0) for s in range(n_shards)]
    over, gaps, beyond, missing = [], [], 0, 0
    for s in range(n_shards):
        over.append(beyond)
        beyond += max(0, have[s] - quota[s])
        if have[s] < quota[s]:
            gaps.append((missing, missing + quota[s] - have[s], s, have[s]))
            missing += quota[s] - have[s]
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), i + 1)
    stays = F.col("place") < at(quota, F.col("shard"))
    turn = at(over, F.col("shard")) + F.col("place") - at(quota, F.col("shard"))  # among all that are too many
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, last, s, n in gaps:
        inside = (turn >= first) & (turn < last)
        shard, slot = F.when(inside, F.lit(s)).otherwise(shard), F.when(inside, turn - first + n).otherwise(slot)
    out = placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(stays, F.col("shard")).otherwise(shard).cast("int").alias("shard"), F.when(stays, F.col("place")).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return out


def light_counts(placed: DataFrame) -> list:
    """Rows by shard: as many as there are shards."""
    return placed.groupBy("shard").agg(F.count("*").alias("n")).collect()
