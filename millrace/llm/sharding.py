"""Operator 10: shards of near-equal row counts with linked documents together, by balanced label propagation.

Links join documents of equal text. All documents of a group that are in one shard are alike, so the state of the propagation is a table of
(group, shard, documents). In a round each group looks for the shard where most of its documents already are and that has room, and its other
documents propose to move there; a shard admits proposals within its free quota. Documents without links fill what is left, so that counts
end at most one apart.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C


def _picked(rank: Column, ends: list[int]) -> Column:
    """The first shard whose running total of places is above the rank."""
    return F.size(F.filter(F.lit(list(ends)), lambda e: e <= rank))


def ranked(df: DataFrame, keys: list[str], salts: int, name: str, order: Column) -> DataFrame:
    """df with a gapless rank from 0 within its keys. Rows are ranked within (keys, salt) and each salt's rows start where those before it end,
    so no key's rows meet in one task; what is summed up is a row for each key and salt."""
    salted = df.withColumn("_salt", F.pmod("h", F.lit(salts)))  # dealt by salt too, as df may come dealt by the keys alone
    start = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(*keys, "_salt").count().withColumn("_start", F.coalesce(F.sum("count").over(start), F.lit(0))).drop("count")
    own = Window.partitionBy(*keys, "_salt").orderBy(order, "doc_id")
    return salted.repartition(*keys, "_salt").withColumn("_own", F.row_number().over(own)).join(sizes, [*keys, "_salt"]).withColumn(name, (F.col("_start") + F.col("_own") - 1).cast("long")).drop("_salt", "_start", "_own")


def propagate(cells: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Moves (group, shard, n) cells towards their groups' largest admitted shard until nothing moves. No shard gets more than its quota, beyond what it began with."""
    shards, fine = len(quota), 64
    for _ in range(rounds):
        load = dict.fromkeys(range(shards), 0) | {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, q - load[s]) for s, q in enumerate(quota)]
        room = F.element_at(F.lit(free), F.col("shard") + 1)
        goals = cells.where(room > 0).groupBy("grp").agg(F.max(F.struct("n", "shard")).alias("goal"))
        moves = cells.join(goals, "grp").where((F.col("goal.shard") != F.col("shard")) & ((F.col("goal.n") > F.col("n")) | (F.col("goal.n") == F.col("n")) & (F.col("goal.shard") > F.col("shard"))))
        # Larger groups are admitted first: by size class, then by hash, in classes small enough to rank.
        moves = moves.select("grp", "shard", "n", F.col("goal.shard").alias("to"), (F.lit(64 * fine) - F.floor(F.log2(F.col("goal.n") + F.col("n"))) * fine + F.pmod(F.xxhash64("grp"), F.lit(fine))).cast("int").alias("class"))
        moves = C.cut(moves)
        before = Window.partitionBy("to").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
        starts = moves.groupBy("to", "class").agg(F.sum("n").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
        within = Window.partitionBy("to", "class").orderBy("grp", "shard").rowsBetween(Window.unboundedPreceding, -1)
        asked = moves.join(starts, ["to", "class"]).withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
        admitted = F.greatest(F.lit(0), F.least(F.col("n"), F.element_at(F.lit(free), F.col("to") + 1) - F.col("at"))).cast("long")
        moved = C.cut(asked.withColumn("moved", admitted).where("moved > 0").select("grp", "shard", "to", "moved"))
        if moved.isEmpty():
            break
        changes = moved.select("grp", "shard", (-F.col("moved")).alias("n")).unionByName(moved.select("grp", F.col("to").alias("shard"), F.col("moved").alias("n")))
        cells = C.cut(cells.unionByName(changes).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return cells


def shard(docs: DataFrame, shards: int = 40, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and its place in it, under the law `rows`: counts of any two shards differ by one at most.

    size is the UTF-8 bytes of the text plus 16 and text_crc32 its unsigned checksum; a null text counts as empty. Equal texts are linked and stay together as
    far as quotas let them: a group larger than a shard fills whole shards. Repeated rows are rows of their own; null ids are carried along; further columns
    are not read; with fewer rows than shards some shards stay empty. cut_edges is true for rows that are not in their group's largest shard.
    Only a row for each shard reaches the driver. Groups and shards are ranked in salted pieces, so a hot text does not meet in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("grp"))
    d = C.written(narrow.withColumn("h", F.xxhash64("doc_id", "grp")), "shard-rows")
    n = d.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    salts = max(16, n // 500_000)
    linked = C.cut(d.groupBy("grp").agg(F.count("*").alias("total")).where("total > 1"))
    inside = d.join(linked, "grp")
    inside = C.written(ranked(inside, ["grp"], salts, "rank", F.col("h")), "shard-linked")
    begun = F.pmod(F.xxhash64("grp", F.col("h")), F.lit(shards)).cast("int")
    cells = propagate(C.cut(inside.groupBy("grp", begun.alias("shard")).agg(F.count("*").alias("n"))), quota, rounds)
    # A shard that began above its quota hands the excess to the pool that fills the others.
    taken = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    gaps = list(accumulate(max(0, q - taken.get(s, 0)) for s, q in enumerate(quota)))
    lists = cells.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("cells"), F.max(F.struct("n", "shard")).getField("shard").alias("main"))
    salt = F.pmod("h", F.lit(salts))
    spread = inside.withColumn("salt", salt).groupBy("grp", "salt").count().drop("count").join(lists, "grp")
    ends = F.transform(F.sequence(F.lit(1), F.size("cells")), lambda i: F.aggregate(F.slice("cells", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    placed = inside.withColumn("salt", salt).join(spread.withColumn("ends", ends), ["grp", "salt"])
    place = F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1
    placed = placed.select("doc_id", "size", "text_crc32", "grp", "h", F.element_at("cells", place)["shard"].alias("shard"), "main")
    over = {s: t - quota[s] for s, t in taken.items() if t > quota[s]}
    single = d.join(linked, "grp", "left_anti").withColumns({"shard": F.lit(None).cast("int"), "main": F.lit(None).cast("int")})
    if over:
        placed = C.cut(ranked(placed, ["shard"], salts, "rank", F.col("h")))
        kept = F.col("rank") < F.element_at(F.lit([int(q) for q in quota]), F.col("shard") + 1)
        single = single.unionByName(placed.where(~kept).drop("rank").withColumn("shard", F.lit(None).cast("int")))
        placed = placed.where(kept).drop("rank")
    pool = ranked(single.withColumn("all", F.lit(0)), ["all"], max(64, n // 100_000), "rank", F.col("h")).withColumn("shard", _picked(F.col("rank"), gaps).cast("int")).drop("rank", "all")
    out = C.written(placed.unionByName(pool.select(placed.columns)), "shard-places")
    out = ranked(out, ["shard"], salts, "slot", F.col("h"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce(F.col("shard") != F.col("main"), F.lit(False)).alias("cut_edges"))
