"""Shards by balanced label propagation, in DataFrame operations only.

Documents start at a shard drawn by a hash. Documents with equal texts are linked. In each round every document asks to
move to the shard that most of its neighbours are in, among those with room; a shard admits requests up to its quota, by
how many neighbours they would join. Documents of a group that are in one shard are alike, so rounds work on counts by
group and shard, of which a group has as many as there are shards. At last every shard gives what it has above its
share to the shards below theirs, unlinked documents first, which makes the counts equal to within one. Rounds go on
until one admits no move. Each move joins documents to at least as many, so the sum of the squared counts only grows and
the rounds end.

Ranks are made in two levels, a rank in a bucket and the bucket's offset, so no window spans a whole shard or group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import small, stored

BUCKET = 50_000
HASHES = 256


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def _running(values: list[int]) -> list[int]:
    return [sum(values[:k]) for k in range(len(values))]


def _slot_of(bounds: list[int], x: Column) -> Column:
    """The last k with bounds[k] <= x, for rising bounds that begin with 0; 0-based."""
    return F.size(F.filter(_numbers(bounds), lambda b: b <= x)) - 1


def _loads(cells: DataFrame, shards: int) -> list[int]:
    return _state(cells, shards)[0]


def _state(cells: DataFrame, shards: int) -> tuple[list[int], int]:
    """The load of each shard, and the sum of the squared counts, which every move makes larger."""
    n = F.col("n").cast("decimal(19,0)")
    got = {r.shard: r for r in cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(n * n).alias("n2")).collect()}  # a row for each shard
    return [int(got[k].n) if k in got else 0 for k in range(shards)], sum(int(r.n2) for r in got.values())


def _round(cells: DataFrame, room: list[int]) -> DataFrame:
    """cells: gid, shard, n. Moves what the rooms admit towards each group's largest open shard."""
    rating = F.struct(F.col("n").alias("n"), F.xxhash64("gid", "shard").alias("m"), F.col("shard").alias("shard"))  # ties by a hash
    open_n = F.when(F.element_at(_numbers(room), F.col("shard") + 1) > 0, rating)
    best = Window.partitionBy("gid")
    asked = cells.withColumn("_b", F.max(open_n).over(best)).withColumn("to", F.col("_b.shard"))
    wants = (F.col("to") != F.col("shard")) & (rating < F.col("_b"))
    asked = asked.withColumn("ask", F.when(wants, F.col("n")).otherwise(F.lit(0)))
    asked = asked.withColumns({"_g": F.floor(F.log2(F.col("_b.n") + F.lit(1))).cast("int"), "_h": F.pmod(F.xxhash64("gid"), F.lit(HASHES)).cast("int")})
    moves = asked.where("ask > 0")
    steps = moves.groupBy("to", "_g", "_h").agg(F.sum("ask").alias("_n"))  # shards x 64 x HASHES rows at most
    order = Window.partitionBy("to").orderBy(F.desc("_g"), "_h").rowsBetween(Window.unboundedPreceding, -1)
    steps = small(steps.select("to", "_g", "_h", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")))
    local = Window.partitionBy("to", "_g", "_h").orderBy("gid", "shard").rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.withColumn("_own", F.coalesce(F.sum("ask").over(local), F.lit(0))).join(steps, ["to", "_g", "_h"])
    free = F.element_at(_numbers(room), F.col("to") + 1) - F.col("_before") - F.col("_own")
    moves = moves.withColumn("go", F.greatest(F.lit(0), F.least(free, F.col("ask")))).where("go > 0")
    both = moves.select("gid", F.inline(F.array(F.struct(F.col("shard"), (-F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n")))))
    return stored(cells.unionByName(both).groupBy("gid", "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def _settled(cells: DataFrame, share: list[int]) -> DataFrame:
    """cells after as many rounds as it takes until none admits a move."""
    loads, squares = _state(cells, len(share))
    while True:
        # Unlinked documents give way at the end, at no cost, so linked ones may fill a shard's share.
        cells = _round(cells, [max(0, s - h) for s, h in zip(share, loads, strict=True)])
        before = squares
        loads, squares = _state(cells, len(share))
        if squares == before:
            return cells


def assigned(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs; the law is ``rows``.

    Rows are treated one by one: repeated rows are linked copies, null ids are allowed, null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("gid"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("start"),
    )
    base = stored(base)
    total = base.count()
    buckets = max(1, math.ceil(total / BUCKET))
    groups = stored(base.groupBy("gid", F.col("start").alias("shard")).agg(F.count("*").alias("n")))
    linked = stored(groups.groupBy("gid").agg(F.sum("n").alias("_all")).where("_all > 1").select("gid"))
    cells = stored(groups.join(linked, "gid", "left_semi"))
    share = [total // shards + (k < total % shards) for k in range(shards)]
    cells = _settled(cells, share)

    # Linked documents: a rank in the group, looked up among the group's shards.
    b = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    ends = F.sum("n").over(Window.partitionBy("gid").orderBy("shard"))
    lists = cells.withColumn("_end", ends).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(F.col("_end").alias("end"), F.col("shard").alias("shard")))).alias("_cells"))
    parts = base.join(linked, "gid", "left_semi").groupBy("gid", b.alias("_k")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("gid").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.withColumn("_before", F.coalesce(before, F.lit(0))).join(lists, "gid").select("gid", "_k", "_before", "_cells"))
    rows = base.withColumn("_k", b).join(parts, ["gid", "_k"], "left")
    rank = F.when(F.col("_cells").isNotNull(), F.row_number().over(Window.partitionBy("gid", "_k").orderBy("doc_id")) - 1 + F.col("_before"))
    rows = rows.withColumn("_rank", rank)
    chosen = F.element_at(F.filter("_cells", lambda c: c["end"] > F.col("_rank")), 1)["shard"]
    rows = rows.withColumn("_at", F.coalesce(chosen, F.col("start")))

    # A rank in the shard, linked documents before the others.
    rows = rows.withColumns({
        "_last": F.col("_cells").isNull().cast("int"),
        "_b": F.pmod(F.xxhash64("gid", F.coalesce(F.floor(F.col("_rank") / 10_000), F.lit(0))), F.lit(buckets)).cast("int"),
    })
    rows = stored(rows.select("doc_id", "size", "text_crc32", "gid", "_at", "_last", "_b"))
    sums = rows.groupBy("_at", "_last", "_b").agg(F.count("*").alias("_n"))  # shards x 2 x buckets rows at most
    order = Window.partitionBy("_at").orderBy("_last", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))))
    loads = _loads(sums.select(F.col("_at").alias("shard"), F.col("_n").alias("n")), shards)
    local = F.row_number().over(Window.partitionBy("_at", "_last", "_b").orderBy("gid", "doc_id")) - 1
    rows = rows.withColumn("_own", local).join(small(sums.drop("_n")), ["_at", "_last", "_b"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_own"))

    # What is above a shard's share goes, in one line, to the shards below theirs.
    over = [max(0, x - s) for x, s in zip(loads, share, strict=True)]
    under = [max(0, s - x) for x, s in zip(loads, share, strict=True)]
    at = F.col("_at") + 1
    moves = F.col("_rank") >= F.element_at(_numbers(share), at)
    line = F.element_at(_numbers(_running(over)), at) + F.col("_rank") - F.element_at(_numbers(share), at)
    takers = [k for k in range(shards) if under[k]] or [0]
    starts = _running([under[k] for k in takers])
    rows = rows.withColumn("_line", F.when(moves, line)).withColumn("_to", _slot_of(starts, F.col("_line")) + 1)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(moves, F.element_at(_numbers(takers), F.col("_to"))).otherwise(F.col("_at")).cast("int").alias("shard"),
        F.when(moves, F.element_at(_numbers([loads[k] for k in takers]), F.col("_to")) + F.col("_line") - F.element_at(_numbers(starts), F.col("_to"))).otherwise(F.col("_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
