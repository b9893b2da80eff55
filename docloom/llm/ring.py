"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to one of ``PLACES`` places of a ring; a key's home is the shard of the next virtual node clockwise.
A full shard turns keys away, and they continue clockwise to the next other shard with room.  Homes are filled
first, then first overflows, and so on, so a key that stays within its home's capacity never moves for others.

Only counts decide: one row for each (place, part) comes to the driver, ``PLACES * PARTS`` at most whatever the
input, and goes back as intervals of ranks, so every row finds its shard and slot by one broadcast join of that
bounded size.  With ``slack`` 0 the shards' row counts are at most one apart; with more, fewer keys overflow.

Equal rows (id, size and checksum) are counted once ahead of the shuffle and given back as often as they came.
A part cuts a place by the whole row, so one id with very many texts does not meet in one task.  Null ids and
null texts are placed like others (size 16); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm.shared import shared_table

PLACES, PARTS, NODES = 4096, 16, 32


def preferences(shards: int, nodes: int = NODES) -> list[list[int]]:
    """For each place, all shards in the order in which their virtual nodes follow clockwise."""
    def spot(shard: int, node: int) -> int:
        return int(hashlib.md5(f"shard {shard} node {node}".encode()).hexdigest(), 16) % (1 << 64)

    ring = sorted((spot(s, v) * PLACES >> 64, spot(s, v), s) for s in range(shards) for v in range(nodes))
    orders, found, at = [], {}, 0
    for place in range(PLACES):
        while at < len(ring) and ring[at][0] < place:
            at += 1
        key = at % len(ring)
        if key not in found:
            found[key] = list(dict.fromkeys(s for _, _, s in ring[key:] + ring[:key]))
        orders.append(found[key])
    return orders


def bounded_loads(counts: dict[tuple[int, int], int], shards: int, slack: float = 0.0) -> list[tuple]:
    """Intervals (place, part, from rank, to rank, shard, slot of the first rank) for the counts of all parts."""
    total = sum(counts.values())
    room = [int((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]
    order, used = preferences(shards), [0] * shards
    parts, plan = sorted(counts), []
    left = dict.fromkeys(parts, 0)  # ranks already placed
    for turn in range(shards):
        for part in parts:
            rest = counts[part] - left[part]
            if rest:
                shard = order[part[0]][turn]
                take = min(rest, room[shard] - used[shard])
                if take > 0:
                    plan.append((*part, left[part], left[part] + take, shard, used[shard]))
                    left[part] += take
                    used[shard] += take
    return plan


def assign_shards(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text",
                  slack: float = 0.0) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``; slots of a shard run from 0 without a gap."""
    row = (
        docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        .select("id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
        .groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumn("place", F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 20), F.lit(PLACES)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(PARTS)).cast("int"))
    )
    row = shared_table(row, "ring")
    counts = {(r.place, r.part): r.n for r in row.groupBy("place", "part").agg(F.sum("n").alias("n")).collect()}
    kind = T.StructType([T.StructField(c, T.LongType() if c in ("low", "high", "base") else T.IntegerType())
                         for c in ("place", "part", "low", "high", "shard", "base")])
    plan = docs.sparkSession.createDataFrame(bounded_loads(counts, shards, slack), kind)
    upto = F.sum("n").over(
        Window.partitionBy("place", "part").orderBy("id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        row.withColumn("upto", upto).withColumn("rank", F.explode(F.expr("sequence(upto - n, upto - 1)")))
        .join(F.broadcast(plan), ["place", "part"]).where("rank >= low AND rank < high")
        .select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_column: str = "doc_id", text_column: str = "text",
                 slack: float = 0.0) -> None:
    """Write ``docs`` as one folder for each shard; rows that are equal in id and text go together."""
    checksum = F.crc32(F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8"))
    size = (F.octet_length(F.coalesce(F.col(text_column), F.lit(""))) + 16).cast("long")
    keys = (
        assign_shards(docs, shards, id_column, text_column, slack).groupBy("id", "size", "text_crc32")
        .agg(F.min("shard").alias("shard"))
    )
    on = docs[id_column].eqNullSafe(keys["id"]) & (size == keys["size"]) & (checksum == keys["text_crc32"])
    (
        docs.join(keys, on).select(*(docs[c] for c in docs.columns), keys["shard"].alias("_shard"))
        .write.partitionBy("_shard").parquet(path)
    )
