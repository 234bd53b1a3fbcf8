"""Consistent-hash ring with virtual nodes and bounded loads.

A key hashes to one of ``RING_SLOTS`` slots; the next virtual node clockwise owns the slot. Shards
have quotas; keys that a full shard can't take continue clockwise to the next shard with room. The
ring is planned on counts per slot (at most ``RING_SLOTS`` numbers, whatever the table's size), and
the plan is joined to the keys as ranges of ranks inside a slot.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm._common import materialise

RING_SLOTS = 1 << 14


def ring_owners(n_shards: int, vnodes: int = 64, seed: str = "ring") -> list[int]:
    """Owner of each slot. A shard's points depend on its number alone, so one more shard only adds points."""
    points: dict[int, tuple[str, int]] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{seed}/{shard}/{v}".encode()).hexdigest()
            slot = int(digest[:8], 16) % RING_SLOTS
            points[slot] = min(points.get(slot, ("~", -1)), (digest, shard))
    owners, nearest = [0] * RING_SLOTS, points[min(points)][1]
    for slot in range(RING_SLOTS - 1, -1, -1):
        if slot in points:
            nearest = points[slot][1]
        owners[slot] = nearest
    return owners


def quotas(total: int, n_shards: int) -> list[int]:
    q, r = divmod(total, n_shards)
    return [q + (s < r) for s in range(n_shards)]


def plan_ring(counts: dict[int, int], owners: list[int], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (ring_slot, first rank, last rank, shard, first place in the shard).

    First each shard takes keys of its own slots in ring order until it is full. What is left over
    then goes clockwise, in order, to the next shard that has room. Ranks count from 1.
    """
    if sum(limits) < sum(counts.values()):
        raise ValueError("the quotas hold fewer keys than there are")
    room, filled, pieces = list(limits), [0] * len(limits), []

    def put(slot: int, first: int, n: int, shard: int) -> None:
        pieces.append((slot, first, first + n - 1, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    over: dict[int, tuple[int, int]] = {}
    for slot in sorted(counts):
        shard = owners[slot]
        if taken := min(counts[slot], room[shard]):
            put(slot, 1, taken, shard)
        if counts[slot] > taken:
            over[slot] = (taken + 1, counts[slot] - taken)
    carried: deque[tuple[int, int, int]] = deque()
    for step in range(2 * len(owners)):
        slot = step % len(owners)
        if step < len(owners) and slot in over:
            carried.append((slot, *over[slot]))
        shard = owners[slot]
        while carried and room[shard]:
            origin, first, n = carried.popleft()
            taken = min(n, room[shard])
            put(origin, first, taken, shard)
            if n > taken:
                carried.appendleft((origin, first + taken, n - taken))
    # a shard without a point of its own still counts in the quotas
    for shard in range(len(limits)):
        while carried and room[shard]:
            origin, first, n = carried.popleft()
            taken = min(n, room[shard])
            put(origin, first, taken, shard)
            if n > taken:
                carried.appendleft((origin, first + taken, n - taken))
    return pieces


def ring_key(id_col: str, fallback: Column) -> Column:
    """64-bit place of a key on the ring; rows without an id are placed by ``fallback``."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("id:"), F.col(id_col).cast("string")), F.concat(F.lit("no id:"), fallback.cast("string"))))


def assign_shards(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, most: int = 1 << 16) -> DataFrame:
    """Adds (id, size, text_crc32, ring_slot, shard, slot) for every row of ``df``.

    Shard counts differ by one at most. ``size`` is the UTF-8 bytes of the text plus 8. Null texts
    count as empty; null ids are placed by their text's checksum and size; repeated rows each take a
    place; an empty table gives an empty result. Only these columns are read, so any further columns,
    whatever their names, do no harm and are not returned. The text is read once: what is needed of a
    row is written to the shared folder. A ring slot with more than ``most`` rows (of one repeated id, say), or
    than 4 slots have on average, is ranked in parts by a hash of the row, so no task gets all of it.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keys = df.select(F.col(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = keys.withColumn("_key", ring_key(id_col, F.concat_ws("/", "text_crc32", "size")))
    keys = keys.withColumn("ring_slot", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(RING_SLOTS)).cast("int"))
    keys = materialise(keys.withColumn("_row", F.xxhash64("_key", F.monotonically_increasing_id())), "shards-keys")
    counts = {r["ring_slot"]: r["count"] for r in keys.groupBy("ring_slot").count().collect()}
    total = sum(counts.values())
    most = max(most, 4 * total // RING_SLOTS)
    crowded = [(slot, -(-n // most)) for slot, n in counts.items() if n > most]
    part, before = F.lit(0), F.lit(0)
    if crowded:  # at most RING_SLOTS / 4 slots, with RING_SLOTS / 4 further parts
        keys = keys.join(F.broadcast(spark.createDataFrame(crowded, "_crowded int, _parts int")), F.col("ring_slot") == F.col("_crowded"), "left")
        part = F.pmod("_row", F.coalesce("_parts", F.lit(1))).cast("int")
        sizes, offset, starts = keys.where("_parts is not null").groupBy("ring_slot", part.alias("_part")).count().collect(), {}, []
        for r in sorted(sizes):
            starts.append((r["ring_slot"], r["_part"], offset.get(r["ring_slot"], 0)))
            offset[r["ring_slot"]] = starts[-1][2] + r["count"]
        begins = F.broadcast(spark.createDataFrame(starts, "_s int, _p int, _before long"))
        keys = keys.withColumn("_part", part).join(begins, (F.col("ring_slot") == F.col("_s")) & (F.col("_part") == F.col("_p")), "left")
        part, before = F.col("_part"), F.coalesce("_before", F.lit(0))
    keys = keys.select(id_col, "size", "text_crc32", "_key", "_row", "ring_slot", part.alias("_part"), before.cast("long").alias("_before"))
    plan = spark.createDataFrame(plan_ring(counts, ring_owners(n_shards, vnodes), quotas(total, n_shards)), "_slot int, _first long, _last long, shard int, _base long")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("ring_slot", "_part").orderBy("_key", "_row"))
    ranked = keys.withColumn("_rank", rank)
    joined = ranked.join(
        F.broadcast(plan),  # at most RING_SLOTS + n_shards pieces
        (F.col("ring_slot") == F.col("_slot")) & F.col("_rank").between(F.col("_first"), F.col("_last")),
    )
    return joined.select(id_col, "size", "text_crc32", "ring_slot", "shard", (F.col("_base") + F.col("_rank") - F.col("_first")).alias("slot"))
