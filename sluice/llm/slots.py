"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stage


def slot_of(id_col: str, text_col: str, slots: int) -> Column:
    """Virtual slot of a row: the hash of its id, or of its text where the id is null. It never changes."""
    return F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(slots)).cast("int")


def rebalance(weight: dict[int, int], owner: dict[int, int], shards: int) -> dict[int, int]:
    """The map after moving as few bytes as it takes to even out the shards.

    Works on one number per slot, never on rows. While it narrows the gap, the slot nearest to half the gap
    goes from the fullest to the emptiest shard. With more shards than before, slots move only where they even things out.
    """
    owner = dict(owner)
    load, held = [0] * shards, [set() for _ in range(shards)]
    for slot, shard in owner.items():
        load[shard] += weight.get(slot, 0)
        if weight.get(slot, 0):
            held[shard].add(slot)
    while True:
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        fitting = [s for s in held[full] if weight[s] < gap]
        if not fitting:
            return owner
        slot = min(fitting, key=lambda s: (abs(2 * weight[s] - gap), s))
        owner[slot] = empty
        held[full].remove(slot)
        held[empty].add(slot)
        load[full] -= weight[slot]
        load[empty] += weight[slot]


def map_version(spark: SparkSession, totals: list, shards: int, slots: int, earlier: DataFrame | None = None) -> DataFrame:
    """The next version of the map: (version, slot, shard, bytes, rows), one row per slot.

    Without an earlier version slot ``s`` starts at shard ``s % shards``. ``totals`` are the (slot, bytes, rows) of the slots.
    """
    weight, rows = {t["slot"]: t["bytes"] for t in totals}, {t["slot"]: t["rows"] for t in totals}
    version, owner = 0, {s: s % shards for s in range(slots)}
    if earlier is not None:
        for row in earlier.collect():  # one row per slot
            version, owner[row["slot"]] = row["version"], row["shard"]
    owner = rebalance(weight, owner, shards)
    return spark.createDataFrame(
        [(version + 1, s, owner[s], weight.get(s, 0), rows.get(s, 0)) for s in range(slots)],
        "version int, slot int, shard int, bytes long, rows long")


def shard_by_slots(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, slots: int = 4096, earlier: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(assignment, map): where each row of ``docs`` goes, and the stored version of the slot map that says so.

    The assignment has (doc_id, size, text_crc32, shard, slot, virtual_slot): size is the UTF-8 bytes of the text plus one (null: one), crc32
    is unsigned over the UTF-8 bytes (null: of none), slot is the row's place in its shard, from 0 without gaps, by virtual slot
    and id. Bytes are added up per virtual slot; the map of ``slots`` rows, a number that does not grow with the data, is edited from its
    earlier version until no move evens the shards out further, and is written to the shared folder. Shards then differ by less
    than the smallest slot that the fullest one could give.

    Only narrow rows are shuffled, by virtual slot: ids are hashed, so no source, text or group of copies fills a slot. Null
    ids are spread by their texts. Repeated rows share a virtual slot and get places of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(id_col, text_col, slots).alias("virtual_slot"))
    rows = stage(rows, "slot-rows")
    totals = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    table = stage(map_version(spark, totals.collect(), shards, slots, earlier).coalesce(1), "slot-map")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = table.select(
        F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    out = rows.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(placed), "virtual_slot")  # one row per slot
    return out.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"), "virtual_slot"), table


def write_shards(docs: DataFrame, path: str, id_col: str, text_col: str, table: DataFrame, slots: int) -> None:
    """Writes the rows below ``path/shard=N`` by a stored map; each shard is written by as many tasks as it has slots or fewer."""
    shard, slot = "shard", "virtual_slot"
    placed = docs.withColumn(slot, slot_of(id_col, text_col, slots)).join(
        F.broadcast(table.select(F.col("slot").alias(slot), shard)), slot)
    placed.repartition(slot).drop(slot).write.partitionBy(shard).parquet(path)
