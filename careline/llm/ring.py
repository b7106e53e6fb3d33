"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Only DataFrame operations. The ring has shards * vnodes arcs, whatever the size of the
table: counts per arc are small, and all planning is done on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions on the ring: 60 bits of an md5.
RING = 1 << 60
#: Bits of a position below its cell; keys meet arcs by cell.
CELL_BITS = 48


def position(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def arcs(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(arc, shard, lo, hi): positions above lo up to hi belong to the virtual node at hi.

    Arc 0 also takes what lies above the last node; its lo is that node, above its hi.
    """
    nodes = spark.range(shards * vnodes, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.floor(F.col("id") / shards).alias("v"))
    nodes = nodes.withColumn("hi", position(F.concat_ws("/", F.lit("shard"), "shard", "v")))
    order = Window.orderBy("hi", "shard", "v")
    nodes = nodes.select("shard", "hi", (F.row_number().over(order) - 1).alias("arc"),
                         F.lag("hi").over(order).alias("before"),
                         F.max("hi").over(Window.partitionBy()).alias("last"))
    return nodes.select("arc", "shard", F.coalesce("before", "last").alias("lo"), "hi")


def _placed(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """`keys` (with pos) with their arc and how far they lie behind its start."""
    pieces = ring.filter("lo < hi").select("arc", "lo", "lo", "hi").toDF("arc", "start", "lo", "hi")
    wrap = ring.filter("lo >= hi")
    pieces = (pieces
              .unionByName(wrap.select("arc", F.col("lo").alias("start"),
                                       F.lit(-1).cast("long").alias("lo"), "hi"))
              .unionByName(wrap.select("arc", F.col("lo").alias("start"), "lo",
                                       F.lit(RING - 1).alias("hi"))))
    cells = pieces.filter("lo < hi").select("*", F.explode(F.sequence(
        F.shiftright(F.col("lo") + 1, CELL_BITS), F.shiftright("hi", CELL_BITS))).alias("cell"))
    # At most one row an arc and one a cell: about 10,000 short rows.
    return (keys.withColumn("cell", F.shiftright("pos", CELL_BITS))
            .join(F.broadcast(cells), "cell")
            .filter("pos > lo AND pos <= hi")
            .withColumn("way", F.pmod(F.col("pos") - F.col("start"), F.lit(RING)))
            .drop("cell", "lo", "hi", "start"))


def _plan(ring: DataFrame, loads: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """(arc, rank_from, rank_to, shard, base): where the keys of an arc go, by rank.

    A shard's capacity is the total divided by the shards, up or down. An arc of a full
    shard keeps its fair part of the capacity; the keys behind it go on clockwise, first
    come first served, to the next nodes of shards with room. The scan starts where the
    excess seen so far is least, so no key ever has to pass its start.
    """
    ring_order = Window.orderBy("arc")
    of_shard = Window.partitionBy("shard")
    along = of_shard.orderBy("arc")
    t = (ring.join(F.broadcast(loads), "arc", "left")
         .select("arc", "shard", F.coalesce("load", F.lit(0)).cast("long").alias("load"))
         .withColumn("total", F.sum("load").over(Window.partitionBy()))
         .withColumn("demand", F.sum("load").over(of_shard))
         .withColumn("seen", F.sum("load").over(along))
         .withColumn("k", F.row_number().over(along))
         .withColumn("cap", F.expr(f"total div {shards}")
                     + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0))
         .withColumn("room", F.col("cap") - F.col("demand")))
    t = t.withColumn("keep", F.when(
        F.col("room") < 0,
        F.expr("CAST(CAST(seen AS DECIMAL(19,0)) * CAST(cap AS DECIMAL(19,0)) DIV demand AS LONG)"
               " - CAST(CAST(seen - load AS DECIMAL(19,0)) * CAST(cap AS DECIMAL(19,0)) DIV demand"
               " AS LONG)")).otherwise(
        F.col("load") + F.expr(f"k * room div {vnodes} - (k - 1) * room div {vnodes}")))
    t = (t.withColumn("excess", F.greatest(F.col("load") - F.col("keep"), F.lit(0)))
         .withColumn("free", F.greatest(F.col("keep") - F.col("load"), F.lit(0)))
         .withColumn("e", F.sum("excess").over(ring_order))
         .withColumn("f", F.sum("free").over(ring_order)))
    all_arcs = Window.partitionBy()
    t = (t.withColumn("low", F.min(F.struct(F.col("e") - F.col("f"), "arc", "e", "f"))
                      .over(all_arcs))
         .withColumn("moved", F.sum("excess").over(all_arcs))
         .withColumn("turn", F.when(F.col("arc") > F.col("low.arc"), 0).otherwise(F.col("moved")))
         .withColumn("e_to", F.col("e") - F.col("low.e") + F.col("turn"))
         .withColumn("f_to", F.col("f") - F.col("low.f") + F.col("turn")))
    marks = (t.filter("excess > 0").select(
                 (F.col("e_to") - F.col("excess")).alias("at"), "arc", "keep",
                 F.lit(None).cast("int").alias("target"), "moved")
             .unionByName(t.filter("free > 0").select(
                 (F.col("f_to") - F.col("free")).alias("at"), F.lit(None).cast("int").alias("arc"),
                 F.lit(None).cast("long").alias("keep"), F.col("shard").alias("target"),
                 "moved")))
    queue = Window.orderBy("at")
    upto = queue.rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col("arc").isNotNull(), F.struct("arc", "keep", "at")),
                    ignorenulls=True).over(upto)
    moves = (marks.select("at", F.lead("at", 1).over(queue).alias("next"), "moved",
                          source.alias("source"),
                          F.last("target", ignorenulls=True).over(upto).alias("target"))
             .withColumn("next", F.coalesce("next", "moved"))
             .filter("next > at")
             .select(F.col("source.arc").alias("arc"),
                     (F.col("source.keep") + F.col("at") - F.col("source.at")).alias("rank_from"),
                     (F.col("source.keep") + F.col("next") - F.col("source.at")).alias("rank_to"),
                     F.col("target").alias("shard")))
    stays = t.select("arc", F.lit(0).cast("long").alias("rank_from"),
                     F.least("load", "keep").alias("rank_to"), "shard").filter("rank_to > 0")
    pieces = stays.unionByName(moves)
    size = F.col("rank_to") - F.col("rank_from")
    return pieces.withColumn("base", F.sum(size).over(
        Window.partitionBy("shard").orderBy("arc", "rank_from")) - size)


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard), a row each.

    Law `rows`: shard sizes differ by one row at most. home_shard is the shard whose arc the
    id lies in; a row is elsewhere only if that shard is full. slot numbers the rows of a shard
    from 0 without gaps. A NULL text has size 8 and the checksum of no bytes, an id of NULL lies where
    an empty text would. Repeated rows get slots of their own. An empty table gives none. Other
    columns are ignored. `shards * vnodes` rows are planned and broadcast, whatever the table.
    """
    ring = arcs(docs.sparkSession, shards, vnodes)
    doc_id, text = F.col("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    pos = position(F.coalesce(doc_id.cast("string"), F.lit("")))
    loads = (_placed(docs.select(pos.alias("pos")), ring)
             .groupBy("arc").agg(F.count("*").alias("load")))
    plan = _plan(ring, loads, shards, vnodes)
    keys = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), pos.alias("pos"))
    rank = F.row_number().over(Window.partitionBy("arc").orderBy(
        "way", "doc_id", "text_crc32", "size")) - 1
    ranked = _placed(keys, ring).withColumn("rank", rank)
    home = F.broadcast(ring.select("arc", F.col("shard").alias("home_shard")))
    # Pieces: at most one an arc that stays, and two an arc for what moves on.
    return (ranked.join(F.broadcast(plan), "arc")
            .filter("rank >= rank_from AND rank < rank_to")
            .join(home, "arc")
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("base") + F.col("rank") - F.col("rank_from")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "home_shard"))
