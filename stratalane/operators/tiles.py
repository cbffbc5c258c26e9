"""Regions beside the points of a track, without a row for each pair of them.

Regions are filed by the tile in which they begin, and the points of a tile and of the one after it go there in packed
blocks. A partition streams through its tiles in order and holds the points of one tile and a batch of regions at a time,
so what is shuffled grows with regions and points, not with their pairs, and a tile may have any number of regions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a tile and of a packed block of points; regions longer than a tile have to be met in another way.
TILE, BLOCK = 4096, 256
#: Regions of a tile from which on they are dealt to several places, each with the tile's points.
CROWD = 100_000
#: Pairs of a region and a point that are held at a time.
PAIRS = 1 << 20


def beside(regions: DataFrame, points: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(payload, places, values) for regions (chrom, first, last, payload) and the points (chrom, pos, v) near them.

    regions reach from first to last, both included, in less than TILE positions. work gets a struct array of payloads,
    all points of their tile in order of their places, one a place, and yields record batches of `schema`.
    """
    import pyarrow as pa

    spark = regions.sparkSession
    filed = regions.where("chrom IS NOT NULL").select("chrom", F.floor(F.col("first") / TILE).alias("tile"), "payload")
    tiles = filed.groupBy("chrom", "tile").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("deals"))
    crowded = tiles.where("deals > 1")  # at most regions / CROWD rows
    deal = F.pmod(F.xxhash64("payload"), F.coalesce("deals", F.lit(1))).cast("int")
    filed = filed.join(F.broadcast(crowded), ["chrom", "tile"], "left").select("chrom", "tile", deal.alias("deal"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("block"), "payload")
    packed = points.where("pos IS NOT NULL").groupBy("chrom", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("points"))
    packed = packed.withColumn("tile", F.explode(F.array(*(F.floor(F.col("block") * BLOCK / TILE) - k for k in (0, 1)))))
    dealt = lambda df: df.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    given = dealt(packed.join(tiles, ["chrom", "tile"])).select("chrom", "tile", "deal", F.lit(0).alias("kind"), "block", "points")
    # Each tile begins with a row of its own, so that one without points does not take those of the one before.
    heads = dealt(tiles).select("chrom", "tile", "deal", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("block"))
    rows = filed.unionByName(given, True).unionByName(heads, True).select("chrom", "tile", "deal", "kind", "block", F.col("points.pos").alias("pos"), F.col("points.v").alias("v"), "payload")
    # As many partitions as asked for, whatever their bytes: work is heavy for few bytes.
    rows = rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chrom", "tile", "deal").sortWithinPartitions("chrom", "tile", "deal", "kind", F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        places: list = []
        values: list = []
        held = None
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if kinds[a] == 0:
                    if held is not None:
                        places, values, held = [], [], None
                    places.append(pa.array(batch["pos"].slice(a, z - a).flatten()))
                    values.append(pa.array(batch["v"].slice(a, z - a).flatten()))
                else:
                    if held is None:
                        held = pa.concat_arrays(places).to_numpy(zero_copy_only=False), pa.concat_arrays(values)
                    yield from work(batch["payload"].slice(a, z - a), *held)

    return rows.select("kind", "pos", "v", "payload").mapInArrow(run, schema)


def chunks(lengths, most: int = PAIRS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to `most` or a little more."""
    import numpy as np

    upto = np.cumsum(lengths)
    a = 0
    while a < len(upto):
        z = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most)) + 1
        yield a, min(z, len(upto))
        a = z


def met(places, first, last):
    """(k, i): for each of the stretches from first to last, both included, its number and the indices of places in it."""
    import numpy as np

    low, high = np.searchsorted(places, first), np.searchsorted(places, last, "right")
    n = np.maximum(high - low, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) + np.repeat(low - (np.cumsum(n) - n), n)
