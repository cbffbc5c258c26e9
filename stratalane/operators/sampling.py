"""Random placement and permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from stratalane.operators.intervals import merged, running

ANSWER_BIN = 512
#: Bins of a reference up to which they are sent to every task; above it the join is Spark's own choice.
SENT_ROWS = 500_000


def cumulative_regions(regions: DataFrame, order: str, size: str) -> DataFrame:
    """regions with `first`, the sum of the sizes before each; a table of chromosomes or target regions, not of features."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("first", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("__next", F.col("first") + F.col(size))


def region_of(draws: DataFrame, regions: DataFrame, draw: str) -> DataFrame:
    """Each draw with the region that holds it; regions are few and go along as one sorted array."""
    listed = regions.agg(F.sort_array(F.collect_list(F.struct("first", "__next", F.struct(*(c for c in regions.columns if c not in ("first", "__next"))).alias("of")))).alias("__all"))
    hit = F.get(F.filter("__all", lambda r: (r["first"] <= F.col(draw)) & (F.col(draw) < r["__next"])), F.lit(0))
    return draws.crossJoin(F.broadcast(listed)).withColumn("__hit", hit).where("__hit IS NOT NULL").select(*draws.columns, "__hit.of.*", F.col("__hit.first").alias("first"))  # one row on the right


def relocated(features: DataFrame, regions: DataFrame, seed: int | Column) -> DataFrame:
    """Features moved to uniformly drawn places within regions (chrom, size) that hold them whole, without rejections.

    The eligible starts of a region are size - length - 1; a draw over their sum picks region and start at once.
    Features that fit no region are dropped. The draw is a hash of id and seed, so that a retried task repeats it.
    """
    number = F.lit(seed) if isinstance(seed, int) else seed
    listed = regions.agg(F.sort_array(F.collect_list(F.struct("chrom", "size"))).alias("__all"))
    length = F.col("e") - F.col("s")
    room = F.transform("__all", lambda r: F.greatest(F.lit(0), r["size"] - length - 1))
    rows = features.crossJoin(F.broadcast(listed)).withColumn("__room", room).withColumn("__sum", F.aggregate("__room", F.lit(0).cast("long"), lambda a, x: a + x)).where("__sum > 0")
    rows = rows.withColumn("__draw", F.pmod(F.xxhash64("id", number), "__sum"))
    walk = F.aggregate(
        F.arrays_zip("__all", "__room"),
        F.struct(F.col("__draw").alias("left"), F.lit(None).cast(regions.schema["chrom"].dataType).alias("chrom"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.when(a["chrom"].isNotNull(), a).when(a["left"] < x["__room"], F.struct(a["left"].alias("left"), x["__all"]["chrom"].alias("chrom"), (a["left"] + 1).alias("at"))).otherwise(F.struct((a["left"] - x["__room"]).alias("left"), a["chrom"].alias("chrom"), a["at"].alias("at"))),
    )
    rows = rows.withColumn("__to", walk)
    kept = [c for c in features.columns if c not in ("chrom", "s", "e")]
    return rows.select(F.col("__to.chrom").alias("chrom"), F.col("__to.at").alias("s"), (F.col("__to.at") + length).alias("e"), *kept)


def _redrawn(test: DataFrame, regions: DataFrame, rounds: int, spread: int) -> DataFrame:
    """test placed anew in each round, to the places that relocated() gives with the round as seed.

    What depends on lengths and regions is made once for a block of rounds; a round only looks up its draw among the summed rooms.
    """
    # Few features make many rows: blocks of rounds are dealt out first, while rows are short, to a number that stays as it is.
    block = max(1, rounds // 10)
    rows = test.withColumn("__from", F.explode(F.sequence(F.lit(1), F.lit(rounds), F.lit(block)))).repartition(spread, "chrom", "s", "e", "id", "__from")
    listed = regions.agg(F.sort_array(F.collect_list(F.struct("chrom", "size"))).alias("__all"))
    length = F.col("e") - F.col("s")
    room = F.transform("__all", lambda r: F.greatest(F.lit(0), r["size"] - length - 1))
    none = F.array().cast("array<bigint>")
    ends = F.aggregate("__room", none, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    rows = rows.crossJoin(F.broadcast(listed)).withColumn("__room", room).withColumn("__ends", ends).withColumn("__sum", F.get("__ends", F.size("__ends") - 1)).where("__sum > 0")
    rows = rows.withColumn("__chroms", F.col("__all.chrom")).drop("__room", "__all")
    rows = rows.withColumn("round", F.explode(F.sequence("__from", F.least(F.col("__from") + (block - 1), F.lit(rounds)))))
    rows = rows.withColumn("__draw", F.pmod(F.xxhash64("id", "round"), "__sum"))
    rows = rows.withColumn("__k", F.size(F.filter("__ends", lambda x: x <= F.col("__draw"))))
    rows = rows.withColumn("__at", F.col("__draw") - F.when(F.col("__k") > 0, F.get("__ends", F.col("__k") - 1)).otherwise(0) + 1)
    return rows.select(F.get("__chroms", "__k").alias("chrom"), F.col("__at").alias("s"), (F.col("__at") + length).alias("e"), "id", "__copies", "round")


def _answers(reference: DataFrame, reach: DataFrame) -> DataFrame:
    """The union of reference cut into bins: for every end of an interval up to reach (chrom, far), the one row with the last island that begins at or before it."""
    union = running(merged(reference), ("chrom",), ("s",), {"__next": ("min", "s")}, reverse=True)
    last = union.join(reach, "chrom").select("chrom", F.col("s").alias("__s"), F.col("e").alias("__e"), F.coalesce(F.col("__next") - 1, F.greatest("s", "far")).alias("__until"))
    return last.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / ANSWER_BIN), F.floor(F.col("__until") / ANSWER_BIN))))


def _mixed(seeds, numbers):
    """xxhash64 going on from hashes (unsigned) with 32-bit numbers (unsigned too), as Spark works it out."""
    import numpy as np

    one, two, three, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seeds + (five + np.uint64(4))) ^ (numbers * one)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * two + three
    h ^= h >> np.uint64(33)
    h *= two
    h ^= h >> np.uint64(29)
    h *= three
    h ^= h >> np.uint64(32)
    return h


def _counted(test: DataFrame, regions: DataFrame, islands: list[tuple], rounds: int, spread: int) -> DataFrame:
    """(round, placed, overlapping) of the rounds that _redrawn() makes, counted where they are drawn: no placement is a row.

    islands: the union of the reference, as (chrom, s, e). Of ids that occur several times, the rounds in which one of them
    overlaps go on as bits, 64 rounds a word, which are put together by id.
    """
    import numpy as np
    import pyarrow as pa

    listed = regions.agg(F.sort_array(F.collect_list(F.struct("chrom", "size")))).first()[0]
    sizes = np.array([r[1] or 0 for r in listed], np.int64)
    number = {c: k for k, c in enumerate(dict.fromkeys(r[0] for r in listed if r[0] is not None))}
    # Places of all chromosomes in one row; those of placed features lie between 1 and the largest size.
    far = int(sizes.max(initial=0)) + 2
    base = np.array([number.get(r[0], len(number)) * far for r in listed], np.int64)
    near = sorted((number[c] * far + max(s, 0), number[c] * far + min(e, far - 1)) for c, s, e in islands if c in number and e >= 1 and s < far)
    begins, stops = np.array([-1, *(a for a, _ in near)], np.int64), np.array([-1, *(z for _, z in near)], np.int64)
    kind = test.schema["id"].dataType
    schema = StructType().add("round", "integer").add("placed", "long").add("hit", "long").add("id", kind).add("k", "integer").add("word", "long")
    many = max(1, (1 << 17) // max(1, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, rounds + 1, dtype=np.uint64)
        placed, hits = 0, np.zeros(rounds, np.int64)
        for batch in batches:
            # Rows without a length fit nowhere.
            batch = batch.filter(batch["length"].is_valid())
            seeds, lengths, copies = (batch[c].to_numpy(zero_copy_only=False) for c in ("seed", "length", "copies"))
            order = np.argsort(lengths, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                length = int(lengths[order[a]])
                room = np.maximum(0, sizes - length - 1)
                ends = np.cumsum(room)
                if not len(ends) or ends[-1] <= 0:
                    continue
                placed += z - a
                if length < 0:
                    continue
                # From a draw to its place among all chromosomes.
                shift = base - (ends - room) + 1
                for i in range(a, z, many):
                    rows = order[i : min(i + many, z)]
                    draws = (_mixed(seeds[rows].view(np.uint64)[:, None], numbers).view(np.int64) % ends[-1]).ravel()
                    at = draws + shift[np.searchsorted(ends, draws, "right")]
                    hit = (stops[np.searchsorted(begins, at + length, "right") - 1] >= at).reshape(len(rows), rounds)
                    hits += np.count_nonzero(hit[copies[rows] == 1], axis=0)
                    if len(again := np.flatnonzero(copies[rows] > 1)):
                        bits = np.zeros((len(again), -(-rounds // 64) * 64), bool)
                        bits[:, :rounds] = hit[again]
                        words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                        row, k = np.nonzero(words)
                        none = pa.nulls(len(k))
                        yield pa.RecordBatch.from_arrays([none.cast("int32"), none.cast("int64"), none.cast("int64"), batch["id"].take(pa.array(rows[again[row]])), pa.array(k, pa.int32()), pa.array(words[row, k], pa.int64())], names=schema.names)
        none = pa.nulls(rounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1), pa.int32()), pa.array(np.full(rounds, placed), pa.int64()), pa.array(hits, pa.int64()), none.cast(to_arrow_type(kind)), none.cast("int32"), none.cast("int64")], names=schema.names)

    rows = test.repartition(spread, "chrom", "s", "e", "id").select(F.xxhash64("id").alias("seed"), (F.col("e") - F.col("s")).cast("long").alias("length"), F.coalesce("__copies", F.lit(0).cast("long")).alias("copies"), F.when(F.col("__copies") > 1, F.col("id")).alias("id"))
    found = rows.mapInArrow(run, schema).groupBy("round", "id", "k").agg(F.sum("placed").alias("placed"), F.sum("hit").alias("hit"), F.bit_or("word").alias("word"))
    at = lambda n, placed, hit: F.struct(n.cast("int").alias("round"), placed.cast("long").alias("placed"), hit.cast("long").alias("hit"))
    bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.getbit("word", j) == 1), lambda j: at(F.col("k") * 64 + j + 1, F.lit(0), F.lit(1)))
    counts = found.select(F.explode(F.when(F.col("k").isNull(), F.array(at(F.col("round"), F.col("placed"), F.col("hit")))).otherwise(bits)).alias("x")).select("x.*")
    return counts.groupBy("round").agg(F.sum("placed").alias("placed"), F.sum("hit").alias("overlapping")).where("placed > 0")


def permutation_overlaps(test: DataFrame, reference: DataFrame, regions: DataFrame, rounds: int = 1000) -> DataFrame:
    """(round, placed, overlapping): distinct test ids that overlap the reference; round 0 is as observed, others are shuffled.

    Whether a feature overlaps is asked of the reference's union, of which one island at most can tell, however deep the
    reference lies. Rounds are counted in arrays, a batch of features at a time; where the union has too many islands to be
    sent to every task, placements are rows that are joined to it.
    """
    spark = test.sparkSession
    test = test.select("chrom", "s", "e", "id")
    test = test.join(test.groupBy("id").agg(F.count("*").alias("__copies")), "id", "left")
    reference = reference.select("chrom", "s", "e").where("s <= e")
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    observed = test.withColumn("round", F.lit(0))
    islands = merged(reference.where("chrom IS NOT NULL")).select("chrom", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).limit(SENT_ROWS + 1).toArrow()
    if islands.num_rows <= SENT_ROWS:
        drawn = _counted(test, regions, list(zip(*(c.to_pylist() for c in islands.columns))), rounds, spread)
        return _asked(observed, test, reference, regions).unionByName(drawn)
    return _asked(_redrawn(test, regions, rounds, spread).unionByName(observed), test, reference, regions)


def _asked(every: DataFrame, test: DataFrame, reference: DataFrame, regions: DataFrame) -> DataFrame:
    """(round, placed, overlapping) of placements that are rows, by a join to the reference's union."""
    reach = regions.select("chrom", F.col("size").alias("far")).unionByName(test.select("chrom", F.col("e").alias("far"))).groupBy("chrom").agg(F.max("far").alias("far"))
    answers = _answers(reference, reach)
    if answers.count() <= SENT_ROWS:
        answers = F.broadcast(answers)
    answers = answers.withColumnRenamed("chrom", "__chrom")
    met = (F.col("chrom") == F.col("__chrom")) & (F.floor(F.col("e") / ANSWER_BIN) == F.col("__bin")) & F.col("e").between(F.col("__s"), F.col("__until"))
    asked = every.join(answers, met, "left").withColumn("__hit", F.coalesce((F.col("__e") >= F.col("s")) & (F.col("s") <= F.col("e")), F.lit(False)))
    # Ids that occur once are counted as rows; only the others have to be told apart.
    once, again = (F.count(F.when(F.col("__hit") & (F.col("__copies") == 1), 1)), F.count_distinct(F.when(F.col("__hit") & (F.col("__copies") > 1), F.col("id"))))
    return asked.groupBy("round").agg(F.count("*").alias("placed"), (once + again).alias("overlapping"))
