"""Proportional stratified interleaving into shards.

Rows are shuffled within their source by a seeded hash and ranked; rank k of n gives the
fractional rank (2k - 1) / 2n. Sorting all rows by it interleaves the sources in proportion
and any cut of that order into equal parts matches the mixture, so the order is cut into
shards whose counts are at most one apart (law ``rows``). The shuffle's hash is that of the
group, so copies of a text have neighbouring ranks in their source, and about the same
fractional rank in every other; there they take that of the first of them. So a group is in
one shard, but for the one on which a cut falls, which no law of equal counts can avoid,
and for groups of more than ``HEAVY`` bins, which lie in neighbouring shards.

No rank is taken over a whole source, nor over the whole table: both are counted per bin,
the counts are summed up to offsets, and rows are numbered within their bin only. The bins
of a source are slices of the hash; one that a large group has made heavy is cut further by
the rows' own hashes. Those of the order are slices of the fractional rank, which is spread
evenly by construction. So neither a source nor a group with a third of all rows is a task,
and texts are reduced to size and checksums before a shuffle.

Defined results: a null text has size 1 and the checksum of no bytes, and is in the group of
empty texts; null sources are a source of their own; rows that are alike in id and text are
interchangeable and get one slot each; an empty table has no shards; very long texts are
read whole; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gablestone.llm.common import Scratch, free_prefix, read

SHARDS = 16
#: Rows that a bin holds on average, times that of a heavy bin, and the most heavy bins that there can be.
BIN_ROWS, HEAVY, HEAVY_BINS = 500, 8, 1 << 16
#: Parts of a group when its rows look up its rank.
SALT = 16


def _offsets(counts: DataFrame, by: list[str], bins: list[str], n: str, p: str) -> DataFrame:
    """counts with the rows before each bin in the order of ``bins`` ({p}before) and in all ({p}all).

    Summed in two levels, so that no task gets more than the bins of a thousand bins.
    """
    hi, m = f"{p}hi", f"{p}m"
    counts = counts.withColumn(hi, F.shiftright(F.col(bins[0]), 10))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    high = counts.groupBy(*by, hi).agg(F.sum(n).alias(m))
    high = high.withColumn(f"{p}base", F.sum(m).over(upto(*by).orderBy(hi)) - F.col(m)).withColumn(f"{p}all", F.sum(m).over(Window.partitionBy(*by))).drop(m)
    low = counts.withColumn(f"{p}in", F.sum(n).over(upto(*by, hi).orderBy(*bins)) - F.col(n))
    return low.join(high, [*by, hi]).withColumn(f"{p}before", F.col(f"{p}base") + F.col(f"{p}in")).select(*by, *bins, f"{p}before", f"{p}all")


def interleave(rows: DataFrame, stratum: str, ties: list[Column], shards: int = SHARDS, seed: int = 7, bin_rows: int = BIN_ROWS, group: Column | None = None) -> DataFrame:
    """rows with ``shard`` and ``slot``; ``ties`` order rows of a stratum whose hashes are equal.

    Rows of one ``group`` (by default each row is its own) are neighbours in their stratum.
    ``rows`` should be narrow: they are shuffled twice and written once.
    """
    p = free_prefix(rows)
    s, h, hb, sub, k, f, fb = (p + x for x in ("stratum", "h", "hb", "sub", "k", "f", "fb"))
    scratch = Scratch(rows.sparkSession)
    seeded = rows.withColumn(s, F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))).withColumn(h, F.xxhash64(F.lit(seed), *([group] if group is not None else ties)))
    seeded = scratch.write(seeded, "seeded")
    total = seeded.count()
    bins = max(1, -(-total // bin_rows))
    # Bins are slices of the hash in its order, so that groups near each other in it stay near in all strata.
    share = (F.shiftrightunsigned(h, 11) / float(1 << 53)).cast("double")
    seeded = seeded.withColumn(hb, F.least(F.floor(share * bins), F.lit(bins - 1)).cast("long"))

    # Rank within the stratum: rows of earlier bins, and those before in its own.
    per_bin = seeded.groupBy(s, hb).agg(F.count("*").alias(f"{p}n"))
    least = max(HEAVY * bin_rows, total // HEAVY_BINS)  # so there are at most HEAVY_BINS of them
    heavy = per_bin.where(F.col(f"{p}n") > least).select(s, hb, F.ceil(F.col(f"{p}n") / bin_rows).alias(f"{p}parts"))
    own = F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), *ties), 12), F.col(f"{p}parts"))
    seeded = seeded.join(F.broadcast(scratch.write(heavy, "heavy")), [s, hb], "left").withColumn(sub, F.coalesce(own, F.lit(0).cast("long"))).drop(f"{p}parts")
    whole = _offsets(seeded.groupBy(s, hb, sub).agg(F.count("*").alias(f"{p}n")), [s], [hb, sub], f"{p}n", p)
    ranked = seeded.withColumn(f"{p}i", F.row_number().over(Window.partitionBy(s, hb, sub).orderBy(h, *ties)))
    ranked = ranked.join(whole, [s, hb, sub]).withColumn(k, F.col(f"{p}before") + F.col(f"{p}i"))
    ranked = ranked.withColumn(f, (2 * F.col(k) - 1) / (2 * F.col(f"{p}all")))
    ranked = scratch.write(ranked.drop(f"{p}i", f"{p}before", f"{p}all", hb, sub), "ranked")
    scratch.drop("seeded")

    # Rows of a group that isn't itself as large as several bins take the rank of its first.
    if group is not None:
        several = ranked.groupBy(h).agg(F.count("*").alias(f"{p}n"), F.min(f).alias(f"{p}first")).where((F.col(f"{p}n") > 1) & (F.col(f"{p}n") <= HEAVY * bin_rows))
        salt = F.pmod(F.xxhash64(F.lit(seed + 2), *ties), F.lit(SALT))
        several = several.select(h, f"{p}first").withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        ranked = ranked.withColumn(f"{p}salt", salt).join(several, [h, f"{p}salt"], "left").withColumn(f, F.coalesce(f"{p}first", f)).drop(f"{p}first", f"{p}salt")
        ranked = scratch.write(ranked, "grouped")
        scratch.drop("ranked")
    ranked = ranked.withColumn(fb, F.least(F.floor(F.col(f) * bins), F.lit(bins - 1)))

    # Place in the whole order, in the same way.
    starts = _offsets(ranked.groupBy(fb).agg(F.count("*").alias(f"{p}n")), [], [fb], f"{p}n", p).drop(f"{p}all")
    placed = ranked.withColumn(f"{p}i", F.row_number().over(Window.partitionBy(fb).orderBy(f, h, s, k)))
    # One row a bin: as many as the table's rows by bin_rows.
    placed = placed.join(starts, fb).withColumn(f"{p}at", F.col(f"{p}before") + F.col(f"{p}i") - 1)
    shard = F.expr(f"cast({p}at * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(cast({p}at * {shards} div {max(1, total)} as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.select(*rows.columns, shard.alias("shard"), (F.col(f"{p}at") - first).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select("doc_id", "source", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"))
    out = interleave(rows, "source", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], group=F.col("text_hash"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
