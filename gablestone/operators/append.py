"""Appending predictions to a target, with schema, integrity and idempotence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types that must be the same again when results come back."""
    return [(c.lower(), t) for c, t in df.dtypes]


def missing_fields(needed: DataFrame, fields: str = "fields", have: str = "have") -> DataFrame:
    """needed with the fields that aren't there."""
    return needed.withColumn("missing", F.array_except(fields, have)).withColumn("valid", F.size(F.array_except(fields, have)) == 0)


def append(target: DataFrame, predicted: DataFrame, key: str = "fid", read_only: tuple[str, ...] = (), first_new: Column | None = None) -> DataFrame:
    """target and, below it, predicted with the columns that both have by name.

    Keys and read-only columns aren't taken; what only the target has is null; values are
    cast to the target's types, integers half to even. ``first_new`` numbers the new rows.
    """
    types = dict(target.dtypes)
    common = [c for c in predicted.columns if c in types and c != key and c not in read_only]
    whole = ("int", "bigint", "smallint", "tinyint")
    cast = lambda c: (F.bround(F.col(c).cast("double"), 0) if types[c] in whole else F.col(c)).cast(types[c])
    new = predicted.select(*([first_new.cast(types[key]).alias(key)] if first_new is not None and key in types else []), *[cast(c).alias(c) for c in common])
    return target.unionByName(new, allowMissingColumns=True).select(*target.columns)


def counted(result: DataFrame, target: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: whether the result has as many rows as its parts."""
    names = ("total", "existing", "added")
    one = lambda df, c: df.agg(F.count("*").alias("n")).select(*[(F.col("n") if c == x else F.lit(0).cast("long")).alias(x) for x in names])
    row = one(result, "total").union(one(target, "existing")).union(one(predicted, "added")).agg(*[F.sum(x).alias(x) for x in names])
    return row.withColumn("complete", F.col("total") == F.col("existing") + F.col("added"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys), keys, "left_anti")


def height_failures(reasons: DataFrame) -> DataFrame:
    """One row: rows, failures, and a map of the reasons' counts."""
    per = reasons.groupBy("reason").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("reason") != "ok", F.col("n"))), F.lit(0)).alias("failed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def verified(manifests: DataFrame, contents: DataFrame) -> DataFrame:
    """manifests with ``valid``: complete, named, with a count, and its file of that size and hash."""
    have = contents.select("job_id", F.length("content").cast("long").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    ok = F.col("complete") & (F.col("new_layer") == "predicted_buildings") & (F.col("feature_count") >= 0) & (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha"))
    return manifests.join(have, "job_id", "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_bytes", "_sha")


def assembled(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (job_id, bytes, sha256) with ``valid``: the job's chunks (job_id, seq, content)
    follow each other without a gap from 0, and together have that size and that hash.

    A job's chunks are gathered, so a job is at most what a row can hold.
    """
    whole = chunks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("content").cast("binary").alias("content")))).alias("c"))
    gapless = F.forall(F.sequence(F.lit(1), F.size("c")), lambda i: F.element_at(F.col("c"), i)["seq"] == i - 1)
    data = F.aggregate("c", F.lit(b""), lambda s, c: F.concat(s, c["content"]))
    have = whole.select("job_id", gapless.alias("_gapless"), F.octet_length(data).cast("long").alias("_bytes"), F.sha2(data, 256).alias("_sha"))
    ok = F.col("_gapless") & (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha"))
    return expected.join(have, "job_id", "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_gapless", "_bytes", "_sha")


def compatible(stored: Column, wanted: Column, legacy: tuple[str, ...] = ()) -> Column:
    """Whether a cache's settings serve: equal maps, or equal but for a source hash that is a known old one."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    bare = lambda m: entries(F.map_filter(m, lambda k, _: k != "source_sha256"))
    old = F.coalesce(F.element_at(stored, F.lit("source_sha256")).isin(*legacy), F.lit(False)) if legacy else F.lit(False)
    return (entries(stored) == entries(wanted)) | (old & (bare(stored) == bare(wanted)))


def summary(fits: DataFrame) -> DataFrame:
    """One row over fitted polygons: counts, areas and vertices before and after."""
    return fits.agg(
        F.count("*").alias("buildings"), F.count_if(F.col("fit_done") == 1).alias("fitted"), F.sum("area_m2").alias("area_m2"),
        F.sum("v_old").alias("vertices_before"), F.sum("v_new").alias("vertices_after"), F.sum("holes").alias("holes"))


def reason_histogram(fits: DataFrame, reasons: str = "attempt_reasons") -> DataFrame:
    return fits.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def removed(before: DataFrame, after: DataFrame, key: str = "fid", area: str = "area_m2") -> DataFrame:
    """One row: how many were dropped and their area."""
    return before.join(after.select(key), key, "left_anti").agg(F.count("*").alias("n"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area_m2"))


def empty_layer(spark) -> DataFrame:
    return spark.createDataFrame([], "id int, height double")
