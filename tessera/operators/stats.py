"""Percentile rules, summaries, bounds, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored

#: 1-based ranks over n sorted values; they differ.
RULES = {
    "ceil": lambda p, n: F.greatest(F.lit(1), F.ceil(p * n)),
    "half_up": lambda p, n: F.least(n, F.greatest(F.lit(1), F.floor(p * n + F.lit(0.5)))),
    "floor": lambda p, n: F.least(n, F.floor(n * p) + 1),
}


def percentiles(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Per key the p-percentile under each rule, for keys that have values. By counts of values and running sums, so a key is never an array."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    picks = []
    for name, rule in RULES.items():
        rank = rule(F.lit(p), F.col("n"))
        picks.append(F.min(F.when(F.col("upto") >= rank, F.col(value))).alias(f"p_{name}"))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def percentile_or_zero(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """(keys, n, p_zero): the rule `ceil`, and 0 for a key without any value."""
    found = percentiles(df, keys, value, p)
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p_ceil", F.lit(0)).alias("p_zero"))


def violations(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """(key, value, verdict) for every bound (key, lo, hi), either side null for none: a key that wasn't measured is a violation too."""
    verdict = F.when(F.col("value").isNull(), "missing").when(F.col("value") < F.col("lo"), "below").when(F.col("value") > F.col("hi"), "above").otherwise("ok")
    return bounds.join(measured, "key", "left").select("key", "value", verdict.alias("verdict"))


def stratified(df: DataFrame, stratum: str, ident: str, seed: str, cap: int, scale: float) -> DataFrame:
    """At most cap a stratum, trimmed to max(1, int(n * scale)), by the order of md5(seed, id)."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.col(ident)).cast("binary"))
    counts = df.groupBy(stratum).agg(F.least(F.lit(cap), F.count("*")).alias("n"))
    keep = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(scale)))
    ranked = df.select(stratum, ident).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    return ranked.where(F.col("rank") <= cap).join(counts, stratum).where(F.col("rank") <= keep).select(stratum, ident, "rank")


def share(hits: Column, n: Column) -> Column:
    """Percent, null over nothing."""
    return hits.cast("double") * 100.0 / F.nullif(n, F.lit(0))


def corpus(files: DataFrame) -> DataFrame:
    """(key, value): what a corpus of files (path, content) measures; a file is binary if its first 8000 characters hold a NUL.

    Contents are read once, for a written table of what is measured of each file.
    """
    f = files.select(
        "path", F.octet_length("content").alias("size"), F.contains(F.left("content", F.lit(8000)), F.lit("\x00")).cast("int").alias("bin"),
        F.size(F.split("path", "/")).alias("depth"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"),
    )
    f = stored(f, "corpus-files")
    one = f.agg(F.count("*").alias("file_count"), F.sum("size").alias("total_working_bytes"), F.round(F.avg("bin"), 6).alias("binary_fraction"), F.max("size").alias("max_file_bytes"), F.max("depth").alias("max_path_depth"), F.count_distinct("ext").alias("distinct_extensions"))
    whole = f.select(F.lit(1).alias("all"), "size")
    for p in (50, 90, 99):
        one = one.unionByName(percentiles(whole, ["all"], "size", p / 100).select(F.col("p_floor").alias(f"p{p}_file_bytes")), allowMissingColumns=True)
    parts = F.split("path", "/")
    above = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("dir"), F.get(parts, n - 1).alias("name")))).alias("e")).select("e.*").distinct()
    fan = above.groupBy("dir").agg(F.count("*").alias("fan")).agg(F.count("*").alias("directory_count"), F.max("fan").alias("max_directory_fanout"), F.round(F.avg("fan"), 6).alias("mean_directory_fanout"))
    rows = one.unionByName(fan, allowMissingColumns=True)  # one row each
    names = rows.columns
    return rows.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("key", "value")).where("value is not null")
