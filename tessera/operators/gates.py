"""Scoring of gates: status, ratchet, waivers, stages, licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ALLOWED = [
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "CC0-1.0", "MPL-2.0", "BSL-1.0", "Unicode-3.0", "Unicode-DFS-2016",
    "OpenSSL", "Apache-2.0 WITH LLVM-exception", "0BSD", "CDLA-Permissive-2.0", "NCSA",
]
INCOMPATIBLE = ["GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "AGPL-3.0-only", "SSPL-1.0", "BUSL-1.1", "Elastic-2.0", "CC-BY-NC-4.0"]
TOLERANCE, WAIVED_TOLERANCE = 0.05, 0.02
CLEARING = ["PASS", "WAIVED"]


def satisfied(value: Column, cmp: Column, target: Column) -> Column:
    return F.when(cmp == ">=", value >= target).when(cmp == "<=", value <= target).when(cmp == ">", value > target).when(cmp == "<", value < target).when(cmp == "==", value == target)


def status(gates: DataFrame, results: DataFrame) -> DataFrame:
    """(gid, stage, value, status): what a missing file, error, missed coverage or bad exit comes to, in that order."""
    c = F.col
    word = (
        F.when(c("outcome").isNull(), "N/A-yet").when(c("outcome") == "error", "ERROR").when(c("outcome") == "not-implemented", "N/A-yet")
        .when(~c("covered"), "FAIL").when(c("exit_code") != 0, "ERROR").when(c("value").isNull(), "ERROR")
        .when(satisfied(c("value"), c("cmp"), c("target")), "PASS").otherwise("FAIL")
    )
    return gates.join(results, "gid", "left").select("gid", "stage", "value", word.alias("status"))


def ratchet(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """(gid, worse, lost, next_value): worse than the baseline beyond its tolerance; passed before and fails now; the new baseline."""
    c = F.col
    tol = F.when(c("waived") & ~c("timing"), WAIVED_TOLERANCE).otherwise(TOLERANCE)
    lower = F.when(c("base") > 0, c("base") * (1 + tol)).otherwise(c("base") + 1e-9)
    worse = F.when(c("lower_is_better"), c("value") > lower).otherwise(c("value") < c("base") * (1 - tol))
    better = c("base").isNull() | F.when(c("lower_is_better"), c("value") <= c("base")).otherwise(c("value") >= c("base"))
    df = current.where("value is not null").join(baselines, "gid", "left")
    return df.select(
        "gid", F.coalesce(worse, F.lit(False)).alias("worse"), F.coalesce(c("base_status").isin(CLEARING) & (c("status") == "FAIL"), F.lit(False)).alias("lost"),
        F.when(c("status").isin(CLEARING) & better, c("value")).otherwise(c("base")).alias("next_value"),
    )


def waivers(df: DataFrame) -> DataFrame:
    """(gid, problems): why each waiver doesn't hold, in order; an empty list is a waiver that does."""
    c = F.col
    gap = F.abs(c("value") - c("target")) > F.abs(c("before") - c("target")) * 1.02
    ratio = F.when(c("lower_is_better"), F.try_divide("value", "target")).otherwise(F.try_divide("target", "value"))
    rules = [(c("type") == "HARD", "hard"), (c("iterations") < 5, "iterations"), (c("strategies") < 3, "strategies"), (c("before").isNull(), "no-history"), (gap, "regressing"), (c("perf") & (c("target") != 0) & (ratio > 2), "over-cap")]
    return df.select("gid", F.array_compact(F.array(*[F.when(rule, word) for rule, word in rules])).alias("problems"))


def stage_state(scored: DataFrame) -> DataFrame:
    """(stage, state): blocked, in progress or clear, by the worst gate."""
    bad, open_ = F.bool_or(F.col("status").isin("FAIL", "ERROR", "STALE")), F.bool_or(F.col("status") == "N/A-yet")
    return scored.groupBy("stage").agg(F.when(bad, "BLOCKED").when(open_, "IN PROGRESS").otherwise("CLEAR").alias("state"), F.count("*").alias("gates"))


def delivery(stages: DataFrame) -> DataFrame:
    """(delivery, reasons) from (stage, state, gates): delivered only if every stage is clear; reasons name those that aren't, in order."""
    open_ = F.array_sort(F.collect_list(F.when(F.col("state") != "CLEAR", F.concat_ws(": ", F.col("stage").cast("string"), "state"))))
    word = F.when(F.count_if(F.col("state") == "BLOCKED") > 0, "BLOCKED").when(F.count_if(F.col("state") != "CLEAR") > 0, "IN PROGRESS").otherwise("DELIVERED")
    return stages.agg(word.alias("delivery"), F.array_join(open_, "; ").alias("reasons"))


#: Waivers of performance gates that may hold at once.
MOST_PERF_WAIVERS = 2


def waiver_cap(waived: DataFrame) -> DataFrame:
    """(perf_waivers, over_cap) of waivers (gid, perf, problems): those of performance gates that hold."""
    n = F.count_if(F.col("perf") & (F.size("problems") == 0))
    return waived.agg(n.alias("perf_waivers"), (n > MOST_PERF_WAIVERS).alias("over_cap"))


def chain(scored: DataFrame, baselines: DataFrame, waived: DataFrame, frozen: DataFrame) -> DataFrame:
    """(gid, stage, status, note): what a run comes to after all steps, in order: files that were frozen and changed
    make a result stale; a failure with a waiver that holds is waived; a result worse than its baseline fails.

    scored: (gid, stage, value, status, lower_is_better, timing); frozen: (gid, finding), one row a change.
    """
    stale = frozen.groupBy("gid").agg(F.count("*").alias("changes"))
    held = waived.where(F.size("problems") == 0).select("gid", F.lit(True).alias("held"))
    worse = ratchet(scored, baselines).select("gid", "worse", "lost")
    df = scored.join(stale, "gid", "left").join(held, "gid", "left").join(worse, "gid", "left")
    regressed = F.coalesce(F.col("worse") | F.col("lost"), F.lit(False))
    note = F.when(F.col("changes").isNotNull() & (F.col("status") != "N/A-yet"), "frozen files changed").when((F.col("status") == "FAIL") & F.col("held"), "waived").when((F.col("status") == "PASS") & regressed, "worse than baseline")
    word = F.when(note == "frozen files changed", "STALE").when(note == "waived", "WAIVED").when(note == "worse than baseline", "FAIL").otherwise(F.col("status"))
    return df.select("gid", "stage", word.alias("status"), note.alias("note"))


def licences(deps: DataFrame) -> DataFrame:
    """(name, verdict): OR needs one allowed alternative, AND every part; what isn't determined is a violation too."""
    alternatives = F.split(F.coalesce("licence", F.lit("")), r"(?i)\s+OR\s+|/")
    parts = F.transform(alternatives, lambda a: F.transform(F.split(F.regexp_replace(a, "[()]", ""), r"(?i)\s+AND\s+"), lambda p: F.trim(p)))
    ok = F.exists(parts, lambda a: F.forall(a, lambda p: p.isin(ALLOWED)))
    known = F.forall(parts, lambda a: F.exists(a, lambda p: p.isin(INCOMPATIBLE)))
    return deps.select("name", F.when(ok, "allowed").when(known, "incompatible").otherwise("unknown").alias("verdict"))


def closure_diff(then: DataFrame, now: DataFrame) -> DataFrame:
    """(path, finding) for pinned files that are missing, changed or new."""
    df = then.withColumnRenamed("hash", "was").join(now.withColumnRenamed("hash", "now"), "path", "full_outer")
    word = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return df.select("path", word.alias("finding")).where("finding is not null")


def error_audit(errors: DataFrame, known: list[str]) -> DataFrame:
    """(line, missing, unknown): fields that an error document lacks, and commands that its advice names but don't exist."""
    doc = F.from_json("json", "error string, category string, concept string, recovery string")
    df = errors.select("line", doc.alias("d"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"d.{k}"), F.lit("")) == "", k) for k in ("error", "category", "concept", "recovery")]))
    named = F.array_distinct(F.regexp_extract_all(F.coalesce("d.recovery", F.lit("")), F.lit("`([A-Za-z0-9-]+)`"), F.lit(1)))
    return df.select("line", lacking.alias("missing"), F.array_except(named, F.array(*map(F.lit, known))).alias("unknown"))


def scorecard(registry: DataFrame, results: DataFrame, evidence: DataFrame) -> DataFrame:
    """(gid, finding): gates without a result, results of no gate, results given twice, and evidence that is named but isn't there.

    results: (gid, evidence), the path of a file or null; evidence: (path).
    """
    n = results.groupBy("gid").agg(F.count("*").alias("n"))
    both = registry.select("gid", F.lit(True).alias("known")).distinct().join(n, "gid", "full_outer")
    word = F.when(F.col("known").isNull(), "not in the registry").when(F.col("n").isNull(), "no result").when(F.col("n") > 1, "more than one result")
    lost = results.where("evidence is not null").join(evidence.select(F.col("path").alias("evidence")).distinct(), "evidence", "left_anti").select("gid", F.lit("evidence is missing").alias("finding")).distinct()
    return both.select("gid", word.alias("finding")).where("finding is not null").union(lost)
