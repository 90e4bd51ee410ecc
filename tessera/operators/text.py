"""Text: normal forms, line-multiset similarity, merge buckets, identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import first_of_each, stored

# Fixed values.
IMPORT_LINE = r"^\s*(import\b|from\b.*\bimport\b|use\b.*;|#include\b|require\b).*$"
TRAILERS = ["Co-Authored-By", "Signed-off-by", "Reviewed-by", "Generated-by", "Assisted-by", "Change-Id", "PR-URL", "Reviewed-On"]
CI_AUTOMATION = (
    r"(?i)dependabot|renovate|github[- ]actions|greenkeeper|snyk[- ]bot|mergify|codecov|allcontributors|pre-commit-ci|semantic-release|imgbot|whitesource|"
    r"restyled|stale\[bot\]|netlify|vercel\[bot\]|azure-pipelines|travis|appveyor|circleci|jenkins|buildkite|release-please|changeset-bot|weblate|transifex|"
    r"crowdin|pyup|scala-steward|bors|autoroller|gitbot|update-bot|k8s-ci-robot|openshift-|prow"
)
BOT_MARK = r"(?i)\[bot\]|\bbot@|^bot$|-bot\b|\bbot-"
AUTHORING_AGENT = (
    r"(?i)\bclaude\b|copilot|\bcursor\b|\bdevin\b|\bcodex\b|\baider\b|\bsweep\b|chatgpt|openai|anthropic|\bgpt-?[0-9]|codeium|tabnine|sourcegraph[- ]cody|"
    r"\bcody\b|gemini[- ]code|jules\b|\bdroid\b|factory[- ]ai"
)
#: Least similarity of each tier.
TIERS = {"A": 1.0, "B": 0.9, "C": 0.5}


def normalized(text: Column) -> Column:
    """Line ends to \\n, line tails stripped, runs of two imports or more sorted, commas before a closing bracket
    gone, four line ends or more to three, one at the end. Text with NUL in its first 8000 characters stays.

    Runs are folded in one pass: an import line joins the open run, any other line closes it.
    """
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    kind = "struct<done:array<string>,run:array<string>>"

    def step(a: Column, x: Column) -> Column:
        closed = F.concat(a["done"], F.array_sort(a["run"]), F.array(x))
        return F.when(x.rlike(IMPORT_LINE), F.struct(a["done"].alias("done"), F.array_append(a["run"], x).alias("run"))).otherwise(F.struct(closed.alias("done"), F.array().cast("array<string>").alias("run"))).cast(kind)

    empty = F.array().cast("array<string>")
    folded = F.aggregate(lines, F.struct(empty.alias("done"), empty.alias("run")).cast(kind), step, lambda a: F.concat(a["done"], F.array_sort(a["run"])))
    # most texts have no imports, so the fold is left out for them
    sorted_ = F.when(text.rlike(f"(?m){IMPORT_LINE}"), folded).otherwise(lines)
    joined = F.regexp_replace(F.array_join(sorted_, "\n"), r",(\s*[)\]}])", "$1")
    done = F.concat(F.regexp_replace(F.regexp_replace(joined, r"\n{4,}", "\n\n\n"), r"\n+$", ""), F.lit("\n"))
    return F.when(F.instr(F.left(text, F.lit(8000)), "\x00") > 0, text).otherwise(done)


def line_counts(docs: DataFrame, key: str) -> DataFrame:
    """(key, line hash, n): each document's multiset of lines, blanks collapsed, empty ones left out."""
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    lines = docs.select(key, F.explode(F.split("text", "\n")).alias("line")).select(key, line.alias("line")).where("line <> ''")
    return lines.groupBy(key, F.xxhash64("line").alias("h")).agg(F.count("*").alias("n"))


def dice(counts: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(a, b, dice) of given pairs: 2 * shared lines / all lines; both empty 1, one empty 0."""
    size = counts.groupBy(key).agg(F.sum("n").alias("size"))
    side = lambda x: size.select(F.col(key).alias(x), F.col("size").alias(f"size_{x}"))
    left = pairs.join(counts.select(F.col(key).alias("a"), "h", F.col("n").alias("na")), "a")
    shared = left.join(counts.select(F.col(key).alias("b"), "h", F.col("n").alias("nb")), ["b", "h"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").join(side("a"), "a", "left").join(side("b"), "b", "left").fillna(0, ["shared", "size_a", "size_b"])
    total = F.col("size_a") + F.col("size_b")
    return out.select("a", "b", F.round(F.when(total == 0, 1.0).otherwise(2.0 * F.col("shared") / total), 6).alias("dice"))


def tier(similarity: Column, equal: Column) -> Column:
    return F.when(equal, "A").when(similarity >= TIERS["B"], "B").when(similarity >= TIERS["C"], "C").otherwise("none")


def identity(name: Column, email: Column) -> Column:
    blob = F.concat_ws(" ", name, email)
    return F.when(blob.rlike(AUTHORING_AGENT), "authoring-agent").when(blob.rlike(CI_AUTOMATION) | blob.rlike(BOT_MARK), "ci-automation")


def has_trailer(text: Column, trailer: str) -> Column:
    return text.rlike(rf"(?im)^{trailer}:\s*(.+)$")


def provenance(commits: DataFrame) -> DataFrame:
    """Adds to commits (author, author_email, committer, committer_email, body): identity of author, else committer;
    co_authored, agent_co_authored, structured, agent_route, any; and a column a trailer."""
    own = F.coalesce(identity(F.col("author"), F.col("author_email")), identity(F.col("committer"), F.col("committer_email")))
    names = F.regexp_extract_all("body", F.lit(r"(?im)^co-authored-by:\s*(.+)$"), F.lit(1))
    found = {t: has_trailer(F.col("body"), t) for t in TRAILERS}
    df = commits.withColumns({"identity": own, "agent_co_authored": F.exists(names, lambda n: identity(n, n).isNotNull())} | {trailer_column(t): c for t, c in found.items()})
    df = df.withColumns({"co_authored": F.col("co_authored_by"), "structured": reduce(Column.__or__, [F.col(trailer_column(t)) for t in TRAILERS])})
    return df.withColumns({"agent_route": F.col("identity").isNotNull() | F.col("agent_co_authored"), "any": F.col("identity").isNotNull() | F.col("structured")})


def trailer_column(trailer: str) -> str:
    return trailer.lower().replace("-", "_")


def probe(commits: DataFrame, recent: int = 2000) -> DataFrame:
    """Per repo (repo, n: larger for newer ones) the counters of `provenance`, of each trailer, and of the newest `recent`."""
    c, n = F.col, lambda x: F.count_if(x)
    flags = [trailer_column(t) for t in TRAILERS]
    df = stored(provenance(commits).select("repo", "n", "identity", "co_authored", "agent_co_authored", "structured", "any", "agent_route", *flags), "provenance")  # messages are read once
    out = df.groupBy("repo").agg(
        F.count("*").alias("commits"), n(c("identity").isNotNull()).alias("s1"), n(c("identity") == "authoring-agent").alias("s1_agent"), n(c("identity") == "ci-automation").alias("s1_ci"),
        n(c("co_authored")).alias("s2"), n(c("agent_co_authored")).alias("s2_agent"), n(c("structured")).alias("s3"), n(c("any")).alias("any"), n(c("agent_route")).alias("agent_route"), *[n(c(t)).alias(t) for t in flags],
    )
    new = first_of_each(df.select("repo", "n", "agent_route", "any"), "repo", [F.desc("n")], recent)
    new = new.groupBy("repo").agg(F.count("*").alias("recent"), n(c("agent_route")).alias("recent_agent_route"), n(c("any")).alias("recent_any"))
    share = lambda a, b: F.round(c(a) * 100.0 / F.greatest(c(b), F.lit(1)), 6)
    return out.join(new, "repo").withColumns({"pct_agent_route": share("agent_route", "commits"), "pct_any": share("any", "commits"), "pct_recent_agent_route": share("recent_agent_route", "recent"), "pct_recent_any": share("recent_any", "recent")})


def verdict(c1: Column, c2: Column, c3: Column) -> Column:
    ok = (c1 >= 5) & (c2 >= 20)
    return F.when(ok & (c3 >= 3), "GO").when(ok & (3 - c3 < 1), "WEAK-GO").otherwise("NO-GO")


#: The outcomes of a replayed merge.
BUCKETS = ["ERROR", "REPLAY_CONFLICT", "CLEAN_MATCH", "CLEAN_DIVERGE_NORMALIZED", "EXCLUDED_EVIL", "CLEAN_DIVERGE"]


def replayed(merges: DataFrame, paths: DataFrame, most: int = 80) -> DataFrame:
    """(merge, bucket, diff_paths, evil_paths) from merges (merge, has_base, status) and paths (merge, path, and the
    contents replayed, recorded, p1, p2, base; null for no file).

    No base or a status above 1: error; 1: conflict. Of the paths that differ the first `most` are looked at: equal in
    normal form, or not; those whose recorded form is none of the others' were written during the merge (five are named).
    """
    sides = ["replayed", "recorded", "p1", "p2", "base"]
    form = {c: F.sha2(normalized(F.col(c)).cast("binary"), 256) for c in sides}
    differ = ~F.col("replayed").eqNullSafe(F.col("recorded"))
    own = paths.where(differ).withColumn("i", F.row_number().over(Window.partitionBy("merge").orderBy("path")))
    own = own.select("merge", "path", "i", *[form[c].alias(c) for c in sides])
    both = F.col("replayed").isNotNull() & F.col("recorded").isNotNull()
    same = F.coalesce(both & (F.col("replayed") == F.col("recorded")), F.lit(False))
    known = reduce(Column.__or__, [F.coalesce(F.col("recorded") == F.col(c), F.lit(False)) for c in ("replayed", "p1", "p2", "base")])
    seen = F.col("i") <= most
    g = own.groupBy("merge").agg(
        F.count("*").alias("diff_paths"), F.bool_and(~seen | same).alias("normal"), F.array_sort(F.collect_list(F.when(seen & both & ~same & ~known, F.col("path")))).alias("evil")
    )
    df = merges.join(g, "merge", "left")
    bucket = (
        F.when(~F.col("has_base") | (F.col("status") > 1), "ERROR").when(F.col("status") == 1, "REPLAY_CONFLICT").when(F.col("diff_paths").isNull(), "CLEAN_MATCH")
        .when(F.col("normal"), "CLEAN_DIVERGE_NORMALIZED").when(F.size("evil") > 0, "EXCLUDED_EVIL").otherwise("CLEAN_DIVERGE")
    )
    clean = bucket.isin("EXCLUDED_EVIL")
    return df.select(*merges.columns, bucket.alias("bucket"), F.coalesce("diff_paths", F.lit(0)).cast("long").alias("diff_paths"), F.array_join(F.when(clean, F.slice("evil", 1, 5)).otherwise(F.array().cast("array<string>")), ",").alias("evil_paths"))


def merge_bucket(paths: DataFrame) -> DataFrame:
    """(merge, bucket, evil) from (merge, replayed, recorded, p1, p2, base), normal forms' hashes, null for no file."""
    differ = ~F.col("replayed").eqNullSafe(F.col("recorded"))
    known = F.greatest(*[F.coalesce(F.col("recorded") == F.col(c), F.lit(False)) for c in ("replayed", "p1", "p2", "base")])
    evil = differ & F.col("replayed").isNotNull() & F.col("recorded").isNotNull() & ~known
    g = paths.groupBy("merge").agg(F.count_if(differ).alias("differ"), F.count_if(evil).alias("evil"))
    return g.select("merge", F.when(F.col("differ") == 0, "same").when(F.col("evil") > 0, "evil").otherwise("diverge").alias("bucket"), "evil")
