"""Queries on texts, merges and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.tables import stored, table
from ..operators import stats, text
from .registry import query

IMPORTS = r"^\s*(import\b|from\b.*\bimport\b|use\b.*;|#include\b|require\b)"
#: The normal form of `docs` under DuckDB: an import line sorts within its run, which the line before the run begins.
NORMAL = r"""
l as (select doc_id, unnest(ls) raw, generate_subscripts(ls, 1) i from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) ls from docs)),
t as (select doc_id, i, regexp_replace(raw, '\s+$', '') line from l),
m as (select *, regexp_matches(line, '{0}') imp from t),
g as (select *, sum((not imp)::int) over (partition by doc_id order by i) run from m),
j as (select doc_id, string_agg(line, chr(10) order by run, imp, case when imp then line else '' end, i) body from g group by 1),
n as (select doc_id, regexp_replace(regexp_replace(regexp_replace(body, ',(\s*[)\]}}])', '\1', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\n+$', '') || chr(10) body from j)
select doc_id, sha256(body) hash from n""".format(IMPORTS)


def normal_hashes(docs):
    return docs.select("doc_id", F.sha2(text.normalized(F.col("text")).cast("binary"), 256).alias("hash"))


@query("with docs as (select doc_id, text from documents)," + NORMAL)
def normalize_text(spark, d):
    """Normal forms' hashes of all texts."""
    return normal_hashes(table(spark, d, "documents"))


@query(r"""
with docs as (select doc_id, 'import zeta' || chr(10) || 'from alpha import beta' || chr(13) || chr(10) || text || chr(10) || 'use b::c;' || chr(10) || 'use a::b;  ' || chr(10) || '#include <x>' || chr(10) || 'f(a,' || chr(10) || ')' text from documents),""" + NORMAL)
def normalize_imports(spark, d):
    """The same of texts that have runs of imports put before and after, which the test tables' texts haven't."""
    more = F.concat(F.lit("import zeta\nfrom alpha import beta\r\n"), "text", F.lit("\nuse b::c;\nuse a::b;  \n#include <x>\nf(a,\n)"))
    return normal_hashes(table(spark, d, "documents").select("doc_id", more.alias("text")))


DICE = r"""
with l as (select doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) line from (select doc_id, unnest(string_split(text, chr(10))) line from documents)),
c as (select doc_id, line, count(*) n from l where line <> '' group by all), s as (select doc_id, sum(n) size from c group by 1),
p as (select doc_id a, lead(doc_id) over (partition by source, lang order by doc_id) b from documents),
x as (select a, b, coalesce((select sum(least(u.n, v.n)) from c u join c v on u.line = v.line where u.doc_id = a and v.doc_id = b), 0) shared, coalesce(sa.size, 0) + coalesce(sb.size, 0) total
  from p left join s sa on a = sa.doc_id left join s sb on b = sb.doc_id where b is not null),
dice as (select a, b, round(case when total = 0 then 1.0 else 2.0 * shared::double / total::double end, 6) dice from x)
"""


def neighbours(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("source", "lang").orderBy("doc_id")).alias("b")).where("b is not null")
    return docs, text.dice(text.line_counts(docs, "doc_id"), pairs, "doc_id")


@query(DICE + "select * from dice")
def dice_pairs(spark, d):
    """Line-multiset similarity of each document and the next of its source and language."""
    return neighbours(spark, d)[1]


@query(DICE + """
, t as (select case when x.text = y.text then 'A' when dice >= 0.9 then 'B' when dice >= 0.5 then 'C' else 'none' end tier, x.lang, x.source, case when a % 10 = b % 10 then 'rename' else 'move' end kind from dice join documents x on a = x.doc_id join documents y on b = y.doc_id)
select tier, lang, source, kind, tier in ('A', 'B') refactoring, count(*) n, count(distinct source) sources from t group by grouping sets ((tier), (tier, lang), (tier, source), (tier, kind))""")
def similarity_tiers(spark, d):
    """Refactorings by tier, and by language, repository and kind of rename within it."""
    docs, found = neighbours(spark, d)
    h = docs.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    x = h.select(F.col("doc_id").alias("a"), "lang", "source", F.col("hash").alias("ha"))
    t = found.join(x, "a").join(h.select(F.col("doc_id").alias("b"), F.col("hash").alias("hb")), "b").select(text.tier(F.col("dice"), F.col("ha") == F.col("hb")).alias("tier"), "lang", "source", F.when(F.col("a") % 10 == F.col("b") % 10, "rename").otherwise("move").alias("kind"))
    c = F.col
    return t.groupingSets([[c("tier")], [c("tier"), c("lang")], [c("tier"), c("source")], [c("tier"), c("kind")]], "tier", "lang", "source", "kind").agg(c("tier").isin("A", "B").alias("refactoring"), F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


#: A merge a customer, a path an order: contents are short texts whose tails normalise away.
MERGES = """
with ps as (select o_custkey merge, 'f' || o_orderkey path, 'v' || o_orderkey % 7 || chr(10) a, case when o_orderkey % 11 = 0 then null when o_orderkey % 5 = 0 then 'v' || o_orderkey % 4 || chr(10) when o_orderkey % 3 = 0 then 'v' || o_orderkey % 7 || '  ' || chr(13) || chr(10) else 'v' || o_orderkey % 7 || chr(10) end b,
    'v' || o_orderkey % 3 || chr(10) p1, 'v' || o_orderkey % 2 || chr(10) p2, case when o_orderkey % 4 <> 0 then 'v' || o_orderkey % 6 || chr(10) end base from orders where o_custkey % 6 <> 0 or o_orderkey % 15 = 1),
mg as (select c_custkey merge, c_nationkey repo, c_mktsegment lang, c_custkey % 13 <> 0 has_base, case when c_custkey % 29 = 0 then 2 when c_custkey % 8 = 0 then 1 else 0 end status from customer),
df as (select *, row_number() over (partition by merge order by path) i from ps where a is distinct from b),
nf as (select merge, path, i, {0} na, {1} nb, {2} n1, {3} n2, {4} n0 from df),
ev as (select *, na is not null and nb is not null and na = nb same, na is not null and nb is not null and na <> nb and nb <> coalesce(n1, '') and nb <> coalesce(n2, '') and nb <> coalesce(n0, '') evil from nf),
gr as (select merge, count(*) diff_paths, bool_and(i > 80 or coalesce(same, false)) normal, list_sort(list(path) filter (i <= 80 and coalesce(evil, false))) evil from ev group by 1),
bk as (select m.*, case when not has_base or status > 1 then 'ERROR' when status = 1 then 'REPLAY_CONFLICT' when diff_paths is null then 'CLEAN_MATCH' when normal then 'CLEAN_DIVERGE_NORMALIZED' when len(evil) > 0 then 'EXCLUDED_EVIL' else 'CLEAN_DIVERGE' end bucket,
    coalesce(diff_paths, 0)::bigint diff_paths, evil from mg m left join gr using (merge)),
sm as (select * from (select *, row_number() over (partition by repo order by md5('20260903|' || merge)) rank, least(50, count(*) over (partition by repo)) cap from bk) where rank <= cap and rank <= greatest(1, floor(cap * 0.8)))
""".format(*[f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '\\s+$', ''), '$', chr(10))" for c in ("a", "b", "p1", "p2", "base")])


def merges(spark, d):
    k, text_of = F.col("o_orderkey"), lambda n: F.concat(F.lit("v"), n.cast("string"), F.lit("\n"))
    recorded = F.when(k % 11 == 0, None).when(k % 5 == 0, text_of(k % 4)).when(k % 3 == 0, F.concat(F.lit("v"), (k % 7).cast("string"), F.lit("  \r\n"))).otherwise(text_of(k % 7))
    paths = table(spark, d, "orders").where((F.col("o_custkey") % 6 != 0) | (k % 15 == 1)).select(
        F.col("o_custkey").alias("merge"), F.concat(F.lit("f"), k.cast("string")).alias("path"), text_of(k % 7).alias("replayed"), recorded.alias("recorded"), text_of(k % 3).alias("p1"), text_of(k % 2).alias("p2"), F.when(k % 4 != 0, text_of(k % 6)).alias("base")
    )
    c = F.col("c_custkey")
    own = table(spark, d, "customer").select(c.alias("merge"), F.col("c_nationkey").alias("repo"), F.col("c_mktsegment").alias("lang"), (c % 13 != 0).alias("has_base"), F.when(c % 29 == 0, 2).when(c % 8 == 0, 1).otherwise(0).alias("status"))
    return text.replayed(own, paths)


def sampled_merges(spark, d):
    found = stored(merges(spark, d), "merges")  # contents are normalised once
    return found.join(stats.stratified(found, "repo", "merge", "20260903", 50, 0.8).select("merge"), "merge", "left_semi")


@query(MERGES + "select merge, bucket, diff_paths, case when bucket = 'EXCLUDED_EVIL' then array_to_string(evil[:5], ',') else '' end evil_paths from bk")
def merge_buckets(spark, d):
    """Every replayed merge: errors and conflicts, equal trees, and what normal forms and the merge's sides make of the rest."""
    return merges(spark, d).select("merge", "bucket", "diff_paths", "evil_paths")


@query(MERGES + "select bucket, lang, repo, count(*) n from sm group by grouping sets ((bucket), (lang, bucket), (repo, bucket))")
def merge_counters(spark, d):
    """Buckets of the sampled merges overall, by language and by repository."""
    b, lang, repo = F.col("bucket"), F.col("lang"), F.col("repo")
    return sampled_merges(spark, d).groupingSets([[b], [lang, b], [repo, b]], "bucket", "lang", "repo").agg(F.count("*").alias("n"))


@query(MERGES + """
, n as (select count(*) filter (bucket in ('CLEAN_MATCH', 'CLEAN_DIVERGE', 'CLEAN_DIVERGE_NORMALIZED')) clean, count(*) filter (bucket = 'CLEAN_DIVERGE') diverge, count(*) filter (bucket <> 'ERROR') replayed, count(*) filter (bucket = 'REPLAY_CONFLICT') conflict from sm),
r as (select 'divergence' rate, diverge k, clean n from n union all select 'conflict', conflict, replayed from n),
z as (select *, k::double / n p, 1.959964 z from r)
select rate, k, n, round(100 * p, 4) pct, round(100 * greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 4) low,
  round(100 * least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 4) high from z""")
def merge_rates(spark, d):
    """Divergence over clean merges, without those written during the merge; conflicts over all that were replayed; with intervals."""
    b, n = F.col("bucket"), lambda x: F.count_if(x)
    g = sampled_merges(spark, d).agg(
        F.struct(F.lit("divergence").alias("rate"), n(b == "CLEAN_DIVERGE").alias("k"), n(b.isin("CLEAN_MATCH", "CLEAN_DIVERGE", "CLEAN_DIVERGE_NORMALIZED")).alias("n")).alias("a"),
        F.struct(F.lit("conflict").alias("rate"), n(b == "REPLAY_CONFLICT").alias("k"), n(b != "ERROR").alias("n")).alias("b"),
    )
    rows = g.select(F.inline(F.array("a", "b")))
    low, high = scalar.wilson(F.col("k"), F.col("n"))
    return rows.select("rate", "k", "n", F.round(stats.share(F.col("k"), F.col("n")), 4).alias("pct"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


#: Who wrote a commit, by the last digit and more of a number.
NAMES = ["Ann Lee", "dependabot[bot]", "Copilot", "bot", "Release-Bot x", "Cody Smith", "Abbot", "k8s-ci-robot", "GPT-4 helper", "Jo Grower", "Prow", "Cursorine"]
MAILS = ["ann@x.org", "bot@y.com", "c@z", "", "r@x", "cody@x"]


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _identity_sql(blob: str) -> str:
    pattern = lambda p: "'" + p.replace("'", "''") + "'"
    return f"case when regexp_matches({blob}, {pattern(text.AUTHORING_AGENT)}) then 'authoring-agent' when regexp_matches({blob}, {pattern(text.CI_AUTOMATION)}) or regexp_matches({blob}, {pattern(text.BOT_MARK)}) then 'ci-automation' end"


def pick(words: list[str], n):
    return F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))


@query(f"""
with p as (select c_custkey, {_sql_list(NAMES)}[c_custkey % {len(NAMES)} + 1] || ' ' || {_sql_list(MAILS)}[c_custkey // 7 % {len(MAILS)} + 1] blob from customer)
select c_custkey, {_identity_sql('blob')} identity from p""")
def identity_classes(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", text.identity(pick(NAMES, k), pick(MAILS, F.floor(k / 7))).alias("identity"))


#: A commit an event: its people, and up to two trailers of the eight in its message, of either case.
LINES = ["none", "Co-Authored-By: Ann", "signed-off-by: Bo", "REVIEWED-BY:  Cy", "Generated-by: tool", "Assisted-by: x", "Change-Id: I1", "PR-URL: u", "Reviewed-On: v", "co-authored-by: Copilot <c@x>", "Co-authored-by: dependabot[bot]", " Signed-off-by: indented"]
COMMITS = f"""
with m as (select user_id % 12 repo, row_number() over (partition by user_id % 12 order by event_id desc) - 1 i,
    case when user_id % 12 < 8 and event_id % 3 = 0 then {_sql_list(NAMES)}[event_id % {len(NAMES)} + 1] else 'Jo Grower' end || ' ' || case when event_id % 4 = 0 then {_sql_list(MAILS)}[event_id // 7 % {len(MAILS)} + 1] else 'jo@x' end author,
    case when user_id % 12 < 8 and event_id % 9 = 0 then {_sql_list(NAMES)}[event_id // 11 % {len(NAMES)} + 1] else 'Jo Grower' end || ' jo@x' committer,
    'work' || chr(10) || {_sql_list(LINES)}[event_id // 2 % {len(LINES)} + 1] || chr(10) || {_sql_list(LINES)}[event_id // 5 % {len(LINES)} + 1] body from events),
c as (select *, coalesce({_identity_sql('author')}, {_identity_sql('committer')}) ident, list_filter(regexp_extract_all(body, '(?im)^co-authored-by:\\s*(.+)$', 1), lambda n: {_identity_sql("n || ' ' || n")} is not null) <> [] agent_co,
    {", ".join(f"regexp_matches(body, '(?im)^{t}:\\s*(.+)$') {text.trailer_column(t)}" for t in text.TRAILERS)} from m),
a as (select *, {" or ".join(text.trailer_column(t) for t in text.TRAILERS)} structured, ident is not null or agent_co route from c),
p as (select repo, count(*) commits, count(*) filter (ident is not null) s1, count(*) filter (ident = 'authoring-agent') s1_agent, count(*) filter (ident = 'ci-automation') s1_ci, count(*) filter (co_authored_by) s2, count(*) filter (agent_co) s2_agent,
    count(*) filter (structured) s3, count(*) filter (structured or ident is not null) "any", count(*) filter (route) agent_route, {", ".join(f"count(*) filter ({text.trailer_column(t)}) {text.trailer_column(t)}" for t in text.TRAILERS)},
    count(*) filter (i < 2000) recent, count(*) filter (i < 2000 and route) recent_agent_route, count(*) filter (i < 2000 and (structured or ident is not null)) recent_any from a group by 1),
q as (select *, round(100.0::double * agent_route / greatest(commits, 1), 6) pct_agent_route, round(100.0::double * "any" / greatest(commits, 1), 6) pct_any, round(100.0::double * recent_agent_route / greatest(recent, 1), 6) pct_recent_agent_route, round(100.0::double * recent_any / greatest(recent, 1), 6) pct_recent_any from p)
"""


def commits(spark, d):
    k, heavy = F.col("event_id"), F.col("user_id") % 12 < 8
    e = table(spark, d, "events")
    return e.select(
        (F.col("user_id") % 12).alias("repo"), k.alias("n"),
        F.when(heavy & (k % 3 == 0), pick(NAMES, k)).otherwise("Jo Grower").alias("author"), F.when(k % 4 == 0, pick(MAILS, F.floor(k / 7))).otherwise("jo@x").alias("author_email"),
        F.when(heavy & (k % 9 == 0), pick(NAMES, F.floor(k / 11))).otherwise("Jo Grower").alias("committer"), F.lit("jo@x").alias("committer_email"),
        F.concat_ws("\n", F.lit("work"), pick(LINES, F.floor(k / 2)), pick(LINES, F.floor(k / 5))).alias("body"),
    )


@query(COMMITS + "select * from q")
def provenance_counters(spark, d):
    """By repository: identities of authors and committers, co-authors, each of the eight trailers, and the newest 2000 commits."""
    return text.probe(commits(spark, d))


@query(COMMITS + """
, v as (select round(median(pct_agent_route) filter (repo < 8), 6) c1, round(median(pct_any) filter (repo < 8), 6) c2, round(median(pct_agent_route) filter (repo < 8) - coalesce(median(pct_agent_route) filter (repo >= 8), 0), 6) c3 from q)
select *, case when c1 >= 5 and c2 >= 20 and c3 >= 3 then 'GO' when c1 >= 5 and c2 >= 20 and 3 - c3 < 1 then 'WEAK-GO' else 'NO-GO' end verdict from v""")
def demand_probe(spark, d):
    """Medians over the agent-heavy repositories (the first eight), how far they are above the contrast group's, and the verdict."""
    q = text.probe(commits(spark, d))
    of = lambda c, heavy: F.median(F.when((F.col("repo") < 8) == heavy, F.col(c)))
    g = q.agg(F.round(of("pct_agent_route", True), 6).alias("c1"), F.round(of("pct_any", True), 6).alias("c2"), F.round(of("pct_agent_route", True) - F.coalesce(of("pct_agent_route", False), F.lit(0.0)), 6).alias("c3"))
    return g.withColumn("verdict", text.verdict(F.col("c1"), F.col("c2"), F.col("c3")))


@query("select d.source, count(*) filter (l.doc_id is null) unreviewed, count(*) docs from documents d left join labels l on d.doc_id = l.doc_id where d.source like 'src1%' group by 1")
def trace_unreviewed(spark, d):
    """Documents under a prefix that nobody has labelled."""
    docs = table(spark, d, "documents").where(F.startswith("source", F.lit("src1")))
    seen = table(spark, d, "labels").select("doc_id", F.lit(True).alias("seen"))
    return docs.join(seen, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("seen").isNull()).alias("unreviewed"), F.count("*").alias("docs"))


@query(r"""
with l as (select conv_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i from
  (select conv_id, string_agg(case when role = 'system' then '# ' when role = 'user' then '## ' else '### ' end || role || ' ' || turn || chr(10) || replace(text, '#', ''), chr(10) order by turn) t from conversations group by 1)),
h as (select conv_id, i, length(regexp_extract(line, '^(#{1,6})\s', 1)) lvl, regexp_extract(line, '^#{1,6}\s+(.*?)\s*$', 1) title from l where regexp_matches(line, '^#{1,6}\s+')),
e as (select h.conv_id, h.i, h.title, coalesce((select min(n.i) from h n where n.conv_id = h.conv_id and n.i > h.i and n.lvl <= h.lvl), 1000000) stop from h)
select e.conv_id, title, cast(coalesce(sum(len(regexp_extract_all(line, '[A-Za-z]+'))), 0) as bigint) words from e left join l on l.conv_id = e.conv_id and l.i > e.i and l.i < stop group by e.conv_id, e.i, title""")
def doc_sections(spark, d):
    """Words under each heading, those of deeper headings included: to the next one of the same level or above."""
    from pyspark.sql import Window

    mark = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("### ")
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat(mark, "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.replace("text", F.lit("#"), F.lit(""))).alias("t")).alias("x"))
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("t"))
    lines = t.select("conv_id", F.posexplode(F.split("t", "\n")).alias("i", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    lines = lines.select("conv_id", "i", F.when(F.col("line").rlike(r"^#{1,6}\s+"), level).alias("lvl"), F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*$", 1).alias("title"), F.regexp_count("line", F.lit("[A-Za-z]+")).alias("n"))
    lines = lines.withColumn("body", F.when(F.col("lvl").isNull(), F.col("n")).otherwise(0)).withColumn("head", F.when(F.col("lvl").isNotNull(), F.col("n")).otherwise(0))
    w = Window.partitionBy("conv_id").orderBy("i")
    lines = lines.withColumn("sum", F.sum("n").over(w))
    after = Window.partitionBy("conv_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)  # running, from the end
    # for each level, the words before the next heading at that level or above
    stop = F.coalesce(*[F.when(F.col("lvl") == k, F.coalesce(F.last(F.when(F.col("lvl") <= k, F.col("sum") - F.col("n")), ignorenulls=True).over(after), F.max("sum").over(Window.partitionBy("conv_id")))) for k in range(1, 7)])
    return lines.withColumn("stop", stop).where("lvl is not null").select("conv_id", "title", (F.col("stop") - F.col("sum")).alias("words"))
