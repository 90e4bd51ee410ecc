"""Queries of the scoring engine, over small tables made from the test tables' counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import table
from ..operators import gates
from .registry import query

GATES = """
with g as (select p_partkey gid, p_size % 5 stage, case p_partkey % 5 when 0 then '>=' when 1 then '<=' when 2 then '>' when 3 then '<' else '==' end cmp, p_size::double target, p_partkey % 4 <> 0 lower, p_partkey % 3 = 0 timing from part),
r as (select p_partkey gid, case when p_partkey % 17 = 0 then 'error' when p_partkey % 19 = 0 then 'not-implemented' else 'ok' end outcome, p_partkey % 23 <> 0 covered, (p_partkey % 29 = 0)::int exit_code, case when p_partkey % 31 <> 0 then (p_partkey % 50)::double end v from part where p_partkey % 13 <> 0),
s as (select gid, stage, v "value", case when outcome is null then 'N/A-yet' when outcome = 'error' then 'ERROR' when outcome = 'not-implemented' then 'N/A-yet' when not covered then 'FAIL' when exit_code <> 0 then 'ERROR' when v is null then 'ERROR'
  when (cmp = '>=' and v >= target) or (cmp = '<=' and v <= target) or (cmp = '>' and v > target) or (cmp = '<' and v < target) or (cmp = '==' and v = target) then 'PASS' else 'FAIL' end status from g left join r using (gid))
"""


def scored(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, d, "part")
    words = F.array(*map(F.lit, [">=", "<=", ">", "<", "=="]))
    g = part.select(k.alias("gid"), (size % 5).alias("stage"), F.get(words, (k % 5).cast("int")).alias("cmp"), size.cast("double").alias("target"))
    outcome = F.when(k % 17 == 0, "error").when(k % 19 == 0, "not-implemented").otherwise("ok")
    r = part.where(k % 13 != 0).select(k.alias("gid"), outcome.alias("outcome"), (k % 23 != 0).alias("covered"), (k % 29 == 0).cast("int").alias("exit_code"), F.when(k % 31 != 0, (k % 50).cast("double")).alias("value"))
    return gates.status(g, r)


@query(GATES + "select * from s")
def gate_status(spark, d):
    return scored(spark, d)


@query(GATES + "select stage, case when bool_or(status in ('FAIL', 'ERROR', 'STALE')) then 'BLOCKED' when bool_or(status = 'N/A-yet') then 'IN PROGRESS' else 'CLEAR' end state, count(*) gates from s group by 1")
def stage_state(spark, d):
    return gates.stage_state(scored(spark, d))


@query(GATES + """
, t as (select stage + 10 * (gid % 2)::int stage, case when stage = 3 then 'PASS' when stage = 1 and gid % 2 = 0 then case when status in ('FAIL', 'ERROR') then 'N/A-yet' else status end else status end status from s),
st as (select stage, case when bool_or(status in ('FAIL', 'ERROR', 'STALE')) then 'BLOCKED' when bool_or(status = 'N/A-yet') then 'IN PROGRESS' else 'CLEAR' end state from t group by 1)
select 'all' scope, case when bool_or(state = 'BLOCKED') then 'BLOCKED' when bool_or(state <> 'CLEAR') then 'IN PROGRESS' else 'DELIVERED' end delivery, coalesce(string_agg(case when state <> 'CLEAR' then stage || ': ' || state end, '; ' order by stage::varchar || ': ' || state), '') reasons from st
union all select 'open', case when bool_or(state = 'BLOCKED') then 'BLOCKED' when bool_or(state <> 'CLEAR') then 'IN PROGRESS' else 'DELIVERED' end, coalesce(string_agg(case when state <> 'CLEAR' then stage || ': ' || state end, '; ' order by stage::varchar || ': ' || state), '') from st where stage in (1, 3)
union all select 'clear', case when bool_or(state = 'BLOCKED') then 'BLOCKED' when bool_or(state <> 'CLEAR') then 'IN PROGRESS' else 'DELIVERED' end, coalesce(string_agg(case when state <> 'CLEAR' then stage || ': ' || state end, '; ' order by stage::varchar || ': ' || state), '') from st where stage in (3, 13)""")
def delivery_state(spark, d):
    """Delivery over stages of which some are blocked, some open and some clear."""
    k, stage, status = F.col("gid"), F.col("stage"), F.col("status")
    word = F.when(stage == 3, "PASS").when((stage == 1) & (k % 2 == 0) & status.isin("FAIL", "ERROR"), "N/A-yet").otherwise(status)
    states = gates.stage_state(scored(spark, d).select("gid", word.alias("status"), (stage + 10 * (k % 2)).cast("int").alias("stage")))
    out = [gates.delivery(states.where(which)).withColumn("scope", F.lit(name)) for name, which in (("all", "true"), ("open", "stage in (1, 3)"), ("clear", "stage in (3, 13)"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(GATES + """
, b as (select gid, (gid % 41)::double base, gid % 2 = 0 waived, case when gid % 7 = 0 then 'FAIL' else 'PASS' end base_status from g where gid % 6 <> 0),
x as (select s.gid, s."value" v, s.status, g.lower, g.timing, base, waived, base_status, case when waived and not timing then 0.02 else 0.05 end tol from s join g using (gid) left join b using (gid) where s."value" is not null)
select gid, coalesce(case when lower then v > case when base > 0 then base * (1 + tol) else base + 1e-9 end else v < base * (1 - tol) end, false) worse, coalesce(base_status in ('PASS', 'WAIVED') and status = 'FAIL', false) lost,
  case when status in ('PASS', 'WAIVED') and (base is null or case when lower then v <= base else v >= base end) then v else base end next_value from x""")
def ratchet(spark, d):
    k = F.col("gid")
    now = scored(spark, d).select("gid", "value", "status", (k % 4 != 0).alias("lower_is_better"), (k % 3 == 0).alias("timing"))
    base = table(spark, d, "part").select(F.col("p_partkey").alias("gid")).where(k % 6 != 0)
    base = base.select("gid", (k % 41).cast("double").alias("base"), (k % 2 == 0).alias("waived"), F.when(k % 7 == 0, "FAIL").otherwise("PASS").alias("base_status"))
    return gates.ratchet(now, base)


WAIVERS = GATES + """
, w as (select gid, case when gid % 4 = 0 then 'HARD' else 'SOFT' end type, gid % 9 iterations, gid % 5 strategies, case when gid % 8 <> 0 then (gid % 37)::double end prior, (gid % 50)::double v, target t, gid % 3 = 0 perf, lower from g),
pr as (select gid, perf, array_to_string(list_filter([case when type = 'HARD' then 'hard' end, case when iterations < 5 then 'iterations' end, case when strategies < 3 then 'strategies' end, case when prior is null then 'no-history' end,
  case when abs(v - t) > abs(prior - t) * 1.02 then 'regressing' end, case when perf and t <> 0 and case when lower then v / t else t / nullif(v, 0) end > 2 then 'over-cap' end], lambda x: x is not null), ',') problems from w)
"""


@query(WAIVERS + "select gid, problems from pr")
def waiver_check(spark, d):
    return waived(spark, d).select("gid", F.array_join("problems", ",").alias("problems"))


@query(WAIVERS + "select count(*) filter (perf and problems = '') perf_waivers, count(*) filter (perf and problems = '') > 2 over_cap from pr")
def waiver_cap(spark, d):
    """Waivers of performance gates that hold, of which there may be two."""
    own = waived(spark, d)
    return gates.waiver_cap(own.withColumn("perf", F.col("gid") % 3 == 0))


@query(WAIVERS + """
, b as (select gid, (gid % 41)::double base, gid % 2 = 0 waived, case when gid % 7 = 0 then 'FAIL' else 'PASS' end base_status from g where gid % 6 <> 0),
x as (select s.gid, s.stage, s."value" v, s.status, g.lower, base, base_status, case when b.waived and not g.timing then 0.02 else 0.05 end tol, problems = '' held, s.gid % 15 = 4 changed from s join g using (gid) left join b using (gid) join pr using (gid)),
y as (select *, coalesce(case when v is not null then case when lower then v > case when base > 0 then base * (1 + tol) else base + 1e-9 end else v < base * (1 - tol) end end, false) worse from x)
select gid, stage, case when changed and status <> 'N/A-yet' then 'STALE' when status = 'FAIL' and held then 'WAIVED' when status = 'PASS' and worse then 'FAIL' else status end status,
  case when changed and status <> 'N/A-yet' then 'frozen files changed' when status = 'FAIL' and held then 'waived' when status = 'PASS' and worse then 'worse than baseline' end note from y""")
def gate_chain(spark, d):
    """Run, freeze, waiver and ratchet in one: what each gate comes to, and why."""
    k = F.col("gid")
    now = scored(spark, d).withColumns({"lower_is_better": k % 4 != 0, "timing": k % 3 == 0})
    base = table(spark, d, "part").select(F.col("p_partkey").alias("gid")).where(k % 6 != 0)
    base = base.select("gid", (k % 41).cast("double").alias("base"), (k % 2 == 0).alias("waived"), F.when(k % 7 == 0, "FAIL").otherwise("PASS").alias("base_status"))
    frozen = table(spark, d, "part").select(F.col("p_partkey").alias("gid"), F.lit("changed").alias("finding")).where(k % 15 == 4)
    return gates.chain(now, base, waived(spark, d), frozen.union(frozen))


def waived(spark, d):
    k = F.col("p_partkey")
    w = table(spark, d, "part").select(
        k.alias("gid"), F.when(k % 4 == 0, "HARD").otherwise("SOFT").alias("type"), (k % 9).alias("iterations"), (k % 5).alias("strategies"), F.when(k % 8 != 0, (k % 37).cast("double")).alias("before"),
        (k % 50).cast("double").alias("value"), F.col("p_size").cast("double").alias("target"), (k % 3 == 0).alias("perf"), (k % 4 != 0).alias("lower_is_better"),
    )
    return gates.waivers(w)


LICENCES = ["MIT OR Apache-2.0", "GPL-3.0", "MIT AND GPL-3.0", "GPL-3.0 OR MIT", "", "Weird-1.0", "MIT/Apache-2.0", "(MIT AND BSD-3-Clause) or GPL-2.0", "Apache-2.0 WITH LLVM-exception", "GPL-2.0 OR AGPL-3.0", "Weird-1.0 OR GPL-2.0"]


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""
with d as (select p_partkey, case when p_partkey % 97 <> 0 then [{", ".join(f"'{x}'" for x in LICENCES)}][p_partkey % {len(LICENCES)} + 1] || case p_size % 3 when 0 then '' when 1 then ' OR ' else ' AND ' end || case when p_size % 3 = 0 then '' else [{", ".join(f"'{x}'" for x in LICENCES)}][p_partkey // 13 % {len(LICENCES)} + 1] end end licence from part),
a as (select p_partkey, unnest(regexp_split_to_array(coalesce(licence, ''), '(?i)\\s+OR\\s+|/')) alt, generate_subscripts(regexp_split_to_array(coalesce(licence, ''), '(?i)\\s+OR\\s+|/'), 1) i from d),
p as (select p_partkey, i, unnest(regexp_split_to_array(regexp_replace(alt, '[()]', '', 'g'), '(?i)\\s+AND\\s+')) part from a),
j as (select p_partkey, i, bool_and(trim(part) in {_in(gates.ALLOWED)}) ok, bool_or(trim(part) in {_in(gates.INCOMPATIBLE)}) bad from p group by all)
select p_partkey::varchar "name", case when bool_or(ok) then 'allowed' when bool_and(bad) then 'incompatible' else 'unknown' end verdict from j group by 1""")
def licence_verdicts(spark, d):
    """A dependency a part, whose licence is made of one or two of a list."""
    k, size = F.col("p_partkey"), F.col("p_size")
    words = F.array(*map(F.lit, LICENCES))
    of = lambda n: F.get(words, (n % len(LICENCES)).cast("int"))
    more = F.when(size % 3 == 0, "").otherwise(F.concat(F.when(size % 3 == 1, " OR ").otherwise(" AND "), of(F.floor(k / 13))))
    return gates.licences(table(spark, d, "part").select(k.cast("string").alias("name"), F.when(k % 97 != 0, F.concat(of(k), more)).alias("licence")))


@query("""
with a as (select o_orderkey path, md5(o_orderstatus) hash from orders where o_orderkey % 5 <> 0), b as (select o_orderkey path, md5(case when o_orderkey % 9 = 0 then 'x' else o_orderstatus end) hash from orders where o_orderkey % 7 <> 0)
select path, finding from (select path, case when a.hash is null then 'added' when b.hash is null then 'missing' when a.hash <> b.hash then 'changed' end finding from a full join b using (path)) where finding is not null""")
def freeze_diff(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    a = o.where(k % 5 != 0).select(k.alias("path"), F.md5(F.col("o_orderstatus").cast("binary")).alias("hash"))
    b = o.where(k % 7 != 0).select(k.alias("path"), F.md5(F.when(k % 9 == 0, "x").otherwise(F.col("o_orderstatus")).cast("binary")).alias("hash"))
    return gates.closure_diff(a, b)


@query("select l_shipdate::date - date '1992-01-01' >= 1200 late, count(*) filter (l_returnflag = 'R') killed, count(*) filter (l_returnflag = 'N') missed, round(count(*) filter (l_returnflag = 'R')::double / nullif(count(*) filter (l_returnflag in ('R', 'N')), 0), 6) score from lineitem group by 1")
def kill_rate(spark, d):
    """Killed over killed and missed; anything else counts for neither."""
    late = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) >= 1200
    n = table(spark, d, "lineitem").groupBy(late.alias("late")).agg(F.count_if(F.col("l_returnflag") == "R").alias("killed"), F.count_if(F.col("l_returnflag") == "N").alias("missed"))
    return n.withColumn("score", F.round(F.col("killed").cast("double") / F.nullif(F.col("killed") + F.col("missed"), F.lit(0)), 6))


@query("""
select event_id line, case when event_id % 11 = 0 then 'error,category,concept,recovery' else array_to_string(list_filter([case when event_id % 7 = 0 then 'error' end, case when event_id % 5 = 0 then 'category' end, case when event_type = 'error' then 'concept' end, case when event_id % 3 = 0 then 'recovery' end], lambda x: x is not null), ',') end missing,
  case when event_id % 11 = 0 or event_id % 3 = 0 then '' when event_type in ('click', 'view') then event_type else '' end "unknown" from events""")
def error_doc_audit(spark, d):
    """An error document an event: fields that are missing or empty, and commands in the advice that don't exist; some aren't JSON."""
    k, kind = F.col("event_id"), F.col("event_type")
    advice = F.concat(F.lit("run `save`, then `"), F.when(kind.isin("click", "view"), kind).otherwise("undo"), F.lit("` and `save`"))
    doc = F.to_json(F.struct(F.when(k % 7 != 0, "e").alias("error"), F.when(k % 5 != 0, "c").alias("category"), F.when(kind == "error", "").otherwise("k").alias("concept"), F.when(k % 3 != 0, advice).alias("recovery")))
    docs = table(spark, d, "events").select(k.alias("line"), F.when(k % 11 == 0, "not json").otherwise(doc).alias("json"))
    found = gates.error_audit(docs, ["save", "undo", "log"])
    return found.select("line", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


@query("""
with t as (select user_id % 20 target, sum(value) as hrs, count(*) filter (event_type = 'error' and event_id % 3 <> 0) outstanding from events group by 1) select target, round(hrs, 4) as hours, outstanding, hrs < 24000 short from t""")
def fuzz_outstanding(spark, d):
    """Findings that nobody has triaged, and targets below their hours."""
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("target"), "event_id", "event_type", "value")
    open_ = e.where("event_type = 'error'").join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").groupBy("target").agg(F.count("*").alias("outstanding"))
    t = e.groupBy("target").agg(F.sum("value").alias("hours")).join(open_, "target", "left")
    return t.select("target", F.round("hours", 4).alias("hours"), F.coalesce("outstanding", F.lit(0)).alias("outstanding"), (F.col("hours") < 24000).alias("short"))


@query("""
with j as (select n_regionkey platform, c_nationkey % 3 = 0 stale, bool_and(c_custkey % 600 <> 599) ok, bool_or(c_custkey % 4 = 0) step from customer join nation on n_nationkey = c_nationkey group by all),
r as (select stale, count(*) platforms, count(*) filter (ok and step) passed from j group by 1)
select stale, platforms, passed, case when stale then 0 else passed end "value" from r""")
def platform_pass(spark, d):
    """Platforms whose jobs all succeeded and whose needed step ran; a run of another commit than the current one counts as none."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    jobs = c.select(F.col("n_regionkey").alias("platform"), (F.col("c_nationkey") % 3 == 0).alias("stale"), (F.col("c_custkey") % 600 != 599).alias("ok"), (F.col("c_custkey") % 4 == 0).alias("step"))
    j = jobs.groupBy("platform", "stale").agg(F.bool_and("ok").alias("ok"), F.bool_or("step").alias("step"))
    n = j.groupBy("stale").agg(F.count("*").alias("platforms"), F.count_if(F.col("ok") & F.col("step")).alias("passed"))
    return n.withColumn("value", F.when(F.col("stale"), 0).otherwise(F.col("passed")))


@query("""
with a as (select p_partkey path, md5(p_name) digest, p_size mode, case when p_partkey % 12 = 0 then '../' || p_brand end link from part where p_partkey % 9 <> 0), b as (select p_partkey path, md5(case when p_partkey % 8 = 0 then '' else p_name end) digest, case when p_partkey % 10 = 0 then 0 else p_size + 512 end mode, case when p_partkey % 24 = 0 then null when p_partkey % 36 = 12 then '/' || p_brand when p_partkey % 12 = 0 then '../' || p_brand end link from part where p_partkey % 11 <> 0)
select a.path, 'digest' finding from a join b using (path) where a.digest <> b.digest union all select a.path, 'mode' from a join b using (path) where a.mode & 511 <> b.mode & 511
union all select a.path, 'link' from a join b using (path) where a.link is distinct from b.link
union all select path, 'only-source' from a where path not in (select path from b) union all select path, 'only-target' from b where path not in (select path from a)""")
def manifest_findings(spark, d):
    """Where a copy isn't the original: bytes, mode's last nine bits, a link's target, or the set of paths either way."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    a = p.where(k % 9 != 0).select(k.alias("path"), F.md5(F.col("p_name").cast("binary")).alias("da"), F.col("p_size").alias("ma"), F.when(k % 12 == 0, F.concat(F.lit("../"), "p_brand")).alias("la"))
    b = p.where(k % 11 != 0).select(k.alias("path"), F.md5(F.when(k % 8 == 0, "").otherwise(F.col("p_name")).cast("binary")).alias("db"), F.when(k % 10 == 0, 0).otherwise(F.col("p_size") + 512).alias("mb"), F.when(k % 24 == 0, None).when(k % 36 == 12, F.concat(F.lit("/"), "p_brand")).when(k % 12 == 0, F.concat(F.lit("../"), "p_brand")).alias("lb"))
    found = F.array_compact(F.array(
        F.when(F.col("da").isNull(), "only-target"), F.when(F.col("db").isNull(), "only-source"), F.when(F.col("da") != F.col("db"), "digest"), F.when(F.col("ma").bitwiseAND(511) != F.col("mb").bitwiseAND(511), "mode"),
        F.when(F.col("da").isNotNull() & F.col("db").isNotNull() & ~F.col("la").eqNullSafe(F.col("lb")), "link"),
    ))
    return a.join(b, "path", "full_outer").select("path", F.explode(found).alias("finding"))


@query("""
with g as (select p_partkey gid from part where p_partkey % 10 <> 3),
r as (select p_partkey gid, case when p_partkey % 6 = 0 then 'e' || p_partkey % 100 end evidence from part where p_partkey % 7 <> 2 union all select p_partkey, null from part where p_partkey % 50 = 1),
e as (select distinct 'e' || p_size path from part), n as (select gid, count(*) n from r group by 1)
select gid, finding from (select coalesce(g.gid, n.gid) gid, case when g.gid is null then 'not in the registry' when n is null then 'no result' when n > 1 then 'more than one result' end finding from g full join n on g.gid = n.gid) where finding is not null
union all select distinct gid, 'evidence is missing' from r where evidence is not null and evidence not in (select path from e)""")
def scorecard_integrity(spark, d):
    """A scorecard against the registry of gates, both ways, and the evidence that it names."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    named = F.when(k % 6 == 0, F.concat(F.lit("e"), (k % 100).cast("string")))
    results = p.where(k % 7 != 2).select(k.alias("gid"), named.alias("evidence")).union(p.where(k % 50 == 1).select(k, F.lit(None).cast("string")))
    return gates.scorecard(p.where(k % 10 != 3).select(k.alias("gid")), results, p.select(F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("path")))
