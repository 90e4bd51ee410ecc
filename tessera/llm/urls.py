"""Op 4, URL filters: pattern rules found by their rarest literal token. DataFrame functions only.

A rule is a host with its subdomains and a path prefix, or a pattern in which * is anything, ^ an end of a token
and || the start of a host label. Each rule is kept under one of its literal tokens: the one that the fewest urls of
the table have (counted for the rules' tokens only). A url's distinct tokens fetch the rules kept under them, and
only those run their regular expressions. The index is a literal of the plan, a hash table of SLOTS lists, so a url
needs no shuffle. Rules that take more than `most_bytes` are a written table instead, joined with the urls' tokens;
that gives the same rows.

The longest fitting host rule decides. Without one, a fitting pattern does (block before allow), else `allow`.

Defined results. Null url or no ://: host and path empty, no rule, allow. A host may be empty, hold a port or user;
those belong to it. Rules that tie in length are taken in text order. Repeated rows are judged each. A very long url
is judged in whole, each of its distinct tokens looked up once. Extra columns, whatever their names, aren't read.
Empty table: empty result. No rules: all are allowed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, stored

#: Of rules in the plan.
MOST_BYTES = 4_000_000
SLOTS = 1024
TOKEN = r"[^0-9A-Za-z]+"

#: (host, path, verdict)
HOST_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: (pattern, verdict) for urls that no host rule fits: farms, pills, casinos and session traps.
PATTERNS = [("||spam-farm^", "block"), ("||cheap-pills^", "block"), ("||casino^", "block"), ("/login^", "block"), ("/cart^", "block"), ("?sessionid=", "block"), ("^adserver^", "block")]


def host_rule(host: str, path: str, verdict: str) -> dict:
    """Whole tokens: those of the host, and those of the path that end before its end."""
    tokens = re.split(TOKEN, host) + re.split(TOKEN, path)[:-1]
    return {"name": host + path, "rank": len(host + path), "verdict": verdict, "regex": rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", "tokens": [t for t in tokens if t]}


def pattern_rule(pattern: str, verdict: str) -> dict:
    regex, body = r"(?s)", pattern
    if body.startswith("||"):
        regex, body = r"(?s)\A(?:[^/]*\.)?", body[2:]
    marks = {"*": ".*", "^": r"(?:[^0-9A-Za-z]|\z)"}
    regex += "".join(marks.get(c, re.escape(c)) for c in body)
    closed = "^" + body if pattern.startswith("||") else body
    tokens = re.findall(r"(?<=[^0-9A-Za-z*])[0-9A-Za-z]+(?=[^0-9A-Za-z*])", closed)
    if not tokens:
        raise ValueError(f"no literal token in {pattern!r}")
    return {"name": None, "rank": 0, "verdict": verdict, "regex": regex, "tokens": tokens}


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """host, path, and what follows the host."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.regexp_replace(rest, r"(?s)\A[^/?#]*", "")
    return host, F.regexp_extract(after, r"(?s)\A[^?#]*", 0), after


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.split(text, TOKEN))


def judged(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: list[tuple[str, str, str]] = HOST_RULES, patterns: list[tuple[str, str]] = PATTERNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_candidates)."""
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(*p) for p in patterns]
    host, path, after = split_url(F.col("_url"))
    df = urls.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("_url")).select("page_id", host.alias("host"), path.alias("path"), after.alias("_after"))
    if sum(len(r["regex"]) + sum(map(len, r["tokens"])) for r in rules) > most_bytes:
        return _by_table(df, rules)
    wanted = sorted({t for r in rules for t in r["tokens"]})
    known = F.array_intersect(tokens_of(F.concat("host", "_after")), F.array(*map(F.lit, wanted)).cast("array<string>"))
    seen = {r.token: r["count"] for r in df.select(F.explode(known).alias("token")).groupBy("token").count().collect()} if rules else {}
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    spark = urls.sparkSession
    rare = [min(r["tokens"], key=lambda t: (seen.get(t, 0), t)) for r in rules]
    at = spark.createDataFrame([(i, t) for i, t in enumerate(rare)], "i int, t string").select("i", F.pmod(F.xxhash64("t"), F.lit(SLOTS)).alias("s")).collect()
    for i, s in at:
        slots[s].append({"token": rare[i]} | {k: rules[i][k] for k in ("name", "rank", "verdict", "regex")})
    kind = "array<array<struct<token:string,name:string,rank:int,verdict:string,regex:string>>>"
    index = F.from_json(F.lit(json.dumps(slots)), kind)
    whole = F.concat("host", "_after")
    fetched = F.flatten(F.transform(tokens_of(whole), lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")), lambda r: r["token"] == t)))
    df = df.withColumn("_whole", F.concat("host", "path")).withColumn("_fetched", fetched)
    # a host rule reads host and path; a pattern also what follows
    fits = F.transform(F.array(F.struct(F.col("_whole").alias("w"), whole.alias("a"), F.col("_fetched").alias("f"))), lambda x: F.filter(x["f"], lambda r: F.rlike(F.when(r["name"].isNull(), x["a"]).otherwise(x["w"]), r["regex"])))[0]
    df = df.withColumn("_fits", fits)
    best = F.array_sort(F.transform(F.filter("_fits", lambda r: r["name"].isNotNull()), lambda r: F.struct((-r["rank"]).alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    other = F.when(F.exists("_fits", lambda r: r["verdict"] == "block"), "block").otherwise("allow")
    df = df.withColumn("_best", F.get(best, F.lit(0)))
    return df.select("page_id", "host", "path", F.col("_best.name").alias("rule"), F.coalesce("_best.verdict", other).alias("verdict"), F.size("_fetched").cast("long").alias("n_candidates"))


def _by_table(df: DataFrame, rules: list[dict]) -> DataFrame:
    """`judged` with the index as a table. df: page_id, host, path, _after."""
    spark = df.sparkSession
    kind = "i int, name string, rank int, verdict string, regex string, tokens array<string>"
    table = stored(spark.createDataFrame([(i, r["name"], r["rank"], r["verdict"], r["regex"], sorted(set(r["tokens"]))) for i, r in enumerate(rules)], kind), "url-rules")
    df = stored(df.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    words = df.select("row", F.explode(tokens_of(F.concat("host", "_after"))).alias("token"))
    own = table.select("i", F.explode("tokens").alias("token"))
    seen = words.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rare = own.join(seen, "token", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
    index = stored(table.drop("tokens").join(rare.select("i", "least.token"), "i"), "url-index")
    fetched = words.join(index, "token").join(df.select("row", F.concat("host", "path").alias("w"), F.concat("host", "_after").alias("a")), "row")
    fits = F.rlike(F.when(F.col("name").isNull(), F.col("a")).otherwise(F.col("w")), F.col("regex"))
    best = F.min(F.when(fits & F.col("name").isNotNull(), F.struct((-F.col("rank")).alias("rank"), "name", "verdict")))
    found = fetched.groupBy("row").agg(best.alias("best"), F.max(fits & F.col("name").isNull() & (F.col("verdict") == "block")).alias("bad"), F.count("*").alias("n"))
    verdict = F.coalesce("best.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return df.join(found, "row", "left").select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


#: DuckDB SQL for host, path, rule and verdict over pages, with the fixed rules above.
ORACLE = r"""
with u as (
  select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end rest from pages),
h as (
  select page_id, rest, translate(regexp_extract(rest, '(?s)\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_replace(rest, '(?s)\A[^/?#]*', '') rest2 from u),
p as (
  select page_id, host, regexp_extract(rest2, '(?s)\A[^?#]*') path, host || rest2 w from h),
r(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (
  select page_id, arg_max(struct_pack(rule := rh || rp, verdict := rv), length(rh || rp)) b
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1)
select p.page_id, host, path, f.b.rule rule,
  coalesce(f.b.verdict, case when regexp_matches(w, '(?s)\A(?:[^/]*\.)?(?:spam-farm|cheap-pills|casino)(?:[^0-9A-Za-z]|\z)')
    or regexp_matches(w, '/(?:login|cart)(?:[^0-9A-Za-z]|\z)') or contains(w, '?sessionid=')
    or regexp_matches(w, '[^0-9A-Za-z]adserver(?:[^0-9A-Za-z]|\z)') then 'block' else 'allow' end) verdict
from p left join f on p.page_id = f.page_id
"""
