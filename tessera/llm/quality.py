"""Op 8, quality rules: fixed base rules, then limits that adapt to each language and source. DataFrame functions only.

Each text is read once: its measures are a written table, from which limits and verdicts come. Three shares (of
symbols, of capitals and exclamation marks, of repeated lines; per 10,000) get a limit for each (lang, source): third
quartile + REACH * max(interquartile range, least spread). The quartiles come from a mergeable sketch with bins that
double in width after every 64 (exact up to 127, within 1/64 above): counts by (lang, source, share, bin) add up in any
order, on the map side first, so the limits don't depend on partitions and a hot source is a few hundred rows. All
documents are counted, also those that the base rules reject.

Sketches merge upwards, from source to language to corpus. A group of fewer than LEAST_GROUP documents takes its
language's limit, a language of fewer the corpus's; and no limit is above WIDER times that of the level above, so a
group that is mostly junk doesn't set its own limit at its junk.

The limits join the documents by (lang, source), nulls equal. They are broadcast once they are counted and are
BROADCAST_ROWS at most; with more groups the join is left to Spark.

Defined results. Null or empty text: no words, base_failed. Null lang or source: a group like any other. A document
with a share equal to its limit is kept. Repeated rows count and are judged each. A very long text is measured in
whole; words and window hashes are arrays of one row. Empty table: empty result. Extra columns, whatever their names,
are kept in a struct and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, stored, whole_row

GAP = r"[\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30
#: share -> its least spread, per 10,000
SHARES = {"symbols": 50, "shouts": 100, "lines": 500}
REACH = 8
LEAST_GROUP = 40
WIDER = 2
BROADCAST_ROWS = 100_000


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(GAPS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more.

    Each array is bound by let(): where the optimizer moves a filter on the result below a projection, it puts the
    expression of a column in the column's place, and within a lambda that would be computed for every element.
    """

    def covered(at: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, begin, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def places(s: Column) -> Column:
        def same(k: Column, step: int) -> Column:
            return F.coalesce(F.get(s, k)["h"] == F.get(s, k + step)["h"], F.lit(False))

        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def counted(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(pairs, places), covered)).otherwise(0)

    def joined(have: Column, step: int) -> Column:
        """The hashes of stretches twice as long: each with the one `step` words on."""
        return let(have, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(1 + step), F.size(h) - step), lambda x, y: F.xxhash64(x, y)))

    def hashes(w: Column) -> Column:
        found, length = F.transform(w, lambda x: F.xxhash64(x)), 1
        while length < WINDOW:  # a power of two
            found, length = joined(found, length), 2 * length
        return found

    return let(words, lambda w: F.when(F.size(w) >= WINDOW, let(hashes(w), counted)).otherwise(0)).cast("long")


def shares(df: DataFrame, text: str = "_text") -> DataFrame:
    """Adds n_symbols, n_dup_lines, word_chars and the shares of SHARES, from one reading of the text."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(GAPS)) != "")
    df = df.withColumns({
        "word_chars": F.length(F.regexp_replace(t, GAP, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_shouts": F.regexp_count(t, F.lit("[A-Z!]")).cast("long"),
        "_lines": lines,
    })
    df = df.withColumns({"_n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    part = lambda n, whole: F.expr(f"{n} * 10000 div greatest({whole}, 1)")
    return df.withColumns({"symbols": part("n_symbols", "word_chars"), "shouts": part("_shouts", "word_chars"), "lines": part("n_dup_lines", "_n_lines")}).drop("_lines", "_shouts", "_n_lines")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, _lang, _source, MEASURES, SHARES), a written table; row has the columns `keep` of docs, or all."""
    df = docs.select(whole_row(docs.select(*map(quoted, keep)) if keep else docs).alias("row"), quoted(lang_col).alias("_lang"), quoted(source_col).alias("_source"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("_text"))
    df = shares(df).withColumn("_words", words_of(F.col("_text"))).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("n_repeat_words", repeated_words(F.col("_words"))).drop("_words", "_text")
    df = df.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    return stored(df.select("row", "_lang", "_source", *MEASURES, *SHARES), "quality-measures")


def limits(measures: DataFrame) -> DataFrame:
    """(_lang, _source, and a limit for each share) from the sketches, as a written table."""
    bin_of = "case when x < 128 then x else x - pmod(x, shiftleft(1L, length(bin(x)) - 7)) end"
    each = measures.select("_lang", "_source", F.explode(F.create_map(*[y for s in SHARES for y in (F.lit(s), F.col(s))])).alias("share", "x"))
    sketch = stored(each.selectExpr("_lang", "_source", "share", f"{bin_of} as bin").groupBy("_lang", "_source", "share", "bin").agg(F.count("*").alias("n")), "quality-sketch")

    def quantile(k: int) -> str:  # the bin of rank ceil(k / 4 * total)
        return f"aggregate(bins, struct(0L as seen, cast(null as bigint) as at), (a, b) -> struct(a.seen + b.n as seen, case when a.at is null and 4 * (a.seen + b.n) >= {k} * total then b.bin else a.at end as at), a -> a.at)"

    spread = "case share " + " ".join(f"when '{s}' then {n}" for s, n in SHARES.items()) + " end"

    def fences(level: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*level, "share", "bin").agg(F.sum("n").alias("n")) if len(level) < 2 else sketch
        merged = merged.groupBy(*level, "share").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
        return merged.selectExpr(*level, "share", "total", f"{quantile(1)} as q1", f"{quantile(3)} as q3").selectExpr(*level, "share", f"total as total_{name}", f"q3 + {REACH} * greatest(q3 - q1, {spread}) as most_{name}")

    def narrowed(name: str, above: str) -> str:
        return f"case when total_{name} >= {LEAST_GROUP} then least(most_{name}, {WIDER} * {above}) else {above} end"

    own, lang, all_ = fences(["_lang", "_source"], "own"), fences(["_lang"], "lang"), fences([], "all")
    lang = lang.join(all_, "share").selectExpr("_lang as _l", "share as _share", f"{narrowed('lang', 'most_all')} as above")
    own = own.join(lang, own["_lang"].eqNullSafe(lang["_l"]) & (own["share"] == lang["_share"])).selectExpr("_lang", "_source", "share", f"{narrowed('own', 'above')} as most")
    return stored(own.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("share") == s, F.col("most"))).alias(f"most_{s}") for s in SHARES]), "quality-limits")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept); row has the columns `keep` of docs, or all."""
    df = measured(docs, text_col, lang_col, source_col, keep)
    most = limits(df)
    most = F.broadcast(most) if most.count() <= BROADCAST_ROWS else most
    most = most.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    df = df.join(most, df["_lang"].eqNullSafe(most["_l"]) & df["_source"].eqNullSafe(most["_s"]), "left")
    kept = ~F.col("base_failed")
    for s in SHARES:
        kept &= F.col(s) <= F.col(f"most_{s}")
    return df.select("row", *MEASURES, F.coalesce(kept, F.lit(False)).alias("kept"))


def clean(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs that are kept."""
    return judged(docs, **kw).where("kept").select("row.*")


_W = r"[^\x20\x09-\x0D]"
#: DuckDB SQL for `judged` over documents, with the fixed values above.
ORACLE = rf"""
with base as (
  select doc_id, lang, source, coalesce(text, '') t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) ln,
    regexp_extract_all(coalesce(text, ''), '{_W}+') ws
  from documents),
m as (
  select *, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, len(regexp_extract_all(t, '[A-Z!]'))::bigint n_shouts,
    (len(ln) - len(list_distinct(ln)))::bigint n_dup_lines
  from base),
s as (
  select *, n_symbols * 10000 // greatest(word_chars, 1) symbols, n_shouts * 10000 // greatest(word_chars, 1) shouts,
    n_dup_lines * 10000 // greatest(len(ln), 1) lines
  from m),
x as (
  select lang, source, 'symbols' share, symbols x, 50 spread from s
  union all select lang, source, 'shouts', shouts, 100 from s
  union all select lang, source, 'lines', lines, 500 from s),
v as (
  select lang, source, share, spread, case when x < 128 then x else x - x % (1::bigint << (length(bin(x)) - 7)::bigint) end bin from x),
b as (
  select 0 level, lang, source, share, spread, bin, count(*) n from v group by all
  union all select 1, lang, null, share, spread, bin, count(*) from v group by all
  union all select 2, null, null, share, spread, bin, count(*) from v group by all),
c as (
  select *, sum(n) over (partition by level, lang, source, share order by bin) seen, sum(n) over (partition by level, lang, source, share) total from b),
q as (
  select level, lang, source, share, spread, total, min(bin) filter (4 * seen >= total) q1, min(bin) filter (4 * seen >= 3 * total) q3
  from c group by all),
f as (select level, lang, source, share, total, q3 + {REACH} * greatest(q3 - q1, spread) most from q),
l1 as (
  select a.lang, a.share, case when a.total >= {LEAST_GROUP} then least(a.most, {WIDER} * z.most) else z.most end above
  from f a join f z on a.level = 1 and z.level = 2 and a.share = z.share),
l0 as (
  select a.lang, a.source, a.share, case when a.total >= {LEAST_GROUP} then least(a.most, {WIDER} * above) else above end most
  from f a join l1 on a.level = 0 and a.lang is not distinct from l1.lang and a.share = l1.share),
lim as (
  select lang, source, max(most) filter (share = 'symbols') ms, max(most) filter (share = 'shouts') mh, max(most) filter (share = 'lines') ml
  from l0 group by all),
p as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from base),
g as (
  select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and 7 following) g from p),
d as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) k from g where len(g) = 8) where k > 1),
r as (
  select doc_id, count(distinct i + k)::bigint n from d, range(8) z(k) group by 1)
select s.doc_id, s.n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words,
  (n_words < 20 or 100 * coalesce(r.n, 0) > 30 * n_words) base_failed,
  not (n_words < 20 or 100 * coalesce(r.n, 0) > 30 * n_words) and symbols <= ms and shouts <= mh and lines <= ml kept
from s left join r on s.doc_id = r.doc_id
  join lim on s.lang is not distinct from lim.lang and s.source is not distinct from lim.source
"""
