"""Op 6, secret scans: fixed patterns, then how widely each value is copied across the corpus. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each pattern. Their values, and those of long mixed tokens, are
candidates; each one's hash is counted by distinct repositories (documents) and owners (sources) over the whole
corpus. A value of one owner that lies in MOST_DOCS documents or fewer looks like a live credential of theirs, and its
place is added as a span of kind `live`; one that several owners hold, or more documents, is a copied example and adds
nothing. Counting goes by (hash, document) and (hash, owner) first, on the map side too, so a value that everybody
copies is a row per document at most; the counts are a written table, which Spark can split such a value's rows over.

A match's place is the sum of the lengths of what the text splits into before it, added up by blocks of BLOCK matches.

Defined results. Null or empty text: no spans, the hash of an empty string. Null source: an owner of its own.
Repeated rows: each has its spans; they add no owner and no document. Null doc_id stays, all of them one document.
A very long text is scanned in whole; its matches take time in proportion. Equal values in one document count once.
Extra columns, whatever their names, aren't read. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .shared import quoted, stored

#: Kind, pattern, least length.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs; shorter ones would be dropped
LONG = r"[A-Za-z0-9+/_-]{20,}"  # candidates if they mix digits, capitals and small letters
#: Documents of one owner that may hold a value that still looks live.
MOST_DOCS = 10
BLOCK = 256
KINDS = ["assign", "access", "hex", "live"]
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Every leftmost non-overlapping match: start, kind, end (code points, end exclusive), value."""
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))).cast(SPAN).alias("out"))

    def from_(at: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def sizes(blocks: Column) -> Column:
        return F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"])))

    def begins(sizes: Column) -> Column:
        one = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, one, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).cast("array<int>").alias("out")), lambda a: a["out"])

    def in_blocks(pairs: Column) -> Column:  # appending copies, so many matches are placed block by block
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, begins(sizes(b)), lambda own, at: from_(at, own))))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(found) == 0, none).when(F.size(found) <= BLOCK, from_(F.lit(0), pairs)).otherwise(let(pairs, in_blocks))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def valued(span: Column) -> Column:
    """The span of an assignment's value."""
    v = F.regexp_extract(span["value"], ASSIGN, 2)
    return F.struct((span["end"] - F.length(v)).alias("start"), span["kind"].alias("kind"), span["end"].alias("end"), v.alias("value"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_docs: int = MOST_DOCS) -> DataFrame:
    """(doc_id, base, live, n_copied, counts): spans as arrays of (start, kind, end), in order of start, then kind.

    counts has (start, end, n_docs, n_owners) of every candidate.
    """
    df = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(owner_col).cast("string").alias("owner"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    df = df.select("doc_id", "owner", matches(t, ASSIGN, 0).alias("assign"), matches(t, ACCESS, 1).alias("access"), matches(t, HEX, 2).alias("hex"), matches(t, LONG, 3).alias("long"))
    assign = F.filter("assign", lambda s: F.length(valued(s)["value"]) >= 6)
    access = F.filter("access", lambda s: F.length(s["value"]) >= 20)
    mixed = F.filter("long", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    df = df.select("doc_id", "owner", assign.alias("assign"), access.alias("access"), "hex", mixed.alias("long"))
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.concat("assign", "access", "hex"), place))
    # equal values at one place, found in several ways, are one candidate
    wanted = F.array_distinct(F.transform(F.concat(F.transform("assign", valued), "access", "hex", "long"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.unhex(F.sha2(s["value"].cast("binary"), 256)).alias("hash"))))
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", base.alias("base"), wanted.alias("wanted")), "secrets-rows")
    found = rows.where(F.size("wanted") > 0).select("row", "doc_id", "owner", F.explode("wanted").alias("w")).select("row", "doc_id", "owner", "w.*")

    def distinct(col: str, name: str) -> DataFrame:
        return found.groupBy("hash", col).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias(name))

    copied = (F.col("n_owners") > 1) | (F.col("n_docs") > most_docs)
    shared = stored(distinct("owner", "n_owners").join(distinct("doc_id", "n_docs"), "hash"), "secrets-counts")
    judged = found.select("row", "hash", "start", "end").join(shared, "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(~copied, F.struct("start", F.lit(3).alias("kind"), "end")))).alias("live"),
        F.count_if(copied).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("start", "end", "n_docs", "n_owners"))).alias("counts"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    bare = F.array().cast("array<struct<start:int,end:int,n_docs:bigint,n_owners:bigint>>")
    return rows.join(judged, "row", "left").select("doc_id", "base", F.coalesce("live", none).alias("live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("counts", bare).alias("counts"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
