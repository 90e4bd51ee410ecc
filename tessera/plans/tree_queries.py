"""Queries on trees, ids and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.tables import table
from ..operators import ids, trees
from .history import SQL, checkpoints, line_chunks, oplog, tree
from .registry import query


def both(spark, d):
    return tree(spark, d, 0, False), tree(spark, d, 1, True)


DIFF = SQL + "select path, case when a.path is null then '{0}' when b.path is null then '{1}' when a.content = b.content then '{2}' else '{3}' end {4} from tree_a a full join tree_b b using (path)"


@query(DIFF.format("added", "deleted", "same", "changed", "change"))
def tree_diff(spark, d):
    return trees.diff(*both(spark, d))


@query(DIFF.format("write", "remove", "keep", "rewrite", "action"))
def tree_prune_actions(spark, d):
    return trees.prune_actions(*both(spark, d))


#: Folders of a tree {t} under DuckDB, as h{t} (dir, depth, entries, hash), and all its entries as e{t}.
MERKLE = """
, f{t} as (select path, len(string_split(path, '/')) depth, sha256(content) hash from tree_{t}),
x4{t} as (select regexp_replace(path, '/[^/]*$', '') dir, split_part(path, '/', 4) nm, 'file' kind, hash from f{t} where depth = 4),
d3{t} as (select dir, count(*) entries, sha256(string_agg(nm || '=' || kind || '=' || hash, ';' order by nm)) hash from x4{t} group by 1),
x3{t} as (select regexp_replace(path, '/[^/]*$', '') dir, split_part(path, '/', 3) nm, 'file' kind, hash from f{t} where depth = 3 union all select regexp_replace(dir, '/[^/]*$', ''), split_part(dir, '/', 3), 'dir', hash from d3{t}),
d2{t} as (select dir, count(*) entries, sha256(string_agg(nm || '=' || kind || '=' || hash, ';' order by nm)) hash from x3{t} group by 1),
x2{t} as (select split_part(path, '/', 1) dir, split_part(path, '/', 2) nm, 'file' kind, hash from f{t} where depth = 2 union all select split_part(dir, '/', 1), split_part(dir, '/', 2), 'dir', hash from d2{t}),
d1{t} as (select dir, count(*) entries, sha256(string_agg(nm || '=' || kind || '=' || hash, ';' order by nm)) hash from x2{t} group by 1),
x1{t} as (select '' dir, path nm, 'file' kind, hash from f{t} where depth = 1 union all select '', dir, 'dir', hash from d1{t}),
d0{t} as (select dir, count(*) entries, sha256(string_agg(nm || '=' || kind || '=' || hash, ';' order by nm)) hash from x1{t} group by 1),
h{t} as (select * from d3{t} union all select * from d2{t} union all select * from d1{t} union all select * from d0{t}),
e{t} as (select distinct kind, hash child from (select * from x4{t} union all select * from x3{t} union all select * from x2{t} union all select * from x1{t}) union select 'dir', hash from d0{t})
"""


@query(SQL + MERKLE.format(t="a") + "select * from ha")
def tree_root_hash(spark, d):
    """Every folder's hash up to the root's; folders hold files and folders of any depth."""
    return trees.hashes(tree(spark, d, 0, False))


def history_nodes(spark, d):
    """Two trees' nodes in one store, and the second's root."""
    a, b = (trees.nodes(t) for t in both(spark, d))
    return a.union(b).where("parent <> ''").distinct(), a.where("parent = ''").select("child"), b.where("parent = ''").select("child")


@query(SQL + MERKLE.format(t="b") + "select child, kind from eb")
def reachable_nodes(spark, d):
    """What the second tree's root reaches in a store that holds both trees."""
    entries, _, root = history_nodes(spark, d)
    return trees.reach(entries, root)


@query(SQL + MERKLE.format(t="a") + MERKLE.format(t="b") + "select child, kind from ea union select child, kind from eb")
def live_union(spark, d):
    """What either root reaches, shared subtrees once."""
    entries, one, two = history_nodes(spark, d)
    return trees.reach(entries, one.union(two))


@query(SQL + MERKLE.format(t="b") + """
, s as (select child, case when child like '%7' then 'redacted' when child like '0%' then 'absent' else 'verified' end state from eb where kind = 'file')
select state, count(*) files, false complete from s group by 1""")
def verify_walk(spark, d):
    """The second tree walked from its root, and its contents looked up in a store that has lost some and redacted others."""
    entries, _, root = history_nodes(spark, d)
    have = entries.where("kind = 'file' and child not like '0%'").select("child")
    states = trees.verified(trees.reach(entries, root), have, entries.where("kind = 'file' and child like '%7'").select("child"))
    n = states.groupBy("state").agg(F.count("*").alias("files"))
    return n.withColumn("complete", F.min(F.col("state") == "verified").over(Window.partitionBy(F.lit(1))))  # three rows at most


@query(SQL + """
select path, content from tree_a where path not in (select path from tree_b where content like '%+')
union all select path, content from tree_b where content like '%+'""")
def tree_splice(spark, d):
    """The first tree with the second's changed paths put in."""
    a, b = both(spark, d)
    return trees.splice(a, b.where("content like '%+'"))


@query(SQL + """
select 'a' only_in, * from (select * from tree_a except all select * from tree_b) union all select 'b', * from (select * from tree_b except all select * from tree_a)""")
def state_equal(spark, d):
    return trees.unequal(*both(spark, d)).select("only_in", "path", "content")


@query(SQL + "select distinct chunk_id from chunks where source in ('src4', 'src5')")
def reachable_chunks(spark, d):
    """Chunks that the roots (two sources) reach, shared ones once."""
    return line_chunks(spark, d).where(F.col("source").isin("src4", "src5")).select("chunk_id").distinct()


ASKED = ["1-URGENT", "2-HIGH/s3", "3-MEDIUM/s6/deep", "3-MEDIUM/s", "4", "104", "nowhere", "../etc", "5-LOW//s1", ""]


@query(SQL + """
, q(asked) as (values ('1-URGENT'), ('2-HIGH/s3'), ('3-MEDIUM/s6/deep'), ('3-MEDIUM/s'), ('4'), ('104'), ('nowhere'), ('../etc'), ('5-LOW//s1'), (''))
select distinct asked, path from q left join tree_a on path = asked or (asked <> '' and starts_with(path, asked || '/'))""")
def assign_expand(spark, d):
    """Given paths expanded to the files that they are or hold; null for refused ones."""
    return trees.expand(tree(spark, d, 0, False), spark.createDataFrame([(x,) for x in ASKED], "asked string"))


@query(SQL + "select case when strpos(path, '/') > 0 then regexp_replace(path, '/[^/]*$', '') else '' end dir, count(*) files from tree_a join tree_b using (path) group by 1")
def tree_node_at(spark, d):
    """Paths that both trees have, by folder: looked up by whole paths."""
    a, b = both(spark, d)
    return a.join(b.select("path"), "path", "left_semi").groupBy(scalar.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))


@query(SQL + """
, i as (select distinct id from checkpoints), n as (select id, lag(id) over (order by id) a, lead(id) over (order by id) b from i)
select id, left(id, greatest(4, 1 + (select coalesce(max(k), 0) from range(1, 65) r(k) where left(id, k) = left(a, k) or left(id, k) = left(b, k)))::bigint) prefix from n""")
def abbreviate_ids(spark, d):
    return ids.abbreviated(checkpoints(oplog(spark, d)).select("id").distinct())


RESOLVE = """
, i as (select distinct id from checkpoints),
p as (select distinct left(id, case when seq % 3 = 0 then 3 when seq % 3 = 1 then 5 else 4 end) prefix from checkpoints union select 'zzzz')
select prefix, case when length(prefix) < 4 or n = 0 then 'unknown' when n = 1 then 'one' else 'ambiguous' end outcome, case when length(prefix) >= 4 and n = 1 then id end id
from (select prefix, count(i.id) n, min(i.id) id from p left join i on starts_with(i.id, prefix) group by 1)"""


@query(SQL + RESOLVE)
def resolve_prefix(spark, d):
    c = checkpoints(oplog(spark, d))
    asked = c.select(F.left("id", F.when(F.col("seq") % 3 == 0, 3).when(F.col("seq") % 3 == 1, 5).otherwise(4)).alias("prefix"))
    return ids.resolved(asked.union(spark.createDataFrame([("zzzz",)], "prefix string")).distinct(), c.select("id").distinct())


PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""
with p as (select page_id, {PATH} path from pages)
select page_id, path, split_part(path, '/', 1) head, regexp_extract(path, '^(.*)/[^/]*$', 1) dir, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) ext,
  case regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) when 'html' then 'html' when 'py' then 'python' when 'c' then 'c' when 'rs' then 'rust' when 'go' then 'go' when 'js' then 'javascript' when 'ts' then 'typescript' when 'java' then 'java' else 'other' end lang,
  left(sha256(path), 12) short, regexp_matches(sha256(path), '^[0-9a-f]{{64}}$') address, regexp_matches(split_part(path, '/', 2), '^[A-Za-z0-9_-]([A-Za-z0-9._/-]{{0,126}}[A-Za-z0-9_-])?$') line_ok,
  split_part(path, '/', 2) not in ('', '.', '..') safe, lpad(page_id::varchar, 12, '0') || '-' || lpad((page_id + 9)::varchar, 12, '0') || '.jsonl' archive,
  page_id & 511 mode, page_id * 1.5e0 * 1024 quantity, '{{"page_id":' || page_id || ',"path":"' || path || '"}}' json
from p""")
def scalar_parity(spark, d):
    """One column a function."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = table(spark, d, "pages").select("page_id", path.alias("path"))
    c, part = F.col("path"), F.split_part("path", F.lit("/"), F.lit(2))
    hashed = F.sha2(c.cast("binary"), 256)
    return p.select(
        "page_id", "path", scalar.first_component(c).alias("head"), scalar.dirname(c).alias("dir"), scalar.extension(c).alias("ext"), scalar.language(c).alias("lang"),
        scalar.short_id(hashed).alias("short"), scalar.is_address(hashed).alias("address"), scalar.line_name(part).alias("line_ok"), scalar.safe_component(part).alias("safe"),
        scalar.archive_name(F.col("page_id"), F.col("page_id") + 9).alias("archive"), scalar.mode_bits(F.col("page_id")).alias("mode"),
        scalar.quantity(F.concat((F.col("page_id") * F.lit(1.5)).cast("decimal(18,1)").cast("string"), F.lit(" KiB"))).alias("quantity"), F.to_json(F.struct("page_id", "path")).alias("json"),
    )
