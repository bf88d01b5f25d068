"""A Merkle manifest of a dataset: every row's leaf, its proof, the root of its group and the root of all.

Groups of any size are cut into blocks of 3^6 consecutive leaves.  A block is one row with an ordered array, which sequence, transform, slice
and aggregate collapse level by level inside the row.  The roots of blocks are the leaves of the next round, so a round divides rows by 729 and a few
rounds serve any dataset; the groups' roots, ordered by group, go the same way to the root of all.  On the way back every block learns its own path from its round
above, and its leaves get theirs: for each level, what stands left and right of the own node.  Only digests move; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, let, table
from .places import numbered

FAN = 3
#: Levels that are collapsed within one row; a block has FAN^LEVELS leaves.
LEVELS = 6
#: What stands beside a node, level by level from its leaf up.
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of values, each as its length in bytes of UTF-8, a colon and the value, or - for null."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-"))
    return digest(F.concat(*(one(v.cast("string")) for v in values)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, start, lambda node, beside: digest(F.concat(beside["left"], node, beside["right"])))


def proof(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), ""))


def _powers(levels: int) -> list[Column]:
    return [F.lit(FAN**k) for k in range(levels)]


def _collapsed(nodes: Column) -> Column:
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(runs, lambda at: digest(F.array_join(F.slice(nodes, at, F.lit(FAN)), "")))


def _levels(nodes: Column, steps: Column) -> Column:
    """array<array<string>>: the nodes, and after each step what they became."""
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(_collapsed(F.element_at(done, -1)))))


def _beside(nodes: Column, at: Column) -> Column:
    """What stands left and right of the node at a place (from 0) within its run."""
    return let(at - at % FAN, lambda first: F.struct(
        F.array_join(F.slice(nodes, first + 1, at - first), "").alias("left"), F.array_join(F.slice(nodes, at + 2, F.lit(FAN - 1) - (at - first)), "").alias("right")
    ))


def _within(levels: Column, place: Column) -> Column:
    """The path of the leaf at a place of a block, up to the block's root."""
    steps = F.sequence(F.lit(1), F.size(levels) - 1)
    path = F.transform(steps, lambda k: let(F.floor(place / F.element_at(F.array(*_powers(LEVELS + 1)), k)).cast("int"), lambda at: _beside(F.element_at(levels, k), at)))
    return F.when(F.size(levels) > 1, path).otherwise(F.array().cast(PATH))


def _climb(nodes: DataFrame, levels: int, grouped: bool = True) -> DataFrame:
    """(own, path, tops) for nodes (grp, place, total, node, own); tops is an array with the group's root and, where grouped, the root of all groups.

    own is carried along.  A group's last block may be short, down to one node: it goes up as many levels as the others.
    """
    size = FAN**levels
    steps = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), p.alias("p")) for k, p in enumerate(_powers(levels)))), lambda s: s["p"] < F.col("total"))
    member = F.struct("place", "node", "own")
    rows = nodes.groupBy("grp", F.floor(F.col("place") / size).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("levels", _levels(F.col("members.node"), steps)).withColumn("members", F.col("members.own"))
    blocks = cut(rows.withColumn("node", F.element_at("levels", -1)[0]))
    if blocks.filter("block > 0").isEmpty():
        done = blocks.select("grp", "node")
        nothing = done.select("grp", F.lit(0).alias("block"), F.array().cast(PATH).alias("path"), F.array("node").alias("tops"))
        above = _over_groups(done, levels) if grouped else nothing
    else:
        up = blocks.select("grp", F.col("block").alias("place"), F.ceil(F.col("total") / size).alias("total"), "node", F.struct("grp", "block").alias("own"))
        above = _climb(up, levels, grouped).select("own.*", "path", "tops")
    b, a = blocks.alias("b"), above.alias("a")
    joined = b.join(a, F.col("b.grp").eqNullSafe(F.col("a.grp")) & (F.col("b.block") == F.col("a.block")))
    leaves = F.transform("b.members", lambda own, i: F.struct(own.alias("own"), F.concat(_within(F.col("b.levels"), i), F.col("a.path")).alias("path")))
    return joined.select(F.explode(leaves).alias("one"), "a.tops").select("one.own", "one.path", "tops")


def _over_groups(tops: DataFrame, levels: int) -> DataFrame:
    """(grp, block, path, tops) for one row (grp, node) for each group: the tree over the groups' roots, in the order of groups."""
    rows = tops.select(F.lit(0).alias("one"), F.struct("grp", "node").alias("own"), F.col("grp").alias("key"), "node")
    placed = numbered(rows, [], ["key"], "place", "total").select(F.col("one").alias("grp"), "place", "total", "node", "own")
    return _climb(placed, levels, grouped=False).select("own.grp", F.lit(0).alias("block"), "path", F.concat(F.array("own.node"), "tops").alias("tops"))


def manifest(rows: DataFrame, node: str = "leaf", group: str = "source", order: tuple[str, ...] = ("doc_id",), levels: int = LEVELS) -> DataFrame:
    """rows with subroot, root and path (see PATH); node names the column with each row's leaf digest.

    Within a group leaves ascend by order, nulls first, then by digest: rows that tie there are alike, and either way round gives the same
    tree.  A null group is a group, the first.  A group of one row has its leaf as subroot, a single subroot is the root, and either adds nothing
    to the path.  An empty table stays empty.  Where rows has a column of such a name already, the new one gets an underscore more.
    """
    names = fresh(rows.columns, "subroot", "root", "path")
    packed = rows.select(F.struct(group).alias("grp"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(node).alias("node"), F.struct("*").alias("own"))
    keys = [*(f"o{k}" for k in range(len(order))), "node"]
    placed = numbered(packed, ["grp"], keys, "place", "total").select("grp", "place", "total", "node", "own")
    return _climb(placed, levels).select("own.*", F.col("tops")[0].alias(names[0]), F.col("tops")[1].alias(names[1]), F.col("path").alias(names[2]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf and proof; every other row (by crc32 of its doc_id; null ids never) is tampered with and checked against the root."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    stripped = [*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = cut(docs.select("doc_id", "source", leaf(fields).alias("leaf"), F.when(chosen & F.contains("text", F.lit("\n")), leaf(stripped)).alias("tampered")))
    found = manifest(rows).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_sql() -> str:
    """All levels of all trees by recursion, siblings by a join for each level, paths folded by recursion again."""
    one = lambda v: f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"
    made = lambda text: f"sha256({' || '.join(one(v) for v in ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', text))})"
    table256 = "(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)))"
    return f"""
WITH RECURSIVE crc AS (SELECT {table256} AS t),
bits AS (
  SELECT doc_id, 1 - list_reduce(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)),
         lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1]), 4294967295) % 2 AS odd
  FROM documents, crc),
leaves AS (
  SELECT d.doc_id, d.source, {made('d.text').replace('(doc_id', '(d.doc_id')} AS leaf,
         CASE WHEN b.odd = 0 THEN {made("replace(d.text, chr(10), '')").replace('(doc_id', '(d.doc_id')} END AS tampered
  FROM documents d LEFT JOIN bits b USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS lvl, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
  SELECT p.source, p.pos AS leaf_pos, x.lvl AS step, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < p.pos // CAST(pow(3, x.lvl) AS BIGINT)), '') AS l,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > p.pos // CAST(pow(3, x.lvl) AS BIGINT)), '') AS r
  FROM placed p JOIN nodes x ON x.source IS NOT DISTINCT FROM p.source AND x.n > 1 AND x.pos // 3 = p.pos // CAST(pow(3, x.lvl + 1) AS BIGINT)
  GROUP BY p.source, p.pos, x.lvl),
above AS (
  SELECT s.source, 1000 + x.lvl AS step, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < s.pos // CAST(pow(3, x.lvl) AS BIGINT)), '') AS l,
         coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > s.pos // CAST(pow(3, x.lvl) AS BIGINT)), '') AS r
  FROM subroots s JOIN tops x ON x.n > 1 AND x.pos // 3 = s.pos // CAST(pow(3, x.lvl + 1) AS BIGINT)
  GROUP BY s.source, x.lvl),
paths AS (
  SELECT source, leaf_pos, list({{'l': l, 'r': r}} ORDER BY step) AS path FROM (
    SELECT * FROM steps UNION ALL SELECT p.source, p.pos, a.step, a.l, a.r FROM placed p JOIN above a ON a.source IS NOT DISTINCT FROM p.source)
  GROUP BY source, leaf_pos),
climbing AS (
  SELECT p.doc_id, p.source, p.pos, p.leaf, 0 AS done, coalesce(p.tampered, p.leaf) AS h, coalesce(q.path, []) AS path
  FROM placed p LEFT JOIN paths q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_pos = p.pos
  UNION ALL
  SELECT doc_id, source, pos, leaf, done + 1, sha256(path[done + 1].l || h || path[done + 1].r), path FROM climbing WHERE done < len(path))
SELECT c.doc_id, c.leaf, s.subroot, t.h AS root, sha256(array_to_string(list_transform(c.path, lambda p: p.l || p.r), '')) AS proof_sha256,
       c.h AS folded_root, c.h = t.h AS verified
FROM climbing c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source, tops t
WHERE c.done = len(c.path) AND t.n = 1"""
