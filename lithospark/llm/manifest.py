"""Merkle manifest of a dataset: a root over all rows, and for each row a proof found by pointer jumping.

Rows become leaves, sha256 of their length-prefixed columns. In each group the leaves stand in order, and runs of
`fan` neighbours are hashed to their parent until one node is left, the group's subroot; the subroots, in the
groups' order, are the leaves of a top tree whose last node is the root. Each level is one grouping by parent, which
also tells every child its sibling segment: the digests left and right of it.

Proofs: every node starts with a pointer to its parent and the segment on the way. A round joins the pointers with
themselves, which doubles the distance to the ancestor pointed at and concatenates the segments, until every leaf
points to the root; the logarithm of the tree's depth in rounds. Of the nodes above the leaves only those are kept
that some leaf can point to after the round, so the side that is looked up shrinks by fan ** distance.

Places in the order come from a range sort and the counts of its ranges, never from one task. All tables between
steps are written to the shared folder.

Nulls: a null column is `-` in its leaf; null groups come first and are a group of their own; null ids come first.
Repeated rows are leaves of their own, next to each other; as they are equal, so is any order of them. A group of one
row has its leaf as subroot. An empty table gives an empty result. Columns with other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithospark.llm.common import discard, id_crc, keep, partitions, table

#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*columns: Column) -> Column:
    """sha256 (lowercase hex) of the columns: `-` for null, else UTF-8 byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings on a path, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(_hex(s["left"]), digest, _hex(s["right"])), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """df with `place`, its rank from 0 in this order: a range sort, and the rows of the ranges before."""
    at = F.monotonically_increasing_id()  # number of the range times 2 ** 33, plus the place in it
    dealt = keep(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", at), tag)
    part = F.shiftright("_at", 33)
    ranges = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = ranges.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # one row a range
    return dealt.join(F.broadcast(base), F.col("_part") == part).withColumn("place", F.col("_base") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_n", "_base")


def _height(n: Column, fan: int) -> Column:
    """Levels above n leaves until one node is left."""
    powers = [fan**k for k in range(64) if fan**k < 1 << 62]
    return sum(((n > p).cast("int") for p in powers), F.lit(0))


def _key(tree: Column, level: int | Column, idx: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(tree.cast("bigint").alias("tree"), level.cast("int").alias("level"), idx.cast("bigint").alias("idx"))


def _levels(nodes: DataFrame, fan: int, tag: str, top: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of each level, and the nodes that are the last of their tree. nodes: tree, idx, height, digest, row."""
    runs, last, level = [], [nodes.where("height = 0").select("tree", "digest")], nodes.where("height > 0")
    for _ in range(nodes.agg(F.max("height")).first()[0] or 0):
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest", "row")))
        run = keep(level.groupBy("tree", "height", F.floor(F.col("idx") / fan).alias("up")).agg(kids.alias("kids")), tag)  # fan rows a group
        runs.append(run)
        digest = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
        above = run.select("tree", F.col("up").alias("idx"), (F.col("height") - 1).alias("height"), digest.alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
        last.append(above.where("height = 0").select("tree", "digest"))
        level = above.where("height > 0")
    return runs, last


def _pointers(run: DataFrame, level: int, top: bool) -> DataFrame:
    """node, to, path, row of the children in these runs: to is the parent, path the segment on the way."""
    side = lambda a: F.unhex(F.array_join(F.transform(a, lambda k: k["digest"]), ""))
    kids, p = F.col("kids"), F.col("p")
    segment = F.struct(side(F.slice(kids, F.lit(1), p)).alias("left"), side(F.slice(kids, p + 2, F.size(kids))).alias("right"))
    up = _key(F.col("tree"), level + 1, F.col("up"))
    if not top:
        up = F.when(F.col("height") == 1, _key(F.lit(_TOP), 0, F.col("tree"))).otherwise(up)
    each = run.select("*", F.posexplode("kids").alias("p", "kid"))
    return each.select(_key(F.col("tree"), level, F.col("kid.idx")).alias("node"), up.alias("to"), F.array(segment).alias("path"), "tree", F.col("kid.digest").alias("leaf"), F.col("kid.row").alias("row"))


def proofs(leaves: DataFrame, group: str, order: str, digest: str, carry: list[str], fan: int = 8) -> DataFrame:
    """row (struct of the carry columns), leaf, subroot, root and path of each row of leaves.

    digest: hex sha256; path: array of struct<left, right>, binary sibling digests by level from the leaf's to the root's."""
    spark = leaves.sparkSession
    flat = leaves.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(digest).alias("digest"), F.struct(*carry).alias("row"), F.monotonically_increasing_id().alias("u"))
    flat = keep(flat, "leaves")  # texts are hashed once
    placed = numbered(flat, ["g", "o", "digest", "u"], "placed")
    groups = keep(placed.groupBy("g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    trees = keep(numbered(groups, ["first"], "trees").select(F.col("g").alias("_g"), "first", F.col("place").alias("tree"), _height(F.col("n"), fan).alias("height")), "trees")
    nodes = placed.join(trees, F.expr("g <=> _g"))
    nodes = keep(nodes.select("tree", (F.col("place") - F.col("first")).alias("idx"), "height", "digest", "row"), "nodes")
    discard(flat)
    n_trees = trees.count()
    runs, last = _levels(nodes, fan, "runs", False)
    subroots = last[0]
    for x in last[1:]:
        subroots = subroots.unionByName(x)
    subroots = keep(subroots, "subroots")
    tops = subroots.select(F.lit(_TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), _height(F.lit(n_trees), fan).alias("height"), "digest", F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
    top_runs, top_last = _levels(tops, fan, "top", True)
    tall, top_tall = len(runs), len(top_runs)
    found = [r["digest"] for x in top_last for r in x.limit(1).collect()]  # the root; none in an empty table
    root, end = (found or [""])[0], _key(F.lit(_TOP), top_tall, F.lit(0))

    lone = nodes.where("height = 0").select(_key(F.lit(_TOP), 0, F.col("tree")).alias("to"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), "tree", F.col("digest").alias("leaf"), "row")
    hold = lone
    if runs:
        hold = lone.unionByName(_pointers(runs[0], 0, False).drop("node"))
    inner = [_pointers(r, k + 1, False) for k, r in enumerate(runs[1:])] + [_pointers(r, k, True) for k, r in enumerate(top_runs)]
    jump = 1
    if inner:
        up = inner[0]
        for x in inner[1:]:
            up = up.unionByName(x)
        up = keep(up.select("node", "to", "path"), "up")
    while jump < max(tall + top_tall, top_tall + 1):
        hold = _jump(hold, up, end)
        jump *= 2
        if jump < max(tall + top_tall, top_tall + 1):
            hold = keep(hold, "hold")
            up = keep(_jump(up.where((F.col("node.level") >= jump) | (F.col("node.tree") == _TOP)), up, end), "up")
    return hold.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").select("row", "leaf", "subroot", F.lit(root).alias("root"), "path")


def _jump(rows: DataFrame, up: DataFrame, end: Column) -> DataFrame:
    """Pointers not at the end yet go on to where the node they point to points; their paths are concatenated."""
    names = rows.columns
    there = up.select(F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("path").alias("_path"))
    moved = rows.where(F.col("to") != end).join(there, F.col("to") == F.col("_node"))
    moved = moved.withColumns({"to": F.col("_to"), "path": F.concat("path", "_path")})
    return rows.where(F.col("to") == end).unionByName(moved.select(*names))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    """Contract query: a tree of eights per lang; rows whose id's crc32 is divisible by 3 are tampered with, a null id too."""
    docs = table(spark, sf_dir, "documents")
    changed = F.translate("text", _UPPER, _LOWER)
    plain = leaf_digest(*map(F.col, COLUMNS))
    tampered = F.when(id_crc() % 3 == 0, leaf_digest(*[changed if c == "text" else F.col(c) for c in COLUMNS]))
    leaves = docs.select("doc_id", "lang", plain.alias("leaf"), tampered.alias("tampered"))
    found = proofs(leaves, "lang", "doc_id", "leaf", ["doc_id", "tampered"])
    found = found.withColumn("folded_root", fold(F.coalesce("row.tampered", "leaf"), F.col("path")))
    return found.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = {
    "op12_manifest": """
WITH RECURSIVE crc AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295), 0) AS crc FROM documents),
head AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM crc),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered FROM head),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaf),
node AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), CAST(any_value((n + 7) // 8) AS BIGINT) FROM node WHERE n > 1 GROUP BY tree, level, idx // 8),
sub AS (SELECT tree, digest, level AS height, (SELECT count(DISTINCT tree) FROM placed) AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, digest, n FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), CAST(any_value((n + 7) // 8) AS BIGINT) FROM top WHERE n > 1 GROUP BY level, idx // 8),
root AS (SELECT digest AS root FROM top WHERE n = 1),
own AS (SELECT row_number() OVER () AS r, p.*, s.digest AS subroot, s.height FROM placed p JOIN sub s USING (tree)),
step AS (
  SELECT r, level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < mine), '') AS l, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > mine), '') AS g
  FROM (SELECT r, x.level, x.idx, x.digest, pos // CAST(8 ** x.level AS BIGINT) AS mine FROM own JOIN node x ON x.tree = own.tree AND x.level < own.height AND x.idx // 8 = pos // CAST(8 ** (x.level + 1) AS BIGINT)) GROUP BY r, level
  UNION ALL
  SELECT r, 100 + level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < mine), ''), coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > mine), '')
  FROM (SELECT r, x.level, x.idx, x.digest, tree // CAST(8 ** x.level AS BIGINT) AS mine FROM own JOIN top x ON x.n > 1 AND x.idx // 8 = own.tree // CAST(8 ** (x.level + 1) AS BIGINT)) GROUP BY r, level),
path AS (SELECT r, list({'l': l, 'g': g} ORDER BY level) AS path FROM step GROUP BY r),
walk AS (
  SELECT r, 0 AS k, tampered AS digest, coalesce(path, []) AS path FROM own LEFT JOIN path USING (r)
  UNION ALL
  SELECT r, k + 1, sha256(path[k + 1].l || digest || path[k + 1].g), path FROM walk WHERE k < len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.g), '')) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM walk JOIN own USING (r) CROSS JOIN root WHERE k = len(path)"""
}
