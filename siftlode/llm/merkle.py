"""Merkle manifest of a dataset: a tree of hashes a group, a tree over the groups, and a proof for every row.

A parent is stored with its preimage, the hashes of its children one behind the other. Paths run from the top
down: a node's path is its parent's preimage, the node's slot in it, and the parent's own path. A row cuts its
slot of 64 characters out of each preimage to get its siblings, and puts a recomputed hash into the slot to fold
its way up to the root. All of it is built-in functions, grouped aggregation and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import numbered, written

#: Children of a node, and characters of a hash.
FAN, HEX = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(values: list[Column]) -> Column:
    """The hash of a row: of each value its length in bytes, a colon and the value as text; '-' for null."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in as_text)), 256)


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels of trees over nodes (g, pos, n, h), n being the nodes of g: first ``nodes``, then parents with their
    preimage ``pre``, up to the level at which the largest tree has its root. A tree's last node has n = 1."""
    found = [nodes]
    size = nodes.agg(F.max("n").alias("n")).first().n or 0
    while size > 1:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
        up = found[-1].where("n > 1").groupBy("g", F.expr(f"pos div {FAN}").alias("pos"))
        up = up.agg(F.ceil(F.first("n") / FAN).cast("long").alias("n"), F.array_join(kids, "").alias("pre"))
        found.append(written(up.withColumn("h", F.sha2("pre", 256)), "parents"))
        size = -(-size // FAN)
    return found


def with_paths(found: list[DataFrame], roots: DataFrame | None = None) -> DataFrame:
    """The nodes of the lowest level with ``path`` (array of (pre, slot), nearest first), ``subroot`` and ``root``.

    roots (g, path, subroot, root): where the trees' own roots hang; None: each root is a root.
    """
    below = None
    for nodes in reversed(found):
        if roots is None:
            top = nodes.where("n = 1").select("g", "pos", "h", F.expr("cast(array() as array<struct<pre: string, slot: int>>)").alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
        else:
            top = nodes.where("n = 1").select("g", "pos", "h").join(roots, "g").select("g", "pos", "h", "path", "subroot", "root")
        if below is not None:
            kids = nodes.where("n > 1").select("g", "pos", "h", F.expr(f"pos div {FAN}").alias("up"))
            step = F.struct(F.col("pre"), (F.col("pos") % FAN).cast("int").alias("slot"))
            top = top.unionByName(kids.join(below, ["g", "up"]).select("g", "pos", "h", F.concat(F.array(step), "path").alias("path"), "subroot", "root"))
        if nodes is not found[0]:
            top = written(top.join(nodes.select("g", "pos", "pre"), ["g", "pos"]).withColumnRenamed("pos", "up").drop("h"), "paths")
        below = top
    return below


def siblings(path: Column) -> Column:
    """The hashes of the siblings on a path, one behind the other, level by level."""
    at = lambda p: p["slot"] * HEX
    return F.array_join(F.transform(path, lambda p: F.concat(F.substr(p["pre"], F.lit(1), at(p)), F.substr(p["pre"], at(p) + HEX + 1, F.lit(FAN * HEX)))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf's hash and its siblings lead to."""
    at = lambda p: p["slot"] * HEX
    put = lambda h, p: F.concat(F.substr(p["pre"], F.lit(1), at(p)), h, F.substr(p["pre"], at(p) + HEX + 1, F.lit(FAN * HEX)))
    return F.aggregate(path, leaf, lambda h, p: F.sha2(put(h, p), 256))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, path, claimed_leaf, subroot, root): a row for each row of ``docs``.

    Leaves are ordered by key (nulls first), then by their hash, within their group; groups by the bytes of their name, null
    first. ``claimed``: values in place of some fields, as someone presents them; claimed_leaf is their hash. Repeated
    rows have neighbouring leaves of one hash and are interchangeable. Very long texts are only hashed. An empty table gives no
    rows. Columns other than key, group and fields are not read, whatever their names.
    """
    c = lambda f: F.col(f"`{f}`")
    name = F.coalesce(F.concat(F.lit("="), c(group).cast("string")), F.lit(""))  # the order of names, and null before them
    first = leaf_hash([c(f) for f in fields])
    other = leaf_hash([(claimed or {}).get(f, c(f)) for f in fields]) if claimed else first
    rows = written(docs.select(c(key).alias("key"), name.alias("g"), first.alias("h"), F.nullif(other, first).alias("c")), "leaves")
    leaves = written(numbered(rows, ["g"], ["key", "h"]), "leaves")
    trees = levels(leaves.select("g", "pos", "n", "h"))
    subroots = trees[0].where("n = 1").select("g", "h")
    for up in trees[1:]:
        subroots = subroots.unionByName(up.where("n = 1").select("g", "h"))
    tops = written(numbered(subroots.withColumnRenamed("g", "name"), [], ["name"]), "subroots")
    over = levels(tops.select(F.lit(0).alias("g"), "pos", "n", "h"))
    roots = with_paths(over).select("pos", "path", F.col("h").alias("subroot"), "root")
    roots = written(tops.select("pos", F.col("name").alias("g")).join(roots, "pos").drop("pos"), "paths")
    found = with_paths([leaves, *trees[1:]], roots).select("g", "pos", "path", "subroot", "root")
    done = leaves.join(found, ["g", "pos"]).select(F.col("key").alias(key), F.col("h").alias("leaf"), "path", F.coalesce("c", "h").alias("claimed_leaf"), "subroot", "root")
    return done


def op12_merkle(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``; text of every third hash of ids is presented in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    m = manifest(docs, claimed={"text": F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))})
    m = m.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": folded(F.col("path"), F.col("claimed_leaf"))})
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_PART = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_ROW = " || ".join(_PART.format(f) for f in FIELDS[:-1])
#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_ROW} || {_PART.format("text")}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claim, source, lang, n_chars
  FROM documents),
placed AS MATERIALIZED (
  SELECT doc_id, g, leaf, sha256({_ROW} || {_PART.format("claim")}) AS claimed,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
node(g, level, pos, n, h, pre) AS (
  SELECT g, 0, pos, n, leaf, '' FROM placed
  UNION ALL
  SELECT g, any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)), string_agg(h, '' ORDER BY pos) FROM node WHERE n > 1 GROUP BY g, pos // 8),
sub AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS k, count(*) OVER () AS groups FROM node WHERE n = 1),
top(level, pos, n, h, pre) AS (
  SELECT 0, k, groups, h, '' FROM sub
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)), string_agg(h, '' ORDER BY pos) FROM top WHERE n > 1 GROUP BY pos // 8),
steps AS (
  SELECT p.g, p.pos, 0 AS part, level, pre, p.pos // (8 ** (level - 1))::BIGINT % 8 AS slot FROM placed p JOIN node o ON o.g = p.g AND level > 0 AND o.pos = p.pos // (8 ** level)::BIGINT
  UNION ALL
  SELECT p.g, p.pos, 1, level, pre, s.k // (8 ** (level - 1))::BIGINT % 8 FROM placed p JOIN sub s USING (g) JOIN top t ON level > 0 AND t.pos = s.k // (8 ** level)::BIGINT),
paths AS (SELECT g, pos, list({{'pre': pre, 'slot': slot}} ORDER BY part, level) AS path, string_agg(pre[:slot * 64] || pre[slot * 64 + 65:], '' ORDER BY part, level) AS proof FROM steps GROUP BY g, pos),
ends AS (
  SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([{{'pre': claimed, 'slot': 0::BIGINT}}] || coalesce(path, []), lambda a, p: {{'pre': sha256(p.pre[:p.slot * 64] || a.pre || p.pre[p.slot * 64 + 65:]), 'slot': 0::BIGINT}}).pre AS folded_root
  FROM placed JOIN sub USING (g) LEFT JOIN paths USING (g, pos))
SELECT ends.*, folded_root = root AS verified FROM ends
"""
