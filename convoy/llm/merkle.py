"""A Merkle manifest of a table: a tree of digests per group, and one over the groups.

Rows get indices within their group by row_number.  Level by level the indices are
floor-divided by the fan-out, the children of a parent are gathered in order (eight
at most) and hashed into it, until each group has one node, its subroot; the subroots
make a tree of their own, whose apex is the root.  Then the levels are joined from the
root down: a run of siblings gets the runs above it, so a level's join moves a row per
run and no level moves more than an eighth of the one below.  The lowest runs are opened
into rows, each with its path: the siblings and its own place at every level.

Indices are numbered within ranges of rows and offset by the ranges before, so that no
task holds a group.  Rows that are equal in every field are interchangeable.

Nulls: a null field hashes as ``-`` and is no empty string; rows without a group form
the group that comes first; null keys come first in their group.  Ties in the key go by
leaf, and rows that tie there are the same.  An empty table gives no rows.  Columns that
are not fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.llm.shared import settled, table

#: Children of a parent.
FANOUT = 8
#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

digest = lambda c: F.sha2(c.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its number of UTF-8 bytes, ``:`` and its text."""
    shown = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``_i``, their number within the group from 0, and ``_n``, the group's rows."""
    # the last key parts rows that are equal otherwise, so that no range has to hold them all
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_row")
    placed = settled(dealt.withColumn("_part", F.spark_partition_id()).drop("_row"), name)
    each = Window.partitionBy(group)
    before = each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", group).agg(F.count("*").alias("_rows"))
    parts = parts.select("_part", group, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(each).alias("_n"))
    inside = Window.partitionBy("_part", group).orderBy(*order)
    own = placed.withColumn("_place", F.row_number().over(inside) - 1).join(parts, ["_part", group])
    return own.withColumn("_i", F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def levels(leaves: DataFrame, group: str, name: str, fanout: int = FANOUT) -> list[DataFrame]:
    """Runs of siblings, a table for each level from the leaves up: group, ``_i`` (the parent's number), ``_n`` (its level's
    nodes in the group), ``node`` (the parent's digest) and ``run`` (the children, in order, with all columns of their own)."""
    out, rows = [], leaves
    most = leaves.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        most = -(-most // fanout)
        own = F.struct("_i", *[c for c in rows.columns if c not in (group, "_i", "_n")])
        runs = rows.where("_n > 1").groupBy(group, F.expr(f"_i div {fanout}").alias("_up")).agg(F.array_sort(F.collect_list(own)).alias("run"), F.min("_n").alias("_below"))
        node = digest(F.array_join(F.transform("run", lambda c: c["node"]), ""))
        out.append(settled(runs.select(group, F.col("_up").alias("_i"), F.expr(f"(_below + {fanout - 1}) div {fanout}").alias("_n"), node.alias("node"), "run"), f"{name}-{len(out)}"))
        rows = out[-1].drop("run")
    return out


def subroots(leaves: DataFrame, above: list[DataFrame], group: str) -> DataFrame:
    """Group and the one node that is left of it: a lone leaf, or the apex of its tree."""
    out = leaves.where("_n = 1").select(group, "node")
    for level in above:
        out = out.unionByName(level.where("_n = 1").select(group, "node"))
    return out


def descend(above: list[DataFrame], tops: DataFrame, group: str, fanout: int = FANOUT) -> DataFrame | None:
    """The lowest runs with what ``tops`` has of their group and the ``path`` above them, from their parent's siblings up to
    the group's apex and then on as ``path`` of tops goes; None where no group has more than one leaf.

    An element of a path: the digests of the run, and the place from 0 in it of the node below."""
    kept, reached = [c for c in tops.columns if c not in (group, "path")], None
    for level in reversed(above):
        own = level.select(group, "_i", "_n", "run")
        apex = own.where("_n = 1").join(tops, group).select(group, "_i", "run", "path", *kept)
        if reached is None:
            reached = apex
            continue
        up = reached.select(F.col(group).alias("_g"), F.col("_i").alias("_up"), F.transform("run", lambda c: c["node"]).alias("_nodes"), F.col("path").alias("_path"), *kept)
        met = own.where("_n > 1").join(up, (F.col(group) == F.col("_g")) & (F.expr(f"_i div {fanout}") == F.col("_up")))
        here = F.struct(F.col("_nodes").alias("nodes"), F.expr(f"cast(_i % {fanout} as int)").alias("place"))
        reached = apex.unionByName(met.select(group, "_i", "run", F.concat(F.array(here), "_path").alias("path"), *kept))
    return reached


def opened(runs: DataFrame | None, leaves: DataFrame, tops: DataFrame, group: str) -> DataFrame:
    """A row per leaf with its path and what tops has of its group."""
    kept = [c for c in tops.columns if c not in (group, "path")]
    own = [c for c in leaves.columns if c not in (group, "_i", "_n")]
    alone = leaves.where("_n = 1").join(tops, group).select(*own, "path", *kept)
    if runs is None:
        return alone
    here = F.struct(F.transform("run", lambda c: c["node"]).alias("nodes"), F.col("_place").alias("place"))
    each = runs.select("run", "path", *kept, F.posexplode("run").alias("_place", "_leaf"))
    return alone.unionByName(each.select(*[F.col(f"_leaf.{c}").alias(c) for c in own], F.concat(F.array(here), "path").alias("path"), *kept))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    at = lambda level, below: F.transform(level["nodes"], lambda v, i: F.when(i == level["place"], below).otherwise(v))
    return F.aggregate(path, node, lambda below, level: digest(F.array_join(at(level, below), "")))


def siblings(path: Column) -> Column:
    """The digests of a path without the nodes on the way, level by level and left to right."""
    return F.flatten(F.transform(path, lambda level: F.filter(level["nodes"], lambda _, i: i != level["place"])))


def manifest(df: DataFrame, fields: tuple[str, ...], by: str, key: str, keep: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """A row per row of ``df``: key, ``leaf``, ``subroot``, ``root``, ``path`` (see ``descend``), and the expressions of ``keep``.

    The leaves hash ``fields``; a tree is built for each value of ``by`` in order of ``key``, and one over them, by value.
    """
    group = F.coalesce(F.concat(F.lit(":"), F.col(by).cast("string")), F.lit("")).alias("_group")
    rows = df.select(group, F.col(key).alias("_key"), leaf([F.col(f) for f in fields]).alias("node"), *[v.alias(f"_keep_{k}") for k, v in (keep or {}).items()])
    leaves = settled(numbered(rows, "_group", ["_key", "node"], "merkle-leaves"), "merkle-numbered")
    trees = levels(leaves, "_group", "merkle-level", fanout)
    heads = subroots(leaves, trees, "_group").select(F.lit("").alias("_all"), F.col("_group").alias("_value"), "node")
    heads = settled(numbered(heads, "_all", ["_value", "node"], "merkle-subroots"), "merkle-heads")
    crown = levels(heads, "_all", "merkle-crown", fanout)
    nothing = F.array().cast("array<struct<nodes:array<string>,place:int>>")
    apex = subroots(heads, crown, "_all").select("_all", F.col("node").alias("root"), nothing.alias("path"))
    tops = opened(descend(crown, apex, "_all", fanout), heads, apex, "_all")
    tops = settled(tops.select(F.col("_value").alias("_group"), F.col("node").alias("subroot"), "root", "path"), "merkle-tops")
    out = opened(descend(trees, tops, "_group", fanout), leaves, tops, "_group")
    return out.select(F.col("_key").alias(key), F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(f"_keep_{k}").alias(k) for k in keep or {}])


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and what it says about a copy in which a third of the texts lost its capitals."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf([F.when(touched, small).otherwise(F.col("text")) if f == "text" else F.col(f) for f in FIELDS])
    rows = manifest(docs, FIELDS, "lang", "doc_id", {"changed": changed})
    proof = digest(F.array_join(siblings(F.col("path")), ""))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' leaves and proofs, and whether a tampered copy of each is found out."""
    return document_manifest(table(spark, sf_dir, "documents"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(f) for f in FIELDS[:-1])
#: CRC-32 of the key's digits, a bit at a time.
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b:"
    " list_reduce(list_concat([xor(c, b)], range(8)), lambda d, _: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)))"
)
_CLIMB = "SELECT g, i // 8, max((n + 7) // 8), sha256(string_agg(node, '' ORDER BY i)), level + 1 FROM {0} WHERE n > 1 GROUP BY g, i // 8, level"
ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, coalesce(':' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
          sha256({_HEAD} || {_FIELD.format("CASE WHEN " + _CRC + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS changed
        FROM documents)),
tree(g, i, n, node, level) AS (SELECT g, i, n, leaf, 0 FROM leaves UNION ALL {_CLIMB.format("tree")}),
heads AS (SELECT g AS value, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(g, i, n, node, level) AS (SELECT '', i, n, subroot, 0 FROM heads UNION ALL {_CLIMB.format("crown")}),
runs AS (SELECT g, level, i // 8 AS up, list(node ORDER BY i) AS nodes FROM tree WHERE n > 1 GROUP BY ALL),
crown_runs AS (SELECT level, i // 8 AS up, list(node ORDER BY i) AS nodes FROM crown WHERE n > 1 GROUP BY ALL),
walk(doc_id, leaf, g, i, n, level, below, proof) AS (
  SELECT doc_id, leaf, g, i, n, 0, changed, '' FROM leaves
  UNION ALL
  SELECT doc_id, leaf, w.g, w.i // 8, (n + 7) // 8, w.level + 1, sha256(array_to_string(list_concat(nodes[:w.i % 8], [below], nodes[w.i % 8 + 2:]), '')),
    proof || array_to_string(list_concat(nodes[:w.i % 8], nodes[w.i % 8 + 2:]), '')
  FROM walk w JOIN runs r ON r.g = w.g AND r.level = w.level AND r.up = w.i // 8 WHERE w.n > 1),
climb(doc_id, leaf, g, subroot, i, n, level, below, proof) AS (
  SELECT doc_id, leaf, w.g, subroot, h.i, h.n, 0, below, proof FROM walk w JOIN heads h ON h.value = w.g WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, g, subroot, c.i // 8, (n + 7) // 8, c.level + 1, sha256(array_to_string(list_concat(nodes[:c.i % 8], [below], nodes[c.i % 8 + 2:]), '')),
    proof || array_to_string(list_concat(nodes[:c.i % 8], nodes[c.i % 8 + 2:]), '')
  FROM climb c JOIN crown_runs r ON r.level = c.level AND r.up = c.i // 8 WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, below AS folded_root, below = root AS verified
FROM climb, (SELECT node AS root FROM crown WHERE n = 1) WHERE n = 1
"""
