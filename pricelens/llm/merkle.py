"""Merkle manifest of a table with nested-interval labels (operator 11).

Rows are leaves, ordered by (group, id); every node carries the interval
``[lo, hi)`` of the leaf ranks it covers.  Levels are built upwards, one eighth
the size each: nodes of a level with the same bucket ``position div fanout``
make one parent.  Downwards, a containment join bucketed by level attaches to
each node its parent (``parent.lo <= lo and hi <= parent.hi``) and with it all
ancestors; the siblings are the parent's interval less the node's own, that is
the children that end before ``lo`` and those that begin at ``hi`` or later.
No key of these joins has more than ``fanout`` rows, however the groups are
sized; a tree that is done passes its root on unchanged, so all trees have as
many levels as the largest.

Ranks come from a range-partitioned sort: each row knows its place in its
partition, and a table with one row a partition holds the offsets.  Texts are
hashed in the scan and never shuffled.

Defined results: nulls are hashed as ``-``; null ids and groups come first; rows
with the same id follow their digests; equal rows are leaves of their own next
to each other.  An empty table gives no rows.  A null id is altered like the text ``-``.
Further columns are not read, unless named in ``fields``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.llm.common import materialize
from pricelens.session import broadcast_checked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE = 33  # bits of monotonically_increasing_id that number the rows of a partition


class Manifest(NamedTuple):
    #: key, id, digest, altered, tree, n, i, lo, hi: one row a leaf
    leaves: DataFrame
    #: parents of each level, lowest first: tree, i, lo, hi, n, digest, kids, hashed
    levels: list[DataFrame]
    #: how many of the levels lie within the groups' trees
    inner: int
    #: root digest, None for an empty table
    root: str | None
    fanout: int


def leaf_digest(values: list[Column]) -> Column:
    """Hex digest of the values, each written as byte count, ``:``, text; null as ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*parts), 256)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 0-based rank ``name`` along a total order, without a window over all rows."""
    s = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_m", PLACE), F.col("_m").bitwiseAND(F.lit((1 << PLACE) - 1))
    counts = s.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))  # one row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    joined = s.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return joined.withColumn(name, F.col("_o") + place).drop("_p", "_o", "_m")


def _height(n: int, fanout: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: (tree, n, i, lo, hi, digest) -> the nodes that cover ``fanout`` of them each."""
    kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
    up = nodes.groupBy("tree", "n", F.floor(F.col("i") / fanout).alias("i")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
    joined = F.sha2(F.concat_ws("", F.col("kids.digest")), 256)
    return up.select(
        "tree", "i", "lo", "hi", F.ceil(F.col("n") / fanout).alias("n"),
        F.when(F.col("n") > 1, joined).otherwise(F.col("kids")[0]["digest"]).alias("digest"), "kids", (F.col("n") > 1).alias("hashed"))


def build(docs: DataFrame, digest: Column, altered: Column, id_col: str = "doc_id", group: str = "lang", fanout: int = 8) -> Manifest:
    """Trees of the groups and the tree over their roots.  ``digest`` is a row's leaf, ``altered``
    a second digest carried along (what a later copy of the row hashes to)."""
    rows = docs.select(F.col(f"`{group}`").alias("key"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), altered.alias("altered"))
    copies = rows.groupBy("key", "id", "digest", "altered").agg(F.count(F.lit(1)).alias("c"))
    each = copies.select("key", "id", "digest", "altered", F.explode(F.sequence(F.lit(1), "c")).alias("copy"))
    order = [F.asc_nulls_first("key"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("copy")]
    leaves = ranked(each, order, "lo").drop("copy").withColumn("hi", F.col("lo") + 1)

    trees = ranked(leaves.groupBy("key").agg(F.min("lo").alias("start"), F.count(F.lit(1)).alias("n")), [F.asc("start")], "tree")
    n_trees, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_trees:
        none = leaves.select("*", *[F.lit(None).cast("long").alias(c) for c in ("tree", "n", "i")])
        return Manifest(none, [], 0, None, fanout)
    side = broadcast_checked(trees.withColumnRenamed("key", "tree_key"))
    leaves = leaves.join(side, F.col("key").eqNullSafe(F.col("tree_key"))).withColumn("i", F.col("lo") - F.col("start")).drop("tree_key", "start")

    levels: list[DataFrame] = []
    nodes = leaves.select("tree", "n", "i", "lo", "hi", "digest")
    inner = _height(largest, fanout)
    for _ in range(inner):
        levels.append(materialize(_parents(nodes, fanout), "level"))
        nodes = levels[-1]
    nodes = nodes.select(F.lit(-1).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("i"), "lo", "hi", "digest")
    for _ in range(_height(n_trees, fanout)):
        levels.append(materialize(_parents(nodes, fanout), "level"))
        nodes = levels[-1]
    return Manifest(leaves, levels, inner, nodes.first()["digest"], fanout)


def _siblings(kids: Column, keep) -> Column:
    return F.concat_ws("", F.transform(F.filter(kids, keep), lambda k: k["digest"]))


def prove(m: Manifest) -> DataFrame:
    """Leaves with ``subroot`` and ``path``: for each level up to the root the digests to
    the left and to the right within the run."""
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    # address of the node above: bucketed by level, within the tree or in the one over the roots
    above, above_tree = F.floor(F.col("i") / m.fanout), F.col("tree")
    over, over_tree = F.floor(F.col("tree") / m.fanout), F.lit(-1).cast("long")
    tables = [m.leaves, *m.levels]
    upper = None
    for depth in range(len(tables) - 1, -1, -1):
        t = tables[depth]
        own = [c for c in ("key", "id", "digest", "altered", "kids", "hashed") if c in t.columns]
        top = depth == len(tables) - 1
        if depth == m.inner:  # the roots of the groups
            node = t.select("tree", "i", "lo", "hi", *own, over_tree.alias("ptree"), over.alias("pi"))
            subroot = F.col("digest")
        else:
            node = t.select("tree", "i", "lo", "hi", *own, above_tree.alias("ptree"), above.alias("pi"))
            subroot = F.col("p_subroot") if depth < m.inner else F.lit(None).cast("string")
        if top:
            upper = node.withColumn("subroot", subroot).withColumn("path", empty)
            continue
        p = upper.select(*[F.col(c).alias(f"p_{c}") for c in ("tree", "i", "lo", "hi", "kids", "hashed", "subroot", "path")])
        inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
        joined = node.join(p, (F.col("ptree") == F.col("p_tree")) & (F.col("pi") == F.col("p_i")) & inside)
        step = F.struct(
            _siblings(F.col("p_kids"), lambda k: k["hi"] <= F.col("lo")).alias("left"),
            _siblings(F.col("p_kids"), lambda k: k["lo"] >= F.col("hi")).alias("right"))
        path = F.when(F.col("p_hashed"), F.concat(F.array(step), F.col("p_path"))).otherwise(F.col("p_path"))
        upper = joined.select("tree", "i", "lo", "hi", *own, subroot.alias("subroot"), path.alias("path"))
    return upper


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, lowest level first, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"])))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf digest and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered(text: Column, id_: Column) -> Column:
    """The text with A-Z in lower case where the id's unsigned CRC-32 is a multiple of 3."""
    hit = F.crc32(F.coalesce(id_.cast("string"), F.lit("-")).cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


def audit(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields=FIELDS, text: str = "text", fanout: int = 8) -> DataFrame:
    """Manifest of ``docs`` and the check of a tampered copy against it, one row a leaf."""
    cols = {f: F.col(f"`{f}`") for f in fields}
    digest = leaf_digest(list(cols.values()))
    altered = leaf_digest([tampered(c, F.col(f"`{id_col}`")) if f == text else c for f, c in cols.items()])
    m = build(docs, digest, altered, id_col, group, fanout)
    root = F.lit(m.root).cast("string")
    rows = prove(m) if m.root else m.leaves.withColumn("subroot", F.col("digest")).withColumn("path", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
    folded = rows.withColumn("folded", fold(F.col("altered"), F.col("path")))
    return folded.select(
        "id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


# Level by level: nodes(lvl, tree, i, n, h), tree -1 above the groups' roots.
SQL = """
WITH RECURSIVE crc AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
hit AS (
    SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT],
        flatten(list_transform(range(1, len(s) + 1), lambda p: list_transform(range(0, 8), lambda b: (ascii(substr(s, p, 1))::BIGINT >> b) & 1)))),
        lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 3 = 0 AS t
    FROM crc),
d AS (
    SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text,
        CASE WHEN h.t THEN translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE d.text END AS text2
    FROM documents d LEFT JOIN hit h USING (doc_id)),
f AS (
    SELECT doc_id, lang,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, text2
    FROM d),
leaf AS MATERIALIZED (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
        sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS h2 FROM f),
r AS MATERIALIZED (
    SELECT doc_id, h, h2, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
low AS (
    SELECT 0 AS lvl, tree, i, n, h FROM r
    UNION ALL
    SELECT lvl + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lvl, tree, i // 8, n),
tops AS MATERIALIZED (SELECT tree, lvl AS height, h FROM low WHERE n = 1),
high AS (
    SELECT 0 AS lvl, -1::BIGINT AS tree, tree AS i, (SELECT count(*) FROM tops) AS n, h FROM tops
    UNION ALL
    SELECT lvl + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, tree, i // 8, n),
node AS MATERIALIZED (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1),
walk AS (
    SELECT tree AS home, i AS rank, 0 AS step, 0 AS lvl, CASE WHEN n > 1 THEN tree ELSE -1 END AS tree, CASE WHEN n > 1 THEN i ELSE tree END AS i FROM r
    UNION ALL
    SELECT home, rank, step + 1, CASE WHEN w.tree >= 0 AND w.lvl + 1 = t.height THEN 0 ELSE w.lvl + 1 END,
        CASE WHEN w.tree >= 0 AND w.lvl + 1 = t.height THEN -1 ELSE w.tree END, CASE WHEN w.tree >= 0 AND w.lvl + 1 = t.height THEN w.tree ELSE w.i // 8 END
    FROM walk w JOIN tops t ON t.tree = w.home JOIN node x ON x.tree = w.tree AND x.lvl = w.lvl AND x.i = w.i),
steps AS MATERIALIZED (
    SELECT w.home, w.rank, w.step, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < w.i), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > w.i), '') AS r
    FROM walk w JOIN node x ON x.tree = w.tree AND x.lvl = w.lvl AND x.i // 8 = w.i // 8 GROUP BY w.home, w.rank, w.step),
fold AS (
    SELECT tree AS home, i AS rank, 0 AS step, h2 AS acc FROM r
    UNION ALL
    SELECT f.home, f.rank, f.step + 1, sha256(s.l || f.acc || s.r) FROM fold f JOIN steps s USING (home, rank, step)),
done AS (SELECT home, rank, arg_max(acc, step) AS acc FROM fold GROUP BY home, rank),
proof AS (SELECT home, rank, sha256(string_agg(l || r, '' ORDER BY step)) AS p FROM steps GROUP BY home, rank)
SELECT r.doc_id, r.h AS leaf, t.h AS subroot, top.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, d.acc AS folded_root, d.acc = top.h AS verified
FROM r JOIN tops t USING (tree) JOIN done d ON d.home = r.tree AND d.rank = r.i LEFT JOIN proof p ON p.home = r.tree AND p.rank = r.i
CROSS JOIN (SELECT h FROM high WHERE n = 1) top
"""
