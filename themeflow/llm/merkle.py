"""Merkle manifest of a documents table, checked by a recursive climb.

Leaves ascend within their source; runs of ``FAN`` nodes are hashed until one
is left, and the sources' roots are hashed the same way. Every run is stored
as a row linked to its parent. The check is a recursive SQL query: it starts
at the runs of leaves, goes up by the parent link, appends what stands beside
the node (the same for all leaves of the run) and folds one digest per leaf.

Results for odd input: a null field counts as ``-``; rows with the same id are
leaves of their own, in the order of their digests; a row whose id is null
comes first and is never tampered with; an empty table gives no row; other
columns of the table pass unread.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeflow.llm.stored import Stored
from themeflow.operators.ordering import with_row_index

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BYTES = 32  # of a digest
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = -1  # the tree over the sources' roots
#: Spark ends recursive queries at a million rows by default; a climb has a row
#: per run and level. It also gives the whole result as many partitions as the
#: first step has after coalescing, which can be one.
_CLIMB_CONF = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def hash_fields(*fields: Column) -> Column:
    """Hex sha256 of the fields, each with its length before it."""
    coded = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f))
             for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*coded), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, found): the digest of each row, and the digest
    that a reader of the tampered table finds."""
    first = [F.col(c) for c in FIELDS[:-1]]
    leaf = F.unhex(hash_fields(*first, F.col("text")))
    lowered = F.unhex(hash_fields(*first, F.translate("text", _UPPER, _LOWER)))
    return docs.select("source", "doc_id", leaf.alias("leaf"),
                       F.when(is_tampered(F.col("doc_id")), lowered).otherwise(leaf).alias("found"))


@dataclass
class Manifest:
    """``starts``: runs of leaves (``kids``: idx, digest, doc_id, found);
    ``runs``: all runs above them; both are linked by ``parent`` and ``place``
    and hold the digests of their children. ``root``: None without leaves."""

    starts: DataFrame
    runs: DataFrame
    root: bytes | None


def _hashed(digests: str) -> Column:
    """Digest, as bytes, of digests that lie one behind the other (their hex text is hashed)."""
    return F.expr(f"unhex(sha2(lower(hex({digests})), 256))")


def _runs(nodes: DataFrame, level: int, *more: str) -> DataFrame:
    """Runs of nodes (sid, idx, digest, n): n is the number of nodes of the
    tree on this level. The only node of a tree passes as it is."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest", *more)))
    runs = nodes.groupBy("sid", F.floor(F.col("idx") / FAN).alias("run"), "n").agg(kids.alias("kids"))
    runs = runs.withColumn("children", F.expr("unhex(array_join(transform(kids, k -> hex(k.digest)), ''))"))
    alone = F.col("n") == 1
    return runs.select("sid", F.when(alone, 0).otherwise(level).alias("level"), F.col("run").alias("idx"),
                       F.ceil(F.col("n") / FAN).alias("n"), alone.alias("alone"), "kids", "children",
                       F.when(alone, F.col("children")).otherwise(_hashed("children")).alias("digest"))


def _linked(runs: DataFrame, trees: int) -> DataFrame:
    """Names for runs and their parents, ``sid/level/idx``. The last run of a
    source's tree is a child in the top tree, if there are several sources."""
    last, top = F.col("n") == 1, F.col("sid") == _TOP
    up = F.when(~last, F.concat_ws("/", "sid", F.col("level") + 1, F.floor(F.col("idx") / FAN)))
    if trees > 1:
        up = F.when(last & ~top, F.concat_ws("/", F.lit(_TOP), F.lit(1), F.floor(F.col("sid") / FAN))).otherwise(up)
    place = F.when(last, F.col("sid")).otherwise(F.col("idx")) % FAN
    return runs.select(F.concat_ws("/", "sid", "level", "idx").alias("node"), up.alias("parent"),
                       place.cast("int").alias("place"), top.alias("top"), *[c for c in ("alone", "kids") if c in runs.columns],
                       "children")


def _climb_tree(nodes: DataFrame, most: int, level: int, stored: list[Stored]) -> None:
    """Adds the levels above ``nodes`` to ``stored``; ``most``: nodes of the largest tree."""
    while most > 1:
        stored.append(Stored(_runs(nodes.filter("n > 1"), level).drop("kids", "alone"), f"merkle-level-{level}"))
        nodes, most, level = stored[-1].read().select("sid", "idx", "digest", "n"), -(-most // FAN), level + 1


def build_manifest(leaves: DataFrame) -> Manifest:
    """Levels over (source, doc_id, leaf, found), each stored when built.

    Places come from one sort by range over all tasks, so a source of any size
    is spread out; a run's digests meet in one group of ``FAN`` rows."""
    spark = leaves.sparkSession
    leaves = Stored(leaves, "merkle-leaves")
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf")]
    numbered = with_row_index(leaves.read(), order, "nth")
    groups = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("start"))
    groups = Stored(with_row_index(groups, [F.col("start")], "sid"), "merkle-sources")
    trees, most = groups.read().agg(F.count(F.lit(1)), F.max("n")).first()
    own = groups.read().select(F.col("source").alias("of"), (F.col("sid") - 1).alias("sid"), "start", "n")
    placed = numbered.join(own, F.col("source").eqNullSafe(F.col("of"))).select(
        "sid", "n", (F.col("nth") - F.col("start")).alias("idx"), F.col("leaf").alias("digest"), "doc_id", "found")
    starts = Stored(_runs(placed, 1, "doc_id", "found"), "merkle-starts")
    leaves.drop()

    stored: list[Stored] = []
    ends = [starts.read()]
    _climb_tree(starts.read().filter("not alone").select("sid", "idx", "digest", "n"), -(-(most or 0) // FAN), 2, stored)
    ends += [s.read() for s in stored]
    subroots = reduce(DataFrame.unionByName, [e.filter("n = 1").select("sid", "digest") for e in ends])
    top = subroots.select(F.lit(_TOP).cast("long").alias("sid"), F.col("sid").alias("idx"), "digest",
                          F.lit(trees).cast("long").alias("n"))
    below = len(stored)
    _climb_tree(top, trees, 1, stored)
    groups.drop()
    root = (stored[-1].read().filter("n = 1") if len(stored) > below else subroots).select("digest").first()
    schema = "node string, parent string, place int, top boolean, children binary"
    runs = [_linked(s.read(), trees) for s in stored] or [spark.createDataFrame([], schema)]
    return Manifest(_linked(starts.read(), trees), reduce(DataFrame.unionByName, runs), root and bytes(root[0]))


@contextlib.contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    old = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _around(children: str, place: str) -> tuple[str, str]:
    """SQL for the digests before and behind the one at ``place``."""
    return (f"substring({children}, 1, ({place}) * {_BYTES})",
            f"substring({children}, ({place}) * {_BYTES} + {_BYTES + 1})")


def _folded(before: str, digest: str, behind: str) -> str:
    return f"unhex(sha2(lower(hex(concat({before}, {digest}, {behind}))), 256))"


_UP, _DOWN = _around("r.children", "c.place")
_CLIMB_SQL = f"""
WITH RECURSIVE climb(start, parent, place, folded, beside, subroot) AS (
  SELECT node, parent, place, folded, CAST('' AS BINARY), CAST(NULL AS BINARY) FROM {{starts}}
  UNION ALL
  SELECT c.start, r.parent, r.place, transform(c.folded, f -> {_folded(_UP, 'f', _DOWN)}),
         concat(c.beside, {_UP}, {_DOWN}),
         CASE WHEN r.top AND c.subroot IS NULL THEN substring(r.children, c.place * {_BYTES} + 1, {_BYTES})
              ELSE c.subroot END
  FROM climb c JOIN {{runs}} r ON c.parent = r.node)
SELECT start, folded, beside, subroot FROM climb WHERE parent IS NULL
"""


def verify_leaves(tree: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one
    row per leaf, digests as hex text."""
    spark = tree.starts.sparkSession
    before, behind = _around("children", "i")
    first = F.expr(f"transform(kids, (k, i) -> CASE WHEN alone THEN k.found ELSE {_folded(before, 'k.found', behind)} END)")
    starts = tree.starts.select("node", "parent", "place", first.alias("folded"))
    with _settings(spark, _CLIMB_CONF):
        climbed = Stored(spark.sql(_CLIMB_SQL, starts=starts, runs=tree.runs), "merkle-climbed").read()
    own = tree.starts.select(F.col("node").alias("start"), "alone", "kids", "children")
    leaves = climbed.join(own, "start").select(
        F.posexplode("kids").alias("i", "kid"), "alone", "children", "folded", "beside", "subroot")
    root = F.lower(F.hex(F.lit(tree.root).cast("binary")))
    beside = F.expr(f"concat(CASE WHEN alone THEN CAST('' AS BINARY) ELSE concat({before}, {behind}) END, beside)")
    out = leaves.select(
        F.col("kid.doc_id").alias("doc_id"), F.lower(F.hex("kid.digest")).alias("leaf"),
        F.coalesce(F.lower(F.hex("subroot")), root).alias("subroot"), root.alias("root"),
        F.sha2(F.lower(F.hex(beside)), 256).alias("proof_sha256"),
        F.lower(F.hex(F.expr("folded[i]"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
