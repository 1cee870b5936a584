"""Mixing sources to target weights, with DataFrame functions only.

Words are packed into blocks of ``block_words``: within a source the documents
lie end to end in the order of their ids, and block b holds words
``[b * block_words, (b + 1) * block_words)`` of that line. The output is a row
of slots, dealt into shards. Each shard draws how many slots each source gets:
the whole part of its expectation, and the rest as multinomial draws (so that a
source's total strays by a few blocks, however many shards there are). The
g-th slot of a source is place ``g mod n`` of its pass ``g div n`` over its n
blocks, and a keyed permutation of 0..n-1 (swap-or-not rounds; a bijection for
every n) turns the place into a block. Blocks join by (source, block).

A pass uses every block once, and no slot is beyond pass ``max_repeats``, so no
document is taken more than that many times. Everything is a function of the
data and ``seed``; reruns agree.

The frame of sources has one row per source and the draws one row per source
and shard; only these go through windows that are not split further. Running
word counts of all documents come from range partitions, so a source with a
third of all rows is many partitions.

Rows are documents: repeated rows or ids each have their own place. A null id
comes first in its source, a null source is a source of its own, after all
others; null or empty texts have size 0 and are never taken. Without any word
all targets are 0. Other columns are ignored, whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeflow.llm.stored import store
from themeflow.operators.ordering import with_running_sum

_SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeats: int = 3
    block_words: int = 64
    shard_slots: int = 4096
    rounds: int = 24
    task_slots: int = 100_000
    seed: int = 20


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, s: MixSettings) -> DataFrame:
    """Per source: ``sid`` (its place by code point, null last), source_size,
    words before it, and the target.

    Sources share the total by weight; a target stops at ``max_repeats`` times
    its source's size, the excess goes to the others by weight. That ends at
    ``least(max_repeats * size, level * weight)`` with the one level at which
    the targets add up to the total; it is found along the sources sorted by
    their cap per weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (per.withColumn("sid", F.row_number().over(by_name) - 1)
           .withColumn("words_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
           .withColumn("total", F.sum("source_size").over(everything))
           .withColumn("weight", F.element_at(F.array(*map(F.lit, s.weights)),
                                              (F.col("sid") % len(s.weights) + 1).cast("int")))
           .withColumn("cap", s.max_repeats * F.col("source_size").cast("double")))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    taken = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level_here", (F.col("total") - taken) / open_weight)
    fits = F.col("cap") / F.col("weight") >= F.col("level_here")
    per = per.withColumn("level", F.coalesce(F.max(F.when(fits, F.col("level_here"))).over(everything), F.lit(0.0)))
    return per.select("source", "sid", "source_size", "words_before",
                      F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def shard_counts(sources: DataFrame, s: MixSettings) -> DataFrame:
    """Slots of each source in each shard: (sid, n_blocks, shard, n, start);
    start is the number of the source's slots in earlier shards."""
    everything = Window.partitionBy()
    by_sid = Window.orderBy("sid")
    src = (sources.filter("source_size > 0")
           .withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(s.block_words)).cast("long"))
           .withColumn("wanted", F.col("target") * F.col("n_blocks") / F.col("source_size"))
           .withColumn("slots", F.round(F.sum("wanted").over(everything)).cast("long"))
           .withColumn("share", F.col("wanted") / F.sum("wanted").over(everything)))
    grid = (src.withColumn("shard", F.explode(F.expr(
                f"sequence(0L, cast(ceil(slots / {s.shard_slots}) as bigint) - 1)")))
            .withColumn("size", F.least(F.lit(s.shard_slots), F.col("slots") - F.col("shard") * s.shard_slots))
            .withColumn("mean", F.col("size") * F.col("share"))
            .withColumn("whole", F.floor("mean")))
    in_shard = Window.partitionBy("shard").orderBy("sid")
    grid = (grid.withColumn("upto", F.sum(F.col("mean") - F.col("whole")).over(in_shard))
            .withColumn("rest", F.col("size") - F.sum("whole").over(Window.partitionBy("shard"))))
    # draws of the rest: points among the sources' cumulative bounds
    top = F.max("upto").over(Window.partitionBy("shard"))
    bounds = grid.withColumn("top", top)
    draws = (bounds.groupBy("shard").agg(F.first("rest").alias("rest"), F.max("top").alias("top"))
             .filter("rest > 0").withColumn("draw", F.explode(F.expr("sequence(1L, rest)")))
             .select("shard", (_uniform(F.lit(s.seed), F.col("shard"), F.col("draw")) * F.col("top")).alias("at"),
                     F.lit(None).cast("int").alias("sid")))
    marks = bounds.select("shard", F.col("upto").alias("at"), "sid").unionByName(draws)
    upward = Window.partitionBy("shard").orderBy(F.col("at").desc(), F.col("sid").asc_nulls_last())
    extra = (marks.withColumn("drawn", F.last("sid", ignorenulls=True).over(upward))
             .filter("sid is null and drawn is not null").groupBy("shard", F.col("drawn").alias("sid"))
             .agg(F.count(F.lit(1)).alias("extra")))
    counts = (grid.join(extra, ["shard", "sid"], "left")
              .withColumn("n", F.col("whole") + F.coalesce("extra", F.lit(0))))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store(counts.select("sid", "n_blocks", "shard", "n",
                               F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "mix-counts")


def permuted(place: Column, n: Column, salt: Column, rounds: int) -> Column:
    """A keyed bijection of 0..n-1: each round swaps x with its partner
    (key - x) mod n or not, as a hash of the larger of the two says."""
    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(salt, r), n) - x, n)
        swap = F.xxhash64(salt, -r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place, step)


def slots(counts: DataFrame, s: MixSettings) -> DataFrame:
    """One row per slot of the output: shard, source, block. The few rows of
    counts are dealt out first, by how many slots they become."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return (counts.filter("n > 0").repartition(1 + total // s.task_slots, "sid", "shard")
            .select("sid", "n_blocks", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("g"))
            .withColumn("pass", F.floor(F.col("g") / F.col("n_blocks")))
            .filter(F.col("pass") < s.max_repeats)
            .withColumn("salt", F.xxhash64(F.lit(s.seed), F.col("sid"), F.col("pass")))
            .select("shard", "sid", "g", permuted(F.col("g") % F.col("n_blocks"), F.col("n_blocks"), F.col("salt"),
                                                  s.rounds).alias("block")))


def layout(docs: DataFrame, s: MixSettings, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with size and place in their source, sources)."""
    sizes = store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              n_words(F.col(text_col)).alias("size")), "mix-sizes")
    sources = store(source_targets(sizes, s), "mix-sources")
    placed = with_running_sum(sizes, "size", [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size")],
                              "until", index_name="row")
    joined = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    return joined.select("p.doc_id", "p.source", "row", "size", "sid", "source_size", "target",
                         (F.col("until") - F.col("size") - F.col("words_before")).alias("begin")), sources


def doc_blocks(placed: DataFrame, s: MixSettings) -> DataFrame:
    """The parts of documents that lie in each block: (sid, block, row, words,
    from_word), from_word being the part's place in its document."""
    b = s.block_words
    return (placed.filter("size > 0")
            .select("row", "sid", "begin", (F.col("begin") + F.col("size")).alias("end"),
                    F.explode(F.expr(f"sequence(cast(begin div {b} as bigint), cast((begin + size - 1) div {b} as bigint))"))
                    .alias("block"))
            .withColumn("lo", F.greatest("begin", F.col("block") * b))
            .withColumn("hi", F.least("end", (F.col("block") + 1) * b))
            .select("sid", "block", "row", (F.col("hi") - F.col("lo")).alias("words"),
                    (F.col("lo") - F.col("begin")).alias("from_word")))


def mixed_parts(docs: DataFrame, s: MixSettings = MixSettings(), **cols) -> DataFrame:
    """The mix itself: for each slot (shard, sid, g) the parts of documents in
    its block, as doc_id, from_word and words."""
    placed, sources = layout(docs, s, **cols)
    placed = store(placed, "mix-layout")
    parts = doc_blocks(placed, s).join(placed.select("row", "doc_id").hint("merge"), "row")
    return slots(shard_counts(sources, s), s).join(parts.hint("merge"), ["sid", "block"]).select(
        "shard", "sid", "g", "block", "doc_id", "from_word", "words")


def mix_report(docs: DataFrame, s: MixSettings = MixSettings(), **cols) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source,
    and taken, the words that the mix takes from it (repeats counted)."""
    placed, sources = layout(docs, s, **cols)
    placed = store(placed, "mix-layout")
    times = slots(shard_counts(sources, s), s).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # estimates know nothing of exploded rows: without the hint they are broadcast
    taken = (doc_blocks(placed, s).join(times.hint("merge"), ["sid", "block"])
             .groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    return (placed.join(taken.hint("merge"), "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source"))
