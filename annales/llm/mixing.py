"""Problem 8: mix sources to target weights.

Method: Pfair scheduling. Each source is a periodic task whose weight is its
share of the mixture's blocks; its j-th block is released at floor(j / w) and
due at ceil((j + 1) / w), and an earliest-deadline-first pass over released
blocks interleaves the sources so that each is less than one block away from its
share at every moment. A source that can't reach its target gets the weight of
what it can give, so that all sources end together. The pass runs over blocks,
whose number is bounded; documents take the places of their blocks by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.session import ensure_checkpoint_dir

#: Least tokens of a block.
BLOCK_TOKENS = 4096
#: Slots of the schedule at most, besides one for each source; blocks of a larger mixture are as much larger.
MOST_SLOTS = 1_000_000
#: Documents of a source in a bucket, whose running total one task works out.
BUCKET_DOCS = 50_000


def pfair_pattern(slots: dict[str, int]) -> list[str]:
    """The source scheduled in each slot, given the number of blocks of each.

    Block j of a task of n blocks out of `period` is eligible from
    floor(j*period/n) and due at ceil((j+1)*period/n); among eligible ones the
    earliest due runs, ties going to the block whose window overlaps its
    successor's, then to the heavier source, then by name.
    """
    period = sum(slots.values())
    later = [(0, name, 0) for name, n in slots.items() if n > 0]
    heapq.heapify(later)
    ready: list[tuple] = []
    pattern = []
    for now in range(period):
        while later and later[0][0] <= now:
            _, name, j = heapq.heappop(later)
            n = slots[name]
            overlaps = (j + 1) * period % n != 0
            heapq.heappush(ready, (-(-(j + 1) * period // n), not overlaps, -n, name, j))
        _, _, _, name, j = heapq.heappop(ready)
        pattern.append(name)
        if j + 1 < slots[name]:
            heapq.heappush(later, ((j + 1) * period // slots[name], name, j + 1))
    return pattern


def source_sizes(docs: DataFrame, tokens: Column, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc, source, tokens) of all documents with a source."""
    return docs.where(F.col(source).isNotNull()).select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), tokens.cast("long").alias("tokens"))


def mix_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: what it should give, can give and is planned to give.

    `sizes` as of source_sizes, `targets` with source, target_share, max_repeats.
    A source's goal is target_share of the size of all documents with a source;
    its capacity is its own size times max_repeats; planned is the smaller of the
    two. Sources without documents have size 0; sources without a target give
    nothing but count in the total; targets with a null source are dropped, null
    shares are 0 and null repeats 1. An empty corpus makes every goal 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("size_tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = by_source.agg(F.coalesce(F.sum("size_tokens"), F.lit(0)).alias("total_tokens"))
    goals = targets.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # One row of totals: a scalar, not a cross product of tables.
    rows = goals.join(by_source, "source", "left").join(F.broadcast(total), F.lit(True), "inner")
    rows = rows.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("size_tokens", F.lit(0)).alias("size_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "total_tokens")
    rows = rows.withColumn("goal_tokens", F.col("target_share") * F.col("total_tokens")).withColumn("capacity_tokens", F.col("size_tokens") * F.col("max_repeats"))
    return rows.withColumn("planned_tokens", F.least("goal_tokens", F.col("capacity_tokens").cast("double")))


def _kept(sizes: DataFrame) -> DataFrame:
    """Sizes written once, as they are used several times; tokenising is the dear part."""
    ensure_checkpoint_dir(sizes.sparkSession)
    return sizes.checkpoint()


def mix_sources(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, most_slots: int = MOST_SLOTS, seed: int = 0) -> DataFrame:
    """The mixture: one row per use of a document, with its copy number and place in the interleaving.

    Columns doc, source, copy, tokens, block, slot. Copies of a source follow one
    another, each pass in a seeded random order; a document is used when it
    starts before the source's planned tokens end, hence at most max_repeats
    times. Documents of zero tokens are left out, as are targets without a
    document. `slot` orders blocks of all sources as the Pfair pass schedules
    them; every slot holds one block.
    """
    return _mixture(_kept(sizes), targets, block_tokens, most_slots, seed)


def _mixture(sizes: DataFrame, targets: DataFrame, block_tokens: int, most_slots: int, seed: int) -> DataFrame:
    spark = sizes.sparkSession
    sizes = sizes.where(F.col("tokens") > 0)
    # One row per source of the target table, whose size is that of the request.
    plan = [r for r in mix_report(sizes, targets).collect() if r["planned_tokens"] > 0]
    block = max(block_tokens, -(-int(sum(r["planned_tokens"] for r in plan)) // most_slots))
    places: dict[str, list[int]] = {r["source"]: [] for r in plan}
    for at, name in enumerate(pfair_pattern({r["source"]: int(-(-r["planned_tokens"] // block)) for r in plan})):
        places[name].append(at)
    rows = [(r["source"], float(r["planned_tokens"]), int(r["size_tokens"]), -(-int(r["n_docs"]) // BUCKET_DOCS), places[r["source"]]) for r in plan]
    # Bounded by most_slots numbers and the rows of the target table.
    per_source = F.broadcast(spark.createDataFrame(rows, "source string, planned double, size long, buckets int, places array<int>"))
    asked = sizes.join(per_source.select("source", "buckets"), "source")
    shuffled = asked.withColumn("_h", F.xxhash64("doc", F.lit(seed))).withColumn("_b", F.pmod(F.col("_h"), F.col("buckets").cast("long"))).drop("buckets")
    buckets = shuffled.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    before = buckets.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n")).select("source", "_b", "_before")
    inside = F.sum("tokens").over(Window.partitionBy("source", "_b").orderBy("_h", "doc")) - F.col("tokens")
    placed = shuffled.withColumn("_in", inside).join(before, ["source", "_b"]).withColumn("_start", F.col("_before") + F.col("_in")).join(per_source, "source")
    # Copies that start before the planned tokens end.
    copies = F.ceil((F.col("planned") - F.col("_start")) / F.col("size")).cast("int")
    used = placed.withColumn("_copies", copies).where(F.col("_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    at = F.col("_start") + (F.col("copy") - 1) * F.col("size")
    used = used.withColumn("block", F.floor(at / F.lit(block)).cast("long"))
    return used.select("doc", "source", "copy", "tokens", "block", F.element_at("places", (F.col("block") + 1).cast("int")).cast("long").alias("slot"))


def mix_shares(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, most_slots: int = MOST_SLOTS, seed: int = 0) -> DataFrame:
    """One row per target source: the plan of mix_report and what the scheduled mixture holds.

    given_tokens, used_docs and blocks are counted from the rows of mix_sources
    with the same parameters; actual_share is given_tokens over all given tokens
    (null for an empty mixture); `reachable` is whether the given tokens reach
    the goal. A source gives more than its goal by less than a document.
    """
    sizes = _kept(sizes)
    mixture = _mixture(sizes, targets, block_tokens, most_slots, seed)
    given = mixture.groupBy("source").agg(F.sum("tokens").alias("given_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("block").alias("_last"), F.max("copy").alias("copies"))
    rows = mix_report(sizes, targets).join(given, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("given_tokens", "used_docs", "copies")})
    rows = rows.withColumn("blocks", F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
    # As many rows as the target table has.
    total = F.sum("given_tokens").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.when(total > 0, F.col("given_tokens") / total)).withColumn("reachable", F.col("given_tokens") >= F.col("goal_tokens"))
