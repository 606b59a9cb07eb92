"""Bounded expansion, shortest paths and personalised PageRank, for batches of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.functions.years import edge_in_years
from annales.operators.graph import ends
from annales.operators.search import top
from annales.session import ensure_checkpoint_dir


def passable(edges: DataFrame, relations: list[str] | None = None, low: int | None = None, high: int | None = None, slack: int = 5) -> DataFrame:
    """Edges of the given relations near the given years, before any join sees them."""
    rows = edges if relations is None else edges.where(F.col("rel").isin(relations))
    return rows.where(edge_in_years(F.col("start_year"), F.col("end_year"), low, high, slack)) if "start_year" in edges.columns else rows


def expand(seeds: DataFrame, edges: DataFrame, degree: DataFrame | None = None, hops: int = 2, max_degree: int | None = None, limit: int | None = None, key: str = "edge_id") -> DataFrame:
    """(query_id, seed, node, hop, edges): trails from seeds (query_id, id) over undirected edges, no edge twice.

    Nodes past the degree bound end no trail, seeds excepted as starts. Hops are
    held to 1..4. A limit counts trails per question in order of hop and edge
    ids; the replaced engine's limit was global and unordered.
    """
    hops = max(1, min(4, hops))
    steps = ends(edges, key)
    if degree is not None and max_degree is not None:
        calm = degree.where(F.col("degree") <= max_degree).select(F.col("id").alias("other"))
        # A node without a degree row has no edge and is no step's end.
        steps = steps.join(calm, "other", "left_semi")
    steps = steps.select(F.col("id").alias("node"), F.col("other").alias("_to"), F.col("edge").alias("_e"))
    front = seeds.select("query_id", F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hop"), F.array().cast("array<string>").alias("edges")).distinct()
    found = None
    for hop in range(1, hops + 1):
        met = front.join(steps, "node").where(~F.array_contains("edges", F.col("_e").cast("string")))
        front = met.select("query_id", "seed", F.col("_to").alias("node"), F.lit(hop).alias("hop"), F.concat("edges", F.array(F.col("_e").cast("string"))).alias("edges"))
        found = front if found is None else found.unionByName(front)
    if limit is None:
        return found
    order = Window.partitionBy("query_id").orderBy("hop", F.concat_ws("|", "edges"), "seed")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def shortest_paths(pairs: DataFrame, edges: DataFrame, degree: DataFrame | None = None, max_hops: int = 4, max_degree: int | None = 200, limit: int | None = 5, key: str = "edge_id") -> DataFrame:
    """(query_id, hops, nodes, edges): all shortest paths between pairs (query_id, a, b), undirected, up to max_hops (1..6).

    Inner nodes must not pass the degree bound. Fronts grow level by level; a
    question stops at the first level that meets its target. `limit` keeps the
    first paths by edge ids. a = b gives no path.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    max_hops = max(1, min(6, max_hops))
    steps = ends(edges, key).where("id <> other").select(F.col("id").alias("node"), F.col("other").alias("_to"), F.col("edge").cast("string").alias("_e"))
    if degree is not None and max_degree is not None:
        busy = degree.where(F.col("degree") > max_degree).select(F.col("id").alias("_to"), F.lit(True).alias("_busy"))
        steps = steps.join(busy, "_to", "left")
    else:
        steps = steps.withColumn("_busy", F.lit(None).cast("boolean"))
    front = pairs.where("a <> b").select("query_id", F.col("a").alias("node"), F.col("b").alias("target"), F.array("a").alias("nodes"), F.array().cast("array<string>").alias("edges")).distinct()
    seen = front.select("query_id", "node")
    found = None
    for hop in range(1, max_hops + 1):
        met = front.join(steps, "node").where("_busy IS NULL OR _to = target")
        met = met.select("query_id", "target", F.col("_to").alias("node"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("edges", F.array("_e")).alias("edges"))
        # Shortest paths meet no node that an earlier level has met.
        front = met.join(seen, ["query_id", "node"], "left_anti").checkpoint()
        hits = front.where("node = target").select("query_id", F.lit(hop).alias("hops"), "nodes", "edges")
        found = hits if found is None else found.unionByName(hits)
        if hop == max_hops or not front.where("node <> target").limit(1).count():
            break
        done = hits.select("query_id").distinct()
        front = front.join(done, "query_id", "left_anti")
        seen = seen.unionByName(front.select("query_id", "node")).distinct()
    if limit is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.concat_ws("|", "edges"))
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def pagerank(seeds: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, every: int = 10) -> DataFrame:
    """(query_id, node, score): personalised PageRank of each question over its own edges.

    seeds: query_id, id; edges: query_id, src, dst. Parallel edges count once,
    loops as one neighbour. Restarts are spread evenly over the seeds that the
    edges touch; questions none of whose seeds is touched have no rows. All
    nodes have edges, so no rank is lost. With a tolerance the batch ends when
    every question's last step changed less than nodes x tolerance, looked at
    each `every` steps, where lineage is cut too; where that never happens all
    nodes score 1. `tolerance=None` runs exactly `iterations` steps.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select("query_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.array_distinct(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    links = pairs.select("query_id", F.explode(both).alias("_l")).select("query_id", "_l.node", "_l.to").checkpoint()
    out = links.groupBy("query_id", "node").agg(F.count(F.lit(1)).alias("deg"))
    start = seeds.select("query_id", F.col("id").alias("node")).distinct().join(out.select("query_id", "node"), ["query_id", "node"], "left_semi")
    each = start.groupBy("query_id").agg((1.0 / F.count(F.lit(1))).alias("jump"))
    start = start.join(each, "query_id")
    count = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = out.join(each.select("query_id"), "query_id", "left_semi").join(start, ["query_id", "node"], "left").join(count, "query_id")
    nodes = nodes.select("query_id", "node", "deg", F.coalesce("jump", F.lit(0.0)).alias("jump"), "n").checkpoint()
    steps = links.join(nodes.select("query_id", "node", "deg"), ["query_id", "node"]).checkpoint()

    def walk(rank: DataFrame) -> DataFrame:
        # The former rank is read once a step, so plans grow by one step each, not twofold.
        flow = rank.join(steps, ["query_id", "node"]).groupBy("query_id", F.col("to").alias("node")).agg(F.sum(F.col("score") / F.col("deg")).alias("_in"))
        return nodes.join(flow, ["query_id", "node"], "left").select("query_id", "node", (alpha * F.coalesce("_in", F.lit(0.0)) + (1 - alpha) * F.col("jump")).alias("score"))

    # The walk starts evenly on all nodes, as the replaced engine's library does.
    rank = nodes.select("query_id", "node", (1.0 / F.col("n")).alias("score"))
    for step in range(1, iterations + 1):
        looked = step % every == 0 or step == iterations
        if looked and tolerance is not None:
            rank = rank.checkpoint()
        new = walk(rank)
        if not looked:
            rank = new
            continue
        new = new.checkpoint()
        if tolerance is not None:
            moved = new.join(rank.withColumnRenamed("score", "_old"), ["query_id", "node"]).groupBy("query_id").agg(F.sum(F.abs(F.col("score") - F.col("_old"))).alias("d"))
            if not moved.join(nodes.select("query_id", "n").distinct(), "query_id").where(F.col("d") >= F.col("n") * tolerance).limit(1).count():
                return new
        rank = new
    return rank if tolerance is None else rank.withColumn("score", F.lit(1.0))


def pagerank_near(seeds: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(query_id, node, score): pagerank of questions whose edges are bounded in number, as those of `expand` with a limit are.

    Such a neighbourhood fits one task many times over, so each question walks
    in memory, all its steps at once, and its change is looked at after every
    step. Rules are those of pagerank; for edges without a bound use that.
    """
    kind = dict(seeds.dtypes)["query_id"]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = rows[rows["b"].notna()]
        names, at = np.unique(np.concatenate([pairs["a"], pairs["b"]]).astype(str), return_inverse=True)
        n, a, b = len(names), at[: len(pairs)], at[len(pairs) :]
        loop = a == b
        src, dst = np.concatenate([a, b[~loop]]), np.concatenate([b, a[~loop]])
        jump = np.isin(names, rows.loc[rows["b"].isna(), "a"].to_numpy().astype(str)).astype(float)
        jump /= jump.sum()
        score, degree = np.full(n, 1.0 / n), np.bincount(src, minlength=n)
        for _ in range(iterations):
            new = alpha * np.bincount(dst, (score / degree)[src], n) + (1 - alpha) * jump
            moved, score = np.abs(new - score).sum(), new
            if moved < n * tolerance:
                break
        else:
            score = np.ones(n)
        return pd.DataFrame({"query_id": pd.Series([rows["query_id"].iloc[0]] * n, dtype=rows["query_id"].dtype), "node": pd.Series(list(names), dtype=object), "score": score})

    pairs = edges.select("query_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends_ = pairs.select("query_id", F.explode(F.array("a", "b")).alias("a")).distinct()
    touched = seeds.select("query_id", F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).distinct().join(ends_, ["query_id", "a"], "left_semi")
    walked = pairs.join(touched.select("query_id").distinct(), "query_id", "left_semi")
    return walked.unionByName(touched).groupBy("query_id").applyInPandas(walk, f"query_id {kind}, node string, score double")


#: Questions whose scores travel side by side over one edge table.
SIDE_BY_SIDE = 64


def pagerank_over(seeds: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, every: int = 10) -> DataFrame:
    """(query_id, node, score): pagerank where all questions walk over one graph.

    seeds: query_id, id; edges: src, dst. No edge is copied for a question: a
    node holds the scores of SIDE_BY_SIDE questions in as many columns, and
    further questions take further runs. Rules are those of pagerank; a block
    of questions ends together.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.array_distinct(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    links = pairs.select(F.explode(both).alias("_l")).select("_l.node", "_l.to").checkpoint()
    degree = links.groupBy("node").agg(F.count(F.lit(1)).alias("deg")).checkpoint()
    steps = links.join(degree, "node").checkpoint()
    count = degree.count()
    start = seeds.select("query_id", F.col("id").alias("node")).distinct().join(degree.select("node"), "node", "left_semi")
    start = start.join(start.groupBy("query_id").agg((1.0 / F.count(F.lit(1))).alias("jump")), "query_id").checkpoint()
    asked = [r[0] for r in start.select("query_id").distinct().orderBy("query_id").collect()]
    out = None
    for low in range(0, len(asked), SIDE_BY_SIDE):
        part = asked[low : low + SIDE_BY_SIDE]
        names = [f"s{i}" for i in range(len(part))]
        jumps = start.where(F.col("query_id").isin(part)).groupBy("node").agg(*[F.max(F.when(F.col("query_id") == q, F.col("jump"))).alias(f"j{i}") for i, q in enumerate(part)])
        nodes = degree.select("node").join(jumps, "node", "left").na.fill(0.0).checkpoint()

        def walk(rank: DataFrame, names=names, nodes=nodes) -> DataFrame:
            flow = rank.join(steps, "node").groupBy(F.col("to").alias("node")).agg(*[F.sum(F.col(s) / F.col("deg")).alias(f"_{s}") for s in names])
            return nodes.join(flow, "node", "left").select("node", *[(alpha * F.coalesce(f"_{s}", F.lit(0.0)) + (1 - alpha) * F.col(f"j{i}")).alias(s) for i, s in enumerate(names)])

        rank, settled = nodes.select("node", *[F.lit(1.0 / count).alias(s) for s in names]), tolerance is None
        for step in range(1, iterations + 1):
            looked = step % every == 0 or step == iterations
            if looked and tolerance is not None:
                rank = rank.checkpoint()
            new = walk(rank).checkpoint() if looked else walk(rank)
            if looked and tolerance is not None:
                olds = rank.select("node", *[F.col(s).alias(f"o{s}") for s in names])
                moved = new.join(olds, "node").agg(*[F.sum(F.abs(F.col(s) - F.col(f"o{s}"))) for s in names]).first()
                if all(m < count * tolerance for m in moved):
                    rank, settled = new, True
                    break
            rank = new
        each = F.array(*[F.struct(F.lit(q).alias("query_id"), (F.col(s) if settled else F.lit(1.0)).alias("score")) for q, s in zip(part, names)])
        rows = rank.select("node", F.explode(each).alias("_s")).select("_s.query_id", "node", "_s.score")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else seeds.limit(0).select("query_id", F.col("id").alias("node"), F.lit(0.0).alias("score"))


def trim(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, id) to keep and edges (query_id, src, dst) both of whose ends are kept."""
    kept = nodes.join(keep.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    ids = keep.select("query_id", F.col("id").alias("_k")).distinct()
    src = edges.join(ids.withColumnRenamed("_k", "src"), ["query_id", "src"], "left_semi")
    return kept, src.join(ids.withColumnRenamed("_k", "dst"), ["query_id", "dst"], "left_semi")


def period_seeds(degree: DataFrame, in_period: DataFrame, wanted: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, id, rank): the best connected entities of each question's periods (query_id, period_id)."""
    rows = in_period.join(F.broadcast(wanted), "period_id").select("query_id", "id").distinct().join(degree, "id").withColumnRenamed("degree", "score")
    return top(rows, "query_id", "score", "id", n).select("query_id", "id", F.col("score").alias("degree"), "rank")
