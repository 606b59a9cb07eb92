"""Vector and full-text search for batches of questions, fusion, boosting and linking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.config import DEFAULT, Config
from annales.functions.text import words
from annales.session import ensure_checkpoint_dir
from annales.sources.tables import spread

#: Rows of a question table that may be broadcast.
MOST_QUESTIONS = 20_000


def top(rows: DataFrame, key: str, score: str, item: str, k: int) -> DataFrame:
    """The k rows of each key with the highest rounded score, ties by item; with their rank.

    Ranking on the rounded score keeps the last bits of floating sums from reordering.
    """
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine of two arrays in double precision; null if one has no direction."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)) for v in (x, y)]
    return dot / F.nullif(norms[0] * norms[1], F.lit(0.0))


def few(queries: DataFrame) -> DataFrame:
    """The question table with a broadcast hint where its size, counted, allows it."""
    return F.broadcast(queries) if queries.limit(MOST_QUESTIONS + 1).count() <= MOST_QUESTIONS else queries


def _directions(vectors: list, dims: int) -> np.ndarray:
    """Rows at length one; those of another width, with nulls or without direction are null rows."""
    out = np.full((len(vectors), dims), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            out[i] = np.array(v, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(axis=1))[:, None]


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, item: str = "id", where: Column | None = None, post_filter: bool = False) -> DataFrame:
    """(query_id, item, score, rank): exact cosine of every question against all vectors.

    queries: query_id, vector. The filter holds before the ranking; with
    `post_filter` after the best max(4k, 40), as an index that filters late does.
    Questions travel to the vectors in blocks of MOST_QUESTIONS, each a pass over
    them; a batch of vectors keeps a question's best k by matrix product, so
    only these are shuffled. Vectors of other width or without direction score
    nothing.
    """
    rows = vectors if where is None or post_filter else vectors.where(where)
    late = where is not None and post_filter
    kept = [c for c in vectors.columns if c not in (item, "vector")] if late else []
    wide = max(4 * k, 40) if late else k
    kinds = dict(vectors.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("query_id", item, *kept)) + ", score double"
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    blocks = -(-asked.count() // MOST_QUESTIONS)
    scored = None
    for n in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        block = part.toArrow()
        if not block.num_rows:
            continue
        dims = max(len(v) for v in block.column("vector").to_pylist())
        packed = queries.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), _directions(block.column("vector").to_pylist(), dims)))

        def near(batches: Iterator[pa.RecordBatch], packed=packed, dims=dims) -> Iterator[pa.RecordBatch]:
            ids, seek = packed.value
            for batch in batches:
                unit = _directions(batch.column("vector").to_pylist(), dims)
                good = np.flatnonzero(~np.isnan(unit).any(axis=1))
                step = max(1, 4_000_000 // max(1, len(good)))
                for low in range(0, len(seek) if len(good) else 0, step):
                    score = np.round(seek[low : low + step] @ unit[good].T, 6)
                    np.nan_to_num(score, copy=False, nan=-2.0)
                    if len(good) > wide:
                        floor = np.partition(score, len(good) - wide, axis=1)[:, len(good) - wide]
                        i, j = np.nonzero((score >= floor[:, None]) & (score > -2))
                    else:
                        i, j = np.nonzero(score > -2)
                    at = pa.array(good[j])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(low + i)), *(batch.column(c).take(at) for c in (item, *kept)), pa.array(score[i, j])], names=["query_id", item, *kept, "score"])

        found = spread(rows.select(item, *kept, "vector")).select(item, *kept, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(near, schema)
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        scored = queries.sparkSession.createDataFrame([], schema)
    if not late:
        return top(scored.select("query_id", item, "score"), "query_id", "score", item, k)
    best = top(scored.select("query_id", item, "score", *kept), "query_id", "score", item, wide).where(where)
    return top(best.drop("rank"), "query_id", "score", item, k).select("query_id", item, "score", "rank")


def _exploded(docs: DataFrame, item: str, text: str) -> DataFrame:
    """(item, length, term): the words of each document and the empty term."""
    listed = spread(docs.select(item, text)).select(item, words(F.col(text)).alias("_w"))
    # An outer explode, as the optimiser would ask for the length of an inner one's array, and so for the words, once more.
    each = F.explode_outer(F.when(F.size("_w") > 0, F.concat(F.array(F.lit("")), "_w")))
    return listed.select(item, F.size("_w").alias("length"), each.alias("term"))


def inverted_index(docs: DataFrame, item: str = "id", text: str = "text") -> DataFrame:
    """(term, item, tf, length): one row per word of a document, and one of the empty term; documents without words have none.

    Written once, partitioned or bucketed by term, it serves any number of
    batches of questions through scored_hits.
    """
    return _exploded(docs, item, text).where("term IS NOT NULL").groupBy("term", item).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, item: str = "id", text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """(query_id, item, score, rank): BM25 over distinct words of each question, any text accepted.

    queries: query_id, query. idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N and the
    mean length count documents with words. Only terms of the questions are
    exploded: their list is broadcast where its counted size allows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term")).checkpoint()
    # The empty term stands for the document itself, so one pass tells lengths and hits.
    whole = asked.sparkSession.createDataFrame([("",)], "term string")
    # Terms, and what is worked out for each asked one, have no more rows than what is asked, which is counted once.
    hint = F.broadcast if asked.count() <= MOST_QUESTIONS else lambda df: df
    terms = hint(asked.select("term").unionByName(whole).distinct())
    hits = _exploded(docs, item, text).join(terms, "term", "left_semi").groupBy("term", item).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length")).checkpoint()
    return _scored(hits, hits.where("term <> ''"), asked, hint, k, item, config)


def scored_hits(hits: DataFrame, asked: DataFrame, k: int, item: str = "id", config: Config = DEFAULT) -> DataFrame:
    """(query_id, item, score, rank) from rows of an inverted index (term, item, tf, length), the empty term standing for each document, and asked terms (query_id, term)."""
    hint = F.broadcast if asked.limit(MOST_QUESTIONS + 1).count() <= MOST_QUESTIONS else lambda df: df
    return _scored(hits, hits.where("term <> ''").join(hint(asked.select("term").distinct()), "term", "left_semi"), asked, hint, k, item, config)


def _scored(hits: DataFrame, rows: DataFrame, asked: DataFrame, hint: Callable[[DataFrame], DataFrame], k: int, item: str, config: Config) -> DataFrame:
    k1, b = config.bm25_k1, config.bm25_b
    # One row: a constant, read ahead of the rest.
    stats = hits.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = F.lit(float(stats["n"])), F.lit(float(stats["mean"] or 1.0))
    frequency = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(frequency, "term").select("query_id", "term", idf.alias("_i"))
    weight = F.col("_i") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    scored = rows.join(hint(weighed), "term").groupBy("query_id", item).agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, "query_id", "score", item, k)


def rrf(lists: Sequence[tuple[DataFrame, float]], item: str = "id", k: int = 60, rounded: int = 9) -> DataFrame:
    """(query_id, item, score, rank): sum of weight / (k + rank) over ranked lists (query_id, item, rank).

    Lists of weight 0 are passed over; ties keep the order of first sight: the
    earlier list, then its rank.
    """
    parts = [df.select("query_id", item, (F.lit(float(w)) / (k + F.col("rank"))).alias("_s"), F.struct(F.lit(n).alias("list"), F.col("rank").alias("at")).alias("_f")) for n, (df, w) in enumerate(lists) if w]
    if not parts:
        raise ValueError("no list has a weight")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("query_id", item).agg(F.round(F.sum("_s"), rounded).alias("score"), F.min("_f").alias("_f"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_f"), F.col(item))
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", item, "score", "rank")


def rrf_by_intent(queries: DataFrame, lists: Sequence[DataFrame], item: str = "id", config: Config = DEFAULT, mode: str = "graph", rounded: int = 9) -> DataFrame:
    """Fusion of vector, graph and path lists with the weights of each question's intent (query_id, intent)."""
    known = list(config.fusion)
    weights = [F.lit(0.0) if mode == "vector" and n else F.lit(1.0) if mode == "vector" else F.coalesce(*[F.when(F.col("intent") == i, F.lit(config.fusion[i][n])) for i in known], F.lit((0.5, 0.5, 0.0)[n])) for n in range(3)]
    intents = few(queries.select("query_id", "intent"))
    parts = [df.join(intents, "query_id").select("query_id", item, weights[n].alias("_w"), F.struct(F.lit(n).alias("list"), F.col("rank").alias("at")).alias("_f")) for n, df in enumerate(lists)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.where("_w > 0").groupBy("query_id", item).agg(F.round(F.sum(F.col("_w") / (config.rrf_k + F.col("_f.at"))), rounded).alias("score"), F.min("_f").alias("_f"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_f"), F.col(item))
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", item, "score", "rank")


def boost_evidence(ranked: DataFrame, evidence: DataFrame, item: str = "id", factor: float = 1.3, rounded: int = 9) -> DataFrame:
    """Scores of evidence (query_id, item) times `factor`, order renewed; ties keep their former order."""
    flagged = ranked.join(evidence.select("query_id", item).distinct().withColumn("_e", F.lit(True)), ["query_id", item], "left")
    rows = flagged.withColumn("score", F.round(F.when(F.col("_e"), F.col("score") * factor).otherwise(F.col("score")), rounded)).drop("_e").withColumnRenamed("rank", "_was")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_was"))
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", item, "score", "rank")


def prefer_periods(ranked: DataFrame, in_period: DataFrame, preferred: DataFrame, item: str = "id", k: int = 2) -> DataFrame:
    """The first k candidates after those of a preferred period (query_id, period_id) are put ahead, order kept inside."""
    good = in_period.join(few(preferred), "period_id").select("query_id", item).distinct().withColumn("_g", F.lit(True))
    rows = ranked.join(good, ["query_id", item], "left").withColumn("_g", F.coalesce("_g", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.col("_g").desc(), F.col("rank"))
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query_id", item, F.col("new_rank").alias("rank"))


def link_mentions(mentions: DataFrame, names: DataFrame, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, k: int = 2, pool: int = 10, config: Config = DEFAULT) -> DataFrame:
    """(query_id, id, rank): ids of names (id, text) for mentions (query_id, position, mention), distinct, in order of mention.

    Full text and, with vectors and an embedder, vector candidates are fused.
    """
    one = mentions.select(F.concat_ws("#", "query_id", "position").alias("query_id"), F.col("mention").alias("query"))
    ranked = bm25_topk(one, names, pool, "id", "text", config)
    lists = [(ranked, 1.0)]
    if vectors is not None and embed is not None:
        lists.append((vector_topk(embed(one.withColumnRenamed("query", "text")).select("query_id", "vector"), vectors, pool), 1.0))
    best = rrf(lists, k=config.rrf_k).where(F.col("rank") <= k)
    apart = best.select(F.split_part("query_id", F.lit("#"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("#"), F.lit(2)).cast("int").alias("_p"), "id", "rank")
    first = apart.groupBy("query_id", "id").agg(F.min(F.struct("_p", "rank")).alias("_f"))
    order = Window.partitionBy("query_id").orderBy("_f", "id")
    return first.select("query_id", "id", F.row_number().over(order).alias("rank"))


def rerank(ranked: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, item: str = "id", first: int = 30) -> DataFrame:
    """The first `first` items reordered by a scorer that adds `relevance`; without one nothing changes."""
    if scorer is None:
        return ranked
    scored = scorer(ranked.where(F.col("rank") <= first)).withColumn("_new", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank")))
    rest = ranked.where(F.col("rank") > first)
    return scored.select("query_id", item, "score", F.col("_new").alias("rank")).unionByName(rest.select("query_id", item, "score", "rank"))
