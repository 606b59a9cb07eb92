"""Answering batches of questions, and the build of the graph stage by stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales import plugins
from annales.config import DEFAULT, Config
from annales.functions.times import spans
from annales.functions.years import overlaps
from annales.operators import chunking, context, graph, search, traverse
from annales.operators.extract import ONTOLOGY
from annales.operators.periods import by_alias, in_period
from annales.plans import views
from annales.session import ensure_checkpoint_dir

STAGES = ("ingest", "parse", "chunk", "extract", "resolve", "load", "embed")


@dataclass
class Store:
    """Tables of a built graph; vectors stand apart so that browsing never reads them."""

    chunks: DataFrame
    entities: DataFrame
    edges: DataFrame
    periods: DataFrame
    in_period: DataFrame
    chunk_vectors: DataFrame | None = None
    entity_vectors: DataFrame | None = None
    degree: DataFrame | None = None
    eras: DataFrame | None = None


def open_store(spark: SparkSession, folder: str, embed: bool = True) -> Store:
    """The graph held in a folder of tables; its views are written once, as a build would. With vectors of one embedder for chunks and names."""
    ensure_checkpoint_dir(spark)
    nodes, edges, chunks = views.entities(spark, folder).checkpoint(), views.edges(spark, folder).checkpoint(), views.chunks(spark, folder)
    vectors = plugins.embed_rows(chunks.select("id", "text")).select("id", "vector") if embed else None
    named = plugins.embed_rows(nodes.select("id", F.concat_ws("\n", "name", "description").alias("text"))).select("id", "vector") if embed else None
    dim = views.periods(spark, folder)
    return Store(chunks, nodes, edges, dim, in_period(nodes, dim), vectors, named)


@dataclass
class Answered:
    plans: DataFrame
    chunks: DataFrame
    triplets: DataFrame
    citations: DataFrame
    context: DataFrame


def plan_rules(questions: DataFrame, periods: DataFrame, config: Config = DEFAULT, eras: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, low, high, periods, out_of_scope): the longest alias of a period or era named, else the first time span.

    periods: id, name, start_year, end_year, era_id, position; eras: id, alias;
    aliases: more names of periods (id, alias). An era stands for all its periods.
    """
    dim = periods.select("id", F.col("name").alias("alias"), "position")
    if aliases is not None:
        dim = dim.unionByName(aliases.join(periods.select("id", "position"), "id").select("id", "alias", "position"))
    names = dim.select(F.lit("period").alias("kind"), "id", "alias", "position")
    whole = periods.select(F.lit("period").alias("kind"), "id", F.col("start_year").alias("_na"), F.coalesce("end_year", "start_year").alias("_nb"), F.array("id").alias("_np"))
    if eras is not None:
        of_era = periods.groupBy(F.col("era_id").alias("id")).agg(F.min("start_year").alias("_na"), F.max(F.coalesce("end_year", "start_year")).alias("_nb"), F.array_sort(F.collect_set("id")).alias("_np"), F.min("position").alias("position"))
        # A period comes before its era where both are named at equal length.
        names = names.unionByName(eras.join(of_era.select("id", "position"), "id").select(F.lit("era").alias("kind"), "id", "alias", (F.col("position") + 100_000).alias("position")))
        whole = whole.unionByName(of_era.select(F.lit("era").alias("kind"), "id", "_na", "_nb", "_np"))
    named = by_alias(questions, names, "query_id", "query").join(F.broadcast(whole), ["kind", "id"]).select("query_id", "_na", "_nb", "_np")
    rows = questions.select("query_id", F.try_element_at(spans(F.col("query")), F.lit(1)).alias("_s")).join(named, "query_id", "left")
    low, high = F.coalesce("_na", F.col("_s.start")), F.coalesce("_nb", F.col("_s.end"))
    rows = rows.select("query_id", low.alias("low"), high.alias("high"), "_np")
    met = rows.where("_np IS NULL AND low IS NOT NULL").join(F.broadcast(periods.select("id", "start_year", "end_year")), overlaps(F.col("low"), F.col("high"), F.col("start_year"), F.col("end_year"))).groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("_mp"))
    empty = F.array().cast("array<string>")
    return rows.join(met, "query_id", "left").select("query_id", "low", "high", F.coalesce("_np", "_mp", empty).alias("periods"), F.coalesce(F.col("low") > config.max_year, F.lit(False)).alias("out_of_scope"))


def choose_scope(rules: DataFrame, asked: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """(query_id, low, high, periods): years by the rules, else the user's filter, else the analyzer; periods by the analyzer, else the rules.

    rules: query_id, low, high, periods; asked: query_id, low, high; told: query_id,
    low, high, periods. A range counts as a whole, with its own end.
    """
    rows = rules.select("query_id", F.struct("low", "high").alias("_r"), "periods")
    for name, df in (("_u", asked), ("_t", told)):
        if df is None:
            rows = rows.withColumn(name, F.lit(None).cast("struct<low:int,high:int>")).withColumn(name + "p", F.lit(None).cast("array<string>"))
        else:
            also = F.col("periods") if "periods" in df.columns else F.lit(None).cast("array<string>")
            rows = rows.join(df.select("query_id", F.struct("low", "high").alias(name), also.alias(name + "p")), "query_id", "left")
    valid = [F.when(F.col(c)["low"].isNotNull(), F.col(c)) for c in ("_r", "_u", "_t")]
    time = F.coalesce(*valid)
    listed = [F.when(F.size(c) > 0, F.col(c)) for c in ("_tp", "periods")]
    return rows.select("query_id", time["low"].alias("low"), time["high"].alias("high"), F.coalesce(*listed, F.array().cast("array<string>")).alias("periods"))


def retrieve(questions: DataFrame, store: Store, config: Config = DEFAULT, mode: str = "graph") -> Answered:
    """Everything an answer rests on, for questions (query_id, query[, mentions array]).

    Time and periods come from rules; intents from the registered analyzer or
    the rules; mentions link to seeds by name and, where the store has vectors
    of entities, by likeness; questions without any take the best connected of
    their periods. Three lists are fused by intent: chunk search (full text and
    vectors), evidence around the seeds by PageRank, and evidence along the
    shortest paths between a question's first two seeds. Questions out of scope
    have no rows beyond their plan.

    The store's tables are read several times and not copied; those that are
    views should be written first. Only what lies around the seeds is.
    """
    ensure_checkpoint_dir(questions.sparkSession)
    plans = (plugins.registered("analyzer") or plugins.rule_analyzer)(questions).join(plan_rules(questions, store.periods, config, store.eras), "query_id").checkpoint()
    open_ = plans.where("NOT out_of_scope")
    said = open_.select("query_id", F.posexplode("mentions").alias("position", "mention")) if "mentions" in questions.columns else open_.select("query_id", F.lit(0).alias("position"), F.col("query").alias("mention"))
    embed = lambda rows: plugins.embed_rows(rows)
    seeds = search.link_mentions(said, store.entities.select("id", F.col("name").alias("text")), store.entity_vectors, embed if store.entity_vectors is not None else None, config=config)
    wanted = open_.select("query_id", F.explode("periods").alias("period_id"))
    degree = store.degree if store.degree is not None else graph.degrees(store.edges).checkpoint()
    missing = wanted.join(seeds.select("query_id").distinct(), "query_id", "left_anti")
    seeds = seeds.select("query_id", "id", "rank").unionByName(traverse.period_seeds(degree, store.in_period, missing).select("query_id", "id", "rank")).checkpoint()
    ranked = search.bm25_topk(open_.select("query_id", "query"), store.chunks.select("id", "text"), config.chunk_k, config=config)
    lists = [(ranked, 1.0)]
    if store.chunk_vectors is not None:
        asked = plugins.embed_rows(open_.select("query_id", F.col("query").alias("text"))).select("query_id", "vector")
        lists.append((search.vector_topk(asked, store.chunk_vectors, config.chunk_k), 1.0))
    found = search.rrf(lists, k=config.rrf_k).checkpoint()
    if mode == "vector":
        triplets = store.edges.limit(0).select(F.lit("").alias("query_id"), *store.edges.columns, F.lit(0.0).alias("score"))
        fused, paths = found, None
    else:
        bound = graph.degree_bound(degree, config.max_degree)
        passable = traverse.passable(store.edges, list(ONTOLOGY))
        trails = traverse.expand(seeds.select("query_id", "id"), passable, degree, config.hops, bound, config.max_paths)
        first = seeds.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        routes = traverse.shortest_paths(first, passable, degree, config.path_hops, config.path_degree, config.path_limit)
        routes = routes.withColumn("route", F.row_number().over(Window.partitionBy("query_id").orderBy(F.concat_ws("|", "edges")))).checkpoint()
        met = trails.select("query_id", F.explode("edges").alias("edge_id")).unionByName(routes.select("query_id", F.explode("edges").alias("edge_id"))).distinct()
        near = met.join(store.edges, "edge_id").checkpoint()
        # A limit on trails bounds each question's neighbourhood.
        walk = traverse.pagerank if config.max_paths is None else traverse.pagerank_near
        rank = walk(seeds, near.select("query_id", "src", "dst"), config.ppr_alpha, config.ppr_iterations, config.ppr_tolerance)
        best = search.top(rank.withColumn("score", F.round("score", 9)), "query_id", "score", "node", config.ppr_top_n).select("query_id", F.col("node").alias("id"), "score")
        kept = best.select("query_id", "id").unionByName(seeds.select("query_id", "id")).distinct()
        score = best.select("query_id", F.col("id").alias("src"), F.col("score").alias("_s"))
        triplets = traverse.trim(kept, near, kept)[1].join(score, ["query_id", "src"], "left").withColumn("score", F.coalesce("_s", F.lit(0.0))).drop("_s")
        evidence = triplets.select("query_id", F.explode("evidence").alias("id"), "score").groupBy("query_id", "id").agg(F.max("score").alias("score"))
        by_graph = search.top(evidence, "query_id", "score", "id", config.chunk_k)
        along = routes.select("query_id", "route", F.posexplode("edges").alias("place", "edge_id")).join(near.select("query_id", "edge_id", "evidence"), ["query_id", "edge_id"])
        on_paths = along.select("query_id", "route", "place", F.explode("evidence").alias("id")).groupBy("query_id", "id").agg(F.min(F.struct("route", "place")).alias("_f"))
        by_path = on_paths.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("_f", "id")).alias("rank"))
        fused = search.rrf_by_intent(open_, [found, by_graph.select("query_id", "id", "rank"), by_path], config=config, mode=mode)
        told_by = evidence.select("query_id", "id").unionByName(by_path.select("query_id", "id"))
        fused = search.boost_evidence(fused, told_by, factor=config.evidence_boost)
        known = store.entities.select(F.col("id").alias("_n"), F.col("name").alias("_name"))
        steps = routes.select("query_id", "route", F.posexplode("nodes").alias("place", "_n")).join(known, "_n", "left").withColumn("_l", F.coalesce("_name", "_n"))
        paths = steps.groupBy("query_id", F.col("route").alias("rank")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_l"))), lambda x: x["_l"]), " — ").alias("line"))
    fused = search.rerank(fused, plugins.registered("reranker"), first=config.rerank_top)
    size = F.when(F.col("intent") == "overview", config.overview_top_chunks).otherwise(config.top_chunks)
    chosen = fused.join(open_.select("query_id", "intent"), "query_id").where(F.col("rank") <= size).drop("intent")
    cited = context.citations(chosen, store.chunks, config)
    names = store.entities.select("id", "name")
    told = triplets.join(names.select(F.col("id").alias("src"), F.col("name").alias("head")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("tail")), "dst")
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "edge_id")))
    ends = told.select("query_id", F.col("src").alias("id"), "rank").unionByName(told.select("query_id", F.col("dst").alias("id"), "rank")).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    nodes = ends.join(store.entities.select("id", "name", "type", "start_year", "end_year"), "id")
    text = context.build_context(open_.select("query_id", "periods"), store.periods, nodes, told, cited, paths, config=config)
    return Answered(plans, chosen, told, cited, text)


def answer(questions: DataFrame, store: Store, config: Config = DEFAULT, mode: str = "graph") -> DataFrame:
    """(query_id, answer, context): by the registered generator or the extractive stand-in."""
    found = retrieve(questions, store, config, mode)
    rows = questions.select("query_id", "query").join(found.context, "query_id", "left")
    return (plugins.registered("generator") or plugins.extractive_generator)(rows).select("query_id", "answer", "context")


def ask_documents(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """(query_id, answer, context): questions (query_id, query) over texts of one's own, by the passages most like each.

    Passages are character windows; a question is compared with all of them by
    the registered embedder. `[Dn]` numbers a passage within its document.
    """
    cut = chunking.passages(docs, key, text, config)
    cut = cut.select(F.concat_ws("#", F.col(key).cast("string"), F.col("n").cast("string")).alias("id"), "n", "passage")
    vectors = plugins.embed_rows(cut.select("id", F.col("passage").alias("text"))).select("id", "vector")
    asked = plugins.embed_rows(questions.select("query_id", F.col("query").alias("text"))).select("query_id", "vector")
    hits = search.vector_topk(asked, vectors, config.passage_k).join(cut, "id").select("query_id", "rank", "n", "passage")
    rows = questions.select("query_id", "query").join(context.passage_context(hits), "query_id", "left")
    first = F.regexp_extract("context", r"(?s)^(\[D\d+\]) (.*?)(?:\n\n\[D\d+\] |$)", 2)
    quoted = rows.withColumn("answer", F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(F.lit(plugins.NOTHING)))
    made = plugins.registered("generator")
    return (made(rows) if made else quoted).select("query_id", "answer", "context")


def build(steps: dict[str, Callable[[], object]], skip_to: str | None = None, dry_run: bool = False, order: Sequence[str] = STAGES) -> list[str]:
    """Runs stages in order from `skip_to` on and stops at the first that fails; a dry run only lists them."""
    if skip_to is not None and skip_to not in order:
        raise ValueError(f"no stage {skip_to!r}")
    names = [s for s in order[order.index(skip_to) if skip_to else 0 :] if s in steps]
    if not dry_run:
        for name in names:
            try:
                steps[name]()
            except Exception as e:
                raise RuntimeError(f"stage {name} failed") from e
    return names
