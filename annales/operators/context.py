"""Context of an answer: sources within a token budget, citations, lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.config import DEFAULT, Config
from annales.functions.text import article_url, entity_label, estimate_tokens, year_label

EVERYTHING = "Toàn bộ phạm vi dữ liệu (tiền sử – hết 1945)"


def within_budget(ranked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Sources (query_id, rank, tokens, ...) from the first until the budget would be passed; the first always, at most max_sources.

    Running totals only grow, so the rows within the budget are a prefix. `n` numbers them.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.max_sources)
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used_tokens", total).where((F.col("used_tokens") <= config.context_max_tokens) | (F.col("n") == 1))


def citations(ranked: DataFrame, chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, n, id, title, section, url, quote, used_tokens) of ranked chunks (query_id, id, rank)."""
    rows = ranked.join(chunks.select("id", "page_title", "section_path", "text"), "id").withColumn("tokens", estimate_tokens(F.col("text")))
    kept = within_budget(rows, config)
    return kept.select("query_id", "n", "id", F.coalesce("page_title", F.lit("")).alias("title"), F.coalesce("section_path", F.lit("")).alias("section"), article_url(F.coalesce("page_title", F.lit(""))).alias("url"), F.coalesce("text", F.lit("")).alias("quote"), "used_tokens")


def relation_lines(triplets: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, edge_id, line): `head —REL(role, year)→ tail [1][2]`; cited: query_id, n, id."""
    evidence = triplets.select("query_id", "edge_id", F.explode("evidence").alias("id")).join(cited.select("query_id", "id", "n"), ["query_id", "id"])
    numbers = evidence.groupBy("query_id", "edge_id").agg(F.array_sort(F.collect_set("n")).alias("_n"))
    rows = triplets.join(numbers, ["query_id", "edge_id"], "left")
    detail = F.concat_ws(", ", F.nullif(F.col("role"), F.lit("")), F.when(F.coalesce(F.col("start_year"), F.lit(0)) != 0, year_label(F.col("start_year"))))
    cites = F.coalesce(F.concat(F.lit(" "), F.concat_ws("", F.transform("_n", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))))), F.lit(""))
    line = F.concat("head", F.lit(" —"), "rel", F.when(detail == "", "").otherwise(F.concat(F.lit("("), detail, F.lit(")"))), F.lit("→ "), "tail", cites)
    return rows.select("query_id", "edge_id", line.alias("line"))


def timeline(nodes: DataFrame) -> DataFrame:
    """(query_id, start_year, name): distinct dated names, in order of year, then name."""
    return nodes.where("start_year IS NOT NULL").select("query_id", "start_year", "name").distinct().orderBy("query_id", "start_year", "name")


def scope_lines(plans: DataFrame, periods: DataFrame) -> DataFrame:
    """(query_id, line) of plans (query_id, periods array): the known periods in order, a default text for none."""
    listed = plans.select("query_id", F.posexplode(F.array_distinct("periods")).alias("_p", "id")).join(F.broadcast(periods), "id")
    name = F.concat("name", F.lit(" ("), year_label(F.col("start_year")), F.lit("–"), year_label(F.col("end_year")), F.lit(")"))
    lines = listed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", name.alias("_l")))), lambda x: x["_l"]), "; ").alias("_l"))
    return plans.select("query_id").join(lines, "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit("Giai đoạn: "), "_l"), F.lit(EVERYTHING)).alias("line"))


def _section(title: str, rows: DataFrame, order: list[str], line: Column, limit: int | None = None) -> DataFrame:
    """(query_id, text): lines of each question under a heading. Lists are bounded by the context's limits."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    ranked = ranked if limit is None else ranked.where(F.col("_r") <= limit)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("_l")))), lambda x: x["_l"]), "\n")
    return ranked.groupBy("query_id").agg(F.concat(F.lit(f"### {title}\n"), body).alias("text"))


def build_context(plans: DataFrame, periods: DataFrame, nodes: DataFrame, triplets: DataFrame, cited: DataFrame, paths: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """(query_id, context): scope, entities, relations, paths, timeline and sources of each question.

    nodes: query_id, rank, name, type, start_year, end_year; triplets: query_id,
    rank, edge_id, head, rel, tail, role, start_year, evidence; paths: query_id,
    rank, line. Sections without lines are left out.
    """
    top_nodes = nodes.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_k") <= config.max_entities)
    scope = scope_lines(plans, periods).select("query_id", F.concat(F.lit("### PHẠM VI\n"), "line").alias("text"))
    lines = relation_lines(triplets, cited).join(triplets.select("query_id", "edge_id", "rank"), ["query_id", "edge_id"])
    dash = lambda c: F.concat(F.lit("- "), c)
    source = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.col("title"), F.lit(" › "), F.col("section"), F.lit(') "'), F.col("quote"), F.lit('"'))
    parts = [
        scope,
        _section("THỰC THỂ", top_nodes, ["rank"], dash(entity_label(F.col("name"), F.col("type"), F.col("start_year"), F.col("end_year")))),
        _section("QUAN HỆ", lines, ["rank"], dash(F.col("line")), config.max_relations),
        _section("ĐƯỜNG LIÊN KẾT", paths, ["rank"], dash(F.col("line"))) if paths is not None else None,
        _section("DÒNG THỜI GIAN", top_nodes.where("start_year IS NOT NULL").select("query_id", "start_year", "name").distinct(), ["start_year", "name"], dash(F.concat(year_label(F.col("start_year")), F.lit(": "), "name"))),
        _section("NGUỒN", cited, ["n"], source),
    ]
    out = plans.select("query_id")
    names = []
    for i, part in enumerate(parts):
        if part is not None:
            names.append(f"_s{i}")
            out = out.join(part.withColumnRenamed("text", f"_s{i}"), "query_id", "left")
    return out.select("query_id", F.concat_ws("\n\n", *names).alias("context"))


def passage_context(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits (query_id, rank, n, passage): `[Dn] text` in order of rank; hits are a top-k."""
    line = F.concat(F.lit("[D"), F.col("n").cast("string"), F.lit("] "), F.col("passage"))
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("_l"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["_l"]), "\n\n").alias("context"))


def recent_turns(history: DataFrame, n: int = 6, roles: tuple[str, ...] | None = None) -> DataFrame:
    """The last n turns (conv_id, turn, role, text), in order; roles are filtered before they are counted."""
    rows = history if roles is None else history.where(F.col("role").isin(*roles))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r").orderBy("conv_id", "turn")


def recent_questions(history: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, text, rank): the last n different questions of users, latest first."""
    last = history.where("role = 'user'").groupBy("conv_id", "text").agg(F.max("turn").alias("_t"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("_t"))
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("conv_id", "text", "rank")


def search_chats(chats: DataFrame, wanted: str) -> DataFrame:
    """Chats (title, messages array) whose title or any message contains the words, case aside."""
    low = wanted.lower()
    return chats.where(F.lower("title").contains(low) | F.exists("messages", lambda m: F.lower(m).contains(low)))
