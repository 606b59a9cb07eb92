"""Browsing: lists, details, neighbours, passages, focus panels; null parameters ask nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.operators.graph import ends


def entities(nodes: DataFrame, degree: DataFrame, in_period: DataFrame, q: str | None = None, kind: str | None = None, period: str | None = None, limit: int = 60, skip: int = 0) -> DataFrame:
    """Entities by name part, type and period, the best connected first; one page of them."""
    rows = nodes
    if q is not None:
        rows = rows.where(F.lower("name").contains(q.lower()))
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    if period is not None:
        rows = rows.join(in_period.where(F.col("period_id") == period).select("id"), "id", "left_semi")
    rows = rows.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.orderBy(F.desc("degree"), "name", "id").offset(skip).limit(limit)


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame, limit: int = 30, key: str = "edge_id") -> DataFrame:
    """(id, neighbours): the first names one edge away, either direction, distinct; ids without edges have none."""
    near = ids.select("id").distinct().join(ends(edges, key), "id").where("other <> id").join(nodes.select(F.col("id").alias("other"), "name"), "other").select("id", "other", "name").distinct()
    order = Window.partitionBy("id").orderBy("name", "other")
    few = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    listed = few.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("neighbours"))
    return ids.select("id").distinct().join(listed, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def by_relation(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rel, names): distinct names at the other end by relation, in order."""
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    rows = edges.select("rel", F.explode(both).alias("_e")).select("rel", "_e.id", "_e.other").join(ids.select("id").distinct(), "id", "left_semi")
    return rows.join(nodes.select(F.col("id").alias("other"), "name"), "other").groupBy("id", "rel").agg(F.array_sort(F.collect_set("name")).alias("names"))


def passages(about: DataFrame, chunks: DataFrame, ids: DataFrame, limit: int = 6) -> DataFrame:
    """(entity_id, id, rank): the first chunks of articles about the entities."""
    rows = about.join(ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").join(chunks.select("page_id", "id", "chunk_index"), "page_id")
    order = Window.partitionBy("entity_id").orderBy("chunk_index", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("entity_id", "id", "rank")


def period_items(nodes: DataFrame, in_period: DataFrame, limit: int = 60) -> DataFrame:
    """(period_id, id, name, start_year, rank): each period's entities by year, undated last, then name."""
    rows = in_period.join(nodes.select("id", "name", "start_year"), "id")
    order = Window.partitionBy("period_id").orderBy(F.col("start_year").asc_nulls_last(), "name", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("period_id", "id", "name", "start_year", "rank")


def event_focus(events: DataFrame, edges: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(query_id, event_id, leaders, places): the best event of each question, dated ones first, then by degree.

    events: query_id, id. Leaders are persons who take part, places where it happened.
    """
    rows = events.join(nodes.where("type = 'Event'").select("id", "start_year"), "id").join(degree, "id", "left")
    best = rows.groupBy("query_id").agg(F.max_by("id", F.struct(F.col("start_year").isNotNull(), F.coalesce("degree", F.lit(0)), F.col("id"))).alias("event_id"))
    people = edges.where("rel = 'PARTICIPATED_IN'").select(F.col("dst").alias("event_id"), F.col("src").alias("id")).join(nodes.where("type = 'Person'").select("id", "name"), "id")
    spots = edges.where("rel = 'OCCURRED_AT'").select(F.col("src").alias("event_id"), F.col("dst").alias("id")).join(nodes.select("id", "name"), "id")
    leaders = best.join(people, "event_id").groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("leaders"))
    places = best.join(spots, "event_id").groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("places"))
    empty = F.array().cast("array<string>")
    return best.join(leaders, "query_id", "left").join(places, "query_id", "left").select("query_id", "event_id", F.coalesce("leaders", empty).alias("leaders"), F.coalesce("places", empty).alias("places"))


def key_facts(nodes: DataFrame) -> DataFrame:
    """(query_id, type, names): distinct labels of each question's entities by type."""
    return nodes.groupBy("query_id", "type").agg(F.array_sort(F.collect_set("name")).alias("names"))


def evidence_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(edge_id, chunk_id, page_title): chunks that an edge rests on."""
    rows = edges.select("edge_id", F.explode("evidence").alias("chunk_id")).distinct()
    return rows.join(chunks.select(F.col("id").alias("chunk_id"), "page_title"), "chunk_id").select("edge_id", "chunk_id", "page_title")


def event_timeline(nodes: DataFrame, edges: DataFrame, in_period: DataFrame, period: str) -> DataFrame:
    """(id, name, start_year, commanders): events of a period in order of year with those who commanded them."""
    events = nodes.where("type = 'Event'").join(in_period.where(F.col("period_id") == period), "id", "left_semi")
    led = edges.where("rel = 'COMMANDED'").select(F.col("dst").alias("id"), F.col("src").alias("_c")).join(nodes.select(F.col("id").alias("_c"), F.col("name").alias("_n")), "_c")
    listed = led.groupBy("id").agg(F.array_sort(F.collect_set("_n")).alias("commanders"))
    rows = events.join(listed, "id", "left").select("id", "name", "start_year", F.coalesce("commanders", F.array().cast("array<string>")).alias("commanders"))
    return rows.orderBy(F.col("start_year").asc_nulls_last(), "name", "id")


def with_coordinates(entities: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Places with a Wikidata number get lat and lon where one of its labels is their name, case and spacing aside."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = coordinates.select(F.concat(F.lit("qid:"), "qid").alias("id"), F.explode("labels").alias("_l"), "lat", "lon").select("id", key(F.col("_l")).alias("_l"), "lat", "lon").dropDuplicates(["id", "_l"])
    rows = entities.withColumn("_l", F.when(F.col("type") == "Place", key(F.col("name"))))
    return rows.join(known, ["id", "_l"], "left").drop("_l")
