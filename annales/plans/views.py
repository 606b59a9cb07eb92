"""The knowledge graph held in the tables at hand, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annales.functions.text import normalize_key
from annales.functions.years import valid_years
from annales.operators.graph import merge_edges
from annales.operators.resolve import relations
from annales.sources.tables import latest, table


def year(c: str) -> Column:
    return F.when((F.col(c) != 0) & F.col(c).between(-40000, 2100), F.col(c))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity: its record with the largest rec_id, impossible years gone."""
    rows = latest(table(spark, d, "entities"), "id", "rec_id", "ingested_at")
    start, end = valid_years(year("start_year"), year("end_year"))
    return rows.select("id", "rec_id", "qid", "name", "aliases", "type", "description", F.coalesce("period_ids", F.array().cast("array<string>")).alias("period_ids"), start.alias("start_year"), end.alias("end_year"))


def triplets(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "triplets"), "triplet_id", "extracted_at")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without their vectors, which browsing never reads."""
    return latest(table(spark, d, "chunks").drop("embedding"), "id", "loaded_at", "load_seq")


def articles(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "articles"), "page_id", "revision_id", "ingested_at")


def periods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "periods").withColumn("position", F.substring("id", 2, 2).cast("int"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """(name, entity_id): the first bearer of each name."""
    rows = entities(spark, d).where("name IS NOT NULL").withColumn("_k", normalize_key(F.col("name")))
    return rows.groupBy("_k").agg(F.min_by("id", "rec_id").alias("entity_id")).select(F.col("_k").alias("name"), "entity_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Merged relations: edge_id, src, rel, dst, start_year, end_year, confidence, role, evidence."""
    rows = relations(triplets(spark, d), names(spark, d)).where("relation IS NOT NULL")
    listed = rows.select("src", F.col("relation").alias("rel"), "dst", "start_year", "end_year", "confidence", "role", F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id")).alias("evidence"), "triplet_id")
    return merge_edges(listed, "triplet_id").withColumnRenamed("id", "edge_id")


KEY = "trim(lower(regexp_replace({0}, '\\s+', ' ', 'g')))"
SQL = {
    "ents0": """SELECT id, rec_id, qid, name, aliases, type, description, coalesce(period_ids, []) AS period_ids,
        CASE WHEN start_year <> 0 AND start_year BETWEEN -40000 AND 2100 THEN start_year END AS s,
        CASE WHEN end_year <> 0 AND end_year BETWEEN -40000 AND 2100 THEN end_year END AS e
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC, ingested_at DESC) AS r FROM entities WHERE id IS NOT NULL) WHERE r = 1""",
    "ents": """SELECT * EXCLUDE (s, e), CASE WHEN s IS NOT NULL AND (e IS NULL OR s <= e) THEN s END AS start_year,
        CASE WHEN s IS NOT NULL AND (e IS NULL OR s <= e) THEN e END AS end_year FROM ents0""",
    "trips": "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY triplet_id ORDER BY extracted_at DESC) AS r FROM triplets WHERE triplet_id IS NOT NULL) WHERE r = 1",
    "chks": "SELECT * EXCLUDE (r, embedding) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, load_seq DESC) AS r FROM chunks WHERE id IS NOT NULL) WHERE r = 1",
    "arts": "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY revision_id DESC, ingested_at DESC) AS r FROM articles WHERE page_id IS NOT NULL) WHERE r = 1",
    "pers": "SELECT *, CAST(substr(id, 2, 2) AS INTEGER) AS position FROM periods",
    "nms": f"SELECT {KEY.format('name')} AS name, arg_min(id, rec_id) AS entity_id FROM ents WHERE name IS NOT NULL GROUP BY 1",
    "rels": f"""SELECT t.*, h.entity_id AS src, x.entity_id AS dst FROM trips t JOIN nms h ON h.name = {KEY.format('t.head')} JOIN nms x ON x.name = {KEY.format('t.tail')} WHERE t.relation IS NOT NULL""",
    "edgs": """SELECT 'rel:' || src || ':' || relation || ':' || dst AS edge_id, src, relation AS rel, dst, last.start_year AS start_year, last.end_year AS end_year, last.confidence AS confidence, last.role AS role, evidence FROM (
        SELECT src, relation, dst, arg_max(struct_pack(start_year := start_year, end_year := end_year, confidence := confidence, role := role), triplet_id) AS last,
        coalesce(list_sort(list_distinct(list(chunk_id) FILTER (WHERE chunk_id IS NOT NULL))), []) AS evidence FROM rels GROUP BY 1, 2, 3)""",
    "ends": "SELECT DISTINCT * FROM (SELECT src AS id, dst AS other, edge_id FROM edgs UNION ALL SELECT dst, src, edge_id FROM edgs)",
    "degs": "SELECT id, count(DISTINCT edge_id) AS degree FROM ends GROUP BY 1",
    "inper": """SELECT DISTINCT e.id, p.id AS period_id FROM ents e JOIN periods p ON e.start_year <= coalesce(p.end_year, p.start_year) AND coalesce(e.end_year, e.start_year) >= p.start_year
        UNION SELECT id, p FROM (SELECT id, unnest(period_ids) AS p FROM ents WHERE start_year IS NULL) WHERE p IN (SELECT id FROM periods)""",
}
NEEDS = {"ents": ["ents0"], "nms": ["ents"], "rels": ["trips", "nms"], "edgs": ["rels"], "ends": ["edgs"], "degs": ["ends"], "inper": ["ents"]}


def with_views(query: str, *names: str, extra: str = "") -> str:
    """A query with the named views, and those they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)} {query}" if parts else query
