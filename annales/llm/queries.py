"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annales.llm.leakage import leaked_items
from annales.llm.markup import clean_texts, marked_blocks
from annales.llm.mixing import mix_shares, mix_sources, source_sizes
from annales.llm.names import name_links, same_names
from annales.llm.neighbours import similar_vectors
from annales.llm.spam import spam_scores
from annales.llm.splitting import split_oversized
from annales.llm.survivor import FILLER_OPENINGS, FILLERS, field_values, survivors
from annales.llm.tokens import token_count
from annales.llm.visual import canonical
from annales.sources.tables import latest, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_blocks(table(spark, sf_dir, "articles"), structure_only=True).select("revision_id", "kind", "body").distinct()


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = latest(table(spark, sf_dir, "articles").select("revision_id", "ingested_at", "wikitext"), "revision_id", "ingested_at")
    return marked_blocks(once)


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = latest(table(spark, sf_dir, "articles").select("revision_id", "ingested_at", "wikitext"), "revision_id", "ingested_at")
    return clean_texts(once)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "chunks"), k=5, least=0.85)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest, among all chunks, of every chunk delivered under a load_seq divisible by 20."""
    chunks = table(spark, sf_dir, "chunks")
    queries = chunks.where("load_seq % 20 = 0").select("id")
    return similar_vectors(chunks, k=5, queries=queries).select("id", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_names(table(spark, sf_dir, "entities"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_links(table(spark, sf_dir, "entities")).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("score", 4).alias("score"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf_dir, "chunks"), only_oversized=True)
    return pieces.where((F.col("piece_index") == 0) & (F.col("n_pieces") > 1)).select("id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_values(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(_fields(spark, sf_dir)).select("id", "field_name", "rec_id")


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(_fields(spark, sf_dir), "additive")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "entities").select(F.struct(F.lit("entities").alias("tbl"), F.col("rec_id").alias("row_id")).alias("at"), F.col("name").alias("value"))
    evidence = table(spark, sf_dir, "triplets").select(F.struct(F.lit("triplets").alias("tbl"), F.col("triplet_id").alias("row_id")).alias("at"), F.col("evidence").alias("value"))
    return canonical(names.unionByName(evidence), "at", "value").select("at.tbl", "at.row_id", "value", "canonical", "changed")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_forms(spark, sf_dir).where("changed AND row_id IS NOT NULL").select("tbl", "row_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "n_equal")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_sizes(table(spark, sf_dir, "documents"), token_count(F.col("text")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")).where(~F.col("reachable")).select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mix_shares(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return shares.select("source", "target_share", "max_repeats", "size_tokens", "capacity_tokens", "given_tokens", "used_docs", "blocks", "copies", F.round("actual_share", 6).alias("actual_share"), "reachable")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spam_scores(table(spark, sf_dir, "documents"))
    return scores.select(F.col("doc").alias("doc_id"), "n_words", F.round("abnormal_share", 6).alias("abnormal_share"), F.round("mean_cost", 6).alias("mean_cost"), "spam")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_scores(table(spark, sf_dir, "documents")).where("spam").select(F.col("doc").alias("doc_id")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_blocks": p1_blocks, "p1_texts": p1_texts, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_consensus": p5_consensus, "p6_found": p6_found, "p6_forms": p6_forms, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_shares": p8_shares, "p8_mixture": p8_mixture, "p9_found": p9_found, "p9_scores": p9_scores}


P4_FOUND = "SELECT DISTINCT id FROM chunks WHERE length(text) > 2400"
P8_FOUND = """
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN s USING (source)
WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM s)
"""


def _fillers() -> str:
    return ", ".join("'" + f.replace("'", "''") + "'" for f in FILLERS)


P5_FOUND = f"""
WITH once AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at DESC) AS r FROM entities WHERE rec_id IS NOT NULL) WHERE r = 1 AND id IS NOT NULL),
kept AS (SELECT o.*, coalesce(t.trust, -2147483648) AS trust, coalesce(start_year > end_year, false) AS swapped FROM once o LEFT JOIN entity_sources t USING (source) WHERE id IN (SELECT id FROM once GROUP BY id HAVING count(*) > 1)),
bare AS (SELECT rec_id, trim(regexp_replace(trim(lower(regexp_replace(description, '[\\s\\x{{A0}}]+', ' ', 'g'))), '^[\\s\\[\\](){{}}<>*_"''“”.,:;…!?—–-]+|[\\s\\[\\](){{}}<>*_"''“”.,:;…!?—–-]+$', '', 'g')) AS b FROM kept WHERE description IS NOT NULL),
said AS (SELECT rec_id FROM bare WHERE length(regexp_replace(b, '[^\\p{{L}}]', '', 'g')) >= 2 AND length(list_aggregate(list_distinct(string_split(regexp_replace(b, '[^\\p{{L}}]', '', 'g'), '')), 'string_agg', '')) > 1
  AND b NOT IN ({_fillers()}) AND NOT regexp_matches(b, '{FILLER_OPENINGS}')),
vals AS (SELECT id, 'description' AS field_name, rec_id, trust, updated_at FROM kept WHERE rec_id IN (SELECT rec_id FROM said)
  UNION ALL SELECT id, 'start_year', rec_id, trust, updated_at FROM kept WHERE NOT swapped AND start_year <> 0 AND start_year BETWEEN -40000 AND 2100
  UNION ALL SELECT id, 'end_year', rec_id, trust, updated_at FROM kept WHERE NOT swapped AND end_year <> 0 AND end_year BETWEEN -40000 AND 2100)
SELECT id, field_name, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY id, field_name ORDER BY trust DESC, updated_at DESC NULLS LAST, rec_id DESC) AS r FROM vals) WHERE r = 1
""".replace("\\\\", "\\")


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p5_found": P5_FOUND, "p8_found": P8_FOUND}
