"""The property graph as tables: endpoints, merging, degrees, display names, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_endpoints(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "id") -> DataFrame:
    """Edges both of whose ends are nodes; dangling ones vanish."""
    ids = nodes.select(F.col(key).alias("_n")).distinct()
    return edges.join(ids, edges[src] == ids["_n"], "left_semi").join(ids, F.col(dst) == F.col("_n"), "left_semi")


def split_by(rows: DataFrame, allowed: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose `column` is allowed, the others); nulls are among the others."""
    return rows.join(allowed, column, "left_semi"), rows.join(allowed, column, "left_anti")


def merge_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (src, rel, dst): the properties of the last by `order`, the union of all evidence in order of id.

    Null evidence counts as none. Repeated deliveries change nothing.
    """
    props = [c for c in edges.columns if c not in ("src", "rel", "dst", "evidence", order)]
    last = F.max_by(F.struct(*props), F.col(order)) if props else F.first(F.lit(None))
    merged = edges.groupBy("src", "rel", "dst").agg(last.alias("_p"))
    # Repeats of an edge that a third of all rows tells fall together before they are shuffled.
    told = edges.select("src", "rel", "dst", F.explode("evidence").alias("_e")).where("_e IS NOT NULL").distinct()
    told = told.groupBy("src", "rel", "dst").agg(F.array_sort(F.collect_list("_e")).alias("evidence"))
    merged = merged.join(told, [merged[c].eqNullSafe(told[c]) for c in ("src", "rel", "dst")], "left").select(*[merged[c] for c in ("src", "rel", "dst")], "_p", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    return merged.select(F.concat(F.lit("rel:"), "src", F.lit(":"), "rel", F.lit(":"), "dst").alias("id"), "src", "rel", "dst", *[F.col("_p")[c].alias(c) for c in props], "evidence")


def ends(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """(id, other, edge) seen from both ends; a self-loop comes once."""
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    return edges.select(F.col(key).alias("edge"), F.explode(F.array_distinct(both)).alias("_e")).select("_e.id", "_e.other", "edge")


def degrees(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """(id, degree): incident edges of any kind, each once."""
    return ends(edges, key).groupBy("id").agg(F.count_distinct("edge").alias("degree"))


def degree_bound(degree: DataFrame, setting: str | int | None = "p99") -> int | None:
    """The largest degree that may be passed through: a number, the 99th percentile met exactly, or none."""
    if setting is None or isinstance(setting, int):
        return setting
    row = degree.agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY degree)").alias("p")).first()
    return None if row is None or row["p"] is None else int(row["p"])


def display_names(nodes: DataFrame) -> DataFrame:
    """(id, name, display_name): the start year is added where other nodes bear the name too and it is known.

    Counted by a join with the names, not in one window a name, so that a name
    that a third of all nodes bears gathers nowhere.
    """
    shared = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND name IS NOT NULL").select("name", F.lit(True).alias("_s"))
    dated = F.concat("name", F.lit(" ("), F.col("start_year").cast("string"), F.lit(")"))
    return nodes.join(shared, "name", "left").select("id", "name", F.when(F.col("_s") & F.col("start_year").isNotNull(), dated).otherwise(F.col("name")).alias("display_name"))


def has_chunk(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page_id, chunk_id) of chunks whose article exists."""
    return chunks.select("page_id", F.col("id").alias("chunk_id")).where("page_id IS NOT NULL").join(articles.select("page_id").distinct(), "page_id", "left_semi").distinct()


def mentions(pairs: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_id) whose chunk and entity exist; by id, never by name."""
    kept = pairs.select("chunk_id", "entity_id").distinct().join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    return kept.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("chunk_id", "entity_id")


def about(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """(page_id, entity_id) of articles whose Wikidata number is an entity's id."""
    keyed = articles.where("qid IS NOT NULL").select("page_id", F.concat(F.lit("qid:"), "qid").alias("entity_id")).distinct()
    return keyed.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("page_id", "entity_id")


def label_counts(**tables: DataFrame) -> DataFrame:
    """(label, n) of node tables, most first."""
    parts = [df.select(F.lit(label).alias("label")) for label, df in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def period_shares(links: DataFrame, periods: DataFrame, warn_below: float = 0.03) -> DataFrame:
    """(period_id, n, share, warn): entities per period, counted in each of theirs; shares of the summed counts."""
    counted = links.groupBy("period_id").agg(F.count_distinct("id").alias("n"))
    rows = periods.select(F.col("id").alias("period_id")).join(counted, "period_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Periods are a dimension of fixed size; the whole of it is one window.
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    return rows.withColumn("share", F.round(F.col("n") / total, 6)).withColumn("warn", F.col("n") / total < warn_below)


def part_of(periods: DataFrame, eras: DataFrame) -> DataFrame:
    """(period_id, era_id) of periods whose era exists; eras are a dimension of fixed size."""
    known = F.broadcast(eras.select(F.col("id").alias("era_id")).distinct())
    return periods.select(F.col("id").alias("period_id"), "era_id").join(known, "era_id", "left_semi").select("period_id", "era_id").distinct()


def scalar_properties(rows: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Columns that a node may bear: plain values and lists of them; maps, records and excluded ones vanish."""

    def plain(kind: str) -> bool:
        return not kind.startswith(("struct", "map", "binary", "variant")) and (not kind.startswith("array<") or plain(kind[6:-1]))

    return rows.select(*[c for c, kind in rows.dtypes if c not in excluded and plain(kind)])


def united(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """Rows of both, those of the first in place of the second's with their key; repeats inside one count once."""
    rows = first.withColumn("_n", F.lit(0)).unionByName(second.withColumn("_n", F.lit(1)))
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "_n").alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest if c != "_n"])


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table, n): rows of each table of a build."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no table")
    return out
