"""Periods: interval joins, gaps, chains, aliases and the assignment of a main period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.functions.years import overlap_length, overlaps

#: Periods that may be broadcast; a larger dimension is joined by stretches of years.
BROADCAST_ROWS = 10_000


def interval_join(rows: DataFrame, dim: DataFrame, start: str = "start_year", end: str = "end_year", dim_rows: int | None = None, width: int = 50) -> DataFrame:
    """Rows joined with every `dim` interval they overlap; columns of both, dim's prefixed with p_.

    A dimension of up to BROADCAST_ROWS rows (counted unless given) is broadcast;
    beyond that both sides are cut into stretches of `width` years and joined on
    these, each pair counting in the first stretch both share. Rows without a
    start overlap nothing.
    """
    named = dim.select(*[F.col(c).alias(f"p_{c}") for c in dim.columns])
    condition = overlaps(F.col(start), F.col(end), F.col("p_start_year"), F.col("p_end_year"))
    count = dim.count() if dim_rows is None else dim_rows
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named), condition)

    def cells(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / width), F.floor(F.coalesce(b, a) / width)))

    left = rows.where(F.col(start).isNotNull() & (F.coalesce(end, start) >= F.col(start))).withColumn("_cell", cells(F.col(start), F.col(end)))
    right = named.withColumn("_cell", cells(F.col("p_start_year"), F.col("p_end_year")))
    first = F.greatest(F.floor(F.col(start) / width), F.floor(F.col("p_start_year") / width))
    return left.join(right, "_cell").where(condition & (F.col("_cell") == first)).drop("_cell")


def in_period(entities: DataFrame, periods: DataFrame, key: str = "id") -> DataFrame:
    """(key, period_id): by overlapping years; by the listed periods only where there is no start year."""
    by_years = interval_join(entities.select(key, "start_year", "end_year"), periods.select("id", "start_year", "end_year")).select(key, F.col("p_id").alias("period_id"))
    listed = entities.where(F.col("start_year").isNull()).select(key, F.explode("period_ids").alias("period_id"))
    listed = listed.join(F.broadcast(periods.select(F.col("id").alias("period_id"))), "period_id", "left_semi").select(key, "period_id")
    return by_years.unionByName(listed).distinct()


def listed_periods(rows: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """(key, period_id) by period_ids, or period_id where there are none."""
    ids = F.coalesce("period_ids", F.array("period_id"))
    listed = rows.select(key, F.explode(ids).alias("period_id"))
    return listed.join(F.broadcast(periods.select(F.col("id").alias("period_id"))), "period_id", "left_semi").select(key, "period_id").distinct()


def gaps(periods: DataFrame) -> DataFrame:
    """(gap_start, gap_end): years between merged periods that none covers."""
    order = Window.orderBy("start_year", "end_year")
    reach = F.max("end_year").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return periods.select("start_year", reach.alias("_reach")).where(F.col("start_year") > F.col("_reach") + 1).select((F.col("_reach") + 1).alias("gap_start"), (F.col("start_year") - 1).alias("gap_end"))


def chain(periods: DataFrame, keep_parallel: bool = False) -> DataFrame:
    """(id, next_id): neighbours in order of position, parallel ones left out unless kept."""
    main = periods if keep_parallel else periods.where(~F.col("parallel"))
    order = Window.orderBy("position")
    return main.select("id", F.lead("id").over(order).alias("next_id"))


def main_period(articles: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """(key, period_id): the seed's period; else the overlapping one, hinted and main-line ones first, that
    shares most years, the narrower of equals, then the earlier; else the first hint.

    articles: key, start_year, end_year, seed_period, hint_periods.
    """
    met = interval_join(articles.select(key, "start_year", "end_year", "hint_periods"), periods)
    hinted = F.coalesce(F.array_contains("hint_periods", F.col("p_id")), F.lit(False))
    shared = overlap_length(F.col("start_year"), F.col("end_year"), F.col("p_start_year"), F.col("p_end_year"))
    rank = Window.partitionBy(key).orderBy((hinted & ~F.col("p_parallel")).desc(), hinted.desc(), F.col("p_parallel"), shared.desc(), (F.col("p_end_year") - F.col("p_start_year")), F.col("p_position"))
    best = met.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(key, F.col("p_id").alias("_best"))
    hint = F.when(F.size("hint_periods") > 0, F.element_at("hint_periods", 1))
    return articles.join(best, key, "left").select(key, F.coalesce("seed_period", "_best", hint).alias("period_id"))


def by_alias(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, id): the longest alias a text contains, no word boundary asked; of equals the first listed.

    names: kind, id, alias, position; a small dimension of fixed size.
    """
    met = texts.select(key, F.lower(text).alias("_t")).join(F.broadcast(names), F.col("_t").contains(F.lower("alias")))
    best = met.groupBy(key).agg(F.max_by(F.struct("kind", "id"), F.struct(F.length("alias"), -F.col("position"))).alias("_b"))
    return best.select(key, "_b.kind", "_b.id")
