"""Selecting articles: in-links, hints, tiers, caps, aliases, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.config import DEFAULT, Config
from annales.functions.times import spans
from annales.functions.years import valid_years
from annales.operators.periods import interval_join, main_period

#: Titles that are no articles: years, centuries, decades, lists (fixed value).
NON_ARTICLE = r"(?iu)^(?:năm\s+)?\d+(?:\s+tcn)?$|^thế kỷ\b|^thập niên\b|^danh sách\b"
PROFILES = ("mini", "core", "full")


def profile(name: str, periods: list[dict]) -> tuple[str, list[dict]]:
    """(kind, periods) of mini, core, full, era:<id> or period:<id>."""
    kind, _, value = name.partition(":")
    if name in PROFILES:
        return name, periods
    chosen = [p for p in periods if kind in ("era", "period") and p["era_id" if kind == "era" else "id"] == value]
    if not chosen:
        raise ValueError(f"no profile {name!r}: mini, core, full, era:<id> or period:<id>")
    return kind, chosen


def in_links(links: DataFrame) -> DataFrame:
    """(target, n): distinct links to each title, one per page."""
    return links.select("page_id", "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def ranked_hints(links: DataFrame, periods: DataFrame) -> DataFrame:
    """(target, period_id, n, rank): periods whose seeds link to a title, most first, then main-line ones, then by id."""
    counted = links.select("page_id", "target", "period_id").distinct().groupBy("target", "period_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.join(F.broadcast(periods.select(F.col("id").alias("period_id"), "parallel")), "period_id")
    order = Window.partitionBy("target").orderBy(F.desc("n"), "parallel", "period_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("target", "period_id", "n", "rank")


def tiers(articles: DataFrame, quotas: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, tier): A for the first `quota` of each period: seeds by rank, then dated ones, by links, by title.

    articles: key, period_id, is_seed, seed_rank, start_year, links, title.
    """
    order = Window.partitionBy("period_id").orderBy(F.desc("is_seed"), F.coalesce("seed_rank", F.lit(0)), F.col("start_year").isNull(), F.desc(F.coalesce("links", F.lit(0))), "title", key)
    rows = articles.withColumn("_r", F.row_number().over(order)).join(F.broadcast(quotas), "period_id", "left")
    return rows.select(key, F.when(F.col("_r") <= F.coalesce("quota", F.lit(0)), "A").otherwise("B").alias("tier"))


def capacity(articles: DataFrame, caps: DataFrame, key: str = "page_id") -> DataFrame:
    """Articles that fit: all seeds of a period, then others by links and title while there is room."""
    order = Window.partitionBy("period_id", "is_seed").orderBy(F.desc(F.coalesce("links", F.lit(0))), "title", key)
    seeds = articles.where("is_seed").groupBy("period_id").agg(F.count(F.lit(1)).alias("_s"))
    rows = articles.withColumn("_r", F.row_number().over(order)).join(F.broadcast(caps), "period_id").join(F.broadcast(seeds), "period_id", "left")
    room = F.greatest(F.lit(0), F.col("cap") - F.coalesce("_s", F.lit(0)))
    return rows.where(F.col("is_seed") | (F.col("_r") <= room)).select(*articles.columns)


def quotas(periods: DataFrame, kind: str, total: int | None = None) -> DataFrame:
    """(period_id, cap): quotas as they are for mini and core; else `total` shared by quota, halves to even, quotas at least."""
    if kind in ("mini", "core") or total is None:
        return periods.select(F.col("id").alias("period_id"), F.col("quota").alias("cap"))
    whole = F.greatest(F.sum("quota").over(Window.partitionBy()), F.lit(1))
    share = F.bround(F.lit(float(total)) * F.col("quota") / whole, 0).cast("int")
    return periods.select(F.col("id").alias("period_id"), F.greatest("quota", share).alias("cap"))


def useful_alias(alias: Column, title: Column) -> Column:
    """Four letters or more, no initials, no bar, at most 80 characters, and not the title itself."""
    letters = F.length(F.regexp_replace(alias, r"[^\p{L}]", ""))
    return (letters >= 4) & ~alias.rlike(r"^(?:\p{Lu}\.\s*)+$") & ~alias.contains("|") & (F.length(alias) <= 80) & (F.lower(alias) != F.lower(title))


def too_young(births: Column, classes: Column, config: Config = DEFAULT) -> Column:
    """Humans born too late to count before the cutoff."""
    return F.array_contains(classes, "Q5") & F.coalesce(F.array_min(births) > config.max_year - config.min_age_at_cutoff, F.lit(False))


def year_range(starts: Column, ends: Column, end_starts: Column) -> tuple[Column, Column]:
    """(start, end) from the first years of beginning and the last years of ending properties; one stands in for the other."""
    start = F.coalesce(F.array_min(starts), F.array_min(end_starts))
    return start, F.coalesce(F.array_max(ends), start)


def categories_below(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(page): pages of a category and its sub-categories to `depth`, by frontier; edges: category, member, is_category."""
    front = edges.sparkSession.createDataFrame([(root,)], "category string")
    seen, pages = front, None
    for _ in range(depth + 1):
        met = edges.join(front, "category")
        here = met.where("NOT is_category").select(F.col("member").alias("page"))
        pages = here if pages is None else pages.unionByName(here)
        front = met.where("is_category").select(F.col("member").alias("category")).distinct().join(seen, "category", "left_anti")
        seen = seen.unionByName(front)
    return pages.distinct()


def by_class(candidates: DataFrame, allowed: tuple[str, ...] | list[str], classes: str = "classes") -> tuple[DataFrame, DataFrame]:
    """(candidates one of whose classes is allowed, the others); null or empty classes are among the others."""
    met = F.coalesce(F.arrays_overlap(classes, F.array(*[F.lit(c) for c in allowed])), F.lit(False)) if allowed else F.lit(False)
    rows = candidates.withColumn("_ok", met)
    return rows.where("_ok").drop("_ok"), rows.where("NOT _ok").drop("_ok")


def is_article(title: Column) -> Column:
    """Whether a title may be an article: no year, century, decade or list; null is none."""
    return F.coalesce(~F.trim(title).rlike(NON_ARTICLE), F.lit(False))


def seed_links(links: DataFrame, seeds: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n): distinct targets of each page's links that name a seed; pages without any have no row. seeds: target."""
    return links.select(key, "target").distinct().join(seeds.select("target").distinct(), "target", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def on_topic(pages: DataFrame, links: DataFrame, seeds: DataFrame, least: int = 1, key: str = "page_id") -> DataFrame:
    """Pages with `seed_links`, those below `least` left out."""
    counted = seed_links(links, seeds, key).withColumnRenamed("n", "seed_links")
    return pages.join(counted, key, "left").withColumn("seed_links", F.coalesce("seed_links", F.lit(0))).where(F.col("seed_links") >= least)


def described(labels: Column, descriptions: Column, aliases: Column, title: Column, languages: tuple[str, str] = ("vi", "en")) -> list[Column]:
    """label, description and useful aliases of an entity's maps by language, the first language before the second; an absent entity has none."""
    first, second = languages
    pick = lambda c: F.coalesce(F.nullif(F.try_element_at(c, F.lit(first)), F.lit("")), F.nullif(F.try_element_at(c, F.lit(second)), F.lit("")))
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(F.try_element_at(aliases, F.lit(x)), empty) for x in languages], F.coalesce(F.array(F.try_element_at(labels, F.lit(second))), empty))
    tidy = F.transform(every, lambda a: F.trim(F.regexp_replace(a, r"\s+", " ")))
    useful = F.filter(tidy, lambda a: F.coalesce(useful_alias(a, title), F.lit(False)))
    return [pick(labels).alias("label"), pick(descriptions).alias("description"), F.array_distinct(useful).alias("aliases")]


def lead_years(rows: DataFrame, key: str, text: str = "lead") -> DataFrame:
    """(key, start_year, end_year): the years of the first bracket with years in a lead's first sentence.

    The sentence is read up to 300 characters, brackets up to 120. Rows without
    such a bracket, or whose years run backward, are left out.
    """
    sentence = F.substring(F.split_part(text, F.lit(". "), F.lit(1)), 1, 300)
    brackets = rows.where(F.col(key).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(sentence, F.lit(r"\(([^()]{1,120})\)"), F.lit(1))).alias("_p", "_b"))
    told = brackets.withColumn("_s", spans(F.col("_b"))).where(F.size("_s") > 0)
    first = told.groupBy(key).agg(F.min_by("_s", "_p").alias("_s"))
    start, end = F.array_min(F.transform("_s", lambda s: s["start"])), F.array_max(F.transform("_s", lambda s: s["end"]))
    return first.select(key, start.alias("start_year"), end.alias("end_year")).where("start_year <= end_year")


#: Columns of an article record with their defaults, null unless named.
RECORD = {
    "page_id": "long", "revision_id": "long", "title": "string", "label": "string", "qid": "string", "aliases": "array<string>", "description": "string", "period_id": "string", "period_ids": "array<string>", "tier": "string",
    "is_seed": "boolean", "in_links": "int", "seed_links": "int", "classes": "array<string>", "start_year": "int", "end_year": "int", "categories": "array<string>", "redirects": "array<string>", "wikitext": "string", "url": "string", "fetched_at": "timestamp",
}
DEFAULTS = {"is_seed": False, "in_links": 0, "seed_links": 0, "tier": "B"}


def records(rows: DataFrame) -> DataFrame:
    """Article records: every column of RECORD, absent and null ones at their default; lists are never null."""
    out = []
    for name, kind in RECORD.items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        default = F.array().cast(kind) if kind.startswith("array") else F.lit(DEFAULTS[name]) if name in DEFAULTS else None
        out.append((value if default is None else F.coalesce(value, default)).alias(name))
    return rows.select(*out)


def collected(seeds: DataFrame, candidates: DataFrame, links: DataFrame, periods: DataFrame, caps: DataFrame, classes: tuple[str, ...] | list[str], config: Config = DEFAULT, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected by class): seeds and the candidates that fit, as a chain of filters.

    seeds, candidates: page_id, title, classes, births, start_year, end_year,
    period_id (of seeds); links: page_id, target of all pages; caps: period_id,
    cap. Candidates that seeds have already, aren't articles, have no allowed
    class, are too young, lie outside all periods or after the cutoff, or link
    to no seed fall away; each is given its main period and taken by links while
    its period has room.
    """
    new = candidates.where(is_article(F.col("title"))).join(seeds.select("title"), "title", "left_anti")
    kept, rejected = by_class(new, classes)
    kept = kept.where(~too_young(F.col("births"), F.col("classes"), config))
    start, end = valid_years(F.col("start_year"), F.col("end_year"))
    kept = kept.withColumn("start_year", start).withColumn("end_year", end).where(F.col("start_year").isNull() | (F.col("start_year") <= config.max_year))
    counted = in_links(links.join(seeds.select("page_id"), "page_id", "left_semi"))
    origin = links.join(seeds.select("page_id", "period_id"), "page_id")
    hints = ranked_hints(origin, periods).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "period_id"))), lambda x: x["period_id"]).alias("hint_periods"))
    kept = kept.join(counted.withColumnRenamed("n", "in_links"), F.col("title") == F.col("target"), "left").drop("target")
    kept = kept.join(hints, F.col("title") == F.col("target"), "left").drop("target").withColumn("seed_period", F.lit(None).cast("string"))
    assigned = main_period(kept.select("page_id", "start_year", "end_year", "seed_period", "hint_periods"), periods, "page_id")
    # A candidate with years that no period shares is out, whatever its hints.
    inside = interval_join(kept.select("page_id", "start_year", "end_year"), periods).select("page_id").distinct()
    undated = kept.where("start_year IS NULL").select("page_id")
    kept = kept.join(inside.unionByName(undated), "page_id", "left_semi").join(assigned, "page_id").where("period_id IS NOT NULL")
    kept = on_topic(kept, links, seeds.select(F.col("title").alias("target")), least).withColumn("is_seed", F.lit(False))
    both = kept.withColumn("links", F.coalesce("in_links", F.lit(0)) + F.col("seed_links")).select("page_id", "title", "period_id", "is_seed", "links", "start_year", "end_year")
    first = seeds.select("page_id", "title", "period_id", F.lit(True).alias("is_seed"), F.lit(0).cast("long").alias("links"), "start_year", "end_year")
    return capacity(first.unionByName(both), caps), rejected.join(counted, rejected["title"] == counted["target"], "left").select("title", "classes", F.coalesce("n", F.lit(0)).alias("in_links"))
