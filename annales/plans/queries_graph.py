"""Queries over periods, the graph, selection, extraction, resolution and browsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.functions.text import qid
from annales.functions.years import edge_in_years, in_periods, in_years, valid_years
from annales.operators import browse, collect, extract, graph, periods, resolve, traverse
from annales.operators.chunking import chunk_articles
from annales.plans import views
from annales.plans.views import KEY, with_views
from annales.sources.files import memo_key, merged
from annales.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# Periods


@query(with_views("SELECT e.id, p.id AS period_id FROM ents e JOIN periods p ON e.start_year <= coalesce(p.end_year, p.start_year) AND coalesce(e.end_year, e.start_year) >= p.start_year", "ents"))
def overlap_join(spark, d):
    rows = views.entities(spark, d).select("id", "start_year", "end_year")
    return periods.interval_join(rows, table(spark, d, "periods").select("id", "start_year", "end_year")).select("id", F.col("p_id").alias("period_id"))


@query(with_views("SELECT count(*) AS pairs, sum(greatest(0, least(coalesce(e.end_year, e.start_year), w.end_year) - greatest(e.start_year, w.start_year) + 1)) AS years FROM ents e JOIN wars w ON e.start_year <= w.end_year AND coalesce(e.end_year, e.start_year) >= w.start_year WHERE e.end_year IS NULL OR e.start_year <= e.end_year", "ents", extra="wars AS (SELECT id, start_year, coalesce(end_year, start_year) AS end_year FROM ents WHERE type = 'Polity' AND start_year IS NOT NULL)"))
def range_join(spark, d):
    """Both sides large: joined on stretches of years, no nested loop."""
    rows = views.entities(spark, d)
    wars = rows.where("type = 'Polity' AND start_year IS NOT NULL").select("id", "start_year", F.coalesce("end_year", "start_year").alias("end_year"))
    met = periods.interval_join(rows.select("id", "start_year", "end_year"), wars, dim_rows=periods.BROADCAST_ROWS + 1)
    years = F.greatest(F.lit(0), F.least(F.coalesce("end_year", "start_year"), F.col("p_end_year")) - F.greatest("start_year", "p_start_year") + 1)
    return met.agg(F.count(F.lit(1)).alias("pairs"), F.sum(years).alias("years"))


@query(with_views("SELECT id, period_id FROM inper", "inper"))
def in_period_fallback(spark, d):
    return periods.in_period(views.entities(spark, d), table(spark, d, "periods"))


@query(with_views("SELECT DISTINCT id, p AS period_id FROM (SELECT id, unnest(coalesce(period_ids, [period_id])) AS p FROM chks) WHERE p IN (SELECT id FROM periods)", "chks"))
def chunk_periods(spark, d):
    return periods.listed_periods(views.chunks(spark, d), table(spark, d, "periods"), "id")


@query(with_views("SELECT p.id AS period_id, count(DISTINCT i.id) AS n, round(count(DISTINCT i.id) / greatest(sum(count(DISTINCT i.id)) OVER (), 1), 6) AS share, count(DISTINCT i.id) / greatest(sum(count(DISTINCT i.id)) OVER (), 1) < 0.03 AS warn FROM periods p LEFT JOIN inper i ON i.period_id = p.id GROUP BY p.id", "inper"))
def period_entity_counts(spark, d):
    return graph.period_shares(in_period_fallback(spark, d), table(spark, d, "periods"))


@query(with_views("SELECT reach + 1 AS gap_start, start_year - 1 AS gap_end FROM (SELECT start_year, max(end_year) OVER (ORDER BY start_year, end_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM works) WHERE start_year > reach + 1", "ents", extra="works AS (SELECT DISTINCT start_year, coalesce(end_year, start_year) AS end_year FROM ents WHERE type = 'Culture' AND start_year IS NOT NULL)"))
def period_gaps(spark, d):
    rows = views.entities(spark, d).where("type = 'Culture' AND start_year IS NOT NULL")
    return periods.gaps(rows.select("start_year", F.coalesce("end_year", "start_year").alias("end_year")).distinct())


@query(with_views("SELECT id, lead(id) OVER (ORDER BY position) AS next_id FROM pers WHERE NOT parallel", "pers"))
def next_chain(spark, d):
    return periods.chain(views.periods(spark, d))


@query(with_views("SELECT id, lag(id) OVER (ORDER BY position) AS prev_id, lead(id) OVER (ORDER BY position) AS next_id FROM pers WHERE NOT parallel", "pers"))
def prev_next(spark, d):
    chain = periods.chain(views.periods(spark, d))
    before = chain.select(F.col("next_id").alias("id"), F.col("id").alias("prev_id"))
    return chain.join(before, "id", "left").select("id", "prev_id", "next_id")


@query(with_views("""SELECT id, arg_min(period_id, k) AS period_id FROM (SELECT e.id, p.id AS period_id, (p.parallel, -greatest(0, least(coalesce(e.end_year, e.start_year), p.end_year) - greatest(e.start_year, p.start_year) + 1), p.end_year - p.start_year, p.position) AS k
    FROM ents e JOIN pers p ON e.start_year <= p.end_year AND coalesce(e.end_year, e.start_year) >= p.start_year) GROUP BY id""", "ents", "pers"))
def best_period(spark, d):
    rows = views.entities(spark, d).select("id", "start_year", "end_year").withColumn("seed_period", F.lit(None).cast("string")).withColumn("hint_periods", F.array().cast("array<string>"))
    return periods.main_period(rows, views.periods(spark, d), "id").where("period_id IS NOT NULL")


@query("SELECT item_id, CAST(arg_max(id, (length(name), id)) AS VARCHAR) AS id FROM eval_items JOIN periods ON contains(lower(question || ' ' || passage), lower(name)) GROUP BY item_id")
def alias_search(spark, d):
    names = views.periods(spark, d).select(F.lit("period").alias("kind"), "id", F.col("name").alias("alias"), (-F.col("position")).alias("position"))
    rows = table(spark, d, "eval_items").select("item_id", F.concat("question", F.lit(" "), "passage").alias("text"))
    return periods.by_alias(rows, names, "item_id", "text").select("item_id", "id")


# Graph


@query(with_views("SELECT edge_id, src, rel, dst, start_year, end_year, round(confidence, 6) AS confidence, array_to_string(evidence, ',') AS evidence FROM edgs", "edgs"))
def edge_merge_evidence(spark, d):
    return views.edges(spark, d).select("edge_id", "src", "rel", "dst", "start_year", "end_year", F.round("confidence", 6).alias("confidence"), F.concat_ws(",", "evidence").alias("evidence"))


@query(with_views("SELECT id, degree FROM degs", "degs"))
def degree(spark, d):
    return graph.degrees(views.edges(spark, d))


@query(with_views("SELECT quantile_disc(degree, 0.99) AS p99 FROM degs", "degs"))
def degree_p99(spark, d):
    return graph.degrees(views.edges(spark, d)).agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY degree)").cast("long").alias("p99"))


@query(with_views("SELECT id, degree FROM degs WHERE degree <= (SELECT quantile_disc(degree, 0.99) FROM degs)", "degs"))
def hub_filter(spark, d):
    rows = graph.degrees(views.edges(spark, d))
    return rows.where(F.col("degree") <= graph.degree_bound(rows, "p99"))


@query(with_views("SELECT 'Entity' AS label, count(*) AS n FROM ents UNION ALL SELECT 'Chunk', count(*) FROM chks UNION ALL SELECT 'Article', count(*) FROM arts UNION ALL SELECT 'Period', count(*) FROM periods", "ents", "chks", "arts"))
def label_counts(spark, d):
    return graph.label_counts(Entity=views.entities(spark, d), Chunk=views.chunks(spark, d), Article=views.articles(spark, d), Period=table(spark, d, "periods"))


@query(with_views("SELECT coalesce(type, 'Entity') AS labels, count(*) AS n FROM ents GROUP BY 1", "ents"))
def stats_by_label_set(spark, d):
    return views.entities(spark, d).groupBy(F.coalesce("type", F.lit("Entity")).alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT id, name, CASE WHEN name IS NOT NULL AND count(*) OVER (PARTITION BY name) > 1 AND start_year IS NOT NULL THEN name || ' (' || start_year || ')' ELSE name END AS display_name FROM ents", "ents"))
def display_name_disambig(spark, d):
    return graph.display_names(views.entities(spark, d))


@query(with_views("SELECT lower(name) AS name, count(*) AS n FROM ents WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "ents"))
def duplicate_names(spark, d):
    rows = views.entities(spark, d).where("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1")


@query(with_views("SELECT rel, count(*) AS n FROM edgs WHERE src IN (SELECT id FROM ents WHERE start_year IS NOT NULL) AND dst IN (SELECT id FROM ents WHERE start_year IS NOT NULL) GROUP BY rel", "edgs"))
def semi_endpoints(spark, d):
    dated = views.entities(spark, d).where("start_year IS NOT NULL")
    return graph.with_endpoints(views.edges(spark, d), dated).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(f"SELECT relation IN ({', '.join(repr(r) for r in extract.ONTOLOGY)}) AND relation IS NOT NULL AS accepted, count(*) AS n FROM trips GROUP BY 1", "trips"))
def ontology_reject_split(spark, d):
    good, bad = graph.split_by(views.triplets(spark, d), F.broadcast(extract.ontology_table(spark).select("relation")), "relation")
    return good.agg(F.lit(True).alias("accepted"), F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit(False).alias("accepted"), F.count(F.lit(1)).alias("n"))).where("n > 0")


@query(with_views("SELECT DISTINCT c.page_id, c.id AS chunk_id FROM chks c JOIN arts a USING (page_id)", "chks", "arts"))
def has_chunk(spark, d):
    return graph.has_chunk(views.articles(spark, d), views.chunks(spark, d))


@query(with_views("SELECT DISTINCT r.chunk_id, x AS entity_id FROM (SELECT chunk_id, unnest([src, dst]) AS x FROM rels WHERE chunk_id IS NOT NULL) r JOIN chks c ON c.id = r.chunk_id", "rels", "chks"))
def mentions_distinct(spark, d):
    rows = resolve.relations(views.triplets(spark, d), views.names(spark, d)).where("relation IS NOT NULL AND chunk_id IS NOT NULL")
    pairs = rows.select("chunk_id", F.explode(F.array("src", "dst")).alias("entity_id"))
    return graph.mentions(pairs, views.chunks(spark, d), views.entities(spark, d))


@query(with_views("SELECT DISTINCT a.page_id, e.id AS entity_id FROM arts a JOIN ents e ON e.id = 'qid:' || a.qid", "arts", "ents"))
def about(spark, d):
    return graph.about(views.articles(spark, d), views.entities(spark, d))


@query(with_views("SELECT id FROM chks WHERE min_year IS NULL OR (min_year <= 1500 AND coalesce(max_year, min_year) >= 1200)", "chks"))
def keep_null_year_filter(spark, d):
    return views.chunks(spark, d).where(in_years(F.col("min_year"), F.col("max_year"), 1200, 1500)).select("id")


@query(with_views("SELECT id FROM chks WHERE period_id IN ('p07', 'p08') OR list_has_any(coalesce(period_ids, []), ['p07', 'p08'])", "chks"))
def period_filter(spark, d):
    return views.chunks(spark, d).where(in_periods(F.col("period_id"), F.col("period_ids"), ["p07", "p08"])).select("id")


@query(with_views("SELECT edge_id FROM edgs WHERE start_year IS NULL OR (start_year <= 1505 AND coalesce(end_year, start_year) >= 1295)", "edgs"))
def edge_slack_filter(spark, d):
    return views.edges(spark, d).where(edge_in_years(F.col("start_year"), F.col("end_year"), 1300, 1500)).select("edge_id")


@query("SELECT DISTINCT rec_id, CASE WHEN start_year IS NOT NULL AND (end_year IS NULL OR start_year <= end_year) THEN start_year END AS start_year, CASE WHEN start_year IS NOT NULL AND (end_year IS NULL OR start_year <= end_year) THEN end_year END AS end_year FROM entities")
def valid_year_pairs(spark, d):
    start, end = valid_years(F.col("start_year"), F.col("end_year"))
    return table(spark, d, "entities").select("rec_id", start.alias("start_year"), end.alias("end_year")).distinct()


@query("SELECT DISTINCT id, nullif(regexp_extract(trim(id), '^(?:qid:)?(Q[0-9]+)$', 1), '') AS number FROM entities")
def qid_validity(spark, d):
    return table(spark, d, "entities").select("id", qid(F.col("id")).alias("number")).distinct()


# Expansion

SEEDS = "seeds AS (SELECT 'q' || CAST(row_number() OVER (ORDER BY degree DESC, id) AS VARCHAR) AS query_id, id FROM degs ORDER BY degree DESC, id LIMIT 5)"


def _seeds(spark, d):
    """The five best connected entities, one question each."""
    top = graph.degrees(views.edges(spark, d)).orderBy(F.desc("degree"), "id").limit(5)
    order = Window.orderBy(F.desc("degree"), "id")
    return top.select(F.concat(F.lit("q"), F.row_number().over(order).cast("string")).alias("query_id"), "id")


@query(with_views("SELECT DISTINCT s.query_id, e.other AS node FROM seeds s JOIN ends e ON e.id = s.id", "degs", extra=SEEDS))
def khop_1(spark, d):
    return traverse.expand(_seeds(spark, d), views.edges(spark, d), hops=1).select("query_id", "node").distinct()


@query(with_views("SELECT query_id, node, min(hop) AS hop, count(*) AS trails FROM (SELECT query_id, node, 1 AS hop FROM one UNION ALL SELECT o.query_id, e.other, 2 FROM one o JOIN ends e ON e.id = o.node AND e.edge_id <> o.edge_id) GROUP BY 1, 2", "degs", extra=SEEDS + ", one AS (SELECT s.query_id, e.other AS node, e.edge_id FROM seeds s JOIN ends e ON e.id = s.id)"))
def khop_2(spark, d):
    return traverse.expand(_seeds(spark, d), views.edges(spark, d), hops=2).groupBy("query_id", "node").agg(F.min("hop").alias("hop"), F.count(F.lit(1)).alias("trails"))


_WALK = """, pairs AS (SELECT a.query_id || b.query_id AS query_id, a.id AS a, b.id AS b FROM seeds a JOIN seeds b ON a.query_id < b.query_id),
    w0 AS (SELECT query_id, a AS node, b, [a] AS nodes FROM pairs)"""
for _i in range(1, 5):
    _WALK += f", w{_i} AS (SELECT w.query_id, e.other AS node, w.b, list_append(w.nodes, e.other) AS nodes FROM w{_i - 1} w JOIN (SELECT DISTINCT id, other FROM ends WHERE id <> other) e ON e.id = w.node WHERE w.node <> w.b AND NOT list_contains(w.nodes, e.other))"


@query(with_views("SELECT query_id, min(hops) AS hops, count(DISTINCT mid) AS routes FROM (SELECT *, min(hops) OVER (PARTITION BY query_id) AS best FROM (" + " UNION ALL ".join(f"SELECT query_id, {i} AS hops, array_to_string(nodes, '|') AS mid FROM w{i} WHERE node = b" for i in range(1, 5)) + ")) WHERE hops = best GROUP BY query_id", "degs", extra=SEEDS + _WALK))
def shortest_routes(spark, d):
    seeds = _seeds(spark, d)
    pairs = seeds.alias("x").join(seeds.alias("y"), F.col("x.query_id") < F.col("y.query_id")).select(F.concat("x.query_id", "y.query_id").alias("query_id"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    found = traverse.shortest_paths(pairs, views.edges(spark, d), max_degree=None, limit=None)
    return found.groupBy("query_id").agg(F.min("hops").alias("hops"), F.count_distinct(F.concat_ws("|", "nodes")).alias("routes"))


_STEPS = 10
_RANK = """, links AS (SELECT DISTINCT s.query_id, e.id AS node, e.other AS oth FROM (SELECT DISTINCT query_id FROM seeds) s, ends e),
    outs AS (SELECT query_id, node, count(*) AS deg FROM links GROUP BY 1, 2),
    base AS (SELECT o.query_id, o.node, o.deg, CASE WHEN s.id IS NULL THEN 0.0 ELSE 1.0 END AS jump, 1.0 / count(*) OVER (PARTITION BY o.query_id) AS start FROM outs o LEFT JOIN seeds s ON s.query_id = o.query_id AND s.id = o.node),
    r0 AS MATERIALIZED (SELECT query_id, node, deg, CAST(jump AS DOUBLE) AS jump, CAST(start AS DOUBLE) AS score FROM base)"""
for _i in range(1, _STEPS + 1):
    _RANK += f", r{_i} AS MATERIALIZED (SELECT b.query_id, b.node, b.deg, b.jump, 0.85 * coalesce(f.s, 0) + 0.15 * b.jump AS score FROM r0 b LEFT JOIN (SELECT l.query_id, l.oth AS node, sum(r.score / r.deg) AS s FROM r{_i - 1} r JOIN links l USING (query_id, node) GROUP BY 1, 2) f USING (query_id, node))"


@query(with_views(f"SELECT query_id, node, round(score, 6) AS score FROM r{_STEPS}", "degs", extra=SEEDS + _RANK))
def ppr_iterations(spark, d):
    ranked = traverse.pagerank_over(_seeds(spark, d), views.edges(spark, d).select("src", "dst"), iterations=_STEPS, tolerance=None)
    return ranked.select("query_id", "node", F.round("score", 6).alias("score"))


@query(with_views("SELECT period_id AS query_id, id, degree, CAST(r AS INTEGER) AS rank FROM (SELECT i.period_id, i.id, g.degree, row_number() OVER (PARTITION BY i.period_id ORDER BY g.degree DESC, i.id) AS r FROM inper i JOIN degs g USING (id)) WHERE r <= 10", "inper", "degs"))
def period_seeds_topk(spark, d):
    wanted = table(spark, d, "periods").select(F.col("id").alias("query_id"), F.col("id").alias("period_id"))
    return traverse.period_seeds(graph.degrees(views.edges(spark, d)), in_period_fallback(spark, d), wanted)


# Selection


@query("SELECT target, count(*) AS n FROM (SELECT DISTINCT page_id, trim(unnest(regexp_extract_all(wikitext, '\\[\\[([^\\]|#:\\n]+)', 1))) AS target FROM articles WHERE page_id IS NOT NULL) GROUP BY 1")
def inlinks(spark, d):
    links = table(spark, d, "articles").where("page_id IS NOT NULL").select("page_id", F.explode(F.regexp_extract_all("wikitext", F.lit(r"\[\[([^\]|#:\n]+)"), F.lit(1))).alias("target"))
    return collect.in_links(links.withColumn("target", F.trim("target")))


@query("SELECT target, period_id, n, CAST(row_number() OVER (PARTITION BY target ORDER BY n DESC, parallel, period_id) AS INTEGER) AS rank FROM (SELECT target, period_id, count(*) AS n FROM (SELECT DISTINCT page_id, period_id, trim(unnest(regexp_extract_all(wikitext, '\\[\\[([^\\]|#:\\n]+)', 1))) AS target FROM articles WHERE is_seed AND page_id IS NOT NULL) GROUP BY 1, 2) JOIN (SELECT id AS period_id, parallel FROM periods) USING (period_id)")
def inlinks_hints(spark, d):
    links = table(spark, d, "articles").where("is_seed AND page_id IS NOT NULL").select("page_id", "period_id", F.explode(F.regexp_extract_all("wikitext", F.lit(r"\[\[([^\]|#:\n]+)"), F.lit(1))).alias("target"))
    return collect.ranked_hints(links.withColumn("target", F.trim("target")), table(spark, d, "periods"))


def _ranked(spark, d):
    rows = views.articles(spark, d).select("page_id", "title", "period_id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), F.lit(None).cast("int").alias("seed_rank"), "start_year", F.col("in_links").alias("links"))
    return rows.where("period_id IS NOT NULL")


@query(with_views("SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY period_id ORDER BY coalesce(is_seed, false) DESC, start_year IS NULL, coalesce(in_links, 0) DESC, title, page_id) <= 5 + position THEN 'A' ELSE 'B' END AS tier FROM arts a JOIN (SELECT id AS period_id, position FROM pers) USING (period_id)", "arts", "pers"))
def tier_assign(spark, d):
    return collect.tiers(_ranked(spark, d), views.periods(spark, d).select(F.col("id").alias("period_id"), (F.col("position") + 5).alias("quota")))


@query(with_views("SELECT page_id, period_id FROM (SELECT a.*, p.position, coalesce(is_seed, false) AS seed, row_number() OVER (PARTITION BY a.period_id, coalesce(is_seed, false) ORDER BY coalesce(in_links, 0) DESC, title, page_id) AS r, count(*) FILTER (WHERE is_seed) OVER (PARTITION BY a.period_id) AS seeds FROM arts a JOIN (SELECT id AS period_id, position FROM pers) p USING (period_id)) WHERE seed OR r <= greatest(0, 8 + position - seeds)", "arts", "pers"))
def capacity_cap(spark, d):
    return collect.capacity(_ranked(spark, d), views.periods(spark, d).select(F.col("id").alias("period_id"), (F.col("position") + 8).alias("cap"))).select("page_id", "period_id")


@query(with_views("SELECT id AS period_id, greatest(3 + position, CAST(round_even(95.0 * (3 + position) / sum(3 + position) OVER (), 0) AS INTEGER)) AS cap FROM pers", "pers"))
def quota_alloc(spark, d):
    return collect.quotas(views.periods(spark, d).select("id", (F.col("position") + 3).alias("quota")), "full", 95)


@query("SELECT DISTINCT id, alias FROM (SELECT id, name, unnest(aliases) AS alias FROM entities WHERE name IS NOT NULL) WHERE length(regexp_replace(alias, '[^\\p{L}]', '', 'g')) >= 4 AND NOT regexp_matches(alias, '^(?:\\p{Lu}\\.\\s*)+$') AND NOT contains(alias, '|') AND length(alias) <= 80 AND lower(alias) <> lower(name)")
def useful_aliases(spark, d):
    rows = table(spark, d, "entities").where("name IS NOT NULL").select("id", "name", F.explode("aliases").alias("alias"))
    return rows.where(collect.useful_alias(F.col("alias"), F.col("name"))).select("id", "alias").distinct()


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 2 * value ELSE value END AS value, event_type FROM events")
def dedupe_merge_write(spark, d):
    old = table(spark, d, "events").select("event_id", "value", "event_type")
    new = old.where("event_type = 'purchase'").withColumn("value", 2 * F.col("value"))
    return merged(old, new, "event_id")


@query(with_views("SELECT c.id FROM chks c WHERE c.id NOT IN (SELECT chunk_id FROM trips WHERE chunk_id IS NOT NULL) AND (coalesce(tier, '') <> 'B' OR chunk_index < 3)", "chks", "trips"))
def resume_antijoin(spark, d):
    return extract.select_chunks(views.chunks(spark, d), views.triplets(spark, d).where("chunk_id IS NOT NULL")).select("id")


@query(with_views("SELECT period_id, count(*) AS n, CAST(floor(sum(coalesce(tokens, 0)) / count(*)) AS BIGINT) AS mean_tokens FROM chks GROUP BY 1", "chks"))
def chunks_per_period(spark, d):
    return views.chunks(spark, d).groupBy("period_id").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(F.coalesce("tokens", F.lit(0))) / F.count(F.lit(1))).alias("mean_tokens"))


@query(with_views("SELECT id, sha256('[\"model\",' || to_json(trim(id)) || ']') AS key FROM chks", "chks"))
def memo_keys(spark, d):
    return views.chunks(spark, d).select("id", memo_key(F.lit("model"), F.col("id")).alias("key"))


# Extraction and resolution


def _checked(spark, d):
    rows = views.triplets(spark, d)
    kinds = views.entities(spark, d).where("name IS NOT NULL").groupBy(views.normalize_key(F.col("name")).alias("_k")).agg(F.min_by("type", "rec_id").alias("_type"))
    for end in ("head", "tail"):
        rows = rows.withColumn("_e", views.normalize_key(F.col(end))).join(kinds.select(F.col("_k").alias("_e"), F.col("_type").alias(f"{end}_type")), "_e", "left").drop("_e")
    texts = views.chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    return rows.join(texts, "chunk_id", "left")


def _type_sql(name: str, known: str) -> str:
    from annales.functions.text import TYPE_WORDS

    cases = " ".join(f"WHEN regexp_matches({KEY.format(name)}, '{'|'.join(words)}') THEN '{kind}'" for kind, words in TYPE_WORDS)
    return f"coalesce(nullif({known}, ''), CASE WHEN coalesce({KEY.format(name)}, '') = '' THEN 'Unknown' {cases} ELSE 'Unknown' END)"


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', [{', '.join(repr(x) for x in dom)}], [{', '.join(repr(x) for x in ran)}])" for r, (dom, ran) in extract.ONTOLOGY.items()) + ") v(rel, dom, ran))"
_KINDS = f"kinds AS (SELECT {KEY.format('name')} AS k, arg_min(type, rec_id) AS kind FROM ents WHERE name IS NOT NULL GROUP BY 1)"
_CHECKED = f"""checked AS (SELECT t.*, c.text AS chunk_text, r.rel, r.dom, r.ran, {_type_sql('t.head', 'h.kind')} AS ht, {_type_sql('t.tail', 'x.kind')} AS tt FROM trips t LEFT JOIN chks c ON c.id = t.chunk_id LEFT JOIN rules r ON r.rel = t.relation
    LEFT JOIN kinds h ON h.k = {KEY.format('t.head')} LEFT JOIN kinds x ON x.k = {KEY.format('t.tail')})"""
_REASONS = f"""reas AS (SELECT triplet_id, list_filter([
    CASE WHEN coalesce(trim(head), '') = '' OR coalesce(trim(tail), '') = '' THEN 'head_or_tail_missing' END,
    CASE WHEN coalesce(relation, '') = '' THEN 'relation_missing' END,
    CASE WHEN rel IS NULL AND coalesce(relation, '') <> '' THEN 'relation_not_in_ontology' END,
    CASE WHEN rel IS NOT NULL AND ht <> 'Unknown' AND NOT list_contains(dom, ht) THEN 'head_type_invalid' END,
    CASE WHEN rel IS NOT NULL AND tt <> 'Unknown' AND NOT list_contains(ran, tt) THEN 'tail_type_invalid' END,
    CASE WHEN NOT (coalesce(contains({KEY.format('chunk_text')}, {KEY.format('evidence')}), false) AND coalesce(trim(evidence), '') <> '') THEN 'evidence_not_in_chunk' END,
    CASE WHEN confidence < 0.6 THEN 'low_confidence' END,
    CASE WHEN coalesce(start_year > 1945, false) OR coalesce(end_year > 1945, false) THEN 'after_1945' END,
    CASE WHEN start_year > end_year THEN 'start_year_gt_end_year' END], lambda x: x IS NOT NULL) AS reasons FROM checked)"""


@query(with_views("SELECT triplet_id, array_to_string(reasons, ',') AS reasons FROM reas", "trips", "chks", "ents", extra=f"{_RULES}, {_KINDS}, {_CHECKED}, {_REASONS}"))
def validate_reasons(spark, d):
    return extract.reasons(_checked(spark, d), fuzzy=False).select("triplet_id", F.concat_ws(",", "reasons").alias("reasons"))


@query(with_views("SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM reas) GROUP BY 1", "trips", "chks", "ents", extra=f"{_RULES}, {_KINDS}, {_CHECKED}, {_REASONS}"))
def reject_histogram(spark, d):
    return extract.histogram(extract.reasons(_checked(spark, d), fuzzy=False))


@query()
def validate_fuzzy(spark, d):
    """Evidence that is nearly in its chunk counts; no SQL measures that."""
    return extract.reasons(_checked(spark, d)).select("triplet_id", F.concat_ws(",", "reasons").alias("reasons"))


@query(with_views("SELECT name AS head, 'SUCCEEDED' AS relation, prev AS tail FROM (SELECT name, lag(name) OVER (PARTITION BY p ORDER BY start_year, id) AS prev FROM (SELECT *, coalesce(period_ids[1], '') AS p FROM ents WHERE type = 'Polity' AND name IS NOT NULL AND start_year IS NOT NULL)) WHERE prev IS NOT NULL AND prev <> name", "ents"))
def succession_chain(spark, d):
    rows = views.entities(spark, d).where("type = 'Polity' AND name IS NOT NULL AND start_year IS NOT NULL")
    rows = rows.withColumn("_p", F.coalesce(F.try_element_at("period_ids", F.lit(1)), F.lit(""))).withColumn("_at", F.struct("start_year", "id"))
    return extract.succession(rows, "_p", "_at")


@query(f"SELECT {KEY.format('alias')} AS alias, arg_min(id, rec_id) AS entity_id FROM (SELECT id, rec_id, unnest(list_append(coalesce(aliases, []), name)) AS alias FROM entities) WHERE alias IS NOT NULL AND {KEY.format('alias')} <> '' GROUP BY 1")
def resolve_exact_alias(spark, d):
    rows = table(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("rec_id").alias("load_seq"), F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("alias"))
    return resolve.alias_registry(rows)


@query("""WITH once AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at DESC) AS r FROM entities) WHERE r = 1),
    al AS (SELECT id, a, min((rec_id, p)) AS f FROM (SELECT id, rec_id, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS p FROM once) GROUP BY 1, 2)
    SELECT o.id, arg_min(name, rec_id) FILTER (WHERE name IS NOT NULL) AS name, arg_min(type, rec_id) FILTER (WHERE type IS NOT NULL) AS type, arg_min(start_year, rec_id) FILTER (WHERE start_year IS NOT NULL) AS start_year, arg_min(end_year, rec_id) FILTER (WHERE end_year IS NOT NULL) AS end_year,
    coalesce((SELECT string_agg(a, '|' ORDER BY f) FROM al WHERE al.id = o.id), '') AS aliases FROM once o GROUP BY o.id""")
def merge_entities(spark, d):
    once = views.latest(table(spark, d, "entities"), "rec_id", "ingested_at")
    merged_rows = resolve.merge_entities(once, "rec_id")
    return merged_rows.select("id", "name", "type", "start_year", "end_year", F.concat_ws("|", "aliases").alias("aliases"))


@query()
def fuzzy_pairs(spark, d):
    return resolve.fuzzy_pairs(views.entities(spark, d))


@query()
def resolve_mentions(spark, d):
    rows = views.latest(table(spark, d, "entities"), "rec_id", "ingested_at")
    return resolve.resolve_mentions(rows.select(F.col("rec_id").alias("seq"), F.coalesce("name", F.lit("")).alias("name"), "type", "start_year", "qid", "aliases"))


@query(with_views("SELECT id, CASE WHEN qid IS NOT NULL THEN 'qid' WHEN type = 'Event' AND start_year IS NOT NULL THEN 'dated' ELSE 'local' END AS kind FROM ents", "ents"))
def new_id_kinds(spark, d):
    rows = resolve.new_ids(views.entities(spark, d))
    dated = F.col("new_id").rlike(r"^local:.*-?\d+$") & (F.col("type") == "Event") & F.col("start_year").isNotNull()
    return rows.select("id", F.when(F.col("new_id").startswith("qid:"), "qid").when(dated, "dated").otherwise("local").alias("kind"))


# Browsing


@query(with_views("SELECT e.id, e.name, coalesce(g.degree, 0) AS degree FROM ents e LEFT JOIN degs g USING (id) WHERE contains(lower(name), 'kh') AND type = 'Person' AND e.id IN (SELECT id FROM inper WHERE period_id = 'p08') ORDER BY degree DESC, name, id LIMIT 60 OFFSET 5", "ents", "degs", "inper"))
def entities_browse(spark, d):
    return browse.entities(views.entities(spark, d), graph.degrees(views.edges(spark, d)), in_period_fallback(spark, d), "kh", "Person", "p08", 60, 5).select("id", "name", "degree")


@query(with_views("SELECT id, array_to_string(list(name ORDER BY name, other), '|') AS neighbours FROM (SELECT s.id, s.other, x.name, row_number() OVER (PARTITION BY s.id ORDER BY x.name, s.other) AS r FROM (SELECT DISTINCT e.id, e.other FROM ends e WHERE e.id <> e.other) s JOIN ents x ON x.id = s.other) WHERE r <= 30 GROUP BY id", "ends"))
def entity_neighbours(spark, d):
    nodes = views.entities(spark, d)
    rows = browse.neighbours(views.edges(spark, d), nodes, nodes.select("id"))
    return rows.where(F.size("neighbours") > 0).select("id", F.concat_ws("|", "neighbours").alias("neighbours"))


@query(with_views("SELECT x.id, x.rel, array_to_string(list_sort(list_distinct(list(n.name))), '|') AS names FROM (SELECT src AS id, dst AS other, rel FROM edgs UNION ALL SELECT dst, src, rel FROM edgs) x JOIN ents n ON n.id = x.other WHERE n.name IS NOT NULL GROUP BY 1, 2", "edgs"))
def neighbours_by_relation(spark, d):
    nodes = views.entities(spark, d).where("name IS NOT NULL")
    return browse.by_relation(views.edges(spark, d), nodes, views.entities(spark, d)).select("id", "rel", F.concat_ws("|", "names").alias("names"))


@query(with_views("SELECT entity_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT 'qid:' || a.qid AS entity_id, c.id, row_number() OVER (PARTITION BY a.qid ORDER BY c.chunk_index, c.id) AS r FROM arts a JOIN ents e ON e.id = 'qid:' || a.qid JOIN chks c ON c.page_id = a.page_id) WHERE r <= 6", "arts", "chks", "ents"))
def entity_passages(spark, d):
    return browse.passages(about(spark, d), views.chunks(spark, d), views.entities(spark, d))


@query(with_views("SELECT period_id, id, name, start_year, CAST(r AS INTEGER) AS rank FROM (SELECT i.period_id, e.id, e.name, e.start_year, row_number() OVER (PARTITION BY i.period_id ORDER BY e.start_year NULLS LAST, e.name NULLS FIRST, e.id) AS r FROM inper i JOIN ents e USING (id)) WHERE r <= 60", "inper"))
def period_items(spark, d):
    return browse.period_items(views.entities(spark, d), in_period_fallback(spark, d))


@query(with_views("SELECT p.id AS query_id, arg_max(e.id, (e.start_year IS NOT NULL, coalesce(g.degree, 0), e.id)) AS event_id FROM periods p JOIN inper i ON i.period_id = p.id JOIN ents e ON e.id = i.id AND e.type = 'Event' LEFT JOIN degs g ON g.id = e.id GROUP BY 1", "inper", "degs"))
def event_focus(spark, d):
    events = in_period_fallback(spark, d).select(F.col("period_id").alias("query_id"), "id")
    edges = views.edges(spark, d)
    return browse.event_focus(events, edges, views.entities(spark, d), graph.degrees(edges)).select("query_id", "event_id")


@query(with_views("SELECT i.period_id AS query_id, coalesce(type, 'Entity') AS type, count(DISTINCT name) AS n FROM inper i JOIN ents e USING (id) WHERE name IS NOT NULL GROUP BY 1, 2", "inper"))
def key_facts(spark, d):
    rows = in_period_fallback(spark, d).join(views.entities(spark, d).where("name IS NOT NULL"), "id").select(F.col("period_id").alias("query_id"), F.coalesce("type", F.lit("Entity")).alias("type"), "name")
    return browse.key_facts(rows).select("query_id", "type", F.size("names").cast("long").alias("n"))


@query(with_views("SELECT DISTINCT x.edge_id, c.id AS chunk_id, c.page_title FROM (SELECT edge_id, unnest(evidence) AS chunk_id FROM edgs) x JOIN chks c ON c.id = x.chunk_id", "edgs", "chks"))
def evidence_chunks(spark, d):
    return browse.evidence_chunks(views.edges(spark, d), views.chunks(spark, d))


@query(with_views("SELECT e.id, e.name, e.start_year, coalesce((SELECT string_agg(DISTINCT x.name, '|' ORDER BY x.name) FROM edgs g JOIN ents x ON x.id = g.src WHERE g.rel = 'COMMANDED' AND g.dst = e.id), '') AS commanders FROM ents e WHERE e.type = 'Event' AND e.id IN (SELECT id FROM inper WHERE period_id = 'p08')", "edgs", "inper"))
def event_timeline(spark, d):
    return browse.event_timeline(views.entities(spark, d), views.edges(spark, d), in_period_fallback(spark, d), "p08").withColumn("commanders", F.concat_ws("|", "commanders"))


@query(with_views("SELECT count(*) AS edges, count(*) FILTER (WHERE src = dst) AS loops, count(DISTINCT least(src, dst) || '|' || greatest(src, dst)) AS pairs FROM edgs", "edgs"))
def simple_graph(spark, d):
    rows = views.edges(spark, d)
    pair = F.concat(F.least("src", "dst"), F.lit("|"), F.greatest("src", "dst"))
    return rows.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_distinct(pair).alias("pairs"))


@query()
def chunk_pages(spark, d):
    """Articles cut to chunks with years, links and labels."""
    from annales.functions.wikipage import parsed

    rows = views.articles(spark, d).withColumn("_p", parsed(F.col("wikitext")))
    rows = rows.select("page_id", "title", F.lit(None).cast("string").alias("label"), "qid", "period_id", "period_ids", "tier", "_p.sections", "_p.links")
    return chunk_articles(rows, table(spark, d, "periods")).select("id", "page_id", "chunk_index", "section_path", "tokens", "min_year", "max_year", "legendary", F.size("links").alias("links"))


@query()
def infobox_triplets(spark, d):
    from annales.functions.wikipage import parsed

    rows = views.articles(spark, d).withColumn("_b", parsed(F.col("wikitext"))["infobox"]).where("_b IS NOT NULL")
    fields = F.transform_values("_b.fields", lambda _, v: v["text"])
    rules = {"thông tin nhân vật": {"liên quan": ("OPPOSED", False)}, "thông tin địa điểm": {"liên quan": ("PART_OF", False)}, "thông tin trận đánh": {"liên quan": ("PARTICIPATED_IN", True)}}
    return extract.from_infobox(rows.select("title", "page_id", "start_year", "end_year", F.col("_b.template").alias("template"), fields.alias("fields")), rules).select("head", "relation", "tail", "article_id")


