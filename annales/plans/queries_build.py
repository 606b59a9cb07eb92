"""Queries over the build of the graph: curated lists, selection of articles, prompts, summaries, plans of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from annales.functions import times
from annales.operators import collect, extract, graph, search
from annales.operators.extract import INFOBOX, ONTOLOGY, PLACEHOLDERS
from annales.plans import pipeline, views
from annales.plans.queries_graph import Query, in_period_fallback
from annales.plans.views import KEY, with_views
from annales.sources.tables import table

QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(items) -> str:
    return ", ".join(_quoted(x) for x in items)


# Curated lists: periods stand for dynasties, with the first person and place recorded under each.

_LISTS = """firsts AS (SELECT period_ids[1] AS pid, arg_min(name, rec_id) FILTER (WHERE type = 'Person') AS founder, arg_min(name, rec_id) FILTER (WHERE type = 'Place') AS capital FROM ents WHERE name IS NOT NULL GROUP BY 1),
    lists AS (SELECT p.era_id AS section, p.position, p.name, f.founder, f.capital, CASE WHEN p.position % 5 = 0 THEN lag(p.name) OVER (PARTITION BY p.era_id ORDER BY p.position) END AS predecessor, p.start_year, p.end_year FROM pers p LEFT JOIN firsts f ON f.pid = p.id),
    bb AS (SELECT founder AS head, 'FOUNDED' AS relation, name AS tail, start_year, end_year FROM lists WHERE founder IS NOT NULL
    UNION ALL SELECT capital, 'CAPITAL_OF', name, start_year, end_year FROM lists WHERE capital IS NOT NULL
    UNION ALL SELECT name, 'SUCCEEDED', predecessor, start_year, end_year FROM lists WHERE predecessor IS NOT NULL AND predecessor <> name
    UNION ALL SELECT name, 'SUCCEEDED', b, start_year, end_year FROM (SELECT *, lag(name) OVER (PARTITION BY section ORDER BY position) AS b FROM lists) WHERE b IS NOT NULL AND b <> name AND predecessor IS DISTINCT FROM b
    UNION ALL SELECT e.name, 'CAPITAL_OF', p.name, e.start_year, e.end_year FROM ents e JOIN pers p ON p.id = e.period_ids[1] WHERE e.type = 'Place' AND e.name IS NOT NULL AND e.start_year IS NOT NULL)"""


def _backbone(spark, d):
    from pyspark.sql.window import Window

    nodes = views.entities(spark, d).where("name IS NOT NULL").withColumn("pid", F.try_element_at("period_ids", F.lit(1)))
    firsts = nodes.groupBy("pid").agg(F.min_by(F.when(F.col("type") == "Person", F.col("name")), F.when(F.col("type") == "Person", F.col("rec_id"))).alias("founder"), F.min_by(F.when(F.col("type") == "Place", F.col("name")), F.when(F.col("type") == "Place", F.col("rec_id"))).alias("capital"))
    dim = views.periods(spark, d)
    before = F.lag("name").over(Window.partitionBy("era_id").orderBy("position"))
    none = F.lit(None).cast("string")
    lists = dim.join(firsts, dim["id"] == firsts["pid"], "left").select(F.col("era_id").alias("section"), "position", "name", "founder", none.alias("ruler"), "capital", F.when(F.col("position") % 5 == 0, before).alias("predecessor"), none.alias("successor"), "start_year", "end_year")
    places = nodes.where("type = 'Place' AND start_year IS NOT NULL").join(F.broadcast(dim.select(F.col("id").alias("pid"), F.col("name").alias("polity"))), "pid")
    return extract.from_backbone(places.select(F.col("name").alias("place"), "polity", "start_year", "end_year"), lists)


@query(with_views("SELECT head, relation, tail, start_year, end_year, 1.0::DOUBLE AS confidence, 'backbone:' || head || ' ' || relation || ' ' || tail AS evidence FROM bb", "ents", "pers", extra=_LISTS))
def backbone_triplets(spark, d):
    return _backbone(spark, d).select("head", "relation", "tail", "start_year", "end_year", "confidence", "evidence")


@query(with_views("""SELECT head, relation, tail, start_year, end_year, 'backbone' AS source FROM bb
    UNION ALL SELECT t.head, t.relation, t.tail, t.start_year, t.end_year, t.source FROM trips t JOIN chks c ON c.id = t.chunk_id JOIN arts a ON a.page_id = c.page_id WHERE t.source IN ('wikidata', 'infobox') AND a.period_id IN (SELECT id FROM periods WHERE era_id = 'e3')""", "ents", "pers", "trips", "chks", "arts", extra=_LISTS))
def tier_s(spark, d):
    """Curated triplets, and those of structured sources whose article lies in an era."""
    rows = views.triplets(spark, d).join(views.chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("page_id").alias("article_id")), "chunk_id").withColumn("year_target", F.lit(None).cast("string"))
    parts = {name: rows.where(F.col("source") == name) for name in ("wikidata", "infobox")}
    return extract.structured(_backbone(spark, d), views.articles(spark, d), parts, era="e3", periods=table(spark, d, "periods")).select("head", "relation", "tail", "start_year", "end_year", "source")


@query("SELECT id AS period_id, era_id FROM periods WHERE era_id IS NOT NULL")
def part_of_eras(spark, d):
    dim = table(spark, d, "periods")
    return graph.part_of(dim, dim.select(F.col("era_id").alias("id")).distinct())


_FIELDS = [(t, f, r, h) for t, fields in INFOBOX.items() for f, (r, h) in fields.items()]
_RULES = ", ".join(f"({_quoted(t)}, {_quoted(f)}, {_quoted(r)}, {str(h).lower()})" for t, f, r, h in _FIELDS)
_SHOWN = [f for _, f, _, _ in _FIELDS]


@query(with_views(f"""SELECT CASE WHEN h THEN v ELSE name END AS head, rel AS relation, CASE WHEN h THEN name ELSE v END AS tail, start_year, end_year, rec_id AS article_id FROM (
    SELECT e.*, r.rel, r.h, trim(regexp_replace(x, '\\s*\\([^()]*\\)', '', 'g')) AS v FROM (SELECT *, unnest(string_split(name || chr(10) || coalesce(description, '?') || ' (x)' || chr(10) || 'Không rõ' || chr(10) || coalesce(aliases[1], ''), chr(10))) AS x FROM ents WHERE name IS NOT NULL) e, (VALUES {_RULES}) r(t, f, rel, h))
    WHERE {KEY.format('v')} NOT IN ({_values(PLACEHOLDERS)}) AND {KEY.format('v')} <> {KEY.format('name')}""", "ents"))
def infobox_rules(spark, d):
    """The rules as they are, over boxes that hold every field: the name itself, a description, a placeholder and an alias, a line each."""
    rows = views.entities(spark, d).where("name IS NOT NULL")
    text = F.concat_ws("\n", "name", F.concat(F.coalesce("description", F.lit("?")), F.lit(" (x)")), F.lit("Không rõ"), F.coalesce(F.try_element_at("aliases", F.lit(1)), F.lit("")))
    out = None
    for template, fields in INFOBOX.items():
        # Fields are written with capitals and numbers at their end, as pages do.
        held = F.map_from_entries(F.array(*[F.struct(F.lit(f.capitalize() + " 1"), text) for f in fields]))
        part = extract.from_infobox(rows.select(F.col("name").alias("title"), F.col("rec_id").alias("page_id"), "start_year", "end_year", F.lit("  " + template.upper()).alias("template"), held.alias("fields")))
        out = part if out is None else out.unionByName(part)
    return out.select("head", "relation", "tail", "start_year", "end_year", "article_id")


# Selection of articles


@query("SELECT id, list_has_any(t, ['Person', 'Event']) AS kept FROM (SELECT id, coalesce(list(DISTINCT type) FILTER (WHERE type IS NOT NULL), []) AS t FROM entities WHERE id IS NOT NULL GROUP BY 1)")
def class_split(spark, d):
    rows = table(spark, d, "entities").where("id IS NOT NULL").groupBy("id").agg(F.collect_set("type").alias("classes"))
    good, bad = collect.by_class(rows, ("Person", "Event"))
    return good.select("id", F.lit(True).alias("kept")).unionByName(bad.select("id", F.lit(False).alias("kept")))


_TITLES = "titles AS (SELECT DISTINCT unnest([name, CAST(start_year AS VARCHAR), 'Năm ' || abs(start_year) || ' TCN', 'Danh sách ' || lower(name), 'thập niên ' || start_year, 'Thế kỷ ' || name, 'Thế kỷ']) AS title FROM ents)"
_NO_ARTICLE = r"(?i)^(năm\s+)?\d+(\s+tcn)?$|^(thế kỷ|thập niên|danh sách)($|[^\p{L}\p{N}_])"


@query(with_views(f"SELECT title, NOT regexp_matches(trim(title), '{_NO_ARTICLE}') AS article FROM titles WHERE title IS NOT NULL", "ents", extra=_TITLES))
def article_titles(spark, d):
    rows = views.entities(spark, d)
    year = F.col("start_year").cast("string")
    variants = F.array("name", year, F.concat(F.lit("Năm "), F.abs("start_year").cast("string"), F.lit(" TCN")), F.concat(F.lit("Danh sách "), F.lower("name")), F.concat(F.lit("thập niên "), year), F.concat(F.lit("Thế kỷ "), "name"), F.lit("Thế kỷ"))
    return rows.select(F.explode(variants).alias("title")).where("title IS NOT NULL").distinct().select("title", collect.is_article(F.col("title")).alias("article"))


_LINK = "'\\[\\[([^\\]|#:\\n]+)'"


@query(f"""SELECT page_id, n FROM (SELECT page_id, count(*) AS n FROM (SELECT DISTINCT page_id, trim(unnest(regexp_extract_all(wikitext, {_LINK}, 1))) AS target FROM articles WHERE page_id IS NOT NULL)
    WHERE target IN (SELECT title FROM articles WHERE is_seed UNION SELECT name FROM entities) GROUP BY 1) WHERE n >= 2""")
def topic_links(spark, d):
    """Pages that link to two seeds or more; seeds and known names count."""
    rows = table(spark, d, "articles").where("page_id IS NOT NULL")
    links = rows.select("page_id", F.explode(F.regexp_extract_all("wikitext", F.lit(r"\[\[([^\]|#:\n]+)"), F.lit(1))).alias("target")).withColumn("target", F.trim("target"))
    seeds = rows.where("is_seed").select(F.col("title").alias("target")).unionByName(table(spark, d, "entities").select(F.col("name").alias("target")))
    return collect.on_topic(rows.select("page_id").distinct(), links, seeds, 2).select("page_id", F.col("seed_links").alias("n"))


_TIDY = "trim(regexp_replace(a, '\\s+', ' ', 'g'))"


@query(with_views(f"""SELECT id, coalesce(nullif(vi, ''), nullif(en, '')) AS label, coalesce(nullif(description, ''), nullif(name, '')) AS description, len(aliases) AS n_aliases, array_to_string(list_sort(aliases), '|') AS aliases FROM (
    SELECT id, vi, en, description, name, list_distinct(list_filter(list_transform(list_concat(coalesce(aliases, []), [en, name || '  II'], CASE WHEN en IS NULL THEN [] ELSE [en] END), lambda a: {_TIDY}), lambda a: length(regexp_replace(a, '[^\\p{{L}}]', '', 'g')) >= 4 AND NOT regexp_matches(a, '^(?:\\p{{Lu}}\\.\\s*)+$') AND NOT contains(a, '|') AND length(a) <= 80 AND lower(a) <> lower(name))) AS aliases
    FROM (SELECT *, CASE WHEN start_year IS NULL THEN name END AS vi, type || '  ' || name AS en FROM ents WHERE name IS NOT NULL))""", "ents"))
def entity_fields(spark, d):
    """Labels, descriptions and aliases by language: Vietnamese first, English where it lacks."""
    rows = views.entities(spark, d).where("name IS NOT NULL")
    pair = lambda x, y: F.map_from_arrays(F.array(F.lit("vi"), F.lit("en")), F.array(x, y))
    english = F.concat("type", F.lit("  "), "name")
    labels, descriptions = pair(F.when(F.col("start_year").isNull(), F.col("name")), english), pair(F.col("description"), F.col("name"))
    aliases = pair(F.coalesce("aliases", F.array().cast("array<string>")), F.array(english, F.concat("name", F.lit("  II"))))
    out = rows.select("id", *collect.described(labels, descriptions, aliases, F.col("name")))
    return out.select("id", "label", "description", F.size("aliases").cast("long").alias("n_aliases"), F.concat_ws("|", F.array_sort("aliases")).alias("aliases"))


_PLAIN = "start_year BETWEEN 100 AND 2000 AND end_year BETWEEN 100 AND 2000"


@query(with_views(f"SELECT id, start_year, end_year FROM ents WHERE name IS NOT NULL AND NOT regexp_matches(name, '[().\\d]') AND length(name) < 60 AND {_PLAIN} UNION ALL SELECT id, start_year, start_year FROM ents WHERE name IS NOT NULL AND NOT regexp_matches(name, '[().\\d]') AND length(name) < 60 AND start_year BETWEEN 100 AND 2000 AND end_year IS NULL", "ents"))
def lead_years(spark, d):
    """Years in the first bracket with years of a lead sentence."""
    rows = views.entities(spark, d).where(r"name IS NOT NULL AND NOT name RLIKE '[().\\d]' AND length(name) < 60")
    both = F.concat(F.col("start_year").cast("string"), F.lit(" – "), F.col("end_year").cast("string"))
    inner = F.when(F.expr(_PLAIN), both).when(F.expr("start_year BETWEEN 100 AND 2000 AND end_year IS NULL"), F.concat(F.lit("năm "), F.col("start_year").cast("string")))
    lead = F.concat("name", F.lit(" (tên khác) ("), F.coalesce(inner, F.lit("không rõ")), F.lit(") là một tên. Sau đó (1801 – 1802) còn nữa."))
    return collect.lead_years(rows.select("id", lead.alias("lead")), "id")


_RECORD = {"is_seed": "coalesce(is_seed, false)", "in_links": "coalesce(in_links, 0)", "tier": "coalesce(tier, 'B')", "period_ids": "coalesce(period_ids, [])"}
_STORED = ("page_id", "revision_id", "title", "qid", "period_id", "period_ids", "tier", "is_seed", "in_links", "start_year", "end_year", "wikitext")


@query(with_views(f"SELECT {', '.join(f'{_RECORD.get(c, c)} AS {c}' for c in _STORED)}, CAST(NULL AS VARCHAR) AS label, 0 AS seed_links, 0 AS n_aliases, 0 AS n_classes FROM arts", "arts"))
def article_records(spark, d):
    rows = collect.records(views.articles(spark, d))
    return rows.select(*_STORED, "label", "seed_links", F.size("aliases").alias("n_aliases"), F.size("classes").alias("n_classes"))


@query()
def collect_articles(spark, d):
    """Seeds and candidates of all periods: classes, years, topic, main period and room, in one chain."""
    rows = views.articles(spark, d).where("title IS NOT NULL AND period_id IS NOT NULL")
    types = views.entities(spark, d).where("qid IS NOT NULL").select("qid", F.array("type").alias("classes")).dropDuplicates(["qid"])
    rows = rows.join(types, "qid", "left").withColumn("births", F.array().cast("array<int>"))
    links = rows.select("page_id", F.explode(F.regexp_extract_all("wikitext", F.lit(r"\[\[([^\]|#:\n]+)"), F.lit(1))).alias("target")).withColumn("target", F.trim("target"))
    seeds = rows.where("is_seed").dropDuplicates(["title"])
    others = rows.where("NOT coalesce(is_seed, false)").drop("period_id", "in_links").dropDuplicates(["title"])
    caps = views.periods(spark, d).select(F.col("id").alias("period_id"), (F.col("position") + 40).alias("cap"))
    kept, _ = collect.collected(seeds, others, links, views.periods(spark, d), caps, ("Person", "Event", "Place", "Organization", "Polity"), least=0)
    return kept.select("page_id", "period_id", "is_seed", "links")


# Prompts and summaries


@query(with_views("SELECT c.id, c.period_id, p.name AS period_name, p.era_id AS period_era FROM chks c LEFT JOIN periods p ON p.id = c.period_id", "chks"))
def period_context(spark, d):
    return extract.with_period_context(views.chunks(spark, d).select("id", "period_id"), table(spark, d, "periods")).select("id", "period_id", "period_name", "period_era")


_ONTOLOGY = ", ".join(f"({_quoted(r)}, [{_values(a)}], [{_values(b)}])" for r, (a, b) in ONTOLOGY.items())
_FOUND = f"found AS MATERIALIZED (SELECT DISTINCT t.chunk_id, e.name, e.type FROM (SELECT chunk_id, head AS n FROM trips UNION ALL SELECT chunk_id, tail FROM trips) t JOIN nms m ON m.name = {KEY.format('t.n')} JOIN ents e ON e.id = m.entity_id WHERE t.chunk_id IS NOT NULL AND e.type IS NOT NULL)"
_ALLOWED = f"""allowed AS MATERIALIZED (SELECT chunk_id, list_sort(list('- ' || r || ': (' || array_to_string(list_sort(list_intersect(a, t)), '/') || ') -> (' || array_to_string(list_sort(list_intersect(b, t)), '/') || ')')) AS relations
    FROM (SELECT chunk_id, list(DISTINCT type) AS t FROM found GROUP BY 1), (VALUES {_ONTOLOGY}) o(r, a, b) WHERE list_has_any(a, t) AND list_has_any(b, t) GROUP BY 1)"""


def _found(spark, d):
    rows = views.triplets(spark, d).where("chunk_id IS NOT NULL")
    said = rows.select("chunk_id", F.explode(F.array("head", "tail")).alias("_n")).withColumn("name", views.normalize_key(F.col("_n"))).select("chunk_id", "name").distinct()
    known = said.join(views.names(spark, d), "name").select("chunk_id", F.col("entity_id").alias("id")).distinct()
    return known.join(views.entities(spark, d).where("type IS NOT NULL").select("id", "name", "type"), "id").select("chunk_id", "name", "type").distinct()


@query(with_views("SELECT chunk_id, array_to_string(relations, chr(10)) AS relations FROM allowed", "trips", "nms", "ents", extra=f"{_FOUND}, {_ALLOWED}"))
def allowed_relations(spark, d):
    return extract.applicable_relations(_found(spark, d)).select("chunk_id", F.concat_ws("\n", "relations").alias("relations"))


@query(with_views("""SELECT c.id, md5(concat_ws(chr(10) || chr(10), nullif(c.text, ''), CASE WHEN f.e IS NOT NULL THEN 'ENTITIES:' || chr(10) || f.e ELSE 'ENTITIES:' || chr(10) END,
    'RELATIONS:' || chr(10) || coalesce(array_to_string(w.relations, chr(10)), ''), nullif(coalesce('period: ' || p.name, ''), ''))) AS prompt FROM chks c LEFT JOIN periods p ON p.id = c.period_id
    LEFT JOIN (SELECT chunk_id, array_to_string(list_sort(list(DISTINCT '- ' || name || ' (' || type || ')')), chr(10)) AS e FROM found GROUP BY 1) f ON f.chunk_id = c.id LEFT JOIN allowed w ON w.chunk_id = c.id""", "chks", "trips", "nms", "ents", extra=f"{_FOUND}, {_ALLOWED}"))
def relation_prompts(spark, d):
    """Second-pass prompts of all chunks, by their hash."""
    rows = extract.with_period_context(views.chunks(spark, d).select("id", "text", "period_id"), table(spark, d, "periods"))
    return extract.prompts(rows, _found(spark, d).where("name IS NOT NULL")).select("id", F.md5("prompt").alias("prompt"))


@query(with_views("""SELECT (SELECT count(DISTINCT id) FROM chks) AS chunks, (SELECT count(*) FROM chks WHERE id IN (SELECT chunk_id FROM trips WHERE source = 'wikidata')) AS skipped,
    count(DISTINCT chunk_id) AS processed, count(*) AS triplets, count(*) FILTER (WHERE coalesce(confidence, 1) >= 0.6) AS accepted, count(*) FILTER (WHERE confidence < 0.6) AS rejected, count(DISTINCT CASE WHEN evidence IS NULL THEN chunk_id END) AS failed FROM trips""", "chks", "trips"))
def extraction_summary(spark, d):
    rows = views.triplets(spark, d)
    judged = rows.select("chunk_id", F.array_compact(F.array(F.when(F.col("confidence") < 0.6, "low_confidence"))).alias("reasons"))
    return extract.summary(views.chunks(spark, d), rows.where("source = 'wikidata'"), judged, rows.where("evidence IS NULL"))


@query(with_views("SELECT 'articles' AS \"table\", count(*) AS n FROM arts UNION ALL SELECT 'chunks', count(*) FROM chks UNION ALL SELECT 'entities', count(*) FROM ents UNION ALL SELECT 'edges', count(*) FROM edgs UNION ALL SELECT 'triplets', count(*) FROM trips", "arts", "chks", "ents", "edgs", "trips"))
def build_counts(spark, d):
    return graph.table_counts(articles=views.articles(spark, d), chunks=views.chunks(spark, d), entities=views.entities(spark, d), edges=views.edges(spark, d), triplets=views.triplets(spark, d))


@query(with_views("SELECT id, name, 0 AS part FROM ents WHERE type = 'Person' UNION ALL SELECT e.id, e.name, 1 FROM ents e WHERE e.id IN (SELECT id FROM inper WHERE period_id IN ('p07', 'p08')) AND coalesce(e.type, '') <> 'Person'", "ents", "inper"))
def united_nodes(spark, d):
    """Nodes of a subgraph and of paths: the first table's row stands where both have it."""
    rows = views.entities(spark, d)
    inside = in_period_fallback(spark, d).where("period_id IN ('p07', 'p08')").select("id").distinct()
    return graph.united(rows.where("type = 'Person'").select("id", "name", F.lit(0).alias("part")), rows.join(inside, "id", "left_semi").select("id", "name", F.lit(1).alias("part")), "id")


@query(with_views("SELECT id, name, type, start_year, end_year, coalesce(array_to_string(aliases, '|'), '') AS aliases FROM ents", "ents"))
def node_properties(spark, d):
    """Records and maps don't reach the nodes."""
    rows = views.entities(spark, d).select("id", "name", "type", "start_year", "end_year", "aliases", "rec_id", F.struct("id").alias("raw"), F.create_map("id", "name").alias("labels"), F.array(F.struct("id")).alias("rows"))
    return graph.scalar_properties(rows, ("rec_id",)).withColumn("aliases", F.coalesce(F.concat_ws("|", "aliases"), F.lit("")))


# Plans of questions

_ASKED = """asked AS (SELECT id || ':' || k AS query_id, CASE k WHEN 1 THEN 'Ai lập ra ' || upper(name) || ' năm 1300?' WHEN 2 THEN 'Kể về thời ' || era_id || ' và năm 12' WHEN 3 THEN 'Năm ' || end_year || ' có việc gì?' ELSE 'Việc gì năm 1950?' END AS query, k, id, era_id, start_year, end_year FROM periods, (VALUES (1), (2), (3), (4)) v(k) WHERE k <> 3 OR end_year > 0)"""


@query(f"""WITH {_ASKED} SELECT query_id, CASE k WHEN 1 THEN start_year WHEN 2 THEN (SELECT min(start_year) FROM periods p WHERE p.era_id = a.era_id) WHEN 3 THEN end_year ELSE 1950 END AS low,
    CASE k WHEN 1 THEN end_year WHEN 2 THEN (SELECT max(end_year) FROM periods p WHERE p.era_id = a.era_id) WHEN 3 THEN end_year ELSE 1950 END AS high,
    CASE k WHEN 1 THEN id WHEN 2 THEN (SELECT string_agg(p.id, '|' ORDER BY p.id) FROM periods p WHERE p.era_id = a.era_id) WHEN 3 THEN (SELECT string_agg(p.id, '|' ORDER BY p.id) FROM periods p WHERE a.end_year BETWEEN p.start_year AND p.end_year) ELSE '' END AS periods, k = 4 AS out_of_scope FROM asked a""")
def question_plans(spark, d):
    """A period's name, an era's, or a year in a question; names outrank years, an era stands for its periods."""
    dim = views.periods(spark, d)
    kinds = dim.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]))).where("k <> 3 OR end_year > 0")
    text = F.when(F.col("k") == 1, F.concat(F.lit("Ai lập ra "), F.upper("name"), F.lit(" năm 1300?"))).when(F.col("k") == 2, F.concat(F.lit("Kể về thời "), "era_id", F.lit(" và năm 12"))).when(F.col("k") == 3, F.concat(F.lit("Năm "), F.col("end_year").cast("string"), F.lit(" có việc gì?"))).otherwise("Việc gì năm 1950?")
    asked = kinds.select(F.concat("id", F.lit(":"), F.col("k").cast("string")).alias("query_id"), text.alias("query"))
    eras = dim.select(F.col("era_id").alias("id"), F.concat(F.lit("thời "), "era_id").alias("alias")).distinct()
    return pipeline.plan_rules(asked, dim, eras=eras).withColumn("periods", F.concat_ws("|", F.array_sort("periods")))


@query("""SELECT item_id AS query_id, coalesce(CASE WHEN item_id % 3 = 0 THEN 1000 END, CASE WHEN item_id % 5 = 0 THEN 1400 END, CASE WHEN item_id % 2 = 0 THEN 1700 END) AS low, coalesce(CASE WHEN item_id % 3 = 0 THEN 1100 END, CASE WHEN item_id % 5 = 0 THEN 1500 END, CASE WHEN item_id % 2 = 0 THEN 1800 END) AS high,
    coalesce(CASE WHEN item_id % 7 = 0 THEN 'p02' END, period, '') AS periods FROM eval_items""")
def scope_precedence(spark, d):
    """Years: rules, then the user's filter, then the analyzer; periods: the analyzer, then rules."""
    items = table(spark, d, "eval_items")
    n, when = F.col("item_id"), lambda test, value: F.when(test, value)
    rules = items.select(n.alias("query_id"), when(n % 3 == 0, 1000).alias("low"), when(n % 3 == 0, 1100).alias("high"), F.array_compact(F.array("period")).alias("periods"))
    asked = items.select(n.alias("query_id"), when(n % 5 == 0, 1400).alias("low"), when(n % 5 == 0, 1500).alias("high"))
    told = items.select(n.alias("query_id"), when(n % 2 == 0, 1700).alias("low"), when(n % 2 == 0, 1800).alias("high"), F.when(n % 7 == 0, F.array(F.lit("p02"))).alias("periods"))
    return pipeline.choose_scope(rules, asked, told).withColumn("periods", F.concat_ws("|", "periods"))


@query("""SELECT query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS r FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e) WHERE r <= 10""")
def entity_vectors(spark, d):
    """The ten nearest of every twentieth vector among all, without a filter."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.vector_topk(rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), rows, 10).select("query_id", "id", "rank")


@query("""SELECT p.id AS period_id, s AS stem, b AS branch, CASE WHEN count(y) = 1 THEN min(y) END AS year FROM periods p, range(10) t1(s), range(12) t2(b) LEFT JOIN (SELECT unnest(generate_series(-3000, 2100)) AS y) ys
    ON y <> 0 AND y BETWEEN p.start_year AND p.start_year + 59 AND ((CASE WHEN y > 0 THEN y ELSE y + 1 END - 4) % 10 + 10) % 10 = s AND ((CASE WHEN y > 0 THEN y ELSE y + 1 END - 4) % 12 + 12) % 12 = b GROUP BY 1, 2, 3""")
def cycle_hints(spark, d):
    """The year of each stem and branch within sixty years of each period's beginning, where there is just one."""
    rows = table(spark, d, "periods").select(F.col("id").alias("period_id"), "start_year").withColumn("stem", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return rows.select("period_id", "stem", "branch", times.cycle_year(F.col("stem"), F.col("branch"), F.col("start_year"), F.col("start_year") + 59).alias("year"))


@query("""SELECT rec_id, n, y AS start, y AS "end", CASE WHEN a <> '' THEN 'approx' ELSE 'year' END AS "precision" FROM (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY i) AS n, CAST(regexp_extract(m, '(\\d+)$', 1) AS INTEGER) AS y, regexp_extract(m, '(?i)^(vào )?(khoảng|chừng|độ) ', 2) AS a
    FROM (SELECT rec_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT rec_id, regexp_extract_all(description, '(?i)(?:(?:vào )?(?:khoảng|chừng|độ) )?năm \\d{1,4}') AS ms FROM (SELECT DISTINCT rec_id, description FROM entities WHERE rec_id IS NOT NULL AND regexp_matches(description, '(?i)năm \\d') AND NOT regexp_matches(description, '(?i)năm \\d{5}|[/–—-]|\\d[.,]\\d|thế k|TCN|tháng|cách đây|công nguyên|thập niên|những năm|tuổi|đến|\\(')))) WHERE true)""")
def described_years(spark, d):
    """Years in descriptions that name them plainly, in order of place."""
    rows = table(spark, d, "entities").where("rec_id IS NOT NULL").select("rec_id", "description").distinct()
    rows = rows.where(r"description RLIKE '(?i)năm \\d' AND NOT description RLIKE '(?iu)năm \\d{5}|[/–—-]|\\d[.,]\\d|thế k|TCN|tháng|cách đây|công nguyên|thập niên|những năm|tuổi|đến|\\('")
    told = rows.select("rec_id", F.posexplode(times.spans(F.col("description"))).alias("_p", "s"))
    return told.select("rec_id", (F.col("_p") + 1).cast("long").alias("n"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.precision").alias("precision"))
