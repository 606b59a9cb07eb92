"""Queries of scalar text and year functions, and of event windows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from annales.functions import times
from annales.functions.sentences import ABBREVIATIONS
from annales.functions.text import MOVING, TONES, article_url, entity_label, estimate_tokens, guess_type, infobox_key, mention_query, nfc, normalize_key, old_tones, slug, strip_accents, year_label, year_range_label
from annales.operators.chunking import sentence_rows
from annales.plans import views
from annales.plans.queries_graph import _type_sql
from annales.plans.queries_search import TOKENS
from annales.plans.views import KEY, with_views
from annales.sources.tables import spread, table
from annales.streaming.resume import sessions, windowed_counts

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT DISTINCT rec_id, {KEY.format('name')} AS k FROM entities")
def normalized_keys(spark, d):
    return table(spark, d, "entities").select("rec_id", normalize_key(F.col("name")).alias("k")).distinct()


@query("SELECT DISTINCT id, coalesce(nullif(trim(regexp_replace(regexp_replace(strip_accents(replace(lower(replace(title, '_', '-')), 'đ', 'd')), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '-'), ''), 'entity') AS slug FROM (SELECT page_id AS id, title FROM articles WHERE title IS NOT NULL)")
def slugs(spark, d):
    return table(spark, d, "articles").where("title IS NOT NULL").select(F.col("page_id").alias("id"), slug(F.col("title")).alias("slug")).distinct()


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_size), '[\\s_]*[0-9]+$', '')) AS field FROM part")
def infobox_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", infobox_key(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))).alias("field"))


@query("SELECT DISTINCT triplet_id, nfc_normalize(evidence) AS evidence FROM triplets")
def composed_texts(spark, d):
    return table(spark, d, "triplets").select("triplet_id", nfc("evidence").alias("evidence")).distinct()


@query("SELECT DISTINCT page_id, strip_accents(replace(replace(title, 'đ', 'd'), 'Đ', 'D')) AS plain FROM articles")
def plain_titles(spark, d):
    return table(spark, d, "articles").select("page_id", strip_accents(F.col("title")).alias("plain")).distinct()


_Y = "CASE WHEN {0} IS NULL THEN '?' WHEN {0} < 0 THEN (-{0}) || ' TCN' ELSE CAST({0} AS VARCHAR) END"
_R = f"CASE WHEN start_year IS NULL THEN '' WHEN end_year IS NULL OR end_year = start_year THEN {_Y.format('start_year')} ELSE {_Y.format('start_year')} || '–' || {_Y.format('end_year')} END"


@query(with_views(f"SELECT id, {_Y.format('start_year')} AS label, {_R} AS span, name || CASE WHEN start_year IS NULL THEN '' ELSE ' (' || {_R} || ')' END || ' — ' || coalesce(type, 'Entity') AS entity FROM ents", "ents"))
def year_labels(spark, d):
    s, e = F.col("start_year"), F.col("end_year")
    return views.entities(spark, d).select("id", year_label(s).alias("label"), year_range_label(s, e).alias("span"), entity_label(F.col("name"), F.col("type"), s, e).alias("entity"))


@query(with_views(f"SELECT id, {_type_sql('name', 'NULL')} AS kind FROM ents", "ents"))
def guessed_types(spark, d):
    return views.entities(spark, d).select("id", guess_type(F.col("name")).alias("kind"))


@query("SELECT DISTINCT page_id, '\"' || replace(title, '\"', ' ') || '\"~' AS q FROM articles")
def mention_queries(spark, d):
    return table(spark, d, "articles").select("page_id", mention_query(F.col("title")).alias("q")).distinct()


_CENTURY = "CASE WHEN y < 0 THEN CAST(ceil(-y / 100.0) AS INTEGER) ELSE CAST(ceil(y / 100.0) AS INTEGER) END"


@query(f"SELECT y, CASE WHEN y < 0 THEN -100 * c ELSE 100 * c - 99 END AS low, CASE WHEN y < 0 THEN -100 * c + 99 ELSE 100 * c END AS high FROM (SELECT y, {_CENTURY} AS c FROM (SELECT DISTINCT start_year AS y FROM entities WHERE start_year <> 0 AND abs(start_year) < 50000))")
def century_bounds(spark, d):
    rows = table(spark, d, "entities").where("start_year <> 0 AND abs(start_year) < 50000").select(F.col("start_year").alias("y")).distinct()
    low, high = times.century_bounds(F.ceil(F.abs("y") / 100).cast("int"), F.col("y") < 0)
    return rows.select("y", low.alias("low"), high.alias("high"))


@query("SELECT y, ((CASE WHEN y > 0 THEN y ELSE y + 1 END - 4) % 10 + 10) % 10 AS stem, ((CASE WHEN y > 0 THEN y ELSE y + 1 END - 4) % 12 + 12) % 12 AS branch FROM (SELECT DISTINCT start_year AS y FROM entities WHERE start_year <> 0 AND abs(start_year) < 50000)")
def canchi_years(spark, d):
    rows = table(spark, d, "entities").where("start_year <> 0 AND abs(start_year) < 50000").select(F.col("start_year").alias("y")).distinct()
    stem, branch = times.cycle_names(F.col("y"))
    return rows.select("y", stem.alias("stem"), branch.alias("branch"))


@query("SELECT id, p.id AS period_id, p.start_year < -258 AND p.start_year % 50 <> 0 AS legendary FROM periods p")
def legendary_flag(spark, d):
    return table(spark, d, "periods").select("id", F.col("id").alias("period_id"), times.legendary(F.col("start_year"), F.lit("year")).alias("legendary"))


_N = "((abs(y) - 1) // size + 1)"


@query(f"""SELECT y, p, CASE WHEN size IS NOT NULL THEN CASE WHEN y < 0 THEN -{_N} * size ELSE ({_N} - 1) * size + 1 END WHEN p = 8 THEN CAST(floor(y / 10.0) AS INTEGER) * 10 ELSE y END AS low,
    CASE WHEN size IS NOT NULL THEN CASE WHEN y < 0 THEN -(({_N} - 1) * size + 1) ELSE {_N} * size END WHEN p = 8 THEN CAST(floor(y / 10.0) AS INTEGER) * 10 + 9 ELSE y END AS high
    FROM (SELECT y, p, CASE p WHEN 6 THEN 1000 WHEN 7 THEN 100 END AS size FROM (SELECT DISTINCT start_year AS y FROM entities WHERE start_year <> 0 AND abs(start_year) < 50000), (VALUES (6), (7), (8), (9)) v(p))""")
def wikidata_bounds(spark, d):
    rows = table(spark, d, "entities").where("start_year <> 0 AND abs(start_year) < 50000").select(F.col("start_year").alias("y")).distinct().withColumn("p", F.explode(F.array(*[F.lit(x) for x in (6, 7, 8, 9)])))
    stamp = F.concat(F.when(F.col("y") < 0, "-").otherwise("+"), F.abs("y").cast("string"), F.lit("-01-01T00:00:00Z"))
    low, high = times.dated_bounds(stamp, F.col("p"))
    return rows.select("y", "p", low.alias("low"), high.alias("high"))


@query()
def year_extract(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", times.spans(F.col("text")).alias("s"))
    return rows.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.start", "s.end", "s.precision", "s.legendary")


_BLANK = "\\s\\x{A0}\\x{85}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}\\x{B}"


def _sentences_sql() -> str:
    """Marks (1) behind abbreviations and single letters, then cuts (2) at stops before capitals and digits, and restores."""
    short = "|".join(a.replace(".", "\\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
    guarded = f"regexp_replace(l, '(^|[{_BLANK}])({short}|\\p{{L}})([.!?…])', '\\1\\2' || chr(1) || '\\3', 'gi')"
    # Neighbours share a blank, so marking is done twice.
    guarded = f"regexp_replace({guarded}, '(^|[{_BLANK}])({short}|\\p{{L}})([.!?…])', '\\1\\2' || chr(1) || '\\3', 'gi')"
    cut = "regexp_replace({0}, '(^|[^\\x{{01}}.!?…])([.!?…]+[\"”’»)\\]]*)[" + _BLANK.replace("{", "{{").replace("}", "}}") + "]+([\"“‘«(\\[]?[\\p{{Lu}}\\p{{Nd}}])', '\\1\\2' || chr(2) || '\\3', 'g')"
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos, s AS sentence FROM (
        SELECT doc_id, i, j, regexp_replace(replace(p[j], chr(1), ''), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS s FROM (SELECT doc_id, i, p, unnest(generate_series(1, len(p))) AS j FROM (
        SELECT doc_id, i, string_split({cut.format(cut.format(guarded))}, chr(2)) AS p FROM (SELECT doc_id, ls[i] AS l, i FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))))) WHERE s <> ''"""


@query(_sentences_sql())
def sentences(spark, d):
    return sentence_rows(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


def _old_tone_sql(column: str) -> str:
    """Each of the fifteen pairs of vowels and marks, small and with a capital, at the end of a syllable and not behind q."""
    out = column
    for first, second in MOVING:
        for mark in TONES:
            new, old = (unicodedata.normalize("NFC", x) for x in (first + second + mark, first + mark + second))
            for a, b in ((new, old), (new.capitalize(), old.capitalize())):
                out = f"regexp_replace({out}, '(^|[^qQ]){a}($|[^\\p{{L}}])', '\\1{b}\\2', 'g')"
    return out


_KEPT_SIGNS = "/:()',"
_URL = "url_encode(replace(nfc_normalize(title), ' ', '_'))"
for _c in _KEPT_SIGNS:
    _URL = f"replace({_URL}, '%{ord(_c):02X}', '{_c if _c != chr(39) else _c * 2}')"


@query(f"SELECT DISTINCT page_id, {_old_tone_sql('nfc_normalize(title)')} AS title, 'https://vi.wikipedia.org/wiki/' || {_URL.replace('nfc_normalize(title)', 'title')} AS url FROM articles")
def tone_titles(spark, d):
    return table(spark, d, "articles").select("page_id", old_tones("title").alias("title"), article_url("title").alias("url")).distinct()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"))


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def event_sessions(spark, d):
    return sessions(table(spark, d, "events"))
