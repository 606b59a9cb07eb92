"""Queries of vector and full-text search, fusion, linking and context."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.functions.text import estimate_tokens
from annales.operators import context, search
from annales.operators.chunking import passages
from annales.plans import pipeline, views
from annales.plans.queries_graph import in_period_fallback
from annales.plans.views import with_views
from annales.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def bm25_sql(asked: str, docs: str, k: int, item: str = "id", name: str = "bm") -> str:
    """CTEs up to `name` (query_id, item, score, rank); `asked` has query_id, query, `docs` has item, text."""
    split = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""{name}_q AS (SELECT DISTINCT query_id, unnest({split.format('query')}) AS term FROM {asked}),
    {name}_d AS (SELECT {item}, w, len(w) AS length FROM (SELECT {item}, {split.format('text')} AS w FROM {docs} WHERE text IS NOT NULL) WHERE len(w) > 0),
    {name}_s AS (SELECT count(*) AS n, avg(length) AS mean FROM {name}_d),
    {name}_t AS (SELECT term, {item}, count(*) AS tf, any_value(length) AS length FROM (SELECT {item}, length, unnest(w) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY 1, 2),
    {name}_f AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY 1),
    {name}_r AS (SELECT query_id, {item}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM {name}_t JOIN {name}_f USING (term) JOIN {name}_q USING (term), {name}_s GROUP BY 1, 2),
    {name} AS MATERIALIZED (SELECT query_id, {item}, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item}) AS r FROM {name}_r) WHERE r <= {k})"""


VECTOR = "vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), vd AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    # The query set of a search: every row whose id is divisible by 20.
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), rows


@query(f"WITH {VECTOR} SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT vq.query_id, vd.id, round(list_cosine_similarity(vq.v, vd.v), 6) AS score FROM vq, vd)) WHERE r <= 10")
def vector_topk(spark, d):
    asked, rows = _vectors(spark, d)
    return search.vector_topk(asked, rows, 10)


@query(f"WITH {VECTOR} SELECT query_id, id, score, CAST(r2 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r2 FROM (SELECT query_id, id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT vq.query_id, vd.id, vd.label, round(list_cosine_similarity(vq.v, vd.v), 6) AS score FROM vq, vd)) WHERE r <= 40 AND label <= 4) WHERE r2 <= 10")
def vector_topk_postfilter(spark, d):
    asked, rows = _vectors(spark, d)
    return search.vector_topk(asked, rows, 10, where=F.col("label") <= 4, post_filter=True)


ASKED = "asked AS (SELECT item_id AS query_id, question AS query FROM eval_items), docs AS (SELECT doc_id AS id, text FROM documents)"


def _asked(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {ASKED}, {bm25_sql('asked', 'docs', 10)} SELECT query_id, id, score, rank FROM bm")
def bm25_topk(spark, d):
    return search.bm25_topk(_asked(spark, d), _docs(spark, d), 10)


VQ = "vq AS (SELECT i.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS v FROM eval_items i JOIN embeddings e ON e.vec_id = i.item_id), vs AS MATERIALIZED (SELECT query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT vq.query_id, e.vec_id AS id, round(list_cosine_similarity(vq.v, CAST(e.embedding AS DOUBLE[])), 6) AS score FROM vq, embeddings e)) WHERE r <= 20)"


def _fused_sql(lists: list[tuple[str, float]], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, {w} / (60 + rank) AS s, ({n}, rank) AS f FROM {name}" for n, (name, w) in enumerate(lists))
    return f"SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, id) AS r FROM (SELECT query_id, id, round(sum(s), 9) AS score, min(f) AS f FROM ({union}) GROUP BY 1, 2)) WHERE r <= {k}"


def _by_vector(spark, d):
    """Vectors of documents are those with their number; a question's that with its item's."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = table(spark, d, "eval_items").select("item_id").join(rows, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), "vector")
    return search.vector_topk(asked, rows, 20)


@query(f"WITH {ASKED}, {VQ}, {bm25_sql('asked', 'docs', 20)} {_fused_sql([('vs', 1.0), ('bm', 1.0)], 20)}")
def hybrid_search(spark, d):
    """Vector and full-text lists of every question, fused."""
    ranked = search.bm25_topk(_asked(spark, d), _docs(spark, d), 20)
    return search.rrf([(_by_vector(spark, d), 1.0), (ranked, 1.0)]).where(F.col("rank") <= 20)


LISTS = """la AS (SELECT period_id AS query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT period_id, id, row_number() OVER (PARTITION BY period_id ORDER BY tokens DESC NULLS LAST, id) AS r FROM chks WHERE period_id IS NOT NULL) WHERE r <= 20),
    lb AS (SELECT period_id AS query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT period_id, id, row_number() OVER (PARTITION BY period_id ORDER BY min_year NULLS LAST, id) AS r FROM chks WHERE period_id IS NOT NULL) WHERE r <= 20),
    lc AS (SELECT period_id AS query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT period_id, id, row_number() OVER (PARTITION BY period_id ORDER BY chunk_index DESC NULLS LAST, id) AS r FROM chks WHERE period_id IS NOT NULL) WHERE r <= 20)"""


def _lists(spark, d):
    """Three rankings of every period's chunks: the longest, the earliest, the last."""
    rows = views.chunks(spark, d).where("period_id IS NOT NULL").select(F.col("period_id").alias("query_id"), "id", "tokens", "min_year", "chunk_index")
    out = []
    for order in (F.col("tokens").desc_nulls_last(), F.col("min_year").asc_nulls_last(), F.col("chunk_index").desc_nulls_last()):
        window = Window.partitionBy("query_id").orderBy(order, "id")
        out.append(rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= 20).select("query_id", "id", "rank"))
    return out


@query(with_views(_fused_sql([("la", 1.0), ("lb", 1.0)], 1000), "chks", extra=LISTS))
def rrf_two_lists(spark, d):
    a, b, _ = _lists(spark, d)
    return search.rrf([(a, 1.0), (b, 1.0)])


_WEIGHTS = "CASE p.position % 6 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(6)) + " END"
_KINDS = ("factoid", "multihop", "temporal", "relational", "comparison", "overview")


def _intent_sql() -> str:
    from annales.config import DEFAULT

    parts = []
    for n, name in enumerate(("la", "lb", "lc")):
        weight = _WEIGHTS.format(*[DEFAULT.fusion[k][n] for k in _KINDS])
        parts.append(f"SELECT query_id, l.id, {weight} AS w, rank, ({n}, rank) AS f FROM {name} l JOIN pers p ON p.id = l.query_id")
    return f"SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, id) AS INTEGER) AS rank FROM (SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score, min(f) AS f FROM ({' UNION ALL '.join(parts)}) WHERE w > 0 GROUP BY 1, 2)"


@query(with_views(_intent_sql(), "chks", "pers", extra=LISTS))
def rrf_intent_weights(spark, d):
    intents = F.array(*[F.lit(k) for k in _KINDS])
    plans = views.periods(spark, d).select(F.col("id").alias("query_id"), F.element_at(intents, (F.col("position") % 6 + 1).cast("int")).alias("intent"))
    return search.rrf_by_intent(plans, _lists(spark, d))


@query(with_views(f"SELECT query_id, id, CASE WHEN e.chunk_id IS NULL THEN score ELSE round(score * 1.3, 9) END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN e.chunk_id IS NULL THEN score ELSE round(score * 1.3, 9) END DESC, rank) AS INTEGER) AS rank FROM ({_fused_sql([('la', 1.0), ('lb', 1.0)], 1000)}) LEFT JOIN (SELECT DISTINCT chunk_id FROM trips WHERE chunk_id IS NOT NULL) e ON e.chunk_id = id", "chks", "trips", extra=LISTS))
def evidence_boost(spark, d):
    ranked = rrf_two_lists(spark, d)
    known = views.triplets(spark, d).where("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("id")).distinct()
    evidence = ranked.select("query_id", "id").join(known, "id", "left_semi")
    return search.boost_evidence(ranked, evidence)


MENTIONS = "asked AS (SELECT item_id AS query_id, answer_keywords[1] AS query FROM eval_items WHERE answer_keywords[1] IS NOT NULL), nm AS (SELECT id, name AS text FROM ents)"


def _mentions(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.try_element_at("answer_keywords", F.lit(1)).alias("query"), "period").where("query IS NOT NULL")


@query(with_views("SELECT query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY g.id IS NOT NULL DESC, b.rank) AS r FROM bm b LEFT JOIN (SELECT DISTINCT e.item_id AS query_id, i.id FROM eval_items e JOIN inper i ON i.period_id = e.period) g ON g.query_id = b.query_id AND g.id = b.id) WHERE r <= 2", "inper", extra=f"{MENTIONS}, {bm25_sql('asked', 'nm', 10)}"))
def link_prefer_period(spark, d):
    asked = _mentions(spark, d)
    ranked = search.bm25_topk(asked.select("query_id", "query"), views.entities(spark, d).select("id", F.col("name").alias("text")), 10)
    wanted = asked.where("period IS NOT NULL").select("query_id", F.col("period").alias("period_id"))
    return search.prefer_periods(ranked, in_period_fallback(spark, d), wanted)


_EACH = "asked AS (SELECT item_id || '#' || (i - 1) AS query_id, answer_keywords[i] AS query FROM (SELECT item_id, answer_keywords, unnest(generate_series(1, len(answer_keywords))) AS i FROM eval_items) WHERE answer_keywords[i] IS NOT NULL), nm AS (SELECT id, name AS text FROM ents)"


@query(with_views("SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, id) AS INTEGER) AS rank FROM (SELECT split_part(query_id, '#', 1) AS query_id, id, min((CAST(split_part(query_id, '#', 2) AS INTEGER), rank)) AS f FROM bm WHERE rank <= 2 GROUP BY 1, 2)", "ents", extra=f"{_EACH}, {bm25_sql('asked', 'nm', 10)}"))
def link_all(spark, d):
    rows = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), F.posexplode("answer_keywords").alias("position", "mention"))
    return search.link_mentions(rows, views.entities(spark, d).select("id", F.col("name").alias("text")))


TOKENS = "CAST(coalesce(ceil(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) * 1.4::DOUBLE), 0) AS INTEGER)"


@query(with_views(f"SELECT query_id, id, CAST(n AS INTEGER) AS n, used_tokens FROM (SELECT query_id, l.id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, sum({TOKENS}) OVER (PARTITION BY query_id ORDER BY rank) AS used_tokens FROM lb l JOIN chks c ON c.id = l.id) WHERE n <= 8 AND (used_tokens <= 1200 OR n = 1)", "chks", extra=LISTS))
def context_budget(spark, d):
    rows = _lists(spark, d)[1].join(views.chunks(spark, d).select("id", "text"), "id").withColumn("tokens", estimate_tokens(F.col("text")))
    return context.within_budget(rows).select("query_id", "id", "n", F.col("used_tokens").cast("decimal(38,0)").alias("used_tokens"))


def _cited(spark, d):
    rows = _lists(spark, d)[1].join(views.chunks(spark, d).select("id", "text"), "id").withColumn("tokens", estimate_tokens(F.col("text")))
    return context.within_budget(rows)


_CITED = f"cited AS (SELECT query_id, id, CAST(n AS INTEGER) AS n FROM (SELECT query_id, l.id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, sum({TOKENS}) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM lb l JOIN chks c ON c.id = l.id) WHERE n <= 8 AND (used <= 1200 OR n = 1))"
_YEAR = "CASE WHEN {0} < 0 THEN (-{0}) || ' TCN' ELSE CAST({0} AS VARCHAR) END"


@query(with_views(f"""SELECT query_id, edge_id, head || ' —' || rel || CASE WHEN detail = '' THEN '' ELSE '(' || detail || ')' END || '→ ' || tail || coalesce(' ' || cites, '') AS line FROM (
    SELECT c.query_id, g.edge_id, h.name AS head, g.rel, x.name AS tail, concat_ws(', ', nullif(g.role, ''), CASE WHEN coalesce(g.start_year, 0) <> 0 THEN {_YEAR.format('g.start_year')} END) AS detail, c.cites FROM (
    SELECT query_id, edge_id, array_to_string(list_transform(list_sort(list_distinct(list(n))), lambda v: '[' || v || ']'), '') AS cites FROM (SELECT edge_id, unnest(evidence) AS chunk_id FROM edgs) e JOIN cited ON cited.id = e.chunk_id GROUP BY 1, 2) c
    JOIN edgs g USING (edge_id) JOIN ents h ON h.id = g.src JOIN ents x ON x.id = g.dst WHERE h.name IS NOT NULL AND x.name IS NOT NULL)""", "chks", "edgs", "ents", extra=f"{LISTS}, {_CITED}"))
def citations_join(spark, d):
    cited = _cited(spark, d)
    edges = views.edges(spark, d)
    near = edges.select("edge_id", F.explode("evidence").alias("id")).join(cited.select("query_id", "id"), "id").select("query_id", "edge_id").distinct()
    names = views.entities(spark, d).where("name IS NOT NULL").select("id", "name")
    rows = near.join(edges, "edge_id").join(names.select(F.col("id").alias("src"), F.col("name").alias("head")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("tail")), "dst")
    return context.relation_lines(rows, cited)


@query(with_views("SELECT DISTINCT i.period_id AS query_id, e.start_year, e.name FROM inper i JOIN ents e USING (id) WHERE e.start_year IS NOT NULL", "inper"))
def timeline(spark, d):
    rows = in_period_fallback(spark, d).join(views.entities(spark, d), "id").select(F.col("period_id").alias("query_id"), "start_year", "name")
    return context.timeline(rows)


@query(f"SELECT e.item_id AS query_id, coalesce('Giai đoạn: ' || p.name || ' (' || {_YEAR.format('p.start_year')} || '–' || {_YEAR.format('p.end_year')} || ')', '{context.EVERYTHING}') AS line FROM eval_items e LEFT JOIN periods p ON p.id = e.period")
def scope_lines(spark, d):
    plans = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.array_compact(F.array("period")).alias("periods"))
    return context.scope_lines(plans, table(spark, d, "periods"))


HISTORY = "h AS (SELECT user_id AS conv_id, event_id AS turn, CASE WHEN event_type = 'click' THEN 'assistant' ELSE 'user' END AS role, event_type || ' ' || props AS text FROM events)"


def _history(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "click", "assistant").otherwise("user").alias("role"), F.concat("event_type", F.lit(" "), "props").alias("text"))


@query(f"WITH {HISTORY} SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM h WHERE role = 'user') WHERE r <= 6")
def history_last6(spark, d):
    return context.recent_turns(_history(spark, d), 6, ("user",))


@query(f"WITH {HISTORY} SELECT conv_id, text, CAST(r AS INTEGER) AS rank FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY max(turn) DESC) AS r FROM h WHERE role = 'user' GROUP BY 1, 2) WHERE r <= 6")
def recent_questions(spark, d):
    return context.recent_questions(_history(spark, d))


@query(f"WITH {HISTORY} SELECT conv_id FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE contains(lower(text), 'purchase')) > 0")
def chat_search(spark, d):
    chats = _history(spark, d).groupBy("conv_id").agg(F.collect_set("text").alias("messages")).withColumn("title", F.lit(""))
    return context.search_chats(chats, "Purchase").select("conv_id")


_WINDOWS = """WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{A0}\\x{85}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}\\x{B}]+', ' ', 'g')) AS x FROM documents),
    w AS (SELECT doc_id, x, 0 AS b, 1 AS n, CASE WHEN len(x) <= 700 THEN len(x) ELSE coalesce(nullif(350 + 350 - strpos(reverse(x[351:700]), ' .'), 700), 700) END AS e FROM t WHERE len(x) > 0
    UNION ALL SELECT doc_id, x, nb, n + 1, CASE WHEN len(x) <= nb + 700 THEN len(x) ELSE coalesce(nullif(nb + 700 - strpos(reverse(x[nb + 351:nb + 700]), ' .'), nb + 700), nb + 700) END FROM (SELECT *, greatest(e - 120, b + 1) AS nb FROM w WHERE e < len(x)))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS n, len(p) AS chars FROM (SELECT doc_id, n, trim(x[b + 1:e]) AS p FROM w) WHERE p <> ''"""


@query(_WINDOWS)
def doc_passages(spark, d):
    return passages(table(spark, d, "documents"), "doc_id").select("doc_id", "n", F.length("passage").alias("chars"))


@query()
def answers(spark, d):
    """Every evaluation question answered from its text alone: rules, linking, search by words and vectors, graph, paths, fusion, context, extractive answer."""
    return pipeline.answer(_questions(spark, d), pipeline.open_store(spark, d))


def _questions(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), F.col("question").alias("query"))


@query()
def retrieved(spark, d):
    """What each answer rests on: chunks in order, and how many lines its context has."""
    found = pipeline.retrieve(_questions(spark, d), pipeline.open_store(spark, d))
    lines = found.context.select("query_id", F.size(F.split("context", "\n")).alias("lines"))
    return found.chunks.select("query_id", "id", "rank", "score").join(lines, "query_id")


@query()
def document_answers(spark, d):
    """Every evaluation question put to all documents as to texts of one's own."""
    return pipeline.ask_documents(_questions(spark, d), table(spark, d, "documents").select("doc_id", "text")).select("query_id", "answer", F.length("context").alias("chars"))
