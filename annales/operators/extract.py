"""Triplets from structured sources, and their validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.config import DEFAULT, Config
from annales.functions.fuzzy import partial_similarity
from annales.functions.text import guess_type, infobox_key, normalize_key
from annales.sources.files import memo_key

#: Relations with the types of their heads and tails (fixed values).
ONTOLOGY = {
    "CHILD_OF": (("Person",), ("Person",)), "SPOUSE_OF": (("Person",), ("Person",)), "MEMBER_OF": (("Person",), ("Polity", "Organization")), "BORN_IN": (("Person",), ("Place",)),
    "DIED_IN": (("Person",), ("Place",)), "RULED": (("Person",), ("Polity",)), "RULED_OVER": (("Polity", "Person"), ("Place", "Polity")), "SUCCEEDED": (("Person", "Polity", "Culture"), ("Person", "Polity", "Culture")),
    "FOUNDED": (("Person",), ("Polity", "Organization", "Place")), "CAPITAL_OF": (("Place",), ("Polity",)), "COMMANDED": (("Person",), ("Event",)), "PARTICIPATED_IN": (("Person", "Polity", "Organization"), ("Event",)),
    "OPPOSED": (("Person", "Polity", "Organization"), ("Person", "Polity", "Organization")), "OCCUPIED": (("Polity",), ("Place", "Polity")), "OCCURRED_AT": (("Event",), ("Place",)), "PART_OF": (("Event", "Place"), ("Event", "Place")),
    "CAUSED": (("Event",), ("Event",)), "LED_TO": (("Event",), ("Event",)), "SIGNED": (("Person", "Polity"), ("Event",)), "AUTHORED": (("Person",), ("Work",)), "FOUND_AT": (("Culture",), ("Place",)),
}
#: Wikidata properties as relations; True where the value is the head (fixed values).
PROPERTIES = {
    "P22": ("CHILD_OF", False), "P25": ("CHILD_OF", False), "P26": ("SPOUSE_OF", False), "P40": ("CHILD_OF", True), "P1365": ("SUCCEEDED", False), "P1366": ("SUCCEEDED", True), "P155": ("SUCCEEDED", False),
    "P156": ("SUCCEEDED", True), "P276": ("OCCURRED_AT", False), "P710": ("PARTICIPATED_IN", True), "P607": ("PARTICIPATED_IN", False), "P112": ("FOUNDED", True), "P36": ("CAPITAL_OF", True), "P19": ("BORN_IN", False),
    "P20": ("DIED_IN", False), "P50": ("AUTHORED", True), "P463": ("MEMBER_OF", False), "P361": ("PART_OF", False), "P527": ("PART_OF", True),
}
#: Infobox fields by template; True where the value is the head (fixed values).
INFOBOX = {
    "hộp thông tin xung đột quân sự": {"chỉ huy": ("COMMANDED", True), "bên tham chiến": ("PARTICIPATED_IN", True), "địa điểm": ("OCCURRED_AT", False), "phần của": ("PART_OF", False)},
    "thông tin nhân vật hoàng gia": {"tiền nhiệm": ("SUCCEEDED", False), "kế nhiệm": ("SUCCEEDED", True), "thân phụ": ("CHILD_OF", False), "thân mẫu": ("CHILD_OF", False), "phối ngẫu": ("SPOUSE_OF", False), "triều đại": ("RULED", False)},
    "thông tin quốc gia cũ": {"thủ đô": ("CAPITAL_OF", True)},
}
#: Infobox values that say nothing (fixed values).
PLACEHOLDERS = ("", "không có", "không rõ", "không", "?", "chưa rõ")


def ontology_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, list(d), list(g)) for r, (d, g) in ONTOLOGY.items()], "relation string, domain array<string>, range array<string>")


def _triplet(rel: Column, value_heads: Column, page: Column, value: Column) -> list[Column]:
    return [F.when(value_heads, value).otherwise(page).alias("head"), rel.alias("relation"), F.when(value_heads, page).otherwise(value).alias("tail")]


def from_wikidata(articles: DataFrame) -> DataFrame:
    """Triplets of articles (title, page_id, start_year, end_year, rels map, labels map), confidence 0.95.

    Values without a label keep their number; those equal to the title are dropped.
    """
    spark = articles.sparkSession
    rules = F.broadcast(spark.createDataFrame([(p, r, h) for p, (r, h) in PROPERTIES.items()], "prop string, relation string, value_heads boolean"))
    listed = articles.select("title", "page_id", "start_year", "end_year", "labels", F.explode("rels").alias("prop", "_ids")).select("*", F.explode("_ids").alias("_id"))
    rows = listed.join(rules, "prop").withColumn("_v", F.coalesce(F.try_element_at("labels", F.col("_id"))["label"], F.col("_id")))
    rows = rows.where(normalize_key(F.col("_v")) != normalize_key(F.col("title")))
    return rows.select(*_triplet(F.col("relation"), F.col("value_heads"), F.col("title"), F.col("_v")), "start_year", "end_year", F.col("title").alias("year_target"), F.lit(0.95).alias("confidence"), F.lit("wikidata").alias("source"), F.col("page_id").alias("article_id"))


def unmapped_properties(articles: DataFrame) -> DataFrame:
    """(prop, n): values of properties that no rule maps."""
    known = articles.sparkSession.createDataFrame([(p,) for p in PROPERTIES], "prop string")
    return articles.select(F.explode("rels").alias("prop", "_ids")).join(F.broadcast(known), "prop", "left_anti").groupBy("prop").agg(F.sum(F.size("_ids")).alias("n"))


def from_infobox(articles: DataFrame, rules: Mapping[str, Mapping[str, tuple[str, bool]]] = INFOBOX) -> DataFrame:
    """Triplets of articles (title, page_id, start_year, end_year, template, fields map), confidence 0.95; one per line of a field."""
    spark = articles.sparkSession
    table = spark.createDataFrame([(t, f, r, h) for t, fields in rules.items() for f, (r, h) in fields.items()], "_t string, _f string, relation string, value_heads boolean")
    rows = articles.select("title", "page_id", "start_year", "end_year", normalize_key(F.col("template")).alias("_t"), F.explode("fields").alias("_name", "_text")).withColumn("_f", infobox_key(F.col("_name")))
    lines = rows.join(F.broadcast(table), ["_t", "_f"]).withColumn("_v", F.explode(F.split("_text", "\n")))
    lines = lines.withColumn("_v", F.trim(F.regexp_replace("_v", r"\s*\([^()]*\)", "")))
    lines = lines.where(~normalize_key(F.col("_v")).isin(*PLACEHOLDERS) & (normalize_key(F.col("_v")) != normalize_key(F.col("title"))))
    return lines.select(*_triplet(F.col("relation"), F.col("value_heads"), F.col("title"), F.col("_v")), "start_year", "end_year", F.col("title").alias("year_target"), F.lit(0.95).alias("confidence"), F.lit("infobox").alias("source"), F.col("page_id").alias("article_id"))


def from_backbone(capitals: DataFrame | None, lists: DataFrame | None) -> DataFrame:
    """Triplets of curated lists, confidence 1.

    capitals: place, polity, start_year, end_year. lists (dynasties and names of
    states): section, position, name, founder, ruler, capital, predecessor,
    successor, start_year, end_year. Each entry gives what it names; neighbours
    of a section succeed each other unless the later one names the earlier as
    its predecessor already. Null fields give nothing; years stay on the edge.
    """
    parts = []
    shape = ["head", "relation", "tail", "start_year", "end_year"]
    if capitals is not None:
        parts.append(capitals.where("place IS NOT NULL AND polity IS NOT NULL").select(F.col("place").alias("head"), F.lit("CAPITAL_OF").alias("relation"), F.col("polity").alias("tail"), "start_year", "end_year"))
    if lists is not None:
        named = lists.where("name IS NOT NULL")
        told = [("founder", "FOUNDED", True), ("ruler", "RULED", True), ("capital", "CAPITAL_OF", True), ("predecessor", "SUCCEEDED", False), ("successor", "SUCCEEDED", True)]
        # A field is the head of its triplet, or the name is.
        each = F.array(*[F.struct((F.col(c) if head else F.col("name")).alias("head"), F.lit(r).alias("relation"), (F.col("name") if head else F.col(c)).alias("tail")) for c, r, head in told])
        rows = named.select(F.explode(each).alias("_t"), "start_year", "end_year").select("_t.*", "start_year", "end_year")
        parts.append(rows.where("head IS NOT NULL AND tail IS NOT NULL AND (relation <> 'SUCCEEDED' OR head <> tail)"))
        order = Window.partitionBy("section").orderBy("position")
        chained = lists.withColumn("_before", F.lag("name").over(order)).where("name IS NOT NULL AND _before IS NOT NULL AND _before <> name AND NOT predecessor <=> _before")
        parts.append(chained.select(F.col("name").alias("head"), F.lit("SUCCEEDED").alias("relation"), F.col("_before").alias("tail"), "start_year", "end_year"))
    if not parts:
        raise ValueError("no list")
    out = parts[0].select(*shape)
    for part in parts[1:]:
        out = out.unionByName(part.select(*shape))
    return out.select(*shape, F.lit(None).cast("string").alias("year_target"), F.lit(1.0).alias("confidence"), F.concat(F.lit("backbone:"), "head", F.lit(" "), "relation", F.lit(" "), "tail").alias("evidence"), F.lit("backbone").alias("source"))


def structured(backbone: DataFrame, articles: DataFrame, parts: Mapping[str, DataFrame], period: str | None = None, era: str | None = None, periods: DataFrame | None = None) -> DataFrame:
    """Triplets that need no model: the backbone whole, and those of `parts` (name of source -> triplets with article_id) whose article lies in the period or era.

    articles: page_id, period_id[, era_id]. An era stands for its periods in the
    table of periods; one that the table lacks is compared with era_id. `source`
    is rewritten to the part's name.
    """
    shape = ["head", "relation", "tail", "start_year", "end_year", "year_target", "confidence", "source"]
    kept = articles
    if period is not None:
        kept = kept.where(F.col("period_id") == period)
    if era is not None:
        inside = F.col("era_id") == era if "era_id" in kept.columns else F.lit(False)
        if periods is not None:
            of_era = F.broadcast(periods.where(F.col("era_id") == era).select(F.col("id").alias("period_id"), F.lit(True).alias("_in")))
            kept = kept.join(of_era, "period_id", "left")
            inside = F.coalesce("_in", inside, F.lit(False))
        kept = kept.where(inside)
    out = backbone.select(*shape)
    for name, rows in parts.items():
        if period is not None or era is not None:
            rows = rows.join(kept.select(F.col("page_id").alias("article_id")).distinct(), "article_id", "left_semi")
        out = out.unionByName(rows.withColumn("source", F.lit(name)).select(*shape))
    return out


def with_period_context(chunks: DataFrame, periods: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with what a prompt says of their period: name, era and the `extra` lists (roles, polities); null where it is unknown."""
    dim = periods.select(F.col("id").alias("period_id"), F.col("name").alias("period_name"), F.col("era_id").alias("period_era"), *extra)
    return chunks.join(F.broadcast(dim), "period_id", "left")


def applicable_relations(entities: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, relations): relations, as lines of a prompt, whose head and tail types both occur among a chunk's entities (key, type)."""
    rules = F.broadcast(ontology_table(entities.sparkSession))
    present = entities.where("type IS NOT NULL").groupBy(key).agg(F.collect_set("type").alias("_types"))
    # A chunk's types lie in a set of fixed size; the ontology is a constant.
    rows = present.join(rules, F.arrays_overlap("_types", "domain") & F.arrays_overlap("_types", "range"))
    listed = lambda c: F.concat_ws("/", F.array_sort(F.array_intersect(c, "_types")))
    line = F.concat(F.lit("- "), "relation", F.lit(": ("), listed("domain"), F.lit(") -> ("), listed("range"), F.lit(")"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("relations"))


#: Most roles, polities and links that a prompt hints at.
HINTS = {"roles": 8, "polities": 6, "links": 10}


def prompts(chunks: DataFrame, entities: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, prompt): what a model is asked about a chunk: its header, text and hints; in a second pass also its entities and the relations these allow.

    chunks: key, header, text and, as they exist, period_name, roles, polities,
    links. entities: chunk_id, name, type.
    """
    have = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    hint = [F.concat(F.lit(f"{name}: "), F.nullif(F.concat_ws(", ", F.slice(name, 1, n)), F.lit(""))) for name, n in HINTS.items() if name in chunks.columns]
    period = F.concat(F.lit("period: "), have("period_name"))
    rows = chunks.withColumn("_hints", F.concat_ws("\n", period, *hint))
    told = [F.col("header"), F.col("text")] if "header" in chunks.columns else [F.col("text")]
    if entities is not None:
        lines = entities.where("name IS NOT NULL AND type IS NOT NULL").groupBy(F.col("chunk_id").alias(key)).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")")))).alias("_e"))
        allowed = applicable_relations(entities.withColumnRenamed("chunk_id", key), key)
        rows = rows.join(lines, key, "left").join(allowed, key, "left")
        told += [F.concat(F.lit("ENTITIES:\n"), F.concat_ws("\n", "_e")), F.concat(F.lit("RELATIONS:\n"), F.concat_ws("\n", "relations"))]
    filled = [F.nullif(c, F.lit("")) for c in [*told, F.col("_hints")]]
    return rows.select(key, F.concat_ws("\n\n", *filled).alias("prompt"))


def two_passes(chunks: DataFrame, find: Callable[[DataFrame], DataFrame], relate: Callable[[DataFrame], DataFrame], key: str = "id", version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(entities, triplets) of chunks by two calls of plug-ins.

    `find` maps rows (key, call_key, prompt) to (key, name, type), `relate` rows
    of the second prompt to triplets with the key. The second call's key holds a
    hash of the entities found, so that another first result isn't answered from
    a memo.
    """
    first = prompts(chunks, key=key).withColumn("call_key", memo_key(F.lit(version), F.col(key), F.col("prompt")))
    found = find(first).withColumnRenamed(key, "chunk_id")
    seen = found.groupBy("chunk_id").agg(F.substring(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("name", "type")))), 256), 1, 16).alias("_h"))
    second = prompts(chunks, found, key).join(seen.withColumnRenamed("chunk_id", key), key)
    return found, relate(second.select(key, memo_key(F.lit(version), F.col(key), F.col("_h"), F.col("prompt")).alias("call_key"), "prompt"))


def summary(chunks: DataFrame, done: DataFrame, judged: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row of counts of an extraction: chunks, skipped, processed, failed, triplets, accepted, rejected.

    chunks: id; done: chunk_id of former runs; judged: chunk_id, reasons of this one.
    """
    one = lambda df, *cols: df.agg(*cols)
    skipped = chunks.select("id").distinct().join(done.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    parts = [one(chunks, F.count_distinct("id").alias("chunks")), one(skipped, F.count(F.lit(1)).alias("skipped"))]
    parts.append(one(judged, F.count_distinct("chunk_id").alias("processed"), F.count(F.lit(1)).alias("triplets"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected")))
    parts.append(one(failed, F.count_distinct("chunk_id").alias("failed")) if failed is not None else one(judged.limit(0), F.count(F.lit(1)).alias("failed")))
    out = parts[0]
    for part in parts[1:]:
        # Rows of one each.
        out = out.join(F.broadcast(part), F.lit(True), "inner")
    return out


def succession(items: DataFrame, group: str, position: str, name: str = "name", explicit: str | None = None) -> DataFrame:
    """(head, relation, tail): each of two neighbours in a list succeeds the one before, unless it names another or itself."""
    order = Window.partitionBy(group).orderBy(position)
    rows = items.withColumn("_before", F.lag(name).over(order)).where(F.col("_before").isNotNull() & (F.col("_before") != F.col(name)))
    if explicit is not None:
        rows = rows.where(F.col(explicit).isNull())
    return rows.select(F.col(name).alias("head"), F.lit("SUCCEEDED").alias("relation"), F.col("_before").alias("tail"))


def reasons(triplets: DataFrame, config: Config = DEFAULT, fuzzy: bool = True) -> DataFrame:
    """Triplets (head, relation, tail, evidence, start_year, end_year, confidence, chunk_text, head_type, tail_type) with `reasons`, empty for good ones.

    Types that are null are guessed from the name; unknown types pass. Evidence
    must stand in the chunk, nearly at least: the exact test runs in the JVM,
    only what it leaves undecided is measured. `fuzzy=False` asks for exact
    evidence.
    """
    rules = F.broadcast(ontology_table(triplets.sparkSession).withColumnRenamed("relation", "_rel"))
    rows = triplets.join(rules, F.col("relation") == F.col("_rel"), "left")
    rows = rows.withColumn("_h", guess_type(F.col("head"), F.col("head_type"))).withColumn("_t", guess_type(F.col("tail"), F.col("tail_type")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    evidence, chunk = normalize_key(F.col("evidence")), normalize_key(F.col("chunk_text"))
    stands = F.coalesce(F.contains(chunk, evidence), F.lit(False)) & ~blank("evidence")
    if fuzzy:
        open_ = ~stands & ~blank("evidence") & ~blank("chunk_text")
        stands = stands | (F.coalesce(partial_similarity(F.when(open_, evidence), F.when(open_, chunk)), F.lit(0.0)) >= config.evidence_ratio)
    late = (F.coalesce(F.col("start_year") > config.max_year, F.lit(False))) | F.coalesce(F.col("end_year") > config.max_year, F.lit(False))
    tests = [
        ("head_or_tail_missing", blank("head") | blank("tail")),
        ("relation_missing", F.coalesce(F.col("relation"), F.lit("")) == ""),
        ("relation_not_in_ontology", F.col("_rel").isNull() & (F.coalesce(F.col("relation"), F.lit("")) != "")),
        ("head_type_invalid", F.col("_rel").isNotNull() & (F.col("_h") != "Unknown") & ~F.array_contains("domain", F.col("_h"))),
        ("tail_type_invalid", F.col("_rel").isNotNull() & (F.col("_t") != "Unknown") & ~F.array_contains("range", F.col("_t"))),
        ("evidence_not_in_chunk", ~stands),
        ("low_confidence", F.coalesce(F.col("confidence") < config.min_confidence, F.lit(False))),
        ("after_1945", late),
        ("start_year_gt_end_year", F.coalesce(F.col("start_year") > F.col("end_year"), F.lit(False))),
    ]
    codes = F.array_compact(F.array(*[F.when(test, code) for code, test in tests]))
    return rows.withColumn("reasons", codes).drop("_rel", "domain", "range", "_h", "_t")


def histogram(rejects: DataFrame) -> DataFrame:
    """(reason, n)."""
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def select_chunks(chunks: DataFrame, done: DataFrame | None = None, periods: list[str] | None = None, tier: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """Chunks still to be extracted: of the given periods and tier, tier B only its first ones, without those done."""
    rows = chunks
    if periods is not None:
        rows = rows.where(F.col("period_id").isin(periods))
    if tier is not None:
        rows = rows.where(F.col("tier") == tier)
    rows = rows.where((F.coalesce(F.col("tier"), F.lit("")) != "B") | (F.col("chunk_index") < config.max_chunks_b))
    return rows if done is None else rows.join(done.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
