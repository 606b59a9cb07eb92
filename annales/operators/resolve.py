"""Entity resolution: aliases, merging, fuzzy candidates, and the ordered fold of mentions to ids."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annales.config import DEFAULT, Config
from annales.functions.fuzzy import NearMarks, mean_ratio, mean_similarity
from annales.functions.text import normalize_key, slug
from annales.session import ensure_checkpoint_dir


def alias_registry(aliases: DataFrame, typed: bool = False) -> DataFrame:
    """(alias[, type], entity_id): the first registration by load_seq wins; aliases compare without case and spacing."""
    keys = ["alias", "type"] if typed else ["alias"]
    rows = aliases.withColumn("alias", normalize_key(F.col("alias"))).where("alias IS NOT NULL AND alias <> ''")
    return rows.groupBy(*keys).agg(F.min_by("entity_id", "load_seq").alias("entity_id"))


def merge_entities(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One entity per id: first known years, type, description; aliases and periods as sets in order of first sight.

    rows: id, name, type, description, start_year, end_year, aliases, period_ids, `order`.
    """
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("name", "type", "description", "start_year", "end_year")]
    scalars = rows.groupBy("id").agg(*first)

    def sets(column: str) -> DataFrame:
        # Members are told apart before they are listed, so repeats in a large group cost nothing.
        each = rows.select("id", F.posexplode(column).alias("_p", "_v"), order).groupBy("id", "_v").agg(F.min(F.struct(order, "_p")).alias("_f"))
        return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_v"))), lambda x: x["_v"]).alias(column))

    empty = F.array().cast("array<string>")
    return scalars.join(sets("aliases"), "id", "left").join(sets("period_ids"), "id", "left").withColumns({c: F.coalesce(c, empty) for c in ("aliases", "period_ids")})


def exact_matches(mentions: DataFrame, typed: DataFrame, untyped: DataFrame) -> DataFrame:
    """Mentions (name, type, ...) with `entity_id` by typed alias, else by untyped alias."""
    key = normalize_key(F.col("name"))
    a = typed.select(F.col("alias").alias("_k"), F.col("type").alias("_t"), F.col("entity_id").alias("_a"))
    b = untyped.select(F.col("alias").alias("_k2"), F.col("entity_id").alias("_b"))
    rows = mentions.join(a, (key == F.col("_k")) & (F.col("type") == F.col("_t")), "left").join(b, key == F.col("_k2"), "left")
    return rows.withColumn("entity_id", F.coalesce("_a", "_b")).drop("_k", "_t", "_a", "_k2", "_b")


def _marked(names: DataFrame, config: Config) -> DataFrame:
    """Names (type, _n) with their marks (see NearMarks) and what bounds their likeness; those with repeated words also without the repeats."""
    seen = names.select(F.explode(F.array_distinct(F.split("_n", ""))).alias("x")).groupBy("x").count().where(r"x <> '' AND NOT x RLIKE '\\s'").collect()
    marks = NearMarks(config.fuzzy_threshold, {r["x"]: r["count"] for r in seen})

    def rows(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, name in zip(batch["type"], batch["_n"]):
                words = sorted(name.split())
                if not words:
                    continue
                once = sorted(set(words))
                few, many = marks.words(once)
                if len(once) < len(words):
                    few = None
                    exact, near = marks.letters(once)
                    out.append((kind, name, sum(map(len, once)) + len(once) - 1, *marks.bits(once), exact, near, [], False, False))
                exact, near = marks.letters(words)
                out.append((kind, name, sum(map(len, words)) + len(words) - 1, *marks.bits(words), exact + (few or []), near + (many or []), once, few is None, many is None))
            yield pd.DataFrame(out, columns=["type", "_n", "_l", "_b", "_bb", "_few", "_many", "_words", "_odd", "_wide"])

    return names.mapInPandas(rows, "type string, _n string, _l int, _b long, _bb long, _few array<string>, _many array<string>, _words array<string>, _odd boolean, _wide boolean").checkpoint()


def _near_names(names: DataFrame, config: Config) -> DataFrame:
    """(type, _x, _y), _x <= _y: names of one type that may reach the threshold, each with itself."""
    marks = NearMarks(config.fuzzy_threshold, {})
    marked = _marked(names, config)
    bounds = ["type", "_n", "_l", "_b", "_bb"]

    def side(rows: DataFrame, key: str, end: str, *also: str) -> DataFrame:
        return rows.select("type", F.col(key).alias("_k"), *also, *(F.col(c).alias(c + end) for c in bounds[1:]))

    def keys(column: str) -> DataFrame:
        return marked.select(*bounds, F.explode(column).alias("_m")).withColumn("_loose", F.col("_m").startswith("s ")).withColumn("_h", F.xxhash64("_m"))

    total, differ = F.col("_l1") + F.col("_l2"), F.bit_count(F.col("_b1").bitwiseXOR(F.col("_b2")))
    # The sorted words alone must reach twice the threshold less 100.
    loose = (F.abs(F.col("_l1") - F.col("_l2")) <= 2 * marks.share * total + 1e-9) & (differ <= 2 * marks.share * total + 1e-9)
    most = F.floor(marks.share * total + 1e-9)
    tight = (F.abs(F.col("_l1") - F.col("_l2")) <= most) & (differ <= most) & (F.bit_count(F.col("_bb1").bitwiseXOR(F.col("_bb2"))) <= 3 * most)
    left, right = keys("_few"), keys("_many")
    found = [side(left, "_h", "1", "_loose").join(side(right, "_h", "2"), ["type", "_k"]).where((F.col("_n1") != F.col("_n2")) & F.when(F.col("_loose"), loose).otherwise(tight)).select("type", "_n1", "_n2")]
    # Names with repeated or too many words: the rarest of the common words stands behind few letters of the name that it is nearly all of.
    listed = marked.select(*bounds, "_odd", "_wide", F.explode("_words").alias("_w"), F.expr("aggregate(_words, -1, (n, w) -> n + length(w) + 1)").alias("_once"))
    rarity = listed.groupBy("type", "_w").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum(F.length("_w") + 1).over(Window.partitionBy("type", "_n").orderBy("_c", "_w").rowsBetween(Window.unboundedPreceding, -1))
    rare = listed.join(rarity, ["type", "_w"]).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= F.col("_once") * (marks.rest / (1 + marks.rest)) + 1e-9)
    for odd, other in ((rare.where("_odd"), listed), (rare, listed.where("_wide"))):
        found.append(side(odd, "_w", "1").join(side(other, "_w", "2"), ["type", "_k"]).where((F.col("_n1") != F.col("_n2")) & loose).select("type", "_n1", "_n2"))
    pairs = found[0].unionByName(found[1]).unionByName(found[2])
    pairs = pairs.select("type", F.least("_n1", "_n2").alias("_x"), F.greatest("_n1", "_n2").alias("_y")).distinct()
    return pairs.unionByName(names.select("type", F.col("_n").alias("_x"), F.col("_n").alias("_y")))


def fuzzy_pairs(entities: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(id_a, id_b, score): names of one type whose mean ratio reaches the threshold; events also need near years.

    Each two names are compared once, however many ids bear them, if they share
    a mark that near names must share (see NearMarks); a common word isn't needed.
    """
    ensure_checkpoint_dir(entities.sparkSession)
    rows = entities.where("id IS NOT NULL AND name IS NOT NULL AND type IS NOT NULL").select("id", "type", F.lower("name").alias("_n"), F.when(F.col("type") == "Event", F.col("start_year")).otherwise(0).alias("_at"))
    rows = rows.where("_at IS NOT NULL").distinct()
    score = F.round(mean_similarity("_x", "_y"), 2)
    near = _near_names(rows.select("type", "_n").distinct(), config).withColumn("score", score).where(F.col("score") >= config.fuzzy_threshold)
    # Both ways round, as either name may be that of the smaller id.
    near = near.select("type", "score", F.explode(F.array_distinct(F.array(F.struct("_x", "_y"), F.struct(F.col("_y").alias("_x"), F.col("_x").alias("_y"))))).alias("_p")).select("type", "_p.*", "score")
    slack = F.when(F.col("type") == "Event", F.lit(config.event_year_tolerance)).otherwise(0)
    left = rows.select("type", F.col("id").alias("id_a"), F.col("_n").alias("_x"), "_at")
    right = rows.select("type", F.col("id").alias("id_b"), F.col("_n").alias("_y"), F.explode(F.sequence(F.col("_at") - slack, F.col("_at") + slack)).alias("_at"))
    pairs = left.join(near, ["type", "_x"]).join(right, ["type", "_y", "_at"]).where("id_a < id_b")
    return pairs.select("id_a", "id_b", "_x", "_y", "score").distinct().select("id_a", "id_b", "score")


def new_ids(mentions: DataFrame) -> DataFrame:
    """Mentions with `new_id`: the Wikidata number, else a slug of the name, dated events with their year."""
    base = F.concat(F.lit("local:"), slug(F.col("name")))
    dated = (F.col("type") == "Event") & F.col("start_year").isNotNull()
    local = F.when(dated, F.concat(base, F.lit("-"), F.col("start_year").cast("string"))).otherwise(base)
    return mentions.withColumn("new_id", F.when(F.col("qid").isNotNull(), F.concat(F.lit("qid:"), "qid")).otherwise(local))


class Resolver:
    """Mentions to ids one after the other: number, typed alias, alias, near name of the type, new id."""

    def __init__(self, config: Config = DEFAULT, aliases: Iterable[tuple[str, str, str | None]] = ()) -> None:
        self.config = config
        self.typed: dict[tuple[str, str], str] = {}
        self.plain: dict[str, str] = {}
        self.by_type: dict[str, list[tuple[str, str, int | None]]] = {}
        self.types: dict[str, str | None] = {}
        self.known: set[tuple[str, str, str, int | None]] = set()
        for name, entity, kind in aliases:
            self._register(entity, [name], kind, None)

    @staticmethod
    def key(name: str) -> str:
        return " ".join(name.lower().split())

    def _register(self, entity: str, names: list[str], kind: str | None, year: int | None) -> None:
        self.types.setdefault(entity, kind)
        for name in filter(None, map(self.key, names)):
            if kind:
                self.typed.setdefault((name, kind), entity)
                # Only the first of equal ones can be found.
                if (kind, name, entity, year) not in self.known:
                    self.known.add((kind, name, entity, year))
                    self.by_type.setdefault(kind, []).append((name, entity, year))
            # Dated events never take the bare name.
            if not (kind == "Event" and year is not None):
                self.plain.setdefault(name, entity)

    def _near(self, name: str, kind: str, year: int | None) -> str | None:
        best: tuple[float, str] | None = None
        for other, entity, then in self.by_type.get(kind, ()):
            if kind == "Event" and (year is None or then is None or abs(year - then) > self.config.event_year_tolerance):
                continue
            score = mean_ratio(name, other)
            if score >= self.config.fuzzy_threshold and (best is None or score > best[0]):
                best = (score, entity)
        return best and best[1]

    def resolve(self, name: str, kind: str | None, year: int | None, number: str | None, new: str, aliases: Iterable[str] = ()) -> str:
        key = self.key(name)
        dated = kind == "Event" and year is not None
        entity = f"qid:{number}" if number else None
        if entity is None and kind:
            entity = next((e for n, e, y in self.by_type.get(kind, ()) if n == key and (y == year or y is None)), None) if dated else self.typed.get((key, kind))
        if entity is None and (found := self.plain.get(key)) is not None and (not kind or self.types.get(found) in (None, kind)) and not dated:
            entity = found
        if entity is None and kind:
            entity = self._near(key, kind, year)
        if entity is None:
            entity = new
            if self.types.get(entity) not in (None, kind) and kind:
                entity = f"{new}-{kind.lower()}"
        self._register(entity, [name, *aliases], kind, year)
        return entity


def _components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of edges (u, v) with the least node it can reach; labels are checkpointed each round."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "node").checkpoint()
    while True:
        told = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("_t"))
        moved = labels.join(told, "node").select("node", F.least("label", "_t").alias("label"), (F.col("_t") < F.col("label")).alias("_m"))
        # The label of one's label is nearer the least one.
        jumped = moved.join(moved.select(F.col("node").alias("label"), F.col("label").alias("_j")), "label", "left").select("node", F.least("label", "_j").alias("label"), "_m").checkpoint()
        labels = jumped.select("node", "label")
        if not jumped.where("_m").limit(1).count():
            return labels


def _grouped(mentions: DataFrame, config: Config) -> DataFrame:
    """Mentions (with new_id) and the group `_g` outside which none can change another's outcome.

    Two mentions can do so if they share a name, an alias or an id that one may
    be given, or if a name of one is near a name or alias of the other; groups
    are the connected components.
    """
    ensure_checkpoint_dir(mentions.sparkSession)

    @F.pandas_udf("array<string>")
    def keys(name: pd.Series, aliases: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(filter(None, (Resolver.key(x or "") for x in (n, *(a if a is not None else ())))))) for n, a in zip(name, aliases)])

    own = F.concat(F.lit("n:"), "new_id")
    rows = mentions.select("new_id", "type", keys("name", "aliases").alias("keys"), keys("name", F.array().cast("array<string>")).alias("names")).checkpoint()
    exact = rows.select(own.alias("u"), F.explode(F.concat(F.transform("keys", lambda k: F.concat(F.lit("k:"), k)), F.array_compact(F.array(F.concat(own, F.lit("-"), F.lower("type")))))).alias("v"))
    typed = rows.where("type <> ''").select("type", F.explode("keys").alias("key"), "names").groupBy("type", "key").agg(F.max(F.array_contains("names", F.col("key"))).alias("named"))
    # Years don't matter here: a group may hold more than it needs.
    near = _near_names(typed.select("type", F.col("key").alias("_n")), config).where("_x <> _y").where(mean_similarity("_x", "_y") >= config.fuzzy_threshold)
    near = near.select(F.col("_x").alias("id_a"), F.col("_y").alias("id_b")).distinct()
    named = typed.where("named").select(F.col("key").alias("id")).distinct()
    near = near.join(named.withColumnRenamed("id", "id_a"), "id_a", "left_semi").unionByName(near.join(named.withColumnRenamed("id", "id_b"), "id_b", "left_semi"))
    edges = exact.unionByName(near.select(F.concat(F.lit("k:"), "id_a").alias("u"), F.concat(F.lit("k:"), "id_b").alias("v")))
    labels = _components(edges)
    return mentions.withColumn("_n", own).join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_l")), "_n", "left").withColumn("_g", F.coalesce("_l", "_n")).drop("_n", "_l")


def resolve_mentions(mentions: DataFrame, group: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """(seq, entity_id) of mentions (seq, name, type, start_year, qid, aliases), resolved in order of seq.

    The outcome depends on the order, so a group stays in one task. Without a group
    column the result is that of one pass over all mentions: groups are then
    those that cannot touch each other (see _grouped), and run in parallel.
    """
    numbered = new_ids(mentions)
    keyed = numbered.withColumn("_g", F.col(group).cast("string")) if group else _grouped(numbered, config)

    def fold(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        # Most groups are a few mentions, so they stream through one call; of the resolvers only that of the present group is held.
        at, resolver = object(), Resolver(config)
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False, name="Mention"):
                if r.at != at:
                    at, resolver = r.at, Resolver(config)
                year = None if pd.isna(r.start_year) else int(r.start_year)
                out.append((r.seq, resolver.resolve(r.name or "", r.type or None, year, r.qid or None, r.new_id, r.aliases if r.aliases is not None else ())))
            yield pd.DataFrame(out, columns=["seq", "entity_id"])

    columns = [F.col("_g").alias("at"), "seq", "name", "type", "start_year", "qid", "aliases", "new_id"]
    return keyed.select(*columns).repartition("at").sortWithinPartitions("at", "seq").mapInPandas(fold, "seq long, entity_id string")


def relations(triplets: DataFrame, ids: DataFrame) -> DataFrame:
    """Relation rows of triplets (head, relation, tail, ...) with the ids of their names (name, entity_id); unknown names drop out.

    Evidence chunks are collected per relation, which the replaced engine lost on the way.
    """
    names = ids.select(normalize_key(F.col("name")).alias("_k"), "entity_id")
    rows = triplets.withColumn("_h", normalize_key(F.col("head"))).withColumn("_t", normalize_key(F.col("tail")))
    rows = rows.join(names.select(F.col("_k").alias("_h"), F.col("entity_id").alias("src")), "_h").join(names.select(F.col("_k").alias("_t"), F.col("entity_id").alias("dst")), "_t")
    return rows.drop("_h", "_t")
