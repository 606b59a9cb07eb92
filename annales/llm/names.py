"""Problem 3: variant spellings of persons' and organisations' names.

Method: every name is rewritten to canonical forms by rules for spelling
(accents, typed accents, look-alikes, missing spaces), token order, one or two
wrong or missing tokens, initials, legal forms, titles and nicknames. Forms are
exploded and equi-joined; a form that few ids have brings all of them together,
a commoner one those that also share a fact (a place, a year of beginning or
end, a rare phrase). A pair is scored by how rare the rewriting that joined it is and by what
its bearers' facts say. All weights are log-likelihood ratios that an
expectation-maximisation over all pairs learns (Fellegi and Sunter). They bound
what a pair without a common fact can score; where that could be a link, all
bearers of such forms are compared after all, so no link is left out. Pairs
that hold are closed to clusters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annales.llm.visual import LATIN_LOOKALIKES, LOOKALIKES
from annales.session import ensure_checkpoint_dir

#: Titles that stand before a whole name (fixed values, folded). A title that isn't listed counts as a token too many.
TITLES = ("cu", "ong", "ba", "duc", "tuong quan", "hiep tran", "thuong thu", "quan do", "tong doc", "quan", "ngai", "co", "chu", "bac", "thay")
#: Words before a given name alone (fixed values, folded).
NICKNAMES = ("chanh", "doi", "de", "lanh", "ca", "hai", "ba", "tu", "nam", "sau", "bay", "tam", "chin", "ut", "cai", "ly", "tong", "xa")
#: What ends a courtesy name (fixed value, folded).
COURTESY = "tien sinh"
#: Legal forms of organisations (fixed values, folded).
LEGAL = ("thuong hoi", "tong hoi", "hoc xa", "lien doan", "mat tran", "uy ban", "hoi", "doan")
#: Persons and organisations among the types.
TYPES = ("Person", "Organization")

#: Kinds of forms: tokens in any order, run together, initials with the last token, all initials, given name, courtesy name, all tokens but two.
BAG, JOINED, INITIALS, LETTERS, GIVEN, STYLE, PAIR = range(7)
#: Ways in which two names meet, the surest first, with the share of such pairs that is expected to be one bearer
#: where the form is held by two ids. WHOLE to STYLE: the whole name; MISSING: one has a token more; INITIALED: one is
#: shortened; NICKNAMED; REPLACED: one token differs; ALIKE: equal initials and last token; LETTERED: an acronym; TWO: two tokens differ.
WHOLE, RUN_ON, COURTESIES, MISSING, INITIALED, NICKNAMED, REPLACED, ALIKE, LETTERED, TWO = range(10)
EXPECTED = (0.8, 0.8, 0.8, 0.5, 0.3, 0.02, 0.1, 0.02, 0.02, 0.01)
#: (kind, number of its two names that only have the form by leaving something out) -> way. What isn't listed is no rewriting.
WAYS = {(BAG, 0): WHOLE, (JOINED, 0): RUN_ON, (STYLE, 0): COURTESIES, (BAG, 1): MISSING, (INITIALS, 0): INITIALED, (INITIALS, 1): INITIALED, (GIVEN, 0): NICKNAMED, (GIVEN, 1): NICKNAMED, (BAG, 2): REPLACED, (INITIALS, 2): ALIKE, (LETTERS, 0): LETTERED, (LETTERS, 1): LETTERED, (PAIR, 2): TWO}
#: Forms of these kinds say so little that their bearers first meet only together with a fact.
WEAK = (LETTERS, GIVEN, PAIR)
#: Ids of a form of another kind that meet without a common fact before any weights are known.
FEW = 15
#: Tokens of names of which any two may be wrong.
TWO_TOKENS = (4, 8)
#: Years that two sources may be apart for the same event.
YEARS_APART = 2
#: Least log-odds of a link.
LEAST_SCORE = 0.5
#: Members of one key in a block; more are compared in a grid of blocks, every block with every block.
BLOCK = 200
YEARS = (-40000, 2100)

#: What a comparison may say: nothing told, contradiction, agreement on something held by fewer than one id in e^0, e^2, e^4, e^6.
UNTOLD, APART, SHARED = 0, 1, 2
RARITIES = (2.0, 4.0, 6.0)
LEVELS = SHARED + 1 + len(RARITIES)
#: Shares of each level among pairs of one bearer and of two, before any data: years (start and end), places, descriptions, types.
_YEAR = np.array([1.0, 0.05, 3.0]), np.array([1.0, 3.0, 0.02])
START = {
    "years": (np.outer(_YEAR[0], _YEAR[0]).ravel(), (np.outer(_YEAR[1], _YEAR[1]) * np.where(np.outer([0, 0, 1], [0, 0, 1]), 10, 1)).ravel()),
    "places": (np.array([1, 0.1, 0.5, 0.5, 0.5, 0.5]), np.array([1, 3, 0.3, 0.1, 0.03, 0.01])),
    "told": (np.array([1, 1, 0.5, 0.5, 0.5, 0.5]), np.array([1, 3, 0.3, 0.1, 0.03, 0.01])),
    "types": (np.array([1, 0.05, 9]), np.array([1, 2, 8])),
}
#: Pairs that these shares, and EXPECTED, weigh as much as.
WEIGHT_LEVELS, WEIGHT_WAYS = 20.0, 5.0
ROUNDS = 100
#: Most that the facts of one bearer contradict each other, and most pairs of a way that have one bearer, whatever the data seem to say.
MOST_WRONG = 0.02
MOST_TRUE = 0.98
#: Levels of each comparison that are contradictions; descriptions may differ.
CONTRADICTIONS = {"years": [1, 3, 4, 5, 7], "places": [APART], "told": [], "types": [APART]}

_SYLLABLE = re.compile(r"^(?:ngh|ch|gh|gi|kh|ng|nh|ph|qu|th|tr|[bcdghklmnpqrstvx])?[aeiouy]{1,3}(?:ch|ng|nh|[cmnpt])?$")
_ALIKE = str.maketrans(LOOKALIKES | LATIN_LOOKALIKES)
_LOWER_UPPER = re.compile(r"(?<=[^\W\d_])(?=[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐĨŨƠƯ])")
_MASK = 2**64 - 1


def fold(text: str) -> str:
    return unicodedata.normalize("NFKD", text.lower().replace("đ", "d")).encode("ascii", "ignore").decode()


def untyped(token: str) -> str:
    """A folded token without accents typed as digits (a6, d9) or as doubled and trailing letters (aa, dd, ow, f)."""
    if any(c.isdigit() for c in token):
        return re.sub(r"\d", "", token)
    if not _SYLLABLE.match(token) or "aa" in token or "ee" in token:
        plain = token.replace("w", "")
        for double in ("dd", "aa", "ee", "oo"):
            plain = plain.replace(double, double[0])
        if len(plain) > 1 and plain[-1] in "sfrxj":
            plain = plain[:-1]
        if _SYLLABLE.match(plain):
            return plain
    return token


def name_tokens(name: str) -> tuple[list[str], bool]:
    """Folded tokens of a name without bracketed additions, and whether its spaces can't be trusted."""
    name = unicodedata.normalize("NFKC", name).translate(_ALIKE)
    name = "".join(c for c in name if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F and c != "͏")
    name = re.sub(r"[(\[{].*?(?:[)\]}]|$)", " ", name)
    words = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", name))
    run_on = any(not w.isupper() and _LOWER_UPPER.search(w[1:]) for w in words)
    tokens = [untyped(t) for t in (fold(w) for w in words) if t]
    return [t for t in tokens if t], run_on


@lru_cache(200_000)
def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _code(kind: int, form: int, partial: bool) -> int:
    """A form as a signed 64-bit number whose last four bits are its kind and whether something was left out."""
    return (((form * 0x9E3779B97F4A7C15 + kind) & _MASK) & ~15 | kind << 1 | partial) - 2**63


@lru_cache(200_000)
def form_codes(name: str) -> tuple[int, ...]:
    """Codes of the canonical rewritings of a name; a bag of tokens is the sum of their hashes, so a long name costs no more than its length."""
    tokens, run_on = name_tokens(name)
    if not tokens:
        return ()
    if len(tokens) > 2 and " ".join(tokens[-2:]) == COURTESY:
        return (_code(STYLE, _hash(" ".join(tokens[:-2])), False),)
    out: list[int] = []
    bare = next((tokens[n:] for n, t in ((t.count(" ") + 1, t) for t in TITLES) if len(tokens) >= n + 3 and " ".join(tokens[:n]) == t), None)
    for words in [tokens] if bare is None else [tokens, bare]:
        out += _forms(words, run_on)
    return tuple(dict.fromkeys(out))


def _forms(tokens: list[str], run_on: bool) -> Iterator[int]:
    yield _code(JOINED, _hash("".join(tokens)), False)
    # A nickname: a rank or number, perhaps a byword, and the given name.
    if 2 <= len(tokens) <= 3 and tokens[0] in NICKNAMES:
        yield _code(GIVEN, _hash(tokens[-1]), False)
    whole = [t for t in tokens if _SYLLABLE.match(t)]
    short = len(whole) < len(tokens)
    letters = "".join(sorted("".join(t if not _SYLLABLE.match(t) and len(t) <= 7 else t[0] for t in tokens)))
    yield _code(LETTERS, _hash(letters), not short)
    if run_on or len(tokens) < 3:
        return
    parts = [_hash(t) for t in tokens]
    bag = sum(parts)
    yield _code(BAG, bag, False)
    if len(tokens) > 3:
        for h in parts:
            yield _code(BAG, bag - h, True)
    if TWO_TOKENS[0] <= len(tokens) <= TWO_TOKENS[1]:
        for i, h in enumerate(parts):
            for other in parts[:i]:
                yield _code(PAIR, bag - h - other, True)
    if whole:
        yield _code(INITIALS, _hash(letters + " " + whole[-1]), not short)
    yield _code(GIVEN, _hash(tokens[-1]), True)
    # The rest without the legal form, which is written out, shortened or moved to the end.
    text = " ".join(tokens)
    for legal in LEGAL:
        n = legal.count(" ") + 1
        if text.startswith(legal + " ") or text.endswith(" " + legal):
            yield _code(BAG, sum(parts[n:] if text.startswith(legal + " ") else parts[:-n]), False)
            break
    else:
        if not _SYLLABLE.match(tokens[0]) and len(tokens) >= 4:
            yield _code(BAG, sum(parts[1:]), False)


@lru_cache(200_000)
def facts(description: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(places, phrases) of a description, hashed: runs of two capitalised words or more, and runs of three other words."""
    places, phrases = set(), set()
    for part in re.split(r"(?<=[.;,])\s+", unicodedata.normalize("NFC", description)):
        names: list[str] = []
        words: list[str] = []
        for at, word in enumerate([*re.findall(r"[^\W\d_]+|\d+", part), ""]):
            # The first word of a sentence is capital anyhow.
            if word[:1].isupper() and at:
                names.append(word)
                words = []
                continue
            if len(names) > 1:
                places.add(_hash(fold(" ".join(names))))
            names = []
            words = [*words[-2:], fold(word)] if word and not word.isdigit() else []
            if len(words) == 3:
                phrases.add(_hash(" ".join(words)))
    return tuple(h - 2**63 for h in places), tuple(h - 2**63 for h in phrases)


def _features(records: DataFrame) -> DataFrame:
    """Per record: id, type, years, and what its names and description give."""
    schema = "id string, type string, start_year int, end_year int, forms array<long>, places array<long>, phrases array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, places, phrases = [], [], []
            for name, aliases, description in zip(batch.column("name").to_pylist(), batch.column("aliases").to_pylist(), batch.column("description").to_pylist()):
                forms.append(list({c for n in (name, *(aliases or ())) if n for c in form_codes(n)}))
                p, t = facts(description) if description else ((), ())
                places.append(p)
                phrases.append(t)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "type", "start_year", "end_year")), pa.array(forms, longs), pa.array(places, longs), pa.array(phrases, longs)], names=["id", "type", "start_year", "end_year", "forms", "places", "phrases"])

    both = F.coalesce(F.col("start_year") > F.col("end_year"), F.lit(False))

    def year(c: str) -> Column:
        return F.when((F.col(c) != 0) & F.col(c).between(*YEARS) & ~both, F.col(c)).alias(c)

    rows = records.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("type").cast("string").alias("type"), year("start_year"), year("end_year"), F.col("name").cast("string"), F.col("aliases").cast("array<string>"), F.col("description").cast("string")).distinct()
    return rows.mapInArrow(read, schema)


def _level(n: Column, count: int) -> Column:
    """How rare something is that n of `count` ids have, from 0 on."""
    rare = F.log(F.lit(float(count)) / n)
    return sum((F.when(rare >= r, 1).otherwise(0) for r in RARITIES), F.lit(0))


def _held(told: DataFrame, column: str, count: int, least: int) -> DataFrame:
    """(id, codes): what each id has of a column; the last two bits of a code are its rarity. Below `least` nothing is kept;
    what one id alone has is kept as an empty list only, which tells that it has something."""
    once = told.select("id", F.explode(column).alias("_h")).distinct()
    seen = once.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_l", _level(F.col("_n"), count)).where(F.col("_l") >= least)
    code = F.when(F.col("_n") > 1, F.col("_h").bitwiseAND(~3).bitwiseOR(F.col("_l").cast("long")))
    return once.join(seen, "_h").groupBy("id").agg(F.collect_set(code).alias(column))


def _near(a: Column, b: Column) -> Column:
    """Whether two sets of years have members YEARS_APART or less from each other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= YEARS_APART))


def _stretches(years: Column, tag: int) -> Column:
    """Keys of years: any two at most YEARS_APART apart share one."""
    width = 2 * YEARS_APART + 1
    return F.flatten(F.transform(years, lambda y: F.array(F.xxhash64(F.lit(tag), F.floor(y / width)), F.xxhash64(F.lit(tag + 1), F.floor((y + YEARS_APART) / width)))))


def clusters(links: DataFrame) -> DataFrame:
    """(id, cluster) of the ids in links (a, b): each takes the least id it can reach.

    Minimum labels travel along links and along labels until nothing changes;
    every round is written to the checkpoint folder.
    """
    ensure_checkpoint_dir(links.sparkSession)
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("_l")).select("_l.id", "_l.to").distinct().checkpoint()
    labels = both.groupBy("id").agg(F.least(F.min("to"), F.min("id")).alias("cluster")).checkpoint()
    while True:
        told = both.join(labels.select(F.col("id").alias("to"), "cluster"), "to").groupBy("id").agg(F.min("cluster").alias("_c"))
        moved = labels.join(told, "id", "left").select("id", F.least("cluster", "_c").alias("cluster"), (F.col("_c") < F.col("cluster")).alias("_m"))
        # The label of one's label is nearer the least one.
        jumped = moved.join(moved.select(F.col("id").alias("cluster"), F.col("cluster").alias("_j")), "cluster", "left").select("id", F.least(F.col("cluster"), F.col("_j")).alias("cluster"), "_m").checkpoint()
        changed = jumped.where("_m").limit(1).count()
        labels = jumped.select("id", "cluster")
        if not changed:
            return labels


def _way(kind: Column, partial: Column) -> Column:
    out = None
    for (k, p), way in WAYS.items():
        at = (kind == k) & (partial == p)
        out = F.when(at, way) if out is None else out.when(at, way)
    return out


def _met(keyed: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b, stratum): all pairs of ids with a key in common, and the surest way and rarest form in which they meet.

    keyed: key, id, kind, partial and n, the ids that have the form. Keys above
    `block` ids are cut into blocks and every block is compared with every
    other, so no pair is dropped and no task holds a whole key.
    """
    block = block or BLOCK
    members = F.collect_list(F.struct("id", "_i", "partial")).alias("_all")
    shape = [F.first("kind").alias("kind"), F.first("n").alias("n"), members]
    # Only forms of many ids can have keys of many; the others are one group each.
    calm = keyed.where(F.col("n") <= block).withColumn("_i", F.lit(0)).groupBy("key").agg(*shape).withColumns({"_low": F.lit(0), "_high": F.lit(0)})
    common = keyed.where(F.col("n") > block)
    blocks = common.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    rows = common.join(blocks, "key").withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_blocks").cast("long")).cast("int"))
    cells = rows.select("key", "id", "kind", "partial", "n", "_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j"))
    cells = cells.groupBy("key", F.least("_i", "_j").alias("_low"), F.greatest("_i", "_j").alias("_high")).agg(*shape)
    cells = calm.unionByName(cells).where(F.size("_all") > 1)
    # In a cell off the diagonal only members of different blocks are paired; those of one block meet on it.
    seen = cells.select("kind", "n", (F.col("_low") == F.col("_high")).alias("_same"), "_all", F.explode("_all").alias("_x"))
    whole = F.col("kind").isin(LETTERS, GIVEN)
    others = F.filter("_all", lambda y: (y["id"] > F.col("_x.id")) & (F.col("_same") | (y["_i"] != F.col("_x._i"))) & ~(whole & (y["partial"] + F.col("_x.partial") == 2)))
    pairs = seen.select(F.col("_x.id").alias("a"), F.col("_x.partial").alias("_p"), "kind", "n", F.explode(others).alias("_y"))
    pairs = pairs.select("a", F.col("_y.id").alias("b"), (_way(F.col("kind"), F.col("_p") + F.col("_y.partial")) * 64 + F.floor(F.log2("n")).cast("int")).alias("stratum"))
    return pairs.groupBy("a", "b").agg(F.min("stratum").alias("stratum"))


def _expected(strata: np.ndarray) -> np.ndarray:
    """Share of true pairs that a stratum has before any data."""
    return np.minimum(np.array(EXPECTED)[strata // 64] * 2 / 2.0 ** (strata % 64), 0.95)


def weights(cells: pd.DataFrame, totals: dict[int, float]) -> np.ndarray:
    """Log-odds, of each cell, that its pairs have one bearer."""
    return _learnt(cells, totals)[0]


def _reaching(cells: pd.DataFrame, totals: dict[int, float]) -> tuple[np.ndarray, set[int]]:
    """The log-odds of each cell, and the strata of `totals` in which a pair without a common fact may be a link."""
    odds, priors, ratios = _learnt(cells, totals)
    # Levels of pairs without a year, a place or one of the rarest phrases in common.
    apart = {"years": [0, 1, 3, 4], "places": [UNTOLD, APART], "told": list(range(LEVELS - 1))}
    most = sum(float(r[apart.get(name, slice(None))].max()) for name, r in ratios.items())
    return odds, {s for s in totals if priors[s] + most >= LEAST_SCORE}


def _learnt(cells: pd.DataFrame, totals: dict[int, float]) -> tuple[np.ndarray, dict[int, float], dict[str, np.ndarray]]:
    """(log-odds of each cell, most log-odds of each stratum before any comparison, log-ratio of each level of each comparison).

    cells: stratum, the level of each comparison in START, n pairs. A stratum
    named in `totals` shows only pairs with a fact in common out of so many
    pairs: its share of true pairs counts over all of them, and what two bearers
    agree in is learnt elsewhere. Expectation-maximisation from START and
    EXPECTED, which weigh as some pairs, so that tables of any size have weights.
    What isn't told weighs nothing.
    """
    strata, at = np.unique(cells["stratum"].to_numpy(np.int64), return_inverse=True)
    n = cells["n"].to_numpy(float)
    expected = _expected(strata)
    seen = np.bincount(at, n, len(strata))
    every = np.array([max(totals.get(int(s), 0.0), seen[i]) for i, s in enumerate(strata)])
    open_to_all = np.array([int(s) not in totals for s in strata])[at]
    levels = [cells[c].to_numpy(np.int64) for c in START]
    one, two = ([x / x.sum() for x in side] for side in zip(*START.values()))
    first_one, first_two = [x.copy() for x in one], [x.copy() for x in two]
    share = expected.copy()
    odds = true = np.zeros(len(n))
    for _ in range(ROUNDS):
        odds = np.log(share / (1 - share))[at] + sum(np.where(x == UNTOLD, 0.0, np.log(m / u)[x]) for m, u, x in zip(one, two, levels))
        true = n / (1 + np.exp(-odds))
        share = np.clip((np.bincount(at, true, len(strata)) + WEIGHT_WAYS * expected) / (every + WEIGHT_WAYS), 1e-9, MOST_TRUE)
        for k, (name, x) in enumerate(zip(START, levels)):
            one[k] = np.bincount(x, true, len(one[k])) + WEIGHT_LEVELS * first_one[k]
            two[k] = np.bincount(x, (n - true) * open_to_all, len(two[k])) + WEIGHT_LEVELS * first_two[k]
            one[k], two[k] = one[k] / one[k].sum(), two[k] / two[k].sum()
            one[k][CONTRADICTIONS[name]] = np.minimum(one[k][CONTRADICTIONS[name]], MOST_WRONG)
    # Pairs that weren't compared could be true as often as those that were; of strata without any, as often as is expected.
    priors = {s: float(_expected(np.array([s]))[0]) for s in totals}
    priors |= {int(s): float(min(max(p, (t + WEIGHT_WAYS * e) / (n + WEIGHT_WAYS)), MOST_TRUE)) for s, p, t, e, n in zip(strata, share, np.bincount(at, true, len(strata)), expected, seen)}
    ratios = {name: np.where(np.arange(len(m)) == UNTOLD, 0.0, np.log(m / u)) for name, m, u in zip(START, one, two)}
    return odds, {s: float(np.log(p / (1 - p))) for s, p in priors.items()}, ratios


def name_links(records: DataFrame) -> DataFrame:
    """(a, b, score): pairs of ids whose names are rewritings of each other and whose facts agree.

    Records: id, name, aliases, type, description, start_year, end_year; extra
    columns are ignored. Score: log-odds that both have one bearer. Nulls say
    nothing; names without letters have no forms; ids of other types than TYPES
    are left out, ids without any type can only join one that has. Repeated
    records count once. An empty table gives no pairs.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    told = _features(records).checkpoint()
    kinds = told.groupBy("id").agg(F.collect_set("type").alias("types"), F.collect_set("start_year").alias("starts"), F.collect_set("end_year").alias("ends"))
    kinds = kinds.where((F.size("types") == 0) | F.arrays_overlap("types", F.array(*[F.lit(t) for t in TYPES])))
    # Ids are numbered, so that what is shuffled carries eight bytes of them.
    kinds = kinds.withColumnRenamed("id", "name").withColumn("id", F.monotonically_increasing_id()).checkpoint()
    named = kinds.select("id", "name")
    kinds = kinds.drop("name")
    told = told.select(F.col("id").alias("name"), "forms", "places", "phrases").join(named, "name").drop("name").checkpoint()
    count = max(kinds.count(), 2)
    held = kinds.join(_held(told, "places", count, 0), "id", "left").join(_held(told, "phrases", count, 1), "id", "left").checkpoint()
    forms = told.select("id", F.explode("forms").alias("_f")).groupBy("id", F.col("_f").bitwiseAND(~1).alias("form")).agg(F.min(F.col("_f").bitwiseAND(1)).cast("int").alias("partial"))
    rarity = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.sum("partial").alias("_left")).where("n > 1").checkpoint()
    kind = F.shiftright(F.col("form").bitwiseAND(15), 1).cast("int")
    forms = forms.join(rarity.select("form", "n"), "form").withColumn("kind", kind)
    alone = ~F.col("kind").isin(*WEAK) & (F.col("n") <= FEW)
    none = F.array().cast("array<long>")
    # Of phrases, those of the greatest rarity are keys; what others add to a score is bounded.
    rare = F.filter(F.coalesce("phrases", none), lambda x: x.bitwiseAND(3) == len(RARITIES))
    keys = F.concat(F.coalesce("places", none), F.transform(rare, lambda x: F.xxhash64(F.lit(4), x)), _stretches(F.col("starts"), 0), _stretches(F.col("ends"), 2))
    known = held.select("id", F.explode(F.array_distinct(keys)).alias("fact"))
    keyed = forms.where(alone).select(F.col("form").alias("key"), "id", "kind", "partial", "n")
    keyed = keyed.unionByName(forms.where(~alone).join(known, "id").select(F.xxhash64("form", "fact").alias("key"), "id", "kind", "partial", "n"))
    one, two = (held.select(*[F.col(c).alias(f"{c}_{x}") for c in held.columns]) for x in ("a", "b"))

    def known_level(c: str, agree: Column) -> Column:
        return F.when((F.size(f"{c}_a") == 0) | (F.size(f"{c}_b") == 0), UNTOLD).when(agree, SHARED).otherwise(APART)

    def rarest(c: str) -> Column:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        common = F.array_max(F.transform(F.array_intersect(a, b), lambda x: x.bitwiseAND(3).cast("int")))
        return F.when(a.isNull() | b.isNull(), UNTOLD).otherwise(F.coalesce(common + SHARED, F.lit(APART))).alias(c)

    years = known_level("starts", _near(F.col("starts_a"), F.col("starts_b"))) * 3 + known_level("ends", _near(F.col("ends_a"), F.col("ends_b")))

    def compare(keyed: DataFrame) -> DataFrame:
        rows = _met(keyed).join(one.withColumnRenamed("id_a", "a"), "a").join(two.withColumnRenamed("id_b", "b"), "b")
        rows = rows.where((F.size("types_a") > 0) | (F.size("types_b") > 0))
        return rows.select("a", "b", "stratum", years.alias("years"), rarest("places"), rarest("phrases").alias("told"), known_level("types", F.arrays_overlap("types_a", "types_b")).alias("types"))

    compared = compare(keyed).checkpoint()
    # Strata and levels are few whatever the input: ways x powers of two x levels.
    shape = ["stratum", *START]
    whole = F.col("n") - F.col("_left")
    sorts = {0: whole * (whole - 1) / 2, 1: whole * F.col("_left"), 2: F.col("_left") * (F.col("_left") - 1) / 2}
    sums = rarity.withColumn("kind", kind).groupBy("kind", F.floor(F.log2("n")).cast("int").alias("bucket"), F.col("n") <= FEW).agg(*[F.sum(c).alias(f"s{p}") for p, c in sorts.items()]).collect()
    # Kinds and sizes of forms whose bearers were all compared, facts or not. Each round has more; forms of many ids, of whose pairs few are true, stay out.
    every: set[tuple[int, int]] = set()
    while True:
        cells = compared.groupBy(*shape).agg(F.count(F.lit(1)).alias("n")).toPandas()
        totals: dict[int, float] = {}
        held_by: dict[int, tuple[int, int]] = {}
        for k, bucket, few, *pairs in sums:
            for p, way in ((p, WAYS.get((k, p))) for p in sorts):
                if way is not None and (k in WEAK or not few) and (k, bucket) not in every:
                    totals[way * 64 + bucket] = totals.get(way * 64 + bucket, 0.0) + float(pairs[p] or 0)
                    held_by[way * 64 + bucket] = (k, bucket)
        cells["score"], reaching = _reaching(cells, totals)
        more = {held_by[s] for s in reaching if totals[s] > 0}
        if not more:
            break
        every |= more
        size = F.col("kind") * 64 + F.floor(F.log2("n")).cast("int")
        rest = forms.where(~alone & size.isin(*[k * 64 + b for k, b in more])).select(F.col("form").alias("key"), "id", "kind", "partial", "n")
        compared = compared.unionByName(compare(rest)).groupBy("a", "b").agg(F.min(F.struct(*shape)).alias("_s")).select("a", "b", "_s.*").checkpoint()
    if not len(cells):
        return compared.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.lit(0.0).alias("score")).limit(0)
    scores = F.broadcast(spark.createDataFrame(cells.drop(columns="n"), ", ".join(f"{c} int" for c in shape) + ", score double"))
    links = compared.join(scores, shape).where(F.col("score") >= LEAST_SCORE).select("a", "b", "score")
    links = links.join(named.select(F.col("id").alias("a"), F.col("name").alias("_a")), "a").join(named.select(F.col("id").alias("b"), F.col("name").alias("_b")), "b")
    return links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "score")


def name_clusters(records: DataFrame) -> DataFrame:
    """(id, cluster): membership of every id that has links; the cluster is its least id."""
    return clusters(name_links(records))


def same_names(records: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids in one cluster; as many rows as the clusters have pairs."""
    grouped = name_clusters(records)
    left, right = grouped.select(F.col("id").alias("id_a"), "cluster"), grouped.select(F.col("id").alias("id_b"), "cluster")
    return left.join(right, "cluster").where("id_a < id_b").select("id_a", "id_b")
