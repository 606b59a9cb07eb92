"""Problem 6: bring visually identical text to one form.

Method: text is exploded to positioned code points; broadcast joins replace
each by its decomposition or look-alike; combining marks are ordered by class
within their starter's run; runs are recomposed through a join with the
composition table (those it doesn't hold as a whole by the rule it is made
from); strings are rebuilt in order. Only values that hold a code
point outside the ordinary set are exploded, which a JVM-side pattern decides.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of other scripts and the Latin letters they look like (fixed values).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "Һ": "H",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
}
#: Latin letters that stand for another Latin letter here, whatever word they are in (fixed values).
LATIN_LOOKALIKES = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g"}
#: Punctuation that stays although compatibility forms would replace it (fixed values).
LEGITIMATE = "–—‘’“”…"
#: Hyphens that look like the ordinary one (fixed values).
HYPHENS = {"‐": "-", "‑": "-", "‒": "-", "−": "-"}

# Values made only of these are ordinary and pass unchanged: ASCII without controls, line breaks and
# tabs, composed Latin letters but the look-alikes above, and the legitimate punctuation.
_ORDINARY = r"\x{20}-\x{7E}\n\t\r\x{C0}-\x{CF}\x{D1}-\x{D6}\x{D8}-\x{EF}\x{F1}-\x{F6}\x{F8}-\x{130}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{1A0}\x{1A1}\x{1AF}\x{1B0}\x{1E00}-\x{1E99}\x{1E9E}-\x{1EFF}" + "".join(f"\\x{{{ord(c):X}}}" for c in LEGITIMATE)
ODD = f"[^{_ORDINARY}]"
#: Words as runs of letters, marks and invisible characters; every other code point on its own.
_WORDS = r"(?s)[\p{L}\p{M}\p{Cf}]+|."
_LOOKALIKE_CLASS = "[" + "".join(LOOKALIKES) + "]"


@lru_cache(1)
def _tables() -> tuple[list[tuple[str, str]], list[tuple[str, int]], list[tuple[str, str]]]:
    """Replacement by code point, class of combining marks, composed form by decomposed run.

    Built by rule from the Unicode data; their size is bounded by the standard
    (below 20,000 rows), so they may be broadcast at any input size.
    """
    replace, classes, composed = [], [], []
    for code in range(sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0xE000 <= code <= 0xF8FF or code >= 0xF0000:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cn" and not 0xFE00 <= code <= 0xFE0F:
            continue
        if unicodedata.combining(c):
            classes.append((c, unicodedata.combining(c)))
        if c in LEGITIMATE:
            continue
        if kind in ("Cf", "Cc") and c not in "\n\t\r" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code == 0x34F:
            replace.append((c, ""))
        elif kind == "Zs" and c != " ":
            replace.append((c, " "))
        elif c in HYPHENS:
            replace.append((c, HYPHENS[c]))
        elif c in LATIN_LOOKALIKES:
            replace.append((c, LATIN_LOOKALIKES[c]))
        elif (d := unicodedata.normalize("NFKD", c)) != c:
            replace.append((c, d))
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.normalize("NFC", d) == c:
            composed.append((d, c))
    return replace, classes, composed


@lru_cache(1)
def _second_starters() -> str:
    """A class of the starters that compose with a starter before them: parts of syllables and of two-part vowels."""
    found = {c for code in range(sys.maxunicode + 1) if not 0xAC00 <= code <= 0xD7A3 for c in unicodedata.normalize("NFD", chr(code))[1:] if not unicodedata.combining(c)}
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(found)) + r"\x{1161}-\x{1175}\x{11A8}-\x{11C2}]"


def _broadcast(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]), schema))


def canonical(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, canonical, changed), one row per distinct key and value.

    `canonical` is the value with ordinary composed characters in place of
    full-width and other compatibility forms, combining sequences, invisible
    characters, unusual spaces and look-alike letters inside words that also
    have Latin letters or alone among Latin words. Curly quotes, dashes, ellipses and words wholly in
    another script stay. Null values stay null and unchanged; empty strings
    stay empty; a value of invisible characters alone becomes empty. Rows that
    repeat key and value count once; null keys are kept. Texts of any length
    are handled whole.
    """
    spark = df.sparkSession
    replace, classes, composed = _tables()
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("string").alias("_value"))
    odd = F.col("_value").rlike(ODD)
    plain = rows.where(F.col("_value").isNull() | ~odd).distinct().select("_key", "_value", F.col("_value").alias("_canonical"))
    # One row per odd value and word, then per code point. Two hashes stand for key and value on the way: a
    # long text carried by each of its code points would be quadratic.
    strange = rows.where(odd).distinct().withColumns({"_v1": F.xxhash64("_key", "_value"), "_v2": F.hash("_value", "_key")})
    # What is asked of a whole value or word is asked before it is exploded, once.
    words = strange.withColumn("_roman", F.col("_value").rlike(r"\p{IsLatin}")).select("_v1", "_v2", "_roman", F.posexplode(F.regexp_extract_all("_value", F.lit(_WORDS), F.lit(0))).alias("_w", "_word"))
    # A single letter is no word of another script where the rest of the value is Latin.
    lone = F.col("_word").rlike(rf"^[\p{{M}}\p{{Cf}}]*{_LOOKALIKE_CLASS}[\p{{M}}\p{{Cf}}]*$") & F.col("_roman")
    mixed = (F.col("_word").rlike(r"\p{IsLatin}") & F.col("_word").rlike(_LOOKALIKE_CLASS)) | lone
    points = words.withColumn("_mixed", mixed).select("_v1", "_v2", "_w", "_mixed", F.posexplode(F.regexp_extract_all("_word", F.lit("(?s)."), F.lit(0))).alias("_p", "_c"))
    swap = _broadcast(spark, replace, "_c string, _to string")
    alike = _broadcast(spark, list(LOOKALIKES.items()), "_c string, _latin string")
    points = points.join(swap, "_c", "left").join(alike, "_c", "left")
    text = F.when(F.col("_mixed") & F.col("_latin").isNotNull(), F.col("_latin")).otherwise(F.coalesce("_to", "_c"))
    # Replacements may be several code points; each gets its own position.
    points = points.select("_v1", "_v2", "_w", "_p", F.posexplode(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("_q", "_c"))
    points = points.join(_broadcast(spark, classes, "_c string, _class int"), "_c", "left").withColumn("_class", F.coalesce("_class", F.lit(0)))
    row = Window.partitionBy("_v1", "_v2").orderBy("_w", "_p", "_q")
    runs = points.withColumn("_run", F.sum(F.when(F.col("_class") == 0, 1).otherwise(0)).over(row)).withColumn("_at", F.row_number().over(row))
    ordered = runs.groupBy("_v1", "_v2", "_run").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_class", "_at", "_c"))), lambda x: x["_c"])).alias("_d"))
    joined = ordered.join(_broadcast(spark, composed, "_d string, _to string"), "_d", "left").withColumn("_c", F.coalesce("_to", "_d"))
    # Runs of several code points that no composed form stands for as a whole: their starter composes with some marks only.
    left = (F.length("_d") > 1) & F.col("_to").isNull()
    built = joined.groupBy("_v1", "_v2").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_run", "_c"))), lambda x: x["_c"])).alias("_built"), F.max(left).alias("_left"))
    built = built.withColumn("_left", F.col("_left") | F.col("_built").rlike(_second_starters()))

    @F.pandas_udf("string")
    def composed_form(texts: pd.Series) -> pd.Series:
        """Composition of the few values with runs that the table doesn't hold; null for the others."""
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    built = built.withColumn("_built", F.coalesce(composed_form(F.when(F.col("_left"), F.col("_built"))), F.col("_built")))

    # A value of which nothing is left has no code point to rebuild it from.
    built = built.select("_v1", "_v2", F.col("_built").alias("_canonical")).join(strange, ["_v1", "_v2"]).select("_key", "_value", "_canonical")
    gone = strange.where(F.regexp_replace("_value", r"[\p{Cf}\p{Cc}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{34F}&&[^\n\t\r]]", "") == "").select("_key", "_value", F.lit("").alias("_canonical"))
    whole = plain.unionByName(built).unionByName(gone)
    return whole.select(F.col("_key").alias(key), F.col("_value").alias(value), F.col("_canonical").alias("canonical"), (~F.col("_value").eqNullSafe(F.col("_canonical"))).alias("changed"))
