"""Problem 4: cut oversized texts at natural boundaries, with overlap.

Method: recursive separator hierarchy. Boundaries are tried from the most
natural to the least: section, paragraph, line, sentence, word, character.
Inside the room a piece has left, the furthest boundary of the best level that
occurs there is the cut, which is what greedy packing of the recursively split
units comes to. Each piece then starts with up to `overlap` trailing characters
of the piece before, trimmed to start at a sentence or else a word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2400
OVERLAP = 200

#: A boundary is the end of a match: what follows it opens the next piece.
LEVELS = (
    re.compile(r"\n[ \t]*\n?(?=#{1,6}\s|={2,6}[^=]|\\(?:sub)*section\b|<[hH][1-6]\b)"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]"),
    re.compile(r"\s+"),
)
LEVEL_NAMES = ("section", "paragraph", "line", "sentence", "word", "character")


def _cut(text: str, start: int, room: int) -> tuple[int, int]:
    """End of the piece that starts at `start` and may hold `room` characters; level of that boundary."""
    stop = start + room
    if stop >= len(text):
        return len(text), -1
    for level, pattern in enumerate(LEVELS):
        best = -1
        for match in pattern.finditer(text, start, min(len(text), stop + 1)):
            if start < match.end() <= stop:
                best = match.end()
        if best > start and text[start:best].strip():
            return best, level
    while stop > start + 1 and unicodedata.combining(text[stop]):
        stop -= 1
    if stop == start + 1 and unicodedata.combining(text[stop]):
        stop = start + room
    return stop, len(LEVELS)


def _tail(text: str, low: int, end: int, overlap: int) -> int:
    """Start of the repeated stretch: at most `overlap` characters before `end`, none before `low`."""
    first = max(low, end - overlap)
    if first <= low or overlap <= 0:
        return first if overlap > 0 else end
    for pattern in LEVELS[3:]:
        for match in pattern.finditer(text, first, end):
            if match.end() < end:
                return match.end()
    while first < end and unicodedata.combining(text[first]):
        first += 1
    return first


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces of `text` as (start, start of new characters, end, boundary level).

    `text[start:end]` is the piece and never longer than `limit`; the stretches
    `text[new:end]` join to `text` exactly.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    pieces, new, start = [], 0, 0
    while True:
        end, level = _cut(text, new, limit - (new - start))
        pieces.append((start, new, end, level))
        if end >= len(text):
            return pieces
        start = _tail(text, new, end, overlap)
        new = end


def split_oversized(
    df: DataFrame, key: str = "id", text: str = "text", carry: tuple[str, ...] = ("section_path",), limit: int = LIMIT, overlap: int = OVERLAP, order: tuple[str, ...] = ("loaded_at", "load_seq"), only_oversized: bool = False
) -> DataFrame:
    """One row per piece: key, carried columns, piece_index, n_pieces, start_char, overlap_chars, boundary, text.

    Of rows with the same key the one with the largest `order` counts (columns
    that are missing are passed over). Texts within `limit`, null and empty ones
    included, come out whole as one piece and never enter Python; with
    `only_oversized` they are left out. Rows with a null key are dropped.
    Lengths are Unicode code points. `section_path` is carried as it is, null
    included. Extra columns of the input are ignored, whatever their names.
    """
    order = tuple(c for c in order if c in df.columns)
    carry = tuple(c for c in carry if c in df.columns)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("_text"), F.struct(*[F.col(c) for c in order], F.xxhash64(F.col(text))).alias("_order"))
    newest = rows.groupBy("_key").agg(F.max("_order").alias("_order"))
    long = rows.where(F.length("_text") > limit)
    # Only keys and order are shuffled for the repeated deliveries, and only oversized texts join them.
    kept = long.join(newest, ["_key", "_order"], "left_semi").dropDuplicates(["_key"])
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in ("_key", *[f"_c{i}" for i in range(len(carry))]))
    names = ["_key", *[f"_c{i}" for i in range(len(carry))]]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch[[*names, "_text"]].itertuples(index=False, name=None):
                body = row[-1]
                pieces = split_text(body, limit, overlap)
                out += [(*row[:-1], i, len(pieces), a, n - a, LEVEL_NAMES[level] if level >= 0 else "end", body[a:b]) for i, (a, n, b, level) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=[*names, "piece_index", "n_pieces", "start_char", "overlap_chars", "boundary", "piece"])

    pieces = kept.select(*names, "_text").mapInPandas(cut, f"{head}, piece_index int, n_pieces int, start_char int, overlap_chars int, boundary string, piece string")
    if not only_oversized:
        short = rows.where(F.col("_text").isNull() | (F.length("_text") <= limit)).join(newest, ["_key", "_order"], "left_semi").dropDuplicates(["_key"])
        pieces = pieces.unionByName(short.select(*names, F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.lit(0).alias("overlap_chars"), F.lit("end").alias("boundary"), F.col("_text").alias("piece")))
    return pieces.select(F.col("_key").alias(key), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "piece_index", "n_pieces", "start_char", "overlap_chars", "boundary", F.col("piece").alias(text))
