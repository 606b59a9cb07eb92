"""Articles to chunks: packing by section, years, links, cutoff."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annales.config import DEFAULT, Config
from annales.functions.sentences import pack, sentences, tokens, windows
from annales.functions.text import context_header, year_label
from annales.functions.times import spans
from annales.functions.years import after_cutoff

LEAD = "Mở đầu"


def pieces_of(sections: list[dict], config: Config) -> list[dict]:
    """Pieces (path, text, tokens, sections) of one article; small neighbours under one top heading are joined."""
    cut = ((s["path"], " ".join(g)) for s in sections for g in pack(sentences(s["text"] or ""), config.target_tokens, config.overlap_sentences, config.min_tokens))
    out: list[dict] = []
    for top, run in groupby(cut, key=lambda p: p[0].split(" > ")[0]):
        pieces = [(path, text, tokens(text)) for path, text in run]
        total = [0, *accumulate(n for _, _, n in pieces)]
        at = 0
        while at < len(pieces):
            end = max(at + 1, bisect_right(total, total[at] + config.target_tokens) - 1)
            paths = [path for path, _, _ in pieces[at:end]]
            out.append({"path": paths[0] if len(set(paths)) == 1 else top, "text": "\n".join(text for _, text, _ in pieces[at:end]), "tokens": total[end] - total[at], "sections": paths})
            at = end
    return out


def chunk_articles(articles: DataFrame, periods: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per chunk of articles (page_id, title, label, qid, period_id, period_ids, tier, sections, links).

    Indices count pieces before the cutoff, so ids may have holes. Null or empty
    sections give no chunks. Packing needs the order of sentences and runs in
    Arrow batches; years, labels, links and the cutoff are columns.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, sections in zip(batch["page_id"], batch["sections"]):
                listed = [dict(s) for s in sections] if sections is not None else []
                rows += [(page, i, p["path"], p["text"], p["tokens"], p["sections"]) for i, p in enumerate(pieces_of(listed, config))]
            yield pd.DataFrame(rows, columns=["page_id", "chunk_index", "section_path", "text", "tokens", "_paths"])

    key = dict(articles.dtypes)["page_id"]
    cut = articles.select("page_id", "sections").mapInPandas(pieces, f"page_id {key}, chunk_index int, section_path string, text string, tokens int, _paths array<string>")
    dim = F.broadcast(periods.select(F.col("id").alias("period_id"), F.col("name").alias("_name"), F.col("start_year").alias("_a"), F.col("end_year").alias("_b")))
    rows = cut.join(articles.drop("sections"), "page_id").join(dim, "period_id", "left")
    rows = rows.withColumn("_spans", spans(F.col("text"), F.col("_a"), F.col("_b")))
    label = F.when(F.col("_name").isNotNull(), F.concat("_name", F.lit(" ("), year_label(F.col("_a")), F.lit("–"), year_label(F.col("_b")), F.lit(")")))
    both = F.flatten(F.transform("_spans", lambda s: F.array(s["start"], s["end"])))
    linked = F.filter("links", lambda x: F.array_contains("_paths", x["section"]) & F.contains("text", x["surface"]))
    rows = rows.select(
        F.format_string("%s-%03d", F.col("page_id").cast("string"), "chunk_index").alias("id"), "page_id", F.col("title").alias("page_title"), "qid", "chunk_index", "section_path",
        context_header(F.col("title"), F.col("section_path"), F.coalesce("label", "title"), label).alias("header"), "text", "tokens",
        F.array_distinct(F.transform(F.coalesce(linked, F.array()), lambda x: x["target"])).alias("links"),
        F.array_sort(F.array_distinct(both)).alias("years"), F.array_min(F.transform("_spans", lambda s: s["start"])).alias("min_year"), F.array_max(F.transform("_spans", lambda s: s["end"])).alias("max_year"),
        F.exists("_spans", lambda s: s["legendary"]).alias("legendary"), "period_id", "period_ids", "tier",
    )
    return rows.where(~after_cutoff(F.col("min_year"), F.col("section_path"), config.max_year, LEAD)) if config.drop_post_cutoff else rows


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, sentence)."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentences(t) if t else [])

    return docs.select(key, F.posexplode(split.asNondeterministic()(text)).alias("pos", "sentence"))


def passages(docs: DataFrame, key: str, text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """(key, n, passage): character windows of each document, numbered from 1; null and blank texts have none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, config.passage_chars, config.passage_overlap) if t else [])

    return docs.select(key, F.posexplode(cut.asNondeterministic()(text)).alias("_p", "passage")).select(key, (F.col("_p") + 1).alias("n"), "passage")
