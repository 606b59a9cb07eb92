"""Problem 7: evaluation texts that leak into training text.

Method: spaced-seed hashing. Fixed masks over a window of words ignore some of
its positions; windows of documents and of test items that agree on the kept
positions of a mask meet by hash. Around every meeting the two texts are laid
word over word, single replaced words and short insertions allowed, and the
stretch that reads the same is measured.

Test items are few and bounded, so their hashes travel to the documents: the
join happens where a document is read and only leaks leave the scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annales.llm.visual import LOOKALIKES

#: Kept (1) and ignored (0) positions of each mask; every mask keeps eight words.
MASKS = ("11111111", "1111011110", "111110111", "11011011011", "1101110111", "111011101100")
#: Words of an item that a document must repeat as one stretch, those replaced included.
LEAST_WORDS = 20
#: Share of words in the stretch that must be the same, and the most words in a row that may differ.
LEAST_SAME = 0.75
MOST_REPLACED = 2
#: Equal words of a stretch that must be the item's own: outside runs of STOCK_RUN words that STOCK_ITEMS items share.
LEAST_OWN = 8
STOCK_RUN = 5
STOCK_ITEMS = 3
#: Words by which document and item may drift apart within one stretch (words put between or left out).
DRIFT = 12
#: Words of test items that travel in one pass over the corpus; larger sets take several passes.
WORDS_A_PASS = 2_000_000
#: Words laid over each other at once around a meeting.
REACH = 48

_TAGS = re.compile(r"<[^<>]{0,400}>|https?://\S+|&[a-z]{1,8};|&#x?[0-9a-f]{1,6};", re.IGNORECASE)
_FOREIGN = re.compile("[Ͱ-ӿԀ-ԯ]")
_WORD = re.compile("[a-z0-9]+")
_ALIKE = str.maketrans(LOOKALIKES)
#: Signs that separate words but vanish with what is not ASCII (fixed values).
_SEPARATORS = "–—…“”‘’·•»«。，、  "


def words(text: str | None) -> list[str]:
    """Words without case, accents, character forms, punctuation, tags, addresses and numbers below 100.

    Small numbers are left out because footnote and list marks between words are.
    """
    if not text:
        return []
    if "<" in text or "&" in text or "://" in text:
        text = _TAGS.sub(" ", text)
    # Look-alikes go by their case, so they are told before it is lost.
    if _FOREIGN.search(text):
        text = text.translate(_ALIKE)
    # Dotless i and d with stroke have no decomposition.
    text = text.casefold().replace("đ", "d").replace("ð", "d").replace("ɖ", "d").replace("ı", "i")
    for sign in _SEPARATORS:
        if sign in text:
            text = text.replace(sign, " ")
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return [w for w in _WORD.findall(plain) if len(w) > 2 or not w.isdigit()]


class Probe:
    """Hashes of all mask windows of the test texts, and the measuring of stretches around meetings."""

    def __init__(self, texts: list[tuple[int, list[str]]]) -> None:
        self.vocabulary: dict[str, int] = {}
        rows, owner, starts = [], [], [0]
        for item, body in texts:
            rows += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in body] + [-1]
            owner.append(item)
            starts.append(len(rows))
        self.text = np.array(rows, np.int64)
        self.owner = np.array(owner, np.int64)
        self.starts = np.array(starts, np.int64)
        self.padded = np.concatenate([np.full(REACH, -1), self.text, np.full(REACH, -1)]).astype(np.int32)
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
        self.mult = np.random.default_rng(5).integers(1, 2**62, max(len(m) for m in self.masks), dtype=np.int64) * 2 + 1
        self.own = np.concatenate([np.zeros(REACH, bool), self._own_words(texts), np.zeros(REACH, bool)])
        self.tables = []
        for mask in self.masks:
            keys, at = self._hash(self.text, mask)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], at[order]))

    def _own_words(self, texts: list[tuple[int, list[str]]]) -> np.ndarray:
        """Words outside the stock runs that several items share, in the order of the test texts."""
        shared: dict[tuple, set] = {}
        for item, body in texts:
            for k in range(len(body) - STOCK_RUN + 1):
                shared.setdefault(tuple(body[k : k + STOCK_RUN]), set()).add(item)
        own = []
        for _, body in texts:
            mine = [True] * len(body) + [False]
            for k in range(len(body) - STOCK_RUN + 1):
                if len(shared[tuple(body[k : k + STOCK_RUN])]) >= STOCK_ITEMS:
                    mine[k : k + STOCK_RUN] = [False] * STOCK_RUN
            own += mine
        return np.array(own, bool)

    def _hash(self, seq: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of which every kept word is known, and where these start."""
        n = len(seq) - mask[-1]
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k, offset in enumerate(mask):
            part = seq[offset : offset + n]
            known &= part > 0
            keys += part * self.mult[k]
        at = np.flatnonzero(known)
        keys = keys[at]
        return keys ^ (keys >> 29), at

    def meetings(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in seq, position in the test texts) of the windows that meet, one a diagonal run and mask hit."""
        left, right = [], []
        for mask, (keys, at) in zip(self.masks, self.tables):
            mine, where = self._hash(seq, mask)
            if not len(mine) or not len(keys):
                continue
            low = np.searchsorted(keys, mine)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == mine)
            if not len(hit):
                continue
            low = low[hit]
            count = np.searchsorted(keys, mine[hit], side="right") - low
            first = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            left.append(np.repeat(where[hit], count))
            right.append(at[first])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, q = np.concatenate(left), np.concatenate(right)
        # Meetings on one diagonal within a mask's length tell the same; one of them is measured.
        order = np.lexsort((p, p - q))
        p, q = p[order], q[order]
        d = p - q
        first = np.r_[True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > 8)]
        return p[first], q[first]

    def _side(self, padded: np.ndarray, p: np.ndarray, q: np.ndarray, sign: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words up to the last equal one before more than MOST_REPLACED differing in a row, equal and equal own words, from p and q on (1) or before them (-1); not whole: within REACH."""
        last, equal, own = np.full(len(p), -1), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        live, base = np.arange(len(p)), 0
        while len(live):
            steps = base + np.arange(REACH)
            offsets = steps if sign > 0 else -1 - steps
            a, b = p[live, None] + REACH + offsets, q[live, None] + REACH + offsets
            within = (a >= 0) & (a < len(padded)) & (b >= 0) & (b < len(self.padded))
            a, b = np.clip(a, 0, len(padded) - 1), np.clip(b, 0, len(self.padded) - 1)
            same = (padded[a] == self.padded[b]) & (padded[a] > 0) & within
            latest = np.maximum(np.maximum.accumulate(np.where(same, steps, -1), axis=1), last[live, None])
            broken = steps - latest > MOST_REPLACED
            stop = np.where(broken.any(axis=1), broken.argmax(axis=1), REACH)
            hits = same & (np.arange(REACH) < stop[:, None])
            equal[live] += hits.sum(axis=1)
            own[live] += (hits & self.own[b]).sum(axis=1)
            last[live] = np.where(stop > 0, latest[np.arange(len(live)), np.maximum(stop - 1, 0)], last[live])
            live, base = live[stop == REACH] if whole else live[:0], base + REACH
        return last + 1, equal, own

    def stretches(self, padded: np.ndarray, p: np.ndarray, q: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end on the item's side, equal words and equal own words of the stretch through each meeting, read in windows of REACH to its real ends."""
        after, before = self._side(padded, p, q, 1, whole), self._side(padded, p, q, -1, whole)
        return q - before[0], q + after[0], after[1] + before[1], after[2] + before[2]

    def leaks(self, seq: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document number, item, words of the stretch, equal words), the longest stretch of each pair.

        `seq` holds the documents one after the other with breaks between, `edges` their starts.
        """
        p, q = self.meetings(seq)
        if not len(p):
            return (np.empty(0, np.int64),) * 4
        padded = np.concatenate([np.full(REACH, -2), seq, np.full(REACH, -2)]).astype(np.int32)
        # A long stretch may thin out at its ends, so its near part is judged as well.
        parts = [self.stretches(padded, p[a : a + 50_000], q[a : a + 50_000], whole) for whole in (True, False) for a in range(0, len(p), 50_000)]
        low, high, equal, own = (np.concatenate(x) for x in zip(*parts))
        p, q = np.tile(p, 2), np.tile(q, 2)
        doc = np.searchsorted(edges, p, side="right") - 1
        text = np.searchsorted(self.starts, q, side="right") - 1
        # Parts of one stretch on neighbouring diagonals are joined where words were put between or left out.
        rows = np.unique(np.stack([doc, text, low, high, p - q, equal, own], axis=1), axis=0)
        doc, text, low, high, drift, equal, own = rows.T
        span = high - low
        good = (span >= LEAST_WORDS) & (equal >= LEAST_SAME * span) & (own >= LEAST_OWN)
        pair = doc * len(self.owner) + text
        loose = ~np.isin(pair, pair[good])
        many = np.flatnonzero(loose)
        found = [(doc[good], text[good], span[good], equal[good])]
        if len(many):
            order = np.lexsort((low[many], pair[many]))
            many = many[order]
            cuts = np.flatnonzero(np.r_[True, pair[many][1:] != pair[many][:-1], True])
            joined = [self._joined(low[m], high[m], drift[m], equal[m], own[m], doc[m[0]], text[m[0]]) for m in (many[a:b] for a, b in zip(cuts[:-1], cuts[1:])) if len(m) > 1]
            joined = [x for x in joined if x]
            if joined:
                found.append(tuple(np.array(x) for x in zip(*joined)))
        doc, text, span, equal = (np.concatenate(x) for x in zip(*found))
        item = self.owner[text]
        order = np.lexsort((-equal, -span, item, doc))
        doc, item, span, equal = doc[order], item[order], span[order], equal[order]
        first = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])] if len(doc) else np.empty(0, bool)
        return doc[first], item[first], span[first], equal[first]

    @staticmethod
    def _joined(low, high, drift, equal, own, doc, text) -> tuple[int, int, int, int] | None:
        """The longest chain of stretches of one pair of texts that follow each other with little drift."""
        best = None
        chains: list[tuple[int, int, int, int, int]] = []
        for a, b, d, e, o in zip(low, high, drift, equal, own):
            options = [(a, b, d, e, o)]
            for ca, cb, cd, ce, co in chains:
                gap = a - cb
                if -8 <= gap <= MOST_REPLACED and b > cb and 0 < abs(d - cd) <= DRIFT:
                    options.append((ca, b, d, ce + e - max(0, -gap), co + o - max(0, -gap)))
            one = max(options, key=lambda x: (x[1] - x[0], x[3]))
            chains.append(one)
            span = one[1] - one[0]
            if span >= LEAST_WORDS and one[3] >= LEAST_SAME * span and one[4] >= LEAST_OWN and (best is None or (span, one[3]) > best[2:]):
                best = (int(doc), int(text), int(span), int(one[3]))
        return best


def _passes(items: DataFrame, key: str, fields: tuple[str, ...]) -> list[list[tuple[int, list[str]]]]:
    """Test texts in passes of bounded size. The rows are read in slices so that one slice at a time is held raw."""
    passes, now, size = [], [], 0
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), *[F.col(f).cast("string") for f in fields]).distinct()
    for row in rows.toLocalIterator():
        for body in row[1:]:
            text = words(body)
            if not text:
                continue
            if size + len(text) > WORDS_A_PASS and now:
                passes.append(now)
                now, size = [], 0
            now.append((row[0], text))
            size += len(text)
    return [*passes, now] if now else passes


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", fields: tuple[str, ...] = ("question", "passage")) -> DataFrame:
    """(doc, item, n_words, n_equal): documents that repeat a stretch of a test item's text, the longest per pair.

    A leak is a stretch of at least LEAST_WORDS words of one field, in order, of
    which LEAST_SAME are the same, LEAST_OWN of them outside phrases that many
    items share, and never more than MOST_REPLACED in a row differ; case, accents, character forms, punctuation, spacing, tags and small
    numbers don't count, and short insertions don't break it. Null and empty
    texts leak nothing, as do fields shorter than a mask. Repeated rows give one
    result row. Documents are read whole, whatever their length.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    schema = f"doc {kind}, item long, n_words int, n_equal int"
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    out = None
    for texts in _passes(items, item_key, fields):
        packed = spark.sparkContext.broadcast(texts)

        def scan(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            probe = Probe(packed.value)
            known = probe.vocabulary.get
            for batch in batches:
                ids, edges = [], []
                for body in batch.column("text").to_pylist():
                    edges.append(len(ids))
                    ids += [known(w, 0) for w in words(body)]
                    # More breaks than words may differ in a row, so no stretch runs into the next document.
                    ids += [-1] * (MOST_REPLACED + 1)
                doc, item, span, equal = probe.leaks(np.array(ids, np.int64), np.array(edges, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc)), pa.array(item), pa.array(span.astype(np.int32)), pa.array(equal.astype(np.int32))], names=["doc", "item", "n_words", "n_equal"])

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame(pd.DataFrame({"doc": [], "item": [], "n_words": [], "n_equal": []}), schema)
    best = out.groupBy("doc", "item").agg(F.max(F.struct("n_words", "n_equal")).alias("_b"))
    return best.select("doc", "item", "_b.n_words", "_b.n_equal")
