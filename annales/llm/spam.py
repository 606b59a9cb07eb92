"""Problem 9: keyword-stuffed and link-list pages.

Method: pages are read as sequences of function words and word classes and
scored under a trigram model trained on prose. The corpus trains the model
itself: pages that are built of sentences and don't repeat themselves count as
prose, all of them, not a sample. Such pages may still be shuffled words, so a
trigram is part of the model only where pages that aren't copies of each other
agree on it, which a page of shuffled words can't bring about, and only
sentences are read for it, so that the links and lists at the end of an article
don't teach it lists. Costs are averaged over a sliding window; a word belongs to
abnormal text where that average lies far outside the middle of prose. Costs
alone don't tell keywords from sentences whose words are out of order; what does
is that keywords stand outside sentences, are repeated or are rare. A page is
flagged when more than half of its words are abnormal and lie where most words
are such, or when nearly all are abnormal.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annales.session import ensure_checkpoint_dir

#: Share of prose pages in which a word must occur to stand for itself; rarer ones are classes.
FUNCTION_SHARE = 0.004
#: Words of the sliding window.
WINDOW = 20
#: Prose pages: share of words in sentences of five words or more; most four-word runs that may repeat.
PROSE_SENTENCES = 0.9
PROSE_REPEATS = 0.5
#: A list: this many commas or more, with fewer words for each. Words of the longest sentence; beyond, stops are missing.
LIST_COMMAS, LIST_WORDS = 3, 9
LONGEST = 80
#: Share of a page's words that must lie in abnormal text of keywords, and in abnormal text of any words.
FLAG_SHARE = 0.5
ORDER_SHARE = 0.85
#: A trigram is known when this many pages that aren't copies of each other have it, when this share of the prose pages
#: have it, and when it is this share of all. By the second the same is known at any size of the corpus: with a number of
#: pages alone, a larger one knows what ever rarer pages hold. The third bounds the model, which is broadcast, by
#: 1/LEAST_PART trigrams of 16 bytes.
LEAST_PAGES = 3
LEAST_SHARE = 3e-4
LEAST_PART = 2e-7
#: Costs of windows are told in this many steps of so many nats, those of all prose in finer ones.
STEPS, STEP = 128, 0.08
FINE, FINE_STEP = 1024, 0.01
#: A window is abnormal where its cost exceeds the median of prose by HIGH times the way from there to the upper tenth,
#: or falls below LOW times the lowest hundredth. Both hold though a tenth of what counts as prose were something else.
HIGH, LOW = 7.0, 0.5

#: Prose pages: most words that may be neither function words nor names.
PROSE_RARE = 0.1
#: Longest run of capitalised or of rare words read as one.
NAME_RUN = 5

#: Classes; function words are numbered from len(CLASSES) on.
CLASSES = ("<page>", "<name>", "<word>", "<number>", "<address>", "<tag>", "<link>", "<sign>", "<stop>", "<comma>")
PAGE, NAME, WORD, NUMBER, ADDRESS, TAG, LINK, SIGN, STOP, COMMA = range(len(CLASSES))
# A link that opens a line is a class of its own; inside a line only its words count, and so it is with
# line ends, brackets, quotes and markup. The commonest alternatives come first.
_TOKEN = re.compile(r"(?m)https?://\S+|www\.\S+|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|#\w+|^[^\w\n]{0,4}\[\[|^[ \t]*[-*+•»–—]+[ \t]|[.!?…]+|[,;:/|–—·•]|[^\w\s.,;:()\"“”‘’'\[\]<>=_#]+")
_LINE_LINK = re.compile(r"(?m)^[^\w\n<]{0,4}<[aA]\b[^<>]{0,400}>")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
# Marks of footnotes and citations stand between words of prose and are none.
_FOOTNOTE = re.compile(r"\[\d{1,4}\]")
_INVISIBLE = re.compile("[­͏​-‏⁠﻿︀-️]")
#: Raw codes: classes stay below WORDS; words are WORDS + 4 * hash + 2 * all capitals + capital.
WORDS = 16
_HASHES = 1 << 28
#: By raw code, WORDS for all words: whether it counts as a word, and whether no sentence has it.
_IS_WORD = np.isin(np.arange(WORDS + 1), (NUMBER, TAG, ADDRESS, WORDS)).astype(float)
_IS_SPOILING = np.isin(np.arange(WORDS + 1), (TAG, ADDRESS, LINK)).astype(float)
#: Most pairs of codes that are told from a table of all of them; more are searched for.
_TABLE = 2_000_000


def fold(word: str) -> str:
    """A word without case and accents."""
    return unicodedata.normalize("NFKD", word.lower().replace("đ", "d")).encode("ascii", "ignore").decode() or word.lower()


def tokens(text: str) -> list[str]:
    if "<" in text:
        text = _MARKUP.sub("", _LINE_LINK.sub("[[", text))
    if "[" in text:
        text = _FOOTNOTE.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return _TOKEN.findall(text)


class Coder(dict):
    """Raw codes of tokens, remembered per worker. Two words share a code with a chance of one in 2^28."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        first = token[0]
        if token[-2:] == "[[":
            code = LINK
        elif first.isalpha():
            if "://" in token or token[:4] == "www.":
                code = ADDRESS
            else:
                h = zlib.crc32(fold(token).encode()) % _HASHES
                capital = first != first.lower()
                code = WORDS + 4 * h + 2 * (capital and len(token) > 1 and token.isupper()) + capital
        elif first.isdigit():
            code = NUMBER
        elif first == "#" and len(token) > 1:
            code = TAG
        elif first in ".!?…":
            code = STOP
        elif token in ",;:/|–—·•":
            code = COMMA
        else:
            code = SIGN
        self[token] = code
        return code

    def page(self, text: str | None) -> bytes:
        """The page as raw codes between two page marks."""
        return np.array([PAGE, *[self[t] for t in tokens(text)], PAGE] if text else [PAGE, PAGE], np.int32).tobytes()


def classes(raw: np.ndarray, starts: np.ndarray, function: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, weights, starts, group): class sequences of pages, given the sorted hashes of function words; group is the token each raw code went into.

    A capitalised word is a name inside a sentence; at its start, or in text set
    in capitals, it is the function word it looks like. A run of up to NAME_RUN
    names or rare words is one token that weighs as many words as it has; signs
    and marks weigh nothing.
    """
    n = len(raw)
    word = raw >= WORDS
    h = (raw.astype(np.int64) - WORDS) >> 2
    if len(function):
        at = np.minimum(np.searchsorted(function, h), len(function) - 1)
        known = word & (function[at] == h)
    else:
        at, known = np.zeros(n, np.int64), np.zeros(n, bool)
    capital, capitals = word & ((raw - WORDS) & 1 > 0), word & ((raw - WORDS) & 2 > 0)
    mark = np.where(word, PAGE, raw)
    opens = np.r_[True, ~word[:-1] & np.isin(mark[:-1], (PAGE, STOP, SIGN, LINK))][:n]
    codes = np.where(word, np.where(known & (~capital | opens | capitals), at + len(CLASSES), np.where(capital, NAME, WORD)), raw).astype(np.int64)
    counts = word | np.isin(codes, (NUMBER, TAG, ADDRESS))
    # The place in a run of names or rare words decides where the run's next token begins.
    place = np.arange(n)
    began = np.maximum.accumulate(np.where(np.r_[True, codes[1:] != codes[:-1]][:n], place, -1))
    keep = ((codes != NAME) & (codes != WORD)) | ((place - began) % NAME_RUN == 0)
    group = np.cumsum(keep) - 1
    weights = np.bincount(group, weights=counts, minlength=group[-1] + 1 if n else 0)
    return codes[keep], weights, group[starts], group


def _page_of(starts: np.ndarray, n: int) -> np.ndarray:
    page = np.zeros(n, np.int64)
    page[starts[1:]] = 1
    return np.cumsum(page)


def in_sentences(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which tokens lie in sentences, how many words each is)."""
    mark = np.minimum(raw, WORDS)
    weights = _IS_WORD[mark]
    # A sentence has 5 to LONGEST words, six for each comma, more for each of several, a stop and no tag, address or link.
    ends = (mark == PAGE) | (mark == STOP)
    segment = np.r_[0, np.cumsum(ends)[:-1]][: len(raw)]
    size = np.bincount(segment, weights)
    spoilt = np.bincount(segment, _IS_SPOILING[mark]) > 0
    stopped = np.bincount(segment, mark == STOP) > 0
    commas = np.bincount(segment, mark == COMMA)
    listed = (6 * commas > size) | (commas >= LIST_COMMAS) & (LIST_WORDS * commas > size)
    return ((size >= 5) & (size <= LONGEST) & ~spoilt & ~listed & stopped)[segment], weights


def _named(raw: np.ndarray) -> np.ndarray:
    """Raw codes with one code for all capitalised words."""
    return np.where((raw >= WORDS) & ((raw - WORDS) & 1 > 0), NAME, raw)


def prose_pages(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which pages are prose by their build alone: sentences that don't repeat four-token runs."""
    pages = len(starts)
    page = _page_of(starts, len(raw))
    sentence, weights = in_sentences(raw)
    total = np.bincount(page, weights, pages)
    inside = np.bincount(page, weights * sentence, pages)
    good = (total >= 12) & (inside >= PROSE_SENTENCES * total)
    return good & (_repeats(_named(raw), page, pages) <= PROSE_REPEATS)


def repeated(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run of three, with one name at most and no stop, that their page has more than once."""
    codes = _named(raw).astype(np.int64)
    n = max(0, len(codes) - 2)
    a, b, c = codes[:n], codes[1 : n + 1], codes[2:]
    name, end = codes == NAME, np.isin(codes, (PAGE, STOP))
    plain = np.flatnonzero((name[:n].astype(np.int8) + name[1 : n + 1] + name[2:] < 2) & ~(end[:n] | end[1 : n + 1] | end[2:]))
    run = (a * 1_000_003 + b * 998_244_353 + c * 754_974_721)[plain]
    run = (_page_of(starts, len(codes))[plain] << 40) | ((run * 2_305_843_009 >> 20) & ((1 << 40) - 1))
    order = np.argsort(run)
    same = run[order[1:]] == run[order[:-1]]
    at = plain[order[np.r_[False, same] | np.r_[same, False]]] if len(run) else plain
    out = np.zeros(len(codes), bool)
    for k in range(3):
        out[at + k] = True
    return out


def _repeats(codes: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """Share of each page's four-token runs without names and stops that have occurred on it before."""
    n = max(0, len(codes) - 3)
    mult = np.array([1_000_003, 998_244_353, 754_974_721, 167_772_161], np.int64)
    run, plain = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(4):
        part = codes[k : n + k]
        run += part * mult[k]
        plain &= ~np.isin(part, (NAME, PAGE, STOP))
    # 40 bits of the run behind the page's number, so that one sort of numbers tells both.
    run = np.sort((page[:n][plain] << 40) | ((run[plain] * 2_305_843_009 >> 20) & ((1 << 40) - 1)))
    every = np.bincount(run >> 40, minlength=pages)
    distinct = np.bincount(run[np.r_[True, run[1:] != run[:-1]][: len(run)]] >> 40, minlength=pages)
    return 1 - distinct / np.maximum(every, 1)


def _before(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code two before and the code before each, page marks at the start of a page."""
    one, two = np.r_[PAGE, codes[:-1]], np.r_[PAGE, PAGE, codes[:-2]][: len(codes)]
    one[starts] = PAGE
    two[starts] = PAGE
    two[np.minimum(starts + 1, len(codes) - 1)] = PAGE
    return two, one


class Trigrams:
    """Costs of tokens in nats, interpolating trigram, bigram and unigram estimates (Witten-Bell)."""

    def __init__(self, size: int, keys: np.ndarray, counts: np.ndarray) -> None:
        self.size = size
        order = np.argsort(keys)
        self.k3, self.c3 = keys[order], counts[order].astype(np.float64)
        a_b, c = self.k3 // size, self.k3 % size
        self.k2, self.h3, self.t3 = self._context(a_b, self.c3)
        b_c = self.k3 % (size * size)
        self.kb, inverse = np.unique(b_c, return_inverse=True)
        self.cb = np.bincount(inverse, self.c3)
        self.h2 = np.bincount(self.kb // size, self.cb, size)
        self.t2 = np.bincount(self.kb // size, minlength=size).astype(np.float64)
        unigram = np.bincount(c, self.c3, size)
        self.p1 = (unigram + 0.5) / (unigram.sum() + 0.5 * size)
        self.tables = [self._table(self.kb, self.cb), self._table(self.k2, self.h3), self._table(self.k2, self.t3)]

    def _table(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray | None:
        if self.size**2 > _TABLE:
            return None
        out = np.zeros(self.size**2)
        out[keys] = values
        return out

    def _pair(self, table: int, keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The values of pairs of codes, 0 where there are none."""
        dense = self.tables[table]
        return self._look(keys, values, wanted) if dense is None else dense[wanted]

    @staticmethod
    def _context(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, np.bincount(inverse, counts), np.bincount(inverse).astype(np.float64)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def costs(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Cost of each token given the two before it on its page."""
        two, one = _before(codes, starts)
        p = self.p1[codes]
        h, t = self.h2[one], self.t2[one]
        p = np.where(h > 0, (self._pair(0, self.kb, self.cb, one * self.size + codes) + t * p) / np.maximum(h + t, 1), p)
        context = two * self.size + one
        h, t = self._pair(1, self.k2, self.h3, context), self._pair(2, self.k2, self.t3, context)
        p = np.where(h > 0, (self._look(self.k3, self.c3, context * self.size + codes) + t * p) / np.maximum(h + t, 1), p)
        return -np.log(p)


def windowed(values: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Mean of the values around each position, within its page."""
    n = len(values)
    total = np.r_[0.0, np.cumsum(values)]
    page = _page_of(starts, n)
    first, last = starts[page], np.r_[starts[1:], n][page]
    at = np.arange(n)
    # At the ends of a page the window is moved inside rather than cut.
    low = np.maximum(first, np.minimum(at - width // 2, last - width))
    high = np.minimum(last, low + width)
    return (total[high] - total[low]) / np.maximum(high - low, 1)


def _pages(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(raw codes of all pages of a batch, start of each page)."""
    column = batch.column("raw")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
    return data, (offsets[:-1] - offsets[0]).astype(np.int64) // 4


def _function_words(pages: DataFrame) -> np.ndarray:
    """Sorted hashes of words in lower case of FUNCTION_SHARE of the prose pages or more: as many as a page has distinct words, over that share, at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = _pages(batch)
            if not len(starts):
                continue
            page = _page_of(starts, len(raw))
            lower = (raw >= WORDS) & ((raw - WORDS) & 1 == 0)
            once = np.unique((page[lower] << 28) | ((raw[lower].astype(np.int64) - WORDS) >> 2)) & (_HASHES - 1)
            h, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[h, -1]), pa.array(np.r_[n, len(starts)].astype(np.int64))], names=["h", "n"])

    counted = pages.where("prose").select("raw").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).checkpoint()
    total = counted.where("h = -1").agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("h") >= 0) & (F.col("n") >= max(2, FUNCTION_SHARE * total))).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64))


def _trigrams(pages: DataFrame, function: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the trigrams that prose pages agree on; keys are numbers in base of the number of codes."""
    size = len(CLASSES) + len(function)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = _pages(batch)
            if not len(starts):
                continue
            # Copies of a page, near ones mostly too, have the same least hash of four words and count as one.
            four = (raw.astype(np.int64) + 1) * 0x2545F4914F6CDD1D
            four[:-3] += four[1:-2] * 31 + four[2:-1] * 961 + four[3:] * 29791
            group = np.minimum.reduceat((four ^ four >> 29) * 0x1B873593CC9E2D51 & (2**62 - 1), starts) >> 20 & 63
            kept = in_sentences(raw)[0] | (raw == PAGE)
            starts = (np.cumsum(kept) - 1)[starts]
            codes, weights, starts, _ = classes(raw[kept], starts, function)
            page = _page_of(starts, len(codes))
            common = np.bincount(page, weights * (codes == WORD), len(starts)) <= PROSE_RARE * np.bincount(page, weights, len(starts))
            two, one = _before(codes, starts)
            keys = (two * size + one) * size + codes
            bits = len(starts).bit_length()
            both, n = np.unique((keys << bits | page)[common[page]], return_counts=True)
            if not len(both):
                continue
            key, on = both >> bits, both & (1 << bits) - 1
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            seen = np.bitwise_or.reduceat(np.int64(1) << group[on].astype(np.int64), first)
            # All pages are told under the key -1.
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[key[first], -1]), pa.array(np.r_[np.add.reduceat(n, first), 0].astype(np.int64)), pa.array(np.r_[seen, 0]), pa.array(np.r_[np.diff(np.r_[first, len(both)]), common.sum()].astype(np.int64))], names=["key", "n", "seen", "pages"])

    counted = pages.where("prose").select("raw").mapInArrow(count, "key long, n long, seen long, pages long").groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("seen").alias("seen"), F.sum("pages").alias("pages")).checkpoint()
    total, every = (x or 0 for x in counted.agg(F.sum("n"), F.max(F.when(F.col("key") == -1, F.col("pages")))).first())
    known = counted.where((F.bit_count("seen") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * every) & (F.col("n") >= LEAST_PART * total)).select("key", "n").toPandas()
    return known["key"].to_numpy(np.int64), known["n"].to_numpy(np.int64)


def spam_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, abnormal_share, mean_cost, spam) of every document.

    A word is abnormal where the mean cost of the WINDOW tokens around it lies
    outside the bounds of prose; spam is told by FLAG_SHARE and ORDER_SHARE. Documents without words (null and empty texts
    among them) are not spam and have a null share and cost; so has every
    document where the corpus holds no prose to train on. Null keys are left
    out. Repeated rows are scored each. Texts are read whole.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = dict(docs.dtypes)[key]
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            raw = pa.array([coder.page(t) for t in batch.column("text").to_pylist()], pa.binary())
            coded = pa.RecordBatch.from_arrays([batch.column("doc"), raw], names=["doc", "raw"])
            good = prose_pages(*_pages(coded)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*coded.columns, pa.array(good, pa.bool_())], names=["doc", "raw", "prose"])

    # Texts are tokenised once; the passes that follow read codes of four bytes a word.
    pages = rows.mapInArrow(read, f"doc {kind}, raw binary, prose boolean").checkpoint()
    function = _function_words(pages)
    keys, counts = _trigrams(pages, function)
    size = len(CLASSES) + len(function)
    if not len(keys):
        return pages.select("doc", F.lit(0).alias("n_words"), F.lit(None).cast("double").alias("abnormal_share"), F.lit(None).cast("double").alias("mean_cost"), F.lit(False).alias("spam"))
    packed = spark.sparkContext.broadcast((function, keys, counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k, c = packed.value
        trigrams = Trigrams(size, k, c)
        for batch in batches:
            raw, starts = _pages(batch)
            if not len(starts):
                continue
            loose = ~in_sentences(raw)[0] | repeated(raw, starts)
            codes, weights, starts, group = classes(raw, starts, words)
            page, pages = _page_of(starts, len(codes)), len(starts)
            # Where most words around are keywords by their place: outside sentences, repeated or rare.
            loose = np.where(codes == WORD, weights, np.bincount(group, loose & (weights[group] > 0), len(codes)))
            keyword = 2 * windowed(np.minimum(loose, weights), starts) > windowed(weights, starts)
            cost = trigrams.costs(codes, starts)
            window = windowed(cost, starts)
            step = np.minimum(window / STEP, STEPS - 1).astype(np.int64)
            spread = np.bincount((page * 2 + keyword) * STEPS + step, weights, pages * 2 * STEPS).reshape(pages, 2 * STEPS)
            total = spread.sum(axis=1)
            # Shares of the page's words in steps of 1/65535.
            spread = np.rint(spread * (65535 / np.maximum(total, 1))[:, None]).astype(np.uint16)
            good = batch.column("prose").to_numpy(zero_copy_only=False)[page]
            fine = np.bincount(np.minimum(window[good] / FINE_STEP, FINE - 1).astype(np.int64), minlength=FINE).astype(np.int64)
            mean = np.bincount(page, cost, pages) / np.bincount(page, minlength=pages)
            # The batch's prose is told once, with its first page.
            prose = pa.array([fine.tobytes()] + [None] * (pages - 1), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total.astype(np.int32)), pa.array(mean), pa.array([r.tobytes() for r in spread], pa.binary()), prose], names=["doc", "n_words", "mean_cost", "spread", "prose"])

    # Words of each page by whether keywords are around them and by the cost there, in steps: bounds and shares both follow from these.
    spreads = pages.mapInArrow(score, f"doc {kind}, n_words int, mean_cost double, spread binary, prose binary").checkpoint()

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FINE, np.int64)
        for batch in batches:
            for x in batch.column("prose").to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FINE)), pa.array(total)], names=["step", "n"])

    told = spreads.where("prose IS NOT NULL").select("prose").mapInArrow(normal, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toPandas()
    share = (told["n"].cumsum() / max(1, told["n"].sum())).to_numpy()
    low, middle, upper = (float(np.searchsorted(share, q)) * FINE_STEP for q in (0.01, 0.5, 0.9))
    low, high = round(LOW * low / STEP), round((middle + HIGH * (upper - middle)) / STEP)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = np.array([np.frombuffer(x, np.uint16) for x in batch.column("spread").to_pylist()], np.int64).reshape(-1, 2, STEPS)
            total, keyword = spread.sum(axis=(1, 2)), spread[:, 1, high:].sum(axis=1) + spread[:, 1, :low].sum(axis=1)
            bad = keyword + spread[:, 0, high:].sum(axis=1) + spread[:, 0, :low].sum(axis=1)
            none = total == 0
            mean = np.asarray(batch.column("mean_cost"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_words"), pa.array((bad / np.maximum(total, 1)).astype(np.float64), mask=none), pa.array(mean, mask=none), pa.array((keyword > FLAG_SHARE * total) | (bad > ORDER_SHARE * total))], names=["doc", "n_words", "abnormal_share", "mean_cost", "spam"])

    return spreads.drop("prose").mapInArrow(shares, f"doc {kind}, n_words int, abnormal_share double, mean_cost double, spam boolean")
