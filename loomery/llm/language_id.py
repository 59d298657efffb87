"""Language identification by language-bitmask n-gram filters.

Training counts, for each language, in how many sample texts each lower-cased
5-byte n-gram of letters and word gaps occurs, and keeps those in at least
``MIN_SHARE`` of them.  They go into one bit-sliced Bloom filter: slot arrays
whose entries are bit masks of languages, so one probe returns every language
that contains the n-gram.  A text's n-grams are probed all at once; the
popcount of each language, less the matches its fill would give by chance,
decides.

What training reads is bounded: about ``SAMPLE_TEXTS`` texts of each language,
taken by a hash of their ids, and whole.  Prediction reads every text whole.

Defined results: ``und`` with score 0 for a null text or one without letters,
or when nothing was learned; a text whose n-grams match no language gets the
language with most sample texts, score 0; ties go to the alphabetically first
language; a null lang is never learned from; repeated rows count twice;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.shingles import buffers, chunks, mix, trim

WIDTH = 5
SAMPLE_TEXTS = 1500
MIN_SHARE = 0.01
SLOTS = 1 << 21
UNKNOWN = "und"
_CODE = 22  # bits of a language's number

_CLASS = np.zeros(256, np.uint8)  # 0: gap; letters and the bytes of non-ASCII characters stand for themselves
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def ngrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that hold a letter and no double gap, and their rows."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    unit = _CLASS[data]
    gap = unit == 0
    double = np.concatenate(([0], np.cumsum(gap[:-1] & gap[1:])))
    at = np.flatnonzero(double[WIDTH - 1 :][:n] == double[:n])
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + WIDTH <= offsets[row + 1]
    at, row = at[inside], row[inside]
    packed = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        packed = (packed << np.uint64(8)) | unit[at + k].astype(np.uint64)
    return packed, row


class LanguageFilter:
    """Bit-sliced Bloom filter: ``slots[p, i]`` has a bit for each language of plane ``p`` (64 at most)."""

    def __init__(self, languages: list[str], slots: np.ndarray, prior: list[int]):
        self.languages, self.slots = languages, slots
        fill = [float(np.mean(self._has(slots[k // 64], k))) for k in range(len(languages))]
        self.chance = np.array(fill) ** 2
        self.fallback = int(np.argmax(prior)) if prior else -1

    @staticmethod
    def _has(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks >> np.array(language % 64, masks.dtype)) & np.array(1, masks.dtype) == 1

    @staticmethod
    def _probes(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(grams)
        return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, language: np.ndarray, prior: list[int], size: int = SLOTS) -> LanguageFilter:
        kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(languages), 64) <= bits)
        slots = np.zeros((max(-(-len(languages) // 64), 1), size), kind)
        for probe in cls._probes(grams, size):
            np.bitwise_or.at(slots, (language // 64, probe), np.left_shift(np.array(1, kind), (language % 64).astype(kind)))
        return cls(languages, slots, prior)

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (index) and score of each row."""
        rows = len(offsets) - 1
        grams, row = ngrams(offsets, data)
        one, two = self._probes(grams, self.slots.shape[1])
        masks = [plane[one] & plane[two] for plane in self.slots]
        total = np.bincount(row, minlength=rows)
        counts = np.empty((len(self.languages), rows))
        for k in range(len(self.languages)):
            found = np.bincount(row[self._has(masks[k // 64], k)], minlength=rows)
            counts[k] = np.maximum(found - total * self.chance[k], 0) / max(1 - self.chance[k], 1e-9)
        best = counts.argmax(axis=0)
        top, all_ = counts.max(axis=0), counts.sum(axis=0)
        return np.where(top > 0, best, self.fallback), np.where(all_ > 0, top / np.maximum(all_, 1e-12), 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS, min_share: float = MIN_SHARE, size: int = SLOTS) -> LanguageFilter:
    """Learn from rows that are not held out and whose lang is not null."""
    known = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint8), [])
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = known.filter(draw < share[F.col("lang")]).select("lang", "text")
    code = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tongue = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            offsets, data = buffers(_lower(batch.column(1)))
            for low, high in chunks(offsets):
                grams, row = ngrams(offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]])
                order = np.lexsort((grams, row))
                grams, row = grams[order], row[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
                keyed, n = np.unique((grams[new] << np.uint64(_CODE)) | tongue[low:high][row[new]].astype(np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keyed.view(np.int64)), pa.array(n)], names=["keyed", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(len(languages))), pa.array(np.bincount(tongue[low:high], minlength=len(languages)))], names=["keyed", "n"])
            trim()

    totals = picked.mapInArrow(count, "keyed long, n long").groupBy("keyed").agg(F.sum("n").alias("n"))
    # Languages and 40-bit n-grams share a key of 62 bits; negative keys count texts.
    from loomery.sources.staging import staged

    totals = staged(totals, "language-grams")
    texts = {-1 - r["keyed"]: r["n"] for r in totals.filter("keyed < 0").collect()}
    least = F.create_map(*[F.lit(x) for k in range(len(languages)) for x in (k, max(2 if texts.get(k, 0) > 20 else 1, int(min_share * texts.get(k, 0))))])
    # Bounded: a text has few n-grams, and each kept one is in min_share of the sample.
    kept = totals.filter((F.col("keyed") >= 0) & (F.col("n") >= least[F.col("keyed").bitwiseAND(F.lit((1 << _CODE) - 1)).cast("int")])).select("keyed").toArrow()
    keyed = kept["keyed"].to_numpy().view(np.uint64) if kept.num_rows else np.zeros(0, np.uint64)
    return LanguageFilter.build(languages, keyed >> np.uint64(_CODE), (keyed & np.uint64((1 << _CODE) - 1)).astype(np.int64), [texts.get(k, 0) for k in range(len(languages))], size)


def _predictions(model: LanguageFilter, texts: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Runs of rows: the first row, languages and scores."""
    lower = _lower(texts)
    letters = pc.match_substring_regex(lower, r"\pL").to_numpy(zero_copy_only=False)
    offsets, data = buffers(lower)
    for low, high in chunks(offsets):
        if model.languages:
            best, score = model.predict(offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]])
            ok = letters[low:high]
        else:
            best, score, ok = np.zeros(high - low, int), np.zeros(high - low), np.zeros(high - low, bool)
        yield low, [model.languages[b] if good else UNKNOWN for b, good in zip(best, ok, strict=True)], np.where(ok, score, 0.0)
    trim()


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS entries a plane, at most 16 MB
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, names, scores in _predictions(sent.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(names)), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """The rows whose language is not ``und``, all columns as they were.

    Each row is judged by its own text, so null, repeated or missing ids make no difference.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [name != UNKNOWN for _, names, _ in _predictions(sent.value, batch.column(place)) for name in names]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
