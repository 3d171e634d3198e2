"""Quality classification by importance resampling.

Two generative models over hashed n-grams are counted: one of the target text (documents labelled as
good) and one of the raw text (all documents).  A document's log importance weight is the mean of
its n-grams' log ratios times a fixed length, so that a long document is weighed by what it is like
and not by how long it is.  Documents are sampled without replacement in proportion to their
weights by the Gumbel top-k trick: each gets its log weight plus a Gumbel variate hashed from its
doc_id, and the k largest stay.  k is the expected number of target-like documents, from a
logistic calibration of the weights.

The n-grams have two views of a word: the lower-cased word by itself, and pairs of neighbouring
shapes (the runs of lower case, upper case, digits and other signs) with a flag for a repeated
word, so that shouting, lists, stuck words and noise show in any language.

Raw counts, weights, k and the threshold cover all documents.  Only labels are a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm._common import settled, slices, table, unit_interval, unused

#: Hash buckets of the n-gram models.
BUCKETS = 1 << 16
#: Labelled documents used, by order of a hash of their doc_id: at most so many, whatever the table holds.
LABELS = 20_000
SEED = 23
#: N-grams that a weight stands for, and n-grams of ratio one that short texts are filled up with.
LENGTH, FILL = 50, 20
#: Words whose features a worker remembers, their longest, words that are handled at a time, and characters cut into words at a time.
MEMO, MEMO_CHARS = 50_000, 64
RUN = 50_000
PIECE = 1 << 18
WHITE = re.compile(r"\s")


def shape(word: str) -> str:
    """x for a run of lower case, X of upper case, 9 of digits; other signs stand for their runs."""
    out, last = [], ""
    for sign in word:
        kind = "x" if sign.islower() else "X" if sign.isupper() else "9" if sign.isdigit() else sign
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


def word_lists(text: str, piece: int = PIECE) -> Iterator[list[str]]:
    """The words of a text in lists of bounded size; no word is cut."""
    start = 0
    while start < len(text):
        end = min(start + piece, len(text))
        if end < len(text):
            found = WHITE.search(text, end)
            end = found.start() if found else len(text)
        yield text[start:end].split()
        start = end


class Words(dict):
    """Word hash in the low 32 bits, shape hash in the next 31; a table of bounded size."""

    def __missing__(self, word: str) -> int:
        bare = word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")
        code = xxhash.xxh32_intdigest(bare) | (xxhash.xxh32_intdigest(shape(word).encode("utf-8", "surrogatepass")) >> 1) << 32
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = code
        return code


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)


def grams(texts: list[str | None], run: int = RUN, known: Words | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buckets of all n-grams, the text of each) for bounded runs of the texts.

    A text longer than a run comes in several; the last word before a seam is carried over it, so
    the n-grams are those of the whole text, whatever `run` is.
    """
    code_of = (Words() if known is None else known).__getitem__
    first, carried, codes, owner = 0, 0, [], []

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        code, own = np.array(codes, dtype=np.uint64), np.array(owner, dtype=np.int64)
        word, form = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
        before, opens = np.zeros_like(form), np.ones(len(code), dtype=bool)
        before[1:], opens[1:] = form[:-1], own[1:] != own[:-1]
        again = np.zeros(len(code), dtype=bool)
        again[1:] = (word[1:] == word[:-1]) & ~opens[1:]
        pair = _scramble(np.where(opens, np.uint64(1), before * np.uint64(3) + np.uint64(2)) * np.uint64(0xC2B2AE3D27D4EB4F) + form * np.uint64(2) + again.astype(np.uint64))
        fresh = slice(carried, None)
        return first, np.concatenate([_scramble(word)[fresh], pair[fresh]]).astype(np.int64) % BUCKETS, np.concatenate([own[fresh], own[fresh]])

    for k, text in enumerate(texts):
        for words in word_lists(text or ""):
            for at in range(0, len(words), run):
                part = list(map(code_of, words[at : at + run]))
                codes += part
                owner += [k - first] * len(part)
                if len(codes) - carried >= run:
                    yield flush()
                    # the last word is the neighbour of the next one, if that is of the same text
                    first, carried, codes, owner = k, 1, codes[-1:], [0]
    if len(codes) > carried:
        yield flush()


def sampled_labels(labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """(doc_id, good, fits): at most `limit` rows; a doc_id labelled twice counts as good only if all its labels say so.

    Half of them fit the target model, the others calibrate: weights of documents that a model was
    counted from are too high to judge the rest by.
    """
    agreed = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    return settled(agreed.orderBy(unit_interval(F.col("doc_id"), SEED), "doc_id").limit(limit).select("doc_id", (F.col("good") > 0).alias("good"), (unit_interval(F.col("doc_id"), SEED + 1) < 0.5).alias("fits")))


def log_ratios(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target / p_raw for each bucket, from counts over all documents; zeros without a target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, known = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), Words()
        for batch in slices(batches):
            good = np.array([bool(g) for g in batch.column(1).to_pylist()], dtype=bool)
            for first, bucket, owner in grams(batch.column(0).to_pylist(), known=known):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[first + owner]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    marked = documents.select("doc_id", "text").join(F.broadcast(labels.where("good and fits")), "doc_id", "left").select("text", "good")
    rows = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in rows:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + 0.5) / (expected + 0.5))


def weights(texts: list[str | None], ratios: np.ndarray, known: Words | None = None) -> np.ndarray:
    """The log importance weight of each text; 0 for a text without words."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for first, bucket, owner in grams(texts, known=known):
        here = int(owner[-1]) + 1
        total[first : first + here] += np.bincount(owner, ratios[bucket], here)
        n[first : first + here] += np.bincount(owner, minlength=here)
    return LENGTH * total / (n + FILL)


def calibrate(weight: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of `good` on the weights, by Newton steps with a ridge."""
    x, y = np.clip(weight, -200, 200) / 10, good.astype(float)
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        v = p * (1 - p) + 1e-9
        grad = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum()])
        hess = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 2048, enough: int = 4096) -> float:
    """The k-th largest value of a double column, by repeated histograms; `enough` values at most come to the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while True:
        if low == high:
            return low
        inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counted = sorted(inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r.b)
        for row in counted:
            if k <= row.n:
                break
            k -= row.n
        if row.lo == row.hi:
            return row.lo
        if row.n <= enough:
            return sorted((r[0] for r in values.where((F.col(column) >= row.lo) & (F.col(column) <= row.hi)).select(column).collect()), reverse=True)[k - 1]
        low, high = row.lo, row.hi


def gumbel(key) -> F.Column:
    """A standard Gumbel variate hashed from the key."""
    u = unit_interval(key, SEED) + F.lit(2.0**-53)
    return -F.log(-F.log(u))


class Sampler:
    """The fitted models, k and the threshold; `keys` and `kept` apply them."""

    def __init__(self, documents: DataFrame, labels: DataFrame):
        sample = sampled_labels(labels)
        self.ratios = log_ratios(documents, sample)
        self.scored = settled(self._weighed(documents))
        # one row for each labelled doc_id, so at most LABELS; of rows that repeat a doc_id the least weight counts
        judged = self.scored.join(F.broadcast(sample.where("not fits")), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("log_weight"))
        known = judged.orderBy("doc_id").select("log_weight", "good").collect()
        slope, intercept = calibrate(np.array([r[0] for r in known]), np.array([r[1] for r in known])) if known else (0.0, 50.0)
        odds = F.greatest(F.lit(-200.0), F.least(F.lit(200.0), F.col("log_weight"))) / 10 * slope + intercept
        expected, rows = self.scored.agg(F.sum(1 / (1 + F.exp(-odds))), F.count(F.lit(1))).first()
        self.k = min(rows, round(expected or 0))
        self.threshold = kth_largest(self.scored.withColumn("gumbel_key", self._key()), "gumbel_key", self.k) if self.k else math.inf

    @staticmethod
    def _key() -> F.Column:
        return F.col("log_weight") + gumbel(F.col("doc_id"))

    def _mapped(self, weigh: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        ratios = self.ratios

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Words()
            for batch in slices(batches):
                yield weigh(batch, weights(batch.column("text").to_pylist(), ratios, known))

        return run

    def _weighed(self, documents: DataFrame) -> DataFrame:
        kind = documents.schema["doc_id"].dataType.simpleString()
        return documents.select("doc_id", "text").mapInArrow(self._mapped(lambda batch, w: pa.RecordBatch.from_arrays([batch.column(0), pa.array(w)], names=["doc_id", "log_weight"])), f"doc_id {kind}, log_weight double")

    def decisions(self) -> DataFrame:
        return self.scored.select("doc_id", "log_weight", self._key().alias("gumbel_key")).withColumn("kept", F.col("gumbel_key") >= self.threshold)

    def kept(self, documents: DataFrame) -> DataFrame:
        """The rows that stay, with their columns; the weight is computed beside the row, so no text is shuffled.

        Nulls, empty texts, ties and repeated rows are as in `classify`; an empty table gives an
        empty result, and further columns, whatever their names, are carried along unchanged.
        """
        name = unused(documents, "log_weight")
        fields = [(f.name, f.dataType.simpleString()) for f in documents.schema.fields]
        schema = ", ".join(f"`{n}` {t}" for n, t in [*fields, (name, "double")])
        added = documents.mapInArrow(self._mapped(lambda batch, w: pa.RecordBatch.from_arrays([*batch.columns, pa.array(w)], names=[*batch.schema.names, name])), schema)
        return added.where(F.col(name) + gumbel(F.col("doc_id")) >= self.threshold).select(*documents.columns)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row: doc_id, log_weight, gumbel_key, kept.

    A null or empty text has weight 0.  Repeated rows get equal keys; all rows at the threshold
    stay.  A null doc_id draws its variate as the word null.  Without labels every weight is 0 and
    every row stays; an empty table gives an empty result.  Other columns are not read.
    """
    return Sampler(documents, labels).decisions()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
