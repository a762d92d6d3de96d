"""Quality classifier by importance resampling over hashed n-grams.

Two bags-of-n-grams models over `BUCKETS` hashed unigrams and bigrams of words and signs: one of the raw text
(all documents), one of target text (a bounded sample of labelled good documents). A document's importance is
the log ratio of its probabilities under both. Documents are then sampled without replacement in proportion
to their importance: a Gumbel number drawn from a hash of the id is added to the log ratio, and the k largest
sums are kept. k is the number of documents times the share of good ones among the labels.

The counts are summed in Spark and are `BUCKETS` numbers on the driver; the k-th largest sum is found with
counts of ever smaller parts of the range.

Rows: a null or empty text has no n-grams and is rejected. Repeated rows have equal sums and share their fate; all
rows with the k-th largest sum are kept. A null id is an id. Without target documents nothing tells texts
apart, and all but the empty ones are kept. Empty tables give no rows. Other columns stay in `selected`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import Words, byte_kinds, chunks, flat, gram_hashes, saved, with_own_names

BUCKETS = 10_000
#: labelled good documents of which the target model is made, at most
TARGET_ROWS = 20_000
SMOOTHING = 1.0
SEED = 17

#: white space separates; letters, digits and bytes beyond ASCII are one kind, signs another
_KINDS = byte_kinds((0x00, 0x20, 0), (0x21, 0x2F, 2), (0x3A, 0x40, 2), (0x5B, 0x60, 2), (0x7B, 0x7F, 2))


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray
    threshold: float


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a chunk of texts, and the row of each."""
    words = Words(data, bounds, _KINDS)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(words.rows))
    pairs = gram_hashes(words.hashes, 2)
    inside = row[1:] == row[:-1]
    every = np.concatenate([words.hashes, pairs[inside]]) if len(pairs) else words.hashes
    rows = np.concatenate([row, row[1:][inside]]) if len(pairs) else row
    return (every % np.uint64(BUCKETS)).astype(np.int64), rows


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each bucket in all texts and in target texts (`target` true)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches, "text"):
            bucket, row = features(*flat(batch.column("text")))
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            total += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[target[row]], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some]), pa.array(good[some])], names=["bucket", "n", "good"])

    sums = docs.mapInArrow(counted, "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n"), F.sum("good"))
    out = np.zeros((2, BUCKETS))
    for bucket, n, good in sums.collect():  # at most BUCKETS rows
        out[:, bucket] = n, good
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if target.sum() == 0:
        return np.zeros(BUCKETS)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def _gumbel(id_col: str) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col)), 12).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(-F.log(u))


def scored(docs: DataFrame, log_ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with log_weight and the sum with its Gumbel number, sample_key; null: no n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            bucket, row = features(*flat(batch.column(text_col)))
            weight = np.bincount(row, weights=sent.value[bucket], minlength=batch.num_rows)
            some = np.bincount(row, minlength=batch.num_rows) > 0
            yield batch.append_column("log_weight", pa.array(weight, pa.float64(), mask=~some))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", log_weight double"
    return docs.mapInArrow(score, schema).withColumn("sample_key", F.col("log_weight") + _gumbel(id_col))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a stored column, by counts in 4,096 parts of its range, again and again."""
    if k <= 0:
        return float("inf")
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("-inf")
    left = k
    for _ in range(8):
        if low == high:
            break
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(4095))
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        rows = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):  # at most 4,096
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        else:
            return min(r["low"] for r in rows)
        if left == 1:
            return high
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all documents, and the threshold that keeps the share of good ones."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), "quality")
    good, all_labels = known.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    share = (good or 0) / all_labels if all_labels and good else 1.0
    sample = known.where("quality = 1").select("_id", F.xxhash64("_id").alias("_order")).orderBy("_order", "_id").limit(TARGET_ROWS).select("_id", F.lit(True).alias("_target")).distinct()
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text"))
    flagged = own.join(F.broadcast(sample), F.col("_own") == F.col("_id"), "left").select("text", F.coalesce("_target", F.lit(False)).alias("target"))
    raw, target = _counts(flagged)
    ratio = log_ratios(raw, target)
    keys = saved(scored(docs.select(id_col, text_col), ratio, id_col, text_col).select("sample_key"), "quality")
    k = int(round(share * keys.count()))
    return Model(ratio, kth_largest(keys.where(F.col("sample_key").isNotNull()), "sample_key", k))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, sample_key, kept of every document."""
    model = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), model.log_ratio)
    return out.select("doc_id", "log_weight", "sample_key", F.coalesce(F.col("sample_key") >= model.threshold, F.lit(False)).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the sample keeps, with all their columns."""
    own = with_own_names(docs, id_col, text_col)
    model = fit(own, labels.withColumnRenamed(id_col, "doc_id"))
    return scored(own, model.log_ratio).where(F.col("sample_key") >= model.threshold).select(*own.columns).toDF(*docs.columns)
