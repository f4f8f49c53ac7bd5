"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kth_largest, row_key, stage, text_slices
from .words import Spans, gram_starts, mix, words


@dataclass(frozen=True)
class Options:
    """buckets: for words and as many for word pairs, so the model has a fixed size.

    labelled: at most so many labelled rows (those of smallest hash) fit the target model and, half of them, the length
    correction; raw counts always cover every document. smoothing: tokens of the raw model mixed into the target's.
    temperature: of the Gumbel noise; with 1 rows are drawn in proportion to their weights. keep: share of good
    calibration rows with a log weight of 0 or more. sample: rows to draw, or None for as many as have such a weight.
    """

    buckets: int = 1 << 16
    labelled: int = 20_000
    smoothing: float = 10_000.0
    temperature: float = 1.0
    keep: float = 0.995
    sample: int | None = None
    seed: int = 17


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each lower-case word and pair of words; n-grams of each text."""
    w = words(column, lower=True)
    start, text = gram_starts(w.ptr, 2)
    pairs = Spans(w.hash).of(start, 2)
    bucket = np.concatenate((w.hash % np.uint64(buckets), pairs % np.uint64(buckets) + np.uint64(buckets))).astype(np.int64)
    of = np.concatenate((np.repeat(np.arange(len(column)), np.diff(w.ptr)), text))
    return bucket, of, np.bincount(of, minlength=len(column))


def flagged(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, text, fits, holds): labelled rows of quality 1 fit the target in one half and hold for calibration in the
    other. Labels that are null or disagree about a document count by their highest quality."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.withColumn("half", F.xxhash64("doc_id", F.lit(o.seed)))
    # bounded by o.labelled, so small enough to send to every task
    chosen = picked.orderBy("half", "doc_id").limit(o.labelled).where("quality = 1").select("doc_id", (F.col("half") % 2 == 0).alias("half"))
    joined = docs.select("doc_id", "text").join(F.broadcast(stage(chosen, "labelled")), "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce("half", F.lit(False)).alias("fits"), F.coalesce(~F.col("half"), F.lit(False)).alias("holds"))


def log_ratios(rows: DataFrame, o: Options = Options()) -> np.ndarray:
    """Log of target over raw frequency of each bucket of rows (text, fits); 0 without target rows.

    The target's counts are smoothed by the raw model.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * o.buckets, np.int64), np.zeros(2 * o.buckets, np.int64)
        for batch in text_slices(batches):
            bucket, of, _ = features(batch.column(0), o.buckets)
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[of]], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    counted = rows.select("text", "fits").mapInArrow(count, "bucket long, raw long, target long")
    # 2 * buckets rows at most reach the driver
    found = np.array([tuple(r) for r in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()], np.int64).reshape(-1, 3)
    raw, target = np.zeros(2 * o.buckets), np.zeros(2 * o.buckets)
    raw[found[:, 0]], target[found[:, 0]] = found[:, 1], found[:, 2]
    ratio = np.zeros(2 * o.buckets)
    for part in (slice(0, o.buckets), slice(o.buckets, None)):
        if target[part].sum():
            p = raw[part] / raw[part].sum()
            some = p > 0
            ratio[part][some] = np.log((target[part][some] + o.smoothing * p[some]) / (target[part].sum() + o.smoothing) / p[some])
    return ratio


def score(docs: DataFrame, ratio: np.ndarray, level: float = 0.0, o: Options = Options()) -> DataFrame:
    """docs with n_grams, log_weight and perturbed.

    log_weight is the sum over n-grams of log ratio less `level`: without the correction long texts would win or lose
    by their length alone. perturbed adds Gumbel noise, which follows from doc_id, text and seed, so equal rows share it
    and a task that runs again draws the same.
    """
    docs = docs.drop("n_grams", "log_weight", "perturbed")
    names, weights = docs.columns, docs.sparkSession.sparkContext.broadcast(ratio - level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bucket, of, n = features(batch.column(names.index("text")), o.buckets)
            total = np.bincount(of, weights=weights.value[bucket], minlength=len(n)).astype(np.float64)
            drawn = mix(batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(o.seed))
            uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            noisy = total - o.temperature * np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(total), pa.array(noisy)], names=[*names, "n_grams", "log_weight", "perturbed"])

    schema = docs.schema.simpleString()[7:-1]
    return docs.withColumn("__key", row_key()).mapInArrow(run, f"{schema},n_grams:bigint,log_weight:double,perturbed:double")


def resample(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """The sample of docs, with all their columns and n_grams, log_weight and perturbed.

    The level of the length correction is what all but 1 - keep of the good calibration rows reach in the mean (0 without
    any). The k largest perturbed log weights are drawn, which is sampling without replacement in proportion to
    exp(log_weight / temperature): where n-grams say much the weight decides, for short or ambiguous texts the draw.
    Rows that tie at the k-th value are all drawn. Null text is empty (weight 0); an empty table gives an empty sample; a
    column of docs with the name of a new one is replaced. Words are cut anew in each of three passes: their buckets, kept
    as a table, take twice the disk of the compressed input.
    """
    rows = flagged(docs, labels, o)
    ratio = log_ratios(rows, o)
    held = score(rows.where("holds"), ratio, 0.0, o).where("n_grams > 0")
    level = held.agg(F.percentile(F.col("log_weight") / F.col("n_grams"), 1 - o.keep)).first()[0] or 0.0
    scores = stage(score(docs.select("doc_id", "text"), ratio, level, o).select("log_weight", "perturbed"), "scores")
    k = scores.where("log_weight >= 0").count() if o.sample is None else o.sample
    last = kth_largest(scores, "perturbed", k)
    discard(scores)
    return score(docs, ratio, level, o).where(F.col("perturbed") >= (float("inf") if last is None else last))
