"""Quality filter by importance resampling with hashed n-gram models.

A bag of hashed word and word-pair features is modelled for the target (texts labelled
good) and for the raw corpus. The log ratio ``log p_target - log p_raw`` of a document's
features, taken per feature, is its evidence; a whole sum would span hundreds of units
and leave nothing to sampling. Two calibrated numbers turn the evidence into a log
importance weight, the log odds that a text of the corpus is a target text. Gumbel noise
is added to the log weights and the ``k`` highest keys are kept, which samples without
replacement in proportion to the weights (to their power ``1 / temperature``).

Features: lower-cased runs of letters and digits and runs of other signs, and pairs of
neighbours; a word that repeats the word before it counts as one common feature of
repetition, so that stuttering is seen whatever the word. ``PRIOR`` neutral features are
added to every text, so that a handful of rare words says little.

The raw model counts every feature of every document; counts are summed per task over
``BUCKETS`` fixed buckets, so the model's size does not grow. The target model and the
calibration come from at most ``LABELLED`` labelled rows of each class, taken by hash
order; rows whose crc32(doc_id) mod 5 is 0 are left out of the fit to measure on, and
good rows where it is 1 calibrate alone, as the target model favours its own. In the
calibration a good document counts ``CLEAN_COST`` times as much as a bad one. ``k`` is a
parameter; left out, it is the sum of all documents' probabilities of being a target text.

Defined cases: null text counts as empty; an empty text has no features and evidence 0;
rows that share an id share their noise; rows tied at the k-th key are all kept; without
labels of both classes every document is kept; an empty table gives an empty result;
other columns of the input pass through the filter and are otherwise ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from orbweave.llm.logistic import fit_logistic
from orbweave.llm.words import M1, mix, slices
from orbweave.plans.workspace import Workspace

BUCKETS = 1 << 14
LABELLED = 10_000
CLEAN_COST = 20.0
TEMPERATURE = 1.0
PRIOR = 8
SEED = np.uint64(0x5EED)
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")
REPEAT = 0


def features(text: str | None) -> np.ndarray:
    """Feature buckets of a whole text, repeats included."""
    tokens = TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())
    h = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    words = np.fromiter((t[0] >= 48 for t in tokens), bool, len(tokens))
    pair = mix(h[:-1] * M1 + h[1:])
    out = np.concatenate([h, pair]) % np.uint64(BUCKETS - 1) + np.uint64(1)
    # The neighbour of a word is the word before it, with at most one sign between them.
    for step in (1, 2):
        same = (h[step:] == h[:-step]) & words[step:] & words[:-step] if len(h) > step else np.empty(0, bool)
        if step == 2:
            same &= ~words[1:-1] if len(h) > 2 else same
        out[np.flatnonzero(same) + step] = REPEAT
    return out.astype(np.int64)


def labelled_sample(labels: DataFrame, limit: int) -> dict[int, int]:
    """At most ``limit`` ids of each class by hash order, with their quality."""
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    fit = once.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    out: dict[int, int] = {}
    for q in (0, 1):
        out |= {r["doc_id"]: q for r in fit.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()}
    return out


def feature_counts(docs: DataFrame, sample: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket in all documents and in the labelled good ones."""
    good = docs.sparkSession.sparkContext.broadcast(np.array(sorted(i for i, q in sample.items() if q == 1), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        chosen = set(good.value.tolist())
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.bincount(features(text.as_py()), minlength=BUCKETS)
                total += got
                if i in chosen:
                    target += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(target[at])], ["bucket", "n", "good"])

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, n long, good long")
    total, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():
        total[r["bucket"]], target[r["bucket"]] = r["n"], r["good"]
    return total, target


def log_ratio(total: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the smoothed log-likelihood ratio of target to raw."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((total + 1) / (total.sum() + BUCKETS))


def evidence(texts: list[str | None], ratio: np.ndarray) -> np.ndarray:
    """Per text the log ratio of its features, averaged with ``PRIOR`` neutral ones."""
    each = [features(t) for t in texts]
    return np.array([ratio[f].sum() / (len(f) + PRIOR) for f in each], dtype=float).reshape(len(texts))


def gumbel(ids: list[int | None]) -> np.ndarray:
    """Standard Gumbel noise from a hash of the id."""
    h = mix(np.array([i or 0 for i in ids], dtype=np.int64).astype(np.uint64) * M1 + SEED)
    unit = ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
    return -np.log(-np.log(unit))


class Resampler:
    """The fitted models, the calibration and the least key that is kept."""

    def __init__(
        self, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, k: int | None = None, temperature: float = TEMPERATURE, workspace: Workspace | None = None
    ):
        ws = workspace or Workspace(docs.sparkSession)
        self.temperature = temperature
        sample = labelled_sample(labels, labelled)
        aside = {i for i, q in sample.items() if q == 1 and zlib.crc32(str(i).encode()) % 5 == 1}
        self.ratio = log_ratio(*feature_counts(docs, {i: q for i, q in sample.items() if i not in aside}))
        self.drawn = ws.save(self._drawn(docs), "evidence")
        self.offset, self.slope = self._calibrated({i: q for i, q in sample.items() if q == 0 or i in aside} if aside else sample, labels)
        log_weight = F.lit(self.offset) + F.lit(self.slope) * F.col("evidence")
        self.scores = self.drawn.select("doc_id", "evidence", log_weight.alias("log_weight"), (log_weight + temperature * F.col("noise")).alias("key"))
        if not np.isfinite(self.offset):
            self.key = -np.inf
            return
        if k is None:
            k = round(self.scores.agg(F.sum(1 / (1 + F.exp(-F.col("log_weight"))))).first()[0] or 0)
        self.key = kth_largest(self.scores, "key", k)

    def _drawn(self, docs: DataFrame) -> DataFrame:
        """``doc_id, evidence, noise`` of every row."""
        ratio = self.ratio

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found, noise = evidence(batch.column(1).to_pylist(), ratio), gumbel(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(noise)], ["doc_id", "evidence", "noise"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, evidence double, noise double")

    def _calibrated(self, sample: dict[int, int], labels: DataFrame) -> tuple[float, float]:
        """Offset and slope of the log odds, from the labelled documents' evidence."""
        everything = np.inf, 0.0
        if len(set(sample.values())) < 2:
            return everything
        share = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
        marks = F.broadcast(self.drawn.sparkSession.createDataFrame(list(sample.items()), "doc_id long, quality int"))
        rows = self.drawn.join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min("evidence").alias("x")).collect()
        x, q = np.array([r["x"] for r in rows], float), np.array([r["quality"] for r in rows], int)
        many = np.bincount(q, minlength=2)
        if not many.all():
            return everything
        weight = np.array([share[0], share[1] * CLEAN_COST]) / many
        unit = x.std() or 1.0
        offset, slope = fit_logistic(x[:, None] / unit, q.astype(float), (weight / weight.sum() * len(q) / 2)[q])
        return float(offset), float(slope / unit)

    def kept_rows(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that the sample holds, with all their columns."""
        if not np.isfinite(self.offset):
            return docs
        ratio, temperature, least, offset, slope = self.ratio, self.temperature, self.key, self.offset, self.slope
        at, text = docs.columns.index("doc_id"), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                key = offset + slope * evidence(batch.column(text).to_pylist(), ratio) + temperature * gumbel(batch.column(at).to_pylist())
                # The same sum as in the table, but for the last bits.
                yield batch.filter(pa.array(key >= least - 1e-9 * max(1.0, abs(least))))

        return docs.mapInArrow(run, docs.schema)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, most: int = 10_000) -> float:
    """The ``k``-th largest value, found by counting ever narrower bins.

    At most ``bins`` counts, and at last ``most`` distinct values, reach the driver.
    """
    low, high, above = *rows.agg(F.min(column), F.max(column)).first(), 0
    if low is None or k <= 0:
        return float("inf")
    inside = rows
    for _ in range(12):
        width = (high - low) / bins
        if width <= 0 or inside.select(column).limit(most + 1).count() <= most:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        counted = inside.withColumn("_bin", place).groupBy("_bin").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(counted.collect(), key=lambda r: -r["_bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        inside = rows.where(F.col(column).between(low, high))
    for r in inside.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col(column).desc()).limit(most).collect():
        above += r["n"]
        if above >= k:
            return r[column]
    return low


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, key and decision for every row of ``documents``."""
    model = Resampler(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scores.withColumn("kept", F.col("key") >= model.key)


def resampled_documents(docs: DataFrame, labels: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` that importance resampling keeps."""
    return Resampler(docs, labels, workspace=workspace).kept_rows(docs)
