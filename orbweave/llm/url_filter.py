"""URL filter by the likelihood ratio of two character language models.

Rules decide first; a rule fits its host and all subdomains where the path starts with
the rule's, and the longest fitting rule wins. URLs that no rule fits are judged by two
variable-order Markov models over bytes, one of the URLs that rules accept and one of
those they reject: each order's estimate is smoothed towards the next lower one, so a
context that was never seen leaves the decision to shorter ones. The score is the
difference of the log likelihoods per byte; the threshold is the one that parts the
held-out fifth of the ruled URLs (crc32(page_id) mod 5 is 0) best in balanced accuracy.

Counts are taken over all ruled URLs outside that fifth. Every order's contexts and
(context, byte) pairs have a 64-bit key of their own in one partitioned table that grows
with the input; nothing of it reaches the driver. URLs are judged in slices of
``SLICE`` rows: each slice asks the table once for every key it holds.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule
fits it, and a URL without bytes scores 0; without ruled URLs of both kinds the
threshold is 0 and scores are 0; repeated rows are judged alike; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.words import M1, mix, slices
from orbweave.plans.workspace import Workspace

ORDERS, BUCKETS, SMOOTHING = 6, 1 << 17, 2.0
SLICE_BITS = 12
SLICE = 1 << SLICE_BITS
BINS, REACH = 4000, 8.0
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds ``host, path, rule, ruling``; the longest fitting rule, or null."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return out.withColumn("rule", rule).withColumn("ruling", ruling)


def context_keys(urls: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Lengths, and for each order the 64-bit keys of (context) and (context, byte)."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    pad = ORDERS - 1
    flat = np.frombuffer(b"".join(b"\x02" * pad + r for r in raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths + pad) - lengths
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    own, before = [], []
    h = np.zeros(len(at), np.uint64)
    for k in range(ORDERS):
        if k:
            h = mix(h * M1 + flat[at - k] + np.uint64(1))
        place = mix(h + np.uint64(k + 1))
        before.append(place)
        own.append(mix(place * M1 + flat[at] + np.uint64(1)))
    return lengths, before, own


def contexts(urls: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """``context_keys`` folded into ``BUCKETS`` places, for small tables alone."""
    lengths, before, own = context_keys(urls)
    fold = lambda keys: [(k % np.uint64(BUCKETS)).astype(np.int64) for k in keys]
    return lengths, fold(before), fold(own)


def log_likelihood(before: list[np.ndarray], own: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Natural log probability of each byte; ``counts[0]`` of contexts, ``[1]`` with the byte."""
    p = np.full(len(own[0]), 1 / 256)
    for b, o in zip(before, own, strict=True):
        p = (counts[1, o] + SMOOTHING * p) / (counts[0, b] + SMOOTHING)
    # Rounding, and in folded tables a shared place, can lift an estimate above one.
    return np.log(np.minimum(p, 1.0))


class UrlModel:
    """The two models and the threshold. ``pages(page_id, url)``."""

    def __init__(self, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, workspace: Workspace | None = None):
        self.rules, self.workspace = tuple(rules), workspace or Workspace(pages.sparkSession)
        marked = ruled(pages.select("page_id", "url"), rules).where("ruling is not null")
        test = F.coalesce(F.crc32(F.col("page_id").cast("string")) % 5 == 0, F.lit(False))
        self.counts = self._count(marked.where(~test).select("url", F.col("ruling") == "allow"))
        self.threshold = 0.0
        held = self.counts.agg(F.max("good"), F.max("bad")).first()
        self.fitted = all(x is not None and x > 0 for x in held)
        if self.fitted:
            place = F.floor((F.least(F.greatest("score", F.lit(-REACH)), F.lit(REACH)) + REACH) / (2 * REACH) * BINS).cast("int")
            rows = self.scored(marked.where(test)).groupBy((F.col("ruling") == "allow").alias("good"), place.alias("at")).agg(F.count("*").alias("n")).collect()
            seen = np.zeros((2, BINS + 2))
            for r in rows:
                seen[int(r["good"]), r["at"] + 1] += r["n"]
            if (seen.sum(axis=1) > 0).all():
                share = np.cumsum(seen, axis=1) / seen.sum(axis=1, keepdims=True)
                gain = share[0] - share[1]
                best = np.flatnonzero(gain >= gain.max() - 1e-12)
                # The middle of the best cuts; a cut after bin k lies at its upper edge.
                self.threshold = float((best[0] + best[-1]) / 2 / BINS * 2 * REACH - REACH)

    def _count(self, urls: DataFrame) -> DataFrame:
        """``key, good, bad``: how often each key stands in URLs of either kind."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, SLICE):
                lengths, before, own = context_keys(batch.column(0).to_pylist())
                good = np.tile(np.repeat(np.array(batch.column(1).to_pylist(), dtype=bool), lengths), 2 * ORDERS)
                keys, at = np.unique(np.concatenate([*before, *own]).view(np.int64), return_inverse=True)
                n, of_good = np.bincount(at, minlength=len(keys)), np.bincount(at[good], minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(of_good, pa.int64()), pa.array(n - of_good, pa.int64())], ["key", "good", "bad"])

        found = urls.mapInArrow(run, "key long, good long, bad long")
        return self.workspace.save(found.groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "counts")

    def scored(self, pages: DataFrame) -> DataFrame:
        """Adds ``score``, the difference of log likelihoods per byte."""
        if not self.fitted:
            return pages.withColumn("score", F.lit(0.0))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, SLICE):
                numbers, urls = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for number in np.unique(numbers):
                    _, before, own = context_keys([urls[i] for i in np.flatnonzero(numbers == number)])
                    keys = np.unique(np.concatenate([*before, *own]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), pa.array(keys)], ["number", "key"])

        # Arrow keeps ids whole where some are null.
        def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
            lengths, before, own = context_keys(rows.column("url").to_pylist())
            out = np.zeros(rows.num_rows)
            if found.num_rows and lengths.sum():
                # Batches may part a slice, so that a key is answered twice.
                known, first = np.unique(found.column("key").to_numpy(), return_index=True)
                # The last place holds keys that no ruled URL has.
                def place(keys):
                    at = np.minimum(np.searchsorted(known, keys.view(np.int64)), len(known) - 1)
                    return np.where(known[at] == keys.view(np.int64), at, len(known))

                before, own = [place(k) for k in before], [place(k) for k in own]
                parts = [np.append(found.column(c).to_numpy()[first], 0).astype(float) for c in ("good", "bad")]
                good, bad = (log_likelihood(before, own, np.stack([x, x])) for x in parts)
                np.add.at(out, np.repeat(np.arange(len(rows)), lengths), good - bad)
            return rows.drop_columns(["number"]).append_column("score", pa.array(out / np.maximum(lengths, 1)))

        # Saved, so that both passes see the same slices.
        dealt = self.workspace.save(pages.withColumn("number", F.shiftright(F.monotonically_increasing_id(), SLICE_BITS)), "slices")
        asked = dealt.select("number", "url").mapInArrow(ask, "number long, key long")
        # Neither side has a size bound, so the join is a merge at every size.
        found = asked.join(self.counts.hint("merge"), "key").select("number", "key", "good", "bad")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", score double"
        return dealt.groupBy("number").cogroup(found.groupBy("number")).applyInArrow(judge, schema)

    def judged(self, pages: DataFrame) -> DataFrame:
        """``page_id, host, path, rule, verdict, score`` of every row."""
        out = self.scored(ruled(pages.select("page_id", "url"), self.rules))
        verdict = F.coalesce("ruling", F.when(F.col("score") >= self.threshold, "allow").otherwise("block"))
        return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return UrlModel(pages).judged(pages)
