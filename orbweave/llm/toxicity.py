"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents, so words are labelled first: in documents marked toxic,
the words whose form or beginning (four or five letters) occurs in many families of
toxic documents and hardly in clean ones. A chain with the states clean and toxic is
fitted to sequences of ``LENGTH`` words with these labels; a sequence begins and ends in
the clean state. Forward-backward gives each word's marginal; a document's score is a
logistic function, fitted to the documents' labels, of the odds that any of its words is
toxic and of how many are. Words above one half form the offending spans.

The fit uses at most ``LABELLED`` documents of each class, taken by hash order, with all
words of their texts; only rows whose crc32(doc_id) mod 5 is not 0. They are gathered
into one table in one pass. For the lexicon likely copies, documents that agree in
``MINIMA`` MinHash values of their words, count as one family. Every word of every whole
text is scored.

Defined cases: null text counts as empty; a text without words gets the score of no
toxic word; rows with a null id are scored, never learnt from and not held out; of rows
that share a sampled id one text, the least by hash, is learnt from; without both classes
among the labels every score is 0; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from orbweave.llm.logistic import fit_logistic
from orbweave.llm.words import M1, fingerprint, hash_words, mix, slices, split_words
from orbweave.plans.workspace import Workspace

BUCKETS, LENGTH = 1 << 18, 64
LABELLED, MINIMA, EPOCHS = 4000, 3, 6
EDGES = ".,;:!?\"'()[]{}<>%$*&#|-_«»¿¡"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def forms(word: bytes) -> list[str]:
    """A word's form and its beginnings, as the features that may label it."""
    w = word.decode("utf-8", "surrogatepass").strip(EDGES)
    return [f"{k}:{w[:k]}" for k in (4, 5) if len(w) > k] + ([f"w:{w}"] if w else [])


def feature_buckets(word: bytes) -> tuple[int, ...]:
    w = word.decode("utf-8", "surrogatepass").strip(EDGES)
    names = [f"w:{w}", f"3:{w[:3]}", f"4:{w[:4]}", f"5:{w[:5]}", f"s:{w[-3:]}"]
    return tuple(xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names)


def emissions(words: list[bytes], weights: np.ndarray, known: dict[bytes, float]) -> np.ndarray:
    """The toxic state's score for each word; ``known`` remembers words."""
    out = np.empty(len(words))
    for i, w in enumerate(words):
        x = known.get(w)
        if x is None:
            if len(known) > 300_000:
                known.clear()
            x = known[w] = float(weights[list(feature_buckets(w))].sum())
        out[i] = x
    return out


def marginals(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxic marginals, expected moves and log partition of rows of word scores.

    ``scores(rows, length)`` holds -inf beyond a row's end, where only the clean state
    is possible; ``move[from, to]`` are the scores of transitions.
    """
    rows, length = scores.shape
    top = np.maximum(scores, 0)
    e0, e1 = np.exp(-top), np.exp(scores - top)
    m = np.exp(move)
    forward = np.empty((length + 1, 2, rows))
    forward[0, 0], forward[0, 1] = 1.0, 0.0
    log_z = top.sum(axis=1)
    for t in range(length):
        a0, a1 = forward[t]
        b0 = (a0 * m[0, 0] + a1 * m[1, 0]) * e0[:, t]
        b1 = (a0 * m[0, 1] + a1 * m[1, 1]) * e1[:, t]
        s = b0 + b1
        log_z = log_z + np.log(s)
        forward[t + 1, 0], forward[t + 1, 1] = b0 / s, b1 / s
    p = np.empty((rows, length))
    moves = np.zeros((2, 2))
    back0, back1 = np.full(rows, m[0, 0]), np.full(rows, m[1, 0])
    log_z = log_z + np.log(forward[length, 0] * m[0, 0] + forward[length, 1] * m[1, 0])
    for t in range(length - 1, -1, -1):
        f0, f1 = forward[t + 1]
        z = f0 * back0 + f1 * back1
        p[:, t] = f1 * back1 / z
        a0, a1 = forward[t]
        n0, n1 = back0 * e0[:, t], back1 * e1[:, t]
        joint = [[a0 * m[0, 0] * n0, a0 * m[0, 1] * n1], [a1 * m[1, 0] * n0, a1 * m[1, 1] * n1]]
        whole = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        for i in (0, 1):
            for j in (0, 1):
                moves[i, j] += (joint[i][j] / whole).sum()
        c0, c1 = m[0, 0] * n0 + m[0, 1] * n1, m[1, 0] * n0 + m[1, 1] * n1
        s = c0 + c1
        back0, back1 = c0 / s, c1 / s
    return p, moves, log_z


def fit_chain(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and transitions by AdaGrad on the exact gradient.

    ``features(rows, length, 5)``, ``labels(rows, length)``.
    """
    weights, move = np.full(BUCKETS, -0.5), np.zeros((2, 2))
    seen, moved = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(3)
    inside = np.arange(features.shape[1]) < lengths[:, None]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(features)), max(1, len(features) // 500)):
            x, y, here = features[part], labels[part], inside[part]
            scores = np.where(here, weights[x].sum(axis=2), -np.inf)
            p, expected, _ = marginals(scores, move)
            g = np.bincount(x[here].ravel(), weights=np.repeat((y - p)[here], x.shape[2]), minlength=BUCKETS) / len(part) - decay * weights
            seen += g * g
            weights += rate * g / np.sqrt(seen)
            state = np.pad(np.where(here, y, 0), ((0, 0), (1, 0)))
            real = np.array([[((state[:, :-1] == i) & (state[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
            h = (real - expected) / len(part)
            moved += h * h
            move += 0.1 * h / np.sqrt(moved)
    return weights, move


def document_marginals(emitted: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Marginals of all documents of a slice, in sequences of ``LENGTH`` words."""
    sizes = [len(e) for e in emitted]
    rows = [-(-n // LENGTH) for n in sizes]
    scores = np.full((sum(rows), LENGTH), -np.inf)
    at = 0
    for e, r in zip(emitted, rows, strict=True):
        scores[at : at + r].reshape(-1)[: len(e)] = e
        at += r
    p = marginals(scores, move)[0] if len(scores) else scores
    out, at = [], 0
    for n, r in zip(sizes, rows, strict=True):
        out.append(p[at : at + r].reshape(-1)[:n])
        at += r
    return out


def evidence(p: np.ndarray) -> tuple[float, float]:
    """Log odds that any word is toxic, and the logarithm of their expected number."""
    none = float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
    some = -np.expm1(none)
    return float(np.clip(np.log(max(some, 1e-9)) - none, -20, 20)), float(np.log1p(p.sum()))


class ToxicityModel:
    """A chain fitted to ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""

    def __init__(self, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, workspace: Workspace | None = None):
        known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        sample: dict[int, int] = {}
        for y in (0, 1):
            sample |= {r["doc_id"]: y for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
        self.fitted = len(set(sample.values())) == 2
        self.weights, self.move, self.beta = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(3)
        if not self.fitted:
            return
        spark = docs.sparkSession
        ids = F.broadcast(spark.createDataFrame(list(sample.items()), "doc_id long, toxic int"))
        chosen = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id")
        # Rows that share an id are merged map-side, so at most one text an id comes together.
        once = chosen.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        once = (workspace or Workspace(spark)).save(once, "sample")
        features, marks, lengths = self._sequences(once, self._lexicon(once))
        self.fitted = len(features) > 0
        if not self.fitted:
            return
        self.weights, self.move = fit_chain(features, marks, lengths)
        rows = self.scored(once).select("doc_id", "odds", "amount").collect()
        truth = np.array([sample[r["doc_id"]] for r in rows], float)
        # The sample holds the classes evenly; the labels do not.
        many = Counter(truth.tolist())
        weight = np.array([share[int(t)] / many[t] for t in truth]) * len(rows) / sum(share.values())
        self.beta = fit_logistic(np.array([[r["odds"], r["amount"]] for r in rows]), truth, weight)

    @staticmethod
    def _lexicon(sample: DataFrame) -> frozenset[str]:
        """Forms of at least 1 % of the toxic families and a fiftieth as often in clean ones."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = set(split_words(text.as_py(), lower=True))
                    each = [*{f for w in words for f in forms(w)}, ""]
                    hashes = hash_words(list(words))
                    least = [mix(hashes + np.uint64(k) * M1).min() for k in range(MINIMA)] if words else [np.uint64(0)]
                    family = fingerprint(np.array(least))[0]
                    yield pa.RecordBatch.from_arrays([pa.array(each), pa.array([family] * len(each)), pa.array([toxic] * len(each), pa.int32())], ["form", "family", "toxic"])

        rows = sample.select("toxic", "text").mapInArrow(run, "form string, family long, toxic int")
        by_family = rows.groupBy("form", "family").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"))
        counts = by_family.groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        families = counts.where("form = ''").first()
        least = max(3, families["bad"] * 0.01) if families else 3
        return frozenset(r["form"] for r in counts.where((F.col("bad") >= least) & (F.col("good") * 50 <= F.col("bad")) & (F.col("form") != "")).select("form").collect())

    @staticmethod
    def _sequences(sample: DataFrame, lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, labels and lengths of every sequence of every sampled document."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = split_words(text.as_py(), lower=True)
                    marks = np.array([int(bool(toxic) and not lexicon.isdisjoint(forms(w))) for w in words], np.int8)
                    flat = np.array([feature_buckets(w) for w in words], "<i4").reshape(-1, 5)
                    cuts = range(0, len(words), LENGTH)
                    yield pa.RecordBatch.from_arrays([pa.array([a[k : k + LENGTH].tobytes() for k in cuts], pa.binary()) for a in (flat, marks)], ["features", "marks"])

        rows = sample.select("toxic", "text").mapInArrow(run, "features binary, marks binary").toArrow()
        order = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
        x, y = np.zeros((len(order), LENGTH, 5), np.int32), np.zeros((len(order), LENGTH), np.int8)
        n = np.zeros(len(order), int)
        for i, (features, marks) in enumerate(order):
            n[i] = len(marks)
            x[i, : n[i]] = np.frombuffer(features, "<i4").reshape(-1, 5)
            y[i, : n[i]] = np.frombuffer(marks, np.int8)
        return x, y, n

    def scored(self, docs: DataFrame) -> DataFrame:
        """``doc_id, held_out, odds, amount, score, spans`` of every row."""
        weights, move, beta, fitted = self.weights, self.move, self.beta, self.fitted
        model = docs.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, float] = {}
            names = ["doc_id", "held_out", "odds", "amount", "score", "spans"]
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            for batch in slices(batches, 256):
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                emitted = [emissions(split_words(t, lower=True), model.value, known) for _, t in pairs]
                rows = []
                for (doc, text), p in zip(pairs, document_marginals(emitted, move), strict=True):
                    odds, amount = evidence(p)
                    score = 1 / (1 + np.exp(-np.clip(beta @ [1.0, odds, amount], -30, 30))) if fitted else 0.0
                    rows.append((doc, held_out(doc), odds, amount, float(score), spans(text, p) if fitted and len(p) and p.max() >= 0.5 else []))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), span]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        schema = "doc_id long, held_out boolean, odds double, amount double, score double, spans array<struct<begin:long,end:long>>"
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def spans(text: str | None, p: np.ndarray) -> list[dict]:
    """Half-open character offsets of the runs of words above one half."""
    out: list[dict] = []
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text or "")):
        if p[i] >= 0.5:
            if out and i and p[i - 1] >= 0.5:
                out[-1]["end"] = m.end()
            else:
                out.append({"begin": m.start(), "end": m.end()})
    return out


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ToxicityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return model.scored(docs).select("doc_id", "held_out", "score", predicted.alias("predicted"), "spans")
