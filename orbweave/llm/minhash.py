"""Document fingerprints by MinHash.

A fingerprint keeps, for each of ``PERMUTATIONS`` universal hash functions
``(a * x + b) mod 2**64`` with odd ``a``, 16 bits of the smallest value over a text's
word shingles; all functions are evaluated by numpy on a block of shingles at a time. The
smallest of many values is small, so it is scrambled before bits are taken: otherwise all
long texts would look alike. The share of equal places estimates the Jaccard similarity
of two shingle sets.

``fingerprint_table`` compares each document with an edited text and with the next
document by id. The order needs one range shuffle of the texts; each sorted range is one
stream that also reports its first and its last row, and the last row of a range meets
the first one of the next range in a join of two rows a range.

``minhash_components`` joins bands of signatures in Spark; every candidate is verified
on its whole shingle sets, see ``ngram_jaccard.block_links``.

Defined cases: null text counts as empty; texts without words share one fingerprint of
their own, alike to nothing else; rows with one id follow each other by a hash of their
text; null ids come before all others; a table of one row is its own next document; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.ngram_jaccard import block_links, by_component, joined_components
from orbweave.llm.words import fingerprint as content_mark
from orbweave.llm.words import list_array, mix, shingles, slices, split_words
from orbweave.plans.workspace import Workspace

PERMUTATIONS = 128
SHINGLE = 5
BAND_ROWS = 4
#: Documents of one sorted range, about; ranges of small inputs are smaller.
RANGE_ROWS = 20_000
FIRST = -(1 << 63)


def universal(permutations: int = PERMUTATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash functions, fixed by the seed."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, permutations, dtype=np.uint64) | np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 64, permutations, dtype=np.uint64)[:, None]


A, B = universal()


def signature(values: np.ndarray, a: np.ndarray = A, b: np.ndarray = B) -> np.ndarray:
    """The 16-bit MinHash values of shingle hashes; all ones for no shingles."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    if not len(values):
        return np.full(len(a), 0xFFFF, np.uint16)
    for k in range(0, len(values), 1024):
        np.minimum(least, (a * values[k : k + 1024] + b).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def text_signature(text: str | None, n: int = SHINGLE) -> np.ndarray:
    return signature(shingles(split_words(text, lower=True), n))


def alike(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def as_bytes(x: np.ndarray) -> bytes:
    return x.astype(">u2").tobytes()


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the first as many characters of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


#: Digests and fingerprints travel as bytes and become text last.
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _compared(own: tuple, following: tuple, n: int) -> tuple:
    """A row of the result; both sides are (doc_id, text, signature)."""
    doc, text, mark = own
    changed = edited_text(text, following[1])
    other = text_signature(changed, n)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
    return doc, len(text), digest, as_bytes(mark), as_bytes(other), alike(mark, other), alike(mark, following[2])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in sorted ranges; rows that share an id are cut too."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text")
    total = keyed.count()
    ranges = max(1, min(64, total // 64), total // RANGE_ROWS)
    order = ["id", "mark", "row"]
    keyed = keyed.withColumns({"id": F.coalesce("doc_id", F.lit(FIRST)), "mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")


def fingerprint_table(docs: DataFrame, n: int = SHINGLE, workspace: Workspace | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    spark = docs.sparkSession
    ws = workspace or Workspace(spark)
    edge_kinds, edge_names = [*KINDS, pa.int32(), pa.bool_(), pa.string()], [*NAMES, "part", "first", "text"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda first: (held[0], *[None] * 6, part, first, held[1])
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                mine = (doc, text, text_signature(text, n))
                if held:
                    rows.append((*_compared(held, mine, n), None, None, None))
                    held = mine
                else:
                    held = mine
                    rows.append(edge(True))
            yield _batch(rows, edge_kinds, edge_names)
        if held:
            yield _batch([edge(False)], edge_kinds, edge_names)

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append(_compared((doc, text, text_signature(text, n)), (None, following, text_signature(following, n)), n))
            yield _batch(rows, KINDS, NAMES)

    done = ws.save(_in_order(docs).mapInArrow(stream, f"{RESULT}, part int, first boolean, text string"), "ranges")
    # A number for each range, of which the driver knows as many as it has tasks.
    parts = sorted(r["part"] for r in done.where("first").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    ends = done.where("not first").select("part", "doc_id", "text").join(following, "part")
    heads = done.where("first").select(F.col("part").alias("next"), F.col("text").alias("head"))
    last = ends.join(heads, "next").select("doc_id", "text", "head").mapInArrow(closing, RESULT)
    out = done.where("first is null").select(*NAMES).union(last)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``."""
    return fingerprint_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def minhash_components(
    docs: DataFrame, n: int = SHINGLE, num: int = 80, den: int = 100, band_rows: int = BAND_ROWS, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` by banded signatures.

    Documents that agree in a whole band of ``band_rows`` places are candidates, and
    linked when their shingle sets reach the similarity ``num / den``. With 32 bands of
    4 rows a pair at 0.8 is missed with a probability below 1e-7.
    """
    ws = workspace or Workspace(docs.sparkSession)
    bands = PERMUTATIONS // band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingles(split_words(x.as_py(), lower=True), n).view(np.int64)) for x in batch.column(1)]
            marks = [content_mark(x) for x in sets]
            parts = []
            for x in sets:
                rows = signature(x.view(np.uint64)).reshape(bands, band_rows)
                parts.append(np.array([content_mark(np.append(r, np.uint16(i)))[0] for i, r in enumerate(rows)], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x for x, _ in marks], pa.int64()), pa.array([x for _, x in marks], pa.int64()), list_array(parts)],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
    rows = ws.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    classes = ws.save(classes.where("doc is not null"), "classes")
    blocks = classes.select("doc", F.col("n_shingles").alias("size"), F.lit(1).alias("need"), F.explode("bands").alias("token"))
    links = block_links(docs, classes, ws.save(blocks, "blocks"), n, num, den, ws)
    return by_component(rows, classes, joined_components(rows, classes, links, ws))


def query_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all ``documents`` by bands, verified: five words, 0.8 or more."""
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
