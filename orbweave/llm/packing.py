"""Best-fit packing of token sequences with vector capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces are placed longest first, each into the open sequence that fits
under every constraint with the best score: the weighted norm of what stays free, or the
weighted dot product of the piece with what is free.

A piece's demand depends on its length alone, and lengths lie in 1..capacity, so the
global packing is computed on the histogram of lengths: sequences with the same content
are one row with a multiplicity, and each step places as many equal pieces as fit. The
driver holds at most ``capacity`` histogram rows and the plan's intervals, however many
documents there are. Every piece then finds its place from its rank among the pieces of
its length; ranks are counted in hashed buckets, so a length that a third of all pieces
share is spread over many tasks.

Token ids are those of the ``tokenizers`` file that ``tokenizer_path`` names. The default
engine feeds the file's own vocabulary to ``tiktoken``, which gives the same ids at about
four times the speed; texts and files that this cannot serve, and
``engine="tokenizers"``, use the other library.

Defined cases: null text counts as empty; every document ends with id 0, so an empty one
is a piece of length 1; a document longer than the capacity is cut into full pieces, the
first piece being the shorter one; repeated rows are packed as separate documents; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.words import slices
from orbweave.plans.workspace import Workspace

CAPACITY = 2048
END_ID = 0
#: Fixed value: how a byte-level tokenizer of this kind splits a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def splits_as_known(file: dict) -> bool:
    """Whether a tokenizer file says no more than a vocabulary of ranks and ``WORD_PATTERN``."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    extras = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or file.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in extras):
        return False
    if any(not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ids = np.array([model["vocab"][a + b] for a, b in pairs])
    return bool((np.diff(ids) > 0).all())


@lru_cache(maxsize=2)
def encoder(path: str, engine: str):
    """A function from a text to its ids, loaded once per Python worker.

    The fast engine serves files that :func:`splits_as_known`, and hands the other
    library what its pattern matcher refuses, such as a million blanks in a row.
    """
    if engine == "tokenizers":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    if not splits_as_known(model):
        return encoder(path, "tokenizers")
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    coder = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return coder.encode(text, allowed_special="all")
        except ValueError:  # the matcher's stack is bounded
            return encoder(path, "tokenizers")(text)

    return encode


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, total, capacity)]


def token_pieces(docs: DataFrame, capacity: int, tokenizer_path: str, engine: str) -> DataFrame:
    """One row per piece of every document, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, engine)
        for batch in slices(batches):
            ids, rows = batch.column(0), []
            for i, text in enumerate(batch.column(1)):
                doc, text = ids[i].as_py(), text.as_py() or ""
                tokens = np.array([*encode(text), END_ID], dtype="<u4")
                rows += [(doc, k, s, n, zlib.crc32(tokens[s : s + n])) for k, (s, n) in enumerate(cut(len(tokens), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def vector_best_fit(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4),
    score: str = "norm",
) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing of ``counts[length]`` pieces: (content, multiplicity) of the sequences.

    A content lists (length, how many). ``max_documents`` and ``max_attention`` default
    to values that never bind. Raises where a piece alone exceeds a capacity.
    """
    caps = np.array([capacity, max_documents or capacity, max_attention or capacity**2], dtype=np.int64)
    weight = np.array(weights) / caps.astype(float) ** 2
    free = np.empty((0, 3), dtype=np.int64)
    many: list[int] = []
    content: list[list[tuple[int, int]]] = []
    done: list[tuple[list[tuple[int, int]], int]] = []

    def put(parts: list[tuple[int, int]], left: np.ndarray, n: int) -> None:
        nonlocal free
        if not n:
            return
        if left[0] <= 0 or left[1] <= 0 or left[2] <= 0:
            done.append((parts, n))
            return
        free = np.vstack([free, left])
        many.append(n)
        content.append(parts)

    for length in sorted(counts, reverse=True):
        todo, need = counts[length], np.array([length, 1, length * length], dtype=np.int64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while todo:
            fits = np.flatnonzero((free >= need).all(axis=1)) if len(free) else np.empty(0, dtype=int)
            if len(fits):
                if score == "dot":
                    at = fits[np.argmin((free[fits].astype(float) * need * weight).sum(axis=1))]
                else:
                    at = fits[np.argmin(((free[fits] - need).astype(float) ** 2 * weight).sum(axis=1))]
                room, bins, parts = free[at].copy(), many[at], content[at]
            else:
                at, room, bins, parts = None, caps.copy(), todo, []
            each = int((room // need).min())
            n = min(bins, todo // each)
            if n == 0:
                n, each = 1, todo
            todo -= n * each
            if at is not None:
                many[at] -= n
                if not many[at]:
                    free = np.delete(free, at, axis=0)
                    del many[at], content[at]
            put([*parts, (length, each)], room - each * need, n)
    return done + list(zip(content, many, strict=True))


def intervals(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for every slot of the plan."""
    rows, taken, sequence = [], {}, 0
    for parts, n in plan:
        offset = 0
        for length, each in parts:
            for _ in range(each):
                first = taken.get(length, 0)
                rows.append((length, first, first + n, sequence, offset))
                taken[length] = first + n
                offset += length
        sequence += n
    return rows


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4),
    score: str = "norm",
    tokenizer_path: str | None = None,
    engine: str = "tiktoken",
    workspace: Workspace | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    spark = docs.sparkSession
    ws = workspace or Workspace(spark)
    pieces = ws.save(token_pieces(docs, capacity, tokenizer_path or default_tokenizer(), engine), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = vector_best_fit(histogram, capacity, max_documents, max_attention, weights, score)
    slots = spark.createDataFrame(intervals(plan), "length long, first long, end long, sequence long, offset long")

    buckets = 64 + sum(histogram.values()) // 65536
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    placed = pieces.withColumn("bucket", bucket)
    sums = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("bucket")
    base = sums.select("length", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.withColumn("within", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within")).alias("p")
    s = F.broadcast(slots).alias("s")
    here = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    return ranked.join(s, here).select(
        "doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
