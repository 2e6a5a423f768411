"""Removal of passages that repeat across documents, by repeated-phrase automata.

A word of a document goes if a window of ``WINDOW`` consecutive words covers it whose
word sequence also stands in a document with a smaller id.

1. One pass hashes every text's words. In every window the phrase of ``PHRASE`` words
   with the smallest hash is its anchor; equal windows have equal anchors. Texts with
   the same words form a class; only its smallest id goes on, for in the others every
   window repeats.
2. Anchors that stand in two or more classes are confirmed as recurring. The class with
   the smallest id that holds a recurring phrase is its source. Counting is done
   map-side first, so a passage in a third of all documents is a few rows a task.
3. Sources are cut into shards. A shard compiles the recurring phrases, read from its
   sources' texts, into one Aho-Corasick automaton and streams every document that holds
   a phrase of one of its sources through it; the automaton alone, which compares words
   and not hashes, tells where the phrases stand. A shard with more documents than
   ``SHARD_DOCS`` is compiled in as many tasks as it needs. A document without a
   recurring phrase cannot hold a repeated window.
4. The windows around located phrases are confirmed on 96 bits of a hash of all their
   words: the first document that holds one keeps it, later ones lose the words it covers.

Defined cases: null or word-less text has no words, nothing is removed and the kept text
is empty; documents of fewer than ``WINDOW`` words lose nothing; rows that share an id
do not cost each other words, and each of their texts is judged by itself; rows with a
null id lose nothing and take nothing; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.words import M1, M3, fingerprint, grams, hash_words, list_array, mix, slices, split_words
from orbweave.plans.workspace import Workspace

WINDOW, PHRASE = 50, 8
#: Sources of one shard, and documents that one task streams through its automaton, about.
SHARD_SOURCES, SHARD_DOCS = 256, 1024


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def window_anchors(phrases: np.ndarray, span: int) -> np.ndarray:
    """The smallest phrase hash in every run of ``span`` phrases, by doubling."""
    out, width = phrases, 1
    while width < span:
        step = min(width, span - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def profile(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``doc_id, mark, n_words, whole_sha256, f1, f2, anchors`` of every row.

    ``mark`` is a hash of the text, ``f1, f2`` one of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, shas, marks, anchors = [], [], [], []
            for text in batch.column(1):
                words = split_words(text.as_py())
                hashes = hash_words(words)
                counts.append(len(words))
                shas.append(sha(words))
                marks.append(fingerprint(hashes))
                long = len(words) >= window
                anchors.append(np.unique(window_anchors(grams(hashes, phrase), window - phrase + 1).view(np.int64)) if long else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), list_array(anchors)],
                ["doc_id", "mark", "n_words", "whole_sha256", "f1", "f2", "anchors"],
            )

    schema = "doc_id long, mark long, n_words long, whole_sha256 string, f1 long, f2 long, anchors array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, schema)


def spaced(words: list[bytes]) -> str:
    """' w1 w2 ... ', in which a phrase stands exactly where its own spaced form does."""
    return b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")


def compiled(phrases: set[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, text: str) -> np.ndarray:
    """Word positions of every occurrence of the automaton's phrases in a spaced text."""
    starts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    at = [end - size + 1 for end, size in automaton.iter(text)]
    return np.searchsorted(starts, np.array(at, dtype=np.int64))


def rolling(hashes: np.ndarray, window: int, base: int) -> np.ndarray:
    """A polynomial of every run of ``window`` hashes, from one running sum modulo 2**64."""
    count = max(0, len(hashes) - window + 1)

    def powers(of: int, n: int) -> np.ndarray:
        out = np.full(n, of, np.uint64)
        out[:1] = 1
        return np.cumprod(out)

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)))])
    return (sums[window:] - sums[:-window])[:count] * powers(pow(base, -1, 1 << 64), count)


def window_marks(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of every window's words as a long and an int."""
    long = rolling(hashes, window, int(M1) | 1)
    more = mix(rolling(mix(hashes + M1), window, int(M3) | 1)) >> np.uint64(32)
    return mix(long).view(np.int64), more.astype(np.uint32).view(np.int32)


def source_phrases(sources: DataFrame, phrase: int) -> DataFrame:
    """``shard, phrases`` of ``sources(shard, text, anchors)``: the words of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = []
            for text, anchors in zip(batch.column(1), batch.column(2), strict=True):
                words = split_words(text.as_py())
                runs, first = np.unique(grams(hash_words(words), phrase).view(np.int64), return_index=True)
                found.append([spaced(words[k : k + phrase]) for k in first[np.isin(runs, anchors.values.to_numpy())]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["shard", "phrases"])

    return sources.select("shard", "text", "anchors").mapInArrow(run, "shard long, phrases array<string>")


def repeated_windows(phrases: DataFrame, streamed: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(hash, more, doc, f1)`` of every window around a located phrase, once a document.

    ``phrases(shard, part, phrases)`` and ``streamed(s_shard, s_part, doc, f1, text)`` meet
    by shard and part.
    """

    def run(confirmed: pa.Table, docs: pa.Table) -> pa.Table:
        automaton = compiled({p for row in confirmed.column("phrases").to_pylist() for p in row})
        out = []
        for doc, f1, text in zip(docs.column("doc").to_pylist(), docs.column("f1").to_pylist(), docs.column("text"), strict=True):
            words = split_words(text.as_py())
            hashes = hash_words(words)
            found = occurrences(automaton, spaced(words)) if len(automaton) else np.empty(0, np.int64)
            # A window is around a phrase where that is its anchor, the smallest of its phrases.
            runs = grams(hashes, phrase)
            least = window_anchors(runs, window - phrase + 1)
            marks, more = (x[np.isin(least, runs[found])] for x in window_marks(hashes, window))
            marks, once = np.unique(marks, return_index=True)
            out.append((marks, more[once], np.full(len(marks), doc), np.full(len(marks), f1)))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds, strict=True)], ["hash", "more", "doc", "f1"])

    left = phrases.groupBy("shard", "part")
    return left.cogroup(streamed.groupBy("s_shard", "s_part")).applyInArrow(run, "hash long, more int, doc long, f1 long")


def without_windows(candidates: DataFrame, window: int) -> DataFrame:
    """``doc, f1, n_removed, kept_sha256, kept_text`` of ``candidates(doc, f1, text, gone, more)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, f1, text, gone, more in zip(*(batch.column(k) for k in range(5)), strict=True):
                words = split_words(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                marks, rest = window_marks(hash_words(words), window)
                lost, of = np.unique(gone.values.to_numpy(), return_index=True)
                at = np.minimum(np.searchsorted(lost, marks), len(lost) - 1)
                at = np.flatnonzero((lost[at] == marks) & (more.values.to_numpy()[of][at] == rest))
                edge[at] += 1
                edge[at + window] -= 1
                kept = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                rows.append((doc.as_py(), f1.as_py(), len(words) - len(kept), sha(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "f1", "n_removed", "kept_sha256", "kept_text"])

    schema = "doc long, f1 long, n_removed long, kept_sha256 string, kept_text string"
    return candidates.select("doc", "f1", "text", "gone", "more").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row of ``docs``.

    ``kept_text`` is null where the text stays as it is or goes as a whole.
    """
    ws = workspace or Workspace(docs.sparkSession)
    rows = ws.save(profile(docs, window, phrase), "profile")
    least = F.min(F.struct("doc_id", "mark")).alias("first")
    classes = rows.where(F.col("doc_id").isNotNull() & (F.size("anchors") > 0)).groupBy("f1", "f2", "n_words").agg(least, F.first("anchors").alias("anchors"))
    classes = ws.save(classes.select(F.col("first.doc_id").alias("doc"), F.col("first.mark").alias("mark"), "f1", "f2", "n_words", "anchors"), "classes")
    anchors = classes.select("doc", "f1", F.explode("anchors").alias("anchor"))
    # Tables of their own, so that a phrase or window of very many documents can be split where they meet.
    recurring = anchors.groupBy("anchor").agg(F.min(F.struct("doc", "f1")).alias("source"), F.max("doc").alias("high")).where("source.doc < high")
    recurring = ws.save(recurring.select("anchor", "source"), "recurring")
    held = ws.save(anchors.join(recurring, "anchor").select("doc", "f1", "anchor", "source"), "held")

    shards = recurring.select("source").distinct().count() // SHARD_SOURCES + 1
    shard = F.pmod(F.xxhash64("source"), F.lit(shards))
    visits = held.select("doc", "f1", shard.alias("shard")).distinct()
    load = visits.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("parts"))
    # An id may have several texts; the mark tells which one stands for the class.
    wanted = classes.drop("anchors", "f2", "n_words").join(held.select("doc", "f1").distinct(), ["doc", "f1"], "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("mark"))
    candidates = ws.save(texts.join(wanted.hint("merge"), ["doc", "mark"]).dropDuplicates(["doc", "mark"]), "candidates")

    own = held.where(F.col("source") == F.struct("doc", "f1")).groupBy("doc", "f1", "source").agg(F.collect_list("anchor").alias("anchors"))
    phrases = source_phrases(candidates.join(own.select("doc", "f1", shard.alias("shard"), "anchors"), ["doc", "f1"]), phrase)
    phrases = phrases.join(load, "shard").select("shard", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "phrases")
    part = F.pmod(F.xxhash64("doc", "f1", F.lit(1)), F.col("parts")).cast("int")
    streamed = candidates.join(visits, ["doc", "f1"]).join(load, "shard").select(F.col("shard").alias("s_shard"), part.alias("s_part"), "doc", "f1", "text")
    windows = ws.save(repeated_windows(phrases, streamed, window, phrase), "windows")

    first = windows.groupBy("hash", "more").agg(F.min("doc").alias("first"), F.max("doc").alias("end")).where("first < end").select("hash", "more", "first")
    gone = windows.join(ws.save(first, "first"), ["hash", "more"]).where(F.col("doc") > F.col("first"))
    lost = gone.groupBy("doc", "f1").agg(F.collect_list("hash").alias("gone"), F.collect_list("more").alias("more"))
    cut = ws.save(without_windows(candidates.join(lost, ["doc", "f1"]), window), "cut").withColumnsRenamed({"doc": "cut_doc", "f1": "cut_f1"})

    marks = classes.select("f1", "f2", "n_words", F.col("doc").alias("first"))
    by_class = rows.drop("anchors").join(marks, ["f1", "f2", "n_words"], "left")
    out = by_class.join(cut, (F.col("doc_id") == F.col("cut_doc")) & (F.col("f1") == F.col("cut_f1")), "left")
    whole = F.col("doc_id") > F.col("first")
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"), F.when(~F.coalesce(whole, F.lit(False)), F.col("kept_text")).alias("kept_text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every row of ``documents``."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
