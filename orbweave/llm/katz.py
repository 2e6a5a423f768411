"""Language-model scores by Katz backoff over word bigrams.

Training counts are gathered from every training document. A task sorts and merges the
counts of a few million tokens at a time, and sends them cut by a hash of the words, so
each partition merges its own words or pairs; pairs of very frequent first words are cut
by the second word too. The tables are written, partitioned, to the shared folder.

Good-Turing: counts up to ``CUT`` are discounted as Katz does, from the counts of counts;
larger ones are trusted. Words and pairs seen once keep their discounted count; the mass
of unseen words is that of one unknown word. A history's backoff weight is what its pairs
leave over, divided by what their words leave over in the lower order (where no pair is
discounted the history is counted once more, so that something is left), so probabilities
after any history sum to one over the known words, the end and the unknown word.

Scoring is recursive per token: a pair that training has gives its discounted
probability, any other the history's backoff weight times the word's probability. In
logarithms this is a sum of one value per word and one gain per known pair, so the
lookups are additive. A training document never backs off, as it was counted: each of its
pairs that is not in the table was seen once. So pairs seen once enter the sums of their
histories and the discounts, but rows of their own are stored only for the pairs that
held-out documents ask for, which are counted along with the training pairs as asked, not
as seen. The most frequent words and pairs, at most ``HEAD`` of each, and a bitmap of
``BITS`` bits that tells which other keys exist at all are broadcast, a bounded size; what
remains is looked up by one join and summed by document.

Defined cases: null or empty text is the end alone; the first word follows a mark of the
beginning; rows that repeat id and text are each scored; a null id is scored, never
learnt from, and counts as held out; without training documents every token is unknown
with probability one; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from orbweave.llm.words import M1, hash_words, list_array, mix, release, rows_array, slices, split_words
from orbweave.plans.workspace import Workspace

CUT = 5
HEAD = 1 << 20
BITS = 1 << 26
#: Tokens that a task gathers before it merges them, and tokens of one partition, about.
CHUNK, PART = 600_000, 700_000
#: Share of all tokens above which a history's pairs are cut by their second word too.
HOT = 1 / 2000
BEGIN, END = np.uint64(xxh3_64_intdigest(b"\x00begin")), np.uint64(xxh3_64_intdigest(b"\x00end"))
MARK = int(BEGIN.view(np.int64))


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text: str | None) -> np.ndarray:
    """Beginning, words, end."""
    return np.concatenate([[BEGIN], hash_words(split_words(text, lower=True)), [END]])


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * M1 + second)


def _chunks(batches: Iterator[pa.RecordBatch], training: bool = True) -> Iterator[tuple[list[np.ndarray], list[bool]]]:
    """Token arrays of a few documents at a time, and which are to be learnt from."""
    held, learnt, size = [], [], 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            learn = not held_out(doc)
            if learn or not training:
                held.append(tokens(text.as_py()))
                learnt.append(learn)
                size += len(held[-1])
            if size >= CHUNK:
                yield held, learnt
                held, learnt, size = [], [], 0
    if held:
        yield held, learnt


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cut(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(part, kind="stable")
    starts = _starts(part[order])
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        yield int(part[order[a]]), *(c[order[a:b]] for c in columns)


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """``(word, n)`` of all training tokens; the beginning is counted as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches):
            word, n = np.unique(np.concatenate(chunk), return_counts=True)
            rows = list(_cut((mix(word) % np.uint64(parts)).astype(np.int64), word, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), list_array([r[1].view(np.int64) for r in rows]), list_array([r[2] for r in rows])], ["part", "words", "ns"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []
        for batch in batches:
            words.append(batch.column(1).flatten().to_numpy())
            counts.append(batch.column(2).flatten().to_numpy())
        if words:
            word, where = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
            for k in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(word[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["word", "n"])
            del words, counts, word, where, n
            release()

    sent = docs.mapInArrow(run, "part int, words array<long>, ns array<long>")
    return sent.repartition(parts, "part").mapInArrow(merge, "word long, n long")


def pair_counts(docs: DataFrame, parts: int, hot: np.ndarray, head: Head) -> DataFrame:
    """Counts of pairs, and what the pairs of each history sum up to.

    Rows of pairs ``(first, second, n, n_second)``: those seen more than once, and those
    seen once that a held-out document holds or whose second word the head does not know
    (``keep`` tells the former). Rows of histories ``(first, kinds, big, of_head)``, which
    have no second word: how many pairs were seen 1..``CUT + 1`` times, how often the pairs
    seen more than ``CUT`` times were, and how many pairs of each count of the second word
    up to ``CUT`` there are, then the sum of the larger counts. A history may have several.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, head))
    names = ["first", "second", "n", "n_second", "keep", "kinds", "big", "of_head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, head = shared.value
        for chunk, learnt in _chunks(batches, training=False):
            flat = np.concatenate(chunk)
            sizes = [len(c) for c in chunk]
            ends = np.cumsum(sizes)[:-1] - 1
            word, at = np.unique(flat, return_inverse=True)
            pair = np.delete(at[:-1].astype(np.int64) * len(word) + at[1:], ends)
            seen = np.delete(np.repeat(np.array(learnt), sizes)[:-1], ends)
            # Training pairs come with their count, asked ones with 0.
            pair, where = np.unique(pair * 2 + ~seen, return_inverse=True)
            n = np.where(pair & 1, 0, np.bincount(where, minlength=len(pair)))
            pair >>= 1
            first, second = word[pair // len(word)], word[pair % len(word)]
            own = mix(first)
            often = np.isin(first, hot)
            own[often] = mix(own[often] + (second[often] >> np.uint64(56)))
            # Words of the head travel as their place there, in half the bytes.
            here, place = head.at(second.view(np.int64))
            code = np.where(here, place, -1)
            rows = list(_cut((own % np.uint64(parts)).astype(np.int64), first, second, code, n))
            out = [[], [], [], [], []]
            for _, f, s, k, c in rows:
                starts = _starts(f)
                for column, x in zip(out, (f[starts].view(np.int64), np.diff(np.append(starts, len(f))), k, s[k < 0].view(np.int64), c), strict=True):
                    column.append(x)
            small = lambda x: list_array(x).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), list_array(out[0]), small(out[1]), small(out[2]), list_array(out[3]), small(out[4])], ["part", "firsts", "runs", "codes", "seconds", "ns"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, head = shared.value
        firsts, seconds, counts = [], [], []
        for batch in batches:
            f, r, k, s, c = (batch.column(k).flatten().to_numpy() for k in range(1, 6))
            second = np.empty(len(k), np.int64)
            second[k >= 0], second[k < 0] = head.keys[k[k >= 0]], s
            firsts.append(np.repeat(f, r))
            seconds.append(second)
            counts.append(c)
        if not firsts:
            return
        first, second, n = (np.concatenate(x) for x in (firsts, seconds, counts))
        del firsts, seconds, counts
        order = np.lexsort((second, first))
        first, second, n = first[order], second[order], n[order]
        del order, batch, f, r, k, s, c
        release()
        starts = _starts(first, second)
        asked = np.logical_or.reduceat(n == 0, starts)
        first, second, n = first[starts], second[starts], np.add.reduceat(n.astype(np.int64), starts)
        # Pairs that are asked for but were never seen are unknown.
        first, second, n, asked = (x[n > 0] for x in (first, second, n, asked))
        here, place = head.at(second)
        of = head.get("n", here, place, 0).astype(np.int64)
        begins = _starts(first)
        if len(begins):
            sums = lambda x: np.add.reduceat(x.astype(np.int64), begins)
            kinds = np.stack([sums(n == r) for r in range(1, CUT + 2)], axis=1)
            lower = np.stack([sums(of == r) for r in range(1, CUT + 1)] + [sums(np.where(of > CUT, of, 0))], axis=1)
            big, history = sums(np.where(n > CUT, n, 0)), first[begins]
            for k in range(0, len(history), 100_000):
                part = slice(k, k + 100_000)
                none = [pa.nulls(len(history[part]), pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([pa.array(history[part]), *none, pa.nulls(len(none[0]), pa.bool_()), rows_array(kinds[part]), pa.array(big[part]), rows_array(lower[part])], names)
        keep = (n > 1) | asked
        first, second, n, of, here, keep = (x[keep | ~here] for x in (first, second, n, of, here, keep))
        for k in range(0, len(n), 100_000):
            part = slice(k, k + 100_000)
            lists = pa.nulls(len(n[part]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[part]), pa.array(second[part]), pa.array(n[part]), pa.array(of[part], mask=~here[part]), pa.array(keep[part]), lists, pa.nulls(len(lists), pa.int64()), lists], names
            )
        del first, second, n, of, here, keep, place, asked
        release()

    sent = docs.mapInArrow(run, "part int, firsts array<long>, runs array<int>, codes array<int>, seconds array<long>, ns array<int>")
    return sent.repartition(parts, "part").mapInArrow(merge, "first long, second long, n long, n_second long, keep boolean, kinds array<long>, big long, of_head array<long>")


class Head:
    """The most frequent keys, sorted, with their counts and values."""

    def __init__(self, table: DataFrame, key: str, columns: list[str], order: str = "n", limit: int = HEAD, always: tuple[int, ...] = ()):
        # The least level of which no more than the limit are as frequent; above 10,000 a
        # level is a sixteenth of a power of two, so there are few at every size.
        level = F.when(F.col(order) <= 10_000, F.col(order)).otherwise(10_000 + F.floor(F.log2(F.col(order) / 10_000) * 16))
        sizes = [(r["level"], r["rows"], r["least"]) for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min(order).alias("least")).collect()]
        room, self.least = limit, 1 << 62
        for _, rows, least in sorted(sizes, reverse=True):
            if rows > room:
                break
            room -= rows
            self.least = least
        chosen = F.col(order) >= self.least
        for one in always:
            chosen = chosen | (F.col(key) == one)
        rows = table.where(chosen).select(key, *columns).toArrow()
        keys = rows.column(0).to_numpy()
        by = np.argsort(keys)
        self.keys = keys[by]
        self.values = {c: rows.column(c).to_numpy()[by] for c in columns}
        del rows, keys
        release()

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and its place (0 where it is not)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[place] == keys
        return here, np.where(here, place, 0)

    def only(self, *columns: str) -> Head:
        """The same keys with fewer columns, to broadcast less."""
        out = object.__new__(Head)
        out.keys, out.least, out.values = self.keys, self.least, {c: self.values[c] for c in columns}
        return out

    def get(self, column: str, here: np.ndarray, place: np.ndarray, otherwise: float) -> np.ndarray:
        """Values at places that :meth:`at` gave."""
        return np.where(here, self.values[column][place], otherwise) if len(self.keys) else np.full(len(here), otherwise)


def discounts(counts_of: dict[int, int], cut: int = CUT) -> dict[int, float]:
    """Katz's ratios for counts ``1..cut``.

    Where the counts of counts are too thin for a ratio strictly between 0 and 1, the
    ratio is that of absolute discounting by one half.
    """
    n = [0, *(counts_of.get(r, 0) for r in range(1, cut + 2))]
    common = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, cut + 1):
        raw = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = raw if 0 < raw < 1 else (r - 0.5) / r
    return out


def discounted(n, ratios: dict[int, float]):
    """Column of the discounted count."""
    out = F.col(n).cast("double")
    for r, d in ratios.items():
        out = F.when(F.col(n) == r, F.lit(float(r * d))).otherwise(out)
    return out


class KatzModel:
    """Tables of one training corpus. ``docs(doc_id, text)``."""

    def __init__(self, docs: DataFrame, workspace: Workspace | None = None):
        ws = workspace or Workspace(docs.sparkSession)
        spark = docs.sparkSession
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(64, size // 6 // PART)
        self.parts = parts // 4
        words = ws.save(word_counts(docs, parts), "words")
        real = words.where(F.col("word") != MARK)
        self.total, self.kinds = (int(x or 0) for x in real.agg(F.sum("n"), F.count("*")).first())
        small = {r["n"]: r["k"] for r in real.where(F.col("n") <= CUT + 1).groupBy("n").agg(F.count("*").alias("k")).collect()}
        ratios = discounts(small)
        # The mass of the discounts is the unknown word's; at least one token's worth.
        kept = real.agg(F.sum(discounted("n", ratios))).first()[0] or 0.0
        scale = 1.0 if self.total - kept >= 1 else (self.total - 1) / kept if self.total > 1 else 0.5
        self.unknown = 1 - kept * scale / self.total if self.total else 1.0
        p_word = discounted("n", ratios) * (scale / max(1, self.total))

        counted = Head(words, "word", ["n"])
        hot = counted.keys[counted.values["n"] > self.total * HOT].view(np.uint64)
        found = ws.save(pair_counts(docs, parts, hot, counted), "pairs")
        del counted
        kinds = [F.sum(F.col("kinds")[r]) for r in range(CUT + 1)]
        few = {r: k or 0 for r, k in enumerate(found.where("second is null").agg(*kinds).first(), 1)}
        ratio2 = discounts(few)
        self.once = math.log10(ratio2[1])
        lower = lambda n: discounted(n, ratios) * (scale / max(1, self.total))

        # What each history's pairs sum up to: by counts, and by their words' probabilities.
        sums = found.where("second is null")
        kept_sum = sum((F.col("kinds")[r - 1] * F.lit(r * d) for r, d in ratio2.items()), F.col("big").cast("double"))
        seen_sum = sum((F.col("kinds")[r - 1] * F.lit(r) for r in ratio2), F.col("big"))
        head_sum = sum((F.col("of_head")[r - 1] * F.lit(r * d) for r, d in ratios.items()), F.col("of_head")[CUT].cast("double"))
        sums = sums.select("first", seen_sum.alias("seen"), kept_sum.alias("count"), (head_sum * (scale / max(1, self.total))).alias("lower"))
        second = words.select(F.col("word").alias("second"), F.col("n").alias("of"))
        late = found.where("second is not null and n_second is null").select("first", "second").join(second, "second")
        late = late.groupBy("first").agg(F.sum(lower("of")).alias("lower")).select("first", F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("count"), "lower")
        left = sums.union(late).groupBy("first").agg(F.sum("seen").alias("seen"), F.sum("count").alias("count"), F.sum("lower").alias("lower"))
        # A history none of whose pairs is discounted is counted once more, for what follows unseen.
        full = F.when(F.col("count") > F.col("seen") - 1e-6, F.col("seen") / (F.col("seen") + 1)).otherwise(1.0)
        weight = F.log10((1 - F.col("count") / F.col("seen") * full) / F.greatest(1 - F.col("lower"), F.lit(self.unknown * 0.5)))
        left = left.select(F.col("first").alias("word"), weight.alias("back"), (F.log10(full) - F.log10("seen")).alias("each"))
        own = words.join(left, "word", "left")
        own = own.select("word", "n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("back", "each")], F.log10(p_word).alias("lw"))
        self.words = ws.save(own, "words")
        ws.drop(words)
        self.word_head = Head(self.words, "word", ["n", "back", "each", "lw"], always=(MARK,))

        # A pair's discounted count is its gain over a pair seen once, in a training document.
        more = F.log10(discounted("n", ratio2)) - F.lit(self.once)
        gained = self._gains(found.where("keep").select("first", "second", "n", more.alias("more")))
        f, s = self.words.select(F.col("word").alias("first"), "each", "back"), self.words.select(F.col("word").alias("second"), "lw")
        late = gained.where("gain is null").drop("gain").join(f, "first").join(s, "second")
        late = late.select("key", "n", "more", (F.col("more") + self.once + F.col("each") - F.col("back") - F.col("lw")).alias("gain"))
        self.pairs = ws.save(gained.where("gain is not null").select("key", "n", "more", "gain").union(late), "gains")
        ws.drop(found)
        self.pair_head = Head(self.pairs, "key", ["more", "gain"])
        tail_words = self.words.where((F.col("n") < self.word_head.least) & (F.col("word") != MARK)).select(F.col("word").alias("key"), "n", (F.col("back") + F.col("lw")).alias("out"), F.col("each").alias("inside"))
        tail_pairs = self.pairs.where(F.col("n") < self.pair_head.least).select("key", F.lit(0).cast("long").alias("n"), F.col("gain").alias("out"), F.col("more").alias("inside"))
        self.tail = tail_words.union(tail_pairs)
        self.bitmap = self._bitmap(ws)
        self.shared = spark.sparkContext.broadcast((self.word_head, self.pair_head, self.bitmap, self.total, self.kinds, self.unknown, self.once))

    def _gains(self, scored: DataFrame) -> DataFrame:
        head = scored.sparkSession.sparkContext.broadcast(self.word_head.only("back", "each", "lw"))
        once = self.once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = head.value
            for batch in batches:
                first, second, more = (batch.column(k).to_numpy() for k in (0, 1, 3))
                (a, i), (b, j) = words.at(first), words.at(second)
                get = words.get
                gain = more + once + get("each", a, i, 0.0) - get("back", a, i, 0.0) - get("lw", b, j, 0.0)
                key = pair_key(first.view(np.uint64), second.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns, pa.array(gain, mask=~(a & b))], ["key", *batch.schema.names, "gain"])

        return scored.mapInArrow(run, "key long, first long, second long, n long, more double, gain double")

    def _bitmap(self, ws: Workspace) -> np.ndarray:
        """A bit for every key of the tail at its hash; ``BITS`` bits at every size."""
        slot = F.pmod(F.col("key"), F.lit(BITS))
        word = F.floor(slot / 64)
        rows = ws.save(self.tail.groupBy(word.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(key, 64)))")).alias("bits")), "bitmap").toArrow()
        out = np.zeros(BITS // 64, np.int64)
        out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return out

    def scores(self, docs: DataFrame) -> DataFrame:
        """``doc_id, held_out, n_tokens, n_known, base_score, score`` of every row.

        Rows that are not held out are those that the model has learnt from.
        """
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, pairs, bitmap, total, kinds, unknown, once = shared.value
            none = math.log10(unknown)
            names, of_doc = ["cid", "key", "code", "doc"], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            # A slice's words and pairs are looked up once each, in the order of their keys.
            for batch in slices(batches, 256):
                ids, texts = batch.column(0).to_pylist(), [x.as_py() or "" for x in batch.column(1)]
                outside = np.array([held_out(d) for d in ids])
                each = [tokens(t) for t in texts]
                sizes = np.array([len(t) for t in each])
                starts = np.cumsum(sizes) - sizes
                flat = np.concatenate(each)
                owner = np.repeat(np.arange(len(each)), sizes)
                word, at = np.unique(flat.view(np.int64), return_inverse=True)
                here, place = words.at(word)
                real = word != MARK
                counts = words.get("n", here, place, 0)
                known = (real & (counts > 0))[at]
                base = np.where(real, np.log10((counts + 1) / (total + kinds + 1)), 0.0)[at]
                # Every token but the first is predicted, every token but the last predicts.
                backed = (np.where(real, words.get("lw", here, place, none), 0.0) + words.get("back", here, place, 0.0))[at]
                value = np.where(outside[owner], backed, words.get("each", here, place, 0.0)[at])
                inside = np.ones(len(flat) - 1, bool)
                inside[starts[1:] - 1] = False
                holder = owner[:-1][inside]
                key, pair_at = np.unique(pair_key(flat[:-1][inside], flat[1:][inside]).view(np.int64), return_inverse=True)
                got, spot = pairs.at(key)
                gain = np.where(outside[holder], pairs.get("gain", got, spot, 0.0)[pair_at], once + pairs.get("more", got, spot, 0.0)[pair_at])
                score = np.add.reduceat(value, starts) + np.bincount(holder, weights=gain, minlength=len(each))
                asks = []
                for keys, missing, where, whose in ((word, ~here, at, owner), (key, ~got, pair_at, holder)):
                    slot = keys % BITS
                    missing &= (bitmap[slot // 64] >> (slot % 64)) & 1 == 1
                    chosen = missing[where]
                    asked, times = np.unique(whose[chosen] * len(keys) + where[chosen], return_counts=True)
                    asks.append((asked // len(keys), keys[asked % len(keys)], times))
                cid = [xxh3_64_intdigest(f"{d} {t}".encode("utf-8", "surrogatepass")) - (1 << 63) for d, t in zip(ids, texts, strict=True)]
                # A document's own row joins nothing; its key is its own id.
                cid, zero = pa.array(cid, pa.int64()), pa.array(np.zeros(len(each), np.int64))
                own = [pa.array(ids, pa.int64()), pa.array(outside), pa.array(sizes - 1, pa.int64())]
                own += [pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(score)]
                own = pa.StructArray.from_arrays(own, of_doc)
                yield pa.RecordBatch.from_arrays([cid, cid, zero, own], names)
                whose, keys, many = (np.concatenate(x) for x in zip(*asks, strict=True))
                # How often, whether the key is a word's, whether the document is held out.
                code = many * 4 + (np.arange(len(keys)) < len(asks[0][0])) * 2 + outside[whose]
                yield pa.RecordBatch.from_arrays([cid.take(pa.array(whose)), pa.array(keys), pa.array(code), pa.nulls(len(keys), own.type)], names)

        row = "cid long, key long, code long, doc struct<doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double>"
        asked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, row)
        floor, none = math.log10(1 / (self.total + self.kinds + 1)), math.log10(self.unknown)
        # Both sides are cut by size, and the tail's keys are unique: it is hashed, nothing is sorted.
        # Larger parts than the pairs': a document sends one sum from each part.
        tail = self.tail.withColumnRenamed("n", "n_word").repartition(self.parts, "key").hint("shuffle_hash")
        met = asked.repartition(self.parts, "key").join(tail, "key", "left").where("doc is not null or out is not null")
        met = met.withColumn("own", F.col("doc").isNotNull()).withColumn("many", F.shiftright("code", 2))
        for bit, name in ((2, "word"), (1, "outside")):
            met = met.withColumn(name, F.col("code").bitwiseAND(F.lit(bit)) != 0)
        # In a held-out document a word of the tail replaces what the unknown word was given for it.
        met = met.withColumn("hit", ~F.col("own") & F.col("out").isNotNull())
        gain = F.when(F.col("outside"), F.col("out") - F.when(F.col("word"), F.lit(none)).otherwise(0.0)).otherwise(F.col("inside"))
        add = F.when(F.col("hit"), F.col("many") * gain)
        base = F.when(F.col("hit") & F.col("word"), F.col("many") * (F.log10((F.col("n_word") + 1) / F.lit(self.total + self.kinds + 1.0)) - F.lit(floor)))
        known = F.when(F.col("hit") & F.col("word"), F.col("many"))
        sums = met.groupBy("cid").agg(
            F.sum(F.col("own").cast("int")).alias("copies"),
            *[F.max(f"doc.{c}").alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")],
            F.sum(add).alias("add_score"),
            F.sum(base).alias("add_base"),
            F.sum(known).alias("add_known"),
        )
        per = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0))
        return sums.withColumn("_n", F.explode(F.expr("sequence(1, int(copies))"))).select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + per("add_known")).cast("long").alias("n_known"),
            F.lit(self.total).cast("long").alias("train_tokens"),
            (F.col("base_score") + per("add_base")).alias("base_score"),
            (F.col("score") + per("add_score")).alias("score"),
        )


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return KatzModel(docs).scores(docs)
