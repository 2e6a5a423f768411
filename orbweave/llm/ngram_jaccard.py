"""Exact Jaccard self-join of documents on word n-grams by a token-group matrix.

1. One pass hashes every text's shingles. Texts with the same set form a class, which
   its smallest id stands for.
2. Each class keeps a prefix of its set in hash order. If two sets of ``x <= y``
   elements reach the threshold, then prefixes of ``p + s + k`` elements, with
   ``p = floor((1 - t) * size) + 1``, ``s = floor(p / 2)`` and ``k = min(s, SPARE)`` at
   its own size, share at least ``1 + s(x) + k(x)`` tokens. Each class may therefore
   forget the ``s(ceil(t * size))`` tokens that most classes hold: of the shared ones the
   rarest ``1 + k(x)`` stay on both sides. A passage that a third of all documents
   contain so drops out of the matrix, and which tokens are forgotten never changes the
   result. What a class shares with others by chance grows with the table, but seldom
   reaches ``1 + k`` tokens: a class that shares fewer is in no link, and two that share
   fewer with each other are not linked.
3. Every class chooses a pivot, the smallest id of the blocks it shares most tokens
   with, if they are as many as a link needs. The classes that these choices connect are
   similar; cut by a hash into chunks of about ``GROUP_TOKENS`` shingles they are the
   groups. Of the other classes those of one block of more than ``HOT`` classes and of
   like size are a group, any other is one of its own.
4. The matrix holds (token, group) for the tokens of a group's members; a class is near
   the groups, its own included, with which it shares as many tokens of classes that fit
   in size as a link needs. Only the whole sets of classes that are near a group are read.
5. A group's token union, with the members that hold each token, is built once in one
   task; a member whose overlap with the rest of the union cannot reach the threshold is
   passed over, the others are verified, and links within the group give first components.
6. A class queries the other groups that it is near to and that hold a class of another
   component. The overlap of the query with the group's whole token union bounds its
   similarity to every member; only a group whose bound reaches the threshold is opened,
   and its members' overlaps counted from the group's lists. One link for each other
   component in a group is enough and members of the query's own component are skipped,
   so a family of near copies costs a tree, not all pairs. Of two classes the one in the
   smaller component asks.

7. Sets too small to reach the threshold with any other set are left out of the matrix:
   one that has ``x`` elements can at best share them all with a set of ``x + 1``.

Defined cases: null or word-less text has an empty set, size 0, and is linked with
nothing; rows that share an id are one node, so the classes of their texts are linked
and each of them gets the same component (an empty one keeps its own id); rows with a
null id get a null component and take no part; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.words import fingerprint, list_array, shingles, slices, split_words
from orbweave.plans.components import connected_components
from orbweave.plans.workspace import Workspace

#: Shingles of a group's members, and of the queries that meet it in one task, about.
GROUP_TOKENS, QUERY_TOKENS = 1 << 20, 1 << 20
#: Tokens besides the rarest that a pair must share after all that may be forgotten, at most.
SPARE = 4
#: Classes of a block from which on those that are like no other of it form groups too.
HOT = 1000


def prefix_length(size: int, num: int, den: int) -> int:
    """Tokens of which a partner at the threshold shares at least one, in any order."""
    return size - -(-num * size // den) + 1


def slack(size: int, num: int, den: int) -> int:
    return prefix_length(size, num, den) // 2


def forgettable(size: int, num: int, den: int) -> int:
    return slack(-(-num * size // den), num, den)


def spare(size: int, num: int, den: int) -> int:
    """Tokens kept on top of the slack; below a threshold of 3/4 a set may be too small."""
    return min(slack(size, num, den), SPARE) if 4 * num >= 3 * den else 0


def kept(size: int, num: int, den: int) -> int:
    return prefix_length(size, num, den) + slack(size, num, den) + spare(size, num, den)


def least_shared(size: int, num: int, den: int) -> int:
    """Tokens that a partner at the threshold, smaller or larger, shares after forgetting."""
    return 1 + spare(-(-num * size // den), num, den)


def least_shared_column(size: str, num: int, den: int) -> Column:
    """:func:`least_shared` of the column ``size``."""
    if 4 * num < 3 * den:
        return F.lit(1)
    low = f"(({size} * {num} + {den - 1}) div {den})"
    return F.expr(f"1 + least({SPARE}, ({low} - ({low} * {num} + {den - 1}) div {den} + 1) div 2)").cast("int")


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes as signed integers."""
    return np.unique(shingles(split_words(text, lower=True), n).view(np.int64))


def profile(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, forget, prefix`` of every row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x.as_py(), n) for x in batch.column(1)]
            sizes = [len(x) for x in sets]
            marks = [fingerprint(x) for x in sets]
            keep = [x[: kept(len(x), num, den)] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([x for x, _ in marks], pa.int64()),
                    pa.array([x for _, x in marks], pa.int64()),
                    pa.array([forgettable(x, num, den) if x else 0 for x in sizes], pa.int32()),
                    list_array(keep),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "forget", "prefix"],
            )

    schema = "doc_id long, n_shingles long, f1 long, f2 long, forget int, prefix array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``doc, group, size, tokens`` for the classes of ``wanted(doc, f1, f2, group)``.

    Rows that repeat a class follow each other where they meet and give one set; a set
    that nevertheless comes twice repeats links, nothing more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches):
            rows = []
            for doc, text, f1, f2, group in zip(*(batch.column(k) for k in range(5)), strict=True):
                here = doc.as_py(), f1.as_py(), f2.as_py()
                if here == last:
                    continue
                tokens = shingle_set(text.as_py(), n)
                if fingerprint(tokens) == here[1:]:
                    last = here
                    rows.append((here[0], group.as_py(), len(tokens), tokens.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "group", "size", "tokens"])

    # The same plan at every size: texts are sorted to the ids, which have no size bound.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted.hint("merge"), "doc")
    return joined.select("doc", "text", "f1", "f2", "group").mapInArrow(run, "doc long, group string, size long, tokens binary")


def reaches(shared: int, a: int, b: int, num: int, den: int) -> bool:
    return den * shared >= num * (a + b - shared)


class TokenUnion:
    """The token union of a group, and the members that hold each of its tokens."""

    def __init__(self, raw: pd.Series):
        self.sets = [np.frombuffer(x, np.int64) for x in raw]
        self.sizes = np.array([len(x) for x in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.tokens, starts = np.unique(flat[order], return_index=True)
        self.starts, self.ends = starts, np.append(starts[1:], len(flat))

    def places(self, query: np.ndarray) -> np.ndarray:
        """Where the union holds tokens of the query."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        return at[self.tokens[at] == query]

    def held(self, at: np.ndarray) -> np.ndarray:
        """In how many members each token stands."""
        return self.ends[at] - self.starts[at]

    def shared(self, at: np.ndarray) -> np.ndarray:
        """Tokens that the query shares with each member."""
        lengths = self.held(at)
        rows = np.repeat(self.starts[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[rows], minlength=len(self.sets))

    def linked(self, at: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        shared = self.shared(at)
        return den * shared >= num * (self.sizes + size - shared)


def inner_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` that connect the members of each group as far as they are linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        if len(pdf) > 1:
            union, docs, root = TokenUnion(pdf["tokens"]), pdf["doc"].to_numpy(), list(range(len(pdf)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, query in enumerate(union.sets):
                at = union.places(query)
                bound = int((union.held(at) > 1).sum())
                if not reaches(bound, len(query), max(bound, union.sizes.min()), num, den):
                    continue
                for j in np.flatnonzero(union.linked(at, len(query), num, den)):
                    x, y = find(i), find(int(j))
                    if x != y:
                        root[y] = x
                        links.append((docs[i], docs[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return sets.groupBy("group").applyInPandas(run, "a long, b long")


def opened_groups(members: DataFrame, queries: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` from queries to members of the groups they are dealt to.

    ``members(group, part, doc, component, tokens)``;
    ``queries(q_group, q_part, query, q_component, words)``.
    """

    def run(key, group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        links = []
        if len(group) and len(asked):
            union = TokenUnion(group["tokens"])
            docs, components = group["doc"].to_numpy(), group["component"].to_numpy()
            for doc, own, raw in zip(asked["query"], asked["q_component"], asked["words"], strict=True):
                query = np.frombuffer(raw, np.int64)
                at = union.places(query)
                # No member shares more than the bound, nor is one smaller than the least.
                if not len(at) or not reaches(len(at), len(query), max(len(at), union.sizes.min()), num, den):
                    continue
                linked = np.flatnonzero(union.linked(at, len(query), num, den) & (components != own))
                _, once = np.unique(components[linked], return_index=True)
                links += [(doc, other) for other in docs[linked[once]]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    left = members.groupBy("group", "part")
    return left.cogroup(queries.groupBy("q_group", "q_part")).applyInPandas(run, "a long, b long")


def near_groups(blocks: DataFrame, num: int, den: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """``groups(doc, own)`` and ``near(doc, group)``: which classes may link where.

    ``blocks`` as in :func:`block_links`. Two classes that share as many blocks as a link
    needs are near each other's groups, or near their own if that is the same. An id
    that several classes share stands for all of them.
    """
    heads = ws.save(blocks.groupBy("token").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "heads")
    ends = F.min("size").alias("low"), F.max("size").alias("high"), F.min("need").alias("need")
    votes = blocks.join(heads, "token").groupBy("doc", "pivot").agg(F.count("*").alias("votes"), F.max("n").alias("n"), *ends)
    best = F.max(F.when((F.col("votes") >= F.col("need")) & (F.col("doc") != F.col("pivot")), F.struct("votes", (-F.col("pivot")).alias("id"))))
    hub = F.max(F.when(F.col("n") > HOT, F.struct("n", (-F.col("pivot")).alias("id"))))
    lows = F.min("low").alias("low"), F.max("high").alias("high"), F.min("need").alias("need")
    stars = votes.groupBy("doc").agg((-best["id"]).alias("pivot"), (-hub["id"]).alias("hub"), *lows)
    stars = ws.save(stars, "stars")
    family = connected_components(stars.where("pivot is not null").select(F.col("doc").alias("a"), F.col("pivot").alias("b")), ws)
    family = family.select(F.col("node").alias("doc"), "component").union(family.select(F.col("component").alias("doc"), "component").distinct())
    # The classes of a hot block are no family; bands of size keep those apart that cannot link.
    band = F.floor(F.log("low") / float(np.log(den / num))) if num < den else F.col("low")
    crowd = F.when(F.col("hub").isNotNull(), F.concat_ws("/", "hub", band))
    named = stars.join(family, "doc", "left").withColumn("family", F.coalesce(F.col("component").cast("string"), crowd, F.col("doc").cast("string")))
    volume = named.groupBy("family").agg(F.ceil(F.sum("high") / GROUP_TOKENS).cast("long").alias("chunks"))
    chunk = F.pmod(F.xxhash64("doc"), F.col("chunks"))
    groups = named.join(volume, "family").select("doc", "low", "high", "need", F.concat_ws("-", "family", chunk).alias("own"))
    groups = ws.save(groups, "groups")

    cells = blocks.select("doc", "token").join(groups, "doc")
    matrix = cells.groupBy("token", F.col("own").alias("group")).agg(F.count("*").alias("held"), F.min("low").alias("least"), F.max("high").alias("most"))
    sized = (F.col("high") * den >= F.col("least") * num) & (F.col("most") * den >= F.col("low") * num)
    met = cells.join(matrix, "token").where(((F.col("group") != F.col("own")) | (F.col("held") > 1)) & sized)
    near = met.groupBy("doc", "group").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need")
    return groups.select("doc", "own"), ws.save(near.select("doc", "group"), "near")


def block_links(docs: DataFrame, classes: DataFrame, blocks: DataFrame, n: int, num: int, den: int, ws: Workspace) -> DataFrame:
    """Verified links ``(a, b)`` that connect the classes that share blocks.

    ``classes(doc, f1, f2)`` are the distinct sets and ``blocks(doc, size, need, token)``
    the memberships; every two classes with at least ``need`` tokens in common, the lesser
    of both, are told linked or not, except where earlier links already join their
    components.
    """
    groups, near = near_groups(blocks, num, den, ws)
    wanted = near.select("doc").distinct().join(groups, "doc").join(classes.select("doc", "f1", "f2"), "doc")
    sets = ws.save(whole_sets(docs, wanted.select("doc", "f1", "f2", F.col("own").alias("group")), n), "sets")
    links = ws.save(inner_links(sets, num, den), "links")
    first = ws.save(connected_components(links, ws), "components")

    labels = sets.select("doc", "size", "group").join(first, F.col("doc") == F.col("node"), "left").select("doc", "size", "group", F.coalesce("component", "doc").alias("component"))
    weight = labels.groupBy("component").agg(F.count("*").alias("weight"))
    placed = labels.join(weight, "component").select("doc", "size", "component", F.struct("weight", "component").alias("rank"), "group")
    placed = ws.save(placed, "placed")
    top = placed.groupBy("group").agg(F.max("rank").alias("top"))
    asked = near.join(placed.withColumnRenamed("group", "own"), "doc").where("group <> own").join(top, "group").where(F.col("rank") < F.col("top"))
    asked = ws.save(asked.select("doc", "size", "component", "group").distinct(), "queries")

    load = asked.groupBy("group").agg(F.ceil(F.sum("size") / QUERY_TOKENS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")).cast("int")
    dealt = asked.join(load, "group").select("doc", F.col("component").alias("q_component"), F.col("group").alias("q_group"), part.alias("q_part"))
    # Neither side has a size bound, so both joins are merges at every size.
    whole = sets.select("doc", "tokens").hint("merge")
    dealt = dealt.join(whole, "doc").select("q_group", "q_part", F.col("doc").alias("query"), "q_component", F.col("tokens").alias("words"))
    members = placed.join(load, "group").select("doc", "component", "group", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).join(whole, "doc")
    more = ws.save(opened_groups(members, dealt, num, den), "opened")
    return links.union(more)


def joined_components(rows: DataFrame, classes: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """``(node, component)`` over the links and over classes whose rows share an id."""
    named = rows.where("n_shingles > 0 and doc_id is not null").join(classes.select("f1", "f2", "n_shingles", "doc"), ["f1", "f2", "n_shingles"])
    several = named.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("most")).where("b < most").select("doc_id", "b")
    same_id = named.join(several, "doc_id").select(F.col("doc").alias("a"), "b")
    return ws.save(connected_components(links.union(same_id), ws), "components")


def by_component(rows: DataFrame, classes: DataFrame, whole: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every row of the profile."""
    by_set = classes.select("f1", "f2", "n_shingles", F.col("doc").alias("class_id"))
    named = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "f1", "f2").join(by_set, ["f1", "f2", "n_shingles"], "left")
    named = named.join(whole, F.col("class_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id"))
    named = named.select("doc_id", "n_shingles", component.alias("component_id"), "class_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return named.union(empty)


def jaccard_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of ``docs``.

    Documents link when ``den * |intersection| >= num * |union|`` of their sets of
    ``n``-word shingles. ``class_id`` is the smallest id with the very same set.
    """
    ws = workspace or Workspace(docs.sparkSession)
    rows = ws.save(profile(docs, n, num, den), "profile")
    filled = rows.where("n_shingles > 0")
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("forget").alias("forget"), F.first("prefix").alias("prefix"))
    classes = ws.save(classes.where("doc is not null"), "classes")
    linkable = classes.where(F.col("n_shingles") * den >= (F.col("n_shingles") + 1) * num)
    tokens = linkable.select("doc", F.col("n_shingles").alias("size"), "forget", F.explode("prefix").alias("token"))

    # A table of its own, so that a token of very many classes can be split where they meet.
    spread = ws.save(tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "spread")
    shared = tokens.join(spread, "token")
    per_doc = shared.groupBy("doc", "size", "forget").agg(F.sort_array(F.collect_list(F.struct(-F.col("held"), "token"))).alias("held"))
    left = F.slice("held", F.col("forget") + 1, F.greatest(F.size("held") - F.col("forget"), F.lit(0)))
    # Tokens that only one class holds may be counted among the forgotten ones or not.
    per_doc = per_doc.select("doc", "size", least_shared_column("size", num, den).alias("need"), left.alias("left")).where(F.size("left") >= F.col("need"))
    blocks = per_doc.select("doc", "size", "need", F.explode("left").alias("t")).select("doc", "size", "need", F.col("t.token").alias("token"))
    links = block_links(docs, classes, ws.save(blocks, "blocks"), n, num, den, ws)
    return by_component(rows, classes, joined_components(rows, classes, links, ws))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at a Jaccard similarity of 0.9 of 3-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


def one_of_each_group(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the smallest id stays.

    Five-word shingles and a similarity of 0.8; rows with a null id stay.
    """
    found = jaccard_components(docs, workspace=workspace).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    # Whole rows travel in a struct, so no name of theirs can clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), F.struct("*").alias("row"))
    return rows.join(found, F.col("own") == F.col("gone"), "left_anti").select("row.*")
