"""Mixing of sources to target weights by Pareto order sampling.

Every source gets a target number of words: the budget shared by weight, no source
above ``max_epochs`` times its own words, the excess shared again by weight (water
filling, solved in closed form over the sorted ratios of room to weight). A source
takes ``floor(target / size)`` certain copies of each document; the fraction that
remains is a fixed-size sample: documents are ranked by the Pareto quantity
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of the document and ``p`` its
inclusion probability, and the lowest ranks are taken until the words are used up.
The sample's size is fixed in words, the unit of the targets.

Ranking needs no global sort: the ranks are cut into ``BINS`` bins per source, whose
sums find the bin where the budget ends, and only that bin is ordered. A hot source is
therefore spread over all tasks, and only map-side sums and one bin of it meet. The path
is DataFrame functions only.

Defined cases: null text has size 0; a null source is a source of its own, placed last;
repeated rows are separate documents that share their rank; a source without words has
target 0 and takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.plans.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of one level; two levels resolve a rank to 1 / BINS**2 of a source.
BINS = 2048
SEED = "pareto"


def word_count(text: Column) -> Column:
    """Words of a text by the ASCII white space rule; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` a source.

    The weights repeat over the sources in code-point order, null last. The windows run
    over the sources alone, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("i", F.row_number().over(by_name) - 1).withColumn("w", weight)
    room = ranked.withColumn("room", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("room") / F.col("w"), "i")
    below, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        room.withColumn("full", F.coalesce(F.sum("room").over(below), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("w").over(below), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every) * float(budget))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_w") - F.col("used")))
        .withColumn("open", F.col("level") * F.col("w") < F.col("room"))
    )
    first = level.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.col("room") / F.col("w"), F.col("i"), F.col("level")))).over(every))
    target = F.when(F.col("at").isNull(), F.col("room")).otherwise(F.least("room", F.col("at.level") * F.col("w")))
    return first.select("source", "source_size", target.alias("target"))


def _cut(rows: DataFrame, bin_col: str) -> DataFrame:
    """Per source the bin in which the running sum of words passes ``rest``.

    ``rows(key, <bin>, size, start, rest)``; ``start`` is what earlier bins have used.
    Sums are taken map-side; a window sees at most BINS rows of a source.
    """
    sums = rows.groupBy("key", bin_col).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    upto = Window.partitionBy("key").orderBy(bin_col)
    edges = sums.withColumn("before", F.col("start") + F.sum("words").over(upto) - F.col("words"))
    over = edges.where("before + words > rest and before <= rest")
    return over.groupBy("key").agg(F.min(bin_col).alias(f"cut_{bin_col}"), F.min_by("before", bin_col).alias(f"start_{bin_col}"))


def _ranked(docs: DataFrame, id_col: str, source_col: str, size: Column, tilt: Column | None) -> DataFrame:
    """``docs`` with ``_key, _id, _size, _u, _tilt``: what a document's rank needs."""
    digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(SEED))), 1, 12)
    unit = (F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0)) + 0.5) / float(1 << 48)
    return docs.withColumns(
        {
            "_key": F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(source_col, F.lit("")).alias("name")),
            "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
            "_size": size,
            "_u": unit,
            "_tilt": (tilt if tilt is not None else F.lit(1.0)).cast("double"),
        }
    )


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds each document's Pareto rank ``_q`` and its place in the two levels of bins."""
    odds = F.col("_u") / (1 - F.col("_u")) * ((1 - F.col("_p")) / F.col("_p")) / F.col("_tilt")
    place = F.col("_q") / (1 + F.col("_q")) * BINS
    return (
        rows.join(plan, "_key")
        .withColumn("_q", F.when(F.col("_p") > 0, odds))
        .withColumn("_bin", F.coalesce(F.floor(place), F.lit(BINS)).cast("int"))
        .withColumn("_fine", F.coalesce(F.floor((place - F.floor(place)) * BINS), F.lit(0)).cast("int"))
    )


def mix_plan(rows: DataFrame, weights: Sequence[float], budget: float, max_epochs: float, ws: Workspace) -> DataFrame:
    """One row per source: target, certain copies, and the last document of its sample.

    ``rows(_key, _id, _size, _u, _tilt)`` come from :func:`_ranked`.
    """
    totals = rows.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    named = totals.select(F.when(~F.col("_key.none"), F.col("_key.name")).alias("source"), "source_size")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = source_targets(named, weights, budget, max_epochs).withColumn("sure", F.floor(ratio))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rest = F.col("target") - F.col("sure") * F.col("source_size")
    plan = ws.save(
        plan.select(key.alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("sure").alias("_sure"), (ratio - F.col("sure")).alias("_p"), rest.alias("rest")),
        "plan",
    )
    ranked = _placed(rows, plan).withColumnsRenamed({"_size": "size", "_bin": "bin", "_fine": "fine"}).withColumn("start", F.lit(0).cast("long"))
    coarse = ws.save(_cut(ranked.withColumnRenamed("_key", "key"), "bin").withColumnRenamed("key", "_key"), "cuts")
    inside = ranked.drop("start").join(coarse, "_key").where("bin = cut_bin").withColumn("start", F.col("start_bin"))
    fine = ws.save(_cut(inside.withColumnRenamed("_key", "key"), "fine").withColumnRenamed("key", "_key"), "cuts")
    near = inside.drop("start").join(fine, "_key").where("fine = cut_fine")
    within = Window.partitionBy("_key").orderBy("_q", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("upto", F.col("start_fine") + F.sum("size").over(within))
    # The document that crosses the target is taken when that ends nearer to it.
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))
    last = near.where((F.col("upto") <= F.col("rest")) | nearer).groupBy("_key").agg(F.max(F.struct("_q", "_id")).alias("_last"))
    bounds = coarse.select("_key", F.col("cut_bin").alias("_cut_bin")).join(fine.select("_key", F.col("cut_fine").alias("_cut_fine")), "_key", "left")
    return ws.save(plan.drop("rest").join(bounds, "_key", "left").join(last, "_key", "left"), "plan")


def copies_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` of :func:`_ranked` with the columns of the plan and ``_copies``.

    Only the plan, a row a source, meets the rows; their texts never shuffle.
    """
    placed = _placed(rows, plan)
    here = F.struct("_q", "_id") <= F.col("_last")
    inner = (F.col("_fine") < F.col("_cut_fine")) | ((F.col("_fine") == F.col("_cut_fine")) & here)
    chosen = F.col("_cut_bin").isNull() | (F.col("_bin") < F.col("_cut_bin")) | ((F.col("_bin") == F.col("_cut_bin")) & inner)
    extra = F.when((F.col("_p") > 0) & F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return placed.withColumn("_copies", (F.col("_sure") + extra).cast("long"))


def pareto_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    tilt: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, copies, taken``.

    The inclusion probability is a source's own; ``tilt``, a positive column, multiplies
    a document's inclusion odds within its source.
    """
    ws = workspace or Workspace(docs.sparkSession)
    used = docs if tilt is not None else docs.select(id_col, text_col, source_col)
    ranked = _ranked(used, id_col, source_col, word_count(F.col(text_col)), tilt)
    rows = ws.save(ranked.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "_key", "_id", "_size", "_u", "_tilt"), "sizes")
    out = copies_taken(rows, mix_plan(rows, weights, budget, max_epochs, ws))
    return out.select(
        "id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken")
    )


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents`` at 150 % of their words."""
    out = pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    ws = workspace or Workspace(docs.sparkSession)
    sizes = ws.save(_ranked(docs, "doc_id", "source", word_count(F.col("text")), None).select("_key", "_id", "_size", "_u", "_tilt"), "sizes")
    plan = mix_plan(sizes, (5, 2, 1), 1.5, 2.0, ws)
    # Whole rows travel in a struct, so no name of theirs can clash.
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))
    out = copies_taken(_ranked(rows, "doc_id", "source", F.lit(0), None), plan).where("_copies > 0")
    return out.select("row", F.explode(F.expr("sequence(1, int(_copies))"))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5(doc_id::VARCHAR || 'pareto'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM t),
r AS (SELECT *, ([5, 2, 1])[(i % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS room FROM w),
o AS (SELECT *, coalesce(sum(room) OVER b, 0) AS filled, coalesce(sum(w) OVER b, 0) AS used,
             sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w
      FROM r WINDOW b AS (ORDER BY room / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - filled) / (all_w - used) AS level FROM o),
c AS (SELECT min({'x': room / w, 'i': i, 'level': level}).level AS level FROM l WHERE level * w < room),
p AS (SELECT l.source, source_size, CASE WHEN c.level IS NULL THEN room ELSE least(room, c.level * w) END AS target FROM l, c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM p),
g AS (SELECT *, floor(ratio) AS sure, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS rest FROM f),
q AS (SELECT d.doc_id, d.size, g.*, CASE WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END AS q
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q),
e AS (SELECT *, (sure + CASE WHEN p > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END)::BIGINT AS copies FROM s)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM e
"""
