"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words in proportion to its weight, but at most ``max_epochs`` times its own words; what a
cap cuts off goes to the other sources by weight until no source is above its cap. With sources ordered by cap over
weight, the level of the water is max over k of (total - caps of the first k) / (weights of the rest), which one window
over the table of sources gives. Words are then taken as whole repetitions plus one seeded partial pass: documents in
the order of a hash, up to the one whose middle passes the need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import materialize

#: Hash ranges in which the partial pass of a source is ordered; a hot source is spread over all of them.
RANGES = 4096
#: Tables with a row for each source are broadcast up to this many rows.
PLAN_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); the table has one row for each source.

    Weights repeat over the sources in code-point order, null last. The targets sum to all sizes.
    """
    everything = W.partitionBy()
    number = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(max_epochs)).alias("_cap"))
    before = everything.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    return (
        ranked.select("*", level.alias("_level"))
        .select("source", "source_size", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")).alias("target"))
    )


def _key(source: Column) -> Column:
    """The source as text that is never null, so that joins and windows share one exchange."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _row(seed: int, id_col: Column, text_col: Column) -> Column:
    """A number from 0 to 2^60 - 1 that depends on seed, id and text only; an md5, so that other engines can compute it."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """What each source gives: (key, source_size, target, whole, edge, cut, some, of), from rows (source, size, row).

    Every document is taken ``whole`` times, and once more if its range of the hash lies below ``edge``, or is ``edge`` and its
    hash is below ``cut``. Of the ``of`` rows whose hash is ``cut`` (more than one only if rows repeat), ``some`` are taken once more.
    """
    rows = rows.select("source", "size", "row", F.pmod("row", F.lit(RANGES)).cast("int").alias("range"))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = water_fill(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    reps = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(reps).cast("long")
    targets = targets.select(_key(F.col("source")).alias("key"), "source_size", "target", whole.alias("whole"), ((reps - whole) * F.col("source_size")).alias("need"))
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    placed = ranges.select(_key(F.col("source")).alias("key"), "range", "words")
    placed = placed.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets.select("key", "need"), "key")
    edges = placed.filter("start < need and need <= start + words").groupBy("key").agg(F.min_by(F.struct("range", "start", "need"), "range").alias("e"))
    edges = edges.select("key", F.col("e.range").alias("range"), "e.start", "e.need")
    # repeated rows are one row with a count before the window, so a hot text is no hot task
    at_edge = rows.filter("size > 0").select(_key(F.col("source")).alias("key"), "range", "row", "size").join(edges, ["key", "range"])
    at_edge = at_edge.groupBy("key", "range", "row", "size").agg(F.count("*").alias("of"), F.first("start").alias("start"), F.first("need").alias("need"))
    earlier = W.partitionBy("key", "range").orderBy("row", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("need") - F.col("start") - F.coalesce(F.sum(F.col("size") * F.col("of")).over(earlier), F.lit(0))
    some = F.least(F.col("of"), F.floor(left / F.col("size") + 0.5)).cast("long")  # rows whose middle lies within the need
    cuts = at_edge.select("key", "row", "of", some.alias("some")).filter("some > 0").groupBy("key").agg(F.max(F.struct("row", "some", "of")).alias("c"))
    return (
        targets.join(edges.select("key", F.col("range").alias("edge")), "key", "left").join(cuts, "key", "left")
        .select("key", "source_size", "target", "whole", F.coalesce("edge", F.lit(-1)).alias("edge"), F.col("c.row").alias("cut"), F.col("c.some").alias("some"), F.col("c.of").alias("of"))
    )


def _copies(size: Column, row: Column) -> Column:
    """Copies of a row; one at the cut counts as taken once more."""
    place = F.pmod(row, F.lit(RANGES)).cast("int")
    more = (place < F.col("edge")) | ((place == F.col("edge")) & F.coalesce(row <= F.col("cut"), F.lit(False)))
    return F.when(size > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")


def _split_cut(rows: DataFrame) -> DataFrame:
    """Take only ``some`` of the ``of`` equal rows at a source's cut; from rows with key, row, copies and those of the plan.

    Equal rows are numbered within the partitions that hold them, with offsets from the partitions' counts, so no task gets them all.
    """
    split = F.coalesce((F.col("row") == F.col("cut")) & (F.col("some") < F.col("of")) & (F.pmod("row", F.lit(RANGES)) == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    rest, equal = rows.filter(~split), materialize(rows.filter(split).withColumn("_at", F.spark_partition_id()), "equal")
    counts = equal.groupBy("key", "_at").agg(F.count("*").alias("_n"))
    before = W.partitionBy("key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("key", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = equal.join(offsets, ["key", "_at"]).withColumn("_r", F.col("_offset") + F.row_number().over(W.partitionBy("key", "_at").orderBy("row")))
    taken = numbered.withColumn("copies", F.col("copies") - (F.col("_r") > F.col("some")).cast("long"))
    return rest.unionByName(taken.select(rest.columns))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast if it has few rows (one a source); else Spark joins it by a shuffle."""
    return F.broadcast(table) if table.count() <= PLAN_ROWS else table


def _narrow(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), _row(seed, F.col(id_col), text).alias("row")), "mix")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken and copies.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that. A null text has no words; a null
    source is a source of its own, last in order. Rows without words take no part (0 copies). Of repeated rows at the cut only as
    many are taken once more as the need holds; they are equal, so it doesn't matter which. An empty table gives an empty result. The same rows and seed give the same mix at any
    partitioning. Only the named columns are read, so other columns can have any names. The table of sources, a row each, is sorted in one task.
    """
    rows = _narrow(docs, seed, id_col, text_col, source_col)
    shares = materialize(plan(rows, weights, max_epochs), "plan")
    joined = rows.withColumn("key", _key(F.col("source"))).join(_small(shares), "key").withColumn("copies", _copies(F.col("size"), F.col("row")))
    if not shares.filter("some < of").isEmpty():
        joined = _split_cut(joined)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``mix`` takes it. Texts are not shuffled."""
    shares = materialize(plan(_narrow(docs, seed, id_col, text_col, source_col), weights, max_epochs), "plan")
    share = _small(shares.select(F.struct("*").alias("_share")))
    joined = docs.select(F.struct("*").alias("_doc")).join(share, _key(F.col(f"_doc.{source_col}").cast("string")) == F.col("_share.key"))
    doc = F.col("_doc")
    fields = joined.select("_doc", "_share.*", words(doc[text_col]).alias("size"), _row(seed, doc[id_col], doc[text_col]).alias("row"))
    fields = fields.withColumn("copies", _copies(F.col("size"), F.col("row")))
    if not shares.filter("some < of").isEmpty():
        fields = _split_cut(fields)
    return fields.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select("_doc.*")
