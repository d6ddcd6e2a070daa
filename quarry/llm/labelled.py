"""Bounded samples of labelled documents for the two trained document classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, sliced


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, bounds: dict[int, int], seed: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(text, y): at most ``bounds[y]`` documents of each label y, chosen by a seeded hash of the id.

    Held-out rows never enter. Labels other than the keys of ``bounds``, null labels and ids with contradicting labels are
    left out; an id that is repeated in the labels or the documents counts once, with the least of its texts.
    """
    one = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(*bounds) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_y").alias("y"), F.max("_y").alias("_top")).filter("y = _top")
    )
    parts = [one.filter(F.col("y") == y).select("_id", "y").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(n) for y, n in bounds.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "_id")  # bounded: sum of bounds
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.first("y").cast("int").alias("y")).select("text", "y")


def score_rows(docs: DataFrame, scorer, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``scorer`` turns a list of texts (or None) into scores."""
    import pyarrow as pa

    def run(batches):
        for batch in sliced(batches):
            scores = scorer(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def score_column(scorer, text: Column) -> Column:
    """The score as a column expression, for filters that keep every column of a table."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer([t if isinstance(t, str) else None for t in texts]))

    return F.pandas_udf(run, "double")(text)
