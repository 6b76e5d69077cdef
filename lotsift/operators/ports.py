"""Stand-ins for the services a run asks: an embedder and a model that completes verdicts.

Both take a DataFrame of distinct texts, so each text is asked once; a real service goes behind the
same shape with mapInPandas and its own batches and retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_vectors(texts: DataFrame, text: str, out: str, dim: int) -> DataFrame:
    """texts with a vector of length one from the hashes of their words; equal words point the same way."""
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def part(i: int):
        return F.aggregate(words, F.lit(0.0), lambda s, w: s + (F.pmod(F.xxhash64(w, F.lit(i)), F.lit(2001)) - 1000) / 1000.0)

    from .ranking import unit

    return texts.withColumn(out, unit(F.array(*[part(i) for i in range(dim)])))


def failing_closed(answers: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A model port that turns what the service gives into verdicts; a key without a verdict is not allowed."""

    def ask(rows: DataFrame) -> DataFrame:
        got = answers(rows).select("key", F.col("verdict").alias("v"), F.col("code").alias("c"))
        return rows.select("key").join(got, "key", "left").select("key", F.coalesce("v", F.lit("not_allowed")).alias("verdict"), F.coalesce("c", F.lit("")).alias("code"))

    return ask
