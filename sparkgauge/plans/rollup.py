"""Roll-ups of a corpus: how scores are distributed by any columns of the documents, at several levels at once.

Scores are whole numbers from 0 to 100, so a histogram of at most 101 counts says all about a group, and histograms are added
up like any counts: those of each day, or of each part of a corpus, can be kept and merged later. Means and quantiles are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The axis of a document's overall score.
OVERALL = "overall"


def score_histogram(reports: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, score, documents) of rows of analyze() that kept the columns ``by``: how many documents have a score on an
    axis, or overall. Axes on which no check counted have none. Null values are a group of their own."""
    none = F.struct(F.lit(OVERALL).alias("axis"), F.col("overall_score").alias("score"))
    counted = F.transform(F.filter("axis_scores", lambda a: a["check_count"] > 0), lambda a: F.struct(a["axis"].alias("axis"), a["score"].alias("score")))
    rows = reports.select(*by, F.explode_outer(F.concat(F.array(none), counted)).alias("s"))
    return rows.groupBy(*by, "s.axis", "s.score").agg(F.count(F.lit(1)).alias("documents"))


def roll_up(histograms: DataFrame, by: list[str], levels: list[list[str]], quantiles: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """(by, level, axis, documents, mean, p10, p50, p90) for each of ``levels``, which are subsets of ``by``; any number of histograms may be united
    first. ``level`` names the columns that a row is for, as others are null in it; a quantile is the least score that so many percent
    of the documents don't exceed. An empty table gives an empty one."""
    sets = [[*level, "axis", "score"] for level in levels]
    keys = [*by, "axis", "score"]
    names = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    counts = histograms.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(F.sum("documents").alias("n"), names.alias("level"))
    group = ["level", *by, "axis"]
    below = W.partitionBy(*group).orderBy("score")
    placed = counts.withColumn("upto", F.sum("n").over(below)).withColumn("all", F.sum("n").over(W.partitionBy(*group)))
    told = [F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("score"))).alias(f"p{q}") for q in quantiles]
    return placed.groupBy(*group).agg(F.sum("n").alias("documents"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean"), *told)
