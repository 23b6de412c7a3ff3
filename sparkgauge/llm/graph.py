"""Connected components over a table of links, however large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex in ``links`` (a, b, longs): the smallest vertex that it reaches.

    Each round takes the smallest root among a vertex's own and its neighbours', then that root's root, so paths halve;
    the roots are written to the shared folder every round, and only the number of changes comes to the driver.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "links")
    roots = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    roots = cut(roots, "roots")
    while True:
        near = both.join(roots, both["b"] == roots["v"]).groupBy(F.col("a").alias("w")).agg(F.min("root").alias("near"))
        better = roots.join(near, roots["v"] == near["w"]).select("v", "root", F.least("root", "near").alias("next"))
        better = cut(better, "roots")
        up = roots.select(F.col("v").alias("u"), F.col("root").alias("up"))
        following = better.join(up, better["next"] == up["u"]).select("v", "root", F.least("next", "up").alias("next"))
        following = cut(following, "roots")
        if not following.filter("next < root").limit(1).count():
            return roots
        roots = following.select("v", F.col("next").alias("root"))
