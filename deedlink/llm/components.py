"""Connected components by joins: labels sink to the least name while pointers halve the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deedlink.llm.common import few, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges``.

    Edges with a null end are left out. Each round takes, for every node, the least label among its neighbours' and
    then the label of that label. A neighbourhood is reduced before it is shuffled, so that a hub is no hot task, and
    every round is written to the shared folder, by as few tasks as the edges need. The number of rounds is that of the logarithm of the longest path.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stage(few(pairs.union(pairs.select("b", "a")).distinct(), 2 * edges.count()), "component-edges")
    count = both.count()
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
    labels = stage(few(labels, count), "component-labels")
    while True:
        lower = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # a node tells its root of the least label it sees: hooks trees together
        seen = labels.join(lower, "node").select("node", "root", F.least("root", "near").alias("best"))
        hooks = seen.groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook"))
        hooked = seen.join(hooks, "node", "left").select("node", "root", F.least("best", F.coalesce("hook", "best")).alias("next"))
        hooked = stage(few(hooked, count), "component-hooks")
        far = hooked.select(F.col("node").alias("next"), F.col("next").alias("after"))
        jumped = hooked.join(far, "next", "left").select("node", F.col("root").alias("old"), F.least("next", F.coalesce("after", "next")).alias("root"))
        labels = stage(few(jumped, count), "component-labels")
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
