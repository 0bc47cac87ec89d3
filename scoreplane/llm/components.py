"""Connected components over a written edge table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node of the component.

    Each round takes the smallest label among the neighbours and then the label's own label; rounds
    stop when no label moves.  Every round is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .selectExpr("node", "LEAST(node, m) AS label"), "labels")
    state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while state is not None:
        near = both.join(labels.selectExpr("node AS b", "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("m"))
        moved = labels.join(near, "node").selectExpr("node", "LEAST(label, m) AS label")
        jump = labels.selectExpr("node AS label", "label AS next")
        labels = stored(moved.join(jump, "label", "left").selectExpr(
            "node", "LEAST(label, COALESCE(next, label)) AS label"), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return labels
        state = now
    return labels
