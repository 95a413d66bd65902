"""Connected components of links, in DataFrame rounds with log-depth pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, observed


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label): the root above every node of a forest (node, parent) whose
    parents are smaller than their nodes."""
    jump = parents
    while True:
        above = jump.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = jump.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        jumped, seen = observed(jumped, "jump", moved=F.count_if("moved"))
        jump = jumped.select("node", "parent")
        if not seen["moved"]:
            return jump.withColumnRenamed("parent", "label")


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links (a, b) between nodes joined their
    components; a label is the smallest node of its component. In each round every
    label hooks on the smallest neighbouring one, and the forest is flattened. A round
    has no job but those that write its tables: the driver pays for every one."""
    while True:
        a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        across = links.join(a, "a").join(b, "b").where("la <> lb")
        across, seen = observed(across.select("a", "b", F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("parent")), "across", rows=F.count("*"))
        if not seen["rows"]:
            return labels
        roots = _roots(across.groupBy("node").agg(F.min("parent").alias("parent")))
        moved = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = materialize(labels.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        links = across.select("a", "b")
