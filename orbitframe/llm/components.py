"""Connected components of a link table by label propagation with pointer jumping, all as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.storage import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, label): for each id in links (a, b), the smallest id of its component.

    Each round takes the smallest label among neighbours, then the label of that label, so the number of rounds
    follows the logarithm of a component's diameter. Rounds are written out, so lost executors cost one round.
    """
    both = links.union(links.select("b", "a"))
    files = max(1, round(links.count() ** 0.5 / 32))  # a few thousand rows each, growing with the links
    labels = work.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"{name}/0", files)
    k = 0
    while True:
        k += 1
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        moved = step.join(jump, step.label == jump.via, "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        saved = work.save(moved, f"{name}/{k}", files)
        changed = saved.where("label < old").limit(1).count()
        labels = saved.select("id", "label")
        work.drop(f"{name}/{k - 1}")
        if not changed:
            return labels
