"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns); root is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then jumps to the label's own label, so that chains
    shorten by doubling. Rounds are cut by tables in the shared folder; only the number of changed rows comes to the
    driver. Nothing is broadcast: every side grows with the links. Links with a null end or onto themselves are ignored; repeated links count once. No links: no rows."""
    ends = links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("near")).where("node <> near")
    both = materialize(ends.union(ends.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("near"), "root").hint("merge"), "near").groupBy("node").agg(F.min("root").alias("around"))
        # written, so that the jump deals both sides out itself and the rows of a giant component's root can be split
        hooked = materialize(labels.join(around.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "around").alias("root")), "hooked")
        targets = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialize(hooked.join(targets.hint("merge"), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("moved")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return labels
