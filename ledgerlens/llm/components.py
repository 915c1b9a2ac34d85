"""Problem 6: one group identifier for every record of a chain of pairwise matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import stored


def boruvka_groups(pairs: DataFrame, a: str = "loan_a", b: str = "loan_b", max_rounds: int = 64) -> DataFrame:
    """(node, group_id) for every node in at least one pair with two different non-null ends.

    Deterministic Boruvka hooking. Each round, every component picks its smallest outgoing edge, ordered by
    (smaller end, larger end); that order is the same seen from both ends, so the picks form trees with one mutual
    edge each, whose smaller end is the root. Pointer doubling collapses the trees, the edges are rewritten to the
    roots, loops are dropped and repeated edges merged, until no edge is left. Rounds are logarithmic in the number
    of nodes; every step is a join or an aggregation by node, and a hub with a third of all edges is reduced by the
    map-side minimum before any shuffle.

    group_id is the smallest node of the group (string order for strings). Nulls, loops and repeated rows are
    ignored; an empty table gives an empty result; other columns are not read.
    """
    edges = (
        pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = stored(edges, "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = nodes.select("node", F.col("node").alias("root"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "u", "v"), F.struct(F.col("v").alias("node"), "u", "v"))).alias("e")).select("e.*")
        pick = ends.groupBy("node").agg(F.min(F.struct("u", "v")).alias("e"))
        to = pick.select("node", F.when(F.col("e.u") == F.col("node"), F.col("e.v")).otherwise(F.col("e.u")).alias("parent"))
        # The mutual edge of a tree is the only 2-cycle: its smaller end becomes the root.
        back = to.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hook = to.join(back, "parent", "left").select("node", F.when((F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"))
        hook = stored(hook, "hook")
        while True:
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            hook = stored(hook.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")), "hook")
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        step = hook.select(F.col("node").alias("root"), F.col("parent").alias("top"))
        label = stored(label.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "label")
        left = hook.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = hook.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        # Every end of an edge picked an edge, so inner joins lose nothing.
        edges = stored(
            edges.join(left, "u").join(right, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct(),
            "edges",
        )
    else:
        raise RuntimeError("no end after max_rounds; the rounds are logarithmic, so the input changed between reads")
    smallest = label.groupBy("root").agg(F.min("node").alias("group_id"))
    return label.join(smallest, "root").select("node", "group_id")
