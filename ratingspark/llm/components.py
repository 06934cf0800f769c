"""Connected components of an edge table, by rounds of contraction.

In every round each node moves to the least of its neighbours and itself, and edges follow. The first rounds order nodes
by value: the spanning stars that searches return collapse at once, as their centres have the least value. Later rounds
order by a hash under the round's seed, so an expected constant factor of the nodes vanishes whatever the graph's shape. Rounds
are aggregates with map-side combine and joins, so a node with very many edges is no group in one task; each
round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import stored

#: Rounds that order nodes by value.
BY_VALUE = 2


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, label): every node of an edge with one label per component. Loops and repeated
    edges do no harm; nodes without an edge to another node are absent; null ends are ignored."""
    left = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, moves = stored(left, "edges"), []

    def near(node, turn: int):
        order = F.xxhash64(F.lit(turn), node) if turn > BY_VALUE else node
        return F.struct(order.alias("order"), node.alias("node"))

    while not left.isEmpty():
        turn = len(moves) + 1
        ends = left.select(F.col("a").alias("node"), near(F.col("b"), turn).alias("to")).unionAll(
            left.select(F.col("b").alias("node"), near(F.col("a"), turn).alias("to")))
        moved = stored(ends.groupBy("node").agg(F.min("to").alias("to")).select(
            "node", F.least("to", near(F.col("node"), turn))["node"].alias("label")), "moves")
        moves.append(moved)
        to_a = moved.select(F.col("node").alias("a"), F.col("label").alias("x"))
        to_b = moved.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = stored(left.join(to_a, "a").join(to_b, "b").filter("x <> y")
                      .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = moves[0]
    for moved in moves[1:]:
        later = moved.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = found.join(later, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return found
