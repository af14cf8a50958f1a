"""Connected components by local contraction, without collecting links or components anywhere.

Every round gives the nodes a fresh random order, lets each node move to the first of its closed neighbourhood and
replaces the nodes of all edges by where they moved. A clique is done after one round and a star after two; in
expectation the nodes shrink by a constant share each round on any graph. Each round's moves are a written table, and
the tables, smaller every round, are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another: root is one node of its component, the same for all."""
    moves: list[DataFrame] = []
    left = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    while True:
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        both = materialise(both, "edges")
        if both.isEmpty():
            break
        order = lambda c, r=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("o"), F.col(c).alias("n"))
        first = both.groupBy("u").agg(F.min(order("v")).alias("best")).select("u", F.least(order("u"), "best")["n"].alias("to"))
        moves.append(first := materialise(first, "moves"))
        to_u, to_v = first, first.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        left = both.filter("u < v").join(to_u, "u").join(to_v, "v").select(F.col("to").alias("u"), F.col("to_v").alias("v")).filter("u <> v")
    if not moves:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    done = moves[-1]
    for earlier in moves[-2::-1]:
        later = done.select(F.col("u").alias("to"), F.col("to").alias("root"))
        done = earlier.join(later, "to", "left").select("u", F.coalesce("root", "to").alias("to"))
    return done.select(F.col("u").alias("node"), F.col("to").alias("root"))
