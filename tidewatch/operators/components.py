"""Connected components of a graph in a DataFrame, by contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forgetful(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read again, without their plan's size estimate and partitions.

    A checkpoint keeps its plan's estimate, and a join's estimate is the product of its sides', so that over
    rounds of joins the estimate's digits grow exponentially: to hundreds of MB of the driver and of every task's
    description.  Files have their size, and the few that a small graph fills are read by few tasks.
    """
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fewer(ties: DataFrame) -> DataFrame:
    """(a long, b struct with a node ``class``) -> distinct (a, b) of the same components, for nodes with few ties each.

    A node is tied to the least of its b only, and that one to the others: nodes of a group share these ties.
    """
    rows = ties.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs")).select("a", F.col("bs")[0]["class"].alias("least"), F.explode("bs.class").alias("b"))
    return rows.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("least")).alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, label): the least node of its component, for every node of an edge.

    In a round each node chooses its neighbour of the least hash, which is drawn anew in each round, and is merged with what
    that one chose; two that chose each other become the lesser of them.  Only edges between different merged nodes go on, each once.
    Every component that is left loses nodes in a round, a constant part of them on the average, so that rounds shrink and the rows
    joined in all of them follow the edges.  In the end nodes are named backwards from round to round.
    Rounds are written down, so that plans stay short and a lost executor costs no more than a round.  A hub's edges are
    aggregated before they meet, and both sides of a join are dealt out anew, so that Spark can split a hub.
    """
    left = forgetful(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = forgetful(both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(len(rounds))), "b"))["b"].alias("to")).withColumnRenamed("a", "node"))
        then = chosen.select(F.col("node").alias("to"), F.col("to").alias("then"))
        merged = F.when(F.col("then") == F.col("node"), F.least("node", "to")).otherwise(F.col("then"))
        rounds.append(forgetful(chosen.join(then, "to").select("node", merged.alias("merged"))))
        met = left.join(rounds[-1].select(F.col("node").alias("a"), F.col("merged").alias("x")), "a").join(rounds[-1].select(F.col("node").alias("b"), F.col("merged").alias("y")), "b")
        left = forgetful(met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    named = rounds.pop()
    while rounds:
        later = named.select(F.col("node").alias("merged"), F.col("merged").alias("name"))
        named = rounds.pop().join(later, "merged", "left").select("node", F.coalesce("name", "merged").alias("merged"))
    named = forgetful(named)
    least = named.groupBy(F.bitwise_not("merged").alias("flipped")).agg(F.min(F.least("node", "merged")).alias("label")).select(F.bitwise_not("flipped").alias("merged"), "label")
    return forgetful(named.join(least, "merged").select("node", "label"))
