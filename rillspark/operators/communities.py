"""Communities of a weighted graph by modularity: rounds of local moves, then the graph of communities, until nothing is gained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.ranking import numbered
from rillspark.session import removed, tables_so_far, written

#: Least rise of the modularity for which a round or a level goes on.
LEAST_GAIN = 1e-4
#: Shares of the nodes (in quarters) that may move together; the next is tried when a round did not raise the modularity.
SHARES = (4, 1)
MOST_ROUNDS = 1000


def _totals(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.sum("k").alias("total"), F.sum("loop").alias("loops"))


def _votes(near: DataFrame, labels: DataFrame) -> DataFrame:
    """node, own, k, label, w: the weight between each node and each community around it, written.

    Edges are summed by community before the choice, so a hub costs what it has communities around it.
    """
    around = near.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node", "label").agg(F.sum("weight").alias("w"))
    return written(around.join(labels.select("node", F.col("label").alias("own"), "k"), "node"), "votes")


def _modularity(votes: DataFrame, labels: DataFrame, whole: int) -> float:
    """Share of weight inside communities less what chance gives."""
    share = F.col("total") / whole
    parts = votes.where("label = own").select((F.col("w") / whole).alias("part")).union(_totals(labels).select(F.col("loops") / whole - share * share))
    return parts.agg(F.sum("part")).first()[0]


def _moves(votes: DataFrame, labels: DataFrame, whole: int, quarters: int, turn: int) -> DataFrame:
    """node, target: the community of most gain for each node that gains by leaving its own; of equal gains the smallest.

    Between two communities nodes move one way only in a turn, which way is drawn anew each turn, so two nodes never swap.
    """
    totals = _totals(labels).select("label", "total")
    gained = F.col("w") * float(whole) - F.col("k") * F.col("total").cast("double")
    one_way = F.xxhash64(F.least("label", "own"), F.greatest("label", "own"), F.lit(turn)) % 2 == 0
    chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(4)) < quarters
    others = votes.where((F.col("label") != F.col("own")) & ((F.col("label") < F.col("own")) == one_way) & chosen).join(totals, "label")
    best = others.groupBy("node").agg(F.min(F.struct((-gained).alias("less"), "label")).alias("top"))
    # what staying is worth: the weight to the own community, without the node itself
    stay = votes.groupBy("node", "own", "k").agg(F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("w"))), F.lit(0)).alias("w"))
    here = stay.join(totals.select(F.col("label").alias("own"), "total"), "own")
    worth = F.col("w") * float(whole) - F.col("k") * (F.col("total") - F.col("k")).cast("double")
    return here.join(best, "node").where(-F.col("top.less") > worth).select("node", F.col("top.label").alias("target"))


def local_moves(near: DataFrame, nodes: DataFrame, whole: int) -> tuple[DataFrame, float]:
    """node, label, k, loop after rounds of moves until no share of the nodes raises the modularity, and that modularity.

    Every round is written.  A round that does not raise the modularity (too many nodes went to one community at
    once, or nothing is gained) is taken back, and the next smaller share of the nodes is tried.
    """
    spark = near.sparkSession
    start = tables_so_far()
    labels = nodes.withColumn("label", F.col("node"))
    votes = _votes(near, labels)
    reached, share = _modularity(votes, labels, whole), 0
    for turn in range(MOST_ROUNDS):
        moves = _moves(votes, labels, whole, SHARES[share], turn)
        trial = written(labels.join(moves, "node", "left").select("node", F.coalesce("target", "label").alias("label"), "k", "loop"), "labels")
        new_votes = _votes(near, trial)
        value = _modularity(new_votes, trial, whole)
        if value > reached + LEAST_GAIN:
            removed(spark, start, keep=[trial, new_votes])
            labels, votes, reached = trial, new_votes, value
            continue
        share += 1
        if share == len(SHARES):
            break
    else:
        raise RuntimeError("the moves did not settle")
    out = written(labels, "labels")
    removed(spark, start, keep=[out])
    return out, reached


def communities(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, community, size: a partition of high modularity, parallel edges as weight, loops left out.

    Communities are numbered from 1 by falling size, then by their smallest node, so an unchanged graph keeps its
    numbers.  Nodes without an edge to another one have none.
    """
    spark = edges.sparkSession
    start = tables_so_far()
    # a null end compares as null and leaves the edge out
    both = edges.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("to")), F.struct(F.col(b).alias("node"), F.col(a).alias("to")))).alias("e"))
    near = written(both.groupBy("e.node", "e.to").agg(F.count("*").alias("weight")).select("node", "to", "weight"), "near")
    nodes = written(near.groupBy("node").agg(F.sum("weight").alias("k")).withColumn("loop", F.lit(0).cast("long")), "nodes")
    whole = nodes.agg(F.sum("k")).first()[0]
    members, reached = nodes.select("node", F.col("node").alias("label")), -1.0
    while whole:
        labels, value = local_moves(near, nodes, whole)
        moved = labels.select("node", "label")
        if value <= reached + LEAST_GAIN:
            break
        reached = value
        members = written(members.withColumnRenamed("label", "was").join(moved.select(F.col("node").alias("was"), "label"), "was").select("node", "label"), "members")
        # a community becomes a node; what lies inside becomes its loop
        ends = near.join(moved, "node").join(moved.select(F.col("node").alias("to"), F.col("label").alias("other")), "to")
        folded = written(ends.groupBy("label", "other").agg(F.sum("weight").alias("weight")), "folded")
        inner = folded.where("label = other").select("label", F.col("weight").alias("inner"))
        sums = labels.groupBy("label").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        nodes = written(sums.join(inner, "label", "left").select(F.col("label").alias("node"), "k", (F.col("loop") + F.coalesce("inner", F.lit(0))).alias("loop")), "nodes")
        near = written(folded.where("label != other").select(F.col("label").alias("node"), F.col("other").alias("to"), "weight"), "near")
        removed(spark, start, keep=[members, nodes, near])
    sizes = members.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    named = numbered(sizes, [F.desc("size"), F.col("first")], "community")
    out = written(members.join(named.select("label", "community", "size"), "label").select("node", "community", "size"), "communities")
    removed(spark, start, keep=[out])
    return out
