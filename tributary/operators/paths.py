"""Distances, bounded walks, chains of parents, and words accepted by automata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import HOPS, least_fixpoint, written
from ..sources.flowgraphs import FlowGraph


def distances(g: FlowGraph, costs: DataFrame, seeds: DataFrame) -> DataFrame:
    """keys, origin, node, distance: the least cost from seeds (keys, node) to every reachable node; costs are not negative.
    Each round relaxes only the nodes that came nearer."""
    k = list(g.keys)
    best = written(seeds.select(*k, F.col("node").alias("origin"), "node", F.lit(0).cast("long").alias("distance")).distinct())
    near = best
    while not near.isEmpty():
        more = near.withColumnRenamed("node", "src").join(costs, [*k, "src"]).groupBy(*k, "origin", F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("cost")).alias("new"))
        joined = written(best.join(more, [*k, "origin", "node"], "full").withColumn("nearer", F.col("distance").isNull() | (F.col("new") < F.col("distance"))))
        least = F.least(F.coalesce("distance", "new"), F.coalesce("new", "distance")).alias("distance")
        best, near = joined.select(*k, "origin", "node", least), joined.where("nearer").select(*k, "origin", "node", F.col("new").alias("distance"))
    return best


def within(g: FlowGraph, seeds: DataFrame, most: int) -> DataFrame:
    """keys, origin, node, steps: nodes that walks of up to so many steps from seeds end at, for every number of steps."""
    k = list(g.keys)
    seed = seeds.select(*k, F.col("node").alias("origin"), "node", F.lit(0).alias("steps"))
    return least_fixpoint(seed, lambda delta, _: delta.where(F.col("steps") < most).withColumnRenamed("node", "src").join(g.edges, [*k, "src"]).select(*k, "origin", F.col("dst").alias("node"), (F.col("steps") + 1).alias("steps")), HOPS)


def roots(parents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node, root, depth: the end of each node's chain of parents (keys, node, parent), by pointer doubling.
    Nodes on a cycle, and those that lead to one, have none."""
    k = list(keys)
    at = written(parents.select(*k, "node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth")))
    n = at.count()
    reach = 1
    while True:
        far = at.select(*k, F.col("node").alias("to"), F.col("to").alias("far"), F.col("depth").alias("more"))
        new = written(at.join(far, [*k, "to"], "left").select(*k, "node", F.coalesce("far", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")))
        at, reach = new.drop("moved"), 2 * reach
        if reach > n or new.where("moved").isEmpty():
            return new.where("not moved").select(*k, "node", F.col("to").alias("root"), "depth")


def accepted(words: DataFrame, initial: DataFrame, final: DataFrame, transitions: DataFrame) -> DataFrame:
    """word_id of the words (word_id, pos from 0, letter) that the automaton accepts. transitions: src, dst, kind
    ('all': any letter, 'only': letter, 'free': none), letter; initial and final: state. Words without letters aren't in the table.

    Each letter is the pairs of states that it leads from and to, free moves before it included; neighbours are composed
    until a word is one table of pairs, so rounds are the logarithm of the longest word, and each has half the rows."""
    t = transitions.select("src", "dst", "kind", "letter")
    states = t.select(F.col("src").alias("state")).union(t.select("dst")).union(initial.select("state")).union(final.select("state")).distinct()
    ways = states.select(F.col("state").alias("src"), F.col("state").alias("mid")).union(t.where("kind = 'free'").select("src", F.col("dst").alias("mid")))
    free = least_fixpoint(ways, lambda delta, seen: delta.select("src", F.col("mid").alias("m")).join(seen.select(F.col("src").alias("m"), "mid"), "m").select("src", "mid"))
    moves = written(free.join(t.where("kind <> 'free'").withColumnRenamed("src", "mid"), "mid").select("src", "dst", "kind", "letter").distinct())
    any_, only = moves.where("kind = 'all'").select("src", "dst"), moves.where("kind = 'only'").select("src", "dst", "letter")
    words = words.select("word_id", F.col("pos").cast("long").alias("at"), "letter")
    size = words.groupBy("word_id").agg((F.max("at") + 1).alias("size"))
    read = words.select("word_id", "at").join(any_, how="cross").union(words.join(only, "letter").select("word_id", "at", "src", "dst"))
    # Of the first letters only moves from initial states matter.
    start = read.where("at = 0").join(initial.select(F.col("state").alias("src")), "src", "left_semi").select(*read.columns)
    part = written(start.union(read.where("at > 0")).distinct().join(size, "word_id"))
    left = part.agg(F.max("size")).first()[0] or 1
    while left > 1:
        first = part.where("at % 2 = 0 and at < size - 1").select("word_id", "size", (F.col("at") + 1).alias("at"), "src", F.col("dst").alias("mid"))
        both = first.join(part.where("at % 2 = 1").select("word_id", "at", F.col("src").alias("mid"), "dst"), ["word_id", "at", "mid"])
        odd = part.where("at % 2 = 0 and at = size - 1")
        rows = both.select("word_id", "at", "src", "dst", "size").distinct().union(odd.select("word_id", "at", "src", "dst", "size"))
        part, left = written(rows.select("word_id", F.expr("at div 2").alias("at"), "src", "dst", F.expr("(size + 1) div 2").alias("size"))), (left + 1) // 2
    ends = free.join(final.select(F.col("state").alias("mid")), "mid", "left_semi").select(F.col("src").alias("dst"))
    return part.join(initial.select(F.col("state").alias("src")), "src", "left_semi").join(ends, "dst", "left_semi").select("word_id").distinct()
