"""Runs of graphs under fixed choices, and whether observers of some nodes can tell them apart.

An input (keys, input) starts at a node and has a choice at each branch, so its run
is a path that ends, or a path into a loop: no node stands twice in the path and
one turn of the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import written


def runs(steps: DataFrame, starts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, input, pos, node, period: the nodes of each run in the order of their first visits, and of those in its loop
    how long a turn takes. steps: keys, input, node, to, one a node; starts: keys, input, node."""
    k = [*keys, "input"]
    steps = written(steps.select(*k, "node", "to"))
    most = steps.groupBy(*k).agg((F.count("*") + 1).alias("most"))
    seed = starts.select(*k, "node", F.lit(0).cast("long").alias("pos")).join(most, k, "left").select(*k, "node", "pos", F.coalesce("most", F.lit(0)).cast("long").alias("most"))
    # One visit more than there are nodes: then the loop has been closed. Jumps of 1, 2, 4 … steps double the walk.
    walk, jump, far = written(seed.distinct()), steps, 1
    while True:
        on = walk.where(F.col("pos") + far <= F.col("most")).join(jump, [*k, "node"]).select(*k, F.col("to").alias("node"), (F.col("pos") + far).alias("pos"), "most")
        on = written(on)
        if on.isEmpty():
            break
        walk = walk.union(on)
        jump = written(jump.select(*k, "node", F.col("to").alias("mid")).join(jump.select(*k, F.col("node").alias("mid"), "to"), [*k, "mid"]).select(*k, "node", "to"))
        far *= 2
    visits = written(walk.groupBy(*k, "node").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.count("*").alias("times")))
    by = Window.partitionBy(*k)
    entered = F.min(F.when(F.col("times") > 1, F.col("pos"))).over(by)
    length = F.max("pos").over(by) + 1
    # The last node that is new leads to where the loop begins; a loop that the walk saw once ends at that length.
    out = visits.withColumns({"entered": entered, "length": length})
    return out.select(*k, "pos", "node", F.when(F.col("pos") >= F.col("entered"), F.col("length") - F.col("entered")).alias("period"))


def compared(runs_: DataFrame, observed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, a, b, equal, weakly, timed for each two inputs a < b of a graph, of which observers see the nodes in observed
    (keys, node). equal: they see the same nodes in the same order, again and again where they loop. weakly: or one run
    delays for ever, looping where nothing is seen, and what was seen of it begins the other. timed: no node that they see
    in both comes at another time, or in loops of other lengths."""
    k = list(keys)
    seen = runs_.join(observed.select(*k, "node").distinct(), [*k, "node"], "left_semi")
    order = F.row_number().over(Window.partitionBy(*k, "input").orderBy("pos")).cast("long")
    seen = written(seen.select(*k, "input", "node", "pos", "period", order.alias("at")))
    loops = runs_.groupBy(*k, "input").agg((F.count("period") > 0).alias("loops"))
    ends = written(loops.join(seen.groupBy(*k, "input").agg(F.count("*").alias("n"), (F.count("period") > 0).alias("shows")), [*k, "input"], "left").select(*k, "input", "loops", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("shows", F.lit(False)).alias("shows")))
    side = lambda df, x: df.select(*k, *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in k))
    pairs = side(ends, "a").join(side(ends, "b"), k).where("input_a < input_b")
    both = pairs.select(*k, "input_a", "input_b").join(side(seen, "a"), [*k, "input_a"])
    at = both.join(side(seen, "b").withColumnRenamed("at_b", "at_a"), [*k, "input_b", "at_a"]).groupBy(*k, "input_a", "input_b").agg(F.count(F.when((F.col("node_a") == F.col("node_b")) & (F.col("period_a").isNull() == F.col("period_b").isNull()), 1)).alias("alike"), F.count(F.when(F.col("node_a") == F.col("node_b"), 1)).alias("same"))
    off = (F.col("pos_a") != F.col("pos_b")) | F.coalesce(F.col("period_a") != F.col("period_b"), F.lit(False))
    when = both.join(side(seen, "b").withColumnRenamed("node_b", "node_a"), [*k, "input_b", "node_a"]).groupBy(*k, "input_a", "input_b").agg(F.count(F.when(off, 1)).alias("off"))
    out = pairs.join(at, [*k, "input_a", "input_b"], "left").join(when, [*k, "input_a", "input_b"], "left")
    num = lambda c: F.coalesce(c, F.lit(0))
    equal = (F.col("n_a") == F.col("n_b")) & (num("alike") == F.col("n_a"))
    # What a delaying run has shown is a prefix of the other's, which has no node twice before it repeats.
    begins = lambda x, y: F.col(f"loops_{x}") & ~F.col(f"shows_{x}") & (num("same") == F.col(f"n_{x}")) & (F.col(f"n_{x}") <= F.col(f"n_{y}"))
    return out.select(*k, F.col("input_a").alias("a"), F.col("input_b").alias("b"), equal.alias("equal"), (equal | begins("a", "b") | begins("b", "a")).alias("weakly"), (num("off") == 0).alias("timed"))
