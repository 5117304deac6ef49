"""Automata as tables, many to a table: product and trimming.

initial and final (keys, state), transitions (keys, src, dst, kind, letter): kind is
all (reads any letter), only (reads its letter) or free (reads nothing).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import HOPS, least_fixpoint, written


@dataclass(frozen=True)
class Automata:
    initial: DataFrame
    final: DataFrame
    transitions: DataFrame
    keys: tuple[str, ...] = ("graph_id",)


def product(a: Automata, b: Automata) -> Automata:
    """For each key the automaton of the words that both accept; its states are pairs (structs a, b), those alone that its
    initial states lead to. b may have fewer keys, all of them a's: then it stands for each of a's."""
    k, kb = list(a.keys), list(b.keys)
    ta, tb = written(a.transitions.select(*k, "src", "dst", "kind", "letter")), written(b.transitions.select(*kb, F.col("src").alias("src_b"), F.col("dst").alias("dst_b"), F.col("kind").alias("kind_b"), F.col("letter").alias("letter_b")))
    both = lambda x, y: x.select(*k, F.col("state").alias("a")).join(y.select(*kb, F.col("state").alias("b")), kb, "inner") if kb else x.select(*k, F.col("state").alias("a")).join(F.broadcast(y.select(F.col("state").alias("b"))))

    def moves(at: DataFrame) -> DataFrame:
        """keys, a, b, to_a, to_b, kind, letter of the pairs (keys, a, b)."""
        left = at.join(ta.withColumnRenamed("src", "a"), [*k, "a"])
        right = at.join(tb.withColumnRenamed("src_b", "b"), [*kb, "b"])
        alone = left.where("kind = 'free'").select(*k, "a", "b", F.col("dst").alias("to_a"), F.col("b").alias("to_b"), F.lit("free").alias("kind"), F.lit(None).cast("string").alias("letter"))
        alone = alone.union(right.where("kind_b = 'free'").select(*k, "a", "b", F.col("a").alias("to_a"), F.col("dst_b").alias("to_b"), F.lit("free"), F.lit(None).cast("string")))
        reads = left.where("kind <> 'free'").join(tb.where("kind_b <> 'free'").withColumnRenamed("src_b", "b"), [*kb, "b"]).where("kind = 'all' or kind_b = 'all' or letter = letter_b")
        kind = F.when((F.col("kind") == "all") & (F.col("kind_b") == "all"), F.lit("all")).otherwise(F.lit("only"))
        reads = reads.select(*k, "a", "b", F.col("dst").alias("to_a"), F.col("dst_b").alias("to_b"), kind.alias("kind"), F.when(F.col("kind") == "only", F.col("letter")).otherwise(F.col("letter_b")).alias("letter"))
        return alone.union(reads)

    start = both(a.initial, b.initial).select(*k, "a", "b")
    states = least_fixpoint(start, lambda delta, _: moves(delta).select(*k, F.col("to_a").alias("a"), F.col("to_b").alias("b")), HOPS)
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    t = moves(states).select(*k, pair("a", "b").alias("src"), pair("to_a", "to_b").alias("dst"), "kind", "letter").distinct()
    ends = both(a.final, b.final).select(*k, "a", "b").join(states, [*k, "a", "b"], "left_semi")
    return Automata(start.select(*k, pair("a", "b").alias("state")), ends.select(*k, pair("a", "b").alias("state")), t, a.keys)


def trimmed(x: Automata) -> Automata:
    """Without states that no initial one leads to, or that lead to no final one. A key without a word has none left."""
    k = list(x.keys)
    t = written(x.transitions)

    def reached(seeds: DataFrame, from_: str, to: str) -> DataFrame:
        return least_fixpoint(seeds.select(*k, "state"), lambda delta, _: delta.withColumnRenamed("state", from_).join(t, [*k, from_]).select(*k, F.col(to).alias("state")), HOPS)

    use = written(reached(x.initial, "src", "dst").join(reached(x.final, "dst", "src"), [*k, "state"], "left_semi"))
    inside = t.join(use.withColumnRenamed("state", "src"), [*k, "src"], "left_semi").join(use.withColumnRenamed("state", "dst"), [*k, "dst"], "left_semi")
    return Automata(x.initial.join(use, [*k, "state"], "left_semi"), x.final.join(use, [*k, "state"], "left_semi"), inside.select(*k, "src", "dst", "kind", "letter"), x.keys)
