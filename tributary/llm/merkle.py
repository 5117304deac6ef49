"""A Merkle manifest of a dataset: a tree of leaf hashes for each source, one over the sources, a proof for each document.

Places of leaves come from a radix trie, without sorting the whole: documents are
counted by source and by the first digits of their key (the id, then the leaf's
hash, in hexadecimal); running sums over the at most 16 ** DIGITS siblings of a
digit give the first rank of each cell, and only cells over CELL documents are
counted again by their next digits.  A cell of at most CELL documents is ranked
within itself.  So a source with any share of the documents is cut by its ids.

The ranks' digits to the base of the fanout are the keys of the tree's nodes.
Nodes that share all but their last CHUNK digits become one row, in which CHUNK
levels are hashed and each node gets its siblings; rows shrink 3 ** CHUNK times a
round, until one node a source remains.  Siblings then travel down the same keys,
so each document meets one row of its prefix.

Defined results: a null in any column is hashed as `-`; null ids come first and
the null source is the first source; rows that repeat an id are ordered by the
leaf's hash, equal rows keep one leaf each, with proofs of their own; ids are
integers or strings (other kinds count as their strings); an empty table has no
rows.  Columns other than the five hashed ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of the tree that one row holds: 3 ** 6 nodes.
CHUNK = 6
#: Hexadecimal digits of a key that are counted at a time, and documents that may be ranked together.
DIGITS, CELL = 3, 1000
#: Equal rows are written out in runs of so many.
RUN = 1 << 16


def digest(*parts: Column) -> Column:
    """The lower-case hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` if null, else the length in UTF-8 bytes, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def sort_key(value: Column, kind: T.DataType) -> Column:
    """A string of hexadecimal digits in the order of the values, null first; none is a prefix of another."""
    if isinstance(kind, T.IntegralType):
        bits = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    else:
        bits = F.concat(F.hex(value.cast("string").cast("binary")), F.lit(" "))
    return F.coalesce(F.concat(F.lit("1"), bits), F.lit("0 "))


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def ranked(rows: DataFrame, cell: int = CELL, digits: int = DIGITS) -> DataFrame:
    """rows (g, key, n and more; a key once in a group g, n of its like) with rank, how many come before it in its
    group by key, and total, how many the group has."""
    ends = rows.agg(F.min("key"), F.max("key")).first()
    if ends[0] is None:
        return rows.withColumns({"rank": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    at, columns, done = common_prefix(*ends), rows.columns, []
    open_ = rows.withColumns({"base": F.lit(0).cast("long"), "total": F.lit(None).cast("long")})
    while True:
        siblings = Window.partitionBy("g", "parent")
        before = siblings.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        cells = open_.groupBy("g", F.substring("key", 1, at).alias("parent"), F.substring("key", at + 1, digits).alias("digit"))
        cells = cells.agg(F.sum("n").alias("sum"), F.count("*").alias("held"), F.min("base").alias("base"), F.min("total").alias("total"))
        cells = cells.select("g", F.concat("parent", "digit").alias("prefix"), "held", (F.col("base") + F.coalesce(F.sum("sum").over(before), F.lit(0))).alias("base"), F.coalesce("total", F.sum("sum").over(siblings)).alias("total"))
        at += digits
        marked = open_.select(*columns, F.substring("key", 1, at).alias("prefix")).join(cells, ["g", "prefix"])
        marked = table(marked, "cells")
        within = Window.partitionBy("g", "prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        small = marked.where(F.col("held") <= cell)
        done.append(small.select(*columns, (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("rank"), "total"))
        open_ = marked.where(F.col("held") > cell).select(*columns, "base", "total")
        if open_.isEmpty():
            return reduce(DataFrame.union, done)


def spread(rows: DataFrame) -> DataFrame:
    """A row for each of the n that a row stands for, each with its own rank."""
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    last = F.least(F.col("n"), (F.col("_run") + 1) * RUN) - 1
    return runs.withColumn("_i", F.explode(F.sequence(F.col("_run") * RUN, last))).withColumn("rank", F.col("rank") + F.col("_i")).drop("_run", "_i", "n")


def chunks(nodes: DataFrame, carried: Sequence[str], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """One round up the tree. nodes: g, idx (place among the group's nodes), h, count (of the group's nodes), and columns to carry.
    Gives the nodes with chunk and path (siblings left and right, level by level), and the chunks as nodes."""
    width = fanout**CHUNK
    held = F.sort_array(F.collect_list(F.struct((F.col("idx") % width).cast("int").alias("pos"), "h", *carried)))
    packed = nodes.groupBy("g", F.expr(f"idx div {width}").alias("chunk")).agg(held.alias("held"), F.first("count").alias("count"))
    steps = reduce(lambda a, b: a + b, [(F.col("count") > fanout**j).cast("int") for j in range(CHUNK)])
    packed = packed.withColumns({"steps": steps, "n0": F.expr("transform(held, x -> x.h)")})
    for j in range(CHUNK):  # more levels than the group has leave its root as it is
        up = f"transform(sequence(0, (size(n{j}) - 1) div {fanout}), i -> sha2(array_join(slice(n{j}, {fanout} * i + 1, {fanout}), ''), 256))"
        packed = packed.withColumn(f"n{j + 1}", F.expr(f"if(steps > {j}, {up}, n{j})"))
    own = [f"(x.pos div {fanout**j})" for j in range(CHUNK)]
    sides = [f"named_struct('left', array_join(slice(n{j}, cast({own[j]} - {own[j]} % {fanout} + 1 as int), cast({own[j]} % {fanout} as int)), ''), 'right', array_join(slice(n{j}, cast({own[j]} + 2 as int), cast({fanout - 1} - {own[j]} % {fanout} as int)), ''))" for j in range(CHUNK)]
    path = f"slice(array({', '.join(sides)}), 1, steps)"
    named = ", ".join(f"'{c}', x.{c}" for c in carried)
    members = F.expr(f"transform(held, x -> named_struct('idx', chunk * {width} + x.pos, {named + ', ' if named else ''}'path', {path}))")
    packed = packed.select("g", "chunk", "count", members.alias("members"), F.expr(f"n{CHUNK}[0]").alias("h"))
    packed = table(packed, "chunks")
    below = packed.select("g", "chunk", F.explode("members").alias("x")).select("g", "chunk", *(F.col("x")[c].alias(c) for c in ("idx", *carried, "path")))
    return below, packed.select("g", F.col("chunk").alias("idx"), "h", F.expr(f"(count + {width - 1}) div {width}").alias("count"))


def tree(nodes: DataFrame, carried: Sequence[str], above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """The carried columns of nodes (g, rank, h, total) with path, up to the group's root, and top, that root.
    above: called with the groups' roots (g, h), gives g, path and top to go on with."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    up, levels = nodes.select("g", F.col("rank").alias("idx"), "h", F.col("total").alias("count"), *carried), []
    while most > 1 or not levels:
        below, up = chunks(up, carried if not levels else (), fanout)
        levels.append(below)
        most = -(-most // fanout**CHUNK)
    roots = up.select("g", "h")
    full = above(roots) if above else roots.select("g", F.expr("array()").cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("top"))
    more = [c for c in full.columns if c not in ("g", "path")]
    full = full.withColumn("idx", F.lit(0).cast("long"))
    for below in reversed(levels):
        up_ = full.select("g", F.col("idx").alias("chunk"), F.col("path").alias("rest"), *more)
        full = below.join(up_, ["g", "chunk"]).withColumn("path", F.concat("path", "rest")).drop("chunk", "rest")
    return full.drop("idx")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, x: digest(x["left"], h, x["right"]))


def siblings(path: Column) -> Column:
    """The digest of a proof: all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def manifest(docs: DataFrame, **claims: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every document: folded(leaf, path) is root. claims: further columns that are
    functions of the five fields, to be carried along."""
    values = {c: docs[c] for c in FIELDS}
    group = F.coalesce(F.concat(F.lit("1"), values["source"].cast("string")), F.lit(""))
    hashed = docs.select(values["doc_id"].alias("doc_id"), group.alias("g"), leaf(**values).alias("h"), *(v.alias(f"claim_{k}") for k, v in claims.items()))
    key = F.concat(sort_key(F.col("doc_id"), docs.schema["doc_id"].dataType), "h")
    carried = ["doc_id", "leaf", *(f"claim_{k}" for k in claims)]
    rows = hashed.groupBy("g", key.alias("key")).agg(F.count("*").cast("long").alias("n"), F.first("h").alias("h"), F.first("h").alias("leaf"), *(F.first(c).alias(c) for c in carried if c != "leaf"))
    leaves = spread(ranked(table(rows, "leaves")))

    def above(roots: DataFrame) -> DataFrame:
        """The tree over the sources."""
        roots = table(roots, "subroots")
        of = roots.select(F.lit("").alias("g"), F.concat(F.hex(F.col("g").cast("binary")), F.lit(" ")).alias("key"), F.lit(1).cast("long").alias("n"), "h", F.col("g").alias("source"), F.col("h").alias("subroot"))
        return tree(spread(ranked(of)), ["source", "subroot"]).select(F.col("source").alias("g"), "path", "subroot", F.col("top").alias("root"))

    out = tree(leaves, carried, above)
    return out.select("doc_id", "leaf", "subroot", "root", "path", *(F.col(f"claim_{k}").alias(k) for k in claims))


def verify_without_lines(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every proof, tried on the document as it is or,
    where the CRC-32 of the id is even, on a copy that has lost its line ends."""
    d = {c: docs[c] for c in FIELDS}
    even = F.crc32(d["doc_id"].cast("string").cast("binary")) % 2 == 0
    cut = F.when(F.coalesce(even, F.lit(False)), F.replace(d["text"], F.lit("\n"), F.lit(""))).otherwise(d["text"])
    out = manifest(docs, claim=leaf(**{**d, "text": cut})).withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
