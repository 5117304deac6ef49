"""Similar documents by the Jaccard similarity of their sets of shingles, found with signature trees.

Documents with equal sets are one: only the row with the smallest key of each set
goes on.  Under one order of all shingles two sets that are similar enough share one
of the first n - ceil(similarity * n) + 1 of each, so the documents are dealt to
buckets by these; the order puts shingles that are common in a sample last (any
order is right, this one keeps buckets small).  Keys that one document has are
dropped in the pass that first brings keys together.

Groups of copies mustn't cost the square of their size.  So each document is first
compared with one hub: the smallest member of most of its buckets; then, while that
links anything, with the smallest member of another component in its buckets.  What
may be similar after that lies in different components of a bucket.  There the
members, in the order of their sizes, are leaves of a signature tree: every node
holds the bits of its members' shingles, OR-combined, the range of their sizes, and
the range of their components.  Pairs of nodes are visited from the roots down; one
is left out with all below it if its sizes are too far apart, if one component holds
both, or if the bits that both have can't hold an overlap that is large enough.
Pairs of leaves that are left are settled by both whole texts.  A crowded bucket is cut by
sizes, then into blocks, and each two blocks make one tree.

Defined results: null text is empty and similar to nothing; rows that repeat an id
and text are one document; rows that repeat an id alone are documents of their own,
but keep_one drops and keeps by id; null ids are left out by keep_one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, row_key, sieve, small_batches, table, text_pieces, trimmed, without
from .simhash import connected, near_duplicates
from .words import LOWER, SPACE, grams, hashes, mix, split, starts_of_runs

SHINGLE = 5
SIMILARITY = 0.8
#: The order of shingles knows at most COMMON of them, from some SAMPLE documents.
SAMPLE, COMMON = 20_000, 1 << 20
#: Members of a bucket that meet in one tree, if the bucket holds more than one tree's members.
BLOCK = 500
#: Bounds of floating point are loosened by so much.
EPS = 1e-6
#: Children of a node; pairs of nodes that are looked at together; rows whose trees stand in memory together.
FANOUT, AT_ONCE, FOREST = 8, 4_000, 10_000
#: Bits of a leaf of a tree at most; all bits are compared after it.
LEAF_BITS = 1024
#: Words of bits that are compared together.
WIDE = 1 << 20


def lowered(texts: pa.Array):
    w = split(texts, SPACE)
    w.data = LOWER[w.data]
    return w, hashes(w)


def shingles(w, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words and the text of each; a shorter text is one run."""
    ok = np.flatnonzero(starts_of_runs(w, size))
    owner = np.searchsorted(w.first, ok, side="right") - 1
    value = grams(h, size)[ok] if len(ok) else np.zeros(0, np.uint64)
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < size))
    each = np.array([np.bitwise_xor.reduce(grams(h[w.first[d] : w.first[d + 1]], int(w.counts()[d]))) for d in short.tolist()], np.uint64)
    return np.r_[value, each], np.r_[owner, short]


def shingle_sets(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in the order of their hashes, and the text of each."""
    value, owner = shingles(*lowered(texts), size)
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[fresh], o[fresh]


#: Bytes of an Arrow batch: pairs of long texts, a thousand to a batch, would fill a task's memory. Set for the session.
BATCH_BYTES = "4194304"
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def keyed(docs: DataFrame) -> DataFrame:
    """id (a key of doc_id and text), doc_id, text of each row, and nothing else."""
    docs.sparkSession.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
    return small_batches(docs.select(row_key(docs["doc_id"], docs["text"]).alias("id"), docs["doc_id"], docs["text"]))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and in how many. It only orders shingles."""
    every = docs.count() // SAMPLE + 1

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        value, n = np.unique(shingle_sets(piece.column("text"), size)[0], return_counts=True)
        return pa.record_batch([pa.array(value.view(np.int64)), pa.array(n)], ["key", "n"])

    sample = docs.where(F.pmod("id", F.lit(every)) == 0)
    found = map_text(sample, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def signatures(docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """id, doc_id, n (shingles), set (a hash of them), keys (the prefix of them, in order), rare (how many of these the
    order doesn't know), bits (a power of two, four times n or more, those of shingles set),
    leaf (the same, folded to LEAF_BITS at most) of every document (keyed)."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        common, times = sent.value
        value, owner = shingle_sets(piece.column("text"), size)
        n = np.bincount(owner, minlength=piece.num_rows).astype(np.int64)
        first = np.cumsum(n) - n
        rank = np.zeros(len(value), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, value), len(common) - 1)
            rank = np.where(common[at] == value, times[at], 0)
        order = np.argsort(owner << 32 | rank, kind="stable")
        most = n - np.ceil(similarity * n - EPS).astype(np.int64) + 1
        keep = np.arange(len(value)) - first[owner] < most[owner]
        known = np.bincount(owner[keep & (rank[order] == 0)], minlength=len(n))
        width = np.full(len(n), 64, np.int64)
        while (small := width < 4 * n).any():
            width[small] *= 2
        whole = np.zeros(len(n), np.uint64)
        np.add.at(whole, owner, mix(value, value >> np.uint64(32)))  # of equal sets alike
        ends = lambda counts: pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        keys = pa.ListArray.from_arrays(ends(np.bincount(owner[keep], minlength=len(n))), pa.array(value[order][keep].view(np.int64)))

        def packed(width: np.ndarray) -> pa.Array:
            start = np.cumsum(width) - width
            bits = np.zeros(width.sum(), bool)
            bits[start[owner] + (value & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
            return pa.Array.from_buffers(pa.binary(), len(n), [None, ends(width // 8).buffers()[1], pa.py_buffer(np.packbits(bits, bitorder="little").tobytes())])

        return pa.record_batch([piece.column("id"), piece.column("doc_id"), pa.array(n), pa.array(mix(whole, n.astype(np.uint64)).view(np.int64)), keys, pa.array(known), packed(width), packed(np.minimum(width, LEAF_BITS))], ["id", "doc_id", "n", "set", "keys", "rare", "bits", "leaf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table(map_text(docs, run, f"id long, doc_id {kind}, n long, set long, keys array<long>, rare long, bits binary, leaf binary"), "signatures")


def folded(words: np.ndarray, first: np.ndarray, have: int, want: int) -> np.ndarray:
    """A row of `want` words for each bit set that begins at first, `have` words long, its parts OR-combined."""
    rows = words[first[:, None] + np.arange(have)]
    return rows if have == want else np.bitwise_or.reduce(rows.reshape(len(rows), -1, want), axis=1)


class Bits:
    """Bit sets of several widths, one after another."""

    def __init__(self, words: np.ndarray, width: np.ndarray, n: np.ndarray):
        """width in words; n: shingles of each."""
        self.words, self.width, self.first = words, width, np.cumsum(width) - width
        ones = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
        self.ones = ones[self.first + width] - ones[self.first]
        self.extra = n - self.ones  # shingles that share their bit with another

    @classmethod
    def of(cls, column: pa.Array, n: np.ndarray) -> Bits:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return cls(np.frombuffer(b"".join(column.to_pylist()), np.uint64), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8, n)

    def classes(self, other: Bits, a: np.ndarray, b: np.ndarray):
        """Parts of the pairs a of self, b of other that have the same widths, not too many together: places, and both as rows of equal width."""
        kind = self.width[a] << 32 | other.width[b]
        order = np.argsort(kind, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
            wa, wb = int(self.width[a[part[0]]]), int(other.width[b[part[0]]])
            for lo in range(0, len(part), step := max(1, WIDE // max(wa, wb))):
                at, w = part[lo : lo + step], min(wa, wb)
                yield at, folded(self.words, self.first[a[at]], wa, w), folded(other.words, other.first[b[at]], wb, w)

    def overlap(self, other: Bits, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most shingles that both can have: bits that both have, and those that may share a bit with another."""
        out = np.where(self.width[a] < other.width[b], self.extra[a], np.where(self.width[a] > other.width[b], other.extra[b], np.minimum(self.extra[a], other.extra[b])))
        for at, x, y in self.classes(other, a, b):
            out[at] += np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
        return out

    def within(self, other: Bits, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
        """Whether single sets can be similar enough: a bit that the other hasn't is a shingle that it hasn't."""
        shared = np.empty(len(a), np.int64)
        for at, x, y in self.classes(other, a, b):
            shared[at] = np.minimum(na[at] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), nb[at] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        return shared * (1 + similarity) + EPS >= similarity * (na + nb)


def within_bits(x: bytes, y: bytes, nx: int, ny: int, similarity: float) -> bool:
    """The same for one pair."""
    one = np.zeros(1, np.int64)
    a, b = (Bits(np.frombuffer(v, np.uint64), np.array([len(v) // 8]), np.array([n])) for v, n in ((x, nx), (y, ny)))
    return bool(a.within(b, one, one, np.array([nx]), np.array([ny]), similarity)[0])


class Nodes:
    """A level of a forest: bits, and ranges of sizes, components and places of what stands below; children first … last - 1."""

    def __init__(self, bits: Bits, group: np.ndarray, ranges: dict[str, tuple[np.ndarray, np.ndarray]], first: np.ndarray, last: np.ndarray):
        self.bits, self.group, self.ranges, self.first, self.last = bits, group, ranges, first, last

    def above(self) -> Nodes:
        """The next level: runs of FANOUT nodes of a group. The nodes are in the order of group and size."""
        here = np.arange(len(self.group))
        start = np.flatnonzero(np.r_[True, np.diff(self.group) != 0])
        place = here - np.repeat(start, np.diff(np.r_[start, len(here)]))
        first = np.flatnonzero(place % FANOUT == 0)
        last = np.r_[first[1:], len(here)]
        run = np.repeat(np.arange(len(first)), last - first)
        ranges = {k: (np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)) for k, (lo, hi) in self.ranges.items()}
        width = np.minimum.reduceat(self.bits.width, first)
        begin = np.cumsum(width) - width
        words = np.zeros(int(width.sum()), np.uint64)
        extra = np.zeros(len(first), np.int64)
        kind = width[run] << 32 | self.bits.width
        for k in np.unique(kind).tolist():
            want, have = k >> 32, k & 0xFFFFFFFF
            at = np.flatnonzero(kind == k)
            for lo in range(0, len(at), step := max(1, WIDE // have)):
                part = at[lo : lo + step]
                rows = folded(self.bits.words, self.bits.first[part], have, want)
                cut = np.flatnonzero(np.r_[True, np.diff(run[part]) != 0])
                to = begin[run[part[cut]]][:, None] + np.arange(want)
                words[to] |= np.bitwise_or.reduceat(rows, cut, axis=0)
                lost = self.bits.ones[part] - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
                np.maximum.at(extra, run[part], self.bits.extra[part] + lost)
        bits = Bits(words, width, np.zeros(len(first), np.int64))
        bits.extra = extra
        return Nodes(bits, self.group[first], ranges, first, last)


def children(a: np.ndarray, b: np.ndarray, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b, each pair once."""
    na, nb = nodes.last[a] - nodes.first[a], nodes.last[b] - nodes.first[b]
    of = np.repeat(np.arange(len(a)), na * nb)
    k = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    x, y = nodes.first[a[of]] + k // nb[of], nodes.first[b[of]] + k % nb[of]
    once = (a[of] != b[of]) | (x <= y)
    return x[once], y[once]


def similar_in(group, n, place, comp, upper, block, mixed, bits: Bits, similarity: float):
    """Pairs of rows of a group that may be similar and aren't in one component. Rows are in the order of group and n.
    place: of the group's key in the row's prefix. Of two rows one at least isn't upper; if the group is mixed, their blocks differ."""
    every = {k: (v, v) for k, v in (("n", n), ("comp", comp), ("block", block), ("upper", upper))}
    levels = [Nodes(bits, group, every, np.arange(len(n)), np.arange(len(n)))]
    while len(levels[-1].group) > len(np.unique(levels[-1].group)):
        levels.append(levels[-1].above())
    crossed = mixed[np.searchsorted(group, np.arange(group.max(initial=-1) + 1))] if len(group) else mixed
    roots = np.arange(len(levels[-1].group))
    stack = [(len(levels) - 1, roots[k : k + AT_ONCE], roots[k : k + AT_ONCE]) for k in range(0, len(roots), AT_ONCE)]
    while stack:
        k, a, b = stack.pop()
        level = levels[k]
        (n0, n1), (c0, c1), (b0, b1), (u0, _) = (level.ranges[x] for x in ("n", "comp", "block", "upper"))
        live = (n1[a] + EPS >= similarity * n0[b]) & (np.maximum(c1[a], c1[b]) > np.minimum(c0[a], c0[b])) & ~((u0[a] == 1) & (u0[b] == 1))
        live &= ~(crossed[level.group[a]] & (np.maximum(b1[a], b1[b]) == np.minimum(b0[a], b0[b])))
        a, b = a[live], b[live]
        if k:
            need = similarity * (n0[a] + n0[b])
            live = (a == b) | (level.bits.overlap(level.bits, a, b) * (1 + similarity) + EPS >= need)
            a, b = children(a[live], b[live], level)
            stack += [(k - 1, a[i : i + AT_ONCE], b[i : i + AT_ONCE]) for i in range(0, len(a), AT_ONCE)]
        else:  # of the first shingle that both have, so many can still follow
            live = (a != b) & (np.minimum(n[a] - place[a], n[b] - place[b]) * (1 + similarity) + EPS >= similarity * (n[a] + n[b]))
            a, b = a[live], b[live]
            live = bits.within(bits, a, b, n[a], n[b], similarity)
            yield a[live], b[live]


def whole_groups(batches, key: str, rows: int):
    """Sorted batches put together, so that each key is in one of them: a table of `rows` rows or more, or the last."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if cut:
            yield t.slice(0, cut)
        held, count = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def shared_keys(known: DataFrame) -> DataFrame:
    """key, id, n, at (the first place in the prefix), lo (the smallest id of the key), weight, of keys that several
    documents have. Keys that the same documents have are one, of their weight: passages make runs of them."""
    key = F.posexplode("keys").alias("at", "key")
    each = known.select("id", "n", "rare", key).select("key", "id", F.col("n").cast("int").alias("n"), "at", (F.col("at") < F.col("rare")).alias("rare"))

    def run(batches):
        for t in whole_groups(batches, "key", 1):
            k, id_ = t.column("key").to_numpy(), t.column("id").to_numpy()
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, len(k)])
            keep = np.repeat(size > 1, size)
            members = mix(np.bitwise_xor.reduceat(mix(id_.view(np.uint64), id_.view(np.uint64)), first), size.astype(np.uint64)).view(np.int64)
            out = pa.table({"key": np.repeat(members, size), "id": id_, "n": t.column("n"), "at": t.column("at"), "lo": np.repeat(id_[first], size)})
            yield from out.filter(pa.array(keep)).to_batches()

    # The sample has seen no rare key three times, so none is hot; common ones are counted before they meet.
    rare = each.where("rare").drop("rare").repartition("key").sortWithinPartitions("key", "id").mapInArrow(trimmed(run), "key long, id long, n int, at int, lo long")
    common = each.where("not rare").drop("rare")
    ends = common.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.xxhash64(F.bit_xor(F.xxhash64("id")), F.count("*")).alias("members")).where("lo < hi").select("key", "lo", "members")
    common = common.join(ends, "key").select(F.col("members").alias("key"), "id", "n", "at", "lo")
    return table(rare.union(common).groupBy("key", "id").agg(F.first("n").alias("n"), F.min("at").alias("at"), F.first("lo").alias("lo"), F.count("*").alias("weight")), "shared")


def those(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df that may be in ids, both by their column id: a filter of fixed size keeps others out of shuffles."""
    return sieve(df, ids, "id")[0]


def bounded(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that set sizes and bits don't rule out."""
    pairs = table(pairs, "pairs")
    known = those(known.select("id", "n", "bits"), pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    side = lambda id_, n, bits: known.select(F.col("id").alias(id_), F.col("n").alias(n), F.col("bits").alias(bits))
    both = pairs.join(side("b", "nb", "y"), "b").join(side("a", "na", "x"), "a").where(F.least("na", "nb") + EPS >= similarity * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            every = np.arange(len(na))
            keep = Bits.of(batch.column("x"), na).within(Bits.of(batch.column("y"), nb), every, every, na, nb, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y", "na", "nb").mapInArrow(trimmed(run), "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """a, b, similarity: the pairs whose sets of shingles (A-Z in lower case) are similar enough, by their texts."""
    pairs, docs = table(pairs, "pairs"), docs.where("text is not null").select("id", "text")
    text = lambda id_, name: those(docs, pairs.select(F.col(id_).alias("id"))).select(F.col("id").alias(id_), F.col("text").alias(name))
    both = pairs.join(text("b", "y"), "b").join(text("a", "x"), "a")

    def verify(batches):
        for batch in batches:
            for piece in text_pieces(batch, "x"):
                sets = []
                for c in ("x", "y"):
                    value, owner = shingle_sets(piece.column(c), size)
                    sets.append(np.split(value, np.searchsorted(owner, np.arange(1, piece.num_rows))))
                out = []
                for x, y in zip(*sets):
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    out.append((n, len(x) + len(y) - n))
                n, all_ = np.array(out, np.int64).reshape(-1, 2).T
                keep = (n > 0) & (n + EPS >= similarity * all_)
                yield pa.record_batch([piece.column("a"), piece.column("b"), pa.array(n / np.maximum(all_, 1))], ["a", "b", "similarity"]).filter(pa.array(keep))

    return table(both.select("a", "b", "x", "y").mapInArrow(trimmed(verify), "a long, b long, similarity double").distinct(), "verified")


def labelled(links: DataFrame) -> DataFrame:
    """id, comp of the documents that links (a, b) connect."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return table(connected(nodes, links).select(F.col("node").alias("id"), "comp"), "comps")


def with_components(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """shared with comp, those keys alone that hold several components."""
    held = shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    return table(held.join(mixed, "key").select(*shared.columns, "comp"), "mixed")


def most_shared(pairs: DataFrame) -> DataFrame:
    """For each b the a with which it shares most keys, by their weight."""
    counted = pairs.where("a <> b").groupBy("b", "a").agg(F.sum("weight").alias("k"))
    return counted.groupBy("b").agg(F.max(F.struct("k", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def across(mixed: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """a, b: documents of different components that meet in a tree and may be similar."""
    size = mixed.groupBy("key").agg(F.count("*").alias("members"))
    rows = mixed.join(size, "key").withColumns({"cut": F.col("members") > BLOCK, "kind": F.floor(F.log("n") / max(math.log(1 / similarity) * (1 + EPS), EPS)).cast("int")})
    # A crowded bucket has trees by size, each with the sizes next above.
    kinds = F.when(F.col("cut"), F.array(F.struct(F.col("kind").alias("at_kind"), F.lit(0).alias("upper")), F.struct((F.col("kind") - 1).alias("at_kind"), F.lit(1).alias("upper")))).otherwise(F.array(F.struct(F.lit(-9).alias("at_kind"), F.lit(0).alias("upper"))))
    rows = table(rows.select("key", "id", "n", "at", "comp", F.explode(kinds).alias("_k")).select("key", "id", "n", "at", "comp", "_k.*"), "trees")
    live = rows.groupBy("key", "at_kind").agg(F.count("*").alias("members"), F.min("upper").alias("u0"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("u0 = 0 and c0 < c1")
    rows = rows.join(live.select("key", "at_kind", F.floor((F.col("members") - 1) / BLOCK + 1).cast("int").alias("blocks")), ["key", "at_kind"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("key", "at_kind", F.least("block", "other"), F.greatest("block", "other")).alias("tree"), (F.col("block") != F.col("other")).alias("odd"), "id", "n", "at", "comp", "upper", "block", "blocks")
    # Of blocks i and j a tree has the rows of both; its own rows alone if they are one.
    mixed_ = rows.join(known.select("id", "leaf"), "id").repartition("tree").sortWithinPartitions("tree", "n")

    def run(batches):
        for t in whole_groups((b for b in batches if b.num_rows), "tree", FOREST):
            col = lambda c: t.column(c).to_numpy().astype(np.int64)
            group = np.unique(col("tree"), return_inverse=True)[1]
            id_, n = col("id"), col("n")
            for a, b in similar_in(group, n, col("at"), col("comp"), col("upper"), col("block"), col("odd").astype(bool), Bits.of(t.column("leaf"), n), similarity):
                yield pa.record_batch([pa.array(np.minimum(id_[a], id_[b])), pa.array(np.maximum(id_[a], id_[b]))], ["a", "b"])

    return mixed_.mapInArrow(trimmed(run), "a long, b long").distinct()


#: Rounds of hubs at most; trees settle what is left.
HUBS = 1


def links(docs: DataFrame, known: DataFrame, similarity: float, size: int) -> DataFrame:
    """a, b, similarity: pairs of ids that connect all documents (keyed, with their signatures) that are similar."""
    some = known.where("n > 0")
    sets = table(some.groupBy("set").agg(F.min("id").alias("lo"), F.count("*").alias("rows")).where("rows > 1"), "sets")
    same = table(some.join(sets, "set").where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")).distinct(), "same")
    maybe, rest = sieve(some, sets, "set")
    known = table(rest.unionByName(maybe.join(same.select(F.col("b").alias("id")), "id", "left_anti").dropDuplicates(["id"])), "representatives")
    shared = shared_keys(known)
    tried = table(most_shared(shared.select(F.col("lo").alias("a"), F.col("id").alias("b"), "weight")), "tried")
    found = verified(docs, bounded(tried, known, similarity), similarity, size)
    for _ in range(HUBS):
        mixed = with_components(shared, labelled(found))
        least = mixed.groupBy("key", "comp").agg(F.min("id").alias("id"))
        one = least.groupBy("key").agg(F.min(F.struct("id", "comp")).alias("one"))
        two = least.join(one, "key").where("comp <> one.comp").groupBy("key").agg(F.first("one").alias("one"), F.min(F.struct("id", "comp")).alias("two"))
        hub = F.when(F.col("comp") == F.col("one.comp"), F.col("two.id")).otherwise(F.col("one.id"))
        new = mixed.join(two, "key").select(hub.alias("a"), F.col("id").alias("b"), "weight").join(tried, ["a", "b"], "left_anti")
        new = table(most_shared(new), "tried")
        more = verified(docs, bounded(new, known, similarity), similarity, size)
        tried = tried.union(new)
        if more.isEmpty():
            break
        found = table(found.union(more), "links")
    mixed = with_components(shared, labelled(found))
    rest = across(mixed, known, similarity).join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")
    return same.union(found).union(verified(docs, bounded(rest, known, similarity), similarity, size))


def similar_pairs(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """a, b (ids of documents), similarity: similar documents, enough of them to connect all that are similar."""
    rows = keyed(docs).where("doc_id is not null")
    known = signatures(rows, similarity, size)
    name = lambda c: known.select(F.col("id").alias(c), F.col("doc_id").alias(f"doc_{c}")).distinct()
    return links(rows, known, similarity, size).join(name("a"), "a").join(name("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "similarity")


def components(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by similar documents) of every row."""
    rows = keyed(docs)
    known = signatures(rows, similarity, size)
    comps = labelled(links(rows, known, similarity, size))
    named = table(known.select("id", "doc_id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "named")
    several = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(several, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the near-duplicates of one with a smaller id, by fingerprints and by shingles. Rows with a null id stay."""
    close = near_duplicates(docs).where("doc_id is not null").select("doc_id", "component_id").union(components(docs.where(docs["doc_id"].isNotNull()), similarity).select("doc_id", "component_id"))
    pairs = table(close.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "links")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    gone = connected(nodes, pairs).where("node <> comp").select(F.xxhash64("node").alias("key"))
    return without(docs, gone, F.xxhash64(docs["doc_id"]))
