"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits, each
a 23-bit vector of the perfect binary Golay code with its top bits zero.  The
code assigns a vector to exactly one codeword.  A vector's keys are the
codewords assigned to it and to its one-bit neighbours: one key if its own
codeword is near, up to six otherwise.  If two vectors differ in at most one
bit, the codeword of either is among the keys of the other.

Pigeonhole: three errors over three segments are 1+1+1, or leave a segment
without errors and another with one at most.  So two kinds of join keys find
every pair: (segment i exact, codeword of segment j) for the six ordered i, j,
and the codewords of all three segments.  One side carries its own codewords,
the other its neighbours' keys; the all-three key has the neighbours of segment
1 on the first side and those of segments 2 and 3 on the second.

Only distinct fingerprints are joined.  A bucket first links each member to the
bucket's smallest and to its largest fingerprint; components made of these links
are merged, and only buckets that still hold several components compare members,
of different components alone.  So a group of copies costs its size, not its
square.

Defined results: null text is empty; texts without words have fingerprint zero
and link like any others; repeated rows keep one row each and share their
component; null ids take no part in naming a component (its name is null only if
all its ids are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, table, trimmed, with_text, without
from .words import SPACE, joined, split

SEED = 42
RADIUS = 3
WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
#: Fingerprints of a task that makes keys, some 70 for each.
TASK = 5000


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text: bits set in over half of the shingles' XXH64."""
    w = split(texts, SPACE)
    n = len(w.first) - 1
    out = np.zeros(n, np.uint64)
    if not len(w):
        return out
    data, begin, size = joined(w, lower=True)  # a shingle is a slice
    buf = memoryview(data)
    counts = w.counts()
    shingles = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    start = np.arange(total) - np.repeat(first, shingles) + np.repeat(w.first[:-1], shingles)
    last = np.minimum(start + shingle, np.repeat(w.first[1:], shingles)) - 1
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter((hash_(buf[a:b], SEED) for a, b in zip(begin[start].tolist(), (begin + size)[last].tolist())), np.uint64, total)
    has = np.flatnonzero(shingles)
    for lo in range(0, len(has), 4096):  # bounded: the bits of a long text are summed in parts
        part = has[lo : lo + 4096]
        a, b = int(first[part[0]]), int(first[part[-1]] + shingles[part[-1]])
        sums = np.zeros((len(part), 64), np.int64)
        for c in range(a, b, 1 << 16):
            d = min(b, c + (1 << 16))
            bits = np.unpackbits(h[c:d].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.searchsorted(first[part], np.arange(c, d), side="right") - 1
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sums[at[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        over = 2 * sums > shingles[part][:, None]
        out[part] = np.packbits(over, axis=1, bitorder="little").copy().view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([piece.column("doc_id"), pa.array(fingerprints_of(piece.column("text"), shingle).view(np.int64))], ["doc_id", "fp"])

    return map_text(with_text(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def syndromes(v: np.ndarray) -> np.ndarray:
    """What is left of 23-bit vectors modulo the generator of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= (v >> bit & 1) * np.int32(0b101011100011 << (bit - 11))
    return v


def error_patterns() -> np.ndarray:
    """The error that each syndrome tells, of three bits at most."""
    ones = [1 << i for i in range(23)]
    pairs = [a | b for i, a in enumerate(ones) for b in ones[:i]]
    triples = [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    patterns = np.array([0, *ones, *pairs, *triples], np.int32)
    error = np.zeros(1 << 11, np.int32)
    error[syndromes(patterns)] = patterns
    return error


#: Syndromes are linear: the upper 12 bits' and the errors are all that a worker keeps, which serves other stages, too.
UPPER, ERROR = syndromes(np.arange(1 << 12, dtype=np.int32) << 11), error_patterns()


def codewords(vectors: np.ndarray) -> np.ndarray:
    """The index of the codeword that each 23-bit vector is assigned to."""
    return ((vectors ^ ERROR[UPPER[vectors >> 11] ^ (vectors & 0x7FF)]) >> 11).astype(np.int16)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The codeword index of every 23-bit vector, and the error pattern of every syndrome."""
    return codewords(np.arange(1 << 23, dtype=np.int32)), ERROR


def segment_keys(vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own codeword of each vector; and the distinct codewords of it and its one-bit neighbours, with their vector's index."""
    near = codewords(np.concatenate([vectors[:, None], vectors[:, None] ^ (1 << np.arange(width))[None, :]], axis=1))
    own = near[:, 0].astype(np.int64)
    near = np.sort(near, axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(fresh)
    return own, row, near[row, col].astype(np.int64)


def join_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, key, side) of every bucket row. Sides: 0 carries own codewords, 1 the neighbours'."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    keys = [segment_keys(v, w) for v, w in zip(seg, WIDTHS)]
    every, out = np.arange(len(fp)), []

    def emit(index, kind, key, side):
        out.append((index, np.int64(kind) << 36 | key, np.full(len(index), side, np.int8)))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                own, row, near = keys[j]
                emit(every, kind, seg[i] << 12 | own, 0)
                emit(row, kind, seg[i][row] << 12 | near, 1)
                kind += 1
    (own1, row1, near1), (own2, row2, near2), (own3, row3, near3) = keys
    emit(row1, kind, near1 << 24 | own2[row1] << 12 | own3[row1], 0)
    # Neighbours of segments 2 and 3: all pairs of one fingerprint's few keys.
    n2, n3 = np.bincount(row2, minlength=len(fp)), np.bincount(row3, minlength=len(fp))
    first3 = np.cumsum(n3) - n3
    left = np.repeat(np.arange(len(row2)), n3[row2])
    right = np.arange(len(left)) - np.repeat(np.cumsum(n3[row2]) - n3[row2], n3[row2]) + first3[row2[left]]
    emit(row2[left], kind, own1[row2[left]] << 24 | near2[left] << 12 | near3[right], 1)
    return tuple(np.concatenate(x) for x in zip(*out))


def buckets(distinct: DataFrame) -> DataFrame:
    """key, side, fp of every distinct fingerprint."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                fp = batch.column("fp").slice(lo, 1024).to_numpy()
                index, key, side = join_keys(fp)
                yield pa.record_batch([pa.array(key), pa.array(side), pa.array(fp[index])], ["key", "side", "fp"])

    return distinct.select("fp").mapInArrow(trimmed(run), "key long, side byte, fp long")


def near(a: Column | str, b: Column | str, radius: int = RADIUS) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node, by hooking to the smallest neighbour and
    pointer jumping: rounds grow with the logarithm of the longest path. edges: a, b."""
    both = table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        # Smallest label among neighbours, then twice the label of the label.
        seen = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hooked = label.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        # The label of a label can't be larger: a root takes what its members have seen, too.
        root = hooked.groupBy(F.col("old").alias("root")).agg(F.min("comp").alias("least"))
        hooked = hooked.join(root, F.col("comp") == F.col("root"), "left").select("node", "old", F.least("comp", F.coalesce("least", "comp")).alias("comp"))
        hooked = table(hooked, "labels")
        jump = hooked.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        new = table(hooked.join(jump, hooked["comp"] == jump["at"], "left").select("node", "old", F.least("comp", F.coalesce("to", "comp")).alias("comp")), "labels")
        changed = new.where("comp <> old").limit(1).count()
        label = new.select("node", "comp")
        if not changed:
            break
    return nodes.join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, comp of every distinct fingerprint in the column fp; comp is the component's smallest fingerprint."""
    if radius > RADIUS:
        raise ValueError(f"the pigeonhole covers at most {RADIUS} differing bits")
    distinct = table(fps.select("fp").distinct(), "fingerprints")
    # Dealt once by key: both the buckets' ends and the join read this shuffle. A task makes the rows of TASK fingerprints.
    rows = buckets(distinct.repartition(distinct.count() // TASK + 1)).repartition("key")
    # Buckets with both sides and more than one fingerprint.
    ends = rows.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("side").alias("s0"), F.max("side").alias("s1")).where("lo < hi and s0 < s1").select("key", "lo", "hi")
    star = table(rows.join(ends, "key"), "stars")
    links = star.where((F.col("fp") != F.col("lo")) & near("fp", "lo", radius)).select(F.col("lo").alias("a"), F.col("fp").alias("b"))
    links = links.union(star.where((F.col("fp") != F.col("hi")) & near("fp", "hi", radius)).select(F.col("hi").alias("a"), F.col("fp").alias("b")))
    first = table(connected(distinct.select(F.col("fp").alias("node")), links), "comps")
    held = star.select("key", "side", "fp").join(first.select(F.col("node").alias("fp"), "comp"), "fp")
    mixed = held.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    held = table(held.join(mixed, "key"), "held")
    own = held.where("side = 0").select(F.col("key").alias("ka"), F.col("fp").alias("a"), F.col("comp").alias("ca"))
    other = held.where("side = 1").select(F.col("key").alias("kb"), F.col("fp").alias("b"), F.col("comp").alias("cb"))
    more = own.join(other, (F.col("ka") == F.col("kb")) & (F.col("ca") != F.col("cb")) & near("a", "b", radius)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = connected(first.select(F.col("comp").alias("node")).distinct(), more).select(F.col("node").alias("comp"), F.col("comp").alias("final"))
    return first.join(merged, "comp").select(F.col("node").alias("fp"), F.col("final").alias("comp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    fps = table(fingerprints(docs, shingle), "docfp")
    by_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = by_fp.join(components(by_fp, radius), "fp")
    least = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = table(comps.join(least, "comp").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The documents without the near-duplicates of one with a smaller id. Rows with a null id stay."""
    gone = near_duplicates(docs, shingle, radius).where("doc_id <> component_id").select(F.xxhash64("doc_id").alias("key"))
    return without(docs, gone, F.xxhash64(docs["doc_id"]))
