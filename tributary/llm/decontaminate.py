"""Benchmark decontamination with training suffix arrays.

Each task turns bounded shards of the documents into a suffix array over words
and binary-searches every test suffix in it, word by word: the range of
suffixes that still agree narrows until it is empty, which gives the longest
verbatim match and where it lies; the range at the window's depth gives every
occurrence of the window.  Documents are whole within a shard, so nothing is
shuffled.  Suffixes whose first words (DEPTH of them, or as many as the
shortest item has) begin no test suffix are left out of the array before
sorting; they can't match that far.

Test words travel as a broadcast of at most BLOCK_BYTES of text; a larger
benchmark goes through in blocks, each pass adding its hits to the row.

Defined results: null or empty text has no words and no hits; null items and
items without words have no windows; repeated item ids count once; repeated
documents give one row each; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, text_pieces, trimmed, with_text
from .words import PUNCT, grams, hashes, split

WINDOW = 13
DEPTH = 4
BLOCK_BYTES = 8 << 20
#: A document is contaminated if at least 1 in SHARE of its words is hit.
SHARE = 20


class Tests:
    """The words of a block of test items, its suffixes, and the first words that begin them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        w = split(pa.array([t for _, t in items], pa.large_string()), PUNCT, lower=True)
        counts = w.counts()
        self.ids = [i for i, _ in items]
        self.symbols = hashes(w) | np.uint64(1)  # 0 stands for the end of a text
        self.item = w.owners()
        self.left = w.first[1:][self.item] - np.arange(len(w))  # words to the item's end
        self.need = np.minimum(window, counts)[self.item]  # length of the item's windows
        used = counts[counts > 0]
        self.depth = int(min(DEPTH, used.min())) if len(used) else 1
        g = grams(self.symbols, self.depth)
        self.begin = np.unique(g[self.left[: len(g)] >= self.depth])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.begin >> np.uint64(44)).astype(np.int64)] = True


def suffix_array(symbols: np.ndarray, ends: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The suffixes at the given positions in lexicographic order of their first `most` symbols; ties by position."""
    order = np.sort(at)
    group = np.zeros(len(order), np.int64)
    depth = 0
    live = np.arange(len(order))  # places in the order whose group isn't single yet
    while depth < most and len(live):
        pos = order[live] + depth
        here = np.where(pos < ends[order[live]], symbols[np.minimum(pos, len(symbols) - 1)], np.uint64(0))
        by = np.lexsort((order[live], here, group[live]))
        order[live], here, g = order[live][by], here[by], group[live][by]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (here[1:] != here[:-1])
        first = live[np.flatnonzero(new)][np.cumsum(new) - 1]  # a group is named after its first place
        group[live] = first
        single = new & np.append(new[1:], True)
        live = live[~single & (here != 0)]
        depth += 1
    return order


def search(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, tests: Tests):
    """For each test suffix its longest match, a place of it (-1: none), and the range of matches at the window's depth."""
    n = len(tests.symbols)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    longest, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n) if len(order) else np.zeros(0, np.int64)

    def bound(test, depth, right):
        want = tests.symbols[test + depth]
        a, b = lo[test].copy(), hi[test].copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            pos = order[np.minimum(mid, len(order) - 1)]
            there = np.where(pos + depth < ends[pos], symbols[np.minimum(pos + depth, len(symbols) - 1)], np.uint64(0))
            go = open_ & ((there <= want) if right else (there < want))
            a, b = np.where(go, mid + 1, a), np.where(open_ & ~go, mid, b)

    depth = 0
    while len(live):
        a, b = bound(live, depth, False), bound(live, depth, True)
        lo[live], hi[live] = a, b
        live = live[a < b]
        depth += 1
        longest[live] = depth
        place[live] = lo[live]
        full = live[tests.need[live] == depth]
        wlo[full], whi[full] = lo[full], hi[full]
        live = live[tests.left[live] > depth]
    return longest, place, wlo, whi


def shard_hits(texts: pa.Array, tests: Tests):
    """The words of the texts, and the suffix array and search results of the shard."""
    w = split(texts, PUNCT, lower=True)
    symbols = hashes(w) | np.uint64(1)
    ends = np.repeat(w.first[1:], w.counts())
    g = grams(symbols, tests.depth)
    at = np.flatnonzero(tests.filter[(g >> np.uint64(44)).astype(np.int64)])
    at = at[at + tests.depth <= ends[at]]
    if len(tests.begin):
        k = np.searchsorted(tests.begin, g[at])
        at = at[(k < len(tests.begin)) & (tests.begin[np.minimum(k, len(tests.begin) - 1)] == g[at])]
    order = suffix_array(symbols, ends, at, int(tests.left.max(initial=0)))
    return w, symbols, ends, order, search(symbols, ends, order, tests)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the index of each one's range."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def blocks_of(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded text, each collected for one broadcast when it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // most + 1
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r.item_id, r.text) for r in (items.where(of == i) if n > 1 else items).toLocalIterator()]


def passes(df: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, then, shape) -> DataFrame:
    """then on every piece of df once it has the hits (columns hit, items, item, item_word, doc_word, n_match) of all
    blocks. Only one block is on the driver and in a broadcast at a time: a pass that isn't the last is written."""
    sent = None
    rows = df.select("*", F.lit(None).cast("binary").alias("hit"), F.lit("[]").alias("items"), F.lit(None).cast("string").alias("item"), *(F.lit(None).cast("long").alias(c) for c in MATCH[1:]))
    for block in blocks_of(benchmark, block_bytes):
        if sent is not None:
            names = rows.columns
            rows = table(rows.mapInArrow(trimmed(hitting(sent, window, lambda piece, names=names: piece.select(names))), rows.schema), "hits")
            sent.unpersist()
        sent = df.sparkSession.sparkContext.broadcast(block)
    return rows.mapInArrow(trimmed(hitting(sent, window, then)), shape)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (array of ids) of every document, and its longest
    verbatim match with an item that is a window or more: item, item_word, doc_word (places of its first word), n_match
    (words); of equals the smallest item, then the first places. Null without a window."""
    counts = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, item string, item_word long, doc_word long, n_match long"
    return passes(with_text(docs).select("doc_id", "text"), benchmark, window, block_bytes, summarise, counts)


def hitting(sent, window: int, then):
    """A pass that adds the hits of a block of items, and what follows on each piece. Whole rows carry their text in row."""

    def run(batches):
        tests = Tests(sent.value, window)
        for batch in batches:
            if "text" not in batch.schema.names:
                batch = batch.append_column("text", pc.struct_field(batch.column("row"), "text"))
            for piece in text_pieces(batch):
                yield then(add_hits(piece, tests))

    return run


#: The columns of a document's longest match.
MATCH = ["item", "item_word", "doc_word", "n_match"]


def add_hits(piece: pa.RecordBatch, tests: Tests) -> pa.RecordBatch:
    w, symbols, ends, order, (_, _, lo, hi) = shard_hits(piece.column("text"), tests)
    live = np.flatnonzero(hi > lo)
    places, which = ranges(lo[live], hi[live])
    at, test = order[places], live[which]
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.need[test], -1)
    hit = np.cumsum(edge)[:-1] > 0
    owner = np.searchsorted(w.first, at, side="right") - 1
    found: dict[int, set[str]] = {}
    for d, i in set(zip(owner.tolist(), tests.item[test].tolist())):
        found.setdefault(d, set()).add(tests.ids[i])
    bits, items = [], []
    for d, (old, names) in enumerate(zip(piece.column("hit").to_pylist(), piece.column("items").to_pylist())):
        if d in found:
            own = hit[w.first[d] : w.first[d + 1]]
            if old is not None:
                own = own | np.unpackbits(np.frombuffer(old, np.uint8))[: len(own)].astype(bool)
            old, names = np.packbits(own).tobytes(), json.dumps(sorted({*json.loads(names), *found[d]}))
        bits.append(old)
        items.append(names)
    best = longest_of(w, symbols, ends, tests, at, test, owner)
    match = [best.get(d, old) if old[3] is None else min(best.get(d, old), old, key=lambda m: (-m[3], *m[:3])) for d, old in enumerate(zip(*(piece.column(c).to_pylist() for c in MATCH)))]
    own = {"hit": pa.array(bits, pa.binary()), "items": pa.array(items, pa.string())} | {c: pa.array([m[i] for m in match], pa.int64() if i else pa.string()) for i, c in enumerate(MATCH)}
    return pa.record_batch([own.get(c, piece.column(i)) for i, c in enumerate(piece.schema.names)], piece.schema.names)


def longest_of(w, symbols: np.ndarray, ends: np.ndarray, tests: Tests, at: np.ndarray, test: np.ndarray, owner: np.ndarray) -> dict[int, tuple[str, int, int, int]]:
    """The longest match of each document of those that begin at these places with these test suffixes."""
    begin = np.searchsorted(tests.item, tests.item)
    inner = (at > w.first[owner]) & (test > begin[test])
    inner[inner] = symbols[at[inner] - 1] == tests.symbols[test[inner] - 1]
    at, test, owner = at[~inner], test[~inner], owner[~inner]  # others go on from a longer one
    size = tests.need[test]
    live = np.arange(len(at))
    while len(live):
        live = live[(size[live] < tests.left[test[live]]) & (at[live] + size[live] < ends[at[live]])]
        live = live[symbols[at[live] + size[live]] == tests.symbols[test[live] + size[live]]]
        size[live] += 1
    out: dict[int, tuple[str, int, int, int]] = {}
    most = np.zeros(len(w.first), np.int64)
    np.maximum.at(most, owner, size)
    top = np.flatnonzero(size == most[owner])
    for d, t, a, n in zip(owner[top].tolist(), test[top].tolist(), at[top].tolist(), size[top].tolist()):
        match = (tests.ids[tests.item[t]], t - int(begin[t]), a - int(w.first[d]), n)
        out[d] = min(out.get(d, match), match)
    return out


def summarise(piece: pa.RecordBatch) -> pa.RecordBatch:
    n_words, n_hit, contaminated = verdict(piece)
    items = [sorted(json.loads(x)) for x in piece.column("items").to_pylist()]
    return pa.record_batch(
        [
            piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(contaminated), pa.array(items, pa.list_(pa.string())), *(piece.column(c) for c in MATCH),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *MATCH],
    )


def verdict(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_words = split(piece.column("text"), PUNCT, lower=True).counts()
    n_hit = np.array([0 if b is None else int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in piece.column("hit").to_pylist()], np.int64)
    return n_words, n_hit, (n_hit > 0) & (SHARE * n_hit >= n_words)


def matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of each test suffix in each shard, of `least` words or more:
    item_id, item_word, doc_id, doc_word, n_words (the first document of the shard that has it)."""
    spark, out = docs.sparkSession, None
    kind = docs.schema["doc_id"].dataType.simpleString()
    for block in blocks_of(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            tests = Tests(sent.value, least)
            begin = np.searchsorted(tests.item, tests.item)
            for batch in batches:
                for piece in text_pieces(batch):
                    w, _, _, order, (longest, place, _, _) = shard_hits(piece.column("text"), tests)
                    t = np.flatnonzero(longest >= np.maximum(least, tests.depth))
                    at = order[place[t]]
                    owner = np.searchsorted(w.first, at, side="right") - 1
                    yield pa.record_batch(
                        [pa.array([tests.ids[i] for i in tests.item[t].tolist()], pa.string()), pa.array(t - begin[t]), piece.column("doc_id").take(pa.array(owner)), pa.array(at - w.first[owner]), pa.array(longest[t])],
                        ["item_id", "item_word", "doc_id", "doc_word", "n_words"],
                    )

        found = with_text(docs).mapInArrow(trimmed(run), f"item_id string, item_word long, doc_id {kind}, doc_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with their columns. Each row is judged by its own text and filtered in
    the pass that judges it: nothing is shuffled, and rows that share an id or have none are told apart."""
    columns = docs.columns
    rows = small_batches(docs).select(F.struct(*(docs[c] for c in columns)).alias("row"))
    kept = passes(rows, benchmark, window, block_bytes, lambda piece: piece.select(["row"]).filter(pa.array(~verdict(piece)[2])), rows.schema)
    return kept.select(*(F.col("row")[c].alias(c) for c in columns))
