"""Removal of repeated passages with suffix automata of reference shards.

A window of N words is repeated if the same words start earlier.  Each window
is named by its anchor, the run of ANCHOR words in it with the smallest hash:
equal windows have equal anchors, so the windows of one anchor are a shard of
the corpus that can be judged alone, and consecutive windows of a document
mostly share their anchor.

1. Anchors are counted; those found twice or more are kept in a bit filter of
   fixed size, which is all that is broadcast.  A false positive costs work
   only.
2. Each task turns the windows of repeated anchors into passages and settles
   those that it has met before, so a passage in a third of all documents
   leaves a task once.  Anchors found HOT times or more, by a second filter, are
   split further: each of their windows is its own shard.
3. The passages of a shard meet in order of (doc_id, start).  Each streams
   through the suffix automaton of those before it; where the matching statistic
   reaches N, the window is repeated.  Passages with something new extend the
   automaton.
4. Repeated windows go back to their documents, and the words they cover go.

Broadcasting automata of all shards to all tasks would send every distinct
repeated passage everywhere, which grows with the corpus; here passages travel
to the shard's automaton instead, and only fixed-size filters are broadcast.

Defined results: null text has no words and stays as an empty text; fewer than N
words lose nothing; a null doc_id comes after all others; rows with the same
doc_id and text are the same document and lose the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, small_batches, table, text_pieces, trimmed
from .words import SPACE, Words, grams, hashes, joined, mix, split, starts_of_runs

N = 20
ANCHOR = 5
FILTER_BITS = 27
HOT = 1000
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """All runs of words of the passages added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def statistics(self, words: list) -> Iterator[int]:
        """For each word, the length of the longest run ending with it that the automaton has."""
        state = size = 0
        next_, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in next_[state]:
                state = link[state]
                size = length[state]
            if word in next_[state]:
                state = next_[state][word]
                size += 1
            yield size

    def add(self, words: list) -> None:
        next_, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            if word in next_[last]:
                q = next_[last][word]
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                continue
            new = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in next_[p]:
                next_[p][word] = new
                p = link[p]
            if p >= 0:
                q = next_[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = new

    def _clone(self, p: int, q: int, word) -> int:
        copy = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy


def anchors(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash of the anchor, first window, number of windows; and the words' hashes."""
    k = min(ANCHOR, n)
    h = hashes(w)
    ok = starts_of_runs(w, n)
    if not ok.any():
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, h
    best = grams(h, k)
    at = np.arange(len(best))
    width, span = n - k + 1, 1
    while span < width:  # smallest of span runs, then of twice as many; the leftmost of equals
        step = min(span, width - span)
        take = best[step:] < best[:-step]
        best = np.where(take, best[step:], best[:-step])
        at = np.where(take, at[step:], at[:-step])
        span += step
    start = np.flatnonzero(ok)
    p = at[start]
    # Runs of a document have neighbouring starts; an anchor's place can't lie in two documents' windows.
    new = np.r_[True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    return best[start[first]], start[first], np.diff(np.r_[first, len(start)]), h


def in_filter(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (filter_[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1


def filter_of(counts: DataFrame, least: int) -> np.ndarray:
    """A bit for the top bits of each hash found so often; of fixed size."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rows = counts.where(F.col("n") >= least).groupBy(F.shiftright(bit, 6).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def anchor_counts(docs: DataFrame, n: int) -> DataFrame:
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        h, count = np.unique(anchors(split(piece.column("text"), SPACE), n)[0], return_counts=True)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "n"])

    return map_text(docs.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


PASSAGES = "shard long, id long, mark long, start int, n int, words binary"


def passages(docs: DataFrame, n: int, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Passages with repeated anchors, once a task each; without a shard and words: windows that the task has settled."""
    sent = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches):
        seen: dict[bytes, tuple[int, int, int]] = {}  # of each passage, the earliest place met
        for batch in batches:
            for piece in text_pieces(batch):
                yield from work(piece, seen)

    def work(piece, seen):
        repeated, hot = sent.value
        w = split(piece.column("text"), SPACE)
        h, start, count, word = anchors(w, n)
        live = in_filter(repeated, h)
        h, start, count = h[live], start[live], count[live]
        if not len(h):
            return
        single = in_filter(hot, h)
        if single.any():  # each window of a hot anchor is a shard of its own
            g = grams(word, n)
            many = count[single]
            each = np.repeat(start[single] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            h = np.r_[h[~single], mix(np.repeat(h[single], many), g[each])]
            start, count = np.r_[start[~single], each], np.r_[count[~single], np.ones(len(each), np.int64)]
            by = np.argsort(start, kind="stable")
            h, start, count = h[by], start[by], count[by]
        data, begin, size = joined(w)
        text, raw = memoryview(data), memoryview(word).cast("B")
        doc = np.searchsorted(w.first, start, side="right") - 1
        ids, marks = piece.column("id").to_pylist(), piece.column("mark").to_pylist()
        own = start - w.first[doc]
        gone = np.zeros(len(w) + 1, np.int64)
        rows = []
        digest, last = xxhash.xxh3_128_digest, n - 1
        ends = begin + size
        for k, (s, c, d, o) in enumerate(zip(start.tolist(), count.tolist(), doc.tolist(), own.tolist())):
            name = digest(raw[8 * s : 8 * (s + c + last)])
            here = (ids[d], o, marks[d])
            before = seen.get(name)
            if before is not None and before[:2] < here[:2]:
                gone[s] += 1
                gone[s + c] -= 1
            elif before is None or before != here:
                seen[name] = here
                rows.append((k, bytes(text[begin[s] : ends[s + c + last - 1]])))
        if rows:
            k = np.array([r[0] for r in rows])
            take = pa.array(doc[k])
            yield pa.record_batch([pa.array(h[k].view(np.int64)), piece.column("id").take(take), piece.column("mark").take(take), pa.array(own[k].astype(np.int32)), pa.array(count[k].astype(np.int32)), pa.array([r[1] for r in rows], pa.binary())], NAMES)
        covered = np.cumsum(gone[:-1]) > 0
        edge = np.flatnonzero(covered & ~np.r_[False, covered[:-1]] | covered & np.isin(np.arange(len(w)), w.first))
        if len(edge):
            stop = np.flatnonzero(covered & ~np.r_[covered[1:], False] | covered & np.isin(np.arange(1, len(w) + 1), w.first)) + 1
            doc = np.searchsorted(w.first, edge, side="right") - 1
            take = pa.array(doc)
            yield pa.record_batch([pa.nulls(len(edge), pa.int64()), piece.column("id").take(take), piece.column("mark").take(take), pa.array((edge - w.first[doc]).astype(np.int32)), pa.array((stop - edge).astype(np.int32)), pa.nulls(len(edge), pa.binary())], NAMES)

    return docs.mapInArrow(trimmed(run), PASSAGES)


NAMES = ["shard", "id", "mark", "start", "n", "words"]


def judge(group: list[tuple[int, int, int, bytes]], n: int) -> Iterator[tuple[int, int, int]]:
    """(index, window, number of windows) that start earlier in the group; it comes in order of place."""
    if len(group) < 2:
        return
    automaton, known = None, {}
    first = group[0]
    for i, (id_, start, count, words) in enumerate(group):
        place, before = (id_, start), known.get(words)
        if before is not None:
            if before[0] < place:
                yield i, start, count
            else:  # the same place: the same verdict
                for a, b in before[1]:
                    yield i, a, b
            continue
        gone = []
        if i:
            if automaton is None:
                automaton = SuffixAutomaton()
                automaton.add(first[3].split(b" "))
            split_ = words.split(b" ")
            size = list(automaton.statistics(split_))
            flags = [x >= n for x in size[n - 1 :]]
            k = 0
            while k < len(flags):
                if flags[k]:
                    b = k
                    while k < len(flags) and flags[k]:
                        k += 1
                    gone.append((start + b, k - b))
                else:
                    k += 1
            if not all(flags):
                automaton.add(split_)
        known[words] = (place, gone)
        for a, b in gone:
            yield i, a, b


def repeated_windows(found: DataFrame, n: int) -> DataFrame:
    """id, mark, start, n of the runs of repeated windows."""

    def flush(group, marks, out):
        for i, start, count in judge(group, n):
            out.append((group[i][0], marks[i], start, count))

    def run(batches):
        shard, group, marks, out = None, [], [], []
        for batch in batches:
            for key, id_, mark, start, count, words in zip(*(c.to_pylist() for c in batch.columns)):
                if key != shard:
                    flush(group, marks, out)
                    shard, group, marks = key, [], []
                group.append((id_, start, count, words))
                marks.append(mark)
            if len(out) >= 10_000:
                yield rows(out)
                out = []
        flush(group, marks, out)
        yield rows(out)

    def rows(out):
        a, b, c, d = zip(*out) if out else ((), (), (), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], ["id", "mark", "start", "n"])

    new = found.where("shard is not null").repartition("shard").sortWithinPartitions("shard", "id", "start", "mark")
    judged = new.mapInArrow(trimmed(run), "id long, mark long, start int, n int")
    return judged.union(found.where("shard is null").select("id", "mark", "start", "n"))


def without(piece: pa.RecordBatch, n: int) -> pa.RecordBatch:
    w = split(piece.column("text"), SPACE)
    spans = piece.column("spans")
    flat = spans.flatten()
    size = np.array([len(x) if x is not None else 0 for x in spans.to_pylist()], np.int64)
    base = np.repeat(w.first[:-1], size)
    edge = np.zeros(len(w) + 1, np.int64)
    start = base + flat.field("start").to_numpy().astype(np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + flat.field("n").to_numpy() + n - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    data, _, words = joined(w)
    left = data[np.repeat(keep, words + 1)]
    total = np.r_[0, np.cumsum(np.where(keep, words + 1, 0))]
    at = total[w.first]
    empty = at[1:] == at[:-1]
    mem = memoryview(left)
    texts = [b"" if e else bytes(mem[a : b - 1]) for a, b, e in zip(at[:-1].tolist(), at[1:].tolist(), empty.tolist())]
    removed = np.r_[0, np.cumsum(~keep)][w.first]
    return pa.record_batch([piece.column("doc_id"), pa.array(w.counts(), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def place(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(docs["text"])


def remove_repeats(docs: DataFrame, n: int = N, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    id_, mark = place(docs)
    docs = small_batches(docs).select("doc_id", id_.alias("id"), mark.alias("mark"), "text")
    counts = table(anchor_counts(docs, n).where("n > 1"), "anchors")
    found = table(passages(docs.select("id", "mark", "text"), n, filter_of(counts, 2), filter_of(counts, hot)), "passages")
    spans = repeated_windows(found, n).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    back = docs.join(spans, ["id", "mark"], "left").select("doc_id", "text", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,n:int>>)")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(back, lambda p: without(p, n), f"doc_id {kind}, n_words long, n_removed long, kept string")
