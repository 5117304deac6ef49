"""Byte-level BPE over a global shuffle of distinct words.

Pre-tokens are taken from every text with their positions; a block of documents
keeps its positions as numbers into the block's own list of distinct words, so a
word leaves its task once a block however often it occurs.  The lists go, in
parts by the words' hashes, to the part's task, where each distinct word of the
corpus meets and is encoded once.  Its ids return to the blocks, which are put
together again by position.  Decoding is an operator of its own on the ids, which
joins them with the token-byte table.

Blocks are written to the shared folder once, so both shuffles see the same
blocks whatever happens to executors; a block that doesn't get all its words
back is an error, not a short result.

Defined results: null text is empty, with no ids and no bytes; repeated rows give
one row each; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, text_pieces, trimmed, with_text
from .words import Words, hashes, text_bytes

#: A block has so many bytes of text, or a piece more.
BLOCK_TEXT = 20 << 20
#: Pre-tokens put together at a time.
PART = 1 << 18
#: Words of a part whose ids a task remembers; beyond that it forgets them and encodes a word again.
KNOWN = 1 << 21


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


#: A word is one match already: the encoder takes it whole.
WHOLE = r"(?s).+"


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes, and where each id's begin and how many they are."""
    ranks = ranks_of(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def forgetting(run):
    """run for mapInArrow; its worker, which serves other stages after it, doesn't keep the tokenizer's tables when a task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            for kept in (encoder, token_bytes, ranks_of):
                kept.cache_clear()

    return trimmed(task)


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of flat, one after another."""
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return flat[at]


def cuts(texts: pa.Array) -> Words:
    """The texts cut before every space, as words of bytes; an empty text has none."""
    data, at = text_bytes(texts)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = np.flatnonzero((data == 0x20) | first[:-1])
    ends = np.append(starts[1:], len(data))
    return Words(data, starts, ends, np.searchsorted(starts, at), at)


class Block:
    """The pre-tokens of some documents as numbers into a list of distinct words.

    A space after a character that isn't white space begins a pre-token, so texts
    are cut there first and each distinct cut is matched once.  White space before
    a space can belong to one match with it: such texts are matched whole.
    """

    def __init__(self, find):
        self.find = find
        self.ids: list[pa.Array] = []
        self.pieces: deque[tuple[np.ndarray, np.ndarray]] = deque()  # of each piece: numbers of its cuts, cuts of each text
        self.known = np.zeros(0, np.uint64)  # hashes of the distinct cuts, sorted
        self.number = np.zeros(0, np.int32)  # their numbers, in the order in which they are met
        self.fresh: list[tuple[bytes, np.ndarray]] = []  # in that order: bytes, sizes
        self.odd: set[int] = set()  # hashes of cuts that end in white space
        self.whole: list[dict[int, list[str]]] = []  # texts that are matched whole
        self.size = 0

    def add(self, piece: pa.RecordBatch) -> None:
        w = cuts(piece.column("text"))
        h = hashes(w)
        distinct, first = np.unique(h, return_index=True)
        at = np.searchsorted(self.known, distinct)
        new = self.known[np.minimum(at, len(self.known) - 1)] != distinct if len(self.known) else np.ones(len(distinct), bool)
        data = memoryview(w.data)
        raw = [bytes(data[w.starts[i] : w.ends[i]]) for i in first[new].tolist()]
        self.odd.update(x for x, r in zip(distinct[new].tolist(), raw) if str(r, "utf-8")[-1].isspace())
        self.fresh.append((b"".join(raw), np.array([len(r) for r in raw], np.int32)))
        self.number = np.insert(self.number, at[new], np.arange(len(self.known), len(self.known) + len(raw), dtype=np.int32))
        self.known = np.insert(self.known, at[new], distinct[new])
        odd = [x for x in distinct.tolist() if x in self.odd] if self.odd else []
        whole = {}
        if odd:  # a cut that ends in white space, with a cut after it in its text
            hit = np.isin(h, np.array(odd, np.uint64))
            hit[w.first[1:][w.counts() > 0] - 1] = False
            for d in np.unique(w.owners()[hit]).tolist():
                whole[d] = self.find(piece.column("text")[d].as_py())
        self.whole.append(whole)
        self.pieces.append((self.number[np.searchsorted(self.known, h)], w.counts()))
        self.ids.append(piece.column("doc_id").take(pa.array(np.arange(piece.num_rows))))  # a copy: a slice would hold the batch
        self.size += len(w.data)

    def finish(self, parts: int) -> tuple[pa.Array, np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
        """Documents, pre-tokens of each, distinct words by part, the words' numbers, and the part of each number.
        Common words have small numbers, which pack well."""
        word: dict[str, int] = {}
        n, flat = array("i"), array("i")
        for raw, size in self.fresh:
            at = 0
            for m in size.tolist():
                found = self.find(str(raw[at : at + m], "utf-8"))
                at += m
                n.append(len(found))
                flat.extend([word.setdefault(f, len(word)) for f in found])
        self.fresh.clear()
        n, flat = np.array(n, np.int64), np.array(flat, np.uint32)
        begin = np.cumsum(n) - n
        out, counts = [], []
        for whole in self.whole:
            at, of = self.pieces.popleft()
            numbers = gather(flat, begin[at], n[at])
            ends = np.cumsum(of)
            total = np.r_[0, np.cumsum(n[at])]
            size = total[ends] - total[ends - of]
            if whole:
                each = np.split(numbers, np.cumsum(size)[:-1])
                for d, found in whole.items():
                    each[d] = np.array([word.setdefault(f, len(word)) for f in found], np.uint32)
                    size[d] = len(each[d])
                numbers = np.concatenate(each)
            out.append(numbers)
            counts.append(size)
        numbers = np.concatenate(out) if out else np.zeros(0, np.uint32)
        del out
        common = np.argsort(-np.bincount(numbers, minlength=len(word)), kind="stable")
        rank = np.empty(len(word), np.uint32)
        rank[common] = np.arange(len(word), dtype=np.uint32)
        words = list(word)
        words = [words[i] for i in common.tolist()]
        part = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % parts for x in words), np.int64, len(words))
        order = np.argsort(part, kind="stable").tolist()
        cut = np.searchsorted(np.sort(part), np.arange(parts + 1))
        return pa.concat_arrays(self.ids), np.concatenate(counts), [[words[i] for i in order[a:b]] for a, b in zip(cut, cut[1:])], rank[numbers], part


def places(part: np.ndarray) -> np.ndarray:
    """Where each word stands when the words are put in order of their parts."""
    out = np.empty(len(part), np.uint32)
    out[np.argsort(part, kind="stable")] = np.arange(len(part), dtype=np.uint32)
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    to = zstandard.ZstdCompressor(9).compressobj(4 * len(numbers))
    return b"".join([*(to.compress((numbers >> 8 * k & 255).astype(np.uint8)) for k in range(4)), to.flush()])


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    out = planes[0].astype(np.uint32)
    for k in range(1, 4):
        out |= planes[k].astype(np.uint32) << 8 * k
    return out


BLOCKS = "block long, part int, n int, size binary, data binary"
NAMES = ["block", "part", "n", "size", "data"]


def blocks(docs: DataFrame, pattern: str, parts: int, block_text: int = BLOCK_TEXT) -> DataFrame:
    """Of each block: a row with its documents and positions (part -1: size has the pre-tokens of each document, data the
    numbers, part_of each number's part), and a row for each part of its words (size has the lengths, data
    the bytes). doc_ids and part_of are null in these."""
    kind = docs.schema["doc_id"].dataType

    def row(block, part, n, size, data, ids=None, part_of=None):
        ids_type = pa.list_(to_arrow_type(kind))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(ids_type) if ids is not None else pa.nulls(1, ids_type)
        return pa.record_batch([pa.array([block]), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([size], pa.binary()), pa.array([data], pa.binary()), listed, pa.array([part_of], pa.binary())], [*NAMES, "doc_ids", "part_of"])

    def rows(block):
        ids, counts, words, numbers, part_of = block.finish(parts)
        name = uuid.uuid4().int >> 65
        yield row(name, -1, sum(map(len, words)), packed(counts), packed(numbers), ids, packed(part_of))
        for k, own in enumerate(words):
            if own:
                data = [x.encode("utf-8", "surrogatepass") for x in own]
                yield row(name, k, len(own), packed(np.array([len(x) for x in data])), zstandard.compress(b"".join(data), 9))

    def run(batches):
        find = regex.compile(pattern).findall
        block = Block(find)
        for batch in batches:
            for piece in text_pieces(batch):
                block.add(piece)
                if block.size >= block_text:
                    yield from rows(block)
                    block = Block(find)
        if block.ids:
            yield from rows(block)

    return table(with_text(docs).mapInArrow(trimmed(run), f"{BLOCKS}, doc_ids array<{kind.simpleString()}>, part_of binary"), "blocks")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """The parts of word lists with ids: size has each word's number of ids, data the ids."""

    def run(batches):
        one = encoder(path, WHOLE).encode_ordinary
        last, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, part, n, size, data = (batch.column(c)[i].as_py() for c in NAMES)
                if part != last or len(known) > KNOWN:  # all lists of a part follow one another: each word is encoded once
                    last, known = part, {}
                raw, at, out = zstandard.decompress(data), 0, []
                for m in unpacked(size).tolist():
                    w = raw[at : at + m]
                    at += m
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(one(w.decode("utf-8", "surrogatepass")), np.uint32)
                    out.append(ids)
                yield pa.record_batch([pa.array([block]), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([packed(np.array([len(x) for x in out]))], pa.binary()), pa.array([packed(np.concatenate(out))], pa.binary())], NAMES)

    return words.repartition("part").sortWithinPartitions("part").mapInArrow(forgetting(run), BLOCKS)


def assemble(batches, use):
    """use(doc_ids, counts, numbers, ids of all words, how many each has) for every block of sorted rows."""
    head, size, ids = None, [], []

    def finish():
        if head is None:
            return
        name, n, counts, numbers, doc_ids, part_of = head
        sizes = np.concatenate(size) if size else np.zeros(0, np.int64)
        if n != len(sizes):
            raise RuntimeError(f"block {name} got {len(sizes)} of {n} words")
        yield from use(doc_ids, unpacked(counts).astype(np.int64), places(unpacked(part_of))[unpacked(numbers)] if n else np.zeros(0, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.int64), sizes)

    for batch in batches:
        for i in range(batch.num_rows):
            block, part, n, a, b = (batch.column(c)[i].as_py() for c in NAMES)
            if part < 0:
                yield from finish()
                head, size, ids = (block, n, a, b, batch.column("doc_ids")[i].values, batch.column("part_of")[i].as_py()), [], []
            elif head is None or head[0] != block:
                raise RuntimeError(f"words of block {block} came without it")
            else:
                size.append(unpacked(a).astype(np.int64))
                ids.append(unpacked(b))
    yield from finish()


def token_ids(docs: DataFrame, path: str, pattern: str, then=None, more: str = "", block_text: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian). What follows on the batches (then, which adds the columns
    more) runs in the same pass: a pass of its own would be a second Python worker beside each task's."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        def use(doc_ids, counts, numbers, own, n):
            start = np.cumsum(n) - n
            ends = np.cumsum(counts)
            lo = 0
            while lo < len(counts):  # documents of some pre-tokens at a time
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + PART, side="right")))
                part = numbers[before : ends[hi - 1]]
                each = n[part]
                ids = gather(own, start[part], each)
                first = np.r_[0, np.cumsum(each)][np.r_[0, ends[lo:hi] - before]]
                a = memoryview(ids.astype("<u4")).cast("B")
                ids_of = [bytes(a[4 * x : 4 * y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([doc_ids.slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(ids_of, pa.binary())], ["doc_id", "n_tokens", "ids"])
                lo = hi

        ids = assemble(batches, use)
        yield from then(ids) if then else ids

    # As many parts of the words as the input has partitions, so a part doesn't grow with the corpus.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select("text").rdd.getNumPartitions())
    found = blocks(docs, pattern, parts, block_text)
    ids = encoded_words(found.where("part >= 0").select(*NAMES), path)
    rows = found.where("part < 0").unionByName(ids, allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "part").mapInArrow(forgetting(run), f"doc_id {kind}, n_tokens long, ids binary{more}")


def decoding(path: str):
    """Adds decoded, the bytes of the column ids, which is all that is read, to batches: each id is joined with the
    token-byte table, an array by id."""

    def run(batches):
        flat, begin, size = token_bytes(path)
        for batch in batches:
            for piece in text_pieces(batch, "ids"):
                own = piece.column("ids")
                i = np.frombuffer(b"".join(own.to_pylist()), "<u4")
                data = memoryview(gather(flat, begin[i], size[i]))
                first = np.r_[0, np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False) // 4)]
                at = np.r_[0, np.cumsum(size[i])][first].tolist()
                yield pa.record_batch([*piece.columns, pa.array([bytes(data[x:y]) for x, y in zip(at, at[1:])], pa.binary())], [*piece.schema.names, "decoded"])

    return run


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """The rows with decoded, the bytes that their ids stand for."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return ids.mapInArrow(forgetting(decoding(path)), f"{shape}, decoded binary")


def encode(docs: DataFrame, path: str, pattern: str, block_text: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian), decoded (the bytes that the ids stand for)."""
    return token_ids(docs, path, pattern, decoding(path), ", decoded binary", block_text)


def decode(ids: bytes, path: str) -> bytes:
    """The bytes of ids as encode() gives them."""
    flat, begin, size = token_bytes(path)
    i = np.frombuffer(ids, "<u4")
    return gather(flat, begin[i], size[i]).tobytes()
