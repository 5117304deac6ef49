"""Token ids in seekable binary files: independent zstandard frames with a trailing seek table.

File format, all numbers little-endian:
- For each document, in ascending doc_id order, one zstandard frame with its ids
  as unsigned 32-bit integers.
- A skippable frame (INDEX_MAGIC) with the documents' ids as signed 64-bit
  integers and a byte for each, 0 if it has no id.
- A skippable frame (TABLE_MAGIC) with the seek table: for each document's frame
  its compressed size, its size and the lower half of the XXH64 of its contents, 32
  bits each, then the number of frames (32 bits), a byte 0x80 (checksums follow
  the sizes) and the magic 0x8F92EAB1.
- After every frame stands the empty skippable frame SEPARATOR, which is what
  Spark's text writer puts between records; decoders skip it.

So any zstandard decoder can read a file whole, and a reader decompresses only
the frames of the documents that it wants, checking each.

Spark writes and reads the files: one task writes one file, whose documents are
a range of doc_id with about FILE_BYTES of text.

Defined results: null text is empty, its ids are the end id alone; rows with a
null doc_id come first; rows with equal ids follow one another, ordered by their
frames; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_text, shared_dir, table, trimmed, with_text
from .words import SPACE, hashes, split

SEPARATOR = "P*M\x18\x00\x00\x00\x00"
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FILE_BYTES = 16 << 20
#: Pieces that a task remembers, and those it keeps when it has too many: the most used.
CACHE, KEPT = 1 << 19, 1 << 17
#: Words encoded in one call.
TOGETHER = 256
#: Marks that the tokenizer always parts from letters.
MARKS = ".,;:!?#*$%&|<>()\""


class Encoder:
    """Ids of texts by a tokenizer that drops white space and lower-cases, so that each piece between white space
    can be encoded once; pieces are known by 64-bit hashes.  A piece of letters and marks is a word and its marks, each encoded once;
    words of letters are encoded many to a call, as each ends with a token that ends a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Pieces by their hashes, in order, each with its word and marks; words (0 is none), each with its ids.
        self.known = np.zeros(0, np.uint64)
        self.word = self.marks = self.used = np.zeros(0, np.int64)
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of words, in order, and their numbers
        self.begin = self.size = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def has(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(names), bool)
        return self.names[np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)] == names

    def add_words(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        flat, sizes = [self.flat], [self.size]
        parts = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(cut, prepend=0))
            else:
                each = [self.one(w) for w in part]
                flat += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        each = [self.one(w) for w in rest]
        self.flat, self.size = np.concatenate([*flat, *each]), np.concatenate([*sizes, np.array([len(x) for x in each], np.int64)])
        self.begin = np.cumsum(self.size) - self.size
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in [*letters, *rest]), np.uint64, len(words))
        by = np.argsort(hashed)
        at = np.searchsorted(self.names, hashed[by])
        self.place = np.insert(self.place, at, len(self.size) - len(words) + by)
        self.names = np.insert(self.names, at, hashed[by])

    def add_pieces(self, hashed: np.ndarray, pieces: list[str]) -> None:
        """New pieces, in order of their hashes."""
        words, marks = [], []
        for p in pieces:
            w = p.rstrip(MARKS)
            if not w or w.isalpha():
                words.append(w.lower() if w.isascii() else w)
                marks.append(p[len(w) :])
            else:
                words.append(p)
                marks.append("")
        distinct: dict[str, int] = {}
        each = np.array([distinct.setdefault(x, len(distinct)) for x in words + marks], np.int64)
        strings = list(distinct)
        names = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in strings), np.uint64, len(strings))
        have = np.array([not x for x in strings]) | self.has(names)
        if not have.all():
            self.add_words([x for x, h in zip(strings, have.tolist()) if not h])
        number = self.place[np.minimum(np.searchsorted(self.names, names), len(self.place) - 1)] if len(self.place) else np.zeros(len(names), np.int64)
        number[[i for i, x in enumerate(strings) if not x]] = 0
        n = len(pieces)
        at = np.searchsorted(self.known, hashed)
        self.known = np.insert(self.known, at, hashed)
        self.word = np.insert(self.word, at, number[each[:n]])
        self.marks = np.insert(self.marks, at, number[each[n:]])
        self.used = np.insert(self.used, at, 0)

    def shrink(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[:KEPT])
        kept, live = np.unique(np.r_[0, self.word[keep], self.marks[keep]], return_inverse=True)
        stays = np.isin(self.place, kept)
        self.names, self.place = self.names[stays], np.searchsorted(kept, self.place[stays])
        n = self.size[kept]
        self.flat = self.flat[np.repeat(self.begin[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.size, self.begin = n, np.cumsum(n) - n
        self.known, self.used = self.known[keep], np.zeros(len(keep), np.int64)
        self.word, self.marks = live[1 : 1 + len(keep)], live[1 + len(keep) :]

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        if max(len(self.known), len(self.names)) > CACHE:
            self.shrink()
        w = split(texts, SPACE)
        distinct, first, which = np.unique(hashes(w), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        if len(self.known):
            missing = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct)
        else:
            missing = np.arange(len(distinct))
        if len(missing):
            data = memoryview(w.data)
            self.add_pieces(distinct[missing], [str(data[a:b], "utf-8") for a, b in zip(w.starts[first[missing]].tolist(), w.ends[first[missing]].tolist())])
            at = np.searchsorted(self.known, distinct)
        self.used[at] += np.bincount(which, minlength=len(distinct))
        k = at[which]
        both = np.empty(2 * len(k), np.int64)
        both[::2], both[1::2] = self.word[k], self.marks[k]
        n = self.size[both]
        ids = self.flat[np.repeat(self.begin[both] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4")
        cut = np.r_[0, np.cumsum(n)][2 * w.first].tolist()
        last = np.array([end], "<u4")
        return [np.concatenate([ids[a:b], last]) for a, b in zip(cut, cut[1:])]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def frames(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n_tokens, sum (the frame's checksum) and frame of every row."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(path).encode(piece.column("text"), end)
        c = compressor()
        return pa.record_batch([piece.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([checksum(x.tobytes()) for x in ids], pa.int64()), pa.array([c.compress(x.tobytes()) for x in ids], pa.binary())], ["doc_id", "n_tokens", "sum", "frame"])

    return map_text(with_text(docs), run, "doc_id long, n_tokens long, sum long, frame binary")


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def trailer(ids: list[int | None], entries: list[tuple[int, int, int]]) -> tuple[bytes, bytes]:
    index = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + bytes(i is not None for i in ids)
    seek = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    return skippable(INDEX_MAGIC, index), skippable(TABLE_MAGIC, seek)


def write(docs: DataFrame, path: str, to: str, end: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every document, followed by `end`, to files in the folder `to`."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    total, least, most = rows.agg(F.sum("n"), F.min("doc_id"), F.max("doc_id")).first()
    files = (total or 0) // file_bytes + 1
    bounds = sorted({*rows.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 10_000)).first()[0]}) if files > 1 and least is not None else []
    # The file of a document: how many bounds its id has passed.
    part = F.coalesce(F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int")
    dealt = frames(docs, path, end).withColumn("part", part).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "frame")

    def run(batches):
        ids, entries = [], []
        for batch in batches:
            doc_ids, n, sums, data = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "sum", "frame"))
            ids += doc_ids
            entries += [(len(f) + len(SEPARATOR), 4 * k, s) for f, k, s in zip(data, n, sums)]
            yield pa.record_batch([batch.column("frame")], ["frame"])
        if ids:
            yield pa.record_batch([pa.array(trailer(ids, entries), pa.binary())], ["frame"])

    dealt.mapInArrow(trimmed(run), "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(to)


def seek_table(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether there is one, and the seek table of a file's contents."""
    end = len(data) - len(SEPARATOR)
    n, flags, magic = struct.unpack("<IBI", data[end - 9 : end])
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("no seek table at the end")
    begin = end - 9 - 12 * n
    table_ = np.frombuffer(data[begin : end - 9], "<u4").reshape(n, 3).astype(np.int64)
    index = begin - 8 - len(SEPARATOR) - 9 * n
    return np.frombuffer(data[index : index + 8 * n], "<i8"), np.frombuffer(data[index + 8 * n : index + 9 * n], np.uint8).astype(bool), table_


def read(spark: SparkSession, at: str, wanted: set[int] | None = None) -> DataFrame:
    """file, row, doc_id, n_before (ids before it in its file), n_tokens, ids of the documents wanted (None: all)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                if not len(data):
                    continue
                ids, has, entries = seek_table(data)
                begin = np.cumsum(entries[:, 0]) - entries[:, 0]
                n = entries[:, 1] // 4
                before = np.cumsum(n) - n
                rows = np.arange(len(ids)) if wanted is None else np.flatnonzero(has & np.isin(ids, list(wanted)))
                d = zstandard.ZstdDecompressor()
                for lo in range(0, len(rows), 2048):
                    part, out = rows[lo : lo + 2048], []
                    for r in part.tolist():
                        size, full, want = entries[r].tolist()
                        got = d.decompress(data[begin[r] : begin[r] + size - len(SEPARATOR)], max_output_size=full)
                        if checksum(got) != want:
                            raise ValueError(f"{path}: frame {r} is damaged")
                        out.append(got)
                    yield pa.record_batch([pa.array([path] * len(part)), pa.array(part), pa.array(ids[part], mask=~has[part]), pa.array(before[part]), pa.array(n[part]), pa.array(out, pa.binary())], ["file", "row", "doc_id", "n_before", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("path", "content")
    return files.mapInArrow(trimmed(run), "file string, row long, doc_id long, n_before long, n_tokens long, ids binary")


def offsets(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""

    def digest(batches):
        for b in batches:
            yield pa.record_batch([b.column("file"), b.column("row"), b.column("doc_id"), b.column("n_before"), b.column("n_tokens"), pa.array([zlib.crc32(x.as_buffer()) for x in b.column("ids")], pa.int64())], ["file", "row", "doc_id", "n_before", "n_tokens", "ids_crc32"])

    docs = table(read(spark, at).mapInArrow(trimmed(digest), "file string, row long, doc_id long, n_before long, n_tokens long, ids_crc32 long"), "tokens")
    files = docs.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.sum("n_tokens").alias("n"))
    base = files.select("file", (F.sum("n").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))  # a row for each file
    return docs.join(base, "file").select("doc_id", (F.col("base") + F.col("n_before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/tokenfiles-{uuid.uuid4().hex}"
    write(docs, path, to, end, file_bytes)
    return offsets(spark, to)
