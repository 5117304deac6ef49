import base64
import zlib

import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from brute import documents, empty, sha
from tokenizers import Tokenizer

from tributary.llm import bytebpe as B
from tributary.llm import tokenfile as T

BYTES, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["'s 'll it's''re  two  spaces \n\n end  ", "日本語 mixed été 123456 \t\r\n", "<|endoftext|> a<|startoftext|>b", "é ́x \x1c\x1d y z w \x85 q", "\U0001f600\U0001f600" * 3, "ΑΣ ΑΣΑ İı", "x" * 5000, " ", "\x00 \x00a", "A̧ ̧"]


def rows(spark):
    docs, known = documents(spark, 40)
    more = [(1000 + 7 * i, t) for i, t in enumerate(ODD)]
    return docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True), known + more


def test_byte_bpe(spark, monkeypatch):
    docs, known = rows(spark)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in B.encode(docs, BYTES, P.PATTERN).collect()}
    for i, t in known:
        ids = own.encode_ordinary(t or "")
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), data, (t or "").encode()), i
        assert B.decode(data, BYTES) == (t or "").encode()
    assert len(got) == len(known)


def test_cuts_agree_with_the_pattern():
    """Texts of every kind of white space around words, cut at spaces or not."""
    import random

    import regex

    r = random.Random(9)
    find = regex.compile(P.PATTERN).findall
    texts = ["".join(r.choice(["a", "B1", "'s", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "é", ",", "'", "日"]) for _ in range(r.randint(0, 12))) for _ in range(20000)]
    import pyarrow as pa

    block = B.Block(find)
    block.add(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]))
    _, counts, parts, numbers, part = block.finish(3)
    words = sum(parts, [])
    assert len(set(words)) == len(words)
    words = [words[i] for i in B.places(part).tolist()]
    at = 0
    for t, n in zip(texts, counts):
        assert [words[i] for i in numbers[at : at + n]] == find(t), repr(t)
        at += n
    assert B.unpacked(B.packed(numbers)).tolist() == numbers.tolist()


def test_byte_bpe_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    twice = docs.union(docs)
    assert B.encode(twice, BYTES, P.PATTERN).count() == 6
    assert B.encode(empty(spark), BYTES, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [32 << 20, 4000])
def test_token_files(spark, tmp_path, size):
    docs, known = rows(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    want, start = {}, 0
    for i, t in sorted(known):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    T.write(docs, WORDS, str(tmp_path / "f"), file_bytes=size)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.offsets(spark, str(tmp_path / "f")).collect()}
    assert got == want
    # Only the documents asked for, and any zstandard decoder reads the file.
    assert {r.doc_id for r in T.read(spark, str(tmp_path / "f"), {3, 9, 10}).collect()} == {3, 9}
    files = sorted((tmp_path / "f").glob("part-*"))
    assert len(files) > 1 if size == 4000 else len(files) == 1
    whole = zstandard.ZstdDecompressor().stream_reader(files[0].read_bytes(), read_across_frames=True).read()
    assert len(whole) % 4 == 0 and len(whole) > 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "others")], "doc_id long, text string").coalesce(1)
    T.write(docs, WORDS, str(tmp_path / "f"))
    f = next((tmp_path / "f").glob("part-*"))
    data = bytearray(f.read_bytes())
    data[-len(T.SEPARATOR) - 10] ^= 1  # in the last checksum
    f.unlink()
    (tmp_path / "f" / "part-x").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        T.offsets(spark, str(tmp_path / "f")).collect()


def test_empty_and_nulls(spark):
    assert T.round_trip(empty(spark), WORDS).count() == 0
    docs = spark.createDataFrame([(None, "a"), (5, None), (5, "b c"), (None, None)], "doc_id long, text string")
    got = sorted(((r.start, r.n_tokens) for r in T.round_trip(docs, WORDS).collect()))
    assert [s for s, _ in got] == [0, *[sum(n for _, n in got[: k + 1]) for k in range(3)]]


def test_workers_keep_no_tables_and_a_task_has_one(spark):
    """What a stage leaves in Python workers stands beside what the next stages need."""
    docs, _ = rows(spark)
    out = B.encode(docs, BYTES, P.PATTERN)
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2  # words to ids; ids of blocks and their bytes
    assert out.count() == docs.count() and out.agg({"n_tokens": "sum"}).collect()

    def left(batches):
        import pyarrow as pa

        from tributary.llm import bytebpe, simhash

        for _ in batches:
            tables = [x for x in vars(simhash).values() for x in (x if isinstance(x, list) else [x]) if hasattr(x, "nbytes")]
            yield pa.record_batch([pa.array([sum(f.cache_info().currsize for f in (bytebpe.ranks_of, bytebpe.encoder, bytebpe.token_bytes))]), pa.array([sum(x.nbytes for x in tables)])], ["n", "bytes"])

    kept = spark.range(0, 64, 1, 16).mapInArrow(left, "n long, bytes long").collect()
    assert all(r.n == 0 and r.bytes < 1 << 17 for r in kept)
