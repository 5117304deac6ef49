import base64
import gzip
import hashlib

from tributary.llm import warc as W


def brute(rows, least=0):
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == p and i is not None]
        first = min(same, default=None)
        revisit = len(p) >= least and first is not None and first != page_id
        out.append((page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, at int")


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (5, "http://a/\r\nX: y", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (6, "u", FAKE), (7, "u", "WARC/1.0\r\n"), (8, "u", "WARC/WARC/1.0\r\nWARC/1.0" + FAKE * 3),
    (10, "u", "x" + FAKE.replace("5", "99999") + "tail"), (11, "u", "\r\n\r\n"), (12, "u", "é\x00ü" * 5000), (13, "u", FAKE[:40]), (14, "u", "WARC/1.0\r\n" * 50), (None, "u", "only"), (None, "u", "same"), (15, "u", FAKE),
]


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    for n in (1, 3):
        assert result(W.round_trip(pages(spark, ROWS).repartition(n))) == brute(ROWS)
    assert result(W.round_trip(pages(spark, ROWS), 5)) == brute(ROWS, 5)


def test_long_chain_and_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", FAKE * (i % 3) + str(i % 17)) for i in range(300)]
    W.write(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    assert result(W.read(spark, str(tmp_path / "w"))) == brute(rows)
    data = gzip.decompress(next((tmp_path / "w").glob("part-*.gz")).read_bytes())
    # Walking the file by lengths gives as many records.
    at = n = 0
    while at < len(data):
        head = W.parse(data[at + len(W.MAGIC) :])
        assert data[at:].startswith(W.MAGIC)
        at += len(W.MAGIC) + head["begin"] + head["size"] + 4
        n += 1
    assert n == 300


def test_empty_and_repeats(spark):
    assert W.round_trip(pages(spark, [])).count() == 0
    assert result(W.round_trip(pages(spark, [(1, "u", "a")] * 3))) == brute([(1, "u", "a")] * 3)
