"""WARC archives: writing, and reading by boundary-chain verification.

Reading: every place where the record magic stands is a candidate.  A task that
streams a file parses the header there and emits the candidate's offset with the
offset of its successor, header + Content-Length further on.  A payload may hold
the magic, too; only candidates that the chain from the file's start reaches are
records.  The chain is followed by pointer jumping: each round joins the reached
set with jumps twice as long, so rounds grow with the logarithm of the records of
a file.  A candidate that ends where the next magic stands is digested where it
was read; a record whose payload holds the magic comes in several pieces, which
are put together afterwards.

Writing: of equal payloads of at least `least` bytes, the smallest page_id's is
the response; the others revisit it and carry no payload.

Files are gzip-compressed, a task's pages to a file.  A file is read by one task
as a stream of records.

Defined results: null html is an empty payload; a null url gives no
WARC-Target-URI; a null page_id is written and read back as null and revisits a
known page if there is one; rows that repeat the response's page_id and payload
are responses; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, trimmed

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A record without the two line ends that follow it."""
    block = HTTP + payload if refers_to is None else HTTP
    lines = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + name(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url).encode())
    lines.append(b"WARC-Payload-Digest: sha1:" + digest(payload).encode())
    if refers_to is not None:
        lines += [b"WARC-Refers-To: " + name(refers_to), b"WARC-Profile: " + PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return MAGIC + b"\r\n".join(lines) + END + block


def write(pages: DataFrame, to: str, least: int = 0, date: str = DATE) -> None:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    same = pages.where(F.length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("same"), "first")
    dealt = pages.join(same, F.col("sha") == F.col("same"), "left").select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")))
                yield pa.record_batch([pa.array([record(*r, date=date) for r in rows], pa.binary())], ["record"])

    dealt.mapInArrow(trimmed(run), "record binary").select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(to)


def number(text: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", text or b"")
    return int(m[1]) if m else None


def parse(piece: bytes) -> dict | None:
    """The header after the magic: its size with the empty line, and what it says; None if it isn't one."""
    at = piece.find(END)
    if at < 0:
        return None
    fields = {}
    for line in piece[:at].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower()] = v.strip()
    size = fields.get(b"content-length", b"")
    if not re.fullmatch(rb"\d{1,18}", size) or b"warc-type" not in fields:
        return None
    return {"begin": at + 4, "size": int(size), "type": fields[b"warc-type"].decode("latin-1"), "page_id": number(fields.get(b"warc-record-id")), "refers_to": number(fields.get(b"warc-refers-to")), "said": fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")}


def contents(head: dict, piece: bytes) -> tuple[int | None, str]:
    """Payload bytes and digest of a whole record after its magic; a revisit's are its header's."""
    if head["type"] == "revisit":
        return None, head["said"]
    block = piece[head["begin"] : head["begin"] + head["size"]]
    payload = block[block.find(END) + 4 :] if END in block else b""
    got = digest(payload)
    if head["said"] and got != head["said"]:
        raise ValueError(f"record of page {head['page_id']} is damaged")
    return len(payload), got


CANDIDATE = "file string, at long, next long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, whole boolean, raw binary"
NAMES = [f.split(" ")[0] for f in CANDIDATE.split(", ")]


def candidates(spark: SparkSession, at: str) -> DataFrame:
    """A row for each magic: offsets of it and of its successor, and the record if its piece holds it whole.
    raw: the piece, where it may be needed to put a record together."""
    pieces = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(at).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches):
        file, place, claim = None, 0, 0  # the offset after the last magic; where the candidates so far say that they end
        for batch in batches:
            out = []
            for path, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
                if path != file:  # what stands before the first magic; nothing in a sound file
                    file, claim = path, 0
                    place = len(piece) + len(MAGIC)
                    if piece:
                        raise ValueError(f"{path} doesn't start with a record")
                    continue
                start = place - len(MAGIC)
                head = parse(piece)
                next_ = place + head["begin"] + head["size"] + len(END) if head else None
                whole = next_ == place + len(piece)
                inside = start < claim  # an earlier candidate covers it
                size, sha = (None, None)
                if whole:
                    try:
                        size, sha = contents(head, piece)
                    except ValueError:
                        if not inside:
                            raise
                        whole = False
                info = [head[k] if head else None for k in ("type", "page_id", "refers_to")]
                out.append((path, start, next_, *info, size, sha, whole, piece if inside or not whole else None))
                claim = max(claim, next_ or 0)
                place += len(piece) + len(MAGIC)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(NAMES), TYPES)], NAMES)

    return pieces.mapInArrow(trimmed(run), CANDIDATE)


TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]


def reachable(found: DataFrame) -> DataFrame:
    """file, at of the candidates on the chains from the files' starts, by pointer jumping."""
    jump = found.where("next is not null").select("file", "at", F.col("next").alias("to"))
    reached, n = table(found.where("at = 0").select("file", "at"), "reached"), -1
    while (m := reached.count()) != n:
        n = m
        jump = table(jump, "jumps")
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        # Only places that are candidates; the end of a file is none.
        step = step.join(found.select("file", "at"), ["file", "at"], "left_semi")
        reached = table(reached.union(step).distinct(), "reached")
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = jump.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to"))
    return reached


def read(spark: SparkSession, at: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives."""
    found = table(candidates(spark, at), "candidates")
    reached = reachable(found)
    records = table(found.join(reached, ["file", "at"], "left_semi"), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # Pieces of records that hold the magic: each belongs to the last record that starts at or before it.
    pieces = found.where("raw is not null").join(records.select("file", "at", F.lit(True).alias("is_record"), (~F.col("whole")).alias("open")), ["file", "at"], "left")
    owner = F.last(F.when(F.col("is_record"), F.struct("at", "open")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    pieces = pieces.withColumn("owner", owner).where("owner.open").groupBy("file", F.col("owner.at").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("pieces"))

    def put_together(batches):
        for batch in batches:
            out = []
            for file, rows in zip(batch.column("file").to_pylist(), batch.column("pieces").to_pylist()):
                raw = MAGIC.join(r["raw"] for r in rows)
                head = parse(raw)
                if head is None or len(raw) < head["begin"] + head["size"]:
                    raise ValueError(f"{file}: the record at {rows[0]['at']} is cut off")
                size, sha = contents(head, raw)
                out.append((head["page_id"], size, sha, head["type"], head["refers_to"]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], columns)

    rest = pieces.select("file", "pieces").mapInArrow(trimmed(put_together), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = table(records.where("whole").select(*columns).union(rest), "pages")
    # A revisit's payload is that of the response it refers to.
    of = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("original"), F.col("payload_digest").alias("sha")).agg(F.max("payload_bytes").alias("n"))
    full = rows.join(of, (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("sha")), "left")
    return full.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives of the pages to the shared folder and reads them back."""
    spark = pages.sparkSession
    to = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, to, least)
    return read(spark, to)
