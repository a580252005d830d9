"""WARC archives written and read as a table of record segments.

A payload is a stream of chunks. Each chunk is one WARC record (a segment, the first of type
response, the rest of type continuation) and one row of a text table, keyed by record
identifier and segment number; it carries its own digest and the digest of the payload so
far. Spark writes and reads the files, so they may lie in any store it knows. The line that starts a
record never occurs inside a chunk: chunks end inside it. That makes it a safe separator, and
archives can be read in splits without looking at lengths first. No step holds a longer
piece of a read payload than one chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.registry import query, table
from strayrows.llm.words import slices, texts_of
from strayrows.staging import shared_dir, stage

MARK = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CUT = re.compile(re.escape(MARK.encode()))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cut(payload: bytes, most: int) -> Iterator[bytes]:
    """Chunks of at most `most` bytes that split neither a character nor hold MARK; one at least."""
    view, at, marks = memoryview(payload), 0, [m.start() + 4 for m in _CUT.finditer(payload)]
    marks.reverse()
    while True:
        end = min(at + most, len(payload))
        while marks and marks[-1] <= at:
            marks.pop()
        if marks and marks[-1] <= end:
            end = marks[-1]
        while at < end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield bytes(view[at:end])
        if end >= len(payload):
            return
        at = end


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([base32(hashlib.sha1(t).digest()) for t in texts], pa.string()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            names=["page_id", "payload_bytes", "payload_digest", "same"],
        )


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, same, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Payloads of `least` bytes or more that are equal (SHA-256) have one response, the one with the
    smallest page_id; rows that repeat it are responses too. A null page_id comes last.
    """
    spec = "page_id bigint, payload_bytes bigint, payload_digest string, same binary"
    found = stage(pages.select("page_id", "html").mapInArrow(_digests, spec), "digests")
    groups = stage(
        found.where(F.col("payload_bytes") >= least)
        .groupBy("same")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL"),
        "equal-payloads",
    )
    return found.join(groups, "same", "left").select(
        "page_id", "same", "payload_bytes", "payload_digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    ).distinct()


def _segments(chunk_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.select(["page_id", "url", "payload_bytes", "payload_digest", "refers_to"]).to_pylist()
            texts = texts_of(batch.column("html"))
            for a, b in slices(texts, 4 << 20):
                out = []
                for row, text in zip(rows[a:b], texts[a:b]):
                    n += 1
                    out += record(row, text, f"{part}-{n}", chunk_bytes, date)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def record(row: dict, payload: bytes, serial: str, chunk_bytes: int, date: str) -> Iterator[str]:
    """The segments of a page's record, without MARK before and the line feed after."""
    page = "" if row["page_id"] is None else row["page_id"]
    origin = f"<urn:x-page:{page}:{serial}>"
    common = {
        "WARC-Date": date,
        "WARC-Target-URI": quote(row["url"] or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "X-Payload-Length": row["payload_bytes"],
    }
    if row["refers_to"] is not None:
        yield _block(
            {
                "WARC-Type": "revisit", "WARC-Record-ID": origin, **common,
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": f"<urn:x-page:{row['refers_to']}>",
            },
            "",
        )
        return
    so_far = hashlib.sha1()
    chunks = cut(payload, chunk_bytes)
    chunk, number = next(chunks), 1
    while chunk is not None:
        following = next(chunks, None)
        so_far.update(chunk)
        head = {"WARC-Type": "response" if number == 1 else "continuation"}
        head["WARC-Record-ID"] = origin if number == 1 else f"<urn:x-page:{page}:{serial}:{number}>"
        head |= common
        if number > 1 or following is not None:
            head |= {"WARC-Segment-Number": number, "WARC-Segment-Origin-ID": origin}
            if following is None:
                head["WARC-Segment-Total-Length"] = row["payload_bytes"] + len(HTTP)
        head["WARC-Block-Digest"] = f"sha1:{base32(hashlib.sha1(chunk).digest())}"
        head["X-Running-Digest"] = f"sha1:{base32(so_far.digest())}"
        if number == 1:
            head["Content-Type"] = "application/http; msgtype=response"
        yield _block(head, (HTTP if number == 1 else "") + chunk.decode())
        chunk, number = following, number + 1


def _block(head: dict, block: str) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"{MARK}{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r"


def write(pages: DataFrame, path: str, least: int = 0, chunk_bytes: int = 32768,
          date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row of `pages` (page_id, url, html; other columns are ignored), in gzip files.

    A null html is an empty payload. No rows: no records.
    """
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    plan = plan_records(keyed, least).withColumnsRenamed({"page_id": "_id", "same": "_same"})
    content = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    both = keyed.join(plan, F.col("page_id").eqNullSafe(F.col("_id")) & (content == F.col("_same")))
    (
        both.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
        .mapInArrow(_segments(chunk_bytes, date), "value string")
        .write.option("lineSep", "\n").option("compression", "gzip").text(path)
    )


READ = (
    "record string, page_id bigint, segment int, total bigint, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, running string, block binary, digest string"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(v) for v in texts_of(batch.column(0)) if v]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t])
     for n, t in (c.split() for c in READ.split(", "))]
)


def parse(value: bytes) -> dict:
    """One segment. Blocks of whole records are digested at once, of segmented ones kept."""
    top, _, rest = value.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n"))
    length = int(head["Content-Length"])
    if len(rest) < length or rest[length:] not in (b"\r\n\r\n", b"\r\n\r"):
        raise ValueError(f"{head['WARC-Record-ID']}: block of {len(rest)} bytes, {length} announced")
    block, kind = rest[:length], head["WARC-Type"]
    page = head["WARC-Record-ID"].split(":")[2].strip("<>")
    out = {
        "record": head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]),
        "page_id": int(page) if page else None,
        "segment": int(head.get("WARC-Segment-Number", 0)),
        "total": int(head.get("WARC-Segment-Total-Length", 0)),
        "payload_bytes": int(head["X-Payload-Length"]),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
    }
    if kind == "revisit":
        return out | {"refers_to": int(head["WARC-Refers-To"].split(":")[2].strip("<>")), "digest": out["payload_digest"]}
    if kind == "response":
        if not block.startswith(HTTP.encode()):
            raise ValueError(f"{out['record']}: no HTTP header")
        block = block[len(HTTP) :]
    digest = base32(hashlib.sha1(block).digest())
    if f"sha1:{digest}" != head["WARC-Block-Digest"]:
        raise ValueError(f"{out['record']}: block digest differs")
    if out["segment"]:
        return out | {"running": head["X-Running-Digest"].removeprefix("sha1:"), "block": block}
    if len(block) != out["payload_bytes"]:
        raise ValueError(f"{out['record']}: payload length differs")
    return out | {"digest": digest}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of segmented records whose rows come in order; only a digest's state is kept."""
    record, state, size, last = None, hashlib.sha1(), 0, 0
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["record"] != record:
                record, state, size, last = row["record"], hashlib.sha1(), 0, 0
            state.update(row["block"])
            size, last = size + len(row["block"]), last + 1
            if row["segment"] != last or base32(state.digest()) != row["running"]:
                raise ValueError(f"{record}: segment {row['segment']} is not what should follow")
            if row["total"]:
                if size + len(HTTP) != row["total"]:
                    raise ValueError(f"{record}: total length differs")
                done.append(row | {"payload_bytes": size, "digest": base32(state.digest()), "block": None,
                                   "record_type": "response"})
        yield pa.RecordBatch.from_pylist(done, schema=_ARROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in `path`.

    Digests and lengths are computed from what is read, for revisits taken from their header. A
    damaged record raises.
    """
    rows = stage(
        spark.read.schema("value string").option("lineSep", MARK).text(path).mapInArrow(_parse, READ), "segments"
    )
    whole = rows.where("segment = 0")
    ordered = rows.where("segment > 0").repartition("record").sortWithinPartitions("record", "segment")
    both = whole.unionByName(ordered.mapInArrow(_joined, READ))
    checked = F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs: "), "record"))
    )
    return both.select(
        "page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to"
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


@query("op9_warc", SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/strayrows/{uuid.uuid4().hex}/archive"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)
