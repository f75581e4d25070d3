"""WARC archives written and read through Spark's text files, with segmented records put together again.

Every record begins with its version line, which separates records when a file is read line by line. Payloads travel in chunked framing, and a chunk border is set inside every version line that a payload holds; so
the separator never occurs inside a record. Long blocks are cut into a first record and continuations.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayloom.llm import textkit as K
from stayloom.session import cut_lineage

VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
SEPARATOR = VERSION + "\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES = 8192, 4096, 1000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of UUIDs
PIECES = ("origin string, row_tag string, number int, total bigint, kind string, page_id bigint, digest string, refers string, "
          "whole boolean, segmented boolean, body binary")
RECORDS = "record_id string, page_id bigint, record_type string, digest string, refers string, intact boolean, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def whole_characters(data: bytes, at: int) -> int:
    """``at`` moved back to where a UTF-8 character starts."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cuts(data: bytes, size: int, also: list[int]) -> list[int]:
    out, at = [0], 0
    for stop in [*sorted(also), len(data)]:
        while stop - at > size:
            at = whole_characters(data, at + size)
            out.append(at)
        if stop > at:
            out.append(stop)
            at = stop
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked framing, with a border inside every version line."""
    mark, inside, at = VERSION.encode(), [], payload.find(VERSION.encode())
    while at >= 0:
        inside.append(at + len(mark) // 2)
        at = payload.find(mark, at + 1)
    border = cuts(payload, size, inside)
    parts = [b"%x\r\n%s\r\n" % (b - a, payload[a:b]) for a, b in zip(border, border[1:])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The payload of chunked framing; NULL where the framing is broken or unfinished."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        out.append(data[at:at + size])
        if data[at + size:at + size + 2] != b"\r\n":
            return None
        at += size + 2


def escaped(value: str) -> str:
    """A header value that ends no line and holds no version mark, so that none can pass for the start of a record."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(VERSION, f"%{ord(VERSION[0]):02X}{VERSION[1:]}")


def record_texts(page_id, url, payload: bytes, sha1: str, keeper, keeper_sha1: str, tag: str, segment: int) -> list[str]:
    """The records of one page: a revisit, or a response and its continuations."""
    revisit = keeper is not None and keeper != page_id
    own = record_id(page_id, sha1)
    block = HTTP + (b"\r\n" if revisit else b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload))
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    border = cuts(block, segment, [])
    out = []
    for number, (a, b) in enumerate(zip(border, border[1:]), 1):
        first = number == 1
        head = [("WARC-Type", ("revisit" if revisit else "response") if first else "continuation"),
                ("WARC-Record-ID", own if first else record_id(page_id, f"{sha1}/{number}")), ("X-Row", tag)]
        if page_id is not None:
            head.append(("X-Page-Id", str(page_id)))
        if url is not None:
            head.append(("WARC-Target-URI", escaped(url)))
        if first:
            head.append(("WARC-Payload-Digest", "sha1:" + digest))
        if first and revisit:
            head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                     ("WARC-Refers-To", record_id(keeper, keeper_sha1))]
        if len(border) > 2:
            head.append(("WARC-Segment-Number", str(number)))
        if not first:
            head.append(("WARC-Segment-Origin-ID", own))
            if b == len(block):
                head.append(("WARC-Segment-Total-Length", str(len(block))))
        head.append(("Content-Length", str(b - a)))
        out.append(f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block[a:b].decode())
    return out


def write_warc(pages: DataFrame, path: str, *, revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of every row of ``pages`` (page_id, url, html) under ``path``.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes the one with the largest page_id is the response, all others
    revisit it; smaller payloads are always responses. NULL html is an empty payload, a NULL url leaves its header out. Rows
    without a page_id are written but are no response for others; repeated rows are written as often as they occur.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.sha2(html, 256).alias("content"), F.octet_length(html).alias("size"))
    groups = rows.where(F.col("size") >= revisit_bytes).groupBy("content", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(groups.where("n > 1").drop("n"), "repeated")  # its size on disk decides whether it is broadcast
    known = rows.join(repeated, ["content", "size"], "left")
    names = ["page_id", "url", "html", "sha1", "keeper"]

    def write(batches):
        task = TaskContext.get().partitionId()
        done = 0
        for part in K.slices(batches, "html"):
            out = []
            for page_id, url, text, sha1, keeper in zip(*(part.column(n).to_pylist() for n in names)):
                out += record_texts(page_id, url, text.encode(), sha1, keeper, sha1, f"{task}-{done}", segment_bytes)
                done += 1
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    records = K.map_arrow(known.select(*names), write, "value string")
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse_record(text: str) -> dict:
    """Headers and block of one record as read between separators."""
    head, _, block = text.partition(RECORD_END)
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.split("\r\n"))}
    body = block.encode()
    length = int(fields.get("content-length", "-1"))
    whole = body[length:] == RECORD_END.encode()
    digest = fields.get("warc-payload-digest", "")
    return {"origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")), "row_tag": fields.get("x-row"),
            "number": int(fields.get("warc-segment-number", "1")), "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
            "kind": fields.get("warc-type"), "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
            "digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None, "refers": fields.get("warc-refers-to"),
            "whole": whole, "segmented": "warc-segment-number" in fields, "body": body[:max(length, 0)]}


def assemble(pieces: list[dict]) -> dict:
    """One record from its segments in order: numbers without a gap, the stated total length, intact framing and digest."""
    first, last = pieces[0], pieces[-1]
    block = b"".join(p["body"] for p in pieces)
    intact = all(p["whole"] for p in pieces) and [p["number"] for p in pieces] == list(range(1, len(pieces) + 1))
    intact &= first["kind"] != "continuation" and (len(pieces) == 1 and last["total"] is None or last["total"] == len(block))
    head, _, body = block.partition(RECORD_END.encode())
    payload = None
    if first["kind"] == "response":
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        intact &= payload is not None and (first["digest"] is None or hashlib.sha1(payload).hexdigest() == first["digest"])
    return {"record_id": first["origin"], "page_id": first["page_id"], "record_type": first["kind"], "digest": first["digest"],
            "refers": first["refers"], "intact": bool(intact), "payload": payload if intact else None}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: ids, type, digest, what it refers to, whether it is intact, payload.

    Segments are grouped by the identifier of their origin, ordered by number, and joined only if none is missing and the
    total length is the stated one; records in one piece need no grouping. A broken record has a NULL payload and ``intact`` false. An empty folder gives no rows.
    """

    def parse(batches):
        for part in K.slices(batches, "value"):
            rows = [parse_record(t) for t in part.column("value").to_pylist() if t.strip()]
            columns = {n: [r[n] for r in rows] for n in ("origin", "row_tag", "number", "total", "kind", "page_id", "digest", "refers", "whole", "segmented", "body")}
            yield pa.RecordBatch.from_pydict({**columns, "number": pa.array(columns["number"], pa.int32()), "total": pa.array(columns["total"], pa.int64()),
                                              "page_id": pa.array(columns["page_id"], pa.int64()), "body": pa.array(columns["body"], pa.binary()),
                                              **{n: pa.array(columns[n], pa.string()) for n in ("origin", "row_tag", "kind", "digest", "refers")},
                                              **{n: pa.array(columns[n], pa.bool_()) for n in ("whole", "segmented")}})

    def join(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = [assemble(p) for p in batch.slice(start, min(64, batch.num_rows - start)).column("pieces").to_pylist()]
                kinds = {"record_id": pa.string(), "page_id": pa.int64(), "record_type": pa.string(), "digest": pa.string(), "refers": pa.string(),
                         "intact": pa.bool_(), "payload": pa.binary()}
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], k) for n, k in kinds.items()})

    lines = spark.read.schema("value string").option("lineSep", SEPARATOR).text(path)
    head = F.concat(F.lit("\r\n"), F.lower(F.substring_index("value", RECORD_END, 1)))
    lines = lines.withColumn("segmented", F.contains(head, F.lit("\r\nwarc-segment-number: ")))
    pieces, whole = (K.map_arrow(lines.where(F.col("segmented") == s).select("value"), parse, PIECES) for s in (True, False))
    fields = ["number", "total", "kind", "page_id", "digest", "refers", "whole", "body", "origin"]
    grouped = pieces.groupBy("origin", "row_tag").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"))
    single = whole.select(F.array(F.struct(*fields)).alias("pieces"))
    return K.map_arrow(grouped.select("pieces").unionByName(single), join, RECORDS)


def page_summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record; a revisit's come from its response.

    Without the payloads the records are written once, so that no archive is parsed again (runs a job).
    """
    light = cut_lineage(records.select("record_id", "page_id", "record_type", "digest", "refers", F.octet_length("payload").cast("bigint").alias("size")), "records")
    targets = light.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(
        F.first("page_id").alias("refers_to"), F.first("size").alias("full"))
    revisits = light.where("record_type = 'revisit'").join(targets, "refers", "left")
    plain = light.where("record_type <> 'revisit'").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                                           "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return plain.unionByName(revisits.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
