"""Web archives: written with an index first, read back by coalesced byte ranges.

Each page becomes a WARC 1.1 record in a gzip member of its own. The index has one row per record:
file, offset, length, URL, digest. A read takes any selection of index rows, sorts them by file and
offset, joins neighbours into ranges and reads each range at once.

Of pages with equal payloads, one is archived in full and the others as revisits that refer to it.
Tasks name their files by attempt; only files in the index, which holds those of finished tasks, are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import shared

FILE_BYTES, RANGE_BYTES, GAP_BYTES = 1 << 27, 1 << 23, 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, path string, offset long, length long"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(record: str | None) -> int | None:
    return int(record[len("<urn:page:") : -1]) if record and record.startswith("<urn:page:") else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record. A revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """page_id, url, digest, record_type, refers_to, payload_bytes and payload (None for a revisit) of a gzip member."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = h["warc-payload-digest"].partition(":")[2]
    revisit = h["warc-type"] == "revisit"
    if not revisit and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload of {h['warc-record-id']}")
    return {"page_id": page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "digest": digest, "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to")), "payload_bytes": n, "payload": None if revisit else payload}


def write(pages: DataFrame, min_revisit_bytes: int = 0, key: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Archives all of ``pages`` under ``folder`` (a new one in the shared folder by default); gives the index.

    Of pages with equal payloads of at least ``min_revisit_bytes``, that with the smallest id is the
    response and all others are revisits; a row that repeats the response's id is a response too.
    A null payload is an empty one, a very long one is one record. Pages without an id revisit one that has an id, if any. Ids are
    integers. Other columns are not looked at; an empty table makes no archive.
    """
    if not isinstance(pages.schema[key].dataType, T.IntegralType):
        raise ValueError(f"page ids have to be integers: {key}")
    folder = folder or shared.new_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.sha1(body).alias("sha"), body.alias("html"))
    copies = p.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # a written table, so that the join can split a payload with very many copies
    copies = shared.written(copies.filter("n > 1 AND first IS NOT NULL").select("sha", "first"), "copies")
    p = p.join(copies, "sha", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.file_system(folder)
        fs.create_dir(base)
        task, seq, out, path, at = TaskContext.get(), 0, None, "", 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                payload = r["html"].encode("utf-8", "surrogatepass")
                digest, revisit = base64.b32encode(bytes.fromhex(r["sha"])).decode(), r["refers_to"] is not None
                c = zlib.compressobj(level, wbits=31)
                data = c.compress(record(r["page_id"], r["url"], payload, digest, r["refers_to"], revisit, date)) + c.flush()
                if out is not None and at + len(data) > FILE_BYTES:
                    out.close()
                    out, seq = None, seq + 1
                if out is None:
                    path, at = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                out.write(data)
                rows.append((r["page_id"], r["url"], digest, "revisit" if revisit else "response", r["refers_to"], len(payload), path, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(_KINDS), _KINDS)], names=_NAMES)
        if out is not None:
            out.close()

    index = p.select("page_id", "url", "sha", "html", "refers_to").mapInArrow(archive, INDEX)
    scheme = folder.partition("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
    return shared.written(index, "cdx").withColumn("path", F.concat(F.lit(scheme), "path"))


def ranges(selected: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Rows (path, lo, size, members): selected records in file order, neighbours within ``gap`` bytes in one
    range of about ``most`` bytes. Sorting is within an archive file, whose size is bounded."""
    w = Window.partitionBy("path").orderBy("offset")
    end = F.col("offset") + F.col("length")
    far = (F.col("offset") - F.lag(end).over(w) > gap) | F.lag(end).over(w).isNull()
    s = selected.select("path", "offset", "length").withColumn("new", far.cast("int"))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("piece", F.expr(f"offset div {most}"))
    return s.groupBy("path", "run", "piece").agg(F.min("offset").alias("lo"), (F.max(end) - F.min("offset")).alias("size"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))


def read(selected: DataFrame, payloads: bool = False, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """The records of the index rows ``selected``, as parsed from the archives: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, if asked for, html (null for a revisit)."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string()] if payloads else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["html"] if payloads else [])]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            for r in b.to_pylist():
                fs, path = shared.file_system(r["path"])
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    opened = {path: fs.open_input_file(path)}
                f = opened[path]
                f.seek(r["lo"])
                data, rows = f.read(r["size"]), []
                for m in r["members"]:
                    at = m["offset"] - r["lo"]
                    x = parse(data[at : at + m["length"]])
                    rows.append((x["page_id"], x["url"], x["payload_bytes"], x["digest"], x["record_type"], x["refers_to"], *([x["payload"] and x["payload"].decode("utf-8", "surrogatepass")] if payloads else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for f in opened.values():
            f.close()

    todo = ranges(selected, gap, most)
    n = 4 * selected.sparkSession.sparkContext.defaultParallelism
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", html string" if payloads else "")
    return todo.repartition(n, "path", "lo").sortWithinPartitions("path", "lo").mapInArrow(records, schema)


def report(pages: DataFrame, **kw) -> DataFrame:
    """Archives all of ``pages`` and reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages, **kw)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
