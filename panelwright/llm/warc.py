"""Legacy archives to WARC: pages are held as ARC records (version 1 or 2 header lines with declared lengths), which
are parsed and written anew as WARC records with synthesised identifiers, timestamps, types and digests.

A NULL payload is an empty one. Equal payloads of at least `min_bytes` become one response, at the smallest record
key, and revisits of it; smaller payloads are responses each. Archives are plain files of about `archive_bytes`,
written by Spark's text writer in the shared folder (a record ends with two line ends, which is the writer's line
separator) and read back by their declared lengths, so payloads may hold anything, also header lines."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, shared_folder

END = b"\r\n"
ARCHIVE_BYTES = 16 << 20
DEFAULT_DATE = "20000101000000"


def arc_record(url: str, payload: bytes, version: int = 1, date: str = DEFAULT_DATE, kind: str = "text/html") -> bytes:
    """One ARC record: the header line of its version, then the payload of the length declared there."""
    url = "".join("%20" if c in " \t\r\n" else c for c in url or "-")
    fields = [url, "0.0.0.0", date, kind]
    if version == 2:
        fields += ["200", "-", "-", "0", "-"]
    return " ".join([*fields, str(len(payload))]).encode() + b"\n" + payload + b"\n"


def parse_arc(record: bytes) -> tuple[dict, bytes]:
    """Header fields and payload. Version 1 lines have 5 fields, version 2 lines 10; other lines are an error."""
    line, _, rest = record.partition(b"\n")
    fields = line.decode("utf-8", "surrogateescape").split(" ")
    if len(fields) not in (5, 10) or not fields[-1].isdigit() or int(fields[-1]) > len(rest):
        raise ValueError(f"not an ARC record: {line[:80]!r}")
    found = {"url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3], "version": 1 if len(fields) == 5 else 2}
    return found, rest[: int(fields[-1])]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{key}')}>"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_head(key, arc: dict, size: int, sha: str, refers_to) -> bytes:
    """Header block of a WARC record; a revisit declares no payload of its own."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {warc_date(arc['date'])}",
        f"WARC-Target-URI: {arc['url']}",
        f"WARC-IP-Address: {arc['ip']}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Source-Key: {key}",
        f"WARC-Payload-Length: {size}",
        f"Content-Type: {arc['type']}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"WARC-Refers-To-Key: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines.append(f"Content-Length: {size if refers_to is None else 0}")
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + END


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Records of one archive, by their declared lengths."""
    at = 0
    while at < len(data):
        head = data.index(END + END, at)
        lines = data[at:head].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = head + 4
        stop = start + int(fields["Content-Length"])
        yield fields, data[start:stop]
        at = stop + 4


def stored_arcs(batch: pa.RecordBatch) -> list[bytes]:
    """ARC records that a table holds in its column `arc`."""
    return batch.column("arc").to_pylist()


def pages_as_arcs(batch: pa.RecordBatch) -> list[bytes]:
    """Pages as ARC records: even keys in version 1, odd ones in version 2."""
    ids, urls, bodies = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
    return [arc_record(u, (b or "").encode(), 1 + k % 2) for k, u, b in zip(ids, urls, bodies)]


def describe(rows: DataFrame, arcs: Callable[[pa.RecordBatch], list[bytes]] = stored_arcs) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of every ARC record, parsed by its header line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_arc(a)[1] for a in arcs(batch)]
            yield pa.record_batch(
                [batch.column("page_id"), pa.array([digest(p) for p in found]), pa.array([len(p) for p in found], type=pa.int64())],
                names=["page_id", "payload_digest", "payload_bytes"],
            )

    return rows.mapInArrow(read, "page_id long, payload_digest string, payload_bytes long")


def first_pages(described: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to): the smallest page of equal payloads, for the pages that revisit it."""
    large = described.where(F.col("payload_bytes") >= min_bytes)
    # The smallest page is combined before the shuffle; only the small keys of pages are joined to it.
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return large.join(first.where("n > 1"), ["payload_digest", "payload_bytes"]).where("page_id > refers_to").select("page_id", "refers_to")


def write_warc(
    rows: DataFrame, refers: DataFrame, path: str, arcs: Callable[[pa.RecordBatch], list[bytes]] = stored_arcs, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """ARC records as WARC archives below `path`, a folder for each."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            names, records = [], []
            for key, arc, first in zip(batch.column("page_id").to_pylist(), arcs(batch), batch.column("refers_to").to_pylist()):
                fields, payload = parse_arc(arc)
                record = warc_head(key, fields, len(payload), digest(payload), first) + (payload if first is None else b"")
                if held and held + len(record) > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(record)
                names.append(archive)
                records.append(record.decode())
            yield pa.record_batch([pa.array(names, type=pa.int64()), pa.array(records, type=pa.string())], names=["archive", "value"])

    rows.join(refers, "page_id", "left").mapInArrow(convert, "archive long, value string").write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, payload in parse_warc(data.as_py()):
                    kind, first = fields["WARC-Type"], fields.get("WARC-Refers-To-Key")
                    if kind == "response" and digest(payload) != fields["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    rows.append(
                        {
                            "page_id": int(fields["WARC-Source-Key"]),
                            "payload_bytes": int(fields["WARC-Payload-Length"]),
                            "payload_digest": fields["WARC-Payload-Digest"][5:],
                            "record_type": kind,
                            "refers_to": None if first is None else int(first),
                            "record_id": fields["WARC-Record-ID"],
                            "date": fields["WARC-Date"],
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string())]
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string"
    return files.select("content").mapInArrow(read, kinds)


def convert_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC records, those to WARC archives in the shared folder, and their records read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/panelwright-warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    refers = cut_lineage(first_pages(describe(rows, pages_as_arcs), min_bytes))
    write_warc(rows, refers, path, pages_as_arcs, archive_bytes)
    return read_warc(spark, path)
