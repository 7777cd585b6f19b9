"""WARC archives: a writer with revisit records and a salvage reader.

Writing.  Payloads are grouped by SHA-1; in a group of payloads of at least
`min_bytes` the smallest id is a response and the others revisit it (a revisit's
HTTP header keeps the payload's length).  Each record is a gzip member of its own.
Spark's text writer stores the members of one archive as one value, so archives
land wherever Spark can write; the separator it needs is a zero byte, which gzip
takes for padding at the end of a file.

Reading.  An archive is checked member by member, or record by record if it is
not compressed: the gzip checksum, the version line, a whole header with its
mandatory fields, the content length, the closing blank lines, and the block and
payload digests.  After a failed check the reader searches for the next gzip
member or version line that passes all checks, goes on from there, and reports
the bytes between as a gap.  A gzip member that is damaged or cut short gives the
whole records before the damage; if only its checksum fails and no record in it does,
nothing tells where the damage is and all of it is a gap.  A gap inside a member has
its place in the inflated bytes too.  A damaged archive therefore costs the damaged
records only.  Archives are read whole, one at a time; the writer starts a new one at
`FILE_BYTES`.

Defined cases: a null payload is empty; rows with a null id are responses; rows
with the smallest id are all responses if that id is repeated; null addresses are
left out of the header; line ends in addresses are percent-encoded; headers may have
any length, and only line feeds (with or without a carriage return) end their lines,
so addresses keep all other characters; an empty table gives no archives and no rows; extra columns are ignored.
"""

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, slices

#: Compressed bytes after which an archive ends.
FILE_BYTES = 8 << 20
START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r?\n")
VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
HEADER_END = re.compile(rb"\r?\n\r?\n")
PADDING = re.compile(rb"\0+")
END = b"\r\n\r\n"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: str, url: str | None, digest: str, size: int, payload: bytes | None, refers: str | None, date: str) -> bytes:
    """One uncompressed WARC record of an HTTP response or of a revisit without payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + END + block + END


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for each row to archives under `path`."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{url_col}`").cast("string").alias("_url"),
        F.coalesce(as_bytes(body_col), F.lit("").cast("binary")).alias("_text"),
    ).withColumn("_sha", F.unhex(F.sha1("_text")))
    again = (
        rows.where(F.length("_text") >= min_bytes)
        .groupBy("_sha")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_sha", "_first")
    )
    known = rows.join(again, "_sha", "left").withColumn("_size", F.length("_text").cast("long"))
    revisit = F.coalesce(F.col("_id") != F.col("_first"), F.lit(False)) & (F.col("_size") >= min_bytes)
    known = known.select(
        F.col("_id").cast("string").alias("id"),
        F.col("_url").alias("url"),
        F.col("_sha").alias("sha"),
        F.col("_size").alias("size"),
        F.when(revisit, F.col("_first").cast("string")).alias("refers"),
        F.when(~revisit, F.col("_text")).alias("_text"),
    )

    def archives(batches):
        parts, size = [], 0
        for batch in slices(batches):
            for row in batch.to_pylist():
                refers = row["refers"]
                kind = "response" if refers is None else "revisit"
                digest = base64.b32encode(row["sha"]).decode()
                data = record(kind, row["id"] or "", row["url"], digest, row["size"], row["_text"], refers, date)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                parts.append(member.compress(data) + member.flush())
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])

    made = known.mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


class Reason(str):
    """A failed check; `inside` is (offset, length) in the inflated member, if the gap lies in one."""

    inside: tuple[int, int] | None = None


def member_at(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What can be inflated of the gzip member at a place, where that ends, and `whole`, `cut`, `damaged` or `checksum`."""
    inflate, out, view, begin = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not inflate.eof:
            if at >= len(data):
                return b"".join(out), at, "cut"
            piece = view[at : at + (1 << 16)]
            out.append(inflate.decompress(piece))
            at += len(piece)
    except zlib.error:
        # Once more up to this piece, and then byte by byte up to the damage.
        inflate = zlib.decompressobj(31)
        out = [inflate.decompress(view[begin:at])]
        try:
            while True:
                out.append(inflate.decompress(view[at : at + 1]))
                at += 1
        except zlib.error as error:
            return b"".join(out), at, "checksum" if "incorrect" in str(error) else "damaged"
    return b"".join(out), at - len(inflate.unused_data), "whole"


def record_at(data: bytes, at: int) -> tuple[dict | str, int]:
    """The record at a place and where it ends, or the check that failed."""
    version = VERSION.match(data, at)
    if not version:
        return "version line", at
    # Line by line up to the empty one: a bad line ends the search, so it never goes far in damaged data.
    fields, begin = {}, version.end()
    while True:
        stop = data.find(b"\n", begin)
        if stop < 0:
            return "header", at
        line, begin = data[begin:stop].removesuffix(b"\r"), stop + 1
        if not line:
            break
        name, colon, value = line.partition(b":")
        if not colon:
            return "header", at
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip(b" \t\r").decode("utf-8", "replace")
    if not MANDATORY <= fields.keys():
        return "mandatory field", at
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        return "content length", at
    stop = begin + int(length)
    if data[stop : stop + 4] != END:
        return "record end", at
    block = data[begin:stop]
    if not matches(fields.get("warc-block-digest"), block):
        return "block digest", at
    head, payload = HEADER_END.search(block), block
    http = "application/http" in fields.get("content-type", "") and head
    if http:
        payload = block[head.end() :]
    size = len(payload)
    if fields.get("warc-type") == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", block[: head.start()]) if http else None
        size = int(told[1]) if told else None
    elif not matches(fields.get("warc-payload-digest"), payload):
        return "payload digest", at
    return {"fields": fields, "payload": payload, "size": size}, stop + 4


def matches(told: str | None, data: bytes) -> bool:
    """Whether a digest header holds; other algorithms than SHA-1 are not checked."""
    return told is None or not told.lower().startswith("sha1:") or told[5:].upper() == sha1_base32(data)


def salvage(data: bytes):
    """(offset, end, record) of all records that pass the checks and (offset, end, reason) of all gaps."""
    at, lost, why = 0, None, ""

    def step(at: int):
        if data[at : at + 2] == b"\x1f\x8b":
            inner, stop, state = member_at(data, at)
            found = list(salvage(inner))
            good = [x for *_, x in found if isinstance(x, dict)]
            if state in ("damaged", "checksum"):
                # Without a failed record or a digest, nothing tells that a record is intact.
                proven = all((x["fields"].get("warc-block-digest") or "").lower().startswith("sha1:") for x in good)
                if not proven or state == "checksum" and len(good) == len(found):
                    return "gzip member", at
            # A member with nothing valid in it is damaged as a whole.
            if not good:
                return "member content" if state == "whole" else "gzip member", at
            for k, (a, b, x) in enumerate(found):
                if isinstance(x, str):
                    found[k] = a, b, Reason(x)
                    found[k][2].inside = a, b - a
            return [(at, stop, x) for *_, x in found], stop, state
        got, stop = record_at(data, at)
        return (got, stop) if isinstance(got, str) else ([(at, stop, got)], stop, "whole")

    while at < len(data):
        if lost is None and data[at] == 0:  # padding
            at = PADDING.match(data, at).end()
            continue
        got, stop, *state = step(at)
        if isinstance(got, str):
            if lost is None:
                lost, why = at, got
            again = START.search(data, at + 1)
            at = again.start() if again else len(data)
            continue
        if lost is not None:
            yield lost, at, why
            lost = None
        yield from got
        at = stop
        if state != ["whole"]:  # the rest of the member, which may be empty
            lost, why = stop, "gzip member"
    if lost is not None:
        yield lost, len(data), why


READ = (
    "file string, offset long, length long, kind string, page string, url string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, reason string, "
    "inside_offset long, inside_length long"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records (kind = the WARC type) and gaps (kind `gap`, with the failed check in `reason`) of all archives."""
    names = [f.split()[0] for f in READ.split(", ")]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for start, stop, got in salvage(data.as_py()):
                    row = dict.fromkeys(names) | {"file": file, "offset": start, "length": stop - start}
                    if isinstance(got, str):
                        row |= {"kind": "gap", "reason": str(got)}
                        row["inside_offset"], row["inside_length"] = getattr(got, "inside", None) or (None, None)
                    else:
                        fields = got["fields"]
                        row |= {
                            "kind": fields.get("warc-type"),
                            "page": page_of(fields.get("warc-record-id")),
                            "url": fields.get("warc-target-uri"),
                            "refers_to": page_of(fields.get("warc-refers-to")),
                            "payload_digest": (fields.get("warc-payload-digest") or "sha1:" + sha1_base32(got["payload"]))[5:],
                            "payload_bytes": got["size"],
                            "payload": got["payload"] if payloads and fields.get("warc-type") != "revisit" else None,
                        }
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield arrow(rows)
                        rows, held = [], 0
                if rows:
                    yield arrow(rows)

    def page_of(ref: str | None) -> str | None:
        found = re.fullmatch(r"<(?:urn:page:)?(.*)>", ref or "")
        return (found[1] or None) if found else ref

    def arrow(rows):
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*f.split())) for f in READ.split(", ")]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    files = spark.read.format("binaryFile").load(path) if _any(spark, path) else spark.createDataFrame([], "path string, content binary")
    return files.select("path", "content").mapInArrow(run, READ)


def _any(spark: SparkSession, path: str) -> bool:
    """Whether there is an archive at all: an empty table leaves a folder without data files."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(where)
    return any(not f.getPath().getName().startswith(("_", ".")) for f in found)
