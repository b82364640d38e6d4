r"""WARC archives written by Spark and a salvage reader that survives damage.

Each record is a gzip member of its own. Files come from Spark's text writer, so they can go to any store that Spark reaches; the
writer's line end is an empty gzip member, which leaves a file a plain sequence of members. Of pages with equal payloads of
`min_revisit` bytes or more, the one with the smallest page_id is a response and the others are revisits of it.

The reader takes files as Spark's binaryFile source gives them. A record counts if it inflates, its version line and
headers parse, its length fits and its digests agree. After a failed check it looks for the next valid gzip member or version line,
goes on there, and logs the bytes between as a quarantined gap. Plain records outside members are read as well. In a member of
several records it looks for the next version line in the inflated content; such a gap has the member's offset and its own in
`inner`. Of a damaged member the records that inflated before the damage are kept, with length 0; its bytes are in a gap.

Files are bounded in bytes, as a reader takes a whole file at once. A page too long for one lies in a file of its own. Null html: an empty payload. Null page_id: written as `null`; such rows refer to the smallest id of their payload, and are responses
where there is none. Rows of the smallest id itself are all responses. Null url: no target line. Empty tables give no files' records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stash

EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
SHIFT = 1 << 16
FILE_BYTES = 32 << 20
SCHEMA = "kind string, path string, offset long, length long, inner long, reason string, record_type string, page_id long, uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_batches(file_bytes: int):
    """Members, each with the number of its file among its task's; a file ends before the record that would not fit."""

    def run(batches):
        file, size = 0, 0
        for b in batches:
            members, files = [], []
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                one = record(*r)
                if size and size + len(one) > file_bytes:
                    file, size = file + 1, 0
                size += len(one)
                members.append(gzip.compress(one, 4, mtime=0))
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(files, pa.int32())], ["member", "file"])

    return run


def plan_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for a response)."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = stash(rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-firsts")
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_revisit: int = 100, file_bytes: int = FILE_BYTES) -> None:
    """Archives whose records come to file_bytes at most before compression, but for a record that is larger alone.

    One pass over the pages; each task numbers its files, and those of one number share a folder `file=N`."""
    members = plan_records(pages, min_revisit).mapInArrow(_write_batches(file_bytes), "member binary, file int")
    lines = members.select(F.col("member").cast("string").alias("value"), "file").write.partitionBy("file")
    lines.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """(content, end, whether intact) of the gzip member at a position; of a damaged one what inflates before the damage, and its place."""
    d, out, pos, step = zlib.decompressobj(31), [], at, SHIFT
    while not d.eof and pos < len(data):
        before = d.copy()
        part = data[pos : pos + step]
        try:
            out.append(d.decompress(part))
        except zlib.error:
            if step == 1:
                return b"".join(out), pos, False
            d, step = before, max(1, step // 16)
            continue
        pos += len(part)
    return b"".join(out), pos - len(d.unused_data), d.eof


def _inner(content: bytes) -> tuple[list[tuple], list[tuple[int, str]]]:
    """([(headers, block)], [(place, what is wrong)]) of a member's content."""
    got, gaps, pos, open_gap = [], [], 0, False
    while 0 <= pos < len(content):
        r = _record_at(content, pos)
        if isinstance(r, str):
            if not open_gap:
                gaps.append((pos, r))
            open_gap = True
            pos = content.find(VERSION, pos + 1)
            continue
        got.append((r[0], r[1]))
        pos, open_gap = r[2], False
    return got, gaps


def _record_at(data, at: int) -> tuple[dict, bytes, int] | str:
    """(headers, block, end) of the plain record at a position, or what is wrong with it."""
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return "headers don't end"
    lines = data[at:head_end].split(b"\r\n")
    if not lines[0].startswith(VERSION):
        return "no version line"
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return "header without a colon"
        headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        return "no content length"
    start = head_end + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "length doesn't fit"
    block = bytes(data[start:end])
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha256:") and want[7:] != hashlib.sha256(block).hexdigest():
        return "block digest differs"
    if headers.get("warc-type") == "response":
        body, want = block.partition(b"\r\n\r\n")[2], headers.get("warc-payload-digest", "")
        if want.startswith("sha256:") and want[7:] != hashlib.sha256(body).hexdigest():
            return "payload digest differs"
    return headers, block, end + 4


def salvage(content: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, place in the member or None) that together cover
    the file; records and gaps of one member share its offset and length."""
    data, at, bad, why = memoryview(content), 0, None, ""
    head: list[tuple] = []  # records of a damaged member, whose bytes up to head_end may hold them once more as they are
    head_end = 0

    def next_start(after: int) -> int:
        found = [p for p in (content.find(MAGIC, after), content.find(VERSION, after)) if p >= 0]
        return min(found, default=len(content))

    while at < len(content):
        got, gaps, end, problem, after = [], [], at, "no member or version line", at + 1
        if content.startswith(MAGIC, at):
            inner, end, intact = _inflate(data, at)
            got, gaps = _inner(inner)
            if not intact:
                got = [g for g in got if at >= head_end or g not in head]
                if got:
                    if bad is not None:
                        yield "gap", bad, at - bad, why, None
                    for headers, block in got:
                        yield "record", at, 0, headers, block
                    bad, why, head, head_end = at, "damaged gzip member", got, end
                got, problem = [], "damaged gzip member"
            elif gaps and not got:
                problem, after = gaps[0][1], end
            else:
                problem = ""
        elif content.startswith(VERSION, at):
            r = _record_at(content, at)
            if isinstance(r, str):
                problem = r
            elif at < head_end and (r[0], r[1]) in head:
                problem, after = "damaged gzip member", r[2]
            else:
                got, end, problem = [(r[0], r[1])], r[2], ""
        if problem:
            if bad is None:
                bad, why = at, problem
            at = next_start(after)
            continue
        if bad is not None:
            yield "gap", bad, at - bad, why, None
            bad = None
        for headers, block in got:
            yield "record", at, end - at, headers, block
        for place, reason in gaps:
            yield "gap", at, end - at, reason, place
        at = end
    if bad is not None:
        yield "gap", bad, len(content) - bad, why, None


def _page(urn: str | None) -> int | None:
    part = (urn or "").rpartition(":")[2].rstrip(">")
    return int(part) if part.lstrip("-").isdigit() else None


def _read_batches(batches):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in SCHEMA.split(", ")])
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            rows = []
            for x in salvage(content.as_py()):
                row = dict.fromkeys(names) | {"kind": x[0], "path": path.as_py(), "offset": x[1], "length": x[2]}
                if x[0] == "gap":
                    row |= {"reason": x[3], "inner": x[4]}
                else:
                    h, (http, _, body) = x[3], x[4].partition(b"\r\n\r\n")
                    size = next((int(v) for k, _, v in (y.partition(b":") for y in http.split(b"\r\n")) if k.lower() == b"content-length"), None)
                    digest = h.get("warc-payload-digest")
                    row |= {"record_type": h.get("warc-type"), "page_id": _page(h.get("warc-record-id")), "uri": h.get("warc-target-uri"), "payload_digest": digest and digest.removeprefix("sha256:"), "payload_bytes": size, "refers_to": _page(h.get("warc-refers-to")), "payload": body}
                rows.append(row)
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_salvaging(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (kind: record or gap) of all archives under a path."""
    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read_batches, SCHEMA)
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, min_revisit)
    return read_salvaging(pages.sparkSession, path, payloads=False).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
