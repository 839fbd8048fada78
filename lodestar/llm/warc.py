"""WARC archives: one gzip member per record, written by tasks and read back in byte ranges."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import scratch, written

MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, path string, at long"
_NUMBERS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), _NUMBERS32, _BASE32)


def filesystem(uri: str):
    """An Arrow file system and the path in it; local, HDFS and object stores by their schemes."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record_bytes(row, date: str) -> bytes:
    """One record as a gzip member. Responses hold an HTTP head and the payload, revisits the head alone."""
    page = None if pd.isna(row.page_id) else int(row.page_id)
    payload = b"" if row.payload is None else bytes(row.payload)
    revisit = not pd.isna(row.refers_to)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {date}"]
    if row.url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c else "%%%02X" % ord(c) for c in row.url))
    head += [f"WARC-Payload-Digest: sha1:{row.payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{int(row.refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return member.compress(data) + member.flush()


def write_part(batches, folder: str, date: str, roll_bytes: int):
    """Writes a task's records to files named by its partition and attempt; a file appears under its name only when
    whole. Attempts that are repeated never touch each other's files, and the manifest names those of the attempt that Spark committed."""
    from pyspark import TaskContext

    context = TaskContext.get()
    system, root = filesystem(folder)
    out, stream, size, records = [], None, 0, 0

    def close():
        nonlocal stream
        stream.close()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId():08d}-{len(out):04d}.warc.gz"
        system.move(hidden, f"{root}/{name}")
        out.append((f"{folder}/{name}", size, records))
        stream = None

    for frame in batches:
        for row in frame.itertuples():
            if stream is None:
                hidden = f"{root}/_attempt-{context.taskAttemptId()}-{len(out)}"
                stream, size, records = system.open_output_stream(hidden), 0, 0
            data = record_bytes(row, date)
            stream.write(data)
            size, records = size + len(data), records + 1
            if size >= roll_bytes:
                close()
    if stream is not None:
        close()
    if out:
        yield pd.DataFrame(out, columns=["path", "bytes", "records"])


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 1 << 30,
) -> DataFrame:
    """Writes one record per page and returns the manifest: path, bytes, records of each file. Readers take the files from
    the manifest, since an attempt that failed or came second may have left others in the folder.

    Of the pages whose payloads are equal and have at least ``revisit_bytes`` bytes, that with the
    largest id is a response and the others are revisits of it; all other pages are responses.
    Digests with one page never meet the join that looks up the response; it is an equi-join
    that adaptive execution can split where many pages share a payload.

    Cases: null html is an empty payload; null urls are left out; null ids rank lowest, carry no id and are
    revisits if any page of theirs has an id; rows that repeat the largest id are all responses; an
    empty table gives no file; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    system, root = filesystem(folder)
    system.create_dir(root)
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", sha1_base32(F.col("payload")))
    many = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1 AND keeper IS NOT NULL").select("payload_digest", "keeper")
    other = F.when((F.octet_length("payload") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    linked = rows.join(many, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", other.alias("refers_to"))
    return written(linked.mapInPandas(lambda b: write_part(b, folder, date, roll_bytes), "path string, bytes long, records long"), "warc-manifest")


def parse_record(data: bytes) -> dict:
    """Fields of a decoded record: the named headers in lower case, and its HTTP payload."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = block[: int(fields.get("content-length", len(block)))]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def decode_member(source, at: int, size: int, probe: bool = False, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """The decoded gzip member at a place and where it ends; None if there is none or it is no WARC record.
    With `probe` it stops once the record's own header is decoded whole."""
    inflate, data, place = zlib.decompressobj(31), bytearray(), at
    while not inflate.eof:
        chunk = source.read_at(min(step, size - place), place)
        if not chunk:
            return None
        place += len(chunk)
        try:
            data += inflate.decompress(chunk)
        except zlib.error:
            return None
        if len(data) >= 7 and not data.startswith(b"WARC/1."):
            return None
        if probe and b"\r\n\r\n" in data:
            return bytes(data), place
    return (bytes(data), place - len(inflate.unused_data)) if data.startswith(b"WARC/1.") else None


def next_record(source, at: int, end: int, size: int, window: int = 1 << 20) -> int | None:
    """The first place from `at` and before `end` where a WARC record's member begins."""
    while at < end:
        chunk = source.read_at(min(window + len(MAGIC) - 1, size - at), at)
        found = chunk.find(MAGIC)
        while 0 <= found and at + found < end:
            if decode_member(source, at + found, size, probe=True):
                return at + found
            found = chunk.find(MAGIC, found + 1)
        at += window
    return None


def read_ranges(batches):
    """Records that begin in each (path, size, from, to) range; those reach beyond it if need be."""
    for frame in batches:
        for row in frame.itertuples():
            system, path = filesystem(row.path)
            with system.open_input_file(path) as source:
                at, out, held = next_record(source, row.start, row.end, row.bytes), [], 0
                while at is not None and at < row.end:
                    got = decode_member(source, at, row.bytes)
                    if got is None:  # a damaged member: look for the next one
                        at = next_record(source, at + 1, row.end, row.bytes)
                        continue
                    fields = parse_record(got[0])
                    revisit = fields.get("warc-type") == "revisit"
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    page, refers = fields.get("x-page-id"), fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                    payload = None if revisit else fields["payload"]
                    length = int(fields.get("x-payload-length", 0)) if revisit else len(payload)
                    out.append((page and int(page), fields.get("warc-target-uri"), fields.get("warc-type"), payload, length, digest, int(refers) if refers else None, row.path, at))
                    held += len(payload or b"")
                    at = got[1]
                    if len(out) >= 2000 or held >= 1 << 24:
                        yield _records(out)
                        out, held = [], 0
                if out:
                    yield _records(out)


def _records(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(files: DataFrame, split_bytes: int = 64 << 20, most_tasks: int = 100_000) -> DataFrame:
    """The records of gzip-per-record WARC files, given as (path, bytes) rows.

    Files are cut into ranges of ``split_bytes``; a task looks for gzip magic from the start of its
    range, takes a candidate only if it decodes to a WARC header, and then follows members to the last one that
    begins before the range ends. So each record has exactly one owner, wherever the cuts fall.

    Payloads are null for revisits, whose payload_bytes and payload_digest are those recorded with them.
    Damaged members are skipped. No files, no rows. Ranges are dealt to as many tasks as there are ranges, ``most_tasks`` at most.
    """
    starts = F.when(F.col("bytes") > 0, F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "bytes"))
    # a number given here is kept by adaptive execution, which would merge such small rows into one task
    tasks = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0)).cast("long")).first()[0]
    return ranges.repartition(max(1, min(tasks, most_tasks)), "path", "start").mapInPandas(read_ranges, RECORD)
