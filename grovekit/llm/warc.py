"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader checks each record: the gzip member's checksum, the version line, the header, the length and the block
digest. Where a check fails it searches for the next gzip member or version line that passes all of them, goes on
from there, and logs the bytes between as a quarantined gap. It does so in the content of a member too, also in what
comes before a data error or a cut end."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import filesystem, scratch, staged, text_batches, tidied

#: Payloads below this size are never written as revisits.
REVISIT_BYTES = 1000
#: An archive file is closed when it has this many bytes.
ARCHIVE_BYTES = 8 << 20
#: The content of a gzip member up to this size is kept; that of larger ones is expanded again as records are read.
HELD_BYTES = 1 << 26
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "name string, bytes long, records long"
RECORDS = (
    "path string, start long, end long, gap_reason string, record_type string, page_id long, url string,"
    " payload_bytes long, payload_digest string, refers_to long, payload binary,"
    " member_from long, member_to long"
)
_MAGIC = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PAGE = "<urn:x-page:%d>"


# ---- records -------------------------------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header and leaves the payload out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Date": "1970-01-01T00:00:00Z"}
    head["WARC-Record-ID"] = f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else _PAGE % page_id
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Refers-To": _PAGE % refers_to, "WARC-Profile": PROFILE}
    head |= {"WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class Damaged(ValueError):
    pass


class Short(Damaged):
    """The data ends before the record does."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The header fields (names in lower case), the block and the end of the record at `at`; Damaged if a check fails."""
    if not _VERSION.match(data, at):
        raise (Short if len(data) - at < 10 else Damaged)("no version line")
    fields, name, stop = {}, "", data.find(b"\r\n", at)
    while True:
        line_at, stop = stop + 2, data.find(b"\r\n", stop + 2)
        if stop < 0:
            raise Short("header without an end")
        if stop == line_at:
            break
        line = data[line_at:stop].decode("utf-8", "replace")
        if line[0] in " \t" and name:  # a folded line goes on with the field before
            fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damaged("header line without a colon")
        fields[name] = value.strip()
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        raise Damaged("no content length")
    begin = stop + 2
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise (Short if end + 4 > len(data) else Damaged)("block of another length")
    block = data[begin:end]
    if (want := _digest(fields)) and hashlib.sha1(block).hexdigest() != want:
        raise Damaged("block digest")
    return fields, block, end + 4


def _digest(fields: dict[str, str]) -> str | None:
    """The block digest that a record can be checked by, in hexadecimal: SHA-1, written so or in base 32."""
    kind, _, want = fields.get("warc-block-digest", "").partition(":")
    if kind.strip().lower() != "sha1":
        return None
    want = want.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", want):
        return want.lower()
    return base64.b32decode(want.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", want) else None


def _member(data: bytes, at: int) -> tuple[int, str | None, list[bytes] | None]:
    """The end of the gzip member at `at`, what is wrong with it, and its content if it is small and nothing is."""
    expand, parts, size, pos = zlib.decompressobj(31), [], 0, at
    while not expand.eof:
        if pos >= len(data):
            return pos, "member cut short", None
        try:
            part = expand.decompress(data[pos : pos + 65536])
        except zlib.error as e:
            return pos, "member checksum" if "check" in str(e) else "member data", None
        pos += 65536
        size += len(part)
        if size > HELD_BYTES:
            parts = None
        elif parts is not None:
            parts.append(part)
    return min(pos, len(data)) - len(expand.unused_data), None, parts


def _expanded(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The content of a sound member in parts, each with the place in data up to which it is expanded."""
    expand = zlib.decompressobj(31)
    for pos in range(at, end, 65536):
        yield expand.decompress(data[pos : min(pos + 65536, end)]), min(pos + 65536, end)


def _before_damage(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """The same of a damaged member, up to the damage. No part reaches beyond a place where another member or a plain
    record may begin, so the search can go on where a part ends."""
    expand, pos, later = zlib.decompressobj(31), at, _NEXT.search(data, at + 1)
    while pos < len(data) and not expand.eof:
        if later and later.start() <= pos:
            later = _NEXT.search(data, pos + 1)
        end = min(pos + 65536, later.start() if later else len(data))
        before = expand.copy()
        try:
            yield expand.decompress(data[pos:end]), end
        except zlib.error:
            for i in range(pos, end):
                try:
                    yield before.decompress(data[i : i + 1]), i + 1
                except zlib.error:
                    return
        pos = end


def _records(parts: Iterator[tuple[bytes, int]], unchecked: bool) -> Iterator[tuple[int, int, int, str | None, dict | None, bytes | None]]:
    """(place, from, to, reason, fields, block) per record and per gap of a member's content: `from` and `to` count in
    the content, `place` is up to where data was expanded for it. Without `unchecked` only records with a block digest
    are taken. Memory follows the longest record, or the content from a header that claims a longer block than there is."""
    held, base, at, place, over = b"", 0, 0, 0, False
    gap, reason = None, ""

    def more(least: int) -> None:
        nonlocal held, base, at, place, over
        got, n = [held[at:]], 0
        base, at = base + at, 0
        while n < least:
            part, where = next(parts, (None, 0))
            if part is None:
                over = True
                break
            got.append(part)
            n, place = n + len(part), where
        held = b"".join(got)

    more(1)
    while at < len(held):
        try:
            fields, block, end = parse_record(held, at)
            if not unchecked and not _digest(fields):
                raise Damaged("record without a digest in a damaged member")
        except Damaged as e:
            if isinstance(e, Short) and not over:
                more(max(1, len(held) - at))  # twice as much each time
                continue
            if gap is None:
                gap, reason = base + at, str(e)
            while not (later := _VERSION.search(held, at + 1)) and not over:
                at = max(at, len(held) - 10)  # a version line may go on in the next part
                more(65536)
            at = later.start() if later else len(held)
            continue
        if gap is not None:
            yield place, gap, base + at, reason, None, None
            gap = None
        yield place, base + at, base + end, None, fields, block
        at = end
        if at >= len(held) and not over:
            more(1)
    if gap is not None:
        yield place, gap, base + len(held), reason, None, None


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None, bytes | None, tuple[int, int] | None]]:
    """(start, end, None, fields, block, within) per record and (start, end, reason, None, None, within) per quarantined
    gap, in order.

    Together they cover every byte but the line ends between plain records. A member may hold several records; they
    share its start and end, and `within` has their places in its content, as it has those of gaps between them. Records
    before the damage of a member end where it had been read that far, and the gap begins there; after a failed check
    of the member only those with a block digest count."""
    pos, gap, reason, within = 0, None, "", None
    while pos < len(data):
        bad = None  # why nothing, or nothing more, is found at pos
        plain = not data.startswith(_MAGIC, pos)
        if plain:
            try:
                fields, block, end = parse_record(data, pos)
                found = iter([(end, 0, 0, None, fields, block)])
            except Damaged as e:
                found, bad = iter(()), str(e)
        else:
            end, bad, parts = _member(data, pos)
            if bad:
                found = _records(_before_damage(data, pos), bad == "member cut short")
            else:
                found = _records(iter([(b"".join(parts), end)]) if parts is not None else _expanded(data, pos, end), True)
        start, to, waiting, records = pos, 0, [], 0
        for place, a, b, why, fields, block in found:
            if why:
                waiting.append((a, b, why))  # the last one may go on behind the member
                continue
            if gap is not None:
                yield gap, start, reason, None, None, within
                gap = None
            records += 1
            pos, to = place if bad else end, b
            for x, y, w in waiting:
                yield start, pos, w, None, None, (x, y)
            waiting = []
            yield start, pos, None, fields, block, None if plain else (a, b)
        if records and not bad:
            for x, y, w in waiting:
                yield start, end, w, None, None, (x, y)
            while data[pos : pos + 2] == b"\r\n":
                pos += 2
            continue
        if gap is None:
            gap, reason = pos, bad or (waiting[0][2] if waiting else "empty member")
            within = (to, waiting[-1][1]) if records and waiting else None
        if not bad:
            pos = end  # the whole content was searched
            continue
        later = _NEXT.search(data, pos if records else pos + 1)
        pos = later.start() if later else len(data)
    if gap is not None:
        yield gap, len(data), reason, None, None, within


# ---- Spark ---------------------------------------------------------------------------------------------------------


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, payload_bytes, payload_digest and refers_to (null: a response).

    Pages without an id are responses and nothing refers to them. A null page is an empty one. Repeated rows are
    records of their own: those with the largest id of their payload are responses, the others revisits. Very long
    pages and urls count whole; an empty table gives an empty one; other columns, whatever their names, play no part."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "_key": F.xxhash64("payload")}
    )
    same = ["payload_digest", "payload_bytes", "_key"]
    kept = (
        found.filter((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
        .groupBy(*same)
        .agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    # written first, so that both sides of the join are plain exchanges and Spark can split a hot payload
    joined = found.join(staged(kept, "warc-kept"), same, "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("_kept"), F.col("_kept"))).drop("_kept", "_key")


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/_staged", recursive=True)
        out, name, size, n = None, "", 0, 0
        done = []

        def close():
            nonlocal out
            if out:
                out.close()
                done.append((name, size, n))
                out = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for row in zip(*columns):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/_staged/{name}", compression=None)
                member = gzip.compress(record_bytes(*(x.as_py() for x in row)), 6, mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "bytes", "records"]
        )

    return tidied(run)


def _publish(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                # a task that runs again finds what it has moved already
                if fs.get_file_info(f"{base}/{name}").type.name == "NotFound":
                    fs.move(f"{base}/_staged/{name}", f"{base}/{name}")
            yield batch

    return run


def write_warc(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of plan_revisits() to archives in folder, a URI that all executors reach; returns the
    table of archives. Each attempt of a task writes files of its own to a hidden folder; only those that the committed
    table names are moved out of it, so a lost executor leaves no record twice. A task holds one record at a time; an
    empty table gives no archive."""
    text_batches(planned.sparkSession)
    planned = planned.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    written = staged(planned.mapInArrow(_write(folder, archive_bytes), WRITTEN), "warc-written")
    return staged(written.mapInArrow(_publish(folder), WRITTEN), "warc-published")


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ") for x in x.split(",")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def page(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def row(path, start, end, reason, fields, block, within):
        within = within or (None, None)
        if fields is None:
            return path, start, end, reason, None, None, None, None, None, None, None, *within
        kind, (head, _, payload) = fields.get("warc-type"), block.partition(b"\r\n\r\n")
        if kind == "revisit":
            length = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
            size, digest = int(length[1]) if length else None, fields.get("warc-payload-digest", "").partition(":")[2] or None
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        refers = page(fields.get("warc-refers-to")) if kind == "revisit" else None
        return path, start, end, None, kind, page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, refers, payload if with_payload else None, *within

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                part, held = [], 0
                for found in salvage(content.as_py()):
                    part.append(row(path, *found))
                    held += len(part[-1][10] or b"") + 200
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names)

    return tidied(run)


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record and per quarantined gap (gap_reason set) of the archives in folder.

    Places are those in the file; member_from and member_to those in the content of a member. Empty files give no rows;
    a file that is damaged throughout gives one gap."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORDS)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. Fails if the reader finds a gap or another number of records."""
    folder = scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    written = write_warc(plan_revisits(pages), folder).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = staged(read_warc(spark, folder, with_payload=False).drop("payload", "url"), "warc-read")
    read, gaps = found.agg(F.count_if(F.col("gap_reason").isNull()), F.count_if(F.col("gap_reason").isNotNull())).first()
    if gaps or read != written:
        raise RuntimeError(f"{written} records were written to {folder}; {read} and {gaps} gaps were read")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM k
"""
