"""Web archives: writing, reading, and converting legacy ARC files to WARC.

ARC files (versions 1 and 2) are read by their header lines and declared lengths. Each record becomes a
WARC record whose id, time, type and digests are synthesised from the record itself, so that a second
conversion gives the same bytes. Payloads seen before become ``revisit`` records that refer to the one
``response`` of their digest, repeat its HTTP headers and tell the payload's size in a header of their own.

Archives are written by tasks, straight into the shared folder, with a name that depends on the input
partition alone and a rename at the end: a task that runs again replaces its own file. Only an index
(id, file, place, digest) is shuffled, never payloads. A file ends after ``ROLL`` bytes. A compressed file and one of its gzip
members (by the formats' custom a record each) are held at once.

A record's place is where its gzip member begins in the file and where its header line begins in the member's content, so it stays the
same whatever happens to other records. Damaged records (a header line that can't be read, a declared length beyond the member's end, a
payload that doesn't match its digest) are skipped and counted; reading goes on at the next line that is a record's header. Of a broken
member what came out before the break is read, and reading goes on at the next gzip header that opens a whole member. Where the file's own
record is lost, the version is told by each header line. ``archive`` tells what was lost; the query raises if any record is.

Defined results: null html is an empty payload; null urls are written as an empty target; spaces and
control characters in urls are escaped; repeated page ids keep a record each, a null id has its own
mark; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch, skew

#: Uncompressed bytes after which an archive file ends.
ROLL = 16 << 20
LEVEL = 1
_SPACE = uuid.UUID("6f1f0b9e-0c8e-4c5c-9d55-2f3b8a6a0d11").int >> 64 << 64
_NULL_SPACE = uuid.UUID("6f1f0b9f-0c8e-4c5c-9d56-2f3b8a6a0d12").int >> 64 << 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ids, dates, digests -------------------------------------------------------------------------


def record_id(key: int | None) -> str:
    """A record id that tells its key."""
    return f"<urn:uuid:{uuid.UUID(int=_NULL_SPACE if key is None else _SPACE | (key & 0xFFFFFFFFFFFFFFFF))}>"


def key_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 64 << 64 == _NULL_SPACE:
        return None
    low = n & 0xFFFFFFFFFFFFFFFF
    return low - (1 << 64) if low >> 63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date."""
    digits = (re.sub(r"\D", "", arc_date) + "0101000000"[max(0, len(re.sub(r"\D", "", arc_date)) - 4) :])[:14]
    try:
        return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def escaped(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


# --- ARC -----------------------------------------------------------------------------------------

FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}


def arc_preamble(name: str, version: int = 1) -> bytes:
    body = f"{version} 0 fathom\n".encode() + {1: b"URL IP-address Archive-date Content-type Archive-length\n", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}[version]
    head = {1: f"filedesc://{name} 0.0.0.0 19960923142103 text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 19960923142103 text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return head.encode() + body + b"\n"


def arc_record(url: str, ip: str, date: str, kind: str, block: bytes, version: int = 1, offset: int = 0, name: str = "-") -> bytes:
    rest = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{rest} {len(block)}\n".encode("utf-8", "surrogateescape") + block + b"\n"


class Damage:
    """How many records a reader had to skip; without one, readers raise."""

    def __init__(self):
        self.n = 0


def _skipped(damage: Damage | None, why: str, first: bool = True) -> None:
    if damage is None:
        raise ValueError(why)
    damage.n += first


def _line(file: BinaryIO, damage: Damage | None) -> bytes:
    """The next line; none where the stream is broken or ends."""
    try:
        return file.readline()
    except (OSError, EOFError, zlib.error) as e:
        _skipped(damage, f"archive broken: {e}")
        return b""


def _block(file: BinaryIO, size: int, damage: Damage | None) -> bytes | None:
    try:
        block = file.read(size)
    except (OSError, EOFError, zlib.error):
        block = b""
    if len(block) < size:
        _skipped(damage, "record cut short")
        return None
    return block


def _fields(text: str, version: int) -> dict[str, str] | None:
    """The fields of a header line, or nothing where it is none. The url may hold spaces, the other fields may not."""
    values = text.rsplit(" ", len(FIELDS[version]) - 1)
    if len(values) != len(FIELDS[version]) or not re.fullmatch("[0-9]{1,15}", values[-1]) or not re.fullmatch("[0-9]{8,14}", values[2]):
        return None
    return dict(zip(FIELDS[version], values))


class _Arc:
    """Reads the records of one ARC file's streams; remembers the version that the file's own record tells."""

    def __init__(self, damage: Damage | None):
        self.damage, self.version = damage, 0

    def records(self, file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(where the header line begins, header fields, block) of each record but the file's own."""
        lost = False
        while True:
            begins = file.tell()
            line = _line(file, self.damage)
            if not line:
                return
            text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
            if not text:
                continue
            own = not self.version and text.startswith("filedesc:")
            if own:
                size = text.rsplit(" ", 1)[-1]
                fields = {"length": size} if re.fullmatch("[0-9]{1,15}", size) else None
            else:
                fields = _fields(text, self.version) if self.version else _fields(text, 2) or _fields(text, 1)
            if fields is None:
                _skipped(self.damage, f"not an ARC header line: {text[:200]!r}", not lost)
                lost = True
                continue
            lost = False
            block = _block(file, int(fields["length"]), self.damage)
            if block is None:
                return
            if own:
                told = block.split(b" ", 1)[0]
                if told not in (b"1", b"2"):
                    _skipped(self.damage, f"unknown ARC version {told[:20]!r}")
                else:
                    self.version = int(told)
                continue
            yield begins, fields, block


def read_arc(file: BinaryIO, damage: Damage | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the file's own, whose second line tells the version. The bytes of a url that
    aren't UTF-8 are kept as they are (as surrogates)."""
    for _, fields, block in _Arc(damage).records(file):
        yield fields, block


def members(data: bytes, damage: Damage | None = None) -> Iterator[tuple[int, bytes]]:
    """(where it begins, content) of each gzip member of a file; of a broken one what came out before the break. One break counts once."""
    at, broken = 0, False
    while at < len(data):
        unpack, parts, read = zlib.decompressobj(wbits=31), [], at
        try:
            while not unpack.eof and read < len(data):
                piece = data[read : read + 65536]
                parts.append(unpack.decompress(piece))
                read += len(piece)
        except zlib.error:
            pass
        if unpack.eof:
            yield at, b"".join(parts)
            at, broken = read - len(unpack.unused_data), False
            continue
        _skipped(damage, "broken gzip member", not broken)
        if not broken and parts:
            yield at, b"".join(parts)
        broken = True
        at = data.find(b"\x1f\x8b\x08", at + 1)
        if at < 0:
            return


def arc_records(data: bytes, damage: Damage | None = None) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(place, header fields, block) of each record of a gzipped ARC file."""
    arc = _Arc(damage)
    for begins, content in members(data, damage):
        for inside, fields, block in arc.records(io.BytesIO(content)):
            yield f"{begins}:{inside}", fields, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers (with the empty line) and payload."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 and block.startswith(b"HTTP/") else (b"", block)


# --- WARC ----------------------------------------------------------------------------------------


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(file: BinaryIO, damage: Damage | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    lost = False
    while line := _line(file, damage):
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            _skipped(damage, f"not a WARC record: {line[:100]!r}", not lost)
            lost = True
            continue
        lost, fields = False, {}
        while (line := _line(file, damage)) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        if not re.fullmatch("[0-9]{1,15}", fields.get("content-length", "")):
            _skipped(damage, "WARC record without a length")
            lost = True
            continue
        block = _block(file, int(fields["content-length"]), damage)
        if block is None:
            return
        yield fields, block


def warc_records(data: bytes, damage: Damage | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzipped WARC file."""
    for _, content in members(data, damage):
        yield from read_warc(io.BytesIO(content), damage)


def convert(header: dict[str, str], block: bytes, key: int | None, response: int | None, revisit: bool) -> bytes:
    """The WARC record for an ARC record: a response, or a revisit of the record ``response``."""
    http, payload = split_http(block)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", warc_date(header["date"])),
        ("WARC-Target-URI", header["url"]), ("WARC-IP-Address", header["ip"]), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response)), ("WARC-Payload-Length", str(len(payload)))]
        block = http
    kind = "application/http; msgtype=response" if http else header["type"]
    return warc_record([*fields, ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", kind)], block)


# --- archive files in the shared folder ----------------------------------------------------------


class _Writer:
    """Gzipped files, one member a record, each complete before it gets its name."""

    def __init__(self, folder: str, stem: str, suffix: str, preamble=None, roll: float = ROLL):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stem, self.suffix, self.preamble, self.roll = stem, suffix, preamble, roll
        self.n, self.out = 0, None

    def add(self, record: bytes) -> tuple[str, str]:
        """The name of the record's file and its place there."""
        if self.out is None:
            self.name, self.at, self.size = f"{self.stem}-{self.n:05d}.{self.suffix}.gz", 0, 0
            self.temporary = f"{self.folder}/.{self.name}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary)
            if self.preamble:
                self._member(self.preamble(self.name))
        name, place = self.name, f"{self.at}:0"
        self._member(record)
        self.size += len(record)
        if self.size >= self.roll:
            self.close()
        return name, place

    def _member(self, data: bytes) -> None:
        packer = zlib.compressobj(LEVEL, wbits=31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"{self.folder}/{self.name}"
            if self.fs.get_file_info(name).type != fs.FileType.NotFound:
                self.fs.delete_file(name)  # of an earlier attempt; some file systems don't rename onto a file
            self.fs.move(self.temporary, name)
            self.n, self.out = self.n + 1, None


def _content(folder: str, name: str) -> bytes:
    """A file as it is, compressed."""
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/{name}", compression=None) as source:
        return source.read()


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20240101000000") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC files; their index: key, file, place, digest, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, f"part-{TaskContext.get().partitionId():06d}", "arc", lambda name: arc_preamble(name, version))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for key, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                    payload = (html or "").encode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    file, place = out.add(arc_record(escaped(url), "0.0.0.0", date, "text/html", http + payload, version))
                    rows.append((key, file, place, digest(payload), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], ["key", "file", "place", "digest", "bytes"])
        out.close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "key long, file string, place string, digest string, bytes long")


def plan_revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The index (a stored table) with what each record becomes: the largest key of a digest stays a response. Digests are grouped in tasks
    before the shuffle; a digest that very many records have is looked up where they lie, so it gathers nowhere."""
    first = scratch.table(index.groupBy("digest").agg(F.count("*").alias("_n"), F.max(F.when(F.col("bytes") >= min_bytes, F.col("key"))).alias("response")), "digests")
    joined = skew.looked_up(index, first, ["digest"], "_n")
    revisit = (F.col("bytes") >= min_bytes) & F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response"))
    return joined.select("key", "file", "place", "response", revisit.alias("revisit"))


def tasks_for(files: int) -> int:
    """How many tasks so many archive files are dealt to; files are of bounded size."""
    return max(1, min(files, 4096), files // 64)


def convert_archives(plan: DataFrame, arc_folder: str, warc_folder: str) -> DataFrame:
    """Convert ARC files as planned; file (written), records written, planned and damaged. A task reads whole files, each of bounded size.
    ``plan``: a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(file: str, rows: dict[str, tuple]) -> pa.RecordBatch:
            # one file for each ARC file, so that a task that runs again replaces its own
            out, damage, name, n = _Writer(warc_folder, file.removesuffix(".arc.gz"), "warc", roll=float("inf")), Damage(), None, 0
            for place, header, block in arc_records(_content(arc_folder, file), damage):
                if place in rows:
                    name, _ = out.add(convert(header, block, *rows[place]))
                    n += 1
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((name, pa.string()), (n, pa.int64()), (len(rows), pa.int64()), (damage.n, pa.int64()))], ["file", "written", "planned", "damaged"])

        file, rows = None, {}
        for batch in batches:
            for key, name, place, response, revisit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if name != file:
                    if file:
                        yield one(file, rows)
                    file, rows = name, {}
                rows[place] = (key, response, revisit)
        if file:
            yield one(file, rows)

    # an explicit number: rows of the plan are small, and files by file would else be merged into few tasks
    n = tasks_for(plan.select("file").distinct().count())
    return plan.select("key", "file", "place", "response", "revisit").repartition(n, "file").sortWithinPartitions("file").mapInArrow(run, "file string, written long, planned long, damaged long")


def index_archives(files: DataFrame, folder: str) -> DataFrame:
    """The index (key, file, place, digest, bytes) of ARC files that are there already, by their names (``file``). Keys are hashes
    of file and place; damaged records are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for place, _, block in arc_records(_content(folder, file), Damage()):
                    payload = split_http(block)[1]
                    key = int.from_bytes(hashlib.sha256(f"{file}:{place}".encode()).digest()[:8], "big", signed=True)
                    rows.append((key, file, place, digest(payload), len(payload)))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "file", "place", "digest", "bytes"])

    return files.select("file").repartition(tasks_for(files.count()), "file").mapInArrow(read, "key long, file string, place string, digest string, bytes long")


def _size(fields: dict[str, str], http: bytes) -> int | None:
    """The size of a revisit's payload: what its own header tells, else that of the HTTP headers, if they tell one."""
    told = fields.get("warc-payload-length", "")
    found = None if told.isdigit() else re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    return int(told) if told.isdigit() else int(found[1]) if found else None


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the WARC files: what its headers say, and what its payload is where it has one. Damaged records are left
    out; ``written`` in what ``archive`` returns tells how many there should be."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, damage = [], Damage()
                for fields, block in warc_records(_content(folder, file), damage):
                    http, payload = split_http(block)
                    revisit, told = fields["warc-type"] == "revisit", fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    size, found = (_size(fields, http), told) if revisit else (len(payload), digest(payload))
                    if found != told:
                        damage.n += 1
                        continue
                    rows.append((key_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-date"], fields["warc-type"], size, found, key_of(fields["warc-refers-to"]) if revisit else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kind = "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return files.where("file IS NOT NULL").select("file").repartition(tasks_for(files.count()), "file").mapInArrow(read, kind)


def archive(pages: DataFrame, folder: str, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Write pages as ARC, convert to WARC under ``folder``/warc, and return the names of the WARC files and how many records each lost as damaged."""
    index = scratch.table(write_arc(pages, f"{folder}/arc", version), "arc-index")
    plan = scratch.table(plan_revisits(index, min_bytes), "arc-plan")
    return scratch.table(convert_archives(plan, f"{folder}/arc", f"{folder}/warc"), "warc-files")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives; an error if one is missing."""
    folder = scratch.folder(spark, "archives")
    files = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = scratch.table(read_archives(files, f"{folder}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    planned, written, damaged = files.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("planned", "written", "damaged")]).first()
    if not planned == written == found.count():
        raise ValueError(f"{planned} pages, {written} records written, {found.count()} read back, {damaged} damaged")
    return found
