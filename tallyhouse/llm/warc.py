"""WARC archives, compressed record by record: a writer, and a reader that splits files.

A record is a gzip member of its own.  The reader cuts files into byte ranges; the task
of a range looks for the gzip magic, takes a place for a record only if a WARC header can
be decoded there and the member ends at the end of the file or at another magic, and
from then on goes from member to member.  It owns the records that start in its range,
the last of which may end beyond it; so each record is read once, wherever files are cut.
"""

import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyhouse.session import written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a finished file at least, and read or written at a time.
RANGE_BYTES, FILE_BYTES, CHUNK = 32 << 20, 1 << 30, 1 << 20
#: A record's header may take so many bytes.
HEADER_BYTES = 1 << 20
#: Payloads below this are always stored.
LEAST_BYTES = 100
#: Groups of equal payloads broadcast, by number; each takes some 100 bytes.
BROADCAST_GROUPS = 300_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, file string, position long"
)
_ROWS = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "uri", "date", "refers_to", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("position", pa.int64())]
)


class Damaged(ValueError):
    """Bytes of an archive that are no record where one must be."""


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# writing


def _plain(value: str) -> str:
    """A header value on one line: control characters and blanks as %XX."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def member(record: dict) -> bytes:
    """A record of the columns record_id, record_type, uri, date, refers_to, payload_digest, payload_bytes and payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['payload_bytes']}\r\n\r\n".encode()
    revisit = record["record_type"] == "revisit"
    if not revisit:
        block += record["payload"] or b""
    head = [
        ("WARC-Type", record["record_type"]),
        ("WARC-Record-ID", f"<{_plain(record['record_id'])}>"),
        ("WARC-Date", record["date"]),
        ("WARC-Target-URI", None if record["uri"] is None else _plain(record["uri"])),
        ("WARC-Payload-Digest", f"sha256:{record['payload_digest']}"),
        ("WARC-Refers-To", f"<{_plain(record['refers_to'])}>" if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head if value is not None)
    packer = zlib.compressobj(wbits=31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write files of their own aside; the commit moves those of the tasks that counted."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes, self.aside = path, file_bytes, f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{self.aside}")
        files, out, size = [], None, 0
        for batch in iterator:
            for row in range(batch.num_rows):
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{self.aside}/{files[-1]}", compression=None), 0
                packed = member({name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)})
                out.write(packed)
                size += len(packed)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{root}/{self.aside}/{name}", f"{root}/{name}")
        self._drop_aside(store, root)

    def abort(self, messages) -> None:
        self._drop_aside(*open_store(self.path))

    def _drop_aside(self, store, root) -> None:
        if store.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.aside}")


# reading


class Bytes:
    """A file read at any place, some bytes at a time."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.held = source, size, 0, b""

    def at(self, position: int) -> bytes:
        """Some bytes from `position` on, at least three unless the file ends."""
        skip = position - self.start
        if not 0 <= skip <= len(self.held) - len(MAGIC):
            self.source.seek(position)
            self.start, skip, self.held = position, 0, self.source.read(CHUNK)
        return self.held[skip:] if skip else self.held

    def find_magic(self, position: int, end: int) -> int:
        """The first magic that starts at `position` or later and before `end`; `end` without one."""
        while position < min(end, self.size - 2):
            some = self.at(position)
            found = some.find(MAGIC)
            if found >= 0:
                return min(position + found, end)
            position += max(len(some) - 2, 1)
        return end


def inflate(file: Bytes, position: int, most: int | None = None) -> tuple[bytes, int]:
    """The content of the member at `position` and where it ends; at most about `most` bytes of it, and -1 if there are more."""
    opener, out, n = zlib.decompressobj(wbits=31), [], 0
    while position < file.size:
        some = file.at(position)
        position += len(some)
        part = opener.decompress(some, most - n if most else 0)
        out.append(part)
        n += len(part)
        if opener.eof:
            return b"".join(out), position - len(opener.unused_data)
        if most and n >= most:
            return b"".join(out), -1
    raise zlib.error("member without an end")


def parse_header(content: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-cased name and the length of the header; None if it is none."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"WARC/") or end < 0:
        return None
    fields = {}
    for line in content[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _is_start(file: Bytes, position: int) -> bool:
    """Whether a record's header can be decoded here and its member ends where the file or another member does."""
    try:
        content, end = inflate(file, position, 4096)
        if not content.startswith(b"WARC/"):
            return False
        if parse_header(content) is None and parse_header(inflate(file, position, HEADER_BYTES)[0]) is None:
            return False
        if end < 0:
            _, end = inflate(file, position)
    except zlib.error:
        return False
    return end >= file.size or file.at(end).startswith(MAGIC)


def _record(content: bytes, header: dict, skip: int, keep_payload: bool) -> dict:
    size = int(header["content-length"])
    block = content[skip : skip + size]
    if len(block) < size:
        raise Damaged("a record shorter than its Content-Length")
    name, _, digest = header.get("warc-payload-digest", "").partition(":")
    out = {
        "record_id": header.get("warc-record-id", "").strip("<>"),
        "record_type": header["warc-type"],
        "uri": header.get("warc-target-uri"),
        "date": header.get("warc-date"),
        "refers_to": header["warc-refers-to"].strip("<>") if "warc-refers-to" in header else None,
        "payload_digest": digest or None,
        "payload_bytes": len(block),
        "payload": None,
    }
    if header.get("content-type", "").startswith("application/http"):
        http, _, block = block.partition(b"\r\n\r\n")
        out["payload_bytes"] = len(block)
        if header["warc-type"] == "revisit":
            # the payload is elsewhere; its length stays in the headers of the response
            lengths = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            out["payload_bytes"] = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    if header["warc-type"] != "revisit":
        found = hashlib.sha256(block).hexdigest()
        if name == "sha256" and found != digest:
            raise Damaged("a payload that does not match its digest")
        out["payload_digest"] = found
        out["payload"] = block if keep_payload else None
    return out


def records(file: Bytes, start: int, end: int, keep_payload: bool = True):
    """(position, record) of the records that start in [start, end)."""
    position, sure = start, start == 0
    while position < min(end, file.size):
        if not sure:
            position = file.find_magic(position, end)
            if position >= end:
                return
            if not _is_start(file, position):
                position += 1
                continue
        try:
            content, after = inflate(file, position)
            found = parse_header(content)
            if found is None and content:
                raise Damaged("a member that is no record")
            if found:
                yield position, _record(content, *found, keep_payload)
        except (zlib.error, Damaged) as e:
            raise Damaged(f"{e}, at byte {position}") from e
        position, sure = after, True


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, keep_payload: bool):
        self.path, self.range_bytes, self.keep_payload = path, range_bytes, keep_payload

    def partitions(self):
        store, root = open_store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
        elif info.type == fs.FileType.File:
            found = [info]
        else:
            raise FileNotFoundError(self.path)
        base = root.rstrip("/")
        hidden = lambda path: any(x[:1] in "_." for x in path[len(base) :].strip("/").split("/") if x)
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not hidden(x.path))
        # a file outside its root names the file itself
        return [
            _Range(path, start, min(start + self.range_bytes, size), size) for path, size in files for start in range(0, size, self.range_bytes)
        ] or [_Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.size:
            return
        store, _ = open_store(self.path)
        rows, n = [], 0
        with store.open_input_file(partition.file) as source:
            for position, row in records(Bytes(source, partition.size), partition.start, partition.end, self.keep_payload):
                rows.append({**row, "file": partition.file, "position": position})
                n += 500 + len(row["payload"] or b"")
                if n >= 8 * CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                    rows, n = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


class WarcSource(DataSource):
    """Format "warc"; options range_bytes, payload (false leaves payloads out), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def read_archive(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records (columns RECORDS) of the archives below `path`, files of any names without leading `_` or `.`.

    Payloads of responses are checked against their digests; a revisit has no payload,
    but its digest and length.  A damaged member fails the read and names its place.
    Paths are those pyarrow opens: local and shared folders, HDFS, S3 and the like.

    What starts a range must look like a record and end like one.  A payload that holds
    an archive itself could look so, where it cannot be compressed and a range begins in
    it; text cannot, as the magic is never valid UTF-8.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(payload=str(payload).lower(), range_bytes=range_bytes).load(path)


def write_archive(pages: DataFrame, path: str, by: str, uri: str, payload: str, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each row of `pages`, in archives below `path`, a folder without others' files.

    Of rows with equal payloads of at least `least_bytes` bytes, that of the smallest
    `by` (every row that repeats this `by`) is a response; the others are revisits that
    refer to it.  Rows with smaller payloads are responses, and so are those whose
    copies have no `by`, as there is nothing to refer to.  A text payload is stored as
    UTF-8, a null one is empty.  record_id is `urn:row:` and the `by` as text, nothing
    for null; other columns are not stored; an empty table leaves no file.

    Payloads stay where they are unless there are more than BROADCAST_GROUPS groups of
    copies: then the largest so many are still broadcast, so that no key of the shuffle
    that remains can have more than that part of the rows.
    """
    content = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{by}`").alias("id"), F.col(f"`{uri}`").cast("string").alias("uri"), content.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.unhex("payload_digest").alias("digest"))
    groups = groups.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = written(groups, "copies")
    same = F.unhex("payload_digest") == F.col("digest")
    if groups.count() <= BROADCAST_GROUPS:
        marked = rows.join(F.broadcast(groups), same, "left")
    else:
        largest = written(groups.orderBy(F.desc("n"), "digest").limit(BROADCAST_GROUPS), "largest-copies")
        first = rows.join(F.broadcast(largest), same, "left")
        others = groups.join(largest, "digest", "left_anti")
        marked = first.where("digest IS NOT NULL").unionByName(rows.join(F.broadcast(largest), same, "left_anti").join(others, same, "left"))
    revisit = F.col("digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:row:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    marked.select(
        name("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "uri",
        F.lit(date).alias("date"),
        F.when(revisit, name("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)
