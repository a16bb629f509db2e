"""WARC files as a data source of Spark: spark.read.format("warc"), df.write.format("warc").

Reading plans whole files into partitions of about the same bytes. Predicates on the record type, on the target, on the record's length
and on any other header column are pushed down: a record's header is parsed first, and if it fails a predicate its payload is
neither decoded nor kept; in files that aren't compressed it is skipped by a seek. In compressed files every record is a gzip member
of its own, of which an unwanted one is only inflated to find where the next begins.

A damaged record ends the job with an error. With option("mode", "permissive") it is a row instead, whose columns are null but for
file, offset and headers, which has the reason as "x-damage"; reading goes on where the next record begins; in files that
aren't compressed, a damaged record's payload that looks like a record is read as one. Rows by
`headers['x-damage'] is not null` are the count of records that were rejected.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quarry.llm.shared import Workspace

SCHEMA = "warc_type string, record_id string, warc_date string, target_uri string, content_type string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, file string, offset long"
_FIELD = {"warc_type": "warc-type", "record_id": "warc-record-id", "warc_date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "content_length": "content-length"}
#: Bytes of files that a partition reads, about, and payload bytes of a batch.
PARTITION, BATCH, CHUNK = 64 << 20, 8 << 20, 1 << 18


def _open(path: str):
    from pyarrow import fs

    there, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return there, at


class _Plain:
    """Bytes of a file that isn't compressed; skipping them is a seek."""

    def __init__(self, source, at: int = 0):
        self.source, self.buffer, self.at, self.begun = source, b"", at, at

    def more(self) -> bool:
        chunk = self.source.read(CHUNK)
        self.buffer += chunk
        return bool(chunk)

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buffer))
        self.buffer = self.buffer[inside:]
        if n > inside:
            self.source.seek(self.source.tell() + n - inside)
        self.at += n


class _Members:
    """The inflated bytes of gzip members, one after another; start is where the member of the next byte begins in the file."""

    def __init__(self, source, at: int = 0):
        self.source, self.raw, self.buffer, self.start, self.read, self.begun = source, b"", b"", at, at, at
        self.inflate = None

    @property
    def at(self) -> int:
        return self.start

    def more(self) -> bool:
        while True:
            if self.inflate is None:
                if self.buffer:
                    return False  # the next member begins only when this one is used up
                if not self._feed():
                    return False
                self.start = self.read - len(self.raw)
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            self.buffer += out
            if out:
                return True
            if self.inflate is not None and not self._feed():
                raise EOFError("a gzip member is cut off")

    def _feed(self) -> bool:
        if self.raw:
            return True
        self.raw = self.source.read(CHUNK)
        self.read += len(self.raw)
        return bool(self.raw)

    def take(self, n: int) -> bytes:
        parts, size = [], 0
        while size < n:
            if not self.buffer and not self.more():
                break
            part = self.buffer[: n - size]
            self.buffer = self.buffer[len(part) :]
            parts.append(part)
            size += len(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            if not self.buffer and not self.more():
                return
            part = min(n, len(self.buffer))
            self.buffer, n = self.buffer[part:], n - part


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _header(stream) -> tuple[int, list[bytes]] | None:
    """Where the next record begins, and the lines of its header."""
    while True:
        while not stream.buffer:
            if not stream.more():
                return None
        blank = len(stream.buffer) - len(stream.buffer.lstrip(b"\r\n"))
        if not blank:
            break
        stream.take(blank)
    start = stream.begun = stream.at
    while (end := stream.buffer.find(b"\r\n\r\n")) < 0:
        if not stream.more():
            raise ValueError("the header of a record is cut off")
    lines = stream.take(end + 4)[:-4].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no record begins at byte {start}")
    return start, lines[1:]


def _value(name: str, fields: dict[str, str]):
    value = fields.get(_FIELD[name])
    return int(value) if name == "content_length" and value is not None else value


def accepts(filters: list[Filter], fields: dict[str, str]) -> bool:
    """Whether a record's header meets all predicates, as SQL does: a missing value meets none but those on missing values."""
    return all(_meets(f, fields) is True for f in filters)


def _meets(f: Filter, fields: dict[str, str]) -> bool | None:
    if isinstance(f, Not):
        inner = _meets(f.child, fields)
        return None if inner is None else not inner
    value = _value(f.attribute[0], fields)
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None or not isinstance(f, In) and f.value is None:
        return None
    return _COMPARE[type(f)](value, f.value)


_COMPARE = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: True if a in b else None if None in b else False,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def _pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        return _pushable(f.child)
    if not isinstance(f, (*_COMPARE, IsNull, IsNotNull, EqualNullSafe)) or tuple(f.attribute) not in {(x,) for x in _FIELD}:
        return False
    # In(..) has a tuple of values; Python must have read them as what they are
    values = f.value if isinstance(f, In) else (f.value,) if hasattr(f, "value") else ()
    return all(v is None or isinstance(v, int if f.attribute == ("content_length",) else str) for v in values)


def _http(body: bytes) -> tuple[int | None, dict[str, str] | None, bytes]:
    """Status, headers and body of an HTTP message; a body that is none stays whole."""
    end = body.find(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or end < 0:
        return None, None, body
    lines = body[:end].split(b"\r\n")
    status = lines[0].split(b" ", 2)
    fields = _fields(lines[1:])
    body = body[end + 4 :]
    if fields.get("content-encoding") == "gzip":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass  # kept as it came
    return int(status[1]) if len(status) > 1 and status[1].isdigit() else None, fields, body


def _resume(source, at: int, packed: bool) -> int | None:
    """Where, from a byte on, the next record begins: a gzip member that holds one, or a version line and a field after an empty line."""
    mark, kept, overlap = re.compile(rb"\x1f\x8b\x08" if packed else rb"\r\n\r\n(?=WARC/[^\r\n]{1,8}\r\n[!-9;-~]{1,40}:)"), b"", 2 if packed else 63
    source.seek(at)
    while chunk := source.read(CHUNK):
        kept += chunk
        for found in mark.finditer(kept):
            k = found.start()
            if not packed:
                return at + found.end()
            source.seek(at + k)
            try:
                if zlib.decompressobj(31).decompress(source.read(4096), 64).startswith(b"WARC/"):
                    return at + k
            except zlib.error:
                pass  # these bytes are within a member
        source.seek(at + len(kept))
        past = max(0, len(kept) - overlap)
        at, kept = at + past, kept[past:]
    return None


def records(path: str, filters: list[Filter] = (), payload: bool = True, permissive: bool = False) -> Iterator[tuple]:
    """The records of a file that meet the predicates, as rows of SCHEMA; if permissive, with a row for each damaged one."""
    there, at = _open(path)
    with there.open_input_file(at) as source:
        packed = source.read(2) == b"\x1f\x8b"
        begin = 0
        while begin is not None:
            source.seek(begin)
            stream = _Members(source, begin) if packed else _Plain(source, begin)
            try:
                yield from _records(path, stream, filters, payload)
                return
            except (ValueError, EOFError, zlib.error) as e:
                if not permissive:
                    raise
                begun = stream.start if packed else stream.begun
                if accepts(filters, {}):
                    yield (*(None for _ in _FIELD), {"x-damage": str(e)}, None, None, None, path, begun)
                begin = _resume(source, begun + 1, packed)


def _records(path: str, stream, filters: list[Filter], payload: bool) -> Iterator[tuple]:
    while (head := _header(stream)) is not None:
        start, lines = head
        fields = _fields(lines)
        length = int(fields.get("content-length", 0))
        if length < 0:
            raise ValueError(f"{path}: the record at byte {start} has a negative length")
        if not accepts(filters, fields):
            stream.skip(length)
            continue
        status, http, body = None, None, None
        if payload:
            body = stream.take(length)
            if len(body) < length:
                raise EOFError(f"{path}: the record at byte {start} is cut off")
            if fields.get("content-type", "").startswith("application/http"):
                status, http, body = _http(body)
        else:
            stream.skip(length)
        yield (*(_value(c, fields) for c in _FIELD), fields, status, http, body, path, start)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.filters = schema, options, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Files, largest first, each to the partition with the fewest bytes; as many partitions as their bytes ask for."""
        from pyarrow import fs

        found: list[tuple[int, str]] = []
        for path in self.options["path"].split(","):
            there, at = _open(path)
            info = there.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = [info] if info.type == fs.FileType.File else there.get_file_info(fs.FileSelector(at, recursive=True))
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            found += [(x.size, scheme + x.path) for x in infos if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        limit = int(self.options.get("partitionbytes", PARTITION))
        n = max(1, min(len(found), -(-sum(size for size, _ in found) // limit)))
        own: list[list[str]] = [[] for _ in range(n)]
        load = [0] * n
        for size, path in sorted(found, key=lambda x: (-x[0], x[1])):
            k = load.index(min(load))
            own[k].append(path)
            load[k] += size
        return [Files(paths) for paths in own]

    def read(self, partition: Files):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        names = target.names
        known = [x.split()[0] for x in SCHEMA.split(", ")]
        at = [known.index(c) for c in names]
        rows, size = [], 0

        def batch():
            columns = [pa.array([list(r[k].items()) if isinstance(r[k], dict) else r[k] for r in rows], target.field(i).type) for i, k in enumerate(at)]
            return pa.RecordBatch.from_arrays(columns, schema=target)

        for path in partition.paths:
            for row in records(path, self.filters, self.options.get("payload", "true").lower() != "false", self.options.get("mode", "failfast").lower() == "permissive"):
                rows.append(row)
                size += len(row[9] or b"") + 512
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcWriter(DataSourceArrowWriter):
    """Writes records; columns are those of SCHEMA that are there. A task's file gets its name when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        there, root = _open(self.options["path"])
        there.create_dir(root, recursive=True)
        suffix = ".warc.gz" if self.options.get("compression", "gzip") == "gzip" else ".warc"
        limit = int(self.options.get("filebytes", PARTITION))
        paths, out, size = [], None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        paths.append(f"{root}/_{uuid.uuid4().hex}{suffix}.part")
                        out, size = there.open_output_stream(paths[-1], compression=None), 0
                    raw = record(row)
                    raw = _gzip(raw) if suffix.endswith("gz") else raw
                    out.write(raw)
                    size += len(raw)
                    if size >= limit:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        there, root = _open(self.options["path"])
        there.create_dir(root, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for x in there.get_file_info(fs.FileSelector(root)):
                if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                    there.delete_file(x.path)
        for m in messages:
            for path in m.paths if m else ():
                folder, _, name = path.rpartition("/")
                there.move(path, f"{folder}/{name[1:].removesuffix('.part')}")

    def abort(self, messages: list[Written | None]) -> None:
        there, _ = _open(self.options["path"])
        for m in messages:
            for path in m.paths if m else ():
                there.delete_file(path)


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _line(value) -> str:
    """A header's value in one line."""
    return " ".join(str(value).splitlines()).strip()


def record(row: dict) -> bytes:
    """A record's bytes. Null columns give no field; with a status the payload becomes an HTTP response; the length is always that of the content."""
    body = row.get("payload") or b""
    body = body.encode() if isinstance(body, str) else body
    kind = row.get("content_type")
    if row.get("http_status") is not None:
        http = dict(row.get("http_headers") or {})
        head = [f"HTTP/1.1 {row['http_status']} -", *(f"{_line(k)}: {_line(v)}" for k, v in http.items() if k.lower() not in ("content-length", "content-encoding"))]
        body = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body
        kind = kind or "application/http; msgtype=response"
    own = {"WARC-Type": row.get("warc_type") or "resource", "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("warc_date"), "WARC-Target-URI": row.get("target_uri"), "Content-Type": kind}
    more = {k: v for k, v in dict(row.get("headers") or {}).items() if k.lower() not in {x.lower() for x in own} | {"content-length"}}
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in {**own, **more}.items() if v is not None), f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


class WarcSource(DataSource):
    """Options for reading: path (a file, a folder, or several with commas between), payload (false: headers only), partitionBytes.

    Options for writing: path, compression (gzip or none), fileBytes. A folder without records gives an empty table, a missing one an error;
    a header field that is absent is null; repeated records stay; columns of other names are ignored in writing.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and switches on the pushing of predicates to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
    """Records of pages: for each a request without a body and a response with its html. A null id, url or html has no field or no body."""
    from pyspark.sql import functions as F

    page_id = F.col(id_col).cast("string")
    marks = F.map_filter(F.create_map(F.lit("WARC-X-Page"), page_id, F.lit("WARC-X-Null"), F.when(F.col(html_col).isNull(), F.lit("1"))), lambda k, v: v.isNotNull())
    date = F.lit("2024-01-01T00:00:00Z").alias("warc_date")
    parts = [
        F.struct(F.lit("request").alias("warc_type"), F.concat(F.lit("<urn:page:"), F.coalesce(page_id, F.lit("-")), F.lit(":request>")).alias("record_id"), date, F.col(url_col).alias("target_uri"), F.lit(None).cast("int").alias("http_status"), marks.alias("headers"), F.lit("GET / HTTP/1.1\r\n\r\n").cast("binary").alias("payload")),
        F.struct(F.lit("response").alias("warc_type"), F.concat(F.lit("<urn:page:"), F.coalesce(page_id, F.lit("-")), F.lit(":response>")).alias("record_id"), date, F.col(url_col).alias("target_uri"), F.lit(200).alias("http_status"), marks.alias("headers"), F.col(html_col).cast("binary").alias("payload")),
    ]
    return pages.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def round_trip(pages, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
    """(page_id, url, html) of the pages, written as WARC files and read again by their response records.

    Null columns stay null; empty ones stay empty but for an empty url, which a header can't tell from none; repeated rows stay.
    """
    from pyspark.sql import functions as F

    spark = pages.sparkSession
    register(spark)
    work = Workspace(spark, "warc")
    archive(pages, id_col, url_col, html_col).write.format("warc").mode("append").save(f"{work.path}/files")
    read = spark.read.format("warc").load(f"{work.path}/files").where("warc_type = 'response'")
    html = F.when(F.col("headers")["warc-x-null"].isNull(), F.decode("payload", "UTF-8"))
    return read.select(F.col("headers")["warc-x-page"].cast("long").alias(id_col), F.col("target_uri").alias(url_col), html.alias(html_col))
