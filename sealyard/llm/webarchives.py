"""WARC records in ZIP packages: written with an index beside them, and read back by ranges without extraction.

A package is a ZIP file that stores, uncompressed, ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, a line a record with its offset and length there. A reader parses the central directory at the
end of the package, the ZIP64 records too where numbers are past 32 bits, finds where the members' bytes begin, reads
the index, and then the records as ranges of the package's bytes. Members that no index mentions are walked record by
record. Records are spread over tasks by their bytes, as the table of places is far smaller than what it
stands for; neighbouring records share a read, and no package, member or index is ever held whole by a reader.

Of records with equal payloads the one with the largest id holds it (``response``), the others refer to it
(``revisit``), with the length and SHA-1 of the full payload in their headers. A payload that a third of all rows
have is spread over tasks by hash of the id, and the largest id is found from one row a task.

A NULL payload is empty, a NULL URI is left out and a NULL id is the smallest. Control characters in URIs are
percent-encoded. Of rows that are the same in id and payload one is the response. Other columns are not read. No rows
make no packages. A damaged or missing package is a row with ``error``; a record that cannot be read, or whose payload
has not the digest its header names, is one with ``intact`` false. A package is written under a name of its attempt's
own and listed when the attempt has succeeded, so what a lost executor leaves is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm.common import in_batches, table
from sealyard.session import fresh_folder, materialise
from sealyard.sources.named import balance, qualified
from sealyard.sources.streams import CHUNK, locate

#: A package is closed when it has so many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 1 << 30, 1 << 16
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
#: Rows with one payload go to so many tasks at most.
_SALTS = 256
#: Packages whose indexes a task reads, and bytes of records that it reads.
_PACKAGES, _SPAN = 16, 64 * 1024 * 1024
_DATE, _STAMP = "1970-01-01T00:00:00Z", "19700101000000"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

PACKAGES = "path string, length bigint, records bigint"
PLACES = "path string, member string, start bigint, length bigint, error string"
RECORDS = (
    "path string, start bigint, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes bigint, payload_digest string, intact boolean"
)


# ---- which record holds a payload


def holders(df: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """``df`` with ``_digest`` and ``_salt``, by which rows are brought together, and ``_holder``, the largest key with
    the same payload. Payloads of fewer than ``least`` bytes have an empty ``_digest``."""
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digest = F.when(F.octet_length(content) >= least, F.unhex(F.sha2(content, 256))).otherwise(F.lit(b""))
    salt = F.pmod(F.xxhash64(key), F.lit(_SALTS)).cast("int")
    rows = df.withColumns({"_digest": digest, "_salt": salt})
    slim = rows.groupBy("_digest", "_salt").agg(F.max(key).alias("_most"))
    whole = slim.groupBy("_digest").agg(F.max("_most").alias("_holder"))
    known = slim.drop("_most").join(whole, "_digest")
    return rows.repartition("_digest", "_salt").join(known, ["_digest", "_salt"])


# ---- writing


def record_id(key: int | None) -> str:
    return f"<urn:x-record:{'null' if key is None else key}>"


def key_of(column: str):
    """The key in a record id, NULL if it has none."""
    return F.regexp_extract(column, r"\A<urn:x-record:(-?[0-9]+)>\z", 1).try_cast("bigint")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(uri: str) -> str:
    """The URI with all but visible ASCII characters percent-encoded."""
    return quote(uri, safe="".join(map(chr, range(33, 127))), errors="replace")


def sort_key(uri: str) -> str:
    """The host backwards, then path and query, in lower case."""
    try:
        parts = urlsplit(uri)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return uri.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{host}){parts.path or '/'}{query}".lower()


def warc_record(key: int | None, uri: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One record: the payload as an HTTP response, or only its headers with a reference to the record that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", _DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", clean_uri(uri)))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Sink:
    """What ``zipfile`` needs of an output stream that cannot seek; counts the bytes."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def write(self, data) -> int:
        self.raw.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def seek(self, *_):
        raise OSError("cannot seek")


class Package:
    """A package that is being written, record by record."""

    def __init__(self, raw):
        self.sink = _Sink(raw)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self._member(_DATA)
        self.at, self.lines = 0, []

    def _member(self, name: str):
        return self.zip.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, record: bytes, uri: str | None, digest: str) -> None:
        packed = gzip_member(record)
        uri = "" if uri is None else clean_uri(uri)
        about = {
            "url": uri, "digest": f"sha1:{digest}", "mime": "text/html",
            "offset": self.at, "length": len(packed), "filename": _DATA.partition("/")[2],
        }
        self.lines.append(f"{sort_key(uri)} {_STAMP} {json.dumps(about)}\n".encode())
        self.data.write(packed)
        self.at += len(packed)

    def close(self) -> int:
        """Write index and directory; the package's bytes."""
        self.data.close()
        with self._member(_INDEX) as member:
            for line in sorted(self.lines):
                member.write(line)
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": _DATA, "bytes": self.at}]}
        with self._member("datapackage.json") as member:
            member.write(json.dumps(about).encode())
        self.zip.close()
        return self.sink.at


def write_packages(
    df: DataFrame,
    folder: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    least: int = LEAST_REVISIT,
    package_bytes: int = PACKAGE_BYTES,
    package_records: int = PACKAGE_RECORDS,
) -> DataFrame:
    """Write a record per row to packages in ``folder``; ``path, length, records`` of each package."""
    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{uri}`").cast("string").alias("uri"),
        F.col(f"`{payload}`").cast("binary").alias("payload"),
    )
    # Rows with a payload and the holder's id come one after another, so that one of them is the response.
    ordered = holders(rows, "key", "payload", least).sortWithinPartitions(
        "_digest", "_salt", F.col("key").desc_nulls_last()
    )
    root = qualified(df.sparkSession, folder)

    def write(batches):
        import pyarrow as pa

        package, place, stream, held = None, "", None, None

        def closed():
            length, n = package.close(), len(package.lines)
            stream.close()
            return pa.RecordBatch.from_pylist([{"path": place, "length": length, "records": n}], schema=schema)

        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(5)], strict=True):
                own, target, content, digest, holder = (value.as_py() for value in row)
                content = content or b""
                revisit = bool(digest) and (own != holder or held == (digest, own))
                if not revisit:
                    held = (digest, own)
                record = warc_record(own, target, content, record_id(holder), revisit)
                if package is None:
                    place = f"{root}/{uuid.uuid4().hex}.wacz"
                    system, inner = locate(place)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    stream = system.open_output_stream(inner, compression=None)
                    package = Package(stream)
                package.add(record, target, sha1_base32(content))
                if package.at >= package_bytes or len(package.lines) >= package_records:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return materialise(in_batches(ordered.select("key", "uri", "payload", "_digest", "_holder"), write, PACKAGES))


# ---- the ZIP format


class ZipError(ValueError):
    pass


class Entry:
    """A member as the central directory has it."""

    __slots__ = ("name", "method", "stored", "header")

    def __init__(self, name: str, method: int, stored: int, header: int):
        self.name, self.method, self.stored, self.header = name, method, stored, header


# Fixed layouts of the format's records.
_END, _END64, _LOCATOR = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
_CENTRAL, _LOCAL = "<4s6H3L5H2L", "<4s5H3L2H"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def _exactly(source, at: int, n: int) -> bytes:
    if at < 0 or at + n > source.size():
        raise ZipError("a place outside the package")
    return source.read_at(n, at)


def _ending(source, size: int) -> tuple[int, int, int, int]:
    """Entries, bytes and offset of the central directory, and the bytes that lie before the archive itself."""
    tail_at = max(0, size - struct.calcsize(_END) - _MAX16)
    tail = _exactly(source, tail_at, size - tail_at)
    found = len(tail)
    while (found := tail.rfind(b"PK\5\6", 0, found)) >= 0:
        if len(tail) - found >= struct.calcsize(_END):
            _, disk, _, _, entries, length, offset, comment = struct.unpack_from(_END, tail, found)
            if found + struct.calcsize(_END) + comment == len(tail):
                break
    else:
        raise ZipError("no end of a central directory")
    end = tail_at + found
    if end >= struct.calcsize(_LOCATOR):
        mark, _, at, _ = struct.unpack(_LOCATOR, _exactly(source, end - struct.calcsize(_LOCATOR), struct.calcsize(_LOCATOR)))
        if mark == b"PK\6\7":
            # Bytes put before the archive shift the record by as many.
            for place in (at, end - struct.calcsize(_LOCATOR) - struct.calcsize(_END64)):
                if 0 <= place <= end - struct.calcsize(_END64):
                    values = struct.unpack(_END64, _exactly(source, place, struct.calcsize(_END64)))
                    if values[0] == b"PK\6\6":
                        entries, length, offset = values[7], values[8], values[9]
                        return entries, length, offset, place - offset - length
            raise ZipError("no ZIP64 end of a central directory")
    if disk not in (0, _MAX16):
        raise ZipError("package of several volumes")
    return entries, length, offset, end - offset - length


def _wide(extra: bytes, wanted: list[int]) -> list[int]:
    """Values of which those that are all ones stand in the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, place = extra[at + 4 : at + 4 + n], 0
            for i, value in enumerate(wanted):
                if value == _MAX32:
                    if place + 8 > len(field):
                        raise ZipError("ZIP64 field ends too early")
                    (wanted[i],) = struct.unpack_from("<Q", field, place)
                    place += 8
            break
        at += 4 + n
    return wanted


class _Window:
    """Reads a file from ``at`` up to ``end``, some of it ahead."""

    def __init__(self, source, at: int, end: int):
        self.source, self.at, self.end, self.data, self.used = source, at, end, b"", 0

    def take(self, n: int) -> bytes:
        if len(self.data) - self.used < n:
            rest = self.data[self.used :]
            more = min(max(n - len(rest), CHUNK), self.end - self.at)
            self.data, self.used = rest + self.source.read_at(more, self.at) if more > 0 else rest, 0
            self.at += max(more, 0)
        if len(self.data) - self.used < n:
            raise ZipError("package ends too early")
        self.used += n
        return self.data[self.used - n : self.used]


def directory(source, size: int) -> Iterator[Entry]:
    """The members of a ZIP file, from its central directory."""
    entries, length, offset, ahead = _ending(source, size)
    if ahead < 0:
        raise ZipError("central directory out of place")
    window = _Window(source, offset + ahead, offset + ahead + length)
    for _ in range(entries):
        head = struct.unpack(_CENTRAL, window.take(struct.calcsize(_CENTRAL)))
        if head[0] != b"PK\1\2":
            raise ZipError("no entry where the central directory should have one")
        flags, method, stored, plain = head[3], head[4], head[8], head[9]
        name, extra, comment = head[10], head[11], head[12]
        raw, more = window.take(name), window.take(extra)
        window.take(comment)
        _, stored, header = _wide(more, [plain, stored, head[16]])
        yield Entry(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, stored, header + ahead)


def data_offset(source, entry: Entry) -> int:
    """Where a member's bytes begin."""
    head = struct.unpack(_LOCAL, _exactly(source, entry.header, struct.calcsize(_LOCAL)))
    if head[0] != b"PK\3\4":
        raise ZipError(f"no member at the place of {entry.name}")
    return entry.header + struct.calcsize(_LOCAL) + head[9] + head[10]


def _chunks(source, entry: Entry) -> Iterator[bytes]:
    """A member's bytes, inflated if it is compressed, and once more if its name says so."""
    at = data_offset(source, entry)
    end = at + entry.stored
    unpack = None if entry.method == 0 else zlib.decompressobj(-15)
    if entry.method not in (0, 8):
        raise ZipError(f"{entry.name} is compressed by method {entry.method}")
    gunzip = zlib.decompressobj(31) if entry.name.endswith(".gz") else None
    while at < end:
        data = _exactly(source, at, min(CHUNK, end - at))
        at += len(data)
        if unpack is not None:
            data = unpack.decompress(data)
        while gunzip is not None and data:
            yield gunzip.decompress(data)
            data = gunzip.unused_data
            if gunzip.eof:
                gunzip = zlib.decompressobj(31)
        if data:
            yield data


def _lines(source, entry: Entry) -> Iterator[bytes]:
    rest = b""
    for data in _chunks(source, entry):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walk(source, start: int, end: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of the records from ``start`` to ``end``, each a gzip member or plain."""
    at = start
    while at < end:
        if _exactly(source, at, min(2, end - at)) == b"\x1f\x8b":
            unpack, place = zlib.decompressobj(31), at
            while not unpack.eof:
                if place >= end:
                    raise ZipError("record ends too early")
                data = _exactly(source, place, min(CHUNK, end - place))
                place += len(data)
                unpack.decompress(data)
            length = place - len(unpack.unused_data) - at
        else:
            head = source.read_at(min(CHUNK, end - at), at)
            until = head.find(b"\r\n\r\n")
            if until < 0:
                raise ZipError("record without an end of its header")
            length = until + 8 + int(_header(head[:until])[1].get("content-length", "0"))
        if at + length > end:
            raise ZipError("record ends too early")
        yield at, length
        at += length


def places(source, size: int) -> Iterator[tuple[str, int, int]]:
    """``(member, start, length)`` of all records in a package, in the package's own bytes."""
    archives, indexes = {}, []
    for entry in directory(source, size):
        if entry.name.startswith("archive/") and entry.name.endswith((".warc", ".warc.gz")):
            if entry.method != 0:
                raise ZipError(f"{entry.name} is compressed, so that it has no ranges to read")
            archives[entry.name.partition("/")[2]] = (entry.name, data_offset(source, entry), entry.stored)
        elif entry.name.startswith("indexes/") and entry.name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            indexes.append(entry)
    seen = set()
    for index in indexes:
        for line in _lines(source, index):
            about = line.find(b"{")
            if about < 0:
                continue
            known = json.loads(line[about:])
            file, offset, length = known["filename"], int(known["offset"]), int(known["length"])
            if file not in archives:
                raise ZipError(f"index names {file}, which is not in the package")
            name, at, stored = archives[file]
            if offset < 0 or length <= 0 or offset + length > stored:
                raise ZipError(f"index names a place outside {name}")
            seen.add(file)
            yield name, at + offset, length
    for file, (name, at, stored) in archives.items():
        if file not in seen:
            for start, length in _walk(source, at, at + stored):
                yield name, start, length


# ---- reading


def list_records(packages: DataFrame) -> DataFrame:
    """``path, member, start, length, error``: where the records of each package (``path``) lie.

    A package that is damaged or missing has, after the records before the damage, a row with ``error``.
    """

    def visit(batches):
        import pyarrow as pa

        names = [field.split()[0] for field in PLACES.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def output(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    system, inner = locate(path)
                    with system.open_input_file(inner) as source:
                        for member, start, length in places(source, source.size()):
                            rows.append((path, member, start, length, None))
                            if len(rows) >= 4096:
                                yield output(rows)
                                rows = []
                except (FileNotFoundError, ValueError, KeyError, TypeError, zlib.error) as problem:
                    rows.append((path, None, None, None, str(problem) or type(problem).__name__))
                if rows:
                    yield output(rows)

    spread = balance(packages.select("path"), F.lit(1), _PACKAGES, ["path"])
    return in_batches(spread, visit, PLACES)


def _header(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    fields = (line.partition(":") for line in rest if ":" in line)
    return first, {name.strip().lower(): value.strip() for name, _, value in fields}


def read_record(data: bytes) -> dict:
    """The columns of a record, from its bytes. Raises ``ValueError`` or ``zlib.error`` if there is none."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompressobj(31).decompress(data)
    head, end, rest = data.partition(b"\r\n\r\n")
    version, fields = _header(head)
    if not version.startswith("WARC/") or not end:
        raise ValueError("no WARC record")
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("record ends too early")
    kind, told = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, http = block, {}
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        _, http = _header(top)
    found = {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
    }
    if kind == "revisit":
        # The payload is elsewhere: its length and digest are what the record says.
        length = http.get("content-length")
        return found | {"payload_bytes": None if length is None else int(length), "payload_digest": told, "intact": True, "payload": None}
    digest = sha1_base32(payload)
    return found | {"payload_bytes": len(payload), "payload_digest": digest, "intact": told in (None, digest), "payload": payload}


def read_records(listed: DataFrame, payloads: bool = False) -> DataFrame:
    """The columns ``RECORDS`` of the records at ``path, start, length``, and with ``payloads`` their ``payload``.

    Length and digest are those of the full payload, computed from it or, of a revisit, as its record tells.
    """
    schema = RECORDS + (", payload binary" if payloads else "")

    def visit(batches):
        import pyarrow as pa

        names = [field.split()[0] for field in schema.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
        path, source, held, first = None, None, b"", 0

        def bytes_at(start, length):
            nonlocal held, first
            if not first <= start <= start + length <= first + len(held):
                held, first = source.read_at(max(length, CHUNK), start), start
            return held[start - first : start - first + length]

        try:
            for batch in batches:
                rows, size = [], 0
                for place, start, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    if place != path:
                        if source is not None:
                            source.close()
                        system, inner = locate(place)
                        path, source, held, first = place, system.open_input_file(inner), b"", 0
                    try:
                        row = read_record(bytes_at(start, length))
                    except (ValueError, KeyError, zlib.error):
                        row = {"intact": False}
                    row |= {"path": path, "start": start}
                    rows.append({name: row.get(name) for name in names})
                    size += len(row.get("payload") or b"") if payloads else 0
                    if size > _SPAN:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
        finally:
            if source is not None:
                source.close()

    spans = materialise(listed).where(F.col("error").isNull()).withColumn("_span", F.expr(f"start div {_SPAN}"))
    spread = balance(spans, F.col("length"), _SPAN, ["path", "_span"]).sortWithinPartitions("path", "start")
    return in_batches(spread.select("path", "start", "length"), visit, schema)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    packages = write_packages(pages, fresh_folder(spark, "packages"))
    listed = list_records(packages)
    sound = listed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    records = read_records(sound)
    checked = records.where(F.when(F.col("intact"), True).otherwise(F.raise_error(F.lit("a record is damaged"))))
    return checked.select(
        key_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        key_of("refers_to").alias("refers_to"),
    )


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
  FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_ALPHABET}',
    ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN holder END AS refers_to
FROM payloads
"""

QUERIES = {"op11_warc": op11_warc}
SQL = {"op11_warc": _SQL}
