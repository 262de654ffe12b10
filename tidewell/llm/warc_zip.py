"""WARC records in ZIP packages: writing, and reading by ranges.

A package holds ``archive/data.warc.gz`` (a gzip member a record) and ``indexes/index.cdxj`` (a line a record with
offset and length), both stored, so that a record is a range of the package. The reader takes the end of the file,
its central directory (ZIP64 too) and its index, and then reads records by ranges; nothing is extracted. Index
lines are dealt to tasks by ranges of a package, so one large package is read by many tasks.

Files are opened with ``pyarrow.fs``, so the folder can be any that it knows and that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
URN = "urn:page:"
WINDOW = 4 << 20
LINES = "path string, member string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string"
#: Digests that are checked.
DIGESTS = ("sha1", "sha256", "sha512", "md5")


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _header(text: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record_bytes(page_id, url, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """A gzip member with a WARC record; one that refers to another has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"") if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


class _Out:
    """Only what can be written in one go, as to an object store."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def _write(parts: Iterator[pd.DataFrame], folder: str, max_bytes: int) -> Iterator[pd.DataFrame]:
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    task, rows, n = TaskContext.get(), ((r for part in parts for r in part.itertuples(index=False))), 0
    row = next(rows, None)
    while row is not None:
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.wacz"
        stream = fs.open_output_stream(f"{base}/.{name}")
        lines, at = [], 0
        with zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open(ARCHIVE, "w", force_zip64=True) as archive:
                while row is not None and at < max_bytes:
                    refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                    data = record_bytes("null" if pd.isna(row.page_id) else int(row.page_id), row.url, row.payload, int(row.payload_bytes), row.digest, refers)
                    archive.write(data)
                    lines.append(f"{_header(row.url) or '-'} 20240101000000 " + json.dumps({"offset": at, "length": len(data), "filename": ARCHIVE.split("/")[1]}))
                    at += len(data)
                    row = next(rows, None)
            z.writestr(INDEX, "\n".join(lines) + "\n")
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        stream.close()
        fs.move(f"{base}/.{name}", f"{base}/{name}")  # a name without dot is a whole package
        yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(lines)]})
        n += 1


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 100, max_bytes: int = 256 << 20) -> DataFrame:
    """Writes page_id, url, html as WARC records into packages below ``folder``; returns path and records of each.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least ``least_bytes`` the
    one with the smallest page_id is a response and the others are revisits of it; repeated rows of that page_id
    are responses too. Records without page_id are revisits if any of the equal ones has an id. The result must be
    written or checkpointed before use: each run of the job writes packages anew, and only those that the result
    names count, so tasks that ran twice do no harm. Other columns are ignored; an empty table writes nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = records.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    told = records.join(again, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    told = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", "refers_to")
    return told.mapInPandas(lambda parts: _write(parts, folder, max_bytes), "path string, records long")


def central_directory(file, size: int) -> Iterator[dict]:
    """name, method, packed, size and start (of the data) of each member; ZIP64 fields where 32 or 16 bits are full."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) != n:
            raise ValueError("the package is cut off")
        return data

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no ZIP package: there is no end record")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    end += tail_at
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if end >= 20 and (locator := read(end - 20, 20))[:4] == b"PK\6\7":
            at = struct.unpack("<Q", locator[8:16])[0]
            record = read(at, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where the locator says")
            count, length, start = struct.unpack("<QQQ", record[32:56])
            end = at
    shift = end - length - start  # what stands before the package in the file
    at, buffer, begin = start + shift, b"", 0
    stop = at + length
    for _ in range(count):
        if len(buffer) - begin < 46 + 3 * 65535:
            more = read(at, min(1 << 20, stop - at)) if at < stop else b""
            at += len(more)
            buffer, begin = buffer[begin:] + more, 0
        sig, flags, method, packed, plain, n, m, k, local = struct.unpack("<4s4xHH8xIIHHH8xI", buffer[begin : begin + 46])
        if sig != b"PK\1\2":
            raise ValueError("the central directory is broken")
        name = buffer[begin + 46 : begin + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = buffer[begin + 46 + n : begin + 46 + n + m]
        begin += 46 + n + m + k
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:
                fields = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = next(fields) if plain == 0xFFFFFFFF else plain
                packed = next(fields) if packed == 0xFFFFFFFF else packed
                local = next(fields) if local == 0xFFFFFFFF else local
            extra = extra[4 + width :]
        yield {"name": name, "method": method, "packed": packed, "size": plain, "local": local + shift}


def data_start(file, member: dict) -> int:
    file.seek(member["local"])
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no member where the directory says: {member['name']}")
    return member["local"] + 30 + sum(struct.unpack("<HH", head[26:30]))


def _member_lines(file, member: dict) -> Iterator[bytes]:
    """Lines of a stored or deflated member, read in windows."""
    at, stop, rest = data_start(file, member), 0, b""
    stop = at + member["packed"]
    inflate = zlib.decompressobj(-15) if member["method"] == 8 else None
    while at < stop:
        file.seek(at)
        data = file.read(min(WINDOW, stop - at))
        at += len(data)
        lines = (rest + (inflate.decompress(data) if inflate else data)).split(b"\n")
        rest = lines.pop()
        yield from lines
    yield rest


def _scan(file, begin: int, stop: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members from ``begin`` to ``stop``, for archives without index."""
    at, first, one = begin, begin, zlib.decompressobj(31)
    while at < stop:
        file.seek(at)
        data = file.read(min(WINDOW, stop - at))
        at += len(data)
        while data:
            one.decompress(data)
            data = b""
            if one.eof:
                data = one.unused_data
                yield first - begin, at - len(data) - first
                first, one = at - len(data), zlib.decompressobj(31)


def _listed(path: str, name: str, starts: dict[str, int]) -> str:
    """The archive that an index means by ``name``: its path in the package, or below ``archive/``, or its last part where
    only one archive has that."""
    for full in (name, f"archive/{name}"):
        if full in starts:
            return full
    alike = [n for n in starts if n.split("/")[-1] == name]
    if len(alike) != 1:
        raise ValueError(f"{path}: the index names {name}, which {len(alike)} archives of the package are called")
    return alike[0]


def _index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path in part["path"]:
            fs, own = _fs(path)
            with fs.open_input_file(own) as file:
                members = [m for m in central_directory(file, file.size()) if m["name"].startswith(("archive/", "indexes/"))]
                archives = {m["name"]: m for m in members if m["name"].startswith("archive/") and not m["name"].endswith("/")}
                for name, m in archives.items():
                    if m["method"] != 0:
                        raise ValueError(f"{path}: {name} is compressed in the package, so its records can't be read by ranges")
                starts = {name: data_start(file, m) for name, m in archives.items()}
                listed: set[str] = set()
                rows: list[tuple] = []
                for m in (m for m in members if m["name"].startswith("indexes/") and m["name"].endswith((".cdxj", ".cdx"))):
                    for line in _member_lines(file, m):
                        if b"{" in line:
                            x = json.loads(line[line.index(b"{") :])
                            name = _listed(path, x["filename"], starts)
                            listed.add(name)
                            rows.append((path, name, starts[name] + int(x["offset"]), int(x["length"])))
                            if len(rows) >= 50_000:
                                yield pd.DataFrame(rows, columns=["path", "member", "offset", "length"])
                                rows = []
                for name, m in archives.items():
                    if name not in listed:
                        for at, n in _scan(file, starts[name], starts[name] + m["packed"]):
                            rows.append((path, name, starts[name] + at, n))
                            if len(rows) >= 50_000:
                                yield pd.DataFrame(rows, columns=["path", "member", "offset", "length"])
                                rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "member", "offset", "length"])


def _digest_fits(said: str, payload: bytes) -> bool:
    """Whether a digest "algorithm:value" (hex or base 32) is that of ``payload``; unknown algorithms aren't checked."""
    kind, _, value = said.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in DIGESTS:
        return True
    told = hashlib.new(kind, payload).digest()
    return value.strip().lower() in (told.hex(), base64.b32encode(told).decode().rstrip("=").lower(), base64.b32encode(told).decode().lower())


def parse_record(data: bytes) -> tuple | None:
    """The columns of RECORDS from a WARC record; None for types other than response and revisit (as warcinfo, request,
    metadata, which are passed over). Ids that are no page numbers of ours are null, and stand in record_id as they are.
    The payload is what follows the HTTP head of the block, the whole block if it has none; its size is its length, for a
    revisit that of its HTTP head (null without). All known digests that the record has are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode(errors="replace").split("\r\n")[1:])}
    kind = fields.get("warc-type", "").lower()
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)

    def number(x: str | None) -> int | None:
        own = (x or "").strip("<>").removeprefix(URN)
        return int(own) if (x or "").strip("<>").startswith(URN) and own.lstrip("-").isdigit() else None

    name, said = fields.get("warc-record-id"), fields.get("warc-payload-digest", "")
    if "warc-block-digest" in fields and not _digest_fits(fields["warc-block-digest"], block):
        raise ValueError(f"the block of {name} is damaged")
    if kind == "revisit":
        size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        digest, payload = said.removeprefix("sha256:") or None, None
    else:
        if len(block) < int(fields["content-length"]) or not _digest_fits(said, payload):
            raise ValueError(f"the payload of {name} is damaged")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return number(name), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), size, digest, payload, name


def _fetch(parts: Iterator[pd.DataFrame], with_payload: bool) -> Iterator[pd.DataFrame]:
    names, numbers = [c.split()[0] for c in RECORDS.split(", ")], {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}
    opened, file = None, None
    for part in parts:
        out, size, window, begin = [], 0, b"", 0
        for path, offset, length in zip(part["path"], part["offset"], part["length"]):
            if path != opened:
                if file:
                    file.close()
                fs, own = _fs(path)
                opened, file, window = path, fs.open_input_file(own), b""
            if not begin <= offset <= offset + length <= begin + len(window):
                file.seek(offset)
                window, begin = file.read(max(length, 1 << 18)), offset
            row = parse_record(gzip.decompress(window[offset - begin : offset - begin + length]))
            if row is None:
                continue
            out.append(row if with_payload else (*row[:6], None, row[7]))
            if (size := size + (len(row[6] or b"") if with_payload else 0)) > WINDOW:
                yield pd.DataFrame(out, columns=names).astype(numbers)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names).astype(numbers)
    if file:
        file.close()


def read_archives(packages: DataFrame, *, with_payload: bool = True, range_bytes: int = 4 << 20) -> DataFrame:
    """One row a response or revisit (see `parse_record`) of the packages named in column ``path``. A response's payload is checked against its
    digest; a revisit's size and digest are those of the full payload, from its headers, and its payload is null.
    Archives that the index doesn't list are read through; packages without archives give no rows. An archive that is
    compressed in the package, and an index that names an archive which isn't there, are errors: no record is left out."""
    lines = packages.select("path").mapInPandas(_index, LINES)
    dealt = lines.repartition("path", F.floor(F.col("offset") / range_bytes)).sortWithinPartitions("path", "offset")
    return dealt.mapInPandas(lambda parts: _fetch(parts, with_payload), RECORDS)
