"""WARC records in ZIP packages, written in tasks and read back by byte ranges.

A package holds, stored and not deflated, a WARC file whose records are gzip
members, and an index with each record's place. The reader takes a package's last
bytes, finds the central directory (ZIP64 or not), from it the members, from the
index the records; record ranges are then dealt out and read, each from its place,
without unpacking anything else. Packages of other tools are read too: members are known by their endings, the index is CDXJ, and
record ids may be any.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut, join_uneven, scratch, short_batches

#: A package is closed once its records take so many bytes.
PACKAGE_BYTES = 16 << 20
#: Records of one range at most.
RANGE_RECORDS = 512
#: As many groups of equal payloads as may be broadcast: a row of them takes under 100 bytes.
BROADCAST_GROUPS = 100_000
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
_OWN_ID = re.compile(r"<urn:page:(-?\d+)>")
_FEED = 1 << 16
_READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload, only its digest and length."""
    name = "none" if page_id is None else page_id
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        plain = "".join(url.splitlines())
        head.append(("WARC-Target-URI", plain))
        if plain != url:
            head.append(("X-Target-URI-JSON", json.dumps(url)))
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return packer.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


def _own(name: str | None) -> int | None:
    found = _OWN_ID.fullmatch(name or "")
    return int(found[1]) if found else None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on with the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def parse(raw: bytes) -> dict:
    """The row of a record whose gzip member has been unpacked.

    ``page_id`` and ``refers_to`` are null where ids aren't those of ``record``. A record that is no HTTP message, such as one of metadata, has its
    block as payload. A digest in base32 SHA-1 is checked if the payload is as long as its message says; one that is missing is computed.
    """
    head, _, rest = raw.lstrip(b"\r\n").partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    kind, payload, size = fields.get("warc-type", ""), block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = _fields(http).get("content-length", "")
        size = int(told) if told.isdigit() else None
    whole = kind != "revisit"
    stored = fields.get("warc-payload-digest", "").removeprefix("sha1:") or (digest(payload) if whole else None)
    if whole and re.fullmatch("[A-Z2-7]{32}", stored) and size == len(payload) and digest(payload) != stored:
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't match its digest")
    if whole and _own(fields.get("warc-record-id")) is not None and size != len(payload):
        raise ValueError(f"payload of {fields['warc-record-id']} isn't whole")
    url = json.loads(fields["x-target-uri-json"]) if "x-target-uri-json" in fields else fields.get("warc-target-uri")
    return {
        "record_id": fields.get("warc-record-id"), "page_id": _own(fields.get("warc-record-id")), "url": url, "record_type": kind, "refers_to": _own(fields.get("warc-refers-to")),
        "payload_bytes": len(payload) if whole else size, "payload_digest": stored, "payload": payload if whole else None,
    }


def unpacked(raw: bytes) -> Iterator[bytes]:
    """The gzip members of ``raw``, one after the other. They are fed in small pieces, so that none copies all that follows it."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof and at < len(raw):
            piece = view[at : at + _FEED]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("a record's gzip member has no end")
        yield b"".join(out)


def package(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP package of records, and their CDXJ index, as stored members."""
    data, index, at = [], [], 0
    for page_id, raw in records:
        index.append(f"page,{'none' if page_id is None else page_id})/ 19700101000000 " + json.dumps({"filename": WARC_MEMBER.rpartition("/")[2], "offset": str(at), "length": str(len(raw))}))
        data.append(raw)
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((WARC_MEMBER, b"".join(data)), (INDEX_MEMBER, "\n".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(body)
    return out.getvalue()


def index_lines(text: str) -> Iterator[tuple[str, int, int]]:
    """filename, offset, length of the records of a CDXJ index, in order of their places: what is before a line's braces is its key."""
    found = set()
    for line in text.splitlines():
        at = line.find("{")
        if at >= 0 and not line.startswith("!"):
            entry = json.loads(line[at:])
            if "offset" in entry and "length" in entry:
                found.add((entry.get("filename", ""), int(entry["offset"]), int(entry["length"])))
    yield from sorted(found)


def record_ranges(read, size: int, range_records: int) -> Iterator[tuple[int, int]]:
    """Place and length of runs of records of a package, of ``range_records`` at most; an archive member that no index names is one run."""
    found = members(read, size)
    archives = {n.rpartition("/")[2]: m for n, m in found.items() if n.endswith(".warc.gz")}
    if any(m[2] for m in archives.values()):
        raise ValueError("archive members aren't stored")
    entries: dict[str, list[tuple[int, int]]] = {}
    for name, (place, length, method) in found.items():
        if re.search(r"\.cdxj?(\.gz)?$", name):
            text = read(place, length)
            text = zlib.decompress(text, -15) if method == 8 else text
            text = b"".join(unpacked(text)) if name.endswith(".gz") else text
            for file, offset, n in index_lines(text.decode("utf-8", "replace")):
                own = file.rpartition("/")[2] or (next(iter(archives)) if len(archives) == 1 else "")
                if own in archives:
                    entries.setdefault(own, []).append((offset, n))
    for name, (place, length, _) in sorted(archives.items()):
        # Runs meet: records that the index leaves out, such as requests, are read with those before them.
        places = sorted({at for at, _ in entries.get(name, [])})[range_records::range_records] if name in entries else []
        edges = [0, *places, length]
        yield from ((place + lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo)


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (place of its bytes, length, method), from the central directory. ``read(offset, length)`` gives bytes."""
    tail_at = max(0, size - 66_000)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (big,) = struct.unpack_from("<Q", tail, end - 12)
        count, length, offset = struct.unpack("<QQQ", read(big, 56)[32:56])
    directory, at, found = read(offset, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, full = struct.unpack_from("<H8xII", directory, at + 10)
        n, extra_n, comment_n = struct.unpack_from("<HHH", directory, at + 28)
        (place,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode("utf-8")
        extra, k = directory[at + 46 + n : at + 46 + n + extra_n], 0
        while k + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            k += 4 + m
        local = read(place, 30)
        skip = sum(struct.unpack_from("<HH", local, 26))
        found[name] = (place + 30 + skip, packed, method)
        at += 46 + n + extra_n + comment_n
    return found


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes (page_id, url, html, refers_to) and gives a written table of path, records.

    A package's name is new in every attempt of a task; only what a finished task lists is read.
    """
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(package(held))
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(held)}], pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page, url, text, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page, url, text.encode("utf-8", "replace"), other)
                held.append((page, raw))
                size += len(raw)
                if size >= package_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return cut(rows.mapInArrow(run, "path string, records bigint"), "packages")


def read_packages(paths: DataFrame, range_records: int = RANGE_RECORDS, keep_payload: bool = True) -> DataFrame:
    """Records of the packages in ``paths`` (path): record_id, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    short_batches(paths.sparkSession)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                fs, name = _fs(path)
                with fs.open_input_file(name) as f:
                    out += [{"path": path, "at": at, "length": n} for at, n in record_ranges(lambda at, n, f=f: f.read_at(n, at), f.size(), range_records)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = _fs(path)
                with fs.open_input_file(name) as f:
                    raw = f.read_at(length, at)
                rows: list[dict] = []
                for whole in unpacked(raw):
                    rows.append(parse(whole))
                    if not keep_payload:
                        rows[-1]["payload"] = None
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    ranges = paths.select("path").mapInArrow(locate, "path string, at bigint, length bigint")
    n = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n).mapInArrow(load, "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Writes a record per row of ``pages`` into ``folder`` and reads all of them back.

    The payload is the html in UTF-8, empty for null. Of payloads of at least
    ``least_bytes`` with one digest and length, the smallest id's record is the
    response and the others revisit it; smaller ones are all responses, as is a row
    with a null id. A row that repeats the response's id is a response too. Ids are
    integers. An empty table gives an empty result; other columns aren't read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    size = F.octet_length("html")
    key = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", size)
    groups = key.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups, "payloads")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    written = join_uneven(key, groups, ["sha", "size"], "n", F.xxhash64("page_id", "url"), BROADCAST_GROUPS).select("page_id", "url", "html", refers.alias("refers_to"))
    return read_packages(write_packages(written, folder or scratch(spark, "warc")), keep_payload=keep_payload)
