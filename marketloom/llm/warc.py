"""WARC archives as a Spark data source.

``spark.read.format("warc").load(dir)`` plans one partition for each archive file that the
committed writes list (or that the folder holds, if none does), gzip or plain. A reader
inflates only the head of a record, parses the WARC headers, and tests the pushed predicates
on record type and headers; an unwanted record's payload is skipped by the lengths in its gzip
header (the ``sl`` extra field of the WARC standard) or, in a plain file, by its own length,
neither inflated nor decoded. Without that field the rest of the member is inflated and thrown
away. Archives of other writers are read too: any record type, header names in any case,
missing headers as nulls.

Writers give each task attempt a file of its own name; each commit on the driver writes a
manifest of its files that succeeded, so files of lost or repeated tasks are never read and
appends add up. Folders are opened through pyarrow's file systems, so any shared store that has
one will do; reads go through a buffer, so small records share a request.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from marketloom.llm.scratch import new_path, table

SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Payloads under so many bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 1000
#: A writer starts a new file beyond so many bytes.
FILE_BYTES = 128 << 20
MANIFEST = "_manifest"
#: Bytes that a reader fetches at once.
AHEAD = 1 << 20
_HEAD = 4096
_BLANKS = {" ": "%20", "\t": "%09"}
_EDGE = re.compile(r"^(?:%20|%09)+|(?:%20|%09)+$")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
_BASE32 = re.compile(r"[A-Z2-7]{32}")


def open_dir(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path inside it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(row: dict) -> bytes:
    """A WARC record, in WARC order of headers, from a row of SCHEMA."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    heads = [f"WARC-Type: {row['record_type']}"]
    if row["page_id"] is not None:
        heads.append(f"WARC-Record-ID: <urn:page:{row['page_id']}>")
    if row["target_uri"] is not None:
        heads.append("WARC-Target-URI: " + escape_uri(row["target_uri"]))
    heads.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        heads += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(heads) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def escape_uri(uri: str) -> str:
    """The URI on one header line: no line ends, no blanks at its edges."""
    uri = uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    bare = uri.strip(" \t")
    at = uri.index(bare)
    return "".join(_BLANKS[c] for c in uri[:at]) + bare + "".join(_BLANKS[c] for c in uri[at + len(bare) :])


def unescape_uri(uri: str) -> str:
    """The URI as it was before ``escape_uri``."""
    uri = _EDGE.sub(lambda m: m[0].replace("%20", " ").replace("%09", "\t"), uri)
    return uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(data: bytes, most: int = 0xFFFFFFFF) -> bytes:
    """A gzip member with the skip lengths of both forms in its extra field. A member too long
    for the field (``most`` bytes) has none: it is skipped by inflating it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    if max(whole, len(data)) > most:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Committed(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


def _number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def parse_head(head: bytes) -> dict[str, str]:
    """Header lines by name in lower case; folded lines are put together, of repeats the first stays."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines()[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.decode("latin-1").strip().lower(), value.strip(b" \t\r").decode("utf-8", "replace"))
    return out


def digest(value: str | None) -> str | None:
    """A SHA-1 as lower-case hex, from hex or the usual base 32; others as they stand."""
    if value is None:
        return None
    kind, colon, bare = value.partition(":")
    if colon and kind.lower() != "sha1":
        return value
    bare = bare if colon else value
    return base64.b32decode(bare.upper()).hex() if _BASE32.fullmatch(bare.upper()) else bare.lower()


def digest_forms(value: str) -> set[str]:
    """The header values that ``digest`` takes to this one."""
    if not re.fullmatch("[0-9a-f]{40}", value):
        return {value}
    forms = {value, value.upper(), base64.b32encode(bytes.fromhex(value)).decode()}
    return forms | {f"{kind}:{x}" for x in forms for kind in ("sha1", "SHA1")}


def whole(text: str | None) -> int | None:
    """A header's number; null if there is none."""
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


class Ahead:
    """A file that is read in pieces of ``AHEAD`` bytes; what a seek stays within is kept."""

    def __init__(self, f: pa.NativeFile):
        self.f, self.length, self.at, self.begin, self.held = f, f.size(), 0, 0, b""

    def size(self) -> int:
        return self.length

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, n: int) -> bytes:
        n = max(0, min(n, self.length - self.at))
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.held):
            self.f.seek(self.at)
            self.begin, self.held = self.at, self.f.read(max(n, AHEAD))
        out = self.held[self.at - self.begin : self.at - self.begin + n]
        self.at += len(out)
        return out


def plain_records(f: Ahead, wanted: dict[str, set], payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of a file that isn't compressed; without ``payloads`` a block ends about
    where its HTTP header does."""
    at = 0
    while at < f.size():
        f.seek(at)
        text = b""
        while b"\r\n\r\n" not in text.lstrip(b"\r\n"):
            more = f.read(_HEAD)
            if not more:
                if not text.strip():
                    return
                raise ValueError(f"the record at byte {at} has no end of headers")
            text += more
        lead = len(text) - len(text.lstrip(b"\r\n"))  # blank lines between records
        head, _, _ = text[lead:].partition(b"\r\n\r\n")
        headers = parse_head(head)
        size = whole(headers.get("content-length"))
        if not head.startswith(b"WARC/") or size is None:
            raise ValueError(f"no WARC record at byte {at + lead}")
        begin = at + lead + len(head) + 4
        if all(headers.get(k) in v for k, v in wanted.items()):
            f.seek(begin)
            block = f.read(size if payloads else min(size, _HEAD))
            while not payloads and b"\r\n\r\n" not in block and len(block) < size:
                block += f.read(min(size - len(block), _HEAD))
            if payloads and len(block) < size:
                raise ValueError(f"the record at byte {at} is cut off")
            yield headers, block
        at = begin + size


def records(f: Ahead, wanted: dict[str, set], payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose headers have the wanted values."""
    size = f.size()
    at = 0
    while at < size:
        f.seek(at)
        start = f.read(_HEAD)
        if start[:4] != b"\x1f\x8b\x08\x04" and start[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        skip = None
        if start[3] & 4:
            (n,) = struct.unpack_from("<H", start, 10)
            body, k = 12 + n, 12
            while k < body:
                tag, m = start[k : k + 2], struct.unpack_from("<H", start, k + 2)[0]
                if tag == b"sl" and m == 8:
                    skip = struct.unpack_from("<I", start, k + 4)[0]
                k += 4 + m
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(start, _HEAD)
        while b"\r\n\r\n" not in text and not inflate.eof:
            more = inflate.unconsumed_tail or f.read(_HEAD)
            if not more:
                raise ValueError(f"the record at byte {at} has no end of headers")
            text += inflate.decompress(more, _HEAD)
        head, _, block = text.partition(b"\r\n\r\n")
        headers = parse_head(head)
        ok = all(headers.get(k) in v for k, v in wanted.items())
        while ok and b"\r\n\r\n" not in block and not inflate.eof:  # to the end of the HTTP header
            more = inflate.unconsumed_tail or f.read(_HEAD)
            if not more:
                raise ValueError(f"the record at byte {at} is cut off")
            block += inflate.decompress(more, _HEAD)
        if ok and payloads:
            parts, tail = [block], inflate.unconsumed_tail
            while not inflate.eof:
                tail = tail or f.read(1 << 20)
                if not tail:
                    raise ValueError(f"the record at byte {at} is cut off")
                parts.append(inflate.decompress(tail))
                tail = inflate.unconsumed_tail
            block = b"".join(parts)[: whole(headers.get("content-length"))]
        if skip is None:
            tail = inflate.unconsumed_tail
            while not inflate.eof:
                tail = tail or f.read(1 << 20)
                if not tail:
                    raise ValueError(f"the record at byte {at} is cut off")
                inflate.decompress(tail, 1 << 20)
                tail = inflate.unconsumed_tail
            skip = f.tell() - at - len(inflate.unused_data)
        if ok:
            yield headers, block
        at += skip


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in _COLUMNS and values is not None:
                if name == "payload_digest":
                    values = {form for v in values for form in digest_forms(v)}
                elif name == "target_uri":
                    values = {escape_uri(v) for v in values}
                header = _COLUMNS[name]
                self.wanted[header] = self.wanted[header] & values if header in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = open_dir(self.path)
        found = fs.get_file_info(pafs.FileSelector(root))
        lists = [x.path for x in found if x.base_name.startswith(MANIFEST)]
        if lists:
            names = set()
            for path in lists:
                with fs.open_input_stream(path) as f:
                    names.update(json.loads(f.read()))
        else:
            names = {x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz"))}
        return [File(f"{self.path}/{x}") for x in sorted(names)]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file: an empty archive
            return
        fs, path = open_dir(partition.path)
        with fs.open_input_file(path) as raw:
            f = Ahead(raw)
            packed = f.read(2) == b"\x1f\x8b"
            for h, block in (records if packed else plain_records)(f, self.wanted, self.payloads):
                yield self.row(h, block)

    def row(self, h: dict[str, str], block: bytes) -> tuple:
        """A row of SCHEMA. A response's payload is what follows its HTTP header, a revisit has
        none, any other record's is its block; the size is that of the full payload if a
        header tells it."""
        kind, uri, size = h.get("warc-type"), h.get("warc-target-uri"), whole(h.get("content-length"))
        payload: bytes | None = block
        if kind in ("response", "revisit") and block[:5] == b"HTTP/":
            head, end, payload = block.partition(b"\r\n\r\n")
            told = whole(parse_head(head).get("content-length"))
            size = told if told is not None else None if size is None or kind == "revisit" else size - len(head) - len(end)
        elif kind == "revisit":
            size = None
        return (
            kind, _number(h.get("warc-record-id")), uri and unescape_uri(uri), digest(h.get("warc-payload-digest")), size,
            _number(h.get("warc-refers-to")), payload if self.payloads and kind != "revisit" else None,
        )


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, root = open_dir(self.path)
        fs.create_dir(root, recursive=True)
        names, out = [], None
        for row in iterator:
            if out is None:
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
            out.write(member(record(row.asDict())))
            if out.tell() > FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Committed(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_dir(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.base_name.startswith(MANIFEST):
                    fs.delete_file(old.path)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_dir(self.path)
        for name in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """Options: path; payload (false leaves payloads out and their bytes undecoded)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def typed_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of SCHEMA for ``pages``: of equal payloads of ``min_bytes`` or more, the record of
    the largest id is the response and the others revisit it.

    Equal payloads are counted by digest with partial aggregation, so thousands of copies are
    a row a task; only digests that repeat are joined back.

    * A null html is an empty payload; payloads under ``min_bytes`` are all responses.
    * Repeated rows of the largest id are all responses. A null id never is the largest; if
      all ids of a group are null, all its rows are responses.
    * A null url leaves the header out. Other columns are left out. Empty tables are kept.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    tops = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1 and top is not null")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.join(tops, "payload_digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "target_uri",
        "payload_digest",
        "payload_bytes",
        F.when(again, F.col("top")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, **names) -> None:
    """Write ``typed_records`` of ``pages`` as gzip WARC files under ``path``."""
    register(pages.sparkSession)
    typed_records(pages, **names).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA; predicates on record_type, target_uri and payload_digest are pushed."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: digests and sizes of responses come from the decoded
    payload, those of revisits from the record's headers."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    full = read_warc(spark, path).where("record_type = 'response'")
    back = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    seen = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return back.unionByName(seen.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""
