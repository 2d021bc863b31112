"""WARC archives as a Python data source, ``format("warc")``.

Writing: every task writes files of bounded size into the archive folder; a manifest
names those of committed tasks only, so files of lost or repeated attempts don't count.
Reading: the manifest gives one input partition per file. Filters on ``warc_type`` and on
other header fields are pushed down. A record's header is parsed first; unless the filters
want the record, its block is stepped over, and with the option ``payload=false`` wanted
payloads are stepped over too, unread and not decompressed.

A response's block is its HTTP header and the payload, gzip-encoded. A revisit's block is
the HTTP header alone; the record it refers to has the payload.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from splitlane.llm.common import fresh_path, small_side, stored

#: A task begins a new file beyond this many bytes.
FILE_BYTES = 64 << 20
ROW = (
    "warc_type string, page_id long, url string, payload_bytes long, payload_digest string,"
    " refers_to long, payload binary"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_MANIFEST = "manifest.json"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _id(page: int | None) -> str:
    return f"<{_PAGE}{page}>" if page is not None else f"<{uuid.uuid4().urn}>"


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>")
    return int(text.removeprefix(_PAGE)) if text.startswith(_PAGE) else None


def _one_line(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(row) -> bytes:
    """The bytes of one record."""
    payload = bytes(row.payload or b"")
    response = row.warc_type == "response"
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {row.payload_bytes}"]
    if response:
        http.append("Content-Encoding: gzip")
    block = "\r\n".join([*http, "", ""]).encode()
    if response:
        block += gzip.compress(payload, 1, mtime=0)
    head = ["WARC/1.1", f"WARC-Type: {row.warc_type}", f"WARC-Record-ID: {_id(row.page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row.url is not None:
        head.append(f"WARC-Target-URI: {_one_line(row.url)}")
    head.append(f"WARC-Payload-Digest: sha1:{row.payload_digest}")
    if not response:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(row.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for row in iterator:
            if out is None or size >= FILE_BYTES:
                if out is not None:
                    out.close()
                files.append(f"{uuid.uuid4().hex}.warc")
                out, size = store.open_output_stream(f"{folder}/{files[-1]}"), 0
            data = record(row)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{_MANIFEST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list) -> None:
        store, folder = filesystem(self.path)
        for message in messages:
            for name in message.files if message else ():
                store.delete_file(f"{folder}/{name}")


@dataclass
class WarcFile(InputPartition):
    name: str


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        if line in (b"\r\n", b"\n", b""):
            return out
        key, _, value = line.decode().partition(":")
        out[key.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Takes equality filters on what the header says; the rest stays with Spark."""
        header = {"warc_type", "page_id", "url", "payload_digest", "refers_to"}
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in header:
                self.wanted.append((name, frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list:
        store, folder = filesystem(self.path)
        with store.open_input_stream(f"{folder}/{_MANIFEST}") as manifest:
            return [WarcFile(name) for name in json.loads(manifest.read())]

    def read(self, partition: WarcFile | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, folder = filesystem(self.path)
        with io.BufferedReader(store.open_input_file(f"{folder}/{partition.name}"), 1 << 20) as lines:
            while line := lines.readline():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record where one should begin in {partition.name}")
                head = _fields(lines)
                end = lines.tell() + int(head["content-length"])
                row = {
                    "warc_type": head["warc-type"],
                    "page_id": _page(head["warc-record-id"]),
                    "url": head.get("warc-target-uri"),
                    "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                    "refers_to": _page(head.get("warc-refers-to")),
                }
                if all(row[name] in values for name, values in self.wanted):
                    lines.readline()  # the HTTP status
                    http = _fields(lines)
                    body = None
                    if self.payload and row["warc_type"] == "response":
                        body = gzip.decompress(lines.read(end - lines.tell()))
                    yield (
                        row["warc_type"],
                        row["page_id"],
                        row["url"],
                        int(http["x-payload-length"]),
                        row["payload_digest"],
                        row["refers_to"],
                        body,
                    )
                lines.seek(end + 4)


class WarcSource(DataSource):
    """Options: ``path``, and ``payload`` (``false``: leave payloads out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ROW

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1."""

    @F.pandas_udf("string")
    def encode(values):
        return values.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode(), na_action="ignore")

    return encode(hex_digest)


def archive_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """One archive row per page: payload, digest, and whether it is a response or a revisit.

    Of pages with equal payloads of at least ``least_bytes`` the smallest id is the response
    and the others revisit it; smaller payloads are all responses. Null html is an empty
    payload. Rows that repeat the smallest id are responses too. A page without an id comes
    after all others; where no page of a group has one, all are responses.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    light = rows.select("page_id", "sha1", "payload_bytes").where(F.col("payload_bytes") >= least_bytes)
    shared = (
        light.groupBy("sha1")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 and refers_to is not null")
        .select("sha1", "refers_to")
    )
    revisits = stored(
        light.join(shared, "sha1")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("sha1", F.col("page_id").alias("revisit_id"), "refers_to")
        .distinct(),
        "revisits",
    )
    side = small_side(revisits, revisits.count())
    same = (rows["sha1"] == side["sha1"]) & rows["page_id"].eqNullSafe(side["revisit_id"])
    return rows.join(side, same, "left").select(
        F.when(side["refers_to"].isNull(), "response").otherwise("revisit").alias("warc_type"),
        "page_id",
        "url",
        "payload_bytes",
        base32(rows["sha1"]).alias("payload_digest"),
        "refers_to",
        F.when(side["refers_to"].isNull(), F.col("payload")).alias("payload"),
    )


def write_archive(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").option("path", path).mode("append").save()


def read_archive(spark, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive; turns on the pushing of filters into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages into an archive in the shared folder and reads it back.

    Of responses, length and digest are those of the payload as read; of revisits, those
    that the header states, and no payload is decoded.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(archive_rows(pages, id_col, url_col, html_col), path)
    common = ("page_id", "url", "warc_type")
    responses = read_archive(spark, path).where(F.col("warc_type") == "response")
    revisits = read_archive(spark, path, payload=False).where(F.col("warc_type") == "revisit")
    return responses.select(
        *common,
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        "refers_to",
    ).unionByName(revisits.select(*common, "payload_bytes", "payload_digest", "refers_to"))
