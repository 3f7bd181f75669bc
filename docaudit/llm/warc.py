"""Deterministic sharded WARC writer and reader.

Records are cut into shards by ranges of their id, sorted within, and written as gzip members. A file ends
when its compressed size reaches the limit. Headers and digests are made anew from the payload. Equal payloads are stored
once: the smallest id is the response, the others are revisits that refer to it. Files get their names through
a manifest, so a repeated or failed task leaves nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.shard_files import commit, create, cut_shards, temporary_name
from docaudit.shared import written

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record, as a gzip member. A revisit has the headers of the answer, not its body."""
    revisit = refers_to is not None
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page)), ("WARC-Date", date),
        *([("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~"))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        *([("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the file ends within a record")
            piece = view[at : at + 16_384]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of a record, checked against its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *rows = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(r.split(": ", 1) for r in rows)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(r.split(": ", 1) for r in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}" or not revisit and (
        len(payload) != length or payload_digest(payload) != digest
    ):
        raise ValueError(f"{fields['WARC-Record-ID']}: digest or length does not match")

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": None if revisit else payload,
    }


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = 32 << 20,
    shards: int = 64,
    shard_bytes: int = 256 << 20,
    least_revisit: int = 0,
) -> DataFrame:
    """Write every row as a record below ``folder``; returns the manifest (file, path, records, bytes).

    ``file_bytes``: compressed size from which the next record starts a new file. ``shards``: at least so many, and more if
    one would hold over ``shard_bytes`` of payload. ``least_revisit``: smaller payloads are never revisits.

    A null payload is empty; a record without URL has no target. Ids are integers; a null id gets a record without number, in a shard
    after all others, and nothing refers to it. A shard that one id alone would overfill is dealt by digest. Rows that repeat one id and payload get a record each. An empty table gives an empty manifest.
    Other columns are not read. Revisits carry no payload, so their headers need only the narrow columns.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("bigint").alias("size"),
    )
    narrow = written(base.select("id", "digest", "size"), "digests")
    firsts = narrow.where(F.col("size") >= least_revisit).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("digest").alias("digest2"), "first")
    revisits = narrow.join(firsts, narrow.digest == firsts.digest2).where(~F.col("id").eqNullSafe(F.col("first")))
    # The role of a record arrives as a row of its own just before it, so payloads are moved only once.
    rows = base.select("id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("bigint").alias("first"), "size").unionByName(
        revisits.select("id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first", F.lit(0).cast("bigint").alias("size")).distinct()
    )
    cut = cut_shards(narrow, "id", F.col("size"), shards, shard_bytes)
    placed = rows.withColumn("shard", cut.of(F.col("id"), F.col("digest")))
    placed = placed.repartitionById(max(1, cut.count), F.col("shard")).sortWithinPartitions("shard", "id", "digest", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"shard": None, "part": 0, "out": None, "n": 0, "size": 0, "name": "", "temporary": ""}
        done: list[dict] = []

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                done.append({"file": state["name"], "temporary": state["temporary"], "records": state["n"], "bytes": state["size"]})
                state["out"] = None

        def manifest() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            done.clear()
            return found

        role: tuple = (None, None, None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    role = (r["id"], r["digest"], r["first"])
                    continue
                if state["shard"] != r["shard"]:
                    close()
                    state |= {"shard": r["shard"], "part": 0}
                if state["out"] is None:
                    temporary = temporary_name(folder)
                    state |= {
                        "out": create(temporary), "n": 0, "size": 0, "temporary": temporary,
                        "name": f"part-{r['shard']:06d}-{state['part']:05d}.warc.gz",
                    }
                    state["part"] += 1
                refers_to = role[2] if role[:2] == (r["id"], r["digest"]) else None
                data = record(r["id"], r["url"], r["html"].encode(), refers_to, date)
                state["out"].write(data)
                state["n"] += 1
                state["size"] += len(data)
                if state["size"] >= file_bytes:
                    close()
            if done:
                yield manifest()
        close()
        yield manifest()

    parts = placed.select("shard", "id", "digest", "kind", "url", "html", "first").mapInArrow(
        run, "file string, temporary string, records bigint, bytes bigint"
    )
    return commit(written(parts, "warc-parts"), folder)


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the files in a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Spark lists and reads the files; one file, bounded by its rolling size, is in memory at a time.
    A digest or length that does not match raises an error.
    """
    spark = manifest.sparkSession
    columns = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    columns += ", payload binary" if with_payload else ""
    some = manifest.select("path").first()
    if some is None:
        return spark.createDataFrame([], columns)
    folder = some["path"].rsplit("/", 1)[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.join(manifest.select(F.element_at(F.split("path", "/"), -1).alias("name")), F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in members(content.as_buffer()):
                    found = parse(data)
                    if not with_payload:
                        found.pop("payload")
                    rows.append(found)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(kinds + ([("payload", pa.binary())] if with_payload else []))
    return files.select("content").mapInArrow(run, columns)
