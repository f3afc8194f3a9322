"""WARC archives with dictionary compression, written and read through Spark.

An archive is an output file: a leading skippable frame that holds a Zstandard
dictionary trained on all of the archive's own records, then a frame per record. A
task rolls its archives by size. The writer rolls files by the number of rows, so an
archive that another one follows is filled up with empty skippable frames.
Archives leave through Spark's text writer and its commit protocol, so they reach
any file system Spark writes to and a task that runs twice leaves one archive. The
writer ends every row with the line separator, for which an empty skippable frame
serves: readers of Zstandard pass over it.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: magic 0x184D2A50 and length 0, all ASCII.
FILLER = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
_SPACE = uuid.UUID("6f0d9a52-3f0e-4d8b-9a61-1a2b6c0de9f1")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _lines(*pairs) -> bytes:
    # Header values stay on one line whatever the data holds.
    return "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in pairs if v is not None).encode("utf-8", "replace")


def make_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """A response record, or a revisit that carries the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    block = http if is_revisit else http + payload
    head = b"WARC/1.1\r\n" + _lines(
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url}|{digest}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if is_revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if is_revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to if is_revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    )
    return head + b"\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    body = b"software: skerry\r\nformat: WARC File Format 1.1\r\n"
    head = _lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info")), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body)))
    return b"WARC/1.1\r\n" + head + b"\r\n" + body + b"\r\n\r\n"


def train(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records, or none where they are too few or too alike to give one."""
    try:
        return zstandard.train_dictionary(size, records, d=8, k=256, f=20, accel=4)
    except (zstandard.ZstdError, ValueError):
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def _frames(level: int, dict_size: int, archive_bytes: int, slots: int, date: str):
    def archive(records: list[bytes], last: bool):
        found = train(records, dict_size)
        c = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **({} if found is None else {"dict_data": found}))
        out = ([] if found is None else [dictionary_frame(found)]) + [c.compress(x) for x in (_info(date), *records)]
        out += [FILLER.encode()] * (0 if last else slots - len(out))
        for i in range(0, len(out), 1 << 12):
            yield pa.record_batch([pa.array(out[i : i + (1 << 12)], pa.binary())], names=["frame"])

    def frames(batches):
        held, size = [], 0
        for b in batches:
            for p, u, h, d, r in zip(*(b.column(i).to_pylist() for i in range(5))):
                # Closed only when another record follows; two frames aren't records.
                if held and (size >= archive_bytes or len(held) == slots - 2):
                    yield from archive(held, False)
                    held, size = [], 0
                held.append(make_record(p, u, h, d, r, r is not None and p != r, date))
                size += len(held[-1])
        if held:
            yield from archive(held, True)

    return frames


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the response's page, its own for the response itself."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    # Written out first: payloads move only if the repeated digests are too many to send along.
    groups = materialize(groups.where("n > 1 and refers_to is not null").select("digest", "refers_to"), "repeated-payloads")
    return rows.join(groups, "digest", "left").select("page_id", "url", F.encode("html", "UTF-8").alias("html"), "digest", "refers_to")


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    level: int = 6,
    dict_size: int = 1 << 16,
    archive_bytes: int = 1 << 26,
    slots: int = 1 << 14,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per row of ``pages`` to archives under ``path``.

    Of equal payloads of at least 100 bytes, the row of the smallest page id is the
    response and the others revisit it; smaller payloads are always responses. A null
    html is an empty payload. A row with a null id carries no id and is a revisit
    wherever its payload has a response with one. Rows that repeat the response's id
    along with its payload are responses too. An empty table writes no record.
    An archive ends with the record that brings it to ``archive_bytes`` before
    compression, or at ``slots`` frames; its dictionary is trained on all its records.
    """
    rows = plan_records(pages, id_col, url_col, html_col)
    frames = rows.mapInArrow(_frames(level, dict_size, archive_bytes, slots, date), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", FILLER).option("compression", "none").option("maxRecordsPerFile", slots).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its block headers."""
    head = data[at : at + 18]
    params = zstandard.get_frame_parameters(head)
    i = at + zstandard.frame_header_size(head)
    while True:
        h = int.from_bytes(data[i : i + 3], "little")
        i += 3 + (1 if (h >> 1) & 3 == 1 else h >> 3)
        if h & 1:
            return i + (4 if params.has_checksum else 0)


def read_frames(data):
    """Yield the records of an archive, each from a frame of its own."""
    data, at, d = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                raw = bytes(data[at + 8 : at + 8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        else:
            end = frame_end(data, at)
            yield d.decompress(data[at:end])
            at = end


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return h, _headers(http), payload


def _parse(with_payload):
    fields = "page_id payload_bytes payload_digest record_type refers_to url".split()

    def rows(batches):
        for b in batches:
            for content in b.column(0):
                out, bodies, held = [], [], 0

                def batch():
                    cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))]
                    extra = [pa.array(bodies, pa.binary())] if with_payload else []
                    return pa.record_batch(cols + extra, names=fields + ["payload"] * with_payload)

                for raw in read_frames(content.as_buffer()):
                    h, http, payload = parse_record(raw)
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = h["warc-payload-digest"].partition(":")[2]
                    size = len(payload)
                    if kind == "response":
                        found = hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"payload of {h.get('warc-record-id')} doesn't match its digest")
                    else:
                        size = int(http["content-length"])
                    page, ref = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    out.append((page and int(page), size, digest, kind, ref and int(ref), h.get("warc-target-uri")))
                    bodies.append(payload if with_payload else None)
                    held += len(payload) if with_payload else 64
                    if held > 1 << 23:
                        yield batch()
                        out, bodies, held = [], [], 0
                if out:
                    yield batch()

    return rows


def read_warc(spark, path: str, with_payload: bool = False) -> DataFrame:
    """A row per response or revisit record of the archives under ``path``.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if
    asked, payload (empty for revisits). A payload that doesn't match its digest is
    an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return files.mapInArrow(_parse(with_payload), schema)
