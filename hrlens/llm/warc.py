"""WARC archives: writing, and reading back with segment reassembly.

Writing gives each page one response record, or a revisit record where a page
with a larger id has an equal payload of ``min_revisit`` bytes or more (the
largest id is the response). A block is an HTTP message in chunked transfer
framing. Blocks above ``segment`` characters are cut: the record holds segment
1, and continuation records name it as their origin, count on, and the last
gives the total length.

Reading takes records out of the files in any order, groups segments by their
origin, orders them by number, checks that all are there and that their
lengths sum up to the stated total, and decodes the chunked framing.

Files are written, gzipped, by Spark's own writer into any folder that it can
reach; a record's closing line ends are its line separator.

Cases: null html is an empty payload; a null ``page_id`` or url leaves its
header out (such pages are never the response of others: null counts as the
smallest id, and with no other page of that payload all are responses);
repeated rows of the id that is the response are responses; an empty table
writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.llm.common import byte_batches, scratch, small_batches

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time; reruns agree
END = "\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """``min_revisit``: least payload bytes of a revisit. ``segment``: most
    characters of a block in one record. ``chunk``: characters of a transfer
    chunk. ``file_bytes``: archive size per file, about."""

    min_revisit: int = 1000
    segment: int = 16_384
    chunk: int = 8192
    file_bytes: int = 24_000_000


def chunked(payload: str, size: int) -> str:
    """A payload in chunked transfer framing; chunk sizes are bytes of UTF-8."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [f"{len(part.encode('utf-8')):x}\r\n", part, "\r\n"]
    return "".join(out) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing fails."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += n + 2


def _record(headers: list[tuple[str, str | None]], block: str) -> str:
    lines = [VERSION] + [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block.encode('utf-8'))}"]
    return "\r\n".join(lines) + END + block


def _line(s: str | None) -> str | None:
    return None if s is None else " ".join(s.split())


def records(key: str, page_id: int | None, url: str | None, html: str, digest: str, refers: int | None, spec: Archive) -> list[str]:
    """The records of a page, without the line ends that close each."""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{key}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", sha),
        ("Page-ID", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is not None:
        more = [("WARC-Profile", PROFILE), ("Refers-To-Page-ID", str(refers)), ("Payload-Length", str(len(html.encode("utf-8"))))]
        return [_record([*head, *more], HTTP + "\r\n")]
    block = HTTP + "Transfer-Encoding: chunked\r\n\r\n" + chunked(html, spec.chunk)
    parts = [block[i : i + spec.segment] for i in range(0, len(block), spec.segment)]
    if len(parts) == 1:
        return [_record(head, block)]
    out = [_record([*head, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = str(len(block.encode("utf-8"))) if n == len(parts) else None
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:page:{key}:{n}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"),
            ("WARC-Segment-Number", str(n)),
            ("WARC-Segment-Total-Length", total),
        ]
        out.append(_record(more, part))
    return out


def with_response(pages: DataFrame, spec: Archive) -> DataFrame:
    """page_id, url, html, digest, refers_to: the id of the page whose record
    holds the payload of a revisit, null for a response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    best = rows.where(F.col("size") >= spec.min_revisit).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    best = best.where("n > 1 and best is not null").select("digest", "best")
    # Hashed by the few digests found twice, the pages themselves need no sorting.
    rows = rows.join(best.hint("shuffle_hash"), "digest", "left")
    refers = F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, spec: Archive = Archive()) -> None:
    """Archive files of ``pages`` (page_id, url, html). Each task writes its
    own rows, into a new file after so many records."""
    small_batches(pages.sparkSession, 500)
    byte_batches(pages.sparkSession)
    size, n = pages.agg(F.sum(F.octet_length("html").cast("decimal(38,0)")), F.count("*")).first()
    per_file = max(1, n * spec.file_bytes // max(1, int(size or 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for row, page_id, url, html, digest, refers in zip(b["row"], b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"]):
                ids = [None if x is None else int(x) for x in (page_id, refers)]
                key = f"{'none' if ids[0] is None else ids[0]}:{row:x}"
                made += records(key, ids[0], url, html, digest, ids[1], spec)
            yield pd.DataFrame({"record": made})

    # The row's number makes a record id its own, also where rows repeat. No
    # shuffle follows, so a task that runs again writes all its records anew.
    rows = with_response(pages, spec).withColumn("row", F.monotonically_increasing_id())
    # Ids go as text: beside a null, whole numbers would come as floats.
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    rows.mapInPandas(run, "record string").write.options(lineSep=END, maxRecordsPerFile=per_file, compression="gzip").text(folder)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file, gzipped or plain."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode("utf-8").split("\r\n")
        if first != VERSION:
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        n = int(headers["Content-Length"])
        block = content[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) != n or content[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("record of another length than stated")
        yield headers, block


RECORD = "origin string, type string, page_id string, url string, digest string, refers_to string, stated long"
SEGMENT = f"{RECORD}, segment int, total long, block binary"
PAYLOAD = f"{RECORD}, payload binary, sha1 string"


def _segments(batches: Iterator[pd.DataFrame], cut: bool | None) -> Iterator[pd.DataFrame]:
    number = lambda x: None if x is None else int(x)
    for b in batches:
        for content in b["content"]:
            rows = []
            for h, block in parse(content):
                if cut is not None and cut != ("WARC-Segment-Number" in h):
                    continue
                sha = h.get("WARC-Payload-Digest")
                rows.append(
                    (
                        h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]),
                        int(h.get("WARC-Segment-Number", 0)),
                        number(h.get("WARC-Segment-Total-Length")),
                        h["WARC-Type"],
                        h.get("Page-ID"),
                        h.get("WARC-Target-URI"),
                        sha and base64.b32decode(sha.split(":")[1]).hex(),
                        h.get("Refers-To-Page-ID"),
                        number(h.get("Payload-Length")),
                        block,
                    )
                )
                if len(rows) == 500:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    byte_batches(spark)  # an archive file at a time goes to a worker
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def read_segments(spark: SparkSession, folder: str, cut: bool | None = None) -> DataFrame:
    """A row per record: origin, segment, total, type, page_id, url, digest,
    refers_to, stated (payload bytes of a revisit), block; ids are text. With ``cut`` only
    the segments of cut blocks (true) or only whole records (false)."""
    return _files(spark, folder).mapInPandas(lambda batches: _segments(batches, cut), SEGMENT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["origin", "segment", "total", "type", "page_id", "url", "digest", "refers_to", "stated", "block"]
    whole = {c: pd.array([r[names.index(c)] for r in rows], dtype="Int64") for c in ("total", "stated")}
    return pd.DataFrame(rows, columns=names).assign(**whole)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for block in b["block"]:
            head, body = block.split(b"\r\n\r\n", 1)
            out.append(unchunked(body) if b"\r\nTransfer-Encoding: chunked" in head else body)
        kept = b.drop(columns=["block", "segment", "total"], errors="ignore")
        made = {"payload": out, "sha1": [hashlib.sha1(x).hexdigest() for x in out]}
        # Without a record, a list alone would become a column of floats.
        yield kept.assign(**{c: pd.Series(x, kept.index, dtype=object) for c, x in made.items()})


def reassembled(segments: DataFrame, decode: bool = False) -> DataFrame:
    """The records that ``segments`` were cut from: grouped by origin, ordered
    by number and checked. With ``decode`` what ``payloads`` makes of them."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("segment")
        block = b"".join(g["block"])
        if list(g["segment"]) != list(range(1, len(g) + 1)) or g["total"].iloc[-1] != len(block):
            raise ValueError(f"{g['origin'].iloc[0]}: segments missing, or of another length than stated")
        whole = g.iloc[:1].drop(columns=["segment", "total"]).assign(block=[block])
        return next(_decoded(iter([whole]))) if decode else whole

    return segments.groupBy("origin").applyInPandas(run, PAYLOAD if decode else f"{RECORD}, block binary")


def payloads(records: DataFrame) -> DataFrame:
    """``records`` with the decoded payload of each block, and its digest."""
    return records.mapInPandas(_decoded, PAYLOAD)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page of an archive: page_id, url, payload (null for a
    revisit), payload_bytes, payload_digest, record_type, refers_to. The
    digest and size of a revisit are those its record states of the payload.
    A response whose payload has another digest than stated raises an error."""
    # Whole records are not shuffled. Archives are unpacked for either kind,
    # but a record is taken up and decoded once, by the one worker of a task.
    cut = reassembled(read_segments(spark, folder, cut=True), decode=True)
    rows = _files(spark, folder).mapInPandas(lambda batches: _decoded(_segments(batches, False)), PAYLOAD).unionByName(cut)
    is_response = F.col("type") == "response"
    wrong = is_response & (F.col("sha1") != F.col("digest"))
    rows = rows.withColumn("digest", F.when(wrong, F.raise_error(F.concat(F.lit("payload of "), "origin"))).otherwise(F.col("digest")))
    size = F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("stated"))
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.when(is_response, F.col("payload")).alias("payload"),
        size.alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def archive(pages: DataFrame, spec: Archive = Archive(), folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archive back."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write(pages, folder, spec)
    return read(spark, folder)
