"""WARC archives: segmented records written through Spark, read back and put together again."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymesh.llm.common import attach_groups, fresh_path, settle, text_or_empty

END = b"\r\n\r\n"
#: Bytes of a chunk of the body and of a segment: an ordinary page has several chunks, and a longer one several segments.
CHUNK, SEGMENT = 1024, 4096
RECORDS_PER_FILE = 8192


def framed(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(data: bytes) -> bytes:
    """The body of a chunked message; chunk extensions and trailers are passed over. ValueError if it is cut off."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut off")
        out.append(data[at : at + n])
        at += n + 2


def records(data: bytes, only: bytes = b"") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record whose head contains ``only``; the archive may be compressed, as
    a whole or by record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        start = end + len(END)
        stop = start + int(head["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} is cut off")
        if data.find(only, at, end) >= 0:
            yield head, data[start:stop]
        at = stop + len(END)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the line ends that close it (the text writer adds those)."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def uuid_urn(name: str) -> str:
    h = hashlib.md5(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def segments(page: str | None, target: str | None, uid: str, first: str | None, body: bytes, digest: str, size: int) -> Iterator[bytes]:
    """The records of one page: a revisit (of the record of ``first``) has no body; a long response goes on in continuation records."""
    own = uuid_urn(uid)
    named = [("WARC-Target-URI", target and "".join(target.split())), ("WARC-Date", "1970-01-01T00:00:00Z")]
    fields = [*named, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page)]
    if first is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", uuid_urn(first))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *fields, *more], b"")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(body)
    http = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= size:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *fields, http], block)
        return
    for k, at in enumerate(range(0, len(block), size)):
        last = [("WARC-Segment-Total-Length", len(block))] if at + size >= len(block) else []
        if k == 0:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *fields, http], block[:size])
        else:
            more = [*named, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), *last]
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", uuid_urn(f"{uid}/{k + 1}")), *more], block[at : at + size])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100, segment: int = SEGMENT, per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of ``pages`` as compressed WARC files in ``path``, any folder that Spark can write to.

    The body (null: empty) is put in UTF-8 into a chunked HTTP response. Of rows with equal bodies of at least
    ``least`` bytes, that with the smallest id has the body (so have rows that repeat that id); the others
    revisit it. Rows with a null id are responses. Blocks over ``segment`` bytes go on in continuation records, so a file
    has ``per_file`` records of about that size at most. Extra columns are left out.
    """
    given = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), text_or_empty(body_col).cast("string").alias("body"))
    given = given.withColumn("digest", F.sha2("body", 256)).withColumn("n", F.octet_length("body"))
    rows = settle(given.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = rows.where((F.col("n") >= least) & F.col("page").isNotNull()).groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("page", "row")).alias("first")).where("copies > 1")
    groups = settle(groups, "copies")
    n_rows = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]  # in groups, so hot ones are few
    met = attach_groups(rows.drop("n"), groups, "digest", "copies", n_rows, F.col("row"))
    revisit = F.col("page").isNotNull() & (F.col("page") != F.col("first.page"))
    uid = lambda page, row: F.concat_ws("/", F.col(page).cast("string"), F.col(row))
    met = met.select(F.col("page").cast("string").alias("page"), "url", "body", "digest", F.when(revisit, uid("first.page", "first.row")).alias("first"), uid("page", "row").alias("uid"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, url, body, digest, first, own in zip(*(frame[c] for c in ("page", "url", "body", "digest", "first", "uid"))):
                page, url, first = (None if pd.isna(x) else x for x in (page, url, first))
                out += segments(page, url, own, first, body.encode("utf-8", "surrogatepass"), digest, segment)
            yield pd.DataFrame({"value": out})

    # a record is bytes; the writer puts them out as they are, with the separator after each
    written = met.mapInPandas(run, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


PAGE = "record string, page string, record_type string, refers string, payload binary, payload_digest string, payload_bytes bigint, url string"
SEGMENT_ROW = "origin string, number int, total bigint, type string, page string, url string, refers string, digest string, block binary"
HEAD = ("type", "page", "url", "refers", "digest")


def described(h: dict[str, str]) -> tuple:
    """HEAD of a record."""
    return h["warc-type"], h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha256:") or None


def built(own: str, about: tuple, block: bytes, bodies: bool) -> tuple:
    """A row of PAGE from a whole block: the chunked framing is undone and the digest checked."""
    kind, page, url, refers, digest = about
    if kind == "revisit":
        return own, page, kind, refers, None, digest, None, url
    head, _, payload = block.partition(END)
    if b"transfer-encoding: chunked" in head.lower():
        payload = unframed(payload)
    found = hashlib.sha256(payload).hexdigest()
    if digest and found != digest:
        raise ValueError("the payload's digest is another")
    return own, page, kind, None, payload if bodies else None, found, len(payload), url


def table(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in kind.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The pages in the archives of ``path``: page (text), record_type, refers_to (the page, as text, of the record that a revisit
    refers to), payload (null for revisits, and for all without ``bodies``), payload_digest, payload_bytes, url.

    Records that are whole are taken where they stand. Segments are grouped by the id of their origin (the segments
    of one record, never more), put in order by their numbers and checked against the total length that the last
    one states; then the chunked framing is undone and the digest checked. What was read is settled, and revisits look up the record they
    refer to, much revisited ones by a bounded broadcast. A missing, repeated or cut-off segment, a body of another digest, or a revisit
    whose record is missing or has another digest, raises an error. No archives give an empty result.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = records(data.as_py())
                yield table([built(h["warc-record-id"], described(h), block, bodies) for h, block in found if h["warc-type"] in ("response", "revisit") and "warc-segment-number" not in h], PAGE)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in records(data.as_py(), b"WARC-Segment-Number"):
                    total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), total, *described(h), block))
                yield table(rows, SEGMENT_ROW)

    head = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in HEAD]
    parts = files.mapInArrow(pieces, SEGMENT_ROW).groupBy("origin").agg(*head, F.array_sort(F.collect_list(F.struct("number", "total", "block"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                numbers, data = [p["number"] for p in r["parts"]], b"".join(p["block"] for p in r["parts"])
                if numbers != list(range(1, len(numbers) + 1)) or r["parts"][-1]["total"] != len(data):
                    raise ValueError(f"segments {numbers} of {len(data)} bytes don't make the record")
                rows.append(built(r["origin"], tuple(r[c] for c in HEAD), data, bodies))
            yield table(rows, PAGE)

    pages = settle(files.mapInArrow(wholes, PAGE).unionByName(parts.mapInArrow(join, PAGE)), "pages")
    again, whole = pages.where("record_type = 'revisit'"), pages.where("record_type <> 'revisit'")
    wanted = again.where("refers IS NOT NULL").groupBy("refers").agg(F.count("*").alias("times"))
    found = whole.select(F.col("record").alias("refers"), F.col("page").alias("refers_to"), F.struct(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).alias("of"))
    found = settle(wanted.join(found, "refers"), "referred")
    met = attach_groups(again, found, "refers", "times", found.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0], F.col("record"))
    same = F.coalesce(F.col("of.digest") == F.col("payload_digest"), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("no record with this payload for the revisit "), "record")).cast("bigint")
    shown = ["page", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes", "url"]
    met = met.withColumn("payload_bytes", F.when(same, F.col("of.bytes")).otherwise(wrong))
    return whole.withColumn("refers_to", F.lit(None).cast("string")).select(*shown).unionByName(met.select(*shown))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", path: str | None = None, bodies: bool = True) -> DataFrame:
    """Write ``pages`` to archives in ``path`` (in the shared folder, if none is given) and read them back, the ids in their own type."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, body_col)
    back, kind = read_warc(pages.sparkSession, path, bodies), pages.schema[id_col].dataType
    return back.withColumn(id_col, F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
