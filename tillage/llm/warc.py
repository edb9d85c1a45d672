"""WARC: capture transactions written as archives, read back and assembled.

A capture is three records: the response (or a revisit of an earlier one), the request and the
metadata, the latter two naming the first in WARC-Concurrent-To. Records end in two line breaks, so
Spark's text writer with that separator writes valid archives, gzipped, in any store Spark knows.
Reading goes by Content-Length, never by separators, so payloads may hold anything. An archive of any
size is streamed line by line through Spark's text reader: a task holds one record at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm._common import look_up, shared_dir, stored

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Fixed value: payloads of fewer bytes are always stored as responses.
MIN_REVISIT = 100


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload string, digest, size, refers_to, repeated): refers_to is the smallest id with
    that payload, repeated whether several rows have that very id and payload.

    refers_to is null for that id itself and for payloads under `least` bytes. A null body is empty. Digests
    are counted before the shuffle, and the look-up is safe when one payload makes up a third of all rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # rows of one id first, so that the smallest id comes with how often it occurs
    by_id = rows.where(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    again = by_id.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.min_by("n", "page_id").alias("first_n"), F.sum("n").alias("copies")
    ).where("copies > 1")
    found = look_up(rows, stored(again, "copies"), "digest", "copies", "page_id")
    refers = F.when((F.col("size") >= least) & (F.col("first_id") < F.col("page_id")), F.col("first_id"))
    return found.select(
        "page_id", "url", "payload", "digest", "size", refers.alias("refers_to"),
        F.coalesce(F.col("first_n") > 1, F.lit(False)).alias("repeated")
    )


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line breaks that end it; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines, length), F.lit(CRLF * 2), block)


def _plain(c: Column) -> Column:
    """A header value: line breaks would end it."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " ")


def write_archives(marked: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", max_records: int = 20_000) -> None:
    """marked: rows of mark_revisits. A file holds at most `max_records` captures, so that archives can be
    read side by side; how many bytes that is does not matter to the reader.

    A response that others may refer to is called by its page and payload, which is what their
    WARC-Refers-To names. All other captures, those of repeated rows among them, are called by a number too.
    """
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    named = lambda c: F.concat(F.lit("urn:capture:"), page(c), F.lit(":"), F.col("digest"))
    plain = F.col("refers_to").isNull() & ~F.col("repeated") & F.col("page_id").isNotNull() & (F.col("size") >= MIN_REVISIT)
    rows = marked.withColumn(
        "capture",
        F.when(plain, named("page_id")).otherwise(F.concat(named("page_id"), F.lit(":"), F.monotonically_increasing_id().cast("string")))
    )
    revisit = F.col("refers_to").isNotNull()
    main, digest = F.concat(F.lit("<"), F.col("capture"), F.lit(":main>")), F.concat(F.lit("sha256:"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", _plain(F.col("url")))]
    first = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest),
         (
             "WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
         ), (
             "WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), named("refers_to"), F.lit(":main>")))
         ), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
    )
    own = lambda kind: [
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.concat(F.lit("<"), F.col("capture"), F.lit(f":{kind}>"))), *common,
        ("WARC-Concurrent-To", main)
    ]
    request = _record(
        [*own("request"), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), _plain(F.col("url")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    )
    facts = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-bytes: "),
        F.col("size").cast("string"), F.lit(CRLF)
    )
    metadata = _record([*own("metadata"), ("Content-Type", F.lit("application/warc-fields"))], facts)
    lines = rows.select(F.concat_ws(CRLF * 2, first, request, metadata).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


class ArchiveParser:
    """Takes an archive piece by piece and gives (headers, block, whole) of each record.

    Content-Length decides where a block ends. At the end of the data a record whose block is short is
    given with `whole` False, and one whose headers are not complete is left out. A length that is
    missing or no number counts as 0.
    """

    def __init__(self):
        self.data, self.headers, self.need, self.at = bytearray(), None, 0, 0

    def feed(self, piece: bytes):
        self.data += piece
        while True:
            if self.headers is None:
                start = self.data.find(b"WARC/", self.at)
                if start < 0:
                    del self.data[: max(0, len(self.data) - 4)]
                    self.at = 0
                    return
                end = self.data.find(b"\r\n\r\n", start)
                if end < 0:
                    del self.data[:start]
                    self.at = 0
                    return
                lines = bytes(self.data[start:end]).split(b"\r\n")[1:]
                self.headers = {
                    k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _,
                    v in (x.partition(b":") for x in lines)
                }
                size = self.headers.get("content-length", "")
                self.need = int(size) if size.isascii() and size.isdigit() else 0
                del self.data[: end + 4]
                self.at = 0
            if len(self.data) < self.need:
                return
            headers, block = self.headers, bytes(self.data[: self.need])
            del self.data[: self.need]
            self.headers = None
            yield headers, block, True

    def rest(self):
        if self.headers is not None:
            yield self.headers, bytes(self.data), False


def parse_archive(data: bytes):
    """(headers, block, whole) of each record of an archive, gzipped or plain, one stream or one per record;
    a gzipped one that is cut off is read as far as it goes."""
    import zlib

    parser = ArchiveParser()
    if data[:2] == b"\x1f\x8b":
        while data[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            piece = d.decompress(data, 1 << 20)
            while piece or d.unconsumed_tail:
                yield from parser.feed(piece)
                piece = d.decompress(d.unconsumed_tail, 1 << 20)
            yield from parser.feed(d.flush())
            data = d.unused_data
    else:
        yield from parser.feed(data)
    yield from parser.rest()


RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to string, "
    "declared_digest string, payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>, truncated boolean"
)


def _record_row(h: dict, block: bytes, whole: bool, with_payload: bool) -> dict:
    import hashlib

    http = h.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    fields = []
    if h.get("content-type") == "application/warc-fields":
        fields = list({k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}.items())
    names = {
        "record_id": "warc-record-id", "type": "warc-type", "concurrent_to": "warc-concurrent-to", "target_uri": "warc-target-uri",
        "date": "warc-date", "refers_to": "warc-refers-to", "declared_digest": "warc-payload-digest"
    }
    row = {k: h.get(v) for k, v in names.items()}
    return row | {
        "payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "payload": payload if with_payload else None,
        "fields": fields, "truncated": not whole
    }


def damaged_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, good_bytes): gzipped archives under path that end before their stream does or hold bytes that are no
    stream, and how far they can be trusted. For after a reading has failed: a task holds one archive, compressed.
    """

    @F.arrow_udf("long")
    def good(contents):
        import zlib

        import pyarrow as pa

        out = []
        for c in contents:
            data, done = memoryview(c.as_buffer()), 0
            try:
                while done < len(data):
                    d, at = zlib.decompressobj(31), done
                    while not d.eof and at < len(data):
                        d.decompress(data[at : at + (1 << 20)])
                        at = min(len(data), at + (1 << 20))
                    if not d.eof:
                        break
                    done = at - len(d.unused_data)
            except zlib.error:
                pass
            out.append(done)
        return pa.array(out, pa.int64())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), good("content").alias("good_bytes")).where("good_bytes < bytes")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, lenient: bool = False) -> DataFrame:
    """The records of all gzipped archives under path; digest and size are those of the payload as read. An archive that cannot be
    read to its end is an error, unless lenient: then what it gives before the damage counts, and `damaged_archives` names it.

    The payload is the block after the HTTP header of a response or request, else the block. Without
    payloads (with_payload False) that column is null and only digests travel on. A cut-off archive gives
    its records up to the cut, the last of them marked `truncated` if its headers were whole.
    """

    def run(it):
        import pyarrow as pa

        kinds = [
            ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
            ("date", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
            ("truncated", pa.bool_())
        ]
        schema = pa.schema(kinds)
        rows, held = [], 0

        def keep(found):
            nonlocal held
            for h, block, whole in found:
                rows.append(_record_row(h, block, whole, with_payload))
                held += len(block) if with_payload else 0

        parser, last = None, None
        for b in it:
            files = b.column(1).dictionary_encode() if hasattr(b.column(1), "dictionary_encode") else b.column(1)
            names, codes = files.dictionary.to_pylist(), files.indices.to_pylist()
            lines = b.column(0).to_pylist()
            at = 0
            while at < len(lines):
                end = at
                while end < len(lines) and codes[end] == codes[at]:
                    end += 1
                piece = b"\n".join(lines[at:end])
                if names[codes[at]] != last:  # the next archive
                    if parser:
                        keep(parser.rest())
                    parser, last = ArchiveParser(), names[codes[at]]
                else:
                    piece = b"\n" + piece
                for i in range(0, len(piece), 1 << 20):
                    keep(parser.feed(piece[i : i + (1 << 20)]))
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows.clear()
                        held = 0
                at = end
        if parser:
            keep(parser.rest())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # gzipped files are not split, so a task sees whole archives, one after the other
    text = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", lenient).option("pathGlobFilter", "*.gz").text(path)
    return text.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RECORD)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each capture: capture_id and nested response, request, metadata, with counts.

    The capture is the record that the others name in WARC-Concurrent-To; `response` holds a response
    or a revisit. Of several records of one kind in a capture the one with the smallest id stays and
    n_records counts all, so no group is gathered. A missing record is a null struct.
    """
    names = [
        "record_id", "type", "target_uri", "date", "refers_to", "declared_digest", "payload_digest", "payload_bytes",
        *(["payload"] if with_payload else [])
    ]
    body = F.struct(*names)
    pick = lambda kinds, x: F.min_by(x, F.when(F.col("type").isin(*kinds), F.col("record_id")))
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        pick(("response", "revisit"), body).alias("response"), pick(("request",), body).alias("request"), pick(("metadata",), F.struct("record_id", "fields")).alias("metadata"), F.count("*").alias("n_records")
    )
    # min_by gives some row's struct when no row has the kind
    of = lambda c, kinds: F.when(F.col(f"{c}.type").isin(*kinds), F.col(c))
    return grouped.select(
        "capture_id", of("response", ("response", "revisit")).alias("response"), of("request", ("request",)).alias("request"),
        F.when(F.col("metadata.record_id").isNotNull(), F.col("metadata")).alias("metadata"), "n_records"
    )


def captures(pages: DataFrame, path: str | None = None, with_payload: bool = True, **names) -> DataFrame:
    """Writes pages as archives (to a new folder beside the checkpoints unless path is given), reads and assembles them.

    Null bodies are empty payloads, null ids and urls empty fields; repeated rows are captures of their
    own. Columns besides id, url and body are not archived. An empty table gives no captures.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    marked = mark_revisits(pages, **names)
    write_archives(marked, path)
    return assemble(read_archives(pages.sparkSession, path, with_payload), with_payload)
