"""WARC archives: writing captures with revisits, and assembling transactions from archives.

Writing: each page gives a request, a response or revisit, and a metadata record; request and metadata name the
response's record in WARC-Concurrent-To. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
largest id is the response and the others are revisits that refer to it. Records are made by column
expressions and written by Spark's text writer, whose line separator is the WARC record end; files are gzip streams of
at most ``RECORDS_PER_FILE`` pages each, in any file system that Spark writes to.

Reading: Spark's text reader streams gzip files (of any number of members) in pieces that end where a record may end; records are put together by
Content-Length, so a payload may hold anything and no file is held whole. Files that aren't compressed are read whole, one a row. Request, response and
metadata records are joined through their concurrent-to identifiers, of which a record may have several and which either side may give, into
one nested row per capture.

Defined cases: a null html is an empty payload; a null url is left out of the headers and comes back null; rows that repeat an id are captures with
equal identifiers, a row each; a null id is dropped; of several requests or metadata records of a capture the greatest counts; a capture without request or
metadata has null there; records without a capture are left out; an empty table gives an empty archive; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import stored

MIN_REVISIT = 1000
RECORDS_PER_FILE = 4000
#: Date written into records whose capture time isn't known.
NO_DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORDS = "record_id string, record_type string, concurrent_to array<string>, target_uri string, refers_to string, header_digest string, fields map<string,string>, http_headers string, http_length long, payload binary"


def _record_id(kind: str, page_id: Column) -> Column:
    """A urn:uuid from the kind of record and the id: the same at every run."""
    h = F.md5(F.concat(F.lit(kind + " "), page_id.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, record_id: Column, content_type: str, block: Column, **headers: Column) -> Column:
    """A record without its end; a header whose value is null is left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {NO_DATE}\r\nContent-Type: {content_type}")]
    lines += [F.concat(F.lit(name.replace("_", "-") + ": "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the archive of ``pages`` to the folder ``path``."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    url = F.regexp_replace(F.col(f"`{url_col}`"), r"[\r\n]", "")  # a header holds one line
    own = F.col(f"`{id_col}`")
    rows = pages.filter(own.isNotNull()).select(own.alias("page_id"), url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("length"))
    sharing = rows.filter(F.col("length") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # small as a rule; stored, so that its size is known when Spark chooses how to join. Payloads that can't be revisits don't meet it
    short = rows.filter(F.col("length") < MIN_REVISIT).withColumn("original", F.lit(None).cast(rows.schema["page_id"].dataType))
    rows = rows.filter(F.col("length") >= MIN_REVISIT).join(stored(sharing, "warc-originals"), "digest", "left").unionByName(short)
    original = F.when((F.col("length") >= MIN_REVISIT) & (F.col("original") != F.col("page_id")), F.col("original"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit(END))
    capture, uri = _record_id("response", F.col("page_id")), F.col("url")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = F.coalesce(request, F.lit("GET / HTTP/1.1" + END))
    metadata = F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n"))
    response = _record("response", capture, "application/http; msgtype=response", F.concat(http, F.col("html")), WARC_Target_URI=uri, WARC_Payload_Digest=digest)
    revisit = _record(
        "revisit", capture, "application/http; msgtype=response", http, WARC_Target_URI=uri, WARC_Payload_Digest=digest,
        WARC_Profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), WARC_Refers_To=_record_id("response", F.col("original")),
    )
    records = F.concat_ws(
        END,
        _record("request", _record_id("request", F.col("page_id")), "application/http; msgtype=request", request, WARC_Target_URI=uri, WARC_Concurrent_To=capture),
        F.when(F.col("original").isNull(), response).otherwise(revisit),
        _record("metadata", _record_id("metadata", F.col("page_id")), "application/warc-fields", metadata, WARC_Target_URI=uri, WARC_Concurrent_To=capture),
    )
    out = rows.withColumn("original", original).select(records.alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(source: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of plain bytes that come in pieces. Values of a repeated header are parted by line ends."""
    held, at = b"", 0

    def more() -> bool:
        nonlocal held, at
        piece = next(source, None)
        if piece is None:
            return False
        held, at = held[at:] + piece, 0
        return True

    while True:
        while len(held) - at < 4 or held.startswith(b"\r\n", at):
            if held.startswith(b"\r\n", at):
                at += 2
            elif not more():
                return
        while (cut := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("a record's headers end with the file")
        lines = held[at:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        headers: dict[str, str] = {}
        for name, _, value in (line.partition(":") for line in lines[1:]):
            name = name.strip().lower()
            headers[name] = f"{headers[name]}\n{value.strip()}" if name in headers else value.strip()
        at, size = cut + 4, int(headers["content-length"])
        if len(held) - at < size:  # many pieces at once: joined once
            pieces, have = [held[at:]], len(held) - at
            while have < size:
                piece = next(source, None)
                if piece is None:
                    raise ValueError("a record's block ends with the file")
                pieces.append(piece)
                have += len(piece)
            held, at = b"".join(pieces), 0
        yield headers, held[at : at + size]
        at += size


def _rows(source: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """``RECORDS`` of the plain bytes of whole files, some megabytes at a time."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
    rows, size = [], 0
    for h, block in parse(source):
        http = payload = length = None
        fields: dict[str, str] = {}
        if h.get("content-type", "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
            said = [line.partition(":")[2].strip() for line in http.split("\r\n") if line.lower().startswith("content-length:")]
            length = int(said[0]) if said and said[0].isdigit() else None
            payload = body if h.get("warc-type") == "response" else None
        elif h.get("content-type", "").startswith("application/warc-fields"):
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
        digest = h.get("warc-payload-digest", "").partition(":")[2] or None
        near = h["warc-concurrent-to"].split("\n") if "warc-concurrent-to" in h else []
        rows.append((h.get("warc-record-id"), h.get("warc-type"), near, h.get("warc-target-uri"), h.get("warc-refers-to"), digest, list(fields.items()), http, length, payload))
        size += len(block) + 500
        if size > 1 << 22:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archive's files (``RECORDS``)."""

    def streamed(batches):
        yield from _rows(piece.as_py() + END.encode() for batch in batches for piece in batch.column(0))

    def whole(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = memoryview(content.as_buffer())
                yield from _rows(bytes(raw[k : k + (1 << 20)]) for k in range(0, len(raw), 1 << 20))

    packed = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary")).mapInArrow(streamed, RECORDS)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("content").mapInArrow(whole, RECORDS)
    return packed.unionByName(plain)


def digested(records: DataFrame) -> DataFrame:
    """Records without payloads: their length and digest, found where they are read, stand for them (``payload_bytes``, ``payload_digest``)."""
    payload = F.col("payload")
    return records.select(
        *[c for c in records.columns if c != "payload"],
        F.coalesce(F.octet_length(payload), F.col("http_length")).cast("long").alias("payload_bytes"),
        F.coalesce(F.sha1(payload), F.col("header_digest")).alias("payload_digest"),
    )


def captures(records: DataFrame, id_type: str = "long") -> DataFrame:
    """One nested row per capture: record_id, page_id, target_uri, request, response (with payload, or of a revisit without; of ``digested`` records with length and digest), metadata.

    Page ids are read as ``id_type``, a Spark type such as long or string; one that isn't of this type comes back null.
    Request and metadata records go to the captures that they name or that name them; where there are none, to the least capture that
    can be reached through concurrent-to identifiers. They are few bytes each: gathered by capture, then met in one join.
    """
    capture = F.col("record_type").isin("response", "revisit")
    light = records.filter("record_id IS NOT NULL").select("record_id", "record_type", capture.alias("capture"), "concurrent_to", F.when(~capture, F.col("http_headers")).alias("http_headers"), "fields")
    kinds = stored(light, "warc-identifiers")
    named = kinds.select(F.col("record_id").alias("u"), F.explode("concurrent_to").alias("v"), "capture").filter("u <> v")
    is_capture = kinds.filter("capture").select("record_id").distinct()
    forth = named.filter("NOT capture").join(is_capture, F.col("v") == F.col("record_id"), "left").select("u", "v", F.col("record_id").isNotNull().alias("met"))
    back = named.filter("capture").select(F.col("v").alias("u"), F.col("u").alias("v"))
    of = stored(forth.filter("met").select("u", "v").unionByName(back).distinct().withColumnsRenamed({"u": "record_id", "v": "capture_id"}), "warc-partners")
    lost = forth.filter("NOT met").select("u").distinct().join(of, F.col("u") == F.col("record_id"), "left_anti")
    if lost.take(1):  # records that reach a capture only through others
        edges = named.select("u", "v")
        label = components(edges)
        label = label.unionByName(label.select(F.col("v").alias("u"), "v").distinct())
        root = label.join(is_capture, F.col("u") == F.col("record_id")).groupBy("v").agg(F.min("u").alias("capture_id"))
        of = of.unionByName(lost.join(label, "u").join(root, "v").select(F.col("u").alias("record_id"), "capture_id"))
    about = kinds.filter("record_type IN ('request', 'metadata')").join(of, "record_id").groupBy(F.col("capture_id").alias("record_id")).agg(
        F.max(F.when(F.col("record_type") == "request", F.struct("record_id", "http_headers"))).alias("request"),
        F.max_by(F.struct("record_id", "fields"), F.when(F.col("record_type") == "metadata", F.col("record_id"))).alias("metadata"),
    )
    responses = records.filter(capture).select("record_id", "target_uri", F.struct("record_type", "http_headers", "http_length", "header_digest", "refers_to", *[c for c in ("payload", "payload_bytes", "payload_digest") if c in records.columns]).alias("response"))
    joined = responses.join(about, "record_id", "left")
    return joined.select("record_id", F.col("metadata.fields")["pageId"].try_cast(id_type).alias("page_id"), "target_uri", "request", "response", "metadata")


def payload_report(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``captures``' rows; a revisit's referred record is looked up."""
    if "payload" in found.schema["response"].dataType.names:
        payload = F.col("response.payload")
        size, digest = F.coalesce(F.octet_length(payload), F.col("response.http_length")).cast("long"), F.coalesce(F.sha1(payload), F.col("response.header_digest"))
    else:
        size, digest = F.col("response.payload_bytes"), F.col("response.payload_digest")
    rows = found.select(
        "page_id",
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
        "record_id",
    )
    rows = stored(rows, "warc-report")
    named = rows.filter("refers_id IS NOT NULL").select("refers_id").distinct()
    originals = rows.select(F.col("record_id").alias("refers_id"), "page_id").join(named, "refers_id", "left_semi").groupBy("refers_id").agg(F.max("page_id").alias("refers_to"))
    return rows.join(originals, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
