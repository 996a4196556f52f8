"""WARC archives written and read by Spark, with segmented records put together again.

Spark's text sink writes one record a row with the blank lines between records as its separator, so any
file system Spark knows will do, and a lost task is written again. Blocks longer than SEGMENT travel as a
first segment and ``continuation`` records. The reader groups segments by their origin's identifier, orders
them by number, checks that none is missing and that the lengths add up to the stated total, and decodes the
chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm.shared import batches_of, shared_path, written

#: Bytes of a record's block; longer ones are segmented.
SEGMENT = 16 << 10
#: Bytes of an HTTP chunk.
CHUNK = 4 << 10
#: Records a file; with SEGMENT this bounds a file by about 9 MB.
FILE_RECORDS = 512
#: Pages that Python holds at a time.
BATCH = 200
#: Repeated payloads up to which their hashes (32 bytes) are broadcast, and the keys of one payload beyond it.
MAX_BROADCAST, SALTS = 200_000, 64
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; raises ValueError where it breaks off."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields if v is not None) + CRLF


def records(page_id: int | None, url: str | None, payload: bytes, of: int | None, revisit: bool, date: str = "2020-01-01T00:00:00Z") -> Iterator[bytes]:
    """The records, without the blank lines after them, that hold one page.

    Control characters of the URL are percent-encoded so that it stays on its line; a null URL has no line.
    """
    sha = digest(payload)
    name = record_id(page_id, sha)
    uri = None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in url)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if revisit:
        block = HTTP + CRLF
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(of, sha)}>"), *common, ("Content-Length", len(block))]) + block
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    for k, part in enumerate(parts, 1):
        segment = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, *segment]
        else:
            own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{k}")
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{name}>"), *segment]
            if k == len(parts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _head([*fields, ("Content-Length", len(part))]) + part


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased fields, block) of each record of an archive; a file may be gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _typed(keyed: DataFrame) -> DataFrame:
    """(id, url, payload, of, revisit) of rows with the hash ``h`` of their payload.

    Repeats are found by hashes and ids alone; their table joins back where it is small, so that no payload moves.
    Beyond MAX_BROADCAST the rows of a payload are dealt over SALTS keys.
    """
    repeats = written(keyed.groupBy("h").agg(F.max("id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "of", F.lit(True).alias("again")), "repeats")
    if repeats.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        met = keyed.join(F.broadcast(repeats), "h", "left")
    else:
        salted = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left")
    return met.select("id", "url", "payload", "of", (F.coalesce("again", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("of"))).alias("revisit"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes gzipped archives of all rows of ``pages`` (id, url, html; other columns are not read).

    Of rows with equal payloads the largest id is the response and the others revisit it; a null id counts
    as the smallest. Rows equal in id and payload are alike: all of them responses or all revisits. A null
    html is an empty payload. An empty table writes no record.
    """
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    typed = _typed(src.withColumn("h", F.unhex(F.sha2("payload", 256))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, of = pdf["id"].astype("Int64"), pdf["of"].astype("Int64")
            out, size = [], 0
            for i, u, p, o, r in zip(ids, pdf["url"], pdf["payload"], of, pdf["revisit"]):
                for rec in records(None if pd.isna(i) else int(i), u, bytes(p), None if pd.isna(o) else int(o), bool(r)):
                    out.append(rec)
                    size += len(rec)
                if size > 1 << 20:
                    yield pd.DataFrame({"value": out})
                    out, size = [], 0
            yield pd.DataFrame({"value": out})

    made = typed.mapInPandas(rows, "value binary").select(F.col("value").cast("string"))  # bytes as they are
    with batches_of(pages.sparkSession, BATCH):
        made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_RECORD = "rtype string, rid string, page_id long, url string, sha string, refers string, origin string, seg int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``; blocks of whole responses are decoded later."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bare = lambda x: x.strip("<>") if x else None
        number = lambda x: int(x) if x else None
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for f, block in parsed(bytes(data)):
                    url = f.get("warc-target-uri")
                    out.append(
                        (
                            f["warc-type"], bare(f["warc-record-id"]), number(f.get("page-id")), _unquoted(url), (f.get("warc-payload-digest") or "").removeprefix("sha1:"),
                            bare(f.get("warc-refers-to")), bare(f.get("warc-segment-origin-id")), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block,
                        )
                    )
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "seg": "Int32", "total": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, _RECORD)


def _unquoted(url: str | None) -> str | None:
    if url is None or "%" not in url:
        return url
    parts = url.split("%")
    return parts[0] + "".join(chr(int(x[:2], 16)) + x[2:] for x in parts[1:])


def reassembled(segments: DataFrame) -> DataFrame:
    """(rid, block): segments (rid, seg, total, block) of one origin joined by number.

    Fails where a number is missing or the length is not the stated total. Repeated equal segments count once.
    """
    parts = segments.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("seg", "block"))).alias("p"), F.max("total").alias("total"))

    @F.pandas_udf("binary")
    def joined(p: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(p, total):
            numbers = [r["seg"] for r in x]
            if numbers != list(range(1, len(numbers) + 1)):
                raise ValueError(f"segments {numbers} have a gap")
            block = b"".join(bytes(r["block"]) for r in x)
            if pd.isna(n) or len(block) != n:
                raise ValueError(f"segments hold {len(block)} bytes of {n}")
            out.append(block)
        return pd.Series(out)

    return parts.select("rid", joined("p", "total").alias("block"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest): a row for each page.

    The payload of a revisit is null; its bytes and digest are those of the response it names, whose digest
    must equal the revisit's own. A response whose payload does not match its digest fails the read. The archives
    are parsed once, into a table of records in the shared folder.
    """
    recs = written(read_records(spark, path), "records")

    @F.pandas_udf("payload binary, n long, sha string")
    def decoded(block: pd.Series, sha: pd.Series) -> pd.DataFrame:
        out = []
        for b, want in zip(block, sha):
            p = payload_of(bytes(b))
            if digest(p) != want:
                raise ValueError(f"a payload does not have the digest {want}")
            out.append((p, len(p), want))
        return pd.DataFrame(out, columns=["payload", "n", "sha"])

    heads = recs.where("rtype = 'response'")
    whole = heads.where("seg is null").select("rid", "page_id", "url", "sha", "block")
    rest = recs.where("seg is not null").select(F.coalesce("origin", "rid").alias("rid"), "seg", "total", "block")
    split = heads.where("seg is not null").select("rid", "page_id", "url", "sha").join(reassembled(rest), "rid")
    responses = whole.unionByName(split).withColumn("d", decoded("block", "sha"))
    responses = responses.select("rid", "page_id", "url", F.col("d.payload").alias("payload"), F.col("d.n").alias("n"), "sha")
    named = responses.groupBy("rid").agg(F.max("page_id").alias("of"), F.max("n").alias("n"), F.max("sha").alias("was"))
    again = recs.where("rtype = 'revisit'").select("page_id", "url", "sha", F.col("refers").alias("rid")).join(named, "rid", "left")
    ok = F.when(F.col("sha") == F.col("was"), F.col("n")).otherwise(F.raise_error(F.lit("a revisit names no response of its digest")).cast("long"))
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    first = responses.select("page_id", "url", F.lit("response"), F.lit(None).cast("long"), "payload", "n", "sha").toDF(*names)
    return first.unionAll(again.select("page_id", "url", F.lit("revisit"), "of", F.lit(None).cast("binary"), ok, "sha").toDF(*names))


def op10_warc(pages: DataFrame) -> DataFrame:
    """The contract's columns, read back from archives of whole ``pages``."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
