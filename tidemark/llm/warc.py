"""WARC derivative builder: response records to metadata and plain-text conversion records.

Each response gets one metadata record (JSON: its WARC and HTTP headers, title, base, meta tags and links) and one
conversion record (plain text). Both name the response in WARC-Refers-To, with its URI and date, and carry block
digests; the response's payload digest is kept in the metadata, and in written records as WARC-Refers-To-Payload-Digest, an
extension header. Pages are scanned once from front to back, so that hostile markup costs no more than other text. Record ids are derived from the response's id, so
reruns agree. Files hold one gzip member for each record.

Defined cases: null HTML is an empty payload, with empty text and no links; a null URL is an empty target URI, as
which the header is left out; control characters and spaces of a URL are percent-encoded in headers; repeated pages give repeated records with equal ids; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .markup import CLOSE, RAW, TEXT, attributes, decoded, tokens

#: Date of responses that come without one.
DATE = "1970-01-01T00:00:00Z"
RECORD = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, n_bytes long, block string"

#: Elements that begin a new line of plain text, and where links stand (fixed values).
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "embed": "src", "form": "action"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(kind: str, record_id: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {record_id}'.encode()).digest()[:16], version=5)}>"


def read_html(page: str) -> tuple[str, str, str, dict[str, str], list[dict]]:
    """Title, base, plain text (one line per block, white space collapsed), meta tags and links of a page."""
    title, base, metas, links, lines, line = "", "", {}, [], [], []

    def end_line():
        if words := "".join(line).split():
            lines.append(" ".join(words))
        line.clear()

    for kind, name, rest in tokens(page):
        if kind == TEXT:
            line.append(decoded(rest))
        elif kind == RAW:
            if name == "title":
                title = title or " ".join(decoded(rest).split())
        else:
            if name in BLOCKS:
                end_line()
            if kind == CLOSE or not rest or name not in LINKS and name not in ("meta", "base"):
                continue
            found = attributes(rest)
            if name == "meta":
                if key := found.get("name") or found.get("property") or found.get("http-equiv"):
                    metas.setdefault(key.lower(), found.get("content", ""))
            elif name == "base":
                base = base or found.get("href", "")
            elif url := found.get(LINKS[name], "").strip():
                links.append({"path": f"{name}/{LINKS[name]}", "url": url} | ({"rel": found["rel"]} if found.get("rel") and name != "script" else {}))
    end_line()
    return title, base, "\n".join(lines), metas, links


def split_http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in rest)], payload


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages: page_id, url and html."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit(""))
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(payload.cast("binary"), 256)).cast("binary"), 256)
    cut = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    record_id = F.format_string("<urn:uuid:%s-%s-5%s-8%s-%s>", *cut)
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload)
    return pages.select("page_id", record_id.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), block.alias("block"))


def derivatives(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response record (record_id, target_uri, date, block), with the columns to keep in front."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for r in part.select(["record_id", "target_uri", "date", "block"]).to_pylist():
                    block = (r["block"] or "").encode()
                    status, headers, payload = split_http(block)
                    title, base, text, metas, links = read_html(payload.decode("utf-8", "replace"))
                    meta = {
                        "Envelope": {
                            "WARC-Header": {"WARC-Type": "response", "WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["date"], "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload), "Content-Length": len(block)},
                            "HTTP-Response": {"Status": status, "Headers": headers, "Payload-Length": len(payload)},
                        },
                        "HTML": {"Title": title, "Base": base, "Metas": metas, "Links": links},
                    }
                    for kind, content, body in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False, separators=(",", ":"))), ("conversion", "text/plain", text)):
                        data = body.encode()
                        rows.append({"type": kind, "record_id": derived_id(kind, r["record_id"]), "refers_to": r["record_id"], "target_uri": r["target_uri"], "date": r["date"], "content_type": content, "block_digest": digest(data), "payload_digest": digest(payload), "n_bytes": len(data), "block": body, "title": title, "n_links": len(links)})
                two = [x for i in range(part.num_rows) for x in (i, i)]
                out = pa.RecordBatch.from_pylist(rows, kinds)
                yield pa.RecordBatch.from_arrays([*part.select(list(keep)).take(pa.array(two, pa.int64())).columns, *out.columns], names=[*keep, *out.schema.names])

    text, number = pa.string(), pa.int64()
    kinds = pa.schema([(n, number if n == "n_bytes" else text) for n in [x.split()[0] for x in RECORD.split(", ")]] + [("title", text), ("n_links", number)])
    front = "".join(f"{c} {dict(found.dtypes)[c]}, " for c in keep)
    return found.mapInArrow(run, f"{front}{RECORD}, title string, n_links long")


def header_safe(value: Column) -> Column:
    """A header's value without what could end it: control characters and spaces percent-encoded (bytes of UTF-8)."""
    parts = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(value.rlike(r"[\x00-\x20\x7F]"), F.array_join(parts, "")).otherwise(value)


def serialised(records: DataFrame) -> DataFrame:
    """One string per record: a whole WARC record."""
    uri = header_safe(F.col("target_uri"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        F.when(uri != "", line("WARC-Refers-To-Target-URI", uri)), F.when(uri != "", line("WARC-Target-URI", uri)),
        line("WARC-Refers-To-Date", header_safe(F.col("date"))), line("WARC-Date", header_safe(F.col("date"))),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.col("block_digest")),
        line("WARC-Refers-To-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("n_bytes").cast("string")),
    )
    return records.select(F.concat(lines, F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")).alias("value"))


def members(batches):
    """Each record as a gzip member, without its last byte.

    That byte is the highest of the record's length, and 0 up to 16 MB; a longer record is followed by an empty member,
    which ends with 0 as well. The text writer's line separator puts the 0 back."""
    for batch in batches:
        out = []
        for value in batch.column("value"):
            data = gzip.compress(value.as_py().encode(), 6, mtime=0)
            out.append((data if data[-1] == 0 else data + gzip.compress(b"", mtime=0))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records as WARC files, one per partition and one gzip member per record."""
    rows = serialised(records).mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\x00").text(path)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per page; the blocks themselves as digests."""
    found = derivatives(responses(table(spark, sf_dir, "pages")), ("page_id",))
    return found.withColumn("block_sha256", F.sha2(F.col("block").cast("binary"), 256)).drop("block")
