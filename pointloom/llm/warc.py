"""WARC archives: write with Spark's text sink, read with boundary-chain verification.

Writing needs no local files: a record is one line of the text sink, whose line separator
is the blank lines that end a record.  Equal payloads are stored once; the row with the
largest id keeps the payload, others become ``revisit`` records.

Reading splits files at the magic ``WARC/1.0`` CRLF with the text source, so it works on
any file system, in splits, and finds candidates only: payloads may hold the magic too.
1. Each task numbers the bytes of its split and emits candidate -> successor offsets
   (header length + Content-Length), contracted to the split's ways out of it.
2. Pointer jumping from offset 0 of each file doubles the reach in each round until every
   split knows where its first real record starts, and which record runs into it.
3. A second scan walks each split from there and emits whole records; pieces of records
   that hold the magic or cross splits are joined by record.

Candidates off the chain are dropped, so is a record cut off by the end of its file; a file
that does not start with the magic yields nothing.  Rows may repeat, and columns beside the
three that are read may have any name; an empty table gives archives without records.  A
payload is held whole in the task that writes or reads it.  The number of rounds is the logarithm
of the splits a file has.  Both scans must see the same splits; if the session's split
settings change in between, the second one fails rather than lose records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, join_counted, scratch, written

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
RECORD = "file string, off long, headers map<string,string>, http_headers map<string,string>, payload binary, payload_bytes long, payload_digest string"

#: Rows of the table of splits (one a 128 MB split) that are broadcast.
SPLIT_ROWS = BROADCAST_ROWS


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing


def _with_digest(batches):
    for batch in batches:
        data = batch.column(2).to_pylist()
        sums = [sha1_base32(x or b"") for x in data]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x or b"") for x in data], pa.int64()), pa.array(sums, pa.string())], ["__id", "__url", "__data", "__n", "__digest"])


def _render(least: int, date: str):
    def render(batches):
        for batch in batches:
            ids, urls, data, winners, sums = (batch.column(i).to_pylist() for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array([record(*x, least, date) for x in zip(ids, urls, data, winners, sums, strict=True)], pa.binary())], ["value"])

    return render


def record(key: int | None, url: str | None, data: bytes | None, winner: int | None, digest: str, least: int, date: str) -> bytes:
    """One record without the blank lines at its end; a revisit of ``winner`` unless it is ``key``."""
    data = data or b""
    revisit = len(data) >= least and winner is not None and winner != key
    kind = "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
    body = http if revisit else http + data
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{winner}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return MAGIC + "\r\n".join(head).encode() + END + body


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes one record per row of ``pages`` below ``path``, as many files as tasks.

    Of rows with equal payloads of at least ``least`` bytes that with the largest key is a
    response and others revisit it (rows that repeat the largest key are all responses); a
    null payload is empty.  Copies are found from digests alone: payloads are not shuffled
    while the table of repeated digests is small enough to send to every executor; beyond it
    those of very common digests still are not.
    """
    rows = pages.select(F.col(key).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"), F.col(payload).cast("binary").alias("__data"))
    rows = rows.mapInArrow(_with_digest, "__id long, __url string, __data binary, __n long, __digest string")
    copies = rows.where(F.col("__n") >= least).groupBy("__digest").agg(F.max("__id").alias("__winner"), F.count("*").alias("__copies")).where("__copies > 1")
    joined = join_counted(rows, written(copies, "copies"), ["__digest"], "left", "__copies")
    lines = joined.select("__id", "__url", "__data", "__winner", "__digest").mapInArrow(_render(least, date), "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


# ---------------------------------------------------------------- reading


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in file order within a split: file, block, piece."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def content_length(head: bytes) -> int:
    found = re.search(rb"(?:^|\r\n)content-length[ \t]*:[ \t]*([0-9]+)[ \t]*(?:\r\n|$)", head, re.I)
    return int(found[1]) if found else -1


def _splits(batches):
    """Column by column: file, block, head (up to the first blank line), has_end, size."""
    for key, group in _by_split(batches, 5):
        x, offs, nexts = 0, [], []
        for i, (head, has_end, size) in enumerate(group):
            if x or key[1] or i:  # the first piece of a file follows no magic
                n = content_length(head) if has_end else -1
                offs.append(x - len(MAGIC))
                nexts.append(x + len(head) + len(END) + n + len(END) if n >= 0 else -1)
            x += size + len(MAGIC)
        end = x - len(MAGIC)
        place = {o: i for i, o in enumerate(offs)}
        out, last, multi = [None] * len(offs), list(offs), [0] * len(offs)
        for i in reversed(range(len(offs))):
            to = nexts[i]
            multi[i] = int(to != (offs[i + 1] if i + 1 < len(offs) else end))
            if to >= end:
                out[i] = to
            elif to in place:
                j = place[to]
                out[i], last[i], multi[i] = out[j], last[j], multi[i] + multi[j]
        n = len(offs) + 1
        cols = [[key[0]] * n, [key[1]] * n, [x] * n, [None, *offs], [None, *out], [None, *last], [None, *multi]]
        kinds = [pa.string()] + [pa.int64()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "block", "total", "off", "next", "last", "multi"])


def _by_split(batches, width):
    """(file, block), rows of the rest; a task may hold several splits, one after the other."""
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(width)]
        for row in zip(*cols, strict=True):
            if row[:2] != key:
                if key is not None:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if key is not None:
        yield key, rows


def chain(spark: SparkSession, path: str) -> DataFrame:
    """One row a split: file, block, base (offset of its first piece), entry (of its first
    real record, null if it has none), carry (record that runs into it) and multi (real
    records in more than one piece)."""
    pieces = _pieces(spark, path)
    head = F.substring_index("piece", END.decode(), 1)
    heads = pieces.select("file", "block", head.cast("binary").alias("head"), (F.octet_length(head) < F.octet_length("piece")).alias("has_end"), F.octet_length("piece").cast("long").alias("size"))
    found = written(heads.mapInArrow(_splits, "file string, block long, total long, off long, next long, last long, multi long"), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.where("off IS NULL").select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    nodes = found.where("off IS NOT NULL").join(splits, ["file", "block"]).select("file", "block", "base", (F.col("base") + F.col("off")).alias("off"), (F.col("base") + F.col("next")).alias("next"), (F.col("base") + F.col("last")).alias("last"), "multi")
    # Only offsets that some split leads to can be entries.
    ways = nodes.select("file", F.col("next").alias("off")).where("off IS NOT NULL").distinct().unionByName(splits.where("block = 0").select("file", F.lit(0).cast("long").alias("off"))).distinct()
    nodes = written(nodes.join(ways, ["file", "off"], "left_semi"), "nodes")
    most = splits.groupBy("file").count().agg(F.max("count")).collect()[0][0] or 1
    reach = nodes.where("off = 0").select("file", "off")
    jump = nodes.where("next IS NOT NULL").select("file", "off", "next")
    for _ in range(int(most).bit_length()):
        step = reach.join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        further = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.off"))).select("a.file", "a.off", "b.next")
        reach, jump = written(reach.unionByName(step).distinct(), "reach"), written(further, "jump")
    real = nodes.join(reach, ["file", "off"], "left_semi").select("file", "block", F.col("off").alias("entry"), "last", "multi")
    return splits.join(real, ["file", "block"], "left").select("file", "block", "base", "entry", F.last("last", True).over(before).alias("carry"), "multi")


def parse(data: bytes, with_payload: bool):
    """headers, http headers, payload, its length and digest; of a revisit the length and digest it names."""
    head, _, body = data[len(MAGIC) :].partition(END)
    headers = _fields(head)
    named = {k.lower(): v for k, v in headers.items()}
    body = body[: int(named["content-length"])]
    http = {}
    if named.get("content-type", "").startswith("application/http"):
        http_head, _, body = body.partition(END)
        http = _fields(http_head.partition(b"\r\n")[2])
    n, digest = len(body), sha1_base32(body)
    if named.get("warc-type") == "revisit":
        n = int({k.lower(): v for k, v in http.items()}.get("content-length", n))
        digest = named.get("warc-payload-digest", digest).removeprefix("sha1:")
    return list(headers.items()), list(http.items()), body if with_payload else None, n, digest


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n") if line)
    return {k.strip(): v.strip() for k, _, v in pairs}


SCHEMA = f"{RECORD}, part binary, part_off long"
ARROW = [("file", pa.string()), ("off", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("part", pa.binary()), ("part_off", pa.int64())]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), ARROW, strict=True)], [n for n, _ in ARROW])


def _walk(with_payload: bool):
    def walk(batches):
        key, x, due, carry, rows, held = None, 0, None, None, [], 0
        for batch in batches:
            for file, block, piece, base, entry, before in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                first = (file, block) != key
                if first:
                    if base is None:
                        raise RuntimeError(f"{file} is split otherwise than when its chain was verified; keep the session's split settings")
                    key, x, due, carry = (file, block), base, entry, before
                off = x - len(MAGIC)
                x += len(piece) + len(MAGIC)
                if block == 0 and first:
                    continue  # what stands before the first magic
                data = MAGIC + piece
                if off == due:
                    head, mark, _ = piece.partition(END)
                    n = content_length(head) if mark else -1
                    carry = off
                    due = off + len(MAGIC) + len(head) + len(END) + n + len(END) if n >= 0 else None
                    if due is not None and due <= off + len(data):
                        rows.append((file, off, *parse(data, with_payload), None, None))
                        held += len(data) * with_payload
                    elif n >= 0:
                        rows.append((file, off, None, None, None, None, None, data, off))
                        held += len(data)
                elif carry is not None and (due is None or off < due):
                    rows.append((file, carry, None, None, None, None, None, data, off))
                    held += len(data)
                if len(rows) >= 2000 or held > 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return walk


def _joined(with_payload: bool):
    def joined(batches):
        for batch in batches:
            rows = []
            for file, off, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = b"".join(p["part"] for p in sorted(parts, key=lambda p: p["part_off"]))
                head, mark, rest = data[len(MAGIC) :].partition(END)
                n = content_length(head) if mark else -1
                if parts and min(p["part_off"] for p in parts) == off and 0 <= n <= len(rest) - len(END):
                    rows.append((file, off, *parse(data, with_payload), None, None))
            if rows:
                yield _batch(rows)

    return joined


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a real record: file, off, headers, http_headers, payload, payload_bytes, payload_digest.

    A revisit has its own (empty) payload, and the length and digest of the one it stands for.
    """
    splits = written(chain(spark, path), "splits")
    few = splits.limit(SPLIT_ROWS + 1).count() <= SPLIT_ROWS
    where = splits.select("file", "block", "base", "entry", "carry")
    pieces = _pieces(spark, path).withColumn("seq", F.monotonically_increasing_id())
    rows = pieces.join(F.broadcast(where) if few else where.hint("merge"), ["file", "block"], "left")
    if not few:
        rows = rows.sortWithinPartitions("file", "block", "seq")
    rows = rows.select("file", "block", F.col("piece").cast("binary").alias("piece"), "base", "entry", "carry")
    out = rows.mapInArrow(_walk(with_payload), SCHEMA)
    whole = out.where("part IS NULL").drop("part", "part_off")
    if not splits.where("multi > 0").isEmpty():
        parts = out.where("part IS NOT NULL").groupBy("file", "off").agg(F.collect_list(F.struct("part", "part_off")).alias("parts"))
        whole = whole.unionByName(parts.mapInArrow(_joined(with_payload), SCHEMA).drop("part", "part_off"))
    return whole


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and reads them back, one row a page."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least=least)
    got = read_archives(spark, path, with_payload=False)
    number = lambda c: F.when(c.rlike("^<urn:page:-?[0-9]+>$"), F.regexp_extract(c, "(-?[0-9]+)", 1).cast("long"))
    return got.select(
        number(F.col("headers")["WARC-Record-ID"]).alias("page_id"), "payload_bytes", "payload_digest", F.col("headers")["WARC-Type"].alias("record_type"), number(F.try_element_at("headers", F.lit("WARC-Refers-To"))).alias("refers_to")
    )
