"""WARC archives: segmented records written and reassembled.

Writing. A record is a row: its HTTP message (header, body in chunked transfer framing) is cut into segments of at most
``segment`` bytes; the first is the record itself, the others are continuation records that name it as their origin.
Records go to text files whose line separator is the two line ends after a WARC record, so that every file is a plain WARC
archive, gzip-compressed, with at most ``per_file`` records, and no task holds more than a row.

Reading. Files are cut at ``WARC/1.``, so that archives of any size are streamed, and put together again by Content-Length: a piece
is followed by the next ones of its file until its block is as long as declared and two line ends follow, so payloads may hold
version lines or whole records, and versions 1.0 and 1.1 are read alike. A record that no number of pieces completes is reported as
``cut`` and reading goes on with the next piece. Uncompressed files that Spark splits may lose a payload with such a text at a
split; compressed ones are never split. Whole records are decoded where they are read. Segments are grouped by origin, ordered by
segment number, checked for gaps and against the total length, joined, and their chunked framing is decoded. A group holds
the segments of one record, and whole records need no shuffle.

``status`` of a reassembled record: ``ok``; ``cut`` (a block shorter than declared), ``gap`` (segment numbers are not 1 to
n), ``no_end`` (no total length), ``length`` (not the total length), ``framing`` (chunks do not decode), ``digest`` (payload
differs from its declared digest). Payload is null unless ok.

Odd cases: a null payload is empty. Of rows with the same payload (from ``least`` bytes on) that with the largest id is
stored, the others become revisit records, however many; a null id is smaller than any. A repeated id gives a repeated
record, which reassembly reports as ``gap`` if it is segmented; ids are meant to be unique. Null targets are written as
empty. An empty table gives no archives and reads as no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, MARK = b"WARC/1.0\r\n", b"WARC/1."
OPENING = re.compile(rb"[01]\r\n")
END = "\r\n\r\n"
SEGMENT, CHUNK, PER_FILE = 32 << 10, 8 << 10, 20_000
DATE = "2000-01-01T00:00:00Z"
RECORD = ("record_id string, type string, target string, refers_to string, digest string, segment int, origin string, total long, "
          "content_length long, block binary, status string")
NAMES = ("record_id", "type", "target", "refers_to", "digest")
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
AT_ONCE, BYTES_AT_ONCE = 200, 4 << 20


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = (payload[at:at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)[ \t]*(?:;.*)?", body[at:end], re.S) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(out) if body.endswith(b"\r\n", at) else None
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _named(page: object) -> str:
    return f"<urn:record:{page}>"


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *((k.replace("_", "-"), v) for k, v in fields.items() if v is not None),
             ("Content-Length", len(block))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def _records(page: object, target: str | None, payload: bytes, digest: str, refers_to: object, segment: int) -> Iterator[bytes]:
    """All records of a row."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common = {"WARC_Target_URI": "" if target is None else re.sub(r"\s", "%20", target), "WARC_Payload_Digest": f"sha1:{digest}",
              "Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", _named(page), block, WARC_Refers_To=_named(refers_to), WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      **common)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at:at + segment] for at in range(0, len(block), segment)]
    yield _record("response", _named(page), parts[0], WARC_Segment_Number=1 if len(parts) > 1 else None, **common)
    for n, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"<urn:record:{page}:{n}>", part, WARC_Segment_Number=n, WARC_Segment_Origin_ID=_named(page),
                      WARC_Target_URI=common["WARC_Target_URI"], WARC_Segment_Total_Length=len(block) if n == len(parts) else None)


def with_revisits(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """Adds sha1 (hexadecimal) and refers_to: the largest ``key`` of the rows with an equal payload of at least ``least`` bytes, null for
    itself. Groups are counted before the shuffle and joined back, so a payload that very many rows share can be split."""
    own = pages.withColumn("sha1", F.sha1(payload)).withColumn("__long", F.length(payload) >= least)
    last = own.where("__long").groupBy("sha1").agg(F.max(key).alias("__last")).withColumn("__long", F.lit(True))
    df = own.join(last, ["sha1", "__long"], "left")
    return df.withColumn("refers_to", F.when(F.col("__last") != F.col(key), F.col("__last")).when(F.col(key).isNull(), F.col("__last"))).drop("__long", "__last")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, a small slice at a time in Python."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            yield from zip(*(c.to_pylist() for c in whole.slice(at, AT_ONCE).columns))


def _batches(rows: Iterator[tuple], schema: str, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, closed when the bytes in column ``size`` come to a few MB."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    held, out = 0, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*out), kinds)], names=names)

    for row in rows:
        out.append(row)
        held += len(row[size] or b"")
        if held > BYTES_AT_ONCE or len(out) >= 5000:
            yield batch()
            held, out = 0, []
    if out:
        yield batch()


def write_archives(pages: DataFrame, path: str, key: str, target: str, payload: str, least: int = 0, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Archives under ``path`` with a record for every row; ``payload`` is a binary or string column."""
    rows = pages.select(F.col(key).alias("page"), F.col(target).alias("target"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((r,) for page, url, body, sha1, last in _rows(batches)
                   for r in _records(page, url, body, base64.b32encode(bytes.fromhex(sha1)).decode(), last, segment))
        return _batches(records, "record binary", 0)

    records = with_revisits(rows, "page", "payload", least).select("page", "target", "payload", "sha1", "refers_to").mapInArrow(run, "record binary")
    # A cast of binary to string leaves the bytes as they are, and so does the text writer.
    (records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def _parsed(head: bytes, block: bytes, status: str) -> tuple:
    """A record in the order of ``RECORD``."""
    fields = _fields(head)
    digest = fields.get(b"warc-payload-digest")
    return (fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"), fields.get(b"warc-refers-to"),
            digest.split(":")[-1] if digest else None, _number(fields, b"warc-segment-number"), fields.get(b"warc-segment-origin-id"),
            _number(fields, b"warc-segment-total-length"), _number(fields, b"content-length"), block, status)


def _fields(head: bytes) -> dict[bytes, str]:
    fields = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    return fields


def _number(fields: dict[bytes, str], name: bytes) -> int | None:
    return int(fields[name]) if fields.get(name, "").isdigit() else None


def _taken(pieces: list[bytes], closed: bool) -> tuple[int, tuple] | None:
    """The record that the first pieces make, and how many: the fewest that fit its Content-Length exactly. None if more pieces are needed.
    If none can fit, the first piece alone is a cut record."""
    text, need = pieces[0], 1
    while True:
        head, found, rest = text.partition(b"\r\n\r\n")
        length = _number(_fields(head), b"content-length") if found else None
        size = len(rest)
        if length is not None:  # join no more than the length asks for
            more = []
            while size < length and need < len(pieces):
                more += [MARK, pieces[need]]
                size += len(MARK) + len(pieces[need])
                need += 1
            rest = b"".join([rest, *more])
            if size >= length:
                if not rest[length:].strip(b"\r\n"):
                    return need, (head, rest[:length], "ok")
                break
        elif not found and need < len(pieces):  # the mark stands in the header
            text, need = text + MARK + pieces[need], need + 1
            continue
        elif found:
            break
        if not closed:
            return None
        break
    head, _, rest = pieces[0].partition(b"\r\n\r\n")
    return 1, (head, rest, "cut")


def _split(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """Records from the pieces of files, in order."""
    last, waiting, held, wanted = None, [], 0, 0

    def settled(closed: bool) -> Iterator[tuple]:
        while waiting and (found := _taken(waiting, closed)):
            del waiting[:found[0]]
            yield _parsed(*found[1])

    for name, piece in rows:
        if name != last:
            yield from settled(True)
            last = name
        if waiting or OPENING.match(piece):  # anything else stands before the first record
            held = held + len(MARK) + len(piece) if waiting else len(piece)
            waiting.append(piece)
            if held >= wanted:  # a payload full of marks is not joined again at each of them
                yield from settled(False)
                held, wanted = sum(map(len, waiting)), 2 * sum(map(len, waiting)) if waiting else 0
    yield from settled(True)


def _decoded(kind: str, digest: str | None, message: bytes, status: str) -> tuple[int | None, bytes | None, str]:
    """payload_bytes, payload and status of a whole record."""
    if status != "ok":
        return None, None, status
    head, _, body = message.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = re.search(rb"(?mi)^content-length:[ \t]*(\d+)", head)
        return int(length[1]) if length else None, None, "ok"
    payload = dechunked(body) if re.search(rb"(?mi)^transfer-encoding:[^\r\n]*chunked", head) else body
    status = "framing" if payload is None else "digest" if digest and digest_of(payload) != digest else "ok"
    return (len(payload), payload, status) if status == "ok" else (None, None, status)


WHOLE = "record_id string, type string, target string, refers_to string, digest string, payload_bytes long, payload binary, status string"


def _read(spark: SparkSession, path: str, schema: str, size: int, rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(_split(_rows(batches))), schema, size)

    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    return lines.select(F.input_file_name(), F.col("value").cast("binary")).mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, continuation records included."""
    return _read(spark, path, RECORD, 9, lambda records: records)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """What ``reassembled`` makes of the records of archives. Records without segments are decoded as they are read; a second pass takes only segments."""
    single = _read(spark, path, WHOLE, 6, lambda records: ((*r[:5], *_decoded(r[1], r[4], r[9], r[10])) for r in records if r[5] is None))
    return single.unionByName(_joined(_read(spark, path, RECORD, 9, lambda records: (r for r in records if r[5] is not None))))


def _decoded_rows(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*r[:5], *_decoded(r[1], r[4], r[5], r[6])) for r in _rows(batches)), WHOLE, 6)

    return messages.mapInArrow(run, WHOLE)


def reassembled(records: DataFrame) -> DataFrame:
    """record_id, type, target, refers_to, digest, payload_bytes, payload, status: one row a record, its segments joined."""
    single = records.where("segment is null").select(*NAMES, "block", "status")
    return _decoded_rows(single).unionByName(_joined(records.where("segment is not null")))


def _joined(segments: DataFrame) -> DataFrame:
    parts = segments.withColumn("of", F.coalesce("origin", "record_id"))
    grouped = parts.groupBy("of").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("all"), F.max("total").alias("total"), F.min("status").alias("worst"),
        F.max_by(F.struct(*NAMES), F.when(F.col("origin").isNull(), 1)).alias("first"))
    joined = grouped.select(
        F.coalesce("first.record_id", "of").alias("record_id"), "first.type", "first.target", "first.refers_to", "first.digest",
        F.array_join(F.transform("all", lambda x: x["block"].cast("string")), "").cast("binary").alias("message"),
        F.when(F.col("worst") == "cut", "cut").when(F.transform("all", lambda x: x["segment"]) != F.sequence(F.lit(1), F.size("all")), "gap")
        .when(F.col("total").isNull(), "no_end").otherwise("ok").alias("status"), "total")
    joined = joined.withColumn("status", F.when((F.col("status") == "ok") & (F.length("message") != F.col("total")), "length").otherwise(F.col("status")))
    return _decoded_rows(joined.select(*NAMES, "message", "status"))


def page_of(name: str) -> Column:
    """The id in the name that ``write_archives`` gives a record."""
    return F.regexp_extract(name, r"^<urn:record:(-?\d+)>$", 1).try_cast("long")
