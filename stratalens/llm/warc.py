"""WARC archives, and a capture index by external merge of sorted runs.

``write`` turns every page into a record: of pages with equal payloads the one with the
least id is a response, the others are revisits that refer to it. ``read`` parses the
archives and gives, per archive, a run of captures sorted by URL key, timestamp and id.
``history`` merges the runs: the key space is cut into ranges, and each range's sorted
pieces go through a k-way loser tree, so the parts together are one ordered index. URL,
timestamp and id all take part in the ranges, so captures of one URL may fill many.

A record whose payload does not match its digest or length stops the read.

Null payloads are empty, null URLs are empty. Pages that repeat id and payload of a
response are responses too. A null id counts as the least. An empty table gives no
records and an empty index.
"""

from __future__ import annotations

import base64
import gzip
import io
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.common import attach, ship, text_of, with_row
from stratalens.sources.staging import staged, staged_path

# Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Pages carry no time of capture: the id counts seconds from here, within ten years.
START, SPAN = 1_577_836_800, 315_360_000

CAPTURE = ("urlkey string, timestamp string, page_id long, url string, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string, archive string, offset long")
ORDER = ["urlkey", "timestamp", "page_id"]
#: Captures in a range of the index: what a task of the merge holds.
PER_RANGE = 100_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: every 5 hexadecimal digits are 4 of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), HEX32, BASE32)


def decisions(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Per row: digest, size, and the page a revisit refers to. ``rows`` has _row, page_id
    and _payload."""
    seen = staged(rows.select("_row", "page_id", base32_sha1(F.encode("_payload", "UTF-8")).alias("digest"),
                              F.octet_length("_payload").cast("bigint").alias("bytes")), "payloads")
    shared = staged(seen.where(F.col("bytes") >= least_bytes).groupBy("digest")
                    .agg(F.min("page_id").alias("first"), F.max(F.col("page_id").isNull()).alias("unnamed"),
                         F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    found = attach(seen, shared, ["digest"], F.col("_row"))
    again = (F.col("bytes") >= least_bytes) & ~F.coalesce("unnamed", F.lit(True)) & (F.col("page_id") != F.col("first"))
    return found.select("_row", "digest", "bytes", F.when(again, F.col("first")).alias("refers_to"))


def records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """One text per page: the whole record without its closing blank lines."""
    rows = with_row(pages.select("page_id", "url", "html"), "_row").select(
        "_row", "page_id", F.regexp_replace(text_of("url"), r"[\r\n]", "").alias("_url"), text_of("html").alias("_payload"))
    rows = rows.join(decisions(rows, least_bytes), "_row")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                    F.col("bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, "_payload"))
    captured = F.timestamp_seconds(F.lit(START) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN)))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    lines = [F.lit(VERSION),
             F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
             F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
             F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
             F.concat(F.lit("WARC-Target-URI: "), F.col("_url")),
             F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{END}WARC-Refers-To: <urn:page:"),
                                      F.col("refers_to").cast("string"), F.lit(">"))),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return rows.select(F.concat(F.concat_ws(END, *lines), F.lit(END + END), block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write archives below ``path``, one per task, compressed as a whole. The writer's line
    end is the pair of blank lines that closes a record."""
    records(pages, least_bytes).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host reversed, then port, path and query, in lower case: captures of a site stand together."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    at = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{at}){(parts.path or '/')}{query}".lower()


def captures(data: bytes, archive: str) -> list[tuple]:
    """The records of one archive, in the order of the index."""
    found = []
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as file:
        stream = io.BufferedReader(file, 1 << 20)
        offset = 0
        while line := stream.readline():
            if line.strip() != VERSION.encode():
                raise ValueError(f"{archive}: no record at {offset}")
            start, fields = offset, {}
            offset += len(line)
            while (line := stream.readline()).strip():
                offset += len(line)
                name, _, value = line.decode("utf-8").partition(":")
                fields[name] = value.strip()
            block = stream.read(int(fields["Content-Length"]))
            offset += len(line) + len(block) + len(stream.read(4))
            head, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            own = base64.b32encode(sha1(payload).digest()).decode()
            intact = kind == "revisit" or (own == digest and size == len(payload))
            if not intact:
                raise ValueError(f"{archive}: the payload of the record at {start} is not what its head says")
            url, time = fields["WARC-Target-URI"], "".join(c for c in fields["WARC-Date"] if c.isdigit())
            found.append((url_key(url), time, _number(fields["WARC-Record-ID"]), url, kind,
                          _number(fields.get("WARC-Refers-To", "")), size, digest, archive, start))
    return sorted(found, key=_key)


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _key(row) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``: a sorted run per archive."""
    ship(spark)
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                yield _frame(captures(data, archive))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(runs, CAPTURE)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")], dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "offset": "int64"})


def merged(runs: list[list]) -> Iterator:
    """Merge sorted runs of (key, row) by a tree of losers: a leaf per run, each inner node
    keeps the loser of its match, and the overall winner is replaced from its own run."""
    runs = [iter(r) for r in runs]
    size = max(1, len(runs))
    heads = [next(r, None) for r in runs] or [None]
    beats = lambda a, b: heads[b] is None or (heads[a] is not None and (heads[a][0], a) < (heads[b][0], b))
    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if size > 1 else 0
    while heads[best] is not None:
        yield heads[best][1]
        heads[best] = next(runs[best], None)
        node = (best + size) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def history(captured: DataFrame) -> DataFrame:
    """All captures in the order of URL key, timestamp and id, with the part of the index
    and the place in the part. A task holds one range, whose size does not grow with the
    data: their number does."""
    ship(captured.sparkSession)
    runs = staged(captured, "runs")  # the sampling of the ranges reads them, and so does the merge
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: list[list] = []
        for batch in batches:
            for row in batch[names].itertuples(index=False, name=None):
                row = tuple(None if v is pd.NA or v != v else v for v in row)
                key = _key(row)
                if not pieces or pieces[-1][-1][0] > key:
                    pieces.append([])  # the next run begins
                pieces[-1].append((key, row))
        rows = list(merged(pieces))
        if rows:
            yield _frame(rows).assign(place=range(len(rows)))

    ranges = max(int(captured.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // PER_RANGE))
    ranged = runs.repartitionByRange(ranges, *ORDER)
    return ranged.mapInPandas(merge, CAPTURE + ", place long").withColumn("part", F.spark_partition_id())


def ranked(index: DataFrame) -> DataFrame:
    """Add ``rank``, the 0-based place of a capture in the whole index: the captures of the
    parts before its own, and its place in the part."""
    index = staged(index, "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per part, a part per PER_RANGE captures
    starts = (index.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
              .select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return index.join(starts, "part").withColumn("rank", F.col("_start") + F.col("place")).drop("_start")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives for the pages, read them back and give the merged capture index."""
    spark = pages.sparkSession
    path = staged_path(spark, "warc")
    write(pages, path, least_bytes)
    return history(read(spark, path))
