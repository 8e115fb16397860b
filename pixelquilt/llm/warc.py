"""WARC archives of web pages, and the capture index merged from their sorted runs.

Writing: each record is a string that Spark's text writer puts out, its separator being the
empty line pair that ends a WARC record, so archives land in any store Spark writes to.  Of
equal payloads one record carries it (response), the others point there (revisit).

Index: every archive gives one run of captures, sorted by URL key and time.  Runs are cut at
common split points into sorted pieces; a task gets the pieces of one key range from all runs
and merges them with a loser tree.  The whole key (URL key, time, page, archive, offset) sets
the split points, so the captures of one URL may spread over many ranges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.common import lower_ascii, materialize, scratch_root

#: Most records of one archive, which one task reads back at once.
ARCHIVE_RECORDS = 20_000
#: Captures of one key range, which one task merges; and captures a range in the sample that sets the split points.
RANGE_ROWS, SAMPLES = 100_000, 32
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: 8 groups of 20 bits, 4 letters each."""
    letters = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """The host's labels in reverse, joined by commas, then ``)`` and the rest in lower case; the
    fragment and a trailing slash are left out.  Null, or no ``://``: empty."""
    host = lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1), r"/$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), lower_ascii(rest))).otherwise(F.lit(""))


def capture_time(page_id: Column) -> Column:
    """A time for pages that have none: seconds from the start of 2024, by id."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(31536000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): the WARC record of each page, without the empty lines that end it.

    The response of a group of equal payloads is the one with the largest page_id; a null id is
    below all others, and of rows that share the largest id all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = base32(F.sha1(payload.cast("binary")))
    own = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"))
    #: Summed up before the shuffle: a payload that a third of all pages share is a row from each task.
    first = pages.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    repeated = first.where("n > 1").select("digest", "response_id")
    own = own.join(repeated, "digest", "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull()
    date = capture_time(F.col("page_id"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("response_id").cast("string"), F.lit(">\r\nWARC-Original-Length: "), F.octet_length("payload").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(END), body,
    )
    return own.select("page_id", head.alias("record"))


def write(pages: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Write a record for each page; an archive is one compressed stream."""
    rows = records(pages).select("record")
    rows.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        head = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        length = int(head["content-length"])
        yield at, head, data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4


_CAPTURE = "page_id long, url_key string, captured string, run string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(value: str | None) -> int | None:
    value = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives; within an archive (``run``) sorted by URL key, time and page.

    Each archive is read whole by one task; payloads are checked against their digests.
    """
    names = [f.split()[0] for f in _CAPTURE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.column(0)[i].as_py().rpartition("/")[2]
                data = batch.column(1)[i].as_py()
                data = zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for offset, head, block in parse(data):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, own = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if own != digest:
                            raise ValueError(f"{run}, offset {offset}: the payload's digest is {own}, its record has {digest}")
                    else:
                        size = int(head["warc-original-length"])
                    rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], head["warc-date"], offset, size, digest, kind, _page(head.get("warc-refers-to"))))
                cols = list(zip(*rows)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([run] * len(rows), pa.string())], ["page_id", "url", "captured", "offset", "payload_bytes", "payload_digest", "record_type", "refers_to", "run"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    got = files.mapInArrow(work, "page_id long, url string, captured string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string")
    got = got.withColumn("url_key", url_key(F.col("url")))
    return got.select(*names).sortWithinPartitions("run", "url_key", "captured", F.col("page_id").asc_nulls_first(), "offset")


class LoserTree:
    """k-way merge: the inner nodes hold losers, so a new item of the winner's run plays log k matches."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = runs, key
        self.k = max(1, len(runs))
        self.head: list = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.keys = [self._key(x, i) for i, x in enumerate(self.head)]
        #: tree[0]: the winner; tree[j]: the loser of match j.
        self.tree = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for j in range(self.k - 1, 0, -1):
            a, b = winners[2 * j], winners[2 * j + 1]
            a, b = (a, b) if self.keys[a] <= self.keys[b] else (b, a)
            winners[j], self.tree[j] = a, b
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _key(self, item, run: int) -> tuple:
        """An exhausted run loses against all; ties go by run."""
        return (item is None, self.key(item) if item is not None else (), run)

    def __iter__(self) -> Iterator:
        while self.head[w := self.tree[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self.keys[w] = self._key(self.head[w], w)
            j = (w + self.k) // 2
            while j:
                if self.keys[self.tree[j]] < self.keys[w]:
                    w, self.tree[j] = self.tree[j], w
                j //= 2
            self.tree[0] = w


_KEY = ("url_key", "captured", "page_id", "run", "offset")


def _order(url_key: str, captured: str, page: int | None, run: str, offset: int) -> tuple:
    """The place of a capture: null ids before all others, equal captures by archive and offset."""
    return (url_key, captured, page is not None, page or 0, run, offset)


def _split_points(captures: DataFrame, parts: int, rows: int) -> list[tuple]:
    """``parts`` - 1 places that cut the captures into even ranges, from a sample of about ``SAMPLES`` a range."""
    share = parts * SAMPLES / max(1, rows)
    sample = captures.select(*_KEY) if share >= 1 else captures.select(*_KEY).sample(share, seed=0)
    places = sorted(_order(*r) for r in sample.collect())
    return [places[len(places) * i // parts] for i in range(1, parts)] if places else []


def _pieces(captures: DataFrame, splits: list[tuple]) -> DataFrame:
    """(part, piece): every sorted stretch of captures, cut at the split points and packed as one Arrow value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [_order(*r) for r in zip(*(batch.column(c).to_pylist() for c in _KEY))]
            parts, out, begin = [], [], 0
            while begin < len(places):
                end = begin + 1
                while end < len(places) and places[end][4] == places[begin][4] and places[end - 1] < places[end]:
                    end += 1
                while begin < end:
                    part = bisect_right(splits, places[begin])
                    stop = bisect_left(places, splits[part], begin, end) if part < len(splits) else end
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as writer:
                        writer.write_batch(batch.slice(begin, stop - begin))
                    parts.append(part)
                    out.append(sink.getvalue().to_pybytes())
                    begin = stop
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], ["part", "piece"])

    return captures.mapInArrow(work, "part int, piece binary")


def merge_index(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """Captures in global order of (URL key, time, page), partition after partition.

    ``captures`` are runs in their own order, as ``read`` gives them.  Each run is cut at common
    split points and travels to the ranges in sorted pieces; a range's task merges its pieces
    with a loser tree and sorts nothing.  Rows that aren't in order only make more pieces.  A
    task holds one range, of about ``RANGE_ROWS`` captures however many there are: split points
    go down to archive and offset, so repeated captures are cut as well.  Null ids come before
    all others; equal captures go by archive and offset.
    """
    rows = captures.count()
    parts = parts or max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    pieces = _pieces(captures, _split_points(captures, parts, rows)).repartitionById(parts, "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for piece in batch.column("piece"):
                table = pa.ipc.open_stream(piece.as_py()).read_all()
                held.append((table["run"][0].as_py(), [_order(*r) for r in zip(*(table[c].to_pylist() for c in _KEY))], table))
        if not held:
            return
        held.sort(key=lambda h: (h[0], h[1][0]))
        places, cuts = [], []
        for run, own, _ in held:
            if not places or places[-1][4] != run or places[-1] > own[0]:
                cuts.append(len(places))
            places += own
        table = pa.concat_tables([t for _, _, t in held])
        held.clear()
        runs = [iter(range(a, b)) for a, b in zip(cuts, [*cuts[1:], len(places)])]
        order = LoserTree(runs, places.__getitem__)
        merged = table.take(pa.array(np.fromiter(order, dtype=np.int64, count=len(places))))
        yield from merged.combine_chunks().to_batches(max_chunksize=10_000)

    return pieces.mapInArrow(work, captures.schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back, and merge their index.

    A null html is an empty payload; a null url has the key ''; repeated rows have a record each;
    further columns of ``pages`` are left out.  An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return merge_index(materialize(read(spark, folder), "capture-runs"))
