"""WARC records, and a Merkle audit of their replicas.

Every record is hashed; records are the leaves of a tree over ordered ranges of byte
offsets: those that begin in the same 64 KiB make a node, sixteen neighbouring ranges make
one above, and so on up to the file. Two replicas are compared at the roots, and only below
branches that differ the next level is compared, down to the records that were changed, are
missing or are extra.

Nodes have a bounded number of children by construction (a range of offsets holds only so
many records), so no group grows with the table. Records are reduced to hash, offset and
length where they are read; contents are never shuffled.

Defined results: null parts of a record are empty; records of a null file can't be placed
and are audited as the file -1, null offsets as -1, both spread by their hashes so that they
are no single group; records that repeat are one leaf with a count, reported as often as one
side has more of them; equal replicas, also empty ones, give no row; other columns are
ignored. Of files, what is no record, is cut short or can't be decompressed is returned as a
row with a ``fault``, and reading goes on at the next record; a very long record is one row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gablestone.llm.common import Scratch, bounded_batches, read

#: Bits of an offset below the first range, bits by which each next range is wider, and bits over which rows without a place are spread.
LEAF_BITS, STEP_BITS, LOST_BITS = 16, 4, 40
FILE_RECORDS = 1000
EOL = "\r\n"
#: Date of records that bear none; bytes that a reader takes, and hands on, at once.
NO_DATE, CHUNK = "1970-01-01T00:00:00Z", 8 << 20


# --- records --------------------------------------------------------------------


def record(kind: Column, uri: Column, body: Column, date: Column | None = None) -> Column:
    """A record's bytes as text: version, the mandatory headers, body, two line ends.

    Its identifier is a digest of address and body, so equal pages have equal records.
    """
    body, uri = F.coalesce(body, F.lit("")), F.coalesce(uri, F.lit(""))
    m = F.md5(F.concat(uri, F.lit("|"), body))
    id_ = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    at = F.lit(NO_DATE) if date is None else F.coalesce(date, F.lit(NO_DATE))
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), id_, F.lit(">")), F.concat(F.lit("WARC-Date: "), at)]
    head += [F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), F.lit(EOL)]
    return F.concat(F.concat_ws(EOL, *head), body, F.lit(EOL + EOL))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a one-column table of ``record`` texts as WARC files, one for each partition."""
    r = F.col(records.columns[0])
    # Every record ends with a line end, which the writer of texts adds.
    records.select(F.substring(r, F.lit(1), F.char_length(r) - 1)).write.option("lineSep", "\n").option("compression", compression).text(path)


def _inflated(data: bytes) -> Iterator[bytes | None]:
    """The decompressed members of a gzip file in chunks; None where a member is broken."""
    at = 0
    while at < len(data):
        member, start = zlib.decompressobj(31), at
        try:
            while not member.eof:
                if at >= len(data):
                    yield None
                    return
                piece = data[at : at + CHUNK]
                at += len(piece)
                yield member.decompress(piece, CHUNK)
                while member.unconsumed_tail:
                    yield member.decompress(member.unconsumed_tail, CHUNK)
            at -= len(member.unused_data)
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", start + 1)
            if at < 0:
                return


class Reader:
    """Records from chunks of bytes, of which it holds no more than the record at hand."""

    START, NEXT = re.compile(rb"WARC/\d+\.\d+\r?\n"), re.compile(rb"\nWARC/\d+\.\d+\r?\n")
    BLANK = re.compile(rb"\r?\n\r?\n")

    def __init__(self, chunks: Iterator[bytes | None]):
        self.chunks, self.held = chunks, bytearray()
        self.offset, self.over, self.broken = 0, False, False

    def more(self) -> bool:
        """Take a chunk; false at the end and, until ``resume``, where a member is broken."""
        if self.over or self.broken:
            return False
        end = object()
        piece = next(self.chunks, end)
        self.over, self.broken = piece is end, piece is None
        if self.over or self.broken:
            return False
        self.held += piece
        return True

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += len(out)
        return out

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], bytes | None, str, str | None]]:
        """(offset, length, headers, body, sha256, fault)."""
        while True:
            while not self.held.strip(b"\r\n") and self.more():
                pass
            blank = len(self.held) - len(self.held.lstrip(b"\r\n"))
            self.take(blank)
            if self.held:
                yield self._next()
            elif self.broken:
                yield self.offset, 0, {}, None, hashlib.sha256().hexdigest(), "broken member"
            if self.broken:
                self.broken = False
            elif self.over and not self.held:
                return

    def _next(self):
        start = self.offset
        while len(self.held) < 16 and self.more():
            pass
        if not self.START.match(self.held):
            return self._skip(start, {}, hashlib.sha256(), "no record")
        while not (end := self.BLANK.search(self.held)) and self.more():
            pass
        if not end:
            raw = self.take(len(self.held))
            return start, len(raw), {}, None, hashlib.sha256(raw).hexdigest(), self._why()
        head = self.take(end.end())
        digest, headers = hashlib.sha256(head), {}
        for line in head.decode("utf-8", "replace").splitlines()[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
            return self._skip(start, headers, digest, "bad length")
        n = int(headers["content-length"])
        while len(self.held) < n + 4 and self.more():
            pass
        fault = self._why() if len(self.held) < n else None
        body = self.take(n)
        digest.update(body)
        tail = self.held[:4]
        if not fault and bytes(tail) != b"\r\n\r\n":
            fault = self._why() if len(tail) < 4 and not tail.strip(b"\r\n") else "bad length"
        ends = self.take(4) if bytes(tail) == b"\r\n\r\n" else b""
        digest.update(ends)
        return start, self.offset - start, headers, body, digest.hexdigest(), fault

    def _why(self) -> str:
        return "broken member" if self.broken else "cut short"

    def _skip(self, start: int, headers: dict, digest, fault: str):
        """Go on to what looks like the next record; the bytes until there are counted and hashed."""
        while True:
            if found := self.NEXT.search(self.held):
                digest.update(self.take(found.start() + 1))
                break
            raw = self.take(max(0, len(self.held) - 16))
            digest.update(raw)
            if not self.more():
                digest.update(self.take(len(self.held)))
                break
        return start, self.offset - start, headers, None, digest.hexdigest(), fault


def records_of(data: bytes) -> Reader:
    """The records of a file's bytes, which may be gzip, one member a record or not."""
    plain = (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
    return Reader(_inflated(data) if data[:2] == b"\x1f\x8b" else plain)


RECORDS = "file string, offset long, length long, type string, uri string, body binary, sha256 string, fault string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, type, uri, body, sha256, fault) of the records of WARC files.

    Offsets are those of the decompressed records. A task reads a file at a time, as it is
    stored; what is decompressed is handed on in batches of about ``CHUNK`` bytes. Files
    may be as large as Spark lets one value be (2 GB, compressed or not).
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                name, rows, size = batch.column(0)[k].as_py(), [], 0
                for offset, length, h, body, sha, fault in records_of(batch.column(1)[k].as_py() or b""):
                    rows.append((name, offset, length, h.get("warc-type"), h.get("warc-target-uri"), body, sha, fault))
                    size += length
                    if size >= CHUNK:
                        yield sent(rows)
                        rows, size = [], 0
                if rows:
                    yield sent(rows)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORDS)


def laid_out(records: DataFrame, file: str, order: list[str], length: str = "length") -> DataFrame:
    """records with their offset: the lengths before them in their file, whose records are few."""
    w = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("offset", F.sum(length).over(w) - F.col(length))


# --- trees ----------------------------------------------------------------------


def leaves(records: DataFrame) -> DataFrame:
    """(file, place, offset, hash, n): equal records with their count, and where they stand in the tree.

    Those without a file or an offset stand at a place drawn from their hash.
    """
    hash_ = F.coalesce("hash", F.lit(""))
    drawn = F.pmod(F.xxhash64(hash_), F.lit(1 << LOST_BITS))
    place = F.when(F.col("file").isNull() | F.col("offset").isNull(), drawn).otherwise(F.col("offset"))
    rows = records.select(F.coalesce(F.col("file"), F.lit(-1)).alias("file"), place.cast("long").alias("place"), F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"), hash_.alias("hash"))
    return rows.groupBy("file", "place", "offset", "hash").agg(F.count("*").alias("n"))


def levels_for(longest: int) -> int:
    """Levels of ranges until one range covers a file of that many bytes."""
    n = 1
    while longest >> (LEAF_BITS + STEP_BITS * (n - 1)):
        n += 1
    return n


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of (file, node, hash), the leaves' ranges first and the files' roots last."""
    first = leaves.withColumn("node", F.shiftright("place", LEAF_BITS))
    digest = lambda order: F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order]))), 256)
    out = [first.groupBy("file", "node").agg(digest(["place", "offset", "hash", "n"]).alias("hash"))]
    for _ in range(levels - 1):
        up = out[-1].withColumn("parent", F.shiftright("node", STEP_BITS))
        out.append(up.groupBy("file", "parent").agg(digest(["node", "hash"]).alias("hash")).withColumnRenamed("parent", "node"))
    roots = out[-1].groupBy("file").agg(digest(["node", "hash"]).alias("hash"))
    return [*out, roots.withColumn("node", F.lit(0).cast("long")).select("file", "node", "hash")]


def _unlike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    both = a.select(*keys, F.col("hash").alias("ha")).join(b.select(*keys, F.col("hash").alias("hb")), keys, "full")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, left_hash, right_hash, status) of the records that differ between replicas.

    Both are (file, offset, hash). Trees are written level by level, so a descent reads only
    what lies below the branches that differ; they are removed once the result is written.
    """
    spark = left.sparkSession
    scratch = Scratch(spark)
    left, right = (scratch.write(leaves(df), side) for df, side in ((left, "left"), (right, "right")))
    longest = max(df.agg(F.max("place")).first()[0] or 0 for df in (left, right))
    n = levels_for(longest)
    a, b = ([scratch.write(t, f"{side}-{i}") for i, t in enumerate(tree(df, n))] for side, df in (("a", left), ("b", right)))
    unlike = _unlike(a[n], b[n], ["file"]).select("file")
    for i in range(n - 1, -1, -1):
        # The top ranges lie below the root; of the others those below a range that differs.
        near = lambda t: t if i == n - 1 else t.withColumn("parent", F.shiftright("node", STEP_BITS))  # noqa: E731, B023
        keys = ["file"] if i == n - 1 else ["file", "parent"]
        unlike = scratch.write(_unlike(near(a[i]).join(unlike, keys, "left_semi"), near(b[i]).join(unlike, keys, "left_semi"), ["file", "node"]).select("file", F.col("node").alias("parent")), f"unlike-{i}")
    below = lambda df: df.withColumn("parent", F.shiftright("place", LEAF_BITS)).join(unlike, ["file", "parent"], "left_semi").drop("parent")
    at = ["file", "place", "offset", "hash"]
    both = below(left).withColumnRenamed("n", "na").join(below(right).withColumnRenamed("n", "nb"), at, "full")
    more = F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))
    apart = both.select(*at, more.alias("more")).where("more != 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))))
    # At a place where both sides have records of their own, these are told as changed, by the order of their hashes.
    row = F.row_number().over(Window.partitionBy("file", "place", "offset", "side").orderBy("hash", "k"))
    apart = apart.withColumn("side", F.col("more") > 0).withColumn("i", row)
    side = lambda x, name: apart.where(x).select("file", "place", "offset", "i", F.col("hash").alias(name))
    found = side(F.col("side"), "left_hash").join(side(~F.col("side"), "right_hash"), ["file", "place", "offset", "i"], "full")
    status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    found = scratch.write(found.select("file", "offset", "left_hash", "right_hash", status.alias("status")), "found")
    for name in ("left", "right", *(f"{s}-{i}" for s in "ab" for i in range(n + 1)), *(f"unlike-{i}" for i in range(n))):
        scratch.drop(name)
    return found


# --- query ------------------------------------------------------------------------


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, file, length, hash) and of a damaged copy (copy_hash, kept): narrow rows of whole pages.

    A page without an id is a file of its own, named by its content. The replica that is audited is a copy of the table in which every page_id of remainder 7
    by 53 has another first character and every one of remainder 13 by 97 is lost.
    """
    damaged = F.concat(F.lit("?"), F.expr("substring(html, 2)"))
    whole = record(F.lit("response"), F.col("url"), F.col("html"))
    other = record(F.lit("response"), F.col("url"), F.when((F.col("page_id") % 53 == 7) & F.col("html").rlike("^[\\x01-\\x7F]"), damaged).otherwise(F.col("html")))
    file = F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 31)))
    return pages.select("page_id", file.cast("long").alias("file"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("hash"), F.sha2(other, 256).alias("copy_hash"), F.coalesce(F.col("page_id") % 97 != 13, F.lit(True)).alias("held"))


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record with its place and digest, and what the audit of the replica found."""
    rows = laid_out(page_records(read(spark, sf_dir, "pages")), "file", ["page_id", "hash", "length"])
    rows = Scratch(spark).write(rows, "records")
    found = audit(rows, rows.where("held").select("file", "offset", F.col("copy_hash").alias("hash"))).select("file", "offset", "status")
    return rows.join(found, ["file", "offset"], "left").select("page_id", "file", "offset", "length", F.col("hash").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


_LINE = "chr(13) || chr(10)"
OP7_SQL = f"""
WITH i AS (SELECT *, md5(coalesce(url, '') || '|' || coalesce(html, '')) AS m FROM pages),
r AS (
  SELECT page_id, CAST(floor(page_id / {FILE_RECORDS}.0) AS BIGINT) AS file, html,
    'WARC/1.1' || {_LINE} || 'WARC-Type: response' || {_LINE}
    || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || {_LINE}
    || 'WARC-Date: {NO_DATE}' || {_LINE} || 'WARC-Target-URI: ' || coalesce(url, '') || {_LINE}
    || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || {_LINE} || {_LINE}
    || coalesce(html, '') || {_LINE} || {_LINE} AS rec
  FROM i),
l AS (SELECT page_id, file, html, CAST(octet_length(encode(rec)) AS BIGINT) AS length, sha256(rec) AS record_sha256 FROM r)
SELECT page_id, file,
  CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, record_sha256, length ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset",
  length, record_sha256,
  CASE WHEN page_id % 97 = 13 THEN 'missing'
       WHEN page_id % 53 = 7 AND regexp_matches(html, '^[\\x01-\\x7F]') AND substr(html, 1, 1) <> '?' THEN 'changed' ELSE 'ok' END AS status
FROM l
"""
