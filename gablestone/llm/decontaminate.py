"""Benchmark decontamination by a prefix-filtered set join.

Every window of ten consecutive words of an item is a set of shingles (neighbouring word
pairs). Shingles are ordered by rarity: how often the corpus has them, counted in a table of
``BUCKETS`` hash buckets whose size depends on nothing. A document that holds a window holds
all its shingles, so joining the rarest one - the necessary prefix for containment of 1 -
finds every pair of window and place. The place of the shingle bounds where the window must
begin and end, and the words there are then compared exactly.

The join is carried out in the scan of the documents while the windows, counted first, are
few enough to be sent to the tasks. Beyond that it is an equi-join of rows: a bitmap of
fixed size picks the places whose shingle may be a window's, those go with the words around
them to the windows of that shingle, and windows are salted so that a passage which a third
of the corpus holds is no single task. Either way the corpus is scanned twice, however many
windows there are, and no text is shuffled to find its hits. The hits of a text are joined
to its documents by the text's digest: broadcast while their bytes are few, else salted,
and only then do whole rows move.

Defined results: null texts and texts without a word have no windows and no hits; the
windows of an item without an item_id are hits, but name no item; repeated items count once
for each item_id; an empty benchmark hits nothing; repeated documents are answered row by
row; very long texts are read whole; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestone.llm.common import Scratch, free_prefix, parts, read

WINDOW = 10
#: Windows, and bytes of windows with their items, that are sent to the tasks at most.
BLOCK_WINDOWS, BLOCK_BYTES = 100_000, 32 << 20
#: Hash buckets in which shingles are counted, and bits that mark shingles of windows; powers of two.
BUCKETS, BITS = 1 << 18, 1 << 26
#: Copies of a window, between which its places are dealt; bytes of hits that are broadcast.
SALT, BROADCAST_BYTES = 16, 64 << 20
#: Words whose hashes a task remembers.
MEMORY = 200_000
#: Lower-cases A-Z; every other ASCII character that is no digit or letter parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

HITS = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("starts", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("ends", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
])
Window = tuple[bytes, ...]


def words(text: bytes | str | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode("utf-8") if isinstance(text, str) else text).translate(_FOLD).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[Window]:
    """All windows of an item; a shorter one is a single window."""
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


def shingles(window: Window) -> list[Window]:
    """Word pairs in order; the word itself where there is just one."""
    return list(zip(window, window[1:])) or [window]


# --- rarity ---------------------------------------------------------------------------


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_hashes(w: list[bytes], hashes: Hashes, size: int = 2) -> np.ndarray:
    """64-bit hashes of the word pairs, or of the words, at each place."""
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    h = h if size == 1 else h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, hashes = np.zeros(BUCKETS, np.int64), Hashes()
    for batch in parts(batches):
        found = [shingle_hashes(words(t), hashes) for t in batch.column(0).to_pylist()]
        counts += np.bincount(_bucket(np.concatenate(found)), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many shingles of the corpus fall into each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    got = docs.select(F.col(text).cast("binary")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix(window: Window, counts: np.ndarray, hashes: Hashes) -> tuple[int, int]:
    """(hash, offset) of a window's rarest shingle; of equally rare ones the first."""
    h = shingle_hashes(list(window), hashes, min(2, len(window)))
    i = int(counts[_bucket(h)].argmin())
    return int(h[i]), i


# --- windows of the benchmark -----------------------------------------------------------


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words(text)
            for i in range(0, len(w), 10_000):
                some = sorted(set(windows(w[i : i + 10_000 + WINDOW - 1]))) if i + WINDOW <= len(w) or not i else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array([b" ".join(x).decode() for x in some], pa.string())], names=["item", "window"])


def _prefixes(counts: np.ndarray):
    def run(texts: pa.Array) -> pa.Array:
        hashes = Hashes()
        got = [prefix(tuple(t.encode().split(b" ")), counts, hashes) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(np.array([h for h, _ in got], np.uint64).view(np.int64)), pa.array([i for _, i in got], pa.int32())], names=["key", "offset"])

    return F.arrow_udf(run, T.StructType([T.StructField("key", T.LongType()), T.StructField("offset", T.IntegerType())]))


def window_rows(benchmark: DataFrame, counts: np.ndarray, text: str, item: str) -> DataFrame:
    """(window, size, items, key, offset): each distinct window, its items, and its rarest shingle."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("t")).mapInArrow(_windows, "item string, window string")
    each = rows.groupBy("window").agg(F.collect_set("item").alias("items"))
    return each.withColumn("p", _prefixes(counts)("window")).select("window", F.size(F.split("window", " ")).alias("size"), "items", "p.key", "p.offset")


# --- few windows: matched in the scan ------------------------------------------------------


class Index:
    """Windows by their rarest shingle, with the shingle's offset in the window."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.pairs: dict[tuple, list] = {}
        self.singles: dict[bytes, list[str]] = {}
        for text, offset, names in rows:
            window = tuple(text.encode().split(b" "))
            if len(window) == 1:
                self.singles[window[0]] = names
            else:
                self.pairs.setdefault(window[offset : offset + 2], []).append((offset, len(window), window, names))

    def match(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside any window that occurs, and the items it is from."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        pairs, n = self.pairs, len(w)
        for i in [i for i, s in enumerate(zip(w, w[1:])) if s in pairs]:
            for offset, size, window, names in pairs[w[i], w[i + 1]]:
                start = i - offset
                if start >= 0 and start + size <= n and tuple(w[start : start + size]) == window:
                    spans.append((start, start + size))
                    items.update(names)
        if self.singles:
            for i, x in enumerate(w):
                if x in self.singles:
                    spans.append((i, i + 1))
                    items.update(self.singles[x])
        return merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _matcher(index: Index):
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            n, starts, ends, items = [], [], [], []
            for text in texts.to_pylist():
                w = words(text)
                spans, found = index.match(w)
                n.append(len(w))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                items.append(sorted(found))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["n_words", "starts", "ends", "items"])

    return F.arrow_udf(match, HITS).asNondeterministic()


# --- many windows: an equi-join of places ------------------------------------------------

PLACES = "text binary, key long, at int, before int, context string"


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the keys' bits set."""
    bit = F.shiftrightunsigned("key", 65 - BITS.bit_length())
    word = keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {65 - BITS.bit_length()}) & 63 as int))").alias("bit"))
    got = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _placer(bits: np.ndarray, sizes: list[int]):
    """Places of texts whose shingle may be that of a window, with the words around."""

    def marked(h: np.ndarray) -> np.ndarray:
        b = h >> np.uint64(65 - BITS.bit_length())
        return np.flatnonzero((bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in parts(batches):
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                w = words(text)
                digest = hashlib.sha256(text or b"").digest()
                for size in sizes:
                    h = shingle_hashes(w, hashes, size)
                    for i in marked(h).tolist():
                        low = max(0, i + size - WINDOW)
                        out.append((digest, int(h[i : i + 1].view(np.int64)[0]), i, i - low, b" ".join(w[low : i + WINDOW]).decode()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["text", "key", "at", "before", "context"])

    return run


def joined_hits(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(text digest, starts, ends, items) of the texts that hold any of these windows."""
    sizes = sorted(r[0] for r in rows.select(F.least(F.lit(2), "size")).distinct().collect())
    places = docs.select(F.col(text).cast("binary")).mapInArrow(_placer(_bits(rows.select("key")), sizes), PLACES)
    places = places.withColumn("salt", F.pmod(F.xxhash64("text", "at"), F.lit(SALT)))
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    words_ = F.split("context", " ")
    start = F.col("before") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.size(words_))
    exact = F.array_join(F.slice(words_, start + 1, F.col("size")), " ") == F.col("window")
    found = places.join(salted, ["key", "salt"]).where(F.when(inside, exact).otherwise(False))
    first = F.col("at") - F.col("offset")
    each = found.select("text", first.alias("a"), (first + F.col("size")).alias("b"), "items").groupBy("text").agg(F.collect_set(F.struct("a", "b")).alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return each.select("text", merged_spans("s").alias("m"), F.array_sort("items").alias("items")).select("text", "m.starts", "m.ends", "items")


def _merged(spans: pa.Array) -> pa.Array:
    got = [merge((x["a"], x["b"]) for x in s) for s in spans.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([[x[k] for x in s] for s in got], pa.list_(pa.int32())) for k in (0, 1)], names=["starts", "ends"])


merged_spans = F.arrow_udf(_merged, T.StructType(HITS.fields[1:3]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", out: str = "hits", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a struct: n_words, spans [starts, ends) of the words that are hit, and items."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(window_rows(benchmark, rarity(docs, text), text, item), "windows")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 100).alias("b")).first()
    raw = F.col(text).cast("binary")
    if size.n <= block_windows and (size.b or 0) <= BLOCK_BYTES:
        few = [(r.window, r.offset, r["items"]) for r in rows.select("window", "offset", "items").collect()]
        return docs.withColumn(out, _matcher(Index(few))(raw))
    hits = scratch.write(joined_hits(docs, rows, text), "hits")
    p = free_prefix(docs)
    hits = hits.select(F.col("text").alias(f"{p}key"), *[F.col(c).alias(f"{p}{c}") for c in ("starts", "ends", "items")])
    have = docs.withColumn(f"{p}n", _matcher(Index([]))(raw)).withColumn(f"{p}key", F.unhex(F.sha2(F.coalesce(raw, F.lit(b"")), 256)))
    weight = hits.agg(F.sum(F.lit(80) + 8 * F.size(f"{p}starts") + F.octet_length(F.array_join(f"{p}items", ",")))).first()[0] or 0
    if weight <= BROADCAST_BYTES:
        joined = have.join(F.broadcast(hits), f"{p}key", "left")
    else:
        salted = hits.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = have.withColumn(f"{p}salt", F.floor(F.rand(5) * SALT).cast("int")).join(salted, [f"{p}key", f"{p}salt"], "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hit = F.struct(F.col(f"{p}n.n_words").alias("n_words"), *[F.coalesce(F.col(f"{p}{c}"), none(k)).alias(c) for c, k in (("starts", "int"), ("ends", "int"), ("items", "string"))])
    return joined.withColumn(out, hit).select(*[c for c in docs.columns if c != out], out)


def n_hit(hits: str = "hits"):
    """How many words the spans hold."""
    return F.aggregate(F.arrays_zip(F.col(f"{hits}.starts").alias("a"), F.col(f"{hits}.ends").alias("b")), F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of any benchmark item."""
    p = free_prefix(docs)
    found = find(docs, read(spark, sf_dir, "benchmark"), out=f"{p}hits")
    return found.where(F.size(f"{p}hits.starts") == 0).select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        (F.size("hits.starts") > 0).alias("contaminated"),
    )


def brute_force(texts: list[tuple[int, str | None]], items: list[tuple[str, str | None]]) -> list[tuple]:
    """The same answer by comparing every window with every place; for tests."""
    out = []
    for doc_id, text in texts:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            for win in windows(words(t)):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        names.update([] if item is None else [str(item)])
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
