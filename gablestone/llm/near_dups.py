"""Near-duplicate groups: SuperMinHash, banding, exact verification and union-find.

Documents are linked if their sets of word shingles have a Jaccard similarity of at least
``threshold``. Equal sets are folded into their smallest doc_id before anything else, so a
group of copies, however large, goes on as one row. Signatures are cut into bands; sets
that share a band are candidates. In each band's bucket all sets are first compared with
one hub, never with each other, and every candidate is confirmed on the full sets. What is
then still apart within a bucket is compared exactly by a second route whose cost doesn't
follow the bucket's size: shingles are ordered by rarity among these sets, and only sets
that share one of the few rarest - which a link makes necessary - are compared.

Pairs are tested in the join, not after it, and a shingle's sets meet only where their sizes
are within the threshold, and none within the largest component that is there. What can't
be avoided is that n sets of one size, all apart and with a rarest shingle in common, are
n * n / 2 tests of their parity maps, which Spark deals over tasks as a skewed join.

With 32 bands of 5 slots a pair at the threshold of 0.8 shares no band with probability
3e-6. Links are confirmed on 64-bit hashes of all distinct shingles of both documents.

Defined results: null and empty texts, or those without words, have an empty set and are
linked with nothing; fewer words than a shingle are one shingle; rows that share a doc_id
count as one document, linked with whatever any of its texts is linked with; rows with a
null doc_id are linked with nothing, have a null component and are kept; an empty table has
no groups; very long texts are read whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gablestone.llm.common import Scratch, free_prefix, parts, read
from gablestone.llm.components import components
from gablestone.llm.superminhash import bands, mix, signatures

SLOTS, BAND = 160, 5
THRESHOLD = 80  # percent
#: Words whose hashes a task remembers, and ids (eight bytes each) that are broadcast, at most.
MEMORY, BROADCAST_IDS = 200_000, 1_000_000
#: Bytes of links and members to expect for each row of the table.
LINK_BYTES = 64
#: Bits of a set's parity map: those that differ between two maps are at most as many as the
#: elements that differ between the sets, so a pair with too many of them can't be linked.
BITS = 512
U = np.uint64

SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType(), False),
    T.StructField("set_hash", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType(), False)),
])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int):
        self.size, self.words = size, WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, U)
        if len(self.words) > MEMORY:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), U, len(words))
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, U(k))
        for i in range(k):
            out = out * U(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i]
        return np.unique(mix(out))


def sketcher(size: int):
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        shingle = Shingler(size)
        for texts in parts(batches):
            sets = [shingle(t) for t in texts.to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = bands(signatures(np.concatenate(sets) if sets else np.zeros(0, U), sizes, SLOTS), BAND)
            at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=["n_shingles", "set_hash", "bands"])

    return F.arrow_udf(sketch, SKETCH).asNondeterministic()


SET = T.StructType([T.StructField("set", T.BinaryType(), False), T.StructField("bits", T.ArrayType(T.LongType(), False), False)])


def parity(s: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((s & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def set_maker(size: int):
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingle = Shingler(size)
        for texts in parts(batches):
            sets = [shingle(t) for t in texts.to_pylist()]
            at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64))
            bits = pa.array(np.concatenate([parity(s) for s in sets]) if sets else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(at, bits)], names=["set", "bits"])

    return F.arrow_udf(make, SET).asNondeterministic()


def _hash_list(sets: pa.Array) -> pa.Array:
    rows = [np.frombuffer(x.as_buffer(), np.int64) for x in sets]
    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


hash_list = F.arrow_udf(_hash_list, T.ArrayType(T.LongType(), False))


def linker(threshold: int):
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts(batches):
            out = []
            for a, b in zip(left, right):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                out.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(alike, T.BooleanType()).asNondeterministic()


class NearDuplicates:
    """One run over a table; ``sketches`` and ``members`` are what it found."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: int = THRESHOLD):
        self.size, self.threshold = size, threshold
        self.scratch = Scratch(docs.sparkSession)
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
        sketch = self.docs.select("id", sketcher(size)("t").alias("s")).select("id", "s.*")
        self.sketches = self.scratch.write(sketch, "sketches")
        self.scratch.size = LINK_BYTES * self.sketches.count()
        self.members = self.scratch.write_few(self._group(), "members")
        self.scratch.release()
        for name in ("reps", "met", "sets", "distinct", "shingles", "rarest", "sized"):
            self.scratch.drop(name)

    def _group(self) -> DataFrame:
        """(id, component) of every id that is linked with another, or shares its id's rows."""
        sets = self.sketches.where("n_shingles > 0 and id is not null")
        folded = sets.groupBy("set_hash").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("r"))
        reps = self.scratch.write(folded.select("set_hash", "r.*"), "reps")
        copies = sets.select("id", "set_hash").join(reps.select("set_hash", F.col("id").alias("rep")), "set_hash").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
        links = self.near_links(reps.select("id", "n_shingles", "bands"))
        # A copy hangs on its representative alone; only a repeated id can tie two of them.
        several = sets.groupBy("id").agg(F.count_distinct("set_hash").alias("n")).where("n > 1").limit(1).count()
        if several:
            same = sets.groupBy("id").agg(F.count_distinct("set_hash").alias("k")).where("k > 1").select("id")
            held = sets.select("id", "set_hash").join(same, "id").join(reps.select("set_hash", F.col("id").alias("b")), "set_hash").select(F.col("id").alias("a"), "b").where("a != b")
            return components(links.union(copies).union(held), self.scratch)
        near = self.scratch.keep(components(links, self.scratch))
        named = copies.join(near, copies.b == near.node, "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
        return named.union(near)

    def near_links(self, reps: DataFrame) -> DataFrame:
        """Confirmed links (a, b) that connect whatever the threshold connects among candidates."""
        scratch = self.scratch
        rows = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
        size = rows.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
        # Written first, so that the join reads two plain inputs, which Spark can split where a bucket is hot.
        met = scratch.write(rows.join(scratch.keep(size), "band"), "met")
        ids = scratch.keep(met.select("id").distinct())
        self.sets = self.distinct_sets(scratch.write(self.sets_of(ids, ids.count()), "sets"))
        links = self.confirm(self._fit(met))
        # Buckets of two are settled. In larger ones some sets may still be apart.
        tied = components(links, scratch)
        now = met.where("c > 2").join(tied, met.id == tied.node, "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
        now = scratch.keep(now)
        apart = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band")
        rest = scratch.keep(now.join(scratch.keep(apart), "band", "left_semi").select("id", "n", "component").distinct())
        if not rest.limit(1).count():
            return links
        return links.union(self.confirm(self.by_rare_shingles(rest)))

    def _fit(self, met: DataFrame) -> DataFrame:
        """Pairs of a row and its hub; only sizes within the threshold of each other can be linked."""
        near = 100 * F.least("n", "hub.n") >= self.threshold * F.greatest("n", "hub.n")
        return met.where(near & (F.col("id") != F.col("hub.id"))).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()

    def by_rare_shingles(self, rest: DataFrame) -> DataFrame:
        """Pairs (a, b) of these sets, of different components, that share one of their rarest shingles.

        In any order of the shingles, two sets of sizes n and m that reach the threshold t
        share one of the first n - ceil(t n) + 1 of the one and of the first
        m - ceil(t m) + 1 of the other; an order by rarity makes that seldom chance.
        """
        scratch = self.scratch
        # An id may hold several sets: each is ranked by itself and has its own size.
        n = (F.octet_length("set") / 8).cast("long").alias("n")
        have = self.sets.join(rest.select("id", "component").distinct(), "id").select("id", F.xxhash64("set").alias("h"), n, "component", "bits", F.explode(hash_list("set")).alias("shingle"))
        have = scratch.write(have, "shingles")
        many = have.groupBy("shingle").agg(F.count("*").alias("df"))
        ranked = have.join(many, "shingle").withColumn("i", F.row_number().over(Window.partitionBy("id", "h").orderBy("df", "shingle")))
        first = ranked.where((F.col("i") <= F.col("n") - F.ceil(F.col("n") * self.threshold / 100) + 1) & (F.col("df") > 1))
        first = scratch.write(first.select("shingle", "id", "n", "component", "bits", "i"), "rarest")
        # Linked sets are of like size: their classes, by powers of the threshold, are the same or next to each other.
        sized = first.withColumn("c", F.floor(F.log("n") / float(np.log(100 / self.threshold)) + 1e-9))
        # Whom a key's largest component holds needn't meet there: all others meet everyone.
        largest = sized.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.count("*").alias("k")).where("k > 1").select("shingle", "top")
        sized = scratch.write(sized.join(largest, "shingle"), "sized")
        x = sized.where("component != top").alias("x")
        y = sized.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).alias("y")
        # Sharing the i-th and the j-th leaves at most so many shingles in common (positional bound).
        least = F.ceil((F.col("x.n") + F.col("y.n")) * self.threshold / (100 + self.threshold))
        left = 1 + F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) + F.least("x.i", "y.i") - 1
        differ = sum((F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range(BITS // 64)), F.lit(0))
        once = (F.col("y.component") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
        near = 100 * F.least("x.n", "y.n") >= self.threshold * F.greatest("x.n", "y.n")
        pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") == F.col("y.c")) & once & (F.col("x.component") != F.col("y.component")) & near & (left >= least) & (differ <= F.col("x.n") + F.col("y.n") - 2 * least))
        return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def sets_of(self, ids: DataFrame, n: int) -> DataFrame:
        """(id, set) of these ids, from the texts."""
        few = F.broadcast(ids) if n <= BROADCAST_IDS else ids
        return self.docs.join(few, "id", "left_semi").select("id", set_maker(self.size)("t").alias("s")).select("id", "s.*")

    def distinct_sets(self, sets: DataFrame) -> DataFrame:
        """Each set of an id once, however many of its rows hold it; only rows of repeated ids move."""
        sets = sets.where(F.octet_length("set") > 0)
        again = sets.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
        again = self.scratch.keep(again)
        n = again.count()
        if not n:
            return sets
        few = F.broadcast(again) if n <= BROADCAST_IDS else again
        once = sets.join(few, "id", "left_semi").groupBy("id", F.xxhash64("set").alias("h")).agg(F.first("set").alias("set"), F.first("bits").alias("bits")).drop("h")
        return self.scratch.write(sets.join(few, "id", "left_anti").unionByName(once), "distinct")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are as alike as asked for."""
        left = pairs.join(self.sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
        both = left.join(self.sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        return self.scratch.keep(both.where(linker(self.threshold)("x", "y")).select("a", "b").distinct())

    def result(self) -> DataFrame:
        """(id, n_shingles, component), one row for each row of the table."""
        members = self.members.select(F.col("node").alias("id"), "component")
        return self.sketches.select("id", "n_shingles").join(members, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))

    def keep_one(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """The rows of docs that stand for their group: the smallest key's, once."""
        p = free_prefix(docs)
        gone = self.members.where("node != component").select(F.col("node").alias(f"{p}id"))
        gone = self.scratch.write_few(gone, "gone")
        few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        out = docs.join(few, F.col(key).cast("long") == F.col(f"{p}id"), "left_anti")
        again = self.sketches.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(f"{p}id"))
        again = self.scratch.write_few(again, "again")
        n = again.count()
        if not n:
            return out
        # Of rows that repeat an id, the one with the smallest text stays.
        few = F.broadcast(again) if n <= BROADCAST_IDS else again
        same = F.col(key).cast("long") == F.col(f"{p}id")
        order = [F.xxhash64(*[F.col(c) for c in docs.columns])]
        text = [F.sha2(F.col("text"), 256)] if "text" in docs.columns else []
        once = out.join(few, same, "left_semi").withColumn(f"{p}i", F.row_number().over(Window.partitionBy(key).orderBy(*text, *order))).where(F.col(f"{p}i") == 1)
        return out.join(few, same, "left_anti").unionByName(once.select(*docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles."""
    return NearDuplicates(docs).keep_one(docs)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NearDuplicates(read(spark, sf_dir, "documents"), size=4).result()
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
