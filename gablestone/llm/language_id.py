"""Language identification by Bayesian fusion of evidence.

The posterior of a language is its prior at the host times the likelihoods of what is seen:
the text (byte trigrams, naive Bayes, tempered since neighbouring trigrams overlap), the
language declared by the markup, and the suffix of the address. Priors are counted by
grouped aggregation of the text's own verdicts and smoothed hierarchically: a host leans on
its site, a site on the whole corpus. How far declarations and suffixes can be trusted is
counted in the same pass. Missing evidence of any kind has likelihood 1.

The trigram model is fitted on a bounded sample of the rows of each declared language; which
languages there are, and the counts behind priors and trust, cover every row.

A row is kept if its text has letters and the best language is at least ``MIN_POSTERIOR``
likely. Defined results: a null or empty text, or one without letters, has no text evidence
and isn't kept, though it still gets the most likely language from the other evidence; null
hosts share a prior; unknown declarations count as missing; of equally likely languages the
first by name is taken; repeated rows are judged one by one, and alike; very long texts are
read whole; other columns pass through, also such with the names of results, as those stand
behind a prefix that no column has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gablestone.llm.common import Scratch, free_prefix, parts, read

#: Rows of each language from which the trigram model is fitted, at most.
MAX_TRAINING_ROWS = 6_000
BUCKETS = 1 << 15
#: Share of a trigram's evidence that counts, as trigrams overlap; and the most that a text's evidence may weigh.
TEMPER, MOST = 0.3, 60.0
#: Weight of the parent's prior, in rows, and of a declaration or suffix not yet seen.
LEAN, SEEN = 8.0, 0.5
MIN_POSTERIOR = 0.5
#: A language is known if so many rows of the whole table declare it.
MIN_ROWS = 8
#: Parts in which the rows of a language are ordered; bytes of priors that are broadcast, and parts of a host beyond that.
PARTS, BROADCAST_BYTES, SALT = 64, 64 << 20, 16

EVIDENCE = T.StructType([T.StructField("ll", T.ArrayType(T.FloatType(), False)), T.StructField("letters", T.LongType())])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC3 for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the letters, with one blank between words."""
    folded = np.frombuffer(b" " + b" ".join(raw.translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    if len(folded) < 3:
        return np.zeros(0, np.uint32)
    return ((folded[:-2] * 0x9E3779B1 + folded[1:-1] * 0x85EBCA77 + folded[2:] * 0xC2B2AE3D) & 0xFFFFFFFF) >> 17


@dataclass(frozen=True)
class TrigramModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # one row a bucket, one column a language

    def evidence(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """Log-likelihood of each language, less that of the best, and the number of letters."""
        raw = text or b""
        letters = int(_LETTER[np.frombuffer(raw, np.uint8)].sum())
        t = trigrams(raw) if letters else np.zeros(0, np.uint32)
        if not len(t) or not self.languages:
            return np.zeros(len(self.languages), np.float32), letters
        counts = np.bincount(t, minlength=BUCKETS) if len(t) > 3 * BUCKETS else None
        ll = (counts @ self.log_p if counts is not None else self.log_p[t].sum(0, dtype=np.float64)) * TEMPER
        return np.maximum(ll - ll.max(), -MOST).astype(np.float32), letters


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in parts(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            c += np.bincount(trigrams(text or b""), minlength=BUCKETS)
            rows[lang] = rows.get(lang, 0) + 1
    for lang, c in counts.items():
        used = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(used) + 1), pa.string()), pa.array([-1, *used.tolist()], pa.int32()), pa.array([rows[lang], *c[used].tolist()], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, key: str, text: str, declared: str, max_rows: int = MAX_TRAINING_ROWS) -> TrigramModel:
    """Count trigrams by declared language over at most ``max_rows`` rows of each, picked by hash."""
    named = docs.where(F.col(declared).isNotNull() & F.col(key).isNotNull())
    rows = named.select(F.xxhash64(F.lit(17), F.col(key)).alias("h"), F.col(text).cast("binary").alias("t"), F.lower(F.col(declared)).alias("lang"))
    taken = rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS).select("lang")
    # The first of each language are among the first of its parts, and no task sorts a whole language.
    part = F.pmod("h", F.lit(PARTS))
    first = rows.select("lang", "h").withColumn("i", F.row_number().over(Window.partitionBy("lang", part).orderBy("h"))).where(F.col("i") <= max_rows)
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= max_rows)
    last = first.groupBy("lang").agg(F.max("h").alias("last"))
    picked = rows.join(F.broadcast(last.join(taken, "lang")), "lang").where("h <= last").select("t", "lang")
    table = picked.mapInArrow(_count_trigrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (np.array(table[c].to_pylist()) for c in ("lang", "bucket", "n"))
    known = tuple(sorted(set(lang.tolist())))
    counts = np.full((BUCKETS, len(known)), 0.2)
    for j, name in enumerate(known):
        m = (lang == name) & (bucket >= 0)
        counts[bucket[m], j] += n[m]
    return TrigramModel(known, np.log(counts / counts.sum(0)).astype(np.float32) if known else counts.astype(np.float32))


def text_evidence(model: TrigramModel):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            got = [model.evidence(t) for t in texts.to_pylist()]
            flat = pa.array(np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.float32), pa.float32())
            at = pa.array(np.arange(len(got) + 1, dtype=np.int32) * len(model.languages))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, flat), pa.array([n for _, n in got], pa.int64())], names=["ll", "letters"])

    return F.arrow_udf(run, EVIDENCE).asNondeterministic()


def _best(scores: Column, n: int) -> Column:
    """Place of the first largest score, from 1."""
    return F.array_position(scores, F.array_max(scores)) if n else F.lit(0)


@dataclass
class Trust:
    """What the grouped counts say: tables by host and by suffix, and the trust in declarations."""

    hosts: DataFrame
    suffixes: DataFrame
    wrong: float


def _gather(evidence: DataFrame, languages: tuple[str, ...], scratch: Scratch) -> Trust:
    """Priors from rows of (host, site, suffix, declared, best): one grouped pass over all rows."""
    n = len(languages)
    counted = evidence.where("best > 0").groupBy("host", "site", "suffix", "declared", "best").agg(F.count("*").alias("n"))
    counted = scratch.write(counted, "verdicts")
    each = [F.sum(F.when(F.col("best") == i + 1, F.col("n")).otherwise(0)).cast("double") for i in range(n)]
    vector = F.array(*each).alias("c") if n else F.array().cast("array<double>").alias("c")
    total = counted.agg(vector).first()
    whole = [float(x) + 1.0 for x in (total["c"] if total and total["c"] and total["c"][0] is not None else [0.0] * n)]
    whole = [x / sum(whole) for x in whole]
    lean = lambda counts, parent: F.transform(
        F.arrays_zip(counts.alias("a"), parent.alias("b")), lambda z: (z["a"] + LEAN * z["b"]) / (F.aggregate(counts, F.lit(0.0), lambda x, y: x + y) + LEAN))
    root = F.array(*[F.lit(x) for x in whole]) if n else F.array().cast("array<double>")
    sites = counted.groupBy("site").agg(vector).select("site", lean(F.col("c"), root).alias("site_prior"))
    hosts = counted.groupBy("host", "site").agg(vector).join(sites, "site").select("host", lean(F.col("c"), F.col("site_prior")).alias("prior"))
    hosts = scratch.write(hosts.groupBy("host").agg(F.min("prior").alias("prior")), "hosts")
    # P(suffix | language), up to a factor that all languages share.
    share = F.transform(F.arrays_zip(F.col("c").alias("a"), root.alias("b")), lambda z: F.log((z["a"] + SEEN) / (z["b"] + 1e-9)))
    suffixes = scratch.write(counted.where(F.col("suffix") != "").groupBy("suffix").agg(vector).select("suffix", share.alias("suffix_ll")), "suffixes")
    names = F.array(*[F.lit(x) for x in languages]) if n else F.array().cast("array<string>")
    said = counted.where(F.array_contains(names, F.col("declared"))).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.array_position(names, F.col("declared")) != F.col("best"), F.col("n")).otherwise(0)).alias("wrong")).first()
    wrong = ((said["wrong"] or 0) + 1.0) / ((said["n"] or 0) + 4.0)
    return Trust(hosts, suffixes, min(0.5, wrong))


def _placed(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows with those of a written table of evidence, which is broadcast while its bytes are few.

    Beyond that both sides meet by key and salt, so that a host with a third of all rows is no single task.
    """
    value = next(c for c in table.columns if c != on)
    size = table.agg(F.sum(F.octet_length(on) + 8 * F.size(value) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, "left")
    p = free_prefix(rows)
    salted = table.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn(f"{p}salt", F.floor(F.rand(3) * SALT).cast("int")).join(salted, [on, f"{p}salt"], "left").drop(f"{p}salt")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: Column | None = None, model: TrigramModel | None = None, p: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns of docs, if None) and, behind the prefix ``p``, language, posterior, letters and kept.

    ``suffix`` is an expression of the address suffix; the site of a host is its last two
    labels. Evidence is computed in one scan and written with what is carried along, so that
    should be little: all that follows works on the written rows.
    """
    spark = docs.sparkSession
    p = free_prefix(docs) if p is None else p
    model = model or fit(docs, key, text, declared)
    n, scratch = len(model.languages), Scratch(spark)
    carried = list(carry if carry is not None else docs.columns)
    said = F.lower(F.col(declared)) if declared else F.lit(None).cast("string")
    name = F.coalesce(F.col(host), F.lit("")) if host else F.lit("")
    tail = F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit("")
    seen = text_evidence(model)(F.col(text).cast("binary"))
    have = scratch.write(docs.select(*carried, seen.alias(f"{p}e"), said.alias(f"{p}declared"), name.alias(f"{p}host"), tail.alias(f"{p}suffix")), "evidence")
    best = F.when(F.col(f"{p}e.letters") > 0, _best(F.col(f"{p}e.ll"), n)).otherwise(0)
    facts = have.select(F.col(f"{p}host").alias("host"), F.regexp_extract(f"{p}host", r"([^.]*\.?[^.]*)$", 1).alias("site"), F.col(f"{p}suffix").alias("suffix"), F.col(f"{p}declared").alias("declared"), best.cast("int").alias("best"))
    trust = _gather(facts, model.languages, scratch)
    out = _placed(have, trust.hosts.select(F.col("host").alias(f"{p}host"), F.col("prior").alias(f"{p}prior")), f"{p}host")
    if suffix is not None:
        out = _placed(out, trust.suffixes.select(F.col("suffix").alias(f"{p}suffix"), F.col("suffix_ll").alias(f"{p}sll")), f"{p}suffix")
    else:
        out = out.withColumn(f"{p}sll", F.lit(None).cast("array<double>"))
    agree, differ = float(np.log(1 - trust.wrong)), float(np.log(trust.wrong / max(1, n - 1)))
    known = F.col(f"{p}declared").isin(*model.languages) if n else F.lit(False)
    logs = [
        F.col(f"{p}e.ll")[i].cast("double")
        + F.coalesce(F.log(F.col(f"{p}prior")[i]), F.lit(0.0))
        + F.coalesce(F.col(f"{p}sll")[i], F.lit(0.0))
        + F.when(known, F.when(F.col(f"{p}declared") == lang, F.lit(agree)).otherwise(F.lit(differ))).otherwise(0.0)
        for i, lang in enumerate(model.languages)
    ]
    if n:
        out = out.withColumn(f"{p}logs", F.array(*logs)).withColumn(f"{p}top", F.array_max(f"{p}logs"))
        at = _best(F.col(f"{p}logs"), n).cast("int")
        out = out.withColumn(f"{p}language", F.element_at(F.array(*[F.lit(x) for x in model.languages]), at))
        sure = 1.0 / F.aggregate(f"{p}logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col(f"{p}top")))
        out = out.withColumn(f"{p}posterior", sure)
    else:
        out = out.withColumn(f"{p}language", F.lit(None).cast("string")).withColumn(f"{p}posterior", F.lit(0.0))
    out = out.withColumn(f"{p}letters", F.col(f"{p}e.letters"))
    out = out.withColumn(f"{p}kept", (F.col(f"{p}letters") > 0) & (F.col(f"{p}posterior") >= MIN_POSTERIOR))
    return out.select(*carried, *[f"{p}{c}" for c in ("language", "posterior", "letters", "kept")])


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known.

    Evidence is narrow rows under a 128-bit digest of what it is drawn from; texts stay where
    they are and lose those whose digest was rejected, of which few are broadcast.
    """
    p = free_prefix(docs)
    digest = F.struct(*[F.xxhash64(F.lit(i), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull(), F.coalesce(F.col("lang"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))).alias(f"h{i}") for i in (0, 1)])
    marked = docs.withColumn(f"{p}d", digest)
    gone = identify(marked, p=f"{p}_", carry=[f"{p}d"]).where(~F.col(f"{p}_kept")).select(f"{p}d").distinct()
    gone = Scratch(spark).write(gone, "rejected")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_BYTES // 64 else gone
    return marked.join(few, f"{p}d", "left_anti").select(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = identify(docs, p="_", carry=["doc_id", "lang"])
    return out.select("doc_id", F.col("lang").alias("declared"), F.col("_language").alias("language"), F.round("_posterior", 6).alias("posterior"), F.col("_letters").alias("letters"), F.col("_kept").alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over web pages: declared by the html tag, host and suffix from the address."""
    pages = read(spark, sf_dir, "pages")
    address = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)[^/?#]*/?([a-z]{2})?", 1)
    pages = pages.select(
        "page_id",
        F.col("html").alias("text"),
        F.nullif(F.regexp_extract("html", r'(?i)<html[^>]*\blang="?([a-z]+)', 1), F.lit("")).alias("declared"),
        F.lower(address).alias("host"),
        F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1).alias("path"),
    )
    tail = F.concat_ws("/", F.regexp_extract("host", r"\.([^.]+)$", 1), F.col("path"))
    # Markup is taken off by one pattern here; main texts are the work of the extraction operator.
    plain = F.regexp_replace("text", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    out = identify(pages.withColumn("text", plain), key="page_id", declared="declared", host="host", suffix=tail, p="_", carry=["page_id", "host", "declared"])
    return out.select("page_id", "host", "declared", F.col("_language").alias("language"), F.round("_posterior", 6).alias("posterior"), F.col("_kept").alias("kept"))
