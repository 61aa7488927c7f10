"""Sharding, language ID, near duplicates, pages, records and the pipeline: brute force and edge cases."""

from __future__ import annotations

import functools
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SMALL, TINY
from pyspark.sql import functions as F

import corpus_pipeline
from gablestone.llm import bpe, components, decontaminate, language_id, licenses, near_dups, quality_classifier, quality_rules, sharding, superminhash, warc, wrappers
from gablestone.llm.common import Scratch, read
from gablestone.llm.queries import ORACLE_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word", "en", "s", 4), (4, "word", "en", "s", 4), (None, "a b c a b c", "fr", None, 11), (7, "1234 $$$ ###", "xx", "s", 3)]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("mine")).withColumn("_id", F.lit(1)).withColumn("_e", F.lit(2)).withColumn("shard", F.lit("s")).withColumn("component", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- sharding -----------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    got = sharding.op5_sharding(spark, SMALL).toPandas()
    docs = read(spark, SMALL, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    per = got.groupby("shard").size()
    assert len(per) == 16 and per.max() - per.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # Groups that are kept together move a few rows; without groups no shard is off by two.
    off = lambda t: (m := t.groupby(["source", "shard"]).size().unstack(fill_value=0)).sub(m.sum(axis=1) / 16, axis=0).abs()
    assert off(got).mean().mean() < 0.6 and off(got).max().max() <= 3
    alone = sharding.interleave(read(spark, SMALL, "documents").select("doc_id", "source"), "source", [F.col("doc_id")]).toPandas()
    assert off(alone).max().max() < 2
    text = docs.set_index("doc_id").text
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples())


def test_sharding_edges(spark):
    rows = odd(spark).drop("shard")
    for bins in (1, 2, 4000):
        out = sharding.interleave(rows, "source", [F.col("doc_id"), F.col("text")], shards=3, bin_rows=bins).toPandas()
        assert sorted(out.groupby("shard").size()) == [2, 2, 3] and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sharding.interleave(empty(spark), "source", [F.col("doc_id")]).count() == 0
    few = sharding.interleave(rows.limit(2), "source", [F.col("doc_id")], shards=16).toPandas()
    assert len(few) == 2 and set(few.slot) == {0}


def test_groups_stay_together_but_at_cuts(spark):
    got = sharding.op5_sharding(spark, SMALL).toPandas()
    shards = got.groupby(["text_crc32", "size"]).shard.agg(["count", "min", "max"])
    several = shards[shards["count"] > 1]
    # A group is in one shard, or on both sides of one of the 15 cuts.
    assert len(several) > 50 and (several["max"] - several["min"]).max() <= 1 and (several["max"] > several["min"]).sum() <= 15


def test_a_heavy_group_is_cut_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVY", 2)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"))
    out = sharding.interleave(rows, "source", [F.col("doc_id")], shards=10, bin_rows=50, group=F.col("g"))
    got = out.toPandas()
    assert set(got.groupby("shard").size()) == {300} and all(sorted(g.slot) == list(range(300)) for _, g in got.groupby("shard"))
    shards = sorted(set(got[got.g == 0].shard))
    assert shards == list(range(shards[0], shards[-1] + 1)) and len(shards) <= 5 and got.doc_id.is_unique


def test_bins_have_no_effect(spark):
    docs = read(spark, TINY, "documents").select("doc_id", "source")
    a, b = ({tuple(r) for r in sharding.interleave(docs, "source", [F.col("doc_id")], bin_rows=n).collect()} for n in (7, 10_000))
    assert {x[0] for x in a} == {x[0] for x in b} and Counter(x[2] for x in a) == Counter(x[2] for x in b)


# --- language ID ----------------------------------------------------------------------


def test_languages(spark):
    q = language_id.op8_language_id(spark, SMALL)
    r = q.agg(F.avg((F.col("language") == F.col("declared")).cast("int")).alias("right"), F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert r.right > 0.98 and r.kept > 0.99
    p = language_id.language_id_pages(spark, SMALL)
    assert p.where("language = declared").count() > 0.98 * p.count()


def test_host_priors_decide_without_text(spark):
    rows = [(i, "the house and the garden of the king " * 3, "en", "a.example.org") for i in range(40)] + [(100 + i, "das Haus und der Garten des Königs " * 3, "de", "b.example.net") for i in range(40)]
    rows += [(900, "12 34", None, "a.example.org"), (901, "12 34", None, "b.example.net"), (902, "12", "de", "new.example.net"), (903, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r._language, r._kept) for r in language_id.identify(df, p="_").collect()}
    assert got[900] == ("en", False) and got[901] == ("de", False) and got[902] == ("de", False) and got[903][1] is False
    assert got[0] == ("en", True) and got[100] == ("de", True)


def test_rare_languages_are_known_in_large_tables(spark):
    rows = [(i, "the house and the garden of the king", "en") for i in range(3000)] + [(5000 + i, "das Haus und der Garten des Königs", "de-1996-long-tag") for i in range(8)]
    rows += [(6000 + i, "la maison et le jardin du roi", "fr") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, "doc_id", "text", "lang", max_rows=20)
    assert model.languages == ("de-1996-long-tag", "en")
    got = language_id.identify(df, host=None, model=model, p="_").where("doc_id between 5000 and 5999").select("_language", "_kept").distinct().collect()
    assert [tuple(r) for r in got] == [("de-1996-long-tag", True)]


def plain_fusion(model, rows):
    """(language, posterior, kept) of (text, declared, host, suffix) rows, by loops over all of them."""
    names, n = model.languages, len(model.languages)
    seen = [model.evidence((t or "").encode()) for t, *_ in rows]
    site = lambda h: re.search(r"([^.]*\.?[^.]*)$", h)[1]
    best = [int(np.argmax(ll)) if letters else None for ll, letters in seen]
    count = lambda where: np.array([sum(b == i and where(r) for b, r in zip(best, rows)) for i in range(n)], float)
    whole = (count(lambda r: True) + 1) / (count(lambda r: True) + 1).sum()
    lean = lambda c, up: (c + language_id.LEAN * up) / (c.sum() + language_id.LEAN)
    told = [(names.index(r[1].lower()), b) for r, b in zip(rows, best) if b is not None and r[1] and r[1].lower() in names]
    wrong = min(0.5, (sum(a != b for a, b in told) + 1) / (len(told) + 4))
    out = []
    for (ll, letters), (_, declared, host, suffix) in zip(seen, rows):
        logs = ll.astype(float)
        host = host or ""
        mine = count(lambda r: (r[2] or "") == host)
        if mine.sum():
            logs = logs + np.log(lean(mine, lean(count(lambda r: site(r[2] or "") == site(host)), whole)))
        if suffix and (c := count(lambda r: r[3] == suffix)).sum():
            logs = logs + np.log((c + language_id.SEEN) / (whole + 1e-9))
        if declared and declared.lower() in names:
            logs = logs + np.where(np.arange(n) == names.index(declared.lower()), np.log(1 - wrong), np.log(wrong / max(1, n - 1)))
        sure = 1 / np.exp(logs - logs.max()).sum()
        out.append((names[int(np.argmax(logs))], sure, bool(letters and sure >= language_id.MIN_POSTERIOR)))
    return out


@pytest.mark.parametrize("size", [1 << 20, -1])
def test_fusion_equals_plain_loops(spark, monkeypatch, size):
    monkeypatch.setattr(language_id, "BROADCAST_BYTES", size)
    docs = [(r.doc_id, r.text, r.lang) for r in read(spark, TINY, "documents").collect()]
    model = language_id.fit(read(spark, TINY, "documents"), "doc_id", "text", "lang")
    rng = random.Random(1)
    hosts = ["a.example.org", "b.example.org", "c.example.net", None]
    rows = [(i, rng.choice([t, t[:9], "12 3", None]), rng.choice([lang, "en", None, "xx"]), rng.choice(hosts), rng.choice(["org", "fr", None])) for i, t, lang in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tld string")
    got = sorted(language_id.identify(df, model=model, suffix=F.col("tld"), p="_", carry=["doc_id"]).collect())
    for (i, *_), r, (name, sure, kept) in zip(rows, got, plain_fusion(model, [x[1:] for x in rows])):
        assert (r.doc_id, r._language, r._kept) == (i, name, kept) and r._posterior == pytest.approx(sure, rel=1e-4), rows[i]


def test_language_edges(spark):
    model = language_id.fit(read(spark, TINY, "documents"), "doc_id", "text", "lang")
    out = language_id.identify(odd(spark), model=model)
    assert out.count() == len(ODD) and set(odd(spark).columns) < set(out.columns)
    kept = language_id.keep_identified(spark, odd(spark), TINY)
    assert kept.columns == odd(spark).columns
    assert language_id.keep_identified(spark, empty(spark), TINY).count() == 0
    assert language_id.identify(empty(spark), model=model).count() == 0
    long = language_id.trigrams(b"abc " * 200_000)
    assert len(long) == 800_000 - 1 and model.evidence(b"abc " * 200_000)[1] == 600_000


# --- near duplicates --------------------------------------------------------------------


def brute_components(docs, size, threshold=80):
    sh = lambda t: [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if (w := (t or "").encode().lower().split()) else []
    sets = [(i, set(sh(t))) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def family(rng, words, changes, n):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [t for c in (1, 2, 3, 4, 6, 9) for t in family(rng, 200, c, 12)] + [t for t in family(rng, 12, 1, 30)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 40))) for _ in range(80)]
    texts += ["same text here now"] * 7 + ["Same  TEXT here\nnow"] + ["one two"] * 2 + ["one"] + [None, "", "  ", None]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [docs[5], (None, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_dups.NearDuplicates(df, size=4).result()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_components(docs, 4), key=str)


def test_repeated_rows_lose_no_links(spark):
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 40))) for _ in range(60)]
    # Pairs that are just alike enough, in buckets that a shorter text between them ties.
    docs = [(i, t) for i, t in enumerate(texts)] * 4 + [(i, t) for i in (3, 9) for t in (texts[i + 30], "", None)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = near_dups.NearDuplicates(df, size=4)
    assert sorted(map(tuple, found.result().collect()), key=str) == sorted(brute_components(docs, 4), key=str)


def test_prefixes_count_distinct_shingles(spark):
    """Two sets of 100 that share 89 (0.8 of 111), whose first shared shingle comes late in one, three rows each."""
    U = np.uint64
    both, x, y = np.arange(1000, 1089, dtype=U), np.arange(11, dtype=U), np.arange(5000, 5011, dtype=U)
    rows = [(i, np.sort(np.concatenate([s, both])).tobytes()) for i, s in ((1, x), (2, y))] * 3
    found = near_dups.NearDuplicates.__new__(near_dups.NearDuplicates)
    found.size, found.threshold, found.scratch = 4, 80, Scratch(spark)
    sets = spark.createDataFrame([(i, bytearray(s), near_dups.parity(np.frombuffer(s, U)).tolist()) for i, s in rows], "id long, set binary, bits array<long>")
    found.sets = found.distinct_sets(sets)
    rest = spark.createDataFrame([(1, 100, 1), (2, 100, 2)], "id long, n long, component long")
    assert [tuple(r) for r in found.by_rare_shingles(rest).collect()] == [(1, 2)]


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    texts = [t for t in family(rng, 100, 1, 5)] + [f"alone {k} " + " ".join(f"a{k}b{j}" for j in range(20)) for k in range(4)]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs + [docs[7], docs[7], docs[0]] + ODD[:3] + [ODD[5]], DOCS).withColumn("_id", F.lit("x")).withColumn("component", F.lit(1))
    kept = near_dups.keep_one_of_each(spark, df, TINY)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    want = {min(i for i, *_ in docs[:5])} | {5, 6, 7, 8, None}
    assert set(ids) - {1, 2, 3} == want and ids.count(7) == 1 and ids.count(0) == 1
    assert near_dups.keep_one_of_each(spark, empty(spark), TINY).count() == 0
    assert near_dups.NearDuplicates(odd(spark)).result().count() == len(ODD)


def test_query_has_every_document(spark):
    got = near_dups.op9_near_duplicates(spark, TINY).collect()
    docs = [(r.doc_id, r.text) for r in read(spark, TINY, "documents").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, n, c, i == c) for i, n, c in brute_components(docs, 4))


def test_signatures_estimate_with_less_variance():
    rng = np.random.default_rng(1)
    est = []
    for _ in range(300):
        a = rng.integers(0, 2**63, 120).astype(np.uint64)
        b = np.concatenate([a[:90], rng.integers(0, 2**63, 30).astype(np.uint64)])
        s = superminhash.signatures(np.concatenate([a, b]), np.array([120, 120]), 160)
        est.append((s[0] == s[1]).mean())
    j = 90 / 150
    assert abs(np.mean(est) - j) < 0.01 and np.var(est) < j * (1 - j) / 160


def test_signatures_of_a_set_do_not_depend_on_its_batch():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 0, 50, 4000, 160)]
    together = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 160)
    for s, row in zip(sets, together):
        assert (superminhash.signatures(s, np.array([len(s)]), 160)[0] == row).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2001, 2002), (2002, 2003), (2003, 2001), (5, 5)]
    rng.shuffle(links)
    df = spark.createDataFrame([(max(x), min(x)) if rng.random() < 0.5 else (min(x), max(x)) for x in links], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(df, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(300)}, 2001: 2001, 2002: 2001, 2003: 2001}


# --- pages --------------------------------------------------------------------------------


def page(k, extra=""):
    return f"""<html><head><title>T{k}</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="page"><article><h1>Head &amp; line {k}</h1><p>First <b>bo</b>ld {k}.<br>next<p>Second&nbsp;{k}</p>{extra}<div class="comments"><p>reader {k}</p></div></article>
    <aside>side</aside></div><form><input> search</form><footer>end</footer>"""


def test_wrappers_find_the_article(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", page(k, f"<ul><li>x{k}<li>y{k}</ul>" if k % 3 else f"<table><tr><td>c{k}<td>d{k}</table>")) for k in range(20)]
    rows += [(100, "http://h0.example/x", None), (101, None, "<p>plain</p> tail"), (102, "http://h1.example/odd", "<div>no article <p>here"), (103, "", ""), (0, "http://h0.example/0", page(0, "<table><tr><td>c0<td>d0</table>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("_host", F.lit(1)).repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract(df, out="main").withColumnRenamed("text", "was").withColumnRenamed("main", "text").collect()}
    for k in range(20):
        assert got[k] == f"Head & line {k} First bold {k}. next Second {k} " + (f"x{k} y{k}" if k % 3 else f"c{k} d{k}")
    assert got[100] == "" and got[101] == "plain tail" and got[102] == "no article here" and got[103] == ""
    assert wrappers.extract(df.limit(0)).count() == 0


def inferred(pages, evidence=wrappers.EVIDENCE, share=wrappers.SHARE):
    """Template and wrapper of one host, counted and aligned in plain Python."""
    counts = {}
    for x in pages:
        wrappers.count_page(x, counts, "h")
    texts = [k[3] for k, v in counts.items() if k[1] == wrappers.TEXT and v[0] >= evidence and v[0] >= share * counts["h", wrappers.PATH, k[2], 0][0]]
    columns = [k[3] for k, v in counts.items() if k[1] == wrappers.BROTHERS and v[0] >= evidence and v[1] == v[2] > 1 and v[0] == counts["h", wrappers.PARENT, k[2], 0][0]]
    template, wrapper = wrappers.Template(json.dumps({"t": texts, "c": columns})), wrappers.Wrapper()
    for x in pages:
        wrapper.add_page(x, template)
    return template, wrapper


def judge_of(pages):
    template, wrapper = inferred(pages)
    return wrappers.Judge(json.dumps(wrappers.judged(wrapper, template)))


def test_alignment_makes_groups_and_slots():
    show = lambda *pages: inferred(pages)[1].expression()
    assert show("<div><h1>A</h1><p>x</p></div>", "<div><h1>A</h1><p>y</p><p>z</p><hr><ul><li>q</ul></div>") == "<div><h1>#</h1>(<p>#</p>)+(<ul><li>#</li></ul>)?</div>"
    items = "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"
    assert show(items) == show(items, items) == show(items, "<dl><dt>a<dd>x</dl>") == show("<dl><dt>a<dd>x</dl>", items) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    # What changes its order, or recurs with something else between, is a repeated group of optional tokens.
    assert show("<h2>a</h2><p>b</p>", "<p>c</p><h2>d</h2>") == "((<h2>#</h2>)?(<p>#</p>)?)+"
    assert show("<p>a</p><ul><li>b</ul><p>c</p><h2>d</h2>") == "((<p>#</p>)?(<ul><li>#</li></ul>)?)+<h2>#</h2>"
    fixed = [f"<body><div>Call us</div><div>{k} text</div><p>End</p></body>" for k in range(6)]
    assert show(*fixed) == "<body><div/1>'const'</div><div/2>#</div><p>'const'</p></body>"


def accepts(level, tokens):
    """Whether an expression's level covers a row of tokens, by the pattern that it stands for."""
    letter = {t: chr(0xE000 + i) for i, t in enumerate(sorted({t for g in level for t, _ in g[2]} | set(tokens)))}
    sign = {(0, 0): "", (0, 1): "?", (1, 0): "+", (1, 1): "*"}
    pattern = "".join("(?:" + "".join(letter[t] + ("?" if o else "") for t, o in g[2]) + ")" + sign[int(g[0]), int(g[1])] for g in level)
    return re.fullmatch(pattern, "".join(letter[t] for t in tokens)) is not None


def test_levels_cover_what_was_aligned():
    rng = random.Random(12)
    for _ in range(400):
        rows = [[rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 6))]
        level = wrappers.fold(rows[0])
        for r in rows[1:]:
            level = wrappers.align(level, wrappers.fold(r))
        halves = wrappers.align(*[functools.reduce(wrappers.align, map(wrappers.fold, part)) for part in (rows[::2], rows[1::2] or rows[:1])])
        for made in (level, halves):
            assert len({t for g in made for t, _ in g[2]}) == sum(len(g[2]) for g in made)
            assert all(accepts(made, r) for r in rows), (rows, made)


def shuffled_host(rng, kind):
    """Pages of one host and the article of each; the host's frame is drawn once."""
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    top, end, notice = word(4), word(5), word(9)
    open_, close = {"article": ("<article>", "</article>"), "plain": ("<div>", "</div>"), "misleading": ('<div class="content share-enabled">', "</div>"), "table": ("<table><tr><td>", "</td></tr></table>")}[kind]
    pages, want = [], []
    for k in range(30):
        lead, body = word(8), [word(rng.randint(20, 60)) for _ in range(rng.randint(1, 5))]
        tag = '<p class="teaser">' if kind == "misleading" else "<p>"
        article = f"<h1>{lead[:17]}</h1>{tag}{lead}</p>" + "".join(f"<p>{b}</p>" for b in body) + ("<ul><li>one<li>" + lead[:5] + "</ul>" if k % 3 == 0 and kind == "plain" else "")
        links = "".join(f'<a href="/{k}">{word(2)}</a> ' for _ in range(4))
        pages.append(f'<html><body><div>{top}</div><div class="nav"><ul><li><a href=x>{word(1)}</a></ul></div><div>{links}</div>{open_}{article}<p>{notice}</p>{close}<div><p>{end}</p></div><div class="comments"><p>{word(6)}</p></div></body></html>')
        want.append(" ".join([lead[:17], lead, *body, *(["one", lead[:5]] if "<ul><li>one" in article else [])]))
    return pages, want, (top, end, notice)


@pytest.mark.parametrize("kind", ["article", "plain", "misleading", "table"])
def test_the_wrapper_decides(kind):
    """Hosts without marks, with unmarked constants and with misleading words; without the wrapper constants stay."""
    rng = random.Random(kind)
    for _ in range(4):
        pages, want, fixed = shuffled_host(rng, kind)
        judge = judge_of(pages)
        got = [wrappers.main_text(x, judge) for x in pages]
        if kind == "plain":  # "one" stands on all pages with a list
            want = [w.replace(" one ", " ") for w in want]
        assert got == want
        bare = [wrappers.main_text(x, None) for x in pages]
        assert all(fixed[2] in b for b in bare) and bare != got


def test_copies_keep_their_text():
    same = [f"<body><p>{k}</p><article><h1>Head</h1><p>All pages say the same, word by word.</p></article></body>" for k in range(9)]
    assert {wrappers.main_text(x, judge_of(same)) for x in same} == {"Head All pages say the same, word by word."}
    whole = ["<body><nav>n</nav><article><p>Just the same.</p></article></body>"] * 9
    assert wrappers.main_text(whole[0], judge_of(whole)) == "Just the same."


def test_merged_wrappers_judge_alike(spark, monkeypatch):
    """However pages are dealt and tables are joined, the text is the same as in plain Python."""
    rng = random.Random(5)
    hosts = {f"h{k}.example": shuffled_host(rng, kind) for k, kind in enumerate(("article", "plain", "table", "misleading"))}
    rows = [(f"http://{h}/{i}", p) for h, (pages, _, _) in hosts.items() for i, p in enumerate(pages)]
    want = {f"http://{h}/{i}": wrappers.main_text(p, judge_of(pages)) for h, (pages, _, _) in hosts.items() for i, p in enumerate(pages)}
    df = spark.createDataFrame(rows, "url string, html string")
    for n, size, entries in ((1, 1 << 20, 10**6), (7, 0, 10**6), (5, -1, 20)):
        monkeypatch.setattr(wrappers, "BROADCAST_BYTES", size)
        monkeypatch.setattr(wrappers, "ENTRIES", entries)
        assert {r.url: r.text for r in wrappers.extract(df.repartition(n)).collect()} == want


def test_deep_and_broken_pages():
    deep = "<div>" * 3000 + "text" + "</div>" * 2000 + "<p>more</b></i></table> and <b>some"
    assert wrappers.main_text(deep, judge_of([deep])) == "text more and some"
    wide = "".join(f"<p>{k}</p><h2>{k}</h2>" for k in range(20_000))
    assert wrappers.main_text(wide, judge_of([wide])) == " ".join(f"{k} {k}" for k in range(20_000))
    assert wrappers.main_text("<article>a<!-- <p>no</p> --> b &lt;c&gt; &#233;<script>x()", None) == "a b <c> é"


def test_main_text_of_the_supplied_pages(spark):
    got = {r.page_id: r for r in wrappers.op4_html_extraction(spark, TINY).collect()}
    import html
    import re

    for r in read(spark, TINY, "pages").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


# --- records ------------------------------------------------------------------------------


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{TINY}/pages.parquet'")
    cur = con.execute(ORACLE_SQL["op7_warc_audit"])
    cols = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in warc.op7_warc_audit(spark, TINY).collect())
    assert got == want and {"changed", "missing", "ok"} == {r[cols.index("status")] for r in got}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    rows, at = [], {}
    for k in range(3000):
        f = rng.choice([1, 2, 3])
        n = rng.choice([300, 5000, 90_000])
        rows.append((f, at.get(f, 0), n, hashlib.sha256(str(k).encode()).hexdigest()))
        at[f] = at.get(f, 0) + n
    other = list(rows)
    other[7] = (*other[7][:3], "flipped")
    other[1500] = (*other[1500][:3], "flipped")
    gone = other.pop(2000)
    other.append((9, 0, 5, "extra file"))
    kind = "file long, offset long, length long, hash string"
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    got = {(r.file, r.offset, r.status) for r in warc.audit(a, b).collect()}
    assert got == {(*rows[7][:2], "changed"), (*rows[1500][:2], "changed"), (*gone[:2], "missing"), (9, 0, "extra")}
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0
    odd_ = spark.createDataFrame([(None, None, 1, None), (1, 5, 2, "x"), (1, 5, 2, "x")], kind)
    assert warc.audit(odd_, odd_).count() == 0 and warc.audit(odd_, odd_.limit(0)).count() == 3


def test_rows_without_a_place_are_spread(spark):
    rows = [(None, None, f"h{k}") for k in range(200)] + [(None, 7, f"g{k}") for k in range(50)] + [(3, None, "x")] * 4
    kind = "file long, offset long, hash string"
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(rows[5:248] + rows[251:], kind)
    sizes = [r.n for r in warc.leaves(a).groupBy("file", F.shiftright("place", warc.LEAF_BITS)).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 and len(sizes) > 240
    got = Counter((r.file, r.offset, r.left_hash, r.status) for r in warc.audit(a, b).collect())
    assert got == Counter([(-1, -1, f"h{k}", "missing") for k in range(5)] + [(-1, 7, f"g{k}", "missing") for k in (48, 49)] + [(3, -1, "x", "missing")])


def test_records_round_trip(spark, tmp_path):
    pages = [("http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), ("http://a/2", ""), (None, None), ("http://a/3", "x" * 100_000), ("http://a/3", "x" * 100_000)]
    df = spark.createDataFrame(pages, "url string, html string").select(warc.record(F.lit("response"), F.col("url"), F.col("html"), F.lit("2024-05-06T07:08:09Z")).alias("r"))
    raw = [r.r.encode() for r in df.collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        got = warc.read_warc(spark, str(tmp_path / name)).orderBy("offset").collect()
        assert [(r.uri, bytes(r.body).decode()) for r in got] == [(u or "", h or "") for u, h in pages]
        assert [r.length for r in got] == list(map(len, raw)) and [r.offset for r in got] == [sum(map(len, raw[:i])) for i in range(len(raw))]
        assert [r.sha256 for r in got] == [hashlib.sha256(x).hexdigest() for x in raw] and not any(r.fault for r in got)
    for how in ("gzip", "none"):
        warc.write_warc(df.repartition(2), str(tmp_path / how), how)
        got = warc.read_warc(spark, str(tmp_path / how)).collect()
        assert sorted(r.sha256 for r in got) == sorted(hashlib.sha256(x).hexdigest() for x in raw) and len({r.file for r in got}) == 2
    heads = raw[0].split(b"\r\n\r\n")[0].decode().split("\r\n")
    assert heads[0] == "WARC/1.1" and {h.split(":")[0] for h in heads[1:]} == {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"}


def test_broken_files_are_findings(spark, tmp_path, monkeypatch):
    made = lambda k, body: f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    r = [made(k, bytes([65 + k]) * 50) for k in range(6)]
    faults = lambda data: [(length, fault) for _, length, _, _, _, fault in warc.records_of(data)]
    n = len(r[0])
    for chunk in (7, 64, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert faults(b"") == [] and faults(b"\r\n") == []
        assert faults(b"just garbage, no record at all") == [(30, "no record")]
        assert faults(r[0] + b"junk between\n" + r[1]) == [(n, None), (13, "no record"), (n, None)]
        bad = r[1].replace(b"Content-Length: 50", b"Content-Length: 5x")
        assert faults(r[0] + bad + r[2]) == [(n, None), (n, "bad length"), (n, None)]
        low = r[1].replace(b"Content-Length: 50", b"Content-Length: 20")
        assert [f for _, f in faults(r[0] + low + r[2])] == [None, "bad length", "no record", None]
        assert faults(r[0] + r[1][:-30]) == [(n, None), (n - 30, "cut short")]
        assert faults(r[0] + r[1][:20]) == [(n, None), (20, "cut short")]
        z = [gzip.compress(x, mtime=0) for x in r]
        assert faults(b"".join(z)) == [(n, None)] * 6
        hurt = z[2][:30] + bytes([z[2][30] ^ 255]) + z[2][31:]
        got = faults(b"".join([*z[:2], hurt, *z[3:]]))
        assert [x for x in got if not x[1]][:2] == [(n, None)] * 2 and got[-3:] == [(n, None)] * 3 and any(f == "broken member" for _, f in got)
        assert faults(z[0] + z[1][:-12])[0] == (n, None) and faults(z[0] + z[1][:-12])[-1][1] == "broken member"
    (tmp_path / "bad").write_bytes(b"nothing")
    (tmp_path / "ok").write_bytes(r[0])
    got = {(x.length, x.fault) for x in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {(7, "no record"), (n, None)}


# --- very long texts ------------------------------------------------------------------------


def test_the_end_of_a_very_long_text_counts(spark):
    """Five million characters: what stands at the very end is found, counted and encoded."""
    rng = random.Random(9)
    body = " ".join(f"word{rng.randrange(10**6)} and" for _ in range(350_000))
    end = " one two three four five six seven eight nine ten. Released under the MIT License."
    rows = [(1, body + end, "en", "s"), (2, body + end, "en", "s"), (3, body, "en", "s"), (4, "short text", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("mine")).withColumn("licenses", F.lit(1)).withColumn("hits", F.lit(2)).withColumn("tokens", F.lit(3))
    found = {r.doc_id: [x.license for x in r.found] for r in licenses.scan(df, out="found").collect()}
    assert found == {1: ["MIT"], 2: ["MIT"], 3: [], 4: []}
    bench = spark.createDataFrame([("a", "five six seven eight nine ten released under the mit")], "item_id string, text string")
    for block in (10, 0):
        got = {r.doc_id: (r.h.n_words, r.h.starts) for r in decontaminate.find(df, bench, out="h", block_windows=block).collect()}
        assert got == {1: (700_015, [700_004]), 2: (700_015, [700_004]), 3: (700_000, []), 4: (2, [])}
    same = {r.id: r.component for r in near_dups.NearDuplicates(df).result().collect()}
    assert same == {1: 1, 2: 1, 3: 1, 4: 4}
    stats = {r.doc_id: r.n for r in quality_rules.judge(df, quality_rules.DecisionList([])).select("doc_id", F.col("_stats.n_words").alias("n")).collect()}
    assert stats == {1: 700_015, 2: 700_015, 3: 700_000, 4: 2}
    coded = bpe.tokenise(df, out="t").select("doc_id", "text", bpe.decoder(bpe.default_vocabulary())("t.ids").alias("back")).collect()
    assert all(r.text == r.back for r in coded)
    model = language_id.fit(read(spark, TINY, "documents"), "doc_id", "text", "lang")
    assert {r.doc_id: r._letters for r in language_id.identify(df, model=model, p="_", carry=["doc_id"]).collect()} == {i: sum(c.isalpha() for c in t) for i, t, *_ in rows}
    scored = quality_classifier.classify(df, read(spark, TINY, "labels")).collect()
    assert len(scored) == 4 and scored[0].score == scored[1].score
    placed = sharding.interleave(df.select("doc_id", "source", F.length("text").alias("size")), "source", [F.col("doc_id")], shards=2)
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [2, 2]


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "bpe"]
    docs = read(spark, TINY, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark).write(stage(spark, docs, TINY), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    out = corpus_pipeline.run(spark, TINY)
    assert out.count() == n and {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out.collect())
    kept = brute_components([(i, t) for i, t in texts.items()], 5)
    assert all(i == c for i, _, c in kept)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    for df in (odd(spark), empty(spark)):
        out = stage(spark, df, TINY)
        assert out.count() <= df.count()
        assert k == 4 or out.columns == df.columns
