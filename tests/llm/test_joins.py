"""SimHash, line dedup, URL filter, WARC and the pipeline against plain Python."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from simplexflow.llm import decontaminate, lines, quality, simhash, urls, warc
from simplexflow.llm.components import _stars, components
from simplexflow.llm.tables import row_key, shared_folder

from .conftest import frame
from .test_text_ops import check_packing


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    want = Union({n for e in edges for n in e})
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[n] == want.root(n) for e in edges if e[0] != e[1] for n in e)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def slow_classes(texts, size, radius):
    prints = {i: int(simhash.fingerprint(t, size)[0][0]) for i, t in texts}
    want = Union(prints)
    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                want.join(a, b)
    return prints, {i: want.root(i) for i in ids}


def test_simhash_equals_all_pairs(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    base = texts[0][1].split()[:60]
    texts += [(10_000 + i, " ".join(base[:20 + i % 3] + base[20 + i % 7:])) for i in range(60)] + [(20_000, None), (20_001, ""), (20_002, " \n")]
    prints, want = slow_classes(texts, 3, 2)
    for tile in (4096, 16):
        rows = simhash.classes(frame(spark, texts), tile=tile).collect()
        assert {r.id: r.component_id for r in rows} == want and len(rows) == len(texts)
        assert all(r.fp[0] & (1 << 64) - 1 == prints[r.id] for r in rows)


def test_fingerprint_by_definition():
    import xxhash

    text = "The  cat\x0bsat ON the mat, the cat sat"
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert int(simhash.fingerprint(text, 3)[0][0]) == want and simhash.fingerprint("Ab c", 3)[1] == 1


def test_simhash_odd_rows(spark, odd, none):
    rows = {(r.id, r.component_id) for r in simhash.classes(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (None, 1)} <= rows and {(4, 4), (6, 6), (None, 4)} <= rows
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(ids) == len(set(ids)) == 8 and {6, 7, 10} <= {i for i, _ in ids}
    assert simhash.classes(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_catches_near_copies_and_spares_others(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [(i, " ".join(word() for _ in range(400))) for i in range(40)]
    near = []
    for i, t in texts[:20]:
        w = t.split()
        w[rng.randrange(400)] = word()
        w[rng.randrange(400)] = word().upper() + "."
        near.append((100 + i, " ".join(w)))
    for tile in (4096, 16):
        assert {r.doc_id for r in simhash.keep_one(frame(spark, near + texts), tile=tile).collect()} == set(range(40))


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def slow_lines(rows, min_words=3):
    """Dropped (place, text hash order, line) by comparing all lines with all."""
    found = []
    for place, text in rows:
        for n, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if line and len(re.split("[ \t\x0b\x0c\r]+", line)) >= min_words:
                found.append(((place, n), line))
    first = {}
    for at, line in sorted(found):
        first.setdefault(line, at)
    near = {x for x in first for y in first if x != y and first[y] < first[x] and within_one(x, y)}
    return {at for at, line in found if line in near or first[line] != at}


def cleaned(rows, gone):
    return {p: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (p, n) not in gone) for p, t in rows}


def test_lines_equal_all_pairs(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(8, 14))) for _ in range(60)]
    pool += ["aa bb cc dd", "aa bb cc d", "aa bb ccc dd", "ab bb cc dd", "aaa bb cc dd", "  aa bb cc dd\t", "x"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == cleaned(rows, slow_lines(rows))


def test_deletion_keys():
    a, b, c = (lines.deletion_keys(x) for x in ("abcd", "abd", "abxd"))
    whole = lambda k: set(k[0][k[1] == 0].tolist())
    short = lambda k: set(k[0][k[1] == 1].tolist())
    placed = lambda k: set(k[0][k[1] == 2].tolist())
    assert whole(b) <= short(a) and whole(b) <= short(c) and len(placed(a) & placed(c)) == 1 and not placed(a) & placed(b)
    assert len(short(lines.deletion_keys("aaaa"))) == 1


def test_lines_odd_rows(spark, odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    line = "The same line stands in many of these documents."
    assert line in texts[None] and texts[4] == ["", ""] and texts[5] == [""] and texts[1] == [None] and texts[9] == ["Of\nOf\nOf"]
    assert texts[8] == ["And the other line of it is here for once only."]
    assert lines.dedup_lines(none).count() == 0


def test_url_parts_and_rules(spark):
    cases = ["HTTP://A.Example.NET/en/x?y#z", "http://example.net/en/", "http://example.net/de", "net://net", "http://net/", "http://xexample.net/en/",
             "https://b.example.com/de/1", "https://b.example.com/fr/1", "http://w.org/fr/", "http://w.org/FR/", "http://h?x=/y", "http://h#/y", "no scheme",
             "a://b://c/d", "", None, "http://ÀB.org/fr/é", "http://example.net:80/en/"]
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judged(rows).collect()}
    for i, url in enumerate(cases):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, None))
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))
    assert urls.judged(rows.limit(0)).count() == 0
    assert {r.verdict for r in urls.judged(rows, rules=(("zz", "/", "block"),), labelled=urls.labelled_urls(spark).limit(0)).collect()} == {"allow"}


def test_url_model_held_out(spark):
    labelled = urls.labelled_urls(spark)
    assert 300 < labelled.count() < 5000
    name = F.regexp_extract("host", r"([^.]+)\.example", 1)
    seen = labelled.where(F.crc32(name.cast("binary")) % 4 != 0)
    rest = labelled.where(F.crc32(name.cast("binary")) % 4 == 0).select(F.concat(F.lit("http://"), "host", "path").alias("url"), F.col("verdict").alias("want"))
    told = urls.judged(rest, rules=(("zz", "/", "block"),), labelled=seen)
    assert told.select(F.avg((F.col("verdict") == F.col("want")).cast("double"))).first()[0] > 0.9


def test_url_plan_is_native(spark):
    plan = urls.judged(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_round_trip(spark):
    inner = "x" * 200 + warc.MARK + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + warc.MARK + "foo\r\n\r\nbar"
    pages = [(1, "u", inner), (2, None, inner), (3, "v", None), (4, "v", warc.MARK), (5, "a\r\nb", warc.MARK + "Content-Length: 99999999\r\n\r\n" + "z" * 150),
             (6, "q", "é" * 60), (7, "q", "é" * 60), (8, "q", "é" * 49), (9, "q", "é" * 49), (10, "q", "\r\n\r\n" * 40), (None, "n", "m" * 120), (11, "n", "m" * 120)]
    pages += [(100 + i, f"http://h/{i}", "<p>" + "y" * (37 * i % 900) + warc.MARK * (i % 3) + "</p>") for i in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        folder = shared_folder(spark, "warc")
        warc.write(spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, payload int").repartition(2), folder)
        records = warc.read(spark, folder, region=2000)
        texts = {r.page_id: r for r in records.collect()}
        rows = {r.page_id: r for r in warc.resolved(records).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(texts) == len(rows) == len(pages)
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in pages:
        payload = (html or "").encode()
        again = len(payload) >= 100 and i != first[html or ""]
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if again else ("response", None))
        assert bytes(texts[i].payload) == (b"" if again else payload)
    empty = shared_folder(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.resolved(warc.read(spark, empty)).count() == 0


def slow_groups(rows):
    """Groups of exact Jaccard similarity 0.8 over bare five-word shingles; rows without words are one group."""
    sets = {i: set(simhash.shingles(t, 5, True)) for i, t in rows}
    want, holders = Union(sets), {}
    for i, grams in sets.items():
        for gram in grams or {None}:
            holders.setdefault(gram, []).append(i)
    for pair in {(a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k]}:
        a, b = (sets[i] for i in pair)
        if 5 * len(a & b) >= 4 * len(a | b):
            want.join(*pair)
    return want


def test_near_dedup_loses_no_pair(spark):
    """All documents of the larger test tables against exact similarity of all pairs that share a shingle, and long texts with changed words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(9)
    top = max(r.doc_id for r in docs.collect() if r.doc_id is not None) + 1
    made = []
    for k in range(60):
        words = [f"v{rng.randrange(10**9)}" for _ in range(rng.randrange(6, 400))]
        copy = list(words)
        for at in rng.sample(range(len(copy)), len(copy) // rng.choice([40, 50, 60, 80])):
            copy[at] = "changed"
        made += [(top + 2 * k, " ".join(words)), (top + 2 * k + 1, " ".join(copy) + ".")]
    docs = docs.unionByName(frame(spark, made).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = slow_groups(rows)
    assert len({want.root(i) for i, _ in rows}) < len(rows) - 20
    for tile in (4096, 8):
        got = sorted(r.doc_id for r in simhash.keep_one(docs.where("doc_id is not null"), tile=tile).select("doc_id").collect())
        assert got == sorted(i for i, _ in rows if want.root(i) == i)


def test_pipeline_against_plain_python(spark, docs, odd, none):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs.select(quality.text_stats("text").alias("m")).select("m.*"))
    post = {r.doc_id: r.kept for r in quality.judged(docs.select("doc_id", quality.text_stats("text").alias("m")).select("doc_id", "m.*")).collect()}
    assert 0.5 < model.prior < 1
    rows = [(i, t) for i, t in rows if post[i]]
    rows = sorted(cleaned(rows, slow_lines(rows)).items())
    want = slow_groups(rows)
    rows = [(i, t) for i, t in rows if want.root(i) == i]
    matcher = decontaminate.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 0.06, 20)
    rows = [(i, t) for i, t in rows if not matcher.hits(t)]
    check_packing(corpus_pipeline.run(spark, sf).collect(), frame(spark, rows).collect(), 2048)
    for start in (odd, none):
        here = start
        for _, stage in corpus_pipeline.STAGES:
            here = stage(spark, here, sf)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert here.columns == start.columns
        here.count()


def test_row_key_tells_rows_apart(spark, odd):
    assert odd.select(row_key()).distinct().count() == odd.distinct().count()


def test_star_steps_read_their_edges_once_a_side(spark):
    """A round of the components has no union of its edges with themselves, and hanging keeps one edge or none for each."""
    edges = spark.createDataFrame([(5, 4), (5, 3), (4, 1), (9, 2), (9, 8), (7, 2)], "u bigint, v bigint")
    large = _stars(edges, True)
    assert sorted(map(tuple, large.collect())) == [(4, 1), (5, 1), (5, 3), (7, 2), (9, 2), (9, 8)]
    small = _stars(edges, False)
    assert sorted(map(tuple, small.collect())) == [(4, 1), (4, 3), (5, 3), (7, 2), (8, 2), (9, 2)]
    plan = _stars(large, False).distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join") <= 3
