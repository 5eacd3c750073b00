"""Quality rules, licence scans, packing, decontamination, toxicity and LM scoring against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from simplexflow.llm import decontaminate, licenses, lmscore, packing, quality, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_measure(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(inside))


def test_measure_equals_slow_form():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "*", " ", "a b a b a ", "\x0b"]) for _ in range(rng.randint(0, 80)))
        got = dict(zip(quality.STATS, quality.measure(text)))
        assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_measure(text)


def test_em_finds_good_and_bad_rules():
    rng = np.random.default_rng(3)
    good = rng.random(6000) < 0.8
    right = {"a": 0.95, "b": 0.9, "c": 0.8, "d": 0.85}
    votes = {k: np.where(rng.random(6000) < 0.2, 0, np.where((rng.random(6000) < r) == good, 1, -1)) for k, r in right.items()}
    patterns = list(Counter(zip(*(v.tolist() for v in votes.values()))).items())
    model = quality.expectation_maximisation(patterns, tuple(right))
    assert abs(model.prior - 0.8) < 0.05
    assert all(abs(model.right_good[k] - r) < 0.06 for k, r in right.items())
    assert quality.expectation_maximisation([], ("a",)).prior == pytest.approx(0.9)


def test_quality_against_labels_and_odd_rows(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", quality.text_stats("text").alias("m")).select("doc_id", "m.*")
    told = quality.judged(rows).join(labels, "doc_id").where("label is not null and not base_failed").toPandas()
    assert (told["kept"] == (told["label"] == 1)).mean() > 0.97
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {5, 8}
    assert quality.keep_good(none).count() == 0


def test_patience_and_cover():
    a, b = "x x a b c q d e".split(), "a b c d e".split()
    assert [(a[i], b[j]) for i, j in licenses.patience(a, b)] == [(w, w) for w in b]
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:]))
        assert len(got) <= len(licenses.common(a, b))


def test_licences(spark, odd, none):
    mit = licenses.TEMPLATES["MIT-notice"]
    changed = mit.replace("free of charge", "gratis and free").upper()
    rows = spark.createDataFrame([(1, "word " * 500 + mit + " more" * 500), (2, changed), (3, mit + "\n" + mit), (4, "Licensed under CC\nBY-NC 4.0!"), (5, None)],
                                 "doc_id bigint, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan(rows).collect()}
    assert set(got) == {(1, "MIT-notice"), (2, "MIT-notice"), (3, "MIT-notice"), (4, "CC-BY-NC-4.0")}
    assert got[1, "MIT-notice"].coverage == 1 and got[1, "MIT-notice"].start_word == 500 and 0.8 <= got[2, "MIT-notice"].coverage < 1
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_ids_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = [r.text for r in docs.limit(60).collect()] + ["", None, "a<|endoftext|>b  c\x01d \x1c é I'm don't 12 ΑΣ İx é", "\x01", "\x02 \xa0 　x"]
    for text, ids in zip(texts, ours.many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_ids_of_spellings_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = np.random.default_rng(3)
    signs = ["a", "Σ", "İ", "ß", "é", "e\u0301", "\u0301", "\ufb1d", "'", "s", "'T", "S", ".", "_", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "\x01", "漢",
             "ʰ", "क", "ा", "</w>", "<", ">", " ", "\t", "\x1c", "\x85", "\xa0"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(5000)]
    for text, ids in zip(texts, ours.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)


def check_packing(rows, docs, limit):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    whole = Counter()
    for d in docs:
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), limit)):
            part = ids[start:start + limit]
            whole[d.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == whole
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    return len(bins)


def test_packing(docs, odd, none):
    for frame, limit in ((docs, 2048), (odd, 64)):
        rows = packing.pack_documents(frame, PATH, limit).collect()
        n = check_packing(rows, frame.collect(), limit)
        full = sum(r.length == limit for r in rows)
        assert n - full <= -(-sum(r.length for r in rows if r.length < limit) // limit) + 1
    assert packing.pack_documents(none, PATH).count() == 0


def test_exchange_empties_bins():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(150, 700, 400)
        start = packing.best_fit(lengths, 1000)
        end = packing.exchange([list(b) for b in start], 1000)
        square = lambda bins: sum(sum(b) ** 2 for b in bins)
        assert sorted(x for b in end for x in b) == sorted(lengths.tolist()) and max(map(sum, end)) <= 1000
        assert len(end) <= len(start) and square(end) >= square(start)
    assert len(packing.exchange([[500, 400], [300, 300, 300], [100, 100]], 1000)) == 2


def slow_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, ch in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (ch != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_equals_table():
    rng = random.Random(7)
    for _ in range(500):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))
        assert decontaminate.myers(p, t, 99)[0] == slow_distance(p, t)


def test_leaks(spark, odd, none):
    item = "The quick brown fox jumps over the lazy dog while seven wizards boil a pot of strange green soup in the rain"
    edited = item.replace("quick", "qick").replace("soup", "soop").upper().replace(" ", "\n")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "of"), (5, item), (None, item), (6, "Another item of some length stands here, too")],
                                  "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "x " * 900 + item + "."), (2, edited), (3, item[:60]), (4, "of"), (5, "of course"), (6, None)], "doc_id bigint, text string")
    want = {(1, 1): 0, (1, 5): 0, (2, 1): 2, (2, 5): 2, (4, 4): 0}
    for chars in (2_000_000, 60):
        assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(rows, bench, shard_chars=chars).collect()} == want
    assert decontaminate.clean_only(odd, bench).columns == odd.columns
    assert decontaminate.clean_only(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.clean_only(none, bench).count() == 0


def test_leaks_equal_search_over_all_pairs(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, decontaminate.bare(r.text)) for r in bench.collect()]
    rows = [(r.doc_id, decontaminate.bare(r.text)) for r in docs.collect()]
    want = {(d, i) for d, t in rows for i, b in items if len(t) < 4000 and decontaminate.myers(b, t, int(0.06 * len(b)))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    short = {d for d, t in rows if len(t) < 4000}
    assert {x for x in got if x[0] in short} == want


def test_toxicity_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    told = toxicity.judged(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, per_class=1500).join(labels, "doc_id").where("held_out").toPandas()
    hit = told["predicted"] == 1
    assert told.loc[hit, "toxic"].mean() > 0.9 and hit[told["toxic"] == 1].mean() > 0.75
    empty = toxicity.judged(odd, labels.limit(0)).collect()
    assert len(empty) == odd.count() and {r.score for r in empty} == {0.5}
    assert toxicity.judged(none, labels.limit(0)).count() == 0


def test_gaps_lower_the_kernel_but_do_not_hide_a_word():
    k = lambda a, b: toxicity.decide([a.encode()], np.bincount(*toxicity.phi(b.encode())[:1], weights=toxicity.phi(b.encode())[1], minlength=1 << 18), 0.0)[0]
    assert k("idiot", "idiot") > k("idxiot", "idiot") > k("xyz", "idiot") == 0
    assert b"idiot" in toxicity.words_of("you I d i o t here") and toxicity.words_of(None) == set()


def test_lm_models(spark, odd, none):
    rows = [(i, t, i % 2 == 0) for i, t in enumerate(["a b a b c", "a b", "", None, "c c c a", "b a b a"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, good boolean")
    model = lmscore.train(docs, "good", min_share=1000)
    names = {v: k for k, v in model.known.items()}
    for marked, side in ((True, model.target), (False, model.background)):
        texts = [t.split() for _, t, g in rows if t and (g or not marked)]
        counts = Counter((h, w) for t in texts for h, w in zip(["<s>", *t], t))
        for at, kept in zip(model.bigrams.tolist(), side.kept):
            assert counts[names[h].decode() if (h := at >> 31) else "<s>", names[at & 0x7FFFFFFF].decode()] == kept
        for h in range(len(side.word)):
            w = np.arange(1, len(side.word))
            key = np.int64(h) << 31 | w
            at = np.minimum(np.searchsorted(model.bigrams, key), len(model.bigrams) - 1)
            assert (2.0 ** -side.loss(np.full(len(w), h), w, at, model.bigrams[at] == key, model.weight)).sum() == pytest.approx(1)
    scored = {r.doc_id: r for r in lmscore.score(docs, model).collect()}
    assert scored[2].n_tokens == 0 and scored[2].difference is None and scored[3].difference is None
    assert lmscore.score(odd, lmscore.train(odd.withColumn("good", F.lit(None).cast("boolean")), "good")).count() == odd.count()
    assert lmscore.score(none, lmscore.train(none.withColumn("good", F.lit(True)), "good")).count() == 0


def test_lm_tells_good_from_bad_on_unseen_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    good = docs.join(labels, "doc_id", "left").withColumn("good", (F.col("quality") == 1) & seen)
    told = lmscore.score(docs, lmscore.train(good, "good")).join(labels, "doc_id").where(~seen).toPandas()
    assert told.loc[told["quality"] == 0, "difference"].median() > told.loc[told["quality"] == 1, "difference"].median() + 0.5
