"""N-gram join, conversation repair and Merkle manifest against plain Python, with odd inputs and small tiles."""

import hashlib
import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexflow.llm import merkle, ngramjoin, repair
from tests.llm.conftest import frame

CONV = "conv_id bigint, turn bigint, role string, text string, cost string, part int"


def plain_sets(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


def plain_classes(rows):
    sets = plain_sets(rows)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[root(i)] = root(j)
    least = {}
    for i, (doc_id, s) in enumerate(sets):
        if s and doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def made_texts(rng, groups, copies, words, changes):
    """Groups of near copies and chains of them, some with a passage that all texts share."""
    shared = [f"s{k}" for k in range(40)]
    texts = []
    for g in range(groups):
        text = [f"w{rng.randrange(4000)}" for _ in range(words)] + (shared if g % 2 else [])
        for _ in range(copies):
            texts.append(" ".join(text))
            for _ in range(changes):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    return list(enumerate(texts))


@pytest.mark.parametrize("tile", [1024, 8])
def test_ngram_join_equals_all_pairs(spark, tile):
    rows = made_texts(random.Random(3), 12, 30, 60, 1) + made_texts(random.Random(4), 30, 3, 25, 2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = [tuple(r) for r in ngramjoin.classes(frame(spark, rows), tile=tile).select("id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == plain_classes(rows)


def test_ngram_join_odd_rows(spark, odd, none):
    got = [tuple(r) for r in ngramjoin.classes(odd).select("id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == plain_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert ngramjoin.classes(none).count() == 0


def test_ngram_join_whole_table(spark, docs):
    got = [tuple(r) for r in ngramjoin.classes(docs).select("id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == plain_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, (700, 16)).astype(np.int32)
    points[350:] = np.maximum(points[:350] + rng.integers(-1, 2, (350, 16)), 0)
    q, p = ngramjoin.CountTree(points).search(points)
    n = points.sum(axis=1)
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(180 * bound >= 80 * (n[:, None] + n[None])))))


def test_points_of_large_sets_fold(spark):
    rng = random.Random(8)
    rows = made_texts(rng, 4, 4, 500, 12) + made_texts(rng, 3, 3, 560, 25)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = [tuple(r) for r in ngramjoin.classes(frame(spark, rows)).select("id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == plain_classes(rows)
    assert {len(ngramjoin.counts_of(np.arange(n, dtype=np.uint64))) for n in (1, 500, 530, 4097)} == {64, 128, 1024}


def test_prefix_of_similar_sets_meets():
    for n in range(1, 60):
        for m in range(n, 80):
            overlap = next((o for o in range(n + 1) if ngramjoin.reaches(o, n, m, (80, 100))), None)
            if overlap is not None:  # even with the least overlap, neither set can hide it behind its prefix
                assert ngramjoin.prefix_length(n, (80, 100)) > n - overlap and ngramjoin.prefix_length(m, (80, 100)) > m - overlap


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare.strip(" \t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit, text) by a search over whole repairs, independent of the agenda."""
    faults = plain_faults(rows)

    def ok(roles):
        bare = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (bare != "" and len(bare) % 2 == 0 and bare == "ua" * (len(bare) // 2))

    def possible(roles):
        bare = roles[1:] if roles[:1] == "s" else roles
        return bare == ("ua" * (len(bare) // 2 + 1))[:len(bare)]

    heap = [(0, "", 0, "", ())]
    best = None
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and ok(roles):
            best = min(best, (cost, audit, kept)) if best else (cost, audit, kept)
        moves = [("I", 3, i, x, (f"{repair.ROLE[x]}:",)) for x in "ua"]
        if i < len(rows):
            _, role, text = rows[i]
            moves.append(("D", 4, i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                moves.append(("K", more, i + 1, role[:1] or "?", (f"{role}:{text}",)))
                moves += [("R", 3 + more, i + 1, x, (f"{repair.ROLE[x]}:{text}",)) for x in "ua"]
        for letter, more, to, x, line in moves:
            if possible(roles + x):
                heapq.heappush(heap, (cost + more, audit + letter, to, roles + x, kept + line))
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def plain_summary(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = plain_faults(rows)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, sha = plain_repair(rows)
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def conversations(rng, n):
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "*any"])
            text = rng.choice(["Yes.", "No!", "cut", " ", "", "One. two", "Why?\n"])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, 3, None]), role, text))
    return out


def summaries(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)
    return {r["conv"]: tuple(r)[1:] for r in repair.summaries(repair.repaired(df)).collect()}


def test_repair_equals_search(spark):
    rows = conversations(random.Random(5), 150)
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault("" if conv is None else f"c{conv}", []).append((turn, role, text))
    assert summaries(spark, rows) == {c: plain_summary(r) for c, r in groups.items()}


def test_repair_of_a_conversation_in_many_partitions(spark, monkeypatch):
    """A chunked conversation gives what one chunk gives; equal rows are split over chunks too."""
    rng = random.Random(6)
    rows = [(1, rng.choice([None, 5, *range(60)]), rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "cut", "", f"No {k}!"])) for k in range(400)]
    rows += [(2, 0, "user", "Yes.")] * 40 + [(3, 0, "user", "Why?"), (3, 1, "assistant", "So.")]
    one = {}
    for conv in (1, 2, 3):
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = list(zip((r[1][:1] for r in turns), plain_faults(turns)))
        cost, edit = repair.lightest(marks, repair.DONE)
        one[f"c{conv}"] = (cost[0][0], "".join(x[0] for x in repair.walk(marks, edit, 0)))
    monkeypatch.setattr(repair, "parts_for", lambda n, each: 40)
    got = summaries(spark, rows)
    assert {c: (v[4], v[5]) for c, v in got.items()} == one
    monkeypatch.undo()
    assert got == summaries(spark, rows)


def test_repair_empty_and_damage(spark):
    df = spark.createDataFrame([], CONV)
    assert repair.summaries(repair.repaired(df)).count() == 0
    rows = [(k // 8, k % 8, "assistant", f"One. Two {k}!") for k in range(400)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], CONV))
    import zlib

    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else x.translate({33: None, 46: None, 63: None}) if k == 2 else x)] * (2 if k == 3 else 1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Top and, for each leaf, the (sibling, is right) pairs on the way up."""
    paths = [[] for _ in leaves]
    at, level = list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
            at[k] = i // 2
        level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], sha("".join(part(r[f]) for f in merkle.FIELDS))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    trees = {g: plain_tree([leaf for _, leaf in sorted(groups[g], key=order)]) for g in names}
    root, upper = plain_tree([trees[g][0] for g in names])
    return sorted(((d, leaf, trees[g][0], root, tuple(path + up)) for g, up in zip(names, upper)
                   for (d, leaf), path in zip(sorted(groups[g], key=order), trees[g][1])), key=str)


@pytest.mark.parametrize("step", [1, 2, 6])
def test_manifest_equals_plain_tree(spark, odd, step):
    rows = [(k if k % 11 else k // 2, f"t{k % 7}", ["de", None, "en", "fr", "", "a"][min(k % 9, 5)], "s", None if k % 5 == 0 else k) for k in range(150)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("g", F.lit("x")).withColumn("pos", F.lit(1))
    for df in (odd, more):
        made = merkle.manifest(df, changed={"n_chars": F.col("n_chars") + 1}, step=step)
        got = made.select("id", "leaf", "subroot", "root", "path", merkle.folded(F.col("leaf"), F.col("path")).alias("again"), "changed_leaf",
                          merkle.folded(F.col("changed_leaf"), F.col("path")).alias("other")).collect()
        assert sorted(((r["id"], r["leaf"], r["subroot"], r["root"], tuple((p["digest"], int(p["right"])) for p in r["path"])) for r in got), key=str) == plain_manifest(
            [r.asDict() for r in df.collect()])
        assert all(r["again"] == r["root"] and (r["other"] == r["root"]) == (r["changed_leaf"] == r["leaf"]) for r in got)


def test_manifest_of_nothing_and_of_one(spark, none):
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(frame(spark, [(7, "x")])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["path"] == []
