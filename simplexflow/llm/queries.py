"""Registered queries of this package: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from simplexflow.llm import decontaminate, licenses, lines, lmscore, merkle, ngramjoin, packing, quality, repair, simhash, toxicity, urls, warc
from simplexflow.llm.tables import shared_folder, table
from simplexflow.plans.lineage import cut


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    stats = cut(table(spark, sf, "documents").select("doc_id", quality.text_stats("text").alias("m")).select("doc_id", "m.*"))
    return quality.judged(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                        "quality")


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents")).withColumn("coverage", F.round("coverage", 6))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    named = simhash.classes(table(spark, sf, "documents"))
    return named.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judged(table(spark, sf, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    clean = lines.dedup_lines(table(spark, sf, "documents"), gone="gone")
    return clean.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
                        F.length("text").cast("bigint").alias("clean_chars"), F.md5(F.col("text").cast("binary")).alias("clean_md5"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", lmscore.source_split().alias("split"))
    good = table(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.scored(lmscore.marked(docs, good, "good"), "good", whole=docs, split="split")


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    found = warc.resolved(warc.read(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngramjoin.classes(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    broken = repair.damaged(rows)
    done = repair.summaries(repair.repaired(broken)).withColumnRenamed("conv", "c")
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("c")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = broken.groupBy(key).agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    out = rows.select("conv_id", key).distinct().join(gaps, "c", "left").join(done, "c", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    n_chars = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    made = merkle.manifest(table(spark, sf, "documents"), changed={"n_chars": n_chars})
    siblings = F.transform(F.filter("path", lambda p: p["digest"].isNotNull()), lambda p: p["digest"])
    made = made.select("id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"),
                       merkle.folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return made.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7_SQL = f"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw_line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
kept AS (SELECT doc_id, no, trim(raw_line, {SPACES_SQL}) AS line FROM raw),
counted AS (SELECT * FROM kept WHERE line <> '' AND len(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+')) >= 3),
firsts AS (SELECT line, length(line) AS n, min((doc_id, no)) AS place FROM counted GROUP BY line),
halves AS (
  SELECT line, place, unnest([left(line, n // 2), left(line, (n - 1) // 2)]) AS half, 0 AS side FROM firsts UNION ALL
  SELECT line, place, unnest([right(line, (n + 1) // 2), right(line, n // 2)]), 1 FROM firsts),
near AS (
  SELECT DISTINCT x.line FROM halves x JOIN halves y ON x.half = y.half AND x.side = y.side AND y.place < x.place
  WHERE levenshtein(x.line, y.line) <= 1),
gone AS (
  SELECT c.doc_id, c.no FROM counted c JOIN firsts f USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR (c.doc_id, c.no) <> f.place),
per AS (
  SELECT r.doc_id, count(g.no) AS n_dropped, string_agg(r.raw_line, chr(10) ORDER BY r.no) FILTER (g.no IS NULL) AS clean
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.no = g.no GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(clean, '')) END AS clean_chars,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(clean, '')) END AS clean_md5
FROM documents d LEFT JOIN per USING (doc_id)
"""

#: Words of a lower-cased text.
WORDS_SQL = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP11_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 4 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, (SELECT min(v) FROM reach WHERE reach.u = s.doc_id) AS component_id FROM s
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB."""
    byte = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: {byte}), 4294967295::BIGINT)"


OP12_NONE = "{'c': 1000000000, 'a': '', 'r': ''}"


def _next_sql(state: int, edit: str, cost: str, line: str) -> str:
    return f"{{'c': v{state}.c + {cost}, 'a': '{edit}' || v{state}.a, 'r': {line} || v{state}.r}}"


def _base_sql(state: int, keeps: dict[str, int], made: int, role: str) -> str:
    """The best of one row's edits from a state of the grammar."""
    own, new = "role || ':' || text || chr(10)", f"'{role}:' || text || chr(10)"
    kept = " ".join(f"WHEN initial = '{x}' AND stays THEN {_next_sql(to, 'K', 'more', own)}" for x, to in keeps.items())
    rerole = f"CASE WHEN stays THEN {_next_sql(made, 'R', '3 + more', new)} ELSE {OP12_NONE} END"
    return f"list_min([{_next_sql(state, 'D', '4', repr(''))}, CASE {kept} ELSE {OP12_NONE} END, {rerole}])"


def _insert_sql(of: str, role: str) -> str:
    return f"{{'c': {of}.c + 3, 'a': 'I' || {of}.a, 'r': '{role}:' || chr(10) || {of}.r}}"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
r AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again FROM d WHERE k <> 0),
o AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER place AS i, lag(left(role, 1)) OVER place AS before,
    count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM r WINDOW place AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM o),
f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND copy > 1 AS dup, bare <> '' AND copy = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut_off FROM q),
e AS (SELECT *, NOT blank AND NOT dup AS stays, CASE WHEN cut_off THEN 3 ELSE 0 END AS more FROM f),
dp AS (
  SELECT DISTINCT conv_id, n AS i, {{'c': 0, 'a': '', 'r': ''}} AS v0, {{'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS v1,
    {{'c': 3, 'a': 'I', 'r': 'assistant:' || chr(10)}} AS v2, {{'c': 0, 'a': '', 'r': ''}} AS v3 FROM e
  UNION ALL
  SELECT conv_id, i, list_min([b0, {_insert_sql('w2', 'user')}]), list_min([b1, {_insert_sql('w2', 'user')}]), w2, w3 FROM (
    SELECT *, list_min([b2, {_insert_sql('b3', 'assistant')}]) AS w2, list_min([b3, {_insert_sql('b2', 'user')}]) AS w3 FROM (
      SELECT dp.conv_id, dp.i - 1 AS i, {_base_sql(0, {'s': 1, 'u': 2}, 2, 'user')} AS b0, {_base_sql(1, {'u': 2}, 2, 'user')} AS b1,
        {_base_sql(2, {'a': 3}, 3, 'assistant')} AS b2, {_base_sql(3, {'u': 2}, 2, 'user')} AS b3
      FROM dp JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i))),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup,
    count(*) FILTER (cut_off) AS cut_off, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate,
  coalesce(cut_off, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit,
  sha256(coalesce(left(v0.r, length(v0.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM x.conv_id AND dp.i = 0
"""


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS changed FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM d),
nodes AS (
  SELECT lang, 0 AS level, pos, size, leaf AS node FROM leaves UNION ALL
  SELECT lang, level + 1, pos // 2, (max(size) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY lang, level, pos // 2),
tops AS (SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n_tops FROM nodes WHERE size = 1),
upper_ AS (
  SELECT 0 AS level, place AS pos, n_tops AS size, subroot AS node FROM tops UNION ALL
  SELECT level + 1, pos // 2, (max(size) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_ WHERE size > 1 GROUP BY level, pos // 2),
root AS (SELECT level AS height, node AS root FROM upper_ WHERE size = 1),
steps AS (
  SELECT l.doc_id, l.lang, l.pos, r.level AS step, (l.pos >> r.level) & 1 AS on_right, n.node FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang
  JOIN range(0, 64) r(level) ON r.level < t.height
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = r.level AND n.pos = xor(l.pos >> r.level, 1)
  UNION ALL
  SELECT l.doc_id, l.lang, l.pos, 100 + r.level, (t.place >> r.level) & 1, n.node FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root
  JOIN range(0, 64) r(level) ON r.level < root.height
  LEFT JOIN upper_ n ON n.level = r.level AND n.pos = xor(t.place >> r.level, 1)),
paths AS (
  SELECT lang, pos, list(CASE WHEN on_right = 1 THEN 'R' ELSE 'L' END || coalesce(node, '') ORDER BY step) AS path, string_agg(node, '' ORDER BY step) AS siblings
  FROM steps GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM (
  SELECT l.*, t.subroot, root.root, p.siblings,
    list_reduce(list_concat([l.changed], coalesce(p.path, [])), lambda h, s: sha256(CASE WHEN s[1] = 'R' THEN s[2:] || h ELSE h || s[2:] END)) AS folded
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos)
"""

QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_license_scan": (op2_license_scan, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_simhash": (op4_simhash, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_url_filter": (op6_url_filter, None),
    "op7_line_dedup": (op7_line_dedup, OP7_SQL),
    "op8_toxicity": (op8_toxicity, None),
    "op9_lm_scoring": (op9_lm_scoring, None),
    "op10_warc": (op10_warc, OP10_SQL),
    "op11_ngram_join": (op11_ngram_join, OP11_SQL),
    "op12_conversation_repair": (op12_conversation_repair, OP12_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
