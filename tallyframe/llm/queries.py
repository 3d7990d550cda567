"""The queries opN_<name>: each applies one operator to its whole table.  ORACLES has those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, chat_format, decontamination, language_id, line_dedup, merkle, periodic_runs, quality_model, quality_rules, secrets, simhash, substring_dedup, toxicity
from tallyframe.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate_lines(docs, counts=True).withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has a role for every row: the model learns from them and recovers each without seeing its own
    return chat_format.format_chats(table(spark, sf_dir, "conversations"), trust_roles=False)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.summary(decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=periodic_runs.planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.a")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.length div -best.q").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, found=merkle.lowered_fifth(docs)).withColumnRenamed("id", "doc_id")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_chat_format, op4_secret_scan, op5_byte_bpe, op6_simhash, op7_quality_rules, op8_decontamination, op9_language_id, op10_quality_model, op11_periodic_runs, op12_merkle_manifest, op13_substring_dedup)}

_SPACE = r"\x20\x09-\x0D"
_STOPS = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality_rules.STOP_WORDS)

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(x: str) -> str:
    """SQL: the unsigned crc32 of a number's decimal digits, a bit at a time."""
    bits = f"flatten(list_transform(string_split({x}::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295)"


def _merkle_sql(levels: int = 5, tops: int = 3) -> str:
    """The tree unrolled: each level is the runs of the one below, kept as it is once one node is left; then each leaf's way up."""
    coded = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(coded(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = f"CASE WHEN {_crc32('doc_id')} % 5 = 0 THEN translate(text, '{_UP}', '{_LOW}') ELSE text END"
    parts = [
        f"hashed AS (SELECT doc_id, coalesce('s' || source, '') AS k, {leaf('text')} AS leaf, {leaf('found')} AS other FROM (SELECT *, {lowered} AS found FROM documents))",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed)",
        "a0 AS (SELECT k, i, leaf AS d FROM leaves)",
    ]

    def tree(name: str, n: int) -> None:
        for x in range(n):
            parts.append(f"{name}r{x} AS (SELECT k, i // 16 AS i, list(d ORDER BY i) AS run, max(c) > 1 AS more FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM {name}{x}) GROUP BY k, i // 16)")
            parts.append(f"{name}{x + 1} AS (SELECT k, i, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM {name}r{x})")

    tree("a", levels)
    parts.append(f"b0 AS (SELECT 'root' AS k, row_number() OVER (ORDER BY k) - 1 AS i, d, k AS of FROM a{levels})")
    tree("b", tops)
    parts.append(f"w0 AS (SELECT doc_id, leaves.k, leaf, a{levels}.d AS subroot, other AS now, '' AS proof, leaves.i, b0.i AS j FROM leaves JOIN a{levels} USING (k) JOIN b0 ON of = leaves.k)")
    steps = [(f"ar{x}", "i", x, "r.k = w.k") for x in range(levels)] + [(f"br{x}", "j", x, "true") for x in range(tops)]
    for x, (runs, i, level, same) in enumerate(steps):
        at = f"((w.{i} // {16**level}) % 16)"
        before, after = f"run[1:{at}]", f"run[{at} + 2:]"
        parts.append(
            f"w{x + 1} AS (SELECT w.* REPLACE (CASE WHEN more THEN sha256(array_to_string({before} || [now] || {after}, '')) ELSE now END AS now, "
            f"CASE WHEN more THEN proof || array_to_string({before} || {after}, '') ELSE proof END AS proof) FROM w{x} w JOIN {runs} r ON {same} AND r.i = w.{i} // {16 ** (level + 1)})"
        )
    last = f"SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = d AS verified FROM w{len(steps)}, b{tops}"
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLES = {
    "op12_merkle_manifest": _merkle_sql(),
    "op13_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS k, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS s FROM d WHERE len(w) >= 35),
twice AS (SELECT r, k FROM g QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM twice),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op2_line_dedup": rf"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS i FROM split),
w AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER d AS b, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS s
  FROM l WHERE regexp_matches(line, '[^{_SPACE}]') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, a, b, first_value(doc_id) OVER o AS fd, first_value(a) OVER o AS fa, first_value(b) OVER o AS fb
  FROM w WHERE b IS NOT NULL WINDOW o AS (PARTITION BY s ORDER BY doc_id, a)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(a, fb + 1) ELSE a END, b + 1)) AS i
  FROM f WHERE doc_id > fd OR (doc_id = fd AND a > fa)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(s.x), 0)::BIGINT AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = s.doc_id) AS n_removed
FROM split s LEFT JOIN kept k USING (doc_id)""",
    "op7_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stops, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[{_SPACE}]*[{quality_rules.SYMBOLS}]'))) AS n_symbol_lines,
         len(list_filter(w, lambda x: length(x) > 40)) AS n_long
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (word_chars < 1.5 * n_words OR word_chars > 40 * n_words)
  AND NOT (n_symbols::DOUBLE / n_words > 0.3)
  AND NOT (n_words >= 20 AND n_upper::DOUBLE / word_chars > 0.6)
  AND NOT (n_words >= 20 AND n_exclamations::DOUBLE / n_words > 0.3)
  AND NOT (n_words >= 400 AND n_stops::DOUBLE / n_words < 0.0005)
  AND NOT (n_words >= 20 AND n_dup_lines::DOUBLE / n_lines > 0.5)
  AND NOT (n_words >= 20 AND n_symbol_lines::DOUBLE / n_lines > 0.9)
  AND NOT (n_words >= 20 AND n_long::DOUBLE / n_words > 0.3) AS kept
FROM b""",
    "op8_decontamination": rf"""
WITH a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, up, low), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, a),
i AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, up, low), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, a),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
