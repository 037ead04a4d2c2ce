"""The registered queries of the subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, html, language, license_scan, media, packing, pii, prefix_trie, simhash, source_divergence, suffix_dedup, token_store, toxicity
from shutterlake.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), errors=3, words_each=3)
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.crc_of_ids(token_store.read_tokens(files))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.audio_features(media.store_audio(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.hex(F.crc32("tensors")), F.length("tensors"), F.size("spans"), F.format_number(F.aggregate("spans", F.lit(0.0), lambda a, x: a + x["end_s"] - x["start_s"]), 3))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.language_id(table(spark, sf_dir, "documents"), folds=4, held_out=2)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations")).select(*prefix_trie.NODE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii_spans": op3_pii_spans,
    "op4_simhash_components": op4_simhash_components,
    "op5_decontamination": op5_decontamination,
    "op6_token_store": op6_token_store,
    "op7_html_text": op7_html_text,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

#: crc32 bit by bit, since DuckDB has none; then prefixes as strings of fixed-width turn names.
_TRIE_SQL = """
WITH named AS (
    SELECT conv_id AS c, md5(md5(coalesce(role, '')) || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(md5(coalesce(role, '')) || coalesce(text, ''))) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ord(substr(c::VARCHAR, k, 1))::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
    FROM (SELECT DISTINCT c FROM named)
), rebuilt AS (
    SELECT convs.c, named.i, m, size FROM convs JOIN named ON named.c = convs.base AND named.i < h
    UNION ALL SELECT convs.c, named.i + 1000000, m, size FROM convs JOIN named ON named.c = convs.c AND named.i >= h
), steps AS (
    SELECT c, row_number() OVER w AS d, string_agg(m, '') OVER w AS key, size FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY i)
), every AS (
    SELECT c, d, key, size FROM steps UNION ALL SELECT c, 0, '', 0 FROM convs
), lengths AS (
    SELECT c, max(d) AS depth FROM every GROUP BY c
), nodes AS (
    SELECT key, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (every.d = lengths.depth), '')) AS ends_sha256
    FROM every JOIN lengths USING (c) GROUP BY key, d
), kids AS (
    SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), under AS (
    SELECT substr(n.key, 1, 32 * up) AS key, sum(own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) AS n LEFT JOIN kids USING (key) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, under.leaves AS n_leaves, under.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes AS n LEFT JOIN nodes AS p ON n.depth > 0 AND p.key = substr(n.key, 1, length(n.key) - 32) LEFT JOIN kids ON kids.key = n.key JOIN under ON under.key = n.key
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """Every block of every text against every template, without filters."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    words = [(t, label, sorted({w.decode() for w in license_scan.words_of(text)})) for t, (label, text) in enumerate(license_scan.TEMPLATES)]
    templates = ", ".join(f"({t}, {quoted(label)}, {len(ws)}, {license_scan.least_overlap(len(ws), license_scan.THRESHOLD)}, {quoted(w)})" for t, label, ws in words for w in ws)
    phrases = " ".join(f"WHEN {' AND '.join(f'w{i} = {quoted(w)}' for i, w in enumerate(p.split()))} THEN {quoted(label)}" for p, label in license_scan.PHRASES.items())
    step, names = license_scan.STRIDE, lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS w0, generate_subscripts(ws, 1) - 1 AS i, greatest(len(ws) - {step + 1}, 0) // {step} AS last FROM d),
q AS (SELECT r, i, w0, {', '.join(f'lead(w0, {k}) OVER o AS w{k}' for k in (1, 2, 3))} FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS ls FROM (SELECT r, i, CASE {phrases} END AS label FROM q) WHERE label IS NOT NULL GROUP BY r),
t(t, label, n, least, w0) AS (VALUES {templates}),
k AS (SELECT r, w0, least(i // {step}, last) AS k FROM p UNION SELECT r, w0, least(greatest(i // {step} - 1, 0), last) FROM p),
m AS (SELECT r, list(label) AS ls, max(c / n::DOUBLE) AS best FROM (SELECT r, k, t, any_value(label) AS label, any_value(n) AS n, any_value(least) AS o, count(*) AS c FROM k JOIN t USING (w0) GROUP BY r, k, t) WHERE c >= o GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, {names('b.ls')} AS base_labels, {names("list_concat(coalesce(b.ls, []), coalesce(m.ls, []))")} AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


_DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS kept FROM k GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (total + kept) AS p FROM g JOIN k USING (lang) JOIN s USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n)::BIGINT + 1) // (any_value(total) + any_value(kept)) AS q FROM c JOIN t USING (lang) JOIN v USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT p.lang, p.source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 200)
"""
ORACLE_SQL: dict[str, str] = {"op11_source_divergence": _DIVERGENCE_SQL, "op12_license_scan": _license_sql(), "op13_prefix_trie": _TRIE_SQL}
