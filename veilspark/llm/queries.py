"""Registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import let

from . import bpe, exact, jaccard, manifest, packing, pieces, quality, repeats, runs, sitestyle, suffixes, toxicity, urls
from .tables import read

VOCABULARY = os.environ.get("VEILSPARK_VOCABULARY", public_tokenizers.path("byte_bpe_50k.json"))
PIECES = os.environ.get("VEILSPARK_PIECES", public_tokenizers.path("piece_bpe_32k.model"))
TOXIC_FROM = 0.3  # score from which a text counts as toxic


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), VOCABULARY, with_ids=False)


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, VOCABULARY).drop("text")
    return bpe.decode_ids(coded, VOCABULARY).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    labels = read(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.fit(read(spark, folder, "documents"), labels)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, folder)).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


URL_RULES = [
    urls.Rule("org/", True),
    urls.Rule("example.org/es/", False),
    urls.Rule("example.org/en/1", False),
    urls.Rule("com/fr/", True),
    urls.Rule("com/de/", False),
]


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read(spark, folder, "pages").select("page_id", "url"), URL_RULES)


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return sitestyle.main_text(read(spark, folder, "pages"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(read(spark, folder, "documents")).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "quality"
    )


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_groups(read(spark, folder, "documents")).drop("row_key", "keep_key")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.equal_groups(read(spark, folder, "documents"), digests=True)


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, folder, "documents")).drop("text")


_WORDS = r"""
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {n} - 1], ' ') AS s
  FROM words, unnest(range(1, len(w) - {n} + 2)) AS u(i)),
held AS (SELECT s, min(doc_id) AS low, max(doc_id) AS high FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id))"""

OP6_SQL = f"""
WITH {_WORDS.format(n=13)},
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM windows JOIN held USING (s), unnest(range(i, i + 13)) AS v(p)
  WHERE low < doc_id GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: NOT coalesce(list_contains(ps, k), FALSE)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)"""

OP10_SQL = f"""
WITH {_WORDS.format(n=50)},
hits AS (SELECT doc_id, i, CASE WHEN low = doc_id THEN high ELSE low END AS other,
  coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, TRUE) AS new FROM windows JOIN held USING (s)),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits)
SELECT doc_id, min(i) - 1 AS start, max(i) + 50 - min(i) AS n_words, arg_min(other, i) AS other_id
FROM runs GROUP BY doc_id, run"""


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode_texts(docs, PIECES).drop("text")
    return pieces.decode_ids(coded, PIECES).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def planted_period(docs: DataFrame) -> DataFrame:
    """The texts that the query is asked about: in one of ten, words from the a-th on repeat
    with period p (the contract's h, g, a and p)."""
    h = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY))"
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    at = "if(i < a, i, a + (i - a) % p)"
    made = f"array_join(transform(sequence(0, size(w) - 1), i -> w[CAST({at} AS INT)]), ' ')"
    made = let("p", "1 + (size(w) - a) DIV (3 + g % 8)", made)
    made = let("w", words, "if(size(w) = 0, text, " + let("a", "g % size(w)", made) + ")")
    return docs.withColumn("text", F.expr(f"CASE WHEN {h} % 10 = 0 AND text IS NOT NULL THEN {let('g', h + ' DIV 10', made)} ELSE text END"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = planted_period(read(spark, folder, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs).drop("text")
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        F.col("lang").alias("grp"),
        F.col("doc_id").cast("long").alias("id"),
        manifest.leaf_hash(*own, F.col("text")).alias("leaf"),
        F.when(tampered, manifest.leaf_hash(*own, lowered)).alias("altered"),
    )
    return manifest.prove(leaves).drop("grp").withColumnRenamed("id", "doc_id")


# crc32 of the decimal id, from a table of the polynomial's remainders
_CRC = """
remainders AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(n))),
sums AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) END AS crc FROM documents, remainders)"""

OP12_SQL = rf"""
WITH {_CRC},
plain AS (SELECT doc_id, crc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM sums),
marked AS (SELECT *, len(w) AS n, CASE WHEN crc % 10 = 0 AND len(w) > 0 THEN (crc // 10) % len(w) END AS a FROM plain),
words AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i:
  w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (crc // 10) % 8)) END]) END AS w FROM marked),
-- two equal words q apart are part of a run only if five in a row are
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, n - 3)) AS u(i)),
cells AS (SELECT b.doc_id, b.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i
  WHERE 4 * (b.i - a.i) <= a.n),
diagonals AS (SELECT doc_id, q, min(i) - q - 1 AS start, max(i) + 5 - min(i) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM cells) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM diagonals WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
found AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  list_distinct(flatten(list(range(start + period + 1, start + length + 1)))) AS gone FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
  1000 * best.l // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, k: NOT coalesce(list_contains(gone, k), FALSE)), ' '), '')) AS collapsed_sha256
FROM words LEFT JOIN found USING (doc_id)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_OWN = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(name: str, source: str) -> str:
    """Levels of the trees over ``source`` (grp, i, n, h), and what lies beside each node."""
    return f"""
{name}_nodes AS (SELECT 0 AS lvl, grp, i, n, h FROM {source}
  UNION ALL SELECT lvl + 1, grp, i // 8, any_value(n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes
  WHERE n > 1 GROUP BY lvl, grp, i // 8),
{name}_tops AS (SELECT grp, h FROM {name}_nodes WHERE n = 1),
{name}_beside AS (SELECT a.lvl, a.grp, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS early,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS late
  FROM {name}_nodes a JOIN {name}_nodes b ON a.lvl = b.lvl AND a.grp = b.grp AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL)"""


def _path_sql(name: str, tree: str, source: str) -> str:
    """From ``source`` (num, grp, i, proof, cur) up its tree: the proof so far and the node."""
    return f"""
{name}_steps AS (SELECT num, grp, 0 AS lvl, i, proof, cur FROM {source}
  UNION ALL SELECT num, s.grp, s.lvl + 1, s.i // 8, proof || early || late, sha256(early || cur || late)
  FROM {name}_steps s JOIN {tree}_beside b ON s.grp = b.grp AND s.lvl = b.lvl AND s.i = b.i),
{name} AS (SELECT num, any_value(grp) AS grp, arg_max(proof, lvl) AS proof, arg_max(cur, lvl) AS cur FROM {name}_steps GROUP BY num)"""


OP13_SQL = f"""
WITH RECURSIVE {_CRC},
leaves AS (SELECT doc_id, lang IS NULL AS no_lang, coalesce('.' || lang, '') AS grp, sha256({_OWN} || {_field('text')}) AS leaf,
  CASE WHEN crc % 3 = 0 THEN sha256({_OWN} || {_field(_LOWER)}) END AS altered FROM sums),
placed AS (SELECT *, row_number() OVER () AS num, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY grp) AS n FROM leaves),
own AS (SELECT grp, i, n, leaf AS h FROM placed),
{_tree_sql('low', 'own')},
subs AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n, h, grp AS name FROM low_tops),
{_tree_sql('high', 'subs')},
low_start AS (SELECT num, grp, i, '' AS proof, coalesce(altered, leaf) AS cur FROM placed),
{_path_sql('low_end', 'low', 'low_start')},
high_start AS (SELECT num, '' AS grp, i, proof, cur FROM low_end JOIN subs ON low_end.grp = subs.name),
{_path_sql('high_end', 'high', 'high_start')}
SELECT doc_id, leaf, subs.h AS subroot, high_tops.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = high_tops.h AS verified
FROM placed JOIN high_end USING (num) JOIN subs ON placed.grp = subs.name, high_tops"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_url_filters": op4_url_filters,
    "op5_html_extraction": op5_html_extraction,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_pieces": op11_pieces,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op6_substring_dedup": OP6_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_suffix_array_dedup": OP10_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
