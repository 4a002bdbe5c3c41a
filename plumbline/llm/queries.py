"""Queries over the driver tables: one for each operator of this subpackage, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import alignment, audio, bpe, codes, fmindex, html, langid, neighbours, packing, pii, quality, simhash, suffix
from .common import fold, table


def op1_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first", "first_doc_id")


def op2_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("doc_id", 3).alias("fold"))
    profiles = langid.learn(docs.filter("fold <> 1"))
    return langid.identify(docs.select("doc_id", "text", F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out")), profiles).drop("text").select("doc_id", "held_out", "lang_pred", "score")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op5_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_column(table(spark, sf_dir, "documents"), with_media=False)


def op7_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op9_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold("doc_id", 5) != 0)
    return quality.classify(docs, quality.learn(docs, labels)).drop("text").select("doc_id", "held_out", "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_label_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN).drop("groups")


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fmindex.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sparse_suffixes, op2_rank_order, op3_best_fit, op4_simhash, op5_skip_chain, op6_audio, op7_host_suffixes, op8_vantage_points, op9_byte_network, op10_bpe, op11_label_strings, op12_codebooks, op13_fm_index)}


#: All windows of 50 words, without suffixes: those that occur twice, united by document and by whether they come first.
PASSAGES = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
 g AS (SELECT doc_id, p, md5(array_to_string(a[p + 1 : p + 50], ' ')) AS h FROM (SELECT doc_id, a, unnest(range(0, greatest(len(a) - 49, 0))) AS p FROM w)),
 m AS (SELECT h, min(struct_pack(d := doc_id, p := p)) AS f FROM g GROUP BY h HAVING count(*) > 1),
 r AS (SELECT doc_id, p, f.d AS of, f.d = doc_id AND f.p = p AS first FROM g JOIN m USING (h)),
 i AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, first ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM r),
 u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first ORDER BY p) AS island FROM i)
SELECT doc_id, min(p)::BIGINT AS start_word, (max(p) + 50)::BIGINT AS end_word, (max(p) + 50 - min(p))::BIGINT AS n_words, first, min(of) AS first_doc_id FROM u GROUP BY doc_id, first, island
"""


#: All windows of 13 words, without an index: those that a smaller id has too, and the words that no such window covers.
WINDOWS = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
 g AS (SELECT doc_id, p, md5(array_to_string(a[p + 1 : p + 13], ' ')) AS h FROM (SELECT doc_id, a, unnest(range(0, greatest(len(a) - 12, 0))) AS p FROM w)),
 m AS (SELECT h, min(doc_id) AS d FROM g GROUP BY h),
 c AS (SELECT doc_id, list(DISTINCT p + o) AS gone FROM g JOIN m USING (h), range(1, 14) AS r(o) WHERE d < doc_id GROUP BY doc_id),
 k AS (SELECT doc_id, a, coalesce(gone, []) AS gone FROM w LEFT JOIN c USING (doc_id)),
 x AS (SELECT doc_id, string_agg(a[i], ' ' ORDER BY i) AS kept FROM (SELECT doc_id, a, unnest(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(gone, i))) AS i FROM k) GROUP BY doc_id)
SELECT doc_id, len(a)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN x USING (doc_id)
"""


#: Rank-order profiles: fold by crc32, n-grams of each distinct word, the most frequent ones of each document and language, and their places' distance.
PROFILES = rf"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
 d AS (SELECT doc_id, text, lang, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 3 AS fold FROM documents, bits),
 w AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM d) GROUP BY 1, 2),
 v AS (SELECT word, list_concat([0], list_transform(string_split(word, ''), lambda x: ord(x)::BIGINT), [0]) AS a FROM (SELECT DISTINCT word FROM w)),
 g AS (SELECT word, code, count(*) AS k FROM (SELECT word, unnest(list_concat(list_transform(range(2, len(a)), lambda i: {1 << 54} + a[i]), list_transform(range(1, len(a)), lambda i: {2 << 54} + a[i] * {1 << 18} + a[i + 1]),
   list_transform(range(1, len(a) - 1), lambda i: {3 << 54} + a[i] * {1 << 36} + a[i + 1] * {1 << 18} + a[i + 2]))) AS code FROM v) GROUP BY 1, 2),
 n AS (SELECT doc_id, code, sum(w.k * g.k) AS n FROM w JOIN g USING (word) GROUP BY 1, 2),
 own AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS r FROM n QUALIFY r <= {langid.TOP}),
 p AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, code) AS r FROM n JOIN d USING (doc_id) WHERE fold IS DISTINCT FROM 1 AND lang IS NOT NULL GROUP BY lang, code QUALIFY r <= {langid.TOP}),
 l AS (SELECT DISTINCT lang FROM p),
 away AS (SELECT doc_id, l.lang, sum(coalesce(abs(p.r - own.r), {langid.TOP})) AS far, count(*) AS n FROM own CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.code = own.code GROUP BY 1, 2),
 best AS (SELECT doc_id, arg_min(lang, {{'far': far, 'lang': lang}}) AS lang, list_sort(list(far)) AS f, any_value(n) AS n FROM away GROUP BY 1),
 s AS (SELECT doc_id, lang, f[1] AS a, CASE WHEN len(f) > 1 THEN f[2] ELSE {langid.TOP} * n END AS b FROM best)
SELECT doc_id, coalesce(fold = 1, false) AS held_out, coalesce(s.lang, 'und') AS lang_pred, CASE WHEN s.lang IS NULL THEN 0 WHEN a + b > 0 THEN b / (a + b)::DOUBLE ELSE 0.5 END AS score FROM d LEFT JOIN s USING (doc_id)
"""


def _codebooks(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """Each round as a table of its own: the entry of every part, then the floors of the means."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = [
        f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT vec_id, label, i, v[i * len(v) // {parts} + 1 : (i + 1) * len(v) // {parts}] AS x FROM e, range({parts}) AS r(i))",
        f"c0 AS (SELECT i, dense_rank() OVER (ORDER BY vec_id) - 1 AS j, x AS c FROM p QUALIFY j < {entries})",
    ]
    for r in range(rounds):
        sql.append(f"n{r} AS (SELECT p.i, arg_min(j, {{'d': {far}, 'j': j}}) AS j, any_value(x) AS x FROM p JOIN c{r} USING (i) GROUP BY vec_id, p.i)")
        sql.append(f"s{r} AS (SELECT i, j, k, floor(sum(x[k]) / count(*)::DOUBLE)::BIGINT AS m FROM n{r}, range(1, 65536) AS q(k) WHERE k <= len(x) GROUP BY ALL)")
        sql.append(f"m{r} AS (SELECT i, j, list(m ORDER BY k) AS c FROM s{r} GROUP BY i, j)")
        sql.append(f"c{r + 1} AS (SELECT c{r}.i, c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.i = m{r}.i AND c{r}.j = m{r}.j)")
    sql.append(f"z AS (SELECT vec_id, any_value(label) AS label, p.i, min({{'d': {far}, 'j': j}}) AS b FROM p JOIN c{rounds} USING (i) GROUP BY vec_id, p.i)")
    sql.append("y AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', b.j), '' ORDER BY i) AS code, sum(b.d)::BIGINT AS error FROM z GROUP BY vec_id)")
    return "WITH " + ",\n ".join(sql) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY i, j)) FROM c{rounds}) AS codebooks_sha256 FROM y"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sparse_suffixes": PASSAGES, "op2_rank_order": PROFILES, "op12_codebooks": _codebooks(), "op13_fm_index": WINDOWS}
