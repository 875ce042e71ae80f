"""One query for each operator of this folder over its whole tables, and the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, conversations, decontam, jaccard, language, neardup, quality, records, sampling, templates, toxicity, training, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(_table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op6_jaccard_join"] = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWERED}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS ni
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common WHERE 100 * ni >= 90 * (na + nb - ni)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
    SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
), least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
), degree AS (SELECT a AS doc_id, count(*) AS n_links FROM edges GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id, coalesce(d.n_links, 0) AS n_links
FROM sets s LEFT JOIN least l USING (doc_id) LEFT JOIN degree d USING (doc_id)
"""

ORACLES["op10_decontamination"] = rf"""
WITH items AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, {_UPPER}, {_LOWERED}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)
), words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWERED}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), found AS (
    SELECT p.doc_id, p.i, p.size, v.item FROM places p JOIN windows v ON v.size = p.size AND v.win = array_to_string(p.w[p.i : p.i + p.size - 1], ' ')
), hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@_query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = records.write(docs, records.new_folder(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return records.read(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@_query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


ORACLES["op2_url_rules"] = f"""
WITH rules(rh, rp, rv) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}
), tails AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), {_UPPER}, {_LOWERED}) AS host,
        regexp_extract(substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM tails
), fits AS (
    SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
    FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
    GROUP BY ALL
)
SELECT page_id, p.host, p.path, rule, coalesce(rv, 'allow') AS verdict FROM parts p LEFT JOIN fits USING (host, path)
"""


@_query
def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_edited(_table(spark, sf_dir, "documents"))


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", training.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def _classified(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", training.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _classified(toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))), 0.5)


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _classified(quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels"))), 0.3)


@_query
def op4_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(_table(spark, sf_dir, "pages"))


@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = conversations.ordered(_table(spark, sf_dir, "conversations"))
    return conversations.trie(*conversations.spliced(turns, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5))


ORACLES["op12_prefix_trie"] = """
WITH hex AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), plan AS (
    SELECT c, n, c - c % 100 AS donor,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
    FROM (SELECT c, count(*) AS n FROM own GROUP BY c), hex
), shares AS (SELECT p.c, p.n, p.donor, p.h, least(p.h, coalesce(d.n, 0)) AS got FROM plan p LEFT JOIN plan d ON d.c = p.donor
), rebuilt AS (
    SELECT s.c, o.pos, o.role, o.text FROM shares s JOIN own o ON o.c = s.donor AND o.pos <= s.got
    UNION ALL SELECT s.c, o.pos - s.h + s.got, o.role, o.text FROM shares s JOIN own o ON o.c = s.c AND o.pos > s.h
), prefixes AS (
    SELECT c, 0 AS depth, 0 AS chars, '' AS prefix FROM shares
    UNION ALL SELECT c, pos, length(text), sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) OVER w) FROM rebuilt
    WINDOW w AS (PARTITION BY c ORDER BY pos)
), nodes AS (
    SELECT depth, prefix, min(c) AS name, count(*) AS n_convs, max(chars) AS chars FROM prefixes GROUP BY ALL
), path AS (
    SELECT p.c, n.* FROM prefixes p JOIN nodes n USING (depth, prefix)
), own_path AS (SELECT * FROM path WHERE c = name
), edges AS (
    SELECT o.depth, o.name, u.name AS parent FROM own_path o JOIN path u ON u.c = o.c AND u.depth = o.depth - 1
), children AS (SELECT depth - 1 AS depth, parent AS name, count(*) AS n_children FROM edges GROUP BY ALL
), valued AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.chars AS saved FROM nodes n LEFT JOIN children k USING (depth, name)
), sums AS (
    SELECT u.depth, u.name, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM valued v JOIN path u ON u.c = v.name AND u.depth <= v.depth GROUP BY ALL
), lengths AS (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c
), ended AS (
    SELECT l.depth, p.name, string_agg(l.c::VARCHAR, ',' ORDER BY l.c) AS ids FROM lengths l JOIN path p ON p.c = l.c AND p.depth = l.depth GROUP BY ALL
)
SELECT v.name AS conv_id, v.depth::BIGINT AS depth, e.parent AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM valued v JOIN sums s USING (depth, name) LEFT JOIN edges e USING (depth, name) LEFT JOIN ended x USING (depth, name)
"""


@_query
def op13_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.keep_one(_table(spark, sf_dir, "embeddings"), 0.93)


ORACLES["op13_near_embeddings"] = """
WITH RECURSIVE given AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
    SELECT r, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM given
    WHERE label IS NOT NULL AND v IS NOT NULL AND list_count(v) = len(v) AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reach(r, other) AS (
    SELECT a, b FROM links UNION SELECT x.r, l.b FROM reach x JOIN links l ON x.other = l.a
), least AS (
    SELECT x.r, min(g.vec_id) AS vec_id FROM reach x JOIN given g ON g.r = x.other GROUP BY x.r
), degree AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT g.vec_id, coalesce(d.n_links, 0) AS n_links, least(g.vec_id, l.vec_id) AS component_id,
    g.vec_id IS NOT DISTINCT FROM least(g.vec_id, l.vec_id) AS kept
FROM given g LEFT JOIN least l USING (r) LEFT JOIN degree d USING (r)
"""
