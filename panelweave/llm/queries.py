"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quant, bpe, byte_bpe, collocations, exact_dedup, html_text, license_scan, minhash, packing, pii, quality, toxicity, turn_trie
from .common import table

#: The vocabulary files of the BPE and packing queries.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).withColumn("expressions", F.array_join("expressions", "; "))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quant.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20, measure="ip")


def op4_pack_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    digest = F.sha2(pii.spans_text(base).cast("binary"), 256)
    more = count(pii.SECRET), F.size(F.filter("spans", lambda s: s["kind"].startswith("term_"))).cast("long").alias("n_term")
    return found.select("doc_id", *map(count, pii.KINDS), digest.alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), *more)


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract_text(table(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return coded.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, lengths=(2, 5), top=2000, percent=100)


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_byte_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_additive_quantisation": op3_additive_quantisation,
    "op4_pack_concat_cut": op4_pack_concat_cut,
    "op5_pii_disclosure": op5_pii_disclosure,
    "op6_html_layout": op6_html_layout,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_quality_ranking": op8_quality_ranking,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_setm_collocations": op11_setm_collocations,
    "op12_turn_trie": op12_turn_trie,
    "op13_byte_bpe_replay": op13_byte_bpe_replay,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                     ELSE list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])) END AS sh FROM w),
        c AS (SELECT sh, MIN(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
        x AS (SELECT id, n, unnest(sh) AS g FROM c),
        p AS (SELECT a.id AS a, b.id AS b, COUNT(*) AS k, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb
              FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
        r AS (SELECT id AS node, id AS seen FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
        m AS (SELECT node, MIN(seen) AS component FROM r GROUP BY node)
        SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
        FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN m ON m.node = c.id
    """,
    "op11_setm_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        n AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ph FROM w, range(1, 6) x(k) WHERE len(ws) >= k),
        f AS (SELECT lang, ph, len(ph) AS k, COUNT(*) AS a FROM g GROUP BY lang, ph HAVING COUNT(*) >= 100),
        s AS (SELECT lang, ph[i:i + j - 1] AS ph, MAX(a) AS a FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM f)) GROUP BY 1, 2),
        c AS (SELECT f.*, unnest(range(1, f.k)) AS j FROM f LEFT JOIN s USING (lang, ph) WHERE f.k >= 2 AND (s.a IS NULL OR 100 * s.a < 100 * f.a)),
        e AS (SELECT c.lang, array_to_string(c.ph, ' ') AS phrase, c.a, x.a AS l, y.a AS r, n.n, CAST(1000::HUGEINT * c.a * n.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score,
                     row_number() OVER (PARTITION BY c.lang, c.ph ORDER BY 1000::HUGEINT * c.a * n.n // (x.a::HUGEINT * y.a), c.j) AS pick
              FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[:c.j] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[c.j + 1:] JOIN n ON n.lang = c.lang),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e WHERE pick = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
    """,
    # crc32 bit by bit; turns by 128 bits of SHA-256
    "op12_turn_trie": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        i AS (SELECT conv_id, turn, sha256(strlen(r) || ':' || r || x) AS s, strlen(x) AS b FROM t),
        o AS (SELECT conv_id, list({'s': s[:32], 'b': b} ORDER BY turn NULLS FIRST, s) AS own FROM i GROUP BY conv_id),
        h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                  lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h FROM o),
        c AS (SELECT h.conv_id, list_concat(coalesce(o.own, [])[:h.h], h.own[h.h + 1:]) AS q FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
        m AS (SELECT conv_id, len(q) AS n, unnest(range(0, len(q) + 1)) AS d, q FROM c),
        p AS (SELECT list_transform(q[:d], lambda e: e.s) AS k, d, conv_id, n = d AS ends, CASE WHEN d > 0 THEN q[d].b ELSE 0 END AS b FROM m),
        g AS (SELECT k, d, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(b) AS b, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM p GROUP BY k, d),
        w AS (SELECT k[:len(k) - 1] AS k, COUNT(*) AS n FROM g WHERE d > 0 GROUP BY 1),
        f AS (SELECT g.*, coalesce(w.n, 0) AS n_children FROM g LEFT JOIN w ON g.k = w.k),
        a AS (SELECT k[:j] AS k, COUNT_IF(n_children = 0) AS n_leaves, SUM((n_convs - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) GROUP BY 1)
        SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
        FROM f JOIN a ON a.k = f.k LEFT JOIN g u ON f.d > 0 AND u.k = f.k[:len(f.k) - 1]
    """,
}
