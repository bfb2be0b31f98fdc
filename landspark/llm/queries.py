"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspark.llm import ann, decontaminate, exact_dedup, html_text, infill, jaccard, mixing, packing, pii, prefix_trie, quality, substrings, warc
from landspark.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).drop("payload", "url")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_rates(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.infill(infill.store_frames(table(spark, sf_dir, "documents"))))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_packing": op2_packing,
    "op3_jaccard": op3_jaccard,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_ann": op6_ann,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_html": op10_html,
    "op11_infill": op11_infill,
    "op12_decontaminate": op12_decontaminate,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op6_ann": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
""",
    "op9_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3.0::DOUBLE * source_size AS cap FROM s),
-- rounds of resharing: what is left of all words goes to the sources that are not capped yet
t(step, source, source_size, w, cap, target, capped) AS (
  SELECT 0, source, source_size, w, cap, 0.0::DOUBLE, FALSE FROM n
  UNION ALL
  SELECT step + 1, source, source_size, w, cap,
         CASE WHEN capped THEN cap ELSE least(cap, share) END, capped OR share >= cap
  FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w
                  / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS share FROM t)
  WHERE step < 60),
f AS (SELECT source, source_size, target, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 3.0) AS rate FROM t WHERE step = 60)
SELECT d.doc_id, d.size, f.source_size, f.target,
       (floor(rate)::BIGINT + (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate))::BIGINT) * d.size AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
""",
    "op11_infill": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
f AS (
  SELECT doc_id, t, n, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS x,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
""",
    "op12_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT r, p, size, item_id FROM dw JOIN bw USING (words, size)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, p, length(x)::BIGINT AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, p) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(text, '') AS x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS p
        FROM conversations WHERE conv_id IS NOT NULL)),
-- crc32 of the decimal id, bit by bit
cs AS (
  SELECT c, c - c % 100 AS base, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
hs AS (SELECT cs.*, least(cs.h, coalesce(b.n, 0)) AS g FROM cs LEFT JOIN cs b ON b.c = cs.base),
r AS (
  SELECT hs.c, t.i + 1 AS d, p, chars FROM hs JOIN t ON t.c = hs.base AND t.i < hs.g
  UNION ALL
  SELECT hs.c, hs.g + t.i - hs.h + 1, p, chars FROM hs JOIN t ON t.c = hs.c AND t.i >= hs.h),
k AS (SELECT c, d, chars, md5(string_agg(p, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM cs),
e AS (SELECT c, max_by(k, d) AS k FROM k GROUP BY c),
n AS (SELECT k, d, min(c) AS conv, count(*) AS members, any_value(chars) AS chars FROM k GROUP BY k, d),
up AS (SELECT n.k, u.k AS up, v.conv AS parent FROM n JOIN k u ON u.c = n.conv AND u.d = n.d - 1 JOIN n v ON v.k = u.k),
ch AS (SELECT up AS k, count(*) AS n_children FROM up GROUP BY up),
below AS (
  SELECT a.k, count(*) FILTER (WHERE ch.k IS NULL) AS n_leaves, sum((n.members - 1) * n.chars) AS saved
  FROM n JOIN k a ON a.c = n.conv AND a.d <= n.d LEFT JOIN ch ON ch.k = n.k GROUP BY a.k),
es AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM e GROUP BY k)
SELECT n.conv AS conv_id, n.d::BIGINT AS depth, up.parent AS parent_conv_id, n.members AS n_convs, coalesce(ch.n_children, 0) AS n_children, below.n_leaves,
       below.saved::BIGINT AS saved_tokens, coalesce(es.s, sha256('')) AS ends_sha256
FROM n JOIN below USING (k) LEFT JOIN up USING (k) LEFT JOIN ch USING (k) LEFT JOIN es USING (k)
""",
}
