"""One query for each operator over its whole table, and its SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    fingerprints, knn_join, language_id, line_dedup, ngram_join, packing, pii, piece_codec, secret_scan, sharding, token_alignment, toxicity,
    vector_codes,
)
from .common import id_crc, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 4 == 2
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    found = language_id.identify_language(marked, docs.where(~held_out), keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc("doc_id") % 3 == 1
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scored = toxicity.score_toxicity(marked, docs, labels.where(~held_out), keep=("held_out",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_knn_join(spark, sf_dir):
    return knn_join.nearest_by_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def _digests(found, names):
    """Counts of the plain spans of each kind, a digest of them, and all spans as text."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in names]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op6_pii(spark, sf_dir):
    return _digests(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 1, with_ids=False).drop("ids")


def op9_piece_codec(spark, sf_dir):
    coded = piece_codec.encode_decode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_sharding(spark, sf_dir):
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_secret_scan(spark, sf_dir):
    return _digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS)


def op12_token_alignment(spark, sf_dir):
    docs, a, b = table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
    return token_alignment.align_tokens(docs, a, b, with_groups=False)[0]


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))[0]


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM reach JOIN links ON seen = a)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(seen) AS component_id
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP5_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, v.e)]) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

OP7_SQL = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
    SELECT doc_id, i, l[i:i + 2] AS w FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 0) + 1)) AS i FROM lines WHERE text IS NOT NULL)
    WHERE trim(array_to_string(l[i:i + 2], ''), ' ') <> ''
), ranked AS (
    SELECT doc_id, i, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi, row_number() OVER o AS r
    FROM windows WINDOW o AS (PARTITION BY w ORDER BY doc_id, i)
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(i, fi + 3) ELSE i END, i + 3)) AS p FROM ranked WHERE r > 1
), kept AS (
    SELECT t.doc_id, count(*) AS n, string_agg(t.l[t.i], chr(10) ORDER BY t.i) AS text
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines) t LEFT JOIN covered c ON c.doc_id = t.doc_id AND c.p = t.i
    WHERE c.p IS NULL GROUP BY t.doc_id
)
SELECT d.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(l), 0) - coalesce(k.n, 0) AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM lines d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_fingerprints, op3_ngram_join, op4_toxicity, op5_knn_join, op6_pii, op7_line_dedup, op8_packing,
        op9_piece_codec, op10_sharding, op11_secret_scan, op12_token_alignment, op13_vector_codes, pipeline,
    )
}
ORACLE_SQL = {"op3_ngram_join": OP3_SQL, "op5_knn_join": OP5_SQL, "op7_line_dedup": OP7_SQL}
