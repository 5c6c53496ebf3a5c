"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import exact, jaccard, mixing, packing, quality, secret_scan, token_counts, toxicity, vectors, warc
from kinforge.llm.runtime import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 5, 2, 1 takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by three-word shingles at a Jaccard similarity of 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, share=(9, 10)).drop("text_hash")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the byte-level tokenizer."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of trusted text, and whether their language's threshold lets them pass."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return judged.select("doc_id", "lang", "n_grams", "perplexity", "threshold", "good")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "difference")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_ngram_jaccard, op4_warc, op5_embeddings, op6_token_counts, op7_exact_dedup, op8_quality, op9_toxicity, op10_secrets)}

ORACLE_SQL = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS sk,
        CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST(1 + length(regexp_replace(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'), '[^\p{L}]+', '', 'g')) AS DOUBLE)
          / (1 + length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))) AS quality,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
      FROM d),
k AS (SELECT *, -ln(u) / quality AS key FROM r),
s AS (SELECT sk, source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nth FROM s),
w AS (SELECT *, [5, 2, 1][nth % 3 + 1] AS weight, source_size * 3 AS cap FROM n),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS open_words, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weights
      FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * open_weights <= weight * open_words AS capped FROM o),
t AS (SELECT sk, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE CAST(weight * max(open_words) FILTER (NOT capped) OVER () AS DOUBLE) / max(open_weights) FILTER (NOT capped) OVER () END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.sk ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN e USING (sk))
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN rest > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    "op5_embeddings": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, CASE WHEN len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0 THEN e END AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM g UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(k.n), 0) AS BIGINT) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN k USING (vec_id) GROUP BY vec_id""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
