"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bwt_dedup, centroids, decontamination, metric_join, mixing, ppm, quality, relative_parse, secrets, simhash, token_codec, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_parse.parse(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_codec.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_codec.digest(token_codec.read(spark, files))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), literal=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row of its own for each document, also for those that share an id
    docs = table(spark, sf_dir, "documents").withColumn("row", F.struct("doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash")))
    copies = mixing.mix(docs, keep=("row",))
    return mixing.totals(copies, "row").select("doc_id", "size", "source_size", "target", "taken", "position")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near(table(spark, sf_dir, "documents"), size=4, threshold=4)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op4_token_output": op4_token_output,
    "op5_secret_scan": op5_secret_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op2_toxicity": op2_toxicity,
    "op9_ppm_scoring": op9_ppm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
}


def _clustering_sql(k: int, rounds: int, dims: int, scale: int) -> str:
    """Rounds of assignment and means as one chain of tables; a centroid is a list of integers."""
    components = "list_transform(embedding, lambda x: floor({} * x::DOUBLE)::BIGINT)".format(scale)
    parts = [
        f"p AS (SELECT vec_id, {components} AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM p ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance FROM p, c{i})")
        parts.append(f"a{i} AS (SELECT vec_id, v, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if i < rounds:
            sums = ", ".join(f"sum(v[{j}])::BIGINT" for j in range(1, dims + 1))
            means = "list_transform(s, lambda x: (x - ((x % n) + n) % n) // n)"
            parts.append(f"m{i} AS (SELECT cluster, {means} AS c FROM (SELECT cluster, count(*) AS n, [{sums}] AS s FROM a{i} GROUP BY cluster))")
            parts.append(f"c{i + 1} AS (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: SQL where it can express an operator; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS d, a AS m FROM e UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.m)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(x.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) x ON x.d = w.doc_id""",
    "op3_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS f FROM v GROUP BY h),
r AS (SELECT DISTINCT doc_id, i + k AS pos FROM v JOIN f USING (h), range(50) t(k) WHERE doc_id > f),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (SELECT p.doc_id, count(r.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (r.pos IS NULL) AS kept FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op13_centroid_clustering": _clustering_sql(k=16, rounds=3, dims=64, scale=64),
}
