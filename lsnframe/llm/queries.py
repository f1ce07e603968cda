"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), piece_model(), limit=4096)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), piece_model())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.pii import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.language_id import predict

    return predict(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lsnframe.llm.decontamination import scan

    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
}

_OP10 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, s, bw.n, item FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE k > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[s] || ' ' || w[s + 1] END AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.t = y.t AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON m.id = d.doc_id
"""

_OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN m ON id = vec_id
"""

ORACLE_SQL: dict[str, str] = {"op4_embedding_dedup": _OP4, "op7_near_dedup": _OP7, "op6_substring_dedup": _OP6, "op10_decontamination": _OP10}
