"""The queries opN_<name> of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_documents(spark, sf_dir)).drop("kept_text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir)).drop("bucket", "link")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_documents(spark, sf_dir)).drop("kept_text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(_documents(spark, sf_dir))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).drop("source")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_exact_dedup, op3_pieces, op4_pii, op5_substring_dedup, op6_token_counts, op7_lm_scores, op8_decontaminate, op9_simhash, op10_toxicity, op11_mixing, op12_divergence, op13_resampling)}

_OP2 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_OP11 = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT) AS h FROM sized),
sums AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM hashed GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
totals AS (SELECT *, sum(source_size) OVER () AS everything,
    sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - source_size AS sizes_before,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS weights_from FROM weighed),
stopping AS (SELECT *, (3 * everything - 4 * sizes_before) * weight >= 4 * source_size * weights_from AS stops FROM totals),
aims AS (SELECT source, source_size, CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * (3 * everything - 4 * coalesce(sum(source_size) FILTER (stops) OVER (), 0)) AS DOUBLE) / CAST(2 * sum(weight) FILTER (NOT stops) OVER () AS DOUBLE) END AS target FROM stopping),
placed AS (SELECT doc_id, size, h, CAST(source_size AS BIGINT) AS source_size, target, CASE WHEN source_size > 0 THEN floor(target / CAST(source_size AS DOUBLE)) ELSE 0 END AS times,
    CAST(sum(size) OVER (PARTITION BY hashed.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS up_to
    FROM hashed JOIN aims ON hashed.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN up_to - size + size / 2.0 < target - times * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
by_row AS (SELECT row, lang, source, term, count(*) AS n FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM by_row GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, sum(n) AS n FROM by_row SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (CAST(t.total AS HUGEINT) + 5 * l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (CAST(l.total AS HUGEINT) + 5 * l.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_OP13 = r"""
WITH crc AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
octets AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM found UNION SELECT word FROM aim)),
bucketed AS (SELECT word, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM octets, crc),
s AS (SELECT bucket, count(*) AS n FROM found JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN bucketed USING (word) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000) AS DOUBLE) / CAST((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT row, count(*) AS n_features, sum(gain) AS total FROM found JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY row),
w AS (SELECT row, doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight FROM d LEFT JOIN sums USING (row)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN rank <= 10 * n // 100 THEN rank END AS BIGINT) AS rank FROM x LEFT JOIN r USING (row)
"""

SQL = {"op2_exact_dedup": _OP2, "op11_mixing": _OP11, "op12_divergence": _OP12, "op13_resampling": _OP13}
