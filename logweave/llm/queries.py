"""The registered queries of this package: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, kneser_ney, lang_id, line_dedup, mixing, simhash, substring_dedup, token_counts, toxicity
from .common import documents, fold


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 1
    scored = kneser_ney.score(docs, kneser_ney.fit(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled rows of ``docs`` outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.withColumns({c: F.round(c, 9) for c in ("weight", "exponent")})


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    model = lang_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return lang_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(documents(spark, sf_dir))
    return found.withColumn("has_repeats", (F.col("n_repeated") > 0) | (F.col("n_shared") > 0))


#: SQL text, with the white space of the contracts spelt out.
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS first_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.first_doc AS lost FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op5_mixing": r"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
        s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM t GROUP BY source),
        pp AS (SELECT list(CAST(total AS DOUBLE) / whole) AS p, ln(count(*)) * 0.9999 AS aim, max(whole) AS whole
            FROM (SELECT total, sum(total) OVER () AS whole FROM s WHERE total > 0)),
        e1(i, lo, hi, ok) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(2 AS DOUBLE), false UNION ALL
            SELECT i + 1, CASE WHEN h >= aim THEN mid ELSE lo END, CASE WHEN h >= aim THEN hi ELSE mid END, i = 0 AND h >= aim FROM (
                SELECT i, lo, hi, mid, aim, ln(z) - list_sum(list_transform(p, lambda x : pow(x, mid) * ln(pow(x, mid)))) / z AS h FROM (
                    SELECT i, lo, hi, (lo + hi) / 2 AS mid, p, aim, list_sum(list_transform(p, lambda x : pow(x, (lo + hi) / 2))) AS z FROM e1, pp WHERE i < 51 AND NOT ok))),
        a1 AS (SELECT CASE WHEN ok THEN 1.0 ELSE lo END AS a FROM e1 ORDER BY i DESC LIMIT 1),
        e2(i, lo, hi, ok) AS (SELECT -1, a, a, false FROM a1 UNION ALL
            SELECT i + 1, CASE WHEN i < 0 OR r <= 1.25 THEN lo ELSE mid END, CASE WHEN i < 0 THEN CASE WHEN r <= 1.25 THEN hi ELSE 1.0 END WHEN r <= 1.25 THEN mid ELSE hi END, i < 0 AND r <= 1.25 FROM (
                SELECT i, lo, hi, mid, list_max(list_transform(p, lambda x : pow(x, mid) / x)) / z AS r FROM (
                    SELECT i, lo, hi, (lo + hi) / 2 AS mid, p, list_sum(list_transform(p, lambda x : pow(x, (lo + hi) / 2))) AS z FROM e2, pp WHERE i < 50 AND NOT ok))),
        a2 AS (SELECT hi AS a FROM e2 ORDER BY i DESC LIMIT 1),
        w AS (SELECT source, total, n, x / sum(x) OVER () AS weight, a FROM (SELECT source, total, n, a, pow(CAST(total AS DOUBLE) / whole, a) AS x FROM s, pp, a2 WHERE total > 0)),
        q AS (SELECT source, weight, a, CAST(ceil(n / 4096) AS BIGINT) AS n_blocks, total, CAST(round(weight * whole) AS BIGINT) AS quota FROM w, pp),
        d AS (SELECT t.doc_id, t.source, tokens, weight, a, quota // total AS passes, quota % total AS rest,
            CAST('0x' || substr(md5('1:' || coalesce(doc_id, -9223372036854775808)), 1, 15) AS BIGINT) % coalesce(n_blocks, 1) AS block,
            CAST('0x' || substr(md5('2:' || coalesce(doc_id, -9223372036854775808)), 1, 15) AS BIGINT) AS place FROM t LEFT JOIN q ON t.source = q.source),
        f AS (SELECT *, CAST('0x' || substr(md5('3:' || source || ':' || block), 1, 15) AS BIGINT) AS turn FROM d),
        b AS (SELECT source, turn, block, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT source, turn, block, sum(tokens) AS size FROM f GROUP BY source, turn, block)),
        g AS (SELECT source, turn, block, place, doc_id, tokens, coalesce(sum(size) OVER (PARTITION BY source, turn, block ORDER BY place, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
            FROM (SELECT source, turn, block, place, doc_id, tokens, sum(tokens) AS size FROM f GROUP BY source, turn, block, place, doc_id, tokens))
        SELECT f.doc_id, f.source, f.tokens, round(coalesce(weight, 0), 9) AS weight,
            CAST(coalesce(passes, 0) + CASE WHEN b.before < rest AND b.before + g.inside < rest THEN 1 ELSE 0 END AS BIGINT) AS copies, round(coalesce(a, 1.0), 9) AS exponent, f.turn, f.block, f.place
        FROM f JOIN b USING (source, turn, block) JOIN g ON g.source = f.source AND g.turn = f.turn AND g.block = f.block AND g.place = f.place AND g.tokens = f.tokens AND g.doc_id IS NOT DISTINCT FROM f.doc_id""",
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, {_NORMAL} AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, arg_max(doc_id, (n_chars, -doc_id)) AS keep_id FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
