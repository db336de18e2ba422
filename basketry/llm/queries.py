"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (
    alignment,
    bpe,
    hard_negatives,
    hmm,
    language,
    line_dedup,
    neighbours,
    packing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    toxicity,
)
from basketry.llm.common import LOWER, UPPER, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query(
    "op1_line_dedup",
    f"""WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(trim(line, {SQL_WHITE}), '{UPPER}', '{LOWER}') AS key FROM l),
        f AS (SELECT key AS common FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        j AS (SELECT k.*, common IS NOT NULL AS dropped FROM k LEFT JOIN f ON key = common)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


@query(
    "op2_substring_dedup",
    """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM s JOIN (SELECT w FROM s GROUP BY w HAVING count(*) > 1) USING (w)),
        p AS (SELECT d.doc_id, k.i, d.ws[k.i] AS word, last_value(r.i IGNORE NULLS) OVER (PARTITION BY d.doc_id ORDER BY k.i) AS near
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) k JOIN d USING (doc_id)
              LEFT JOIN r ON r.doc_id = k.doc_id AND r.i = k.i)
        SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
          FROM (SELECT *, near IS NOT NULL AND i - near < 35 AS gone FROM p) GROUP BY doc_id) USING (doc_id)""",
)
def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", sha256(F.col("kept_text")).alias("kept_sha256"))


@query("op3_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


@query("op5_nearest_neighbours")
def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op8_hidden_markov_scores")
def hmm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query("op6_simhash")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("_id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


@query(
    "op7_quality_rules",
    """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
              SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
        c AS (SELECT doc_id, sum(least(3, i - coalesce(before, i - 3)))::BIGINT AS n_repeat_words FROM (
              SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g WHERE n > 1) GROUP BY 1),
        m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        f AS (SELECT *, base_failed OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 20
                OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * greatest(n_lines, 1) AS failed FROM b),
        h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INTEGER)::DOUBLE AS k FROM f GROUP BY 1),
        o AS (SELECT sum(k) / sum(n) AS mean, coalesce(var_samp(k / n), 0) AS spread, avg(1 / n) AS inv, avg(n) AS size FROM h),
        v AS (SELECT mean, greatest(CASE WHEN e > 0 THEN mean * (1 - mean) / e - 1 ELSE 1 END, 1) AS weight FROM (
              SELECT mean, greatest(spread - mean * (1 - mean) * inv, mean * (1 - mean) / (size + 1)) AS e FROM o)),
        q AS (SELECT source, greatest(mean * weight, 1e-6) + k AS a, greatest((1 - mean) * weight, 1e-6) + n - k AS z FROM h, v),
        j AS (SELECT source, a / (a + z) - 2 * sqrt(a * z / ((a + z) * (a + z) * (a + z + 1))) > 0.9 AS rejected FROM q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
        FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source""",
)
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("host_rate")


def _slots_in_sql() -> str:
    """The filled table as a list, worked out without Spark."""
    digest = lambda shard, at, n: int(hashlib.md5(shard.encode()).hexdigest()[at : at + 8], 16) % n
    order = [(digest(s, 0, sharding.SLOTS), digest(s, 8, sharding.SLOTS - 1) + 1) for s in sharding.SHARDS]
    return "[" + ",".join(map(str, sharding.claim(order, sharding.SLOTS))) + "]"


@query(
    "op4_sharding",
    f"""WITH s AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
            % {sharding.SLOTS} AS slot FROM documents), o AS (SELECT {_slots_in_sql()} AS owner)
        SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM s, o""",
)
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


@query("op9_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op10_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"], as_bytes=True)
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query(
    "op11_hard_negatives",
    """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
              FROM r a JOIN r b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
        p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
          n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
        QUALIFY rank <= 3""",
)
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


@query("op12_cross_tokenizer")
def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(sha256(F.col("groups")))
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, *files, carry=["doc_id"], outputs=["groups"], digests={"groups_sha256": digest})


@query("op13_language")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), carry=["doc_id"])
