"""The operators of this subpackage as queries over whole driver tables, with
their production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, html_text, minhash, packing, pieces, quality, repetition, resampling, runs, secret_scan,
               simhash, toxicity, warc)
from .common import scratch, table

#: Vocabulary file of a public tokenizer; every executor must see it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, rebuild every record from the archive and measure it."""
    path = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, path)
    return warc.rebuilt(warc.read_archive(spark, path, dict(pages.dtypes)["page_id"])).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit_tables(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit_tables(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(pieces.counted(table(spark, sf_dir, "documents"), PIECE_MODEL), F.col("n_tokens"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judged(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a run in every tenth text, by crc32 of the id: from word a on, a
    stretch of p words is repeated to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    bare = F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"),
                       F.when((h % 10 == 0) & (bare != ""), F.split(bare, "[\\x20\\x09-\\x0D]+")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("int(g % n)")).withColumn(
        "p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    text = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(text).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic(planted(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                max_n=1, buckets=10_000, min_words=20, share=10, seed="2024").drop("n_words")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_simhash, op3_quality, op4_exact_dedup, op5_toxicity, op6_packing,
                            op7_quality_rules, op8_secret_scan, op9_sentencepiece, op10_html_text,
                            op11_periodic_runs, op12_resampling, op13_minhash)}

# CRC-32 in SQL: its table from the rule, then one step per byte.
_CRC_TABLE = """
        crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_concat([i], range(0, 8)), lambda c, x:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(0, 256) r(i)))"""


def _crc32(x: str) -> str:
    code = f"hex(encode({x}))"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length({code}) // 2), lambda i: "
            f"('0x' || substr({code}, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8)))")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS x,
                     min(page_id) OVER (PARTITION BY body) AS low FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM low THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
        FROM h""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_periodic_runs": rf"""
        WITH {_CRC_TABLE.strip()},
        d AS (SELECT doc_id, words, len(words) AS n, h, h // 10 AS g FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words,
                   {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc)),
        planted AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i:
                words[1 + CASE WHEN i < g % n THEN i ELSE
                    g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE words END AS words FROM d),
        w AS MATERIALIZED (SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM planted),
        grams AS MATERIALIZED (SELECT doc_id, n, i, hash(word, {", ".join(f"lead(word, {k}) OVER t" for k in range(1, 8))}) AS x
            FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY i) QUALIFY i + 8 <= n),
        same AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM grams a JOIN grams b
            ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
        islands AS (SELECT doc_id, p, min(i) AS s, count(*) + 7 + p AS length FROM (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same)
            GROUP BY doc_id, p, island HAVING count(*) + 7 + p >= greatest(24, 3 * p)),
        runs AS MATERIALIZED (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY doc_id, s, length ORDER BY p) = 1),
        told AS (SELECT doc_id, count(*) AS n_runs,
                first({{'s': s, 'l': length, 'p': p}} ORDER BY length::DOUBLE / p DESC, s, p) AS best,
                sha256(string_agg(s || ',' || length || ',' || p || chr(10), '' ORDER BY s, p)) AS runs_sha256
            FROM runs GROUP BY doc_id),
        kept AS (SELECT doc_id, sha256(coalesce(string_agg(word, ' ' ORDER BY i), '')) AS collapsed_sha256 FROM w
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.p AND w.i < r.s + r.length)
            GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length,
               best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
               coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
        FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_resampling": rf"""
        WITH {_CRC_TABLE.strip()},
        d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        dw AS MATERIALIZED (SELECT doc_id, unnest(words) AS word FROM d),
        bw AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
               FROM benchmark),
        places AS MATERIALIZED (SELECT word, {_crc32("word")} % 10000 AS bucket
               FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
        s AS (SELECT bucket, count(*) AS s FROM dw JOIN places USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN places USING (word) GROUP BY bucket),
        gains AS MATERIALIZED (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE
                   * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE
                   * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
               FROM range(0, 10000) b(bucket) LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
        means AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
               FROM dw JOIN places USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT
                       + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
               FROM d LEFT JOIN means ON means.doc_id = d.doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
                   10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND r <= drawn THEN r END AS rank FROM ranked""",
    "op13_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, words, len(words) AS n FROM (
            SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) AS words FROM documents)),
        sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN n = 0 THEN [] ELSE
                list_transform(range(0, greatest(1, n - 3)), lambda i: array_to_string(words[i + 1:i + 4], ' ')) END) AS x FROM d),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM sh GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id),
        links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * c >= 80 * (p.size + q.size - c)),
        ends AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b)
        SELECT d.doc_id, coalesce(size, 0)::BIGINT AS n_shingles, low AS component_id, d.doc_id = low AS kept
        FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
        JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id""",
}
