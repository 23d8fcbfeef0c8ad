"""The queries of this subpackage: op1_ to op10_ and the pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import bpe, digest, licenses, lines, packing, quality, sharding, simhash, toxicity, warc
from larkspur.llm.common import read, scratch_path


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = bpe.Vocabulary.from_path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, words), words)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))
    base = F.col("failed").bitwiseAND(F.lit(quality.mask_of("v1"))) != 0
    return rows.select(
        F.col("r.doc_id").alias("doc_id"),
        *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        "kept",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy would keep of all documents without each of its rules, from the ledger's masks."""
    return quality.ablation(quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.summaries(spark, path)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    exact, spans = F.col("found.exact"), F.col("found.spans")
    base = F.sort_array(F.array_distinct(F.transform(exact, lambda x: x["label"])))
    likeness = F.transform(spans, lambda x: 1 - x["edits"] / x["notice_chars"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(F.transform(exact, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(exact, lambda x: x["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.transform(spans, lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(likeness), F.lit(0.0)), F.when(F.size(exact) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_rows(read(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model).select(F.col("r.doc_id").alias("doc_id"), "score")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op9_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.by_bytes(read(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "quality_ablation": quality_ablation,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_licenses": op5_licenses,
    "op6_lines": op6_lines,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_digests": op9_digests,
    "op10_shards": op10_shards,
    "pipeline": corpus_pipeline.run,
}

#: Measurements of the quality rules, as CTEs.
_MEASURES = """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x,
                          translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS y FROM documents),
        b AS (SELECT doc_id, replace(y, ' ', '') AS bare, list_filter(string_split(y, ' '), lambda w: w <> '') AS ws,
                     list_filter(string_split(x, chr(10)), lambda z: trim(z, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM t),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM b),
        g AS (SELECT doc_id, pos, lead(word, 7) OVER (PARTITION BY doc_id ORDER BY pos) AS eighth,
                     list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM w),
        r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g WHERE eighth IS NOT NULL),
        c AS (SELECT doc_id, sum(least(8, pos - coalesce(prev, pos - 8))) AS n_repeat_words
              FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM r WHERE n > 1) GROUP BY doc_id),
        m AS (SELECT b.doc_id, len(ws) AS n_words, length(bare) AS word_chars,
                     length(bare) - length(regexp_replace(bare, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
                     length(bare) - length(regexp_replace(bare, '\\p{Lu}+', '', 'g')) AS n_upper,
                     length(bare) - length(regexp_replace(bare, '\\p{Ll}+', '', 'g')) AS n_lower,
                     length(bare) - length(replace(bare, '!', '')) AS n_bangs,
                     len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_distinct(ws)) AS n_distinct_words,
                     coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM b LEFT JOIN c ON b.doc_id = c.doc_id)
"""


def _ablation_sql() -> str:
    def kept(names: tuple[str, ...]) -> str:
        return " AND ".join(f"NOT ({test})" for name, test in quality.RULES if name in names)

    cases = [(p, w, kept(tuple(n for n in names if n != w))) for p, names in quality.POLICIES.items() for w in (None, *names)]
    rows = [f"SELECT '{p}' AS policy, {repr(w) if w else 'NULL::VARCHAR'} AS without, count(*) FILTER ({test}) AS n_kept FROM m" for p, w, test in cases]
    return _MEASURES.replace("        m AS (", "        m AS MATERIALIZED (") + " UNION ALL ".join(rows)


SQL: dict[str, str] = {
    "quality_ablation": _ablation_sql(),
    "op2_quality": _MEASURES.rstrip() + """,
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT (base_failed OR 4 * n_symbols > n_words OR (n_upper > n_lower AND n_upper >= 20) OR 4 * n_bangs > n_words
                    OR (n_dup_lines > 5 AND 100 * n_dup_lines > 50 * n_lines) OR word_chars > 40 * n_words OR word_chars < 2 * n_words
                    OR (n_words >= 50 AND 20 * n_distinct_words < n_words AND n_distinct_words < 100)) AS kept
        FROM f
    """,
    "op10_shards": """
        WITH z AS (SELECT list(c ORDER BY k) AS tbl FROM (SELECT k, list_reduce(list_prepend(CAST(k AS UBIGINT), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
                      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END) AS c FROM range(256) r(k))),
        d AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 1 AS size FROM documents),
        s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM d),
        p AS (SELECT *, CAST(least(7, (upto - size // 2 - 1) * 8 // total) AS INTEGER) AS shard FROM s)
        SELECT doc_id, size, CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
                   list_transform(regexp_extract_all(hex(x), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
                   lambda c, b: xor(c // 256, tbl[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM p, z
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN least <> page_id THEN least END AS refers_to, true AS intact
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    "op6_lines": """
        WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        k AS (SELECT doc_id, pos, line,
                     translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> first, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
}
