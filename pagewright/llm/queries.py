"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

from . import bpe_documents, chat_format, embedding_links, exact_dedup, filter_audit, fingerprints, heap_lloyd, language_id, mixing, near_dedup, secret_scan, token_counts, token_files
from .storage import shared_path, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.chat_digest(chat_format.format_chats(rows))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_documents.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = shared_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.token_checksums(token_files.read_tokens(spark, path))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return heap_lloyd.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_links.vector_links(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_near_dedup, op2_language_id, op3_chat_format, op4_mixing, op5_bpe, op6_exact_dedup, op7_fingerprints),
        *(op8_token_files, op9_token_counts, op10_secret_scan, op11_vector_codes, op12_filter_audit, op13_embedding_dedup),
    )
}

_CHATS = """(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')""".replace("\\\\", "\\")


def _rounds(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds in SQL: components, entries, then a table of assignments and one of entries a round."""
    told = rf"""v AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, (i - 1) * {parts} // len(embedding) AS part, i AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {entries}),
        e0 AS MATERIALIZED (SELECT part, entry, pos, v AS c FROM x JOIN s USING (vec_id))"""
    for k in range(rounds + 1):
        told += f""",
        a{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT vec_id, x.part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN e{k} e ON x.part = e.part AND x.pos = e.pos GROUP BY ALL) GROUP BY ALL)"""
        if k < rounds:
            told += f""",
        m{k} AS (SELECT x.part, a.best.entry AS entry, pos, sum(v) AS t, count(*) AS n FROM x JOIN a{k} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL),
        e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, e.pos, CASE WHEN n IS NULL THEN c ELSE (t - ((t % n) + n) % n) // n END AS c FROM e{k} e LEFT JOIN m{k} m ON e.part = m.part AND e.entry = m.entry AND e.pos = m.pos)"""
    return told


ORACLES: dict[str, str] = {
    "op3_chat_format": rf"""
        WITH t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                4 + length(role) + 2 + length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '</', ''))) // 2
                + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda r: length(r) - 1)), 0) + 8 AS chars
            FROM {_CHATS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, role = 'assistant' OR i = n AS example FROM t)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(upto) FILTER (example) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (example) AS BIGINT) AS n_examples
        FROM e GROUP BY conv_id""",
    "op4_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS u FROM documents),
        a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, sum(source_size) OVER () * 1.5::DOUBLE AS spend, source_size * 2.0::DOUBLE AS cap FROM a),
        c AS (SELECT *, ([5.0, 2.0, 1.0])[CAST((place - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM b),
        l AS (SELECT *, (spend - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
            row_number() OVER (ORDER BY cap / weight, place) AS o FROM c),
        f AS (SELECT min(o) AS o, arg_min(level, o) AS level FROM l WHERE cap / weight > level),
        t AS (SELECT l.source, source_size, place, spend, CASE WHEN f.o IS NULL OR l.o < f.o THEN cap ELSE f.level * weight END AS target FROM l, f),
        r AS (SELECT d.*, source_size, place, spend, target, sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS ends FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT doc_id, u, size, place, spend, 1 AS copy, ends / target AS finish FROM r WHERE size > 0 UNION ALL SELECT doc_id, u, size, place, spend, 2, (ends + source_size) / target FROM r WHERE size > 0),
        k AS (SELECT doc_id, count(*) AS copies FROM (SELECT *, sum(size) OVER (ORDER BY finish, place, u, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM q) WHERE upto <= spend GROUP BY doc_id)
        SELECT r.doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM r LEFT JOIN k ON r.doc_id = k.doc_id""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents),
        g AS (SELECT doc_id, plain, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w AS place FROM n WINDOW w AS (PARTITION BY plain ORDER BY length(text) DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM g""",
    "op11_vector_codes": rf"""
        WITH {_rounds()},
        r AS (SELECT vec_id, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
        SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM e6) AS codebooks_sha256
        FROM v JOIN r ON v.vec_id = r.vec_id""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM t),
        f AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(again, false)] AS f FROM w),
        g AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
            FROM f LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON f.doc_id = l.id GROUP BY ALL),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c1.x || d.x || e.x AS filter_order FROM c a, c b, c c1, c d, c e WHERE a.x NOT IN (b.x, c1.x, d.x, e.x) AND b.x NOT IN (c1.x, d.x, e.x) AND c1.x NOT IN (d.x, e.x) AND d.x <> e.x),
        p AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda s: f[ascii(filter_order[s]) - 64]) AS fails FROM g, o),
        q AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step, coalesce(fails[1], 6) AS first FROM p),
        r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(sum(n) FILTER (first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed, coalesce(sum(n) FILTER (first < step AND list_contains(fails, step)), 0) AS redundant,
                coalesce(sum(n) FILTER (fails = [step]), 0) AS unique_fails, coalesce(sum(n) FILTER (first = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0) AS toxic_lost FROM q GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r""",
    "op13_embedding_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * (a.size * b.size)),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""",
}
