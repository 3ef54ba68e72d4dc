"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, exact_dedup, langid, mixing, periodic_runs, permutation_index, quotation, simhash, substring_dedup, toxicity, url_filter, warc
from ._base import BATCHES, options, scratch, staged, table
from ._sample import remainder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))[1]


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.membership(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def public_vocabulary() -> tuple[bytes, str]:
    """The rank file that the contract names, and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), *public_vocabulary())
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.membership(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 4)
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 5)
    found = langid.predict(docs, langid.train(docs, fold != 0))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op9_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.linked(table(spark, sf_dir, "conversations"))


def chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of operator 9 as chat markup."""
    return quotation.formatted(table(spark, sf_dir, "conversations"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: host, start of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_of(spark, RULES))


def with_repeats(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting of a tenth of the documents, as places in the original words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(table(spark, sf_dir, "documents"), with_repeats)
    # Runs come by start, then period, so of equal exponents the first stays.
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _whole(query):
    """The query's rows as a table: its plans run here, with the options that bound batches of
    texts, and the other tables that it made go."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with options(spark, BATCHES), scratch() as kept:
            found = staged(query(spark, sf_dir), query.__name__)
            kept.append(found)
        return found

    return run


QUERIES = {
    "op1_warc": _whole(op1_warc),
    "op2_exact_dedup": _whole(op2_exact_dedup),
    "op3_permutation_index": _whole(op3_permutation_index),
    "op4_bpe": _whole(op4_bpe),
    "op5_simhash": _whole(op5_simhash),
    "op6_mixing": _whole(op6_mixing),
    "op7_toxicity": _whole(op7_toxicity),
    "op8_langid": _whole(op8_langid),
    "op9_quotation": _whole(op9_quotation),
    "op10_substring_dedup": _whole(op10_substring_dedup),
    "op11_divergence": _whole(op11_divergence),
    "op12_url_filter": _whole(op12_url_filter),
    "op13_periodic_runs": _whole(op13_periodic_runs),
    "chat_threads": _whole(chat_threads),
}

ORACLE = {
    "op9_quotation": r"""
        WITH RECURSIVE base AS (
          SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM conversations),
        numbered AS (
          SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS id,
                 len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[ \t]{0,3}(?:>[ \t]?)+'))) > 0 AS quoted
          FROM base),
        bodies AS (
          SELECT *, string_split(text, chr(10)) AS lines FROM numbered),
        messages AS (
          SELECT id, conv_id, turn, role, quoted, lines,
                 CASE WHEN quoted THEN regexp_replace(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i:
                        NOT regexp_matches(lines[i], '^[ \t]{0,3}(?:>[ \t]?)+')
                        AND NOT (regexp_matches(lines[i], '(?i)^(?:on .* wrote|le .* a écrit|am .* schrieb .*|el .* escribió|.{1,60} (?:wrote|said)):[ \t]*$')
                                 AND coalesce(regexp_matches(lines[i + 1], '^[ \t]{0,3}(?:>[ \t]?)+'), false))),
                        lambda i: lines[i]), chr(10)), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')
                      ELSE text END AS body
          FROM bodies),
        split AS (SELECT id, conv_id, turn, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM messages WHERE quoted),
        levels AS (
          SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]{0,3}(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
                 substr(line, length(regexp_extract(line, '^[ \t]{0,3}(?:>[ \t]?)+')) + 1) AS rest
          FROM split),
        changes AS (SELECT *, CASE WHEN level <> lag(level) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS changed FROM levels),
        runs AS (SELECT *, sum(changed) OVER (PARTITION BY id ORDER BY pos) AS run FROM changes),
        passages AS (
          SELECT id, conv_id, turn, run, level, string_agg(rest, chr(10) ORDER BY pos) AS passage
          FROM runs WHERE level > 0 GROUP BY ALL),
        units AS (
          SELECT id, conv_id, turn, run, level, 0 AS kind, 1 AS pos, passage AS unit FROM passages
          UNION ALL SELECT id, conv_id, turn, run, level, 1, unnest(range(1, 1 + len(regexp_split_to_array(passage, '\n[ \t]*\n')))),
                           unnest(regexp_split_to_array(passage, '\n[ \t]*\n')) FROM passages
          UNION ALL SELECT id, conv_id, turn, run, level, 2, unnest(range(1, 1 + len(string_split(passage, chr(10))))),
                           unnest(string_split(passage, chr(10))) FROM passages),
        quotes AS (
          SELECT *, trim(regexp_replace(lower(unit), '[\x00-\x20]+', ' ', 'g')) AS norm FROM units
          WHERE trim(regexp_replace(lower(unit), '[\x00-\x20]+', ' ', 'g')) <> ''),
        held AS (
          SELECT conv_id, turn, trim(regexp_replace(lower(unit), '[\x00-\x20]+', ' ', 'g')) AS norm
          FROM (SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n[ \t]*\n'), string_split(body, chr(10)))) AS unit
                FROM messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
        own AS (SELECT norm, conv_id, min(turn) AS own_turn FROM held GROUP BY ALL),
        firsts AS (SELECT norm, f[1] AS f, f[2] AS g FROM (SELECT norm, min({'conv': conv_id, 'turn': own_turn}, 2) AS f FROM own GROUP BY ALL)),
        found AS (
          SELECT q.*, own_turn < q.turn AS near,
                 CASE WHEN own_turn < q.turn THEN {'conv': q.conv_id, 'turn': own_turn}
                      WHEN len(string_split(q.norm, ' ')) < 3 THEN NULL
                      WHEN f.conv <> q.conv_id THEN f WHEN f.conv = q.conv_id THEN g END AS original
          FROM quotes q LEFT JOIN own ON own.norm = q.norm AND own.conv_id = q.conv_id LEFT JOIN firsts ON firsts.norm = q.norm),
        links AS (
          SELECT id, count(DISTINCT run) AS n_quotes, count(DISTINCT run) FILTER (original IS NOT NULL) AS n_linked,
                 arg_min(original, {'a': level, 'b': run, 'c': NOT coalesce(near, false), 'd': kind, 'e': pos}) FILTER (original IS NOT NULL) AS reply
          FROM found GROUP BY id),
        joined AS (SELECT DISTINCT conv_id AS a, reply.conv AS b FROM messages JOIN links USING (id) WHERE reply.conv < conv_id),
        reach AS (
          SELECT a AS node, a AS other FROM joined UNION SELECT b, b FROM joined UNION
          SELECT reach.node, CASE WHEN e.a = reach.other THEN e.b ELSE e.a END FROM reach JOIN joined e ON reach.other IN (e.a, e.b)),
        threads AS (SELECT node, min(other) AS thread_id FROM reach GROUP BY node),
        placed AS (
          SELECT id, coalesce(thread_id, conv_id) AS thread_id,
                 row_number() OVER (PARTITION BY coalesce(thread_id, conv_id) ORDER BY conv_id, turn, role NULLS FIRST) AS position
          FROM messages LEFT JOIN threads ON node = conv_id WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
        SELECT conv_id, turn, thread_id, position, role, body, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
               reply.conv AS reply_conv, reply.turn AS reply_turn
        FROM messages LEFT JOIN links USING (id) LEFT JOIN placed USING (id)""",
    "op1_warc": r"""
        WITH digests AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        coded AS (
          SELECT page_id, payload_bytes, hex,
                 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + (CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT)
                     // CAST(pow(32, 3 - k % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest
          FROM digests),
        ranked AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS best FROM coded)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM ranked""",
    "op2_exact_dedup": r"""
        WITH facts AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        ranked AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM facts)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked""",
    "op6_mixing": r"""
        WITH sizes AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents),
        src AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
          FROM sizes GROUP BY source),
        fill AS (
          SELECT *, 3 * source_size AS cap,
                 CAST((SELECT sum(source_size) FROM src) AS BIGINT)
                   - coalesce(sum(3 * source_size) OVER o, 0) AS room,
                 (SELECT sum(w) FROM src) - coalesce(sum(w) OVER o, 0) AS w_left
          FROM src
          WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        capped AS (SELECT *, room * w > cap * w_left AS full_ FROM fill),
        rest AS (
          SELECT CAST(sum(source_size) - coalesce(sum(cap) FILTER (full_), 0) AS BIGINT) AS room,
                 CAST(sum(w) - coalesce(sum(w) FILTER (full_), 0) AS BIGINT) AS w FROM capped),
        target AS (
          SELECT source, source_size,
                 CASE WHEN full_ THEN CAST(cap AS DOUBLE)
                      ELSE CAST(capped.w * rest.room AS DOUBLE) / rest.w END AS target
          FROM capped, rest),
        rate AS (
          SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM target)
        SELECT doc_id, size, source_size, target,
               size * CAST(floor(rate) + CAST(
                 CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
                   / 4503599627370496.0::DOUBLE < rate - floor(rate) AS BIGINT) AS BIGINT) AS taken
        FROM sizes JOIN rate ON sizes.source IS NOT DISTINCT FROM rate.source""",
    "op11_divergence": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        used AS (SELECT lang, source, row, unnest(terms) AS item FROM docs),
        kept AS (SELECT lang, item FROM used GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        counts AS (SELECT lang, source, item, count(*) AS n FROM used SEMI JOIN kept USING (lang, item) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        cells AS (
          SELECT g.lang, g.source, k.item, coalesce(c.n, 0)::HUGEINT AS n, v.v::HUGEINT AS v
          FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c USING (lang, source, item)),
        own AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM cells),
        whole AS (
          SELECT lang, item, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
          FROM (SELECT lang, item, sum(n)::HUGEINT AS n, any_value(v) AS v FROM cells GROUP BY lang, item)),
        sums AS (
          SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM own a JOIN own b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (
          SELECT lang, source, 'term' AS part, item, (((p - q) * (p - q)) // q)::BIGINT AS value
          FROM own JOIN whole USING (lang, item) WHERE n > 0 AND p > q),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_url_filter": r"""
        WITH RECURSIVE base AS (
          SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (
          SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                 translate(left(url, strpos(url, '://') - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' ||
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node
          FROM base),
        tags AS (
          SELECT node AS a, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'), '(?i)<(?:link|meta)[\x09-\x0D\x20][^>]*>')) AS tag
          FROM parts WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
        raw AS (
          SELECT a, CASE WHEN regexp_matches(tag, '(?i)^<link(?:[\x09-\x0D\x20]|[\x09-\x0D\x20][^>]*[\x09-\x0D\x20])rel[\x09-\x0D\x20]*=(?:[\x09-\x0D\x20]*canonical[\x09-\x0D\x20/>]|[\x09-\x0D\x20]*"(?:[^"]*[\x09-\x0D\x20])?canonical(?:[\x09-\x0D\x20][^"]*)?"|[\x09-\x0D\x20]*''(?:[^'']*[\x09-\x0D\x20])?canonical(?:[\x09-\x0D\x20][^'']*)?'')')
                         THEN regexp_extract(tag, '(?i)[\x09-\x0D\x20]href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', 1) || regexp_extract(tag, '(?i)[\x09-\x0D\x20]href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', 2) || regexp_extract(tag, '(?i)[\x09-\x0D\x20]href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', 3)
                         WHEN regexp_matches(tag, '(?i)^<meta(?:[\x09-\x0D\x20]|[\x09-\x0D\x20][^>]*[\x09-\x0D\x20])http-equiv[\x09-\x0D\x20]*=[\x09-\x0D\x20]*["'']?refresh["''\x09-\x0D\x20/>]')
                         THEN regexp_extract(regexp_extract(tag, '(?i)[\x09-\x0D\x20]content[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', 1) || regexp_extract(tag, '(?i)[\x09-\x0D\x20]content[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', 2) || regexp_extract(tag, '(?i)[\x09-\x0D\x20]content[\x09-\x0D\x20]*=[\x09-\x0D\x20]*(?:"([^"]*)"|''([^'']*)''|([^\x09-\x0D\x20"''>]+))', 3),
                                             '(?i)^[\x09-\x0D\x20]*[0-9.]+[\x09-\x0D\x20]*[;,][\x09-\x0D\x20]*url[\x09-\x0D\x20]*=[\x09-\x0D\x20]*["'']?([^"'']*)', 1) END AS ref
          FROM tags),
        refs AS (
          SELECT a, replace(replace(regexp_replace(ref, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), '&#38;', '&'), '&amp;', '&') AS ref,
                 regexp_extract(a, '^[^:]*://[^/?]*') AS site, regexp_extract(a, '^[^?]*') AS page FROM raw),
        resolved AS (
          SELECT a, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref
                         WHEN regexp_matches(ref, '^(?:#|$)') OR regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                         WHEN ref LIKE '//%' THEN regexp_extract(a, '^[^:]*') || ':' || ref
                         WHEN ref LIKE '/%' THEN site || ref
                         WHEN ref LIKE '?%' THEN page || ref
                         ELSE CASE WHEN page = site THEN site || '/' ELSE regexp_extract(page, '^.*/') END || ref END AS url
          FROM refs WHERE ref <> ''),
        links AS (
          SELECT DISTINCT a, translate(left(url, strpos(url, '://') - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' ||
                   translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
                   regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^#]*)', 1) AS b
          FROM resolved WHERE url IS NOT NULL),
        rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        urls AS (
          SELECT DISTINCT host, path FROM parts UNION
          SELECT regexp_extract(n, '^[^:]*://([^/?]*)', 1), regexp_extract(n, '^[^:]*://[^/?]*([^?]*)', 1) FROM (SELECT a AS n FROM links UNION SELECT b FROM links)),
        decided AS (
          SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS ruled
          FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL),
        reach AS (
          SELECT a AS node, a AS other FROM links UNION SELECT b, b FROM links UNION
          SELECT reach.node, CASE WHEN l.a = reach.other THEN l.b ELSE l.a END FROM reach JOIN links l ON reach.other IN (l.a, l.b)),
        blocked AS (
          SELECT node FROM reach JOIN decided ON host = regexp_extract(other, '^[^:]*://([^/?]*)', 1) AND path = regexp_extract(other, '^[^:]*://[^/?]*([^?]*)', 1)
          GROUP BY node HAVING min(ruled) = 'block')
        SELECT page_id, p.host, p.path, rule, coalesce(ruled, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
               ruled IS NULL AND b.node IS NOT NULL AS aliased
        FROM parts p LEFT JOIN decided d ON d.host = p.host AND d.path = p.path LEFT JOIN blocked b ON b.node = p.node""",
    "op13_periodic_runs": r"""
        WITH hashed AS (
          SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                 CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
                   lambda x, c: list_reduce(list_prepend(xor(x, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                     lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) END AS h
          FROM documents),
        sized AS (SELECT *, len(words)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM hashed),
        texts AS (
          SELECT row, doc_id, n, CASE WHEN a IS NULL THEN words ELSE
                   list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS words
          FROM sized),
        placed AS (SELECT row, unnest(range(n)) AS i, unnest(words) AS word FROM texts),
        equal AS (SELECT x.row, x.i, y.i - x.i AS period FROM placed x JOIN placed y ON x.row = y.row AND x.word = y.word AND x.i < y.i),
        stretches AS (
          SELECT row, min(i) AS start, count(*) + period AS length, period
          FROM (SELECT *, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS stretch FROM equal)
          GROUP BY row, period, stretch HAVING count(*) + period >= greatest(24, 3 * period)),
        runs AS (SELECT row, start, length, min(period) AS period FROM stretches GROUP BY ALL),
        best AS (
          SELECT row, arg_max({'s': start, 'l': length, 'p': period}, {'e': length * 1000000000000::HUGEINT // period, 's': -start, 'p': -period}) AS r, count(*) AS n_runs,
                 string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
          FROM runs GROUP BY row),
        dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
        collapsed AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM placed ANTI JOIN dropped USING (row, i) GROUP BY row)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.l AS length, r.p AS period, r.l * 1000 // r.p AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM texts LEFT JOIN best USING (row) LEFT JOIN collapsed USING (row)""",
}

ORACLE["chat_threads"] = f"""
        WITH linked AS ({ORACLE["op9_quotation"]}),
        told AS (
          SELECT thread_id, (position - 1) // 1024 AS part, position, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body AS said
          FROM linked WHERE position IS NOT NULL)
        SELECT thread_id, part, string_agg(said, chr(10) ORDER BY position) AS text FROM told GROUP BY thread_id, part"""
