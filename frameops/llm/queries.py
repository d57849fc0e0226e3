"""Queries of the operators of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lower case of A-Z alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Smallest node that a node of ``links`` (a, b), held in both directions, can reach.
_REACH = """
    reach AS (
        SELECT a AS node, a AS other FROM links
        UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a
    ), lowest AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""


@query(
    "op3_ngram_jaccard_join",
    f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), grams AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest([array_to_string(w[s:s + 4], ' ') FOR s IN range(1, greatest(len(w) - 4, 1) + 1)]) AS g FROM d WHERE len(w) > 0
    ), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    links AS MATERIALIZED (
        SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
        JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
        GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
    ), {_REACH}
    SELECT doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component_id, doc_id) AS BIGINT) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON lowest.node = doc_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    "op8_benchmark_decontamination",
    f"""
    WITH d AS MATERIALIZED (
        SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
    ), i AS (
        SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
    ), windows AS MATERIALIZED (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest([array_to_string(w[s:s + 9], ' ') FOR s IN range(1, greatest(len(w) - 9, 1) + 1)]) AS g FROM i WHERE len(w) > 0
    ), places AS (
        SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS g
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
    ), found AS MATERIALIZED (SELECT doc_id, s, k, item_id FROM places JOIN windows USING (k, g)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.decontaminate import decontamination_report

    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from frameops.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


@query(
    "op6_warc",
    """
    WITH hashed AS (
        SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
    ), bits AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload) AS lead,
            array_to_string([lpad(bin(CAST(('0x' || substr(hex, 1 + 2 * i, 2)) AS BIGINT)), 8, '0') FOR i IN range(20)], '') AS bits
        FROM hashed
    )
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum([CAST(substr(bits, 1 + 5 * i + j, 1) AS INT) * (16 >> j) FOR j IN range(5)]) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
        CASE WHEN lead IS NULL OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> lead OR page_id IS NULL THEN lead END AS refers_to
    FROM bits
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.langid import language_report

    return language_report(table(spark, sf_dir, "documents"))


@query(
    "op1_embedding_near_dedup",
    f"""
    WITH RECURSIVE v AS MATERIALIZED (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
    ), links AS MATERIALIZED (
        SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
        WHERE list_cosine_similarity(x.e, y.e) >= 0.93
    ), {_REACH}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(component_id, vec_id) AS BIGINT) AS component_id,
        coalesce(component_id, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN lowest ON lowest.node = vec_id LEFT JOIN degree ON degree.a = vec_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.neighbours import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_license_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.licences import licence_report

    return licence_report(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op12_approximate_nearest_neighbours",
    """
    WITH v AS MATERIALIZED (
        SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
    ), scored AS (
        SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.e, c.e) AS score
        FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id AND len(q.e) = len(c.e)
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Terms of the ranked search: the bytes of `alnum` words, upper case letters included.
_TERMS = "coalesce(regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])".format(_LOWER.format("text"))


@query(
    "op13_ranked_lexical_search",
    f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
    i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
    counts AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
    asked AS MATERIALIZED (SELECT i, term, count(*) AS many FROM (SELECT i, unnest(t) AS term FROM i) GROUP BY i, term),
    held AS MATERIALIZED (
        SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d)
        WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, counts GROUP BY term, n_docs
    ), scored AS (
        SELECT i, r, doc_id, CAST(sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term), counts GROUP BY i, r, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
    FROM scored JOIN i USING (i) WHERE score > 0 QUALIFY rank <= 20
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(b) AS BIGINT) FOR b IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query(
    "op11_conversation_prefix_trie",
    f"""
    WITH t AS MATERIALIZED (
        SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS r
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h, count(*) AS n FROM t GROUP BY conv_id),
    k AS MATERIALIZED (SELECT c.conv_id, c.base, c.h, c.n, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
    turns AS MATERIALIZED (
        SELECT k.conv_id, r AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND r <= h
        UNION ALL SELECT k.conv_id, k.k + r - h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND r > h
    ), p AS MATERIALIZED (
        SELECT conv_id, d, strlen(text) AS bytes, max(d) OVER (PARTITION BY conv_id) = d AS ends,
            sha256(string_agg(concat(strlen(role), ':', role, strlen(text), ':', text), '' ) OVER (PARTITION BY conv_id ORDER BY d)) AS prefix
        FROM turns
        UNION ALL SELECT conv_id, 0, 0, conv_id NOT IN (SELECT conv_id FROM turns), '' FROM c
    ), owned AS MATERIALIZED (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS owner FROM p),
    nodes AS MATERIALIZED (
        SELECT owner AS conv_id, d AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM owned GROUP BY owner, d
    ), placed AS MATERIALIZED (
        SELECT nodes.*, o.owner AS parent_conv_id FROM nodes LEFT JOIN owned o ON o.conv_id = nodes.conv_id AND o.d = nodes.depth - 1
    ), children AS MATERIALIZED (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM placed WHERE depth > 0 GROUP BY ALL),
    whole AS MATERIALIZED (SELECT placed.*, coalesce(children.n, 0) AS n_children FROM placed LEFT JOIN children USING (conv_id, depth)),
    sums AS (
        SELECT o.owner AS conv_id, o.d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w.bytes) AS saved_tokens
        FROM whole w JOIN owned o ON o.conv_id = w.conv_id AND o.d <= w.depth GROUP BY ALL
    )
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
        CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
    FROM whole JOIN sums USING (conv_id, depth)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameops.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))
