"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymesh.llm.byte_bpe import decode_bpe, encode_bpe
from tidymesh.llm.common import read
from tidymesh.llm.exact_dedup import exact_dedup
from tidymesh.llm.filter_audit import audit_filters
from tidymesh.llm.hard_negatives import mine_negatives
from tidymesh.llm.jaccard_join import jaccard_components
from tidymesh.llm.line_dedup import dedup_lines
from tidymesh.llm.main_text import extract_main, fit_costs
from tidymesh.llm.packing import pack_documents
from tidymesh.llm.secret_scan import PATTERNS, find_secrets, spelled
from tidymesh.llm.sharding import shard_documents
from tidymesh.llm.topk_search import top_k
from tidymesh.llm.toxicity import fit_toxicity, held_out, score_toxicity
from tidymesh.llm.warc import round_trip


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), learn=~held_out())
    scored = score_toxicity(docs, model).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, content="crc32")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), keep=["doc_id"])
    # one array for all columns, as an expression used twice would scan the text twice
    base = F.filter("secret_spans", lambda x: x["k"] < len(PATTERNS))

    def count(k: int) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")

    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secret_spans")).alias("spans"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6_secret_scan, which SQL can express."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"), bodies=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    path = tok.path("byte_bpe_multi_50k.tiktoken")
    coded = decode_bpe(encode_bpe(read(spark, sf_dir, "documents").select("doc_id", "text"), path, tok.PATTERN), path, tok.PATTERN)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(read(spark, sf_dir, "embeddings"), label)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract_main(pages, fit_costs(pages)).select("page_id", "url", "text", "n_chars")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scan": op6_secret_scan,
    "base_secrets": base_secrets,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_topk_search": op9_topk_search,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_main_text": op12_main_text,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d),
        tk AS (SELECT doc_id, line, place, list_filter(string_split(line, ' '), lambda t: t <> '') AS ts FROM a),
        lf AS (SELECT doc_id, line, ts, len(ts) || ' ' || array_to_string(list_transform(ts[1:2], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '*' ELSE t END), ' ') AS leaf FROM tk WHERE len(ts) >= 3),
        u AS (SELECT leaf, line, any_value(ts) AS ts, count(DISTINCT doc_id) AS c FROM lf GROUP BY 1, 2),
        cell AS (SELECT leaf, line, c, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM u),
        sup AS (SELECT leaf, i, token, sum(c) AS s FROM cell GROUP BY 1, 2, 3),
        tm AS (
            SELECT leaf, line, string_agg(CASE WHEN s >= 4 THEN cell.token ELSE ' ' END, chr(10) ORDER BY cell.i) AS template FROM cell JOIN sup USING (leaf, i, token)
            GROUP BY 1, 2 HAVING sum((s >= 4)::INT) >= 0.6 * count(*)
        ),
        td AS (SELECT DISTINCT lf.doc_id, leaf, line, template FROM lf JOIN tm USING (leaf, line)),
        rec AS (SELECT template, min(doc_id) AS first FROM td GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4),
        lit AS (SELECT line, min(doc_id) AS first FROM lf WHERE len(ts) >= 50 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
        gone AS (SELECT doc_id, line FROM td JOIN rec USING (template) WHERE doc_id <> first UNION SELECT doc_id, line FROM lf JOIN lit USING (line) WHERE doc_id <> first),
        kept AS (SELECT tk.doc_id, place, tk.line, gone.line IS NOT NULL AS dropped FROM tk LEFT JOIN gone ON tk.doc_id = gone.doc_id AND tk.line = gone.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS text_sha256 FROM kept GROUP BY 1
    """,
    "op4_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
        FROM documents d JOIN g ON coalesce(d.text, '') = g.t
    """,
    "base_secrets": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT * FROM (VALUES
            (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+'),
            (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')) AS x(k, kind, pattern)),
        m AS (SELECT doc_id, k, kind, unnest(regexp_extract_all(t, pattern)) AS m, unnest(string_split_regex(t, pattern)[:-2]) AS gap,
            generate_subscripts(regexp_extract_all(t, pattern), 1) AS i FROM d, p WHERE regexp_matches(t, pattern)),
        s AS (SELECT doc_id, k, kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM m),
        b AS (SELECT doc_id, k, kind, e - length(m) AS s, e FROM s WHERE CASE k
            WHEN 0 THEN length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
            WHEN 1 THEN length(m) >= 20 ELSE length(m) >= 24 END)
        SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
            sha256(coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k), '')) AS base_sha256
        FROM d LEFT JOIN b ON d.doc_id = b.doc_id GROUP BY d.doc_id
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT t, min(page_id) AS first FROM p GROUP BY 1)
        SELECT p.page_id, p.n AS payload_bytes, sha256(p.t) AS payload_digest,
            CASE WHEN p.n >= 100 AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.n >= 100 AND f.first <> p.page_id THEN f.first END AS refers_to
        FROM p JOIN f ON p.t = f.t
    """,
    "op9_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.own, q.vec_id AS anchor_id, c.own AS other, c.vec_id, c.label = q.label AS same,
                CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 100 = 0
        ), p AS (SELECT own, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, other) <= 5),
        n AS (
            SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.own, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank,
                s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
            FROM p JOIN s ON s.own = p.own AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
        )
        SELECT * FROM n WHERE rank <= 5
    """,
    "op13_filter_audit": """
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
        ), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
        f AS (
            SELECT part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
                + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(d.doc_id > min(d.doc_id) OVER (PARTITION BY t) AS INT) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM d LEFT JOIN l ON d.doc_id = l.doc_id
        ), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
        x AS (SELECT chr(65 + CAST(i AS INT)) AS letter, CAST(1 << CAST(i AS INT) AS INT) AS bit FROM range(5) r(i)),
        o AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
        ), s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(k)),
        a AS (
            SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN fails & (earlier | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                CAST(sum(CASE WHEN fails & earlier = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                CAST(sum(CASE WHEN fails & earlier <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                CAST(sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                CAST(sum(CASE WHEN fails & earlier = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                CAST(sum(CASE WHEN fails & earlier = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM c, s GROUP BY 1, 2, 3, 4
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a
    """,
}
