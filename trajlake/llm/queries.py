"""Queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajlake.llm.common import table
from trajlake.llm.exact_dedup import exact_dedup
from trajlake.llm.filter_audit import audit
from trajlake.llm.fingerprint import fingerprints
from trajlake.llm.html_text import extract
from trajlake.llm.language_id import identify
from trajlake.llm.licenses import scan
from trajlake.llm.lm_score import score
from trajlake.llm.mixing import mix_sources
from trajlake.llm.ngram_join import ngram_join
from trajlake.llm.packing import pack
from trajlake.llm.prefix_trie import trie
from trajlake.llm.toxicity import toxicity
from trajlake.llm.warc import archive


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_html_text, op3_fingerprints, op4_licenses, op5_exact_dedup, op6_warc, op7_ngram_join, op8_lm_score, op9_mixing, op10_packing, op11_toxicity, op12_prefix_trie, op13_filter_audit, pipeline)
    return {f.__name__: f for f in own}


#: SQL of the unsigned crc32 of an integer's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295)"


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""",
        "op12_prefix_trie": f"""
            WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS m FROM conversations WHERE conv_id IS NOT NULL),
            c AS (SELECT conv_id, list(m ORDER BY k) AS own, {_CRC.format("conv_id")} % 6 AS h FROM t GROUP BY 1),
            s AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS p FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
            x AS (SELECT conv_id, p[1:d] AS q, d, len(p) AS n FROM (SELECT *, unnest(generate_series(0, len(p))) AS d FROM s)),
            n AS (SELECT q, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN length(q[d].x) ELSE 0 END AS chars, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM x GROUP BY q, d),
            k AS (SELECT q[1:d - 1] AS q, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
            j AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (q, d)),
            a AS (SELECT q[1:u] AS q, u AS d, sum((n_convs - 1) * chars) AS saved, sum((n_children = 0)::int) AS n_leaves FROM (SELECT *, unnest(generate_series(0, d)) AS u FROM j) GROUP BY 1, 2)
            SELECT j.conv_id, j.d AS depth, u.conv_id AS parent_conv_id, j.n_convs, j.n_children, a.n_leaves::bigint AS n_leaves, a.saved::bigint AS saved_tokens, sha256(j.ends) AS ends_sha256
            FROM j JOIN a ON a.q = j.q AND a.d = j.d LEFT JOIN j u ON j.d > 0 AND u.d = j.d - 1 AND u.q = j.q[1:j.d - 1]""",
        "op13_filter_audit": r"""
            WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
                regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
            l AS (SELECT doc_id, coalesce(max((quality = 1)::int), 0) AS good, coalesce(max((toxic = 1)::int), 0) AS bad FROM labels GROUP BY 1),
            m AS (SELECT part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int AS mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2, 3, 4),
            x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
            s AS (SELECT o AS filter_order, k::int AS step, o[k] AS name, 1 << (ascii(o[k]) - 65) AS own, list_sum([1 << (ascii(z) - 65) FOR z IN string_split(o[1:k - 1], '') IF z <> ''])::int AS before FROM o, generate_series(1, 5) g(k)),
            j AS (SELECT *, (mask & own) > 0 AS fails, (mask & coalesce(before, 0)) > 0 AS gone FROM m, s),
            r AS (SELECT part, filter_order, step, any_value(name) AS name, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
                sum(n) FILTER (mask = own) AS unique_fails, sum(n * good) FILTER (fails AND NOT gone) AS good_lost, sum(n * bad) FILTER (fails AND NOT gone) AS toxic_lost FROM j GROUP BY 1, 2, 3)
            SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
                coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, name))::bigint AS shapley FROM r""",
    }
