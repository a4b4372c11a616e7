"""The registered queries of the corpus operators, and the SQL that some of them can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator that needs one.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    return classify_quality(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_docs(spark, sf_dir))


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), tokenizer_file(WORD_TOKENIZER))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_docs(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_docs(spark, sf_dir))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(_docs(spark, sf_dir), tokenizer_file(PIECE_TOKENIZER))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import apply_line_dedup

    kept = apply_line_dedup(_docs(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), "keep_runs")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    return find_contamination(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_docs(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_kneser_ney": op1_quality_kneser_ney,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity_grammar": op3_toxicity_grammar,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_count": op8_token_count,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_conversation_trie": op13_conversation_trie,
}


def _lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds spelled out: components as rows, a distance and the number of its centroid in one integer."""
    near = "a{0} AS MATERIALIZED (SELECT r, min(d * {k} + k) AS dk FROM (SELECT r, k, sum((x - c) * (x - c))::BIGINT AS d FROM e JOIN c{1} USING (j) GROUP BY r, k) GROUP BY r)"
    mean = """c{0} AS MATERIALIZED (SELECT k, j, coalesce(m, c) AS c FROM c{1} LEFT JOIN (SELECT dk % {k} AS k, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
            FROM a{0} JOIN e USING (r) GROUP BY 1, 2) USING (k, j))"""
    steps = [f.format(t, t - 1, k=k) for t in range(1, rounds + 1) for f in (near, mean)]
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
            WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
        e AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range(64)) AS j FROM v),
        c0 AS MATERIALIZED (SELECT k, unnest(q) AS c, unnest(range(64)) AS j FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS k, q FROM v) WHERE k < {k}),
        {", ".join(steps)}, {near.format(rounds + 1, rounds, k=k)},
        h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
        SELECT vec_id, k::INT AS cluster, dk // {k} AS distance, (sum(dk // {k}) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(dk // {k}) OVER ())::BIGINT AS inertia,
               centroid_sha256, count(*) OVER (PARTITION BY q) AS n_same
        FROM a{rounds + 1} JOIN v USING (r) JOIN h ON k = dk % {k}"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS n FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(n) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY n)""",
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p, len(ls) AS n FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, f.last IS NOT NULL AND k.doc_id <> f.last AS goes FROM k LEFT JOIN f USING (key)),
        g AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM m WHERE goes),
        r AS (SELECT doc_id, min(p) AS s, max(p) AS e FROM g GROUP BY doc_id, island),
        q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), -1) AS before FROM r),
        x AS (SELECT doc_id, string_agg((s - before - 1) || ',' || (e - s + 1), ',' ORDER BY s) AS keep_runs FROM q GROUP BY doc_id)
        SELECT m.doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (WHERE goes)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT goes), '')) AS kept_sha256,
               coalesce(any_value(keep_runs), '') AS keep_runs
        FROM m LEFT JOIN x USING (doc_id) GROUP BY m.doc_id""",
    "op11_centroid_clustering": _lloyd_sql(),
    "op12_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct([hash(array_to_string(ws[i:i + 3], ' ')) for i in range(1, greatest(len(ws) - 2, 2))]) END AS gs FROM w),
        t AS MATERIALIZED (SELECT min(doc_id) AS node, list_sort(gs) AS gs, len(gs) AS n FROM s GROUP BY ALL),
        e AS MATERIALIZED (SELECT node, n, unnest(gs) AS g FROM t),
        p AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT s.doc_id, len(s.gs) AS n_shingles, CASE WHEN len(s.gs) = 0 THEN s.doc_id ELSE coalesce(c.component, t.node) END AS component_id, coalesce(k.n_links, 0) AS n_links
        FROM s JOIN t ON list_sort(s.gs) = t.gs LEFT JOIN c ON c.a = t.node LEFT JOIN k ON k.a = t.node""",
    "op13_conversation_trie": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(sha256(length(role) || ':' || role || ':' || text) ORDER BY p) AS ks,
                list(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) ORDER BY p) AS ws FROM t GROUP BY conv_id),
        c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
                lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM o),
        r AS (SELECT c.conv_id, list_concat(coalesce(b.ks, [])[1:h], c.ks[h + 1:]) AS ks, list_concat(coalesce(b.ws, [])[1:h], c.ws[h + 1:]) AS ws
            FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
        m AS (SELECT conv_id, d, sha256(array_to_string(ks[1:d], ',')) AS k, sha256(array_to_string(ks[1:d - 1], ',')) AS pk, coalesce(ws[d], 0) AS words, len(ks) = d AS ends
            FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM r)),
        n AS (SELECT d, k, any_value(pk) AS pk, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, k),
        g AS (SELECT n.*, coalesce(q.c, 0) AS n_children FROM n LEFT JOIN (SELECT d - 1 AS d, pk AS k, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL) q USING (d, k)),
        s AS (SELECT m.d, m.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * g.words)::BIGINT AS saved_tokens
            FROM g JOIN m ON m.conv_id = g.conv_id AND m.d <= g.d GROUP BY m.d, m.k)
        SELECT g.conv_id, g.d AS depth, u.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
        FROM g JOIN s USING (d, k) LEFT JOIN n u ON u.d = g.d - 1 AND u.k = g.pk""",
}
