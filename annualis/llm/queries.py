"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op8_probminhash")
def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: doc_id, class_id, kept."""
    from annualis.llm.op08_probminhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op5_cgk_decontaminate")
def op5_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, distance, start."""
    from annualis.llm.op05_cgk_decontaminate import find_leaks
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_pca_tiles")
def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine links and components of all embeddings: vec_id, n_links, component_id, kept."""
    from annualis.llm.op06_pca_tiles import cosine_components
    return cosine_components(table(spark, sf_dir, "embeddings"))


@register("op3_nearest_url_diff")
def op3_nearest_url_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: page_id, url, text, n_chars."""
    from annualis.llm.op03_nearest_url_diff import extract_main_text
    return extract_main_text(table(spark, sf_dir, "pages"))


@register("op7_zip_warc", """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < head THEN head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest AND payload_bytes >= 1000""")
def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ZIP-packaged WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    from annualis.llm.op07_zip_warc import archive_round_trip
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


@register("op10_ac_viterbi")
def op10_ac_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents: doc_id, n_tokens, ids, n_byte_tokens, round_trip."""
    from annualis.llm.op10_ac_viterbi import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"))


@register("op2_factorization_toxicity")
def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    from annualis.llm import op02_factorization_toxicity as tox
    docs = table(spark, sf_dir, "documents")
    return tox.score_documents(docs, tox.train(docs, table(spark, sf_dir, "labels")))


@register("op4_ftrl_language")
def op4_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents: doc_id, held_out, lang_pred, score."""
    from annualis.llm import op04_ftrl_language as lang
    docs = table(spark, sf_dir, "documents")
    return lang.identify(docs, lang.train(docs))


OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m0 AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
e AS (SELECT conv_id, max(k) AS last, count(*) AS n FROM m0 WHERE role = 'assistant' GROUP BY 1),
m AS (SELECT m0.* FROM m0 JOIN e ON m0.conv_id = e.conv_id AND k <= last),
a AS (SELECT conv_id, k, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS j FROM m WHERE role = 'assistant'),
x AS (SELECT *, md5(CAST(conv_id AS VARCHAR)) AS h, '0123456789abcdef' AS hex FROM e),
y AS (SELECT conv_id, ((instr(hex, substr(h, 1, 1)) - 1) * 4096 + (instr(hex, substr(h, 2, 1)) - 1) * 256
                       + (instr(hex, substr(h, 3, 1)) - 1) * 16 + instr(hex, substr(h, 4, 1)) - 1) % n + 1 AS j FROM x),
d AS (SELECT a.conv_id, a.k AS d FROM a JOIN y ON a.conv_id = y.conv_id AND a.j = y.j),
o AS (SELECT conv_id, d, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS donor FROM d QUALIFY count(*) OVER () > 1),
c AS (SELECT o.conv_id AS p, k, role, text FROM o JOIN m ON m.conv_id = o.conv_id),
r AS (SELECT o.conv_id AS p, k, role, text FROM o JOIN m ON m.conv_id = o.conv_id AND k < o.d
      UNION ALL SELECT o.conv_id, o.d + m.k - d.d, role, text FROM o JOIN d ON d.conv_id = o.donor JOIN m ON m.conv_id = o.donor AND m.k >= d.d),
f AS (SELECT coalesce(c.p, r.p) AS p, min(coalesce(c.k, r.k)) FILTER (c.k IS NULL OR r.k IS NULL OR c.role <> r.role OR c.text <> r.text) AS pos, count(c.k) AS n
      FROM c FULL JOIN r ON c.p = r.p AND c.k = r.k GROUP BY 1),
l AS (SELECT p, coalesce(pos - 1, n) AS n FROM f),
s AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
w AS (SELECT s.*, l.n, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole FROM s JOIN l USING (p)),
z AS (SELECT *, sum(length(whole)) FILTER (k > n) OVER (PARTITION BY side, p ORDER BY k) AS stop FROM w),
g AS (SELECT side, p, any_value(n) AS n, coalesce(string_agg(whole, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
             coalesce(string_agg(whole, '' ORDER BY k) FILTER (k > n), '') AS rest,
             coalesce(string_agg((stop - length(whole) + length(head)) || '-' || stop, ',' ORDER BY k) FILTER (k > n AND role = 'assistant'), '') AS mask
      FROM z GROUP BY 1, 2)
SELECT c.p AS pair_id, CAST(c.n AS INTEGER) AS prompt_turns, c.prompt, c.rest AS chosen, coalesce(r.rest, '') AS rejected, c.mask AS chosen_mask,
       coalesce(r.mask, '') AS rejected_mask
FROM g c LEFT JOIN g r ON r.p = c.p AND r.side = 'r' WHERE c.side = 'c'"""


@register("op1_preferences", OP1_SQL)
def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations: pair_id, prompt_turns, prompt, chosen, rejected and
    the trained spans of both completions as "start-end,..."."""
    from annualis.llm.op01_preferences import answer_swaps, format_preferences
    out = format_preferences(answer_swaps(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


from annualis.llm.op09_licence_rules import licences_sql  # noqa: E402


@register("op9_licence_rules", licences_sql())
def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents: doc_id, sentences and licences (both joined by commas)."""
    from annualis.llm.op09_licence_rules import scan_licences
    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("sentences", "licences")})


def centroid_sql(rounds: int = 5, k: int = 40) -> str:
    """The contract of op11 round by round: long form (id, dimension, x), exact integers."""
    step = """
d{n} AS (SELECT p.vec_id, c.c, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{n} c ON p.i = c.i GROUP BY ALL),
a{n} AS (SELECT vec_id, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{n} GROUP BY 1)"""
    move = """,
m{n} AS (SELECT a.c, p.i, CAST(floor(CAST(sum(p.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM p JOIN a{n} a USING (vec_id) GROUP BY ALL),
c{m} AS (SELECT c.c, c.i, coalesce(m{n}.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} ON m{n}.c = c.c AND m{n}.i = c.i),"""
    rounds_sql = "".join(step.format(n=n) + (move.format(n=n, m=n + 1) if n < rounds else "") for n in range(rounds + 1))
    return f"""
WITH kept AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(list_transform(v, lambda e: floor(256 * e))) AS BIGINT) AS x FROM kept),
h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS (SELECT h.c, p.i, p.x FROM p JOIN h USING (vec_id)),{rounds_sql},
s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN s ON s.c = a.c"""


@register("op11_nsimplex_centroids", centroid_sql())
def op11_nsimplex_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer k-means of all embeddings: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    from annualis.llm.op11_nsimplex_centroids import cluster_vectors
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@register("op12_cover_anchors", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35),
h AS (SELECT i.r, i.i, md5(array_to_string(list_slice(w, i.i, i.i + 34), ' ')) AS h FROM i JOIN t USING (r)),
g AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
m AS (SELECT p.r, p.i, word, coalesce(max(g.i) OVER (PARTITION BY p.r ORDER BY p.i) >= p.i - 34, false) AS gone
      FROM p LEFT JOIN g ON g.r = p.r AND g.i = p.i),
k AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS s
      FROM m GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(s, sha256('')) AS kept_sha256
FROM t LEFT JOIN k USING (r)""")
def op12_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated 35-word windows: doc_id, n_words, n_removed, kept_sha256."""
    from annualis.llm.op12_cover_anchors import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"))


@register("op13_slicing_whitening")
def op13_slicing_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings: vec_id, component, n, deviation, whitened, explained, identity_error."""
    from annualis.llm.op13_slicing_whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))
