"""The registered queries of this subpackage and their SQL.

Each query applies its operator with production parameters to the whole
table and derives the columns asked for from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.bpe import decode, encode
from codeweft.llm.decontaminate import SLOP, decontaminate
from codeweft.llm.exact_dedup import exact_dedup
from codeweft.llm.jaccard_join import jaccard_components
from codeweft.llm.license_scan import SIMILAR, TEMPLATES, license_scan, template_bigrams
from codeweft.llm.line_dedup import line_dedup
from codeweft.llm.media import media_columns
from codeweft.llm.quality import THRESHOLD, fit, fold, score
from codeweft.llm.secret_scan import render, secret_scan
from codeweft.llm.spelling import LEAST_COUNT, LEAST_LENGTH, THINNED, TIMES, spelling_variants
from codeweft.llm.substring_dedup import substring_dedup
from codeweft.llm.token_counts import count_tokens
from codeweft.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes

#: Place of the tokenizer file; a path that holds on every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens beyond which op7 marks a text.
TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=SLOP)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
        F.sha2(F.array_join("near", ","), 256).alias("near_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(_table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(render(F.col("base")), 256).alias("base_sha256"),
        render(F.concat("base", "added")).alias("spans"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, similar=(90, 100)).select("doc_id", "n_shingles", "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    filled = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda k: F.get(lines, k).rlike(r"\S"))
    # Rows without an id keep all their lines.
    whole = F.when(F.col("doc_id").isNull(), F.array_join(filled.cast("array<string>"), ","))
    sizes = docs.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(filled).cast("bigint").alias("filled"), whole.alias("whole"))
    kept = line_dedup(docs).select("doc_id", F.size("kept").cast("bigint").alias("n_kept"), F.array_join(F.col("kept").cast("array<string>"), ",").alias("numbers"))
    removed = F.when(F.col("doc_id").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("filled") - F.coalesce("n_kept", F.lit(0)))
    return sizes.join(kept, "doc_id", "left").select("doc_id", "n_lines", removed.alias("n_removed"), F.sha2(F.coalesce("whole", "numbers", F.lit("")), 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hits = license_scan(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("names"), F.max("dice").alias("best"))
    own = docs.select("doc_id")
    return own.join(hits.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_hits"), F.coalesce("names", F.lit("")).alias("licenses"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best_dice"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_columns(_table(spark, sf_dir, "documents"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_media_columns": op12_media_columns,
    "op13_spelling_variants": op13_spelling_variants,
}

_TEMPLATE_ROWS = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{b}'" for b in template_bigrams(text))) for name, text in TEMPLATES.items())



def _assigned(k: int) -> str:
    """CTE ``a{k}``: nearest entry of each part in codebooks ``c{k}``; distance
    and index go into one number, whose least one is wanted."""
    apart = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    return f"""a{k} AS MATERIALIZED (
            SELECT n, p, m % {ENTRIES} AS e, m // {ENTRIES} AS d
            FROM (SELECT n, p, CAST(min({apart} * {ENTRIES} + c.e) AS BIGINT) AS m FROM v JOIN c{k} c USING (p) GROUP BY n, p)
        )"""


def _refined(k: int) -> str:
    """CTE ``c{k}`` from ``a{k - 1}``: floors of means, unused entries as they were."""
    return f"""c{k} AS MATERIALIZED (
            SELECT p, e, coalesce(y, c.x) AS x
            FROM c{k - 1} c LEFT JOIN (
                SELECT p, e, list(CAST(y AS BIGINT) ORDER BY i) AS y
                FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS y FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM v JOIN a{k - 1} USING (n, p)) GROUP BY p, e, i)
                GROUP BY p, e
            ) USING (p, e)
        )"""


_ROUNDS_SQL = ", ".join(f"{_assigned(k)}, {_refined(k + 1)}" for k in range(ROUNDS))

ORACLE_SQL = {
    "op13_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
        ), long_runs AS (
            SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run
        ), crc AS (  -- the checksum's table, by its polynomial
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM long_runs, crc
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT n, CASE WHEN h % {THINNED} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
        ), less AS (
            SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS k FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS p FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM less a JOIN less b USING (p, k) WHERE a.word <> b.word
            UNION SELECT w.word, l.word, l.n FROM words w JOIN less l ON l.k = w.word
            UNION SELECT l.word, w.word, w.n FROM words w JOIN less l ON l.k = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(n) AS m, arg_min(other, (-n, other)) AS other FROM near GROUP BY word
        ), formed AS (
            SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * words.n THEN other END AS form, CASE WHEN m >= {TIMES} * words.n THEN m END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), steps AS (
            SELECT word, word AS root, 0 AS d FROM formed
            UNION ALL
            SELECT s.word, f.form, d + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, d) AS root FROM steps GROUP BY word) USING (word)
    """,
    "op11_vector_codes": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), v AS MATERIALIZED (
            SELECT n, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)
        ), c0 AS MATERIALIZED (
            SELECT p, n - 1 AS e, x FROM v WHERE n <= {ENTRIES}
        ), {_ROUNDS_SQL}, {_assigned(ROUNDS)}, coded AS (
            SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
        FROM kept JOIN coded USING (n)
    """,
    "op10_license_scan": rf"""
        WITH t(license, b) AS (VALUES {_TEMPLATE_ROWS}),
        p AS (
            SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda x: contains(x, chr(10))))) AS passage FROM documents
        ), w AS (
            SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM p
        ), g AS (
            SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) >= 2
        ), d AS (
            SELECT doc_id, k, license, 2.0 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice FROM g, t
        ), best AS (
            SELECT doc_id, k, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM d WHERE dice >= {SIMILAR} GROUP BY doc_id, k
        ), h AS (
            SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(dice) AS best FROM best GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n, 0) AS n_hits, coalesce(names, '') AS licenses, round(coalesce(best, 0), 6) AS best_dice
        FROM documents LEFT JOIN h USING (doc_id)
    """,
    "op1_decontaminate": rf"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), iw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
        ), places AS (
            SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw
        ), grams AS (
            SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS k
            FROM places, (SELECT DISTINCT n FROM windows) WHERE p + n - 1 <= len(w)
        ), hits AS (
            SELECT doc_id, p, n, item_id FROM grams JOIN windows USING (n, k)
        ), covered AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
        ), found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
        ), terms AS MATERIALIZED (
            SELECT k, o, string_split(k, ' ')[o] AS t FROM (SELECT k, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT k, n FROM windows))
        ), words AS MATERIALIZED (
            SELECT doc_id, w[p] AS t, p FROM places WHERE w[p] IN (SELECT t FROM terms)
        ), rarest AS (
            SELECT k, arg_min(t, (coalesce(f, 0), o)) AS t, count(DISTINCT t) AS n_terms
            FROM terms LEFT JOIN (SELECT t, count(*) AS f FROM words GROUP BY t) USING (t) GROUP BY k
        ), near AS (
            SELECT r.k, a.doc_id
            FROM rarest r JOIN words a USING (t) JOIN (SELECT DISTINCT k, t FROM terms) u ON u.k = r.k
            JOIN words x ON x.doc_id = a.doc_id AND x.t = u.t AND x.p BETWEEN a.p - {SLOP} AND a.p + {SLOP}
            GROUP BY r.k, a.doc_id, a.p, r.n_terms HAVING count(DISTINCT u.t) = r.n_terms
        ), around AS (
            SELECT doc_id, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM near JOIN windows USING (k)) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN around USING (doc_id)
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i
            FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY u, v
        ), links AS (
            SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
            WHERE 100 * i >= 90 * (a.n + b.n - i)
        ), reach AS (
            SELECT u AS doc_id, u AS r FROM (SELECT DISTINCT u FROM links)
            UNION
            SELECT doc_id, v AS r FROM reach JOIN links ON r = u
        )
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id)
        LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
    "op6_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w WHERE len(w) >= 13)
        ), firsts AS (
            SELECT g, min(doc_id) AS f FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (g) WHERE doc_id > f
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
}
