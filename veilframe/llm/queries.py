"""One query per operator over its whole table, and the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm import (
    bpe, chat, hard_negatives, heap_kmeans, hidden_markov, html_layout, line_rules, positional_index, quality_gam, simhash, site_lines, toxicity, trie_tokens,
)

#: Words as the contract has them: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a batch for Python is bounded by its bytes too, as texts differ in length a lot
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_rules.clean_lines(table(spark, sf_dir, "documents"))
    return made.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern, remembered=500_000)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op5_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=positional_index.SLOP)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), positional_index.sha_of_items().alias("items_sha256"), "contaminated",
        F.size("near_items").cast("bigint").alias("n_near"), positional_index.sha_of_items("near_items").alias("near_sha256"),
    )


def op7_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return trie_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_pages(table(spark, sf_dir, "pages"))


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = site_lines.drop_boilerplate(table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return made.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op11_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heap_kmeans.cluster(table(spark, sf_dir, "embeddings"))
    own = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row per cluster
    digests = spark.createDataFrame([(k, heap_kmeans.digest(c)) for k, c in enumerate(found.centroids)], "cluster int, digest string")
    totals = own.join(digests, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(1))))
    return found.rows.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("digest", 256).alias("centroid_sha256")
    )


def op12_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = hidden_markov.count_words(docs)
    encoded = hidden_markov.encode(docs, known)
    return hidden_markov.score(encoded, known, hidden_markov.fit(encoded, known)[0])


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_rules, op2_chat_rotation, op3_byte_bpe, op4_quality_gam, op5_toxicity_trees, op6_positional_index, op7_trie_tokens,
        op8_html_layout, op9_site_lines, op10_simhash_pivots,
        op11_heap_kmeans, op12_tree_negatives, op13_hidden_markov,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
grams AS (
    SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS gram
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) t(k) GROUP BY r),
cut AS (SELECT r, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT r, nr, ls[nr] AS line FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS nr FROM cut)),
measured AS (
    SELECT r, nr, line, regexp_extract_all(line, '{WORD}') AS own, len(own) AS k,
        row_number() OVER (PARTITION BY r, line ORDER BY nr) > 1 AS again
    FROM lines),
judged AS (
    SELECT r, nr, line, k, k > 0 AND again AS again,
        k > 0 AND (NOT regexp_matches(own[-1], '[.!?…:;"''”’»)\\]]$') OR 3 * len(regexp_replace(line, '[^{line_rules.SYMBOLS}]', '', 'g')) > k
            OR 2 * len(regexp_replace(line, '[^!]', '', 'g')) > k) AS marks,
        k > 0 AND 5 * len(list_filter(own, lambda x: regexp_full_match(x, '[|»›•·>/-]+'))) >= k AS menu,
        k > 0 AND (again OR regexp_matches(translate(line, '{UPPER}', '{LOWER}'), '{line_rules.BOILERPLATE}')) AS plate
    FROM measured),
per AS (
    SELECT r, count(*) FILTER (k > 0) AS n_lines, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (marks) AS n_punctuation,
        count(*) FILTER (menu) AS n_navigation, count(*) FILTER (plate) AS n_boilerplate,
        coalesce(sum(k) FILTER (marks OR menu OR plate), 0)::BIGINT AS n_removed_words,
        coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT (marks OR menu OR plate)), '') AS clean
    FROM judged GROUP BY r),
base AS (
    SELECT w.r, doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
        len(regexp_replace(text, '[^{line_rules.SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(repeated.n, 0) AS n_repeat_words
    FROM w LEFT JOIN repeated ON repeated.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    n_lines, n_punctuation, n_navigation, n_boilerplate, n_removed_words,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept, sha256(clean) AS clean_sha256
FROM base JOIN per USING (r)
"""

_OP2 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
seats AS (
    SELECT conv_id, speaker AS perspective
    FROM (SELECT conv_id, speaker, bool_or(speaker <> 'system') OVER (PARTITION BY conv_id) AS others FROM (SELECT DISTINCT conv_id, speaker FROM t))
    WHERE speaker <> 'system' OR NOT others),
made AS (
    SELECT t.conv_id, perspective, turn, speaker, text, speaker = perspective AS trained,
        CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS seat,
        '{chat.START}' || (CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END) || chr(10) AS header,
        header || text || '<|end|>' || chr(10) AS segment
    FROM t JOIN seats ON t.conv_id IS NOT DISTINCT FROM seats.conv_id),
placed AS (
    SELECT *, row_number() OVER o - 1 AS seq, coalesce(sum(len(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM made WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, seq, speaker, seat, segment, trained, start,
    CASE WHEN trained THEN start + len(header) END AS mask_start, CASE WHEN trained THEN start + len(segment) END AS mask_end
FROM placed
"""

_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS ws FROM documents),
b AS (SELECT item_id, ws, least(13, len(ws)) AS width FROM (SELECT item_id, {_TERMS} AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, width, array_to_string(ws[i:i + width - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - width + 2)) AS i FROM b)),
grams AS (
    SELECT r, i, width, array_to_string(ws[i:i + width - 1], ' ') AS gram
    FROM (SELECT r, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM windows))),
found AS (SELECT r, i, width, item_id FROM grams JOIN windows USING (width, gram)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT r, i, width FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r),
-- near: distinct terms of each window, how often a document has them, documents that have all but one in {positional_index.SPARE}
wins AS MATERIALIZED (SELECT row_number() OVER () AS w, width, gram, string_split(gram, ' ') AS ws FROM (SELECT DISTINCT width, gram FROM windows)),
terms AS MATERIALIZED (
    SELECT w, width, term, min(place) AS place, count(*) OVER (PARTITION BY w) AS n_terms
    FROM (SELECT w, width, unnest(ws) AS term, unnest(range(len(ws))) AS place FROM wins) GROUP BY w, width, term),
spots AS MATERIALIZED (
    SELECT r, term, list(p) AS ps, count(*) AS n FROM (SELECT r, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM d)
    WHERE term IN (SELECT term FROM terms) GROUP BY r, term),
near_pairs AS (
    SELECT r, w FROM spots JOIN terms USING (term) GROUP BY r, w HAVING count(*) >= any_value(n_terms) - any_value(n_terms) // {positional_index.SPARE}),
rare AS (
    SELECT r, w, width, term, ps FROM (
        SELECT r, w, width, term, ps, row_number() OVER (PARTITION BY r, w ORDER BY n, place) AS nr
        FROM near_pairs JOIN terms USING (w) JOIN spots USING (r, term)) WHERE nr <= {positional_index.RAREST}),
rare_at AS (SELECT r, w, width, term, unnest(ps) AS p FROM rare),
ahead AS (
    SELECT s.r, s.w, s.width, s.p, e.term, min(e.p) AS q FROM (SELECT DISTINCT r, w, width, p FROM rare_at) s
    JOIN rare_at e ON e.r = s.r AND e.w = s.w AND e.p >= s.p GROUP BY s.r, s.w, s.width, s.p, e.term),
runs AS (SELECT r, w, width, p, max(q) - p + 1 AS span, count(*) AS n FROM ahead GROUP BY r, w, width, p),
close AS (
    SELECT DISTINCT runs.r, runs.w FROM runs JOIN (SELECT r, w, count(*) AS n FROM rare GROUP BY r, w) USING (r, w, n) WHERE span <= width + {positional_index.SLOP}),
near_items AS (
    SELECT r, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM close JOIN wins USING (w) JOIN windows USING (width, gram)
          EXCEPT SELECT DISTINCT r, item_id::VARCHAR FROM found) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN near_items USING (r)
"""

_EDGE = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
cut AS (SELECT r, source, text, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT r, source, text, nr, ls[nr] AS line, trim(ls[nr], {_EDGE}) AS bare FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS nr FROM cut)),
totals AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INT) AS pages FROM d GROUP BY source),
plates AS (
    SELECT l.source, bare FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE bare <> '' GROUP BY l.source, bare
    HAVING count(DISTINCT text) >= {site_lines.REPEATED} AND count(DISTINCT text) > {site_lines.RATIO}::DOUBLE * any_value(pages)),
kept AS (
    SELECT r, count(*) AS n_lines, count(p.bare) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (p.bare IS NULL), '') AS text
    FROM lines l LEFT JOIN plates p ON l.source IS NOT DISTINCT FROM p.source AND l.bare = p.bare GROUP BY r)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(kept.text) AS text_sha256 FROM d LEFT JOIN kept USING (r)
"""



def _assigned(nr: int) -> str:
    """Each vector with its nearest centroid of table c{nr}."""
    far = "list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return (
        f"a{nr} AS MATERIALIZED (SELECT r, vec_id, v, arg_min(k, d * 16 + k) AS cluster, min(d) AS distance "
        f"FROM (SELECT r, vec_id, v, k, {far} AS d FROM kept, c{nr}) GROUP BY r, vec_id, v)"
    )


def _moved(nr: int) -> str:
    """The centroids after the assignment a{nr}; those of empty clusters stay."""
    floor = "(s - ((s % n) + n) % n) // n"
    return f"""
sums{nr} AS (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS pos FROM a{nr}) GROUP BY cluster, pos),
c{nr + 1} AS MATERIALIZED (
    SELECT k, coalesce(own, w) AS w FROM c{nr} LEFT JOIN (SELECT cluster, list(({floor})::BIGINT ORDER BY pos) AS own FROM sums{nr} GROUP BY cluster) ON k = cluster)"""


_OP11 = f"""
WITH fine AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM fine),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v AS w
    FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 16)),
{_assigned(0)},{_moved(0)},
{_assigned(1)},{_moved(1)},
{_assigned(2)},{_moved(2)},
{_assigned(3)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON k = cluster
"""

_OP12 = """
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
anchors AS (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT vec_id AS anchor_id, label AS own, v AS av FROM kept WHERE vec_id % 50 = 0)),
scored AS MATERIALIZED (
    SELECT a, anchor_id, r, vec_id, label = own AS same, list_dot_product(av, v)::BIGINT AS score
    FROM anchors JOIN kept ON vec_id IS DISTINCT FROM anchor_id),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS p FROM scored WHERE same) WHERE p <= 5),
fit AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
    FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM fit WHERE rank <= 3
"""

SQL = {"op11_heap_kmeans": _OP11, "op12_tree_negatives": _OP12, "op1_line_rules": _OP1, "op2_chat_rotation": _OP2, "op6_positional_index": _OP6, "op9_site_lines": _OP9}
