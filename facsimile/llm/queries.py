"""The registered queries of this subpackage, and their SQL checks where SQL can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path

from facsimile.llm.byte_bpe import encode_texts
from facsimile.llm.centroids import fit_centroids
from facsimile.llm.chat import link_tools
from facsimile.llm.contamination import contained_items
from facsimile.llm.dac import read_tokens, write_tokens
from facsimile.llm.fill_middle import fill_middle, restored_text
from facsimile.llm.jaccard import jaccard_components
from facsimile.llm.labelled import fold
from facsimile.llm.line_rules import judge_lines
from facsimile.llm.quality_vote import fit_vote
from facsimile.llm.simhash import near_duplicates
from facsimile.llm.suffix import remove_repeats
from facsimile.llm.toxicity import fit_toxicity
from facsimile.llm.warc import derivatives


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_tool_linking(spark, sf_dir):
    """The table has no tool calls, so every turn of an assistant stands for one and the user's next turn for its result.

    Ids repeat in every conversation, arguments refer to earlier calls (in every ninth
    conversation to later ones too: a cycle), and some calls break their schema.
    """
    turns = _read(spark, sf_dir, "conversations")
    conv, turn, word = F.col("conv_id"), F.col("turn"), F.regexp_extract("text", "[A-Za-z]+", 0)
    made = turns.filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.lit(0).alias("position"),
        F.concat(F.lit("call_"), turn.cast("string")).alias("call_id"),
        F.when(conv % 7 == 1, "fetch").when(conv % 7 == 2, "lookup").otherwise("search").alias("name"),
        F.concat(
            F.lit('{ "query" : "'), word, F.lit('", "limit": '),
            F.when(conv % 5 == 0, F.concat(F.lit('"'), F.length("text").cast("string"), F.lit('"'))).otherwise(F.length("text").cast("string")),
            F.when(turn >= 2, F.concat(F.lit(', "after":{"$ref":"call_'), (turn - 2).cast("string"), F.lit('"}'))).otherwise(""),
            F.when((conv % 9 == 0) & (turn < 2), F.concat(F.lit(', "after":{"$ref":"call_'), (turn + 2).cast("string"), F.lit('"}'))).otherwise(""),
            F.when(conv % 11 == 0, "").otherwise("}"),
        ).alias("arguments"),
    )
    results = turns.filter("role = 'user' AND turn > 0").select(
        "conv_id", "turn", F.concat(F.lit("call_"), (turn - 1).cast("string")).alias("call_id"), F.col("text").alias("content")
    )
    tools = [("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "after", "string", False)]
    tools += [("fetch", "query", "string", True), ("fetch", "limit", "integer", False), ("fetch", "url", "string", True)]
    schemas = spark.createDataFrame(tools, "name string, argument string, type string, required boolean")
    return link_tools(made, results, schemas).select(
        "conv_id", "call_id", "turn", "name", "depth", "status", F.array_join("problems", ",").alias("problems"), "json"
    )


def op3_warc_derivatives(spark, sf_dir):
    """Pages as the responses of a crawl that fetched one a second."""
    page = F.col("page_id").cast("string")
    responses = _read(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), F.md5(F.concat_ws(" ", page, "url").cast("binary")), F.lit(">")).alias("record_id"),
        F.col("url").alias("uri"),
        F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("X-Page"), page).alias("headers"),
        F.col("html").alias("payload"),
    )
    head = F.col("headers")
    return derivatives(responses).select(
        "row.page_id", "kind", F.col("row.record_id").alias("refers_to"), "record_id", head["WARC-Target-URI"].alias("target_uri"),
        head["WARC-Date"].alias("date"), head["WARC-Source-Payload-Digest"].alias("source_digest"),
        head["WARC-Block-Digest"].alias("block_digest"), F.sha1("block").alias("block_sha1"),
        F.length("block").cast("bigint").alias("content_length"), F.size("links").cast("bigint").alias("n_links"),
    )


def op2_suffix_array_dedup(spark, sf_dir):
    found = remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.length)
    return found.select(
        "row.doc_id",
        (F.length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_quality_vote(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    scored = fit_vote(docs, labels, held_out).score(docs).select("row.doc_id", "score")
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op6_benchmark_decontamination(spark, sf_dir):
    found = contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("row_id").alias("doc_id"), "item_id", "n_shared", "n_item")


def op7_line_frequency_rules(spark, sf_dir):
    return judge_lines(_read(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_toxicity(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    scored = fit_toxicity(docs, labels, held_out).score(docs).select("row.doc_id", "score")
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_addressable_codes(spark, sf_dir):
    segments = write_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, special_tokens=True)
    return read_tokens(segments).select(
        F.col("row_id").alias("doc_id"), "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op10_byte_bpe(spark, sf_dir):
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    decoded = encode_texts(_read(spark, sf_dir, "documents"), ranks, PATTERN, decoded=True)
    return decoded.select(
        "row.doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_fill_middle(spark, sf_dir):
    made = fill_middle(_read(spark, sf_dir, "documents"))
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored_text(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_centroid_clusters(spark, sf_dir):
    clusters = fit_centroids(_read(spark, sf_dir, "embeddings"))
    if clusters is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.labelled().select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_jaccard_join(spark, sf_dir):
    return jaccard_components(_read(spark, sf_dir, "documents")).select("row.doc_id", "n_shingles", "component_id")


# Words are what ASCII white space separates; only A-Z change case.
WORDS_SQL = r"""[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> '']"""

# An item of fewer than five words is one shingle of as many words.
SHINGLES_SQL = "unnest(list_distinct([array_to_string(w[i + 1:i + k], ' ') FOR i IN range(0, greatest(0, len(w) - k + 1))]))"

DECONTAMINATION_SQL = f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
     d AS (SELECT doc_id, w, k FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents), (SELECT DISTINCT k FROM i)),
     iu AS (SELECT item_id, k, {SHINGLES_SQL} AS g FROM i),
     du AS (SELECT doc_id, k, {SHINGLES_SQL} AS g FROM d),
     n AS (SELECT item_id, count(*) AS n_item FROM iu GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM iu JOIN du USING (k, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""

TOOL_LINKING_SQL = """
WITH c AS (SELECT conv_id, turn, 'call_' || turn AS call_id, length(text) AS n, regexp_extract(text, '[A-Za-z]+') AS word,
                  CASE conv_id % 7 WHEN 1 THEN 'fetch' WHEN 2 THEN 'lookup' ELSE 'search' END AS name, conv_id % 11 = 0 AS broken,
                  CASE WHEN turn >= 2 THEN turn - 2 WHEN conv_id % 9 = 0 THEN turn + 2 END AS wants
           FROM conversations WHERE role = 'assistant'),
     i AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
     d AS (SELECT *, row_number() OVER w - 1 AS place, min(turn) OVER w2 AS first, count(*) OVER w2 AS size FROM i
           WINDOW w AS (PARTITION BY conv_id, turn % 2, island ORDER BY turn), w2 AS (PARTITION BY conv_id, turn % 2, island)),
     k AS (SELECT *, CASE WHEN broken THEN 0 WHEN conv_id % 9 = 0 AND first < 2 AND size > 1 THEN NULL ELSE place END AS depth FROM d),
     r AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'user' AND turn > 0),
     j AS (SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, coalesce(k.call_id, r.call_id) AS call_id, turn, name, depth, word, n, broken, wants,
                  CASE WHEN k.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'open' ELSE 'linked' END AS status, result
           FROM k FULL JOIN r ON k.conv_id = r.conv_id AND k.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, depth, status,
       CASE WHEN status <> 'orphan' THEN array_to_string(list_sort([x FOR x IN [
           CASE WHEN name = 'lookup' THEN 'tool' WHEN broken THEN 'json' END,
           CASE WHEN broken AND name <> 'lookup' THEN 'missing:query' END,
           CASE WHEN broken AND name = 'search' THEN 'missing:limit' END,
           CASE WHEN name = 'fetch' THEN 'missing:url' END,
           CASE WHEN NOT broken AND name <> 'lookup' AND conv_id % 5 = 0 THEN 'type:limit' END,
           CASE WHEN NOT broken AND name <> 'search' AND wants IS NOT NULL THEN 'unknown:after' END,
           CASE WHEN NOT broken AND name = 'lookup' THEN 'unknown:limit' END,
           CASE WHEN NOT broken AND name = 'lookup' THEN 'unknown:query' END] IF x IS NOT NULL]), ',') END AS problems,
       '{' || array_to_string([x FOR x IN [
           CASE WHEN NOT broken THEN '"arguments":{' || CASE WHEN wants IS NULL THEN '' ELSE '"after":{"$ref":"call_' || wants || '"},' END ||
               '"limit":' || CASE WHEN conv_id % 5 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || ',"query":"' || word || '"}' END,
           '"depth":' || depth, '"id":"' || call_id || '"', '"name":"' || name || '"', '"result":' || to_json(result)::VARCHAR, '"turn":' || turn
       ] IF x IS NOT NULL], ',') || '}' AS json
FROM j
"""

LINE_RULES_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, source, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
                  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
     g AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 7))) AS p FROM w)),
     r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
     c AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM r, range(0, 8) AS s(o) GROUP BY doc_id),
     b AS (SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                  coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
     f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
     x AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS line,
                  len([y FOR y IN regexp_split_to_array(line, '[\x20\x09-\x0D]+') IF y <> '']) AS n FROM (SELECT doc_id, source, unnest(l) AS line FROM w)),
     o AS (SELECT source, line FROM x GROUP BY source, line HAVING count(DISTINCT doc_id) > 10),
     k AS (SELECT doc_id, sum(n) FILTER (o.line IS NULL) AS n FROM x LEFT JOIN o ON x.source = o.source AND x.line = o.line GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * coalesce(k.n, 0) >= 50 * n_words AS kept
FROM f LEFT JOIN k USING (doc_id)
"""

FILL_MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                  ('0x' || h[25:32])::BIGINT AS h4 FROM t),
     k AS (SELECT *, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM d),
     p AS (SELECT doc_id, text, len(l) AS n, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle,
                  array_to_string(l[b + 1:], '') AS suffix,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _centroids_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds as one common table each; ``a{n}`` assigns to the centroids of ``c{n}``."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
     a{n} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (
         SELECT vec_id, x, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM (
             SELECT vec_id, x, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, m)])::BIGINT AS d FROM v, c{n})) WHERE place = 1)""")
        if n < rounds:
            steps.append(f"""
     c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(q.m, c{n}.m) AS m FROM c{n} LEFT JOIN (
         SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS m FROM (
             SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, range(1, {dims + 1}) AS r(i) GROUP BY c, i) GROUP BY c) q ON q.c = c{n}.c)""")
    return f"""
WITH v AS MATERIALIZED (
         SELECT vec_id, [floor(1024 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x, sha256('3:' || vec_id) AS h FROM embeddings
         WHERE len(embedding) = {dims} AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = {dims}),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS m FROM v ORDER BY h LIMIT {k}),{",".join(steps)},
     t AS (SELECT c, sum(d) AS total FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, d AS distance, total::BIGINT AS cluster_inertia, (SELECT sum(total) FROM t)::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c JOIN t ON t.c = a.c
"""


QUERIES = {
    "op1_chat_tool_linking": op1_chat_tool_linking,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_quality_vote": op4_quality_vote,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_line_frequency_rules": op7_line_frequency_rules,
    "op8_toxicity": op8_toxicity,
    "op9_addressable_codes": op9_addressable_codes,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_fill_middle": op11_fill_middle,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLES = {
    "op1_chat_tool_linking": TOOL_LINKING_SQL,
    "op6_benchmark_decontamination": DECONTAMINATION_SQL,
    "op7_line_frequency_rules": LINE_RULES_SQL,
    "op11_fill_middle": FILL_MIDDLE_SQL,
    "op12_centroid_clusters": _centroids_sql(),
}
