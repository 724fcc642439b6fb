"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnote.llm import bpe, chat, htmltext, media, minhash, mixing, neighbours, passages, prefixes, quality, toxicity, variants, warc
from trailnote.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ", "))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicas(table(spark, sf_dir, "documents"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(turns), F.lit(said).alias("text")).select("conv_id", "turn", "role", "text")
    return chat.digests(rows.select("conv_id", "turn", "role", "text").union(extra))


def op9_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(table(spark, sf_dir, "documents")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("n_links")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    placed = prefixes.turns(table(spark, sf_dir, "conversations"))
    return prefixes.trie(prefixes.rebuilt(placed, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.counted(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split(translate(t, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(9)||chr(11)||chr(12)||chr(13)||' ', '')) > 0) AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i+4] AS gram FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1))) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 5) o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(translate(t, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ', ''))::BIGINT AS word_chars,
      (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in quality.STOP_WORDS)}], lower(rtrim(x, '.,;:!?'))))) AS n_stop,
      length(t) - length(replace(t, '!', '')) AS n_shouts
      FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(', ', {{rules}}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, NOT base_failed AND failed_rules = '' AS kept FROM v
"""
_RATIOS = {
    "n_words": "n_words",
    "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)",
    "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0), 0)",
    "shouts_per_word": "coalesce(n_shouts / nullif(n_words, 0), 0)",
    "stop_ratio": "coalesce(n_stop / nullif(n_words, 0), 0)",
    "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
}
_RULES = ", ".join(f"CASE WHEN n_words >= {since} AND NOT ({_RATIOS[m]} BETWEEN {lo} AND {hi}) THEN '{rule}' END" for rule, m, lo, hi, since in quality.THRESHOLDS)

_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""

_OP8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(text) - length(translate(text, '\#<', '')) AS escaped,
             length(role) + length(role) - length(translate(role, '\#<:', '')) AS escaped_role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + escaped_role + 14)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END)
         AND bool_or(from_end = 1 AND role IN ('user', 'assistant')) AS valid
FROM e GROUP BY conv_id
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) >= 5 THEN words[i:i+4] ELSE words END AS gram FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(list_sort(list(gram))::VARCHAR) AS whole FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
arcs AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(id, other) AS (SELECT a, b FROM arcs UNION SELECT r.id, arcs.b FROM reach r JOIN arcs ON r.other = arcs.a),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(component, d.doc_id)) AS component_id, coalesce(k.class_id, d.doc_id) AS class_id, d.doc_id = least(d.doc_id, coalesce(component, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""


def _crc32(numbers: str) -> str:
    """SQL of the CRC-32 of a list of byte values, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda a, b: {step}))"


_OP11 = f"""
WITH t AS (SELECT conv_id, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS place FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS giver, {_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS part, place, said, bytes FROM c JOIN o ON o.conv_id = c.giver AND place <= h UNION ALL SELECT c.conv_id, 1, place, said, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND place > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, said, bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
p AS (SELECT conv_id, depth, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix, bytes FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY depth, prefix),
u AS (SELECT n.depth, n.prefix, q.prefix AS above, m.conv_id AS parent FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 JOIN n m ON m.depth = q.depth AND m.prefix = q.prefix),
k AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM u GROUP BY ALL),
s AS (SELECT q.depth, q.prefix, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves FROM n LEFT JOIN k USING (depth, prefix) JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY ALL),
e AS (SELECT p.depth, p.prefix, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) l USING (conv_id, depth) GROUP BY ALL)
SELECT n.conv_id, n.depth, u.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s USING (depth, prefix) LEFT JOIN u USING (depth, prefix) LEFT JOIN k USING (depth, prefix) LEFT JOIN e USING (depth, prefix)
"""

_OP13 = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
b AS (SELECT run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, times, {_crc32("list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::BIGINT)")} AS h FROM b),
x AS (SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
k AS (SELECT word, i, left(word, i::BIGINT) || substr(word, i::BIGINT + 2) AS key FROM w, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
p AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b USING (key, i) WHERE a.word <> b.word UNION SELECT w.word, k.word FROM w JOIN k ON k.key = w.word UNION SELECT k.word, w.word FROM w JOIN k ON k.key = w.word),
g AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS other, max(w.n) AS other_n FROM p JOIN w ON w.word = p.b GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN g USING (word)),
z(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.form)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word AND z.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_html_main_text, op2_byte_bpe, op3_quality_rules, op4_repeated_passages, op5_poisson_mixing, op6_toxicity_chain, op7_warc_chunks, op8_chat_format, op9_media_fingerprints, op10_minhash_near_dedup, op11_prefix_trie, op12_nearest_vectors, op13_spelling_variants)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express. The others are tested against brute force."""
    return {"op3_quality_rules": _OP3.replace("{rules}", _RULES), "op5_poisson_mixing": mixing.ORACLE, "op7_warc_chunks": _OP7, "op8_chat_format": _OP8, "op10_minhash_near_dedup": _OP10, "op11_prefix_trie": _OP11, "op13_spelling_variants": _OP13}
