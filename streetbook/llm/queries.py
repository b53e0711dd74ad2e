"""The registered queries of the text operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetbook.llm import ann_hnsw, byte_bpe, chat_format, exact_dedup, knn_join, language_id, line_dedup, mixing, prefix_trie, simhash_dedup
from streetbook.llm import suffix_dedup, token_alignment, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP6_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)
"""


@register("op6_exact_dedup", OP6_SQL)
def op6(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", exact_dedup.normalised(F.col("text")).alias("text"))
    out = exact_dedup.exact_groups(docs, F.col("text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_key.sha")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS o FROM documents),
b AS (SELECT *, CASE WHEN o = '' THEN 0 ELSE CAST('0x' || substr(o, 1, 8) AS BIGINT) % 1024 END AS bucket FROM d),
c AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun FROM b),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k FROM s),
w AS (SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM r),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS filled FROM l),
g AS (SELECT source, source_size, k, coalesce(least(filled * weight, CAST(cap AS DOUBLE)), 0.0::DOUBLE) AS target FROM f),
h AS (SELECT c.*, g.source_size, g.k, g.target, CAST(round(g.target) AS BIGINT) AS goal,
        CASE WHEN g.source_size > 0 THEN CAST(round(g.target) AS BIGINT) // g.source_size ELSE 0 END AS epochs
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * epochs + greatest(0, least(size, goal - epochs * source_size - begun)) AS taken
FROM h
"""


@register("op9_mixing", OP9_SQL)
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs).orderBy("position", "source", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken")


@register("op10_byte_bpe")
def op10(spark, folder):
    vocab = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), vocab)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op5_language_id")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    profiles = language_id.learn(docs.filter("not held_out"))
    return language_id.identify(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@register("op8_simhash_dedup")
def op8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash_dedup.near_groups(docs, shingle=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


OP2_CONTROL = "</s>[INST] ok [/INST]"
OP2_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{OP2_CONTROL}'), (-7, 1, 'assistant', '{OP2_CONTROL}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10)) + length(text)
    + len(regexp_extract_all(text, '<\\*\|(im_start|im_end|image|audio|document|endoftext)\|>|<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')))
    AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@register("op2_chat_format", OP2_SQL)
def op2(spark, folder):
    own = spark.createDataFrame([(-7, 0, "user", OP2_CONTROL), (-7, 1, "assistant", OP2_CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select(*own.columns).unionByName(own)
    turns = chat_format.format_turns(rows.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts")))
    out = chat_format.digests(turns)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@register("op4_ann_hnsw")
def op4(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann_hnsw.nearest(rows, rows.filter("vec_id % 20 = 0"), top=20)


@register("op7_token_counts")
def op7(spark, folder):
    docs, eod = table(spark, folder, "documents").select("doc_id", "text"), 50_256
    path = token_counts.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, eod)
    out = token_counts.count_tokens(spark, path, eod, head=token_counts.HEADER)
    return out.select(token_counts.header_id(F.col("head")).alias("doc_id"), "n_tokens", "closed")


@register("op3_suffix_dedup")
def op3(spark, folder):
    out = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op1_line_dedup")
def op1(spark, folder):
    out = line_dedup.remove_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@register("op11_knn_join", OP11_SQL)
def op11(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return knn_join.nearest(rows, rows.filter("vec_id % 50 = 0"), top=5)


@register("op12_token_alignment")
def op12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path
    out, _ = token_alignment.measure(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return out.select("doc_id", *token_alignment.COLUMNS)


#: crc32 of a short text bit by bit, as the SQL engine has none.
OP13_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda i: 0::UBIGINT)),
  lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""
OP13_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY place) AS own FROM t GROUP BY conv_id),
h AS (SELECT o.*, CAST({OP13_CRC.format("o.conv_id")} % 6 AS INTEGER) AS h, b.own AS base FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
c AS (SELECT conv_id, list_concat(coalesce(base[1:h], []), own[h + 1:]) AS turns FROM h),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS pre, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
n AS (SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY pre, depth),
k AS (SELECT pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.pre[depth].t) ELSE 0 END AS saved FROM n LEFT JOIN k USING (pre)),
s AS (SELECT pre[1:u] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS u FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s ON w.pre = s.pre LEFT JOIN n q ON w.depth > 0 AND q.pre = w.pre[1:w.depth - 1]
"""


@register("op13_prefix_trie", OP13_SQL)
def op13(spark, folder):
    turns = prefix_trie.numbered(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.trie(prefix_trie.with_shared_start(turns)).drop("node")
