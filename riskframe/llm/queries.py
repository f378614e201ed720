"""The operators applied to their whole tables, with DuckDB SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (chat_format, decontaminate, embedding_dedup, html_extract, license_scan, ngram_join, packing,
                           ranked_search, sharding, suffix_dedup, token_files, toxicity, whitening)
from riskframe.llm.common import read_table

TOXIC_AT = 0.7
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op4_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents")).drop("key")


def op6_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_previous_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc_id: str) -> Column:
    """Documents whose labels the fit never sees."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op8_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return (toxicity.score(docs, model).withColumn("held_out", held_out("doc_id"))
            .withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    plain = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = plain.unionByName(own).withColumn("content", chat_format.text_part(F.col("text")))
    back = chat_format.read_formatted(chat_format.format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)(/?turn|image|audio|document)', '<\\\1\2', 'g') AS coded,
         replace(replace(replace(role, '%', '%25'), '>', '%3E'), chr(10), '%0A') AS named FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ') + length(named) + length('>' || chr(10)) + length(coded)
                + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM d GROUP BY text),
w AS (SELECT class_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM c),
s AS (SELECT class_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
             lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS sh FROM w WHERE len(w) > 0),
e AS (SELECT class_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.class_id AS u, b.class_id AS v FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id
          GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
root AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
n AS (SELECT l.u, sum(c.copies) AS k FROM links l JOIN c ON c.class_id = l.v GROUP BY l.u),
known AS (SELECT s.class_id, c.copies - 1 + coalesce(n.k, 0) AS n_links, least(s.class_id, coalesce(root.v, s.class_id)) AS component_id
          FROM s JOIN c USING (class_id) LEFT JOIN n ON n.u = s.class_id LEFT JOIN root ON root.u = s.class_id)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links,
       coalesce(k.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(k.component_id, d.doc_id) AS kept
FROM d JOIN c USING (text) LEFT JOIN known k ON k.class_id = c.class_id
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
root AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, least(v.vec_id, coalesce(root.v, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(root.v, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id LEFT JOIN root ON root.u = v.vec_id
"""


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = sharding.with_slots(sharding.shuffle_shards(docs, sharding.default_path(docs)))
    return out.select(F.col("record.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"),
                      "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read_table(spark, sf_dir, "documents"), TOKENIZER)
    return token_files.read_token_files(manifest)


def op11_licence_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    # null beyond 64 bits; the operator itself gives 38 digits
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(text="coalesce(text, '')")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS.format(text="coalesce(text, '')")})) AS t FROM benchmark),
g AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t, n),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n) // l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT q, item_id, p.r, m.doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN p USING (t) JOIN f USING (t) JOIN m ON m.r = p.r GROUP BY q, item_id, p.r, m.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""


QUERIES = {
    "op1_pigeonhole_decontamination": op1_pigeonhole_decontamination,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op6_int8_embedding_dedup": op6_int8_embedding_dedup,
    "op7_previous_factor_dedup": op7_previous_factor_dedup,
    "op8_multiple_instance_toxicity": op8_multiple_instance_toxicity,
    "op4_cutting_stock_packing": op4_cutting_stock_packing,
    "op10_arrow_token_files": op10_arrow_token_files,
    "op5_chat_formatting": op5_chat_formatting,
    "op9_two_pass_shuffle": op9_two_pass_shuffle,
    "op11_licence_expressions": op11_licence_expressions,
    "op12_qdwh_whitening": op12_qdwh_whitening,
    "op13_pipelined_search": op13_pipelined_search,
}
ORACLES = {
    "op3_ngram_jaccard_join": OP3_SQL,
    "op6_int8_embedding_dedup": OP6_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op13_pipelined_search": OP13_SQL,
}
