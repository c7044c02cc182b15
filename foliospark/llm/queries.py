"""The queries that apply the operators, with production parameters, to the whole driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import chat_tree, conversation_trie, html_extract, language_id, nearest, ngram_join, packing, periodic_runs, simhash_join, token_counts, toxicity
from foliospark.llm.bpe_codec import encode_decode
from foliospark.llm.common import fold, table
from foliospark.llm.quality_rules import quality_rules
from foliospark.llm.registry import query

GPT = packing.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def pack_with_digests(docs: DataFrame) -> DataFrame:
    out = packing.pack_documents(docs, GPT, payload=packing.ids_crc32, payload_type="long")
    return out.withColumnRenamed("payload", "ids_crc32")


@query("op2_pack")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_digests(table(spark, sf_dir, "documents"))


@query("op3_nearest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Labels are learnt from rows whose fold of four is not 2."""
    return toxicity.train(spark, docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scores.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query("op5_bpe_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


#: E-mail addresses, IPv4 addresses and phone numbers, as the token-count query masks them.
MASKED = r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+?\d[\d ()-]{7,}\d"


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after two edits that a cleaning run makes: personal data is masked, then a source line is put in front."""
    docs = table(spark, sf_dir, "documents")
    front = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.concat(F.lit("source: "), F.coalesce("source", F.lit("unknown")), F.lit("\n")).alias("insert")))
    edits = F.concat(token_counts.replacements(F.col("text"), MASKED, "[masked]"), front.cast(token_counts.EDITS))
    return token_counts.count_with_edits(docs, edits, token_counts.Counter(GPT.path, GPT.pattern, GPT.spare))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op8_chat_tree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat_tree.read_back(*chat_tree.prefix_trees(rows))
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query("op9_html_extract")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def language_model(spark: SparkSession, docs: DataFrame) -> language_id.Model:
    """Languages are learnt from rows whose fold of three is not 1."""
    return language_id.train(spark, docs, fold(F.col("doc_id"), 3) != 1, public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_model(spark, docs)).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


#: CRC-32 of a decimal id, bit by bit: its bytes, each followed by eight shifts.
CRC_SQL = """(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
 lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END))"""

TRIE_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list(struct_pack(id := md5(length(role) || ':' || role || text), chars := length(text)) ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
 r AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(o.own, h + 1, len(o.own))) AS turns
       FROM (SELECT *, xor({CRC_SQL}, 4294967295) % 6 AS h FROM o) o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
 p AS (SELECT conv_id, d, len(turns) = d AS ends, coalesce(turns[d].chars, 0) AS chars, md5(array_to_string(list_transform(list_slice(turns, 1, d), lambda x: x.id), ',')) AS id,
       CASE WHEN d > 0 THEN md5(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda x: x.id), ',')) END AS up FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
 n AS (SELECT id, d AS depth, min(conv_id) AS conv_id, any_value(up) AS up, any_value(chars) AS chars, count(*) AS n_convs,
       sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY id, d),
 k AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
 m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.id AND k.depth = n.depth),
 s AS (SELECT p.id, p.d AS depth, sum((m.n_children = 0)::BIGINT) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.depth GROUP BY ALL)
 SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
        s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256 FROM m JOIN s ON s.id = m.id AND s.depth = m.depth LEFT JOIN m u ON u.id = m.up AND u.depth = m.depth - 1"""


@query("op11_conversation_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


@query("op13_simhash_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, budget=4)
