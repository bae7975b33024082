"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from graphspark.llm import chat_format, common, decontaminate, language_id, near_dedup, packing, quality_model, quality_rules, suffix_dedup, token_counts, token_files


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(common.table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(common.table(spark, sf_dir, "documents"), common.fresh_dir(spark, "tokens"))
    return token_files.read_tokens(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda key, start, ids: (key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(common.table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, common.table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_lines(common.table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    made = common.persisted(chat_format.format_conversations(turns.union(added)), "chats")
    return chat_format.read_back(made).drop("n_tokens")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_near_dedup, op3_token_files, op4_suffix_dedup, op5_quality_rules, op6_quality_model, op7_token_counts, op8_pack, op9_chat_format, op10_language_id)}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = r"regexp_replace({}, '([\[<])(\\*)(INST\]|/INST\]|/s>)', '\1\2\\\3', 'g')"
ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH doc AS (SELECT doc_id, coalesce({_WORDS}, []) w FROM documents),
item AS (SELECT item_id, {_WORDS} w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) i FROM item WHERE len(w) > 0)),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) i FROM doc),
gram AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') g FROM place, (SELECT DISTINCT l FROM win) WHERE i + l - 1 <= len(w)),
hit AS (SELECT doc_id, i, l, item_id FROM gram JOIN win USING (l, g)),
covered AS (SELECT doc_id, count(DISTINCT i + k) n FROM (SELECT doc_id, i, unnest(range(0, l)) k FROM (SELECT DISTINCT doc_id, i, l FROM hit)) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(covered.n, 0)::BIGINT n_hit, coalesce(found.n, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(covered.n, 0) > 0 contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_chat_format": f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
sum(17 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT formatted_chars
FROM turns GROUP BY 1""",
}
