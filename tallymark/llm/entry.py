"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import align, chat, decontam, exact, packing, pu, rules, shards, simhash, substring, tokens, toxicity, trie
from tallymark.llm.common import table


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.answer_swaps(table(spark, sf_dir, "conversations")))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), batches=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.judge(docs, rules.fit(docs, labels))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, most=4096)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), shards=24)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return pu.score(docs, pu.fit(docs, labels))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.regrafted_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_preference_format, op2_simhash_groups, op3_decontamination, op4_substring_dedup, op5_token_counts, op6_quality_rules, op7_toxicity, op8_packing, op9_sharding, op10_quality_classifier, op11_prefix_trie, op12_token_alignment, op13_exact_dedup)}

OP1_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(CAST(turn AS BIGINT), -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, coalesce(CAST(turn AS BIGINT), -1) ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, turn AS end_turn, nth AS end_nth, text AS answer FROM own WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, nth DESC) = 1
), known AS (
  SELECT o.*, e.end_turn, e.end_nth,
         CASE WHEN o.turn = e.end_turn AND o.nth = e.end_nth THEN coalesce(x.answer, '') ELSE o.text END AS other
  FROM own o LEFT JOIN ends e USING (conv_id) LEFT JOIN ends x ON x.conv_id = xor(o.conv_id, 1)
  WHERE e.end_turn IS NULL OR o.turn < e.end_turn OR (o.turn = e.end_turn AND o.nth <= e.end_nth)
), parts AS (
  SELECT conv_id AS pair_id, unnest(CASE WHEN text = other THEN ['prompt'] ELSE ['chosen', 'rejected'] END) AS part, turn, nth, role, text, other FROM known
), said AS (
  SELECT pair_id, part, CAST(floor(turn / 32.0) AS BIGINT) AS chunk, CAST((nth - 1) // 32 AS BIGINT) AS over, turn, nth, role,
         '<|im_start|>' || role || chr(10) AS head, CASE part WHEN 'rejected' THEN other ELSE text END || '<|im_end|>' || chr(10) AS body FROM parts
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, chunk, over ORDER BY turn, nth) AS stop FROM said
)
SELECT pair_id, part, chunk, over, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, nth) AS text,
       coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY turn, nth) FILTER (WHERE part <> 'prompt' AND role = 'assistant'), '') AS loss
FROM placed GROUP BY pair_id, part, chunk, over
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), spans AS (
  SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS line FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM spans)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS line
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM windows))
), met AS (
  SELECT doc_id, p.n, i, item FROM places p JOIN windows k ON k.n = p.n AND k.line = p.line
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM met WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS line FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY line)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM later
), lost AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""

OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS said FROM own GROUP BY conv_id
), heads AS (
  SELECT conv_id, said, conv_id - conv_id % 20 AS base,
         -- CRC-32 of the id's digits, bit by bit
         xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))]),
             lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 4 AS h
  FROM turns
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.said[1:a.h], []), a.said[a.h + 1:]) AS said FROM heads a LEFT JOIN turns b ON b.conv_id = a.base
), prefixes AS (
  SELECT conv_id, len(said) AS size, depth, said[1:depth] AS prefix, CASE WHEN depth > 0 THEN said[1:depth - 1] END AS parent FROM (SELECT *, unnest(range(0, len(said) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT prefix, any_value(parent) AS parent, min(conv_id) AS conv_id, depth, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends
  FROM prefixes GROUP BY prefix, depth
), kids AS (
  SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, n_children IS NULL AS leaf,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN kids k USING (prefix)
), under AS (
  SELECT p.prefix, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens FROM valued v JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.prefix
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN under USING (prefix) LEFT JOIN nodes u ON u.prefix = v.parent
"""

#: The others need XXH64, a tokenizer, a trained model or a sample; they are tested against brute force.
ORACLES: dict[str, str] = {"op1_preference_format": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op3_decontamination": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op13_exact_dedup": OP13_SQL}
