"""The queries of the training-data operators, each over a whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bitplane_tokens, bpe_count, bwt_repeats, decontaminate, hard_negatives, order_minhash, preference_chat, progressive_jpeg, quality_ftrl, sentencepiece_codec, simhash_pivots, vector_codes, window_dedup
from seqloom.llm.common import documents, shared_dir, table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the folder is the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.store_texts(documents(spark, sf_dir))


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    bitplane_tokens.write_token_files(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), path)
    return bitplane_tokens.read_documents(spark, path)


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_ftrl.fit(docs, table(spark, sf_dir, "labels"))
    return quality_ftrl.score(docs, model)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_chat.paired(preference_chat.swapped_endings(table(spark, sf_dir, "conversations")))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


def op13_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_order_minhash, op3_progressive_jpeg, op4_bitplane_tokens, op5_quality_ftrl, op6_token_counts, op7_preference_chat, op8_suffix_array, op9_decontaminate, op10_substring_dedup, op11_vector_codes, op12_hard_negatives, op13_simhash_pivots)}

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS width, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM b, range(1, len(words) - least(len(words), 10) + 2) r(i) WHERE len(words) > 0),
dw AS (
  SELECT doc_id, width, i AS pos, array_to_string(words[i:i + width - 1], ' ') AS win
  FROM w, (SELECT DISTINCT width FROM bw) s, range(1, len(words) - width + 2) r(i)),
h AS (SELECT doc_id, pos, bw.width, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, range(pos, pos + width) r(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i AS pos, array_to_string(words[i:i + 49], ' ') AS win FROM w, range(1, len(words) - 48) r(i)),
least_id AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT win.doc_id, p FROM win JOIN least_id ON win.win = least_id.win AND least_id.first < win.doc_id, range(win.pos, win.pos + 50) r(p)),
kept AS (
  SELECT w.doc_id, count(*) AS n_kept, string_agg(words[i], ' ' ORDER BY i) AS kept
  FROM w, range(1, len(words) + 1) r(i) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = i WHERE gone.p IS NULL GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH last AS (
  SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, c.role, c.text FROM conversations c JOIN last ON last.conv_id = c.conv_id AND last.turn > c.turn
  UNION ALL
  SELECT l.conv_id, 'rejected', l.turn, n.role, n.text FROM last l JOIN last n ON n.conv_id = l.conv_id + 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM sides),
places AS (
  SELECT pair_id, place, max(role) FILTER (side = 'chosen') AS cr, max(text) FILTER (side = 'chosen') AS ct,
         max(role) FILTER (side = 'rejected') AS rr, max(text) FILTER (side = 'rejected') AS rt
  FROM numbered GROUP BY pair_id, place),
split AS (SELECT pair_id, min(place) FILTER (NOT coalesce(cr = rr AND ct = rt, false)) AS ends FROM places GROUP BY pair_id),
cut AS (SELECT places.*, (ends IS NULL OR place < ends) AS shared FROM places JOIN split USING (pair_id))
SELECT pair_id, place, CASE WHEN shared THEN '<|im_start|>' || cr || chr(10) || ct || '<|im_end|>' || chr(10) END AS prompt,
       CASE WHEN NOT shared THEN '<|im_start|>' || cr || chr(10) END AS chosen_header, CASE WHEN NOT shared THEN ct || '<|im_end|>' || chr(10) END AS chosen_body,
       CASE WHEN NOT shared THEN CAST(cr = 'assistant' AS INTEGER) END AS chosen_mask,
       CASE WHEN NOT shared THEN '<|im_start|>' || rr || chr(10) END AS rejected_header, CASE WHEN NOT shared THEN rt || '<|im_end|>' || chr(10) END AS rejected_body,
       CASE WHEN NOT shared THEN CAST(rr = 'assistant' AS INTEGER) END AS rejected_mask
FROM cut
"""

#: Components that no distance or product can be made of.
UNUSABLE = "list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))"

OP11_PARTS = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len({UNUSABLE}) = 0),
p AS (SELECT vec_id, label, q AS part, e[q * (len(e) // 8) + 1:(q + 1) * (len(e) // 8)] AS x FROM v, range(8) r(q)),
b0 AS (SELECT part, rank - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p) WHERE rank <= 16)"""


def op11_sql(rounds: int = 6) -> str:
    """One step for each round."""
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [OP11_PARTS]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT vec_id, label, part, x, (min({{'d': d, 'entry': entry}})).d AS d, (min({{'d': d, 'entry': entry}})).entry AS entry
  FROM (SELECT vec_id, label, p.part, p.x, b.entry, CAST({distance} AS BIGINT) AS d FROM p JOIN b{k} b USING (part)) GROUP BY vec_id, label, part, x)""")
        if k < rounds:
            steps.append(f"""m{k + 1} AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x
  FROM (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) r(i) GROUP BY part, entry, i) GROUP BY part, entry),
b{k + 1} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k + 1} m USING (part, entry))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
"""


OP12_SQL = f"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len({UNUSABLE}) = 0),
s AS (
  SELECT a.id AS anchor, r.id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r ON a.id <> r.id WHERE a.id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""

ORACLES = {"op11_vector_codes": op11_sql(), "op12_hard_negatives": OP12_SQL, "op7_preference_chat": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op9_decontaminate": OP9_SQL}
