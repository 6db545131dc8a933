"""Registered queries of the operators for training data, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seawake.llm import (
    chat,
    collocations,
    compression,
    decontamination,
    html_extract,
    importance,
    minhash,
    ngram_join,
    packing,
    pii,
    prefix_trie,
    token_files,
    toxicity,
)
from seawake.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op6_ngram_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read(spark, sf_dir, "documents"), percent=75, width=5)


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


_CONTROL = r"\[/?INST\*?\]|\[ANS\*?\]|\[/?ROLE\]|\[TEXT\*?\]|</?s>"


@query(
    "op3_chat_format",
    rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE WHEN regexp_matches(text, '{_CONTROL}')
      THEN 1 + length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '{_CONTROL}')) ELSE length(text) END
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) + length(regexp_replace(role, '[^\\]', '', 'g'))
      + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars
  FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(3 + chars AS BIGINT) AS formatted_chars
FROM whole""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_probe(read(spark, sf_dir, "conversations")))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the folder can be set by ``SEAWAKE_TOKENIZERS``."""
    folder = os.environ.get("SEAWAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, vocabulary=49_408)


@query("op8_html_consensus")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(read(spark, sf_dir, "pages"))


@query("op9_compression_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_rules(read(spark, sf_dir, "documents"))


@query("op2_toxicity_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_importance_resampling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op12_prefix_trie",
    """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')],
      lambda a, b: list_reduce(range(8), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END, xor(a, b)),
      4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), turns AS (
  SELECT i.conv_id, t.place, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base AND t.place <= i.h
  UNION ALL SELECT i.conv_id, t.place, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.place > i.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(concat(length(role), ':', role, text)), '') OVER w AS path, strlen(text) AS bytes
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT a.path, sum((u.n_convs - 1) * u.bytes) AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM nodes u LEFT JOIN kids k USING (path) JOIN paths a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.path
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
  LEFT JOIN kids k ON k.path = n.path JOIN below b ON b.path = n.path LEFT JOIN ends e ON e.path = n.path""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


@query(
    "op13_collocations",
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?

]')) AS piece
    FROM documents)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL
), cuts AS (
  SELECT p.lang, p.k, p.phrase, p.f AS a, c.c, array_to_string(string_split(p.phrase, ' ')[: c.c], ' ') AS head,
    array_to_string(string_split(p.phrase, ' ')[c.c + 1 :], ' ') AS rest
  FROM f p JOIN (SELECT unnest([1, 2]) AS c) c ON c.c < p.k WHERE p.f >= 10
), scored AS (
  SELECT x.*, h.f AS l, t.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.rest
), candidates AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[: 2], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS part
    FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer g ON g.lang = c.lang AND g.part = c.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) QUALIFY rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(read(spark, sf_dir, "documents"))


@query("op11_minhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.similar_groups(read(spark, sf_dir, "documents"), percent=80, width=4)
