"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import quality_model, toxicity
from tidewatch.llm.bpe import encode
from tidewatch.llm.conversations import format_chats
from tidewatch.llm.decontamination import decontaminate
from tidewatch.llm.html_text import extract
from tidewatch.llm.licenses import scan
from tidewatch.llm.merkle import document_leaves, manifest
from tidewatch.llm.packing import pack
from tidewatch.llm.passages import repeated_passages
from tidewatch.llm.quality_rules import STATISTICS, judge
from tidewatch.llm.simhash import near_duplicates
from tidewatch.llm.trie import prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]):
    QUERIES[plan.__name__] = plan
    return plan


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: each byte goes in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c), 256, 256, 256, 256, 256, 256, 256, 256]))"
    shifted = "xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x) ELSE {shifted} END))"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLES["op10_decontamination"] = r"""
WITH w AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
    FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
    SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
    FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, sizes)),
hit AS (SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, win)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit),
n_places AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
ids AS (
    SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS all_ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(all_ids, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM w LEFT JOIN n_places p USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode(table(spark, folder, "documents"), path, with_text=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(table(spark, folder, "documents"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *STATISTICS, base_failed.alias("base_failed"), "kept")


ORACLES["op5_quality_rules"] = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
    FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
    GROUP BY doc_id),
s AS (
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(ls) AS n_lines, len([i FOR i IN range(2, len(ws) + 1) IF ws[i] = ws[i - 1]]) AS n_stutters,
        length(t) - length(replace(t, '!', '')) AS n_exclamations, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
        strlen(t) AS n_bytes, length(t) AS n_chars
    FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_stutters > 3 * n_words
        OR 2 * n_exclamations > n_words OR 2 * n_capitals > word_chars OR (word_chars > 20 * n_words AND n_bytes * 2 < 3 * n_chars)) AS kept
FROM b
"""


@query
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op8_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality_model.score(documents, quality_model.train(documents, table(spark, folder, "labels")))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = toxicity.score(documents, toxicity.learn(documents, table(spark, folder, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("terms").cast("long").alias("n_terms"))


@query
def op7_chats(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))


ORACLES["op7_chats"] = r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
said AS (SELECT conv_id, p, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM t),
pre AS (SELECT conv_id, p, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS upto, max(p) OVER (PARTITION BY conv_id) AS n FROM said),
whole AS (SELECT n, upto, min(conv_id) AS conv_id, count(*) AS n_copies FROM pre WHERE p = n GROUP BY n, upto),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM pre q WHERE q.p = w.n AND q.p < q.n AND q.upto = w.upto))
SELECT k.conv_id, CAST((p - 1) // 1024 AS BIGINT) AS part, CAST(n AS BIGINT) AS n_turns, n_copies, string_agg(s, '' ORDER BY p) AS text
FROM kept k JOIN said USING (conv_id) GROUP BY k.conv_id, (p - 1) // 1024, n, n_copies
"""


@query
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_passages(table(spark, folder, "documents"))
    each = found.select("doc_id", "n_left", F.explode("passages").alias("passage"))
    return each.select("doc_id", "passage.first_word", "passage.n_words", F.col("passage.other_id").alias("first_doc_id"), "passage.similarity", "n_left")


@query
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(document_leaves(table(spark, folder, "documents")), "lang", "doc_id", "changed")


ORACLES["op13_merkle"] = rf"""
WITH RECURSIVE base AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS rid
    FROM (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
            CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0
                THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed
        FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents))),
lv AS (
    SELECT 0 AS l, lang, pos, n, leaf AS d FROM base
    UNION ALL
    SELECT l + 1, lang, pos // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY l, lang, pos // 2),
tops AS (SELECT lang, l AS h, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (
    SELECT 0 AS l, pos, n, d FROM tops
    UNION ALL
    SELECT l + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY l, pos // 2),
root AS (SELECT l AS h, d FROM up WHERE n = 1),
path AS (
    SELECT rid, b.l, b.pos >> b.l AS pos, s.d AS sib
    FROM (SELECT b.*, unnest(range(t.h)) AS l FROM base b JOIN tops t ON b.lang IS NOT DISTINCT FROM t.lang) b
    LEFT JOIN lv s ON s.l = b.l AND s.lang IS NOT DISTINCT FROM b.lang AND s.pos = xor(b.pos >> b.l, 1)
    UNION ALL
    SELECT rid, b.h + b.l, b.top >> b.l, s.d
    FROM (SELECT b.rid, t.h, t.pos AS top, unnest(range(r.h)) AS l FROM base b JOIN tops t ON b.lang IS NOT DISTINCT FROM t.lang, root r) b
    LEFT JOIN up s ON s.l = b.l AND s.pos = xor(b.top >> b.l, 1)),
proofs AS (SELECT rid, coalesce(string_agg(sib, '' ORDER BY l), '') AS sibs FROM path GROUP BY rid),
fold AS (
    SELECT rid, 0 AS l, changed AS d FROM base WHERE changed IS NOT NULL
    UNION ALL
    SELECT f.rid, f.l + 1, CASE WHEN p.pos % 2 = 1 THEN sha256(p.sib || f.d) ELSE sha256(f.d || coalesce(p.sib, '')) END
    FROM fold f JOIN path p ON p.rid = f.rid AND p.l = f.l),
folded AS (SELECT rid, max_by(d, l) AS d FROM fold GROUP BY rid)
SELECT b.doc_id, b.leaf, t.d AS subroot, r.d AS root, sha256(coalesce(p.sibs, '')) AS proof_sha256, coalesce(f.d, r.d) AS folded_root, coalesce(f.d, r.d) = r.d AS verified
FROM base b JOIN tops t ON b.lang IS NOT DISTINCT FROM t.lang CROSS JOIN root r LEFT JOIN proofs p USING (rid) LEFT JOIN folded f USING (rid)
"""


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS p,
        count(*) OVER (PARTITION BY conv_id) AS n, sha256(strlen(r) || ':' || r || x) AS d, len(regexp_extract_all(x, '[^ 	-]+')) AS words
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, any_value(n) AS n, any_value({crc32_sql("CAST(conv_id AS VARCHAR)")} % 4) AS h FROM t GROUP BY conv_id),
k AS (SELECT c.*, conv_id - conv_id % 20 AS base, least(h, coalesce((SELECT b.n FROM c b WHERE b.conv_id = c.conv_id - c.conv_id % 20), 0)) AS k FROM c),
turns AS (
    SELECT k.conv_id, t.p AS depth, d, words FROM k JOIN t ON t.conv_id = k.base AND t.p <= k.k
    UNION ALL
    SELECT k.conv_id, k.k + t.p - k.h, d, words FROM k JOIN t ON t.conv_id = k.conv_id AND t.p > k.h),
pre AS (
    SELECT conv_id, depth, words, count(*) OVER (PARTITION BY conv_id) AS len,
        sha256(string_agg(d, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS name FROM turns
    UNION ALL
    SELECT conv_id, 0, 0, (SELECT count(*) FROM turns x WHERE x.conv_id = c.conv_id), '' FROM c),
node AS (
    SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
    FROM pre GROUP BY name, depth),
up AS (SELECT n.name, n.depth, q.name AS above FROM node n JOIN pre q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
kids AS (SELECT above AS name, count(*) AS n FROM up GROUP BY above),
own AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, a.conv_id AS parent_conv_id FROM node n LEFT JOIN kids USING (name) LEFT JOIN up ON up.name = n.name LEFT JOIN node a ON a.name = up.above),
sums AS (
    SELECT q.name, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved_tokens
    FROM own o JOIN pre q ON q.conv_id = o.conv_id AND q.depth <= o.depth GROUP BY q.name)
SELECT o.conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM own o JOIN sums USING (name)
"""
