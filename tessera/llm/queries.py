"""The registered queries opN_<name>: thin digests of the operators' outputs.

Production parameters; every query reads the whole table it is meant for.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, lm, mixing, neighbours, ngram_join, packing, pii, prefix_trie, secrets, structure_repair, substrings, tokens, toxicity
from tessera.llm.common import documents, new_path, written

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, path = new_path(spark, "tokens"), tokenizer_path()
    manifest = written(tokens.write_token_files(documents(spark, sf_dir), root, path), "manifest")
    return tokens.read_token_files(spark, root, tokens.with_bases(manifest.collect()), path)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(documents(spark, sf_dir)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii_spans(documents(spark, sf_dir)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(documents(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired(documents(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_nearest": op8_nearest,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_secret_scan": op13_secret_scan,
}


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text of ASCII characters: eight steps of a bit for each of them."""
    step = "list_reduce(list_prepend(xor(c, b), [0::BIGINT for i in range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"[ascii(ch)::BIGINT for ch in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY norm)""",
    "op10_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
          FROM documents),
        per AS (
          SELECT *, source_size::DOUBLE * 2 AS cap, source_size::DOUBLE * 2 / weight AS bears FROM (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM sized GROUP BY source)),
        filled AS (
          SELECT *, row_number() OVER f AS place,
                 (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
          FROM per WINDOW f AS (ORDER BY bears, source ASC NULLS LAST)),
        goal AS (
          SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, place) FROM filled WHERE level <= bears), cap)) AS target FROM filled),
        parts AS (
          SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS whole FROM goal),
        rests AS (SELECT *, target - whole * source_size::DOUBLE AS rest FROM parts),
        hist AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size),
        steps AS (
          SELECT *, (rest - sure) / squares::DOUBLE AS c FROM (
            SELECT h.source, h.size, r.rest,
                   coalesce(sum(n * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS sure,
                   sum(n * size * size) OVER (PARTITION BY h.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS squares
            FROM hist h JOIN rests r ON h.source IS NOT DISTINCT FROM r.source)),
        odds AS (SELECT source, arg_max(c, size) AS c, arg_max(sure, size) AS sure FROM steps WHERE c * size < 1 GROUP BY source),
        ranked AS (
          SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM (
            SELECT s.doc_id, s.source, s.size, s.u, r.source_size, r.target, r.whole, r.rest - o.sure AS remains,
                   CASE WHEN s.size > 0 THEN least(1.0::DOUBLE, coalesce(o.c * s.size, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END AS p
            FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN odds o ON s.source IS NOT DISTINCT FROM o.source)),
        run AS (
          SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked)
        SELECT doc_id, size, source_size, target,
               (size * (whole + CASE WHEN p = 1 OR (q IS NOT NULL AND upto - size / 2::DOUBLE < remains) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM run""",
    "op11_prefix_trie": rf"""
        WITH turns AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM (
            SELECT conv_id, turn, sha256(length(r) || ':' || r || t)[1:32] AS digest, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM (
              SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))),
        per AS (
          SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h, list(struct_pack(d := digest, w := words) ORDER BY place) AS own FROM turns GROUP BY conv_id),
        made AS (
          SELECT p.conv_id, list_concat(coalesce(b.own, [])[1:p.h], p.own[p.h + 1:]) AS whole FROM per p LEFT JOIN per b ON b.conv_id = p.base),
        prefixes AS (
          SELECT conv_id, whole[1:d] AS node, d AS depth, d = len(whole) AS whole FROM (SELECT *, unnest(range(len(whole) + 1)) AS d FROM made)),
        nodes AS (
          SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256
          FROM prefixes GROUP BY node),
        linked AS (
          SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
          FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
          LEFT JOIN (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1) k ON k.node = n.node),
        sums AS (
          SELECT node[1:d] AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * node[depth].w ELSE 0 END)::BIGINT AS saved_tokens
          FROM (SELECT *, unnest(range(depth + 1)) AS d FROM linked) GROUP BY 1)
        SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
        FROM linked l JOIN sums s ON s.node = l.node""",
    # From the last row to the first: the least (cost, letters) of each of the states nothing, s, u, a; then the letters from the front.
    "op12_structure_repair": rf"""
        WITH RECURSIVE hit AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
          FROM conversations),
        ordered AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hit WHERE fault > 0)),
        seen AS (
          SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS full_text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                 role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
          FROM ordered),
        marked AS (
          SELECT *, full_text = '' AS blank, full_text <> '' AND again AS duplicate, full_text <> '' AND NOT again AND full_text[-1:] NOT IN ('.', '!', '?') AS truncated,
                 full_text = '' OR again AS forced, CASE WHEN truncated THEN 3 ELSE 0 END AS more
          FROM seen),
        per AS (
          SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated,
                 sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal
          FROM marked GROUP BY conv_id),
        back AS (
          SELECT conv_id, n AS i, (0, '') AS b0, (6, 'II') AS b1, (3, 'I') AS b2, (0, '') AS b3 FROM per
          UNION ALL
          SELECT conv_id, i - 1, list_min([s0, (3 + u[1], 'I' || u[2])]), list_min([s1, (3 + u[1], 'I' || u[2])]), u, list_min([s3, (3 + s2[1], 'I' || s2[2])]) FROM (
            SELECT *, list_min([s2, (3 + s3[1], 'I' || s3[2])]) AS u FROM (
              SELECT b.conv_id, b.i,
                list_min([(4 + b0[1], 'D' || b0[2])] || CASE WHEN forced THEN [] ELSE [(3 + more + b2[1], 'R' || b2[2])] END || CASE WHEN forced OR initial <> 'u' THEN [] ELSE [(more + b2[1], 'K' || b2[2])] END || CASE WHEN forced OR initial <> 's' THEN [] ELSE [(more + b1[1], 'K' || b1[2])] END) AS s0,
                list_min([(4 + b1[1], 'D' || b1[2])] || CASE WHEN forced THEN [] ELSE [(3 + more + b2[1], 'R' || b2[2])] END || CASE WHEN forced OR initial <> 'u' THEN [] ELSE [(more + b2[1], 'K' || b2[2])] END) AS s1,
                list_min([(4 + b2[1], 'D' || b2[2])] || CASE WHEN forced THEN [] ELSE [(3 + more + b3[1], 'R' || b3[2])] END || CASE WHEN forced OR initial <> 'a' THEN [] ELSE [(more + b3[1], 'K' || b3[2])] END) AS s2,
                list_min([(4 + b3[1], 'D' || b3[2])] || CASE WHEN forced THEN [] ELSE [(3 + more + b2[1], 'R' || b2[2])] END || CASE WHEN forced OR initial <> 'u' THEN [] ELSE [(more + b2[1], 'K' || b2[2])] END) AS s3
              FROM back b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i))),
        best AS (SELECT conv_id, b0[1] AS cost, b0[2] AS audit FROM back WHERE i = 0),
        walk AS (
          SELECT conv_id, audit, 0 AS p, 1 AS i, '' AS state, NULL::VARCHAR AS repaired FROM best
          UNION ALL
          SELECT w.conv_id, audit, p + 1, w.i + (x <> 'I')::INT, CASE WHEN x = 'D' THEN state WHEN x = 'K' THEN initial ELSE wanted[1:1] END,
                 CASE WHEN x = 'D' THEN repaired ELSE coalesce(repaired || chr(10), '') || CASE WHEN x = 'K' THEN role ELSE wanted END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END END
          FROM (SELECT *, audit[p + 1:p + 1] AS x, CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS wanted FROM walk WHERE p < length(audit)) w
          LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(w.repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN per p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.p = length(w.audit)""",
}
