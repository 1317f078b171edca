"""The queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_classes
from .language_id import fit, predict
from .packing import packed_documents
from .prefix_trie import prefix_trie, rebuilt, turn_digests
from .quality import quality_rules
from .secret_scan import scan_secrets
from .sentencepieces import encoded
from .shared import Scratch, table
from .sharding import shard_by_bytes
from .substring_dedup import repeated_passages
from .token_counts import prefix_counts
from .whitening import whiten


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts, and the stored prefix counts that give them (see ``prefix_counts``).

    Null and empty text: 0 tokens. Null ids and repeated rows are kept as they are; no rows give none.
    """
    found = prefix_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), budget=2048)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars", "prefix_steps", "step_bytes")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by three-word shingles at 90 %. Null, empty and wordless texts and null ids stand alone; repeated ids count as one document; no rows give none."""
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by bytes. Null text counts one byte, null ids and repeated rows have places of their own, equal texts stand together where they are few; no rows give none."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in two documents, exactly or at 80 % of five-word shingles. Null and short texts and null ids give no rows, nor does an empty table; repeated ids count as one document."""
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50, n=5, percent=80)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors at cosine 0.95. Null, empty, zero and non-finite vectors and null ids link with nothing; equal vectors link; no rows give none."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. Null and empty texts are the closing id alone; repeated rows and null ids are packed one by one; no rows give none."""
    return packed_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole texts as spans. Null and empty texts have none; null ids and repeated rows are kept; no rows give none."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages predicted from text alone, learnt from two thirds by id. Null text and text without a letter give `und` with score 0; null ids count as learnt from; repeated rows get equal answers; no rows give none."""
    docs = table(spark, sf_dir, "documents")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out")
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")))
    return predict(rows, model, keep=("doc_id", "held_out"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of whole texts by their number and checksum. Null and empty texts have none; null ids and repeated rows are kept; no rows give none."""
    return encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of documents labelled good and not toxic; null labels are neither, repeated ids are harmless."""
    return table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict of every text. Null and empty texts have no words and fail; null ids are judged but not trusted; repeated rows get equal verdicts; no rows give none."""
    return quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations. Null roles and texts are empty, rows with a null id are left out, equal rows are turns of their own, ties in the turn go by digest; no rows give none."""
    scratch = Scratch(spark)
    return prefix_trie(*rebuilt(turn_digests(table(spark, sf_dir, "conversations")), scratch), scratch)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of each vector. Null, empty and non-finite vectors are left out; null ids and repeated rows are kept; no rows give none."""
    return whiten(table(spark, sf_dir, "embeddings"), most=16)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from four fifths of the labels by id. Null and empty texts get the score of a text without words; null ids and repeated rows are kept; no rows give none."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(fifth != 0))
    rows = docs.select("doc_id", "text", F.coalesce(fifth == 0, F.lit(False)).alias("held_out"))
    return toxicity.scored(rows, model, keep=("doc_id", "held_out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                     ELSE [array_to_string(w, ' ')] END)) AS s
            FROM words WHERE len(w) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT r.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op11_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS t,
                   len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            -- the checksum of the decimal digits, bit by bit
            SELECT c, len, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda crc, b:
                list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384 + 0 * i))), 4294967295) % 4 AS h
            FROM (SELECT c, count(*) AS len FROM turns GROUP BY c)
        ), taken AS (SELECT i.c, i.base, i.h, least(i.h, coalesce(b.len, 0)) AS k FROM ids i LEFT JOIN ids b ON b.c = i.base
        ), rebuilt AS (
            SELECT x.c, t.pos AS d, t.t, t.words FROM taken x JOIN turns t ON t.c = x.base AND t.pos <= x.k
            UNION ALL SELECT x.c, t.pos - x.h + x.k, t.t, t.words FROM taken x JOIN turns t ON t.c = x.c AND t.pos > x.h
        ), steps AS (
            SELECT c, 0 AS d, '' AS path, NULL AS up, 0 AS words FROM ids
            UNION ALL SELECT c, d, string_agg(t, '') OVER w, coalesce(string_agg(t, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words
            FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)
        ), nodes AS (SELECT path, any_value(up) AS up, d, any_value(words) AS words, min(c) AS rep, count(*) AS n FROM steps GROUP BY path, d
        ), children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), sums AS (
            SELECT s.path, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n - 1) * v.words) AS saved
            FROM (SELECT DISTINCT s.path, x.path AS below FROM steps s JOIN steps x ON x.c = s.c AND x.d >= s.d) s
            JOIN nodes v ON v.path = s.below LEFT JOIN children k ON k.path = s.below GROUP BY s.path
        ), ends AS (
            SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS members FROM (SELECT c, arg_max(path, d) AS path FROM steps GROUP BY c) GROUP BY path
        )
        SELECT v.rep AS conv_id, v.d::BIGINT AS depth, p.rep AS parent_conv_id, v.n AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
               s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
        FROM nodes v JOIN sums s USING (path) LEFT JOIN nodes p ON p.path = v.up LEFT JOIN children k ON k.path = v.path LEFT JOIN ends e ON e.path = v.path
    """,
}
