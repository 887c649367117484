"""The registered queries of the corpus operators, and SQL where it can express them.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, table
from .collocations import collocations
from .exact_dedup import exact_dedup
from .line_dedup import SHARE, dropped_lines
from .mixing import mix_sources
from .near_jaccard import jaccard_components
from .packing import added_tokens, pack_documents
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .spelling import spelling_variants, word_counts
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import judge_urls
from .vector_tree import nearest
from .word_pieces import count_pieces, sentencepiece_vocabulary

# Fixed values of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str,
                       vocabulary: str | None = None, pattern: str | None = None,
                       added: dict[str, int] | None = None) -> DataFrame:
    if added is None and vocabulary is None:
        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(
        table(spark, sf_dir, "documents"),
        vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern or public_tokenizers.PATTERN, added=added)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents"), share=SHARE)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_word_pieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    begin, go_on = sentencepiece_vocabulary(vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    return count_pieces(table(spark, sf_dir, "documents"), begin, go_on)


def op9_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), typo_every=97))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

# Water-filling as rounds of clamping, replayed one by one, not by sorted levels.
OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('20240607:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS seeded
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), rounds(k, level) AS (
  SELECT 0, CAST((SELECT sum(source_size) FROM src) AS DOUBLE) / CAST((SELECT sum(weight) FROM src) AS DOUBLE)
  UNION ALL
  SELECT k + 1, nxt FROM (
    SELECT r.k, r.level,
           CAST((SELECT sum(source_size) FROM src)
                - (SELECT coalesce(sum(3 * source_size), 0) FROM src WHERE 3 * source_size < weight * r.level) AS DOUBLE)
           / CAST((SELECT sum(weight) FROM src WHERE 3 * source_size >= weight * r.level) AS DOUBLE) AS nxt
    FROM rounds r) WHERE nxt > level
), filled AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM rounds) * weight) AS target FROM src
), share AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled
), running AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, f.whole,
         CAST(round(f.target) AS BIGINT) - f.whole * f.source_size AS rest,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.seeded, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized s JOIN share f ON s.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, rest - ahead)) AS taken
FROM running
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' ')) END) AS s
    FROM w)
), n AS (
  SELECT w.doc_id, count(sh.s) AS n_shingles FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT link.b, reach.other FROM reach JOIN link ON link.a = reach.doc_id
)
SELECT doc_id, n_shingles, least(doc_id, min(other)) AS component_id
FROM n JOIN reach USING (doc_id) GROUP BY doc_id, n_shingles
"""

OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), total AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: list_aggregate(words[i:i + k - 1], 'string_agg', ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k)
  GROUP BY lang, k, phrase HAVING count(*) >= 30
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r,
         CAST((2000000 * CAST(c.a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), held AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT c.lang, a, array_to_string(words[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(2, k)) AS m FROM c) c, (SELECT unnest([1, 2, 3]) AS i) WHERE i + m - 1 <= k)
  GROUP BY lang, phrase
), ranked AS (
  SELECT lang, phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

# crc32 bit by bit from its table; near words share a pattern with one place left out.
OP13_SQL = r"""
WITH RECURSIVE k0 AS (
  SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda x, y:
         CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, c::BIGINT)) AS crc
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), seen AS (
  SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM runs GROUP BY doc_id, run
), summed AS (
  SELECT run, c, xor(list_reduce(range(0, len(x) // 2), lambda h, i:
         xor(h >> 8, k0.crc[xor(h & 255, CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)) + 1]), 4294967295::BIGINT),
         4294967295) AS h
  FROM seen, k0
), spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM summed
), w AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), gaps AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), cut AS (
  SELECT word, n, i, word[1:i - 1] AS l, word[i + 1:] AS r FROM gaps
), near AS (
  SELECT a.word AS word, b.word AS other, b.n AS m
  FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON b.word = a.l || a.r
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON b.word = a.l || a.r
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form,
         CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)
), walk(word, here, up) AS (
  SELECT word, word, form FROM f
  UNION ALL SELECT walk.word, walk.up, f.form FROM walk JOIN f ON f.word = walk.up
)
SELECT f.word, f.form, walk.here AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND walk.up IS NULL
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_label_propagation": op2_label_propagation,
    "op3_vector_packing": op3_vector_packing,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_nbsvm": op7_quality_nbsvm,
    "op8_word_pieces": op8_word_pieces,
    "op9_vector_tree": op9_vector_tree,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op6_mix_sources": OP6_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
