"""The registered query of each operator and, where SQL can express it, its counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.llm import embedding_dedup, exact_dedup, html_extract, lm_scoring, mixing, ngram_join, pii, prefix_trie, quality, quality_rules, sentencepiece_codec, spelling, suffix_dedup
from sparkcohort.llm.common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the hash of what decoding them gives back."""
    pieces = sentencepiece_codec.Vocabulary.load()
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(read(spark, sf_dir, "documents"), pieces), pieces)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of high quality and not toxic."""
    target = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return lm_scoring.cross_entropy_difference(read(spark, sf_dir, "documents"), target, leave_words=True)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_source_mixing, op3_quality_classifier, op4_sentencepiece, op5_ngram_jaccard_join, op6_exact_dedup,
    op7_html_extraction, op8_pii, op9_lm_scoring, op10_embedding_near_dedup, op11_conversation_trie, op12_quality_rules,
    op13_spelling_variants)}

#: CRC-32 of a text column ``s`` in SQL, from the table of the reflected polynomial.
CRC_TABLE = """crc AS (SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
        FROM (SELECT unnest(range(0, 256)) AS i))"""


def crc32_sql(s: str) -> str:
    byte = f"strpos('0123456789ABCDEF', substr(hex({s}), 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(hex({s}), 2 * i + 2, 1)) - 17"
    octets = f"list_transform(range(0, strlen({s})), lambda i: CAST({byte} AS BIGINT))"
    return (f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {octets}, "
            "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))")


ORACLES = {
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM both_have JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 9 * c >= 4 * (a.n + b.n)),
        r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        least_of AS (SELECT x, min(y) AS y FROM r GROUP BY x),
        deg AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
        SELECT doc_id, least(doc_id, coalesce(y, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links,
               least(doc_id, coalesce(y, doc_id)) = doc_id AS kept
        FROM documents LEFT JOIN least_of ON least_of.x = doc_id LEFT JOIN deg ON deg.x = doc_id""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_conversation_trie": rf"""
        WITH {CRC_TABLE},
        turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
                      PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
                  FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY i) AS ts FROM turns GROUP BY conv_id),
        shared AS (SELECT conv_id, ts, conv_id - conv_id % 20 AS donor, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc),
        rebuilt AS (SELECT s.conv_id, coalesce(d.ts, [])[1:h] || s.ts[h + 1:] AS ts FROM shared s LEFT JOIN own d ON d.conv_id = s.donor),
        member AS (SELECT conv_id, ts[1:d] AS p, d, d = len(ts) AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
        node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS sha
                 FROM member GROUP BY p, d),
        kids AS (SELECT p[:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
        full_node AS (SELECT n.*, coalesce(k, 0) AS k, (n - 1) * CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(n.p[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved
                      FROM node n LEFT JOIN kids USING (p)),
        below AS (SELECT unnest(list_transform(range(0, d + 1), lambda j: p[1:j])) AS p, saved, CASE WHEN k = 0 THEN 1 ELSE 0 END AS leaf FROM full_node),
        sums AS (SELECT p, sum(leaf) AS leaves, sum(saved) AS saved FROM below GROUP BY p)
        SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, a.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(s.saved AS BIGINT) AS saved_tokens, a.sha AS ends_sha256
        FROM full_node a JOIN sums s ON s.p = a.p LEFT JOIN full_node b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[:a.d - 1]""",
    "op12_quality_rules": r"""
        WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM base),
        win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
        twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win),
        rep AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM twice WHERE k > 1) GROUP BY rid),
        line AS (SELECT rid, i, ls[i] AS l, list_position(ls, ls[i]) < i AS again, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws
                 FROM (SELECT rid, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM base)),
        rule AS (SELECT rid, l, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS chars, again,
                        regexp_matches(l, '[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}][)\]\x22\x27\x{BB}\x{201D}\x{2019}]*([\x20\x09-\x0D]|\z)') AS ends,
                        len(list_filter(ws, lambda x: regexp_full_match(x, '[|/>\x{2022}\x{B7}\x{BB}\x{203A}\x{2013}\x{2014}-]+'))) AS bars,
                        len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS marked,
                        len(list_filter(ws, lambda x: regexp_matches(x, '[!?][!?][)\x22\x27]*\z'))) AS doubled
                 FROM line),
        failed AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN 5 * bars >= n OR (n <= 4 AND NOT ends) THEN 'n'
                                  WHEN NOT ends OR 5 * marked >= n OR 3 * doubled >= n THEN 'p'
                                  WHEN again OR (n <= 40 AND regexp_matches(lower(l), 'PHRASES')) THEN 'b' END AS f FROM rule),
        per AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars,
                       count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (f = 'p') AS n_punctuation,
                       count(*) FILTER (f = 'n') AS n_navigation, count(*) FILTER (f = 'b') AS n_boilerplate,
                       CAST(coalesce(sum(chars) FILTER (f IS NOT NULL), 0) AS BIGINT) AS lost_chars FROM failed GROUP BY rid),
        every AS (SELECT doc_id, n_words, word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
                         coalesce(rep.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed,
                         n_punctuation, n_navigation, n_boilerplate, lost_chars
                  FROM base JOIN per USING (rid) LEFT JOIN rep USING (rid))
        SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM every""".replace("PHRASES", "|".join(quality_rules.PHRASES)),
    "op13_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE},
        run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
        each AS (SELECT d, r, count(*) AS k FROM run GROUP BY ALL),
        hashed AS (SELECT r, k, {crc32_sql("(d || r)")} AS h FROM each, crc),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, k FROM hashed),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        less AS (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: struct_pack(i := i, v := left(word, i - 1) || substr(word, i + 1)))) AS x FROM words),
        pairs AS (SELECT a.word AS x, b.word AS y, b.n FROM less a JOIN less b ON a.x = b.x AND a.word <> b.word
                  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.x.v = b.word
                  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.x.v = b.word),
        best AS (SELECT x, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY x),
        top AS (SELECT x, n_near, most, min(y) AS y FROM best JOIN pairs USING (x) WHERE n = most GROUP BY ALL),
        form AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * words.n THEN y END AS form,
                        CASE WHEN most >= 2 * words.n THEN most END AS form_n FROM words LEFT JOIN top ON x = word),
        walk(word, leads) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.leads WHERE form.form IS NOT NULL)
        SELECT form.word, form.form, walk.leads AS root, form.n, form.n_near, form.form_n
        FROM form JOIN walk ON walk.word = form.word JOIN form last ON last.word = walk.leads AND last.form IS NULL""",
}
