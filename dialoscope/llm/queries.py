"""One query per operator over its whole table, with DuckDB texts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoscope.llm import ann, bpe, chat, decontaminate, fim, jaccard, lines, packing, repair, secrets, substrings, suffixes, toxicity
from dialoscope.llm.frames import shown_id, table  # noqa: F401

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op6_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i + 1] AS line
    FROM (SELECT doc_id, text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), opened AS (
    SELECT key, min(doc_id) AS opener FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
    SELECT k.*, coalesce(k.doc_id > o.opener, false) AS dropped FROM keyed k LEFT JOIN opened o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, outputs=("n_lines", "n_dropped", "kept_sha256"))


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs).drop("spans_list")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_neighbours", """
WITH vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 20""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


#: A conversation whose texts hold the template's control strings.
CONTROL = r"\### Assistant: </turn> ok"


@query("op2_chat", r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), pieces AS (
    SELECT *, role || chr(10) || text || chr(10) AS plain,
           '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), chr(10), '\n') || chr(10)
           || replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') || '</turn>' || chr(10) AS piece
    FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(plain, '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], rows.schema)
    return chat.read_back(chat.pack(rows.unionByName(more))).drop("turns")


@query("op3_jaccard", r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN hash(w) ELSE hash(w[i:i + 3]) END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), ranked AS (
    SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY s) AS df FROM shingles) JOIN sizes USING (doc_id)
), candidates AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
    FROM ranked a JOIN ranked b ON a.s = b.s AND a.doc_id < b.doc_id
    WHERE a.r <= a.n - ceil(a.n * 0.85) + 1 AND b.r <= b.n - ceil(b.n * 0.85) + 1 AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n
), shared AS (
    SELECT c.a, c.b, count(*) AS hits FROM candidates c JOIN shingles x ON x.doc_id = c.a JOIN shingles y ON y.doc_id = c.b AND y.s = x.s
    GROUP BY c.a, c.b
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * hits >= 85 * (x.n + y.n - hits)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.groups(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select(shown_id("doc").alias("doc_id"), "n_shingles", shown_id("component_id").alias("component_id"))


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(shown_id("doc").alias("doc_id"), "item_id", "kind", "coverage", "n_windows", "n_changed")


@query("op7_substring_dedup", r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, w[i:i + 19] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
), later AS (
    SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
), judged AS (
    SELECT p.doc_id, p.i, p.word, g.i IS NOT NULL AS removed
    FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words) p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
)
SELECT d.doc_id, count(j.i)::BIGINT AS n_words, (count(*) FILTER (j.removed))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.i) FILTER (NOT j.removed), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(docs, outputs=("n_words", "n_removed", "kept_sha256"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.dedup(docs, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


@query("op11_fim", """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
    SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1)::UBIGINT AS x, ('0x' || h[9:16])::UBIGINT % (n + 1)::UBIGINT AS y,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, least(x, y)::BIGINT AS a, greatest(x, y)::BIGINT AS b FROM cut
), formed AS (
    SELECT *, CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1, n - b) || '<M>' || substring(t, a + 1, b - a)
        ELSE '<S>' || substring(t, b + 1, n - b) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output
    FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM formed""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return samples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"),
                          F.sha2(fim.restored(), 256).alias("restored_sha256"))


@query("op12_repair", r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), rows AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), marked AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b:
        xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM rows, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM marked WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
    SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '?' END AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
    FROM placed
), steps(s, c, t) AS (  -- state, role, state behind it: 0 nothing, 1 system, 2 user, 3 assistant
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ways(s, t, pre, made) AS (  -- turns inserted in front of a row
    SELECT s, s, '', '' FROM (VALUES (0), (1), (2), (3)) v(s)
    UNION ALL
    SELECT w.s, x.t, w.pre || 'I', w.made || chr(10) || CASE x.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END
    FROM ways w JOIN steps x ON x.s = w.t AND x.c <> 's' WHERE length(w.pre) < 3
), moves AS (  -- from state s to t over a row with role r; keeps: its own role stays
    SELECT w.s, w.t, '' AS r, 3 * length(pre) + 4 AS c, pre || 'D' AS e, made, '' AS new FROM ways w
    UNION ALL
    SELECT w.s, x.t, x.c, 3 * length(pre), pre || 'K', made, NULL FROM ways w JOIN steps x ON x.s = w.t
    UNION ALL
    SELECT w.s, x.t, '*', 3 * length(pre) + 3, pre || 'R', made, CASE x.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END
    FROM ways w JOIN steps x ON x.s = w.t AND x.c <> 's'
), walk(conv_id, i, state, best) AS (
    SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'made': ''} FROM (SELECT DISTINCT conv_id FROM judged)
    UNION ALL
    SELECT conv_id, i, state, best FROM (
        SELECT w.conv_id, j.i, m.t AS state, min({'cost': w.best.cost + m.c + CASE WHEN j.fault = 't' AND m.r <> '' THEN 3 ELSE 0 END,
            'audit': w.best.audit || m.e,
            'made': w.best.made || m.made || CASE m.r WHEN '' THEN '' WHEN '*' THEN chr(10) || m.new || j.text ELSE chr(10) || j.role || ':' || j.text END}) AS best
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
             JOIN moves m ON m.s = w.state AND (m.r = '' OR (j.fault NOT IN ('b', 'd') AND (m.r = '*' OR m.r = j.r)))
        GROUP BY w.conv_id, j.i, m.t)
), ended AS (
    SELECT w.conv_id, min({'cost': w.best.cost + 3 * length(x.pre), 'audit': w.best.audit || x.pre, 'made': w.best.made || x.made}) AS best
    FROM walk w JOIN ways x ON x.s = w.state AND x.t IN (0, 3) JOIN (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id) l
         ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = l.n
    GROUP BY w.conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (fault = 'b'))::BIGINT AS blank,
           (count(*) FILTER (fault = 'd'))::BIGINT AS duplicate, (count(*) FILTER (fault = 't'))::BIGINT AS truncated,
           (count(*) FILTER (i > 1 AND prev || role[1] NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal
    FROM judged GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(substring(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.own_rows(table(spark, sf_dir, "conversations"))
    return repair.report(repair.damaged(rows), rows)


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
