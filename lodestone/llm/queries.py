"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import align, ann, bpe, hmm, lines, maxscore, minhash, packing, secrets, substrings, toxicity, turns, warc

BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, shingle_words=4)
    doc, component = minhash.restored("__did"), minhash.restored("component")
    return found.select(doc.alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("__did").eqNullSafe(F.col("component")).alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.drop_lines(docs, lines.keep_bitmaps(docs))
    return done.select("doc_id", F.col("__lines.n_lines").alias("n_lines"), F.col("__lines.n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.read(warc.write(table(spark, sf_dir, "pages"))))


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, digests=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = secrets.scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return done.select("doc_id", *(count(k) for k in secrets.BASE), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCAB)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, BYTE_VOCAB, bpe.build_lexicon(docs, BYTE_VOCAB))


def op11_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.summarize(table(spark, sf_dir, "documents"), BYTE_VOCAB, PIECE_MODEL)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = turns.repair(turns.damaged(given))
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = turns.digests(repaired)
    # null ids meet as a key of their own
    key = lambda df: df.withColumn("k", F.coalesce("conv_id", F.lit(turns.NULL_ID)))
    found = key(every).join(key(report).drop("conv_id"), "k", "left").join(key(done).drop("conv_id"), "k", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_line_dedup, op3_warc, op4_hilbert_ann, op5_maxscore, op6_substring_dedup, op7_toxicity, op8_secret_scans, op9_packing, op10_bpe_codec, op11_hmm_language_model, op12_token_alignment, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {}

#: Keys are the lines without outer white space and with A-Z lower-cased.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL["op2_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, t.line, t.pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       unnest(ls) WITH ORDINALITY AS t(line, pos)
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), shared AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE owner IS NOT NULL AND doc_id <> owner) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR doc_id = owner), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k)
GROUP BY doc_id
"""


def _cuts(kind: str, rank: int, pattern: str, group: int, least: int, options: str) -> str:
    pattern = pattern.replace("'", "''")
    opt = f", '{options}'" if options else ""
    gaps = f"regexp_split_to_array(text, '{pattern}'{opt})"
    whole = f"regexp_extract_all(text, '{pattern}', 0{opt})"
    value = f"regexp_extract_all(text, '{pattern}', {group}{opt})"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, ends - length(m) AS s, ends AS e, length(v) >= {least} AS ok
  FROM (
    SELECT doc_id, t.m, t.v, sum(length(t.g) + length(t.m)) OVER (PARTITION BY doc_id ORDER BY t.i) AS ends
    FROM (SELECT doc_id, {gaps} AS gs, {whole} AS ms, {value} AS vs FROM d WHERE regexp_matches(text, '{pattern}'{opt})),
         LATERAL (SELECT unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(vs) AS v, unnest(range(len(ms))) AS i) t
  )"""


def _secret_sql() -> str:
    base = [r for r in secrets.RULES]
    parts = []
    for i, r in enumerate(base):
        pattern, options = r["pattern"], ""
        if r["kind"] == "assign":
            pattern, options = pattern.replace("(?i:(", "(").replace("key))", "key)"), ""
            pattern = "(?i:" + pattern.replace(r"""["']?\x20*[:=]""", r""")["']?\x20*[:=]""", 1)
        parts.append(_cuts(r["kind"], i, pattern, r["group"], r["least"], options))
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ("
        + " UNION ALL ".join(parts)
        + f"""), good AS (SELECT * FROM found WHERE ok)
SELECT d.doc_id,
       count(*) FILTER (WHERE kind = 'assign') AS n_assign,
       count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(secrets.BASE)}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN good USING (doc_id)
GROUP BY d.doc_id
"""
    )


ORACLE_SQL["op8_secret_scans"] = _secret_sql()

ORACLE_SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
         WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(p.n) AS nx, any_value(q.n) AS ny, count(*) AS k
  FROM s a JOIN s b USING (g) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id
GROUP BY d.doc_id
"""

ORACLE_SQL["op6_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35
), seq AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM win),
rep AS (SELECT g FROM seq GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM seq JOIN rep USING (g)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0)
SELECT d.doc_id, count(word.p) AS n_words, count(gone.p) AS n_removed,
       sha256(coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN word USING (doc_id) LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p
GROUP BY d.doc_id
"""

#: DuckDB has no SHA-1 in binary form nor base32: the digest is rebuilt from the hex digits,
#: five bits at a time.
ORACLE_SQL["op3_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT h, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i) AS d
  FROM (SELECT DISTINCT h FROM p), range(32) AS t(i) GROUP BY h
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN b USING (h) JOIN f USING (h)
"""

ORACLE_SQL["op5_maxscore"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


#: The same repair as a recursion over the turns from the last one back. A value is a cost of nine digits with
#: its audit behind, so the least string is the cheapest and of those the least audit. ``e``: an even
#: number of letters of the target is left, ``o``: an odd number, ``f``: an even number of two or more.
#: DuckDB has no CRC-32: its table of 256 values is built by the rule.
ORACLE_SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS t
), g AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS k
  FROM conversations, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM g WHERE k <> 0
), o AS (
  SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS r,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
  FROM d
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o
), seen AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n
  FROM f GROUP BY conv_id
), steps AS (
  SELECT conv_id, n AS i, n, '000000000' AS e, '000000003I' AS o, '000000006II' AS f, '999999999' AS s FROM seen
  UNION ALL
  SELECT conv_id, i, n, least(e0, '' || lpad(CAST(CAST(left(o0, 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(o0, 10)) AS e,
         least(o0, lpad(CAST(CAST(left(e0, 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(e0, 10)) AS o,
         least(f0, lpad(CAST(CAST(left(least(o0, lpad(CAST(CAST(left(e0, 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(e0, 10)), 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I'
               || substr(least(o0, lpad(CAST(CAST(left(e0, 9) AS INT) + 3 AS VARCHAR), 9, '0') || 'I' || substr(e0, 10)), 10)) AS f, s0 AS s
  FROM (
    SELECT steps.conv_id, i - 1 AS i, n,
           least(lpad(CAST(CAST(left(e, 9) AS INT) + 4 AS VARCHAR), 9, '0') || 'D' || substr(e, 10), CASE WHEN fault IN ('b', 'd') THEN '999999999' ELSE
             lpad(CAST(CAST(left(steps.o, 9) AS INT) + CASE WHEN r = 'u' THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END AS VARCHAR), 9, '0') || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END || substr(steps.o, 10) END) AS e0,
           least(lpad(CAST(CAST(left(steps.o, 9) AS INT) + 4 AS VARCHAR), 9, '0') || 'D' || substr(steps.o, 10), CASE WHEN fault IN ('b', 'd') THEN '999999999' ELSE
             lpad(CAST(CAST(left(e, 9) AS INT) + CASE WHEN r = 'a' THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END AS VARCHAR), 9, '0') || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END || substr(e, 10) END) AS o0,
           least(lpad(CAST(CAST(left(steps.f, 9) AS INT) + 4 AS VARCHAR), 9, '0') || 'D' || substr(steps.f, 10), CASE WHEN fault IN ('b', 'd') THEN '999999999' ELSE
             lpad(CAST(CAST(left(steps.o, 9) AS INT) + CASE WHEN r = 'u' THEN 0 ELSE 3 END + CASE WHEN fault = 't' THEN 3 ELSE 0 END AS VARCHAR), 9, '0') || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END || substr(steps.o, 10) END) AS f0,
           least(lpad(CAST(CAST(left(s, 9) AS INT) + CASE WHEN left(s, 9) = '999999999' THEN 0 ELSE 4 END AS VARCHAR), 9, '0') || 'D' || substr(s, 10), CASE WHEN fault IN ('b', 'd') OR r <> 's' THEN '999999999' ELSE
             lpad(CAST(CAST(left(steps.f, 9) AS INT) + CASE WHEN fault = 't' THEN 3 ELSE 0 END AS VARCHAR), 9, '0') || 'K' || substr(steps.f, 10) END) AS s0
    FROM steps JOIN f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.p = steps.i
  )
), won AS (
  SELECT conv_id, least(e, s) AS v FROM steps WHERE i = 0
), edits AS (
  SELECT conv_id, substr(v, 10) AS audit, CAST(left(v, 9) AS BIGINT) AS cost, unnest(string_split(substr(v, 10), '')) AS x, unnest(range(1, length(v) - 8)) AS nth,
         (length(replace(substr(v, 10), 'D', '')) % 2) AS lead
  FROM won
), laid AS (
  SELECT *, count(*) FILTER (WHERE x <> 'I') OVER w AS row_at, count(*) FILTER (WHERE x <> 'D') OVER w AS pos FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
), fixed AS (
  SELECT laid.conv_id, string_agg(CASE WHEN x = 'K' THEN f.role WHEN (pos - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY nth) AS body
  FROM laid LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM laid.conv_id AND f.p = laid.row_at AND x <> 'I' WHERE x <> 'D' GROUP BY laid.conv_id
)
SELECT c.conv_id, coalesce(seen.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(left(v, 9) AS BIGINT), 0) AS cost, coalesce(substr(v, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM c.conv_id
"""
