"""The registered queries opN_<name> over whole tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, common, conversations, decontam, divergence, lines, packing, quality, sharding, simhash, suffixes, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_remainder(5) != 0), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, model, "text", ["doc_id"])
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", ["vec_id"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    revisit = F.col("record_type") == "revisit"
    return warc.read(spark, path).select(
        F.col("key").alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id"])


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(_table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("new_text", 256).alias("text_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


ACCEPTED_QUALITY = 0.7


def quality_weights(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Weights learned from the labelled documents outside the held-out fold."""
    return quality.train(docs, _table(spark, sf_dir, "labels").where(_remainder(4) != 2), "doc_id", "text", "quality")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_weights(spark, docs, sf_dir), "text", ["doc_id"])
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score",
                         (F.col("score") >= ACCEPTED_QUALITY).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                               "text", "item_id", "text", ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.ranked(divergence.Audit(_table(spark, sf_dir, "documents"), "text", "lang", "source"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(_table(spark, sf_dir, "documents"), "text", ["doc_id"], with_decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return conversations.reports(damaged, "conv", "turn", "role", "text", "present").withColumnRenamed("conv", "conv_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_vectors, op3_warc, op4_simhash, op5_sharding, op6_lines, op7_packing, op8_suffixes, op9_quality, op10_decontamination, op11_divergence, op12_bpe, op13_conversations)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10_SQL = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                     '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT d.*, k AS depth, h >> (60 - k) AS bucket FROM d, range(0, 61) t(k)),
s AS (SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM l GROUP BY ALL
      HAVING sum(n_bytes) <= {sharding.LIMIT} OR min(h) = max(h)),
leaf AS (SELECT doc_id, min(depth) AS depth, arg_min(shard_bytes, depth) AS shard_bytes FROM l JOIN s USING (depth, bucket) GROUP BY 1)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth,
       substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INTEGER)) AS shard, CAST(0 AS BIGINT) AS part, shard_bytes
FROM d JOIN leaf USING (doc_id)
"""



OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             unnest(list_prepend(NULL, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+'))) AS term
           FROM documents),
g AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM d GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS in_lang FROM g WHERE term IS NOT NULL GROUP BY ALL HAVING sum(docs) >= {divergence.MIN_DOCUMENTS}),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(in_lang), 0) AS of_lang FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY 1),
groups_ AS (SELECT g.lang, source, coalesce(sum(n) FILTER (kept.term IS NOT NULL), 0) AS of_group
            FROM g LEFT JOIN kept ON g.lang = kept.lang AND g.term = kept.term GROUP BY ALL),
p AS (SELECT lang, source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (of_group + 5 * v) AS p,
             1 + (1000000000::HUGEINT * (in_lang + 5)) // (of_lang + 5 * v) AS q
      FROM groups_ JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN g USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
rows_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def _op13_sql() -> str:
    """The edit lattice row by row: per state the least (cost, audit); inserts are closed under after each row."""
    def step(label, cost, letter):
        return f"CASE WHEN {label} IS NOT NULL THEN {{'c': {label}.c + {cost}, 'a': {label}.a || '{letter}'}} END"

    def least(*labels):
        return f"list_min([{', '.join(labels)}])"

    extra = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"

    def kept(label, initial):
        return f"CASE WHEN fault IN (0, 3) THEN CASE WHEN ini = '{initial}' THEN {step(label, extra, 'K')} ELSE {step(label, f'1 + {extra}', 'R')} END END"

    keep_system = f"CASE WHEN fault IN (0, 3) AND ini = 's' THEN {step('b0', extra, 'K')} END"
    return f"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(t.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations t JOIN ids ON t.conv_id IS NOT DISTINCT FROM ids.conv_id),
drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(k)),
    lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(k[CAST(i // 8 AS INTEGER) + 1]) AS BIGINT) ELSE 0 END)),
    lambda h, b: xor(xor(h, b) >> 1, CASE WHEN xor(h, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS draw FROM keyed),
rows_ AS (SELECT c, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS nth, substr(role, 1, 1) AS ini,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM rows_),
faulted AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
    lag(ini) OVER (PARTITION BY c ORDER BY i) AS ini_before FROM placed),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulted GROUP BY c),
dp AS (
  SELECT c, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS b0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) AS b1,
         {{'c': CAST(5 AS BIGINT), 'a': 'I'}} AS b2, {{'c': CAST(10 AS BIGINT), 'a': 'II'}} AS b3 FROM ids
  UNION ALL
  SELECT c, i, n0, n1, m2, {least('n3', step('m2', 5, 'I'))} FROM (
    SELECT *, {least('n2', step('n0', 5, 'I'), step('n1', 5, 'I'), step('n3', 5, 'I'))} AS m2 FROM (
      SELECT c, f.i, {step('b0', 2, 'D')} AS n0, {least(step('b1', 2, 'D'), keep_system)} AS n1,
             {least(step('b2', 2, 'D'), kept('b0', 'u'), kept('b1', 'u'), kept('b3', 'u'))} AS n2,
             {least(step('b3', 2, 'D'), kept('b2', 'a'))} AS n3
      FROM dp JOIN faulted f USING (c) WHERE f.i = dp.i + 1))),
best AS (SELECT c, {least('b0', 'b3')} AS b FROM dp LEFT JOIN counts USING (c) WHERE dp.i = coalesce(n, 0)),
letters AS (SELECT c, unnest(range(1, length(b.a) + 1)) AS p, b.a AS a FROM best),
used AS (SELECT c, p, a[p] AS e, length(replace(a[1:p], 'I', '')) AS i FROM letters WHERE a[p] <> 'D'),
led AS (SELECT u.*, f.role, f.text, f.ini, row_number() OVER w - 1 AS k,
    first_value(CASE WHEN e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER w AS lead_s
  FROM used u LEFT JOIN faulted f ON u.c = f.c AND u.i = f.i AND u.e <> 'I' WINDOW w AS (PARTITION BY u.c ORDER BY p)),
done AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - lead_s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole FROM led GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids JOIN best USING (c) LEFT JOIN counts USING (c) LEFT JOIN done USING (c)
"""


OP13_SQL = _op13_sql()

ORACLE = {"op2_vectors": OP2_SQL, "op3_warc": OP3_SQL, "op5_sharding": OP5_SQL, "op10_decontamination": OP10_SQL, "op11_divergence": OP11_SQL,
          "op13_conversations": OP13_SQL}
