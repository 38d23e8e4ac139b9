"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.llm.chat import format_chat, read_back, text_parts
from featureflow.llm.crosstok import align
from featureflow.llm.exactdedup import exact_dedup
from featureflow.llm.langid import identify
from featureflow.llm.licenses import scan_licenses
from featureflow.llm.mixing import Mix
from featureflow.llm.nearjoin import similarity_links
from featureflow.llm.pieces import encode
from featureflow.llm.simhash import near_duplicates
from featureflow.llm.spelling import count_words, spelling_variants
from featureflow.llm.substrings import remove_repeated_passages
from featureflow.llm.topk import quantised, top_k
from featureflow.llm.urlfilter import judge_urls
from featureflow.session import table

# host, path, verdict of the rules that op8 judges by (fixed values)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# turns of the extra conversation that op10 formats (fixed values)
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken()


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def digests(out: DataFrame) -> DataFrame:
    """Digest columns of encoded documents."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, F.col("vec_id") % 100 == 0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_links(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(EXTRA_TEXT).alias("text"))
    turns = rows.unionByName(extra).withColumn("parts", text_parts(F.coalesce("text", F.lit(""))))
    out = format_chat(turns).withColumn("back", read_back(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = F.array_join(F.col("learnt.text"), "")
    out = out.withColumn("learnt", F.filter("back", lambda x: x["loss"]))
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"),
                      F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))


def op12_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents")))


def crc32_table() -> list[int]:
    """The byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_license_scan": op5_license_scan,
    "op6_exact_topk": op6_exact_topk,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_simhash_bktree": op12_simhash_bktree,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 12] AS words FROM w, LATERAL unnest(range(1, len(ws) - 11)) t(i)),
firsts AS (SELECT words, min(doc_id) AS first_doc FROM win GROUP BY words),
hits AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN firsts USING (words), range(0, 13) r(j)
         WHERE doc_id > first_doc),
gone AS (SELECT doc_id, list(i) AS gone FROM hits GROUP BY doc_id),
kept AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN ws
                     ELSE [x[1] FOR x IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(gone, x[2])] END AS kept
         FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
""",
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
           FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
""",
    "op8_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h0 FROM u),
p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(coalesce(rest, ''), length(h0) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                     ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
             arg_max(rverdict, length(rhost || rpath)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + 4] AS sh FROM w, LATERAL unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
r(id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.top = l.a)
SELECT d.doc_id, (SELECT min(top) FROM r WHERE id = d.doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links FROM documents d
""",
    "op10_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 6 + length(role) + 1 + length(text) + 8
             + length(regexp_replace(role || text, '[^\\<>#]', '', 'g')) AS chars,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, sum(words)::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
                     FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(x, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM t),
c AS (SELECT run, doc_id, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(
          regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda y: ('0x' || y)::BIGINT),
          lambda a, b: xor(a >> 8, {crc32_table()}[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
      FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
d AS (SELECT word, i, word[:i] || word[i + 2:] AS v FROM w, LATERAL unnest(range(length(word))) u(i)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
      UNION SELECT d.word, d.v FROM d JOIN w ON w.word = d.v UNION SELECT d.v, d.word FROM d JOIN w ON w.word = d.v),
m AS (SELECT p.word, count(*) AS n_near, max(w.n) AS top FROM p JOIN w ON w.word = near GROUP BY 1),
b AS (SELECT p.word, min(near) AS best FROM p JOIN w ON w.word = near JOIN m ON m.word = p.word AND m.top = w.n GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best END AS form,
             CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN m USING (word) LEFT JOIN b USING (word)),
up(word, here) AS (SELECT word, form FROM f WHERE form IS NOT NULL
                   UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = here WHERE f.form IS NOT NULL),
e AS (SELECT up.word, here FROM up JOIN f ON f.word = here WHERE f.form IS NULL)
SELECT word, form, coalesce(here, word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)
""",
}
