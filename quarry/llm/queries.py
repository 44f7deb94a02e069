"""Registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import (chat_format, cws, dac_codes, decontaminate, language_id, merkle, packing, parity_join,
                        pii, quality_mil, spelling, substring_dedup, wrappers)
from quarry.llm.registry import query
from quarry.llm.scratch import written
from quarry.sources.tables import read_table

VOCABULARY = "word_bpe_49k.json"


@query("op1_fingerprints")
def op1_fingerprints(spark, sf):
    """Consistent weighted samples of every document and its edited text."""
    return cws.compare_with_edits(read_table(spark, sf, "documents"))


@query("op2_near_duplicates", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.other) AS component_id,
       count(*) > 1 AS in_component
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes z USING (doc_id) GROUP BY d.doc_id
""")
def op2_near_duplicates(spark, sf):
    """Components of documents with 5-gram Jaccard similarity of 0.75 or more."""
    return parity_join.near_duplicates(read_table(spark, sf, "documents"))


@query("op3_substring_dedup", r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words)),
first AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN first USING (s) WHERE doc_id > f),
gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
""")
def op3_substring_dedup(spark, sf):
    """Words covered by 13-word windows of earlier documents, removed."""
    return substring_dedup.remove_repeats(read_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_language_id")
def op4_language_id(spark, sf):
    """Language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf, "documents")
    found = language_id.train_and_identify(docs)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"),
                        "lang_pred", "score", "cross_entropy", "rejected")


@query("op5_chat_examples", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, 21 + length(regexp_replace(role, '([<\[\\])', '\1\1', 'g'))
              + length(regexp_replace(text, '([<\[\\])', '\1\1', 'g')) AS chars,
         role = 'assistant' AS trained,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last
  FROM rows),
prefixed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS example FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN trained THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN trained THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(CASE WHEN trained OR last THEN example ELSE 0 END) AS BIGINT) AS formatted_chars
FROM prefixed GROUP BY conv_id
""")
def op5_chat_examples(spark, sf):
    """Conversations expanded to one example per assistant turn, read back from the files."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.createDataFrame(
        [(-7, 0, "user", fixed), (-7, 1, "assistant", fixed)], turns.schema))
    return chat_format.read_back(written(chat_format.expand(turns), "chat-examples"))


@query("op6_packing")
def op6_packing(spark, sf):
    """Documents packed into windows of 2048, 1024, 512 and 256 tokens."""
    return packing.pack(read_table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY), end_id=1)


@query("op7_decontamination")
def op7_decontamination(spark, sf):
    """Documents that hold a passage of a benchmark item."""
    return decontaminate.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query("op8_pseudonyms")
def op8_pseudonyms(spark, sf):
    """Documents with personal numbers, dates and addresses replaced in their format."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonyms(docs, pii.TRIAL_KEY, count="n_replaced")


@query("op9_quality")
def op9_quality(spark, sf):
    """Quality score of every document, learned from labels that are not held out."""
    docs = read_table(spark, sf, "documents")
    model = quality_mil.train(docs, read_table(spark, sf, "labels"))
    return quality_mil.quality(docs, model).select(
        "doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_token_codes")
def op10_token_codes(spark, sf):
    """Documents stored as directly addressable codes, and read back from the files."""
    blocks = dac_codes.token_blocks(read_table(spark, sf, "documents"),
                                    public_tokenizers.path(VOCABULARY), end_id=2)
    return dac_codes.read_documents(written(blocks, "token-codes"))


#: The table of CRC-32 as DuckDB SQL, derived from its polynomial.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""



@query("op11_spelling", f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 6),
counted AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (
  SELECT w, c, coalesce(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(doc_id::VARCHAR || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
             ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END))),
           lambda s, x: xor(s >> 8, crc.t[(xor(s, x) & 255) + 1])), 4294967295), 1) AS h
  FROM counted, crc),
words AS (
  SELECT w AS word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w
        FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(c) >= 5),
gaps AS (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n
  FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION
  SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
  UNION
  SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b),
best AS (
  SELECT word, count(*) AS n_near, first(n) AS n,
         first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n
  FROM near GROUP BY word),
formed AS (SELECT word, form, form_n FROM best WHERE form_n >= 5 * n),
chain AS (
  SELECT word, word AS now FROM words
  UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.now)
SELECT w.word, f.form, r.now AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN formed f USING (word)
JOIN chain r ON r.word = w.word WHERE r.now NOT IN (SELECT word FROM formed)
""")
def op11_spelling(spark, sf):
    """Words one edit apart, and the common form of each."""
    return spelling.variants(spelling.vocabulary(read_table(spark, sf, "documents"), drop_every=199))


@query("op12_merkle", f"""
WITH RECURSIVE {_CRC_TABLE},
parts AS (
  SELECT doc_id, source, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS d, text AS e,
         coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),
           lambda ch: ascii(ch)::BIGINT)), lambda s, x: xor(s >> 8, crc.t[(xor(s, x) & 255) + 1])), 4294967295) % 2 = 0,
           false) AS tampered
  FROM documents, crc),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(e) || ':' || e, '-')) AS leaf,
         sha256(head || coalesce(strlen(f) || ':' || f, '-')) AS changed
  FROM (SELECT *, CASE WHEN tampered THEN replace(e, chr(10), '') ELSE e END AS f,
               coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-')
               || coalesce(strlen(c) || ':' || c, '-') || coalesce(strlen(d) || ':' || d, '-') AS head FROM parts)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos FROM leaves),
below AS (
  SELECT 0 AS level, source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT any_value(level) + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM below WHERE n > 1 GROUP BY source, pos // 3),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM below WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM above WHERE n > 1 GROUP BY pos // 3),
runs AS (
  SELECT 'below' AS part, level, source, pos // 3 AS run, list(digest ORDER BY pos) AS digests
  FROM below WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 'above', level, NULL, pos // 3, list(digest ORDER BY pos) FROM above WHERE n > 1 GROUP BY ALL),
fold AS (
  SELECT p.doc_id, p.leaf, p.changed, p.source, 'below' AS part, 0 AS level, p.pos, p.changed AS digest, '' AS proof,
         false AS done, row_number() OVER () AS id
  FROM placed p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.changed, f.source,
         CASE WHEN r.run IS NULL THEN 'above' ELSE f.part END, CASE WHEN r.run IS NULL THEN 0 ELSE f.level + 1 END,
         CASE WHEN r.run IS NOT NULL THEN f.pos // 3 ELSE s.pos END,
         CASE WHEN r.run IS NULL THEN f.digest ELSE sha256(array_to_string(list_transform(r.digests,
           lambda x, i: CASE WHEN i = f.pos % 3 + 1 THEN f.digest ELSE x END), '')) END,
         CASE WHEN r.run IS NULL THEN f.proof ELSE f.proof || array_to_string(list_filter(r.digests,
           lambda x, i: i <> f.pos % 3 + 1), '') END,
         f.part = 'above' AND r.run IS NULL, f.id
  FROM fold f LEFT JOIN runs r ON r.part = f.part AND r.level = f.level AND r.run = f.pos // 3
         AND (f.part = 'above' OR r.source IS NOT DISTINCT FROM f.source)
       JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source
  WHERE NOT f.done)
SELECT f.doc_id, f.leaf, s.digest AS subroot, root.digest AS root, sha256(f.proof) AS proof_sha256,
       f.digest AS folded_root, f.digest = root.digest AS verified
FROM fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source, (SELECT digest FROM above WHERE n = 1) root
WHERE f.done
""")
def op12_merkle(spark, sf):
    """Merkle manifest of the documents, and every possibly tampered row folded into it."""
    docs = read_table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    head = ("doc_id", "source", "lang", "n_chars")
    rows = docs.select("source", F.col("doc_id").alias("key"), merkle.leaf_digest(*head, "text").alias("leaf"),
                       F.struct(*head, text.alias("text")).alias("row"))
    rows = rows.select("source", "key", "leaf", merkle.leaf_digest(*[f"row.{c}" for c in (*head, "text")]).alias("changed"))
    return merkle.verify(rows).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                                      "folded_root", "verified")


@query("op13_main_text", r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(
           regexp_split_to_array(regexp_replace(regexp_replace(a, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(p|h1)>'),
           lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'),
             '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> '') AS bs
  FROM articles)
SELECT page_id, url, array_to_string(bs, chr(10) || chr(10)) AS text,
       length(array_to_string(bs, chr(10) || chr(10))) AS n_chars
FROM blocks
""")
def op13_main_text(spark, sf):
    """Main text of every page, by one wrapper per host."""
    return wrappers.main_text(read_table(spark, sf, "pages"))
