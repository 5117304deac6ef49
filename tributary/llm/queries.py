"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontaminate, language, merkle, pii, quality, quotes, similar, simhash, spelling, substrings, tokenfile, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(read(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.from_documents(read(spark, sf_dir, "documents")))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, with declared language, address suffix and host."""
    return language.identify(language.from_pages(read(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bytebpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"), secrets=True)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_without_lines(read(spark, sf_dir, "documents"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.components(read(spark, sf_dir, "documents"), 0.9, 3)


OP1_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS id, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM m),
p AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS lv, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS c FROM l),
r AS (SELECT *, sum(CASE WHEN lv = was THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run
      FROM (SELECT *, lag(lv, 1, -1) OVER (PARTITION BY id ORDER BY i) AS was FROM p)),
ps AS (SELECT id, conv_id, turn, run, any_value(lv) AS lv, string_agg(c, chr(10) ORDER BY i) AS txt FROM r GROUP BY id, conv_id, turn, run),
n AS (SELECT *, lower(trim(regexp_replace(txt, '\s+', ' ', 'g'))) AS k FROM ps),
nz AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run) - 1 AS place FROM n WHERE k <> ''),
keys AS (SELECT id, conv_id, turn, lv, place, 0 AS rank, k FROM nz
         UNION SELECT id, conv_id, turn, lv, place, 1, k FROM (SELECT id, conv_id, turn, lv, place, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS k FROM (SELECT *, unnest(string_split(txt, chr(10))) AS x FROM nz)) WHERE k <> ''),
wrote AS (SELECT conv_id, k, min(turn) AS origin FROM keys WHERE lv = 0 GROUP BY conv_id, k),
found AS (SELECT keys.*, origin FROM keys JOIN wrote USING (conv_id, k) WHERE lv > 0 AND origin < turn),
best AS (SELECT id, origin AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lv, rank, place, origin) AS o FROM found) WHERE o = 1),
linked AS (SELECT id, count(DISTINCT place) AS n_linked FROM found GROUP BY id),
of_turn AS (SELECT conv_id, turn, origin FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY lv, rank, place, origin) AS o FROM found) WHERE o = 1),
up AS (SELECT conv_id, turn, origin AS z, 1 AS depth FROM of_turn UNION ALL SELECT up.conv_id, up.turn, o.origin, depth + 1 FROM up JOIN of_turn o ON up.conv_id = o.conv_id AND up.z = o.turn),
tops AS (SELECT conv_id, turn, min(z) AS thread, max(depth) AS depth FROM up GROUP BY conv_id, turn),
body AS (SELECT id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^(?:[ \t]*\n)+|\s+$', '', 'g') AS body FROM p WHERE lv = 0 GROUP BY id),
nq AS (SELECT id, count(*) AS n_quotes FROM nz WHERE lv > 0 GROUP BY id)
SELECT m.conv_id, m.turn, m.role, best.reply_to, coalesce(tops.thread, m.turn) AS thread, CAST(coalesce(tops.depth, 0) AS BIGINT) AS depth,
       CAST(row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(tops.thread, m.turn), m.turn, m.role) - 1 AS BIGINT) AS position,
       CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, coalesce(body, '') AS body
FROM m LEFT JOIN best USING (id) LEFT JOIN linked USING (id) LEFT JOIN body USING (id) LEFT JOIN nq USING (id) LEFT JOIN tops ON m.conv_id = tops.conv_id AND m.turn = tops.turn
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT page_id, strlen(h) AS n, string_agg(translate(to_base(CAST('0x' || substr(sha, 10 * i + 1, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), '' ORDER BY i) AS d
      FROM p, range(4) t(i) GROUP BY page_id, h, sha),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= n)),
occ AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM dwin d JOIN win ON d.g = win.g AND d.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
al AS (SELECT d.doc_id, win.item_id, d.i AS di, win.i AS ii, d.n FROM dwin d JOIN (SELECT item_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)) win ON d.g = win.g AND d.n = win.n),
runs AS (SELECT doc_id, item_id, n, min(di) AS di, min(ii) AS ii, count(*) AS c FROM (SELECT *, di - row_number() OVER (PARTITION BY doc_id, item_id, n, di - ii ORDER BY di) AS grp FROM al) GROUP BY doc_id, item_id, n, di - ii, grp),
longest AS (SELECT doc_id, item, item_word, doc_word, n_match FROM (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, ii - 1 AS item_word, di - 1 AS doc_word, n + c - 1 AS n_match,
            row_number() OVER (PARTITION BY doc_id ORDER BY n + c - 1 DESC, CAST(item_id AS VARCHAR), ii, di) AS o FROM runs) WHERE o = 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, item, item_word, doc_word, n_match
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


#: A table of CRC-32 by its rule; crc(x) over a list of bytes is written out where it is used.
CRC_TABLE = "crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"

OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
once AS (SELECT doc_id, w, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM run WHERE length(w) >= 7 GROUP BY doc_id, w),
coded AS (SELECT w, k, xor(4294967295, list_reduce(list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM once, crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM coded) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, range(length(word)) r(i)),
link AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = rest UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = rest),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM link QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) = 1),
f AS (SELECT word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT up.word, root FROM up JOIN f ON f.word = root WHERE form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
f AS (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
      xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS code FROM documents, crc),
d AS (SELECT doc_id, coalesce('1' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS claim FROM (SELECT *, CASE WHEN code % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM f)),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
lv AS (SELECT g, 0 AS level, i, leaf AS h, m FROM r
       UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM lv WHERE m > 1 GROUP BY g, level, i // 3),
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM lv WHERE m = 1),
tl AS (SELECT 0 AS level, i, subroot AS h, m FROM tops UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM tl WHERE m > 1 GROUP BY level, i // 3),
every AS (SELECT '1' || g AS g, level, i, h, m FROM lv UNION ALL SELECT '0', level, i, h, m FROM tl),
sib AS (SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
        FROM every a JOIN every b ON a.g = b.g AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.m > 1 GROUP BY a.g, a.level, a.i),
up AS (SELECT r.*, '1' || g AS tree, 0 AS level, i AS spot, claim AS fold, '' AS proof FROM r
       UNION ALL SELECT up.doc_id, up.g, up.leaf, up.claim, up.i, up.m, tree, up.level + 1, spot // 3, sha256(sib.l || fold || sib.r), proof || sib.l || sib.r FROM up JOIN sib ON sib.g = tree AND sib.level = up.level AND sib.i = spot),
mid AS (SELECT up.*, tops.subroot, tops.i AS place FROM up JOIN tops USING (g) QUALIFY row_number() OVER (PARTITION BY up.g, up.i ORDER BY level DESC) = 1),
fin AS (SELECT doc_id, g, i, leaf, subroot, 0 AS level, place AS spot, fold, proof FROM mid
        UNION ALL SELECT doc_id, fin.g, fin.i, leaf, subroot, fin.level + 1, spot // 3, sha256(sib.l || fold || sib.r), proof || sib.l || sib.r FROM fin JOIN sib ON sib.g = '0' AND sib.level = fin.level AND sib.i = spot)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY level DESC) = 1), (SELECT h AS root FROM tl WHERE m = 1)
"""


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pair JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.z = e.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) LEFT JOIN c USING (doc_id)
"""


QUERIES = (op1_quotation_linking, op2_decontamination, op3_warc, op4_simhash, op5_token_files, op6_substring_dedup, op7_quality_rules, op8_language_id, language_id_pages, op9_byte_bpe, op10_pii, op11_spelling, op12_merkle, op13_ngram_jaccard)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_linking": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_warc": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op11_spelling": OP11_SQL, "op12_merkle": OP12_SQL, "op13_ngram_jaccard": OP13_SQL}
