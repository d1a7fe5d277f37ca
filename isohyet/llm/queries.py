"""The queries of the llm operators on the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import collocations, decontaminate, extraction, fingerprint, jaccard, langid, lm, minhash, quality, secrets, sentencepiece, toxicity, whitening
from isohyet.llm.common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            TWINS[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Five-word shingle sets, all links, and the smallest doc_id that can be reached over them.
OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query("op1_minhash_near_duplicates", OP1)
def op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query("op7_secret_scan")
def op7(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"))


# The same sketch by MD5; the next document by doc_id, after the last the first.
OP9 = r"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text
  FROM documents),
texts AS (
  SELECT doc_id, 'own' AS part, text FROM ordered UNION ALL
  SELECT doc_id, 'next', next_text FROM ordered UNION ALL
  SELECT doc_id, 'edited', substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) FROM ordered),
words AS (
  SELECT doc_id, part, text, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM texts),
hashes AS (
  SELECT DISTINCT doc_id, part, substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16) AS h
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(i) WHERE len(w) > 0),
least AS (
  SELECT doc_id, part, list(h ORDER BY h) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY h) AS k FROM hashes) WHERE k <= 128 GROUP BY ALL),
sketches AS (SELECT doc_id, part, text, coalesce(s, []) AS s FROM words LEFT JOIN least USING (doc_id, part)),
pairs AS (
  SELECT o.doc_id, o.text, e.text AS edited, o.s, e.s AS es,
         list_sort(list_distinct(o.s || e.s))[1:128] AS ue, list_sort(list_distinct(o.s || x.s))[1:128] AS ux,
         list_intersect(o.s, e.s) AS be, list_intersect(o.s, x.s) AS bx
  FROM sketches o JOIN sketches e ON e.doc_id = o.doc_id AND e.part = 'edited'
  JOIN sketches x ON x.doc_id = o.doc_id AND x.part = 'next' WHERE o.part = 'own')
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(s, ',') AS fingerprint, array_to_string(es, ',') AS edited_fingerprint,
       CASE WHEN len(ue) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ue, be))::DOUBLE / len(ue) END AS near_edited,
       CASE WHEN len(ux) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ux, bx))::DOUBLE / len(ux) END AS near_next,
       CASE WHEN len(s) < 128 THEN len(s)
            ELSE CAST(round(127 / (('0x' || substr(s[128], 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS BIGINT) END AS n_distinct
FROM pairs
"""


@query("op9_fingerprints", OP9)
def op9(spark, sf_dir):
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


# All windows of every length that occurs among the items, matched by their words.
OP4 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS s
  FROM iw, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS g(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM dw, (SELECT DISTINCT m FROM windows), unnest(generate_series(1, len(w) - m + 1)) AS g(i)),
found AS (SELECT p.doc_id, p.i, p.m, v.item_id FROM places p JOIN windows v ON v.m = p.m AND v.s = p.s),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(generate_series(i, i + m - 1)) AS g(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_decontamination", OP4)
def op4(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.hits(documents, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op6_quality_neighbours")
def op6(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = quality.score(documents, quality.fit(documents, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op10_language_profiles")
def op10(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.learn_and_predict(documents, remainder("doc_id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op2_toxicity_neighbours")
def op2(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


@query("op3_log_bilinear_scores")
def op3(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.learn_and_score(documents, remainder("doc_id", 7) != 2)
    return scored.withColumn("held_out", remainder("doc_id", 7) == 2)


@query("op5_sentencepiece")
def op5(spark, sf_dir):
    return sentencepiece.encoded_and_checked(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


# Three-word shingle sets, all links of likeness 0.9, and the smallest doc_id that can be reached over them.
OP12 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query("op12_jaccard_join", OP12)
def op12(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# All n-grams inside pieces, the weakest cut of each frequent one, and no phrase inside a longer one as frequent.
OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM words, unnest(generate_series(1, 5)) AS ks(k), unnest(generate_series(1, len(w) - k + 1)) AS g(i)
  GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, cut,
         (1000::HUGEINT * c.f::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score, n
  FROM frequent c JOIN totals USING (lang), unnest(generate_series(1, c.k - 1)) AS g(cut)
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')),
weakest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts) WHERE place = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(f) AS covered
  FROM frequent, unnest(generate_series(2, k - 1)) AS ms(m), unnest(generate_series(1, k - m + 1)) AS g(i)
  WHERE k > 2 GROUP BY ALL),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS place_in_lang
  FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE covered IS NULL OR covered < a)
SELECT lang, place_in_lang AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE place_in_lang <= 2000
"""


@query("op11_collocations", OP11)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
