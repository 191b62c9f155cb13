"""The operators as queries over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelens.llm import decontaminate, exact_dedup, lexical_search, line_dedup, minhash_dedup, mixing, neighbours, quality, spelling, substring_dedup, suffix_dedup, token_counts, url_filter
from ratelens.llm.tables import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("row.doc_id", "source", "block", "slot", "place")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS t(host, path, verdict)")
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("row.page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.fit(docs, labels.where(~held_out))
    scored = quality.score(spark, docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)
    return found.select("row.doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_decontamination, op2_mixing, op3_neighbours, op4_suffix_dedup, op5_url_filter, op6_quality, op7_substring_dedup,
    op8_line_dedup, op9_token_counts, op10_minhash_dedup, op11_exact_dedup, op12_spelling_variants, op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

# What the three deduplications share: symbols (doc_id, j, s) and windows (doc_id, j, h).
_COVER = """
covered AS (
  SELECT *, coalesce(max(CASE WHEN {later} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j
         ROWS BETWEEN {back} PRECEDING AND CURRENT ROW), 0) AS c
  FROM ranked),
marked AS (SELECT *, CASE WHEN c = 1 AND coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 THEN 1 ELSE 0 END AS b FROM covered)"""

SQL = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)
  UNION ALL SELECT doc_id, array_to_string(w[p:p + n - 1], ' ') FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT len(w) AS n FROM i WHERE len(w) BETWEEN 1 AND 4))),
its AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)
  UNION SELECT item_id, array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_shingles FROM its GROUP BY 1),
f AS (SELECT doc_id, item_id, CAST(count(DISTINCT s) AS INTEGER) AS n_found FROM ds JOIN its USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found * 100 >= n_shingles * 80""",
    "op2_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS mark FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d),
roots AS (SELECT source, sqrt(count(*)) AS root FROM d GROUP BY 1),
shares AS (SELECT source, greatest(1, CAST(round(1000 * root / (SELECT sum(root) FROM roots)) AS BIGINT)) AS share FROM roots),
s AS (SELECT list(share ORDER BY source) AS a, list(source ORDER BY source) AS names, CAST(sum(share) AS BIGINT) AS total FROM shares),
steps AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM s
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, list_min(list_transform(done, lambda x, i: CASE WHEN (x * total) // a[i] <= t
               THEN (((x + 1) * total + a[i] - 1) // a[i]) * 1000000 + i ELSE 9000000000000000 END)) % 1000000 AS p FROM steps, s WHERE t < total)),
slots AS (SELECT names[pick] AS source, t - 1 AS slot0, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM steps, s WHERE t > 0),
b AS (SELECT *, place // 20000 AS block FROM placed)
SELECT doc_id, b.source, block, CAST((block // share) * (SELECT total FROM s) + slot0 AS BIGINT) AS slot, place
FROM b JOIN shares USING (source) JOIN slots ON slots.source = b.source AND slots.k = b.block % share""",
    "op4_suffix_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
sym AS (SELECT doc_id, j, substring(x, 2 * j - 1, 2) AS s, CASE WHEN 2 * j + 198 <= length(x) THEN md5(substring(x, 2 * j - 1, 200)) END AS h
        FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 + 1)) AS j FROM d)),
ranked AS (SELECT *, CASE WHEN h IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY h ORDER BY doc_id, j) END AS r FROM sym),
{_COVER.format(later="r > 1", back=99)},
g AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_bytes, CAST(sum(c) AS BIGINT) AS n_removed, CAST(sum(b) AS BIGINT) AS n_spans,
             coalesce(string_agg(CASE WHEN c = 0 THEN s END, '' ORDER BY j), '') AS kept FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op5_url_filter": rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_ABC}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fits AS (
  SELECT page_id, concat(h, p) AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS r
  FROM u JOIN rules ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (page_id)""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sym AS (SELECT doc_id, j, w[j] AS s, CASE WHEN j + 49 <= len(w) THEN md5(array_to_string(w[j:j + 49], ' ')) END AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
ranked AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM sym),
{_COVER.format(later="h IS NOT NULL AND m < doc_id", back=49)},
g AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(c) AS BIGINT) AS n_removed, string_agg(CASE WHEN c = 0 THEN s END, ' ' ORDER BY j) AS kept FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
sym AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS j, trim(line, chr(32) || chr(9) || chr(13)) AS s FROM l WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''),
counted AS (SELECT *, len({_WORDS.format("s")}) AS w, count(*) OVER (PARTITION BY doc_id) AS n_all FROM sym),
ahead AS (SELECT *, lead(s, 1) OVER o AS s1, lead(s, 2) OVER o AS s2, lead(w, 1) OVER o AS w1 FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
stretches AS (
  SELECT doc_id, j, 3 AS m, 3 AS kind, s || chr(10) || s1 || chr(10) || s2 AS h FROM ahead WHERE s2 IS NOT NULL
  UNION ALL SELECT doc_id, j, 2, 2, s || chr(10) || s1 FROM ahead WHERE w + w1 >= 50
  UNION ALL SELECT doc_id, j, 1, 1, s FROM ahead WHERE w >= 50
  UNION ALL SELECT doc_id, j, n_all, 0, s || coalesce(chr(10) || s1, '') FROM ahead WHERE j = 1 AND n_all < 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, md5(h) ORDER BY doc_id, j) AS r FROM stretches),
hits AS (SELECT DISTINCT doc_id, unnest(range(j, j + m)) AS j FROM ranked WHERE r > 1),
covered AS (SELECT sym.doc_id, n, sym.j, CASE WHEN hits.j IS NULL THEN 0 ELSE 1 END AS c FROM sym LEFT JOIN hits ON hits.doc_id = sym.doc_id AND hits.j = sym.j),
marked AS (SELECT *, CASE WHEN c = 1 AND coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 THEN 1 ELSE 0 END AS b FROM covered),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.n) AS kept FROM l LEFT JOIN marked m ON m.doc_id = l.doc_id AND m.n = l.n WHERE coalesce(m.c, 0) = 0 GROUP BY 1),
g AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(c) AS BIGINT) AS n_removed, CAST(sum(b) AS BIGINT) AS n_runs FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), {_ABC})")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id""",
    "op11_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_ABC}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
    "op12_spelling_variants": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[a-zÀ-ÿ]+') AS w FROM documents),
runs AS (SELECT concat(doc_id, ':', run) AS s, run, n FROM (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(w) AS run FROM d) GROUP BY 1, 2)),
bits AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
bytes AS (
  SELECT run, n, [CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(x), 2), lambda p: CAST(16 * (strpos('0123456789ABCDEF', substring(x, p, 1)) - 1) + strpos('0123456789ABCDEF', substring(x, p + 1, 1)) - 1 AS BIGINT)) AS b
  FROM (SELECT run, n, hex(encode(s)) AS x FROM runs)),
h AS (SELECT run, n, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM bytes, steps),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substring(run, 1, CAST(h % length(run) AS BIGINT)), substring(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
gone AS (SELECT DISTINCT cut.word AS x, v.word AS y FROM cut JOIN v ON v.word = concat(a, b)),
near AS (
  SELECT p.word AS x, q.word AS y FROM cut p JOIN cut q ON p.a = q.a AND p.b = q.b AND p.word <> q.word
  UNION SELECT x, y FROM gone UNION SELECT y, x FROM gone),
best AS (
  SELECT x, y, v.n AS y_n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS r FROM near JOIN v ON v.word = y),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN y_n >= 2 * v.n THEN y END AS form, CASE WHEN y_n >= 2 * v.n THEN y_n END AS form_n FROM v LEFT JOIN best ON x = v.word AND r = 1),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY 1, 2),
f AS (SELECT t, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
v AS (SELECT t, df, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, c),
i AS (SELECT p.doc_id, p.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS score FROM p JOIN n USING (doc_id) JOIN v USING (t), c),
s AS (SELECT item_id, doc_id, CAST(sum(score * times) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
