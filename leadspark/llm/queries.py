"""Queries of this subpackage and the DuckDB SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lexical, licenses, media, mixing, ngram_join, packing, secrets, spelling, toxicity, url_lists, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_ngram_join with the number of links of each document."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), count_links=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs.where(_remainder(4) != 2), _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.where(_remainder(5) != 0)))
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def warc_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves of the records of all pages, and of a replica that lacks, garbles, shortens or repeats some; each has its own bytes and offsets."""
    record = lambda html: warc.record(F.col("url"), html)
    own = lambda t, html: t.select(F.col("page_id").alias("key"), F.octet_length(record(html)).cast("long").alias("length"), F.sha2(record(html), 256).alias("digest"))
    of = lambda n, r: F.coalesce(F.pmod("page_id", F.lit(n)) == r, F.lit(False))
    html = F.col("html")
    garbled = F.when(of(101, 7), F.overlay("html", F.lit("#"), 1, 1)).when(of(103, 9), F.substr("html", F.lit(1), F.length("html") - 1)).otherwise(html)
    copy = pages.withColumn("html", garbled).where(~of(211, 5))
    copy = copy.withColumn("__n", F.explode(F.when(of(307, 11), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return warc.leaves(own(pages, html)), warc.leaves(own(copy, html))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit(*warc_replicas(_table(spark, sf_dir, "pages")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("notices")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(_table(spark, sf_dir, "documents"))).drop("media")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def url_captures(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: each gets a day of 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("day"))


def url_entries(captures: DataFrame) -> DataFrame:
    """A dated list over the domains of the captures themselves: a quarter of them comes and goes, some are allowed, and two are fixed."""
    host = captures.select(url_lists.host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    mark = F.substring(F.md5("domain"), 1, 1)
    day = lambda d: F.lit(d).cast("date")
    e = lambda verdict, action, d: F.struct(F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day(d).alias("day"))
    blocked = F.array(e("block", "add", "2024-02-10"), e("block", "remove", "2024-06-01"), e("block", "add", "2024-09-15"))
    allowed = F.array(e("allow", "add", "2024-04-01"), e("allow", "add", "2024-05-01"), e("allow", "remove", "2024-11-01"))
    some = F.when(mark < "4", blocked).when(mark < "6", allowed).otherwise(F.array().cast("array<struct<verdict:string,action:string,day:date>>"))
    listed = host.select("domain", F.explode(some).alias("e")).select("domain", "e.*")
    fixed = captures.sparkSession.sql("select * from values ('casino-win.example.com', 'block', 'add', date'2024-01-15'), ('example.org', 'block', 'add', date'2024-08-01') as t(domain, verdict, action, day)")
    return listed.unionByName(fixed)


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_captures(_table(spark, sf_dir, "pages"))
    return url_lists.judge(captures, url_entries(captures))


def op9_packing(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *packing.vocabulary(folder))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (op1_ngram_join, op1_ngram_links, op2_toxicity, op3_language, op4_warc, op5_licenses, op6_media, op7_secrets, op8_url_lists, op9_packing, op10_decontaminate, op11_lexical_search, op12_spelling_variants, op13_source_mix)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_SQL, "op1_ngram_links": LINKS_SQL, "op4_warc": WARC_SQL, "op7_secrets": SECRETS_SQL, "op8_url_lists": URL_SQL, "op11_lexical_search": LEXICAL_SQL, "op12_spelling_variants": SPELLING_SQL, "op13_source_mix": MIX_SQL}


NGRAM_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), t AS MATERIALIZED (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM s
), often AS (SELECT t FROM t GROUP BY t HAVING count(*) > 1
), u AS MATERIALIZED (SELECT t.* FROM t JOIN often USING (t)
), e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(least(s.doc_id, coalesce(low.b, s.doc_id)) AS BIGINT) AS component_id
FROM s LEFT JOIN low ON low.a = s.doc_id
"""

#: The same with the links of each document.
LINKS_SQL = f"""
WITH j AS MATERIALIZED ({NGRAM_SQL}), {NGRAM_SQL.split("RECURSIVE")[1].split(", both_ways")[0]}, l AS (SELECT d, count(*) AS n FROM (SELECT a AS d FROM e UNION ALL SELECT b FROM e) GROUP BY d)
SELECT j.*, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links FROM j LEFT JOIN l ON l.d = j.doc_id
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, html FROM pages
), q AS (
  SELECT page_id, u, CASE WHEN page_id % 101 = 7 THEN '#' || substr(html, 2) WHEN page_id % 103 = 9 THEN substr(html, 1, length(html) - 1) ELSE html END AS html,
    unnest(CASE WHEN page_id % 307 = 11 THEN [1, 2] ELSE [1] END) AS copy FROM p WHERE page_id % 211 <> 5
), both_ AS (SELECT 'a' AS side, page_id, u, coalesce(html, '') AS h FROM p UNION ALL SELECT 'b', page_id, u, coalesce(html, '') FROM q
), b AS (
  SELECT side, CAST(page_id AS VARCHAR) AS key,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', u, chr(13), chr(10), 'Content-Length: ', strlen(h), chr(13), chr(10), chr(13), chr(10), h, chr(13), chr(10), chr(13), chr(10)) AS x FROM both_
), o AS (SELECT side, key, strlen(x) AS length, sha256(x) AS digest FROM b
), l AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY side ORDER BY key, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM o
), n AS (SELECT *, row_number() OVER (PARTITION BY side, key, digest ORDER BY "offset") AS k FROM l
), r AS (
  SELECT *, row_number() OVER (PARTITION BY side, key ORDER BY "offset") AS turn FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS m WHERE m.side <> n.side AND m.key = n.key AND m.digest = n.digest AND m.k = n.k)
)
SELECT coalesce(a.key, c.key) AS key, a."offset" AS "offset", c."offset" AS replica_offset, CAST(coalesce(a.length, c.length) AS BIGINT) AS length, a.digest AS expected, c.digest AS found,
  CASE WHEN c.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'extra' ELSE 'corrupt' END AS status
FROM (SELECT * FROM r WHERE side = 'a') a FULL JOIN (SELECT * FROM r WHERE side = 'b') c ON a.key = c.key AND a.turn = c.turn
"""

URL_SQL = r"""
WITH c AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day,
    nullif(lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.')), '') AS host FROM pages
), h AS (SELECT DISTINCT host AS domain, substr(md5(host), 1, 1) AS mark FROM c WHERE host IS NOT NULL
), i AS (
  SELECT domain, 'block' AS verdict, DATE '2024-02-10' AS since, DATE '2024-06-01' AS until FROM h WHERE mark < '4'
  UNION ALL SELECT domain, 'block', DATE '2024-09-15', NULL FROM h WHERE mark < '4' AND domain NOT IN ('casino-win.example.com', 'example.org')
  UNION ALL SELECT domain, 'allow', DATE '2024-04-01', DATE '2024-11-01' FROM h WHERE mark >= '4' AND mark < '6'
  UNION ALL SELECT 'casino-win.example.com', 'block', DATE '2024-01-15', NULL
  UNION ALL SELECT 'example.org', 'block', DATE '2024-08-01', NULL
), m AS (
  SELECT d.host, i.* FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL) d JOIN i ON d.host = i.domain OR ends_with(d.host, '.' || i.domain)
), a AS (
  SELECT c.page_id, c.url, c.day, c.host, m.domain, m.verdict, m.since,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(m.domain) DESC NULLS LAST, m.verdict) AS k, count(m.domain) OVER (PARTITION BY c.page_id) AS n
  FROM c LEFT JOIN m ON c.host = m.host AND m.since <= c.day AND (m.until IS NULL OR c.day < m.until)
)
SELECT page_id, url, day, host, CAST(n AS BIGINT) AS n_active, domain, coalesce(verdict, 'none') AS verdict, since FROM a WHERE k = 1
"""

SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), k AS (
  SELECT rid, repo, t, 0 AS rank, 'assign' AS kind, 8 AS least, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p,
    regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS a,
    regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM d
  UNION ALL SELECT rid, repo, t, 1, 'access', 16, 'AKIA[A-Z0-9]+', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, repo, t, 2, 'hex', 32, '[0-9a-f]{32,}', regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}') FROM d
), x AS (
  SELECT rid, repo, rank, kind, least, a, v, list_transform(string_split_regex(t, p), lambda s: length(s)) AS b, unnest(range(1, len(a) + 1)) AS i FROM k WHERE len(a) > 0
), s AS (
  SELECT rid, repo, rank, kind, v[i] AS value, CAST(list_sum(b[1:i]) + coalesce(list_sum(list_transform(a[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS lo, length(a[i]) AS n FROM x WHERE length(v[i]) >= least
), o AS (SELECT value, count(DISTINCT split_part(repo, '/', 1)) >= 3 OR count(DISTINCT repo) >= 10 AS copied FROM s GROUP BY value
), w AS (
  SELECT s.*, lo + n AS hi, copied,
    NOT copied AND length(value) >= 16 AND len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '(?i)example|changeme|placeholder|your|xxxx') AS live FROM s JOIN o USING (value)
), every AS (
  SELECT rid, rank, kind, lo, hi FROM w UNION ALL SELECT DISTINCT rid, 3, 'live', hi - length(value), hi FROM w WHERE live
), g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live,
    string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank, hi) FILTER (rank < 3) AS base, string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, rank, hi) AS spans FROM every GROUP BY rid
), c AS (SELECT rid, count(*) AS n_copied FROM w WHERE copied GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN g USING (rid) LEFT JOIN c USING (rid)
"""

LEXICAL_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item, item_id, unnest(list_distinct(ws)) AS t FROM (
    SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark)
), g AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM w WHERE len(ws) > 0
), p AS MATERIALIZED (
  SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM w) WHERE t IN (SELECT t FROM i) GROUP BY ALL
), f AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(g.n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, g GROUP BY t
), c AS (SELECT rid, doc_id, p.t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * p.n * g.n) // g.l)))) AS c FROM p JOIN f ON p.t = f.t, g
), s AS (SELECT item, item_id, rid, doc_id, CAST(sum(c) AS BIGINT) AS score FROM c JOIN i ON c.t = i.t GROUP BY ALL HAVING sum(c) > 0
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 50
"""

#: Checksums by a table of 256 entries, near words by what is left of them without one letter.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(x AS BIGINT))) AS t
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents
), k AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM r WHERE length(w) >= 5 GROUP BY d, w
), h AS (
  SELECT w, k.n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h FROM k, crc
), v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h
), words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS c FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.c = b.c AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN words w ON cut.c = w.word
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN words w ON cut.c = w.word
), best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS turn FROM pairs
), f AS MATERIALIZED (
  SELECT w.word, CASE WHEN b.n >= 2 * w.n THEN b.b END AS form, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.a = w.word AND b.turn = 1
), walk AS (
  SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON walk.next = f.word
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

#: Sources of smallest size for their weight are the ones that cannot give their share; each sample is a running sum by rank.
MIX_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), u AS (
  SELECT *, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), o AS (SELECT rid, doc_id, source, size, u / (1 - u) / (1 + least(size, 1000) / 1000.0::DOUBLE) AS q FROM u
), r AS MATERIALIZED (SELECT rid, doc_id, source, size, CAST(floor(q / (1 + q) * 4503599627370496.0::DOUBLE) AS BIGINT) AS rank FROM o
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM r GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER w AS place, coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW w AS (ORDER BY source_size / CAST(weight AS DOUBLE), weight, source NULLS LAST)
), level AS (SELECT place, (CAST(total - given AS DOUBLE) / CAST(weights AS DOUBLE)) AS level FROM c WHERE weight * (total - given) <= 3 * source_size * weights ORDER BY place LIMIT 1
), g AS MATERIALIZED (
  SELECT source, source_size, CAST(CASE WHEN c.place < coalesce(level.place, 0) OR level.place IS NULL THEN 3 * source_size ELSE weight * level END AS DOUBLE) AS target FROM c LEFT JOIN level ON true
), h AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g
), x1 AS (
  SELECT r.*, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY r.source ORDER BY rank) AS upto FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source WHERE size > 0
), y1 AS MATERIALIZED (SELECT rid, source, size, rank, upto <= rest AS chosen, rest - sum(CASE WHEN upto <= rest THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM x1
), x2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS upto FROM y1 WHERE NOT chosen AND size <= rest
), z2 AS MATERIALIZED (SELECT rid, source, size FROM x2 WHERE upto <= rest
), y2 AS MATERIALIZED (
  SELECT y1.rid, y1.source, y1.size, y1.rank, y1.chosen OR z2.rid IS NOT NULL AS chosen, rest - sum(coalesce(z2.size, 0)) OVER (PARTITION BY y1.source) AS rest FROM y1 LEFT JOIN z2 ON y1.rid = z2.rid
), x3 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS upto, sum(size) OVER (PARTITION BY source, rank) AS own FROM y2 WHERE NOT chosen AND size <= 2 * rest
), z3 AS (SELECT rid FROM x3 WHERE upto <= rest OR upto - own <= rest AND upto - rest < rest - (upto - own))
SELECT r.doc_id, r.size, r.source, h.source_size, h.target, CAST(whole + CASE WHEN y2.chosen OR z3.rid IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST((whole + CASE WHEN y2.chosen OR z3.rid IS NOT NULL THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source LEFT JOIN y2 ON y2.rid = r.rid LEFT JOIN z3 ON z3.rid = r.rid
"""
