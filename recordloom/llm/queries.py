"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm import (
    decontaminate, html_blocks, licences, line_quality, merkle, mixing, ranked_search, sanitise, sharding, shingle_join,
    toxicity, url_lists, warc_zip,
)
from recordloom.llm.common import md5_number
from recordloom.session import tune

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, if it has one, its SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


LINE_QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS h FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
raw AS (SELECT rid, h, t, trim(l) AS line FROM (
          SELECT rid, h, t, unnest(regexp_split_to_array(
            regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ?\n ?')) AS l FROM d)
        WHERE trim(l) <> ''),
ln AS (SELECT DISTINCT h, t, line, words FROM (
         SELECT h, t, line, sum(len(string_split(line, ' '))) OVER (PARTITION BY rid, line) AS words FROM raw)),
often AS (SELECT h, line, count(*) AS n FROM ln GROUP BY ALL HAVING count(*) > 20),
wide AS (SELECT ln.*, often.n, row_number() OVER (PARTITION BY ln.h, t ORDER BY often.n DESC,
           ('0x' || substr(md5(ln.line), 1, 15))::BIGINT) AS r
         FROM ln JOIN often ON ln.h IS NOT DISTINCT FROM often.h AND ln.line = often.line),
-- near copies: mostly widespread lines, at most a seventh of the shingles new
mostly AS (SELECT a.h, a.t FROM (SELECT h, t, sum(words) AS n FROM ln GROUP BY ALL) a
           JOIN (SELECT h, t, sum(words) AS n FROM wide GROUP BY ALL) b
             ON a.h IS NOT DISTINCT FROM b.h AND a.t = b.t WHERE 2 * b.n > a.n),
sh AS (SELECT h, t, wide_line, unnest(list_distinct(list_transform(range(1, greatest(len(x) - 4, 1) + 1),
         lambda i: array_to_string(x[i:i + 4], ' ')))) AS s
       FROM (SELECT ln.h, ln.t, wide.line IS NOT NULL AS wide_line, string_split(ln.line, ' ') AS x
             FROM ln JOIN mostly m ON ln.h IS NOT DISTINCT FROM m.h AND ln.t = m.t
             LEFT JOIN wide ON ln.h IS NOT DISTINCT FROM wide.h AND ln.t = wide.t AND ln.line = wide.line)),
known AS (SELECT DISTINCT h, s FROM sh WHERE wide_line),
near AS (SELECT sh.h, t FROM sh LEFT JOIN known k ON sh.h IS NOT DISTINCT FROM k.h AND sh.s = k.s
         GROUP BY ALL HAVING 7 * count(*) FILTER (WHERE k.s IS NULL) <= count(*)),
comp AS (SELECT wide.h, line, CASE WHEN near.t IS NULL THEN 't' || wide.t WHEN r = 1
           THEN coalesce('l' || max(CASE WHEN r = 2 THEN line END) OVER (PARTITION BY wide.h, wide.t), 't' || wide.t)
           ELSE 'l' || max(CASE WHEN r = 1 THEN line END) OVER (PARTITION BY wide.h, wide.t) END AS c
         FROM wide LEFT JOIN near ON wide.h IS NOT DISTINCT FROM near.h AND wide.t = near.t),
spread AS (SELECT h, line FROM comp GROUP BY ALL HAVING count(DISTINCT c) > 20),
gone AS (SELECT wide.h, t, sum(words) AS n FROM wide JOIN spread
           ON wide.h IS NOT DISTINCT FROM spread.h AND wide.line = spread.line GROUP BY ALL),
base AS (SELECT w.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           (SELECT len(x) - len(list_distinct(x)) FROM (SELECT list_filter(string_split(t, chr(10)),
              lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS x)) AS n_dup_lines,
           coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
fin AS (SELECT base.*, coalesce(gone.n, 0)::BIGINT AS gone_n,
          n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed
        FROM base LEFT JOIN gone ON base.h IS NOT DISTINCT FROM gone.h AND base.t = gone.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND (gone_n = 0 OR (n_words - gone_n >= 20 AND n_words - gone_n >= 0.5 * n_words)) AS kept,
       gone_n AS n_removed_words
FROM fin
"""


@query("op10_line_quality", LINE_QUALITY_SQL)
def line_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_quality.judge(docs, columns=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_words")


@query("op3_sanitise")
def sanitise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # two documents, copies too, support a term: the given tables hold no entity in two distinct texts
    return sanitise.find(docs, support=2, by="documents", everywhere=True, columns=["doc_id"]).drop("_base", "_terms")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(text, '')) AS m FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
-- the level: the least rate at which the limited targets make up the whole
c AS (SELECT a.source, a.n, a.w, (SELECT sum(least(2.0 * b.n, b.w * (2.0 * a.n / a.w))) FROM w b) AS filled FROM w a),
low AS (SELECT coalesce(max(2.0 * n / w) FILTER (filled <= (SELECT 1.5 * sum(n) FROM w)), 0) AS r FROM c),
lev AS (SELECT (SELECT 1.5 * sum(n) - coalesce(sum(2.0 * n) FILTER (2.0 * n / w <= r), 0) FROM w)
             / (SELECT sum(w) FILTER (2.0 * n / w > r) FROM w) AS r FROM low),
t AS (SELECT source, n, least(2.0 * n, coalesce(w * lev.r, 2.0 * n)) AS target,
        CAST(floor(least(2.0 * n, coalesce(w * lev.r, 2.0 * n)) + 0.5) AS BIGINT) AS budget FROM w, lev),
r AS (SELECT d.doc_id, d.size, t.n, t.target, CASE WHEN t.n = 0 THEN 0 ELSE budget // t.n END AS epochs,
        CASE WHEN t.n = 0 THEN 0 ELSE budget % t.n END AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY
          ('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.m), 1, 15))::BIGINT, d.doc_id NULLS LAST, d.size
          ROWS UNBOUNDED PRECEDING) AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - (e - size))) AS BIGINT) AS taken FROM r
"""


@query("op7_mixing", MIX_SQL)
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), columns=["doc_id"])


@query("op1_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "source"))


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
      FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, w, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)),
bg AS (SELECT item_id, w, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM b WHERE len(w) >= 8)),
dw AS (SELECT doc_id, w, unnest(w) AS x, unnest(range(0, len(w))) AS shift FROM d),
c AS (SELECT DISTINCT doc_id, dg.w AS dw, item_id, bg.w AS iw, dg.p - bg.p AS shift FROM dg JOIN bg USING (g)
      UNION SELECT doc_id, dw.w, item_id, b.w, shift FROM dw JOIN b ON x = b.w[1] WHERE len(b.w) BETWEEN 1 AND 7),
m AS (SELECT doc_id, item_id, shift, len(iw) AS n, least(13, len(iw)) AS width, list_transform(range(1, len(iw) + 1),
        lambda j: CASE WHEN shift + j > 0 AND dw[shift + j] = iw[j] THEN 1 ELSE 0 END) AS same FROM c),
s AS (SELECT *, list_sum(same)::BIGINT AS total, list_max(list_transform(range(1, n - width + 2),
        lambda i: list_sum(same[i:i + width - 1])))::BIGINT AS best FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, total DESC, shift) AS k FROM s
      WHERE best >= width - CASE WHEN width >= 13 THEN 2 WHEN width >= 8 THEN 1 ELSE 0 END)
SELECT doc_id, item_id, n AS n_item_words, total AS n_matched, best AS n_window, shift AS start FROM r WHERE k = 1
"""


@query("op2_decontamination", DECONTAMINATION_SQL)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op6_shingle_join")
def shingle_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.classes(_table(spark, sf_dir, "documents"))


@query("op4_html_blocks")
def html_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"), columns=["page_id", "url"])


@query("op9_warc_zip")
def warc_zip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


@query("op8_licences")
def licences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"])))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"]))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"),
                        F.array_join(names, ",").alias("licences"), F.array_join(spans, ",").alias("spans"),
                        F.round(F.array_max(F.transform("found", lambda x: x["dice"])), 6).alias("best_dice"))


def _fetched(pages: DataFrame) -> DataFrame:
    """The pages with a fetch date that follows from the id, as the table has none."""
    return pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))


def _dated_lists(pages: DataFrame) -> DataFrame:
    """A log of list entries about the hosts of the table, dated by the hash of what they name."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct() \
        .withColumn("n", md5_number(F.col("host")))
    parents = hosts.select(F.concat(F.lit("d"), F.substring_index("host", ".", -3)).alias("d")).distinct() \
        .withColumn("n", md5_number(F.col("d")))

    def logged(rows, kind, value, start, days, action, where):
        day = F.date_add(F.lit(start).cast("date"), days.cast("int"))
        return rows.where(where).select(F.lit(kind).alias("kind"), value.alias("value"), day.alias("dated"),
                                        F.lit(action).alias("action"))

    n, host = F.col("n"), F.col("host")
    third = n % 3 == 0
    return (
        logged(hosts, "host", host, "2024-01-01", n % 200, "add", third)
        .unionByName(logged(hosts, "host", host, "2024-01-01", n % 200 + 40 + n % 50, "remove", third))
        .unionByName(logged(hosts, "host", host, "2024-01-01", n % 200 + 150, "add", n % 6 == 0))
        .unionByName(logged(hosts, "prefix", F.concat(host, F.lit("/en/")), "2024-02-01", n % 300, "add", n % 5 == 1))
        .unionByName(logged(parents, "domain", F.substring("d", 2, 1000), "2024-03-01", n % 200, "add", n % 4 == 0))
    )


URL_LIST_SQL = r"""
WITH p AS (SELECT *, DATE '2024-01-01' + (page_id * 37 % 366)::INTEGER AS day,
    nullif(rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)), '.'), '') AS host,
    regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS raw_path FROM pages),
c AS (SELECT *, CASE WHEN raw_path = '' THEN '/' ELSE raw_path END AS path FROM p),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 15))::BIGINT AS n FROM c WHERE host IS NOT NULL),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS d FROM h),
dn AS (SELECT d, ('0x' || substr(md5('d' || d), 1, 15))::BIGINT AS n FROM d),
e AS (SELECT 'host' AS kind, host AS value, DATE '2024-01-01' + (n % 200)::INTEGER AS dated, 'add' AS action FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + (n % 200 + 40 + n % 50)::INTEGER, 'remove' FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + (n % 200 + 150)::INTEGER, 'add' FROM h WHERE n % 6 = 0
  UNION ALL SELECT 'prefix', host || '/en/', DATE '2024-02-01' + (n % 300)::INTEGER, 'add' FROM h WHERE n % 5 = 1
  UNION ALL SELECT 'domain', d, DATE '2024-03-01' + (n % 200)::INTEGER, 'add' FROM dn WHERE n % 4 = 0),
i AS (SELECT * FROM (SELECT kind, value, dated, action, lead(dated) OVER (PARTITION BY kind, value ORDER BY dated) AS until
        FROM (SELECT kind, value, dated, max(action) AS action FROM e GROUP BY ALL)) WHERE action = 'add'),
m AS (SELECT page_id, url, day, kind || ':' || value AS rule, dated,
        row_number() OVER (PARTITION BY page_id, url, day ORDER BY CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
          length(value) DESC, value DESC, dated DESC) AS k, count(*) OVER (PARTITION BY page_id, url, day) AS n
      FROM c JOIN i ON (kind = 'host' AND value = host OR kind = 'domain' AND (host = value OR ends_with(host, '.' || value))
                        OR kind = 'prefix' AND starts_with(host || path, value))
        AND day >= dated AND (until IS NULL OR day < until))
SELECT c.page_id, c.host, m.rule IS NOT NULL AS blocked, m.rule, CAST(m.dated AS VARCHAR) AS listed_from, coalesce(m.n, 0) AS n_active
FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.url = m.url AND m.k = 1
"""


@query("op5_url_lists", URL_LIST_SQL)
def url_lists_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_lists.judge(_fetched(pages), _dated_lists(pages), columns=["page_id"])
    return judged.withColumn("listed_from", F.col("listed_from").cast("string"))


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RANKED_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS w FROM documents),
n AS (SELECT rid, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
i AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT rid, doc_id, term, count(*) AS tf FROM (SELECT rid, doc_id, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
s AS (SELECT item_id, rid, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN f USING (term) JOIN n USING (rid), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= 20
"""


@query("op11_ranked_search", RANKED_SQL)
def ranked_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


MERKLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, CASE WHEN crc % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS seen
  FROM (SELECT *, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) AS crc FROM documents)),
s AS (SELECT rid, doc_id, lang, text, seen, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d),
l AS (SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
        sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS shown FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS n FROM l),
tree AS (SELECT lang, 0 AS lvl, pos, h, n FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1
            GROUP BY lang, lvl, pos // 8, n),
sub AS (SELECT lang, lvl, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, h, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8, n),
-- all nodes in one numbering: the levels of the top follow after those of the group
walk AS (SELECT rid, p.lang, 0 AS lvl, p.pos, p.n, p.shown AS node, '' AS beside FROM p
  UNION ALL SELECT w.rid, w.lang, w.lvl + 1, w.pos // 8, (w.n + 7) // 8,
      sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.node ELSE t.h END, '' ORDER BY t.pos)),
      w.beside || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), '')
    FROM walk w JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.pos // 8 = w.pos // 8
    WHERE w.n > 1 GROUP BY w.rid, w.lang, w.lvl, w.pos, w.n, w.node, w.beside),
walk2 AS (SELECT rid, 0 AS lvl, sub.pos, sub.n, walk.node, walk.beside FROM walk JOIN sub ON sub.lang IS NOT DISTINCT FROM walk.lang WHERE walk.n = 1
  UNION ALL SELECT w.rid, w.lvl + 1, w.pos // 8, (w.n + 7) // 8,
      sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.node ELSE t.h END, '' ORDER BY t.pos)),
      w.beside || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), '')
    FROM walk2 w JOIN top t ON t.lvl = w.lvl AND t.pos // 8 = w.pos // 8
    WHERE w.n > 1 GROUP BY w.rid, w.lvl, w.pos, w.n, w.node, w.beside)
SELECT l.doc_id, l.h AS leaf, sub.h AS subroot, top.h AS root, sha256(w.beside) AS proof_sha256, w.node AS folded_root,
  w.node = top.h AS verified
FROM l JOIN walk2 w ON w.rid = l.rid AND w.n = 1 JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang, top WHERE top.n = 1
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # a third of the rows is shown with a changed text
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    shown = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"),
                           F.translate("text", UPPER, LOWER))
    manifest = merkle.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], carried=F.when(tampered, shown))
    root = F.lit(manifest.root)
    return merkle.proofs(manifest).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"),
        merkle.siblings_digest(F.col("steps")).alias("proof_sha256"),
        merkle.fold(F.coalesce("carried", "leaf"), F.col("steps")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == root)


@query("op13_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
