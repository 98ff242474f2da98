"""Independent DuckDB formulations of the registered queries.

Each string runs on DuckDB with the driver tables registered as views.  They
are written from the operator definitions, not from the Spark code: plain
SQL aggregates (``quantile_cont``, ``stddev_samp``), all-pairs joins where the
Spark plan avoids them, and list lambdas where Spark uses arrays.
"""

from __future__ import annotations

import public_tokenizers

from pressroom.config import DEFAULT as CFG

# --- shared CTE fragments --------------------------------------------------

ARTICLES = f"""
articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS uuid, text AS article, source AS domain,
         'https://' || source || '/' || CAST(doc_id AS VARCHAR) AS url,
         TIMESTAMP '{CFG.crawl_epoch}' + to_days(CAST(doc_id AS INTEGER)) AS date_of_creation,
         TIMESTAMP '{CFG.crawl_epoch}' + to_days(CAST(doc_id AS INTEGER)) AS cc_date,
         split_part(source, '.', 1) AS site, lang, doc_id
  FROM documents)"""

# word count: the data's only white space is blank and newline (FIXTURES.md)
WORDS = "len(list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r]+'), lambda w: w <> ''))"

STATS = f"""
stats AS (
  SELECT *, length(article) AS article_length, {WORDS.format(t='article')} AS word_count
  FROM articles)"""

FILTERED = f"""
filtered AS (
  SELECT * FROM stats
  WHERE article_length BETWEEN {CFG.min_article_len} AND {CFG.max_article_len}
    AND word_count >= {CFG.min_article_words})"""


def describe_sql(src: str, value: str, key: str) -> str:
    return f"""
SELECT {key},
       CAST(count({value}) AS BIGINT) AS count,
       round(avg({value}), 4) AS mean,
       round(stddev_samp({value}), 4) AS std,
       CAST(min({value}) AS BIGINT) AS min,
       CAST(trunc(quantile_cont({value}, 0.25)) AS BIGINT) AS p25,
       CAST(trunc(quantile_cont({value}, 0.5)) AS BIGINT) AS p50,
       CAST(trunc(quantile_cont({value}, 0.75)) AS BIGINT) AS p75,
       CAST(max({value}) AS BIGINT) AS max
FROM {src} GROUP BY {key}"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


ORACLE: dict[str, str] = {}

ORACLE["flagship_clean_length_describe"] = with_(ARTICLES, STATS, FILTERED) + describe_sql(
    "filtered", "article_length", "domain")

STRIP = "regexp_replace({t}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


def histogram_sql(src: str, value: str, key: str | None, bins: int = 100) -> str:
    k = f"{key}, " if key else ""
    using = f"JOIN rng USING ({key})" if key else "CROSS JOIN rng"
    return f""",
vc AS (SELECT {k}{value} AS v FROM {src} WHERE {value} IS NOT NULL),
rng AS (SELECT {k}min(v) AS lo, max(v) AS hi FROM vc {'GROUP BY ' + key if key else ''}),
b AS (SELECT {k}lo, hi, CAST(CASE WHEN hi = lo THEN 0
                 ELSE least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INTEGER) AS bin
      FROM vc {using})
SELECT {k}bin, round(lo + ((hi - lo) * bin) / {bins}.0, 4) AS bin_start,
       round(lo + ((hi - lo) * (bin + 1)) / {bins}.0, 4) AS bin_end, count(*) AS n
FROM b GROUP BY {k}bin, lo, hi"""


def yearly_sql(src: str, date: str, ident: str, extra_cte: str = "") -> str:
    return f"""{extra_cte}
SELECT CAST(year({date}) AS BIGINT) AS year, count({ident}) AS n
FROM {src} WHERE {date} IS NOT NULL AND year({date}) <= {CFG.year_max}
GROUP BY 1"""


ORACLE["g1_describe_length_raw"] = with_(ARTICLES, STATS) + describe_sql("stats", "article_length", "domain")
ORACLE["g2_describe_words_raw"] = with_(ARTICLES, STATS) + describe_sql("stats", "word_count", "domain")
ORACLE["g2_describe_words_clean"] = with_(ARTICLES, STATS, FILTERED) + describe_sql("filtered", "word_count", "domain")
ORACLE["g3_histogram_length_per_site"] = with_(ARTICLES, STATS) + histogram_sql("stats", "article_length", "site")
ORACLE["g3_histogram_words_per_site"] = with_(ARTICLES, STATS) + histogram_sql("stats", "word_count", "site")
ORACLE["g4_histogram_length_all_raw"] = with_(ARTICLES, STATS) + histogram_sql("stats", "article_length", None)
ORACLE["g4_histogram_words_all_clean"] = with_(ARTICLES, STATS, FILTERED) + histogram_sql("filtered", "word_count", None)
ORACLE["g5_yearly_articles"] = yearly_sql("articles", "date_of_creation", "uuid", with_(ARTICLES))
ORACLE["g5_yearly_orders"] = yearly_sql("orders", "o_orderdate", "o_orderkey")
ORACLE["g5_yearly_events"] = yearly_sql("events", "ts", "event_id").replace(f"<= {CFG.year_max}", "<= 2024")
ORACLE["g6_yearly_by_language_sets"] = with_(ARTICLES) + f"""
SELECT CAST(year(date_of_creation) AS BIGINT) AS year,
       CASE WHEN grouping(lang) = 1 THEN '__all__' ELSE lang END AS lang,
       count(uuid) AS n
FROM articles WHERE date_of_creation IS NOT NULL AND year(date_of_creation) <= {CFG.year_max}
GROUP BY GROUPING SETS ((year(date_of_creation)), (year(date_of_creation), lang))"""
ORACLE["g7_describe_length_rollup"] = with_(ARTICLES, STATS) + describe_sql(
    "stats", "article_length", "site") + " UNION ALL " + describe_sql(
    "(SELECT '__all__' AS site, * EXCLUDE (site) FROM stats)", "article_length", "site")
ORACLE["g8_raw_vs_clean_length"] = with_(ARTICLES, STATS, FILTERED) + describe_sql(
    "(SELECT 'raw' AS stage, * FROM stats UNION ALL SELECT 'clean' AS stage, * FROM filtered)",
    "article_length", "stage, domain")

ORACLE["t2_t5_text_scalars"] = with_(ARTICLES) + f"""
SELECT uuid, length(article) AS article_length,
       {WORDS.format(t='article')} AS word_count,
       CASE WHEN {STRIP.format(t='article')} = '' THEN 0
            ELSE len(regexp_split_to_array({STRIP.format(t='article')}, '[.!?]+\\s+')) END AS sentence_count,
       len(regexp_extract_all(article, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS token_count,
       length(replace(article, chr(10), ' ')) AS lid_length,
       CAST(instr(replace(article, chr(10), ' '), chr(10)) AS BIGINT) AS lid_newline_at
FROM articles"""
ORACLE["t1_nfkc"] = with_(ARTICLES) + """
SELECT uuid, length(article) AS n_before, length(nfc_normalize(article)) AS n_after,
       nfc_normalize(article) <> article AS changed
FROM articles"""
ORACLE["c1_c2_length_word_filter"] = with_(ARTICLES, STATS, FILTERED) + """
SELECT uuid, site, article_length, word_count FROM filtered"""
ORACLE["c5_sentence_filter"] = with_(ARTICLES, STATS, FILTERED) + f"""
SELECT uuid, site FROM filtered
WHERE CASE WHEN {STRIP.format(t='article')} = '' THEN 0
           ELSE len(regexp_split_to_array({STRIP.format(t='article')}, '[.!?]+\\s+')) END >= {CFG.min_article_sentences}"""
ORACLE["k9_stage_audit"] = with_(ARTICLES, STATS) + f"""
SELECT site, count(*) AS n_input,
       count_if(article_length BETWEEN {CFG.min_article_len} AND {CFG.max_article_len}) AS n_length_ok,
       count_if(article_length BETWEEN {CFG.min_article_len} AND {CFG.max_article_len}
                AND word_count >= {CFG.min_article_words}) AS n_words_ok,
       count_if(article_length BETWEEN {CFG.min_article_len} AND {CFG.max_article_len}
                AND word_count >= {CFG.min_article_words} AND lang IN ('fr', 'de')) AS n_language_ok
FROM stats GROUP BY site"""
ORACLE["s4_site_selection_substring"] = with_(ARTICLES) + """
SELECT site, count(*) AS n FROM articles
WHERE contains(site, 'src1') OR contains(site, 'src2') GROUP BY site"""
ORACLE["s4_site_selection_exact"] = with_(ARTICLES) + """
SELECT site, count(*) AS n FROM articles WHERE site IN ('src1', 'src2') GROUP BY site"""

# --- near-duplicate removal ------------------------------------------------
K = CFG.num_perm
R = CFG.rows_per_band
DEDUP_IN = """
dedup_in AS (SELECT uuid, article, cc_date, site FROM articles)"""
SIGS = f"""
hx AS (SELECT uuid, hex(encode(article)) AS hx FROM dedup_in),
sh AS (SELECT uuid, unnest(list_transform(range(0, length(hx) // 2 - {CFG.char_ngram - 1}),
                                           lambda i: substr(hx, 2 * i + 1, {2 * CFG.char_ngram}))) AS g
       FROM hx WHERE length(hx) // 2 >= {CFG.char_ngram}),
hs AS (SELECT uuid, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS h FROM sh),
mins AS (SELECT uuid, CAST(h % {K} AS INTEGER) AS slot, min(h) AS h FROM hs GROUP BY ALL),
firsts AS (SELECT uuid, min(slot) AS k_first, arg_min(h, slot) AS h_first, count(*) AS n_slots
           FROM mins GROUP BY uuid),
grid AS (SELECT f.uuid, t.j, m.h, CASE WHEN m.h IS NOT NULL THEN t.j END AS ks
         FROM firsts f CROSS JOIN range(0, {K}) t(j)
         LEFT JOIN mins m ON m.uuid = f.uuid AND m.slot = t.j),
nexts AS (SELECT uuid, j,
                 first_value(ks IGNORE NULLS) OVER w AS k_next,
                 first_value(h IGNORE NULLS) OVER w AS h_next
          FROM grid
          WINDOW w AS (PARTITION BY uuid ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT n.uuid, n.j,
                  CASE WHEN k_next IS NOT NULL THEN h_next + (k_next - n.j) * 4294967296
                       ELSE h_first + (k_first + {K} - n.j) * 4294967296 END AS v
           FROM nexts n JOIN firsts f USING (uuid)),
sigs AS (SELECT uuid, list(v ORDER BY j) AS sig FROM filled GROUP BY uuid),
bands AS (SELECT uuid, b AS band, list_slice(sig, b * {R} + 1, b * {R} + {R}) AS bkey
          FROM sigs CROSS JOIN range(0, {CFG.num_bands}) t(b))"""

LOSERS = f"""
pairs AS (SELECT DISTINCT x.uuid AS ux, y.uuid AS uy
          FROM bands x JOIN bands y ON x.band = y.band AND x.bkey = y.bkey AND x.uuid <> y.uuid),
losers AS (SELECT DISTINCT p.ux AS uuid
           FROM pairs p
           JOIN sigs sx ON sx.uuid = p.ux JOIN sigs sy ON sy.uuid = p.uy
           JOIN dedup_in mx ON mx.uuid = p.ux JOIN dedup_in my ON my.uuid = p.uy
           WHERE (my.cc_date > mx.cc_date OR (my.cc_date = mx.cc_date AND my.uuid > mx.uuid))
             AND list_sum(list_transform(range(1, {K + 1}),
                          lambda i: CASE WHEN sx.sig[i] = sy.sig[i] THEN 1 ELSE 0 END)) >= {CFG.min_agree}
           UNION  -- an older copy of the same text loses, however short
           SELECT x.uuid FROM dedup_in x JOIN dedup_in y ON x.article = y.article
           WHERE y.cc_date > x.cc_date OR (y.cc_date = x.cc_date AND y.uuid > x.uuid))"""


def split_sql(src: str) -> str:
    tp = round(CFG.train_size * 1000)
    vp = round((CFG.train_size + CFG.valid_size) * 1000)
    return f"""
ranked AS (SELECT uuid, site,
                  row_number() OVER (PARTITION BY site ORDER BY md5('{CFG.split_seed}' || uuid), uuid) AS rank,
                  count(*) OVER (PARTITION BY site) AS n
           FROM {src})
SELECT uuid, site, CASE WHEN rank <= (n * {tp}) // 1000 THEN 'train'
                        WHEN rank <= (n * {vp}) // 1000 THEN 'valid' ELSE 'test' END AS split, rank
FROM ranked"""


ORACLE["d11_exact_duplicates"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN) + """,
best AS (SELECT sha256(article) AS th, max({'d': cc_date, 'u': uuid}) AS b FROM dedup_in GROUP BY 1)
SELECT d.uuid, best.b['u'] AS kept_uuid
FROM dedup_in d JOIN best ON sha256(d.article) = best.th
WHERE d.uuid <> best.b['u']"""
ORACLE["d2_minhash_signatures"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN, SIGS) + """
SELECT s.uuid, s.sig, f.n_slots FROM sigs s JOIN firsts f USING (uuid)
WHERE s.uuid IN (SELECT uuid FROM dedup_in)"""
ORACLE["d3_lsh_shared_buckets"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN, SIGS) + """,
per AS (SELECT band, bkey, count(*) AS size FROM bands GROUP BY band, bkey HAVING count(*) > 1)
SELECT CAST(band AS INTEGER) AS band, count(*) AS n_buckets, CAST(sum(size) AS BIGINT) AS n_members
FROM per GROUP BY band"""
ORACLE["d6_near_duplicate_losers"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN, SIGS, LOSERS) + """
SELECT uuid FROM losers"""
ORACLE["d9_split_assignment"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN) + "," + split_sql("dedup_in")
ORACLE["d10_dedup_split"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN, SIGS, LOSERS) + "," + split_sql(
    "(SELECT * FROM dedup_in WHERE uuid NOT IN (SELECT uuid FROM losers))").replace(
    "'test' END AS split, rank", "'test' END AS split")

# --- URL and index operators -----------------------------------------------
from pressroom.functions.urls import BAD_URL_RULES, blocklist_pattern  # noqa: E402

BINDING_URL_RULES = (r"m\..*", r"blog\..*\?.*", r".*\.example\.net/en/1.*")
ORACLE["u1_url_blocklist_reference_rules"] = f"""
SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '{blocklist_pattern(BAD_URL_RULES)}')"""
ORACLE["u1_url_blocklist_binding_rules"] = f"""
SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '{blocklist_pattern(BINDING_URL_RULES)}')"""
ORACLE["s6_u1_rule_file"] = ORACLE["u1_url_blocklist_binding_rules"]
ORACLE["u2_u3_domain_and_site"] = """
WITH v AS (SELECT page_id, 0 AS variant, url FROM pages
           UNION ALL SELECT page_id, 1, regexp_replace(url, '://[^/?#:]+', '://www.news.com.au') FROM pages
           UNION ALL SELECT page_id, 2, regexp_replace(url, '://[^/?#:]+', '://shop.co.jp') FROM pages
           UNION ALL SELECT page_id, 3, regexp_replace(url, '://[^/?#:]+', '://10.20.30.40') FROM pages
           UNION ALL SELECT page_id, 4, regexp_replace(url, '://[^/?#:]+', '://co.uk') FROM pages
           UNION ALL SELECT page_id, 5, 'http://bad host/%zz' FROM pages
           UNION ALL SELECT page_id, 6, NULL FROM pages),
h AS (SELECT page_id, variant, CASE WHEN variant < 5 THEN lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) END AS host FROM v),
d AS (SELECT page_id, variant, host,
             CASE WHEN regexp_full_match(host, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN host
                  WHEN regexp_matches(host, '(^|[.])(ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)[.][a-z][a-z]$')
                  THEN coalesce(nullif(regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$', 0), ''), host)
                  ELSE coalesce(nullif(regexp_extract(host, '[^.]+[.][^.]+$', 0), ''), host) END AS domain FROM h)
SELECT page_id, variant, host, domain, split_part(domain, '.', 1) AS site FROM d"""
ORACLE["u6_crawl_timestamp_parse"] = """
SELECT event_id, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') AS crawl_ts FROM events"""
ORACLE["i1_mime_filter"] = r"""
WITH v AS (SELECT page_id, html, CAST(unnest(range(5)) AS INTEGER) AS variant FROM pages),
m AS (SELECT page_id, variant, CASE WHEN variant < 3 AND regexp_matches(lower(html), '^\s*<(!doctype html|html)\b') THEN 'text/html'
                                    WHEN variant = 4 AND regexp_matches(lower(html), '^\s*<!doctype html\b') THEN 'text/html' ELSE 'text/plain' END AS mime FROM v)
SELECT page_id, variant, mime FROM m WHERE mime IN ('text/html', 'application/xhtml+xml')"""
ORACLE["i2_index_url_dedup"] = """
WITH c AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS nf FROM pages),
s AS (SELECT *, regexp_replace(nf, '^[A-Za-z][A-Za-z0-9+.-]*://(www\\.)?', '') AS ns FROM c),
k AS (SELECT page_id, url,
             regexp_replace(lower(split_part(ns, '/', 1)) || regexp_replace(ns, '^[^/]*', ''), '/+$', '') AS canonical_url
      FROM s)
SELECT canonical_url, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM k GROUP BY canonical_url"""

# --- HTML extraction -------------------------------------------------------
from pressroom.operators.html import BLOCK, VOID  # noqa: E402

# the character references that occur in the tables
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _sql_list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _decode(col: str) -> str:
    s = col
    for ent, ch in ENTITIES:
        q = ch.replace("'", "''")
        s = f"replace({s}, '{ent}', '{q}')"
    return s


TOKENS = """
masked AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
           '(?s)<!--.*?-->', '', 'g'),
           '(?is)<script\\b[^>]*>.*?</script\\s*>', '<script></script>', 'g'),
           '(?is)<style\\b[^>]*>.*?</style\\s*>', '<style></style>', 'g') AS h
  FROM {src}),
toks AS (SELECT page_id, regexp_extract_all(h, '<[^>]*>|[^<]+') AS ts FROM masked),
tk0 AS (SELECT page_id, unnest(ts) AS tok, unnest(range(len(ts))) AS pos FROM toks),
tk AS (
  SELECT page_id, pos, tok, name,
         CASE WHEN starts_with(tok, '</') THEN 'close'
              WHEN regexp_matches(tok, '^<[A-Za-z]') AND (name IN """ + _sql_list(VOID) + """
                   OR regexp_matches(tok, '/\\s*>$')) THEN 'void'
              WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open'
              WHEN starts_with(tok, '<') THEN 'other' ELSE 'text' END AS kind,
         regexp_split_to_array(trim(regexp_extract(tok, '(?i)\\sclass\\s*=\\s*"([^"]*)"', 1)
                                    || regexp_extract(tok, '(?i)\\sclass\\s*=\\s*''([^'']*)''', 1)), '\\s+') AS cls
  FROM (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS name FROM tk0))"""

ORACLE["h1_token_counts"] = "WITH " + TOKENS.format(src="pages").strip() + """
SELECT page_id, count(*) AS n_tokens, count_if(kind = 'open') AS n_open, count_if(kind = 'close') AS n_close,
       count_if(kind = 'void') AS n_void, count_if(kind = 'text') AS n_text
FROM tk GROUP BY page_id"""

_PAGES = f"""
pg AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
         TIMESTAMP '{CFG.crawl_epoch}' + to_days(CAST(page_id AS INTEGER)) AS cc_date
  FROM pages WHERE NOT regexp_matches(url, '{{pattern}}')),
lb AS (SELECT *, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n FROM pg),
kk AS (SELECT *, CASE WHEN n > 2 AND regexp_matches(host, '[.](ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)[.][a-z][a-z]$')
                      THEN 2 ELSE 1 END AS k FROM lb),
pd AS (SELECT page_id, url, html, cc_date,
              CASE WHEN n >= 2 THEN array_to_string(labels[n - k:n], '.') ELSE host END AS domain FROM kk),
ps AS (SELECT *, split_part(domain, '.', 1) AS site FROM pd)"""

_EXTRACT = TOKENS.format(src="(SELECT * FROM ps WHERE site = 'example')") + """,
lv AS (
  SELECT *, CASE WHEN kind = 'open' THEN depth WHEN kind = 'close' THEN depth + 1 END AS lvl
  FROM (SELECT *, CASE WHEN kind IN ('open', 'close') THEN
                     sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END)
                       OVER (PARTITION BY page_id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  END AS depth
        FROM tk)),
rm AS (SELECT *, kind IN ('open', 'void') AND (name IN ('nav', 'footer')
                 OR (name = 'div' AND list_contains(cls, 'ad'))) AS rm FROM lv),
sp AS (
  SELECT *,
         CASE WHEN kind = 'open' AND lead(kind) OVER w = 'close' THEN lead(pos) OVER w END AS e,
         kind = 'close' AND coalesce(lag(kind) OVER w = 'open' AND lag(rm) OVER w, false) AS rm_end
  FROM rm WINDOW w AS (PARTITION BY page_id, name, lvl ORDER BY pos)),
cv AS (
  SELECT *, (sum(CASE WHEN rm AND kind = 'open' THEN 1 ELSE 0 END)
               OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - coalesce(sum(CASE WHEN rm_end THEN 1 ELSE 0 END)
               OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) > 0
            AS removed
  FROM sp),
bd AS (
  SELECT *, min({'p': pos, 'e': e}) FILTER (WHERE NOT removed AND kind = 'open' AND name = 'article')
              OVER (PARTITION BY page_id) AS b
  FROM cv),
pc AS (
  SELECT page_id, pos,
         CASE WHEN kind = 'text' THEN regexp_replace(""" + _decode("tok") + """, '[ \\t\\r\\n\\f]+', ' ', 'g')
              WHEN name = 'br' THEN chr(10)
              WHEN kind IN ('open', 'close', 'void') AND name IN """ + _sql_list(BLOCK) + """ THEN chr(10) || chr(10)
              ELSE '' END AS piece
  FROM bd WHERE NOT removed AND b IS NOT NULL AND pos >= b.p AND (b.e IS NULL OR pos <= b.e)),
bt AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           string_agg(piece, '' ORDER BY pos),
           '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'),
           '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') AS body
  FROM pc GROUP BY page_id),
ex AS (
  SELECT ps.page_id, ps.url, ps.domain, ps.site, ps.cc_date, bt.body,
         CASE WHEN ps.site NOT IN ('ac24', 'example', 'index', 'parlamentnilisty', 'telex') THEN 'unknown_site'
              WHEN coalesce(trim(bt.body), '') = '' THEN 'missing_article' END AS reason
  FROM ps LEFT JOIN bt USING (page_id))"""

ORACLE["h12_extract_articles"] = "WITH " + _PAGES.format(pattern=blocklist_pattern(BAD_URL_RULES)).strip() \
    + "," + _EXTRACT + """
SELECT sha256(url || '|' || CAST(cc_date AS VARCHAR)) AS uuid, nfc_normalize(body) AS article, domain, url,
       CAST(NULL AS TIMESTAMP) AS date_of_creation, cc_date, site
FROM ex WHERE reason IS NULL"""
ORACLE["k8_reject_reasons"] = "WITH " + _PAGES.format(pattern=blocklist_pattern(BINDING_URL_RULES)).strip() \
    + "," + _EXTRACT + """
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM ex GROUP BY 1"""

# --- language identification -------------------------------------------------
LANG_MODEL = """
lw AS (SELECT lang, unnest(regexp_extract_all(lower(replace(article, chr(10), ' ')), '\\pL+')) AS word
       FROM articles WHERE lang IS NOT NULL),
lcounts AS (SELECT lang, word, count(*) AS c FROM lw GROUP BY ALL),
lv AS (SELECT count(DISTINCT word) AS v FROM lcounts),
ln_ AS (SELECT count(*) AS n FROM articles WHERE lang IS NOT NULL),
ltotals AS (SELECT lang, sum(c) AS t FROM lcounts GROUP BY lang),
ldocs AS (SELECT lang, count(*) AS nd FROM articles WHERE lang IS NOT NULL GROUP BY lang),
langs AS (SELECT t.lang, t.t, CAST(round(ln(1.0 / (t.t + lv.v)) * 1000) AS BIGINT) AS unseen,
                 CAST(round(ln(d.nd / ln_.n) * 1000) AS BIGINT) AS prior
          FROM ltotals t JOIN ldocs d USING (lang) CROSS JOIN lv CROSS JOIN ln_),
profile AS (SELECT c.word, c.lang,
                   CAST(round(ln((c.c + 1.0) / (l.t + lv.v)) * 1000) AS BIGINT) - l.unseen AS gain
            FROM lcounts c JOIN langs l USING (lang) CROSS JOIN lv)"""


def lang_scores(src: str) -> str:
    return f"""
dw AS (SELECT uuid, unnest(regexp_extract_all(lower(replace(article, chr(10), ' ')), '\\pL+')) AS word FROM {src}),
pw AS (SELECT uuid, word, count(*) AS k FROM dw GROUP BY ALL),
nw AS (SELECT uuid, sum(k) AS n FROM pw GROUP BY uuid),
gains AS (SELECT uuid, lang, sum(k * gain) AS g FROM pw JOIN profile USING (word) GROUP BY ALL),
scores AS (SELECT nw.uuid, l.lang, nw.n * l.unseen + l.prior + coalesce(g.g, 0) AS score
           FROM nw CROSS JOIN langs l LEFT JOIN gains g ON g.uuid = nw.uuid AND g.lang = l.lang),
lid AS (SELECT uuid, lang AS language FROM (
          SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, lang) AS rn FROM scores)
        WHERE rn = 1)"""


ORACLE["c3_language_id"] = with_(ARTICLES, LANG_MODEL, lang_scores("articles")) + """
SELECT uuid, language FROM lid"""
ORACLE["c6_clean_pipeline"] = with_(ARTICLES, STATS, FILTERED, LANG_MODEL, lang_scores("filtered")) + """
SELECT f.uuid, f.site, f.lang FROM filtered f JOIN lid USING (uuid) WHERE lid.language IN ('fr', 'de')"""

# --- ROUGE -------------------------------------------------------------------
PAIRS = """
pairs AS (SELECT CAST(g.conv_id AS VARCHAR) || '_' || CAST(g.turn AS VARCHAR) AS uuid,
                 g.text AS generated, r.text AS article
          FROM conversations g JOIN conversations r ON r.conv_id = g.conv_id AND r.turn + 1 = g.turn)"""


def rouge_n_sql(n: int, tok_re: str = "[\\pL\\pN]+") -> str:
    def grams(col):
        t = f"regexp_extract_all(lower({col}), '{tok_re}')"
        if n == 1:
            return t
        return (f"CASE WHEN len({t}) >= {n} THEN list_transform(range(0, len({t}) - {n - 1}), "
                f"lambda i: array_to_string({t}[i + 1:i + {n}], ' ')) ELSE [] END")
    p = f"rouge{n}"
    return f""",
g AS (SELECT uuid, {grams('generated')} AS gp, {grams('article')} AS gr FROM pairs),
side AS (SELECT uuid, unnest(gp) AS gram, 1 AS p, 0 AS r FROM g
         UNION ALL SELECT uuid, unnest(gr) AS gram, 0 AS p, 1 AS r FROM g),
pg AS (SELECT uuid, gram, sum(p) AS cp, sum(r) AS cr FROM side GROUP BY ALL),
ov AS (SELECT uuid, sum(least(cp, cr)) AS overlap FROM pg GROUP BY uuid),
j AS (SELECT g.uuid, CAST(coalesce(ov.overlap, 0) AS DOUBLE) AS overlap, len(gp) AS n_pred, len(gr) AS n_ref
      FROM g LEFT JOIN ov USING (uuid)),
prf AS (SELECT uuid, overlap / greatest(n_pred, 1) AS p, overlap / greatest(n_ref, 1) AS r FROM j)
SELECT uuid, round(p, 6) AS {p}_precision, round(r, 6) AS {p}_recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS {p}_fmeasure
FROM prf"""


ORACLE["r1_prediction_pairs"] = with_(PAIRS) + " SELECT uuid, generated, article FROM pairs"
ORACLE["r2_rouge1_per_pair"] = with_(PAIRS) + rouge_n_sql(1)
ORACLE["r3_rouge2_per_pair"] = with_(PAIRS) + rouge_n_sql(2)
ORACLE["r3_rouge2_per_pair_ascii"] = with_(PAIRS) + rouge_n_sql(2, "[a-z0-9]+")


def _means(name: str, sql: str) -> str:
    cols = [f"{name}_precision", f"{name}_recall", f"{name}_fmeasure"]
    body = sql.replace("round(p, 6)", "p").replace("round(r, 6)", "r").replace(
        "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6)",
        "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END")
    return body, cols


_b1, _c1 = _means("rouge1", rouge_n_sql(1))
_b2, _c2 = _means("rouge2", rouge_n_sql(2))
ORACLE["r5_rouge_n_corpus"] = with_(PAIRS) + """,
s1 AS (""" + with_(PAIRS).replace("WITH", "WITH", 1) + _b1 + """),
s2 AS (""" + with_(PAIRS) + _b2 + """)
SELECT """ + ", ".join(f"round(avg(s1.{c}), 4) AS {c}" for c in _c1) + ", " + \
    ", ".join(f"round(avg(s2.{c}), 4) AS {c}" for c in _c2) + """
FROM s1 JOIN s2 USING (uuid)"""

# ROUGE-L: the dynamic programme row by row, one step per word of the generated text.  Row cell j is the
# longest common subsequence of the words so far and the first j words of the reference; it is the
# running maximum of the old row and, where the words match, the old row's cell to the left plus one.
ROUGE_L = """,
tok AS (SELECT uuid, regexp_extract_all(lower(generated), '[\\pL\\pN]+') AS gp,
               regexp_extract_all(lower(article), '[\\pL\\pN]+') AS gr FROM pairs),
dp AS (SELECT uuid, 0 AS i, list_transform(range(len(gr) + 1), lambda x: CAST(0 AS BIGINT)) AS row FROM tok
       UNION ALL
       SELECT c.uuid, c.i + 1, list(c.best ORDER BY c.j)
       FROM (SELECT x.uuid, x.i, x.j, max(x.cell) OVER (PARTITION BY x.uuid ORDER BY x.j) AS best
             FROM (SELECT d.uuid, d.i, unnest(range(len(t.gr) + 1)) AS j,
                          unnest(list_transform(range(len(t.gr) + 1), lambda k:
                            greatest(d.row[k + 1], CASE WHEN k > 0 AND t.gr[k] = t.gp[d.i + 1] THEN d.row[k] + 1 ELSE 0 END))) AS cell
                   FROM dp d JOIN tok t USING (uuid) WHERE d.i < len(t.gp)) x) c
       GROUP BY c.uuid, c.i),
l AS (SELECT d.uuid, d.row[len(d.row)] / greatest(len(t.gp), 1) AS p, d.row[len(d.row)] / greatest(len(t.gr), 1) AS r
      FROM dp d JOIN tok t USING (uuid) WHERE d.i = len(t.gp)),
lf AS (SELECT uuid, p AS rougeL_precision, r AS rougeL_recall,
              CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS rougeL_fmeasure FROM l)"""
_CL = ["rougeL_precision", "rougeL_recall", "rougeL_fmeasure"]
ORACLE["r4_rougeL_per_pair"] = with_(PAIRS).replace("WITH", "WITH RECURSIVE", 1) + ROUGE_L + """
SELECT uuid, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _CL) + " FROM lf"
ORACLE["r5_rouge_all_corpus"] = "WITH RECURSIVE" + with_(PAIRS).replace("WITH", "", 1) + ROUGE_L + """,
s1 AS (""" + with_(PAIRS) + _b1 + """),
s2 AS (""" + with_(PAIRS) + _b2 + """)
SELECT """ + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _c1 + _c2 + _CL) + """
FROM s1 JOIN s2 USING (uuid) JOIN lf USING (uuid)"""
# the same draws as numbers: the Poisson weight by its cumulative distribution
ORACLE["r5_bootstrap"] = "WITH RECURSIVE" + with_(PAIRS).replace("WITH", "", 1) + ROUGE_L + """,
s1 AS (""" + with_(PAIRS) + _b1 + """),
s2 AS (""" + with_(PAIRS) + _b2 + """),
u AS (SELECT *, CAST(('0x' || substr(md5(uuid || '|' || b || '|42'), 1, 7)) AS BIGINT) / 268435456.0 AS u
      FROM s1 JOIN s2 USING (uuid) JOIN lf USING (uuid) CROSS JOIN range(1, 1001) r(b)),
cdf AS (SELECT k, sum(exp(-1) / factorial(CAST(k AS INTEGER))) OVER (ORDER BY k) AS c FROM range(0, 10) t(k)),
w AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.c <= u.u) AS w FROM u),
m AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS score, b, sum({c} * w) / sum(w) AS mean FROM w GROUP BY b" for c in _c1 + _c2 + _CL) + """)
SELECT score, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.5), 4) AS mid,
       round(quantile_cont(mean, 0.975), 4) AS high FROM m GROUP BY score"""

# --- training examples -----------------------------------------------------------
_L = CFG.max_seq_len
EXAMPLES = """
examples AS (
  SELECT site || ' ' || article AS input, article, uuid
  FROM articles
  WHERE article IS NOT NULL AND uuid IS NOT NULL)"""
WORD_SQL = "regexp_extract_all(lower({c}), '[\\pL\\pN]+|[^\\pL\\pN\\s]')"
VOCAB = f"""
vw AS (SELECT unnest({WORD_SQL.format(c='article')}) AS word FROM examples),
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 4 AS INTEGER) AS id
          FROM (SELECT word, count(*) AS n FROM vw GROUP BY word))"""


def _enc(col: str, name: str) -> str:
    w = WORD_SQL.format(c=col)
    return f"""
{name}_t AS (SELECT uuid, unnest({w}) AS word, unnest(range(len({w}))) AS pos FROM examples),
{name}_s AS (SELECT t.uuid, list(CAST(coalesce(v.id, 1) AS INTEGER) ORDER BY t.pos) AS s
             FROM {name}_t t LEFT JOIN vocab v USING (word) WHERE t.pos < {_L - 2} GROUP BY t.uuid),
{name} AS (SELECT e.uuid, list_concat(list_concat([2], coalesce(s.s, []), [3]),
                        list_transform(range({_L} - 2 - len(coalesce(s.s, []))), lambda i: 0))::INTEGER[] AS ids
           FROM examples e LEFT JOIN {name}_s s USING (uuid))"""


ENCODED = _enc("input", "enc_in") + "," + _enc("article", "enc_out") + """,
encoded AS (
  SELECT i.uuid, i.ids AS input_ids,
         list_transform(i.ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)::INTEGER[] AS attention_mask,
         list_transform(o.ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)::INTEGER[] AS decoder_attention_mask,
         list_transform(o.ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)::INTEGER[] AS labels
  FROM enc_in i JOIN enc_out o USING (uuid))"""

ORACLE["e1_load_examples"] = with_(ARTICLES, STATS, FILTERED, EXAMPLES) + " SELECT input, article, uuid FROM examples"
ORACLE["e2_e6_encode_examples"] = with_(ARTICLES, STATS, FILTERED, EXAMPLES, VOCAB, ENCODED) + """
SELECT uuid, input_ids, attention_mask, decoder_attention_mask, labels FROM encoded"""
ORACLE["e7_e8_decode_labels"] = with_(ARTICLES, STATS, FILTERED, EXAMPLES, VOCAB, ENCODED) + """,
dl AS (SELECT uuid, unnest(labels) AS id, unnest(range(len(labels))) AS pos FROM encoded),
dw AS (SELECT d.uuid, string_agg(v.word, ' ' ORDER BY d.pos) AS txt
       FROM dl d LEFT JOIN vocab v USING (id) WHERE d.id >= 5 GROUP BY d.uuid)
SELECT e.uuid, coalesce(trim(dw.txt), '') AS generated FROM encoded e LEFT JOIN dw USING (uuid)"""

# --- files, streaming, dates -------------------------------------------------------
ORACLE["s2_k1_articles_jsonl_roundtrip"] = with_(ARTICLES) + """
SELECT uuid, article, domain, url, date_of_creation, cc_date, site FROM articles"""
ORACLE["st_streaming_extract"] = ORACLE["h12_extract_articles"]
ORACLE["t6_human_date_parse"] = """
SELECT event_id, layout, CASE WHEN layout = 'iso' THEN date_trunc('second', ts)
                              ELSE date_trunc('minute', ts) END AS parsed
FROM events CROSS JOIN (VALUES ('hu'), ('cs'), ('sk'), ('en'), ('iso'), ('numeric')) l(layout)"""
ORACLE["t6_relative_dates"] = """
WITH e AS (SELECT event_id, ts, 1 + event_id % 60 AS n FROM events),
units(unit, i) AS (VALUES ('second', INTERVAL 1 SECOND), ('minute', INTERVAL 1 MINUTE), ('hour', INTERVAL 1 HOUR),
    ('day', INTERVAL 1 DAY), ('week', INTERVAL 7 DAY), ('month', INTERVAL 1 MONTH), ('year', INTERVAL 12 MONTH)),
days(word, back) AS (VALUES ('ma', 0), ('dnes', 0), ('today', 0), ('tegnap', 1), ('včera', 1), ('yesterday', 1),
    ('tegnapelőtt', 2), ('předevčírem', 2), ('predvčerom', 2))
SELECT event_id, lang || ' ' || unit AS said, ts - n * i AS parsed
FROM e CROSS JOIN units CROSS JOIN (VALUES ('hu'), ('cs'), ('sk'), ('en')) l(lang)
UNION ALL SELECT event_id, word, ts - to_days(back) FROM e CROSS JOIN days
UNION ALL SELECT event_id, word || ' 07:45', date_trunc('day', ts - to_days(back)) + INTERVAL 465 MINUTE FROM e CROSS JOIN days
UNION ALL SELECT event_id, 'soon', NULL FROM e"""
ORACLE["t9_t12_iso_roundtrip"] = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_trunc('second', ts) AS back FROM events"""
ORACLE["k3_write_splits_roundtrip"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN, SIGS, LOSERS) + "," + split_sql(
    "(SELECT * FROM dedup_in WHERE uuid NOT IN (SELECT uuid FROM losers))").replace(
    "SELECT uuid, site, CASE", "SELECT split, site, count(*) AS n FROM (SELECT uuid, site, CASE").replace(
    "'test' END AS split, rank\nFROM ranked", "'test' END AS split FROM ranked) GROUP BY split, site")
ORACLE["k7_s8_encoded_roundtrip"] = ORACLE["e2_e6_encode_examples"]

ORACLE["d8_seeded_shuffle"] = with_(ARTICLES) + """
SELECT uuid, row_number() OVER (ORDER BY md5('123' || uuid), uuid) AS rank FROM articles"""

# --- learned sentence boundaries: every token next to the one after it ---------------------------
ABBREVIATED = r"""
abbreviated AS (SELECT uuid, regexp_replace(article, ' ([a-h])', ' Nr. č. 7. \1', 'g') AS article FROM articles),
tk AS MATERIALIZED (SELECT uuid, unnest(ts) AS token, unnest(ts[2:] || [NULL]) AS following
       FROM (SELECT uuid, regexp_extract_all(article, '[^\x20\x09-\x0D]+') AS ts FROM abbreviated)),
cores AS MATERIALIZED (SELECT uuid, token, following,
       lower(regexp_replace(regexp_replace(token, '^[^\pL\pN]+', ''), '[^\pL\pN.]+$', '')) AS core FROM tk),
counted AS (SELECT rtrim(core, '.') AS word, count(*) FILTER (regexp_matches(core, '[^.][.]$')) AS stops,
                   count(*) FILTER (NOT regexp_matches(core, '[^.][.]$')) AS others FROM cores GROUP BY ALL),
share AS (SELECT greatest(least(sum(stops) / sum(stops + others), 1 - 1e-9), 1e-9) AS p FROM counted),
abbr AS MATERIALIZED (SELECT word, stops, others,
       2 * (stops * (ln(0.99) - ln(p)) + others * (ln(1 - 0.99) - ln(1 - p))) * exp(-len(replace(word, '.', '')))
         * (1 + len(word) - len(replace(word, '.', ''))) * pow(CAST(len(replace(word, '.', '')) AS DOUBLE), -others) AS score
       FROM counted, share WHERE stops > 0 AND regexp_matches(word, '\pL') AND score >= 0.3
       ORDER BY score DESC, word"""

ORACLE["t4_abbreviations"] = with_(ARTICLES, ABBREVIATED + ")") + """
SELECT word, stops, others, round(score, 6) AS score FROM abbr"""
ORACLE["t4_c5_learned_sentences"] = with_(ARTICLES, ABBREVIATED + " LIMIT 5000)") + rf""",
judged AS (SELECT uuid, count_if(following IS NULL OR (regexp_matches(token, '[.!?]$') AND NOT (
             token LIKE '%.' AND ((regexp_matches(core, '[^.][.]$') AND (rtrim(core, '.') IN (SELECT word FROM abbr)
                                    OR regexp_matches(core, '^\pL[.]$')))
                                  OR (regexp_matches(core, '^\pN+[.]$') AND regexp_matches(following, '^\p{{Ll}}')))))) AS sentences
           FROM cores GROUP BY uuid)
SELECT uuid, sentences FROM judged WHERE sentences >= {CFG.min_article_sentences}"""

# --- trigrams: counts of the training two thirds, then sums over every article ----------------
TRIGRAMS = """
plain AS (SELECT uuid, lang, string_split(' ' || trim(regexp_replace(lower(article), '[^\\pL]+', ' ', 'g')) || ' ', '') AS cs FROM articles),
gr AS MATERIALIZED (SELECT uuid, lang, unnest(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2])) AS gram FROM plain),
third AS (SELECT uuid, CAST('0x' || substr(md5(uuid), 1, 8) AS BIGINT) % 3 = 1 AS held_out FROM articles),
cnt AS (SELECT gr.lang, gram, count(*) AS n FROM gr JOIN third USING (uuid) WHERE NOT held_out GROUP BY gr.lang, gram),
tot AS (SELECT lang, CAST(sum(n) + (SELECT count(DISTINCT gram) FROM cnt) AS DOUBLE) AS al FROM cnt GROUP BY lang),
model AS MATERIALIZED (SELECT cnt.lang, gram, CAST(round(ln((n + 1) / al) * 1000) AS BIGINT) - CAST(round(ln(1 / al) * 1000) AS BIGINT) AS gain
          FROM cnt JOIN tot USING (lang) QUALIFY row_number() OVER (PARTITION BY cnt.lang ORDER BY n DESC, gram) <= 20000),
gains AS (SELECT gr.uuid, model.lang, sum(gain) AS g FROM gr JOIN model USING (gram) GROUP BY ALL),
sizes AS (SELECT uuid, count(*) AS n FROM gr GROUP BY uuid),
scored AS (SELECT sizes.uuid, tot.lang, sizes.n * CAST(round(ln(1 / al) * 1000) AS BIGINT) + coalesce(g, 0) AS s
           FROM sizes CROSS JOIN tot LEFT JOIN gains ON gains.uuid = sizes.uuid AND gains.lang = tot.lang),
best_lang AS (SELECT uuid, lang AS language FROM scored QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY s DESC, lang) = 1)"""

ORACLE["c3_trigram_language"] = with_(ARTICLES, TRIGRAMS) + """
SELECT uuid, language, held_out, lang FROM articles JOIN third USING (uuid) LEFT JOIN best_lang USING (uuid)"""
ORACLE["c6_clean_stored_model"] = with_(ARTICLES, STATS, FILTERED, TRIGRAMS) + """
SELECT uuid, site, lang FROM filtered JOIN best_lang USING (uuid) WHERE language IN ('fr', 'de')"""

# --- crawl index: the second capture is the newest wanted one of its key ------------------
ORACLE["i1_i2_crawl_index"] = r"""
WITH c AS (SELECT page_id, url, lower(regexp_replace(url, '#.*$', '')) AS u, html FROM pages),
k AS (SELECT *, regexp_replace(regexp_extract(u, '^[a-z]+://([^/?:]+)', 1), '^www[0-9]*[.]', '') AS host, regexp_extract(u, '^[a-z]+://[^/?]*(.*)$', 1) AS path FROM c),
s AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
             CASE WHEN regexp_full_match(path, '/*') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS key FROM k),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id DESC) = 1)
SELECT key, TIMESTAMP '2021-07-24 02:00:00' AS captured, 'ftp://www.' || regexp_replace(url, '^https?://(www[.])?', '') AS url,
       'application/xhtml+xml' AS mime, 200 AS status, sha256(coalesce(html, '')) AS digest,
       CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS length, page_id AS "offset" FROM n"""

# --- public suffixes: every rule against the end of every host ------------------------------
ORACLE["u2_public_suffix_domain"] = r"""
WITH hosts AS (SELECT unnest(['', 'www.shop.co.jp', 'a.b.kawasaki.jp', 'x.city.kawasaki.jp', 'kawasaki.jp', 'www.ck', 'deep.www.ck', 'a.bar.ck', 'bar.ck',
               'me.blogs.example.org', 'unknown.tld', 'localhost', '10.20.30.40', 'co.uk', 'is.a.very.long.name']) AS other, unnest(range(15)) AS variant),
v AS (SELECT page_id, CAST(variant AS INTEGER) AS variant, CASE WHEN variant = 0 THEN lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) ELSE other END AS host
      FROM pages CROSS JOIN hosts UNION ALL SELECT page_id, 15, NULL FROM pages),
rules AS (SELECT unnest(['com', 'net', 'org', 'jp', 'co.jp', '[^.]+.kawasaki.jp', 'uk', 'co.uk', '[^.]+.ck', 'blogs.example.org', 'a.very.long.name']) AS r),
longest AS (SELECT host, max(len(string_split(replace(r, '[^.]+', 'x'), '.'))) AS k
            FROM (SELECT DISTINCT host FROM v) JOIN rules ON regexp_matches(host, '(^|[.])' || replace(replace(r, '[^.]+', '#'), '.', '[.]').replace('#', '[^.]+') || '$') GROUP BY host),
s AS (SELECT page_id, variant, v.host, string_split(v.host, '.') AS ls,
             CASE WHEN regexp_matches(v.host, '(^|[.])(city[.]kawasaki[.]jp)$') THEN 2 WHEN regexp_matches(v.host, '(^|[.])www[.]ck$') THEN 1
                  ELSE least(coalesce(k, 1), len(string_split(v.host, '.'))) END AS k
      FROM v LEFT JOIN longest ON longest.host = v.host),
d AS (SELECT page_id, variant, host, CASE WHEN host = '10.20.30.40' THEN NULL ELSE array_to_string(ls[-k:], '.') END AS suffix,
             CASE WHEN host = '10.20.30.40' OR len(ls) <= k THEN host ELSE array_to_string(ls[-(k + 1):], '.') END AS domain FROM s)
SELECT page_id, variant, host, suffix, domain, split_part(domain, '.', 1) AS site FROM d"""

# --- subword pieces: every piece that fits at a place of a word, the longest, then a walk over them ----
PIECE_WORDS = """flatten(list_transform(regexp_extract_all(lower({c}), '[\\pL\\pN]+|[^\\pL\\pN\\s]'),
  lambda w: list_transform(range(0, length(w), 100), lambda k: substr(w, CAST(k AS INTEGER) + 1, 100))))"""
PIECES = f"""
alphabet AS (SELECT b, CASE WHEN own THEN chr(b) ELSE chr(255 + CAST(sum(CASE WHEN own THEN 0 ELSE 1 END) OVER (ORDER BY b) AS INTEGER)) END AS c
             FROM (SELECT CAST(range AS INTEGER) AS b, range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range >= 174 AS own FROM range(256))),
file AS (SELECT unnest(map_entries(CAST(json_extract(content, '$.model.vocab') AS MAP(VARCHAR, INTEGER)))) AS e
         FROM read_text('{public_tokenizers.path("word_bpe_49k.json")}')),
marked AS (SELECT e.value AS id, e.key LIKE '%_</w>' AS ends, string_split(regexp_replace(e.key, '(.)</w>$', '\\1'), '') AS cs FROM file),
spelt AS (SELECT id, ends, unnest(cs) AS c, unnest(range(len(cs))) AS k FROM marked),
pieces AS MATERIALIZED (SELECT id, ends, string_agg(printf('%02X', b), '' ORDER BY k) AS hx FROM spelt JOIN alphabet USING (c) GROUP BY id, ends),
wordlists AS MATERIALIZED (SELECT uuid, {PIECE_WORDS.format(c="article")} AS ws, {PIECE_WORDS.format(c="string_split(input, ' ')[1]")} AS head FROM examples),
dist AS MATERIALIZED (SELECT word, hex(encode(word)) AS hx FROM (SELECT unnest(ws) AS word FROM wordlists UNION SELECT unnest(head) FROM wordlists)),
starts AS (SELECT word, hx, length(hx) // 2 AS n, unnest(range(length(hx) // 2)) AS i FROM dist),
subs AS (SELECT word, n, i, substr(hx, 2 * i + 1, 2 * size) AS sub, size, i + size = n AS ends
         FROM (SELECT *, unnest(range(1, 65)) AS size FROM starts) WHERE i + size <= n),
best AS MATERIALIZED (SELECT word, i, max(size) AS size, arg_max(id, size) AS id, any_value(n) AS n
         FROM subs JOIN pieces ON pieces.hx = subs.sub AND pieces.ends = subs.ends GROUP BY word, i),
walk AS (SELECT word, 0 AS i, CAST([] AS INTEGER[]) AS ids FROM dist
         UNION ALL SELECT w.word, w.i + b.size, list_append(w.ids, b.id) FROM walk w JOIN best b ON b.word = w.word AND b.i = w.i),
cut AS MATERIALIZED (SELECT word, arg_max(ids, i) AS ids FROM walk GROUP BY word),
toks AS (SELECT uuid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM wordlists),
seqs AS (SELECT uuid, flatten(list(ids ORDER BY pos)) AS ids FROM toks JOIN cut USING (word) GROUP BY uuid),
rowids AS (SELECT uuid, ws, coalesce(ids, []) AS ids FROM wordlists LEFT JOIN seqs USING (uuid))"""
_SUBWORD = with_(ARTICLES, STATS, EXAMPLES, PIECES).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["e2_e8_subword_ids"] = _SUBWORD + """
SELECT uuid, CAST(len(ids) AS BIGINT) AS n_pieces, sha256(array_to_string(ids, ' ')) AS ids_sha256,
       sha256(array_to_string(ws, ' ')) AS decoded_sha256 FROM rowids"""
# the input is the site, a blank and the article; the fixed ids are those of the file's special tokens and the next
ORACLE["e2_e6_subword_examples"] = _SUBWORD + """,
heads AS (SELECT uuid, flatten(list(ids ORDER BY pos)) AS head
          FROM (SELECT uuid, unnest(head) AS word, unnest(range(len(head))) AS pos FROM wordlists) JOIN cut USING (word) GROUP BY uuid),
full_ AS (SELECT uuid, [49406] || list_slice(coalesce(head, []) || ids, 1, 510) || [49407] AS a, [49406] || list_slice(ids, 1, 510) || [49407] AS b
          FROM rowids LEFT JOIN heads USING (uuid))
SELECT uuid, list_resize(a, 512, 49408) AS input_ids, list_resize(list_transform(a, lambda x: 1), 512, 0) AS attention_mask,
       list_resize(list_transform(b, lambda x: 1), 512, 0) AS decoder_attention_mask, list_resize(b, 512, -100) AS labels FROM full_"""

# D5 option: candidate pairs (shared band) verified by exact Jaccard of the byte-shingle sets
ORACLE["d5_losers_exact_jaccard"] = with_(ARTICLES, STATS, FILTERED, DEDUP_IN, SIGS) + f""",
pairs AS (SELECT DISTINCT x.uuid AS ux, y.uuid AS uy
          FROM bands x JOIN bands y ON x.band = y.band AND x.bkey = y.bkey AND x.uuid <> y.uuid),
sset AS (SELECT DISTINCT uuid, g FROM sh),
ssize AS (SELECT uuid, count(*) AS n FROM sset GROUP BY uuid),
inter AS (SELECT p.ux, p.uy, count(*) AS i
          FROM pairs p JOIN sset a ON a.uuid = p.ux JOIN sset b ON b.uuid = p.uy AND b.g = a.g
          GROUP BY p.ux, p.uy),
newer AS (SELECT p.ux, p.uy FROM pairs p JOIN dedup_in mx ON mx.uuid = p.ux JOIN dedup_in my ON my.uuid = p.uy
          WHERE my.cc_date > mx.cc_date OR (my.cc_date = mx.cc_date AND my.uuid > mx.uuid))
SELECT DISTINCT n.ux AS uuid
FROM newer n JOIN inter USING (ux, uy) JOIN ssize sx ON sx.uuid = n.ux JOIN ssize sy ON sy.uuid = n.uy
WHERE CAST(inter.i AS DECIMAL(18, 6)) >= CAST({CFG.min_jaccard} AS DECIMAL(10, 6)) * (sx.n + sy.n - inter.i)
UNION
SELECT x.uuid FROM dedup_in x JOIN dedup_in y ON x.article = y.article
WHERE y.cc_date > x.cc_date OR (y.cc_date = x.cc_date AND y.uuid > x.uuid)"""


# --- every page's whole article in every layout: the layouts' own text around it ------
_BREAK = "chr(10) || chr(10)"
_WHOLE = r"""
WITH ar AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)</article>') THEN regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1)
                                 ELSE regexp_extract(html, '(?is)<article\b[^>]*>(.*?)(?:<footer|\z)', 1) END AS h FROM pages),
tx AS (SELECT page_id, """ + _decode(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(h, ''),
         '(?s)<!--.*?-->', '', 'g'), '[ \t\r\n\f]+', ' ', 'g'), '(?i)<br\b[^>]*>', chr(10), 'g'),
         '(?i)</?(""" + "|".join(sorted(BLOCK)) + r""")\b[^>]*>', """ + _BREAK + r""", 'g'), '</?[A-Za-z][^>]*>', '', 'g')""") + f""" AS para FROM ar),
x AS (SELECT page_id * 10 + k AS page_id, k,
             CASE WHEN k < 2 THEN 'telex' WHEN k IN (2, 3, 9) THEN 'index' WHEN k IN (4, 5, 7) THEN 'ac24'
                  WHEN k = 6 THEN 'parlamentnilisty' ELSE 'nowhere' END AS site,
             CASE k WHEN 0 THEN para || {_BREAK} || 'and more' WHEN 2 THEN para WHEN 3 THEN para || {_BREAK} || 'line'
                    WHEN 4 THEN para || {_BREAK} || 'end' WHEN 5 THEN '1 < 2' || {_BREAK} || para
                    WHEN 6 THEN 'a b' || {_BREAK} || para END AS raw,
             CASE k WHEN 0 THEN TIMESTAMP '2021-07-24 10:32:00' WHEN 2 THEN TIMESTAMP '2021-07-25 08:15:00'
                    WHEN 3 THEN TIMESTAMP '2021-07-26 12:00:00' WHEN 4 THEN TIMESTAMP '2021-07-24 14:05:00'
                    WHEN 5 THEN TIMESTAMP '2021-07-25 09:30:00' WHEN 6 THEN TIMESTAMP '2021-07-25 09:30:00' END AS written,
             CASE k WHEN 1 THEN 'invalid_page' WHEN 9 THEN 'invalid_page' WHEN 7 THEN 'missing_article' WHEN 8 THEN 'unknown_site' END AS known
      FROM tx CROSS JOIN range(10) l(k)),
y AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[ \\t]*\\n[ \\t]*', chr(10), 'g'),
             '\\n{{3,}}', {_BREAK}, 'g'), ' {{2,}}', ' ', 'g'), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') AS article FROM x),
z AS (SELECT *, coalesce(known, CASE WHEN article = '' THEN 'missing_article' END) AS reason FROM y)"""
ORACLE["h2_h12_site_layouts_whole"] = _WHOLE + """
SELECT page_id, site, CASE site WHEN 'telex' THEN 'telex.hu' WHEN 'index' THEN 'index.hu' WHEN 'nowhere' THEN 'nowhere.org'
                                ELSE site || '.cz' END AS domain,
       CASE WHEN reason IS NULL THEN nfc_normalize(article) END AS article,
       CASE WHEN reason IS NULL THEN written END AS date_of_creation, reason AS reject_reason FROM z"""
ORACLE["k8_reject_log_layouts_whole"] = _WHOLE + """
SELECT page_id, 'https://' || ['telex.hu/belfold/2021/07/24/', 'telex.hu/kulfold/', 'index.hu/gazdasag/', 'index.hu/sport/',
         'www.ac24.cz/zpravy/', 'www.ac24.cz/clanek/', 'www.parlamentnilisty.cz/arena/', 'www.ac24.cz/prazdny/', 'www.nowhere.org/',
         'index.hu/belfold/'][k + 1] || page_id AS url, site, reason AS reject_reason
FROM z WHERE reason IS NOT NULL"""

# --- round trips: what went in -------------------------------------------------------
ORACLE["s1_u4_u5_warc_roundtrip"] = r"""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html || 'é', '[^\x{00}-\x{ff}]', '?', 'g') ELSE html || 'é' END AS h FROM pages)
SELECT url, TIMESTAMP '2021-07-24 10:32:00' + to_seconds(page_id) AS cc_date, sha256(h) AS html_sha FROM p"""
ORACLE["s1_warc_member_index"] = ORACLE["s1_u4_u5_warc_roundtrip"]
ORACLE["k1_append_repeated_ids"] = with_(ARTICLES) + " SELECT uuid, article, site FROM articles"
ORACLE["k1_append_by_year"] = ORACLE["k1_append_repeated_ids"]
ORACLE["k2_overwrite_by_site"] = with_(ARTICLES) + """,
anew AS (SELECT uuid, 'again' AS url, site FROM articles WHERE CAST(uuid AS BIGINT) % 2 = 0 AND site < 'n')
SELECT uuid, url, site FROM anew
UNION ALL SELECT uuid, url, site FROM articles WHERE site NOT IN (SELECT site FROM anew)"""
ORACLE["k4_stats_csv_roundtrip"] = ORACLE["g1_describe_length_raw"]
ORACLE["k5_metrics_json_roundtrip"] = ORACLE["r5_rouge_all_corpus"]
ORACLE["k6_s5_predictions_roundtrip"] = ORACLE["r1_prediction_pairs"]
ORACLE["s7_site_by_url_prefix"] = """
WITH l AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://(www[.])?([^/?#]+)', 2)) AS site,
                           rtrim(lower(regexp_extract(url, '^[a-z]+://(www[.])?([^/?#]+/[^/?#]*)', 2)), '/') AS prefix
           FROM pages WHERE page_id % 3 = 0),
b AS (SELECT p.page_id, arg_max(l.site, len(l.prefix)) AS listed_site
      FROM pages p JOIN l ON l.prefix <> '' AND starts_with(
        regexp_replace(regexp_replace(lower(p.url), '^[a-z]+://(www[.])?', ''), '[?#].*$', '') || '/', l.prefix || '/')
      GROUP BY p.page_id)
SELECT p.page_id, b.listed_site FROM pages p LEFT JOIN b USING (page_id)"""
