"""Registered queries over the driver's tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, rules, text
from tidewire.operators import dedupe, deals as deal_ops, entities, rollups, serve, wire
from tidewire.plans import views
from tidewire.plans.views import with_views
from tidewire.storage import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOTAL = "CAST(coalesce(sum(CAST(amount_m AS DECIMAL(18,6))), 0) AS DOUBLE)"
HALF_UP = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"
STAMP = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def r6(c):
    return F.round(c, 6)


# ---- companies and periods ----


@query(
    with_views("rounds")
    + f""", t AS (SELECT slug, {TOTAL} AS total_m, count(*) AS rounds FROM rounds GROUP BY slug),
    n AS (SELECT slug, published_at AS latest_at, CAST(link AS VARCHAR) AS latest_link, stage, row_number() OVER (PARTITION BY slug ORDER BY published_at DESC, CAST(link AS VARCHAR) DESC) AS r FROM rounds)
    SELECT t.slug, total_m, rounds, {STAMP('latest_at')} AS latest_at, latest_link, stage FROM t JOIN n ON t.slug = n.slug AND r = 1 ORDER BY total_m DESC, rounds DESC, t.slug LIMIT 250"""
)
def funded_companies(spark, d):
    return rollups.rank_companies(rollups.company_totals(views.rounds(spark, d))).withColumn("latest_at", stamp("latest_at"))


@query(with_views("rounds") + f", t AS (SELECT slug, {TOTAL} AS total_m, count(*) AS rounds FROM rounds GROUP BY slug) SELECT CAST(sum(CAST(total_m AS DECIMAL(18,6))) AS DOUBLE) AS total_m, CAST(sum(rounds) AS BIGINT) AS rounds, count(*) AS companies, count(*) FILTER (WHERE rounds > 1) AS repeat_companies FROM t")
def ranking_summary(spark, d):
    return rollups.ranking_summary(rollups.company_totals(views.rounds(spark, d)))


def _period(grain: str, key: str):
    sql = with_views("rounds") + f" SELECT {key} AS period, count(*) AS rounds, {TOTAL} AS total_m, round(quantile_cont(amount_m, 0.5), 6) AS median_m, max(amount_m) AS largest_m FROM rounds GROUP BY 1 HAVING count(*) >= 3"

    @query(sql, f"rounds_by_{grain}")
    def run(spark, d):
        return rollups.period_rollup(views.rounds(spark, d), grain, least=3).withColumn("median_m", r6("median_m"))


_period("month", "strftime(published_at, '%Y-%m')")
_period("quarter", "concat(year(published_at), '-q', quarter(published_at))")
_period("year", "CAST(year(published_at) AS VARCHAR)")


@query(
    with_views("rounds")
    + f""", p AS (SELECT strftime(published_at, '%Y-%m') AS period, count(*) AS rounds, {TOTAL} AS total_m FROM rounds GROUP BY 1)
    SELECT period, rounds, total_m, lag(period) OVER w AS previous, lead(period) OVER w AS next, CASE WHEN lag(total_m) OVER w > 0 THEN {HALF_UP('(total_m - lag(total_m) OVER w) / (lag(total_m) OVER w) * 100')} END AS total_pct, rounds - lag(rounds) OVER w AS rounds_diff FROM p WINDOW w AS (ORDER BY period)"""
)
def period_delta(spark, d):
    return rollups.period_change(rollups.period_rollup(views.rounds(spark, d), "month"))


_BAND = "CASE WHEN amount_m < 10 THEN 0 WHEN amount_m < 50 THEN 1 WHEN amount_m < 100 THEN 2 ELSE 3 END"


@query(
    with_views("rounds")
    + f""", b AS (SELECT {_BAND} AS ord, count(*) AS rounds, {TOTAL} AS total_m FROM rounds WHERE amount_m >= 0 GROUP BY 1)
    SELECT ord, ['Under $10M', '$10M to $50M', '$50M to $100M', '$100M and above'][ord + 1] AS band, rounds, total_m, {HALF_UP('rounds * 100 / sum(rounds) OVER ()')} AS rounds_pct, {HALF_UP('total_m * 100 / sum(total_m) OVER ()')} AS total_pct FROM b"""
)
def size_bands(spark, d):
    return rollups.size_bands(views.rounds(spark, d))


@query(with_views("rounds") + f" SELECT stage, count(*) AS rounds, round(quantile_cont(amount_m, 0.5), 6) AS median_m, {TOTAL} AS total_m, round({TOTAL} / count(*), 6) AS mean_m FROM rounds WHERE stage <> '' GROUP BY stage HAVING count(*) >= 8")
def stage_ladder(spark, d):
    out = rollups.stage_ladder(views.rounds(spark, d))
    return out.withColumn("median_m", r6("median_m")).withColumn("mean_m", r6("mean_m"))


@query(
    with_views("rounds")
    + f""", o AS (SELECT count(*) AS n, count(*) FILTER (WHERE slug <> '') AS company, count(*) FILTER (WHERE stage <> '') AS stage, count(*) FILTER (WHERE lead <> '') AS lead, count(*) FILTER (WHERE currency <> 'USD') AS converted FROM rounds)
    SELECT field, filled, n, {HALF_UP('filled * 100 / n')} AS pct FROM (SELECT n, unnest(['company', 'stage', 'lead', 'converted']) AS field, unnest([company, stage, lead, converted]) AS filled FROM o)"""
)
def field_coverage(spark, d):
    return rollups.field_coverage(views.rounds(spark, d))


@query(
    with_views("rounds")
    + f""", s AS (SELECT year(published_at) AS y, amount_m FROM rounds WHERE strftime(published_at, '%m-%d') <= '06-15' AND year(published_at) IN (1999, 2000)),
    a AS (SELECT y, count(*) AS rounds, {TOTAL} AS total_m FROM s GROUP BY y), n AS (SELECT * FROM a WHERE y = 2000), w AS (SELECT * FROM a WHERE y = 1999)
    SELECT n.rounds AS rounds_now, w.rounds AS rounds_was, n.total_m AS total_m_now, w.total_m AS total_m_was, {HALF_UP('(n.rounds - w.rounds) / w.rounds * 100')} AS rounds_pct, {HALF_UP('(n.total_m - w.total_m) / w.total_m * 100')} AS total_m_pct FROM n, w WHERE n.rounds >= 12 AND w.rounds >= 12"""
)
def ytd_compare(spark, d):
    return rollups.ytd_compare(views.rounds(spark, d), "2000-06-15")


@query(with_views("rounds") + f" SELECT count(*) AS rounds, {TOTAL} AS total_m, round(quantile_cont(amount_m, 0.5), 6) AS median_m, max(amount_m) AS largest_m, (SELECT CAST(link AS VARCHAR) FROM rounds ORDER BY amount_m DESC, CAST(link AS VARCHAR) DESC LIMIT 1) AS largest_link FROM rounds")
def funding_summary(spark, d):
    return rollups.funding_summary(views.rounds(spark, d)).withColumn("median_m", r6("median_m"))


@query(
    with_views("rounds")
    + f""", m AS (SELECT strftime(published_at, '%Y-%m') AS period, count(*) AS rounds, {TOTAL} AS total_m FROM rounds GROUP BY 1),
    s AS (SELECT strftime(unnest(generate_series((SELECT date_trunc('month', min(published_at)) FROM rounds), (SELECT date_trunc('month', max(published_at)) FROM rounds), INTERVAL 1 MONTH)), '%Y-%m') AS period)
    SELECT s.period, coalesce(rounds, 0) AS rounds, coalesce(total_m, 0.0) AS total_m FROM s LEFT JOIN m ON s.period = m.period"""
)
def calendar_spine(spark, d):
    return rollups.calendar_spine(views.rounds(spark, d))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, concat(year(o_orderdate), '-q', quarter(o_orderdate)) AS quarter, strftime(o_orderdate, '%B %Y') AS month_label, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, concat('Q', quarter(o_orderdate), ' ', year(o_orderdate)) AS quarter_label, date_trunc('month', o_orderdate) = TIMESTAMP '1998-08-01' AS open FROM orders")
def period_labels(spark, d):
    ts = F.col("o_orderdate")
    m, q = dates.month_key(ts), dates.quarter_key(ts)
    return table(spark, d, "orders").select(m.alias("month"), q.alias("quarter")).distinct().select("month", "quarter", dates.period_label(F.col("month")).alias("month_label"), dates.period_start(F.col("month")).cast("string").alias("month_start"), dates.period_label(F.col("quarter")).alias("quarter_label"), dates.is_open(F.col("month"), F.lit("1998-08-15").cast("timestamp")).alias("open"))


# ---- markets, sectors, topics ----

_GROUP = """, per AS (SELECT slug, count(*) AS r, sum(CAST(amount_m AS DECIMAL(18,6))) AS t, max(amount_m) AS m FROM rounds GROUP BY slug),
    mo AS (SELECT {g}, count(*) AS companies, CAST(coalesce(sum(r), 0) AS BIGINT) AS rounds, CAST(coalesce(sum(t), 0) AS DOUBLE) AS total_m, max(m) AS largest_m FROM companies LEFT JOIN per USING (slug) GROUP BY {g}),
    st AS (SELECT {g}, count(DISTINCT link) AS stories FROM companies JOIN stories USING (slug) GROUP BY {g})
    SELECT {g}, companies, coalesce(stories, 0) AS stories, rounds, total_m, largest_m FROM mo LEFT JOIN st USING ({g}) WHERE companies >= 5 AND coalesce(stories, 0) >= 12"""


@query(with_views("rounds", "companies", "stories") + _GROUP.format(g="market"))
def market_rollup(spark, d):
    return rollups.group_rollup(views.companies(spark, d), views.stories(spark, d), views.rounds(spark, d), "market", 5, 12)


@query(with_views("rounds", "companies", "stories") + _GROUP.format(g="kind"))
def sector_rollup(spark, d):
    return rollups.group_rollup(views.companies(spark, d), views.stories(spark, d), views.rounds(spark, d), "kind", 5, 12)


@query(with_views("companies") + " SELECT market, kind, n, r AS rank FROM (SELECT market, kind, count(*) AS n, CAST(row_number() OVER (PARTITION BY market ORDER BY count(*) DESC, kind) AS INTEGER) AS r FROM companies GROUP BY market, kind) WHERE r <= 3")
def kind_mix(spark, d):
    return rollups.mix(views.companies(spark, d), "market", "kind")


@query(with_views("companies") + " SELECT kind, market, count(*) AS companies FROM companies GROUP BY kind, market")
def sector_by_market(spark, d):
    return views.companies(spark, d).groupBy("kind", "market").agg(F.count(F.lit(1)).alias("companies"))


@query(f"SELECT event_type AS tag, count(DISTINCT event_id) AS stories, count(DISTINCT user_id) AS outlets, {STAMP('min(ts)')} AS first_at, {STAMP('max(ts)')} AS last_at FROM events GROUP BY event_type")
def topic_rollup(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("link"), F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("published_at"))
    return rollups.label_rollup(e).withColumns({"first_at": stamp("first_at"), "last_at": stamp("last_at")})


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1")
def daily_totals(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), rollups.total(F.col("value")).alias("total"))


_CO = """SELECT item, other, n, r AS rank FROM (SELECT a.item, b.item AS other, count(*) AS n, CAST(row_number() OVER (PARTITION BY a.item ORDER BY count(*) DESC, b.item) AS INTEGER) AS r FROM x a JOIN x b ON a.k = b.k AND a.item <> b.item GROUP BY a.item, b.item) WHERE r <= {n}"""


@query("WITH x AS (SELECT DISTINCT l_orderkey AS k, concat(l_returnflag, l_linestatus) AS item FROM lineitem) " + _CO.format(n=6))
def tag_cooccurrence(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("tag"))
    return rollups.co_occurrence(li, "tag", "l_orderkey", 6)


@query("WITH x AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS item FROM lineitem) " + _CO.format(n=8))
def company_related(spark, d):
    return entities.related(views.mentions(spark, d))


@query("SELECT slug, tag, n, r AS rank FROM (SELECT l_suppkey AS slug, p_brand AS tag, count(DISTINCT l_orderkey) AS n, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY count(DISTINCT l_orderkey) DESC, p_brand) AS INTEGER) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r <= 6")
def company_topics(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("tag"))
    named = views.mentions(spark, d).join(p, "part").select("slug", "link", "tag").distinct()
    counts = named.groupBy("slug", "tag").agg(F.count(F.lit(1)).alias("n"))
    return rollups.top_per_group(counts, ["slug"], [F.col("n").desc(), F.col("tag")], 6)


@query(with_views("rounds") + f" SELECT slug, link, {STAMP('published_at')} AS published_at, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY slug ORDER BY published_at DESC, link) AS INTEGER) AS r FROM rounds) WHERE r <= 3")
def latest_per_company(spark, d):
    return rollups.top_per_group(views.rounds(spark, d), ["slug"], [F.col("published_at").desc(), F.col("link")], 3).select("slug", "link", stamp("published_at"), "rank")


@query(with_views("rounds") + " SELECT period, link, amount_m, r AS rank FROM (SELECT CAST(year(published_at) AS VARCHAR) AS period, link, amount_m, CAST(row_number() OVER (PARTITION BY year(published_at) ORDER BY amount_m DESC, link) AS INTEGER) AS r FROM rounds) WHERE r <= 10")
def largest_per_period(spark, d):
    keyed = views.rounds(spark, d).withColumn("period", dates.year_key(F.col("published_at")))
    return rollups.top_per_group(keyed, ["period"], [F.col("amount_m").desc(), F.col("link")], 10).select("period", "link", "amount_m", "rank")


# ---- deals ----


@query(with_views("deals") + f" SELECT count(*) AS deals, count(DISTINCT acquirer) AS acquirers, count(amount_m) AS priced, {TOTAL} AS disclosed_m FROM deals")
def ma_summary(spark, d):
    return rollups.ma_summary(views.deals(spark, d))


@query(with_views("deals") + f" SELECT strftime(published_at, '%Y-%m') AS period, count(*) AS deals, count(amount_m) AS priced, {TOTAL} AS disclosed_m FROM deals GROUP BY 1")
def ma_months(spark, d):
    return rollups.ma_months(views.deals(spark, d))


@query(with_views("deals") + f", s AS (SELECT acquirer AS party, 'acquirer' AS side, amount_m FROM deals UNION ALL SELECT target, 'target', amount_m FROM deals) SELECT party, side, count(*) AS deals, count(amount_m) AS priced, {TOTAL} AS disclosed_m FROM s GROUP BY party, side")
def company_deals(spark, d):
    return rollups.deal_sides(views.deals(spark, d)).groupBy("party", "side").agg(F.count(F.lit(1)).alias("deals"), F.count("amount_m").alias("priced"), rollups.total(F.col("amount_m")).alias("disclosed_m"))


@query(with_views("deals") + " SELECT strftime(published_at, '%Y-%m-%d') AS date, acquirer, '' AS acquirer_slug, target, lower(target) AS target_slug, '''=Holdings' AS seller, 'Acquisition' AS type, CASE WHEN amount_m > 0 THEN floor(amount_m * 1000 + 0.5) / 1000 END AS amount_usd_m, CASE WHEN amount_m > 0 THEN 'USD' END AS currency, CASE WHEN amount_m > 0 THEN 'yes' ELSE 'no' END AS price_disclosed, concat(acquirer, ' acquires ', target) AS headline, source, CAST(link AS VARCHAR) AS url, concat(source, '; Other') AS also_reported_by FROM deals")
def ma_export(spark, d):
    full = views.deals(spark, d).select("*", F.lit(None).cast("string").alias("acquirer_slug"), F.lower("target").alias("target_slug"), F.lit("=Holdings").alias("seller"), F.lit("Acquisition").alias("type"), F.lit("USD").alias("currency"), F.concat_ws(" acquires ", "acquirer", "target").alias("title"), F.array(F.col("source"), F.lit("Other")).alias("also_reported_by"))
    return serve.deals_export(full)


def _export(spark, d):
    return serve.rounds_export(views.rounds(spark, d).select("*", F.concat(F.lit("=Co "), F.col("slug")).alias("company"), F.col("amount_m").alias("native_m"), F.concat(F.lit("+"), F.col("stage")).alias("title")))


@query(with_views("rounds") + " SELECT strftime(published_at, '%Y-%m-%d') AS date, concat('''=Co ', slug) AS company, slug AS company_slug, floor(amount_m * 1000 + 0.5) / 1000 AS amount_usd_m, floor(amount_m * 1000 + 0.5) / 1000 AS amount_native_m, currency, stage, lead AS lead_investor, concat('''+', stage) AS headline, source, CAST(link AS VARCHAR) AS url FROM rounds")
def round_export(spark, d):
    return _export(spark, d)


@query(with_views("rounds") + " SELECT count(*) AS count, count(*) FILTER (WHERE amount_m >= 0.0005) AS priced, CAST(sum(CAST(floor(amount_m * 1000 + 0.5) / 1000 AS DECIMAL(18,3))) AS DOUBLE) AS disclosed_usd_m, strftime(min(published_at), '%Y-%m-%d') AS from_date, strftime(max(published_at), '%Y-%m-%d') AS to_date FROM rounds")
def export_metadata(spark, d):
    return serve.export_metadata(_export(spark, d))


@query(with_views("rounds") + " SELECT link, concat(slug, '-', CAST(floor(amount_m * 10 + 0.5) AS BIGINT), '-', strftime(published_at, '%Y-%m')) AS guid FROM rounds ORDER BY published_at DESC, link LIMIT 40")
def funding_feed(spark, d):
    return serve.funding_feed(views.rounds(spark, d).select("*", F.col("slug").alias("company"), F.lit("").alias("subject"))).select("link", "guid")


@query(with_views("deals") + " SELECT link, concat(lower(acquirer), '-', lower(target)) AS guid FROM deals ORDER BY published_at DESC, link LIMIT 30")
def deal_feed(spark, d):
    return serve.deal_feed(views.deals(spark, d)).select("link", "guid")


# ---- gates and totals ----


@query(
    "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS slug, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 15 AS covered, c_acctbal > 9000 AS funded, c_mktsegment = 'BUILDING' AND c_acctbal < 0 AS profiled, c_custkey % 50 = 0 AS dealt FROM customer), "
    "k AS (SELECT *, CAST(covered AS INT) + CAST(funded AS INT) + CAST(profiled AS INT) + CAST(dealt AS INT) AS doors FROM c) "
    "SELECT count(*) FILTER (WHERE doors > 0) AS pages, count(*) FILTER (WHERE covered AND doors = 1) AS only_covered, count(*) FILTER (WHERE funded AND doors = 1) AS only_funded, count(*) FILTER (WHERE profiled AND doors = 1) AS only_profiled, count(*) FILTER (WHERE dealt AND doors = 1) AS only_dealt FROM k"
)
def page_gate(spark, d):
    c = table(spark, d, "customer").withColumn("slug", F.col("c_custkey").cast("string"))
    told = views.stories(spark, d).groupBy("slug").agg(F.count(F.lit(1)).alias("stories"))
    all_ = c.select("slug").join(told, "slug", "left").withColumn("stories", F.coalesce("stories", F.lit(0)))
    return rollups.gate_accounting(rollups.page_gate(all_, c.where("c_acctbal > 9000"), c.where("c_mktsegment = 'BUILDING' and c_acctbal < 0"), c.where("c_custkey % 50 = 0"), 15))


@query("SELECT (SELECT count(*) FROM orders) AS stories, (SELECT count(*) FROM customer) AS companies, (SELECT CAST(sum(CAST(o_totalprice / 1000 AS DECIMAL(18,6))) AS DOUBLE) FROM orders) AS total_m, (SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders) AS since")
def site_totals(spark, d):
    money = views.rounds(spark, d).agg(F.count(F.lit(1)).alias("stories"), rollups.total(F.col("amount_m")).alias("total_m"), F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("since"))
    return money.join(F.broadcast(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("companies"))), F.lit(True)).select("stories", "companies", "total_m", "since")


@query("SELECT concat('/company/', c_custkey, '/') AS url, 'company' AS kind, 0.6 :: DOUBLE AS priority FROM customer UNION ALL SELECT concat('/market/', regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '/'), 'market', 0.7 :: DOUBLE FROM nation")
def url_table(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.lit("2024-01-01").alias("lastmod"))
    n = table(spark, d, "nation").select(text.url_slug(F.col("n_name")).alias("slug"), F.lit("2024-01-01").alias("lastmod"))
    return serve.url_table({"company": (c, "/company/", 0.6, "weekly"), "market": (n, "/market/", 0.7, "daily")}).select("url", "kind", "priority")


# ---- dedupe ----

_KEY = "regexp_replace(translate(lower(title), 'ilo', '110'), '[^a-z0-9]+', '', 'g')"


@query(with_views("articles") + f", k AS (SELECT lang, link, row_number() OVER (PARTITION BY lang, {_KEY} ORDER BY published_at, link) AS r FROM articles) SELECT lang, link FROM k WHERE r = 1")
def title_dedupe(spark, d):
    return dedupe.first_per_title(views.articles(spark, d), ["lang"], [F.col("published_at"), F.col("link")]).select("lang", "link")


_PAGES = "p AS (SELECT page_id AS pos, url AS link, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title, '' AS summary FROM pages UNION ALL SELECT page_id + 1000000000, concat(regexp_replace(url, '\\?.*$', ''), '?copy=1'), trim(regexp_extract(html, '<title>(.*?)</title>', 1)), 'again' FROM pages WHERE page_id % 3 = 0)"


@query(
    f"WITH {_PAGES}, k AS (SELECT pos, link, coalesce(nullif({_KEY}, ''), lower(regexp_replace(link, '\\?.*$', ''))) AS c, CASE WHEN summary <> '' THEN 3 ELSE 1 END AS rich FROM p), "
    "r AS (SELECT pos, c, count(*) OVER (PARTITION BY c) AS copies, row_number() OVER (PARTITION BY c ORDER BY rich DESC, pos) AS r FROM k) SELECT pos, copies FROM r WHERE r = 1"
)
def two_key_dedupe(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("link"), F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), F.lit("").alias("summary"))
    again = p.where("pos % 3 = 0").select(F.col("pos") + 1000000000, F.concat(F.regexp_replace("link", r"\?.*$", ""), F.lit("?copy=1")), "title", F.lit("again"))
    return dedupe.two_key_dedupe(p.union(again)).select("pos", "copies")


_SETS = (
    with_views("articles")
    + ", w AS (SELECT link AS id, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), '\\s+'), lambda x: length(x) > 3 AND NOT list_contains(["
    + ", ".join(f"'{x}'" for x in rules.THREAD_STOP)
    + "], x)))) AS words FROM articles), s AS (SELECT min(id) AS id, words FROM w WHERE len(words) >= 2 GROUP BY words), "
    "j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS n, len(a.words) + len(b.words) AS m FROM s a JOIN s b ON a.id < b.id), pairs AS (SELECT a, b FROM j WHERE n >= 2 AND n / (m - n) >= 0.4)"
)


@query(_SETS + " SELECT a, b FROM pairs")
def similar_headlines(spark, d):
    a = views.articles(spark, d).select(F.col("link").alias("id"), F.array_sort(text.keyword_set(F.col("title"))).alias("words"))
    return dedupe.similar_pairs(Scratch(spark, "headlines").put(a.where(F.size("words") >= 2).groupBy("words").agg(F.min("id").alias("id"))))


@query(
    _SETS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, k AS (SELECT link AS id, CASE WHEN len(words) >= 2 THEN array_to_string(words, ' ') ELSE concat('=', link) END AS key FROM articles JOIN w ON w.id = link), h AS (SELECT key, max(id) AS head, min(id) AS low FROM k GROUP BY key),
    nb AS (SELECT a.head AS a, b.head AS b FROM pairs JOIN h a ON pairs.a = a.low JOIN h b ON pairs.b = b.low), nn AS (SELECT a, b FROM nb UNION SELECT b, a FROM nb), n AS (SELECT head, coalesce(list(b) FILTER (WHERE b IS NOT NULL), []) AS near, row_number() OVER (ORDER BY head DESC) AS i FROM h LEFT JOIN nn ON nn.a = head GROUP BY head),
    g AS (SELECT CAST(0 AS BIGINT) AS i, [] :: BIGINT[] AS leaders, NULL :: BIGINT AS head, NULL :: BIGINT AS leader UNION ALL SELECT i, CASE WHEN hit IS NULL THEN list_append(leaders, head) ELSE leaders END, head, coalesce(hit, head) FROM (SELECT n.i, n.head, g.leaders, list_filter(g.leaders, lambda x: list_contains(n.near, x))[1] AS hit FROM g JOIN n ON n.i = g.i + 1))
    SELECT k.id AS link, g.leader AS thread FROM k JOIN h USING (key) JOIN g ON g.head = h.head"""
)
def threads(spark, d):
    return dedupe.threads(views.articles(spark, d), [-F.unix_micros("published_at")])


@query(
    _SETS
    + """, nb AS (SELECT x.words AS a, y.words AS b FROM pairs JOIN s x ON x.id = pairs.a JOIN s y ON y.id = pairs.b), nn AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb UNION ALL SELECT words, words FROM s), src AS (SELECT DISTINCT words, source FROM w JOIN articles ON link = id),
    o AS (SELECT x.link, count(DISTINCT y.source) FILTER (WHERE y.source <> x.source) + 1 AS n FROM articles x JOIN w ON w.id = x.link LEFT JOIN nn ON nn.a = w.words LEFT JOIN src y ON y.words = nn.b GROUP BY x.link)
    SELECT link, n AS outlets, floor((exp(-(epoch(TIMESTAMP '2024-03-01') - epoch(published_at)) / 86400) * 2.5 + least(n - 1, 3) / 3 * 1.5) * 1000 + 0.5) / 1000 AS score FROM articles JOIN o USING (link)"""
)
def prominence_score(spark, d):
    scratch = Scratch(spark, "prominent")
    a = scratch.put(views.articles(spark, d).select("link", "title", "source", "published_at", F.array_sort(text.keyword_set(F.col("title"))).alias("words")))
    sets = scratch.put(a.where(F.size("words") >= 2).groupBy("words").agg(F.min("link").alias("id")))
    grouped = a.hint("merge").join(sets.select("words", F.col("id").alias("same")).hint("merge"), "words", "left").drop("words")
    scored = wire.prominence(scratch.put(grouped), dedupe.similar_pairs(sets), F.lit("2024-03-01").cast("timestamp"))
    return scored.select("link", F.col("corroborated_by").cast("long").alias("outlets"), "score")


_SCORED = with_views("articles") + ", s AS (SELECT *, CAST(n_chars % 97 AS DOUBLE) AS score, concat(source, lang) AS thread FROM articles)"


def _scored(spark, d):
    return views.articles(spark, d).withColumns({"score": (F.col("n_chars") % 97).cast("double"), "thread": F.concat("source", "lang")})


@query(_SCORED + ", h AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY score DESC, published_at DESC, pos) AS r FROM s), g AS (SELECT thread, min(pos) AS pos, count(*) AS stories, count(DISTINCT source) AS outlets FROM s GROUP BY thread) SELECT g.thread, h.link AS head, h.score, g.pos, stories, outlets FROM g JOIN h ON g.thread = h.thread AND r = 1")
def thread_fold(spark, d):
    return wire.fold_threads(_scored(spark, d)).select("thread", "head", "score", "pos", "stories", "outlets")


@query(_SCORED + ", t AS (SELECT *, (epoch((SELECT max(published_at) FROM s)) + 108000 - epoch(published_at)) / 3600 AS age FROM s) SELECT link, score FROM t ORDER BY CASE WHEN age <= 24 THEN 0 WHEN age <= 48 THEN 1 WHEN age <= 72 THEN 2 ELSE 3 END, score DESC, published_at DESC, link LIMIT 1")
def lead_pick(spark, d):
    a = _scored(spark, d)
    now = a.agg((F.max("published_at") + F.expr("interval 30 hours")).alias("as_of"))
    return wire.pick_lead(a.join(F.broadcast(now), F.lit(True)), F.col("as_of")).select("link", "score")


@query(
    with_views("articles")
    + ", k AS (SELECT source, link, row_number() OVER w AS rn, count(*) OVER (PARTITION BY source) AS k FROM articles WINDOW w AS (PARTITION BY source ORDER BY published_at DESC, link)), e AS (SELECT *, rn - 10 - 1 AS i, k - 10 AS rest FROM k) "
    "SELECT source, link FROM e WHERE k <= 20 OR rn <= 10 OR (i >= 0 AND list_contains([CAST(floor(j * rest / 10) AS BIGINT) for j in range(10)], i))"
)
def evidence_sample(spark, d):
    return wire.sample_evidence(views.articles(spark, d), ["source"], [F.col("published_at").desc(), F.col("link")], 20).select("source", "link")


@query(with_views("articles") + ", n AS (SELECT count(*) AS al FROM articles), c AS (SELECT source AS tag, count(*) AS n FROM articles GROUP BY source) SELECT tag, c.n FROM c, n WHERE c.n >= greatest(3.0, al * 0.05)")
def prominent_labels(spark, d):
    return wire.prominent_labels(views.articles(spark, d).withColumn("tags", F.array("source")), share=0.05)


@query(
    with_views("articles")
    + ", x AS (SELECT link, published_at + INTERVAL 1 HOUR AS landed_at FROM articles), m AS (SELECT max(landed_at) AS t FROM x) SELECT link, 'since previous brief' AS reason FROM x, m WHERE landed_at > m.t - INTERVAL 2 DAY"
)
def brief_window(spark, d):
    a = views.articles(spark, d).select("link", (F.col("published_at") + F.expr("interval 1 hour")).alias("landed_at"))
    top = a.agg(F.max("landed_at").alias("__t"))
    both = a.join(F.broadcast(top), F.lit(True))
    return wire.brief_window(both, F.col("__t") - F.expr("interval 2 days"), F.col("__t")).select("link", "reason")


# ---- headlines made from the tables: the answers are the columns they are made from ----

_UNITS = "CASE k WHEN 0 THEN concat('$', a, 'M') WHEN 1 THEN concat('€', a, ' million') WHEN 2 THEN concat('£', a, 'mn') WHEN 3 THEN concat('Rs ', a, ' crore') ELSE concat('US$', a, ' million') END"
_HEAD = "WITH h AS (SELECT o_orderkey AS link, o_orderkey % 5 AS k, CAST(o_orderkey % 400 + 1 AS VARCHAR) AS a, CAST(o_orderkey % 400 + 1 AS DOUBLE) AS n, o_orderkey % 3 AS v, o_custkey FROM orders)"


def _heads(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), (F.col("o_orderkey") % 5).alias("k"), (F.col("o_orderkey") % 400 + 1).cast("string").alias("a"), (F.col("o_orderkey") % 3).alias("v"), "o_custkey")
    return o.withColumn("money", F.expr(_UNITS))


@query(_HEAD + " SELECT link, CASE k WHEN 0 THEN n WHEN 1 THEN n * 1.08 WHEN 2 THEN n * 1.27 WHEN 3 THEN n * 10 * 0.012 ELSE n END AS usd_m, CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'INR' ELSE 'USD' END AS currency FROM h".replace("n * 1.08", "round(n * 1.08, 6)").replace("n * 1.27", "round(n * 1.27, 6)").replace("n * 10 * 0.012", "round(n * 10 * 0.012, 6)"))
def money_parse(spark, d):
    """Amounts behind valuations, before them and alone."""
    title = F.when(F.col("v") == 0, F.concat(F.lit("Valued at $9 billion, Acme raises "), "money")).when(F.col("v") == 1, F.concat(F.lit("Acme raises "), "money", F.lit(", bringing its valuation to $2.5B"))).otherwise(F.concat(F.lit("Acme lands "), "money", F.lit(" for 24 brokers")))
    return _heads(spark, d).withColumn("x", text.amount_of(title)).select("link", r6("x.usd_m").alias("usd_m"), "x.currency")


@query("SELECT o_orderkey AS link, ['Pre-seed', 'Pre-Series A', 'Seed', 'Series A', 'Series B', 'Series E+', 'Venture debt', 'Growth', ''][o_orderkey % 9 + 1] AS stage, CASE o_orderkey % 4 WHEN 0 THEN concat('Peak ', o_custkey, ' Ventures') WHEN 1 THEN concat('Fund', o_custkey) ELSE '' END AS lead FROM orders")
def stage_parse(spark, d):
    """Stage and lead investor read back out of headlines."""
    words = F.array(*[F.lit(x) for x in ("pre-seed", "pre-series A", "seed round", "Series A", "series B", "Series G", "debt facility", "growth equity", "round")])
    lead = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" led by Peak "), "o_custkey", F.lit(" Ventures to expand"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" Led By Fund"), "o_custkey", F.lit(" To Grow"))).otherwise("")
    title = F.concat(F.lit("Acme raises $5M "), F.element_at(words, (F.col("o_orderkey") % 9 + 1).cast("int")), lead)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), text.stage_of(title).alias("stage"), text.lead_investor(title).alias("lead"))


@query("SELECT l_orderkey AS link, CAST(l_linenumber AS BIGINT) AS line, concat('Buyer', l_suppkey) AS acquirer, concat('Firm', l_partkey, ' Group') AS target, CASE WHEN l_linenumber % 5 = 1 THEN concat('Seller', l_suppkey) ELSE '' END AS seller, CASE WHEN l_linenumber % 5 = 0 THEN 'Majority stake' ELSE 'Acquisition' END AS type FROM lineitem")
def deal_pair_parse(spark, d):
    """Both sides of a deal read back out of five kinds of headline."""
    b, f, s = F.concat(F.lit("Buyer"), "l_suppkey"), F.concat(F.lit("Firm"), "l_partkey", F.lit(" Group")), F.concat(F.lit("Seller"), "l_suppkey")
    k = F.col("l_linenumber") % 5
    title = F.when(k == 0, F.concat(b, F.lit(" acquires majority stake in "), f)).when(k == 1, F.concat(s, F.lit(" sells "), f, F.lit(" to "), b)).when(k == 2, F.concat(F.lit("Rent costs: "), b, F.lit(" to acquire London-based insurtech "), f, F.lit(" for $80M"))).when(k == 3, F.concat(f, F.lit(" acquired by "), b)).otherwise(F.concat(b, F.lit(" completes acquisition of "), f, F.lit(" amid probe")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_linenumber").cast("long").alias("line"), text.deal_pair(title).alias("p"), text.deal_type(title).alias("type")).select("link", "line", "p.acquirer", "p.target", "p.seller", "type")


@query("SELECT o_orderkey AS link, o_orderkey % 6 IN (1, 2, 3) AS noise, o_orderkey % 6 = 4 AS stale, o_orderkey % 6 NOT IN (5) AS candidate FROM orders")
def noise_gate(spark, d):
    """Rounds told from forecasts, tallies and rumours."""
    titles = F.array(*[F.lit(x) for x in ("Acme raises $5M seed", "Market size to reach $5 billion by 2035", "A total of $570m was raised across 26 deals", "Acme could secure up to $100m", "Acme raises $10m - CX Tech Forum", "Weather is fine")])
    t = F.element_at(titles, (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), text.round_noise(t).alias("noise"), text.stale_record(t).alias("stale"), text.funding_candidate(t).alias("candidate"))


@query("SELECT o_orderkey AS link, CASE o_orderkey % 4 WHEN 0 THEN 'Funding' WHEN 1 THEN 'Cyber' WHEN 2 THEN 'AI & Automation|Claims & Underwriting' ELSE 'Industry' END AS tags, CASE o_orderkey % 4 WHEN 0 THEN 'Insurtech funding' WHEN 1 THEN 'Cyber insurance' WHEN 2 THEN 'AI in insurance' ELSE 'Insurtech' END AS subject FROM orders")
def tag_labels(spark, d):
    titles = F.array(*[F.lit(x) for x in ("Acme raises $5M", "Ransomware hits insurer", "AI speeds claims", "A quiet day")])
    t = text.labels(F.element_at(titles, (F.col("o_orderkey") % 4 + 1).cast("int")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.array_join(t, "|").alias("tags"), text.subject_of(F.element_at(t, 1)).alias("subject"))


@query("SELECT c_custkey, ['home-and-property-insurance|pet-insurance|life-and-annuities', '', 'cyber-insurance', 'home-and-property-insurance'][c_custkey % 4 + 1] AS sectors, ['India', 'United States', NULL, 'Bermuda'][c_custkey % 4 + 1] AS country, ['Pune', 'San Francisco', '', ''][c_custkey % 4 + 1] AS city FROM customer".replace("home-and-property-insurance|pet-insurance|life-and-annuities", "life-and-annuities|home-and-property-insurance|pet-insurance"))
def profile_sectors(spark, d):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("c_custkey") % 4 + 1).cast("int"))
    summary = pick("Sells renters, pet, and life insurance", "Sells software", "Writes cyber cover for firms", "A property-casualty carrier")
    place = pick("Pune, India", "San Francisco, California", "Global", "Bermuda")
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.sectors_of(summary), "|").alias("sectors"), text.country_of(place).alias("country"), text.city_of(place).alias("city"))


@query("SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages")
def html_titles(spark, d):
    from tidewire.sources.feeds import tag

    return table(spark, d, "pages").select("page_id", tag(F.col("html"), "title").alias("title"))


@query("SELECT page_id, lower(regexp_replace(url, '\\?.*$', '')) AS link_key FROM pages")
def link_keys(spark, d):
    return table(spark, d, "pages").select("page_id", text.link_key(F.col("url")).alias("link_key"))


@query("SELECT conv_id, turn, regexp_replace(translate(lower(coalesce(text, '')), 'ilo', '110'), '[^a-z0-9]+', '', 'g') AS title_key FROM conversations")
def title_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.title_key(F.coalesce(F.col("text"), F.lit(""))).alias("title_key"))


# ---- entities ----


@query("SELECT concat('firm', s_suppkey, '-', sfx) AS slug, concat('firm', s_suppkey) AS root FROM supplier, (SELECT unnest(['group', 'insurance-group', 'insurance']) AS sfx) WHERE s_suppkey % 2 = 0")
def prefix_merge(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("firm"), "s_suppkey").alias("root"), "s_suppkey")
    more = s.where("s_suppkey % 2 = 0").select(F.explode(F.array(*[F.concat("root", F.lit(x)) for x in ("-group", "-insurance-group", "-insurance", "-bakery")])).alias("slug"))
    return entities.prefix_merges(s.select(F.col("root").alias("slug")).union(more))


@query("SELECT concat('fund-', l_suppkey) AS slug FROM lineitem GROUP BY l_suppkey HAVING bool_and(NOT (l_linenumber % 7 = 0 AND l_suppkey % 3 = 0))")
def investor_demotion(spark, d):
    name = F.concat(F.lit("Fund "), "l_suppkey")
    title = F.when((F.col("l_linenumber") % 7 == 0) & (F.col("l_suppkey") % 3 == 0), F.concat(name, F.lit(" launches a product"))).otherwise(F.concat(F.lit("Acme raises $5M led by "), name))
    return entities.investors(table(spark, d, "lineitem").select(text.company_slug(name).alias("slug"), name.alias("name"), title.alias("title")))


@query(
    with_views("rounds")
    + """, c AS (SELECT *, concat(slug, '-', year(published_at)) AS cluster, CAST(floor(amount_m * 10 + 0.5) AS BIGINT) AS b FROM rounds), n AS (SELECT *, count(*) OVER (PARTITION BY cluster, b) AS n FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, b, published_at, link) AS r FROM n), s AS (SELECT cluster, stage, row_number() OVER (PARTITION BY cluster ORDER BY published_at DESC, link DESC) AS r FROM c),
    o AS (SELECT cluster, count(*) AS reports, list_sort(list(DISTINCT source)) AS outlets FROM c GROUP BY cluster)
    SELECT f.cluster, f.link, f.amount_m, f.source, s.stage, reports, array_to_string(list_filter(outlets, lambda x: x <> f.source), '|') AS also FROM f JOIN s ON f.cluster = s.cluster AND f.r = 1 AND s.r = 1 JOIN o ON o.cluster = f.cluster"""
)
def resolve_round(spark, d):
    r = views.rounds(spark, d).withColumn("cluster", F.concat_ws("-", "slug", F.year("published_at").cast("string")))
    return rollups.resolve_rounds(r).select("cluster", "link", "amount_m", "source", "stage", "reports", F.array_join("also_reported_by", "|").alias("also"))


@query(with_views("rounds") + " SELECT a.link AS a, b.link AS b FROM rounds a JOIN rounds b ON a.slug = b.slug AND a.link < b.link WHERE greatest(a.amount_m, b.amount_m) / least(a.amount_m, b.amount_m) <= 2 AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) / 86400e6 <= 45")
def same_round_pairs(spark, d):
    return dedupe.same_company_round_pairs(views.rounds(spark, d))


@query("SELECT o_orderkey AS link, concat('co-', o_custkey) AS slug FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def attach_company(spark, d):
    """Raisers matched to mentioned companies; one that fits none leaves the round open."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("Co "), "o_custkey")
    raiser = F.when(F.col("o_orderkey") % 3 == 0, name).when(F.col("o_orderkey") % 3 == 2, F.lit("Somebody else's new venture")).otherwise("")
    r = o.select(F.col("o_orderkey").alias("link"), F.concat(name, F.lit(" raises $5M led by Backer One")).alias("title"), raiser.alias("raiser"))
    m = o.select(F.col("o_orderkey").alias("link"), F.explode(F.array(F.struct(text.company_slug(name).alias("slug"), name.alias("name")), F.struct(F.lit("backer-one").alias("slug"), F.lit("Backer One").alias("name")))).alias("x")).select("link", "x.slug", "x.name")
    return entities.attach_companies(r, m).select("link", "slug")


# ---- state ----


@query("SELECT o_orderkey AS link, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN '1999-01-01 00:00:00' END ELSE '2000-01-01 00:00:00' END AS first_seen FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def first_seen_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_orderstatus").alias("status"))
    stored = o.where("link % 3 = 0").select("link", F.when(F.col("link") % 2 == 0, F.col("status")).otherwise(F.col("status")).alias("status"), F.when(F.col("link") % 6 == 0, F.lit("1999-01-01").cast("timestamp")).alias("first_seen"))
    return serve.upsert_store(stored, o.where("link % 2 = 0"), F.lit("2000-01-01").cast("timestamp")).select("link", "status", stamp("first_seen"))


@query("SELECT o_orderkey AS link FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 0")
def worklist_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), "o_orderstatus", "o_orderdate")
    facts = o.select("link", F.when(F.col("link") % 4 == 0, 2).otherwise(1).alias("pv"))
    return deal_ops.worklist(o, facts, F.col("o_orderstatus") == "O", 2, [F.col("o_orderdate").desc(), F.col("link")]).select("link")


@query("SELECT concat('/part/', p_partkey, '/') AS url, CASE WHEN p_partkey % 11 = 0 THEN 'deleted' WHEN p_partkey % 7 = 0 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def snapshot_diff(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/part/"), "p_partkey", F.lit("/index.html")).alias("path"), F.col("p_name").alias("content"))
    before = p.where("p_partkey % 7 <> 0 or p_partkey % 11 = 0")
    after = p.where("p_partkey % 11 <> 0").withColumn("content", F.when(F.col("p_partkey") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return serve.changed_urls(before, after, cap=1 << 30)


@query(with_views("articles") + " SELECT link FROM articles WHERE lang IN ('en', 'de') AND contains(lower(title), 'the')")
def wire_search(spark, d):
    a = views.articles(spark, d).withColumn("tags", F.array("lang")).withColumn("summary", F.lit(None).cast("string"))
    return serve.search_wire(a, ["en", "de"], "The").select("link")


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value FROM events")
def reply_json(spark, d):
    """The object cut out of free text around it, trailing comma and all."""
    raw = F.concat(F.lit("Here it is: ```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` done"))
    m = F.from_json(text.json_slice(raw), "map<string,string>")
    return table(spark, d, "events").select("event_id", F.element_at(F.map_values(m), 1).alias("first_value"))


@query(_SCORED + ", f AS (SELECT thread, min(pos) AS p FROM s GROUP BY thread), k AS (SELECT thread, row_number() OVER (ORDER BY p, thread) AS thread_no FROM f) SELECT link, CAST(thread_no AS INTEGER) AS thread_no FROM s JOIN k USING (thread)")
def thread_numbers(spark, d):
    return wire.number_threads(_scored(spark, d)).select("link", "thread_no")


@query(_SCORED + ", o AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY score DESC, pos) AS r FROM s) SELECT thread, link FROM o WHERE r = 1 ORDER BY score DESC, pos LIMIT 14")
def best_per_thread(spark, d):
    return wire.best_per_thread(_scored(spark, d), [F.col("score").desc(), F.col("pos")], 14).select("thread", "link")


@query("SELECT tag, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'Cyber' WHEN 'view' THEN 'Funding' ELSE event_type END AS tag FROM events) GROUP BY tag")
def tag_counts(spark, d):
    tag = F.when(F.col("event_type") == "click", "Cyber").when(F.col("event_type") == "view", "Funding").otherwise(F.col("event_type"))
    return wire.label_counts(table(spark, d, "events").select(F.array(tag).alias("tags"))).select("tag", "n")


@query(with_views("rounds", "companies", "stories") + _GROUP.format(g="market").replace("SELECT market, companies, coalesce(stories, 0) AS stories, rounds, total_m, largest_m FROM mo", ", z AS (SELECT market, companies, coalesce(stories, 0) AS stories, rounds, total_m, largest_m FROM mo") + ") SELECT CAST(sum(companies) AS BIGINT) AS memberships, CAST(sum(stories) AS BIGINT) AS stories, CAST(sum(rounds) AS BIGINT) AS rounds, CAST(sum(CAST(total_m AS DECIMAL(18,6))) AS DOUBLE) AS total_m FROM z")
def index_totals(spark, d):
    return rollups.index_totals(market_rollup(spark, d))


@query("SELECT a.p_partkey AS slug, b.p_partkey AS other, r AS rank FROM part a JOIN (SELECT x.p_partkey AS s, y.p_partkey, CAST(row_number() OVER (PARTITION BY x.p_partkey ORDER BY y.p_partkey) AS INTEGER) AS r FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey WHERE x.p_partkey <= 200 AND y.p_partkey <= 200) b ON a.p_partkey = b.s WHERE r <= 6".replace(" WHERE x.p_partkey <= 200 AND y.p_partkey <= 200", ""))
def sibling_terms(spark, d):
    p = table(spark, d, "part")
    return rollups.siblings(p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("slug"), F.col("p_brand").alias("label")))


@query("WITH t AS (SELECT event_id, epoch(TIMESTAMP '2024-01-31') - epoch(ts) AS s, ts FROM events) SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm ago') WHEN s < 86400 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h ago') WHEN s < 604800 THEN concat(CAST(floor(s / 86400) AS BIGINT), 'd ago') ELSE strftime(ts, '%b %-d') END AS ago FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS s FROM events)")
def relative_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", dates.time_ago(ts, F.lit("2024-01-31").cast("timestamp")).alias("ago"))


@query("SELECT event_id, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day, isodow(ts - INTERVAL 6 HOUR) <= 5 AS mailable FROM events")
def local_days(spark, d):
    day = dates.local_date(F.col("ts").cast("timestamp")).cast("string")
    return table(spark, d, "events").select("event_id", day.alias("day"), dates.mailable(day).alias("mailable"))


from tidewire.plans import page_queries  # noqa: E402, F401  registers more
from tidewire.plans import state_queries  # noqa: E402, F401  registers more
from tidewire.plans import rule_queries  # noqa: E402, F401  registers more
