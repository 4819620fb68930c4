"""Registered queries of pages, glossary, verdicts, state and whole pipelines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates, rules, text
from tidewire.operators import deals as deal_ops
from tidewire.operators import dedupe, entities, rollups, serve, topics, wire
from tidewire.plans import views
from tidewire.plans.queries import HALF_UP, STAMP, TOTAL, query, stamp
from tidewire.plans.views import with_views
from tidewire.sources import feeds, replies
from tidewire.storage import Scratch, table
from tidewire.streaming import wire as stream

# ---- markets and sectors ----

_SUMMARIES = {
    "AUTOMOBILE": "Sells car and motor insurance in ",
    "BUILDING": "Writes homeowners insurance and title insurance from ",
    "FURNITURE": "Covers renters, pet, and life insurance in ",
    "HOUSEHOLD": "Covers cyber risk for firms of ",
    "MACHINERY": "Marine cargo and travel insurance from ",
}
_SECTORS_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['auto-insurance'] WHEN 'BUILDING' THEN ['home-and-property-insurance', 'title-insurance'] WHEN 'FURNITURE' THEN ['life-and-annuities', 'home-and-property-insurance', 'pet-insurance'] WHEN 'HOUSEHOLD' THEN ['cyber-insurance'] WHEN 'MACHINERY' THEN ['travel-insurance', 'marine-and-aviation-insurance'] END"
_PROFILES = f"""profiles AS (SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, c_acctbal > -500 AS known, {_SECTORS_SQL} AS sectors, n_name AS place,
    CASE c_custkey % 7 WHEN 0 THEN 'Other' WHEN 1 THEN 'Investor' WHEN 2 THEN '' ELSE c_mktsegment END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_INSIDE = "known AND kind NOT IN ('', 'Other', 'Investor')"


def _profiles(spark, d) -> DataFrame:
    """Customers as profiles: a summary by segment, the nation as place, a seventh each outside, investors and unsorted."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    summary = None
    for segment, words in _SUMMARIES.items():
        hit = F.col("c_mktsegment") == segment
        summary = F.when(hit, words) if summary is None else summary.when(hit, words)
    kind = F.when(F.col("c_custkey") % 7 == 0, "Other").when(F.col("c_custkey") % 7 == 1, "Investor").when(F.col("c_custkey") % 7 == 2, "").otherwise(F.col("c_mktsegment"))
    named = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("name"), (F.col("c_acctbal") > -500).alias("known"), F.concat(summary, F.initcap("n_name")).alias("summary"), F.concat(F.lit("Capital, "), F.col("n_name")).alias("place"), kind.alias("kind"))


@query(f"WITH {_PROFILES} SELECT slug, kind, place AS market FROM profiles WHERE {_INSIDE}")
def market_membership(spark, d):
    return topics.market_members(_profiles(spark, d))


@query(f"WITH {_PROFILES} SELECT slug, kind, unnest(sectors) AS sector FROM profiles WHERE {_INSIDE}")
def sector_membership(spark, d):
    return topics.sector_members(_profiles(spark, d))


_GROUPED = """, per AS (SELECT slug, count(*) AS r, sum(CAST(amount_m AS DECIMAL(18,6))) AS t, max(amount_m) AS m FROM rounds GROUP BY slug),
    mo AS (SELECT g, count(*) AS companies, CAST(coalesce(sum(r), 0) AS BIGINT) AS rounds, CAST(coalesce(sum(t), 0) AS DOUBLE) AS total_m, max(m) AS largest_m FROM member LEFT JOIN per USING (slug) GROUP BY g),
    st AS (SELECT g, count(DISTINCT link) AS stories FROM member JOIN stories USING (slug) GROUP BY g),
    z AS (SELECT g, companies, coalesce(stories, 0) AS stories, rounds, total_m, largest_m FROM mo LEFT JOIN st USING (g) WHERE companies >= 5 AND coalesce(stories, 0) >= 12)"""


def _grouped(member: str) -> str:
    return with_views("rounds", "stories") + f", {_PROFILES}, member AS (SELECT slug, {member} AS g FROM profiles WHERE {_INSIDE})" + _GROUPED


@query(_grouped("place") + " SELECT g AS market, companies, stories, rounds, total_m, largest_m FROM z ORDER BY companies DESC, market LIMIT 10")
def market_pages(spark, d):
    members = topics.market_members(_profiles(spark, d))
    return topics.order_groups(rollups.group_rollup(members, views.stories(spark, d), views.rounds(spark, d), "market", 5, 12), "market").limit(10)


@query(_grouped("unnest(sectors)") + " SELECT g AS sector, companies, stories, rounds, total_m, largest_m FROM z ORDER BY companies DESC, sector LIMIT 10")
def sector_pages(spark, d):
    members = topics.sector_members(_profiles(spark, d))
    return topics.order_groups(rollups.group_rollup(members, views.stories(spark, d), views.rounds(spark, d), "sector", 5, 12), "sector").limit(10)


@query(_grouped("place") + " SELECT g AS market, companies, stories, rounds, total_m, largest_m FROM z WHERE rounds > 0 AND total_m > 0 ORDER BY total_m DESC, rounds DESC, g LIMIT 12")
def capital_by_market(spark, d):
    members = topics.market_members(_profiles(spark, d))
    return topics.capital_by_market(rollups.group_rollup(members, views.stories(spark, d), views.rounds(spark, d), "market", 5, 12))


_SUBJECTS = "CASE sector " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n, *_ in rules.SECTORS if "'" not in n) + " ELSE sector END"


@query(f"WITH {_PROFILES}, m AS (SELECT slug, unnest(sectors) AS sector FROM profiles WHERE {_INSIDE}), n AS (SELECT sector, count(*) AS companies FROM m GROUP BY sector), r AS (SELECT slug, sector, CAST(row_number() OVER (PARTITION BY slug ORDER BY companies, {_SUBJECTS}) AS INTEGER) AS rank FROM m JOIN n USING (sector)) SELECT slug, sector, rank FROM r WHERE rank <= 3")
def sector_chips(spark, d):
    return topics.sector_chips(topics.sector_members(_profiles(spark, d))).select("slug", "sector", "rank")


@query(
    with_views("rounds", "stories")
    + f", {_PROFILES}, s AS (SELECT slug, count(*) AS stories FROM stories GROUP BY slug), t AS (SELECT slug, {TOTAL} AS total_m FROM rounds GROUP BY slug), f AS (SELECT place AS market, p.slug, name, coalesce(stories, 0) AS stories, total_m FROM profiles p LEFT JOIN s USING (slug) LEFT JOIN t USING (slug) WHERE {_INSIDE}) "
    "SELECT market, slug, CAST(row_number() OVER (PARTITION BY market ORDER BY stories DESC, coalesce(total_m, 0) DESC, lower(name), slug) AS INTEGER) AS rank FROM f"
)
def market_directory(spark, d):
    told = views.stories(spark, d).groupBy("slug").agg(F.count(F.lit(1)).alias("stories"))
    money = views.rounds(spark, d).groupBy("slug").agg(rollups.total(F.col("amount_m")).alias("total_m"))
    p = _profiles(spark, d)
    rows = topics.market_members(p).join(p.select("slug", "name"), "slug").join(told, "slug", "left").join(money, "slug", "left").withColumn("stories", F.coalesce("stories", F.lit(0)))
    return topics.directory(rows, "market").select("market", "slug", "rank")


# ---- topics and terms ----

_OWN = "own AS (SELECT slug, tag, n FROM (SELECT l_suppkey AS slug, p_brand AS tag, count(DISTINCT l_orderkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(DISTINCT l_orderkey) DESC, p_brand) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r <= 6)"


def _mentions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("tag"))
    return views.mentions(spark, d).join(p, "part").select("slug", "link", "tag").distinct()


@query(f"WITH {_OWN}, r AS (SELECT tag, slug, n, CAST(row_number() OVER (PARTITION BY tag ORDER BY n DESC, slug) AS INTEGER) AS rank FROM own) SELECT tag, slug, n, rank FROM r WHERE rank <= 14")
def topic_companies(spark, d):
    m = _mentions(spark, d)
    own = rollups.top_per_group(m.groupBy("slug", "tag").agg(F.count(F.lit(1)).alias("n")), ["slug"], [F.col("n").desc(), F.col("tag")], 6)
    return topics.companies_of_topics(own)


def _tagged(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("link")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tags"))
    return li.join(views.rounds(spark, d).select("link", "source"), "link")


_TAGGED = "x AS (SELECT DISTINCT l_orderkey AS link, concat(l_returnflag, l_linestatus) AS tag FROM lineitem)"


@query(f"WITH {_TAGGED}, r AS (SELECT a.tag, b.tag AS other, count(*) AS n, CAST(row_number() OVER (PARTITION BY a.tag ORDER BY count(*) DESC, b.tag) AS INTEGER) AS rank FROM x a JOIN x b ON a.link = b.link AND a.tag <> b.tag GROUP BY 1, 2) SELECT * FROM r WHERE rank <= 6")
def topic_related(spark, d):
    return topics.related_topics(_tagged(spark, d))


@query(with_views("rounds") + f", {_TAGGED}, r AS (SELECT tag, source, count(*) AS n, CAST(row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, source) AS INTEGER) AS rank FROM x JOIN rounds USING (link) GROUP BY 1, 2) SELECT * FROM r WHERE rank <= 10")
def topic_sources(spark, d):
    return topics.sources_of_topics(_tagged(spark, d))


_TERMS = [("license", "(?i)licen[cs]e", ""), ("and-the", "(?i) the ", ""), ("und", "(?i) und ", ""), ("de", "(?i) de ", ""), ("question", r"\?", ""), ("rare", "qzx", "")]
_TERM_SQL = with_views("articles") + ", t AS (SELECT DISTINCT link, source, published_at, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title, '{p}') THEN '{s}' END" for s, p, _ in _TERMS) + "], lambda v: v IS NOT NULL)) AS term FROM articles)"


@query(_TERM_SQL + f" SELECT term, count(*) AS stories, {STAMP('min(published_at)')} AS first_at, {STAMP('max(published_at)')} AS last_at, count(*) >= 3 AS indexable FROM t GROUP BY term")
def glossary_rollup(spark, d):
    found = topics.term_rollup(topics.term_stories(views.articles(spark, d), _TERMS))
    return found.withColumns({"first_at": stamp("first_at"), "last_at": stamp("last_at")})


@query(_TERM_SQL + ", r AS (SELECT term, source AS slug, count(*) AS n, CAST(row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, source) AS INTEGER) AS rank FROM t WHERE source IS NOT NULL GROUP BY 1, 2) SELECT * FROM r WHERE rank <= 12")
def term_companies(spark, d):
    a = views.articles(spark, d)
    return topics.companies_of_terms(topics.term_stories(a, _TERMS), a.where(F.col("source").isNotNull()).select(F.col("source").alias("slug"), "link"))


@query("SELECT DISTINCT p_name AS term FROM part ORDER BY lower(p_name) LIMIT 20")
def glossary_order(spark, d):
    return topics.alphabetical(table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()).limit(20)


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS slug FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def window_companies(spark, d):
    window = views.rounds(spark, d).where("published_at >= timestamp'1998-01-01'")
    return topics.window_companies(views.stories(spark, d), window)


@query("SELECT o_orderkey AS link, CAST(o_custkey AS VARCHAR) AS slug FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def live_badges(spark, d):
    index = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("slug"))
    return topics.live_badges(views.stories(spark, d), index).select("link", "slug")


@query(
    with_views("articles", "rounds")
    + """, s AS (SELECT *, CAST(n_chars % 97 AS DOUBLE) AS score, concat(source, lang) AS thread FROM articles), w AS (SELECT * FROM rounds WHERE published_at >= TIMESTAMP '1998-07-01'),
    h AS (SELECT thread, count(DISTINCT source) AS outlets, min(pos) AS pos FROM s GROUP BY thread), b AS (SELECT thread, link, score, row_number() OVER (PARTITION BY thread ORDER BY score DESC, published_at DESC, pos) AS r FROM s), f AS (SELECT h.*, link, score FROM h JOIN b ON h.thread = b.thread AND r = 1),
    l AS (SELECT lang AS tag, count(*) AS n FROM s WHERE lang IS NOT NULL GROUP BY lang)
    SELECT 'counts' AS part, 0 AS ord, 'stories' AS name, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'counts', 0, 'outlets', CAST(count(DISTINCT source) AS DOUBLE) FROM s
    UNION ALL SELECT 'theme', CAST(row_number() OVER (ORDER BY n DESC, tag) AS INTEGER), tag, CAST(n AS DOUBLE) FROM (SELECT * FROM l ORDER BY n DESC, tag LIMIT 8)
    UNION ALL SELECT 'funding', 0, CAST(count(*) AS VARCHAR), CAST(sum(CAST(amount_m AS DECIMAL(18,6))) AS DOUBLE) FROM w HAVING count(*) > 0
    UNION ALL SELECT 'sample', CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER), CAST(link AS VARCHAR), score FROM (SELECT * FROM f ORDER BY score DESC, pos LIMIT 14)"""
)
def batch_digest(spark, d):
    a = views.articles(spark, d).withColumns({"score": (F.col("n_chars") % 97).cast("double"), "thread": F.concat("source", "lang"), "tags": F.array_compact(F.array("lang"))})
    return wire.batch_digest(a, views.rounds(spark, d).where("published_at >= timestamp'1998-07-01'"))


# ---- periods ----


def _grid(grain: str, key: str, step: str):
    sql = with_views("rounds") + f""", m AS (SELECT {key.format('published_at')} AS period, count(*) AS rounds, {TOTAL} AS total_m FROM rounds WHERE published_at >= TIMESTAMP '1992-02-15' AND month(published_at) <> 5 GROUP BY 1),
    s AS (SELECT {key.format('x')} AS period FROM (SELECT unnest(generate_series((SELECT date_trunc('year', min(o_orderdate)) FROM orders WHERE o_orderdate >= TIMESTAMP '1992-02-15' AND month(o_orderdate) <> 5), (SELECT date_trunc('year', max(o_orderdate)) + INTERVAL 11 MONTH FROM orders WHERE o_orderdate >= TIMESTAMP '1992-02-15' AND month(o_orderdate) <> 5), INTERVAL {step})) AS x))
    SELECT s.period, CASE WHEN s.period NOT BETWEEN (SELECT min(period) FROM m) AND (SELECT max(period) FROM m) THEN 'outside' WHEN rounds IS NULL THEN 'gap' ELSE 'data' END AS state, coalesce(rounds, 0) AS rounds, coalesce(total_m, 0.0) AS total_m FROM s LEFT JOIN m USING (period)"""

    @query(sql, f"calendar_grid_{grain}")
    def run(spark, d):
        return rollups.calendar_grid(views.rounds(spark, d).where("published_at >= timestamp'1992-02-15' and month(published_at) <> 5"), grain)


_grid("month", "strftime({0}, '%Y-%m')", "1 MONTH")
_grid("quarter", "concat(year({0}), '-q', quarter({0}))", "3 MONTH")


@query(with_views("rounds") + f", p AS (SELECT CAST(year(published_at) AS VARCHAR) AS period, count(*) AS rounds, {TOTAL} AS total_m FROM rounds GROUP BY 1 HAVING count(*) >= 8), a AS (SELECT min(published_at) AS first FROM rounds) SELECT period, rounds, total_m, CASE WHEN period = '1998' THEN 'open' WHEN make_date(CAST(period AS INT), 1, 1) < CAST(first AS DATE) THEN 'truncated' ELSE '' END AS partial FROM p, a WHERE (SELECT count(*) FROM p) >= 2")
def year_split(spark, d):
    return rollups.split_by_period(views.rounds(spark, d), "year", F.lit("1998-08-15").cast("timestamp"), 8).select("period", "rounds", "total_m", "partial")


# ---- names of companies ----


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('Firm', s_suppkey, ' Labs|AxaCorp', s_nationkey) WHEN 1 THEN concat('PolicyStreet', s_suppkey) WHEN 2 THEN '' ELSE concat('Zx', s_suppkey, ' Holdings') END AS names FROM supplier")
def name_extraction(spark, d):
    """Names by action, camel case and ending; places, modifiers and adjectives are none."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 4
    title = F.when(k == 0, F.concat(F.lit("London-based Insurtech Firm"), "s_suppkey", F.lit(" Labs raises $5M with AxaCorp"), "s_nationkey")).when(k == 1, F.concat(F.lit("Global Digital Market: PolicyStreet"), "s_suppkey", F.lit(" In Singapore"))).when(k == 2, F.lit("How New Global Insurance Platforms Help US Insurers")).otherwise(F.concat(F.lit("Leading Zx"), "s_suppkey", F.lit(" Holdings, Best Report of 2.0")))
    return s.select("s_suppkey", F.array_join(entities.company_names(title), "|").alias("names"))


# ---- deals ----


@query("SELECT l_orderkey AS link, CAST(l_linenumber AS BIGINT) AS line, l_linenumber % 5 IN (1, 2, 3) AS candidate FROM lineitem")
def deal_candidates(spark, d):
    k = F.col("l_linenumber") % 5
    verb = F.when(k == 1, " buys ").when(k == 2, " and a takeover of ").when(k == 3, " meets ").otherwise(" visits ")
    title = F.concat(F.lit("Buyer"), "l_suppkey", verb, F.lit("Firm"), "l_partkey")
    summary = F.when(k == 3, F.lit("It sells the unit.")).otherwise(F.lit(None).cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_linenumber").cast("long").alias("line"), text.deal_candidate(title, summary).alias("candidate"))


_SAME = "li AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2), x AS (SELECT l_orderkey * 10 + l_linenumber AS link, o_custkey AS c, l_suppkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 1000 END AS amount_m, o_orderdate AS dt, concat('desk', l_orderkey % 3) AS source FROM li JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')"


@query(
    f"WITH {_SAME}, r AS (SELECT *, row_number() OVER (PARTITION BY c, s ORDER BY dt DESC, link) AS n FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY c, s ORDER BY dt DESC, link) AS n FROM x WHERE amount_m > 0), g AS (SELECT c, s, count(*) AS reports, list_sort(list(DISTINCT source)) AS o FROM x GROUP BY c, s) "
    "SELECT r.link, reports, p.amount_m, array_to_string(list_filter(o, lambda v: v <> r.source), '|') AS also FROM r JOIN g ON r.c = g.c AND r.s = g.s LEFT JOIN p ON p.c = r.c AND p.s = r.s AND p.n = 1 WHERE r.n = 1"
)
def deals_by_identity(spark, d):
    """Resolved, unresolved and differently written targets of one acquirer."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_extendedprice").alias("l_extendedprice"))
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("Firm"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0"))
    k = F.col("l_linenumber") % 3
    deals = both.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link"),
        F.concat(F.lit("c"), "o_custkey").alias("acquirer_slug"),
        F.when(k == 0, F.concat(F.lit("s"), "l_suppkey")).alias("target_slug"),
        F.when(k == 1, F.concat(name, F.lit(" Holdings Ltd"))).otherwise(name).alias("target"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") / 1000).alias("amount_m"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("bigint").alias("amount_link"),
        F.lit(None).cast("string").alias("amount_source"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.concat(F.lit("desk"), (F.col("l_orderkey") % 3).cast("string")).alias("source"),
        F.array().cast("array<string>").alias("also_reported_by"),
        F.lit(1).cast("long").alias("reports"),
    )
    return deal_ops.merge_by_identity(deals).select("link", "reports", "amount_m", F.array_join("also_reported_by", "|").alias("also"))


# ---- feeds and whole pipelines ----

_AMOUNT = "(o_orderkey % 400 + 1)"


def _bodies(spark, d):
    """Every order as a landed feed body of one item: escaped markup, an atom link for a third, one skipped page in ten."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Insurtech Co"), "o_custkey", F.lit(" raises $"), k % 400 + 1, F.lit("M &amp;amp; grows &lt;b&gt;fast&lt;/b&gt;"))
    url = F.concat(F.lit("https://news.example.com/"), F.when(k % 10 == 7, "events/").otherwise(""), k, F.lit("?utm=1"))
    link = F.when(k % 3 == 0, F.concat(F.lit('<link href="'), url, F.lit('" rel="alternate"/>'))).otherwise(F.concat(F.lit("<link>"), url, F.lit("</link>")))
    summary = F.when(k % 2 == 0, F.concat(F.lit("<description>&lt;p&gt;Co"), "o_custkey", F.lit(" sells   cover. The post X appeared first on Y.&lt;/p&gt;</description>"))).otherwise("")
    when = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), link, summary, F.lit("<published>"), when, F.lit("</published></item>"))
    return table(spark, d, "orders").select(F.concat(F.lit("feed"), k % 4).alias("feed_url"), F.concat(F.lit("<rss>"), item, F.lit("</rss>")).alias("xml"))


def _manifest(spark):
    return feeds.manifest(spark, [("feed0", "Desk Zero", True, False), ("feed1", "Desk One", False, False), ("feed2", "Desk Two", False, True), ("feed3", "Desk Three", True, True)])


@query(
    "SELECT concat('https://news.example.com/', o_orderkey, '?utm=1') AS link, concat('Insurtech Co', o_custkey, ' raises $', o_orderkey % 400 + 1, 'M & grows fast') AS title, ['Desk Zero', 'Desk One', 'Desk Two', 'Desk Three'][o_orderkey % 4 + 1] AS source, "
    "CASE WHEN o_orderkey % 2 = 0 THEN concat('Co', o_custkey, ' sells cover.') ELSE '' END AS summary, 'Funding' AS tags, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published_at FROM orders WHERE o_orderkey % 10 <> 7 AND o_orderdate >= TIMESTAMP '1992-01-05' AND o_orderdate <= TIMESTAMP '1998-07-02'"
)
def feed_articles(spark, d):
    """Landed bodies to admitted, cleaned, tagged articles within the age limits."""
    got = feeds.read_articles(_bodies(spark, d), _manifest(spark), F.lit("1998-07-01").cast("timestamp"), days=2369)
    return got.select("link", "title", "source", "summary", F.array_join("tags", "|").alias("tags"), stamp("published_at"))


_REPORTS = "r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 400 + 1 AS m, o_orderdate AS dt FROM orders WHERE o_orderstatus <> 'P' QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderkey % 400) = 1)"


def _reports(spark, d):
    """Two reports of each round, the second an hour later from another desk; every fifth is judged no round by a reader."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    once = o.groupBy("o_custkey", (F.col("o_orderkey") % 400).alias("m")).agg(F.count(F.lit(1)).alias("k"), F.min("o_orderkey").alias("o_orderkey")).where("k = 1")
    o = o.join(once.select("o_orderkey"), "o_orderkey", "left_semi")  # a company's raises differ in size
    name = F.concat(F.lit("Zeta"), "o_custkey", F.lit(" Omega"), "o_custkey")
    at = F.col("o_orderdate").cast("timestamp")
    one = o.select((F.col("o_orderkey") * 2).alias("link"), F.concat(name, F.lit(" raises $"), F.col("o_orderkey") % 400 + 1, F.lit("M Series A led by Peak Fund")).alias("title"), F.lit("Desk A").alias("source"), at.alias("published_at"), "o_custkey", "o_orderkey")
    two = o.select((F.col("o_orderkey") * 2 + 1).alias("link"), F.concat(F.lit("Series A: "), name, F.lit(" raises $"), F.col("o_orderkey") % 400 + 1, F.lit("M")).alias("title"), F.lit("Desk B").alias("source"), (at + F.expr("interval 1 hour")).alias("published_at"), "o_custkey", "o_orderkey")
    return one.union(two).withColumns({"summary": F.lit("It sells insurance."), "tags": F.array(F.lit("Funding"))})


@query(f"WITH {_REPORTS} SELECT k * 2 + x AS link, CAST(m AS DOUBLE) AS amount_m, 'Series A' AS stage, CASE WHEN x = 0 THEN 'Peak Fund' ELSE '' END AS lead, 'rules' AS by FROM r, (SELECT unnest([0, 1]) AS x) WHERE k % 5 <> 0 UNION ALL SELECT k * 2, 2.0 * 1.27, 'Seed', '', 'reader' FROM r WHERE k % 10 = 5")
def round_rows(spark, d):
    """Rule rows where there is no verdict, the reader's where there is one, none where it says no."""
    a = _reports(spark, d)
    facts = a.where("o_orderkey % 5 = 0").select("link", ((F.col("o_orderkey") % 10 == 5) & (F.col("link") % 2 == 0)).alias("round"), F.lit("Zeta").alias("company"), F.lit(2.0).alias("amount_m"), F.lit("GBP").alias("currency"), F.lit("Seed").alias("stage"), F.lit(None).cast("string").alias("lead"))
    return deal_ops.round_rows(a, facts).select("link", "amount_m", "stage", "lead", "by")


_EMPTY_FACTS = "link bigint, round boolean, company string, amount_m double, currency string, stage string, lead string"
_RECURSE = """, o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY dt DESC, link) AS n FROM q),
    g AS (SELECT c, 0 AS n, [] :: STRUCT(link BIGINT, m DOUBLE, dt TIMESTAMP)[] AS leaders, NULL :: BIGINT AS link, NULL :: BIGINT AS leader FROM (SELECT DISTINCT c FROM o)
        UNION ALL SELECT c, n, CASE WHEN hit IS NULL THEN list_append(leaders, {'link': link, 'm': m, 'dt': dt}) ELSE leaders END, link, coalesce(hit.link, link)
        FROM (SELECT g.c, o.n, g.leaders, o.link, o.m, o.dt, list_filter(g.leaders, lambda l: greatest(l.m, o.m) / least(l.m, o.m) <= 2 AND abs(epoch_us(l.dt) - epoch_us(o.dt)) / 86400e6 <= 45)[1] AS hit FROM g JOIN o ON o.c = g.c AND o.n = g.n + 1)),
    led AS (SELECT link, leader FROM g WHERE n > 0)"""


@query("WITH RECURSIVE q AS (SELECT o_orderkey AS link, o_custkey AS c, o_totalprice / 1000 AS m, o_orderdate AS dt FROM orders)" + _RECURSE + " SELECT link, leader FROM led", "same_round_clusters")
def same_round_clusters(spark, d):
    return deal_ops.company_round_clusters(views.rounds(spark, d)).select("link", "leader")


@query(
    f"WITH RECURSIVE {_REPORTS}, w AS (SELECT k * 2 + 1 AS link, c, CAST(m AS DOUBLE) AS m, dt + INTERVAL 1 HOUR AS dt FROM r), q AS (SELECT * FROM w)"
    + _RECURSE
    + ", f AS (SELECT leader, led.link, c, m, dt, count(*) OVER (PARTITION BY leader, m) AS k FROM led JOIN q USING (link)), p AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY k DESC, m, dt, link) AS n FROM f) SELECT link, concat('zeta', c) AS slug, m AS amount_m, 'Series A' AS stage FROM p WHERE n = 1"
)
def funding_pipeline(spark, d):
    """Archive to rounds: two reports are one raise, raises close in time and size are one round of the company."""
    a = _reports(spark, d)
    facts = spark.createDataFrame([], _EMPTY_FACTS)
    m = a.select("link", F.concat(F.lit("zeta"), "o_custkey").alias("slug"), F.concat(F.lit("Zeta"), "o_custkey", F.lit(" Omega"), "o_custkey").alias("name"))
    return deal_ops.funding_rounds(a, facts, m).select("link", "slug", "amount_m", "stage")


_BOUGHT = "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier"


def _bought(spark, d):
    """Each supplier bought twice over: by headline and again under another name of the buyer."""
    s = table(spark, d, "supplier")
    firm, buyer = F.concat(F.lit("Firm"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")), F.concat(F.lit("Buyer"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0"))
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("s_suppkey") * 86400)
    one = s.select((F.col("s_suppkey") * 2).alias("link"), F.concat(buyer, F.lit(" acquires insurance firm "), firm, F.lit(" for $"), F.col("s_suppkey") + 1, F.lit("M")).alias("title"), F.lit("Desk A").alias("source"), at.alias("published_at"), "s_suppkey", "s_nationkey")
    two = s.select((F.col("s_suppkey") * 2 + 1).alias("link"), F.concat(firm, F.lit(" acquired by "), buyer, F.lit(" Group")).alias("title"), F.lit("Desk B").alias("source"), (at + F.expr("interval 1 hour")).alias("published_at"), "s_suppkey", "s_nationkey")
    return one.union(two).withColumn("summary", F.lit("A deal among insurance brokers."))


@query(f"SELECT k * 2 + 1 AS link, concat('buyer', lpad(CAST(n AS VARCHAR), 4, '0')) AS acquirer_slug, CAST(k + 1 AS DOUBLE) AS amount_m, 'Desk A' AS also FROM ({_BOUGHT})")
def ma_pipeline(spark, d):
    """Archive to deals: both reports are one deal, the buyer a company of the index, the price from the other report."""
    a = _bought(spark, d)
    facts = spark.createDataFrame([], "link bigint, deal boolean, acquirer string, target string, seller string, type string, amount_m double, currency string")
    name = F.concat(F.lit("Buyer"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0"))
    index = table(spark, d, "supplier").select(F.lower(name).alias("slug"), name.alias("name")).distinct().withColumn("stories", F.lit(3))
    return deal_ops.ma_deals(a, facts, index).select("link", "acquirer_slug", "amount_m", F.array_join("also_reported_by", "|").alias("also"))


@query("SELECT concat('zeta', o_custkey) AS slug, count(*) AS stories, count(DISTINCT o_orderkey % 3) AS outlets, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_seen FROM orders GROUP BY o_custkey")
def index_pipeline(spark, d):
    """Raw names to index records: outlets, investors and junk go, an alias and a corporate word fold into the company."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("Zeta"), "o_custkey")
    a = o.select(F.col("o_orderkey").alias("link"), F.concat(name, F.lit(" raises $5M led by Peak Fund")).alias("title"), F.concat(F.lit("Desk "), F.col("o_orderkey") % 3).alias("source"), F.col("o_orderdate").cast("timestamp").alias("published_at"), "o_custkey")
    form = F.when(F.col("link") % 4 == 0, F.concat(name, F.lit(" Group"))).when(F.col("link") % 4 == 1, F.concat(name, F.lit(" Inc."))).otherwise(name)
    names = a.select("link", F.array(form, F.lit("Peak Fund"), F.col("source"), F.lit("Survaival")).alias("names"))
    lone = a.groupBy("o_custkey").agg(F.min("link").alias("link")).select("link", F.array(name).alias("names"))  # the root of each company is among its names
    aliases = spark.createDataFrame([("nothing", "Nothing")], "alias_slug string, canonical string")
    got = entities.full_index(a, names.union(lone), aliases, ["survaival"])
    return got.select("slug", "stories", "outlets", stamp("first_seen"))


# ---- verdicts ----


@query("SELECT o_orderkey AS link, o_orderkey % 4 IN (0, 1) AS round, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 90 + 1.5 WHEN 1 THEN (o_orderkey % 90 + 1) * 1000.0 END AS amount_m, CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency, CASE o_orderkey % 4 WHEN 0 THEN 'Seed' WHEN 1 THEN '' END AS stage FROM orders")
def funding_verdicts(spark, d):
    """Replies read and checked: an unknown stage goes, a late report and an unknown currency are no round."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    fields = F.when(k == 0, F.concat(F.lit('"amount": "'), F.col("o_orderkey") % 90 + 1, F.lit('.5", "unit": "million", "currency": "eur", "stage": "Seed"'))).when(k == 1, F.concat(F.lit('"amount": "'), F.col("o_orderkey") % 90 + 1, F.lit('", "unit": "bn", "stage": "Jumbo"'))).when(k == 2, F.lit('"amount": "5", "unit": "m", "announcedYear": 1980')).otherwise(F.lit('"amount": "5", "unit": "m", "currency": "XYZ"'))
    reply = F.concat(F.lit('Sure: {"round": true, "company": " Acme ", '), fields, F.lit(",} hope it helps"))
    rows = o.select(F.col("o_orderkey").alias("link"), F.col("o_orderdate").cast("timestamp").alias("published_at"), reply.alias("reply"))
    return replies.funding_verdict(rows).select("link", "round", "amount_m", "currency", "stage")


@query("SELECT l_orderkey * 10 + l_linenumber AS link, l_linenumber % 3 <> 2 AS deal, CASE WHEN l_linenumber % 3 <> 2 THEN concat('Firm', l_suppkey) END AS target, CASE l_linenumber % 3 WHEN 0 THEN 'Merger' WHEN 1 THEN 'Acquisition' END AS type, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey + 1 AS DOUBLE) END AS amount_m FROM lineitem")
def deal_verdicts(spark, d):
    """A deal without a price stays one, parties of one name are none, an unknown type is an acquisition."""
    li = table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 3
    buyer = F.when(k == 2, F.concat(F.lit("FIRM"), "l_suppkey")).otherwise(F.concat(F.lit("Buyer"), "l_partkey"))
    more = F.when(k == 0, F.concat(F.lit('", "type": "Merger", "currency": "USD", "unit": "million", "amount": "'), F.col("l_partkey") + 1)).otherwise('", "type": "Purchase')
    reply = F.concat(F.lit('{"deal": true, "acquirer": "'), buyer, F.lit('", "target": "Firm'), "l_suppkey", more, F.lit('"}'))
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link"), F.col("l_shipdate").cast("timestamp").alias("published_at"), reply.alias("reply"))
    return replies.deal_verdict(rows).select("link", "deal", "target", "type", "amount_m")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_custkey % 5 = 0 AS known, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'figure' WHEN 2 THEN 'marketing' WHEN 3 THEN 'kind' ELSE 'unknown' END AS reason, CASE WHEN c_custkey % 5 = 0 THEN 'Oslo, Norway' END AS place FROM customer")
def profile_verdicts(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    words = F.when(k == 1, "It sells cover in 14 countries to many small firms.").when(k == 2, "It is a leading seller of cover to many small firms.").otherwise("It sells cover to many small firms in the north.")
    reply = F.concat(F.lit('{"known": '), F.when(k == 4, "false").otherwise("true"), F.lit(', "summary": "Acme '), "c_custkey", F.lit(" sells. "), words, F.lit('", "kind": "'), F.when(k == 3, "Circus").otherwise("Insurer"), F.lit('", "place": "Oslo,  Norway."}'))
    rows = c.select(F.col("c_custkey").cast("string").alias("slug"), F.concat(F.lit("Acme "), "c_custkey").alias("name"), reply.alias("reply"))
    return replies.profile_verdict(rows, ["Insurer", "Broker"]).select("slug", "known", "reason", "place")


_LONG = "many words about cover and claims, " * 4


@query(f"SELECT o_orderkey AS link, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no object' WHEN 2 THEN 'empty' ELSE 'short' END AS reason, CASE WHEN o_orderkey % 4 IN (0, 3) THEN concat('Wire ', o_custkey) ELSE '' END AS headline FROM orders")
def brief_verdicts(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    head = F.when(k == 2, "").otherwise(F.concat(F.lit("Wire "), "o_custkey", F.lit(".")))
    body = F.when(k == 3, "short").otherwise(_LONG)
    reply = F.when(k == 1, F.lit("no object here")).otherwise(F.concat(F.lit('{"headline": "'), head, F.lit('", "teaser": "t", "whatsHappening": "'), body, F.lit('", "whyItMatters": "'), body, F.lit('"}')))
    return replies.brief_verdict(o.select(F.col("o_orderkey").alias("link"), reply.alias("reply"))).select("link", "reason", F.when(F.col("reason") == "no object", "").otherwise(F.col("headline")).alias("headline"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AS fits FROM customer")
def prose_verdicts(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    section = lambda head, words: F.struct(head.alias("heading"), words.alias("text"))
    two = F.when(k == 1, F.lit("HISTORY ")).otherwise("Today")
    words = F.when(k == 2, F.lit(_LONG + "12 % of all")).otherwise(_LONG)
    pair = F.array(section(F.lit("History"), F.lit(_LONG)), section(two, words))
    return c.select("c_custkey", replies.prose_verdict(F.when(k == 3, F.slice(pair, 1, 1)).otherwise(pair)).alias("fits"))


# ---- sorts, filters and formats ----


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug FROM customer WHERE contains(lower(c_name), '#00000012')")
def company_search(spark, d):
    return serve.search_names(views.companies(spark, d), " #00000012 ").select("slug")


@query("SELECT o_orderkey AS link FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def stage_filter(spark, d):
    known = ["1-URGENT", "2-HIGH", "5-LOW"]
    return serve.filter_stage(views.rounds(spark, d), ["1-URGENT", "5-LOW", "no such stage"], known).select("link")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, count(*) AS stories FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY count(*) DESC, max(o_orderdate) DESC, c_name LIMIT 50")
def companies_by_coverage(spark, d):
    told = views.rounds(spark, d).groupBy("slug").agg(F.count(F.lit(1)).alias("stories"), F.max("published_at").alias("last_seen"))
    return serve.sort_companies(views.companies(spark, d).join(told, "slug"), "stories").limit(50).select("slug", "stories")


@query(with_views("deals") + " SELECT link FROM deals ORDER BY amount_m ASC NULLS LAST, link LIMIT 100")
def deals_by_amount(spark, d):
    return serve.sort_deals(views.deals(spark, d), "amount_m", ascending=True, tie="link").limit(100).select("link")


@query(with_views("articles") + " SELECT link FROM articles ORDER BY published_at DESC, link LIMIT 140")
def newest_wire(spark, d):
    return serve.newest(views.articles(spark, d)).select("link")


@query("SELECT DISTINCT source FROM documents")
def outlets(spark, d):
    return wire.sources(views.articles(spark, d))


@query("SELECT o_orderkey AS link, CASE WHEN v >= 1000 THEN concat('$', regexp_replace(printf('%.1f', floor(v / 1000 * 10 + 0.5) / 10), '\\.0$', ''), 'B') WHEN v >= 1 THEN concat('$', regexp_replace(printf('%.1f', floor(v * 10 + 0.5) / 10), '\\.0$', ''), 'M') ELSE concat('$', CAST(floor(v * 1000 + 0.5) AS BIGINT), 'K') END AS money FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice / 1000 ELSE o_totalprice / 1000000 END AS v FROM orders)")
def money_labels(spark, d):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.col("o_totalprice")).when(k == 1, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice") / 1000000)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), text.short_money(v).alias("money"))


@query("SELECT market, CASE len(l) WHEN 1 THEN l[1] ELSE concat(array_to_string(l[:-2], ', '), ' and ', l[-1]) END AS names FROM (SELECT n_regionkey AS market, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey)")
def name_lists(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("market")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return n.select("market", text.oxford(F.col("l")).alias("names"))


@query("SELECT o_orderkey AS link, strftime(o_orderdate, '%b %-d, %Y') AS whole, strftime(o_orderdate, '%b %-d') AS short FROM orders")
def date_labels(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), dates.full_date(ts).alias("whole"), dates.short_date(ts).alias("short"))


@query("SELECT DISTINCT concat(year(o_orderdate), '-q', quarter(o_orderdate)) AS quarter, array_to_string([strftime(date_trunc('quarter', o_orderdate) + to_months(i), '%Y-%m') for i in range(3)], ',') AS months FROM orders")
def months_of_quarters(spark, d):
    q = table(spark, d, "orders").select(dates.quarter_key(F.col("o_orderdate")).alias("quarter")).distinct()
    return q.select("quarter", F.array_join(dates.quarter_months(F.col("quarter")), ",").alias("months"))


# ---- state ----


@query("SELECT o_orderkey AS link, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) ELSE 'old' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS funding FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def upsert_carry(spark, d):
    """A writer that knows nothing of another's column leaves it as it is."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("funding"))
    stored = o.where("link % 3 = 0").select("link", F.lit("old").alias("status"), "funding", F.lit("1999-01-01").cast("timestamp").alias("first_seen"))
    return serve.upsert_store(stored, o.where("link % 2 = 0").select("link", "status"), F.lit("2000-01-01").cast("timestamp")).select("link", "status", "funding")


@query("SELECT o_orderkey AS link, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS pv, o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 AS round FROM orders")
def verdict_cache(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"))
    facts = o.select("link", F.lit(False).alias("round"), F.lit(1).alias("pv"))
    return serve.append_verdicts(facts, o.where("link % 2 = 0").select("link", (F.col("link") % 4 != 0).alias("round"), F.lit(2).alias("pv"))).select("link", "pv", "round")


@query("SELECT o_orderkey AS link FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def cache_prune(spark, d):
    live = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("slug"))
    return serve.prune(views.stories(spark, d), live, "slug").select("link")


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, c_custkey % 5 = 0 OR (c_custkey % 3 = 0 AND c_nationkey < 3) OR n >= greatest(ceil(w * 1.25), w + 8) AS due FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n, c_custkey % 11 AS w FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey)")
def refresh_due(spark, d):
    c = table(spark, d, "customer").withColumn("slug", F.col("c_custkey").cast("string"))
    n = views.stories(spark, d).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    due = serve.needs_refresh(F.lit(2), F.when(k % 5 == 0, 1).otherwise(2), F.coalesce("n", F.lit(0)), k % 11, k % 3 != 0, F.col("c_nationkey"))
    return c.join(n, "slug", "left").select("slug", due.alias("due"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS slug, true AS known, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS summary, CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN c_custkey % 3 + 1 ELSE c_custkey % 3 END AS tries FROM customer")
def rewrite_merge(spark, d):
    """A rewrite that fails keeps the published text and counts a try."""
    c = table(spark, d, "customer").withColumn("slug", F.col("c_custkey").cast("string"))
    cached = c.select("slug", F.lit(True).alias("known"), F.lit("old").alias("summary"), F.lit(10).alias("n"), (F.col("c_custkey") % 3).cast("int").alias("tries"), F.lit(1).alias("pv"))
    new = c.where("c_custkey % 2 = 0").select("slug", (F.col("c_custkey") % 4 == 0).alias("known"), F.when(F.col("c_custkey") % 4 == 0, "new").alias("summary"), F.lit(12).alias("n"))
    return serve.merge_rewrite(cached, new, 2).select("slug", "known", "summary", F.col("tries").cast("long").alias("tries"))


@query("SELECT c_custkey AS link, strftime(CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-05-01' WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-02-02' WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-03-03' ELSE TIMESTAMP '1970-01-01' END, '%Y-%m-%d %H:%M:%S') AS landed_at FROM customer")
def landed_times(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("link"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-03-03").cast("timestamp")).alias("published_at"))
    seen = c.where("link % 3 <> 0").select("link", F.when(F.col("link") % 3 == 1, F.lit("2024-02-02").cast("timestamp")).alias("first_seen"))
    return wire.landed_at(c, seen, True, F.lit("2024-05-01").cast("timestamp")).select("link", stamp("landed_at"))


_KEY = "regexp_replace(translate(lower(title), 'ilo', '110'), '[^a-z0-9]+', '', 'g')"


@query(with_views("articles") + f", k AS (SELECT link, {_KEY} AS t, published_at FROM articles), f AS (SELECT * FROM k WHERE link % 2 = 1 AND t NOT IN (SELECT t FROM k WHERE link % 2 = 0)) SELECT link FROM (SELECT link, row_number() OVER (PARTITION BY t ORDER BY published_at, link) AS r FROM f) WHERE r = 1")
def backfill_merge(spark, d):
    a = views.articles(spark, d).withColumn("id", F.col("link")).withColumn("link", F.concat(F.lit("https://a.example.com/"), "id"))
    got = dedupe.keep_unseen(a.where("id % 2 = 1"), a.where("id % 2 = 0"), [F.col("published_at"), F.col("id")])
    return got.select(F.col("id").alias("link"))


@query("SELECT strftime(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d') AS date, CASE WHEN n_nationkey % 3 = 0 THEN concat('new ', n_name) ELSE n_name END AS headline FROM nation WHERE n_nationkey < 15 OR n_nationkey % 3 = 0")
def brief_upsert(spark, d):
    """One brief a date; an author that is not accepted changes nothing."""
    n = table(spark, d, "nation")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("date")
    rows = lambda head, by: n.select("n_nationkey", day, head.alias("headline"), F.lit("x").alias("whats_happening"), F.lit(by).alias("by"))
    old = rows(F.col("n_name"), "a").where("n_nationkey < 15")
    new = rows(F.concat(F.lit("new "), "n_name"), "a").where("n_nationkey % 3 = 0").union(rows(F.lit("bad"), "b").where("n_nationkey % 3 = 1"))
    return serve.upsert_brief(old.drop("n_nationkey"), new.drop("n_nationkey"), "a").select(F.col("date").cast("string").alias("date"), "headline")


@query("SELECT strftime(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d') AS date, concat('brief-', strftime(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d')) AS guid FROM nation ORDER BY 1 DESC LIMIT 10")
def brief_feed(spark, d):
    n = table(spark, d, "nation").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("date"))
    return serve.brief_feed(n, 10).select(F.col("date").cast("string").alias("date"), "guid")


@query(with_views("articles") + ", s AS (SELECT *, CAST(n_chars % 97 AS DOUBLE) AS score, concat(source, lang) AS thread FROM articles), b AS (SELECT thread, link, row_number() OVER (PARTITION BY thread ORDER BY score DESC, published_at DESC, pos) AS r FROM s) SELECT b.thread, CASE WHEN b.thread = l.thread THEN 3 ELSE b.link END AS head FROM b, (SELECT thread FROM s WHERE link = 3) l WHERE r = 1")
def pinned_lead(spark, d):
    a = views.articles(spark, d).withColumns({"score": (F.col("n_chars") % 97).cast("double"), "thread": F.concat("source", "lang")})
    return wire.pin_lead(wire.fold_threads(a).select("thread", "head"), a.where("link = 3"), a).select("thread", "head")


# ---- streams ----


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1")
def stream_daily_totals(spark, d):
    """Tumbling days over the events as a stream; what has landed is read and the totals written."""
    source = table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").withColumn("value", F.col("value").cast("decimal(18,6)"))
    scratch, out = Scratch(spark, "stream"), []
    totals = stream.daily_totals(rows, "ts", "value")
    run = totals.writeStream.outputMode("complete").foreachBatch(lambda batch, n: out.append(scratch.put(batch))).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return out[-1].select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.col("total").cast("double").alias("total"))
