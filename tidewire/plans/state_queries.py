"""Registered queries of streams, landed files, incremental state and published tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import dedupe, rollups, serve, wire
from tidewire.plans import page_queries, views
from tidewire.plans.queries import ORACLE_SQL, TOTAL, query, r6, stamp
from tidewire.plans.views import with_views
from tidewire.sources import feeds, replies
from tidewire.storage import Scratch, table
from tidewire.streaming import wire as stream

# ---- landed bodies ----

_ADMITTED = "o_orderkey % 10 <> 7 AND o_orderdate >= TIMESTAMP '1992-01-05' AND o_orderdate <= TIMESTAMP '1998-07-02'"
_AS_OF, _DAYS = "1998-07-01", 2369


def _landing(rows):
    """Items as bodies ``(feed_url, value)``, up to some hundred items a body; one in eight also has an error page beside it."""
    item = F.regexp_extract("xml", "^<rss>(.*)</rss>$", 1)
    body = rows.groupBy("feed_url", F.floor(F.col("k") / 400).alias("part")).agg(F.concat(F.lit("<rss>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</rss>")).alias("value"))
    page = F.concat(F.lit("<html><item><title>insurance</title><link>https://x/"), "part", F.lit("</link><published>1998-01-01T00:00:00Z</published></item>"))
    return body.select("feed_url", F.explode(F.when(F.col("part") % 8 == 0, F.array("value", page)).otherwise(F.array("value"))).alias("value"))


def _land(rows, path: str) -> None:
    """Each body as a file of its own, in a folder a feed."""
    writer = _landing(rows).repartition("feed_url", "value").write.mode("append").option("maxRecordsPerFile", 1)
    writer.partitionBy("feed_url").text(path)


def _land_rows(rows, path: str, landed_at: str) -> None:
    """Bodies as rows of two files a task slot and landing: a stream lists and opens each file by itself, so a file a body
    would cost more than the bodies do."""
    dealt = _landing(rows).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "feed_url", "value")
    dealt.withColumn("landed_at", F.lit(landed_at)).write.mode("append").parquet(path)


def _orders_as_bodies(spark, d):
    return page_queries._bodies(spark, d).withColumn("k", F.regexp_extract("xml", r"news\.example\.com/(?:events/)?(\d+)\?", 1).cast("long"))


@query(ORACLE_SQL["feed_articles"])
def payload_articles(spark, d):
    """Bodies landed as files, read whole with their folder's feed; what is no feed is kept apart."""
    path = f"{Scratch(spark, 'landed').root}/bodies"
    _land(_orders_as_bodies(spark, d), path)
    found = feeds.payloads(spark, path)
    got = feeds.read_articles(found.where(feeds.is_feed(F.col("xml"))), page_queries._manifest(spark), F.lit(_AS_OF).cast("timestamp"), days=_DAYS)
    return got.select("link", "title", "source", "summary", F.array_join("tags", "|").alias("tags"), stamp("published_at"))


@query(
    f"SELECT concat('https://news.example.com/', o_orderkey, '?utm=1') AS link, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '2000-01-01' ELSE '2000-02-01' END END AS first_seen, ['Desk Zero', 'Desk One', 'Desk Two', 'Desk Three'][o_orderkey % 4 + 1] AS source FROM orders WHERE {_ADMITTED}"
)
def first_seen_stream(spark, d):
    """Bodies that land in four steps, one of them a repetition: the first arrival of each link is kept in the stream's state,
    links that were there before stay unset."""
    scratch = Scratch(spark, "arrivals")
    path, store = f"{scratch.root}/landed", stream.Store(spark, f"{scratch.root}/store")
    every = scratch.put(_orders_as_bodies(spark, d))
    raw = spark.readStream.schema("feed_url string, value string, landed_at string").parquet(path) if _mkdir(spark, path) else None
    bodies = raw.select("feed_url", F.nullif("landed_at", F.lit("before")).cast("timestamp").alias("landed_at"), F.col("value").alias("xml")).where(feeds.is_feed(F.col("xml")))
    articles = feeds.read_articles(bodies, page_queries._manifest(spark), F.lit(_AS_OF).cast("timestamp"), days=_DAYS, carry=("landed_at",))
    for rows, landed in ((every.where("k % 3 = 0"), "before"), (every.where("k % 2 = 0"), "2000-01-01"), (every, "2000-02-01"), (every.where("k % 2 = 0"), "2000-03-01")):
        _land_rows(rows, path, landed)
        stream.run_arrivals(articles.drop("feed_url", "pos"), store, f"{scratch.root}/state").awaitTermination()
    return store.latest().select("link", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "source")


def _mkdir(spark, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).mkdirs(at)


_FILE = "CAST(floor(date_diff('day', TIMESTAMP '1992-01-01', {t}) / 360.0) AS BIGINT)"


@query(
    "WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders) SELECT concat('Report ', k) AS title, 0 AS years FROM o UNION ALL SELECT concat('Report ', k), 4 FROM o UNION ALL "
    f"SELECT concat('Slow ', k), 0 FROM o WHERE {_FILE.format(t='t')} <> {_FILE.format(t='t + INTERVAL 20 DAY')}"
)
def stream_drop_repeats(spark, d):
    """Ordered files of titles: a title that comes again within 45 days goes, one far beyond stays, rows that are late by up to
    45 days stay, later ones go."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"))
    file = lambda t: F.floor(F.date_diff(t, F.lit("1992-01-01").cast("timestamp")) / 360.0)
    after = lambda n: F.col("t") + F.expr(f"INTERVAL {n} DAYS")

    def rows(title: str, days: int = 0, landed: int = 0, where="true"):
        at = after(days)
        return o.where(where).select(F.concat(F.lit(f"{title} "), "k").alias("title"), at.alias("published_at"), F.lit(days // 365).alias("years"), (file(at) + landed).alias("file"))

    every = rows("Report")
    for n in (30, 45, 1500):
        every = every.union(rows("Report", n))
    every = every.union(rows("Slow", 0, 1, file(F.col("t")) != file(after(20))))  # one file late, by twenty days at most
    every = every.union(rows("Late", 0, 3, "k % 7 = 0"))
    scratch = Scratch(spark, "repeats")
    every = scratch.put(every)
    path, out = f"{scratch.root}/in", f"{scratch.root}/out"
    source = spark.readStream.schema("title string, published_at timestamp, years int").parquet(path) if _mkdir(spark, path) else None
    for i in sorted(r["file"] for r in every.select("file").distinct().collect()):  # a number a year
        every.where(F.col("file") == i).drop("file").write.mode("append").parquet(path)
        stream.drop_repeats(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("title", "years")


# ---- incremental state ----


@query(ORACLE_SQL["two_key_dedupe"])
def two_key_batches(spark, d):
    """The pages of ``two_key_dedupe`` in three batches, each merged into the stored components."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("link"), F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), F.lit("").alias("summary"))
    again = p.where("pos % 3 = 0").select(F.col("pos") + 1000000000, F.concat(F.regexp_replace("link", r"\?.*$", ""), F.lit("?copy=1")), "title", F.lit("again"))
    rows, labels, best = Scratch(spark, "batches").put(p.union(again)), None, None
    for i in (1, 2, 0):
        labels, best = dedupe.two_key_batch(rows.where(F.pmod(F.xxhash64("pos"), F.lit(3)) == i), labels, best)
    return best.select("m.pos", "copies")


_BRIEFS = "b AS (SELECT date_trunc('day', ts) + INTERVAL 8 HOUR AS date, concat('Brief of ', count(*), ' stories') AS headline FROM events WHERE day(ts) % 3 <> 0 GROUP BY 1)"


@query(
    f"WITH {_BRIEFS}, a AS (SELECT DISTINCT date_trunc('hour', ts) AS date FROM events), j AS (SELECT a.date AS at, b.date AS brief, headline, row_number() OVER (PARTITION BY a.date ORDER BY b.date DESC) AS back FROM a JOIN b ON b.date < a.date) "
    "SELECT strftime(j.at, '%Y-%m-%d %H') AS asked, CAST(back AS INTEGER) AS back, strftime(brief, '%Y-%m-%d') AS brief, j.headline, strftime(n.date, '%Y-%m-%d') AS newest FROM j ASOF JOIN b n ON j.at > n.date WHERE back <= 3"
)
def previous_briefs(spark, d):
    """Every hour of the events with the three briefs before it; the newest of them by an as-of join of its own."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    briefs = e.where(F.dayofmonth("ts") % 3 != 0).groupBy((F.date_trunc("day", "ts") + F.expr("INTERVAL 8 HOURS")).alias("date")).agg(F.concat(F.lit("Brief of "), F.count(F.lit(1)), F.lit(" stories")).alias("headline"))
    got = wire.previous_in_time(e.select(F.date_trunc("hour", "ts").alias("date")).distinct(), briefs, 3)
    one = wire.previous_in_time(e.select(F.date_trunc("hour", "ts").alias("date")).distinct(), briefs, 1).select("date", F.col("brief.date").alias("newest"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return got.join(one, "date").select(F.date_format("date", "yyyy-MM-dd HH").alias("asked"), "back", day("brief.date").alias("brief"), "brief.headline", day("newest").alias("newest"))


# ---- links in prose ----

_NAMES = "n AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) - 1 AS i FROM (SELECT DISTINCT p_name AS name FROM part)), c AS (SELECT count(*) AS n FROM n)"
_PARAS = "q AS (SELECT doc_id AS page, CAST(para AS INTEGER) - 1 AS para, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS para FROM documents))"


@query(
    f"WITH {_NAMES}, {_PARAS}, x AS (SELECT q.*, (page + para) % c.n AS i, (page + para + 1) % c.n AS j FROM q, c), y AS (SELECT x.*, a.name AS one, b.name AS two FROM x JOIN n a ON a.i = x.i JOIN n b ON b.i = x.j) "
    "SELECT page, para, CAST(length(line) + 4 AS INTEGER) AS start, CAST(length(line) + 4 + length(one) AS INTEGER) AS end, one AS target FROM y WHERE para = 0 "
    "UNION ALL SELECT page, para, CAST(length(line) + 4 + length(one) + 9 AS INTEGER), CAST(length(line) + 4 + length(one) + 9 + length(two) AS INTEGER), two FROM y WHERE para <= 4"
)
def auto_links(spark, d):
    """Names of parts linked in every paragraph of the documents: a name once a page, two links a paragraph, six a page.
    Paragraphs end with two names, of which the first is the last one's second; inside words and twice a paragraph they are no link."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    scratch = Scratch(spark, "links")
    n = scratch.put(wire.running(names, [F.col("name")], [], scratch, "i"), narrow=True)
    count = n.count()
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("para", "line"))
    keyed = lines.withColumns({"one": F.pmod(F.col("page") + F.col("para"), F.lit(count)) + 1, "two": F.pmod(F.col("page") + F.col("para") + 1, F.lit(count)) + 1})
    a, b = n.select(F.col("i").alias("one"), F.col("name").alias("a")), n.select(F.col("i").alias("two"), F.col("name").alias("b"))
    both = keyed.hint("merge").join(a.hint("merge"), "one").hint("merge").join(b.hint("merge"), "two")
    body = F.concat("line", F.lit(" of "), F.upper("a"), F.lit(" and not "), "b", F.lit(", x"), "b", F.lit(" nor "), "a", F.lit("."))
    return serve.link_spans(both.select("page", "para", body.alias("body")), n.select(F.col("name").alias("term"), F.col("name").alias("target")))


# ---- shapes, maps, grains ----

_REPLY = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('Sure: {\"k\": \"', k, '\"} done') WHEN 2 THEN concat('[', k, ']') WHEN 3 THEN concat('{\"k\": ', k) ELSE concat('{\"k\": ', k, ', \"more\": {\"at\": 1.5}}') END"
_SHAPES = "CASE event_id % 5 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'OBJECT<k: STRING>' WHEN 2 THEN 'ARRAY<BIGINT>' WHEN 4 THEN 'OBJECT<k: BIGINT, more: OBJECT<at: DECIMAL(2,1)>>' END"


@query(
    f"SELECT {_SHAPES} AS shape, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 IN (0, 1, 4) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS k, count(*) FILTER (WHERE event_id % 5 = 4) AS deep FROM events GROUP BY 1"
)
def reply_shapes(spark, d):
    """Replies whose shape nobody knows, read as variants: counted by shape, a field read from every shape that has it."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    read = replies.reply_variants(e.withColumn("reply", F.expr(_REPLY)))
    k, at = F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$.more.at", "double")
    shapes = replies.shape_counts(read)
    sums = read.groupBy("shape").agg(F.sum(k).alias("k"), F.count_if(at == 1.5).alias("deep"))
    return shapes.join(sums, shapes["shape"].eqNullSafe(sums["shape"])).select(shapes["shape"], "n", "k", "deep")


_STORED = "CASE o_orderkey % 4 WHEN 0 THEN concat('Insurer of Co', o_custkey, ' raises $5M') WHEN 1 THEN concat('Software for Co', o_custkey) WHEN 2 THEN concat('Software with cover for Co', o_custkey) ELSE concat('Lettuce recall at Co', o_custkey) END"


@query(
    f"SELECT concat('https://a/', o_orderkey) AS link, {_STORED} AS title, o_orderkey % 2 = 0 AS native, CASE o_orderkey % 4 WHEN 0 THEN 'Funding' ELSE 'Industry' END AS tags, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN o_orderkey % 5 = 0 THEN '2000-01-01 00:00:00' END AS first_seen FROM orders WHERE o_orderkey % 4 IN (0, 2)"
)
def archive_maps(spark, d):
    """An archive written as JSON maps by link and read back: stored labels are made anew, what no longer passes the gate goes."""
    o = table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("https://a/"), "o_orderkey").alias("link"), F.expr(_STORED).alias("title"), F.lit("Desk").alias("source"), F.lit("").alias("summary"), F.array(F.lit("Stale label")).alias("tags"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("2000-01-01").cast("timestamp")).alias("first_seen"), (F.col("o_orderkey") % 2 == 0).alias("native"))
    path = f"{Scratch(spark, 'maps').root}/archive"
    feeds.write_archive_maps(rows, path)
    back = feeds.archive_maps(path, spark)
    return feeds.archive(feeds.archive_or_batch(back, rows.limit(0))).select("link", "title", "native", F.array_join("tags", "|").alias("tags"), stamp("published_at"), stamp("first_seen"))


@query(
    with_views("rounds")
    + f""", g AS (SELECT strftime(published_at, '%Y-%m') AS month, concat(year(published_at), '-q', quarter(published_at)) AS quarter, CAST(year(published_at) AS VARCHAR) AS year, amount_m FROM rounds)
    SELECT CASE WHEN month IS NOT NULL THEN 'month' WHEN quarter IS NOT NULL THEN 'quarter' ELSE 'year' END AS grain, coalesce(month, quarter, year) AS period, count(*) AS rounds, {TOTAL} AS total_m, round(quantile_cont(amount_m, 0.5), 6) AS median_m, max(amount_m) AS largest_m FROM g GROUP BY GROUPING SETS ((month), (quarter), (year)) HAVING count(*) >= 3"""
)
def rounds_by_all_grains(spark, d):
    return rollups.all_grains(views.rounds(spark, d), least=3).withColumn("median_m", r6("median_m"))


# ---- published tables ----


@query("SELECT event_id AS link, strftime(ts, '%Y-%m-%d') AS day, event_type AS title, CASE WHEN day(ts) % 7 = 3 THEN value + 1 ELSE value END AS value, CASE WHEN day(ts) % 7 = 3 THEN 2 ELSE 1 END AS run FROM events")
def published_days(spark, d):
    """A table published twice: the second run, in which the values of some days differ, writes these days only."""
    scratch = Scratch(spark, "published")
    e = table(spark, d, "events").select(F.col("event_id").alias("link"), F.col("ts").cast("timestamp").alias("published_at"), F.col("event_type").alias("title"), "value")
    path = f"{scratch.root}/table"
    wire.publish_days(e, path)
    first = scratch.put(spark.read.parquet(path).select("day", F.col("_metadata.file_path").alias("file")).distinct(), narrow=True)
    wire.publish_days(e.withColumn("value", F.when(F.dayofmonth("published_at") % 7 == 3, F.col("value") + 1).otherwise(F.col("value"))), path)
    now = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    kept = now.join(first.select("file", F.lit(1).alias("run")), "file", "left")
    return kept.select("link", F.date_format("day", "yyyy-MM-dd").alias("day"), "title", "value", F.coalesce("run", F.lit(2)).alias("run"))


@query("SELECT source AS name, 'source' AS kind, CAST(NULL AS BIGINT) AS n FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT lang, 'label', count(*) FROM documents GROUP BY lang UNION ALL SELECT 'articles', 'meta', count(*) FROM documents")
def wire_payload(spark, d):
    """The wire's payload written as tables and read back: outlets, label counts and what the batch is."""
    path = f"{Scratch(spark, 'payload').root}/wire"
    wire.write_payload(views.articles(spark, d).withColumn("tags", F.array("lang")), path, F.lit("2024-01-01").cast("timestamp"))
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    none = F.lit(None).cast("bigint")
    return read("sources").select(F.col("source").alias("name"), F.lit("source").alias("kind"), none.alias("n")).union(read("labels").select("tag", F.lit("label"), "n")).union(read("meta").select(F.lit("articles"), F.lit("meta"), "count"))


@query("SELECT l_suppkey AS slug, CAST(l_orderkey AS VARCHAR) AS value, 'articles' AS list, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT DISTINCT l_suppkey, CAST(l_returnflag AS VARCHAR), 'topics', 1 FROM lineitem")
def index_records(spark, d):
    """Company records written with their lists in parts, read back and unfolded again."""
    li = table(spark, d, "lineitem")
    m = views.mentions(spark, d)
    companies = m.groupBy("slug").agg(F.count(F.lit(1)).alias("stories"), F.max("link").alias("last_seen"))
    topics = li.select(F.col("l_suppkey").alias("slug"), F.col("l_returnflag").alias("tag")).distinct().withColumns({"rank": F.lit(1), "n": F.lit(1)})
    none = m.limit(0).select(F.col("slug").alias("item"), F.col("slug").alias("other"), F.lit(1).alias("rank"), F.lit(1).alias("n"))
    path = f"{Scratch(spark, 'index').root}/index"
    serve.write_index(companies, m, topics, none, path)
    lists = spark.read.schema("slug bigint, list string, part int, entries array<struct<rank:bigint,value:string>>").json(f"{path}/lists")
    return lists.select("slug", "list", F.explode("entries.value").alias("value")).groupBy("slug", "value", "list").agg(F.count(F.lit(1)).alias("n"))
