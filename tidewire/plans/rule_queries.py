"""Registered queries of the rules: gates, labels, names and text forms over headlines built from the tables' own names.

Every query has rows for which its rules say yes and rows for which they say no. Where SQL can run a rule's pattern it
does; looking around is taken out of patterns there (``_plain``), and no headline here depends on it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates, rules, text
from tidewire.operators import deals as deal_ops
from tidewire.operators import entities, rollups, serve, topics, wire
from tidewire.plans import views
from tidewire.plans.queries import STAMP, query, stamp
from tidewire.plans.views import with_views
from tidewire.sources import feeds
from tidewire.storage import Scratch, table

# ---- headlines as columns and as SQL ----


def _plain(pattern: str) -> str:
    """A pattern for engines that cannot look around: negative looks go, positive ones match."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith(("(?!", "(?<!"), i):
            depth, i = 1, i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 1
        else:
            out, i = out + pattern[i], i + 1
    return out.replace("(?=", "(?:")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(sql: str, pattern: str) -> str:
    return f"regexp_matches({sql}, {_quote(_plain(pattern))})"


def _parts(template: str) -> list[str]:
    return re.split(r"\{(\w+)\}", template)


def _title(key: str, templates: list[str]) -> Column:
    """The headline of a row's template; ``{name}`` stands for a column."""
    made = [F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(_parts(t))]) for t in templates]
    return reduce(lambda out, im: out.when(F.col(key) == im[0], im[1]), enumerate(made[1:], 1), F.when(F.col(key) == 0, made[0]))


def _title_sql(key: str, templates: list[str]) -> str:
    made = ["concat(" + ", ".join(p if i % 2 else _quote(p) for i, p in enumerate(_parts(t))) + ")" for t in templates]
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(made)) + " END"


def _orders(spark, d, n: int) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("link"), (F.col("o_orderkey") % n).cast("int").alias("k"), F.concat(F.lit("Zeta"), "o_custkey").alias("name"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("m"), F.col("o_orderdate").cast("timestamp").alias("published_at"))


def _orders_sql(n: int) -> str:
    return f"o AS (SELECT o_orderkey AS link, o_orderkey % {n} AS k, concat('Zeta', o_custkey) AS name, o_orderkey % 90 + 1 AS m, o_orderdate AS published_at FROM orders)"


# ---- gates ----

_TOPICS = ["Insurer {name} opens an office", "Fintech {name} opens an office", "Insurtech {name} launches its app", "Bakery {name} opens an office", "{name} hires underwriters", "{name} likes analytics of policyholders", "Chatbot startup {name}", "The garden of {name}", "{name} partners with a reinsurer"]
_NATIVE, _STRICT = "link % 2 = 0", "link % 3 = 0"
_ON = f"({_hits('title', rules.RELEVANCE)} OR {_hits('title', rules.TECH_CORE)})"
_ADMITS = f"CASE WHEN {_NATIVE} THEN {_ON} ELSE {_hits('title', rules.RELEVANCE)} END"


@query(f"WITH {_orders_sql(9)}, t AS (SELECT *, {_title_sql('k', _TOPICS)} AS title FROM o) SELECT link, {_ON} AS on_topic, {_ADMITS} AS admitted, ({_ADMITS}) AND (NOT ({_STRICT}) OR {_hits('title', rules.TECH_ANGLE)}) AS fed FROM t")
def topic_gate(spark, d):
    """What the gates of feeds and archive let in: insurance, technology in topical feeds, an angle in strict ones."""
    at = _orders(spark, d, 9).withColumn("title", _title("k", _TOPICS))
    t, native, strict = F.col("title"), F.expr(_NATIVE), F.expr(_STRICT)
    return at.select("link", text.on_topic(t).alias("on_topic"), text.admits(native, t).alias("admitted"), text.feed_admits(native, strict, t).alias("fed"))


_FUNDED = ["{name} raises ${m}M", "{name} secures Rs {m}", "Seed for {name}", "{name} gets {m} crore", "{name} bags a stake", "Weather of {name}", "{name} opens {m} offices", "Capital of {name}"]


@query(f"WITH {_orders_sql(8)}, t AS (SELECT *, {_title_sql('k', _FUNDED)} AS title FROM o) SELECT link, {_hits('title', rules.MONEY_HINT)} OR {_hits('title', rules.ROUND_HINT)} AS worth_reading FROM t")
def funding_candidates(spark, d):
    at = _orders(spark, d, 8).withColumn("title", _title("k", _FUNDED))
    return at.select("link", text.funding_candidate(F.col("title")).alias("worth_reading"))


_ROUNDS = [
    "{name} raises ${m}M to insure farms", "{name} insurance market size to reach ${m} billion by 2035", "{name} raises ${m}M insurance seed - CX Tech Forum", "{name} raises $1.2 billion insurance round", "{name} bakery raises ${m}M seed round",
    "Broker {name} lands ${m}M", "{name} insurance could secure ${m}m", "{name} insurer raises $1 billion", "Insurer {name} eyes ${m}M round", "A total of ${m}m was raised across 26 insurance deals", "Insurance for {name}",
]


@query(f"WITH {_orders_sql(11)} SELECT link, CASE k WHEN 7 THEN 1000.0 ELSE CAST(m AS DOUBLE) END AS amount_m, 'rules' AS by FROM o WHERE k IN (0, 5, 7)")
def round_gate(spark, d):
    """Closed rounds of one insurance company up to the cap, out of forecasts, rumours, tallies, old records, larger and other ones."""
    at = _orders(spark, d, 11).withColumn("title", _title("k", _ROUNDS)).withColumns({"summary": F.lit(""), "source": F.lit("Desk")})
    none = spark.createDataFrame([], "link bigint, round boolean, company string, amount_m double, currency string, stage string, lead string")
    return deal_ops.round_rows(at.withColumn("tags", text.labels(F.col("title"))), none).select("link", "amount_m", "by")


_DEALS = [
    "{name} acquires insurer Firm{m} Mutual", "{name} eyes acquisition of insurer Firm{m} Mutual", "{name} acquires 30% stake in insurer Firm{m} Mutual", "{name} acquires majority stake in insurer Firm{m} Mutual", "{name} boosts customer acquisition of insurer Firm{m} Mutual",
    "{name} acquires bakery Firm{m} Mutual", "{name} buys more insurance from Firm{m} Mutual", "Insurer {name} in the news", "Insurer {name} and Firm{m} Mutual merge", "{name} completes acquisition of broker Firm{m} Mutual",
]
_FACTS = "CASE WHEN k = 7 AND link % 3 = 0 THEN concat('Buyer', m) WHEN k = 7 AND link % 3 = 1 THEN 'a local insurer' END"


@query(f"WITH {_orders_sql(10)}, f AS (SELECT *, {_FACTS} AS told FROM o) SELECT link, coalesce(told, name) AS acquirer, concat('Firm', m, ' Mutual') AS target, CASE WHEN k = 3 THEN 'Majority stake' WHEN k = 7 THEN 'Merger' ELSE 'Acquisition' END AS type, CASE WHEN k = 7 THEN 'reader' ELSE 'rules' END AS by FROM f WHERE k IN (0, 3, 9) OR (k = 7 AND link % 3 = 0)")
def deal_gate(spark, d):
    """Changes of control between named parties, out of rumours, minority stakes, other trades and other meanings of the words."""
    at = _orders(spark, d, 10).withColumn("title", _title("k", _DEALS)).withColumns({"summary": F.lit(""), "source": F.lit("Desk")})
    told = at.withColumn("acquirer", F.expr(_FACTS)).where("acquirer is not null")
    none = F.lit(None)
    facts = told.select("link", F.lit(True).alias("deal"), "acquirer", F.concat(F.lit("Firm"), "m", F.lit(" Mutual")).alias("target"), none.cast("string").alias("seller"), F.lit("Merger").alias("type"), none.cast("double").alias("amount_m"), none.cast("string").alias("currency"))
    return deal_ops.deal_rows(at, facts).select("link", "acquirer", "target", "type", "by")


@query(f"WITH {_orders_sql(10)}, t AS (SELECT *, {_title_sql('k', _DEALS)} AS title FROM o) SELECT link, {_hits('title', rules.DEAL_HINT)} AS worth_reading, {' OR '.join(_hits('title', p) for p in rules.DEAL_NOISE)} AS noise, coalesce(CAST(nullif(regexp_extract(title, '([0-9]+)% stake', 1), '') AS DOUBLE) < 50, {_hits('title', rules.MINORITY_STAKE)} AND NOT {_hits('title', rules.CONTROL_STAKE)}) AS minority, {_hits('title', rules.SPECULATIVE)} AS rumour FROM t")
def deal_candidates_read(spark, d):
    at = _orders(spark, d, 10).withColumn("title", _title("k", _DEALS))
    t = F.col("title")
    return at.select("link", text.deal_candidate(t, F.lit("")).alias("worth_reading"), text.deal_noise(t).alias("noise"), text.minority_deal(t).alias("minority"), t.rlike(rules.SPECULATIVE).alias("rumour"))


# ---- labels, sectors, terms, places ----

_LABELLED = [
    "{name} raises ${m}M", "{name} merges with Firm{m}", "{name} teams up with Firm{m}", "{name} unveils version {m}", "{name} asks a chatbot {m} times", "{name} sells at checkout", "{name} hit by ransomware", "{name} on risk assessment",
    "{name} on telehealth", "{name} and robotaxi {m}", "{name} after the flood", "{name} fined {m}", "{name} steps down", "{name} at rest", "{name} launches AI for cyber claims of drivers", "{name} raises ${m}M, names new CEO after lawsuit",
]
_TAGS = "coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN {_hits('title', p)} THEN {_quote(n)} END" for n, p in rules.TAGS) + f"), ''), {_quote(rules.FALLBACK_TAG)})"
_SUBJECT = "CASE split_part(tags, '|', 1) " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in rules.SUBJECTS.items()) + " END"


@query(f"WITH {_orders_sql(16)}, t AS (SELECT link, {_title_sql('k', _LABELLED)} AS title FROM o), g AS (SELECT link, {_TAGS} AS tags FROM t) SELECT link, tags, {_SUBJECT} AS subject FROM g")
def every_label(spark, d):
    """All labels, alone and together, and the fallback."""
    at = _orders(spark, d, 16).withColumn("t", text.labels(_title("k", _LABELLED)))
    return at.select("link", F.array_join("t", "|").alias("tags"), text.subject_of(F.element_at("t", 1)).alias("subject"))


_SOLD = ["Sells " + subject.lower() + " to {name}" for _, subject, *_ in rules.SECTORS] + ["Writes renters, pet, and life insurance for {name}", "Bakes for {name}", "Cyber, marine and travel cover from {name}", "A title for {name}"]
_SECTOR_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN {_hits('said', '(?i)' + p + (f'|(?:{head}){rules.LIST_TAIL}' if head else ''))} THEN {_quote(slug)} END" for slug, _, p, head, _ in rules.SECTORS) + ")"


@query(f"WITH c AS (SELECT c_custkey, c_custkey % {len(_SOLD)} AS k, c_name AS name FROM customer), s AS (SELECT c_custkey, {_title_sql('k', _SOLD)} AS said FROM c) SELECT c_custkey, {_SECTOR_SQL} AS sectors FROM s")
def every_sector(spark, d):
    """All sectors, named directly and inside enumerations, and none."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % len(_SOLD)).cast("int").alias("k"), F.col("c_name").alias("name"))
    return c.select("c_custkey", F.array_join(text.sectors_of(_title("k", _SOLD)), "|").alias("sectors"))


_PLACES = [(a, c) for c, names in rules.COUNTRY_ALIASES.items() for a in names] + [(s, "United States") for s in rules.US_STATES]
_PLACES = [(a, c) for a, c in _PLACES if not a.endswith(".")] + [("Bermuda", "Bermuda"), ("Kenya.", "Kenya")] + [(n, None) for n in rules.NO_COUNTRY]


@query(
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quote(a)}, {_quote(c) if c else 'NULL'})" for i, (a, c) in enumerate(_PLACES)) + ") AS v(k, alias, country)) "
    f"SELECT c_custkey, country, CASE WHEN c_custkey % 2 = 0 THEN concat('Town', c_custkey) ELSE '' END AS city FROM customer JOIN p ON p.k = c_custkey % {len(_PLACES)}"
)
def every_place(spark, d):
    """Countries under all their names, states, regions that are no country; cities before them or none."""
    c = table(spark, d, "customer").withColumn("k", (F.col("c_custkey") % len(_PLACES)).cast("int"))
    alias = F.element_at(F.array(*[F.lit(a) for a, _ in _PLACES]), F.col("k") + 1)
    place = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Town"), "c_custkey", F.lit(", "), alias)).otherwise(alias)
    return c.select("c_custkey", text.country_of(place).alias("country"), text.city_of(place).alias("city"))


_TERM_WORDS = ["MGA", "Reinsurer", "Parametric cover", "Brokers", "Fraud", "Takaful", "Cat bonds", "Annuities", "Micro-insurance", "The protection gap", "Surplus lines", "Workers' comp", "Telematics", "Bancassurance", "Premium finance", "Marine cargo", "Captives", "Crop insurance", "Trade credit insurance", "D&O", "E&O", "Title insurance", "A TPA", "Stop-loss", "Fronting", "Surety", "Extended warranty", "GAP insurance"]
_TERMED = [w + " for {name}" for w in _TERM_WORDS] + ["Nothing for {name}", "Fraud and surety at {name}"]
_TERM_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_hits('title', p)} THEN {_quote(s)} END" for s, p, _ in rules.TERMS) + "], lambda v: v IS NOT NULL)"


@query(f"WITH {_orders_sql(len(_TERMED))}, t AS (SELECT link, published_at, {_title_sql('k', _TERMED)} AS title FROM o), u AS (SELECT link, published_at, unnest({_TERM_LIST}) AS term FROM t) SELECT term, count(*) AS stories, {STAMP('min(published_at)')} AS first_at, {STAMP('max(published_at)')} AS last_at, count(*) >= 60 AS indexable FROM u GROUP BY term")
def own_terms(spark, d):
    """The library's own glossary over headlines that name each term at least once."""
    at = _orders(spark, d, len(_TERMED)).withColumn("title", _title("k", _TERMED))
    return topics.term_rollup(topics.term_stories(at), least=60).withColumns({"first_at": stamp("first_at"), "last_at": stamp("last_at")})


# ---- names ----

_N = "{big}"
_NAMED = [_N + " raises $5M", "Report: " + _N + " Holdings, again", "News about " + _N + " today", "Insurers like " + _N, "Bank taps " + _N, "AXQ and " + _N + " team", "How " + _N + " & Sons launches", "Insurtech PolicyBox{p} In Europe", _N + " joins " + _N + "Corp", "ROI of {p}", _N + " Labs ABC acquires", "the {p} of it"]
_NAMES = ["{big}", "{big} Holdings", "", "", "Bank|{big}", "AXQ|{big}", "{big} & Sons", "PolicyBox{p}", "{big}|{big}Corp", "", "{big} Labs", ""]


@query(f"WITH q AS (SELECT p_partkey AS p, p_partkey % 12 AS k, concat('Qua', CAST(p_partkey AS VARCHAR), ' ', upper(p_name[1]), split_part(p_name, ' ', 1)[2:], 'er') AS big FROM part) SELECT p, {_title_sql('k', _NAMES)} AS names FROM q")
def name_marks(spark, d):
    """What makes a run of words a company: an action before or behind it, its last word, a capital inside, an acronym."""
    first = F.element_at(F.split("p_name", " "), 1)
    big = F.concat(F.lit("Qua"), "p_partkey", F.lit(" "), F.upper(F.left(first, F.lit(1))), F.substring(first, 2, 100), F.lit("er"))
    at = table(spark, d, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") % 12).cast("int").alias("k"), big.alias("big"))
    return at.select("p", F.array_join(entities.company_names(_title("k", _NAMED)), "|").alias("names"))


_ALIASED = ["Zeta{m} Co", "ZETA{m}", "Zeta{m} of London", "Other{m}"]


@query(
    f"WITH {_orders_sql(4)} SELECT link, CASE WHEN k = 3 THEN concat('Other', m) WHEN link % 3 = 0 THEN concat('Zeta ', m, ' Health') WHEN link % 3 = 1 THEN concat('Zeta ', m, ' Auto') ELSE concat('Zeta ', m) END AS name FROM o"
)
def canonical_names(spark, d):
    """Aliases folded into one name, and that name split by what the headline says, the first fitting rule first."""
    at = _orders(spark, d, 4)
    said = F.when(F.col("link") % 3 == 0, F.lit("about health and cars")).when(F.col("link") % 3 == 1, F.lit("about cars")).otherwise(F.lit("about homes"))
    m = at.select("link", _title("k", _ALIASED).alias("name"), said.alias("title"))
    names = at.select("m").distinct()
    one = F.concat(F.lit("Zeta "), "m")
    aliases = names.select(F.explode(F.array(F.concat(F.lit("zeta"), "m"), F.concat(F.lit("zeta"), "m", F.lit("-of-london")))).alias("alias_slug"), one.alias("canonical"))
    rule = F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("(?i)health").alias("pattern"), F.lit(" Health").alias("to")), F.struct(F.lit(2).alias("ord"), F.lit("(?i)cars").alias("pattern"), F.lit(" Auto").alias("to"))))
    splits = names.select(F.concat(F.lit("zeta-"), "m").alias("slug"), one.alias("one"), rule.alias("r")).select("slug", "r.ord", "r.pattern", F.concat("one", "r.to").alias("new_name"))
    scratch = Scratch(spark, "names")
    return entities.canonical(m, scratch.put(aliases, narrow=True), scratch.put(splits, narrow=True)).select("link", "name")


_PRINTED = ["{name} raises ${m}M", "How the market of {name} and all its many friends raises ${m}M", "{name} expands, raises ${m}M", "Quiet day"]


@query(f"WITH {_orders_sql(4)} SELECT link, CASE WHEN link % 5 = 0 THEN concat('Reader Co', m) WHEN k = 0 THEN name ELSE '' END AS printed, link % 3 = 1 AS seller FROM o")
def printed_names(spark, d):
    """A company to print where none is linked, and whether a deal's seller is worth naming beside its target."""
    at = _orders(spark, d, 4).withColumn("title", _title("k", _PRINTED))
    raiser = F.when(F.col("link") % 5 == 0, F.concat(F.lit("Reader Co"), "m")).when(F.col("link") % 5 == 1, F.lit("the startup that expands into everything it can find")).otherwise("")
    seller = F.when(F.col("link") % 3 == 0, F.concat("name", F.lit(" Group"))).when(F.col("link") % 3 == 1, F.lit("Old Owner")).otherwise("")
    return at.select("link", entities.unlinked_company(raiser, F.col("title")).alias("printed"), text.seller_worth_naming(seller, F.concat("name", F.lit(" Ltd"))).alias("seller"))


@query("SELECT DISTINCT p_name AS name, length(p_name) >= 3 AND split_part(p_name, ' ', 2) NOT IN ('ring', 'rod') AS whole, split_part(p_name, ' ', 2) IN ('widget') OR (length(split_part(p_name, ' ', 2)) >= 6) AS word FROM part")
def linkable_names(spark, d):
    """Names that may be linked in prose: not the ambiguous ones, no short lower-case words."""
    p = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    ambiguous = [f"{a} {b}" for a in ("red", "cold", "small", "hot", "old", "blue", "large", "new") for b in ("ring", "rod")]
    word = F.element_at(F.split("name", " "), 2)
    long = F.length("name") >= 6
    return p.select("name", F.when(long, entities.linkable(F.col("name"), ambiguous)).otherwise(entities.linkable(F.initcap("name"), ambiguous)).alias("whole"), entities.linkable(word, []).alias("word"))


_PARTY = ["{name} Holdings Ltd", "The {name} Group", "{name} and Firm{m}", "Firm{m} & {name}", "{name} Insurance Solutions", "X1", "Firm{m} Marine Brokers"]
_FORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'), {noise}, ' ', 'g'), '\\s+', ' ', 'g'))"
_NOISE = _quote(rules.PARTY_NOISE)
_WORDS = "list_sort(list_filter(string_split(" + _FORM.format(c="party", noise=_NOISE) + ", ' '), lambda w: length(w) > 3 AND NOT list_contains([" + ", ".join(map(_quote, rules.TARGET_NOISE)) + "], w)))"
_SET = "list_sort(list_distinct(list_filter(list_transform(string_split_regex(party, '(?i)\\s*(?:,|;|\\band\\b|&|\\+)\\s*'), lambda x: " + _FORM.format(c="x", noise=_NOISE) + "), lambda p: length(p) >= 4)))"


@query(f"WITH {_orders_sql(7)}, t AS (SELECT link, name, {_title_sql('k', _PARTY)} AS party FROM o) SELECT link, {_FORM.format(c='party', noise=_NOISE)} AS form, array_to_string({_WORDS}, '|') AS words, array_to_string({_SET}, '|') AS parties, list_contains({_WORDS}, lower(name)) OR contains({_FORM.format(c='party', noise=_NOISE)}, lower(name)) AS like_name FROM t")
def party_forms(spark, d):
    """Comparable forms, distinctive words and parties of names, and whether they may be the same target as a plain name."""
    at = _orders(spark, d, 7).withColumn("party", _title("k", _PARTY))
    p = F.col("party")
    return at.select("link", text.party_form(p).alias("form"), F.array_join(F.array_sort(text.target_words(p)), "|").alias("words"), F.array_join(text.party_set(p), "|").alias("parties"), text.same_target(p, F.col("name")).alias("like_name"))


# ---- forms of text ----

_RAW = ["{name} opens an office in a large town - Desk Wire", "{name} opens an office - Desk Wire", "{name} opens an office in a very large town - Other Paper", "{name} opens an office in a very large town - Is it so?", "{name} - b"]
_SEARCH = "link % 2 = 0"
_DASH = "(length(title) - strpos(reverse(title), ' - ') - 1)"
_OWN = f"(strpos(title, ' - ') > 0 AND substr(title, {_DASH} + 3) = 'Desk Wire' AND {_DASH} - 1 > 20)"
_OTHER = f"(strpos(title, ' - ') > 0 AND {_SEARCH} AND {_DASH} - 1 > 30 AND length(substr(title, {_DASH} + 3)) < 40 AND NOT regexp_matches(title, '[.!?]$'))"
_HEADLINE = f"CASE WHEN {_OWN} OR {_OTHER} THEN trim(substr(title, 1, {_DASH} - 1)) ELSE title END"
_SUMMED = ["{name} opens an office in a large town", "All about {name}", "{name} opens an office in a very large town, which has long been wanted by everybody who lives there"]
_NORM = "regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
_ECHO = f"length({_NORM.format(c='headline')}) > 0 AND starts_with({_NORM.format(c='summary')}, substr({_NORM.format(c='headline')}, 1, 24)) AND length({_NORM.format(c='summary')}) <= length({_NORM.format(c='headline')}) + 40"


@query(f"WITH {_orders_sql(15)}, t AS (SELECT link, {_title_sql('(k % 5)', _RAW)} AS title, {_title_sql('(k % 3)', _SUMMED)} AS summary FROM o), h AS (SELECT *, {_HEADLINE} AS headline, CASE WHEN NOT {_OWN} AND {_OTHER} THEN trim(substr(title, {_DASH} + 3)) ELSE 'Desk Wire' END AS source FROM t) SELECT link, headline, source, CASE WHEN {_ECHO} THEN '' ELSE summary END AS summary FROM h")
def publisher_split(spark, d):
    """Publishers cut off headlines, the feed's own and, from search feeds, others'; summaries that only echo the headline go."""
    at = _orders(spark, d, 15).withColumns({"a": F.col("k") % 5, "b": F.col("k") % 3})
    at = at.select("link", _title("a", _RAW).alias("title"), _title("b", _SUMMED).alias("summary"))
    title, source = text.split_publisher(F.col("title"), F.lit("Desk Wire"), F.expr(_SEARCH))
    cut = at.select("link", title.alias("headline"), source.alias("source"), "summary")
    return cut.withColumn("summary", text.drop_echo(F.col("summary"), F.col("headline")))


_LINE = "coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')[1], '')"
_CUT = "regexp_replace(regexp_replace(substr(line, 1, 80), '\\s+\\S*$', ''), '[,;:—–-]$', '')"


@query(f"WITH l AS (SELECT doc_id, {_LINE} AS line FROM documents), s AS (SELECT *, regexp_extract(line, '(?s)^(.*?[.!?])(?:\\s|$)', 1) AS lead FROM l) SELECT doc_id, CASE WHEN length(line) <= 80 THEN line ELSE concat({_CUT}, '…') END AS short, CASE WHEN length(lead) BETWEEN 60 AND 158 THEN lead ELSE line END AS sentence, regexp_matches(line, {_quote(rules.NO_REUSE)}) AS closed FROM s")
def prose_forms(spark, d):
    """First lines cut at a word, first sentences of a fitting length, and notices against reuse."""
    line = F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != ""), F.lit(1)), F.lit(""))
    at = table(spark, d, "documents").select("doc_id", line.alias("line"))
    return at.select("doc_id", text.clamp(F.col("line"), 80).alias("short"), text.first_sentence(F.col("line")).alias("sentence"), F.col("line").rlike(rules.NO_REUSE).alias("closed"))


@query(f"WITH {_orders_sql(4)} SELECT link, CASE WHEN k = 3 THEN '' ELSE concat(name, ' & Co sells more.') END AS tidy FROM o")
def tidy_summaries(spark, d):
    """Summaries without trailers; none where the outlet forbids reuse."""
    ends = ["", " The post X appeared first on Y.", " Read more at Z", " All rights reserved"]
    at = _orders(spark, d, 4).withColumn("s", _title("k", ["{name} &amp; Co   sells more." + e for e in ends]))
    return at.select("link", text.tidy_summary(text.strip_tags(F.col("s"))).alias("tidy"))


@query("SELECT p_partkey, concat(chr(CAST(65 + p_partkey % 26 AS INTEGER)), ' é ', p_name, ' ', chr(128512), CASE WHEN p_partkey % 2 = 0 THEN ' &#; &#xZZ;' ELSE ' ' || chr(65533) END) AS text FROM part")
def numeric_entities(spark, d):
    """Decimal and hexadecimal character references; broken ones stay, impossible ones become the replacement mark."""
    p = table(spark, d, "part")
    code = (F.col("p_partkey") % 26 + 65).cast("int")
    said = F.concat(F.lit("&#"), code, F.lit("; &#xe9; "), "p_name", F.lit(" &#x1F600; "), F.when(F.col("p_partkey") % 2 == 0, "&#; &#xZZ;").otherwise("&#xD800;"))
    return p.select("p_partkey", text.decode_entities(said).alias("text"))


# ---- windows, grids, fallbacks ----


@query("SELECT strftime(m, '%Y-%m-%d') AS after, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d') AS before, count(o_orderkey) AS stories FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN orders ON o_orderdate >= m AND o_orderdate < m + INTERVAL 1 MONTH GROUP BY m")
def backfill_windows(spark, d):
    """Two years of calendar months back from a day, with the stories that fall into each."""
    w = Scratch(spark, "windows").put(dates.month_windows(spark, "1997-12-15", 24))
    o = table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("after"), "o_orderkey").groupBy("after").agg(F.count("o_orderkey").alias("n"))
    got = w.join(o, "after", "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select(day("after"), day("before"), F.coalesce("n", F.lit(0)).alias("stories"))


@query("SELECT s_suppkey, concat('https://news.example.com/search?hl=en&q=insurer', s_suppkey, '%20after%3A', strftime(m, '%Y-%m-%d'), '%20before%3A', strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d'), '&gl=US') AS dated_url FROM supplier, (SELECT unnest([DATE '2024-02-01', DATE '2024-01-01', DATE '2023-12-01']) AS m) WHERE s_suppkey % 3 <> 0")
def dated_queries(spark, d):
    """Every search feed in every window, the dates in its query; other feeds are not asked again."""
    s = table(spark, d, "supplier")
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://feeds.example.com/"), "s_suppkey")).otherwise(F.concat(F.lit("https://news.example.com/search?hl=en&q=insurer"), "s_suppkey", F.lit("&gl=US")))
    return feeds.query_grid(s.select("s_suppkey", url.alias("feed_url")), dates.month_windows(spark, "2024-02-20", 3)).select("s_suppkey", "dated_url")


@query("SELECT o_orderkey AS link, 'batch' AS origin, 0 AS verdicts FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'archive', CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END FROM orders")
def archive_fallback(spark, d):
    """The batch while there is no archive, the archive afterwards; verdicts from a table that may not have been written yet."""
    scratch = Scratch(spark, "fallback")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"))
    schema, path = "link bigint, pv int", f"{scratch.root}/verdicts"
    out = []
    for origin, stored in (("batch", o.limit(0)), ("archive", o)):
        verdicts = feeds.or_empty(spark, path, schema)
        rows = feeds.archive_or_batch(stored, o.where("link % 2 = 0"))
        out.append(scratch.put(rows.join(verdicts.hint("shuffle_hash"), "link", "left").select("link", F.lit(origin).alias("origin"), F.coalesce("pv", F.lit(0)).alias("verdicts"))))
        o.where("link % 5 = 0").withColumn("pv", F.lit(1)).write.mode("overwrite").parquet(path)
    return out[0].union(out[1])


# ---- briefs, threads, index ----

_S = with_views("articles") + ", s AS (SELECT *, CAST(n_chars % 97 AS DOUBLE) AS score, concat(source, lang) AS thread FROM articles)"
_HEADS = "h AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY score DESC, published_at DESC, pos) AS r FROM w), g AS (SELECT thread, min(pos) AS pos, count(*) AS stories, count(DISTINCT source) AS outlets FROM w GROUP BY thread)"


def _scored(spark, d) -> DataFrame:
    return views.articles(spark, d).withColumns({"score": (F.col("n_chars") % 97).cast("double"), "thread": F.concat("source", "lang")})


@query(_S + f", a AS (SELECT max(published_at) + INTERVAL 10 HOUR AS now FROM s), w AS (SELECT s.* FROM s, a WHERE (epoch(now) - epoch(published_at)) / 3600 <= (SELECT CASE WHEN count(*) FILTER (WHERE (epoch(now) - epoch(published_at)) / 3600 <= 24) >= 20 THEN 24 WHEN count(*) FILTER (WHERE (epoch(now) - epoch(published_at)) / 3600 <= 48) >= 20 THEN 48 ELSE 72 END FROM s, a)), {_HEADS} SELECT g.thread, h.link AS head, h.score FROM g JOIN h ON g.thread = h.thread AND r = 1 ORDER BY h.score DESC, g.pos LIMIT 20")
def top_headlines(spark, d):
    """The best threads of the first window with enough stories."""
    a = _scored(spark, d)
    now = a.agg((F.max("published_at") + F.expr("interval 10 hours")).alias("as_of"))
    return wire.top_headlines(a.join(F.broadcast(now), F.lit(True)), F.col("as_of"), 20).select("thread", "head", "score")


@query("WITH w AS (SELECT o_custkey AS thread, o_orderkey % 7 AS source FROM orders WHERE o_orderkey % 3 <> 0), g AS (SELECT thread, count(*) AS n, count(DISTINCT source) AS s FROM w GROUP BY 1) SELECT CAST(thread AS VARCHAR) AS thread, CASE WHEN n = 1 THEN '' WHEN n = s AND n = 2 THEN '+1 more outlet' WHEN n = s THEN concat('+', n - 1, ' more outlets') WHEN n = 2 THEN '+1 more story' ELSE concat('+', n - 1, ' more stories') END AS label FROM g")
def thread_labels(spark, d):
    """What a folded thread says about the stories behind its head."""
    o = table(spark, d, "orders").where("o_orderkey % 3 <> 0")
    rows = o.select(F.col("o_orderkey").alias("link"), F.lit("t").alias("title"), F.col("o_custkey").alias("thread"), F.concat(F.lit("s"), F.col("o_orderkey") % 7).alias("source"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.lit(1.0).alias("score"), F.col("o_orderkey").alias("pos"))
    return wire.fold_threads(rows).select("thread", "label")


_BRIEF = _S + ", n AS (SELECT count(*) AS n FROM s), l AS (SELECT lang AS name, CAST(count(*) AS DOUBLE) AS value FROM s WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) >= greatest(3.0, (SELECT n FROM n) * 0.08)), m AS (SELECT count(*) AS k, CAST(sum(CAST(o_totalprice / 1000 AS DECIMAL(18,6))) AS DOUBLE) AS v FROM orders WHERE o_totalprice / 1000 >= 400)"


@query(_BRIEF + ", w AS (SELECT * FROM s), " + _HEADS + ", b AS (SELECT h.title AS name, CAST(outlets AS DOUBLE) AS value FROM g JOIN h ON g.thread = h.thread AND r = 1 ORDER BY outlets DESC, h.score DESC, g.pos LIMIT 1) SELECT 'label' AS kind, name, value FROM l UNION ALL SELECT 'funding', CAST(k AS VARCHAR), v FROM m WHERE k >= 2 UNION ALL SELECT 'story', name, value FROM b")
def brief_inputs(spark, d):
    """What a brief is written from: prominent labels, disclosed capital, the story most outlets cover."""
    a = _scored(spark, d).withColumn("tags", F.array_compact(F.array("lang")))
    return wire.brief_inputs(a, views.rounds(spark, d), least_m=400.0)


@query("SELECT concat('by:', CASE WHEN o_orderkey % 4 = 0 THEN 'reader' ELSE 'rules' END) AS measure, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_orderkey % 6 = 5 UNION ALL SELECT 'demoted', count(*) FROM customer WHERE c_acctbal < 0")
def index_summary(spark, d):
    """How the index came about: names by their reader, stories without any accepted name, companies demoted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.when(F.col("o_orderkey") % 4 == 0, "reader").otherwise("rules").alias("by"))
    return rollups.index_summary(o, o.where("link % 6 <> 5"), table(spark, d, "customer").where("c_acctbal < 0"))


_KINDS = {"company": 0.6, "market": 0.7, "sector": 0.7, "topic": 0.6, "term": 0.5, "month": 0.5, "quarter": 0.5, "year": 0.6, "brief": 0.4}


@query(
    "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, concat(year(o_orderdate), '-q', quarter(o_orderdate)) AS q, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderdate AS seen FROM orders), u AS (SELECT 'company' AS kind, CAST(o_custkey AS VARCHAR) AS slug, max(o_orderdate) AS seen FROM orders GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'market', lower(replace(n_name, '_', '-')), max(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 "
    "UNION ALL SELECT 'sector', lower(c_mktsegment), max(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'topic', regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g'), max(ts) FROM events GROUP BY 2 UNION ALL SELECT 'term', replace(p_name, ' ', '-'), NULL FROM part GROUP BY p_name HAVING count(*) >= 3 "
    "UNION ALL SELECT 'month', m, max(seen) FROM o GROUP BY m HAVING count(*) >= 5 UNION ALL SELECT 'quarter', q, max(seen) FROM o GROUP BY q UNION ALL SELECT 'year', y, max(seen) FROM o GROUP BY y UNION ALL SELECT 'brief', strftime(ts, '%Y-%m-%d'), max(ts) FROM events GROUP BY 2) "
    "SELECT concat('/', kind, '/', slug, '/') AS url, kind, strftime(seen, '%Y-%m-%d') AS lastmod, CAST(CASE kind " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in _KINDS.items()) + " END AS DOUBLE) AS priority FROM u"
)
def url_kinds(spark, d):
    """The addresses of all page kinds, each with its floor and the day of its newest row."""
    o, c, n = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), table(spark, d, "customer"), table(spark, d, "nation")
    who = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    newest = lambda df, slug, least=1: df.groupBy(slug.alias("slug")).agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("slug", F.date_format("at", "yyyy-MM-dd").alias("lastmod"))
    key = lambda grain: dates.KEYS[grain](F.col("at"))
    terms = table(spark, d, "part").withColumn("at", F.lit(None).cast("timestamp"))
    pages = {
        "company": newest(o, F.col("o_custkey").cast("string"), 3), "market": newest(who, text.url_slug(F.col("n_name"))), "sector": newest(who, text.url_slug(F.col("c_mktsegment"))), "topic": newest(e, text.url_slug(F.col("event_type"))),
        "term": newest(terms, text.url_slug(F.col("p_name")), 3), "month": newest(o, key("month"), 5), "quarter": newest(o, key("quarter")), "year": newest(o, key("year")), "brief": newest(e, F.date_format("at", "yyyy-MM-dd")),
    }
    return serve.url_table({k: (df, f"/{k}/", _KINDS[k], "weekly") for k, df in pages.items()}).select("url", "kind", "lastmod", "priority")
