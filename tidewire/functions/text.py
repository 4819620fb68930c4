"""Column expressions over headlines, summaries and names."""

from __future__ import annotations

import re
import re._constants as sre
from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tidewire.functions import rules

def body(title: Column, summary: Column) -> Column:
    """Title and summary as one text; nulls are empty."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))


def any_of(text: Column, patterns: list[str]) -> Column:
    """True where one of the patterns matches."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


# ---- markup and summaries ----


@F.pandas_udf(StringType())
def _numeric_entities(s: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"

    return s.str.replace(r"&#(?:x([0-9a-fA-F]{1,6})|([0-9]{1,7}));", one, regex=True)


def decode_entities(s: Column, numeric: bool = True) -> Column:
    """CDATA unwrapped, character references decoded, ``&amp;`` last. ``numeric=False`` stays in the JVM."""
    s = F.regexp_replace(s, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    s = _numeric_entities(s) if numeric else s
    for name, char in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return s


def squeeze(s: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_tags(s: Column, numeric: bool = True) -> Column:
    """Decoded (escaped markup becomes markup), tags out, decoded again, squeezed."""
    return squeeze(decode_entities(F.regexp_replace(decode_entities(s, numeric), r"<[^>]*>", " "), numeric))


def clamp(s: Column, n: int, reserve: int = 0) -> Column:
    """Texts of more than ``n`` characters cut at a word boundary with an ellipsis."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(s, 1, n - reserve), r"\s+\S*$", ""), r"[,;:—–-]$", "")
    return F.when(F.length(s) <= n, s).otherwise(F.concat(cut, F.lit("…")))


def tidy_summary(s: Column, n: int = 220) -> Column:
    """Without trailers, at most ``n`` characters; empty where the outlet forbids reuse."""

    def less(s: Column, pattern: str) -> Column:
        return let(s, lambda x: F.when(_has(F.lower(x), list(marks_of(pattern))), F.regexp_replace(x, pattern, "")).otherwise(x))

    def tidied(s: Column) -> Column:
        out = less(squeeze(s), r"(?is)\s*The post\b.*?appeared first on.*$")
        out = less(out, r"(?is)\s*(?:Continue reading|Read more)\b.*$")
        return let(F.trim(less(out, r"\s*\[(?:…|\.\.\.)\]\s*$")), lambda x: clamp(x, n))

    return let(s, lambda x: F.when(_matches(x, F.lower(x), rules.NO_REUSE), F.lit("")).otherwise(tidied(x)))


def split_publisher(title: Column, source: Column, search_feed: Column) -> tuple[Column, Column]:
    """(headline, source): a trailing `` - Publisher`` cut off, and for search feeds taken as the source."""
    dash = F.length(title) - F.locate(" - ", F.reverse(title)) - 1  # where the last " - " begins, from 1
    has = F.locate(" - ", F.reverse(title)) > 0
    head, tail = F.substring(title, F.lit(1), dash - 1), F.substring(title, dash + 3, F.length(title))
    own = has & (tail == source) & (dash - 1 > 20)
    other = has & search_feed & (dash - 1 > 30) & (F.length(tail) < 40) & ~tail.rlike(r"[.!?]$")
    return F.when(own | other, F.trim(head)).otherwise(title), F.when(~own & other, F.trim(tail)).otherwise(source)


def drop_echo(summary: Column, title: Column) -> Column:
    """Empty where the summary only repeats the headline."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
    s, t = norm(summary), norm(title)
    echo = (F.length(t) > 0) & s.startswith(F.substring(t, 1, 24)) & (F.length(s) <= F.length(t) + 40)
    return F.when(echo, F.lit("")).otherwise(summary)


def title_key(title: Column) -> Column:
    """Loose key: look-alike letters folded, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(title), "ilo", "110"), r"[^a-z0-9]+", "")


def link_key(link: Column) -> Column:
    """Address without its query, in lower case."""
    return F.lower(F.regexp_replace(link, r"(?s)\?.*$", ""))


def url_slug(name: Column) -> Column:
    """Lower case, ``&`` as and, anything else than letters and digits as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def company_slug(name: Column) -> Column:
    """Slug of a company name without trailing legal suffixes (one token stays)."""
    legal = "|".join(rules.LEGAL_SUFFIXES)
    toks = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9 ]+", " "), r"\s+", " "))
    return F.replace(F.regexp_replace(toks, rf"(?<=\S)(?: (?:{legal}))+$", ""), F.lit(" "), F.lit("-"))


def first_sentence(s: Column, low: int = 60, high: int = 158) -> Column:
    """The leading sentence where it has a fitting length, else the whole text."""
    lead = F.regexp_extract(s, r"(?s)^(.*?[.!?])(?=\s|$)", 1)
    return F.when(F.length(lead).between(low, high), lead).otherwise(s)


def oxford(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


# ---- labels ----


@lru_cache(maxsize=None)
def marks_of(pattern: str) -> tuple[str, ...]:
    """Words in lower case of which a text has one if the pattern matches it; empty where the pattern asks for none.

    Read off the parsed pattern: of a sequence the best literal, of alternatives one of each; what may be left out, other
    than ASCII or looked around for asks for nothing.
    """

    def better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b, key=lambda x: (min(3, *map(len, x)), -len(x), min(map(len, x))))

    def needed(parts) -> frozenset | None:
        best, run = None, ""
        for op, arg in [*parts, (None, None)]:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            best, run = better(best, frozenset([run])) if run else best, ""
            if op is sre.SUBPATTERN:
                best = better(best, needed(arg[3]))
            elif op is sre.BRANCH:
                each = [needed(x) for x in arg[1]]
                best = best if None in each else better(best, frozenset().union(*each))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                best = better(best, needed(arg[2]))
        return best

    try:
        found = needed(re._parser.parse(pattern)) or ()
    except re.error:  # not a pattern of Python's
        found = ()
    return tuple(sorted(m for m in found if not any(x != m and x in m for x in found)))


def _matches(text: Column, low: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``, tried where a word it needs is there, unless it is such a word itself."""
    marks = list(marks_of(pattern))
    return text.rlike(pattern) if marks in ([], [pattern]) else _has(low, marks) & text.rlike(pattern)


def labels(text: Column, table: list[tuple[str, str]] | None = None, fallback: str | None = rules.FALLBACK_TAG) -> Column:
    """All labels whose pattern matches, in table order; ``[fallback]`` where none does. A pattern is tried where a word it
    needs is there."""
    table = rules.TAGS if table is None else table
    both = F.struct(text.alias("t"), F.lower(text).alias("low"))
    hit = let(both, lambda b: F.filter(F.array(*[F.when(_matches(b["t"], b["low"], p), F.lit(name)) for name, p in table]), lambda x: x.isNotNull()))
    return let(hit, lambda h: F.when(F.size(h) == 0, F.array(F.lit(fallback))).otherwise(h)) if fallback else hit


def first_label(text: Column, table: list[tuple[str, str]], default: str = "") -> Column:
    """The first label whose pattern matches."""
    out = None
    for name, p in table:
        out = F.when(text.rlike(p), name) if out is None else out.when(text.rlike(p), name)
    return out.otherwise(default)


def stage_of(text: Column) -> Column:
    """Stage of a round, empty where none is named."""
    return first_label(text, rules.STAGES)


def deal_type(text: Column) -> Column:
    """Kind of a deal; a pattern is tried where a word it needs is there."""
    low, out = F.lower(text), F
    for (name, p), marks in zip(rules.DEAL_TYPES, rules.DEAL_TYPE_MARKS, strict=True):
        out = out.when(_has(low, marks) & text.rlike(p), name)
    return out.otherwise("Acquisition")


def subject_of(label: Column) -> Column:
    """What a label is about; unknown labels stand for themselves."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in rules.SUBJECTS.items() for x in kv])[label], label)


def sectors_of(summary: Column) -> Column:
    """Slugs of the sectors named directly or inside an enumeration that ends in an insurance noun."""
    table = [(slug, f"(?i){p}" + (f"|(?:{head}){rules.LIST_TAIL}" if head else "")) for slug, _, p, head, _ in rules.SECTORS]
    return labels(F.coalesce(summary, F.lit("")), table, fallback=None)


def terms_of(title: Column) -> Column:
    """Slugs of the glossary terms in a headline."""
    return labels(F.coalesce(title, F.lit("")), [(slug, p) for slug, p, _ in rules.TERMS], fallback=None)


# ---- gates ----


def on_topic(text: Column) -> Column:
    """Insurance, or technology proper."""
    return text.rlike(rules.RELEVANCE) | text.rlike(rules.TECH_CORE)


def admits(native: Column, text: Column) -> Column:
    """Gate of the archive: topical feeds may be about technology alone."""
    return F.when(F.coalesce(native, F.lit(False)), on_topic(text)).otherwise(text.rlike(rules.RELEVANCE))


def feed_admits(native: Column, strict: Column, text: Column) -> Column:
    """Gate of a feed: strict feeds also need a technology angle."""
    return admits(native, text) & (~F.coalesce(strict, F.lit(False)) | text.rlike(rules.TECH_ANGLE))


def funding_candidate(text: Column) -> Column:
    """Worth reading as a round: money or round vocabulary."""
    return text.rlike(rules.MONEY_HINT) | text.rlike(rules.ROUND_HINT)


def round_noise(title: Column, literal: bool = False) -> Column:
    """Not a single company's closed round. ``literal`` also rejects headlines that merely name a fund as backer."""
    noise = title.rlike(rules.MARKET_NOISE)
    return noise | title.rlike(rules.FUND_ANYWHERE) if literal else noise


def stale_record(title: Column) -> Column:
    """A re-served archive page."""
    return title.rlike(rules.STALE_RECORD)


def deal_candidate(title: Column, summary: Column) -> Column:
    """Worth reading as a deal: any vocabulary of a deal in title or summary."""
    return body(title, summary).rlike(rules.DEAL_HINT)


def deal_noise(text: Column) -> Column:
    """Deal vocabulary without a deal."""
    return any_of(text, rules.DEAL_NOISE)


def stake_percent(text: Column) -> Column:
    """Percentage attached to a stake, null where none is."""
    one, two = F.regexp_extract(text, rules.STAKE_PCT, 1), F.regexp_extract(text, rules.STAKE_PCT, 2)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit(""))).cast("double")


def minority_deal(text: Column) -> Column:
    """A stake without control: the stated percentage decides, else the words."""
    pct = stake_percent(text)
    return F.when(pct.isNotNull(), pct < 50).otherwise(text.rlike(rules.MINORITY_STAKE) & ~text.rlike(rules.CONTROL_STAKE))


def named_party(name: Column) -> Column:
    """A name and not a description: a capital, or a single word."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n != "") & (n.rlike("[A-Z]") | ~n.rlike(r"\s"))


def looks_like_name(s: Column) -> Column:
    """Short, without a clause's verb, with a capital."""
    return s.isNotNull() & (s != "") & (F.length(s) <= 60) & (~_spaced(s) | (F.size(F.split(s, r"\s+")) <= 7)) & ~s.rlike(rules.CLAUSE_VERB) & s.rlike("[A-Z]")


# ---- word sets ----


def _words(text: Column, stop: list[str]) -> Column:
    toks = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(toks, lambda w: (F.length(w) > 3) & ~w.isin(stop)))


def keyword_set(title: Column) -> Column:
    """Content words of a headline, for threads."""
    return _words(title, rules.THREAD_STOP)


def distinctive_words(title: Column) -> Column:
    """Content words of a headline, for rounds."""
    return _words(title, rules.ROUND_STOP)


def party_form(name: Column) -> Column:
    """Comparable form of a party's name."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9 ]+", " ")
    return squeeze(F.regexp_replace(plain, rules.PARTY_NOISE, " "))


def target_words(name: Column) -> Column:
    """Distinctive words of a target's name."""
    return _words(party_form(name), rules.TARGET_NOISE)


def party_set(name: Column) -> Column:
    """The parties of a consortium in comparable form, sorted."""
    parts = F.transform(F.split(F.coalesce(name, F.lit("")), r"(?i)\s*(?:,|;|\band\b|&|\+)\s*"), party_form)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 4)))


def same_party(a: Column, b: Column) -> Column:
    """Equal forms, one substantial form inside the other, or the same consortium in any order."""
    x, y = party_form(a), party_form(b)
    inside = ((F.length(x) >= 4) & F.contains(y, x)) | ((F.length(y) >= 4) & F.contains(x, y))
    px, py = party_set(a), party_set(b)
    return (x != "") & (y != "") & ((x == y) | inside | ((F.size(px) > 1) & (px == py)))


def same_target(a: Column, b: Column) -> Column:
    """The same party, or a distinctive word in common."""
    return same_party(a, b) | F.arrays_overlap(target_words(a), target_words(b))


def seller_worth_naming(seller: Column, target: Column) -> Column:
    """A seller that is not just the target's own name."""
    s, t = party_form(seller), party_form(target)
    return (s != "") & ~F.contains(t, s) & ~F.contains(s, t)


# ---- money ----

_FIGURE = re.compile(rules.FIGURE)
_AFTER, _BEFORE, _AT = (re.compile(p) for p in (rules.VALUATION_AFTER, rules.VALUATION_BEFORE, rules.VALUATION_AT))


def _currency(text: str, m: re.Match, prefixes: bool) -> str | None:
    word = (m[5] or "").lower()
    if word and not word.startswith("dollar"):
        named = rules.CURRENCY_WORDS.get(word) or rules.CURRENCY_WORDS.get(word.rstrip("s")) or rules.CODES.get(word.upper())
        if named:
            return named
    if (m[4] or "").lower() in ("crore", "lakh", "cr"):
        return "INR"
    if m[1]:
        return rules.CODES.get(m[1].upper())
    if m[2] == "$" and prefixes:
        mark = re.search(r"(?<![A-Za-z])([A-Z]{1,2})\s?$", text[: m.start(2)])
        if mark and mark[1] in rules.DOLLAR_PREFIX:
            return rules.DOLLAR_PREFIX[mark[1]]
    return rules.SYMBOLS.get(m[2]) or ("USD" if word else None)


def read_amount(text: str | None, prefixes: bool = True) -> tuple[float | None, float | None, str | None]:
    """(US dollars, as printed, currency) in millions of the first figure that is no valuation, or nulls.

    A figure is judged by the text up to its neighbours only. Numbers without a currency are no figures; one
    without a multiplier counts in millions. ``prefixes``: read C$, A$ and the like as the comment intends.
    """
    hits = list(_FIGURE.finditer(text or ""))
    for i, m in enumerate(hits):
        currency = _currency(text, m, prefixes)
        if currency is None:
            continue
        before = text[hits[i - 1].end() if i else 0 : m.start()]
        after = text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)]
        if _BEFORE.search(before) or (i and _AT.search(before)) or _AFTER.search(after):
            continue
        native = float(m[3].replace(",", "")) * rules.MULTIPLIERS.get((m[4] or "").lower(), 1)
        if native * rules.RATES[currency] > 0:
            return native * rules.RATES[currency], native, currency
    return None, None, None


AMOUNT = StructType([StructField("usd_m", DoubleType()), StructField("native_m", DoubleType()), StructField("currency", StringType())])


@F.pandas_udf(AMOUNT)
def amount_of(text: pd.Series) -> pd.DataFrame:
    """The raised amount of each headline."""
    rows = [read_amount(t) for t in text]
    return pd.DataFrame({"usd_m": pd.Series([r[0] for r in rows], dtype="float64"), "native_m": pd.Series([r[1] for r in rows], dtype="float64"), "currency": pd.Series([r[2] for r in rows], dtype="object")})


@F.pandas_udf(ArrayType(IntegerType()))
def figure_starts(text: pd.Series) -> pd.Series:
    """Offsets of all figures with a currency."""
    return text.map(lambda t: [m.start() for m in _FIGURE.finditer(t or "") if _currency(t, m, True)])


def short_money(m: Column) -> Column:
    """``$1.2B``, ``$12.5M`` or ``$250K`` from an amount in millions."""
    one = lambda x: F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), r"\.0$", "")
    return F.when(m >= 1000, F.concat(F.lit("$"), one(m / 1000), F.lit("B"))).when(m >= 1, F.concat(F.lit("$"), one(m), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.floor(m * 1000 + 0.5).cast("string"), F.lit("K")))


def round3(x: Column) -> Column:
    """Half up to three decimals; null is 0."""
    return F.coalesce(F.floor(x * 1000 + 0.5) / 1000, F.lit(0.0))


def same_round(a: Column, b: Column) -> Column:
    """Two amounts within a factor of two."""
    return (a > 0) & (b > 0) & (F.greatest(a, b) / F.least(a, b) <= 2)


# ---- parties of a headline ----


def lead_investor(text: Column) -> Column:
    """The capitalised run after "led by", up to a grammar word, four words at most; empty without one."""
    run = F.regexp_extract(text, r"(?i:\bled by)\s+([A-Z0-9][\w&.'’-]*(?:\s+(?:[A-Z0-9][\w&.'’-]*|of|de|van|del|und|för))*)", 1)
    stop = "|".join(rules.LEAD_STOP)
    run = F.regexp_replace(run, rf"(?<=\S)\s+(?:{stop})(?:\s.*)?$", "")
    run = F.array_join(F.slice(F.split(run, r"\s+"), 1, 4), " ")
    return F.trim(F.regexp_replace(run, r"[\s,;:.]+$", ""))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _has(s: Column, marks: list[str]) -> Column:
    """Whether one of the marks lies in the text: what a pattern cannot match without, and far cheaper to look for."""
    out = F.contains(s, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(s, F.lit(m))
    return out


def _spaced(s: Column) -> Column:
    """Whether there is white space in a text."""
    return _has(s, list(" \t\n\x0b\f\r"))


def _cut(s: Column, pattern: str, where: Column) -> Column:
    """What matches the pattern taken out; looked for only where it may be."""
    return F.when(where, F.regexp_replace(s, pattern, "")).otherwise(s)


def _clean_name(raw: Column, last: bool) -> Column:
    end = list(" \t\n\x0b\f\r\x85\u2028\u2029,'\"“”‘’).!?-")  # the pattern's, and what may follow it at a text's end
    begin = list(" \t\n\x0b\f\r,'\"“”‘’(-")
    part = lambda s: F.when(_has(s, list(";:—–|-")), F.element_at(F.split(s, rules.CHAIN_CUT), -1 if last else 1)).otherwise(s)
    s = let(let(raw, part), lambda s: _cut(s, rules.TARGET_TAIL, _spaced(s)))
    s = let(s, lambda s: _cut(s, r"^[\s,'\"“”‘’(-]+", F.substring(s, 1, 1).isin(begin)))
    s = let(s, lambda s: _cut(s, r"[\s,'\"“”‘’).!?-]+$", F.substring(s, -1, 1).isin(end)))
    return let(s, lambda s: F.when(_has(s, ["  ", *"\t\n\x0b\f\r"]), squeeze(s)).otherwise(F.trim(s)))


def clean_target(raw: Column) -> Column:
    """The name bought: first segment, no tail, no stake, no descriptor where dropping it is safe."""
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))

    def shorten(x: Column) -> Column:
        s, short = x["s"], x["short"]
        safe = (short != "") & (short != s) & ((words(F.substring(s, F.lit(1), F.length(s) - F.length(short))) >= 2) | (words(short) >= 2))
        return F.when(safe, short).otherwise(s)

    whole = lambda s: F.when(_has(F.lower(s), ["stake"]), F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)^.*?\bstakes?\s+(?:in|of)\s+", ""), r"(?i)\s+stakes?$", ""))).otherwise(s)
    pair = lambda s: F.struct(s.alias("s"), F.trim(F.regexp_replace(s, rules.TARGET_PREFIX, "")).alias("short"))
    return let(let(_clean_name(raw, False), whole), lambda s: F.when(_spaced(s), let(pair(s), shorten)).otherwise(s))


def clean_acquirer(raw: Column) -> Column:
    """The buyer's name: last segment, no press furniture, no stranded auxiliary."""
    s = let(_clean_name(raw, True), lambda s: _cut(s, r"(?i)^(?:press release|exclusive|breaking|update|report|reg)\s*[-–—:]?\s*", F.lower(F.substring(s, 1, 3)).isin("pre", "exc", "bre", "upd", "rep", "reg")))
    s = let(s, lambda s: _cut(s, r"^\d+\.\s*", F.contains(s, F.lit("."))))
    return F.trim(let(s, lambda s: _cut(s, r"(?i)\s+(?:to|will|has|have|is|are|and)$", _spaced(s))))


def deal_pair(title: Column) -> Column:
    """``struct(acquirer, target, seller)`` of the first pattern that gives two different names, or null.

    A pattern is tried where a word it needs is there. Its groups are cut out in one pass, which leaves a headline that
    does not match as it is, and cleaned in steps that each name the last one's result.
    """

    def valid(r: Column) -> Column:
        return F.when(looks_like_name(r["acquirer"]) & looks_like_name(r["target"]) & (F.lower(r["acquirer"]) != F.lower(r["target"])), r)

    def reader(acquirer: int, target: int, seller: int):
        def read(groups: Column) -> Column:
            s = _clean_name(groups[seller - 1], False) if seller else F.lit("")
            return F.struct(clean_acquirer(groups[acquirer - 1]).alias("acquirer"), clean_target(groups[target - 1]).alias("target"), s.alias("seller"))

        return read

    def attempt(t: Column, p: str, ways: tuple[int, int, int]) -> Column:
        cut = F.regexp_replace(t["t"], p, "\u0000".join(f"${i}" for i in range(1, max(ways) + 1)))
        return let(cut, lambda c: F.when(c != t["t"], let(let(F.split(c, "\u0000"), reader(*ways)), valid)))

    def first(t: Column) -> Column:
        return F.coalesce(*[F.when(reduce(and_, [_has(t["low"], m) for m in marks]), attempt(t, p, ways)) for (p, *ways), marks in zip(rules.DEAL_PAIRS, rules.DEAL_PAIR_MARKS, strict=True)])

    return let(let(title, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))), first)


# ---- places ----


def country_of(place: Column) -> Column:
    """The country a place ends in, canonical; null where it names none."""
    tail = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(place, F.lit("")), r"(?s)^.*,", "")), r"\.$", "")
    alias = {a: c for c, names in rules.COUNTRY_ALIASES.items() for a in names} | {s.lower(): "United States" for s in rules.US_STATES}
    table = F.create_map(*[F.lit(x) for kv in alias.items() for x in kv])
    known = F.coalesce(table[F.lower(tail)], table[F.concat(F.lower(tail), F.lit("."))])
    return F.when((F.length(tail) >= 2) & ~F.lower(tail).isin(rules.NO_COUNTRY), F.coalesce(known, tail))


def city_of(place: Column) -> Column:
    """What stands before the last comma; empty without one."""
    return F.when(F.contains(place, F.lit(",")), F.trim(F.regexp_replace(place, r",[^,]*$", ""))).otherwise(F.lit(""))


def with_article(country: Column) -> Column:
    """``the`` in front of the names that take it."""
    return F.when(country.isin(rules.WITH_ARTICLE), F.concat(F.lit("the "), country)).otherwise(country)


def csv_guard(cell: Column) -> Column:
    """A leading quote for cells a spreadsheet would run as a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


# ---- replies of a reader ----


#: A brace, a whole string, or the quote of a string that does not end.
_MARKS = re.compile(r'[{}]|"[^"\\]*(?:\\.[^"\\]*)*"|"', re.S)


@F.pandas_udf(StringType())
def json_slice(text: pd.Series) -> pd.Series:
    """The first brace-balanced object in free text, trailing commas removed; null without one."""

    def one(s: str | None) -> str | None:
        start, depth = (s or "").find("{"), 0
        for m in _MARKS.finditer(s, start) if start >= 0 else ():
            mark = m[0]
            if mark == '"':  # a string that does not end
                return None
            if mark in "{}":
                depth += 1 if mark == "{" else -1
                if depth == 0:
                    return re.sub(r",(\s*[}\]])", r"\1", s[start : m.end()])
        return None

    return text.map(one)
