"""URL filters: rules, then logistic regression on hashed character n-grams of host and path, in DataFrame operations only.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end. A rule holds for its host and all
its subdomains where the path starts with the rule's; the longest fitting rule decides. Elsewhere a linear model decides: n-grams of the host and of
the path are hashed to buckets, each bucket has an integer weight (millionths), and a URL is blocked if its mean weight and the bias come out above 0. The model is
trained at import by gradient descent on the small labelled table below, so the weights are part of the plan as a constant.

A null URL, or one without "://", has an empty host and path and no rule; its score is the bias. Repeated rows get equal verdicts. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.ranges import longs
from trackloom.llm.shared import documents

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: The labelled table: made-up site names on neutral paths, and telling paths on neutral sites, so that host and path each tell the classes apart. Where neither says anything (long
#: paths of plain words too), a URL is allowed.
ALLOW = (
    "library", "daily-herald", "gardening", "city-museum", "kitchen", "weather", "history", "travel-guide", "health-council", "cycling", "bookstore", "school", "science", "archive", "orchestra", "transit",
    "parliament", "mathematics", "university", "theatre", "hospital", "fishing-club", "astronomy", "farmers-market", "local-news", "railway", "chess", "architecture", "thread-and-needle", "birdwatching", "poetry", "geology",
)
BLOCK = (
    "royal-casino", "grand-casino-online", "best-bets", "sports-betting", "poker-bonus", "discount-pills", "pharma-cheap", "no-prescription-meds", "adult-videos", "xxx-cams", "link-farm", "spam-links", "ads-click", "pop-ads",
    "banner-ads", "free-download-crack", "warez-crack", "win-free-phone", "payday-loans", "get-rich-fast", "replica-watches", "hot-adult-chat", "slots-jackpot", "viagra-order", "seo-spam", "free-xxx", "bonus-slots", "cheap-viagra", "lottery-winner",
    "keygen-serials", "porn-tube", "click-tracker",
)
ALLOW_PATHS = (
    "/catalogue/books", "/politics/elections", "/roses/pruning", "/manual/install", "/physics/courses", "/bread/sourdough", "/exhibits/bronze", "/forecast/north", "/wiki/rome", "/italy/venice", "/advice/vaccines", "/repairs/brakes",
    "/novels/classic", "/timetable/winter", "/articles/biology", "/concerts/spring", "/lines/blue", "/debates/budget", "/proofs/primes", "/research/climate", "/recipes/soup", "/history/castles", "/gardening/trees", "/school/lessons",
)
BLOCK_PATHS = (
    "/slots/bonus", "/casino/jackpot", "/odds/free-bets", "/betting/bonus", "/poker/cash", "/viagra/order", "/pills/buy-cheap", "/meds/no-prescription", "/xxx/free", "/adult/live", "/cams/girls", "/buy-links/seo", "/spam/article", "/ads/redirect",
    "/pixel/click", "/banner/popup", "/keygen/serial", "/torrent/crack", "/prize/claim", "/payday/cash", "/money/get-rich", "/replica/rolex", "/porn/videos", "/lottery/winner",
)
NEUTRAL_SITES = ("www.portal.org", "home.pages.com", "site.net", "www.host.com", "my.place.org", "web.server.net", "start.com", "www.corner.net")
NEUTRAL_PATHS = ("", "/", "/about", "/page/2", "/index.html", "/contact/us", "/news/2021/03", "/item/7")
PLAIN = (
    "stone", "river", "window", "morning", "yellow", "seven", "another", "together", "north", "paper", "winter", "simple", "bridge", "letter", "garden", "mountain", "harbour", "silver", "evening", "corner", "summer", "village",
    "candle", "forest", "island", "meadow", "pebble", "shadow", "thunder", "valley",
)
FRAMES = ("www.{}.org", "{}.com", "{}.net", "shop.{}.com", "www.{}.net", "{}.org", "info.{}.org", "www.{}.com")

SIZES, BUCKETS, STEPS, RATE, DECAY = (3, 4), 4096, 120, 40.0, 1e-5
UNIT = 1_000_000


def _grams(part: str, text: str) -> list[str]:
    return [f"{part}{n}{text[i : i + n]}" for n in SIZES for i in range(len(text) - n + 1)]


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def features(host: str, path: str) -> list[int]:
    return [_bucket(g) for g in _grams("h", host) + _grams("p", path)]


def labelled() -> list[tuple[str, int]]:
    """(host and path, 1 where to block)."""
    by_host = [(frame.format(name) + path, y) for y, names in ((0, ALLOW), (1, BLOCK)) for name in names for frame, path in zip(FRAMES, NEUTRAL_PATHS)]
    plain = [(site + path, 0) for site in NEUTRAL_SITES for path in NEUTRAL_PATHS] + [(frame.format(name) + path, 0) for name in PLAIN for frame, path in zip(FRAMES, NEUTRAL_PATHS)]
    plain += [(site + "/" + "-".join(PLAIN[k : k + 12]), 0) for k, site in enumerate(NEUTRAL_SITES)]
    plain += [("", 0)] * 40  # nothing known: allowed, so many that the bias comes out below 0
    return by_host + plain + [(site + path, y) for y, paths in ((0, ALLOW_PATHS), (1, BLOCK_PATHS)) for path in paths for site in NEUTRAL_SITES]


def train() -> tuple[list[int], int]:
    """(weights, bias) in millionths; gradient descent with momentum."""
    table = []
    for url, y in labelled():
        found = features(*_parts(url))
        table.append((sorted({k: found.count(k) / len(found) for k in found}.items()), y))
    w, bias, speed, bias_speed = [0.0] * BUCKETS, 0.0, [0.0] * BUCKETS, 0.0
    used = sorted({k for found, _ in table for k, _ in found})
    for _ in range(STEPS):
        step, b = {k: DECAY * w[k] for k in used}, 0.0
        for found, y in table:
            z = bias + sum(w[k] * x for k, x in found)
            g = (1 / (1 + math.exp(-z)) - y) / len(table)
            b += g
            for k, x in found:
                step[k] += g * x
        for k in used:
            speed[k] = 0.9 * speed[k] - RATE * step[k]
            w[k] += speed[k]
        bias_speed = 0.9 * bias_speed - RATE / 100 * b
        bias += bias_speed
    return [round(x * UNIT) for x in w], round(bias * UNIT)


def _parts(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path


WEIGHTS, BIAS = train()


def _chars(text: str) -> Column:
    return F.filter(F.split(F.col(text), ""), lambda c: c != "")


def _hashed(part: str, chars: Column) -> Column:
    """The buckets of the n-grams of a column of characters (a column, so that it isn't split anew for each n-gram)."""

    def of(n):
        places = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{part}{n}"), *(F.element_at(chars, i + k) for k in range(n)))), 1, 3), 16, 10).cast("int"))

    return F.concat(*(of(n) for n in SIZES))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): the score is the model's, in millionths, whatever a rule says."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(rest, F.lit("")).alias("rest"))
    ascii_lower = F.translate(F.regexp_extract("rest", r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select("id", ascii_lower.alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked last, so it stands outermost
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), _chars("host").alias("hc"), _chars("path").alias("pc"))
    found = F.concat(_hashed("h", F.col("hc")), _hashed("p", F.col("pc")))
    rows = rows.select("id", "host", "path", "rule", "ruled", found.alias("found"))
    total = F.aggregate(F.transform("found", lambda k: F.get(longs(WEIGHTS), k)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    score = (F.lit(BIAS) + F.floor(total / F.greatest(F.size("found"), F.lit(1)))).cast("bigint")
    rows = rows.select("id", "host", "path", "rule", "ruled", score.alias("score"))
    return rows.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _sql_grams(part: str) -> str:
    column = {"h": "host", "p": "path"}[part]
    each = [f"list_transform(CASE WHEN length({column}) >= {n} THEN range(1, length({column}) - {n - 2}) ELSE [] END, lambda i: ('0x' || substr(md5('{part}{n}' || substr({column}, i, {n})), 1, 3))::INTEGER)" for n in SIZES]
    return " || ".join(each)


_FITS = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN " + "{0}" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
QUERIES = {"op8_url_filter": op8}
SQL = {
    "op8_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE {" ".join(t.format(f"'{h}{p}'") for t, (v, h, p) in zip(_FITS, _LONGEST))} END AS rule, CASE {" ".join(t.format(f"'{v}'") for t, (v, h, p) in zip(_FITS, _LONGEST))} END AS ruled, {_sql_grams("h")} || {_sql_grams("p")} AS found FROM s),
w AS (SELECT {WEIGHTS} AS w),
g AS (SELECT f.*, ({BIAS} + floor(coalesce(list_sum(list_transform(found, lambda k: w[k + 1])), 0) / greatest(len(found), 1)))::BIGINT AS score FROM f, w)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM g"""
}
