"""URL filter: host and path rules, then a logistic regression on hashed
character n-grams of host and path, all in DataFrame functions.

The model is trained on a small labelled URL table.  Scoring needs no join and
no shuffle: the weights (``BUCKETS`` doubles, a fixed size) stand in the plan
as one array literal and each URL sums its n-grams' weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024          # hashed n-grams; also the size of the weight array
SIZES = (3, 4)          # n-gram lengths
REGULARISATION = 0.0005
BLOCK_AT = 0.7          # probability from which the model blocks

# Rules of (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# Names of unwanted sites (advertising, tracking, link farms,
# gambling, adult, piracy, fraud) and of ordinary ones.
BLOCKED_NAMES = [
    "ads", "ads-track", "adserver", "popup-ads", "banner-ads", "click-track", "tracker", "pixel-track", "spam", "spam-farm", "link-farm", "seo-spam",
    "casino", "casino-win", "free-casino", "poker-bonus", "free-bets", "bets-online", "lottery-win", "jackpot-slots", "cheap-pills", "pills-shop",
    "cheap-loans", "cheap-watches", "adult", "adult-x", "adult-video", "adult-cams", "xxx", "sex-dating", "warez", "torrent-crack", "free-download",
    "keygen-serial", "phish-login", "win-prize", "get-rich", "miracle-diet", "crypto-double", "click-bait",
]
ALLOWED_NAMES = [
    "news", "docs", "library", "university", "school", "museum", "recipes", "weather", "science", "wiki", "history", "garden", "city", "music",
    "travel", "sports", "forum", "thornton", "northern", "another", "threads", "tionesta", "whitby", "there", "thinking", "nation", "heron",
    "authority", "the-herald", "henry", "river", "stone", "oakland", "station", "hatton", "anders", "erwin", "onshore", "bletchley", "national",
    "the-times", "hanover", "shire", "thistle", "the-hand", "wharton", "reading", "stoneham", "relation", "edition",
]


def labelled_urls() -> list[tuple[str, str]]:
    """The small labelled table: each name with four front labels, ends and
    paths in turn, so that only names tell the two verdicts apart."""
    fronts, ends = ["", "www.", "m.", "blog."], [".example.com", ".example.net", ".example.org"]
    paths = ["/en/1", "/de/20", "/fr/300?page=2&ref=x", "/es/4", "/en/512/", "/index.html", "/"]
    out = []
    for verdict, names in (("block", BLOCKED_NAMES), ("allow", ALLOWED_NAMES)):
        for k, name in enumerate(names):
            for j, front in enumerate(fronts):
                out.append((f"https://{front}{name}{ends[(k + j) % 3]}{paths[(2 * k + 3 * j) % 7]}", verdict))
    return out


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end.  Both are
    empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.  Of
    equally long rules the first in text order wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = None
    for says, rh, rp in ordered:
        fits = rule_fits(host, path, rh, rp)
        rule = F.when(fits, rh + rp) if rule is None else rule.when(fits, rh + rp)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if ordered else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def buckets(host: Column, path: Column) -> Column:
    """Bucket of each character n-gram of host and path, 0-based; digits count
    as one letter, and host and path have n-grams of their own."""
    out = []
    for name, text in (("h", host), ("p", path)):
        shape = F.concat(F.lit("^"), F.regexp_replace(lower_ascii(text), "[0-9]+", "0"), F.lit("$"))
        for n in SIZES:
            out.append(_ngram_buckets(shape, n, f"{name}{n}"))
    return F.concat(*out)


def _ngram_buckets(text: Column, n: int, kind: str) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def train(spark: SparkSession, labelled: list[tuple[str, str]]) -> list[float]:
    """Weights of the buckets, then the intercept.  ``labelled`` holds (url,
    ``allow`` or ``block``) rows; it is a small table given as a parameter."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = spark.sql("SELECT url, verdict FROM VALUES " + ", ".join(f"('{_quoted(u)}', '{v}')" for u, v in labelled) + " AS t(url, verdict)")
    host, path = host_and_path(F.col("url"))
    frame = rows.select("url", F.when(F.col("verdict") == "block", 1.0).otherwise(0.0).alias("label"), buckets(host, path).alias("b"))
    # L2-normalised counts, dense over the buckets: a few dozen short rows.
    counted = frame.select("label", "url", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.size(F.filter("b", lambda x: x == k)).cast("double")).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    vectors = counted.select("label", array_to_vector(F.transform("c", lambda x: x / norm)).alias("features")).coalesce(1)
    fitted = LogisticRegression(regParam=REGULARISATION, maxIter=30, tol=1e-6, standardization=False).fit(vectors)
    return [*map(float, fitted.coefficients.toArray()), float(fitted.intercept)]


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability of ``block``: the same normalised counts times the weights.
    The squared norm is the sum over distinct buckets of count squared, from
    runs of the sorted buckets."""
    if any(not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite")
    array = F.array(*[F.lit(w) for w in weights[:-1]])
    b = F.array_sort(buckets(host, path))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot"))

    def step(s, k):
        run = F.when(s["last"] == k, s["run"] + 1.0).otherwise(1.0)
        # A run that grows from r - 1 to r adds r^2 - (r - 1)^2 = 2r - 1.
        return F.struct(k.alias("last"), run.alias("run"), (s["sq"] + 2.0 * run - 1.0).alias("sq"), (s["dot"] + F.get(array, k)).alias("dot"))

    z = F.aggregate(b, start, step, lambda s: s["dot"] / F.sqrt(s["sq"]) + weights[-1])
    return 1.0 / (1.0 + F.exp(-z))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float]) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of
    ``block`` for every row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has empty host and path and gets the
    model's verdict on them.  Repeated rows and null ids pass through as they
    are; other columns are not read; empty tables give no rows."""
    host, path = host_and_path(F.col("url"))
    # Parsed and scored in steps, so that each expression is computed once.
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = by_rule(F.col("host"), F.col("path"), rules)
    scored = parsed.select("*", rule.alias("rule"), says.alias("says"), probability(F.col("host"), F.col("path"), weights).alias("p_block"))
    learned = F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", learned).alias("verdict"), "p_block")
