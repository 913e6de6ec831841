"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

The model is Spark's own, fitted on a small labelled table of URLs (a few hundred rows at most); scoring is
column expressions and the fitted model, all inside Spark.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the n-grams of host and path, and the buckets they are hashed to.
GRAMS, BUCKETS = (3, 4), 1 << 12
#: A URL without a rule is blocked from this probability on.
THRESHOLD = 0.5

# Words of host names to block and to allow. Hosts of the first lists are learned from, those of the second are for
# measuring: they share no word with the first.
BLOCKED_WORDS = "casino bets pills meds adult cams spam ads track prize money win farm cheap click free".split()
ALLOWED_WORDS = "library museum garden history weather rivers school kitchen archive bridges trails cycling physics poems maps council".split()
BLOCKED_UNSEEN = "poker slots jackpot tablets dating popup phish warez lotto loans".split()
ALLOWED_UNSEEN = "cathedral botany fisheries chess astronomy carpentry parish meadow railway pottery".split()
# Paths that speak for one of the two, and paths that both kinds of hosts have.
BLOCKED_PATHS = [
    "/bonus/claim-now", "/free-spins/today", "/buy/cheap-online", "/click/out.php", "/go/offer-limited", "/win/jackpot.html",
    "/xxx/live-cams", "/promo/exclusive-deal",
]
ALLOWED_PATHS = [
    "/articles/2023/spring", "/docs/guide/index.html", "/wiki/Old_bridges", "/blog/2021/05/notes", "/lessons/grade-4",
    "/recipes/apple-pie", "/about/people", "/collections/maps",
]
SHARED_PATHS = ["/", "/en/4", "/fr/310", "/de/77/", "/es/905.html"]
PREFIXES, ENDINGS = ["", "www.", "m."], ["example.com", "example.net", "example.org"]


def _hosts(words: list[str], steps: tuple[int, ...]) -> list[str]:
    """Two words each, every word in several hosts."""
    n = len(words)
    pairs = [(words[i], words[(i + step) % n]) for i in range(n) for step in steps]
    return [f"{PREFIXES[k % 3]}{a}-{b}.{ENDINGS[k // 3 % 3]}" for k, (a, b) in enumerate(pairs)]


def labelled_urls(spark: SparkSession, unseen: bool = False) -> DataFrame:
    """``url, blocked`` (1.0 or 0.0), a few hundred rows: each host with paths of its kind and shared ones.

    As on the web, more hosts are harmless than not, and shared paths are mostly theirs: a URL that tells nothing is
    allowed. With ``unseen`` the hosts that nothing is learned from.
    """
    lists = ((BLOCKED_UNSEEN, BLOCKED_PATHS, 1.0), (ALLOWED_UNSEEN, ALLOWED_PATHS, 0.0)) if unseen else (
        (BLOCKED_WORDS, BLOCKED_PATHS, 1.0), (ALLOWED_WORDS, ALLOWED_PATHS, 0.0))
    rows = []
    for words, own, label in lists:
        steps, shared = ((1, 3), 1) if label else ((1, 2, 3, 5, 7), 4)
        for k, host in enumerate(_hosts(words, steps)):
            paths = [own[k % len(own)], own[(3 * k + 1) % len(own)], *[SHARED_PATHS[(k + j) % 5] for j in range(shared)]]
            rows += [(f"https://{host}{path}", label) for path in paths]
    return spark.createDataFrame(rows, "url string, blocked double").distinct().coalesce(1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null. A rule is (verdict, host, path).

    It fits its host and all subdomains where the path starts with the rule's path.
    """
    out = None
    # rules are few and given by hand, so the longest is simply asked first
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of both parts, marked with the part; none where a part is too short."""
    def of(part: Column, mark: str, n: int) -> Column:
        edged = F.concat(F.lit("^"), part, F.lit("$"))
        starts = F.sequence(F.lit(1), F.length(edged) - F.lit(n - 1))
        cut = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(edged, i, F.lit(n))))
        return F.when(F.length(edged) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(part, mark, n) for part, mark in ((host, "h"), (path, "p")) for n in GRAMS])


def _features(urls: DataFrame) -> DataFrame:
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True)
    return hashing.transform(urls.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> LogisticRegressionModel:
    """A model from a small labelled table; rows without a label are left out."""
    rows = labelled.select(F.col(url_col).alias("_url"), F.col(label_col).cast("double").alias("_label"))
    rows = rows.where(F.col("_label").isNotNull())
    known = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    return LogisticRegression(
        featuresCol="_features", labelCol="_label", probabilityCol="_probability", predictionCol="_prediction",
        rawPredictionCol="_raw", regParam=0.01, maxIter=50, standardization=False,
    ).fit(_features(known))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score``.

    ``verdict`` (allow or block) is the longest fitting rule's, else the model's; ``score`` is always the
    model's probability of block. A null URL, or one without ``://``, has an empty host and path and is judged
    by the model like any other. Repeated rows and null ids pass through; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    parts = rows.select("page_id", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    scored = model.transform(_features(parts))
    score = F.element_at(vector_to_array(F.col("_probability")), 2)
    judged = scored.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
        rule_for(F.col("_host"), F.col("_path"), rules).alias("_rule"), score.alias("score"),
    )
    own = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "score",
    )
