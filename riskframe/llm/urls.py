"""URL filter: a list of host and path rules, then gradient-boosted trees on lexical features.

URLs that a rule judges are the labelled ones; the trees learn from them and judge the
URLs that no rule fits.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path) of the rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled URLs the trees are fitted on at most: those with the smallest hashes.
FIT_ROWS = 20_000
TREES, DEPTH = 20, 4

FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digit_ratio", "entropy", "n_params", "n_marks",
            "n_last", "digits_last", "suffix_rows", "suffix_block", "first_rows", "first_block")


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL: after the first ``://`` up to ``/``, ``?`` or ``#``, then up to ``?`` or ``#``.

    A null URL, or one without ``://``, has the empty host and path.
    """
    url = F.col(url) if isinstance(url, str) else url
    full = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(full, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(full, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _fitting(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _entropy(url: Column) -> Column:
    """Shannon entropy (bits) of the URL's characters."""
    n = F.length(url)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0),
                                      lambda s, c: s + F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))).otherwise(0.0)


def _lexical(rows: DataFrame) -> DataFrame:
    """The features that depend on the URL alone, and the keys of its suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    last = F.regexp_extract("path", r"([^/]*)/?$", 1)
    count = lambda chars: F.length(F.regexp_replace(url, f"[^{chars}]", "")).cast("double")
    return rows.select(
        "*", n.cast("double").alias("n_url"), F.length("host").cast("double").alias("n_host"), F.length("path").cast("double").alias("n_path"),
        F.size(F.split("path", "/")).cast("double").alias("depth"), F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.when(n > 0, digits / n).otherwise(0.0).alias("digit_ratio"), _entropy(url).alias("entropy"),
        count("&=").alias("n_params"), count("_~%+@:;,.-").alias("n_marks"),
        F.length(last).cast("double").alias("n_last"), F.length(F.regexp_replace(last, "[^0-9]", "")).cast("double").alias("digits_last"),
        F.substring_index("host", ".", -1).alias("suffix"), F.regexp_extract("path", r"^/([^/]*)/", 1).alias("first"))


def _statistics(labelled: DataFrame, key: str) -> DataFrame:
    """Rows and smoothed share of blocked ones by ``key``, over all labelled URLs."""
    return labelled.groupBy(F.col(key).alias(f"{key}_key")).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{key}_rows"),
        ((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias(f"{key}_block"))


def features(pages: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """page_id, url, host, path, rule, judged, label (1 block, 0 allow, null none) and all features.

    Suffix statistics come from the labelled rows that ``learn`` holds for, by default all.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")) \
        .withColumns({"host": host, "path": path})
    rule, verdict = _fitting(rules, F.col("host"), F.col("path"))
    rows = _lexical(rows.withColumns({"rule": rule, "judged": verdict})
                    .withColumn("label", F.when(F.col("judged") == "block", 1.0).when(F.col("judged") == "allow", 0.0)))
    labelled = rows.where("label IS NOT NULL")
    if learn is not None:
        labelled = labelled.where(learn)
    for key in ("suffix", "first"):
        rows = rows.join(_statistics(labelled, key), F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")
    return rows.fillna({f"{k}_rows": 0.0 for k in ("suffix", "first")} | {f"{k}_block": 0.5 for k in ("suffix", "first")})


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> PipelineModel | float:
    """Boosted trees on at most ``fit_rows`` labelled URLs; the only label, if there is but one (0 if none)."""
    sample = labelled.select("label", *FEATURES, F.xxhash64("page_id", "url").alias("at")).orderBy("at").limit(fit_rows)
    sample = sample.drop("at").cache()
    try:
        seen = [r.label for r in sample.select("label").distinct().collect()]
        if len(seen) < 2:
            return seen[0] if seen else 0.0
        return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"),
                                GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, seed=7)]).fit(sample)
    finally:
        sample.unpersist()


def judge(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    The longest fitting rule judges; otherwise the trees do.  With a single label among
    the judged URLs that label is the verdict of the rest, with none it is allow.  Null
    URLs have the empty host and path and are judged by the trees; repeated rows each get
    a row; other columns are ignored; an empty table gives no rows.
    """
    rows = features(pages, rules)
    model = fit(rows.where("label IS NOT NULL"), fit_rows)
    if isinstance(model, float):
        scored = rows.withColumn("prediction", F.lit(model))
    else:
        scored = model.transform(rows)
    says = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("judged", says).alias("verdict"))
