"""URL filters: rules on host and path, and a logistic regression for the rest.

A rule like ``example.org/es/`` fits its host and all subdomains where the
path starts with the rule's; the longest fitting rule decides.  Urls that no
rule fits are judged by a logistic regression on hashed character n-grams of
host and path, trained from a small table of labelled urls.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import cut, lower_ascii

#: Rules of the production filter (fixed values).
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Labelled urls used for training, at most (those of smallest hash).
SAMPLE = 20_000
FEATURES = 1 << 16
GRAM = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def best_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits (ties: alphabetic), or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, rest = rule.partition("/")
        at = (host == own) | host.endswith("." + own)
        found = F.when(at & path.startswith(slash + rest), F.lit(rule)).otherwise(found)
    return found


def grams(host: Column, path: Column, n: int = GRAM) -> Column:
    """Character n-grams of host and path, marked by which they come from."""
    def of(text: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.lit(1), F.length(framed) - n + 1)
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n))))
    return F.concat(of(host, "h"), of(path, "p"))


def _vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with the binary vector ``features`` of their hashed n-grams."""
    tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return tf.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def train(labelled: DataFrame, sample: int = SAMPLE):
    """Model from ``labelled(url, blocked)``: at most ``sample`` urls.  None
    without labels of both kinds."""
    host, path = host_and_path(F.col("url"))
    rows = (labelled.where("blocked IS NOT NULL").select("url", F.col("blocked").cast("double").alias("label")).distinct()
            .orderBy(F.xxhash64("url"), "url", "label").limit(sample))
    rows = cut(_vectors(rows.select("label", host.alias("host"), path.alias("path"))))
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(maxIter=25, regParam=1e-3, standardization=False).fit(rows)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, blocked_probability``.

    ``labelled(url, blocked)`` is the training table; unset, the urls that a
    rule decides.  Where no model can be trained (no labels, or of one kind),
    the probability is null and urls without a rule are allowed.  Null urls are
    judged like empty ones.  Equal rows get equal results; an empty table gives
    an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map()
    by_rule = F.try_element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string")
    if labelled is None:
        labelled = rows.where("rule IS NOT NULL").select("url", (by_rule == "block").alias("blocked"))
    model = train(labelled, sample)
    if model is None:
        judged = rows.withColumn("blocked_probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(_vectors(rows))
        judged = scored.withColumn("blocked_probability", vector_to_array("probability")[1])
    guess = F.when(F.col("blocked_probability") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, guess).alias("verdict"), "blocked_probability")
