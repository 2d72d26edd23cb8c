"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is the probability of a logistic regression on
hashed features of its text (words, word shapes, repetition), fitted on a
bounded sample of labelled documents.  Sites add what their other documents
say: grouped aggregation gives each host, and each path below it, the mean
evidence of its documents.  A host's mean is shrunk toward the global mean and
a path's toward its host's, by strengths that the method of moments finds in
the data, so a site with few documents says little.  Document, path and prior
log-odds add up to the posterior.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import WordCache, cut, rows_of

#: Labelled ids used for fitting, at most (those of smallest hash), with one document each.
SAMPLE = 8192
FEATURES = 1 << 18
#: A feature needs this many sample documents.
LEAST_DOCS = 3
#: Lengths of word beginnings that are features.
PREFIXES = (4, 6)
#: A bad document counts this many times in fitting.
BAD_WEIGHT = 3.0
#: Bytes of the words whose features a Python worker keeps, with what an entry adds.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 400
#: Strength of a prior when sites do not differ at all.
MOST_STRENGTH = 1e6

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_EDGES = re.compile(r"^\W+|\W+$")


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) & (FEATURES - 1)


def _word_features(word: str) -> tuple[int, ...]:
    """Features of a word: itself in lower case without marks, its first
    letters, and its shape."""
    shape = _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))
    core = _EDGES.sub("", word).lower()
    names = ["s " + shape[:12]] + ["w " + core] * bool(core) + ["p " + core[:k] for k in PREFIXES if len(core) > k]
    return tuple(map(_feature, names))


_cache = WordCache(_word_features, CACHE_BYTES, ENTRY_BYTES)


def features(text: str | None) -> list[int]:
    """Distinct feature ids of a text (null or empty: one for having no words)."""
    words = text.split() if text else []
    if not words:
        return [_feature("empty")]
    _cache.bound()
    counts = Counter(words)
    found: set[int] = set()
    for word in counts:
        found.update(_cache[word])
    n = len(words)
    scale = min(12, n.bit_length())
    repeats = sum(a == b for a, b in pairwise(words)) / n
    shares = {
        "distinct": len(counts) / n, "top": max(counts.values()) / n, "repeat": min(1.0, 4 * repeats),
        "mark": sum(c for w, c in counts.items() if not w[-1].isalnum()) / n,
        "upper": sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n}
    found.update(_feature(f"{name} {int(10 * x)} {scale if name in ('distinct', 'top') else ''}") for name, x in shares.items())
    return sorted(found)


def fit(rows: list[np.ndarray], good: list[int], steps: int = 100, decay: float = 1e-3, rate: float = 0.05) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on feature sets.

    A feature's value is its log count ratio between good and bad documents,
    so that few steps of adaptive gradient descent settle the weights.  Without
    documents of both kinds all weights are 0.
    """
    if len(set(good)) < 2:
        return np.zeros(FEATURES + 1)
    y = np.array(good, float)
    ids = np.concatenate([np.asarray(r, np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    seen = np.bincount(ids, minlength=FEATURES)
    in_good = np.bincount(ids, weights=y[doc], minlength=FEATURES)
    ratio = np.log((in_good + 0.5) / (y.sum() + 1)) - np.log((seen - in_good + 0.5) / ((1 - y).sum() + 1))
    ratio[seen < LEAST_DOCS] = 0
    kept = ratio[ids] != 0  # most features are too rare to count
    ids, doc = ids[kept], doc[kept]
    value, weigh = ratio[ids], np.where(y == 1, 1.0, BAD_WEIGHT) / len(y)
    w, mean, square, bias = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES), 0.0
    for t in range(1, steps + 1):
        logit = np.bincount(doc, weights=w[ids] * value, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weigh
        gradient = np.bincount(ids, weights=error[doc] * value, minlength=FEATURES) + decay * w
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
        w -= rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
        bias -= 2 * error.sum()
    return np.r_[w * ratio, bias]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most ``sample`` labelled documents; good: quality 1 and not toxic.

    A labelled id counts once, however often it occurs: it is good if all its
    labels say so, and of its documents the one of the smallest text hash is used.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    chosen = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
              .groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most ``sample`` rows of two numbers.
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}  # of each of the chosen ids, the smallest hash so far
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                kept = []
                for i, (d, h) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist())):
                    if d not in least or h < least[d]:
                        least[d] = h
                        kept.append(i)
                if kept:
                    part = part.take(pa.array(kept))
                    ids = pa.array([np.array(features(t), dtype="<i4").tobytes() for t in part.column("text").to_pylist()], pa.binary())
                    names = ["doc_id", "good", "text_hash"]
                    yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [ids], names + ["ids"])

    sets = rows.select("doc_id", "good", "text_hash", "text").mapInArrow(extract, "doc_id long, good int, text_hash long, ids binary")
    found = sets.groupBy("doc_id").agg(F.min(F.struct("text_hash", "ids", "good")).alias("r")).select("doc_id", "r.good", "r.ids").collect()
    found.sort(key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.ids, "<i4") for r in found], [r.good for r in found])


def evidence(docs: DataFrame, weights: np.ndarray, host: Column, path: Column) -> DataFrame:
    """``doc_id, text_hash, host, path, evidence``: the probability, from its text alone, that a document is good."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), host.alias("host"), path.alias("path"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "host", "path"]
        for b in batches:
            logits = np.array([weights[features(t)].sum() for t in b.column("text").to_pylist()], float) + weights[-1]
            p = np.clip(1 / (1 + np.exp(-np.clip(logits, -30, 30))), 1e-4, 1 - 1e-4)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(p)], names + ["evidence"])

    return rows.mapInArrow(score, "doc_id long, text_hash long, host string, path string, evidence double")


def _strength(groups: DataFrame, center: str, within: float) -> float:
    """Prior strength, variance within groups over variance between them, for
    ``groups(n, mean, <center>)``: the method of moments."""
    r = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                   F.sum(F.col("n") * (F.col("mean") - F.col(center)) * (F.col("mean") - F.col(center))).alias("ss")).first()
    if not r.k or r.k < 2 or r.n * r.n == r.n2:
        return MOST_STRENGTH
    between = max(0.0, (r.ss - (r.k - 1) * within) / (r.n - r.n2 / r.n))
    return min(MOST_STRENGTH, within / between) if between > 0 else MOST_STRENGTH


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, text_hash, host, path, evidence,
    host_posterior, path_posterior, posterior, keep``.

    The posteriors of a document's host and path come from their other
    documents; alone on its path it gets the host's, alone on its host the
    global mean.  ``host`` is the site of a document (default: its source),
    ``path`` the part of it (default: source and language); null counts as "".  Without usable
    labels every document's evidence is one half and all are kept.  Null and
    empty texts have evidence of their own.  Equal rows get equal results; an
    empty table gives an empty result.
    """
    host = F.coalesce(F.col("source").cast("string") if host is None else host, F.lit(""))
    path = F.concat_ws("/", host, F.coalesce(F.col("lang").cast("string"), F.lit(""))) if path is None else F.coalesce(path, F.lit(""))
    own = cut(evidence(docs, train(docs, labels, sample), host, path))
    paths = cut(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.avg("evidence").alias("mean"),
                                                F.sum(F.col("evidence") * F.col("evidence")).alias("squares")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("host_mean"))
    total = paths.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("sum"), F.sum("squares").alias("squares"),
                      F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("means"), F.count(F.lit(1)).alias("paths")).first()
    n = total.n or 1
    prior = min(1 - 1e-4, max(1e-4, (total["sum"] or 0.5) / n))
    # Variance within paths; where every path has one document, that of all documents.
    spread = n > total.paths > 0
    squares = (total.squares or 0.0) - (total.means if spread else n * prior * prior)
    within = max(1e-9, squares / (n - total.paths if spread else n))
    sites = paths.join(hosts, "host").withColumn("prior", F.lit(prior))
    k_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_mean").alias("mean"), F.lit(prior).alias("prior")), "prior", within)
    k_path = _strength(sites, "host_mean", within)
    # What the site's other documents say: a document does not vouch for itself.
    others, host_others = F.col("n") - 1, F.col("host_n") - 1
    at_host = (F.col("host_n") * F.col("host_mean") - F.col("evidence") + k_host * prior) / (host_others + k_host)
    at_path = (F.col("n") * F.col("mean") - F.col("evidence") + k_path * F.col("host_posterior")) / (others + k_path)
    both = own.join(sites.select("host", "path", "n", "mean", "host_n", "host_mean"), ["host", "path"])
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    both = both.withColumn("host_posterior", inside(at_host)).withColumn("path_posterior", inside(at_path))
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - F.lit(float(np.log(prior / (1 - prior))))
    posterior = 1 / (1 + F.exp(-odds))
    return (both.withColumn("posterior", posterior).withColumn("keep", F.col("posterior") >= threshold)
            .select("doc_id", "text_hash", "host", "path", "evidence", "host_posterior", "path_posterior", "posterior", "keep"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    return rows_of(docs, classify(docs, labels).where("keep"))
