import pytest
from cases import clashing, docs
from pyspark.sql import functions as F

from codecorpus.llm import quality
from codecorpus.llm.common import cut, table

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    sf = "/root/testdata/sf0.1"
    return table(spark, sf, "documents"), table(spark, sf, "labels")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    train, test = labels.where("xxhash64(doc_id) % 3 <> 0"), labels.where("xxhash64(doc_id) % 3 = 0")
    found = quality.classify(docs, train).join(test, "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    r = found.agg(F.avg(F.when(good, F.col("keep").cast("int"))).alias("clean"),
                  F.avg(F.when(F.col("quality") == 0, 1 - F.col("keep").cast("int"))).alias("junk"),
                  F.avg(F.when(F.col("toxic") == 1, 1 - F.col("keep").cast("int"))).alias("toxic")).first()
    assert r.clean >= 0.99 and r.junk >= 0.9 and r.toxic >= 0.85


def test_posteriors_by_hand(spark, monkeypatch):
    """Site posteriors from given evidence, recomputed in Python."""
    import math
    evidence = {i: (0.9 if i % 7 else 0.2) if i % 3 == 0 else (0.3 if i % 5 else 0.8) for i in range(60)}
    rows = [(i, f"t{i}", "en" if i % 2 else "de", f"s{i % 3}", 2) for i in evidence]
    table_of = spark.createDataFrame([(i, e) for i, e in evidence.items()], "doc_id long, evidence double")
    monkeypatch.setattr(quality, "evidence", lambda d, w, host, path: d.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), host.alias("host"), path.alias("path")).join(table_of, "doc_id"))
    found = {r.doc_id: r for r in quality.classify(docs(spark, rows), spark.createDataFrame([], LABELS)).collect()}
    n, mu = len(rows), sum(evidence.values()) / len(rows)
    by_host, by_path = {}, {}
    for i, _, lang, s, _ in rows:
        by_host.setdefault(s, []).append(evidence[i])
        by_path.setdefault((s, lang), []).append(evidence[i])
    mean = lambda x: sum(x) / len(x)
    within = (sum(e * e for e in evidence.values()) - sum(len(x) * mean(x) ** 2 for x in by_path.values())) / (n - len(by_path))

    def strength(groups):
        total, squares = sum(len(x) for x, _ in groups), sum(len(x) ** 2 for x, _ in groups)
        ss = sum(len(x) * (mean(x) - c) ** 2 for x, c in groups)
        between = (ss - (len(groups) - 1) * within) / (total - squares / total)
        return min(1e6, within / between) if between > 0 else 1e6

    kh = strength([(x, mu) for x in by_host.values()])
    kp = strength([(x, mean(by_host[s])) for (s, _), x in by_path.items()])
    logit = lambda p: math.log(p / (1 - p))
    for i, _, lang, s, _ in rows:
        host = (sum(by_host[s]) - evidence[i] + kh * mu) / (len(by_host[s]) - 1 + kh)
        path = (sum(by_path[s, lang]) - evidence[i] + kp * host) / (len(by_path[s, lang]) - 1 + kp)
        posterior = 1 / (1 + math.exp(-(logit(evidence[i]) + logit(path) - logit(mu))))
        assert found[i].host_posterior == pytest.approx(host) and found[i].path_posterior == pytest.approx(path)
        assert found[i].posterior == pytest.approx(posterior) and found[i].keep == (posterior >= 0.5)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, None), (None, 1, 1), (7, None, 0), (999, 0, 0)], LABELS)
    df = docs(spark)
    found = quality.classify(clashing(df), labels).collect()
    assert len(found) == df.count() and all(0 < r.posterior < 1 for r in found)
    none = quality.classify(df, spark.createDataFrame([], LABELS)).collect()
    assert all(r.keep and r.evidence == 0.5 for r in none)
    assert quality.classify(docs(spark, []), labels).count() == 0
    assert quality.drop_rejected(df, spark.createDataFrame([], LABELS)).count() == df.count()


def test_a_document_does_not_vouch_for_itself(spark, monkeypatch):
    """Alone on its site, a document gets the global mean as the site's word; next to
    one other document, only that one's evidence moves it."""
    rows = [(1, "a", "en", "alone", 1), (2, "b", "en", "pair", 1), (3, "c", "en", "pair", 1)] + [(i, "d", "en", f"s{i % 3}", 1) for i in range(10, 40)]
    given = {1: 0.99, 2: 0.9, 3: 0.1}
    monkeypatch.setattr(quality, "train", lambda *a: None)

    def fixed(docs_, weights, host, path):
        value = F.coalesce(*[F.when(F.col("doc_id") == i, v) for i, v in given.items()], (F.col("doc_id") % 10) / 20.0 + 0.2)
        return docs_.select("doc_id", F.xxhash64("text").alias("text_hash"), host.alias("host"), path.alias("path"), value.alias("evidence"))

    monkeypatch.setattr(quality, "evidence", fixed)
    found = {r.doc_id: r for r in quality.classify(docs(spark, rows), None).collect()}
    mean = sum(r.evidence for r in found.values()) / len(found)
    assert found[1].host_posterior == pytest.approx(mean) and found[1].path_posterior == pytest.approx(mean)
    assert found[2].path_posterior < mean < found[3].path_posterior


def test_sparse_sites_say_little(spark):
    """One bad document on a site of its own does not move it far from the prior."""
    table_of = cut(quality.classify(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"),
                                    host=F.concat(F.lit("host"), (F.col("doc_id") % 400).cast("string"))))
    spread = table_of.agg(F.stddev("evidence"), F.stddev("host_posterior")).first()
    assert spread[1] < 0.3 * spread[0]


def test_repeated_ids_count_once(spark, monkeypatch):
    """One labelled id on a third of all rows, and labels that repeat, give the fit no further documents."""
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda rows, good: fitted.append(([r.tolist() for r in rows], good)))
    rows = [(i, f"text number{i} of source", "en", "s", 2) for i in range(400)]
    labels = [(i, i % 2, 0) for i in range(0, 400, 2)] + [(i, 1, 0) for i in range(1, 400, 2)]
    copies = [(7, f"another text{i % 50} of seven", "en", "s", 2) for i in range(200)] + [rows[7]] * 100
    quality.train(docs(spark, rows), spark.createDataFrame(labels, LABELS))
    quality.train(docs(spark, rows + copies).repartition(6), spark.createDataFrame(labels + [(7, 1, 0)] * 300 + [(9, 0, 0)], LABELS))
    (once, good), (many, votes) = fitted
    assert len(once) == len(many) == 400
    assert votes == good[:9] + [0] + good[10:]
    assert once[:7] + once[8:] == many[:7] + many[8:]
    of_seven = docs(spark, [rows[7], *copies]).select("text", F.xxhash64("text").alias("h")).orderBy("h").first().text
    assert many[7] == quality.features(of_seven)
    quality.train(docs(spark, rows + copies), spark.createDataFrame(labels * 2, LABELS), sample=200)
    assert len(fitted[2][0]) == 200
