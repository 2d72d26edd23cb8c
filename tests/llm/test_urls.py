import re

from pyspark.sql import functions as F

from codecorpus.llm import urls
from codecorpus.llm.common import table
from codecorpus.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    rows = QUERIES["op7_url_filter"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_odd_urls(spark):
    odd = ["HTTP://A.EXAMPLE.ORG/es/x?y#z", "https://example.org/en/12", "https://org", "https://org/", "x", None, "", "a://b://c/d", "http://notorg/x",
           "https://x.com/de/", "https://x.com/DE/", "https://com/fr/1#a", "http://h?q=/es/", "ftp://u@example.org:80/es/", "https://example.org/es\n/x", "://", "http:///de/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(odd)] + [(0, odd[0], None)], PAGES)
    pages = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "features", "label")})
    rows = urls.judge(pages).collect()
    assert len(rows) == len(odd) + 1
    for r in rows:
        host, path, rule, verdict = brute(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), odd[r.page_id]
        assert r.verdict in ((verdict,) if rule else ("allow", "block"))
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_without_labels_everything_else_is_allowed(spark):
    pages = spark.createDataFrame([(1, "https://a.net/x", None)], PAGES)
    r = urls.judge(pages).first()
    assert r.verdict == "allow" and r.blocked_probability is None


def test_held_out_accuracy(spark):
    """Trained on half of the urls that a rule decides, tested on the others."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    ruled = urls.judge(pages.limit(0), rules=urls.RULES)
    host, path = urls.host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", urls.best_rule(host, path).alias("r")).where("r IS NOT NULL")
    rows = rows.withColumn("blocked", F.col("r").isin(*[r for r, v in urls.RULES.items() if v == "block"]))
    train, test = rows.where("xxhash64(url) % 2 = 0"), rows.where("xxhash64(url) % 2 <> 0")
    judged = urls.judge(test, train.select("url", "blocked"), rules={}).join(test.select("page_id", "blocked"), "page_id")
    right = judged.agg(F.avg(((F.col("verdict") == "block") == F.col("blocked")).cast("int"))).first()[0]
    assert right > 0.9 and ruled.count() == 0
