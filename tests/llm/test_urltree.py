import random
import re

import pytest
from pyspark.sql import functions as F

from rowkin.llm import urltree
from rowkin.llm.registry import URL_RULES


def split(url):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = ["http://a.net/x", "HTTP://A.NET/en/1", "http://www.example.net/en/7?q=/x", "http://example.net/en", "http://notexample.net/en/5",
        "https://Example.COM/de/4#f", "http://x.example.com/de", "http://a.org/fr/9", "http://net", "http://net/", "ftp://b.com/a://c/d",
        "no scheme/de/", "://", "", None, "http://ü.net/é", "http://a.com?x=://b.net/", "http://a.com/x\ny", "http://a.net/x"]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    labels = spark.createDataFrame([], "page_id long, good boolean")
    got = {r.page_id: r for r in urltree.judge(pages, labels, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = split(url)
        rule = ruled(host, path)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (rule.name if rule else None) and got[i].verdict == (rule.verdict if rule else "allow")


def test_shapes(spark):
    cases = {"/en/123": "/en/*", "/en/123.html": "/en/*.html", "/a/deadbeef01/": "/a/*/", "/news/2024/05": "/news/*/*", "": "", "/": "/",
             "/item1234x": "/*", "/v2/about": "/v2/about", "/a-very-long-title-of-a-page-that-goes-on": "/*"}
    rows = spark.createDataFrame([(k,) for k in cases], "path string").select("path", urltree.shape(F.col("path")).alias("s")).collect()
    assert {r.path: r.s for r in rows} == cases


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for i in range(3000):
        kind = rng.choice(("blog", "shop", "spam"))
        host = "big.com" if i % 3 == 0 else f"h{i % 2}.com"
        pages.append((i, f"http://{host}/{kind}/{i}"))
        if rng.random() < 0.5:
            labels.append((i, rng.random() < (0.05 if kind == "spam" else 0.9)))
    pages += [(5000 + i, f"http://big.com/rare{i}/x") for i in range(3)]
    return urltree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean"), []).collect()


def test_unlike_branches_stay_and_are_rejected(judged):
    for r in judged:
        if r.page_id < 5000:
            assert r.verdict == ("block" if "/spam/" in r.path else "allow"), r
            assert "/spam/" not in r.path or r.template == "/spam/*"


def test_rare_segments_become_wildcards(judged):
    assert {r.template for r in judged if r.page_id >= 5000} == {"/*/x"} or {r.template for r in judged if r.page_id >= 5000} == {"/*/*"}


def test_alike_branches_merge(spark):
    rng = random.Random(4)
    pages = [(i, f"http://a.com/{'xy'[i % 2]}/{i}") for i in range(400)]
    labels = [(i, rng.random() < 0.8) for i in range(400)] + [(None, True), (1, None), (0, False), (0, True)]
    got = urltree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean"), [])
    rows = got.collect()
    assert {r.template for r in rows} == {"/*/*"}
    good = {}
    for page, g in labels:
        if page is not None and g is not None:
            good[page] = good.get(page, True) and g
    share = sum(good.values()) / len(good)
    assert rows[0].purity == pytest.approx((sum(good.values()) + urltree.PRIOR_PAGES * share) / (len(good) + urltree.PRIOR_PAGES))


def test_a_small_branch_of_a_large_host_keeps_its_verdict(spark):
    many = spark.range(40_000).selectExpr("id AS page_id", "concat('http://a.com/', if(id < 30, 'casino', 'news'), '/', id) AS url")
    labels = many.where("page_id < 2000").selectExpr("page_id", "page_id >= 30 AND page_id % 10 > 0 AS good")
    got = urltree.judge(many, labels, []).groupBy("template", "verdict").count().collect()
    assert {(r.template, r.verdict, r["count"]) for r in got if "casino" in r.template} == {("/casino/*", "block", 30)}
    assert sum(r["count"] for r in got if r.verdict == "block") == 30


def test_whole_paths_are_judged(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://a.com/a/b/c/d/e/', if(id % 4 = 0, 'casino', 'news'), '/', id) AS url")
    labels = pages.selectExpr("page_id", "page_id % 4 > 0 AS good")
    got = {(r.template, r.verdict) for r in urltree.judge(pages, labels, []).collect()}
    assert got == {("/*/*/*/*/*/casino/*", "block"), ("/*/*/*/*/*/news/*", "allow")}


def by_hand(pages, labels):
    """page -> (template, purity): the tree level by level, by dictionaries."""
    good = {}
    for page, g in labels:
        good[page] = good.get(page, True) and g
    share = sum(good.values()) / len(good)
    tree = {}
    done = []
    for page, url in pages:
        host, path = split(url)
        segments = path.removeprefix("/").split("/")
        tree.setdefault((host, ""), []).append((page, segments, 0))
    while tree:
        following = {}
        for (host, template), members in tree.items():
            branches = {}
            for m in members:
                branches.setdefault(m[1][m[2]], []).append(m)
            marked = [good[m[0]] for m in members if m[0] in good]
            pooled = (sum(marked) + share) / (len(marked) + 1)
            for segment, inside in branches.items():
                own = [good[m[0]] for m in inside if m[0] in good]
                error = (pooled * (1 - pooled) / max(len(own), 1)) ** 0.5
                alike = abs((sum(own) + pooled) / (len(own) + 1) - pooled) <= urltree.SAME_WITHIN * error
                grown = template + "/" + ("*" if len(inside) < urltree.RARE_PAGES or alike else segment)
                for page, segments, level in inside:
                    if level + 1 == len(segments):
                        done.append((page, host, grown))
                    else:
                        following.setdefault((host, grown), []).append((page, segments, level + 1))
        tree = following
    out = {}
    for page, host, template in done:
        marked = [good[p] for p, h, t in done if (h, t) == (host, template) and p in good]
        out[page] = template, (sum(marked) + urltree.PRIOR_PAGES * share) / (len(marked) + urltree.PRIOR_PAGES)
    return out


def test_equals_a_tree_built_by_hand(spark):
    rng = random.Random(11)
    pages, labels = [], []
    for i in range(600):
        depth = rng.choice((0, 1, 2, 3, 6, 12))
        middle = ["same", "way"] * (depth // 4)
        path = "/".join([rng.choice(("news", "casino", "a", "b")), *middle, *[rng.choice("xyz") for _ in range(depth - len(middle))]])
        pages.append((i, f"http://{rng.choice(('p.com', 'q.com'))}/{path}{rng.choice(('', '/'))}"))
        if rng.random() < 0.7:
            labels.append((i, rng.random() < (0.1 if "casino" in path else 0.8)))
    pages += [(1000, "http://p.com/" + "deep/" * 5000), (1001, "http://r.com" + "/trap" * 3000), (1002, "http://r.com" + "/trap" * 3000 + "/end")]
    pages += [(1003 + i, "http://r.com" + "/trap" * 2000 + f"/{'uvw'[i % 3]}") for i in range(6)]
    got = urltree.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean"), []).collect()
    want = by_hand(pages, labels)
    assert len(got) == len(pages)
    for r in got:
        template, purity = want[r.page_id]
        assert r.template == template and r.purity == pytest.approx(purity), r.path[:200]
        assert r.verdict == ("block" if purity < urltree.LEAST_PURITY else "allow")


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urltree.judge(empty, spark.createDataFrame([], "page_id long, good boolean"), URL_RULES).count() == 0
