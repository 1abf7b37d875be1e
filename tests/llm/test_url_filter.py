import random
import re

import pytest

from relpoint.llm.url_filter import RULES, judged, keep_allowed, training_rows, with_features

SCHEMA = "page_id long, url string, html string"


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def urls():
    rng = random.Random(1)
    hosts = ["example.org", "www.Example.ORG", "a.com", "com", "org", "notexample.org", "x.net", "É.com", "b.example.net:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123?x=1&y=2", "/fr/9#top", "/de/7.html", "/DE/", "?q=/es/", "#/fr/", "/a://b/es/"]
    found = [f"{rng.choice(['http', 'https', 'ftp', ''])}://{h}{p}" for h in hosts for p in paths]
    return found + [None, "", "example.org/es/", "://", "http:/x.org/", "http://u:p@c.com/de/", "x\nhttp://a\n.org/\ny"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, u, None) for k, u in enumerate(urls())] + [(None, "http://a.org/", "x"), (0, urls()[0], None)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as suffix", "2 as host", "3 as score", "4 as id")
    return judged(pages.repartition(3)).collect()


def test_host_path_and_rule_match_brute_force(found):
    known = dict(enumerate(urls())) | {None: "http://a.org/"}
    assert len(found) == len(urls()) + 2
    for r in found:
        host, path, rule, verdict = slow(known[r["id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), known[r["id"]]
        assert r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
        if verdict:
            assert r["verdict"] == verdict
        else:
            assert r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_trees_learn_the_rules(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        path = rng.choice(["fr", "de"])
        query = "?a=1&b=2&c=3" if path == "de" else ""
        rows.append((k, f"http://s{k}.{rng.choice(['com', 'net'])}/{path}/{k}{query}", None))
    pages = spark.createDataFrame(rows, SCHEMA)
    scored = judged(pages).where("rule is null").collect()
    assert len(scored) > 100
    assert sum((r["verdict"] == "block") == ("/de/" in r["path"]) for r in scored) > 0.95 * len(scored)


def test_one_class_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "http://a.com/de/", None), (2, "http://b.net/", None)], SCHEMA)
    assert {(r["id"], r["verdict"]) for r in judged(one).collect()} == {(1, "block"), (2, "block")}
    none = spark.createDataFrame([(2, "http://b.net/", None), (None, None, None)], SCHEMA)
    assert {r["verdict"] for r in judged(none).collect()} == {"allow"}
    assert judged(one.limit(0)).count() == 0
    kept = keep_allowed(one.union(spark.createDataFrame([(3, "http://c.org/", "h")], SCHEMA)))
    assert kept.columns == one.columns and {r["page_id"] for r in kept.collect()} >= {3}


def test_plan_has_no_python(spark):
    plan = judged(spark.createDataFrame([(k, u, None) for k, u in enumerate(urls())], SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


@pytest.mark.parametrize("rows", [20, 60, 20_000])
def test_copies_of_one_url_count_as_weights(spark, rows):
    """60 copies of a blocked URL and 60 allowed ones, whatever the bound of the sample."""
    copies = [(k, "http://s.com/de/a?x=1&y=2&z=3", None) for k in range(60)]
    others = [(100 + k, f"http://s{k}.com/fr/{k}", None) for k in range(60)]
    free = [(900, "http://s.net/de/a?x=1&y=2&z=3", None), (901, "http://s1.net/fr/5", None)]
    pages = spark.createDataFrame(copies + others + free, SCHEMA)
    labels, chosen = training_rows(with_features(pages, "page_id", "url", RULES), rows)
    found = chosen.collect()
    assert labels == {0.0, 1.0} and len(found) == 1 + min(60, rows // 2)
    for label in labels:
        assert abs(sum(r["weight"] for r in found if r["label"] == label) - 60) < 1e-6
    scored = {r["id"]: r for r in judged(pages, rows=rows).collect()}
    assert scored[0]["score"] > 0.5 > max(scored[100 + k]["score"] for k in range(60))
    assert scored[900]["verdict"] == "block" and scored[901]["verdict"] == "allow"
