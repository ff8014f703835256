import random
import re

from simpairs.llm.queries import URL_RULES
from simpairs.llm.url_filters import RULE_SCHEMA, filter_urls

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(UP), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = filter_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], rules), urls[r.page_id]


def test_contract_rules_and_odd_urls(spark):
    check(spark, [
        None, "", "no scheme", "http://", "HTTP://A.NET/", "http://a.net", "http://a.net?x", "http://xnet/", "http://net/",
        "http://WWW.Example.NET/en/x?y#z", "http://example.net/EN/", "https://b.example.com/de/1", "http://org/fr/", "http://a.org/fr",
        "http://a.org/fr/x://y", "x://u@h:80/p", "http://example.net/en/", "http://example.net/en/", "http://é.net/ü", "http://a..net/",
    ], URL_RULES)


def test_nested_rules_against_brute_force(spark):
    rnd = random.Random(3)
    labels = ["a", "b", "c-d", "a0", "z"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    paths = ["/" + "/".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 3))) for _ in range(400)]
    rules = {(".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 3))), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(60)}
    check(spark, [f"http://{h}{p}" for h, p in zip(hosts, paths)], [(h, p, a) for (h, p), a in rules.items()])


def test_empty_tables_and_clashing_columns(spark):
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "p", "r")], "page_id long, url string, host string, path string, rule string")
    assert [r.verdict for r in filter_urls(pages, rules).collect()] == ["block"]
    assert [r.verdict for r in filter_urls(pages, spark.createDataFrame([], RULE_SCHEMA)).collect()] == ["allow"]
