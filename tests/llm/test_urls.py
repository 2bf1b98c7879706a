import random

import pytest
from pyspark.sql import functions as F

from fumikura.llm import urls


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = []
    for h, p, v in rules:
        if None in (h, p, v) or set(h) & set("/?#") or p[:1] not in ("", "/"):
            continue
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), v, h + p))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[2]


def judged(spark, links, rules, default="allow"):
    pages = spark.createDataFrame(list(enumerate(links)), "page_id bigint, url string")
    got = urls.judge_urls(pages, urls.rule_table(spark, rules), default=default).collect()
    assert len(got) == len(links)
    return {r.page_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("small", [True, False])
def test_random_rules(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(urls, "is_small", lambda *_: False)
    rng = random.Random(7)
    label = lambda: rng.choice(["a", "b", "net", "x-y", "é", ""])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "/en", "/e", "n/", "/é", "%2f"]) for _ in range(rng.randint(0, 4)))
    rules = [(host(3), rng.choice(["", "/", path()]), rng.choice(["block", "allow"])) for _ in range(60)]
    links = [rng.choice(["http://", "ftp://u:p@", "", "://"]) + host(5).upper() + rng.choice(["", "/"]) + path() + rng.choice(["", "?q=/en/", "#/en://b"]) for _ in range(800)]
    links += links[:5]
    for i, found in judged(spark, links, rules, "block").items():
        assert found == brute(links[i], rules, "block"), links[i]


def test_edges(spark):
    long = "http://" + "a." * 50_000 + "net/" + "x/" * 50_000
    links = [None, "", "net/", "http://net", "http://net/", "http://sub.NET/x", "http://subnet/x", "http://net:80/", "http://net?/", long, "a://b.net/c://d.org/fr/", "http://x.net/é\n/", "http://x.net/é\n/"]
    rules = [("net", "/", "block"), ("net", "/", "allow"), ("NET", "/é\n", "allow"), (None, "/", "block"), ("net", None, "block"), ("ne/t", "/", "block"), ("net", "x", "block"), ("net", "/x", "other")]
    got = judged(spark, links, rules)
    assert [got[i][3] for i in range(len(links))] == ["allow"] * 4 + ["block"] * 2 + ["allow"] * 3 + ["block"] * 2 + ["allow"] * 2
    assert got[0] == ("", "", None, "allow") and got[11][2] == "net/é\n" and got[9][2] == "net/"


def test_no_rules_no_pages_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h")], "page_id bigint, url string, host string").selectExpr("*", "1 AS verdict", "2 AS _url", "3 AS _page", "4 AS _own", "5 AS path")
    none = urls.rule_table(spark, [])
    assert [tuple(r) for r in urls.judge_urls(pages, none).collect()] == [(1, "a.net", "/", None, "allow")]
    rules = urls.rule_table(spark, [("net", "/", "block")])
    assert urls.judge_urls(pages.where(F.lit(False)), rules).count() == 0
    assert urls.keep_allowed(pages, rules).count() == 0
    kept = urls.keep_allowed(pages, urls.rule_table(spark, [("com", "/", "block")]))
    assert kept.columns == pages.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in pages.collect()]
    with pytest.raises(ValueError):
        urls.judge_urls(pages, rules, default="maybe")
