"""URL parsing, rules and shrinkage."""

import pytest

from trialspark.llm import host_reputation as H

URLS = [None, "", "no scheme", "http://", "http://A.Com", "https://a.com/x?y#z", "http://WWW.Example.COM/en/1",
        "http://example.com/en/", "http://sub.example.com/en/2", "http://example.com/de/", "x://b.net/es/1", "x://net/fr/",
        "http://c.net/en/", "http://a.com?q=/", "http://a.com#/x", "http://notexample.com/en/", "http://u@h.org:80/p",
        "a://b://c.com/", "//x.com/", "http://www.example.com.evil.org/en/"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    m = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:m]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, w) for w, h, p in H.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_parsing_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' as Host", "1 as n")
    none = spark.createDataFrame([], "id long, bad int")
    rows = {r.page_id: r for r in H.judge_urls(df, none).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (verdict or "allow")
        assert rows[i].n == 1


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("x.foo.co.uk", "foo.co.uk", "co.uk"),
    ("10.0.0.1", "10.0.0.1", ""), ("localhost", "localhost", ""), ("", "", ""), ("u@w.site.org:8080", "site.org", "org")])
def test_domains(spark, host, domain, suffix):
    df = spark.createDataFrame([(host,)], "h string")
    d = H.registered_domain(df["h"])
    assert tuple(df.select(d, H.public_suffix(d)).first()) == (domain, suffix)


def test_few_labels_are_shrunk_and_many_decide(spark):
    pages, labels, n = [], [], 0
    for host, count, bad in [("bad.x.org", 60, 58), ("one.y.org", 1, 1), ("good.y.org", 60, 1), ("new.x.org", 5, None),
                             ("ok.z.com", 200, 10)]:
        for i in range(count):
            pages.append((n, f"http://{host}/p{i}"))
            if bad is not None:
                labels.append((n, int(i < bad)))
            n += 1
    labels += [(0, 1), (None, 1), (1, None)]
    out = H.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                       spark.createDataFrame(labels, "id long, bad int"))
    by = {r.host: r for r in out.collect()}
    assert by["bad.x.org"].verdict == "block" and by["bad.x.org"].bad_lower > 0.8
    assert by["one.y.org"].verdict == "allow" and 0.1 < by["one.y.org"].bad_rate < 0.95
    assert by["good.y.org"].verdict == by["ok.z.com"].verdict == "allow"
    assert by["new.x.org"].labelled == 0 and by["new.x.org"].bad_rate > by["ok.z.com"].bad_rate
    assert out.count() == len(pages)
    assert H.judge_urls(out.select("page_id", "url").limit(0), spark.createDataFrame([], "id long, bad int")).count() == 0
