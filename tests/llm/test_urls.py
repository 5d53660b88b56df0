"""URL rules and host reputations against a plain Python version."""
import random
import re

import pytest

from tillstar.llm import urls


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def best_rule(host, path, rules):
    fit = [(len(r), r, v) for v, r in rules
           for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])]
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def site(host):
    b = re.sub(r"^.*@|:[0-9]*$|\.$", "", host)
    b = re.sub(r":[0-9]*$|\.$", "", b)
    if re.search(r"^[0-9.]+$|\[", b):
        return b, ""
    m = re.search(rf"(?:^|\.)((?:{'|'.join(urls.SECOND_LEVEL)})\.[a-z]{{2}})$", b)
    suffix = m.group(1) if m else b.split(".")[-1]
    return ".".join(b.split(".")[-(suffix.count(".") + 2):]), suffix


def shrink(groups, priors):
    """Posterior means of {key: (n, bad)} towards priors, and the weight."""
    seen = [(n, k, priors[g]) for g, (n, k) in groups.items() if n]
    pairs = sum(n * (n - 1) for n, _, _ in seen)
    rho = (sum((k - n * m) ** 2 / (m * (1 - m)) for n, k, m in seen) - sum(n for n, _, _ in seen)) / pairs if pairs \
        else urls.LEAST_RHO
    c = 1 / min(max(rho, urls.LEAST_RHO), urls.MOST_RHO) - 1
    return {g: min(max((k + c * priors[g]) / (n + c), 1e-6), 1 - 1e-6) for g, (n, k) in groups.items()}, c


def brute(pages, labels, rules):
    marks = {}
    for i, q, t in labels:
        outcome = max([x for x in (None if q is None else 1 - q, t) if x is not None], default=None)
        if i is not None and outcome is not None:
            marks.setdefault(i, []).append(outcome)
    hosts = {}
    for i, url in pages:
        n, k = hosts.get(parts(url)[0], (0, 0))
        got = marks.get(i, [])
        hosts[parts(url)[0]] = (n + len(got), k + sum(got))
    def level(key):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + k)
        return out
    n, k = level(lambda h: 0).get(0, (0, 0))
    by_suffix, by_domain = level(lambda h: site(h)[1]), level(site)
    m0, _ = shrink(by_suffix, dict.fromkeys(by_suffix, (k + 1) / (n + 2)))
    m1, _ = shrink(by_domain, {d: m0[d[1]] for d in by_domain})
    prior = {h: m1[site(h)] for h in hosts}
    _, c = shrink(hosts, prior)
    bounds = {}
    for h, (n, k) in hosts.items():
        a, b = k + c * prior[h], n - k + c * (1 - prior[h])
        bounds[h] = a / (a + b) - urls.Z * (a * b / (a + b + 1)) ** 0.5 / (a + b)
    out = []
    for i, url in pages:
        h, p = parts(url)
        r, v = best_rule(h, p, rules)
        out.append((i, h, p, r, v or ("block" if bounds[h] > urls.BLOCK_RATE else "allow"), round(bounds[h], 9)))
    return out


def judged(spark, pages, labels, rules=urls.RULES, extra=""):
    p = spark.createDataFrame([(*r, "x", "y") for r in pages], "page_id long, url string, host string, n string")
    got = urls.judge(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                     urls.rule_table(spark, rules))
    assert got.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted([(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.bad_bound, 9)) for r in got.collect()], key=key)


def test_rules_and_reputations(spark):
    rng = random.Random(3)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m") for b in ("spam", "news", "shop", "misc") for c in ("org", "com", "co.uk")]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'en', ''])}/{i}?q=://z#f") for i in range(600)]
    pages += [(600, None), (601, ""), (602, "no scheme"), (603, "HTTP://A.Example.NET/en/x"), (604, "x://example.com/de/"),
              (605, "x://EXAMPLE.com/de"), (606, "x://net"), (607, "x://net/"), (608, "x://notexample.com/de/1"),
              (609, "x://a.org/fr/1"), (610, "a://b://c/d"), (611, "x://u@h.net:80/p"), (612, "http://10.0.0.1/"),
              (613, "x://" + "a." * 3000 + "net/" + "y" * 9000), (5, pages[5][1]), (5, pages[5][1]), (None, "http://m.spam.com/a")]
    labels = [(i, 0 if "spam" in u else 1, int(rng.random() < 0.1)) for i, u in pages[:400]]
    labels += [(7, None, 1), (8, None, None), (None, 0, 1), (9, 1, 0), (9, 0, 0), (99999, 0, 0)]
    want = sorted(brute(pages, labels, urls.RULES), key=lambda r: tuple((x is None, str(x)) for x in r))
    got = judged(spark, pages, labels)
    assert got == want
    by_host = {r[1]: r[4] for r in got if r[3] is None}
    assert by_host["www.spam.com"] == "block" and by_host["www.news.com"] == "allow"


def test_no_labels_rules_or_pages(spark):
    pages = [(1, "http://a.net/x"), (2, "http://b.org/fr/x")]
    assert [r[3:5] for r in judged(spark, pages, [])] == [("net/", "block"), ("org/fr/", "allow")]
    assert [r[3:5] for r in judged(spark, pages, [], rules=())] == [(None, "allow")] * 2
    assert judged(spark, [], [(1, 0, 1)]) == []


@pytest.mark.parametrize("host, want", [
    ("www.example.net", ("example.net", "net")), ("a.b.co.uk", ("b.co.uk", "co.uk")), ("co.uk", ("co.uk", "co.uk")),
    ("localhost", ("localhost", "localhost")), ("u:p@x.y.org:8080", ("y.org", "org")), ("10.0.0.1", ("10.0.0.1", "")),
    ("x.org.", ("x.org", "org")), ("", ("", ""))])
def test_registered_domain(spark, host, want):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(host,)], "h string").select(*urls._site(F.col("h"))).first()
    assert tuple(got) == want == site(host)
