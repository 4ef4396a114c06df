import random

import pytest

from riskweave.llm import urls as U
from riskweave.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in host), path[:end]


def rule_of(host, path, rules):
    fits = [r for r, _ in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
            and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


URLS = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q=/es/", "http://example.org/en/2", "http://x.com/fr/1#f", "http://x.com/de",
        "http://x.com/de/9", "ftp://org/", "http://org", "nothing", None, "", "http://notorg/x", "a://b://c.com/fr/", "http://É.com/fr/ü",
        "http://example.org?x=/es/", "http://myexample.org/es/1", "://com/de/"]


def test_rules_and_splitting(spark):
    df = spark.createDataFrame([(i, u, "m") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    verdict = dict(URL_RULES)
    for r in U.judge(df, URL_RULES).collect():
        host, path = parts(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == rule_of(host, path, URL_RULES)
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None or r["verdict"] == verdict[r["rule"]])


def brute(outcomes):
    """The same shrinkage with dictionaries: host -> (mean, bound)."""
    def count(key):
        n = {}
        for h, b in outcomes:
            x = n.setdefault(key(h), [0, 0])
            x[0] += 1
            x[1] += b
        return n

    def strength(kids, prior):
        spread = sum((b - n * prior(k)) ** 2 - n * prior(k) * (1 - prior(k)) for k, (n, b) in kids.items())
        chance = sum(n * (n - 1) * prior(k) * (1 - prior(k)) for k, (n, b) in kids.items())
        return 1000.0 if not chance or spread <= 0 else min(1000.0, max(1.0, chance / spread - 1))
    last = lambda h, n: ".".join(h.split(".")[-n:])
    root = (sum(b for _, b in outcomes) + 1) / (len(outcomes) + 2)
    suf, dom, host = count(lambda h: last(h, 1)), count(lambda h: last(h, 2)), count(lambda h: h)
    s1 = strength(suf, lambda k: root)
    m1 = {k: (s1 * root + b) / (s1 + n) for k, (n, b) in suf.items()}
    s2 = strength(dom, lambda k: m1[last(k, 1)])
    m2 = {k: (s2 * m1[last(k, 1)] + b) / (s2 + n) for k, (n, b) in dom.items()}
    s3 = strength(host, lambda k: m2[last(k, 2)])

    def of(h):
        p = m2.get(last(h, 2), m1.get(last(h, 1), root))
        n, b = host.get(h, (0, 0))
        a, c = s3 * p + b, s3 * (1 - p) + n - b
        mean = a / (a + c)
        return mean, mean - 1.645 * (a * c / ((a + c) ** 2 * (a + c + 1))) ** 0.5
    return of


@pytest.mark.parametrize("seed", [1, 2])
def test_reputation_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rate = {f"h{i}.d{i % 7}.{t}": rng.random() ** 2 for i in range(40) for t in ("com", "net", "org")}
    outcomes = [(h, int(rng.random() < p)) for h, p in rate.items() if not h.endswith(".org") for _ in range(rng.randint(0, 9))]
    outcomes += [("hot.d1.com", 1)] * len(outcomes)              # one host with half of the pages
    pages = [(i, f"http://{h}/p") for i, h in enumerate([*rate, "hot.d1.com", "new.unseen.com", "new.unseen.xyz"])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = U.judge(df, [], spark.createDataFrame(outcomes, "host string, bad int")).collect()
    want = brute(outcomes)
    assert len(out) == len(pages)
    for r in out:
        mean, bound = want(r["host"])
        assert (r["bad_rate"], r["bound"]) == (pytest.approx(mean), pytest.approx(bound))
        assert r["verdict"] == ("block" if bound > 0.5 else "allow")
    assert next(r for r in out if r["host"] == "hot.d1.com")["verdict"] == "block"


def test_empty_tables_and_rule_limits(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(None, None), (None, None)], "page_id long, url string")
    got = U.judge(one, []).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in got] == [("", None, "allow")] * 2
    with pytest.raises(ValueError):
        U.fitting_rules(one, [("x/", "allow")] * (U.MAX_RULES + 1))


def test_ten_thousand_rules(spark):
    rng = random.Random(6)
    names = [f"h{i}.d{i % 50}.{t}" for i in range(2000) for t in ("com", "net")] + [f"d{i}.com" for i in range(50)] + ["com", "net"]
    rules = list({f"{rng.choice(names)}/{rng.choice(['', 'a', 'a/', 'ab', 'b/c'])}": None for _ in range(30_000)})[:U.MAX_RULES]
    rules = [(r, "block" if i % 2 else "allow") for i, r in enumerate(rules)]
    urls = [f"http://{rng.choice(['', 'www.', 'x'])}{rng.choice(names)}/{rng.choice(['', 'a', 'a/x', 'abc', 'b/c', 'z'])}" for _ in range(400)]
    urls += ["http://" + "a." * 20_000 + "com/a"]                 # a host of very many labels
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    verdict = dict(rules)
    by_host = {}
    for r, _ in rules:
        by_host.setdefault(r.partition("/")[0], []).append(r)
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r["page_id"]])
        last = host.split(".")
        fits = [x for n in range(1, 5) for x in by_host.get(".".join(last[-n:]), []) if n <= len(last) and path.startswith("/" + x.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert (r["rule"] is None) == (best is None) and (best is None or len(r["rule"]) == len(best) and r["verdict"] == verdict[r["rule"]])
