import random
import re
from collections import Counter, defaultdict

import pytest

from stratafile.llm import url_filter as op
from stratafile.llm.queries import URL_RULES

URLS = {
    "http://a.EXAMPLE.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://a.example.net/de/1?x=/en/": ("a.example.net", "/de/1", "net/", "block"),
    "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "https://notexample.com/de/5": ("notexample.com", "/de/5", None, "allow"),
    "https://x.org/fr/7#a?b": ("x.org", "/fr/7", "org/fr/", "allow"),
    "http://net": ("net", "", None, "allow"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://HÉ.com?q://z/": ("hÉ.com", "", None, "allow"),
    "ftp://h#f/x": ("h", "", None, "allow"),
    "no scheme/net/": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://h.com/" + "a/" * 300: ("h.com", "/" + "a/" * 300, None, "allow"),
}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(URLS)] + [(0, next(iter(URLS)), "h", "t")], "page_id long, url string, host string, template string")
    labels = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, bad int")
    got = op.filter_urls(pages, labels, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(URLS.values())[r.page_id]
    assert op.filter_urls(pages.limit(0), labels, URL_RULES).collect() == []


def test_bad_templates_are_rejected(spark):
    rows, bad = [], []
    for i in range(300):
        rows.append((i, f"http://s.com/news/{i}.html"))
        bad.append((i, int(i % 10 == 0)))
        rows.append((1000 + i, f"http://s.com/casino/win-{1000 + i}"))
        bad.append((1000 + i, int(i % 10 != 0)))
        rows.append((2000 + i, f"http://s.com/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/{2000 + i}"))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "doc_id long, bad int")
    got = {r.page_id: r for r in op.filter_urls(pages, labels, []).collect()}
    assert all(got[i].verdict == "allow" and got[1000 + i].verdict == "block" for i in range(300))
    assert len({got[2000 + i].template for i in range(300)}) == 1 and "*" in got[2000].template


def brute(urls, bad):
    """{url: (template, purity)} by a plain tree of each host. urls: (url, document); bad: {document: 0 or 1}."""
    hosts = defaultdict(list)
    for url, doc in urls:
        host, _, path = url.split("://")[1].partition("/")
        segs = [s for s in re.sub("[0-9]+", "#", path).split("/") if s]
        hosts[host].append((url, segs, bad.get(doc)))
    known = [b for rows in hosts.values() for *_, b in rows if b is not None]
    share = sum(known) / len(known) if known else 0.0
    out = {}
    for rows in hosts.values():
        named, mass, labels = {}, Counter(), lambda own: [b for *_, b in own if b is not None]

        def name(own, at, depth):
            for r in [r for r in own if len(r[1]) == depth]:
                named[r[0]] = at
            deep = [r for r in own if len(r[1]) > depth]
            kinds = Counter(r[1][depth] for r in deep)
            wild = lambda s: "*" if len(kinds) > op.MANY and kinds[s] * op.RARE < len(deep) else s  # noqa: B023, E731
            for s in {wild(r[1][depth]) for r in deep}:
                name([r for r in deep if wild(r[1][depth]) == s], (*at, s), depth + 1)

        name(rows, (), 0)
        alone, own = {}, defaultdict(list)
        for url, _, b in rows:
            own[named[url]] += [] if b is None else [b]
        for d in range(max(map(len, own), default=0), 0, -1):
            at = {n: own[n] for n in list(own) if len(n) == d}
            for n, x in at.items():
                pool = [b for m, y in at.items() if m[:-1] == n[:-1] for b in y]
                q = sum(pool) / len(pool) if pool else 0
                gap = max(abs(sum(x) / len(x) - q) - 0.5 / len(x), 0) if x else 0
                if gap * gap * len(x) > op.Z2 * q * (1 - q):
                    alone[n] = x
                else:
                    own[n[:-1]] = own[n[:-1]] + x
        alone[()] = own[()]
        host = labels(rows)
        of_host = (sum(host) + op.SMOOTH * share) / (len(host) + op.SMOOTH)
        for url, tpl in named.items():
            node = max((n for n in alone if tpl[: len(n)] == n), key=len)
            text = "/" + "/".join(node) + ("" if len(node) == len(tpl) else "/**" if node else "**")
            out[url] = (text, round((sum(alone[node]) + op.SMOOTH * of_host) / (len(alone[node]) + op.SMOOTH), 9))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_tree(spark, seed):
    rnd = random.Random(seed)
    urls, bad = [], {}
    for i in range(1500):
        host = rnd.choice(["a.com", "a.com", "b.org", f"h{i % 5}.net"])
        way = [rnd.choice(["x", "y", "z", f"v{rnd.randint(1, 60)}", f"page-{i}"]) for _ in range(rnd.choice([0, 1, 2, 2, 3, 4, 8]))]
        way = ["p", "q", "r", "s", "t", "u", "v"][: rnd.choice([0, 7, 7, 5])] + way if host == "b.org" else way
        urls.append((f"http://{host}/" + "/".join([*way, str(i)]), i))
        if rnd.random() < 0.5:
            bad[i] = int(rnd.random() < (0.9 if "x" in way else 0.1) * (1 if host == "a.com" else 0.5))
    pages = spark.createDataFrame([(i, u, i) for u, i in urls], "page_id long, url string, own long")
    labels = spark.createDataFrame(list(bad.items()), "doc_id long, bad int")
    got = op.filter_urls(pages, labels, [], document=pages.own).collect()
    want = brute(urls, bad)
    assert {urls[r.page_id][0]: (r.template, round(r.purity, 9)) for r in got} == want
    assert len({t for t, _ in want.values()}) > 5 and {r.verdict for r in got} == {"allow", "block"}


def test_wildcards_below_wildcards(spark):
    urls = [f"http://s.com/user/name{chr(97 + a % 26)}{chr(97 + a // 26)}/post/slug-{chr(97 + b)}{chr(97 + a % 26)}{chr(97 + a // 26)}" for a in range(40) for b in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    counts = op.counted(pages.select(op.host_path(pages.url)[0].alias("host"), op.segments(op.host_path(pages.url)[1]).alias("segs"), pages.page_id.alias("doc")), spark.createDataFrame([], "doc long, bad int"))
    assert {"/".join(r.tpl) for r in op.templates(counts).collect()} == {"user/*/post/*"}


@pytest.mark.parametrize("above", ["", "/a/b/c/d/e", "/a" * 150])
def test_deep_urls_are_judged_as_shallow_ones(spark, above):
    urls = [f"http://s.com{above}/{'bad' if i % 2 else 'good'}/x{chr(97 + i % 26)}/{i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[1])], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, bad int")
    got = op.filter_urls(pages, labels, []).collect()
    assert Counter((r.template, r.verdict) for r in got) == {(f"{above}/bad/**", "block"): 201, (f"{above}/good/**", "allow"): 200}
