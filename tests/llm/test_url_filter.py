import math
from functools import cache

import pytest
from pyspark.sql import functions as F

from geoloom.llm import url_filter as op

URLS = [
    (1, "http://a.com/x"), (2, "https://EXAMPLE.com/en/1"), (3, "http://www.example.com/en/"), (4, "http://x.net/es/q?u=/fr/"), (5, "http://x.net/fr"), (6, "http://com"), (7, "http://notcom/"),
    (8, None), (9, ""), (10, "no scheme/com/"), (11, "http://x.org/en/1#http://y.com/"), (12, "http://net/es/"), (13, "http://x.net?/es/"), (14, "a://b://c.com/z"), (15, "http://sub.www.example.com/en/1"),
    (15, "http://sub.www.example.com/en/1"), (None, "http://zz.net/fr/1"), (16, "http://example.com/EN/1"), (17, "\nhttp://new.com/\nline"),
]


def host_path(url):
    _, sep, rest = (url or "").partition("://")
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i in range(n, len(rest)) if rest[i] in "?#"), len(rest))
    return rest[:n].translate({c: c + 32 for c in range(65, 91)}), rest[n:m]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_rules(spark):
    df = spark.createDataFrame([(*u, "<p>x</p>", 1) for u in URLS], "page_id long, url string, html string, rule int")
    rows = op.url_verdicts(df, op.RULES).collect()
    assert len(rows) == len(URLS)
    want = sorted(repr((i, *host_path(u), rule(*host_path(u))[0])) for i, u in URLS)
    assert sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in rows) == want
    assert all(r.verdict == rule(r.host, r.path)[1] for r in rows if r.rule) and all(r.verdict in ("allow", "block") for r in rows)
    none = op.url_verdicts(df.limit(0), op.RULES)
    assert none.count() == 0


def split(name, counts, total):
    @cache
    def best(e):
        if not e:
            return 0.0, 0, ()
        ways = [(best(e - 1)[0] + math.log(10 * total), -1)]
        ways += [(best(e - n)[0] - math.log(counts[name[e - n : e]] / total), -n) for n in range(1, e + 1) if name[e - n : e] in counts]
        cost, n = min(ways)
        return cost, -n, (*best(e + n)[2], name[e + n : e])

    return list(best(len(name))[2])


def test_segments(spark):
    counts = {"the": 50, "there": 9, "rain": 8, "here": 12, "in": 30, "re": 2, "spain": 4, "pa": 1, "ünï": 3, "extraordinarilylongword": 2, "extraordinarilylongwords": 1}
    names = ["therainin", "there", "thespain", "q", "xxthereyy", "spainünïthe", "inin" * 12, "theextraordinarilylongwordsrain", "extraordinarilylongwor"]
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.name: r.words for r in op.segmented(spark.createDataFrame([(n,) for n in [*names, "", None]], "name string"), df).collect()}
    assert got == {n: split(n, counts, sum(counts.values())) for n in names}


def test_classifier(spark):
    good = [(i, f"http://{a}{b}.com/news/{i}", f"<b>{a} {b}</b> news cats") for i, (a, b) in enumerate([("garden", "house"), ("house", "cats"), ("garden", "cats")] * 20)]
    bad = [(100 + i, f"http://{a}{b}.net/es/spam/{i}", f"{a} {b} spam") for i, (a, b) in enumerate([("casino", "bets"), ("bets", "pills"), ("casino", "pills")] * 20)]
    new = [(200, "http://catsgarden.org/news/", "cats"), (201, "http://pillscasino.org/spam/", "bets"), (202, "http://house.xyz/", None), (203, "http://betsbets.xyz/", "")]
    df = spark.createDataFrame(good + bad + new, "page_id long, url string, html string")
    rows = {r.page_id: r.verdict for r in op.url_verdicts(df, op.RULES).where(F.col("rule").isNull()).collect()}
    assert rows == {200: "allow", 201: "block", 202: "allow", 203: "block"}


def test_against_brute_force(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = op.op3_url_filter(spark, data).collect()
    urls = [tuple(r) for r in pages.select("page_id", "url").collect()]
    import re

    words = {}
    for (t,) in pages.select("html").collect():
        for w in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"<[^>]*>", b" ", t.encode().lower())):
            words[w.decode()] = words.get(w.decode(), 0) + 1
    total = sum(words.values())

    def tokens(host, path):
        out = []
        for at, text in (("h:", host), ("p:", path.lower())):
            for x in filter(None, re.split(r"[\W_]+", text)):
                out += [at + w for w in ([f"#{len(x)}"] if x.isdigit() else split(x, words, total))]
        return out

    count, prior = {"block": {}, "allow": {}}, {"block": 0, "allow": 0}
    for _, u in urls:
        h, p = host_path(u)
        if v := rule(h, p)[1]:
            prior[v] += 1
            for t in tokens(h, p):
                count[v][t] = count[v].get(t, 0) + 1
    vocabulary = set(count["block"]) | set(count["allow"])
    for r in rows:
        if r.rule is None:
            s = math.log((prior["block"] + 1) / (prior["allow"] + 1))
            for t in tokens(r.host, r.path):
                if t in vocabulary:
                    s += math.log((count["block"].get(t, 0) + 1) / (sum(count["block"].values()) + len(vocabulary)))
                    s -= math.log((count["allow"].get(t, 0) + 1) / (sum(count["allow"].values()) + len(vocabulary)))
            assert r.score == pytest.approx(s) and r.verdict == ("block" if s > 0 else "allow")


def test_long_words_and_open_tags(spark):
    html = ["a" + "\u00e9" * 60, "<" * 200_000 + " open", "<p>x</p>" * 3 + "<unclosed words", "<a <b> c>d", None, "\u0434" * 500]
    df = spark.createDataFrame([(i, f"http://h{i}.org/{'abc' * 700 if i == 2 else 'p'}", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    counts = {r.word: r.n for r in op.word_counts(df, "html").collect()}
    assert counts == {"a" + "\u00e9" * 60: 1, "open": 1, "x": 3, "unclosed": 1, "words": 1, "c": 1, "d": 1, "\u0434" * 500: 1}
    assert op.url_verdicts(df, op.RULES).count() == len(html)
