import random
import re

import pytest

from pairset.llm import url_filters as uf

PAGES = "page_id long, url string, host string, filter string"


def judged(spark, *urls, compiled=None):
    df = spark.createDataFrame([(i, u, "h", "f") for i, u in enumerate(urls)], PAGES)
    return [(r["filter"].host, r["filter"].path, r["filter"].rule, r["filter"].verdict, list(r["filter"].patterns))
            for r in uf.filtered(df, compiled).orderBy("page_id").collect()]


def brute(url, compiled):
    """Every rule against the URL, without tokens."""
    whole = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = m.groups() if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in compiled if re.search(r.regex.replace(r"\z", r"\Z"), host + path if r.by_host else whole)]
    hosts, others = [r for r in fits if r.by_host], [r for r in fits if not r.by_host]
    best = max(hosts, key=lambda r: len(r.name), default=None)
    blocked = bool(others) and all(r.action == "block" for r in others)
    return host, path, best.name if best else None, best.action if best else "block" if blocked else "allow", [r.name for r in others]


def test_host_rules(spark):
    got = judged(spark, "https://a.example.org/es/x", "https://EXAMPLE.org/ES/x", "http://badexample.org/es/", "http://example.org/en/12?x#y",
                 "http://x.com/fr/", "http://x.com/de/a#b", "http://org", "http://x.org?y/", "http://com.net/fr/")
    assert [g[:4] for g in got] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/ES/x", "org/", "allow"), ("badexample.org", "/es/", "org/", "allow"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/a", "com/de/", "block"),
        ("org", "", None, "allow"), ("x.org", "", None, "allow"), ("com.net", "/fr/", None, "allow"),
    ]


def test_patterns(spark):
    compiled = uf.rules([], [("block", "||ads.*^banner"), ("block", "|http://x."), ("block", ".gif|"), ("allow", "/ok^"), ("block", "a+b"), ("block", "*")][:5])
    urls = ["http://ads.y.net/banner1", "http://loads.y.net/banner1", "http://x.net/", "https://x.net/?u=http://x.", "http://y/a.gif", "http://y/a.gif?",
            "http://ads.z/banner/ok", "http://q/A+B", "http://q/aab", "http://y/a.gif\n"]
    got = judged(spark, *urls, compiled=compiled)
    assert [g[3] for g in got] == ["block", "allow", "block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert got == [brute(u, compiled) for u in urls]


def test_whole_tokens_only():
    assert uf.Rule.pattern("block", "||ads-track.").tokens == ("ads", "track")
    assert uf.Rule.pattern("block", "utm_source=*feed|").tokens == ("source",)
    assert uf.Rule.pattern("block", "|https://a.b*c").tokens == ("https", "a")
    assert uf.Rule.host("block", "example.org", "/EN/1").tokens == ("example", "org", "en")


def test_rarest_token_is_chosen_by_counts(spark):
    compiled = uf.rules([("block", "aa.bb", "/"), ("allow", "bb", "/")], [("block", "*zz*")])
    urls = spark.createDataFrame([("http://aa.bb/",), ("http://aa.cc/",), ("http://aa.dd/",), (None,)], "url string")
    counts = uf.token_counts(urls, compiled)
    assert counts == {"aa": 3, "bb": 1}
    assert uf.Index.build(compiled, counts).tokens == ("bb", "bb", None)


def test_equals_every_rule_against_every_url(spark):
    rng = random.Random(1)
    parts = ["a", "b", "ads", "x1", "org", "com", "é", "ADS", "q"]
    seps = ["/", ".", "-", "?", "#", "=", "_", "&", "://", "%"]
    urls = ["http://" * rng.randint(0, 1) + "".join(rng.choice(parts) + rng.choice(seps) * rng.randint(0, 1) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    patterns = [(rng.choice(["block", "allow"]), rng.choice(["", "|", "||"]) + "".join(rng.choice([*parts[:5], "*", "^", "/", "."]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "|"])) for _ in range(40)]
    compiled = uf.rules([("allow", "org", "/"), ("block", "a.org", "/b"), ("block", "com", "/"), ("allow", "ads.com", "/q")], patterns)
    assert judged(spark, *urls, compiled=compiled) == [brute(u, compiled) for u in urls]


def test_null_empty_long_repeated(spark):
    long = "http://ads-track.net/" + "a/" * 200_000 + "?replytocom=1"
    got = judged(spark, None, "", "no scheme ads", long, long)
    assert [g[:4] for g in got[:3]] == [("", "", None, "allow")] * 3
    assert got[3] == got[4] and got[3][3] == "block" and len(got[3][1]) == 400_001 and got[3][4] == ["||ads-track.", "?replytocom="]


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], PAGES)
    assert uf.filtered(df).count() == 0
    assert judged(spark, "http://example.org/es/", compiled=[])[0][2:4] == (None, "allow")


@pytest.mark.parametrize("name", ["filter", "out"])
def test_only_narrow_jvm_plan(spark, name):
    df = spark.createDataFrame([(1, "http://x.org/", "h", "f")], PAGES)
    plan = uf.filtered(df, out=name)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
