from factloom.llm.queries import URL_RULES
from factloom.llm.url_rules import judged, rule_table
from tests.llm.common import plain


def page_table(spark, pages):
    return spark.createDataFrame(
        [(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)],
        "page_id long, url string, html string, host string, node string",
    )


def verdicts(spark, pages, rules=URL_RULES, redirects=None):
    found = judged(page_table(spark, pages), rule_table(spark, rules), redirects)
    return {r["page_id"]: r for r in found.collect()}


def test_parts_and_longest_rule(spark):
    pages = [
        ("http://a.NET/x?y", None), ("https://b.example.net/en/1#top", ""), ("x://net", None),
        ("http://notexample.com/de/", None), ("http://example.com/de/?", None), ("no scheme", None),
        (None, None), ("http://EXAMPLE.org?q/fr/", None), ("HTTP://w.org/fr/", None), ("://", None),
    ]
    found = verdicts(spark, pages)
    got = [(found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) for i in range(len(pages))]
    assert got == [
        ("a.net", "/x", "net/", "block"), ("b.example.net", "/en/1", "example.net/en/", "allow"),
        ("net", "", None, "allow"), ("notexample.com", "/de/", None, "allow"),
        ("example.com", "/de/", "example.com/de/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("example.org", "", None, "allow"), ("w.org", "/fr/", "org/fr/", "allow"),
        ("", "", None, "allow"),
    ]


def test_aliases_carry_blocks_and_allow_comes_first(spark):
    canonical = '<html><LINK href="{}" rel=canonical>'
    pages = [
        ("http://a.com/1", canonical.format("http://spam.net/1")),   # alias of a blocked page
        ("http://b.com/1", canonical.format("//a.com/1#x")),          # two steps away
        ("http://c.com/1", canonical.format("http://spam.net/2")),    # its component also has an allow
        ("http://w.example.net/en/9", canonical.format("http://spam.net/2")),
        ("http://d.com/a/b", canonical.format("c?x=1&amp;y=2")),      # relative: /a/c?x=1&y=2
        ("http://d.com/a/c?x=1&y=2", '<meta http-equiv="refresh" content="0; url=\'http://spam.net/3\'">'),
        ("http://e.com/", "<link rel=stylesheet href=http://spam.net/1>"),
        ("http://f.com/", None),
        ("http://spam.net/1", None),
    ]
    redirects = spark.createDataFrame(
        [("http://f.com/", "https://spam.net/1"), (None, "http://x.net/")],
        "source_url string, target_url string",
    )
    found = verdicts(spark, pages, redirects=redirects)
    assert [found[i]["verdict"] for i in range(9)] == [
        "block", "block", "allow", "allow", "block", "block", "allow", "block", "block",
    ]
    assert found[0]["rule"] is None and found[8]["rule"] == "net/"
    assert found[0]["alias_of"] == found[1]["alias_of"] == found[7]["alias_of"] == "a.com/1"


def test_empty_and_repeated(spark):
    rules = rule_table(spark, URL_RULES)
    assert judged(page_table(spark, []), rules).collect() == []
    twice = page_table(spark, [("http://a.net/", None)] * 3)
    assert plain(judged(twice, rules), "page_id", "verdict") == [(i, "block") for i in range(3)]
