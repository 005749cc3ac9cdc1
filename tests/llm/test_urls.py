from almanac.llm import urls

ROWS = [
    (1, "http://A.Example.NET/en/1?x=/de/"),
    (2, "https://a.example.net/de/1"),
    (3, "https://www.example.com/de/9"),
    (4, "https://x.org/fr/"),
    (5, "https://net"),
    (6, "https://cheap-pills.example.com/en/1"),
    (7, "https://www.casino-win.example.com/en/1"),
    (8, "https://search.casino-museum.example.com/en/1"),
    (9, None),
    (10, "no scheme/de/"),
    (11, ""),
    (12, "x://notexample.com/de/1"),
    (13, "http://h?q=://example.com/de/"),
    (3, "https://www.example.com/de/9"),
    (14, "https://u.example.com/pills/cheap"),
]


def test_rules_and_patterns(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de/1", "net/", "block")
    assert got[3] == ("www.example.com", "/de/9", "example.com/de/", "block")
    assert got[4] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("net", "", None, "allow")
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "block")
    assert got[8][2:] == (None, "allow")  # the allow rule outranks
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[12] == ("notexample.com", "/de/1", None, "allow")
    assert got[13] == ("h", "", None, "allow") and got[14][3] == "allow"
    assert urls.judge(pages).count() == len(ROWS)


def test_the_rarest_literal_is_the_index(spark):
    pages = spark.createDataFrame([("http://cheap.org/cheap",), ("http://cheap.net",), ("http://cheap-pills.org",)], "url string")
    index = {r.name: r.token for r in urls.pattern_index(pages).collect()}
    assert index["pills"] == "pills" and index["spam farm"] == "spam"


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, HOST string, verdict int, token string")
    found = urls.judge(pages)
    assert found.count() == 0 and sorted(found.columns) == ["host", "matched", "page_id", "path", "rule", "token", "url", "verdict"]
