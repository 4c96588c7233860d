import duckdb
import pandas as pd

from kairos.llm import oracles
from kairos.llm import urls as U

ROWS = [
    (1, "https://A.Example.net/en/x?q=1#f", '<a href="https://spam.com/x">s</a><a HREF = //good.org/>'), (2, "http://example.net/de/", None),
    (3, "http://net?x", ""), (4, "net/", "x"), (5, None, "<a href='http://a.b.c/'>"), (6, "x://www.example.com/de/1", ""),
    (7, "x://www.example.com/deals", ""), (8, "http://notexample.net.org/fr/", ""), (9, "ftp://xnet/fr/", ""), (10, "http://org/fr/", ""),
    (11, "a://b://c/d#?", ""), (12, "http://liker.com/", '<a href="http://www.example.net/">' * 3), (12, "http://liker.com/", '<a href="http://www.example.net/">'),
    (13, "http://www.example.net/", '<a href="http://liked.com/">'), (14, "http://liked.com/", ""), (None, "http://x.y.z.w/" + "p" * 50_000, "<" * 50_000),
    (15, "://", ""), (16, "http://deep.liker.com", "")]
SCHEMA = "page_id long, url string, html string, host string"


def test_rules_and_hosts(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3][:3] == ("net", "", None) and got[4][:3] == ("", "", None) == got[5][:3] == got[15][:3]
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2] is None
    assert got[8][2:] == ("org/fr/", "allow") and got[9][2] is None and got[10][2:] == ("org/fr/", "allow")
    assert got[11][:2] == ("b:", "//c/d")
    # who links to blocked hosts is distrusted, who is linked from there is not
    assert got[12][3] == "block" and got[14][3] == "allow"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(ROWS, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT AS page_id, url, html FROM frame")
    norm = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    cols = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    want = norm(con.execute(f"SELECT {', '.join(cols)} FROM ({oracles.URLS})").fetchall())
    assert norm(tuple(r) for r in U.judge(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)).select(cols).collect()) == want


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hosts_that_only_receive_get_their_share(spark):
    # two-label hosts without subdomains: nobody links to spamblog.com, and sink.net links nowhere
    rows = [(1, "http://www.bad.net/", ""), (2, "http://spamblog.com/", '<a href="http://www.bad.net/">'),
            (3, "http://a.example.net/en/", '<a href="http://sink.net/">'), (4, "http://sink.net/", "")]
    got = {r["page_id"]: r for r in U.judge(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got[2]["distrust"] > 0 and got[2]["verdict"] == "block"
    assert got[4]["trust"] > 0


def test_verdict_does_not_follow_a_hosts_own_page_count(spark):
    # n unjudged pages that all link to a blocked host say nothing for their own host
    for n in (1, 200):
        rows = [(1, "http://www.bad.net/", ""), (2, "http://a.example.net/en/", '<a href="http://liked.com/">'),
                (3, "http://liked.com/", ""), (4, "http://alone.com/", "")]
        rows += [(10 + i, "http://farm.com/", '<a href="http://www.bad.net/">') for i in range(n)]
        got = {r["page_id"]: r for r in U.judge(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
        assert got[10]["verdict"] == "block" and got[10]["trust"] == 0
        assert got[3]["verdict"] == "allow" and got[3]["trust"] > 0
        assert (got[4]["verdict"], got[4]["trust"], got[4]["distrust"]) == ("allow", 0, 0)
