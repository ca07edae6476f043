import duckdb

from strandframe.llm.url_filter import ORACLE, RULES, UNIT, judge, parents, propagated

SCHEMA = "page_id long, url string, html string, host string, rule string, mass long"


def test_matches_sql_on_links_of_all_kinds(spark, tmp_path):
    pages = [
        (1, "http://A.Example.com/en/1?x#y", '<a href="https://bad.net/es/1">'),
        (2, "https://www.example.com/en/2", "<a HREF='//good.org/x'>"),
        (3, "https://sub.www.example.com/en/", None),
        (4, "https://bad.net/es/3", "<a href=http://other.org>"),
        (5, "https://bad.net/de/3", ""),
        (6, "https://blog.bad.net/de/3", "<a href='/es/'>"),
        (7, "https://good.org", '<a href="https://farm.org/">'),
        (8, "https://farm.org/q", '<a href="HTTP://BAD.net/">' * 3),
        (9, "no scheme", '<a href="https://bad.net/">'),
        (10, None, None),
        (11, "x://", "y"),
        (12, "https://notexample.com/en/", ""),
        (13, "https://com/x", ""),
        (14, "https://com", ""),
        (15, "https://" + "a." * 400 + "net/es/", ""),
        (15, "https://é.NET:80/fr/x y\nz?q", ""),
        (None, "https://bad.net/fr/3", ""),
        (4, "https://bad.net/es/3", "<a href=http://other.org>"),
    ]
    pages += [(100 + i, f"https://h{i}.org/p", f'<a href="https://h{(i + 1) % 40}.org/"> <a href="https://farm.org/">') for i in range(40)]
    df = spark.createDataFrame([(*p, "h", "r", 1) for p in pages], SCHEMA)
    got = judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.execute(ORACLE).fetchall()
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want, key=str)
    by = {r[0]: r for r in rows}
    assert by[1] == (1, "a.example.com", "/en/1", "example.com/en/", "block")
    assert by[3][3:] == ("www.example.com/en/", "allow")
    assert by[5][3:] == (None, "block")  # other pages of the host are blocked
    assert by[8][3:] == (None, "block")  # links to a blocked host
    assert by[12][3:] == ("com/", "allow") and by[14][3:] == (None, "allow")
    assert by[9][1:] == ("", "", None, "allow") and by[10][1:] == ("", "", None, "allow")


def test_mass_is_the_series_of_shares(spark):
    edges = spark.createDataFrame([("allow", "a", "b"), ("allow", "a", "c"), ("allow", "b", "c")], "kind string, src string, dst string")
    seeds = spark.createDataFrame([("allow", "a", UNIT)], "kind string, host string, mass long")
    got = {r.host: r.mass for r in propagated(seeds, edges).collect()}
    b = UNIT * 85 // 200
    assert got == {"a": UNIT, "b": b, "c": b + b * 85 // 100}


def test_many_links_of_one_host_are_spread(spark, monkeypatch):
    from strandframe.llm import url_filter

    monkeypatch.setattr(url_filter, "LINKS", 10)
    edges = spark.createDataFrame([("allow", "hub", f"h{i}") for i in range(95)], "kind string, src string, dst string")
    got = propagated(spark.createDataFrame([("allow", "hub", UNIT)], "kind string, host string, mass long"), edges)
    assert {r.mass for r in got.where("host != 'hub'").collect()} == {UNIT * 85 // 9500} and got.count() == 96


def test_nearest_parent(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.c", "b.c", "x.y.b.c", "c", "zc")], "host string")
    assert sorted(map(tuple, parents(hosts).collect())) == sorted([("a.b.c", "b.c"), ("b.c", "a.b.c"), ("x.y.b.c", "b.c"), ("b.c", "x.y.b.c"), ("b.c", "c"), ("c", "b.c")])


def test_native_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert judge(df).count() == 0
    assert judge(spark.createDataFrame([(1, "https://a.org/", "", "", "", 1)], SCHEMA), rules=()).first().verdict == "allow"
    assert RULES[0] == ("com", "/", "allow")
