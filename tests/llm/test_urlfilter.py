from pyspark.sql import functions as F

from stripweave.llm import urlfilter as U


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_cascade_is_exact(spark):
    universe, listed = [f"host{i}" for i in range(6000)], [f"host{i}" for i in range(0, 6000, 7)] + ["elsewhere", None]
    cascade = U.Cascade(keys(spark, listed), keys(spark, universe + ["host1", None]))
    assert len(cascade.levels) >= 3 and not cascade.joins
    for c in (cascade, U.Cascade(keys(spark, listed), keys(spark, universe), max_bits=64)):
        got = {r["key"]: r["m"] for r in c.mark(keys(spark, universe + [None]), "key", "m").collect()}
        assert got == {k: k in set(listed) and k is not None for k in universe + [None]}
    assert c.joins


def test_lookup_has_no_join_and_no_python(spark, capsys):
    pages = spark.createDataFrame([(1, "http://a.net/", "x")], "page_id long, url string, listed string")
    cascade = U.Cascade(keys(spark, ["a.net"]), keys(spark, ["a.net", "b.org"]))
    U.judge(pages, cascade).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "EvalPython" not in plan


URLS = ["HTTP://A.Example.NET/en/x?y", "http://example.net/EN/", "x", None, "", "http://casino.example.com", "http://x.example.com/de/1#t", "https://free-bets.example.org/fr/", "https://free-bets.example.org/de/",
        "ftp://net/", "http://planet/", "a://b://net/c", "http://net?x", "http://mycasino.org/", "http://É.net/", "://net/"]


def test_report_against_plain_python(spark):
    import re
    from urllib.parse import urlsplit  # noqa: F401  the contract's split is its own

    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in U.url_report(pages).collect()}
    assert len(got) == len(URLS) + 2
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(r), r, v) for v, r in U.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if set(re.split("[.-]", host)) & set(U.LISTED_PARTS) else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u


def test_empty(spark):
    assert U.url_report(spark.createDataFrame([], "page_id long, url string")).count() == 0
    none = U.Cascade(keys(spark, []), keys(spark, ["a"]))
    assert none.mark(keys(spark, ["a", None]), "key", "m").where(F.col("m")).count() == 0
