"""Hosts without a labelled page are judged by what stands above them."""

from pyspark.sql import functions as F

from shelfscan.llm import urls


def test_hosts_without_labels_fall_back(spark):
    hosts = [f"{kind}{k}.{domain}" for kind, domain in (("a", "bad.net"), ("b", "worse.net"), ("c", "good.info"), ("d", "fine.info")) for k in range(10)]
    rows = [(n, f"x://{hosts[n % 40]}/p") for n in range(1200)]
    new = [(2000, "x://new.bad.net/p"), (2001, "x://new.good.info/p"), (2002, "x://new.unseen.net/p"), (2003, "x://new.unseen.info/p"), (2004, "x://new.unseen.xyz/p")]
    pages = spark.createDataFrame([*rows, *new], "page_id long, url string")
    seen = spark.createDataFrame([(n, n % 40 < 20) for n, _ in rows], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, seen).where("page_id >= 2000").collect()}
    assert got[2000] == "block" and got[2002] == "block"  # by its domain, by its suffix
    assert got[2001] == got[2003] == "allow"
    bounds = {r["host"]: (r["n"], r["bad"]) for r in urls.host_reputation(pages, seen).collect()}
    assert len(bounds) == 45 and bounds["new.unseen.xyz"] == (0, 0)
    assert urls.host_reputation(pages, seen.where(F.lit(False))).count() == 0


def test_suffixes_are_a_parameter(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "concat('x://', if(id % 2 = 0, 'a', 'b'), '.shop.zz/p') AS url").union(
        spark.sql("SELECT 1000L AS page_id, 'x://new.a.shop.zz/p' AS url UNION ALL SELECT 1001L, 'x://new.b.shop.zz/p'")
    )
    seen = pages.where("page_id < 1000").selectExpr("page_id", "page_id % 2 = 0 AS bad")
    own = {r["page_id"]: r["verdict"] for r in urls.judge(pages, seen, suffixes=["shop.zz"]).where("page_id >= 1000").collect()}
    assert own == {1000: "block", 1001: "allow"}  # a.shop.zz and b.shop.zz are domains of their own
