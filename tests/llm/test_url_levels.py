"""Hosts without outcomes are judged by their domain, suffix or the whole."""

from tensorfold.llm import url_filter


def test_new_hosts_inherit(spark):
    hosts = [f"h{i % 4}.bad.org" for i in range(400)] + [f"h{i % 4}.good.org" for i in range(400)]
    asked = ["new.bad.org", "new.good.org", "new.other.org", "new.x.zz"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts + asked)], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, int(".bad." in h)) for i, h in enumerate(hosts)], "page_id bigint, bad int")
    out = {r.host: r for r in url_filter.filter_urls(pages, outcomes, rules=()).collect()}
    assert [out[h].verdict for h in asked] == ["block", "allow", "allow", "allow"]
    assert all(out[h].bound is not None for h in asked)
    assert out["new.bad.org"].bound > url_filter.BLOCK_ABOVE > out["new.other.org"].bound
