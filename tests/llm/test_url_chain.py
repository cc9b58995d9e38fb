"""Propagation until it has converged."""

from pairsignals.llm import catalog, url_filter


def test_distrust_reaches_the_end_of_a_chain_of_sixty_hosts(spark):
    chain = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">x</a>') for i in range(59)]
    # h59 links to a blocked host; h0 is 60 links away from it.
    pages = [*chain, (59, "http://h59.net/", '<a href="http://bad.com/de/">x</a>'), (60, "http://bad.com/de/", ""),
             (61, "http://alone.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in url_filter.judged(df, catalog.URL_RULES).collect()}
    assert [got[i].verdict for i in range(61)] == ["block"] * 61 and got[61].verdict == "allow"
    assert abs(got[0].distrust - 0.15 * 0.85 ** 60) < 1e-8
