"""The url rules of the query against the contract's own list."""

import pytest

from pairsignals.llm import catalog, url_filter

CONTRACT = [("http://a.org/x", "org/", "allow"), ("http://example.org/es/x", "example.org/es/", "block"),
            ("https://www.example.org/en/12", "example.org/en/1", "block"), ("http://b.com/fr/", "com/fr/", "allow"),
            ("http://b.com/de/", "com/de/", "block")]


@pytest.mark.parametrize("url, rule, verdict", CONTRACT)
def test_each_rule_gives_the_word_of_the_contract(spark, url, rule, verdict):
    df = spark.createDataFrame([(1, url, "")], "page_id long, url string, html string")
    row = url_filter.judged_by_rules(df, catalog.URL_RULES, "page_id", "url").first()
    assert (row["rule"], row["rule_verdict"]) == (rule, verdict)
