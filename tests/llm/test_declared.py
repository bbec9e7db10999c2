"""The declared language of a page is found wherever it stands."""

import random
import re
import time

from pyspark.sql import functions as F

from corvane.llm import language_id

TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w{1,8};")
PARTS = ["<", ">", "<!--", "-->", "<script", "</script>", "</script  >", "<style>", "</STYLE>", "&amp;", "&", ";", "a", "b ", "<!-", "--", "/", "<p>", "\n"]


def test_stripped_as_one_pattern_and_in_linear_time():
    r = random.Random(1)
    for _ in range(20_000):
        html = "".join(r.choice(PARTS) for _ in range(r.randrange(0, 14)))
        assert language_id.stripped(html) == TAGS.sub(" ", html)
    for broken in ("<" * 1_000_000, "<script " * 125_000, "<!--" * 250_000, "</script" * 60_000 + "<script>" * 60_000, "<html lang" * 100_000):
        began = time.perf_counter()
        assert language_id.stripped(broken).strip() == ("" if ">" in broken else broken.strip()) and language_id.declared(broken) == ""
        assert time.perf_counter() - began < 3  # 0.2 s on a machine at rest


def test_only_the_attribute_itself_declares():
    cases = {"<html data-lang='fr' lang='de'>": "de", "<html data-lang=fr>": "", "<htmlx lang=fr><HTML\nLANG = \"Es\">": "es", "<html><html lang=it>": "it", "<html": "", "": ""}
    assert {h: language_id.declared(h) for h in cases} == cases


def test_odd_rows(spark):
    """Repeated rows, null keys and columns, clashing names, empty tables."""
    clash = {c: F.lit("x") for c in ("kind", "host", "domain", "prior_de", "ll_de", "n_host", "text_lang", "place")}
    docs = spark.createDataFrame([(1, "das ist ein Haus", "de", "s"), (1, "das ist ein Haus", "de", "s"), (None, None, None, None), (2, "", "xx", "t")], "doc_id bigint, text string, lang string, source string").withColumns(clash)
    pages = spark.createDataFrame([(1, None, None), (None, "https://a.fr/de/x", "<p>Haus"), (None, "https://a.fr/de/x", "<p>Haus")], "page_id bigint, url string, html string").withColumns(clash)
    got = language_id.identified(docs, pages).collect()
    assert len(got) == 7 and all(0 < r.probability <= 1 for r in got)
    assert len({(r.lang, r.probability) for r in got if r.doc_id == 1}) == 1
    assert language_id.identified(docs.where("false"), pages.where("false")).collect() == []
    assert len(language_id.identified(docs.where("false"), pages).collect()) == 3


def test_declared_after_a_long_comment(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "s")], "doc_id bigint, text string, lang string, source string")
    pages = [(1, "http://a.example/", f"<!-- {'x ' * 50000}-->\n<html class='a' lang=\"FR\"><p>la</p>"), (2, "http://b.example/", "<html " + "data-a='b' " * 500 + "lang=de>"), (3, "http://c.example/", "<p>" * 5000)]
    got = {r.page_id: r.declared for r in language_id.identified(docs, spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert (got[1], got[2], got[3]) == ("fr", "de", "")
