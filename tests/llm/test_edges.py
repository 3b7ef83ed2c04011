"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest

from meshrel.llm import decontamination, languages, licenses, mixing, quality, urls

ROWS = [(1, None, "a"), (2, "", None), (3, " \n ", "a"), (4, "Licensed under CC BY-NC 4.0.", "b"), (4, "Licensed under CC BY-NC 4.0.", "b"), (None, "plain words here", "b"), (5, "word " * 60_000, "c"), (6, "é***!!! ÀÉ", "c")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ROWS], SCHEMA + ", size string, bucket int")


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken == r["size"] * r.copies and r.copies <= 3 for r in got)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_water_filling_clamps_and_shares_again(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 490, 1)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    assert got == {"a": 30.0, "b": 735.0, "c": 735.0}


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?q#f"), (4, "http://a.example.com/en/"), (5, "http://x.net/es/"), (5, "http://x.net/es/"), (6, "http://net/esp"), (7, "http://example.com")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.RULES).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "allow") and got[7][2:] == (None, "allow")
    assert urls.judge_urls(pages.limit(0), urls.RULES).collect() == []


def test_decontamination(spark, docs):
    item = " ".join(f"t{i}" for i in range(30))
    changed = item.replace("t9 ", "u ").replace("t20 ", "u ")
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, f"before {item} after"), (51, f"x y z {changed}"), (52, " ".join(f"t{i}" for i in range(6)))], "doc_id long, text string"))
    assert {r.doc_id for r in decontamination.contaminated_spans(more, items).collect()} == {50, 51}
    assert {r.doc_id for r in decontamination.contaminated_spans(more, items, block_words=1).collect()} == {50, 51}
    assert decontamination.decontaminate(more, items).count() == len(ROWS) + 1
    assert decontamination.contaminated_spans(more, items.limit(0)).collect() == []


def test_licenses(docs):
    got = sorted((r.doc_id, r.family) for r in licenses.scan(docs).collect())
    assert got == [(4, "cc-by-nc"), (4, "cc-by-nc")]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_quality_and_languages(spark, docs):
    good = [(i, f"the cat number {i} sat on a mat and slept", 1, "en") for i in range(40)]
    bad = [(100 + i, f"*** $$$ BUY!! {i} !!! %%%", 0, "de") for i in range(40)]
    model = quality.fit_quality(spark.createDataFrame(good + bad, "doc_id long, text string, label int, lang string"))
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = quality.fit_quality(docs.selectExpr("doc_id", "text", "cast(null as int) label"))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    texts = [(i, "the cat sat on the mat", "en") for i in range(9)] + [(20 + i, "der hund und die katze", "de") for i in range(9)]
    fitted = languages.fit_languages(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    judged = languages.identify(languages._documents(docs), fitted, ["doc_id"]).collect()
    assert len(judged) == len(ROWS) and all(r.lang is None for r in judged if r.doc_id in (1, 2, 3))
