"""Every operator on empty tables, null rows, clashing columns, texts of very many words, and repeated rows."""

import os
import time

import pytest

from lexiweft.llm import bpe, htmltext, mixing, neardup, pii, quality, secretscan, tokencount, topk, urlfilter

VOCABULARY = os.path.isdir("/opt/tokenizers")
CLASHING = ["key", "size", "words", "s", "block", "hash", "component_id", "kept", "n", "taken", "target", "score", "spans", "host", "verdict", "shard", "_n", "id", "row", "g_lang"]
SCHEMA = "doc_id long, page_id long, text string, html string, url string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)


def listed(spark):
    return spark.createDataFrame([("net/",)], "key string")


OPERATORS = {
    "pii": (lambda s, d: pii.personal_data(d)), "neardup": (lambda s, d: neardup.near_duplicates(d)), "html": (lambda s, d: htmltext.main_text(d)), "secrets": (lambda s, d: secretscan.secret_findings(d)), "masks": (lambda s, d: secretscan.mask_secrets(d)),
    "urls": (lambda s, d: urlfilter.filter_urls(d, listed(s))), "bpe": (lambda s, d: bpe.bpe_digests(d)), "quality": (lambda s, d: quality.quality_verdicts(d)), "tokens": (lambda s, d: tokencount.token_counts(d)), "mix": (lambda s, d: mixing.mix(d)), "search": (lambda s, d: topk.top_k(d, d)),
}


def rows(spark, *texts):
    """A row for each text (or page, or address), ids from 1; None gives a row of nulls."""
    made = [((k, k, t, t, t, "src", "en") if t is not None else (None,) * 7) + ("x",) * len(CLASHING) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(made, SCHEMA)


def needs(name):
    return pytest.param(name, marks=pytest.mark.skipif(name in ("bpe", "tokens") and not VOCABULARY, reason="no vocabulary here"))


@pytest.mark.parametrize("name", [needs(n) for n in OPERATORS])
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, rows(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", [needs(n) for n in OPERATORS if n != "search"])
def test_nulls_repeats_and_clashing_columns(spark, name):
    d = rows(spark, "a word or two https://net/x", "", None, " \t\n", "a word or two https://net/x", "é 中 🙂")
    assert OPERATORS[name](spark, d.unionByName(d.where("doc_id = 1"))).count() == 7


def test_search_with_nulls_and_clashing_columns(spark):
    d = rows(spark, "red bolt", "", None, "red nut", "red bolt")
    got = topk.top_k(d, d.where("doc_id = 1"))
    assert {r.doc_id for r in got.collect()} == {1, 4, 5}


def test_texts_of_very_many_words(spark):
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    d = rows(spark, long, long + " end", "short")
    n = {r.doc_id: r.n_words for r in quality.quality_verdicts(d).collect()}
    assert n == {1: 300_000, 2: 300_001, 3: 1}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.size for r in mixing.mix(d).collect()} == n
    mail = rows(spark, long + " me@home.org " + long)
    assert pii.personal_data(mail).first().n_email == 1


def test_pages_of_stray_tags_take_time_in_proportion():
    model = htmltext.trained()
    for soup in ("<div>" * 20_000 + "</span>" * 20_000, "<b>" * 20_000 + "<hr>" * 20_000, "<div>" * 20_000 + "<li></li>" * 20_000):
        began = time.process_time()
        htmltext.extract([soup], model)
        assert time.process_time() - began < 8  # in proportion to the square it takes 30
