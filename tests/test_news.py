import json

import pytest

from civicpulse.functions.fixed_values import SUMMARY_PREFIXES, SUMMARY_PROMPT
from civicpulse.functions.html import visible_text
from civicpulse.operators.news import attach_summaries, clean_summaries, extract_text, summary_requests
from civicpulse.plans.reports import article_text, news_digest


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<title> T </title><p>a <b>b</b>\n c</p>", "T a b c"),
        ('<script>var t="</p>";</script><style>p{}</style>x', "x"),
        ("<script/>kept<p>a</p>", "kept a"),
        ("one<!-- no -->two", "one two"),
        ("<!DOCTYPE html><?pi x?>a<br>b<br/>c", "a b c"),
        ("x &amp; y &copy; &lt;b&gt; &#8212; caf&eacute;", "x & y © <b> — café"),
        ("a&nbsp;<p> b </p>", "a b"),
        ("<script>never closed", ""),
        ("<template><p>t</p></template><ruby>k<rt>r<rp>p</ruby>z", "k z"),
        ("</p></div>a</b>b", "a b"),
        ("<![CDATA[c]]>d", "c d"),
        ("", ""),
        ("just text", "just text"),
        ("a < b", "a < b"),
    ],
)
def test_visible_text(html, text):
    assert visible_text(html) == text


def test_missing_page_has_no_text_and_no_error(rows):
    pages = rows.make("url string, html string", ("a", None), ("b", ""), ("c", "<p>x"))
    assert rows.get(extract_text(pages), "url", "content", "error") == [("a", None, None), ("b", "", None), ("c", "x", None)]


def test_only_articles_with_text_are_summarised(rows):
    articles = rows.make("url string, content string", ("a", None), ("b", ""), ("c", " \n\t "),
                         ("d", ' say "x"\n'), ("e", "é" * 15_001))
    requests = dict(rows.get(summary_requests(articles), "url", "body"))
    assert sorted(requests) == ["d", "e"]
    assert json.loads(requests["d"]) == {
        "anthropic_version": "bedrock-2023-05-31",
        "max_tokens": 200,
        "messages": [{"role": "user", "content": SUMMARY_PROMPT + ' say "x"\n'}],
    }
    assert json.loads(requests["e"])["messages"][0]["content"] == SUMMARY_PROMPT + "é" * 15_000


def body(text):
    return json.dumps({"content": [{"type": "text", "text": text}]})


def test_summaries_lose_one_opening_phrase(rows):
    texts = [prefix.swapcase() + " \n Body." for prefix in SUMMARY_PREFIXES]
    texts += [" Plain.\n", "See: Here is the summary: no", SUMMARY_PREFIXES[0] + SUMMARY_PREFIXES[0] + "x"]
    responses = rows.make("url string, body string", *[(f"{i:02}", body(t)) for i, t in enumerate(texts)])
    summaries = [s for _, s in rows.get(clean_summaries(responses))]
    assert summaries == ["Body."] * 7 + ["Plain.", "See: Here is the summary: no", SUMMARY_PREFIXES[0] + "x"]


def test_empty_answers_have_no_summary(rows):
    responses = rows.make("url string, body string", ("a", body(" \n ")), ("b", "{}"), ("c", None), ("d", body(SUMMARY_PREFIXES[4])))
    assert rows.get(clean_summaries(responses)) == [("a", None), ("b", None), ("c", None), ("d", "")]


def test_summaries_are_matched_by_url_once(rows):
    articles = rows.make("url string, headline string", ("a", "A"), ("b", "B"), (None, "N"))
    responses = rows.make("url string, body string", ("a", body("one")), ("a", body("two")), ("z", body("zed")))
    assert rows.get(attach_summaries(articles, responses), "headline", "summary") == [("A", "one"), ("B", None), ("N", None)]


def test_digest_from_articles_to_summaries(rows):
    articles = rows.make("url string, title string, search_query string, pos long",
                         ("a", "Second", "q2", 0), ("a", "First", "q1", 0), ("b", "Unfetched", "q1", 1))
    pages = rows.make("url string, html string", ("a", "<p>text</p>"), ("a", "<p>text</p>"))
    texts = article_text(articles, pages, ["q1", "q2"])
    assert summary_requests(texts).count() == 1
    digest = news_digest(texts, rows.make("url string, body string", ("a", body("Here's the summary: S"))))
    assert digest.columns == ["url", "content", "headline", "summary"]
    assert rows.get(digest) == [("a", "text", "First", "S"), ("b", None, "Unfetched", None)]


def test_no_articles_give_an_empty_digest(rows):
    none = rows.make("url string, title string, search_query string, pos long").filter("false")
    pages = rows.make("url string, html string", ("a", "x"))
    responses = rows.make("url string, body string", ("a", body("x")))
    assert news_digest(article_text(none, pages), responses).count() == 0
