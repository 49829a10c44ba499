import random

import pytest

from weftline.llm import langid

WORDS = {"en": "the of and that thing with from which their house river", "de": "der die und nicht auch eine wenn schon haus fluss", "fr": "le les des et une dans pour avec maison fleuve"}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture
def documents(spark):
    rows = [(i, prose(lang, 60, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(900, None, "en"), (901, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def page(lang, n, seed, declared=None):
    return f"<html{f' lang={declared!r}' if declared else ''}><script>var der='die und nicht'</script><!-- le les --><body><p>{prose(lang, n, seed)}&amp;</p></body>"


def test_evidence_is_fused(spark, documents):
    rows = [(i, f"https://{lang}{i % 2}.example.{lang if lang != 'en' else 'com'}/x", page(lang, 40, i, lang)) for i, lang in enumerate(["en", "de", "fr"] * 15)]
    rows += [(100, "https://de0.example.de/", ""), (101, "https://de1.example.de/y", None), (102, None, page("fr", 40, 7)), (103, "not a url", page("de", 40, 8, "en")), (104, None, None), (None, "https://fr0.example.fr/", page("fr", 30, 1)), (105, "https://new.example.fr/fr/1", "<html lang=fr>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS lang", "'clash' AS text", "'clash' AS share")
    got = {r.page_id: r for r in langid.identify(pages, documents).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == ["en", "de", "fr"][i % 3] and got[i].posterior > 0.9 for i in range(45))
    assert (got[100].lang, got[101].lang, got[102].lang, got[103].lang, got[105].lang, got[None].lang) == ("de", "de", "fr", "de", "fr", "fr")
    assert got[100].text_lang is None and got[104].lang is not None and got[104].host is None


def test_host_prior_decides_without_text_and_takes_out_own_share(spark, documents):
    rows = [(i, "https://blog.example.net/a", page("de", 40, i)) for i in range(12)] + [(50, "https://blog.example.net/b", "<p></p>"), (51, "https://other.example.org/", page("en", 30, 3))]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), documents).collect()}
    assert got[50] == "de" and got[51] == "en"


def test_empty_inputs(spark, documents):
    pages = spark.createDataFrame([(1, "https://a.example.com/", "<p>x</p>")], "page_id long, url string, html string")
    assert langid.identify(pages.limit(0), documents).collect() == []
    (row,) = langid.identify(pages, documents.limit(0)).collect()
    assert (row.lang, row.posterior) == (None, 0.0)


def test_page_parsing():
    assert langid.visible_text("<p>a<!-- b --><style>c</style>d&nbsp;e<br/>f<script>g").split() == ["a", "d", "e", "f"]
    assert langid.declared_language('<HTML xml:lang="PT-br">') == "pt"
    assert langid.declared_language('<meta http-equiv="content-language" content="es">') == "es"
    assert langid.declared_language("<p lang=de>") is None


def test_declared_language_is_searched_in_the_whole_page():
    for long in ("<!--" + "x" * 100_000 + "-->", "<style>" + "p{} " * 30_000 + "</style>", "<p>" * 50_000):
        assert langid.declared_language(long + "<html lang=fr>") == "fr"
        assert langid.declared_language(long + '<meta http-equiv="content-language" content="es">') == "es"
    assert langid.declared_language("<!-- <html lang=de> --><script>'<html lang=fr>'</script><html lang=en>") == "en"
    assert langid.declared_language("<html <meta content-language content= " * 30_000) is None


def test_every_language_of_the_documents_is_modelled(spark):
    rng = random.Random(8)
    words = {f"l{i:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(70)}
    text = lambda lang: " ".join(rng.choices(words[lang], k=30))
    documents = spark.createDataFrame([(i, text(lang), lang) for i, lang in enumerate(words)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, None, f"<p>{text(lang)}</p>") for i, lang in enumerate(words)], "page_id long, url string, html string")
    names, blocks = langid.train(documents)
    assert names == sorted(words) and len(blocks) == 2
    got = {r.page_id: r for r in langid.identify(pages, documents).select("page_id", "lang", "text_lang").collect()}
    assert [got[i].text_lang for i in range(70)] == [got[i].lang for i in range(70)] == list(words)
