import time

from lagoon.sources import documents as D

LONG = "This is a long enough paragraph about the matter, number {}."


def test_article_fields():
    page = f"""<html lang="en"><head><title>Plain &amp; title</title><meta name="author" content=" Jane  Doe "><meta property="og:title" content="Open title"><meta name="date" content="2024-01-02"></head>
    <body><nav><p>{LONG.format(0)}</p></nav><main><p>{LONG.format(1)}<p>{LONG.format(2)}<div class="Related-links"><p>{LONG.format(3)}</p></div><p>short</p></main>
    <div class="x entry-content"><p>{LONG.format(4)}</p></div><p>{LONG.format(5)}<script>var p = "<p>no</p>"</script></p></body></html>"""
    assert D.article_fields(page) == ("Open title", "Jane Doe", "2024-01-02", "en", f"{LONG.format(1)}\n\n{LONG.format(2)}")
    assert D.article_fields(f"<title>T</title><p>{LONG.format(1)}<p>{LONG.format(2)}") == ("T", None, None, None, f"{LONG.format(1)}\n\n{LONG.format(2)}")
    assert D.article_fields(None) == D.article_fields("") == (None,) * 5


def test_filing_fields():
    rows = "".join(f"<tr><td>Revenue {i}<td>{i},000</tr>" for i in range(3))
    page = f"<table><tr><td><table>{rows}</table></td></tr></table><p>{LONG.format(1)}</p><p>{LONG.format(1).upper()}</p><ul><li>{LONG.format(2)}</ul>"
    text, title = D.filing_fields(page, " A report ")
    assert text == "\n\n".join([LONG.format(1), LONG.format(2), "Revenue 0 0,000", "Revenue 1 1,000", "Revenue 2 2,000"]) and title == "A report"
    assert D.filing_fields("<div>one line</div>x<div>another</div>") == ("one line\n\nanother", None)
    assert D.filing_fields(None) == (None, None)
    cut, _ = D.filing_fields("".join(f"<p>{LONG.format(i)}</p>" for i in range(3000)))
    assert cut.endswith(D.notice(50_000)) and len(cut) == 50_000 + len(D.notice(50_000))
    big, _ = D.filing_fields("<p>" + "word " * 300_000)
    assert len(big) == 50_000 + len(D.notice(50_000))


def test_scans_are_linear():
    for page in ("<div>word " * 100_000, "</b>x" * 100_000, "<li>" * 50_000 + "word", "<article><p>" * 40_000, "<a \"" * 100_000, "<a \"" * 5_000 + ">"):
        begin = time.time()
        D.article_fields(page)
        D.filing_fields(page)
        assert time.time() - begin < 20


def test_columns(spark):
    df = spark.createDataFrame([(1, f"<p>{LONG.format(1)}</p>", "d"), (2, None, None), (2, "", "e")], "text int, html string, title string")
    got = {tuple(r) for r in D.extract_filings(df.withColumnRenamed("text", "k"), "k", "html", "title").collect()}
    assert got == {(1, LONG.format(1), "d"), (2, None, None), (2, None, "e")}
    assert D.extract_articles(df.withColumnRenamed("text", "k").limit(0), "k", "html").count() == 0
