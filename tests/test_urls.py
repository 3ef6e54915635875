"""URL scalars and link discovery (FIXTURES section 5)."""

import itertools
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from docforge.functions.url import hrefs, netloc, with_url_join


def test_netloc(spark):
    urls = ["https://docs.aws.amazon.com/page", "https://kubernetes.io/docs/security/",
            "https://learn.microsoft.com/azure", "https://kubernetes.io:443/x", "http://a b/c",
            "//g/i", "mailto:m@n", "relative/path"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.n for r in df.select(netloc(F.col("u")).alias("n")).collect()]
    assert got == [urlparse(u).netloc for u in urls]


def test_hrefs(spark):
    html = "<a href='/x'><a href=\"https://y/z?a=1#t\"><A HREF=/no><a href=q>"
    got = spark.createDataFrame([(html,)], "h string").select(hrefs(F.col("h")).alias("x")).first().x
    assert got == ["/x", "https://y/z?a=1#t", "q"]


def test_url_join_matches_python(spark):
    bases = ["https://h/a/b", "https://h/a/b/", "https://h", "http://h/a/b?q=2#z",
             "https://u@h:8080/x/y/z.html"]
    links = ["/x", "c", "../d", "?q=1", "#f", "//g/i", "mailto:m@n", "./", "../../../x",
             "a/./b/../c", "http://o/p", "https://o/p?", "?", "#", "/a/../b/.", "..", "x//y",
             "HTTPS://Q/r", "///z"]
    pairs = list(itertools.product(bases, links))
    df = spark.createDataFrame(pairs, "b string, l string")
    got = {(r.b, r.l): r.j for r in with_url_join(df, "b", "l", "j").collect()}
    for b, l_ in pairs:
        assert got[(b, l_)] == urljoin(b, l_), (b, l_)


def test_character_references(spark):
    from docforge.functions.html import main_text
    df = spark.createDataFrame([("<p>It&#8217;s &#x27;q&#x27; &eacute; &amp;lt; &#38;gt; &none; &#0; &#xD800; &#128512;",)],
                               "h string")
    assert df.select(main_text(F.col("h")).alias("t")).first().t == \
        "It’s 'q' é &lt; &gt; &none; &#0; &#xD800; \U0001f600"


def _texts(spark, pages):
    from docforge.functions.html import main_text
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    return [r.t for r in df.select("i", main_text(F.col("h")).alias("t")).orderBy("i").collect()]


def test_references_are_decoded_once(spark):
    assert _texts(spark, ["&#38;amp; &amp; x", "&amp;#38; &#38;lt;", "&amp;amp;lt; & &; &#38"]) == [
        "&amp; & x", "&#38; &lt;", "&amp;lt; & &; &#38"]


def test_ad_boxes_end_at_their_own_tag(spark):
    """Divs inside count; what can't be closed stays."""
    assert _texts(spark, [
        'a<div class="ad">x<div>y</div>z</div>b',
        "<div>p<div class=ad >q<div class='ad'>r</div>s</div>t</div>u",
        'a</div><div class="ad">x</div></div>b',
        'a<div class="ad">x<div>y</div>b<div class="ad">z</div>c',
        '<DIV CLASS="AD">u</DIV ><div>v</div><div class="address">w</div>',
        '<div class="ad"><div><div>1</div></div></div>k<div class="ad">2</div>',
    ]) == ["ab", "pt\n\nu", "a\n\nb", "a\n\nx\n\ny\n\nb\n\nz\n\nc", "v\n\nw", "k"]


def test_main_text_names_its_input_once(spark):
    from docforge.functions.html import main_text
    df = spark.createDataFrame([("x",)], "h string").select(main_text(F.col("h")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 20


def test_payloads_in_bytes(spark):
    from docforge.functions.html import decode_payload
    meta = lambda c: f'<meta http-equiv="x" content="text/html; charset={c}">'.encode()
    text = "é – \U0001f600"
    cases = [
        (b"plain", "UTF-8", "plain"), (text.encode(), "UTF-8", text), (b"\xef\xbb\xbf" + text.encode(), "UTF-8", text),
        (b"\xff\xfe" + text.encode("utf-16-le"), "UTF-16LE", text), (b"\xfe\xff" + text.encode("utf-16-be"), "UTF-16BE", text),
        (meta("ISO-8859-1") + b"\xe9 \x96", "windows-1252", meta("ISO-8859-1").decode() + "é –"),
        (meta("windows-1252") + b"\x81", "windows-1252", None), (meta("utf-8") + b"\xe9", "UTF-8", None),
        (meta("shift_jis") + b"x", "shift_jis", None), (b"\xff\xfe\x00\xd8", "UTF-16LE", None),
        (b"\xff\xfe\x00\xd8\x00\xdc", "UTF-16LE", "\U00010000"), (b"\xfe\xff\x00", "UTF-16BE", None),
        (b"", "UTF-8", ""), (b"\xc3", "UTF-8", None)]
    df = spark.createDataFrame([(k, bytearray(c[0])) for k, c in enumerate(cases)] + [(99, None)], "i int, b binary")
    got = {r.i: r.d for r in df.select("i", decode_payload(F.col("b")).alias("d")).collect()}
    assert got.pop(99) is None
    assert [(got[k].charset, got[k].html) for k in range(len(cases))] == [(c, h) for _, c, h in cases]
