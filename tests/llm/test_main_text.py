import pytest

from rosterfold.llm.main_text import LEAST_PAGES, blocks, extract


def text(html):
    return "\n\n".join(b for b, _ in blocks(html))


@pytest.mark.parametrize("html, expected", [
    ("", ""),
    ("plain words", "plain words"),
    ("<p>a<p>b", "a\n\nb"),
    ("<body><nav>menu</nav><article><h1>T &amp; U</h1><p>one<br>two  three\n four</p></article><footer>f</footer>", "T & U\n\none two three four"),
    ("<article>x<aside>side</aside><div class='share-box ad'>ad</div>y<section id=comments><p>reader</section></article>rest", "x\n\ny"),
    ("<main><p>m</p></main><p>outside</p>", "m"),
    ("<div class='cookie notice'>c</div><p>kept</p><form>f<p>g</form>", "kept"),
    ("<article><script>var t='</p><p>no';</script><style>p{}</style><p>yes</p></article>", "yes"),
    ("<article><p>a &lt;b&gt; &#233; &eacute; &nbsp; z &am", "a <b> é é z &am"),
    ("<article><p>cut <b>off <a href='x", "cut off"),
    ("<!-- <p>no</p> --><p>1 < 2 and 3 > 2</p><!-- open", "1 < 2 and 3 > 2"),
    ("<p title=\"a>b\">quoted</p>", "quoted"),
    ("<article><header><h1>Title</h1></header><ul><li>i<li>j</ul></article>", "Title\n\ni\n\nj"),
    ("<p hidden>no</p><div style='display: none'>no</div><div role=banner>no</div><p>yes</p>", "yes"),
    ("</p></div>stray<p>ends</b></i>", "stray\n\nends"),
])
def test_blocks(html, expected):
    assert text(html) == expected


def test_given_pages_keep_the_article(frames):
    for page in frames.given("pages").collect():
        assert text(page["html"]) and "track(" not in text(page["html"]) and "&copy;" not in text(page["html"])


def page(k, host, body, frame="<div class=box><p>Powered by the same engine</p></div>"):
    return (k, f"http://{host}/{k}", f"<html><body>{frame}<div class=content><p>{body}</p></div></body></html>")


def test_recurring_subtrees_go_and_copied_articles_stay(spark):
    rows = [page(k, "a.example", f"own words of page {k} and some more of them here") for k in range(LEAST_PAGES + 3)]
    rows += [page(100 + k, "b.example", f"text {k}") for k in range(LEAST_PAGES - 1)]
    rows += [(200 + k, "http://c.example/x", "<article><p>copied article</p><p>shared passage</p></article>") for k in range(LEAST_PAGES + 3)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"own words of page {k} and some more of them here" for k in range(LEAST_PAGES + 3))
    assert all(got[100 + k] == f"Powered by the same engine\n\ntext {k}" for k in range(LEAST_PAGES - 1))
    assert all(got[200 + k] == "copied article\n\nshared passage" for k in range(LEAST_PAGES + 3))


def test_odd_rows(spark):
    long = "<article>" + "<p>words and words</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x"), (None, "http://h/", "", "x"), (2, "not a url", "<p>a", "x"), (2, "not a url", "<p>a", "x"), (3, "http://h", long, "x"), (4, "http://h", "<div>" * 3000 + "deep", "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = extract(frame).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 20_000 * 17 - 2), (4, 4)]
    assert extract(frame.limit(0)).collect() == []


def test_what_recurs_inside_articles_goes_and_quotes_stay(spark):
    def made(k, host, extra=""):
        return f"<html><body><main><article><h1>Title {k}</h1><p>Own words {k}.</p>{extra}<ul><li>point {k}<li>Write to us</ul><h2>Read on</h2><span>Sign up for more</span><p>Get our letter every week.</p></article><article><p>Teaser</p></article></main></body></html>"

    quote = "<blockquote>A passage that some quote.</blockquote>"
    rows = [(k, f"http://d.example/{k}", made(k, "d.example", quote if k < LEAST_PAGES else "")) for k in range(3 * LEAST_PAGES)]
    rows += [(100 + k, f"http://e.example/{k}", made(k, "e.example")) for k in range(LEAST_PAGES - 1)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(3 * LEAST_PAGES):
        assert got[k].split("\n\n") == [f"Title {k}", f"Own words {k}.", *(["A passage that some quote."] if k < LEAST_PAGES else []), f"point {k}"]
    assert all(got[100 + k].endswith("Write to us\n\nRead on\n\nSign up for more\n\nGet our letter every week.\n\nTeaser") for k in range(LEAST_PAGES - 1))


@pytest.mark.parametrize("html, expected", [
    ("<div class='layout has-sidebar'><p>a</p></div><main class='with-sidebar'><p>m</p></main>", "m"),
    ("<div class='layout has-sidebar'><p>a</p></div>", "a"),
    ("<article class='post comments-closed category-social'><p>x</p></article>", "x"),
    ("<article class='social'><p>x</p><div class='ad'>no</div></article>", "x"),
    ("<div class='menu sidebar'>no<main class='notice'><p>m</p><div class='share'>no</div></main>no</div>", "m"),
    ("<body class='login'><div id=sidebar>no<article><p>x</p></article></div><p>outside</p>", "x"),
    ("<article><h2 id='related-work'>Related</h2><p>x</p><h2 id=related>More</h2><section id='social-history'><p>y</p></section><section id=notice><p>z</p></section></article>", "Related\n\nx\n\nMore\n\ny\n\nz"),
    ("<article><p>x</p><article class=comment><p>reader</p></article></article><div class=related><article>teaser</article></div>", "x"),
    ("<p>words</p><div id=comments><article>reader</article></div>", "words"),
    ("<main><p>m</p><section class='comments wide'><article>reader</article></section></main>", "m"),
    ("<nav>no<article>no</article></nav><p>a<div class=sidebar>no</div>b", "a\n\nb"),
])
def test_names_are_whole_and_keep_articles(html, expected):
    assert text(html) == expected
