"""Template deduction and main text."""

import html
import re

import pytest

from trialspark.llm import html_template as T
from trialspark.llm.common import table
from tests.conftest import SF_SMALL


def page(i, blocks, nav="Home", extra="", inner=""):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return (f"<!DOCTYPE html><html><head><title>Title {i}</title><script>var x='</p><article>';</script></head><body>"
            f"<nav><ul><li>{nav}</li><li>About</li></ul></nav><!-- note {i} --><div class=\"ad\">Buy {i}</div>"
            f"<article><h1>Head &amp; line {i}</h1>{body}{inner}</article>{extra}<footer>&copy; site</footer></body></html>")


def test_given_pages_equal_their_articles(spark):
    src = {r.page_id: r for r in table(spark, SF_SMALL, "pages").collect()}
    rows = T.extract_pages(table(spark, SF_SMALL, "pages")).collect()
    assert sorted(r.page_id for r in rows) == sorted(src)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", src[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars, r.url) == (want, len(want), src[r.page_id].url)


@pytest.mark.parametrize("doc, text", [
    (None, ""), ("", ""), ("plain  text &lt;b&gt;", "plain text <b>"),
    ("<article><p>a<br>b<p>c <b>d</b>e</article>", "a b\n\nc de"),
    ("<main><header>x</header><p>a</p><aside>no</aside><form>f<input></form><p>b&nbsp;c</p></main>", "a\n\nb c"),
    ("<article><p>a</p><section class='comments'><p>nice</p></section><div id=cookie-notice>ok?</div></article>", "a"),
    ("<article><p>a</p><article class=comment><p>me</p></article><p hidden>h</p><p style='display: none'>n</p></article>", "a"),
    ("<article><p>1 < 2 and 3 <4</p><style>p{}</style><p>x</article><p>after", "1 < 2 and 3 <4\n\nx"),
    ("<article><p title='a > b'>q</p><!-- <p>no</p> --><p>r", "q\n\nr"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article", "a\n\nb\n\nc\n\nd"),
    ("<script>if (a</b) {}</script><body><p>t</p></body>", "t"),
    ("<article><p>&eacute;&#x41;&#66;&unknown;</p></article>", "éAB&unknown;"),
    ("<article><p>x</p></article><article><p>y</p></article>", "x\n\ny")])
def test_main_text(doc, text):
    assert T.main_text(doc) == text


def test_template_text_goes_where_no_article_is(spark):
    def old(i):
        return (f"<html><body><div><b>Fine Site</b></div><div><span>Sign in</span></div><div><p>Story {i} begins.</p>"
                f"<p>It ends {i}.</p></div><div>Copyright</div></body></html>")

    rows = [(i, f"http://old.example.com/{i}", old(i)) for i in range(6)] + [
        (10, "http://single.org/", "<body><div>Only page</div></body>"), (11, None, None), (12, "http://old.example.com/e", ""),
        (13, "http://old.example.com/odd", "<body><p>Different page</p></body>")]
    rows += [(20 + i, f"http://new.org/{i}", page(i, [f"first {i}", "shared line"], inner="<p>shared line</p>")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as TEXT", "1 as template")
    out = T.extract_main_text(df)
    assert out.columns == ["page_id", "url", "html", "template", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert [got[i] for i in range(6)] == [f"Story {i} begins.\n\nIt ends {i}." for i in range(6)]
    assert (got[10], got[11], got[12], got[13]) == ("Only page", "", "", "Different page")
    for i in range(4):
        assert got[20 + i] == f"Head & line {i}\n\nfirst {i}\n\nshared line\n\nshared line"
    assert T.extract_pages(df.select("page_id", "url", "html").limit(0)).count() == 0


def test_classes_group_equal_vectors(spark):
    rows = [("h", page(i, ["x"] * (i + 1))) for i in range(5)]
    df = spark.createDataFrame(rows, "host string, html string")
    found = T.templates(df, "host", "html").collect()
    assert len(found) == 1
    of = T._parsed(found[0].template)
    cls = {t: c for t, (c, _) in of.items()}
    article = "/html/body/article"
    assert cls[f"< {article}"] == cls[f"> {article}"] == cls["t /html/body/footer &copy; site"]
    assert cls[f"< {article}/p"] == cls[f"> {article}/p"] != cls[f"< {article}"]
    assert T.fixed_tokens(T.tokens(T.walk(rows[0][1])), found[0].template) >= {f"< {article}", f"> {article}"}


def test_very_long_and_broken_pages():
    assert T.main_text("<article>" + "<p>word</p>" * 20000) == "\n\n".join(["word"] * 20000)
    assert T.main_text("<article><p>" + "x " * 100000) == " ".join(["x"] * 100000)
    assert T.main_text("<div <div <p 'a" * 50) is not None
    assert T.main_text("<" * 5000) == "<" * 5000


@pytest.mark.parametrize("doc, text", [
    ("<div class='has-sidebar'><article><p>a</p></article></div>", "a"),
    ("<div class='no-comments'><main>a</main></div>", "a"), ("<div id=with-search><article>a</article></div>", "a"),
    ("<div class='layout widget'><div class=ad>x</div><article>a</article></div>", "a"),
    ("<article class='post has-comments'><p>a</p></article>", "a"), ("<form id=f><article>a<form>x</form></article></form>", "a"),
    ("<div class=sidebar><article>a</article></div>", "a"), ("<div class=comments><main>a</main></div>", "a"),
    ("<article>a</article><section class=comments><article>me</article></section><div class=sidebar><article>t</article></div>",
     "a"),
    ("<article>a<div class=widget><article>b</article></div><div class=ad><article>no</article></div></article>", "a\n\nb"),
    ("<article><p>a</p><math><mi>x</mi></math><noscript><p>b</p></noscript><div class='search-tips'>c</div>"
     "<div class=related>d</div><div class='social work'>e</div><p class=banner>f</p><div class='ads'>no</div></article>",
     "a\n\nx\n\nb\n\nc\n\nd\n\ne\n\nf"),
    ("<body><noscript>no</noscript><div class=widget>no</div><p>a</p></body>", "a")])
def test_names_never_hide_the_main_element(doc, text):
    assert T.main_text(doc) == text


def test_copied_pages_without_an_article_keep_their_text(spark):
    def doc(i, *paragraphs):
        return (f"<html><head><title>{i}</title></head><body><div><b>Site</b></div>"
                + "".join(f"<p>{p}</p>" for p in paragraphs) + f"<script>track({i})</script><div>Foot</div></body></html>")

    rows = [(i, f"http://copies.org/{i}", doc(i, "one text", "its end")) for i in range(5)]
    rows += [(10 + i, f"http://two.org/{i}", doc(0, "same", "here")) for i in range(2)]
    rows += [(20 + i, f"http://half.org/{i}", doc(i, "shared a", "shared b", f"own {i}") if i < 2 else doc(i, f"own {i}", "x" * i))
             for i in range(4)]
    rows += [(30 + i, f"http://mixed.org/{i}", doc(i, "copy", "copy end") if i < 6 else doc(i, f"own {i}", f"end {i}"))
             for i in range(10)]
    got = {r.page_id: r.text for r in T.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(5)} == {"Site\n\none text\n\nits end\n\nFoot"}
    assert {got[10], got[11]} == {"Site\n\nsame\n\nhere\n\nFoot"}
    assert got[20] == "shared a\n\nshared b\n\nown 0" and got[22] == "own 2\n\nxx"
    assert {got[30 + i] for i in range(6)} == {"copy\n\ncopy end"}
    assert got[39] == "own 9\n\nend 9"


def test_the_template_decides_inside_the_article(spark):
    def doc(i, body):
        return f"<html><body><article><div><b>Read our offer</b></div><p>{body}</p><p>seen twice</p><p>seen twice</p></article></body></html>"

    rows = [(i, f"http://notice.org/{i}", doc(i, f"own text number {i}")) for i in range(4)]
    rows += [(10 + i, f"http://near.org/{i}", f"<html><body><article><h1>a long shared text</h1><p>{i}</p></article></body></html>")
             for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in T.extract_main_text(df).collect()}
    for i in range(4):
        assert got[i] == f"own text number {i}\n\nseen twice\n\nseen twice"
        assert T.main_text(rows[i][2]) == f"Read our offer\n\n{got[i]}"  # without the template
        assert got[10 + i] == f"a long shared text\n\n{i}"  # copies but for a number


def test_only_containers_at_the_edges_are_frame(spark):
    """Headings, captions and lines that a host repeats are part of the article, however long it is."""
    def recipe(i, n):
        steps = "".join(f"<p>step {k} of {i}</p>" for k in range(n))
        return (f"<html><body><nav>Home</nav><article><h2>Ingredients</h2><ul><li>{i} eggs</li><li>salt</li></ul>"
                f"<h2>Method</h2>{steps}<figure><img src=a><figcaption>Ready</figcaption></figure><div>Serve at once</div>"
                f"<p>enjoy {i}</p><p>By our kitchen</p></article><footer>Foot</footer></body></html>")

    def offer(i):
        return (f"<html><body><article><div><h3>Sale</h3><p>Half price</p></div><section><h2>Part one</h2></section>"
                f"<p>own {i}</p><div><b>Sign our list today</b></div></article></body></html>")

    rows = [(i, f"http://cook.org/{i}", recipe(i, 1 + 30 * (i % 2))) for i in range(6)]
    rows += [(10 + i, f"http://offer.org/{i}", offer(i)) for i in range(5)]
    rows += [(20 + i, f"http://same.org/{i}", "<article><div><p>all the same</p></div></article>") for i in range(4)]
    got = {r.page_id: r.text for r in T.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        steps = "\n\n".join(f"step {k} of {i}" for k in range(1 + 30 * (i % 2)))
        assert got[i] == (f"Ingredients\n\n{i} eggs\n\nsalt\n\nMethod\n\n{steps}\n\nReady\n\nServe at once\n\n"
                          f"enjoy {i}\n\nBy our kitchen")
        assert T.main_text(rows[i][2]) == got[i]  # a single page keeps the same
    for i in range(5):
        assert got[10 + i] == f"Part one\n\nown {i}"
    assert {got[20 + i] for i in range(4)} == {"all the same"}


def test_given_pages_keep_whole_articles(spark):
    """Every article of the given pages, by the standard library's parser with the contract's parts left out."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks, self.now = [], [], ""

        def end(self):
            if self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in T.BLOCK:
                self.end()
            if tag not in T.VOID:
                named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split()
                self.stack.append((tag, tag in T.MAIN_SKIP or bool(set(named) & T.MAIN_PARTS)))

        def handle_endtag(self, tag):
            if tag in T.BLOCK:
                self.end()
            while any(t == tag for t, _ in self.stack) and self.stack.pop()[0] != tag:
                pass

        def handle_data(self, data):
            tags = [t for t, _ in self.stack]
            if "article" in tags and not any(out for _, out in self.stack[tags.index("article"):]):
                self.now += data

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in T.extract_pages(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.end()
        assert got[r.page_id] == "\n\n".join(plain.blocks), r.page_id
