"""Main text of pages: planted pages, and a plain recount of templates."""

import random
import re
import html as H
from collections import defaultdict

import pytest

from statline.llm import page_text, queries
from statline.llm.page_text import Page

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, host int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], SCHEMA).repartition(5)
    return {r.page_id: r for r in page_text.extract(df, **options).collect()}


def text_of(source):
    page = Page(source)
    return "\n\n".join(t for t, r in page.blocks if r == page.root() or not page.root())


@pytest.mark.parametrize("source,want", [
    ("<article><h1>A&amp;B</h1><p>x  \n y<b>z</b></p><p></p><p>&copy;&nbsp;q</p></article><footer>f</footer>",
     "A&B\n\nx yz\n\n© q"),
    ("<p>one<br>two<p><b>three<p>four", "one two\n\nthree\n\nfour"),
    ("<nav>m</nav><main><p>a</p><aside>s</aside><form>f<p>g</p></form><p>b</p></main>after", "a\n\nb"),
    ("<article>top<script>var t='</p><p>';</script> rest<style>p{}</style></article>", "top rest"),
    ("<article>a<!-- no <p> --> b<!--> c</article>", "a b c"),
    ("<article><p>say <button>Like</button>more</p><select><option>1</select></article>", "say more"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\n\nb\n\n1 2\n\n3"),
    ("<article><p>cut here &am", "cut here &am"),
    ("<article><p>cut here<a href='x", "cut here"),
    ("<article><p>x</p><div class='comments'><article><p>first!</p></article></div></article>", "x"),
    ("<article><p>x</p><section id=reader-comments><p>c</p></section><p role='note'>y</p></article>", "x\n\ny"),
    ("<body class='with-sidebar no-comments'><div class=\"cookie-notice\">ok?</div><p>t</p></body>", "t"),
    ("<head><title>T</title><body><header>h</header><div class=post-header><h1>t</h1></div>b</body>", "t\n\nb"),
    ("a < b and <3 > 2 <", "a < b and <3 > 2 <"),
    ("<ARTICLE><P>Up &lt;p&gt; &#x41;&#66;</P></ARTICLE>", "Up <p> AB"),
    ("<article></article><p>teaser</p>", ""),
    ("", ""),
    ("<p title=\"a>b\" class='x'>q</p><p title='>'>r</p>", "q\n\nr"),
    ("<div hidden=\"unclosed>x</div><p>y", "x\n\ny"),
    ("<article><header><h1>own</h1></header><p>t</p></article><header>site</header>", "own\n\nt"),
])
def test_structure(source, want):
    assert text_of(source) == want


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_templates_of_unmarked_pages(spark):
    """Pages of plain boxes: what recurs on a host goes, what does not stays."""
    r = random.Random(1)
    rows, want = [], []
    for i in range(60):
        site = i % 3
        box = f"<div><div>menu {site}</div><a>home {site}</a></div>"
        low = f"<div>all rights, site {site}</div>"
        body = [words(r, 30) for _ in range(3)]
        if i % 10 == 0:
            body.append(low.replace("<div>", "").replace("</div>", ""))  # same words in a paragraph
        url = f"https://user@Site{site}.example:80/p/{i}" if i % 2 else f"http://site{site}.EXAMPLE/p{i}#x"
        rows.append((url, f"<body>{box}<div>{''.join(f'<p>{b}</p>' for b in body)}</div>{low}</body>"))
        want.append("\n\n".join(body))
    got = run(spark, rows)
    assert [got[i].text for i in range(60)] == want
    assert all(got[i].n_template >= 1 and got[i].n_chars == len(want[i]) for i in range(60))


def test_few_pages_are_no_template(spark):
    page = "<body><div>menu</div><div><p>{}</p></div></body>"
    rows = [("http://a.example/1", page.format(f"text number {i}")) for i in range(4)]
    rows += [(None, page.format(f"other {i}")) for i in range(9)] + [("/relative", page.format("rel"))]
    got = run(spark, rows)
    assert all(got[i].text.startswith("menu\n\n") for i in range(len(rows)))


def test_copies_of_an_article_are_one_page(spark):
    """Copies under several addresses do not make their text a template."""
    r = random.Random(2)
    text = words(r, 40)
    rows = [(f"http://a.example/{i}", f"<body><div>menu {i}</div><div><p>{text}</p></div></body>") for i in range(30)]
    rows += [("http://a.example/0", rows[0][1])] * 5
    got = run(spark, rows)
    assert all(got[i].text.endswith(text) for i in range(len(rows)))


def test_passages_of_articles_stay(spark):
    """A paragraph of many articles is text; a box of most articles is not."""
    r = random.Random(3)
    passage = words(r, 20)
    rows, want = [], []
    for i in range(40):
        own = words(r, 30)
        box = "<div>Read this next</div>" if i % 4 else ""
        rare = "<div>Correction</div>" if i % 5 == 0 else ""
        rows.append((f"http://a.example/{i}", f"<nav>n{i}</nav><article><p>{own}</p>{box}<p>{passage}</p>{rare}</article>"))
        want.append("\n\n".join([own, passage] + (["Correction"] if rare else [])))
    got = run(spark, rows)
    assert [got[i].text for i in range(40)] == want
    assert {got[i].n_marked for i in range(40)} == {1}


def test_nulls_and_empty_table(spark):
    got = run(spark, [("http://a.example/", None), (None, ""), (None, "<p>x</p>")])
    assert [(got[i].text, got[i].n_chars) for i in range(3)] == [("", 0), ("", 0), ("x", 1)]
    df = spark.createDataFrame([], SCHEMA)
    assert page_text.extract(df).collect() == []


def test_long_page(spark):
    r = random.Random(4)
    paragraphs = [words(r, 50) for _ in range(4000)]
    source = "<article>" + "".join(f"<p>{p}\n</p>" for p in paragraphs) + "</article>"
    assert len(source) > 1 << 20
    got = run(spark, [("http://a.example/", source), ("http://a.example/2", "<article>short")])
    assert got[0].text == "\n\n".join(paragraphs) and got[1].text == "short"
    assert text_of("<div>" * 20_000 + "deep") == "deep"
    assert text_of("<a \"" * 20_000) == ""


def test_query_as_plain_reading(spark):
    """The article's blocks by splitting the source, and templates by counting."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in page_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    assert queries.op13_site_template_text(spark, SF).columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: Page(r.html) for r in rows}
    main, seen, sizes = {}, defaultdict(set), defaultdict(set)
    for r in rows:
        cut = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", cut)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
        assert got[r.page_id].n_marked == len(pages[r.page_id].subtrees)
        host = re.match(r"\w+://([^/]+)", r.url)[1]
        main[r.page_id] = (host, max((b for b in blocks if b), key=len, default=r.html))
        sizes[host].add(main[r.page_id][1])
        for s in pages[r.page_id].subtrees:
            seen[host, s[0]].add(main[r.page_id][1])
    want = {k: len(v) for k, v in seen.items() if len(v) >= max(5, 0.005 * len(sizes[k[0]]))}
    found = page_text.templates(page_text.parse(spark.read.parquet(f"{SF}/pages.parquet")))
    assert {(r.host, r.hash): r.pages for r in found.collect()} == want
