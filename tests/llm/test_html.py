"""Main text of pages."""

import html as escapes
import re

import pytest

from quarry.llm import html


def article(page):
    """The text of the article of a synthetic page, by its fixed layout."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<b>", "")
    blocks = (" ".join(escapes.unescape(x).split()) for x in re.split(r"<br>|</?p>|</?h1>", inner))
    return "\n\n".join(x for x in blocks if x)


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in pages.collect()}
    got = html.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r["page_id"]: (r["url"], r["text"]) for r in got.collect()} == want


@pytest.mark.parametrize("page,want", [
    ("<p>a<b>b</p><p>c &amp; d<br>e</p>", ["ab", "c & d e"]),
    ("text only < 5 & <3", ["text only < 5 & <3"]),
    ('<div class="comments"><p>x</p></div><main>hi<script>var t="</p>";</script> there</main>', ["hi there"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
    ('<!-- <p>x</p> --><a href="x>y">l</a>ink', ["link"]),
    ("<article>unclosed <em>x", ["unclosed x"]),
    ("<article><h1>T</h1><p>a&nbsp;&#8217;s</p><aside>no</aside><div id=adBox>no</div><form>no</form><p hidden>no</p></article><p>out</p>", ["T", "a ’s"]),
    ("<header><h1>site</h1></header><nav>n</nav><table><tr><td>a<td>b<tr><td>c</table><footer>f</footer>", ["a", "b", "c"]),
    ("<script>if(a<b){}</scr", []), ("<style>x", []), ("", []), (None, []),
    ("<p>" + "long " * 50_000 + "</p>", [("long " * 50_000).strip()])])
def test_markup(page, want):
    parse = html._parser()
    blocks = parse(page or "")
    main = any(p.startswith("+") for p, *_ in blocks)
    assert [t for p, t, _, _ in blocks if p.startswith("+" if main else (".", ","))] == want


def test_repeated_branches_of_a_site_go(spark):
    """What every page of a site repeats goes; what varies, and copies in articles, stay."""
    pages = [(i, "http://a.example/x", f"<div class=top>Welcome</div><div class=body><p>story {i}</p></div>", "h") for i in range(30)]
    pages += [(100 + i, "http://b.example:80/y", "<div>site</div><article><p>the same</p></article>", "h") for i in range(30)]
    pages += [(200, None, "<p>alone</p>", "h"), (200, None, "<p>alone</p>", "h"), (None, "odd", None, "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df).collect()), key=str)
    want = [(i, f"story {i}", len(f"story {i}")) for i in range(30)] + [(100 + i, "the same", 8) for i in range(30)] + [(200, "alone", 5)] * 2 + [(None, "", 0)]
    assert got == sorted(want, key=str)
    assert html.main_text(df.limit(0)).count() == 0


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://a.example/x", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"].split("\n\n") for r in html.main_text(df).orderBy("page_id").collect()]


def test_entropy_decides_in_and_beside_articles(spark):
    """A body beside teaser cards stays and repeated cards go; what every article repeats goes, copies of articles stay."""
    cards = "<article><h3>Our best</h3></article><article><h3>Our newest</h3></article>"
    assert texts(spark, [f"<div><p>story {i} of the site</p><p>end {i}</p></div>{cards}" for i in range(30)]) == [
        [f"story {i} of the site", f"end {i}"] for i in range(30)]
    box = "<div><p>Why us</p><p>Read on</p><p>Write to us</p></div>"
    assert texts(spark, [f"<p>{i}</p><article><h1>T {i % 3}</h1><p>story {i % 3}</p>{box}</article>" for i in range(30)]) == [
        [str(i), f"T {i % 3}", f"story {i % 3}"] for i in range(30)]
    assert texts(spark, [f"<p>{i}</p><article><h1>T</h1><p>story</p></article>" for i in range(30)]) == [[str(i), "T", "story"] for i in range(30)]


@pytest.mark.parametrize("page", [
    '<article class="post comments-open"><h1>T</h1><p>{0}</p></article>', '<main class="no-sidebar"><h1>T</h1><p>{0}</p></main>',
    '<div id="page" class="has-menu"><nav><a href="/">home and more</a></nav><h1>T</h1><p>{0}</p></div>',
    '<form id="aspnetForm"><article><h1>T</h1><p>{0}</p></article></form><footer>f</footer>',
    '<article><h1>T</h1><p>{0}</p></article><div class=ad>an advertisement that is longer than all the rest of it</div>',
    '<div class="has-sidebar"><article><h1>T</h1><p>{0}</p></article></div><footer>a very long footer of the whole site, longer than it all</footer>'])
def test_marks_around_the_article_are_none(page):
    assert [t for p, t, *_ in html._parser()(page.format("words of the article")) if p[0] in "+."] == ["T", "words of the article"]


STORY = "<h1>T {0}</h1><p>" + "front {0} " * 30 + "</p>"
PARTS = {
    "comments": lambda i: "<section class=comments>" + "".join(f"<p>comment {i} {j} of reader {i * j}</p>" for j in range(1 + i % 6)) + "</section>",
    "long comments": lambda i: "<div id=disqus_thread class=comment-list>" + "".join(f"<p>{f'said {i} {j} ' * 40}</p>" for j in range(1 + i % 4)) + "</div>",
    "sidebar": lambda i: "<aside class=sidebar>" + "".join(f"<p><a href=/{i}/{j}>See also {i} {j}</a> of {i + j}</p>" for j in range(1 + i % 5)) + "</aside>",
    "nav": lambda i: f"<nav><ul>{''.join(f'<li>chapter {i} {j}' for j in range(200))}</ul></nav>",
    "hidden": lambda i: f"<div hidden><p>{f'draft {i} ' * 90}</p></div>",
    "not displayed": lambda i: f'<div style="color:red; display: none"><p>{f"draft {i} " * 90}</p></div>',
    "advert": lambda i: f"<div class=ad-slot>{''.join(f'<p>buy {i} {j} now</p>' for j in range(1 + i % 3))}</div>",
    "form": lambda i: f"<form><p>{f'write to us {i} ' * 50}</p></form>",
    "dialog": lambda i: f"<div role=dialog><p>{f'accept {i} ' * 60}</p></div>",
    "footer": lambda i: f"<footer><p>{f'imprint {i} ' * 60}</p></footer>"}


@pytest.mark.parametrize("layout", ["<article>{0}</article>{1}", "<article>{0}{1}</article>", "{0}{1}", "<div class=body>{1}{0}</div>"])
def test_marked_and_hidden_parts_go(spark, layout):
    """Inside or beside an article, or without one, however long and varied they are."""
    for few in (1, 2, 60):
        made = [(name, i, layout.format(STORY.format(i), part(i))) for name, part in PARTS.items() for i in range(few)]
        df = spark.createDataFrame([(k, f"http://{name.replace(' ', '')}.example/x", page) for k, (name, _, page) in enumerate(made)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"].split("\n\n") for r in html.main_text(df).collect()}
        for k, (name, i, _) in enumerate(made):
            assert got[k] == [f"T {i}", ("front %d " % i * 30).strip()], (few, name)


def test_boilerplate_beside_articles_of_small_sites_goes(spark):
    """On one page as on many."""
    for few in (1, 2, 3, 5):
        pages = [f"<div class=top>Welcome to us</div><article><p>{f'story {i} ' * 9}</p></article><div class=end>All rights ours</div>" for i in range(few)]
        assert texts(spark, pages) == [[f"{f'story {i} ' * 9}".strip()] for i in range(few)]


@pytest.mark.parametrize("page,want", [
    ("<div class=comments><p>only these</p></div>", ["only these"]),  # the page would have no text
    ("<div class=comments><p>the most of it by far</p></div><p>short</p>", ["short"]),
    ("<nav><p>only a menu</p></nav>", []), ("<div hidden><p>only a draft</p></div><nav>n</nav>", []),
    ("<div class=sidebar-layout><div class=comments><p>theirs, longer than ours</p></div><article><p>ours</p></article></div>", ["ours"])])
def test_when_marks_are_none(page, want):
    assert [t for p, t, *_ in html._parser()(page) if p[0] in html.PRIORS] == want


def entropy(values):
    from collections import Counter
    from math import log
    counts = Counter(values)
    n = sum(counts.values())
    return sum(-c / n * log(c / n) for c in counts.values())


def test_style_tree_against_plain_entropies(spark):
    """Importance of every node of small hosts, from its texts and pages one by one."""
    from collections import Counter, defaultdict
    from math import log
    pages = [(f"h{i % 3}", f"<div class=a>{'same' if i % 2 else i}</div>" + "".join(f"<p>t {i % 4} {j}<a>l {j}</a></p>" for j in range(i % 3)) + f"<article><p>{i % 5}</p>{'<h2>x</h2>' * (i % 2)}</article>") for i in range(36)]
    rows = spark.createDataFrame(pages, "_host string, _html string").repartition(3)
    counted = rows.mapInArrow(html._counter(), "_host string, path string, hash long, page long, c long, chars long, links long")
    got = {(r["_host"], r["path"]): r["importance"] for r in html.style_tree(counted).collect()}
    parse, seen = html._parser(), defaultdict(list)
    for i, (host, page) in enumerate(pages):
        blocks = parse(page)
        side = max(("+", ".,"), key=lambda k: sum(b[2] - b[3] for b in blocks if b[0][0] in k))
        about = "\n".join(b[1] for b in blocks if b[0][0] in side)
        for path, text, chars, links in blocks:
            seen[host, path].append((i, text, about, chars, links))
    assert got.keys() == seen.keys()
    for key, xs in seen.items():
        weight, off, likely, strength = html.PRIORS[key[1][0]]
        ids, texts_, abouts, chars, links = zip(*xs)
        n, many = len(xs), len(set(ids))
        about = entropy(abouts)
        tells = min(1, max(0, (entropy(texts_) + about - entropy(zip(texts_, abouts))) / about)) if about > 1e-9 else entropy(texts_) / log(n) if key[1][0] == "," and n > 1 else None
        further = 0 if tells is None else many - 1
        content = (further * (tells or 0) + strength * likely) / (further + strength)
        shape = entropy([Counter(ids)[i] for i in set(ids)]) / log(many) if many > 1 else 0
        assert abs(got[key] - weight * (1 - off * sum(links) / sum(chars)) * (content + (1 - content) * shape / 5)) < 1e-9, key


@pytest.mark.parametrize("around,one,other", [
    ('<div class="elementor section wrap">' * 40, "<div class=story>", "<div class=box>"),
    ("", '<div class="a b c d e f g h story">', '<div class="a b c d e f g h teaser">')])
def test_paths_are_whole(spark, around, one, other):
    """Deep branches and long class lists are told apart by all they hold."""
    assert texts(spark, [f"{around}{one}story {i}</div>{other}{'read on ' * 9}</div>" for i in range(30)]) == [[f"story {i}"] for i in range(30)]
