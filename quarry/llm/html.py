"""Main text of web pages through a site style tree.

The DOMs of a host's pages are merged into one tree of style nodes: the
elements of a path with the same tags and the same class and id words, all of
them, as a running 64-bit hash.  A
node's content importance is how much its texts tell of the page they are on
(their mutual information with the pages' own texts, relative to the most it
could be), so that what every page repeats scores 0, in an article as well as
outside.  The entropy of its presentation, how often it stands on a page, adds
to that, and how much of its text is links is the weight by which both count.
Few pages tell little, so what they tell is mixed with what a node is likely
to be: text in an article, or on a page without one, is the page's own; text
beside an article that holds most of the page is not.  Branches of low importance
are removed from each page and the rest is the page's text.  Where the pages
themselves are copies of each other, repetition tells nothing of the article.

What is not shown, and branches whose tags, roles, class or id words mark them
as something other than the article (menus, headers, footers, sidebars,
notices, adverts, forms, comments), go whatever they hold.  Only a class or id
word, or a form, that lies around the article marks nothing; so does one
without which the page would have no text at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sent_if_small, ship, text_of, tidy, written

# fixed values: how HTML elements behave
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table
tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object head noframes xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
LIST_SCOPE = frozenset("ul ol dl table select menu article main body".split())
# fixed values: elements, roles and class or id words that mark what is not the article
NOT_MAIN_TAGS = frozenset("nav footer aside form menu dialog select button fieldset search".split())
NOT_MAIN_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
NOT_MAIN_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner
comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification notifications alert
popup modal overlay newsletter subscribe subscription signup sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs
masthead footer share sharing social related recommended recommendations pagination pager widget widgets toolbar login hidden""".split())
#: below this a branch goes
LEAST = 0.25
#: for text in an article (+), on a page without one (.) and beside one (,): its weight, what links take off it,
#: how likely it is the page's own, and how many further pages outweigh that
PRIORS = {"+": (1.0, 0.5, 1.0, 1), ".": (0.6, 0.8, 1.0, 1), ",": (0.6, 0.8, 0.2, 2)}


def _parser():
    import re

    from xxhash import xxh64_intdigest
    token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
    attribute = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
    part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
    styles: dict[tuple[str, str], tuple[str, int]] = {}

    def style(tag: str, attributes: str) -> tuple[str, int]:
        """The style node's name, and -3 if marked as not shown, -2 (by a class or id word, or as a form) or -1 as not the article, 1 as it."""
        if not attributes and (tag, "") in styles:
            return styles[tag, ""]
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in attribute.finditer(attributes)} if attributes.strip() else {}
        words = [w.lower() for w in part.findall(found.get("class", "") + " " + found.get("id", ""))]
        names = sorted({w for w in words if not w.isdigit()})
        role = found.get("role", "").lower()
        if tag in ("body", "html"):
            own = 0
        elif "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            own = -3
        elif role in NOT_MAIN_ROLES:
            own = -1
        elif tag in ("article", "main") or role in ("main", "article"):
            own = 1
        else:
            own = -2 if tag == "form" else -1 if tag in NOT_MAIN_TAGS else 0 if NOT_MAIN_WORDS.isdisjoint(words) else -2
        out = ".".join([tag, *names]), own
        if len(styles) < 100_000:
            styles[tag, attributes] = out
        return out

    def parse(html: str) -> list[tuple[str, str, int, int]]:
        """(path, text, characters, characters in links) of the blocks.  The
        path begins with ! for what is not shown, - for what is marked as not
        the article, + for what is in it, the comma for what lies beside one
        that holds most of the rest, and . for all else."""
        from html import unescape
        blocks: list[tuple[int, str, int, int, bool, int]] = []  # and whether in the article, and the mark it is under
        stack: list[tuple[str, int, bool, int]] = []  # tag, path, whether in the article, mark (0: none)
        marks: list[list] = [[0, 0, False, 0, 0]]  # the mark above, kind, whether in the article, characters outside links, those of articles within
        words: list[str] = []
        links = inside_link = 0

        def flush() -> None:
            nonlocal links
            if words:
                text = " ".join("".join(words).split())
                if text:
                    _, path, main, mark = stack[-1] if stack else ("", 0, False, 0)
                    blocks.append((path, text, len(text), min(links, len(text)), main, mark))
                words.clear()
            links = 0

        def push(tag: str, attributes: str) -> None:
            name, own = style(tag, attributes)
            _, path, main, mark = stack[-1] if stack else ("", 0, False, 0)
            if tag == "header" and not main and own > -3:
                own = -1
            if own < 0:
                marks.append([mark, own, main, 0, 0])
                mark = len(marks) - 1
            stack.append((tag, xxh64_intdigest(name.encode("utf-8", "surrogatepass"), path), main or own > 0, mark))

        def pop_to(at: int) -> None:
            nonlocal inside_link
            for tag, *_ in stack[at:]:
                inside_link -= tag == "a"
            del stack[at:]

        def kinds() -> list[str]:
            """The kind of each mark: a word or form around most of the text of
            the page's articles marks nothing, nor does one around most of a
            page that would have no text otherwise."""
            for _, _, chars, links, main, mark in blocks:
                marks[mark][3] += chars - links
                marks[mark][4] += (chars - links) * main
            for above, _, _, chars, of_main in marks[:0:-1]:
                marks[above][3] += chars
                marks[above][4] += of_main
            void = [own == -2 and not main and 2 * of_main > marks[0][4] for _, own, main, _, of_main in marks]
            for last in (False, True):
                out = [""]
                for (above, own, *_), none in zip(marks[1:], void[1:]):
                    out.append(out[above] if none or out[above] == "!" else "!" if own == -3 else "-")
                if last or any(not out[mark] for *_, mark in blocks):
                    return out
                void = [v or x[1] == -2 and not x[2] and 2 * x[3] > marks[0][3] for v, x in zip(void, marks)]

        at, raw = 0, None
        for m in token.finditer(html):
            if m.start() < at:
                continue
            if raw is None and m.start() > at:
                piece = unescape(html[at:m.start()])
                words.append(piece)
                if inside_link:
                    links += len(piece)
            if raw is not None and not (m[1] and m[2].lower() == raw):
                continue  # inside a script and the like
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if raw is not None:
                raw = None
            elif m[1]:
                found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if tag in BLOCKS or found is not None and any(x[0] in BLOCKS for x in stack[found:]):
                    flush()
                if found is not None and (tag in BLOCKS or not any(x[0] in BLOCKS for x in stack[found:])):
                    pop_to(found)
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    raw = tag if tag != "head" else None
            elif tag == "br":
                words.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
            else:
                if tag in BLOCKS:
                    flush()
                    closes = CLOSES.get(tag)
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p" or closes and stack[i][0] in closes:
                            pop_to(i)
                        elif stack[i][0] in LIST_SCOPE:
                            break
                push(tag, m[3])
                inside_link += tag == "a"
        if raw is None and at < len(html):
            words.append(unescape(html[at:]))
        flush()
        kind = kinds()
        own, beside = (sum(chars - links for _, _, chars, links, main, mark in blocks if not kind[mark] and main == side) for side in (True, False))
        sides = {True: "+", False: "," if own > beside else "."}
        return [(f"{kind[mark] or sides[main]}{path:016x}", *block) for path, *block, main, mark in blocks]

    return parse


def _counter():
    """Blocks of a batch's pages by host, path, text and page (hashes), and as
    rows without a page the pages by how many blocks of a path they have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter, defaultdict

        from xxhash import xxh64_intdigest
        parse = _parser()

        def hashed(text: str) -> int:
            return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)

        def story(blocks: list[tuple[str, str, int, int]]) -> int:
            """What the page is about: the texts in or outside articles, whichever are more."""
            sides = [[b for b in blocks if b[0][0] in kind] for kind in ("+", ".,")]
            return hashed("\n".join(b[1] for b in max(sides, key=lambda side: sum(b[2] - b[3] for b in side))))

        for batch in batches:
            sums: dict = defaultdict(lambda: [0, 0, 0])
            for host, page in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist()):
                blocks = [b for b in parse(page) if b[0][0] in PRIORS]
                about = story(blocks)
                for path, text, chars, links in blocks:
                    x = sums[host, path, hashed(text), about]
                    x[0] += 1
                    x[1] += chars
                    x[2] += links
                for path, times in Counter(b[0] for b in blocks).items():
                    sums[host, path, times, None][0] += 1
            columns = [*zip(*sums)] or [[]] * 4
            numbers = [*zip(*sums.values())] or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip([*columns, *numbers], (pa.string(), pa.string(), *[pa.int64()] * 5))],
                ["_host", "path", "hash", "page", "c", "chars", "links"])
    return tidy(run)


def _extractor():
    """The texts of the pages, without marked branches and those in ``_low``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = _parser()
        for batch in batches:
            found = []
            for page, low in zip(batch.column("_html").to_pylist(), batch.column("_low").to_pylist()):
                blocks = parse(page)
                low = set(low or ())
                found.append("\n\n".join(b[1] for b in blocks if b[0][0] in PRIORS and b[0] not in low))
            keep = [c for c in batch.schema.names if c not in ("_html", "_low")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], [*keep, "text"])
    return tidy(run)


def style_tree(blocks: DataFrame) -> DataFrame:
    """(host, path, importance) of counted blocks (host, path, hash, page, c, chars, links).

    Counts by (host, path, text and page, text, or page) come first, so a host
    with a third of all pages is summed by every task before it meets.
    """
    views = F.when(F.col("page").isNull(), F.array(F.lit("shape"))).otherwise(F.array(*[F.lit(v) for v in ("both", "text", "page")]))
    keys = [F.when(F.col("view") != "page", F.col("hash")).alias("hash"), F.when(F.col("view") != "text", F.col("page")).alias("page")]
    seen = (blocks.withColumn("view", F.explode(views)).groupBy("_host", "path", "view", *keys)
            .agg(*[F.sum(k).alias(k) for k in ("c", "chars", "links")]))

    def total(view: str, value):
        return F.sum(F.when(F.col("view") == view, value))

    nodes = seen.groupBy("_host", "path").agg(
        *[total("both", F.col(k)).alias(k) for k in ("chars", "links")], total("both", F.col("c")).alias("n"), total("shape", F.col("c")).alias("pages"),
        *[total(v, F.col("c") * F.log("c")).alias(v) for v in ("both", "text", "page", "shape")])
    text, page, both = (F.log("n") - F.col(v) / F.col("n") for v in ("text", "page", "both"))
    kind = F.substring("path", 1, 1)

    def prior(k: int):
        return F.element_at(F.create_map(*[F.lit(x) for name, values in PRIORS.items() for x in (name, float(values[k]))]), kind)

    copies = page < 1e-9  # no pages to tell apart
    tells = F.when(~copies, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (text + page - both) / page))).when((kind == ",") & (F.col("n") > 1), text / F.log("n"))
    further = F.when(tells.isNull(), 0.0).otherwise(F.col("pages") - 1.0)
    content = (further * F.coalesce(tells, F.lit(0.0)) + prior(3) * prior(2)) / (further + prior(3))
    shape = F.when(F.col("pages") > 1, (F.log("pages") - F.col("shape") / F.col("pages")) / F.log("pages")).otherwise(0.0)
    links = F.coalesce(F.try_divide(F.col("links"), F.col("chars")), F.lit(0.0))
    weight = prior(0) * (1 - prior(1) * links)
    return nodes.select("_host", "path", (weight * (content + (1 - content) * shape / 5)).alias("importance"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST) -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``.

    A null or empty html gives an empty text; a null or odd url is a host of
    its own kind.  Repeated rows and ids keep their rows; other
    columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), text_of(html_col).alias("_html"))
    tree = style_tree(rows.select("_host", "_html").mapInArrow(_counter(), "_host string, path string, hash long, page long, c long, chars long, links long"))
    # a few branches for each host; the pages meet them where they are unless there are very many hosts
    low = sent_if_small(written(tree.filter(F.col("importance") < least).groupBy("_host").agg(F.collect_list("path").alias("_low")), "style-tree"))
    done = rows.join(low, "_host", "left").select("_id", "_url", "_html", "_low").mapInArrow(
        _extractor(), f"_id {rows.schema['_id'].dataType.simpleString()}, _url {rows.schema['_url'].dataType.simpleString()}, text string")
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


ship(__name__)
