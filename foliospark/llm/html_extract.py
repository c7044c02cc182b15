"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the prose they hold; the pages of a host vote with these scores on generalised
paths (tags with their classes, digits dropped) and the winning path says where the text of each of its pages lies; beside
it all text stays that is no furniture and that the host doesn't repeat.
Only votes are shuffled by host; pages are read again and meet the one winner of their host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import map_columns
from foliospark.sources.scratch import written

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas title textarea select datalist audio video map".split())
#: Elements that are furniture around the article.
FURNITURE = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: Words in class, id or role that mark furniture; reader comments count as such.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar masthead
    breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended
    comment comments disqus respond replies reply login search searchbox widget pager pagination toolbar footer header hidden
    contentinfo complementary alert dialog""".split())
COMMENT_MARKS = frozenset("comment comments disqus respond replies reply related recommended sponsored promo ad".split())
#: Elements that stand for the article of a page.
SIGNS = frozenset("h1 article main".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the given kind ends when they are still open, up to the named boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PLAIN_ROOTS = frozenset(("html", "body", "main"))
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?:svg|math)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+(?<=/)>
    |<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|title|textarea|select)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPLIT = re.compile(r"[^a-z]+")
MAIN = re.compile(r"(?:[^/]*/)*?main(?:\.[^/]*)?(?=/|\Z)")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "parent", "path", "hidden", "mark", "comment", "semantic")

    def __init__(self, tag: str, parent: Element | None, attrs: str, spared: bool = False):
        self.tag, self.parent, self.comment = tag, parent, False
        self.hidden = parent.hidden if parent else False
        #: Innermost element around it, itself included, whose tag or words mark furniture.
        self.mark = parent.mark if parent else None
        self.semantic = parent.semantic if parent else None
        name = tag
        marks: set[str] = set()
        if attrs and not attrs.isspace():
            for key, value in ATTRIBUTE.findall(attrs):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id", "role"):
                    words = {w for w in SPLIT.split(value) if w}
                    marks |= words
                    if key == "class" and words:
                        name += "." + ".".join(sorted(words))
                elif key == "style":
                    self.hidden |= bool(INVISIBLE.search(value))
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    self.hidden = True
        if spared:
            pass
        elif tag in FURNITURE and not (tag == "header" and self.semantic) or tag not in PLAIN_ROOTS and marks & (COMMENT_MARKS if tag == "article" else MARKS):
            self.mark, self.comment = self, bool(marks & COMMENT_MARKS)
        if tag == "article" or tag == "main" and not self.semantic:
            self.semantic = self
        self.path = f"{parent.path}/{name}" if parent and tag in BLOCKS else parent.path if parent else name

    @property
    def noise(self) -> bool:
        return self.hidden or self.mark is not None


def parse(page: str) -> list[tuple[Element, str, int]]:
    """Blocks of text in page order, furniture left out: (innermost block element, text as it stands, characters inside links).

    A tolerant reading: unknown end tags are skipped, a paragraph ends where a block begins, a page may break off anywhere.
    Where what a mark takes away is the article itself, the page is read again without that mark.
    """
    blocks, spared = read(page, frozenset())
    return read(page, spared)[0] if spared else blocks


def wrappers(order: dict[Element, int], prose: dict[Element | None, int], signs: set[Element | None]) -> frozenset[int]:
    """Places of the marked elements that hold the article, with the marked elements around them.

    ``prose`` and ``signs`` (an h1, article or main) are given by innermost marked element, None for text without marks. A marked
    element holds the article if it has more prose than all text without marks and either a sign, or most of the prose while
    no unmarked part has a sign. Comments, teasers and furniture by tag other than forms need a sign and a page without one elsewhere.
    """
    clean, total = prose.get(None, 0), sum(prose.values())
    found = set()
    for element, held in prose.items():
        plain = element is not None and not element.comment and (element.tag not in FURNITURE or element.tag == "form")
        bare = None not in signs
        if element is not None and held > clean and (element in signs and (plain or bare) or plain and bare and 2 * held > total):
            up: Element | None = element
            while up is not None:
                found.add(order[up])
                up = up.parent.mark
    return frozenset(found)


def read(page: str, spared: frozenset[int]) -> tuple[list[tuple[Element, str, int]], frozenset[int]]:
    """Blocks of a page, where the marks of the elements at the given places don't count, and the places of marks to spare."""
    root = Element("html", None, "")
    stack = [root]
    blocks: list[tuple[Element, str, int]] = []
    pending: list[str] = []
    linked = links = place = 0
    owner = root
    order: dict[Element, int] = {}
    prose: dict[Element | None, int] = defaultdict(int)
    signs: set[Element | None] = set()

    def flush():
        nonlocal linked
        if pending:
            text = "".join(pending)
            if text.strip():
                blocks.append((owner, text, linked))
            pending.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            top, part = stack[-1], m["text"]
            if not (links or top.hidden):
                prose[top.mark] += len(part.strip())
            if top.noise:
                continue
            if links:
                linked += len(part)
            pending.append(part)
        elif kind == "attrs":
            tag = m["tag"].lower()
            if tag in VOID:
                if tag in ("br", "hr", "wbr", "img"):
                    pending.append("" if tag == "wbr" else " ")
                if tag == "hr":
                    flush()
                continue
            if tag in ("html", "head"):
                continue
            if tag in BLOCKS:
                flush()
                ends, limits = CLOSES.get(tag, (set(), BLOCKS - {"p"}))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p" or stack[i].tag in ends:
                        del stack[i:]
                    elif stack[i].tag in limits:
                        break
            if tag == "a":
                links = 1
            place += 1
            element = Element(tag, stack[-1], m["attrs"], place in spared)
            if element.mark is element:
                order[element] = place
            elif tag in SIGNS and not element.hidden:
                signs.add(element.mark)
            if not m["attrs"].endswith("/"):
                stack.append(element)
            if tag in BLOCKS:
                owner = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
        elif kind == "end":
            tag = m["end"].lower()
            if tag == "a":
                links = 0
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in BLOCKS:
                        flush()
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            if tag in BLOCKS:
                flush()
                owner = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
    flush()
    return blocks, wrappers(order, prose, signs) if order else frozenset()


def container(element: Element) -> Element:
    """The element a block's prose is credited to: the article or main part around it, else the innermost div or body, so that
    cells, list items and sections count for the part they stand in."""
    if element.semantic is not None:
        return element.semantic
    while element.tag not in ("div", "body", "html") and element.parent is not None:
        element = element.parent
    return element


def candidates(page: str | None) -> list[tuple[str, float, bytes]]:
    """(generalised path, prose outside links, digest of the text) of every container of a page, best first."""
    scores: dict[str, float] = defaultdict(float)
    texts: dict[str, list[str]] = defaultdict(list)
    for element, text, linked in parse(page or ""):
        at = container(element).path
        scores[at] += max(0, len(text.strip()) - linked)
        texts[at].append(text)
    return [(p, s, digest("\0".join(texts[p]))) for p, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))]


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def within(path: str, of: str) -> bool:
    return path == of or path.startswith(of + "/")


def extract(page: str | None, path: str | None, repeated: list[str] | None = None) -> str:
    """Text of the page without furniture: with the containers of the path all that stands beside them, but for those the host repeats.

    Parts of an article may lie in any containers, so none is left out for its size. What a host repeats from page to page beside
    its winning path is furniture; a page without that path is read whole. A winner inside main keeps the text to main.
    References are decoded, white space inside a block becomes one space, blocks are joined by one space.
    """
    blocks = [(e.path, container(e).path, t) for e, t, _ in parse(page or "")]
    gone = set(repeated or ())
    if not (path and any(within(at, path) for at, _, _ in blocks)):
        path, gone = next((p for p, _, _ in candidates(page)), ""), set()
    main = MAIN.match(path)
    scope = main[0] if main else ""
    found = (" ".join(html.unescape(t).split()) for at, c, t in blocks if within(at, path) or (not scope or within(at, scope)) and c not in gone)
    return " ".join(t for t in found if t)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty for null or other text."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, repeated``: the path with the highest sum of scores over the pages of each host, ties to the path first in order,
    and the paths off its line whose text the host repeats: seen on three different pages or more, with less than half as many texts.

    Partial sums are formed before votes are shuffled, so a host with a third of all pages costs as much as any other.
    """
    def run(hosts, texts):
        out: dict[str, list] = {"host": [], "path": [], "page": [], "text": [], "points": []}
        for host, page in zip(hosts, texts, strict=True):
            found = candidates(page)
            total = sum(s for _, s, _ in found) or 1.0
            name = digest(page or "")
            for path, points, text in found:
                for key, value in zip(out, (host, path, name, text, points / total), strict=True):
                    out[key].append(value)
        return out

    votes = map_columns(pages.select(host_of(F.col("url")).alias("host"), "html"), run, "host string, path string, page binary, text binary, points double")
    seen = votes.groupBy("host", "path", "page", "text").agg(F.sum("points").alias("points"))
    texts = seen.groupBy("host", "path", "text").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("pages"))
    totals = texts.groupBy("host", "path").agg(F.round(F.sum("points"), 6).alias("points"), F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("texts"))
    again = F.when((F.col("pages") >= 3) & (2 * F.col("texts") < F.col("pages")), F.col("path"))
    hosts = totals.groupBy("host").agg(F.min_by("path", F.struct(-F.col("points"), F.col("path"))).alias("path"), F.collect_list(again).alias("repeated"))
    line = F.concat("path", F.lit("/"))
    return hosts.withColumn("repeated", F.filter("repeated", lambda r: ~line.startswith(F.concat(r, F.lit("/")))))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, text`` for every row of ``pages(page_id, url, html)``.

    A null or empty page has an empty text; a null url belongs to the host with the empty name. Repeated rows repeat
    their result; other columns are ignored; a page without the winning container is read whole.
    """
    spark = pages.sparkSession
    winners = written(spark, host_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left")

    def run(ids, urls, texts, hosts, paths, repeated):
        return {"page_id": ids, "url": urls, "host": hosts, "path": paths, "text": [extract(*x) for x in zip(texts, paths, repeated, strict=True)]}

    return map_columns(rows.select("page_id", "url", "html", "host", "path", "repeated"), run, "page_id long, url string, host string, path string, text string")
