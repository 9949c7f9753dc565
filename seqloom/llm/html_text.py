"""HTML extraction by tree scoring.

The page is read once into a tree (tags, parents, subtree ends, marks) and a list of text
pieces. Marks say what an element probably is: elements that don't hold the article (navigation,
page headers and footers, asides, forms ...) and elements whose class, id or role says so
(adverts, notices, sidebars, comments ...); inside an ``article`` or ``main`` element, headers
aren't marked, and paragraphs, headings, lists and tables only as adverts or comments. A word that
another one takes back (``no-comments``, ``has-sidebar``) marks nothing.

Then the texts decide (``_cut``). Hidden elements, controls, adverts and comments go. Other marked
elements go as well, the outermost first, unless few of their letters are linked, they hold
most of the page (a third of it, if the marking word is only part of a longer name like
``social-science``; for menus, sidebars, footers and the like: ten times all that is left), and
there is no article or main element outside of them.

Each remaining block of text passes points to its container, half of them to the container
above, a quarter to the next and so on: one point, one for each comma, and up to three for
length, less the share of its text that is linked. A container's sum is discounted once more by
its link density. The best container is kept, widened to the ``article`` or ``main`` around it,
with those of its siblings that score a fifth of it or are plain text without many links.

The text is all of the kept blocks in page order: character references decoded, white space
inside a block turned into one space, ends trimmed, blocks joined by one newline. ``br`` is
white space. Nothing is capped, and every step is linear in the page, however deep it is nested.

Defined results: null and empty html give an empty text; a page without any kept block gives
an empty text; of containers with equal scores the first is the best; broken markup (unclosed
elements, a cut-off end, no head or body tags) is read as far as it goes, and pages of any
length are read whole; repeated rows give equal results; ids of any type, null or not, and columns of any name pass
through unless named like the outputs; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html as _html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from seqloom.runtime import in_batches

_TAG = re.compile(r"""<(?:!--|(?P<decl>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>)""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_COMMENT_END = re.compile("--!?>")
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
GONE = frozenset("button select option menu dialog head object canvas audio video".split())
CUT = frozenset("nav aside footer".split())
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th figcaption caption address summary".split())
CONTAINERS = frozenset("article main section div body td html blockquote center".split())
#: Opening the key closes an open element of the set.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements across which an end tag or an implied end doesn't reach.
SCOPES = frozenset("table td th article section main div body html ul ol dl blockquote".split())
#: Words of a class, id or role that mark what isn't the article.
UNLIKELY = frozenset(
    """ad ads adv advert advertisement advertising adsbox adslot banner sponsor sponsored promo promotion promoted
    comment comments commentlist disqus discussion respond reply replies sidebar aside widget widgets
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar
    share sharing social related recommended recommendations trending popular tags taglist skip hidden
    complementary contentinfo search dialog form feedback""".split()
)
#: Words that mark the article, whatever else the class says.
LIKELY = frozenset("article articlebody content entry main post story maincontent".split())


#: Words that rule an element out even if another word marks the article; those that rule out an article element.
STRONG = frozenset("comment comments commentlist ad ads advert advertisement sponsored related share sharing social footer newsletter promo breadcrumb breadcrumbs pagination".split())
STRONGEST = frozenset("comment comments commentlist ad ads advert advertisement sponsored".split())
#: Words that mark adverts and comments; those whose elements may hold a page by their kind; those that take back the next word; those that add nothing to a name.
SOFT = frozenset("search form social modal overlay popup dialog widget widgets notice alert tags share sharing skip banner hidden feedback".split())
TAKEN_BACK = frozenset("no not non has have with without hide hides".split())
NAMELESS = frozenset(
    """box wrap wrapper container inner outer block section area bar list item items link links button buttons row column col left right top bottom main
    content contents body text title header heading head group panel region unit slot area zone module component icon icons image img media posts post articles article stories
    story results result input field fields message messages small large desktop mobile sticky fixed primary secondary global site page the a of by and for in x px""".split()
)
#: Elements of running text, which inside an article only the strongest words rule out.
RUNNING = TEXTUAL | frozenset("table thead tbody tfoot tr ul ol dl figure".split())


#: Marks, from none to what never stays.
NONE, PART, SOFTLY, FIRMLY, ALWAYS = range(5)


def _named(value: str) -> dict[str, int]:
    """Marking words of a class, id or role, with the marks they give."""
    out: dict[str, int] = {}
    for token in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", token).lower())
        held = [w for k, w in enumerate(words) if w in UNLIKELY and not (k and words[k - 1] in TAKEN_BACK)]
        # a longer name counts in full if its other words say nothing, or its last word marks it
        full = bool(held) and (words[-1] == held[-1] or all(w in UNLIKELY or w in NAMELESS or w.isdigit() for w in words))
        for w in held:
            mark = ALWAYS if w in STRONGEST else PART if not full else SOFTLY if w in SOFT else FIRMLY
            out[w] = max(out.get(w, NONE), mark)
    return out


def _mark(attrs: str, name: str = "div", inside: bool = False) -> int:
    """How surely class, id, role or a hiding attribute rule an element out; ``inside`` an article or main element or not."""
    out = NONE
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "hidden":
            if m.group(2) is None or value.lower() in ("", "hidden", "true"):
                return ALWAYS
        elif key == "aria-hidden":
            if value.lower() == "true":
                return ALWAYS
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return ALWAYS
        elif key in ("class", "id", "role"):
            bad = _named(value)
            if bad and (name in ("article", "main") or inside and name in RUNNING):
                bad = {w: k for w, k in bad.items() if w in STRONGEST}
            elif bad and key != "role" and set(_WORD.findall(_CAMEL.sub(" ", value).lower())) & LIKELY:
                bad = {w: k for w, k in bad.items() if w in STRONG}
            out = max([out, *bad.values()])
    return out


class _Page:
    """Preorder arrays of the tree and the text pieces in page order."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.ends, self.marks = ["#root"], [-1], [0], [NONE]
        self.pieces: list[tuple[int, int, str, bool]] = []  # block, node, text, in a link
        self.block = 0
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[int] = [0]
        names: list[str] = ["#root"]
        open_: dict[str, int] = {}  # how often each name is open
        links = around = 0  # open links, and open articles or mains
        at, size = 0, len(source)

        def pop() -> None:
            nonlocal links, around
            node, name = stack.pop(), names.pop()
            open_[name] -= 1
            self.ends[node] = len(self.tags)
            if name == "a":
                links -= 1
            if name in ("article", "main"):
                around -= 1

        def close(targets, scopes) -> bool:
            """Pops up to an open element of ``targets`` that lies inside no ``scopes``."""
            if not any(open_.get(t) for t in targets):
                return False
            for k in range(len(names) - 1, 0, -1):
                if names[k] in targets:
                    while len(names) > k:
                        pop()
                    return True
                if names[k] in scopes:
                    return False
            return False

        while at < size:
            m = _TAG.search(source, at)
            stop = m.start() if m else size
            if stop > at:
                if open_.get("head") and not source[at:stop].isspace():
                    close({"head"}, frozenset())
                self.pieces.append((self.block, stack[-1], source[at:stop], links > 0))
            if m is None:
                break
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                if m["decl"] is None:  # a comment
                    short = 1 if source.startswith(">", at) else 2 if source.startswith("->", at) else 0
                    end = _COMMENT_END.search(source, at)
                    at = at + short if short else end.end() if end else size
                else:
                    end = source.find(">", at)
                    at = size if end < 0 else end + 1
                continue
            name = name.lower()
            block = name not in INLINE
            if m["end"] or m["end2"]:
                if block:
                    self.block += 1
                if name == "p" or name in TEXTUAL:
                    close({name}, SCOPES - {name})
                elif block:
                    close({name}, frozenset())
                else:
                    close({name}, SCOPES | TEXTUAL)
                continue
            if open_.get("head") and name not in IN_HEAD:
                close({"head"}, frozenset())
            if block:
                self.block += 1
                close({"p"}, SCOPES)
                if name in CLOSES:
                    close(CLOSES[name], {"ul", "ol", "dl", "table", "#root"} - {name})
                if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    close({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPES)
            if name in VOID:
                if name == "br":
                    self.pieces.append((self.block, stack[-1], " ", links > 0))
                continue
            attrs = m["attrs"] if m["name"] else m["attrs2"]
            if name in RAW:
                if attrs.endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
                continue
            if attrs.endswith("/") and not block:
                continue
            mark = _mark(attrs, name, around > 0) if attrs and name not in ("html", "body") else NONE
            if name in GONE:
                mark = ALWAYS
            elif name in CUT or (name == "header" and not around):
                mark = max(mark, FIRMLY)
            elif name == "form":
                mark = max(mark, SOFTLY)
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.ends.append(0)
            self.marks.append(mark)
            stack.append(len(self.tags) - 1)
            open_[name] = open_.get(name, 0) + 1
            names.append(name)
            if name == "a":
                links += 1
            if name in ("article", "main"):
                around += 1
        while len(stack) > 1:
            pop()
        self.ends[0] = len(self.tags)


def _cut(page: _Page) -> list[bool]:
    """Which elements go, with all they hold."""
    parents, ends, marks, n = page.parents, page.ends, page.marks, len(page.tags)
    chars, linked = [0] * n, [0] * n
    for _, node, text, link in page.pieces:
        size = len(text.strip())
        chars[node] += size
        linked[node] += size if link else 0
    free = list(chars)  # letters below a node that lie in no marked element below it
    for node in range(n - 1, 0, -1):
        up = parents[node]
        if marks[node] != ALWAYS:
            chars[up] += chars[node]
            linked[up] += linked[node]
        if marks[node] == NONE:
            free[up] += free[node]
    gone = [m == ALWAYS for m in marks]
    # by node: the marked element around it, and whether an article or main is; by marked element: articles with text in it
    over, within, articles = [0] * n, [False] * n, [0] * n
    for node in range(1, n):
        up = parents[node]
        over[node], within[node] = up if marks[up] != NONE else over[up], within[up] or page.tags[up] in ("article", "main")
        if page.tags[node] in ("article", "main") and marks[node] == NONE and free[node]:
            articles[over[node]] += 1
    left, shown, waiting = free[0], articles[0], []

    def below(node: int) -> None:
        """Queues the outermost marked elements below a node that stays."""
        k = node + 1
        while k < ends[node]:
            if marks[k] == NONE:
                k += 1
                continue
            if marks[k] != ALWAYS:
                heapq.heappush(waiting, (-chars[k], k))
            k = ends[k]

    below(0)
    while waiting:
        size, node = heapq.heappop(waiting)
        size = -size
        share = {PART: 1 / 3, SOFTLY: 1 / 2}.get(marks[node], 2.0)
        most = (within[node] or not shown) and size > share * chars[0]
        if 10 * linked[node] < 3 * size and (most or not shown and size > 10 * left):
            left += free[node]
            shown += articles[node]
            below(node)
        else:
            gone[node] = True
    for node in range(1, n):
        gone[node] = gone[node] or gone[parents[node]]
    return gone


def extract(source: str | None) -> str:
    """Main text of one page."""
    if not source:
        return ""
    page = _Page(source)
    tags, parents, ends, gone = page.tags, page.parents, page.ends, _cut(page)
    # blocks: text by (block, owning block element)
    blocks: list[list] = []
    for block, node, text, link in page.pieces:
        if gone[node]:
            continue
        if "&" in text:
            text = _html.unescape(text)
        if blocks and blocks[-1][0] == block:
            last = blocks[-1]
            last[2].append(text)
        else:
            last = [block, node, [text], 0]
            blocks.append(last)
        if link:
            last[3] += len(text.strip())
    kept = []
    for _, node, parts, linked in blocks:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            kept.append((node, text, linked))
    if not kept:
        return ""
    n = len(tags)
    owners = list(range(n))  # the element that an inline element's text belongs to
    for node in range(1, n):
        if tags[node] in INLINE:
            owners[node] = owners[parents[node]]
    points, chars, linked_chars = [0.0] * n, [0] * n, [0] * n
    for node, text, linked in kept:
        owner = owners[node]
        chars[owner] += len(text)
        linked_chars[owner] += linked
        worth = (1.0 + text.count(",") + min(len(text) / 100, 3.0)) * (1.0 - min(1.0, linked / len(text)))
        points[parents[owner] if tags[owner] in TEXTUAL else owner] += worth
    for node in range(n - 1, 0, -1):
        chars[parents[node]] += chars[node]
        linked_chars[parents[node]] += linked_chars[node]
        points[parents[node]] += points[node] / 2

    def score(node: int) -> float:
        return points[node] * (1.0 - linked_chars[node] / chars[node]) if chars[node] else 0.0

    best = max((k for k in range(n) if tags[k] in CONTAINERS or k == 0), key=lambda k: (score(k), -k))
    around = best
    while around > 0 and tags[around] not in ("article", "main"):
        around = parents[around]
    least = 0.2 * score(best)
    best = around if around > 0 else best
    ranges = [(best, ends[best])]
    if best > 0:
        k = parents[best] + 1
        while k < ends[parents[best]]:
            if k != best and chars[k] and (score(k) >= least > 0 or (tags[k] in TEXTUAL and linked_chars[k] < 0.25 * chars[k])):
                ranges.append((k, ends[k]))
            k = ends[k]
    ranges.sort()  # siblings: none holds another
    starts = [a for a, _ in ranges]

    def inside(node: int) -> bool:
        k = bisect_right(starts, node) - 1
        return k >= 0 and node < ranges[k][1]

    return "\n".join(text for node, text, _ in kept if inside(node))


def extract_pages(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the html by default) with ``text`` and ``n_chars``."""

    def compute(sources: list) -> list[list]:
        texts = [extract(h) for h in sources]
        return [texts, [len(t) for t in texts]]

    names = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]
    return in_batches(pages, [html_col], [(c, c) for c in names], "text string, n_chars long", compute)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("page_id", "url"))
