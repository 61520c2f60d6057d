"""Main text of web pages by composite text density.

Every node of a page's tree gets its link-adjusted characters per tag (the
composite text density), every node the sum of its children's densities. The
node with the largest sum marks the article, with the outermost article element
around it; the least density on its path to the body is the threshold that
other parts must reach to belong to it. Further article elements beside that
path belong to it unless they are mostly links.
Page furniture that says what it is by element, role or as hidden takes no
part in the counts and is left out of the text. A class or id that names
furniture is a hint only: inside the article it takes out what is sparser than
the threshold or mostly links (adverts, notices, menus, sidebars and readers'
comments always), beside the article it keeps a part from joining; where most
of the page's prose stands under it, it is a layout's name and says nothing. A
heading right before the article, or the page's only h1 above it, belongs to it.

Text is put out block by block: character references decoded, white space
within a block as one space (a line break element counts as white space),
blocks joined by a line feed.

Cases: null or empty html, and pages without text, give ""; broken markup is
read the way browsers do, as far as closing tags go (a tag or comment that
never ends takes the rest of the page; a value whose quote is never closed ends
its tag at the next ">"), in time linear in the page; pages of any length are
read whole; repeated rows are extracted alike; other columns pass through.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrlens.llm.common import byte_batches, small_batches

# Fixed values of HTML: elements without an end tag, elements whose contents
# are no markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# An open element of the first kind ends where one of the second begins.
CLOSES = {
    "p": BLOCKS - {"html", "body", "caption", "legend", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt"} | {"li", "dd", "dt"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
# An end or start tag never closes an element outside of these.
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form".split())

# Page furniture by element, by role, and by words of a class or id.
NOISE_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe svg canvas object "
    "embed audio video dialog menu title".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright dialog disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination paywall popup promo promotion promoted recommended related replies reply respond "
    "search share sharing sidebar sidebars signin signup skip social sponsor sponsored subscribe subscription teaser "
    "teasers toolbar topbar tracking widget widgets".split()
)
VISITORS = frozenset("comment comments disqus replies reply respond".split())  # readers' text, which may be as dense as an article
# Words that name what a text is, not where it stands: no layout while there is other prose.
KINDS_OF_TEXT = VISITORS | frozenset(
    "ad ads adsense advert adverts advertisement advertising consent cookie cookies copyright gdpr newsletter popup promo promotion "
    "promoted sponsor sponsored".split()
)
# Parts that go out of an article whatever their density.
ASIDES = KINDS_OF_TEXT | frozenset(
    "banner breadcrumb breadcrumbs menu nav navbar navigation notice notices notification pager pagination paywall related share "
    "sharing sidebar sidebars subscribe subscription".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset(["header"])  # also an element: noise outside an article
BEARERS = frozenset(["has", "no", "with", "without"])  # "with-sidebar" names no sidebar
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())

# White space and slashes, or one attribute: its whole name, then a quoted, bare
# or empty value. A quote in a name or bare value opens nothing.
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_VALUE = r"[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)|(?=>))"
_ATTR = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_BARE = _VALUE.replace("([", "(?:[")
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_TOKEN = re.compile(
    rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_NAME}(?:{_BARE})?+)*+)>|<!--(?:-?>|.*?--!?>)|<(?:!(?!--)|\?|/(?![a-zA-Z]))[^>]*+>", re.S
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Values by whole lower-case names; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _is_noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    return (
        "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in attrs.get("style", "").lower().replace(" ", "")
        or attrs.get("role", "").lower() in NOISE_ROLES
    )


def _label(tag: str, attrs: dict[str, str], in_article: bool) -> frozenset[str]:
    """The words of a class or id that name page furniture."""
    found = set()
    for name in ("class", "id"):
        value = attrs.get(name, "")
        if not value or tag in ("html", "body") or tag in ("article", "main") and "comment" not in value.lower():
            continue
        for label in value.split():
            words = _WORD.findall(_CAMEL.sub(" ", label).lower())
            for before, word in zip(["", *words], words):
                if before not in BEARERS and (word in NOISE_WORDS or (word in HEADER_WORDS and not in_article)):
                    found.add(word)
    return frozenset(found)


class Page:
    """A page's tree as lists by node, in page order: node 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise, self.label = ["#root"], [-1], [False], [frozenset()]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at a block's start or end
        open_, in_article = [0], [0]
        self.places: dict[str, list[int]] = {}  # where in open_ the elements of a tag stand
        self.scopes, self.marks = [], []  # the same of SCOPE, and of SCOPE and CLOSES
        at, n = 0, len(source)
        for start in iter(lambda: _MARKUP.search(source, at), None):
            if start.start() > at:
                self.events.append((open_[-1], source[at : start.start()]))
            m = _TOKEN.match(source, start.start())
            if m is None:  # never closed
                at = n
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(open_, in_article, tag)
                continue
            while open_[-1] and tag in CLOSES.get(self.tag[open_[-1]], ()):
                self._pop(open_, in_article)
            if tag in CLOSES["p"] or tag in CLOSES:  # an open paragraph or item further up ends too
                for k in reversed(self.marks):
                    up = self.tag[open_[k]]
                    if tag in CLOSES.get(up, ()):
                        while len(open_) > k:
                            self._pop(open_, in_article)
                        break
                    if up in SCOPE:
                        break
            node = len(self.tag)
            attrs = _attributes(m[3] or "")
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.noise.append(self.noise[open_[-1]] or _is_noise(tag, attrs, bool(in_article[-1])))
            self.label.append(_label(tag, attrs, bool(in_article[-1])) if attrs else frozenset())
            if tag in BLOCKS:
                self.events.append((node, None))
            elif tag == "br":
                self.events.append((open_[-1], " "))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(source, at)
                at = source.find(">", end.end()) + 1 or n
                continue
            for places in self._places(tag):
                places.append(len(open_))
            open_.append(node)
            in_article.append(in_article[-1] or tag in ("article", "main"))
        if at < n:
            self.events.append((open_[-1], source[at:]))

    def _places(self, tag: str) -> list[list[int]]:
        """The lists that hold the place of an open element."""
        scope = tag in SCOPE
        return [self.places.setdefault(tag, []), *[self.scopes] * scope, *[self.marks] * (scope or tag in CLOSES)]

    def _pop(self, open_: list[int], in_article: list) -> None:
        node = open_.pop()
        in_article.pop()
        for places in self._places(self.tag[node]):
            places.pop()
        if self.tag[node] in BLOCKS:
            self.events.append((node, None))

    def _close(self, open_: list[int], in_article: list, tag: str) -> None:
        here = self.places.get(tag)
        if not here or (tag not in BLOCKS and self.scopes and self.scopes[-1] > here[-1]):
            return
        k = here[-1]
        while len(open_) > k:
            self._pop(open_, in_article)

    def densities(self, out: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite density, sum of the children's, characters and link
        characters of every node; nodes in ``out`` take no part."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        own = [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.events:
            if text and not out[node]:
                k = len("".join(text.split()))
                own[node] += k
                chars[node] += k
                if in_link[node]:
                    links[node] += k
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        ratio = links[0] / max(chars[0], 1)
        density = [0.0] * n
        for i in range(n):
            c, lc = chars[i], links[i]
            if c:
                t = max(tags[i], 1)
                base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
                share = c / max(lc, 1) * t / max(link_tags[i], 1)
                density[i] = c / t * (math.log(max(share, 1.0)) / math.log(base) if base > 1 else math.log(max(share, 1.0)))
        sums = [float(k) for k in own]  # text of a node's own counts as a child of its own length
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        return density, sums, chars, links

    def _under(self, said: frozenset[str] | set[str]) -> list[bool]:
        """Which nodes are noise or stand under a label, words of ``said``
        aside."""
        out = self.noise[:]
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]] or bool(self.label[i] - said)
        return out

    def _said(self, best: int, marking: bool) -> set[str]:
        """Words of the labels around ``best`` that name a layout, not
        furniture: most of the page's prose (text that is neither link nor
        heading) stands under them, or (``marking``) its main heading or main
        element; never where an article or main element stands beside them
        alone."""
        n = len(self.tag)
        plain, prose, marks, articles = [True] * n, [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            articles[i] = self.tag[i] in ("article", "main") or articles[self.parent[i]]
            plain[i] = plain[self.parent[i]] and self.tag[i] not in HEADINGS | {"a"}
        for node, text in self.events:
            if text and not self.noise[node]:
                marks[node] = marks[node] or self.tag[node] in ("h1", "main") and bool(text.strip())
                if plain[node]:
                    prose[node] += len("".join(text.split()))
        path = [best]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        said: set[str] = set()
        for top in reversed(path):
            if not self.label[top] - said:
                continue
            inside = [False] * n
            inside[top] = True
            for i in range(top + 1, n):
                inside[i] = inside[self.parent[i]]
            out = self._under(said)
            here = sum(k for k, x in zip(prose, inside) if x)
            beside = sum(k for k, x, y in zip(prose, inside, out) if not x and not y)
            marked = marking and any(m and x for m, x in zip(marks, inside)) and not any(m and not x and not y for m, x, y in zip(marks, inside, out))
            wrapped = any(a and k and x for a, k, x in zip(articles, prose, inside))
            elsewhere = any(a and k and not x and not y for a, k, x, y in zip(articles, prose, inside, out))
            if elsewhere and not wrapped:
                break
            if not marked and (beside if self.label[top] & KINDS_OF_TEXT else 2 * beside >= here):
                break
            said |= self.label[top]
        return said

    def kept(self) -> list[bool]:
        """Which nodes belong to the article."""
        n = len(self.tag)
        most = lambda sums, chars, out: max((i for i in range(n) if not out[i] and chars[i]), key=lambda i: (sums[i], -i), default=None)
        out, said = self._under(frozenset()), frozenset()
        density, sums, chars, links = self.densities(self.noise)
        all_density, all_chars, all_links = density, chars, links  # of labelled parts too
        best = most(sums, chars, self.noise)
        if best is None:
            return [False] * n
        if out != self.noise:
            labelled = best if out[best] else most(sums, chars, [x or not y for x, y in zip(self.noise, out)])
            said = self._said(labelled, labelled == best) if labelled is not None else said
            out = self._under(said)
        if out != self.noise:
            density, sums, chars, links = self.densities(out)
            best = most(sums, chars, out)
            if best is None:
                return [False] * n
        path = [best]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        # The outermost article element around the best node, or else the main element.
        for tag in ("article", "main"):
            around = [i for i in path if self.tag[i] == tag]
            if around:
                best = around[-1]
                path = path[path.index(best) :]
                break
        threshold = min((density[i] for i in path if self.tag[i] not in ("#root", "html")), default=0.0)
        on_path, whole = set(path), [False] * n
        after, last = [0] * n, {}  # the next element beside a node
        for i in range(n - 1, 0, -1):
            if chars[i] or i in on_path:
                after[i] = last.get(self.parent[i], 0)
                last[self.parent[i]] = i
        h1 = [i for i in range(n) if self.tag[i] == "h1" and chars[i] and not out[i]]
        above = {h1[0]} if len(h1) == 1 and h1[0] < best else set()  # the only h1
        for i in range(n):
            p = self.parent[i]
            if self.noise[i]:
                continue
            if i == best:
                whole[i] = True
            elif p >= 0 and whole[p]:
                label = self.label[i] - said
                sparse = all_links[i] > 0.5 * all_chars[i] or all_density[i] < threshold
                whole[i] = not label or not (label & ASIDES or sparse)
            elif p in on_path and i not in on_path and not out[i] and chars[i]:
                heads = self.tag[i] in HEADINGS and (i in above or after[i] in on_path)
                inside = self.tag[p] not in ("#root", "html", "body") and self.tag[i] in TEXT_TAGS
                whole[i] = links[i] <= 0.5 * chars[i] and (density[i] >= threshold or inside or heads or self.tag[i] == "article")
        return whole

    def text(self) -> str:
        kept = self.kept()
        blocks, held = [], []
        for node, text in self.events:
            if text is None:
                if held:
                    blocks.append("".join(held))
                    held = []
            elif kept[node]:
                held.append(text)
        blocks.append("".join(held))
        out = (" ".join(entities.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in out if b)


def main_text(source: str | None) -> str:
    """The article's text of a page."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in ``out`` (in place of a
    column of that name)."""
    small_batches(pages.sparkSession)
    byte_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in sources], dtype=object)

    return pages.withColumn(out, run(F.col(html)))
