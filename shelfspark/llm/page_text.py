"""The main text of web pages by consensus of each host's pages.

A page is read into blocks of text and the containers around them. Regions that are never main text
by their tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, comments, ...)
are left out. A class is one vote only: one that merely sounds like a notice or a list of related
texts (``DOUBTFUL``) is overruled where its region holds prose instead of links and either a third of
the page's text or a place inside the article.

The page's own candidate is found from the root down: the inner region that still holds at least
``SHARE`` of the remaining text, as long as nothing that reads like main text (a heading, paragraph,
quotation, list or table without mostly links, or a longer bare text) stays outside. Each page
votes for its candidate's path of tags and classes, with digits generalised; Spark adds the votes per
host, and every page is read again with its host's winning path. What reads like main text in the
page's own candidate but lies outside the winning path is kept beside it, in page order; a page
that lacks the path, or has less than half of its text there, keeps its own candidate.

Blocks are joined by two line feeds in page order; character references are decoded and white space
inside a block becomes one space. Time grows with the length of a page, however deep it is nested.

Cases: null and empty html give an empty text; broken, unclosed and truncated markup is read as far
as it goes; pages without a host are on their own; repeated pages each count and come out; texts
of any length; a host of any number of pages adds up in partial sums; further columns are not read.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.frames import written

SHARE = 0.8
#: Fixed lists of names in HTML and in common class names.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp",
       "noembed", "noframes", "canvas", "object", "audio", "video", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
LEFT_OUT = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "datalist"}
REGIONS = {"html", "body", "div", "section", "article", "main", "td", "center"}
BLOCKS = REGIONS | LEFT_OUT | {
    "address", "blockquote", "caption", "dd", "details", "dl", "dt", "figcaption", "figure", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "ol", "p", "pre", "search",
    "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose text is main text unless it is mostly links.
PROSE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "ul", "ol", "dl", "li", "dt", "dd", "table",
         "pre", "figure", "figcaption", "details"}
#: From this length on a text outside these elements counts as well.
BARE_CHARS = 40
#: An opening tag ends an open element of these names, up to an element that shuts them in.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"})}
NOT_MAIN = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot",
    "banner", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "promoted", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "signin", "nav",
    "navbar", "navigation", "navi", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "header",
    "masthead", "topbar", "footer", "foot", "bottombar", "sidebar", "sidebars", "aside", "rail",
    "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "shares",
    "social", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "pagination",
    "pager", "toolbar", "searchbox", "searchform", "skip", "disclaimer", "legal", "copyright"}
#: Of these, names that a page's contents can decide against.
DOUBTFUL = {"legal", "copyright", "disclaimer", "notice", "notices", "notification", "notifications",
            "alert", "banner", "related", "recommended", "recommendations", "header", "rail", "foot",
            "skip", "reply", "widget", "widgets", "overlay", "promotion", "subscription"}
#: Of the doubtful names those that prose inside an article overrules.
WITHIN = {"legal", "related", "recommended", "recommendations", "rail", "foot", "header", "skip", "reply"}
NOT_MAIN_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog",
                  "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
#: A class of this kind tells how a region is laid out, not what it is.
LAYOUT = {"with", "has", "no", "without", "is", "not"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<plain>[a-zA-Z][^\s/>]*)[^>]*>|</(?P<close>[a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*>"
    r"|</?[a-zA-Z!][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NONE, _MAY_STAY, _DOUBT, _BY_CLASS, _BY_TAG = range(5)


class Page:
    """Blocks and containers of a page.

    A container is (parent, tag, key, left out); a block is (container, text, characters in links).
    """

    def __init__(self, text: str) -> None:
        self.containers: list[tuple[int, str, str, int]] = [(-1, "html", "html", _NONE)]
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]
        #: For each tag name the places of its open elements on the stack.
        self._places: dict[str, list[int]] = {"html": [0]}
        self._parts: list[str] = []
        self._links = 0
        self._in_link = False
        self._read(text)
        self._settle()

    def _close(self, depth: int) -> None:
        """End the open elements from this place of the stack on."""
        while len(self._open) > depth:
            self._places[self.containers[self._open.pop()][1]].pop()

    def _deepest(self, names: set[str]) -> int:
        return max((p[-1] for p in map(self._places.get, names) if p), default=0)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._open[-1], text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = markup.unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if self._in_link:
                self._links += len(text.strip())

    def _read(self, text: str) -> None:
        at = 0
        low = None
        for_more = _TOKEN.search
        while (found := for_more(text, at)) is not None:
            self._text(text[at:found.start()])
            at = found.end()
            tag = found["open"] or found["plain"]
            if tag:
                tag = tag.lower()
                if tag in RAW:
                    if (found["attributes"] or "").rstrip().endswith("/") and tag in ("svg", "math"):
                        continue
                    if low is None:
                        low = text.lower()
                        if len(low) != len(text):
                            # A few capitals grow in lower case; places must stay the same.
                            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                    shut = low.find(f"</{tag}", at)
                    at = len(text) if shut < 0 else shut
                elif tag == "a":
                    self._in_link = True
                elif tag == "br" or tag in ("input", "img"):
                    self._parts.append(" ")
                elif tag in BLOCKS or "-" in tag:
                    self._start(tag, found["attributes"] or "")
            elif found["close"]:
                tag = found["close"].lower()
                if tag == "a":
                    self._in_link = False
                elif tag in BLOCKS or "-" in tag:
                    self._end(tag)
        self._text(text[at:])
        self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        tags = self.containers
        self._in_link = self._in_link and tag not in REGIONS
        # A block ends an open paragraph; list items, cells and rows end their like.
        if tags[self._open[-1]][1] == "p":
            self._close(len(self._open) - 1)
        ends, within = ENDS.get(tag, (set(), set()))
        depth = self._deepest(ends)
        if depth and depth > self._deepest(within):
            self._close(depth)
        if tag in VOID:
            return
        key, out = _describe(tag, attributes)
        if tag == "header":
            out = _NONE if self._deepest({"article", "main"}) else _BY_TAG
        tags.append((self._open[-1], tag, key, out))
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(len(tags) - 1)

    def _end(self, tag: str) -> None:
        self._flush()
        depth = self._deepest({tag})
        if depth:
            self._close(depth)

    def _settle(self) -> None:
        """What is left out: tags and classes hold for all that is inside, doubtful names are weighed."""
        tags = self.containers
        inside = [False] * len(tags)
        sure = [_NONE] * len(tags)
        for c in range(1, len(tags)):
            parent, tag, _, out = tags[c]
            inside[c] = inside[parent] or tag in ("article", "main")
            sure[c] = max(sure[parent], out if out >= _BY_CLASS else _NONE)
        text, links = [0] * len(tags), [0] * len(tags)
        for c, words, linked in self.blocks:
            if sure[c] == _NONE:
                text[c] += len(words)
                links[c] += linked
        for c in range(len(tags) - 1, 0, -1):
            text[tags[c][0]] += text[c]
            links[tags[c][0]] += links[c]
        level = [_NONE] * len(tags)
        for c in range(1, len(tags)):
            parent, tag, key, out = tags[c]
            if out in (_MAY_STAY, _DOUBT):
                prose = 2 * links[c] < text[c]
                stays = prose and (3 * (text[c] - links[c]) >= text[0] - links[0]
                                   or (out == _MAY_STAY and inside[parent]))
                out = _NONE if stays else _BY_CLASS
            level[c] = max(out, level[parent])
        self.containers = [(*t[:3], out) for t, out in zip(tags, level)]
        self._inside = inside

    def path(self, container: int) -> str:
        keys = []
        while container > 0:
            parent, _, key, _ = self.containers[container]
            keys.append(key)
            container = parent
        return "/".join(reversed(keys))

    def on_path(self, path: str) -> set[int]:
        """The containers whose path this is."""
        keys = path.split("/")
        #: Keys of the path that lead to each container; -1 off the path.
        met = [0] * len(self.containers)
        for c in range(1, len(met)):
            parent, _, key, _ = self.containers[c]
            k = met[parent]
            met[c] = k + 1 if 0 <= k < len(keys) and keys[k] == key else -1
        return {c for c, k in enumerate(met) if k == len(keys)}

    def _limit(self) -> int:
        """What leaves a block out: classes count, unless they leave under a quarter of the text and
        no article."""
        held = {_NONE: 0, _BY_CLASS: 0, _BY_TAG: 0}
        for container, text, links in self.blocks:
            out = self.containers[container][3]
            held[out] += len(text) - links
            if out == _NONE and self._inside[container]:
                return _BY_CLASS
        return _BY_CLASS if 3 * held[_NONE] >= held[_BY_CLASS] else _BY_TAG

    def remaining(self) -> list[tuple[int, str, int]]:
        limit = self._limit()
        return [b for b in self.blocks if self.containers[b[0]][3] < limit]

    def _prose(self) -> list[int]:
        """For each container the element of ``PROSE`` around it or itself, -1 if none."""
        found = [-1] * len(self.containers)
        for c in range(1, len(found)):
            parent, tag, *_ = self.containers[c]
            found[c] = c if tag in PROSE else found[parent]
        return found

    def candidate(self) -> int:
        """The container of the page's own main text; 0 if it has none."""
        tags = self.containers
        prose = self._prose()
        held = [0] * len(tags)
        #: Texts below a container that count as main text; and those it holds itself.
        telling, bare = [0] * len(tags), [0] * len(tags)
        for c, text, links in self.remaining():
            held[c] += len(text) - links
            if 2 * links < len(text):
                if prose[c] > 0:
                    telling[tags[prose[c]][0]] += 1
                elif len(text) >= BARE_CHARS:
                    bare[c] += 1
        for c in range(len(tags) - 1, 0, -1):
            held[tags[c][0]] += held[c]
            telling[tags[c][0]] += telling[c]
        best, total = 0, held[0]
        if not total:
            return 0
        inner: dict[int, int] = {}
        for c in range(1, len(tags)):
            parent, tag = tags[c][0], tags[c][1]
            if (tag in REGIONS or "-" in tag) and held[c] >= SHARE * total:
                inner[parent] = c
        while best in inner and tags[best][1] != "article":
            below = inner[best]
            if telling[best] > telling[below] or (bare[best] and tags[best][1] not in ("html", "body")):
                break
            best = below
        return best

    def _within(self, roots: set[int]) -> list[bool]:
        inside = [False] * len(self.containers)
        for c, (parent, *_) in enumerate(self.containers):
            inside[c] = c in roots or (parent >= 0 and inside[parent])
        return inside

    def text_of(self, roots: set[int]) -> list[str]:
        inside = self._within(roots)
        return [text for container, text, _ in self.remaining() if inside[container]]

    def main_text(self, winner: str | None) -> str:
        """Blocks of the containers on the winning path with the page's own, see above."""
        own = self._within({self.candidate()})
        roots = self.on_path(winner) if winner else set()
        theirs = self._within(roots)
        blocks = self.remaining()
        if 2 * sum(len(t) for c, t, _ in blocks if theirs[c]) >= sum(len(t) for c, t, _ in blocks if own[c]):
            prose = self._prose()
            kept = [t for c, t, links in blocks if theirs[c] or (
                own[c] and prose[c] > 0 and 2 * links < len(t))] if roots else []
        else:
            kept = []
        return "\n\n".join(kept or [t for c, t, _ in blocks if own[c]])


def _describe(tag: str, attributes: str) -> tuple[str, int]:
    """The element's part of a path, and whether it is left out."""
    out = _BY_TAG if tag in LEFT_OUT else _NONE
    if not attributes.strip(" /"):
        return tag, out
    found = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        out = _BY_TAG
    if found.get("role", "").lower() in NOT_MAIN_ROLES:
        out = _BY_TAG
    classes = found.get("class", "").split()
    if out == _NONE and tag not in ("html", "body", "main", "article", "header"):
        for name in [*classes, *found.get("id", "").split()]:
            words = [w.lower() for w in _WORD.findall(name)]
            found_in = NOT_MAIN.intersection(words)
            if words and words[0] not in LAYOUT and found_in:
                out = max(out, _BY_CLASS if found_in - DOUBTFUL else
                          _DOUBT if found_in - WITHIN else _MAY_STAY)
    names = sorted({re.sub(r"\d+", "#", c) for c in classes}) or (
        ["#" + re.sub(r"\d+", "#", found["id"])] if found.get("id") else [])
    return ".".join([tag, *names]).replace("/", "_"), out


def host_of(url: str) -> F.Column:
    """The url's host in lower case, without port and www; null if it has none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host`` and ``winner``: the path that most of its pages vote for, the longest text deciding."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, sizes = [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(text.as_py() or "")
                own = page.candidate()
                if own:
                    hosts.append(host)
                    paths.append(page.path(own))
                    sizes.append(sum(map(len, page.text_of({own}))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())],
                ["host", "path", "size"])

    votes = (pages.select(host_of(url).alias("host"), html).where("host IS NOT NULL")
             .mapInArrow(vote, "host string, path string, size long"))
    added = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("size").alias("size"))
    return added.groupBy("host").agg(F.max(F.struct("pages", "size", "path")).alias("best")).select(
        "host", F.col("best.path").alias("winner"))


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    winners = written(host_paths(pages, url, html), "host-paths")
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host_of(url).alias("host"))
    # A few hosts are broadcast by their size on file; otherwise a large host's rows can be split.
    marked = rows.join(winners, "host", "left").select("page_id", "url", "html", "winner")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py() or "").main_text(w)
                     for h, w in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return marked.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
