"""Main text of raw web pages by tree scoring."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from peakpool.llm.common import parts, table

#: What may begin at a "<": a comment, a declaration, or a tag's name.
NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*+)")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|\b(hidden)\b", re.I)
#: Elements whose content is no text of the page; the first ones swallow the rest of a page if they aren't closed.
SWALLOWING = frozenset("script style noscript textarea iframe title".split())
RAW = SWALLOWING | frozenset("template svg object math".split())
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks whose points go to their parent first; other blocks are containers themselves.
PARAGRAPH = frozenset("p li h1 h2 h3 h4 h5 h6 td th dd dt pre blockquote figcaption caption summary center address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is never part of an article, and what isn't unless the page has no other prose.
DROPPED = frozenset("head button select option label dialog menu input audio video canvas title datalist".split())
SUSPECT = frozenset("nav footer aside form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of a class or id that mark what isn't part of an article, and names that say the contrary or something else.
BAD = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|sidebar|side-bar|navbar|navigation|nav|menu|breadcrumbs?|footer|site-?header|page-?header|masthead|topbar|cookies?|consent|gdpr|notices?|popup|modal|overlay"
    r"|newsletter|subscri\w+|share|sharing|social|comments?|commentlist|comment-?\w*|disqus|repl(?:y|ies)|respond|related|recommend\w*|widget|login|signup|search|pagination|pager|toolbar|skip-?link|alert)(?![a-z])",
    re.I,
)
NOT_BAD = re.compile(r"(?:no|not|non|has|have|with|without|hide|is)[-_]|.*[-_](?:free|less|none|off|hidden|enabled|disabled|open|closed|wrap|wrapper|layout|page)$", re.I)
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|story|text|blog", re.I)
KEPT = frozenset("html body article main".split())
#: Open elements that a start tag of the key closes, and where the search for them ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}
#: Elements that an open paragraph outside isn't closed through, elements that hold back most end tags, and end tags they don't.
P_WALLS = ("table", "td", "th", "button", "object")
WALLS = ("article", "main", "body", "td", "table")
STRONG = frozenset("table tr tbody section div ul ol nav aside header footer form".split()) | KEPT
#: A page's largest suspect part is taken for its article if it has so many characters of prose and less than that and less
#: than this share of the page is outside of suspect parts.
LEAST_PROSE, LEAST_SHARE = 200, 0.05


class Node:
    __slots__ = ("tag", "up", "depth", "drop", "suspect", "within", "name", "home", "score", "passed", "chars", "linked", "prose", "shown")

    def __init__(self, tag: str, up: Node | None, drop: bool, suspect: bool, name: str):
        self.tag, self.up, self.drop, self.suspect, self.name = tag, up, drop, suspect, name
        self.depth = up.depth + 1 if up else 0
        self.within = tag in ("article", "main") or up is not None and up.within
        self.home = self if tag in BLOCK or up is None else up.home
        self.score = self.passed = 0.0
        self.chars = self.linked = self.prose = 0
        self.shown = True


def suspicious(name: str) -> bool:
    """Whether some word of a class or id marks what isn't part of an article."""
    return any(BAD.search(w) and not NOT_BAD.match(w) for w in name.split())


class Scanner:
    """Tags, comments and raw elements of a page, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.plain, self.unclosed = False, set()

    def tag_end(self, i: int) -> int:
        """The place of the ">" that ends a tag, quoted ones aside; -1 if there is none. If a quote swallows the rest of the
        page, quotes are taken for ordinary characters from there on."""
        if i > self.last[">"]:
            return -1
        at = i
        while not self.plain:
            m = QUOTE_OR_END.search(self.page, at)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.start()
            else:
                at = self.page.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        return self.page.find(">", i)

    def tokens(self):
        """(text before, closing, tag, attributes) of each tag; tag None for the text at the end, "" for what is left out."""
        page, text_from, at = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                yield page[text_from:at], False, "", ""
                text_from = at = len(page) if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at) if at < self.last[">"] else -1
                if end < 0:
                    break
                yield page[text_from:at], False, "", ""
                text_from = at = end + 1
                continue
            m = NAME.match(page, at + 1)
            end = self.tag_end(m.end()) if m else -1
            if end < 0:
                at += 1
                continue
            tag, attrs = m[2].lower(), page[m.end() : end]
            yield page[text_from:at], bool(m[1]), "" if tag in RAW and not m[1] else tag, attrs
            text_from = at = end + 1
            if tag in RAW and not m[1] and not attrs.endswith("/") and tag not in self.unclosed:
                done = RAW_END[tag].search(page, at)
                if done:
                    text_from = at = done.end()
                elif tag in SWALLOWING:
                    text_from = at = len(page)
                else:
                    self.unclosed.add(tag)
        yield page[text_from:], False, None, ""


class Parser:
    def __init__(self, page: str):
        self.at = self.root = Node("html", None, False, False, "")
        self.nodes = [self.root]
        self.open: dict[str, list[Node]] = {}
        #: Blocks in page order: (node, text, characters in links).
        self.blocks: list[tuple[Node, str, int]] = []
        self.pieces: list[str] = []
        self.linked, self.links, self.home = 0, 0, self.root
        for before, closing, tag, attrs in Scanner(page).tokens():
            if before:
                self.text(before)
            if tag == "":
                self.gap()
            elif tag is not None and closing:
                self.end(tag)
            elif tag is not None:
                self.start(tag, attrs)
        self.flush()

    def gap(self) -> None:
        if self.pieces:
            self.pieces.append(" ")

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.home, text, min(self.linked, len(text))))
            self.pieces.clear()
        self.linked = 0

    def text(self, raw: str) -> None:
        if not self.at.drop:
            t = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(t)
            if self.links:
                self.linked += len(" ".join(t.split()))

    def close(self, to: Node) -> None:
        """Closes all up to and including `to`."""
        while True:
            done, self.at = self.at, self.at.up
            self.open[done.tag].pop()
            if done.tag == "a":
                self.links -= 1
            if done.tag in BLOCK:
                self.flush()
                self.home = self.at.home
            if done is to:
                return

    def deepest(self, tags) -> Node | None:
        """The innermost open element of some tags."""
        best = None
        for t in tags:
            found = self.open.get(t)
            if found and (best is None or found[-1].depth > best.depth):
                best = found[-1]
        return best

    def reach(self, tags, walls) -> Node | None:
        """The innermost open element of some tags, if no wall stands within it."""
        node = self.deepest(tags)
        if node is not None and node is not self.at:
            wall = self.deepest(walls)
            if wall is not None and wall.depth > node.depth:
                return None
        return node

    def end(self, tag: str) -> None:
        node = self.reach((tag,), () if tag in STRONG else WALLS)
        if node is not None:
            self.close(node)

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            while self.at.drop and self.at.up:
                self.close(self.at)
            if tag == "html" or self.open.get("body"):
                return
        if tag in BLOCK:
            if (p := self.reach(("p",), P_WALLS)) is not None:
                self.close(p)
            if tag in CLOSES and (old := self.reach(CLOSES[tag], SCOPE[tag])) is not None:
                self.close(old)
        up = self.at
        name, drop, suspect = "", up.drop or tag in DROPPED, tag in SUSPECT
        if not drop and attrs and tag not in KEPT:
            for key, value, hidden in ATTR.findall(attrs):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    name += " " + value
                elif key == "role" and value.lower() in ROLES:
                    suspect = True
                elif hidden or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    drop = True
            suspect = suspect or bool(name) and tag not in HEADING and suspicious(name)
        if tag == "header":
            suspect = suspect or not up.within
        if tag in BLOCK:
            self.flush()
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            if tag in ("br", "hr", "img"):
                self.gap()
            return
        self.at = Node(tag, up, drop, suspect, name)
        self.nodes.append(self.at)
        self.open.setdefault(tag, []).append(self.at)
        if tag == "a":
            self.links += 1
        if tag in BLOCK:
            self.home = self.at


def hide_suspects(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Sets `shown`: what lies in a suspect element isn't, unless next to nothing of the page's text is outside of them all;
    then the suspect element with the most prose, if it has some, is taken for the article, and so on within it."""
    for node, text, linked in blocks:
        node.chars += len(text)
        if len(text) >= 25:
            node.prose += len(text) - linked
    for n in reversed(nodes[1:]):
        n.up.prose += n.prose
        n.up.chars += n.chars
    whole = nodes[0].chars
    for _ in range(8):
        left, outer, article = whole, [], False
        for n in nodes:
            n.shown = not n.suspect and (n.up is None or n.up.shown)
            if n.shown:
                article = article or n.tag == "article" and n.chars > 0
            elif n.up is None or n.up.shown:
                outer.append(n)
                left -= n.chars
        most = max(outer, key=lambda n: n.prose, default=None)
        if most is None or article or most.prose < LEAST_PROSE or left >= min(LEAST_PROSE, LEAST_SHARE * whole):
            break
        most.suspect = False
    for n in nodes:
        n.chars = 0


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two newlines; empty if there is none.

    Each block of text passes points for its length and commas to its container, half of them to the next one, and from there a
    third of what came to each further one, all discounted by the share of its text in links. The container with the most
    points, discounted by its own link density, is the article; where it stands in an <article>, that element is. Siblings with
    a fifth of its points are kept as well. Elements whose tag, role, class or id says that they aren't part of an article are
    left out, unless next to no prose were left then. Time and memory are linear in the page.
    """
    parser = Parser(page or "")
    nodes = parser.nodes
    hide_suspects(nodes, parser.blocks)
    blocks = [b for b in parser.blocks if b[0].shown]
    if not blocks:
        return ""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        up = node.up if node.tag in PARAGRAPH and node.up is not None else node
        up.score += ((len(text) >= 25) + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
    for n in reversed(nodes[1:]):  # children come after their parents; score: own points, passed: what came from below
        n.up.chars += n.chars
        n.up.linked += n.linked
        n.up.passed += n.score / 2 + n.passed / 3
    for n in nodes:
        n.score += n.passed
        if n.tag not in PARAGRAPH:
            n.score += (25 if n.tag in ("article", "main") else 5 if n.tag in ("div", "section") else 0) + (10 if n.name and GOOD.search(n.name) else 0)
        n.score *= 1 - n.linked / max(1, n.chars)
    held = [n for n in nodes if n.chars and n.shown]
    best = max((n for n in held if n.tag not in PARAGRAPH), key=lambda n: (n.score, n.depth), default=blocks[0][0])
    top = best
    while top is not None and top.tag != "article":
        top = top.up
    top = top or best
    least = max(5.0, best.score / 5)
    keep = {id(top)}
    if top.up is not None:
        keep |= {id(n) for n in held if n.up is top.up and n.tag not in ("html", "body") and (n.score >= least or n.tag in HEADING or n.tag == "p" and n.linked < 0.25 * n.chars)}
    for n in nodes:
        n.suspect = id(n) in keep or n.up is not None and n.up.suspect  # now: kept
    return "\n\n".join(text for node, text, _ in blocks if node.suspect)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages: the main text of the whole html and its code points.

    Null and empty html give an empty text; a null url or id is kept; repeated rows are treated alike; an empty table gives no
    rows; unclosed or broken markup is read as browsers would, without failing, in time linear in the page. Other columns are
    not read. One pass.
    """

    def run(batches):
        for b in parts(batches, 2):
            out = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")


def op8_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
