"""Main text of web pages by template deduction over the pages of a host.

Every page becomes tokens: the path of each element (names, classes and ids from the root down)
and each text with its path. A path is known by a hash of its parent's and its last step, so a page
costs what it is long, however deep it nests. Tokens of a host that occur equally often in each of
its pages have one occurrence vector and form an equivalence class. The vectors are never gathered:
a token keeps the number of its pages, its total and two sums of hashes over (page, count), which
merge in any order, so a host of any size is aggregated before the shuffle. Classes that enough pages
share are valid; they nest by their paths into the host's template. What lies between template
tokens are slots. A slot is dropped for what its template path says (menus, forms, adverts and
the like), for being mostly links, or for holding one text on most pages; the rest is extracted.
Inside an article the template decides: a slot that holds one and the same text wherever the host
has it goes, whatever its name; names and ids are only a reason to drop where the slot bears them out.
A text that most pages repeat in a slot beside other texts may be the article's own: it goes only if
its own words tell of sharing, subscribing and the like.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, spread_join, table, written

#: Pages of a host, and their share, that a valid class needs.
LEAST_PAGES, LEAST_SHARE = 2, 0.05
#: A text outside the article is part of the template from so many pages and such a share on.
TEXT_PAGES, TEXT_SHARE = 4, 0.6
LINK_SHARE = 0.6

# Elements of HTML by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mspace mstyle mpadded mphantom menclose mmultiscripts mprescripts semantics "
    "svg g path circle rect line polygon polyline ellipse use defs text tspan object audio video canvas noscript map area source track embed param input picture".split()
)
#: What is never shown as text. Of these, what may stand inside a line of text does not end it.
UNREAD = set("script style template title head iframe select optgroup option textarea button datalist".split())
UNREAD_INLINE = UNREAD - {"head", "title"}
#: What a head holds; anything else ends it.
OF_HEAD = set("base basefont bgsound link meta title noscript noframes style script template head html".split())
OF_SELECT = set("option optgroup hr script template select".split())
ENDS_NONE = INLINE | VOID
DROPPED = set("nav footer aside form menu dialog fieldset".split())
HOLDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Words of classes, ids and roles of what is no article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social breadcrumb breadcrumbs menu nav navbar navigation sidebar aside rail widget widgets related recommended recommendations trending popular comment comments disqus reply replies respond discussion reviews "
    "footer pagination pager login search skip toolbar copyright legal disclaimer complementary contentinfo hidden "
    "adbox adslot adunit adsense adbanner topnav subnav submenu dropdown responses paywall warning".split()
)
OUTER_MARKS = {"header", "masthead", "topbar", "banner", "tags", "meta"}
#: Marks that as a whole class may also name a part of an article.
TOPICS = set("reviews discussion legal search warning alert notice notices responses popular trending".split())
#: Marks that as one word of a longer class may also name a part of an article.
WEAK = TOPICS | set("share sharing social copyright rail related recommended recommendations respond reply replies comment".split())
#: Words of a repeated line that is no part of the article.
TELLING = set("share subscribe subscription newsletter advertisement advert sponsored cookie cookies follow login unsubscribe".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(1 << 16)
def _says(step: str) -> tuple[bool, bool, bool, bool]:
    """Whether a step is an article or main element, whether it is called so, and whether it is no article inside of one and outside."""
    name, marks = _marks(step)
    frame, plain = name in ("article", "main"), name not in ("html", "body")
    outer = name in DROPPED or plain and not frame and (bool(marks & (MARKS | OUTER_MARKS)) or name == "header")
    return frame, frame or plain and "main" in marks, name in DROPPED, outer


class Node:
    """An element's path: its last step and the path before it."""

    __slots__ = ("step", "parent", "key", "depth", "inside", "framed", "dropped", "steps", "count", "chars", "links")

    def __init__(self, step: str, parent: Node | None):
        self.step, self.parent = step, parent
        self.key = xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), parent.key & _MASK) - (1 << 63) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        frame, main, inner, outer = _says(step)
        framed = parent is not None and parent.framed  # below an article or main element
        self.dropped = parent is not None and (parent.dropped or (inner if framed else outer))
        self.framed = framed or frame
        self.inside = parent is not None and parent.inside or main
        self.steps: dict[str, Node] = {}
        self.count = self.chars = self.links = 0


_MASK = (1 << 64) - 1


def _step(tag: str, attrs) -> str:
    """An element's name, classes, roles and ids."""
    values = dict(attrs)
    said = values.get("class") or "", values.get("role") or "", "hidden" in values, values.get("id") or ""
    return (_named if len(said[0]) + len(said[1]) + len(said[3]) <= 256 else _named.__wrapped__)(tag, *said)  # long ones are not kept


@lru_cache(1 << 16)
def _named(tag: str, classes: str, role: str, hidden: bool, ids: str) -> str:
    names = {*classes.split(), *role.split(), *(["hidden"] if hidden else [])}
    plain = lambda m: re.sub("[./#]", "-", m)
    marks = [plain(m) for m in sorted(names)] + [f"#{plain(m)}" for m in sorted({*ids.split()})]
    return tag + "".join(f".{m}" for m in marks)


class _Page(HTMLParser):
    """Blocks (node, text, characters in links) and element paths of one page."""

    RCDATA_CONTENT_ELEMENTS = ()  # a title or text field that never closes ends with the next block

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", None)
        self.root.count = 1
        self.nodes = [self.root]
        self.stack: list[tuple[str, Node]] = []
        self.inline = 0  # open links
        self.blocks: list[tuple[Node, str, int]] = []
        self.parts: list[str] = []
        self.links = 0
        self.unread = 0
        self.open: dict[str, int] = {}  # how many of each name are open

    def node(self) -> Node:
        return self.stack[-1][1] if self.stack else self.root

    def flush(self) -> None:
        if not self.parts:
            self.links = 0
            return
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.stack[-1][1] if self.stack and self.stack[-1][0] not in UNREAD else next((n for name, n in reversed(self.stack) if name not in UNREAD), self.root)
            links = min(self.links, len(text))
            self.blocks.append((at, text, links))
            at.chars += len(text)
            at.links += links
        self.parts, self.links = [], 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def drop(self, at: int) -> None:
        if self.stack[at][0] not in UNREAD_INLINE or any(name not in UNREAD_INLINE for name, _ in self.stack[at:]):
            self.flush()
            self.inline = 0
        for name, _ in self.stack[at:]:
            self.unread -= name in UNREAD
            self.open[name] -= 1
        del self.stack[at:]

    def last(self, name: str) -> int:
        at = len(self.stack) - 1
        while self.stack[at][0] != name:
            at -= 1
        return at

    def implied(self, tag: str) -> None:
        """Ends what a start tag ends."""
        is_open = self.open.get
        if is_open("title") and tag != "title":
            self.drop(self.last("title"))
        if is_open("head") and tag not in OF_HEAD:
            self.drop(self.last("head"))
        if tag not in ENDS_NONE:
            if is_open("select") and tag not in OF_SELECT:
                self.drop(self.last("select"))
            if is_open("textarea"):
                self.drop(self.last("textarea"))

    def handle_starttag(self, tag: str, attrs) -> None:
        self.implied(tag)
        if tag == "br":
            self.parts.append(" ")
        if tag in INLINE:
            self.inline += tag == "a"
            return
        shown = tag not in UNREAD_INLINE
        if shown:
            self.flush()
            if tag not in VOID and (self.open.get("p") or tag in HOLDS and any(self.open.get(x) for x in HOLDS[tag])):
                for i in range(len(self.stack) - 1, -1, -1):
                    name = self.stack[i][0]
                    if name == "p" or name in HOLDS.get(tag, ()):
                        self.drop(i)
                        break
                    if name in BOUNDS.get(tag, ()) or tag not in HOLDS:
                        break
        elif tag in ("option", "optgroup") and self.stack and self.stack[-1][0] == "option":
            self.drop(len(self.stack) - 1)
        step, around = _step(tag, attrs) if attrs else tag, self.node()
        node = around.steps.get(step)
        if node is None:
            node = around.steps[step] = Node(step, around)
            self.nodes.append(node)
        node.count += 1
        if tag not in VOID:
            self.stack.append((tag, node))
            self.unread += tag in UNREAD
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in ENDS_NONE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.inline = max(0, self.inline - (tag == "a"))
        elif self.open.get(tag):
            self.drop(self.last(tag))
        elif tag not in UNREAD_INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.open.get("head") and self.stack[-1][0] == "head" and data.strip():
            self.drop(self.last("head"))
        if not self.unread:
            self.parts.append(data)
            if self.inline:
                self.links += len(data.strip())


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return page


def _marks(step: str) -> tuple[str, set[str]]:
    name, *marks = step.split(".")
    return name, {w for m in marks for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m).lower()) if w}


@lru_cache(1 << 16)
def suspicion(step: str) -> int:
    """What the classes, roles and ids of a step inside an article say: 3 no article, 2 none if the template repeats the slot, 1 none if the slot's texts are fixed or links, 0 nothing."""
    tag, *marks = step.split(".")
    most = 0
    for m in marks:
        of_id = m.startswith("#")
        if of_id and tag in HEADINGS or tag in ("article", "main"):
            continue
        whole, words = re.sub(r"[^a-z]+", "", m.lower()), _marks(f"x.{m}")[1]
        if whole in MARKS - TOPICS:
            most = 3
        elif words & MARKS - WEAK and not of_id:
            most = max(most, 2)
        elif words & MARKS:
            most = max(most, 1)
    return most


class Template:
    """The valid classes of a host and what they say about slots."""

    def __init__(self, pages: int, classes):
        self.slots, self.texts = {}, set()
        self.decided: dict[int, bool] = {}
        self.repeated: set[int] = set()  # paths on most pages
        self.fixed: set[int] = set()  # of these, inside an article: those whose slot never holds a second text
        parents: dict[int, int | None] = {}
        sole: dict[int, int] = {}  # characters of the most common text of a slot
        common = 0  # characters inside articles that are in texts of most pages
        inside: dict[int, int] = {}
        by_depth = []
        for c in classes or []:
            often = c["pages"] >= TEXT_PAGES and c["pages"] >= TEXT_SHARE * pages
            for t in c["tokens"]:
                key = t["path"]
                if t["text"] is None:
                    self.slots[key] = (t["chars"], t["links"])
                    parents[key] = t["parent"]
                    by_depth.append((-t["depth"], key))
                    if t["inside"] and t["chars"]:
                        inside[key] = t["chars"]
                    if often:
                        self.repeated.add(key)
                elif often:
                    self.texts.add((key, t["text"]))
                    if t["inside"]:
                        sole[key] = max(sole.get(key, 0), t["chars"])
                        common += t["chars"]
        varying = {p: chars - sole.get(p, 0) for p, chars in inside.items()}
        # where nothing varies, as on a host of copies, nothing tells a template from an article
        if sum(inside.values()) > common:
            self.fixed = {p for p, rest in varying.items() if not rest and p in self.repeated}
        self.open: set[int] = set()  # paths at or below which something varies
        for p in varying.keys() - self.fixed:
            while p is not None and p not in self.open:
                self.open.add(p)
                p = parents.get(p)
        self.under = dict(self.slots)  # characters of the slots at and below a path, and of those in links
        for _, p in sorted(by_depth):
            if (up := parents[p]) in self.under:
                self.under[up] = tuple(x + y for x, y in zip(self.under[up], self.under[p], strict=True))

    def _says_no(self, node: Node) -> bool:
        """Whether a step inside an article is a reason to drop what it holds."""
        level, known = suspicion(node.step), node.key in self.repeated
        if level == 3 or level == 2 and known:
            return True
        chars, links = self.under.get(node.key, (0, 0))
        return bool(level and known and chars and (node.key not in self.open or links > LINK_SHARE * chars))

    def inner_drop(self, node: Node) -> bool:
        """Whether the template drops a block inside an article."""
        chain, at = [], node
        while at is not None and at.inside and at.key not in self.decided:
            chain.append(at)
            at = at.parent
        no = at is not None and at.inside and self.decided[at.key]
        for n in reversed(chain):
            no = self.decided[n.key] = no or self._says_no(n)
        if no or node.key not in self.fixed:
            return no
        # a fixed heading goes only with all that it heads
        around = node.parent
        return node.step.split(".")[0] not in HEADINGS or around.inside and around.parent.inside and around.key not in self.open

    def keeps(self, node: Node, text: str) -> bool:
        repeated = (node.key, _text_key(text)) in self.texts
        if node.inside:
            return not (node.dropped or self.inner_drop(node) or repeated and set(re.findall(r"[^\W\d_]+", text.lower())) & TELLING)
        at = node
        while at is not None and at.key not in self.slots:  # the deepest template path around; a path in no class is its own
            at = at.parent
        chars, links = self.slots.get((at if at is not None and at.parent is not None else node).key, (0, 0))
        return not (node.dropped or chars > 0 and links > LINK_SHARE * chars or repeated)


def _text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


TOKEN = "struct<path:bigint,parent:bigint,step:string,depth:int,inside:boolean,text:bigint,count:bigint,chars:bigint,links:bigint>"


def _tokens(htmls):
    tokens = []
    for html in htmls:
        page = parsed(html)
        texts: dict[tuple[int, int], list] = {}
        for node, text, _ in page.blocks:
            texts.setdefault((node.key, _text_key(text)), [node, len(text), 0])[2] += 1
        up = lambda n: n.parent.key if n.parent else None
        tokens.append(
            [(n.key, up(n), n.step, n.depth, n.inside, None, n.count, n.chars, n.links) for n in page.nodes]
            + [(n.key, up(n), None, n.depth, n.inside, t, times, size * times, 0) for (_, t), (n, size, times) in texts.items()]
        )
    return [tokens]


def extracted(page: _Page, template: Template) -> str:
    """The blocks that a template leaves: of the article if there is one, else of the whole page."""
    kept = [t for n, t, _ in page.blocks if n.inside and template.keeps(n, t)]
    if not kept:
        kept = [t for n, t, links in page.blocks if template.keeps(n, t) and links <= LINK_SHARE * len(t)]
    return "\n".join(kept)


def _extract(hosts, pages, classes, htmls):
    known: dict = {}
    out = []
    for host, n, c, html in zip(hosts, pages, classes, htmls, strict=True):
        if host not in known:
            known[host] = Template(n or 0, c)
        out.append(extracted(parsed(html), known[host]))
    return [out]


def templates(tokens: DataFrame) -> DataFrame:
    """host, pages, classes: the valid equivalence classes of each host, of tokens (host, page and the fields of TOKEN)."""
    seen = F.xxhash64("page", "count")
    merged = written(tokens.groupBy("host", "path", "text").agg(
        F.count("*").alias("pages"), F.sum("count").alias("total"), F.sum(seen.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v1"), F.sum(F.shiftrightunsigned(seen, 33)).alias("v2"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), *[F.max(n).alias(n) for n in ("parent", "step", "depth", "inside")])
        .where((F.col("pages") >= LEAST_PAGES) | ((F.col("path") == 0) & F.col("text").isNull())), "tokens")
    sizes = written(merged.where("path = 0 AND text IS NULL").select("host", F.col("pages").alias("all")), "sizes")
    often = merged.where(F.col("pages") >= LEAST_PAGES)
    valid = spread_join(often, sizes, "host", often.groupBy("host").agg(F.count("*").alias("n"))).where(F.col("pages") >= F.col("all") * LEAST_SHARE)
    token = F.struct("path", "parent", "step", "depth", "inside", "text", "chars", "links")
    classes = valid.groupBy("host", "all", "pages", "total", "v1", "v2").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    return classes.groupBy("host").agg(F.max("all").alias("pages"), F.sort_array(F.collect_list(F.struct("pages", "total", "tokens"))).alias("classes"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html gives an empty text. A null url, or one without host, counts as the host ''.
    Repeated rows are pages of their own. Text inside of an article or main element is preferred;
    of pages without such, all slots count that are not dropped. Elements may nest as deep as a page
    is long. A head, title, text field or list of options that never closes ends with the next
    block, other markup at the end. No rows give no rows. Other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    tokens = mapped(rows, ["host", "page_id", "url"], ["html"], {"tokens": f"array<{TOKEN}>"}, _tokens)
    tokens = tokens.select("host", F.xxhash64("page_id", "url").alias("page"), F.explode("tokens").alias("t")).select("host", "page", "t.*")
    found = written(templates(tokens), "templates")
    sizes = written(rows.groupBy("host").agg(F.count("*").alias("n")), "sizes")
    joined = spread_join(rows, found, "host", sizes)
    out = mapped(joined, ["page_id", "url"], ["host", "pages", "classes", "html"], {"text": "string"}, _extract)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table."""
    return main_texts(table(spark, sf_dir, "pages"))


#: The articles of these pages by string functions: they all have one article element and few named references.
OP3_SQL = r"""
WITH cut AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(
    string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h1|h2|h3|ul|ol|li|div|section|blockquote)( [^>]*)?>', chr(1), 'g'), '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)),
    lambda b: trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM cut),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
