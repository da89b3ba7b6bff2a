"""Main text of web pages by tag-path ratios.

Every text block hangs on a root-to-leaf path of block tags. Per path of one
page: text length and punctuation over the number of blocks, smoothed along
the page, fused by product, less the share of text in links. Paths whose fused
ratio reaches the threshold mark content; their containers' blocks, without
link lists, are the main text. <article> and <main> only add weight. Paths
through menus, headers, footers, sidebars, notices, adverts, forms and comments
get no ratio, unless the element that is named so wraps the story.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|title|object|canvas|math)\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|[^<]+|<", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")

# Tags by their role.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside button menu head dialog search".split())
FORM_TAGS = frozenset(("form", "fieldset"))  # some pages are one form
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended share sharing social "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies reply pagination pager copyright legal disclaimer skip "
    "toolbar alert masthead topbar".split())
# words that sections of an article are named by as well, and words that add no meaning to a name
TOPIC_WORDS = frozenset("legal social notice notices alert disclaimer copyright promotion related consent".split())
TALK_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
FILL_WORDS = frozenset(
    "area bar block blog body bottom box button buttons col column container content div first form global group header "
    "holder icon icons inner item items left link links list main outer page panel post primary right row secondary "
    "section site slot text title top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"),
            "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
          "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟¿¡]")
SHARE = 0.2     # of the best fused ratio that a path must reach
ARTICLE_WEIGHT, MARKED_WEIGHT = 1.5, 0.5


class _Path:
    """A path of element names from the root. Equal paths are one object, which
    knows its parent and depth and the path of the ``article`` around it, so that
    deep pages need no more memory than they have elements."""
    __slots__ = ("parent", "tag", "depth", "story", "below")

    def __init__(self, parent, tag):
        self.parent, self.tag, self.below = parent, tag, {}
        self.depth = parent.depth + 1 if parent else 0
        self.story = self if tag == "article" else parent.story if parent else None

    def child(self, tag: str, name: str) -> "_Path":
        path = self.below.get((tag, name))
        if path is None:
            path = self.below[tag, name] = _Path(self, tag)
        return path

    def up_to(self, depth: int) -> "_Path":
        path = self
        while path.depth > depth:
            path = path.parent
        return path


class _Node:
    __slots__ = ("tag", "path", "boiler", "article", "suspect")

    def __init__(self, tag, path, boiler, article, suspect):
        self.tag, self.path, self.boiler, self.article, self.suspect = tag, path, boiler, article, suspect


class _Suspect:
    """An element that its tag, class or id may mark as boilerplate, with the
    text and the story tags of its subtree."""
    __slots__ = ("parent", "depth", "sure", "talk", "chars", "story", "final")

    def __init__(self, parent, depth, sure, talk):
        self.parent, self.depth, self.sure, self.talk = parent, depth, sure, talk
        self.chars, self.story, self.final = 0, False, False


class _Block:
    __slots__ = ("path", "boiler", "article", "suspect", "marked", "linked", "text")

    def __init__(self, node, linked, text):
        self.path, self.boiler, self.article, self.suspect = node.path, node.boiler, node.article, node.suspect
        self.marked, self.linked, self.text = 0, linked, text


def _names_boiler(value: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """(any, sure, talk) of a class or id: whether any word is one of
    boilerplate; whether one name has only such and filling words, not all of
    them topics; whether that is about comments."""
    some = sure = talk = False
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        hits = {w for w in words if w in BOILER_WORDS or w == "header" and not inside_article}
        if hits:
            some = True
            if not hits <= TOPIC_WORDS and all(w in hits or w in FILL_WORDS for w in words):
                sure, talk = True, talk or not hits.isdisjoint(TALK_WORDS)
    return some, sure, talk


def _is_boiler(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool, bool, str]:
    """Whether the element is boilerplate by itself; whether, how surely and
    whether as comments its name marks it; and its class or id as a name."""
    name, boiler = "", tag in BOILER_TAGS or tag == "header" and not inside_article
    some = sure = tag in FORM_TAGS
    talk = False
    for key, a, b, c, flag in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), a or b or c
        if flag or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            boiler = True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            boiler = True
        elif key == "role" and value.lower() in BOILER_ROLES:
            boiler = True
        elif key == "role" and value.lower() == "form":
            some = sure = True
        elif key in ("class", "id"):
            name = name or value
            if tag not in ("html", "body", "main", "h1"):
                marks = _names_boiler(value, inside_article)
                some, sure, talk = some or marks[0], sure or marks[1], talk or marks[2]
    return boiler, some, sure, talk, name


def _settle(blocks: list[_Block], suspects: list[_Suspect], outside: set[str]) -> None:
    """Marked elements are boilerplate if the mark is sure and they hold
    neither the story tags nor, on a page without article and main outside of
    them, half of the text; other marks only lower the ratio. For comments an
    h1 outside is enough, however long they are."""
    story = outside & {"article", "main"}
    total = 0
    for b in blocks:
        if not b.boiler:
            total += len(b.text)
            if b.suspect:
                b.suspect.chars += len(b.text)
    for s in reversed(suspects):  # inner ones first
        if s.parent:
            s.parent.chars += s.chars
            s.parent.story |= s.story
    for s in suspects:  # outer ones first
        wrapper = s.story or not story and 2 * s.chars >= total and not (s.talk and outside)
        s.final = bool(s.parent and s.parent.final) or s.sure and not wrapper
        s.depth = 0 if wrapper else s.depth
        if s.parent and not s.depth:
            s.depth = s.parent.depth
    for b in blocks:
        if b.suspect and not b.boiler:
            b.boiler, b.marked = b.suspect.final, b.suspect.depth


def blocks_of(page: str) -> list[_Block]:
    """Every non-empty text block in page order. Inline tags do not end a block."""
    root = _Node("", _Path(None, ""), False, False, None)
    opened = Counter()  # elements of each tag on the stack
    stack, out, parts = [root], [], []
    suspects, outside = [], set()  # marked elements, story tags outside of them
    link, linked = 0, 0  # depth of the stack where a link was opened, characters in links

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(_Block(stack[-1], linked, text))
        linked = 0

    def pop_to(tags, limits) -> bool:
        if not any(opened[t] for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return True
            if stack[i].tag in limits:
                return False
        return False

    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            parts.append(token)
            if link:
                linked += len(token)
            continue
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if m[1] or not tag:  # comments, declarations and elements without page text
            if token.startswith("<![CDATA[") or m[1] and m[1].lower() not in ("noscript",):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "a":
                link = len(stack) if not closing and "href" in attributes.lower() else 0
            elif tag == "br" or tag in ("img", "input"):
                parts.append(" ")
            continue
        flush()
        if closing:
            pop_to((tag,), ())
            link = link if len(stack) >= link else 0
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            opened[stack.pop().tag] -= 1
        if tag in SIBLINGS:
            while pop_to(SIBLINGS[tag], LIMITS[tag]):
                pass
        if tag in VOID:
            continue
        top = stack[-1]
        link = link if len(stack) >= link else 0
        boiler, some, sure, talk, name = _is_boiler(tag, attributes or "", top.article)
        path, suspect = top.path.child(tag, name), top.suspect
        if tag in ("main", "h1") or tag == "article" and not sure:
            if suspect and not (boiler or top.boiler):
                suspect.story = True
            if not (suspect or boiler or top.boiler):
                outside.add(tag)
        if some and tag != "article":
            suspect = _Suspect(suspect, path.depth, sure, talk)
            suspects.append(suspect)
        opened[tag] += 1
        stack.append(_Node(tag, path, top.boiler or boiler, top.article or tag in ("article", "main"), suspect))
    flush()
    _settle(out, suspects, outside)
    return out


def select(blocks: list[_Block]) -> list[str]:
    """Texts of the content blocks by smoothed and fused path ratios."""
    live = [b for b in blocks if not b.boiler]
    if not live:
        return []
    sums: dict[_Path, list[float]] = {}  # text, punctuation, blocks, text in links, weights
    for b in live:
        own = sums.setdefault(b.path, [0, 0, 0, 0, 0.0])
        own[0] += len(b.text)
        own[1] += len(PUNCTUATION.findall(b.text))
        own[2] += 1
        own[3] += min(b.linked, len(b.text))
        own[4] += (ARTICLE_WEIGHT if b.article else 1) * (MARKED_WEIGHT if b.marked else 1)
    paths = list(sums)  # in page order
    text_ratio = [sums[p][0] / sums[p][2] for p in paths]
    mark_ratio = [(sums[p][1] + 0.5) / sums[p][2] for p in paths]

    def smooth(v):
        return [0.25 * v[max(i - 1, 0)] + 0.5 * v[i] + 0.25 * v[min(i + 1, len(v) - 1)] for i in range(len(v))]

    fused = dict(zip(paths, (a * b for a, b in zip(smooth(text_ratio), smooth(mark_ratio)))))
    # text in links is no prose; article and main add weight, marked names take some
    for p in paths:
        own = sums[p]
        fused[p] *= (1 - own[3] / own[0]) * own[4] / own[2]
    best = max(fused.values())
    chosen = {p for p in paths if fused[p] >= SHARE * best}
    linked = {p for p in paths if 2 * sums[p][3] > sums[p][0] and p.tag not in HEADINGS}
    containers = {p.parent if p.tag in ("p", "li", "pre", "blockquote") else p for p in chosen if p.tag not in HEADINGS}
    # a list of links belongs to the article around it whose chosen prose is longer than all of its links
    prose, links = Counter(), Counter()
    for p in paths:
        if p.story and p in chosen and p not in linked and p.tag not in HEADINGS:
            prose[p.story] += sums[p][0]
        if p.story:
            links[p.story] += sums[p][3]
    stories = {p for p in prose if prose[p] > links[p]}
    nearest: dict[_Path, int] = {}  # depth of the innermost container but html and body, 0: none

    def container_depth(path: _Path) -> int:
        way = []
        while path not in nearest and path.depth:
            if path in containers and path.tag not in ("body", "html"):
                nearest[path] = path.depth
            else:
                way.append(path)
                path = path.parent
        depth = nearest.get(path, 0)
        nearest.update(dict.fromkeys(way, depth))
        return depth

    def wanted(path, marked) -> bool:
        if path in chosen:
            return True
        if path in linked and path.story not in stories:
            return False
        # a marked part of a container must be chosen itself
        if container_depth(path) >= max(marked, 1):
            return True
        page_wide = [c for c in (path, path.parent) if c and c in containers and c.depth >= marked]
        return bool(page_wide) and path.depth > 0 and path.tag != "div"

    keep, below = [], None
    for b in reversed(live):  # a heading stays with the kept block that it heads
        heads = b.path.tag in HEADINGS and below is not None and b.path.parent is below.up_to(b.path.depth - 1)
        keep.append(heads or wanted(b.path, b.marked))
        if b.path.tag not in HEADINGS or keep[-1]:
            below = b.path if keep[-1] else None
    return [b.text for b, kept in zip(live, reversed(keep)) if kept]


def main_text(page: str | None) -> str:
    return "\n".join(select(blocks_of(page))) if page else ""


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row (repeated rows give repeated results; null ids and
    urls stay null; null or empty html has the empty text; an empty table gives
    no rows; other columns are ignored). Each page is read whole, in one narrow
    pass."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
