"""Main text of web pages by consensus host paths.

First each page's containers are scored: a container is an element that is not boilerplate; its score is
the text of the blocks below it, less text in links, a little of it lost with each step up so that the
innermost holder of the article wins over the body. Parts of a container are not containers themselves,
and their text counts as its own: anything below an article; lists, tables, sections and what they hold
below a main; elsewhere lists and tables with headings. The path of a container is generalised to tags and
classes without digits, and known by a hash. In Spark the paths of all pages of a host vote with their
scores. Then each page is extracted again from the elements on the host's winning path; a page that lacks
the path uses its own best container.

Boilerplate are elements by tag, role or the attributes ``hidden`` and ``aria-hidden``. Everything else is suspected
only, and decided once the page is read:

- a class or id of words for boilerplate and neutral ones only ("ad", "site-footer", "right-sidebar"), a form, and
  ``display:none`` in a style: dropped, unless it holds a main or most of the text that nothing is suspected of (text
  in an article counts more). So a layout wrapper named like a sidebar, or a form around the whole page, stays;
- words for readers' comments, related pages and the like among these ("comments", "related-posts"): dropped
  unless it holds a main;
- other words among them ("related-work", "acme-sidebar"): dropped by the share of its text in links.

A heading of the first level is never suspected by name; other headings and paragraphs by words for adverts
and the like only, since "page-header" or "related" there says how they look.

Parsing is one pass of a tokenising regex with an explicit stack: unclosed paragraphs, cut-off pages
and stray end tags are tolerated. Elements point to their parents, and scores are summed from the leaves
up, so time and memory follow the page's size however deep it is nested.

Defined results: null, empty or text-free html gives an empty text; pages with a null or hostless
url vote together as one host; equal votes go to the smaller hash; repeated rows count and vote each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import bounded, slices, written

#: Fixed values of HTML: elements without content, with raw text, and the ones that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same set closes when it is still open.
CLOSES = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
_LIST_HOLDERS = frozenset(["ul", "ol", "dl", "table"])
#: Elements whose text is their holder's; elements in foreign markup that hold text of pages.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre".split())
_SPOKEN = _TEXT_TAGS - {"li"}
_TEXT_HOLDERS = frozenset("foreignobject desc title annotation-xml".split())
#: Parts of what holds them: lists and the like, and tables.
LISTS = frozenset("ul ol li dir dl dt dd figure figcaption details summary".split())
TABLES = frozenset("table thead tbody tfoot tr td th".split())
#: Elements without article text, which may lack an end tag; and markup of its own, which ends where a block begins.
EMBEDDED = frozenset("noscript template iframe select option optgroup datalist canvas object video audio map xmp noframes".split())
FOREIGN = frozenset(["svg", "math"])
SKIP_TAGS = frozenset("nav header footer aside button menu dialog head".split()) | RAW | EMBEDDED | FOREIGN
#: Words in classes and ids: of boilerplate, and neutral ones that may stand beside them.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsors sponsored promo promos promotion promoted banner banners cookie cookies consent "
    "gdpr notice notices popup modal newsletter subscribe subscription nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar side footer header "
    "masthead comment comments respond reply replies disqus related recommend recommended recommendation recommendations share sharing social pagination pager "
    "widget widgets login signup signin search reaction reactions".split()
)
#: Among these: what never holds an article, and what is suspected of a paragraph or heading too.
APART = frozenset(
    "comment comments respond reply replies reaction reactions disqus related recommend recommended recommendation recommendations share sharing social "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription breadcrumb breadcrumbs pagination pager login signup signin".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsors sponsored cookie cookies consent gdpr newsletter subscribe subscription".split())
NEUTRAL = frozenset(
    "box boxes area areas bar bars block blocks wrap wrapper container inner outer body section sections list lists item items link links button buttons btn "
    "icon icons form field input post posts article articles story stories page pages site main primary secondary top bottom left right first last global local "
    "mobile desktop sticky fixed overlay message panel reader readers user users column col row grid group holder title heading text label slot unit zone thread count meta info tools tool "
    "toolbar the and of for to by my our more also read new js large small medium dark light".split()
)
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Share of text in links from which a suspected element is boilerplate.
LINK_SHARE = 0.4
#: What a suspect is suspected by; how often text in an article counts; how much of the other text it has to outweigh, without and with an article; and its least text.
PERHAPS, LAYOUT, OTHER = 1, 2, 3
ARTICLE_WEIGHT, OUTWEIGHS, OUTWEIGHS_WITH_ARTICLE, LEAST_TEXT = 3, 4, 1, 140
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?|[\"'][^\"']*[\"']?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none\b", re.I)
_DIGITS = re.compile(r"\d+")
DECAY = 0.75
_NOT_P = BLOCK - {"p"}
_PAGE = frozenset(["body", "html", "article", "main"])


def name_says(names: str, tag: str = "div") -> int:
    """What classes and ids say of an element: ``OTHER`` than the article, ``LAYOUT`` or ``OTHER``, ``PERHAPS`` boilerplate; 0: nothing."""
    said = 0
    if tag == "h1":
        return said
    for name in _CAMEL.sub("-", names).lower().split():
        words = _NAME_WORDS.findall(name)
        if not (ADVERTS if tag in _SPOKEN else BOILERPLATE).isdisjoint(words):  # "comment-content" is of a comment, "content-sidebar" of a whole layout
            known = all(w in BOILERPLATE or w in NEUTRAL or w == "content" and words[0] in BOILERPLATE for w in words)
            said = max(said, PERHAPS if not known else LAYOUT if APART.isdisjoint(words) else OTHER)
    return said


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and values; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        if name:
            out.setdefault(name.lower(), next(filter(None, values), ""))
    return out


def _step(parent: int, tag: str, classes: str) -> int:
    """The hash of a path: its parent's, and the tag and classes without digits of its last element."""
    kinds = "".join(f".{_DIGITS.sub('', c.lower())}" for c in sorted(set(classes.split())))
    return xxhash.xxh3_64_intdigest(f"{parent}>{tag}{kinds}".encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """Blocks of text in page order, each with its innermost container and the length of its text in links."""

    def __init__(self, page: str):
        self.tags, self.paths, self.parents = [""], [0], [-1]  # of each element; paths are hashes
        blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, innermost suspect
        suspects: list[list] = [[-1, 0, 0, 0, 0, False]]  # the suspect around it, why, characters, of these in links, in articles; whether it holds a main
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, element, skipped, suspect
        open_: dict[str, int] = defaultdict(int)
        parts: list[str] = []
        linked, links, lower, ends = 0, 0, None, {}

        def flush() -> None:
            nonlocal linked
            if parts:
                text = "".join(parts)
                text = " ".join((htmllib.unescape(text) if "&" in text else text).split())
                if text and not stack[-1][2]:
                    holder = stack[-1][1]
                    while self.tags[holder] in _TEXT_TAGS and self.parents[holder] >= 0:
                        holder = self.parents[holder]
                    at = stack[-1][3]
                    blocks.append((holder, text, linked, at))
                    suspects[at][2] += len(text)
                    suspects[at][3] += min(linked, len(text))
                    suspects[at][4] += len(text) if open_["article"] or open_["main"] else 0
                parts.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                if stack[-1][0] in BLOCK or stack[-1][2] or stack[-1][3] != stack[-2][3]:
                    flush()
                links -= stack[-1][0] == "a"
                open_[stack[-1][0]] -= 1
                stack.pop()

        def nearest(names, stops) -> int:
            """Place of the innermost open element of ``names`` that no element of ``stops`` is within; 0: none."""
            for n in names:
                if open_.get(n):
                    break
            else:
                return 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in stops:
                    break
            return 0

        def ended(tag: str) -> bool:
            """Whether an end tag of this name is still to come."""
            nonlocal lower
            if tag not in ends:
                lower = page.lower() if lower is None else lower
                ends[tag] = lower.rfind(f"</{tag}")
            return ends[tag] >= at

        at, size = 0, len(page)
        while at < size:
            m = _TOKEN.search(page, at)
            text = page[at : m.start() if m else size]
            if text and not stack[-1][2]:
                parts.append(text)
                linked += len(text) if links else 0
            if not m:
                break
            at = m.end() if m.end() > m.start() else m.start() + 1
            tag = (m.group(2) or "").lower()
            if not tag:
                if m.group().startswith("<![CDATA[") and not stack[-1][2]:
                    parts.append(htmllib.escape(m.group()[9:].removesuffix("]]>")))
                continue
            if m.group(1):  # an end tag closes the nearest open element of its name, if any
                if k := nearest((tag,), ()):
                    close(k)
                if tag in BLOCK:
                    flush()
                continue
            if tag in VOID:
                if tag == "br":
                    parts.append(" ") if not stack[-1][2] else None
                elif tag == "hr":
                    flush()
                continue
            if tag in BLOCK:
                flush()
                if (open_.get("svg") or open_.get("math")) and (k := nearest(FOREIGN, _TEXT_HOLDERS)):  # a block ends markup of another kind
                    close(k)
                if open_.get("p") and (k := nearest(("p",), _NOT_P)):  # and an open paragraph
                    close(k)
            if tag in CLOSES:
                if k := nearest(CLOSES[tag], _LIST_HOLDERS):
                    close(k)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if m.group(3).endswith("/") and tag not in BLOCK or tag in EMBEDDED and not ended(tag):
                continue
            attrs = attributes(m.group(3)) if m.group(3) else {}
            role, suspect = attrs.get("role", "").lower(), stack[-1][3]
            skipped = stack[-1][2] or tag in SKIP_TAGS or tag not in _PAGE and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or role in SKIP_ROLE)
            if not skipped and tag not in _PAGE:
                said = name_says(f"{attrs.get('class', '')} {attrs.get('id', '')}", tag) if "class" in attrs or "id" in attrs else 0
                if said < LAYOUT and (tag == "form" or "style" in attrs and _NO_DISPLAY.search(attrs["style"])):
                    said = LAYOUT
                if said:
                    flush()
                    suspects.append([suspect, said, 0, 0, 0, False])
                    suspect = len(suspects) - 1
            if (tag == "main" or role == "main") and not skipped:
                suspects[suspect][5] = True
            if skipped and not stack[-1][2]:
                flush()
            if tag in BLOCK and not skipped:
                self.parents.append(stack[-1][1])
                self.paths.append(_step(self.paths[stack[-1][1]], tag, attrs.get("class", "")))
                self.tags.append(tag)
                stack.append((tag, len(self.paths) - 1, False, suspect))
            else:
                stack.append((tag, stack[-1][1], skipped, suspect))
            open_[tag] += 1
            links += tag == "a"
        close(1)
        flush()
        out = self._dropped(suspects)
        self.blocks = [(holder, text, n) for holder, text, n, at in blocks if not out[at]]

    @staticmethod
    def _dropped(suspects: list[list]) -> list[bool]:
        """Whether the text of each suspect, and of those in it, is dropped; suspects come after what is around them."""
        clear = [True]  # not suspected but perhaps
        for around, said, *_ in suspects[1:]:
            clear.append(clear[around] and said == PERHAPS)
        free = sum(n + (ARTICLE_WEIGHT - 1) * a for (_, _, n, _, a, _), c in zip(suspects, clear) if c)
        whole = [list(x) for x in suspects]
        for x in reversed(whole[1:]):
            for k in (2, 3, 4):
                whole[x[0]][k] += x[k]
            whole[x[0]][5] |= x[5]
        out = [False]
        for around, said, n, in_links, in_article, main in whole[1:]:
            if said == PERHAPS:
                drop = in_links >= LINK_SHARE * n
            elif said == LAYOUT and n >= LEAST_TEXT and in_links < LINK_SHARE * n:
                drop = n + (ARTICLE_WEIGHT - 1) * in_article < free * (OUTWEIGHS_WITH_ARTICLE if in_article else OUTWEIGHS)
            else:
                drop = True
            out.append(out[around] or drop and not main)
        return out

    def containers(self) -> list[int]:
        """The container (0: none) whose own text each element's text is."""
        tags, headed = self.tags, set()
        for k, tag in enumerate(tags):
            if tag in ("th", "thead"):
                while k > 0 and tags[k] != "table":
                    k = self.parents[k]
                headed.add(k)
        # rank: 0 elsewhere, 1 below a main, 2 within a part of a main, 3 below an article; table: within a headed one
        out, rank, table = [0], [0], [False]
        for k in range(1, len(tags)):
            tag, up = tags[k], self.parents[k]
            holder, level, inside = k, rank[up], tag in TABLES and (table[up] if tag != "table" else k in headed)
            if level == 3:
                holder = out[up]
            elif tag == "article":
                level = 3
            elif tag == "main" and level == 0:
                level = 1
            elif level == 2 or level == 1 and (tag == "section" or tag in LISTS or tag in TABLES):
                holder, level = out[up], 2
            elif tag in LISTS or inside:
                holder = out[up]
            out.append(holder)
            rank.append(level)
            table.append(inside)
        return out

    def scores(self) -> dict[int, float]:
        """Score of each generalised container path: own text counts fully, text further down a little less."""
        container, worth = self.containers(), [0.0] * len(self.paths)
        for holder, text, linked in self.blocks:
            worth[container[holder]] += max(0.0, len(text) - 2.0 * linked)
        out: dict[int, float] = {}
        for k in range(len(worth) - 1, 0, -1):  # what is inside comes after its holder
            if worth[k]:
                bonus = 1.2 if self.tags[k] in ("article", "main") else 1.0
                out[self.paths[k]] = out.get(self.paths[k], 0.0) + worth[k] * bonus
                worth[container[self.parents[k]]] += DECAY * worth[k]
        return out

    def text(self, path: int | None) -> str:
        """Blocks at or below elements on ``path``; all blocks for None."""
        inside = [path is None or (k > 0 and p == path) for k, p in enumerate(self.paths)]
        for k in range(1, len(self.paths)):
            inside[k] = inside[k] or inside[self.parents[k]]
        return "\n".join(text for holder, text, _ in self.blocks if inside[holder])


def best_path(scores: dict[int, float]) -> int | None:
    return min(scores, key=lambda p: (-scores[p], p), default=None)


def extract(page: str, winner: int | None) -> str:
    parsed = Page(page)
    if winner is not None and (got := parsed.text(winner)):
        return got
    return parsed.text(best_path(parsed.scores()))


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.`` and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host`` and its winning ``path``. Votes are summed per task before the shuffle."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, texts in slices(batches):
            total: dict[tuple[str, int], int] = {}
            for host, text in zip(hosts, texts):
                scores = Page(text or "").scores()
                top = max(scores.values(), default=0.0) or 1.0
                for path, score in scores.items():  # a page's votes are shares of its best score, so long pages count like others
                    total[host, path] = total.get((host, path), 0) + round(1e6 * score / top)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.int64()), pa.array(total.values(), pa.int64())], ["host", "path", "votes"])

    votes = bounded(source).mapInArrow(vote, "host string, path bigint, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("path").alias("path"))).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``.

    The winners are a table of one row per host: Spark broadcasts it when its size allows and else
    joins by host, where a hot host's pages can be split since the other side is a plain exchange.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = source.join(written(host_paths(pages, url_col, html_col)), "host", "left").select("id", "url", "html", "path")
    kinds = [to_arrow_type(joined.schema[c].dataType) for c in ("id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, texts, paths in slices(batches):
            got = [extract(t or "", p) for t, p in zip(texts, paths)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(urls, kinds[1]), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], ["id", "url", "text", "n_chars"])

    types = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("id", "url"))
    return bounded(joined).mapInArrow(run, f"{types}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
