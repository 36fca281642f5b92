"""Main text of web pages, with site templates removed.

A page is parsed into a tree that tolerates unclosed and crossing tags. Its main
part is its articles but teasers, else the main element, else the body; menus,
headers, footers, sidebars, notices, adverts, forms and comments go by tag, role
or class, but nothing that holds the article goes by its names. What is left of a site's template is found by counting: the subtrees of
the main part are hashed, and Spark counts for every host on how many different
pages each occurs; subtrees that recur on many pages of the host are deleted.
Within an article only containers can be template, its paragraphs stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.llm.batches import slices
from finsieve.session import materialize

#: A subtree is template from so many different pages of a host on, if that is at least this share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 10, 0.05

# Kinds of elements (fixed values of the markup language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("aside center details dir div dl fieldset figure menu ol section table ul".split())
#: Elements that end an open element of the second kind.
ENDS = {name: frozenset(ended.split()) for name, ended in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
P_STAYS = frozenset("option optgroup".split())

DROPPED_TAGS = frozenset("aside button canvas datalist dialog footer form head input label menu nav object select svg template".split()) | RAW
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of classes and ids that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination"
    " popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe toolbar widget widgets".split()
)

#: Words that make a whole class name together with words of the above ("related-posts"), and those of teasers.
COMPOUND_WORDS = frozenset(
    "area articles bar block bottom box button buttons col column container form global group header inner item items left link links list main outer"
    " page panel posts primary right row secondary section site slot stories top unit wrap wrapper".split()
)
#: Words of what readers wrote below an article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
TEASER_WORDS = frozenset("excerpt preview promo promoted recommended related sponsored teaser".split())
#: Elements of running text; their ids name places in it.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that can be template on pages without an article or main element; single headings, items and cells cannot.
TEMPLATE_BLOCKS = BLOCKS - frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption legend html body".split())

#: A comment, a declaration, or a tag: slash, name, attributes, end. A quote counts after an equals sign only, and
#: where the page ends inside a tag the end is empty.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?=[^"'])|\Z))*+)(>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "attributes", "children", "dropped", "digest")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []
        self.dropped = False
        self.digest = 0

    def attribute_values(self) -> dict[str, str]:
        if "=" not in self.attributes and "hidden" not in self.attributes:
            return {}
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attributes)}


def parse(page: str) -> Element:
    """The tree of a page. Comments and raw elements but their tags are left out."""
    root = Element("html", "")
    stack = [root]
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if m is None:
            return root
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            return root
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if tag in BLOCKS and tag not in P_STAYS:
            _close(stack, frozenset(("p",)), BLOCKS)
        if tag in ENDS:
            _close(stack, ENDS[tag], frozenset("ul ol dl table select menu dir".split()))
        element = Element(tag, m[3])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not element.attributes.rstrip().endswith("/"):
            stack.append(element)


def _close(stack: list[Element], tags: frozenset, barrier: frozenset) -> None:
    """Closes the innermost element of ``tags``, unless one of ``barrier`` is open inside it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in barrier:
            return


def _marked(names: str, words: frozenset) -> bool:
    """Whether one of the names is a word of ``words``, alone or in a compound of such words."""
    for name in names.lower().split():
        parts = set(_WORD.findall(name))
        if not parts.isdisjoint(words) and parts <= words | COMPOUND_WORDS:
            return True
    return False


def _unwanted(e: Element, in_article: bool, in_main: bool, protected: bool) -> bool:
    """Whether an element is none of the article, by its tag, its role or, unless it is protected, its names."""
    if e.tag in DROPPED_TAGS:
        return True
    if e.tag == "header":
        # an article's own header holds its title
        return not protected and not (in_article and any(isinstance(c, Element) and c.tag in ("h1", "h2", "hgroup") for c in e.children))
    if not e.attributes or e.tag in ("html", "body", "main", "br", "hr"):
        return False
    values = e.attribute_values()
    if not values:
        return False
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    if values.get("role", "").lower() in DROPPED_ROLES:
        return True
    names = values.get("class", "")
    if not (e.tag in TEXT_TAGS or in_main and e.tag == "section"):
        names = f"{names} {values.get('id', '')}"
    if e.tag == "article":
        return _comment(e)
    if protected:
        return False
    return _marked(names, DROPPED_WORDS) or (not in_article and _marked(names, frozenset(("header",))))


def _comment(e: Element) -> bool:
    """Whether an element's names say that readers wrote it."""
    values = e.attribute_values()
    return not COMMENT_WORDS.isdisjoint(_WORD.findall(f"{values.get('class', '')} {values.get('id', '')}".lower()))


def _holders(root: Element) -> set[int]:
    """Elements (by ``id()``) that are kept whatever their names: those around the main element, the longest article that is
    no teaser or comment, or, on pages with neither, most of the text. Lists of teasers and comments are not kept for it."""
    order: list[tuple[Element, int]] = [(root, -1)]
    for i, (e, _) in enumerate(order):
        order += [(c, i) for c in e.children if isinstance(c, Element)]
    sizes = [0 if e.tag in RAW else sum(len(c) for c in e.children if isinstance(c, str)) for e, _ in order]
    for i in range(len(order) - 1, 0, -1):
        sizes[order[i][1]] += sizes[i]
    named = [bool(e.attributes) for e, _ in order]
    mains = [i for i, (e, _) in enumerate(order) if e.tag == "main" or named[i] and "main" in e.attributes and e.attribute_values().get("role") == "main"]
    articles = [i for i, (e, _) in enumerate(order) if e.tag == "article" and not (named[i] and _comment(e)) and not _teaser(e)]
    wanted = mains + ([max(articles, key=sizes.__getitem__)] if articles else [])
    if not wanted:
        wanted = [i for i in range(len(order)) if 2 * sizes[i] > sizes[0] and not (named[i] and _comment(order[i][0]))]
    held: set[int] = set()
    # innermost first; a walk up ends where an earlier one passed
    for i in reversed(wanted):
        while i >= 0:
            e = order[i][0]
            # what lies around a list of teasers or comments is not kept for their sake
            if id(e) in held or named[i] and (_comment(e) or _marked(e.attribute_values().get("class", ""), TEASER_WORDS)):
                break
            held.add(id(e))
            i = order[i][1]
    return held


def _teaser(e: Element) -> bool:
    """Whether an article only leads to another page: by its class, or as nearly all of its text is links."""
    if _marked(e.attribute_values().get("class", ""), TEASER_WORDS):
        return True
    n = linked = 0
    todo: list[tuple[Element | str, bool]] = [(e, False)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            size = len("".join(x.split()))
            n, linked = n + size, linked + size * link
        elif not x.dropped:
            todo += [(c, link or x.tag == "a") for c in x.children]
    return 10 * linked >= 9 * n


def main_part(root: Element) -> tuple[Element, bool]:
    """The element that holds the main text, its unwanted parts marked as dropped; whether it is an article."""
    articles, mains = [], []
    held = _holders(root)
    todo: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while todo:
        e, inside, in_main = todo.pop()
        e.dropped = _unwanted(e, inside, in_main, id(e) in held)
        if e.dropped:
            continue
        if e.tag == "article" and not inside:
            articles.append((e, in_main))
        elif e.tag == "main" or "main" in e.attributes and e.attribute_values().get("role") == "main":
            mains.append(e)
            in_main = True
        inside = inside or e.tag == "article"
        todo += [(c, inside, in_main or inside) for c in reversed(e.children) if isinstance(c, Element)]
    # articles beside the main element are not of the main part
    found = [e for e, in_main in articles if in_main] or [e for e, _ in articles]
    if len(found) > 1:
        full = [e for e in found if not _teaser(e)]
        found = full or [max(found, key=lambda e: sum(map(len, blocks(e, frozenset()))))]
    if len(found) > 1:
        part = Element("article", "")
        part.children += found
        return part, True
    if found:
        return found[0], True
    if mains:
        return mains[0], True
    return root, False


def hash_subtrees(e: Element) -> list[Element]:
    """All elements below ``e`` that are not dropped, children first, each with the digest of its subtree."""
    order: list[Element] = []
    todo = [e]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Element) and not c.dropped]
    order.reverse()
    for x in order:
        parts = [str(c.digest) if isinstance(c, Element) else " ".join(c.split()) for c in x.children if isinstance(c, str) or not c.dropped]
        x.digest = xxhash.xxh3_64_intdigest("\x00".join([x.tag, *(p for p in parts if p)])) - 2**63
    return order


def _has_text(e: Element) -> bool:
    return any(c.strip() if isinstance(c, str) else not c.dropped and _has_text(c) for c in e.children)


def candidates(page: str) -> list[int]:
    """Digests of the subtrees of a page that may be template."""
    part, article = main_part(parse(page))
    if part.tag == "html" and not part.children:
        return []
    found = {x.digest for x in hash_subtrees(part) if x is not part and x.tag in (CONTAINERS if article else TEMPLATE_BLOCKS) and _shallow(x)}
    return sorted(found)


def _shallow(e: Element) -> bool:
    """Whether ``e`` says anything; a tree too deep for recursion is taken to."""
    try:
        return _has_text(e)
    except RecursionError:
        return True


def blocks(part: Element, template: frozenset) -> list[str]:
    """Text blocks of ``part`` in page order, white space as single spaces, without empty ones."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[Element | str | None] = [part]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.dropped or (template and x is not part and x.digest in template):
            if x.tag in BLOCKS:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def extract(page: str, template: frozenset = frozenset()) -> str:
    part, article = main_part(parse(page))
    if template:
        for x in hash_subtrees(part):
            # in an article only containers can be template
            if x.tag not in (CONTAINERS if article else TEMPLATE_BLOCKS):
                x.digest = 2**64
    return "\n".join(blocks(part, template))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _pages_of(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("html").to_pylist()]


def _candidates_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            found = [candidates(x) for x in _pages_of(part)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("host").take(at), part.column("page_hash").take(at), pa.array([d for x in found for d in x], pa.int64())],
                names=["host", "page_hash", "digest"],
            )


def _extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            template = part.column("template").to_pylist()
            texts = [extract(x, frozenset(t or ())) for x, t in zip(_pages_of(part), template, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame, least_pages: int = TEMPLATE_PAGES, least_share: float = TEMPLATE_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    A null html is an empty page; an empty page has the empty text. Pages with a
    null url or one without a host belong to no site and are compared with none.
    Equal pages of a host count as one page, so copies of a page are no template;
    each row gets its own result. A very long page is parsed whole.
    Other columns are ignored; an empty table gives no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page_hash"))
    subtrees = own.filter("host <> '' AND html IS NOT NULL").select("host", "page_hash", "html")
    subtrees = materialize(subtrees.mapInArrow(_candidates_task, "host string, page_hash long, digest long").distinct(), "subtrees")
    sizes = own.select("host", "page_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = subtrees.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    template = counts.join(sizes, "host").filter(F.col("n") >= F.col("pages") * least_share).select("host", "digest")
    # a page's own list is no longer than the page
    lists = subtrees.join(template, ["host", "digest"]).groupBy("host", "page_hash").agg(F.collect_list("digest").alias("template"))
    lists = materialize(lists, "templates")
    joined = own.join(lists, ["host", "page_hash"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extract_task, "page_id long, url string, text string, n_chars long")
