"""Main text of web pages, with the container agreed on by the pages of a host.

Each page's containers are scored by the running text in them (links, and parts that
their tag or class names mark as menus, adverts and the like, count against it). A page
votes for the generalised path of tags and classes of its best container; Spark counts
the votes of a host, and every page is read again with the winning path that holds most
running text of it, weighed by votes; its own best container counts as a path with few votes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.shared import small_batches, staged

#: Paths of a host that are tried in turn, and the share of its votes that a path needs.
MAX_PATHS = 3
MIN_VOTES = 0.1
#: Characters from which on a block counts as running text whatever its tag.
RUNNING_TEXT = 80

# Kinds of tags, and names that mark parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small "
    "span strike strong sub sup time tt u var wbr nobr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# An open element that a start tag of the same group ends, up to the listed container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
OUTSIDE_TAGS = set("nav header footer aside form script style button select option input menu dialog svg canvas object head iframe noscript template".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
OUTSIDE_NAMES = set(
    "ad ads adv advert advertisement adverts advertising adsbygoogle sponsor sponsored promo promotion banner sidebar rail aside nav navbar "
    "navigation menu breadcrumb breadcrumbs topbar masthead footer copyright cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond "
    "disqus share sharing social related recommended recommendations outbrain taboola pagination pager toolbar widget "
    "widgets search form skip".split()
)
# Words that say nothing of a part's content beside one of the names above.
NEUTRAL_NAMES = set(
    "area article articles bar block body bottom box btn button buttons card center col column container content global group header "
    "icons inner item items left links list main outer page panel post posts primary reader right row secondary section site slot "
    "stories story thread title top unit user users wrap wrapper".split()
)
WHOLE_PAGE_TAGS = set("html body main article".split())
TAG_BONUS = {"article": 1.5, "main": 1.3}
NAME_BONUS = set("article content entry post story main text body".split())

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element. A path is a number that all elements with the same labels above them share;
    ``paths`` is the page's table of (number of the path above, label)."""

    __slots__ = ("parent", "paths", "tag", "label", "path", "order", "depth", "block", "outside", "suspect", "bonus", "content")

    def __init__(self, parent: Node | None, tag: str, label: str, order: int = 0, outside: bool = False, suspect: bool = False, bonus: float = 1.0):
        self.parent, self.tag, self.label, self.order = parent, tag, label, order
        self.outside, self.suspect, self.bonus = outside, suspect, bonus
        self.content = bonus > 1.0 and tag not in ("html", "body")
        if parent is None:
            self.paths, self.path, self.depth, self.block = {}, 0, 0, self
            return
        self.paths, self.depth = parent.paths, parent.depth + 1
        self.path = self.paths.setdefault((parent.path, label), len(self.paths) + 1)
        self.block = parent.block if tag in INLINE else self
        self.content = self.content or parent.content

    def named_path(self) -> str:
        labels, node = [], self
        while node.parent is not None:
            labels.append(node.label)
            node = node.parent
        return "".join("/" + x for x in reversed(labels))


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _node(parent: Node, tag: str, given: str, order: int) -> Node:
    attributes = _attributes(given)
    classes = attributes.get("class", "").split()
    given_names = [{part.lower() for part in _NAME_PART.findall(c)} for c in (*classes, attributes.get("id", ""))] if attributes else []
    names = set().union(*given_names)
    label = tag + "".join(sorted("." + _NUMBER.sub("#", c.lower()).replace("/", "|") for c in classes))
    outside, suspect = parent.outside or tag in OUTSIDE_TAGS, False
    if not outside and attributes and tag not in WHOLE_PAGE_TAGS:
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        outside = bool(hidden or attributes.get("role", "").lower() in OUTSIDE_ROLES)
        # A site's header, not the head of an article.
        outside = outside or ("header" in names and not names & {"article", "entry", "post", "story", "content"})
        if not outside and not names & {"has", "with", "no", "without"}:
            marking = [x for x in given_names if x & OUTSIDE_NAMES]
            # A name that says nothing else, like cookie-notice; social-history only makes suspect.
            outside = any(all(part in OUTSIDE_NAMES or part in NEUTRAL_NAMES or part.isdigit() for part in x) for x in marking)
            suspect = bool(marking) and not outside
    if tag == "header" and not parent.outside and parent.content:
        outside = suspect = False  # the head of the article itself
    bonus = TAG_BONUS.get(tag, 1.2 if names & NAME_BONUS or attributes.get("role") == "main" else 1.0)
    return Node(parent, tag, label, order, outside, suspect, bonus)


def _above(found: list[tuple[Node, str, int]]) -> list[Node]:
    """The blocks' elements and all those they are in, outer ones first."""
    seen: dict[int, Node] = {}
    for node, _, _ in found:
        while node is not None and node.order not in seen:
            seen[node.order] = node
            node = node.parent
    return [seen[k] for k in sorted(seen)]


def _summed(nodes: list[Node], own: dict[int, float]) -> dict[int, float]:
    """Each element's value with those of all elements in it, by the elements' order."""
    total = {node.order: own.get(node.order, 0.0) for node in nodes}
    for node in reversed(nodes):
        if node.parent is not None:
            total[node.parent.order] += total[node.order]
    return total


def _settle(found: list[tuple[Node, str, int]]) -> None:
    """Suspect elements are left out if they are mostly links or hold short pieces only."""
    nodes = _above(found)
    if not any(node.suspect for node in nodes):
        return
    sizes, linked, running = {}, {}, {}
    for owner, text, links in found:
        k = owner.order
        sizes[k], linked[k] = sizes.get(k, 0) + len(text), linked.get(k, 0) + links
        running[k] = running.get(k, 0) + (len(text) >= RUNNING_TEXT)
    sizes, linked, running = (_summed(nodes, x) for x in (sizes, linked, running))
    for node in nodes:
        k = node.order
        if node.suspect and (2 * linked[k] >= sizes[k] or not running[k]):
            node.outside = True
        if node.parent is not None and node.parent.outside:
            node.outside = True


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """The page's blocks of text in order: the element they are in, text, characters in links."""
    stack, out = [Node(None, "", "")], []
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    linked, links = 0, 0  # characters in links, open links
    at, n, size, order, last_end = 0, 0, len(page), 0, page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1].block, text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    def close(upto: int) -> None:
        nonlocal links
        if any(x.tag not in INLINE for x in stack[upto:]):
            flush()
        links -= sum(x.tag == "a" for x in stack[upto:])
        opened.subtract(x.tag for x in stack[upto:])
        del stack[upto:]

    while at < size:
        n = page.find("<", at)
        if n < 0:
            add(page[at:])
            break
        if n > at:
            add(page[at:n])
        following = page[n + 1 : n + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", n):
                end = page.find("-->", n + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", n)
                at = size if end < 0 else end + 1
            continue
        if not (following.isascii() and following.isalpha()) and following != "/":
            add("<")
            at = n + 1
            continue
        if n > last_end:
            break  # a tag that the page's end cuts off is markup, too
        m = _TAG.match(page, n) or _LOOSE_TAG.match(page, n)
        if m is None:
            if following == "/":
                at = page.find(">", n) + 1
            else:
                add("<")
                at = n + 1
            continue
        at = m.end()
        tag = m[1].lower()
        if following == "/":
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW_TEXT:
            end = re.compile(r"</" + re.escape(tag) + r"(?=[\s/>])", re.I).search(page, at)
            at = size if end is None else end.start()
            if end is not None:
                close_tag = page.find(">", at)
                at = size if close_tag < 0 else close_tag + 1
            if tag not in INLINE:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[k].tag in within:
                    break
                if stack[k].tag in ends:
                    close(k)
                    if tag != "tr" or stack[-1].tag != "tr":
                        break
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag not in INLINE:
            flush()
        if m[2].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        order += 1
        stack.append(_node(stack[-1], tag, m[2], order))
        opened[tag] += 1
        links += tag == "a"
    flush()
    _settle(out)
    return out


def _weighed(found: list[tuple[Node, str, int]]) -> tuple[list[Node], dict[int, float]]:
    """Elements with text that counts, and the worth of the running text in each."""
    inside = [block for block in found if not block[0].outside]
    own: dict[int, float] = {}
    for owner, text, linked in inside:
        worth = max(0.0, len(text) - 3.0 * linked) * (1.0 if owner.tag == "p" or len(text) >= RUNNING_TEXT else 0.3)
        own[owner.order] = own.get(owner.order, 0.0) + worth
    nodes = _above(inside)
    return nodes, _summed(nodes, own)


def _best(nodes: list[Node], weights: dict[int, float]) -> Node | None:
    best, best_rank = None, None
    for node in nodes:
        # Text blocks themselves are no containers, and the smaller of two equal ones wins.
        if weights[node.order] >= 0.75 * weights[0] and node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre"):
            rank = (node.bonus, node.depth)
            if best_rank is None or rank > best_rank:
                best, best_rank = node, rank
    return best


def best_container(found: list[tuple[Node, str, int]]) -> tuple[str, float]:
    """Path and score of the container with the most running text in it, and nothing else if possible."""
    nodes, weights = _weighed(found)
    best = _best(nodes, weights)
    return ("", 0.0) if best is None else (best.named_path(), weights[best.order])


def main_text(found: list[tuple[Node, str, int]], paths: list[tuple[str, float]]) -> str:
    """The blocks, without parts marked as something else, within one of the host's paths or the page's own
    best container: the one with the most running text, weighed by its share of the host's votes. The own
    container counts with ``MIN_VOTES`` at least, so a winner that holds next to nothing of a page gives way."""
    nodes, weights = _weighed(found)
    best = _best(nodes, weights)
    if best is None:
        return ""
    tried = []
    for path, share in paths:
        number: int | None = 0
        for label in path.split("/")[1:]:
            number = best.paths.get((number, label)) if number is not None else None
        tried.append((number, share))
    chosen, most = set(), -1.0
    for number, share in [*tried, (best.path, MIN_VOTES)]:
        if number is None:
            continue
        within, weight = set(), 0.0
        for node in nodes:
            if node.parent is not None and node.parent.order in within:
                within.add(node.order)
            elif node.path == number:
                within.add(node.order)
                weight += weights[node.order]
        if within and weight * share > most:
            chosen, most = within, weight * share
    return "\n".join(text for owner, text, _ in found if not owner.outside and owner.order in chosen)


def host_of(url: str | None) -> str:
    """Lower-case host name; empty without one."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            found = [best_container(blocks(h or "")) for h in part.column("html").to_pylist()]
            hosts = [host_of(u) for u in part.column("url").to_pylist()]
            rows = [(h, p, s) for h, (p, s) in zip(hosts, found) if p]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows)) or [(), (), ()], (pa.string(), pa.string(), pa.float64()))], ["host", "path", "score"])


def _read_again(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                pages, paths = part.column("__html").to_pylist(), part.column("__paths").to_pylist()
                texts = [main_text(blocks(h or ""), [(x["path"], x["share"]) for x in p or []]) for h, p in zip(pages, paths)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    return run


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the paths with most votes of a host and their shares of them, best first; ties by the text in them, then by name."""
    votes = pages.select(F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(_vote, "host string, path string, score double")
    counted = staged(votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score")), "votes")
    of_host = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.round("score", 3)), "path"))
    first = counted.withColumn("rank", rank).where(F.col("rank") <= MAX_PATHS).join(of_host, "host").where(F.col("votes") >= MIN_VOTES * F.col("all_votes"))
    share = (F.col("votes") / F.col("all_votes")).alias("share")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", share))), lambda x: F.struct(x["path"].alias("path"), x["share"].alias("share")))
    return staged(first.groupBy("host").agg(listed.alias("paths")), "winning-paths")


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the html by default) plus ``text`` (the main text's blocks, one a line) and ``n_chars``.

    Null and empty pages, and pages without running text, give an empty text; pages
    without a host form a group of their own; repeated pages vote and are read each on
    its own; input columns named as the results are replaced. Time and memory grow with the
    length of a page, whatever its nesting; a page is one row of one task.
    """
    small_batches(pages.sparkSession)
    keep = [c for c in (keep or [c for c in pages.columns if c != html]) if c not in ("text", "n_chars")]
    rows = pages.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(html).alias("__html"),
        F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("__host"),
    )
    winners = winning_paths(pages, url, html).select(F.col("host").alias("__host"), F.col("paths").alias("__paths"))
    joined = rows.join(winners, "__host", "left").select(*[F.col(f"`{c}`") for c in keep], "__html", "__paths")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return joined.mapInArrow(_read_again(keep), f"{fields}text string, n_chars long")
