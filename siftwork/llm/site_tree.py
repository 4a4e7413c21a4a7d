"""Main text of HTML pages by site style trees.

The element trees of a host's pages are merged: a tree node is a path of tags with their classes, and for each the
pages that have it, the styles of its children (their tag sequences) and its own texts are counted. The entropy of a
node is the mean information of its values, and each block is judged by the information of its own: one whose style
and text are those of most pages is presentation, and the page loses it, whatever its siblings at the path hold; one
whose style or text is rare stays. Tags and classes that by their meaning
are presentation (menus, footers, adverts, forms ...) start with no importance. Names and forms only hint: an article
stays whatever it is called, and so does what wraps all articles or most of the text. Pages with the same texts count
once, and inside an article a block counts once for each longest other text beside it, so that copies of a text are no proof.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import small_side, spill
from siftwork.llm.url_filter import host_of

#: Pages with a path from which on its values are judged, and the importance below which a block goes.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.2

#: Tags and words of class names and ids by meaning. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video".split())
DROPPED = frozenset("head title nav footer aside button select option textarea input label dialog menu".split()) | RAW
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars side aside footer footers foot header masthead topbar cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments reply replies respond disqus widget widgets form search copyright legal disclaimer skip".split()
)
MAIN = frozenset("article main".split())
#: How a node starts, before its page's other nodes are known.
HARD, SOFT, ARTICLE, PLAIN = range(4)
_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*(?:\"|\Z)|=\s*+'[^']*(?:'|\Z)|=)*+)(?:>|\Z)|([^<]++|<)", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "path", "names", "prior", "parts", "parent", "block", "kind", "scope", "soft", "size", "main")

    def __init__(self, tag: str, path: str, names: str, parent: Node | None) -> None:
        self.tag, self.path, self.names, self.prior, self.parent, self.parts = tag, path, names, 0, parent, []
        self.block = parent.block if tag in INLINE else self  # the node whose text it is


def _judge(root: Node) -> None:
    """Sets prior: -1: presentation by meaning, 1: inside an article, 0: outside. The entropies decide on both of these.

    HARD tags go with all that is in them. A SOFT branch, by a whole class name, id or role of BOILER or as a form, goes
    unless it holds all of the page's article text, or, inside an article or on a page without, most of the text there.
    Articles inside it stay, except comments and cards: two of being named so, in another article, in a SOFT branch.
    """
    nodes = list(_walk(root))
    root.kind, root.scope, root.soft, root.size, root.main = PLAIN, root, False, 0, 0
    for node in nodes[1:]:
        up, tag = node.parent, node.tag
        scope = node.scope = up if up.kind == ARTICLE else up.scope
        soft = up.soft
        named = node.names != "" and tag not in ("html", "body") and not BOILER.isdisjoint(node.names.lower().split())
        if up.kind == HARD or tag in DROPPED or tag == "header" and scope is root:
            node.kind = HARD
        elif tag == "main" or tag == "article" and named + soft + (scope.tag == "article") < 2:
            node.kind, soft = ARTICLE, False
        else:
            node.kind = SOFT if named or tag == "form" else PLAIN
        node.soft, node.size, node.main = soft or node.kind == SOFT, 0, 0
    for node in reversed(nodes):
        if node.kind != HARD:
            node.size += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
            if node.kind == ARTICLE:
                node.main = node.size
            if node is not root:
                node.parent.size += node.size
                node.parent.main += node.main
    for node in nodes[1:]:
        scope = node.scope
        if node.kind == SOFT and not (node.main == root.main if scope is root and root.main else node.size * 2 > scope.size) or node.kind == HARD:
            node.prior = -1
        else:
            node.prior = 1 if node.kind == ARTICLE else node.parent.prior


def parse(page: str) -> Node:
    """The element tree: forgiving, in one pass, each part a child Node or a str with its references decoded."""
    root = Node("", "", "", None)
    at, raw, pos = root, "", 0
    opened: dict[str, int] = {}
    while pos < len(page):
        if raw:  # text up to the end tag of a script, style ...
            end = re.compile(rf"</{raw}\b[^>]*>", re.I).search(page, pos)
            pos, raw = (end.end() if end else len(page)), ""
            continue
        m = _PARTS.match(page, pos)
        if m is None:
            pos += 1
            continue
        pos = m.end()
        close, tag, rest, text = m.groups()
        if text is not None:
            at.parts.append(markup.unescape(text) if "&" in text else text)
        elif tag:
            tag = tag.lower()
            if close:
                if opened.get(tag):
                    while at.tag != tag:
                        opened[at.tag] -= 1
                        at = at.parent
                    opened[tag] -= 1
                    at = at.parent
                continue
            if tag in _BLOCKS_END_P or tag in _CLOSES:
                shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
                up = at
                while up is not root and (up.tag in INLINE or up.tag in shut):
                    if up.tag in shut:
                        while at is not up.parent:
                            opened[at.tag] -= 1
                            at = at.parent
                    up = up.parent
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
            path = at.path if tag in INLINE else at.path + "/" + tag + ("." + names if names else "")
            if len(path) > 400:  # deep trees keep short names
                path = "#" + hashlib.sha256(path.encode()).hexdigest()[:16]
            node = Node(tag, path, names, at)
            at.parts.append(node)
            if tag not in VOID and not rest.endswith("/"):
                if tag in RAW:
                    raw = tag
                else:
                    at = node
                    opened[tag] = opened.get(tag, 0) + 1
    _judge(root)
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        own = stack.pop()
        yield own
        stack += [p for p in reversed(own.parts) if isinstance(p, Node)]


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _blocks(root: Node) -> list[tuple[Node, int, int, int, int]]:
    """(node, path, style, text, length) of each block whose importance the entropies decide: the keys of its path and of its values there.

    The text is that of the block and its inline parts. Every block counts, repeated siblings too; those without text have nothing to lose.
    """
    held: dict[Node, list[str]] = {}
    for node in _walk(root):
        own = node.block
        if node.prior != -1 and own.prior != -1 and own.tag not in ("", "html", "body"):
            held.setdefault(own, []).extend(p for p in node.parts if isinstance(p, str))
    out = []
    for node, parts in held.items():
        text = " ".join(" ".join(parts).split())
        if text:
            tags = [p.tag for p in node.parts if isinstance(p, Node)]
            style = ",".join(t for i, t in enumerate(tags) if i == 0 or t != tags[i - 1])
            path = node.path if node.prior == 0 else "in " + node.path
            out.append((node, _key(path), _key(path, "s", style), _key(path, "t", text), len(text)))
    return out


def _votes(page: str) -> set[tuple[bool, int, int, int]]:
    """(inside, path, v, seen) of a page's blocks: values are counted by their distinct `seen`.

    It is a key of all texts of the page, so that a page and its copies have one vote. For a text inside an article it
    is the longest other text, so that even copies with changes elsewhere don't make an article's paragraphs common.
    """
    found = _blocks(parse(page))
    page_key = _key(*map(str, sorted({text for *_, text, _ in found})))
    longest = [text for _, text in sorted({(-length, text) for *_, text, length in found})[:2]] + [0]
    out = set()
    for node, path, style, text, _ in found:
        inside = node.prior == 1
        out |= {(inside, path, path, page_key), (inside, path, style, page_key), (inside, path, text, longest[longest[0] == text] if inside else page_key)}
    return out


def low_values(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, v): the keys of styles and texts of low importance at their path, for paths on LEAST_PAGES pages or more of a host.

    A value's importance is its information to the base of the pages that have the path: 0 if all of them have the
    value too, 1 if a single one does. Copies of a page count once (see _votes). Inside articles a value must also be
    on half of the pages at least: a line that many of them quote is theirs. Counts are summed before a shuffle, and values
    too rare for any path are gone before they meet the paths' pages, so that no task sees all of a host.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                made = []
                for h, p in zip(batch.column(0)[k : k + 200], batch.column(1)[k : k + 200], strict=True):
                    host = h.as_py()
                    made += [(host, *x) for x in _votes(p.as_py())]
                columns = list(zip(*made, strict=True)) if made else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), *[pa.int64()] * 3), strict=True)], ["host", "inside", "path", "v", "seen"])

    found = rows.mapInArrow(run, "host string, inside boolean, path long, v long, seen long").distinct()  # v = path: the page has the path
    counts = found.groupBy("host", "inside", "path", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = spill(counts.where(F.col("n") >= LEAST_PAGES ** (1 - LEAST_IMPORTANCE)), "values")
    paths = counts.where((F.col("v") == F.col("path")) & (F.col("n") >= LEAST_PAGES)).select("host", "path", F.col("n").alias("pages"))
    values = counts.where("v <> path").join(paths, ["host", "path"])
    common = (F.log2(F.col("pages") / F.col("n")) < LEAST_IMPORTANCE * F.log2("pages")) & (~F.col("inside") | (F.col("n") * 2 >= F.col("pages")))
    return values.where(common).select("host", "v")


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The text of a page without presentation and without blocks whose style and text are both in `low`; inline tags join, others part.

    A block's inner blocks are judged by themselves, so that a branch goes only if all of its blocks do.
    """
    out: list[str] = []
    root = parse(page)
    gone = {node for node, _, style, text, _ in _blocks(root) if style in low and text in low} if low else ()
    stack: list[Node | str | None] = [root]
    while stack:
        own = stack.pop()
        if own is None:
            out.append(" ")
        elif isinstance(own, str):
            out.append(own)
        elif own.kind != HARD:
            if own.tag not in INLINE:
                out.append(" ")
                stack.append(None)
            stack += [p for p in reversed(own.parts) if isinstance(p, Node) or own.prior != -1 and own.block not in gone]
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of `pages`: the id, the url, text, n_chars (code points).

    Null html is empty; a page without main text has an empty text. Pages with a null url share the empty host. The
    keys of low importance travel to the pages as one small list for each host, and are looked up there.
    """
    low = low_values(pages, url_col, html_col)
    low = spill(low.groupBy("host").agg(F.collect_set("v").alias("low")), "low-values")
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(small_side(low), "host", "left").select("id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", frozenset(x.as_py() or ())) for p, x in zip(batch.column(2), batch.column(3), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
