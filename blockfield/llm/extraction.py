"""Main text of raw pages by composite text density.

The project has no records of markup, so this operator is general: pages(page_id, url, html).

A page is read into a tree of elements.  What is not text and boilerplate elements are left out: by tag always, by role, class,
id or as a form if they do not hold most of the page's text outside links.  Every node gets its characters C, tags T (formatting inside a block does not count), link characters LC and link tags LT; its density is
C/T * log(C*T / (LC*LT)) to the base ln(C*LC/(C-LC) + C*LCb/Cb + e), b being the body, zero divisors counting as one.  The
node with the greatest sum of its children's densities leads; of it and the nodes above it, those as dense as the
sparsest node on the path to the body bound the text: the main text is that of the uppermost node on the path whose own text
is dense enough, blocks in page order.
"""

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select textarea option iframe object svg math canvas audio video map dialog menu".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that is left out only if it does not hold most of the page's text: a form may span the page.
WRAPPER = frozenset(["form"])
IN_HEAD = frozenset("base link meta title style script noscript template".split())
CLOSES_P = BLOCK - frozenset("br body html td th tr tbody thead tfoot caption li dd dt".split())
BOUNDS = BLOCK | DROPPED
NOT_P = BOUNDS - {"p"}
LISTS = frozenset("ul ol dl table".split()) | DROPPED
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Words that say where or how large a named part is; a name of these and boilerplate words alone still names boilerplate.
PLACE_WORDS = frozenset("area bar block bottom box container content item items left link links list main page post posts primary right secondary section site top wrap wrapper".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

# A comment may end at once or with --!>; in a tag only a quote behind an equals sign opens a quoted value, and one that never
# closes is an ordinary character, so a malformed tag ends at its next >.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>?)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parts", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str):
        self.tag, self.parts = tag, []  # parts: text or nodes, in page order
        self.named = False  # as boilerplate, by a class, an id, a role or a tag that may also be a wrapper
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate_name(name: str) -> bool:
    """Whether one class or id names boilerplate as a whole: 'sidebar' or 'site-header', but not 'has-sidebar' or 'header-image'."""
    words = PARTS.findall(name)
    return any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in PLACE_WORDS or w.isdigit() for w in words)


def _named_boilerplate(tag: str, attributes: str) -> bool:
    if tag in WRAPPER:
        return True
    if "=" in attributes and tag not in ("body", "html", "main", "article"):
        for name, a, b, c in NAMED.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "role":
                if value.strip() in BOILERPLATE_ROLES:
                    return True
            elif any(map(_boilerplate_name, value.split())):
                return True
    return False


def parse(text: str) -> Node:
    """Tree of what may be main text; a missing end tag is closed by what cannot stand inside, or by the end of the page.

    Elements that are boilerplate by their tag open and close as all others do, but do not hang on the tree; those named
    boilerplate are taken off the whole tree.
    """
    root = Node("body")
    stack = [root]
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            tail = text[at:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", tail)
            stack[-1].parts.append(tail[: cut.start()] if cut else tail)
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        if not m.group(4):  # the page ends inside a tag
            break
        tag, attributes = name.lower(), m.group(3)
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BOUNDS and stack[i].tag in BOUNDS:  # an inline end tag closes nothing beyond its block
                    break
            continue
        alone = tag in VOID or attributes.endswith("/") and tag not in BLOCK
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in CLOSES_P:
            _close(stack, ("p",), NOT_P)
        elif tag in SAME:
            _close(stack, SAME[tag].split(), LISTS)
        node = Node(tag)
        if tag in DROPPED and tag not in WRAPPER:
            if stack[-1].parts and not alone:
                stack[-1].parts.append(Node("hr"))
        else:
            node.named = not alone and _named_boilerplate(tag, attributes)
            stack[-1].parts.append(node)
        if not alone:
            stack.append(node)
        if tag in RAW and not alone:  # its contents are not markup
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else n
            stack.pop()
    return _without_named(root)


def _without_named(root: Node) -> Node:
    """Take off the elements named boilerplate, but for those with more than half of the page's text outside links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if node.tag != "a":
            todo += [p for p in node.parts if isinstance(p, Node)]
    if not any(x.named for x in order):
        return root
    for node in reversed(order):
        if node.tag != "a":
            node.chars = sum(p.chars if isinstance(p, Node) else len(SPACE.sub("", p)) for p in node.parts)
    most = root.chars / 2
    for node in order:
        parts, node.parts = node.parts, []
        for p in parts:
            if not isinstance(p, Node) or not p.named or p.chars > most:
                node.parts.append(p)
            elif node.parts:
                node.parts.append(Node("hr"))
    for node in order:
        node.chars = 0
    return root


def _close(stack: list, tags, stop) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in stop:
            return


def measure(root: Node) -> list[Node]:
    """Fill in the counts and densities of all nodes; returns them children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    order.reverse()
    for node in order:
        for p in node.parts:
            if isinstance(p, Node):
                node.chars += p.chars
                node.tags += p.tags + (p.tag in BLOCK or p.tag == "a")
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
            else:
                node.chars += len(SPACE.sub("", p))
        if node.tag == "a":
            node.link_chars = node.chars
    body = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
            base = math.log(c * lc / max(c - lc, 1) + body * c + math.e)
            node.density = c / t * math.log(max(c * t / (max(lc, 1) * lt), 1.0)) / max(math.log(max(base, 1.0)), 1.0)
        node.total = sum(p.density if p.tag in BLOCK else p.total for p in node.parts if isinstance(p, Node))
    return order


def main_node(root: Node) -> Node:
    order = measure(root)
    lead = max((x for x in order if x.tag in BLOCK), key=lambda x: x.total)  # of equal sums the first child-first, hence the innermost
    if not lead.total:
        return root
    above = {id(p): node for node in order for p in node.parts if isinstance(p, Node)}
    path = [lead]
    while id(path[-1]) in above:
        path.append(above[id(path[-1])])
    least = min(x.density for x in path)
    top = lead
    for child, node in zip(path, path[1:]):
        if any(isinstance(p, Node) and p is not child and p.density >= least for p in node.parts):
            top = node
    return top


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space collapsed, references decoded."""
    out, run = [], []

    def flush():
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo = [node]
    while todo:
        p = todo.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            run.append(p)
        else:
            inner = [*reversed(p.parts)]
            if p.tag in BLOCK:
                flush()
                inner = [None, *inner]
            todo += inner
    flush()
    return out


def main_text(page: str) -> str:
    return "\n".join(blocks_of(main_node(parse(page)))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``.

    ``text`` holds the main text, empty if there is none; n_chars its code points.  A null html counts as empty, null ids
    and addresses stay, repeated rows are all returned, other columns are not read, an empty table gives an empty one.
    Pages cut off inside a tag, a comment or a reference are read up to there.
    """
    def step(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(step, f"page_id {kind}, url string, text string, n_chars bigint")
