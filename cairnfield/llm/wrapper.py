"""Main-text extraction by wrapper induction over pages of one host.

Every page is parsed into a small tree of block nodes. For each host a few pages with open text serve as references:
one (the smallest id) for each of the host's ``REFERENCES`` most frequent layouts, a layout being a set of block labels.
Every page of the host is aligned with each of them by simple tree matching. A text node of a reference that nearly
all aligned, differing pages repeat word for word is constant, and so are the nodes of other pages that are aligned with it
and repeat it; the same words elsewhere on a page do not count. Nodes whose text varies are slots. The content region of a page
is its main element, or else the smallest subtree that holds most of the text of its slots (``content_region``): what stands there
is content, constant or not (sub-headings, standing lines, paragraphs that two versions share). Constant nodes outside it are
the host's template and go. A page to which they would leave less than 1 / n of its text (a tenth where n pages agree and n is over ten) is a copy
of the reference, not a filled template, and keeps them. Two differing pages are enough; more agreement is asked of few pages
(``same / (n + 1)`` at least ``SURE``).

Before the alignment, elements whose meaning is fixed are closed (navigation, footer, aside, hidden ones, form controls). Others
are suspects: forms, and containers whose class or id names a known kind of boilerplate. A suspect goes unless it holds the
page's main element or first heading, or more text than all the rest where the rest has neither; suspects around it that stay are no
part of that rest, but one of another name inside them needs a fifth of their text too. Outside the main element, three or more
blocks in a row that are links go as a menu, unless paragraphs before and after them stand in the same container. The page's header goes,
but for the first heading of a page without a main element. The main element decides alone if it holds half of the open text; else article
elements with less than a fifth of it are teasers. What is left open is then aligned.

The matching is the largest one at any size of the trees. Equal subtrees are weighed once; long lists of children keep about the square
root of their rows for tracing back, so their memory grows with the power 1.5 of their length, and their time with its square.

Only tree shapes, hashes and node numbers are shuffled for the alignment, never texts; statistics are counted for each host
and node over all pages, so a host with a third of all pages is summed before it is shuffled. Pages with the same blocks
count once, or else a host that serves one article many times would lose it as constant.

Defined cases: null html counts as empty and gives text ''; a null or odd url is a host of its own; repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm.common import lean_batches, materialize, small

MIN_PAGES = 2
CONSTANT_SHARE, SURE = 0.9, 0.66
#: Most reference pages of a host; each costs one more alignment of every page.
REFERENCES = 8
#: Pages of a host with over 1 / HOT_HOSTS of all pages are dealt to SALTS tasks, each with its own copy of the reference.
HOT_HOSTS, SALTS = 250, 64
#: Two lists of children whose lengths multiply to more are aligned by rows of arrays, with the same result.
LOOP_CELLS = 2_000
#: Words of a paragraph that shows that a list of links beside it belongs to the text.
PARAGRAPH = 10
#: The content region holds this share of the text that varies from page to page.
REGION_SHARE = 0.6
#: Bits of the rows that are kept to trace such a sequence; longer pairs of lists are halved first.
ROW_BITS = 8_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_HAS_MAIN = re.compile(r"<(?:main|article)\b|role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "noframes")}

# Element names of the HTML standard, by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CELL = frozenset(("td", "th"))
_DROP = frozenset("head nav footer aside button select option menu dialog input canvas video audio map".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
_SELF_NEST = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "thead": ("table",)}
_SIBLINGS = {"td": ("th",), "th": ("td",), "dt": ("dd",), "dd": ("dt",)}
# Names of boilerplate, and of the parts that such a name may be followed by in one token.
_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner navbar nav navigation menu breadcrumb breadcrumbs sidebar side footer masthead siteheader pageheader cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies widget widgets pagination pager toolbar search skip copyright legal disclaimer tags rail teaser teasers card cards outbrain taboola".split()
)
_PARTS = frozenset("list box wrapper wrap container block area section item items inner left right top bottom bar links link menu slot unit content body text title widget panel group row header footer col icon thread form card meta author count 1 2 3".split())
_NEGATED = frozenset("no has with without not".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())


#: Start tags judged before; pages of a host repeat theirs.
_JUDGED: dict[tuple[str, str, bool, bool], tuple[str, bool, bool, bool, bool]] = {}


class _Node:
    __slots__ = ("tag", "label", "drop", "closed", "main", "suspect", "article", "parts", "linked")

    def __init__(self, tag: str, label: str, drop: bool, main: bool, suspect: int, article: int, closed: bool = False):
        # ``suspect``: number of the innermost suspect around, ``article``: of the outermost article; 0 without one.
        # ``closed``: by the element itself, not by what it stands in.
        self.tag, self.label, self.drop, self.closed, self.main, self.suspect, self.article = tag, label, drop, closed, main, suspect, article
        self.parts: list[str] = []
        self.linked = 0


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for m in _ATTR.finditer(raw):
        found.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    return found


def _named(names: str) -> bool:
    """A token names boilerplate by itself, by its last part (site-nav), or by its first before a usual part (comment-list)."""
    for token in names.lower().split():
        parts = re.split(r"[_-]+", token.strip("_-"))
        if parts[0] in _NEGATED:
            continue
        if "".join(parts) in _NAMES or parts[-1] in _NAMES or (parts[0] in _NAMES and all(p in _PARTS for p in parts[1:])) or (parts[-1] == "header" and parts[0] in ("site", "page")):
            return True
    return False


def _judge(tag: str, raw: str, dropped: bool, inside: bool) -> tuple[str, bool, bool, bool, bool]:
    """Label, whether its text goes, whether it is inside the main element, whether it is a suspect, and whether it closes itself, of a start tag below such a parent."""
    key = (tag, raw, dropped, inside)
    if key in _JUDGED:
        return _JUDGED[key]
    if len(_JUDGED) > 4096:
        _JUDGED.clear()
    attrs = _attributes(raw) if raw.strip(" /\n\t") else {}
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    main = inside or tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
    closed = hidden or tag in _DROP or (attrs.get("role", "") in _ROLES and tag != "form")
    # The page's header goes; an article's own header holds its title and stays.
    drop = dropped or closed or (tag == "header" and not inside)
    # Names say something on elements below the root only.
    suspect = tag == "form" or (tag not in ("html", "body", "main") and _named(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
    _JUDGED[key] = (f"{tag}.{attrs['class'].strip().lower()}" if attrs.get("class") else tag, drop, main, suspect, closed)
    return _JUDGED[key]


def _parents(depths: list[int]) -> list[int]:
    """The number of the block around each block, -1 at the root."""
    out, path = [], []
    for i, d in enumerate(depths):
        while path and depths[path[-1]] >= d:
            path.pop()
        out.append(path[-1] if path else -1)
        path.append(i)
    return out


def _within_text(run: list[int], parents: list[int], mass: list[int], free: list[bool]) -> bool:
    """A list of links stands in the text, not in the page's frame, if paragraphs before and after it share its container."""
    flanks = []
    for step, at in ((-1, run[0] - 1), (1, run[-1] + 1)):
        while 0 <= at < len(mass) and not free[at]:
            at += step
        if not 0 <= at < len(mass) or mass[at] < PARAGRAPH:
            return False
        flanks.append(at)
    box, above = parents[flanks[0]], parents[run[0]]
    while above > box:
        above = parents[above]
    return box == above == parents[flanks[1]]


def _decide(nodes: list[tuple[_Node, str]], outer: dict[int, int], names: dict[int, str], depths: list[int]) -> list[bool]:
    """Whether the text of each block is open: not closed by element, suspect, menu or teaser. ``outer``: the suspect around each suspect."""
    mass = [len(text.split()) if text and not node.drop else 0 for node, text in nodes]
    heading = next((i for i, (node, _) in enumerate(nodes) if node.tag == "h1" and mass[i]), None)
    best = [bool(m) and (node.main or i == heading) for i, ((node, _), m) in enumerate(zip(nodes, mass, strict=True))]
    own, held, chief = dict.fromkeys([0, *outer], 0), dict.fromkeys([0, *outer], 0), set()
    far = dict.fromkeys([0, *outer], 0)  # greatest number of an article that holds main text; a suspect inside it is no part of the page's frame
    for (node, _), m, b in zip(nodes, mass, best, strict=True):
        own[node.suspect] += m
        held[node.suspect] += m
        if b:
            chief.add(node.suspect)
            far[node.suspect] = max(far[node.suspect], node.article or 1 << 60)
    for s in sorted(outer, reverse=True):  # inner ones have greater numbers
        held[outer[s]] += held[s]
        far[outer[s]] = max(far[outer[s]], far[s])
    around = {0: 0}  # text of the suspects around each suspect: no rival of it
    for s in sorted(outer):
        around[s] = around[outer[s]] + (own[outer[s]] if outer[s] else 0)
    cleared, rest, found = {0}, own[0], 0 in chief
    for s in sorted(outer, key=lambda s: (far[s] <= s, -held[s], s)):
        if found:
            break
        # Inside a suspect that was cleared, one of another name goes if it is but a small part.
        part = 4 * held[s] >= around[s] or names[s] == names.get(outer[s])
        if outer[s] in cleared and (far[s] > s or (part and held[s] > rest - around[s])):
            cleared.add(s)
            rest += own[s]
            found = s in chief
    free = [bool(m) and node.suspect in cleared for (node, _), m in zip(nodes, mass, strict=True)]
    # Menus: runs of blocks that are links.
    run: list[int] = []
    parents = _parents(depths)
    for i, (node, text) in enumerate([*nodes, (nodes[0][0], ".")]):
        if not text or i < len(nodes) and not free[i]:
            continue
        if i < len(nodes) and not node.main and node.linked * 5 >= 4 * len(text):
            run.append(i)
            continue
        if len(run) >= 3 and not _within_text(run, parents, mass, free):
            for k in run:
                free[k] = False
        run = []
    whole = sum(m for m, f in zip(mass, free, strict=True) if f)
    main = sum(mass[i] for i, (node, _) in enumerate(nodes) if free[i] and node.main)
    if 2 * main >= whole and main:
        return [f and node.main for f, (node, _) in zip(free, nodes, strict=True)]
    articles: Counter[int] = Counter()
    for i, (node, _) in enumerate(nodes):
        articles[node.article] += mass[i] * free[i]
    return [f and not (node.article and 5 * articles[node.article] < whole) for f, (node, _) in zip(free, nodes, strict=True)]


def parse(page: str) -> list[tuple[str, int, str, bool, bool]]:
    """Block nodes in page order: (label, depth, text, open, inside a main element)."""
    root = _Node("#", "#", False, False, 0, 0)
    stack = [root]
    open_tags: Counter[str] = Counter()  # so that no deep stack is searched for a tag that is not open
    at, end = 0, len(page)
    order: list[tuple[_Node, int]] = [(root, 0)]
    depth = 0
    holder = root  # the block that text goes to
    holders = [root]
    number = 0  # of elements, in page order
    outer: dict[int, int] = {}
    names: dict[int, str] = {0: ""}
    has_main = _HAS_MAIN.search(page) is not None

    def new_segment() -> None:
        """Text after a nested block, or of inline boilerplate, is a block of its own."""
        nonlocal holder
        top = stack[-1]
        node = _Node("#text", "#text", top.drop, top.main, top.suspect, top.article)
        order.append((node, depth + 1))
        holder = node

    def pop() -> None:
        nonlocal depth, holder
        gone = stack.pop()
        open_tags[gone.tag] -= 1
        if gone.tag in _BLOCK:
            holders.pop()
            depth -= 1
            holder = None

    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                top = stack[-1]
                if holder is None or holder.drop != top.drop or holder.suspect != top.suspect:
                    if not piece.strip():
                        if holder is not None:
                            holder.parts.append(" ")
                        continue
                    if not top.drop:
                        # Inline boilerplate (a link list in a span) is kept apart from the block around it, but not the words after it.
                        back = holders[-1]
                        if holder is not None and holder.tag == "#text" and back.drop == top.drop and back.suspect == top.suspect and order[-1][0] is holder:
                            holder = back
                        else:
                            new_segment()
                    else:
                        continue
                holder.parts.append(piece)
                if open_tags["a"]:
                    holder.linked += len(piece.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("br", "p") and not open_tags[tag]:
                if holder is not None:
                    holder.parts.append(" ")
                continue
            if open_tags[tag]:
                stop = ("table",) if tag in ("p", "li", "div", "span", "b", "i", "a") else ()
                k = len(stack) - 1
                while k and stack[k].tag != tag and stack[k].tag not in stop:
                    k -= 1
                if k and stack[k].tag == tag and (tag in _BLOCK or tag in _CELL or not any(n.tag in _BLOCK for n in stack[k + 1 :])):
                    while len(stack) > k:
                        pop()
            if tag in _CELL and holder is not None:
                holder.parts.append(" ")
            continue
        if tag in _RAW_END and not m[3].rstrip().endswith("/"):
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag in ("br", "hr", "img", "wbr"):
            if tag != "wbr" and holder is not None:
                holder.parts.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in ("table", "td", "th", "div", "li", "article", "section", "main", "body"):
                    break
        if tag in _SELF_NEST and any(open_tags[t] for t in (tag, *_SIBLINGS.get(tag, ()))):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in ("td", "th") and stack[k].tag in _CELL) or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")):
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in _SELF_NEST[tag]:
                    break
        top = stack[-1]
        label, drop, main, suspect, closed = _judge(tag, m[3], top.drop, top.main)
        # A label belongs to the controls of a form; elsewhere it is a word of the text.
        drop = drop or (tag == "label" and open_tags["form"] > 0)
        if tag == "h1" and drop and not has_main:
            # The title of a page without a main element may stand in the page's header.
            drop = closed or any(n.closed for n in stack)
        number += 1
        if suspect:
            outer[number], names[number] = top.suspect, label
        node = _Node(tag, label, drop, main, number if suspect else top.suspect, top.article or (number if tag == "article" else 0), closed)
        stack.append(node)
        open_tags[tag] += 1
        if tag in _BLOCK:
            depth += 1
            holders.append(node)
            order.append((node, depth))
            holder = node
        elif tag in _CELL and holder is not None:
            holder.parts.append(" ")
    nodes = [(node, " ".join(entities.unescape("".join(node.parts)).split()) if node.parts else "") for node, _ in order]
    live = _decide(nodes, outer, names, [d for _, d in order])
    return [(node.label, d, text, ok, node.main) for (node, text), (_, d), ok in zip(nodes, order, live, strict=True)]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if text else 0


def _tree(labels: list[str], depths: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in labels]
    path: list[int] = []
    for i, d in enumerate(depths):
        while path and depths[path[-1]] >= d:
            path.pop()
        if path:
            kids[path[-1]].append(i)
        path.append(i)
    return kids


def _subtrees(labels: list[str], kids: list[list[int]], known: dict[tuple[str, tuple[int, ...]], int]) -> list[int]:
    """A number for each node, the same for equal subtrees; ``known`` numbers them, smaller ones first."""
    out = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        out[i] = known.setdefault((labels[i], tuple(out[k] for k in kids[i])), len(known))
    return out


def _lcs_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each prefix of ``a``, bits over ``b``: bit j is 0 where the longest common sequence grows with b[j]."""
    places: dict[str, list[int]] = {label: [] for label in set(a)}
    for j, label in enumerate(b):
        if label in places:
            places[label].append(j)
    at: dict[str, int] = {}
    full = (1 << len(b)) - 1
    row = full
    for label in a:
        if label not in at:
            if len(at) * len(b) > ROW_BITS:
                at.clear()
            bits = bytearray(len(b) // 8 + 1)
            for j in places[label]:
                bits[j // 8] |= 1 << j % 8
            at[label] = int.from_bytes(bits, "little")
        hit = row & at[label]
        row = ((row + hit) | (row - hit)) & full
        yield row


def _growth(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common sequence of ``a`` and each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _lcs_rows(a, b):  # noqa: B007  the last row counts
        pass
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def common_sequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of two lists of labels, in bit-parallel time and bounded memory besides the lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if (k - i) * (m - j) > ROW_BITS and k - i > 1:
            half = (i + k) // 2
            before, after = _growth(a[i:half], b[j:m]), _growth(a[half:k][::-1], b[j:m][::-1])
            cut = j + max(range(m - j + 1), key=lambda x: before[x] + after[m - j - x])
            todo += [(i, half, j, cut), (half, k, cut, m)]
            continue
        rows = list(_lcs_rows(a[i:k], b[j:m]))
        x, y = k - i, m - j
        while x and y:
            if rows[x - 1] >> (y - 1) & 1:
                y -= 1
            elif x > 1 and not rows[x - 2] >> (y - 1) & 1:
                x -= 1
            else:
                x, y = x - 1, y - 1
                out.append((i + x, j + y))
    return sorted(out)


def _heaviest(a: tuple[int, ...], b: tuple[int, ...], made: list, weight: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """Weight and places of the heaviest common sequence of two lists of subtrees; of several it gives the one that tracing back finds
    when it leaves out the last of ``a`` first. Long lists go by rows of arrays, which take the same steps."""
    i, j, found = len(a), len(b), []
    if i * j <= LOOP_CELLS:
        w = [[0] * (j + 1) for _ in range(i + 1)]
        named = [made[q][0] for q in b]
        for x, p in enumerate(a, 1):
            row, above, label = w[x], w[x - 1], made[p][0]
            for y, name in enumerate(named, 1):
                best = above[y] if above[y] >= row[y - 1] else row[y - 1]
                if label == name:
                    with_pair = above[y - 1] + weight.get((p, b[y - 1]), 1)
                    if with_pair > best:
                        best = with_pair
                row[y] = best
        total = w[-1][-1]
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return total, found
    kinds, code = np.unique(np.array(b, np.int64), return_inverse=True)
    alike: dict[str, list[int]] = {}
    for k, q in enumerate(kinds.tolist()):
        alike.setdefault(made[q][0], []).append(k)

    def below(above: np.ndarray, p: int) -> np.ndarray:
        gain = np.zeros(len(kinds), np.int64)
        for k in alike.get(made[p][0], ()):
            gain[k] = weight.get((p, int(kinds[k])), 1)
        row = above.copy()
        np.maximum(row[1:], above[:-1] + gain[code], out=row[1:])
        return np.maximum.accumulate(row)

    # Every step-th row is kept; the rows between two of them are made again where the trace passes.
    step = math.isqrt(i) + 1
    marks, row = {}, np.zeros(j + 1, np.int64)
    for x, p in enumerate(a):
        if x % step == 0:
            marks[x] = row
        row = below(row, p)
    total = int(row[-1])
    while i and j:
        start = (i - 1) // step * step
        rows = [marks[start]]
        for p in a[start:i]:
            rows.append(below(rows[-1], p))
        while i > start and j:
            here, above = rows[i - start], rows[i - start - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
    return total, found


def simple_tree_matching(labels_a: list[str], depths_a: list[int], labels_b: list[str], depths_b: list[int]) -> dict[int, int]:
    """The largest order-preserving matching of two trees that maps roots to roots and children to children, a to b."""
    if not labels_a or not labels_b or labels_a[0] != labels_b[0]:
        return {}
    kids_a, kids_b = _tree(labels_a, depths_a), _tree(labels_b, depths_b)
    inner: dict[tuple[int, int], list[tuple[int, int]]] = {}
    # Equal subtrees are weighed once. No recursion, as pages nest deeply: subtrees below have smaller numbers.
    known: dict[tuple[str, tuple[int, ...]], int] = {}
    of_a, of_b = _subtrees(labels_a, kids_a, known), _subtrees(labels_b, kids_b, known)
    made = list(known)
    pairs, order = {(of_a[0], of_b[0])}, [(of_a[0], of_b[0])]
    for x, y in order:
        inside: dict[str, set[int]] = {}
        for q in made[y][1]:
            if made[q][1]:
                inside.setdefault(made[q][0], set()).add(q)
        for p in set(made[x][1]):
            for q in inside.get(made[p][0], ()) if made[p][1] else ():
                if (p, q) not in pairs:
                    pairs.add((p, q))
                    order.append((p, q))
    weight: dict[tuple[int, int], int] = {}
    sizes: list[int] = []
    for _, below in made:
        sizes.append(1 + sum(sizes[k] for k in below))
    for x, y in sorted(order):
        a, b = made[x][1], made[y][1]
        # No matching gains by pairing equal subtrees at the front otherwise.
        front = 0
        while front < min(len(a), len(b)) and a[front] == b[front]:
            front += 1
        found = [(i, i) for i in range(front)]
        weight[x, y] = 1 + sum(sizes[k] for k in a[:front])
        more, rest = _heaviest(a[front:], b[front:], made, weight)
        weight[x, y] += more
        inner[x, y] = found + [(front + i, front + j) for i, j in rest]

    matched, todo = {0: 0}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        a, b = kids_a[x], kids_b[y]
        if a and b:
            for i, j in inner[of_a[x], of_b[y]]:
                matched[a[i]] = b[j]
                todo.append((a[i], b[j]))
    return matched


_BLOCKS_SQL = "page_id {id}, url string, host string, labels array<string>, depths array<int>, hashes array<bigint>, open array<boolean>, inner array<boolean>, texts array<string>"


def _host(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else (url or "")


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("host", "labels", "depths", "hashes", "open", "inner", "texts")}
        for url, page in zip(batch.column(1), batch.column(2), strict=True):
            nodes = parse(page.as_py() or "")
            live = [n[3] for n in nodes]
            cols["host"].append(_host(url.as_py()))
            cols["labels"].append([n[0] for n in nodes])
            cols["depths"].append([n[1] for n in nodes])
            cols["hashes"].append([_hash(n[2]) for n in nodes])
            cols["open"].append(live)
            cols["inner"].append([n[4] for n in nodes])
            cols["texts"].append([n[2] for n, ok in zip(nodes, live, strict=True) if ok])
        types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.string()))
        arrays = [pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["page_id", "url", *cols])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and reference: aligned open nodes that repeat the reference's text (theirs and the page's number), and others (theirs)."""
    host, refs = None, []
    for batch in batches:
        out: dict[str, list] = {"host": [], "page": [], "no": [], "same": [], "at": [], "other": []}
        given = batch.column(batch.schema.get_field_index("refs"))
        for i, r in enumerate(batch.drop_columns("refs").to_pylist()):
            if not refs or r["host"] != host:
                host, refs = r["host"], given[i].as_py()
            for no, ref in enumerate(refs):
                matched = simple_tree_matching(r["labels"], r["depths"], ref["labels"], ref["depths"])
                pairs = [(y, x, r["hashes"][x] == ref["hashes"][y]) for x, y in matched.items() if ref["open"][y] and r["open"][x]]
                out["host"].append(host)
                out["page"].append(r["page"])
                out["no"].append(no)
                out["same"].append([y for y, _, same in pairs if same])
                out["at"].append([x for _, x, same in pairs if same])
                out["other"].append([y for y, _, same in pairs if not same])
        types = (pa.string(), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


_PAGE = "xxhash64(to_json(hashes))"


def references(different: DataFrame, min_pages: int = MIN_PAGES, most: int = REFERENCES) -> DataFrame:
    """(host, refs): a page with open text of each of the most frequent layouts of every host with enough such pages."""
    layout = F.xxhash64(F.array_sort(F.array_distinct("labels")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "page")).alias("first")
    layouts = different.where(F.exists("open", lambda x: x)).groupBy("host", layout.alias("layout")).agg(F.count("*").alias("n"), first)
    enough = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).select(F.col("host").alias("h2"))
    # The best of each part of a host's layouts first, then the best of these: as many layouts as pages meet in no task.
    order = [F.desc("n"), F.asc("first")]
    some = layouts.withColumn("part", F.pmod(F.xxhash64("layout"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("host", "part").orderBy(*order))).where(F.col("rank") <= most)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("rank") <= most).join(enough, F.col("host") == F.col("h2"))
    chosen = small(materialize(top.select(F.col("host").alias("_host"), F.col("first.page").alias("_page"), "rank"), "chosen"), 20_000)
    found = different.join(chosen, (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page")))
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "labels", "depths", "hashes", "open"))).alias("refs"))


def _hot_hosts(pages: DataFrame) -> list[str]:
    """Hosts with over 1 / HOT_HOSTS of the pages; there are fewer than HOT_HOSTS of them, whatever the input."""
    n = pages.count()
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    return [r["host"] for r in counts.where(F.col("n") * HOT_HOSTS > n).select("host").collect()]


def templates(blocks: DataFrame, min_pages: int = MIN_PAGES, share: float = CONSTANT_SHARE) -> DataFrame:
    """(host, page, template, pages): numbers of the nodes of each different page that belong to its host's template, and how many pages agree."""
    shape = blocks.select("page_id", "host", "labels", "depths", "hashes", "open")
    different = shape.groupBy("host", F.expr(_PAGE).alias("page")).agg(F.min_by(F.struct("labels", "depths", "hashes", "open"), F.struct(F.col("page_id").isNull(), "page_id")).alias("p"), F.min("page_id").alias("page_id"))
    different = materialize(different.select("host", "page", "page_id", "p.*"), "shapes")
    refs = references(different, min_pages)
    hot = _hot_hosts(different)
    salt = F.when(F.col("host").isin(hot), F.pmod(F.xxhash64("page"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = different.withColumn("salt", salt).join(refs.withColumn("salt", F.explode(salts)), ["host", "salt"])
    aligned = spread.select("host", "page", "labels", "depths", "hashes", "open", "refs").mapInArrow(_align, "host string, page long, no int, same array<int>, at array<int>, other array<int>")
    aligned = materialize(aligned, "aligned")
    node = lambda c, same: F.transform(c, lambda y: F.struct(y.alias("y"), F.lit(same).alias("same")))
    told = aligned.select("host", "no", F.explode(F.concat(node("same", 1), node("other", 0))).alias("n")).groupBy("host", "no", "n.y").agg(F.sum("n.same").alias("same"), F.count("*").alias("n"))
    enough = (F.col("same") >= min_pages) & (F.col("same") >= share * F.col("n")) & (F.col("same") >= SURE * (F.col("n") + 1))
    constant = materialize(told.where(enough).groupBy("host", "no").agg(F.collect_set("y").alias("constant"), F.max("n").alias("n")), "constant")
    known = small(constant.select(F.col("host").alias("_host"), F.col("no").alias("_no"), "constant", "n"), 20_000)
    found = aligned.where(F.size("same") > 0).join(known, (F.col("host") == F.col("_host")) & (F.col("no") == F.col("_no")))
    mine = F.transform(F.filter(F.arrays_zip("same", "at"), lambda z: F.array_contains("constant", z["same"])), lambda z: z["at"])
    return found.select("host", "page", "n", F.explode(mine).alias("x")).groupBy("host", "page").agg(F.collect_set("x").alias("template"), F.max("n").alias("pages"))


def content_region(depths: list[int], sizes: list[int], varying: list[bool]) -> tuple[int, int]:
    """First and last block of the smallest subtree that holds REGION_SHARE of the text that varies. If that is a single
    block, its container counts where another block varies in it. If it is the whole page, they are its first and last varying block.
    (0, -1) where nothing varies."""
    last, parents = list(range(len(depths))), _parents(depths)
    mass = [s if v else 0 for s, v in zip(sizes, varying, strict=True)]
    total = sum(mass)
    if not total:
        return 0, -1
    best = 0
    for i, p in reversed(list(enumerate(parents))):
        if mass[i] >= REGION_SHARE * total and (not best or last[i] - i < last[best] - best):
            best = i
        if p >= 0:
            mass[p] += mass[i]
            last[p] = max(last[p], last[i])
    whole = lambda k: not any(s for i, s in enumerate(sizes) if not k <= i <= last[k])
    box = best if last[best] > best else max(0, parents[best])
    places = [i for i, v in enumerate(varying) if v and box <= i <= last[box]]
    if whole(box) or (box != best and len(places) == 1):
        return places[0], places[-1]
    return box, last[box]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, depths, open, inner, texts, template, pages) to (page_id, url, text): template nodes outside the content region go."""
    for batch in batches:
        out = []
        for depths, live, inner, texts, template, pages in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
            if template and not all(i for i, ok in zip(inner, live, strict=True) if ok):
                at = [i for i, ok in enumerate(live) if ok]
                sizes = [0] * len(depths)
                for i, text in zip(at, texts, strict=True):
                    sizes[i] = len(text)
                same = set(template)
                lo, hi = content_region(depths, sizes, [ok and i not in same for i, ok in enumerate(live)])
                left = [text for i, text in zip(at, texts, strict=True) if i not in same or inner[i] or lo <= i <= hi]
                if min(pages, 10) * sum(map(len, left)) >= sum(map(len, texts)):
                    texts = left
            out.append("\n\n".join(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): blocks of the main text in page order, joined by two line feeds."""
    only = lean_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = only.schema["page_id"].dataType.simpleString()
    blocks = materialize(only.mapInArrow(_parse_pages, _BLOCKS_SQL.format(id=kind)), "blocks")
    found = materialize(templates(blocks), "templates").select(F.col("host").alias("_host"), F.col("page").alias("_page"), "template", "pages")
    live = blocks.withColumn("page", F.expr(_PAGE))
    joined = live.join(small(found, 20_000), (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page")), "left")
    return joined.select("page_id", "url", "depths", "open", "inner", "texts", "template", "pages").mapInArrow(_keep, f"page_id {kind}, url string, text string")


def op3_html(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
