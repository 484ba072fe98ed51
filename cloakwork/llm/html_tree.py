"""From HTML to block trees: a forgiving parser and the features of its nodes.

Only blocks become nodes; inline markup is part of its block's text. Each run of
inline content between two block boundaries is a leaf. Elements without readable
text (scripts, styles, controls between blocks) are left out with all they hold. End tags may be
missing or misplaced and a page may break off anywhere.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTES = re.compile(r"""(class|id|role|itemprop|aria-label|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = frozenset("script style textarea title iframe noembed noframes".split())
DROPPED = frozenset("head noscript template svg datalist".split())
#: Controls: left out where they stand between blocks, kept within a block's running text.
CONTROLS = frozenset("button select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAGS = (
    *"html body main article section div header footer nav aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6".split(),
    *"blockquote pre figure figcaption table thead tbody tfoot tr td th caption address details summary fieldset dialog menu search center".split(),
)
BLOCKS = frozenset(TAGS)
#: An open element that a start tag of the same family closes, and where the search for it ends.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words in class, id, role and the like.
HINTS = {
    "content": "article content post entry story body main text prose page blogpost articlebody",
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs toc toolbar skip links",
    "head": "header masthead topbar logo branding hero head",
    "foot": "footer copyright legal colophon foot contentinfo bottom imprint",
    "side": "sidebar side aside related recommended trending popular widget more complementary tags archive recent",
    "advert": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion affiliate dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast announcement warning dialog",
    "comments": "comment comments reply replies respond disqus discussion feedback reader reviews commentlist",
    "form": "form search subscribe newsletter signup login contact share social sharing follow",
}
HINT_OF = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
TAG_OF = {tag: k for k, tag in enumerate(TAGS)}
LEAF, OTHER = len(TAGS), len(TAGS) + 1
#: Pair potentials differ by the child's group.
GROUPS = {tag: 1 for tag in TAGS} | {t: 2 for t in "nav footer aside form header".split()} | {t: 3 for t in "h1 h2 h3 h4 h5 h6 p blockquote pre".split()} | {t: 4 for t in "ul ol li dl dt dd table tr td th tbody".split()}
N_GROUPS = 5
N_DENSE = 12
N_FEATURES = 1 + (OTHER + 1) + len(HINTS) + N_DENSE


@dataclass
class Forest:
    """The nodes of several pages, each page's in page order; a parent comes before its children.

    ``labelled``: take ``data-label`` of drawn training pages as a label; elsewhere it is an attribute like any other.
    """

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # the node after the last below this one
    tag: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)  # a bit for each kind of HINTS
    linked: list[int] = field(default_factory=list)  # characters within links
    label: list[int] = field(default_factory=list)  # -1: none given
    text: list[str] = field(default_factory=list)  # of leaves
    pages: int = 0
    labelled: bool = False

    def _add(self, parent: int, tag: int, group: int, hints: int, label: int, text: str = "", linked: int = 0) -> int:
        at = len(self.page)
        self.page.append(self.pages)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(at + 1)
        self.tag.append(tag)
        self.group.append(group)
        self.hints.append(hints)
        self.linked.append(linked)
        self.label.append(label)
        self.text.append(text)
        return at

    def add_page(self, source: str) -> None:
        """Parse one more page."""
        root = self._add(-1, TAG_OF["html"], 1, 0, -1)
        stack: list[tuple[str, int]] = [("html", root)]
        run: list[str] = []
        dropped, depth_dropped, in_link, linked, at = "", 0, False, 0, 0
        lower_source = ""

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    top = stack[-1][1]
                    self._add(top, LEAF, 0, 0, self.label[top], text, min(linked, len(text)))
                run.clear()
            linked = 0

        def close(k: int) -> None:
            nonlocal in_link
            while len(stack) > k:
                self.end[stack.pop()[1]] = len(self.page)
            in_link = False

        position, size = 0, len(source)
        while position <= size:
            found = TAG.search(source, position)
            start = found.start() if found else size
            if start > at and not dropped:
                piece = source[at:start]
                if "&" in piece:
                    piece = html.unescape(piece)
                run.append(piece)
                if in_link:
                    linked += len(piece)
            if not found:
                break
            position = at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if not closing and name in RAW:
                lower_source = lower_source or source.lower()
                end = lower_source.find(f"</{name}", position)
                position = at = end if end >= 0 else size
                continue
            if dropped:
                if name == dropped:
                    depth_dropped += -1 if closing else 1
                    if not depth_dropped:
                        dropped = ""
                elif dropped == "head" and (name == "body" or name in BLOCKS and not closing and name != "html"):
                    dropped = ""  # a head that nobody closed
                if dropped or name == "head" or closing:
                    continue
            if name in DROPPED or name in CONTROLS and not any(map(str.strip, run)):
                if not closing and not attributes.endswith("/"):
                    dropped, depth_dropped = name, 1
                continue
            if name == "br" or name == "hr":
                run.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in VOID:
                continue
            if name == "a":
                in_link = not closing
                continue
            if name not in BLOCKS and "-" not in name:
                continue  # inline
            flush()
            if closing:
                if name not in ("body", "html"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            close(k)
                            break
                continue
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in ("html", "body") and any(x[0] == name for x in stack[:2]):
                continue
            if name in SIBLINGS:
                own, ends = SIBLINGS[name]
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in ends:
                    if stack[k][0] in own:
                        close(k)
                    k -= 1
            elif name[0] == "h" and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and len(name) == 2:
                close(len(stack) - 1)
            hints, label, parent = 0, self.label[stack[-1][1]], stack[-1][1]
            if "=" in attributes:
                for key, value in ATTRIBUTES.findall(attributes):
                    value = value.strip("\"'")
                    key = key.lower()
                    if key == "data-label":
                        if self.labelled:
                            label = int(value)
                        continue
                    for word in WORD.findall(value):
                        kind = HINT_OF.get(word.lower())
                        if kind is not None:
                            hints |= 1 << kind
            stack.append((name, self._add(parent, TAG_OF.get(name, OTHER), GROUPS.get(name, 1), hints, label)))
        flush()
        close(0)
        self.pages += 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        """parent, depth and group of each node, and its features."""
        n = len(self.page)
        parent, depth, end, tag, group, hints, page = (np.array(x, np.int64) for x in (self.parent, self.depth, self.end, self.tag, self.group, self.hints, self.page))
        chars = np.fromiter(map(len, self.text), np.float64, n)
        words = np.fromiter((t.count(" ") + 1 if t else 0 for t in self.text), np.float64, n)
        stops = np.fromiter((t.count(". ") + t.count(", ") + (t[-1:] in ".!?:\"'") if t else 0 for t in self.text), np.float64, n)
        signs = np.fromiter(("©" in t if t else False for t in self.text), np.float64, n)
        own = np.stack([chars, words, stops, signs, np.array(self.linked, np.float64), (chars > 0).astype(float)])
        before = np.concatenate([np.zeros((6, 1)), np.cumsum(own, axis=1)], axis=1)
        c, w, s, g, linked, leaves = before[:, end] - before[:, :-1]
        first = np.searchsorted(page, np.arange(self.pages))
        total = np.maximum(1.0, c[first])[page]
        seen = (before[0, :-1] - before[0, first][page]) / total
        some = np.maximum(1.0, c)
        dense = np.stack([
            np.log1p(c) / 8, linked / some, s / np.maximum(1.0, w) * 8, c / total, seen, np.minimum(1.0, seen + c / total) > 0.98, w / np.maximum(1.0, leaves) / 40,
            g / np.maximum(1.0, leaves), np.log1p(leaves) / 5, np.minimum(depth, 20) / 10, (c == 0).astype(float), (chars > 0) * (stops == 0),
        ], axis=1)
        # Paragraphs, list parts and leaves go with what holds them: of these figures only length, links and signs are their own.
        dense[np.isin(group, (0, 3, 4))[:, None] & ~np.isin(np.arange(N_DENSE), (0, 1, 7))[None, :]] = 0
        features = np.zeros((n, N_FEATURES))
        features[:, 0] = 1
        features[np.arange(n), 1 + tag] = 1
        for k in range(len(HINTS)):
            features[:, 2 + OTHER + k] = (hints >> k) & 1
        features[:, -N_DENSE:] = dense
        return parent, depth, group, features
