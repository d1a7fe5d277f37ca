"""A tolerant tree of HTML blocks: block elements, and runs of inline text between them."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "head", "title", "svg", "iframe", "canvas", "select", "textarea", "audio", "video", "map",
          "datalist"}
# All that can stand in a head; any other start tag, or text, ends it as in HTML parsers.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template"}
MATH = {"math", "semantics", "annotation", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup",
        "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd", "mspace", "mpadded",
        "mphantom", "menclose", "mstyle", "merror", "maction", "mglyph", "maligngroup", "malignmark"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", *MATH, "button", "tt", "u", "var", "wbr", "input", "output", "meter", "progress", "picture", "source"}
# What a start tag closes if it is open, up to the nearest element of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, set())}


class Node:
    """A block element, or ``#text``: a run of inline content that stands among blocks or fills one."""

    __slots__ = ("tag", "words", "parent", "children", "text", "linked", "depth", "hidden", "mark")

    def __init__(self, tag: str, parent: "Node | None", words: list[str] = (), hidden: bool = False, mark: str = ""):
        self.tag, self.parent, self.words, self.hidden, self.mark = tag, parent, list(words), hidden, mark
        self.children: list[Node] = []
        self.text: list[str] = []
        self.linked = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def attribute_words(attributes) -> tuple[list[str], bool, str]:
    """Lower-case words of class, id, role and the like; whether the element is hidden; the mark of a page made to learn from."""
    words, hidden, mark = [], False, ""
    for name, value in attributes:
        value = value or ""
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component", "name"):
            word = ""
            for c in value + " ":
                if c.isalpha() and not (c.isupper() and word and word[-1].islower()):
                    word += c
                else:
                    if word:
                        words.append(word.lower())
                    word = c if c.isalpha() else ""
        elif name == "data-part":
            mark = value
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return words, hidden, mark


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.open: list[tuple[str, Node | None]] = [("#root", self.root)]  # None: an inline or silent element
        self.silent = 0
        self.links = 0
        self.run: Node | None = None

    def _block(self) -> Node:
        return next(n for _, n in reversed(self.open) if n is not None)

    def _pop(self, size: int) -> None:
        while len(self.open) > size:
            tag, node = self.open.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if node is not None:
                self.run = None

    def handle_starttag(self, tag, attributes):
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        if self.silent:
            if tag not in VOID and not (tag == "body" and self.open[-1][0] in ("head", "title")):
                self.open.append((tag, None))
                self.silent += tag in SILENT
                self.links += tag == "a"
                return
            if tag in VOID:
                return
        if tag not in INLINE and tag not in SILENT:
            self.run = None
            if tag in CLOSES:
                closed, limit = CLOSES[tag]
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] in limit:
                        break
                    if self.open[i][0] in closed:
                        self._pop(i)
                        if tag in ("li", "dt", "dd", "td", "th", "option"):
                            break
            # A paragraph holds no blocks: it ends here, with the inline elements in it.
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == "p":
                    self._pop(i)
                    break
                if self.open[i][1] is not None:
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        if tag in INLINE or tag in SILENT:
            self.open.append((tag, None))
        else:
            self.open.append((tag, Node(tag, self._block(), *attribute_words(attributes))))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            # An inline end tag does not reach out of its block, nor any end tag out of a cell.
            if (tag in INLINE and self.open[i][1] is not None) or (self.open[i][0] in ("td", "th") and tag not in (
                    "tr", "table", "tbody", "thead", "tfoot", "body", "html")):
                return

    def handle_data(self, data):
        if self.open[-1][0] == "head" and not data.isspace():
            self._pop(len(self.open) - 1)
        if self.silent or not data:
            return
        if self.run is None:
            if data.isspace():
                return
            self.run = Node("#text", self._block())
        self.run.text.append(data)
        if self.links:
            self.run.linked += len(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children, in the order of the page."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out
