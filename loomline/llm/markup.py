"""Markup in text documents: which kinds there are, and clean text with its structure.

A text is read as a tree of nodes: the page, the elements of its tags as they
nest (unclosed ones end as their names imply), the lines in them, and in the
lines the cues (stretches that look like markup). Each node has a hidden kind:
none, or one of the markup languages. Potentials tie the kind of a child to that
of its parent, by the type of the child, and a cue's kind to what is seen.
Sum-product messages go up to the page and down again; a cue whose marginal
favours a language is markup of it, and what is left is content. So an ambiguous
cue (a dash, a back-tick, an underline, a dollar sign) is decided by what
surrounds it.

The potentials are trained on pages of the corpus itself, labelled by the reader
that their file came through; a label is a soft observation of the page's kind,
pages without one take part with their kind open, and the messages give the
expected counts (expectation maximisation). A second pair of potentials on the
same elements, content or not, gives each element's content marginal; clean text
leaves out the elements that it is low for (navigation, scripts, link lists).

Code inside a code block is looked at as the block's, not for markup of its own.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import current, few_files, latest, states, table

KINDS = ("none", "html", "markdown", "wiki", "latex", "rest")
#: Texts without any of these characters or line starts have no cue at all.
TRIGGER = r"(?m)[<&*`#\[\]{}|\\~$=^]|^! |''|__|:[A-Za-z][\w:.-]*:|^[ \t]*(?:[-+>] |\.\. )|^[ \t]*([-=~^\"'+.:_*])\1{3,}[ \t]*$"

_TAGS = (
    "a abbr article aside audio b blockquote body br button caption center cite code col dd del details dfn div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav nobr ol option p pre q s samp script section "
    "select small span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
_TAG = "|".join(sorted(_TAGS, key=len, reverse=True))


def _c(p: str, flags: int = re.M) -> re.Pattern:
    return re.compile(p, flags)


#: Name, a string that any match holds (or None), pattern, and the groups of the pattern that are dropped from clean text.
CUES: tuple[tuple[str, str | None, re.Pattern, str], ...] = (
    ("comment", "<!--", _c(r"<!--.*?(?:-->|\Z)", re.S), "all"),
    ("tag", "<", _c(rf"</?(?:{_TAG})(?:\s[^<>]*)?/?>", re.I), "all"),
    ("other_angle", "<", _c(rf"<(?!/?(?:{_TAG})[\s/>])[A-Za-z][\w.:/-]*>", re.I), "keep"),
    ("entity", "&", _c(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), "entity"),
    ("hash_heading", "# ", _c(r"^(#{1,6} +)\S"), "groups"),
    ("fence", "```", _c(r"^[ \t]*(```+)[\w+-]*[ \t]*$"), "all"),
    ("tilde_fence", "~~~", _c(r"^(~~~)[\w+-]*$"), "all"),
    ("strong", "**", _c(r"(?<![\w*])(\*\*)(?=\S)[^*\n]+(?<=\S)(\*\*)(?!\*)|(\*\*)(?=[^\s\w*])[^*\n]+(?<=\S)(\*\*)|(?<=[^\x00-\x7f])(\*\*)(?=\S)[^*\n]+(\*\*)"), "groups"),
    ("emphasis", "*", _c(r"(?<![\w*\\])(\*)(?=[^\s*])[^*\n]*(?<=[^\s*])(\*)(?![\w*])"), "groups"),
    ("low_strong", "__", _c(r"(?<![\w])(__)(?=[^\s_])[^\n_]+(?<=[^\s_])(__)(?!\w)"), "groups"),
    ("tick", "`", _c(r"(?<![`:])(`)(?!`)[^`\n]+(`)(?![`_])"), "groups"),
    ("ticks", "``", _c(r"(?<!`)(``)(?!`)[^`\n]+(``)(?!`)"), "groups"),
    ("image", "![", _c(r"(!\[)[^\]\n]*(\]\([^)\n]*\))"), "groups"),
    ("link", "](", _c(r"(?<!!)(\[)[^\[\]\n]+(\]\([^()\s]+(?:\s[^()\n]*)?\))"), "groups"),
    ("ref_link", "]:", _c(r"^\[[^\]\n]+\]:\s+\S+"), "all"),
    ("task", "[", _c(r"^[ \t]*([-*+] \[[ xX]\] )"), "groups"),
    ("dash_item", None, _c(r"^[ \t]*([-+] +)(?!\[[ xX]\])\S"), "groups"),
    ("star_item", "* ", _c(r"^[ \t]*(\*+ +)(?!\[[ xX]\])\S"), "groups"),
    ("number_item", None, _c(r"^[ \t]*(\d{1,3}[.)] +)\S"), "keep"),
    ("quote", "> ", _c(r"^(> ?)+\S"), "groups"),
    ("pipe_row", "|", _c(r"^\|(?![-+}|]).*[^|\n]\|[ \t]*$"), "cells"),
    ("pipe_rule", "-|", _c(r"^\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$"), "all"),
    ("double_bracket", "[[", _c(r"(\[\[(?:[^\[\]\n|]*\|)?)[^\[\]\n|]+(\]\])"), "groups"),
    ("template", "{{", _c(r"\{\{[^{}\n]+\}\}"), "all"),
    ("quotes3", "'''", _c(r"(''')(?=[^'\s])[^\n]+?(''')"), "groups"),
    ("quotes2", "''", _c(r"(?<!')('')(?=[^'\s])[^'\n]+('')(?!')"), "groups"),
    ("equals_heading", "==", _c(r"^(={2,6}[ \t]*)[^=\n]+?([ \t]*={2,6})[ \t]*$"), "groups"),
    ("table_open", "{|", _c(r"^\{\|.*$"), "all"),
    ("table_close", "|}", _c(r"^\|\}[ \t]*$"), "all"),
    ("table_row", "|-", _c(r"^\|-(?!-*[-:| ]*\|).*$"), "all"),
    ("table_head", "!", _c(r"^! .*$"), "cells"),
    ("table_cells", "||", _c(r"^\|(?!\|).*\|\|.*$"), "cells"),
    ("outer_link", "[http", _c(r"(\[https?://\S+[ ])[^\]\n]+(\])"), "groups"),
    ("magic", "__", _c(r"__[A-Z]{3,}__|^#REDIRECT\b"), "all"),
    ("command", "\\", _c(r"(~?\\(?!begin\b|end\b)[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{)[^{}\n]*(\})"), "groups"),
    ("environment", "\\", _c(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*"), "all"),
    ("item", "\\item", _c(r"\\item\b[ \t]*"), "all"),
    ("display", "\\[", _c(r"(\\\[).*?(\\\])", re.S), "groups"),
    ("inline_paren", "\\(", _c(r"(\\\()[^\n]*?(\\\))"), "groups"),
    ("dollars", "$$", _c(r"(\$\$).+?(\$\$)", re.S), "groups"),
    ("dollar_math", "$", _c(r"(?<![\\$\w])(\$)(?=[^\s$])(?=[^$\n]*[\\^_{}=<>+])[^$\n]+(\$)(?![$\d])"), "groups"),
    ("dollar_plain", "$", _c(r"\$\d[\d.,]*"), "keep"),
    ("bare_command", "\\", _c(r"(?<![\w:\\])\\(?:maketitle|tableofcontents|noindent|clearpage|newpage|bigskip|medskip|smallskip|centering|par|LaTeX|TeX|ldots|dots|hline)\b"), "all"),
    ("path", "\\", _c(r"[A-Za-z]:\\[\w\\.-]+"), "keep"),
    ("directive", ".. ", _c(r"^[ \t]*\.\. [A-Za-z][\w:-]*::.*$"), "all"),
    ("target", ".. _", _c(r"^[ \t]*\.\. _[^:\n]+:.*$"), "all"),
    ("dot_comment", ".. ", _c(r"^\.\. (?!_|[A-Za-z][\w:-]*::)\S.*$"), "all"),
    ("option", ":", _c(r"^[ \t]+(:[a-z][\w-]*:).*$"), "all"),
    ("role", ":`", _c(r"(:[A-Za-z][\w:.+-]*:`)[^`\n]+(`)"), "groups"),
    ("tick_link", "`_", _c(r"(?<![`:\w])(`)[^`<\n]+((?: <[^>\n]+>)?`__?)(?!\w)"), "groups"),
    ("underline", None, _c(r"^[^\s|].*\n(([=~^\-\"'+.:_*#])\2{3,})[ \t]*$"), "groups"),
    ("lone_rule", None, _c(r"\A(([=~^\"'+.:_*])\2{3,})[ \t]*$"), "all"),
    ("note_ref", "]_", _c(r"\[(?:#|\d+|[A-Za-z]\w*)\]_(?!\w)"), "all"),
    ("comparison", None, _c(r"\s[<>]=?\s?[\d.]|(?<=\S)[ \t]==[ \t]|\s&\s"), "keep"),
    ("product", " * ", _c(r"\w \* \w"), "keep"),
)
NAMES = [c[0] for c in CUES]
_NUMBER = {n: k for k, n in enumerate(NAMES)}
_HEADINGS = {"hash_heading", "equals_heading", "underline"}
_LISTS = {"dash_item", "star_item", "task", "item"}
_TICKED = {"tick", "ticks", "tick_link", "role"}
_MATH = {"display", "inline_paren", "dollars", "dollar_math"}

#: Code blocks: what lies between the groups' ends is code.
_CODE = (
    re.compile(r"^[ \t]*```[^\n`]*\n(?P<code>.*?)(?:^[ \t]*```[ \t]*$|\Z)", re.M | re.S),
    re.compile(r"^~~~[\w+-]*\n(?P<code>.*?)^~~~[ \t]*$", re.M | re.S),
    re.compile(r"<(?P<t>pre|code|script|style|syntaxhighlight|source|nowiki)\b[^<>]*>(?P<code>.*?)(?:</(?P=t)>|\Z)", re.I | re.S),
    re.compile(r"^(?P<in>[ \t]*)(?:\.\. (?:code-block|code|sourcecode|highlight|parsed-literal|literalinclude)::[^\n]*|[^\n]*[^:\n]::)\n(?P<code>(?:[ \t]*\n|(?P=in)[ \t]+[^\n]*(?:\n|\Z))+)", re.M),
    re.compile(r"\\begin\{(?P<t>verbatim|lstlisting|minted)\}(?P<code>.*?)(?:\\end\{(?P=t)\}|\Z)", re.S),
)
_CODE_HINT = re.compile(r"```|~~~|<(?:pre|code|script|style|syn|source|nowiki)|::|\\begin\{(?:verb|lst|mint)", re.I)


def code_spans(text: str) -> list[tuple[int, int]]:
    """The places of code inside code blocks; the first block that opens wins."""
    if not _CODE_HINT.search(text):
        return []
    got = sorted(m.span("code") for p in _CODE for m in p.finditer(text))
    out: list[tuple[int, int]] = []
    for a, z in got:
        if z > a and (not out or a >= out[-1][1]):
            out.append((a, z))
    return out


def scan(text: str) -> list[tuple[int, int, int, re.Match]]:
    """Cues outside of code as (number, start, end, match), in order of their place."""
    hidden = code_spans(text)
    out = []
    for k, (_, hint, pattern, _how) in enumerate(CUES):
        if hint is not None and hint not in text:
            continue
        for m in pattern.finditer(text):
            a, z = m.span()
            if a == z or any(x < z and a < y and not (a < x and z > y) for x, y in hidden):
                continue
            out.append((k, a, z, m))
    out.sort(key=lambda c: (c[1], -c[2]))
    # back-ticks pair up from the left: what starts inside such a cue pairs its end with the next one's start
    kept, end = [], 0
    for c in out:
        if NAMES[c[0]] in _TICKED:
            if c[1] < end:
                continue
            end = c[2]
        kept.append(c)
    return kept


#: Tags without content of their own, and tags that end one of their name that is still open.
_VOID = frozenset("br col hr img input link meta wbr".split())
_IMPLIED = frozenset("p li td th tr dt dd option".split())
_TAG_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
#: Elements nest up to this depth in the tree; deeper ones are siblings at it.
DEEPEST = 64
PAGE, ELEMENT, LINE, CUE = range(4)


@dataclass
class Tree:
    """Nodes of some texts: parent (-1 for a page), type, depth, cue number (-1 for none), and for elements the tag's name, start and end in the text."""

    parent: list[int]
    kind: list[int]
    depth: list[int]
    cue: list[int]
    page: list[int]
    cues: list[list[tuple[int, int, int, re.Match]]]
    leaf: list[list[int]]
    element: dict[int, list]

    @classmethod
    def of(cls, texts: list[str]) -> Tree:
        t = cls([], [], [], [], [], [], [], {})
        for text in texts:
            t._add(text)
        return t

    def _node(self, parent: int, kind: int, cue: int = -1) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.cue.append(cue)
        return len(self.parent) - 1

    def _add(self, text: str) -> None:
        found = scan(text)
        root = self._node(-1, PAGE)
        self.page.append(root)
        self.cues.append(found)
        own: list[int] = []
        self.leaf.append(own)
        open_: list[tuple[str, int]] = []
        lines: dict[tuple[int, int], int] = {}
        line = at = 0
        for n, a, z, _m in found:
            line += text.count("\n", at, a)
            at = a
            top = open_[-1][1] if open_ else root
            tag = _TAG_NAME.match(text, a) if NAMES[n] == "tag" else None
            if tag:
                name = tag[2].lower()
                if tag[1]:
                    k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
                    if k is not None:
                        node = open_[k][1]
                        self.element[node][2] = z
                        del open_[k:]
                        own.append(self._node(node, CUE, n))
                        continue
                elif name not in _VOID and text[z - 2] != "/":
                    if name in _IMPLIED and open_ and open_[-1][0] == name:
                        self.element[open_.pop()[1]][2] = a
                        top = open_[-1][1] if open_ else root
                    if self.depth[top] >= DEEPEST:
                        top = self.parent[top]
                    node = self._node(top, ELEMENT)
                    self.element[node] = [name, a, len(text), len(self.page) - 1]
                    open_.append((name, node))
                    own.append(self._node(node, CUE, n))
                    continue
            if (top, line) not in lines:
                lines[top, line] = self._node(top, LINE)
            own.append(self._node(lines[top, line], CUE, n))


def sum_product(parent: np.ndarray, kind: np.ndarray, depth: np.ndarray, emit: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all nodes of a forest, and the sums by child type of the marginals of (parent, child) pairs.

    ``emit`` has the log potential of each node by state, ``edge`` by child type those of (parent, child).
    """
    n, k = emit.shape
    up, to_parent = emit.copy(), np.zeros((n, k))
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for at in reversed(levels[1:]):
        to_parent[at] = _lse(up[at][:, None, :] + edge[kind[at]], 2)
        np.add.at(up, parent[at], to_parent[at])
    full = up.copy()
    pairs = np.zeros((4, k, k))
    for at in levels[1:]:
        without = full[parent[at]] - to_parent[at]
        both = without[:, :, None] + edge[kind[at]] + up[at][:, None, :]
        full[at] = _lse(both, 1)
        both -= both.max(axis=(1, 2), keepdims=True)
        both = np.exp(both)
        np.add.at(pairs, kind[at], both / both.sum(axis=(1, 2), keepdims=True))
    p = np.exp(full - full.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), pairs


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(x / x.sum(axis=-1, keepdims=True))


#: The languages whose syntax a cue can be (fixed value); other names are no markup by themselves. A "?" says that plain texts have it too.
SYNTAX = {
    "html": "comment tag entity",
    "markdown": "hash_heading fence tilde_fence strong emphasis low_strong tick? ticks image link ref_link task dash_item? star_item? number_item? quote? pipe_row pipe_rule underline",
    "wiki": "double_bracket template quotes3 quotes2 equals_heading table_open table_close table_row table_head? table_cells outer_link magic star_item?",
    "latex": "command environment item display inline_paren dollars dollar_math bare_command",
    "rest": "directive target dot_comment option role tick_link underline lone_rule? note_ref ticks tick? strong emphasis dash_item? star_item? number_item? quote?",
}
#: What a reader's files are written in.
READS = {"MarkdownReader": "markdown", "ReSTReader": "rest", "WebReader": "html"}
#: How much a reader is believed, and rounds of training.
TRUST = 0.6
ROUNDS = 12


@dataclass
class MarkupModel:
    """Log potentials: page prior, child given parent by child type, and what is seen given a cue's kind."""

    prior: np.ndarray
    edge: np.ndarray
    seen: np.ndarray

    @classmethod
    def start(cls) -> MarkupModel:
        """What the syntaxes alone say."""
        k = len(KINDS)
        seen = np.full((k, len(NAMES)), 1e-4)
        for n, name in enumerate(NAMES):
            if CUES[n][3] == "keep":
                seen[0, n] = 1.0
        for kind, names in SYNTAX.items():
            for x in names.split():
                seen[KINDS.index(kind), _NUMBER[x.rstrip("?")]] = 0.3 if x.endswith("?") else 1.0
                if x.endswith("?"):
                    seen[0, _NUMBER[x.rstrip("?")]] = 0.1
        edge = np.stack([np.full((k, k), 0.02) + np.eye(k) * w for w in (0, 1.0, 1.0, 4.0)])
        edge[1:, :, 0] += 0.3
        return cls(np.log(np.full(k, 1 / k)), _log(edge), _log(seen))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str | None], rounds: int = ROUNDS) -> MarkupModel:
        """Trains on pages; a label is the kind that a page's reader is for, or None."""
        k = len(KINDS)
        m = first = cls.start()
        tree = Tree.of(texts)
        parent, kind, depth, cue = (np.array(x, np.int64) for x in (tree.parent, tree.kind, tree.depth, tree.cue))
        leaves = np.flatnonzero(cue >= 0)
        trust = np.zeros((len(texts), k))
        for i, x in enumerate(labels):
            if x in KINDS:
                trust[i] = np.log((1 - TRUST) / (k - 1))
                trust[i, KINDS.index(x)] = np.log(TRUST)
        for _ in range(rounds):
            emit = m.emissions(parent, cue)
            emit[tree.page] += trust
            p, pairs = sum_product(parent, kind, depth, emit, m.edge)
            seen = np.exp(first.seen) * 40
            np.add.at(seen.T, cue[leaves], p[leaves])
            # a language shows no cue that isn't in its syntax
            seen[1:][first.seen[1:] < first.seen[1:].max() - 7] = 1e-9
            m = cls(_log(np.ones(k) + p[tree.page].sum(axis=0)), _log(np.exp(first.edge) * 20 + pairs), _log(seen))
        return m

    def emissions(self, parent: np.ndarray, cue: np.ndarray) -> np.ndarray:
        emit = np.where((cue >= 0)[:, None], self.seen.T[np.maximum(cue, 0)], 0.0)
        emit[parent < 0] = self.prior
        return emit

    def judge(self, texts: list[str]) -> list[list[tuple[int, int, int, re.Match, int, float]]]:
        """The cues of each text with their likeliest kind and its marginal."""
        tree = Tree.of(texts)
        parent, kind, depth, cue = (np.array(x, np.int64) for x in (tree.parent, tree.kind, tree.depth, tree.cue))
        if not len(parent):
            return []
        p, _ = sum_product(parent, kind, depth, self.emissions(parent, cue), self.edge)
        best, sure = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
        return [[(*c, best[i], sure[i]) for c, i in zip(found, leaf)] for found, leaf in zip(tree.cues, tree.leaf)]


#: Log odds that an element is content, by its tag (fixed prior; others say nothing): what never is, mostly isn't, and mostly is.
_NEVER, _SELDOM = frozenset("script style head noscript template".split()), frozenset("nav footer aside menu form button select option".split())
_MOSTLY = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote article main section figure figcaption".split())
_CONTENT_EDGE = np.log(np.array([[0.95, 0.05], [0.1, 0.9]]))


def dropped(text: str) -> list[tuple[int, int]]:
    """The places of elements whose content marginal is below one half: two-state messages over the elements of one text, seen by tag, text and share of it in links."""
    tree = Tree.of([text])
    nodes = sorted(tree.element)
    if not nodes:
        return []
    number = {x: i + 1 for i, x in enumerate(nodes)}
    links = [(a, z) for name, a, z, _ in tree.element.values() if name == "a"]
    parent, depth, emit = [-1], [0], [(0.0, 2.0)]
    for x in nodes:
        name, a, z, _ = tree.element[x]
        up = number.get(tree.parent[x], 0)
        parent.append(up)
        depth.append(depth[up] + 1)
        size = len(re.sub(r"<[^<>]*>|\s+", "", text[a:z]))
        linked = sum(y - b for b, y in links if a < b and y <= z) / max(1, z - a)
        odds = -9.0 if name in _NEVER else 9.0 if name in ("html", "body", "main") else -3.0 if name in _SELDOM else 1.0 if name in _MOSTLY else 0.0
        odds += 1.0 if size > 200 else 0.0
        odds -= 2.0 if linked > 0.7 and name in ("ul", "ol", "div", "table", "p", "nav", "footer", "aside") and size < 400 else 0.0
        emit.append((0.0, odds))
    p, _ = sum_product(np.array(parent), np.full(len(parent), ELEMENT), np.array(depth), np.array(emit), np.stack([_CONTENT_EDGE] * 4))
    return [(tree.element[x][1], tree.element[x][2]) for x in nodes if p[number[x], 1] < 0.5]


def fit_markup(spark: SparkSession, sf_dir: str, rows: int = 3000) -> MarkupModel:
    """Trains the potentials on a bounded sample (``rows``) of the corpus, labelled by the reader of each file."""
    docs = few_files(table(spark, sf_dir, "corpus_documents")).select("doc_id", "input_path", "json_data")
    total = docs.count()
    buckets = 1 << 20
    cut = buckets if total <= rows else max(1, buckets * rows // total)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) < cut)
    picked = picked.select("input_path", F.from_json("json_data", "text string")["text"].alias("text")).where("text is not null").limit(2 * rows)
    got = picked.toArrow().to_pydict()
    # the sample is bounded, and so are its paths
    paths = spark.createDataFrame([(x,) for x in sorted({x for x in got["input_path"] if x})], "input_path string")
    files = table(spark, sf_dir, "reader_files").select("input_path", "reader").join(F.broadcast(paths), "input_path")
    reader = {r["input_path"]: READS.get(r["reader"]) for r in files.groupBy("input_path").agg(F.min("reader").alias("reader")).collect()}
    pages = sorted((t, reader.get(x) or "") for x, t in zip(got["input_path"], got["text"]))
    return MarkupModel.fit([t for t, _ in pages], [x or None for _, x in pages])


_BREAKS = re.compile(r"(?i)</?(?:p|div|li|h[1-6]|td|th|tr|br|hr|ul|ol|dl|dt|dd|table|pre|blockquote|section|article|header|main|figure|figcaption|caption)\b")
_HEAD_COMMAND = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_NUMBERED = re.compile(r"[ \t]*\d{1,3}[.)] +")


def _role(name: str, m: re.Match, marks: dict[str, int], lists: int) -> tuple[str, int] | None:
    """The block kind that a cue gives its line, and its level: of a heading from 1, of a list item by nesting from 1."""
    s = m.group()
    if name == "hash_heading":
        return "heading", len(m[1].strip())
    if name == "equals_heading":
        return "heading", max(1, len(m[1].strip()) - 1)
    if name == "underline":
        return "heading", marks.setdefault(m[2], len(marks) + 1)
    if name == "tag" and re.match(r"(?i)<h[1-6]\b", s):
        return "heading", int(s[2])
    if name == "command":
        head = re.match(r"~?\\([A-Za-z]+)", s)[1]
        return ("heading", _HEAD_COMMAND[head]) if head in _HEAD_COMMAND else None
    if name == "tag" and re.match(r"(?i)<li\b", s):
        return "list_item", max(1, lists)
    if name == "star_item":
        stars = len(m[1].strip())
        return "list_item", stars if stars > 1 else 1 + (len(s) - len(s.lstrip())) // 2
    if name in _LISTS:
        return "list_item", 1 + (len(s) - len(s.lstrip())) // 2
    if name in _MATH or name == "role" and ":math:" in s:
        return "formula", 0
    return ("table", 0) if CUES[_NUMBER[name]][3] == "cells" else None


def clean(text: str, cues: list[tuple[int, int, int, re.Match, int, float]]) -> list[tuple[str, str, int, str]]:
    """Clean blocks of a text as (block kind, markup, level, text): heading, list_item, code, formula, table or paragraph.

    The level is that of a heading or the nesting of a list item, else 0. A
    formula inside a sentence stays in its paragraph, without its signs; a line
    that is nothing but a formula is a block of its own.
    """
    gone = dropped(text) if any(NAMES[c[0]] == "tag" and c[4] for c in cues) else []
    inside = lambda a, spans: any(x <= a < z for x, z in spans)
    code = [(a, z) for a, z in code_spans(text) if not inside(a, gone)]
    events: list[tuple[int, int, str, tuple | None]] = [(a, z, "\n", None) for a, z in gone]
    marks: dict[str, int] = {}
    lists = 0
    page = {c[4] for c in cues}
    for n, a, z, m, kind, _p in cues:
        if inside(a, gone):
            continue
        name, how = NAMES[n], CUES[n][3]
        if name == "number_item" and page & {KINDS.index("markdown"), KINDS.index("rest")}:
            lead = _NUMBERED.match(text, a)
            events.append((a, lead.end(), "", ("list_item", "markdown" if KINDS.index("markdown") in page else "rest", 1 + (m.start(1) - a) // 2)))
            continue
        if kind == 0:
            continue
        if name == "tag" and (t := _TAG_NAME.match(text, a))[2].lower() in ("ul", "ol"):
            lists += -1 if t[1] else 1
        role = _role(name, m, marks, lists)
        mark = role and (role[0], KINDS[kind], role[1])
        if how == "all":
            events.append((a, z, "\n" if name == "tag" and _BREAKS.match(m.group()) else "", mark))
        elif how == "entity":
            events.append((a, z, html.unescape(m.group()), mark))
        elif how == "groups":
            cuts = [m.span(g) for g in range(1, (m.re.groups or 0) + 1) if m.span(g)[0] >= 0 and not (name == "underline" and g == 2)]
            if mark and mark[0] == "formula" and text[text.rfind("\n", 0, a) + 1 : a].strip() + text[z : (text.find("\n", z) + 1 or len(text) + 1) - 1].strip(" \t\r.,;"):
                mark = None
            if mark:
                events.append((a, a, "", mark))
            events += [(*c, "", None) for c in cuts]
        elif how == "cells":
            events.append((a, a, "", mark))
            events += [(a + c.start(), a + c.end(), " " if c.start() == 0 else "\t", None) for c in re.finditer(r"\|\|?|!!|^! ", m.group())]
    out: list[tuple[str, str, int, str]] = []
    buffer: list[str] = []
    role: tuple = ("paragraph", "none", 0)

    def flush() -> None:
        nonlocal role
        s = re.sub(r"[ \t\xa0]+" if role[0] != "table" else r" +", " ", "".join(buffer)).strip()
        buffer.clear()
        if s:
            out.append((*role, s))
        role = ("paragraph", "none", 0)

    def say(a: int, z: int) -> None:
        for k, part in enumerate(text[a:z].split("\n")):
            if k:
                flush()
            buffer.append(part)

    def block(a: int, z: int) -> None:
        flush()
        s = text[a:z]
        if re.search(r"(?i)<(?:pre|code|samp|nowiki)\b[^<>]*>\Z", text[max(0, a - 200) : a]):
            s = html.unescape(re.sub(rf"(?i)</?(?:{_TAG})(?:\s[^<>]*)?/?>", "", s))
        if s.strip():
            out.append(("code", "none", 0, s.strip("\n")))

    at = 0
    for a, z, what, mark in sorted([*events, *((a, z, "code", None) for a, z in code)], key=lambda e: (e[0], e[1])):
        if a < at and z <= at:
            continue
        say(at, max(at, a))
        at = max(at, z)
        if what == "code":
            block(a, z)
            continue
        if what == "\n":
            flush()
        elif what and a < z:
            buffer.append(what)
        if mark and (role[0] == "paragraph" or mark[0] == "heading"):
            role = mark
    say(at, len(text))
    flush()
    return out


def markup_masks(df: DataFrame, model: MarkupModel, text: str = "text") -> DataFrame:
    """The other columns with ``markup_mask``: bit k for KINDS[k] where a cue's marginal favours it. Null texts have mask 0."""
    rest = [c for c in df.columns if c not in (text, "markup_mask")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "markup_mask int"])

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            at = [i for i, t in enumerate(texts) if t]
            mask = np.zeros(len(texts), np.int32)
            for lo in range(0, len(at), 500):
                own = at[lo : lo + 500]
                for i, cues in zip(own, m.judge([texts[i] for i in own])):
                    for c in cues:
                        if c[4] and c[5] >= 0.5:
                            mask[i] |= 1 << c[4]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array(mask, pa.int32())], names=[*rest, "markup_mask"])

    return df.select(*rest, text).mapInArrow(run, schema)


def clean_documents(df: DataFrame, model: MarkupModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, block_kind, markup, level, clean_text): each text without its markup, in blocks that keep headings, list items, code, formulas and tables.

    A null or empty text gives no block; a text without markup gives its paragraphs.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows, cols = [], ([], [], [], [], [])
            for lo in range(0, len(texts), 500):
                for i, cues in enumerate(m.judge(texts[lo : lo + 500])):
                    for no, (k, f, level, s) in enumerate(clean(texts[lo + i], cues)):
                        rows.append(lo + i)
                        for c, v in zip(cols, (no, k, f, level, s)):
                            c.append(v)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=[key, "block_no", "block_kind", "markup", "level", "clean_text"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, block_no int, block_kind string, markup string, level int, clean_text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of markup in the texts of current records."""
    model = fit_markup(spark, sf_dir)
    df = states(spark, sf_dir)
    sent = df.select("doc_id", "stored_at", F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text"))
    masks = latest(markup_masks(sent, model), "markup_mask").where("markup_mask > 0")
    names = F.array(*[F.when(F.col("markup_mask").bitwiseAND(1 << k) != 0, F.lit(n)) for k, n in enumerate(KINDS) if k])
    return masks.select("doc_id", F.explode(F.array_compact(names)).alias("markup"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean blocks of all current records."""
    return clean_documents(current(states(spark, sf_dir)).where("text is not null"), fit_markup(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
