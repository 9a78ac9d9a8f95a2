"""Main-text extraction: a tree-structured graphical model over the DOM, with sum-product message passing."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices

#: A tag ends at the first > that is in no quoted value; quotes hold a value right after = only.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: White space of markup; other spaces are text until decoded blocks are trimmed.
SPACE = re.compile(r"\s+")

#: Fixed values of the markup language: elements inside a line (formulas are text), without an end, of raw text, set in a line with content of their own, and what closes an open p or item.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr mstyle merror mpadded mphantom mspace menclose mfenced maction".split())  # fmt: skip
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
EMBEDDED = frozenset("noscript iframe template svg select button object canvas".split())
#: Where the source text of a formula ends, which isn't shown.
ANNOTATION = re.compile(r"</annotation(?:-xml)?\s*>|</?math\b", re.I)
#: A slash at the end of a tag that belongs to an attribute's value.
VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "thead": "tr td th", "tfoot": "tr td th thead tbody"}
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "tbody": "table", "thead": "table", "tfoot": "table"}

#: Elements and words in class, id and role that speak for the article or for what surrounds it.
MAIN_TAGS, OTHER_TAGS = frozenset("article main".split()), frozenset("nav footer aside form header head dialog menu fieldset".split()) | EMBEDDED
MAIN_WORDS = frozenset("article content post entry story main body text".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe signup login "
    "share sharing social related recommended recommendations more comment comments commentlist reply replies respond disqus discussion form search widget tags pagination pager copyright legal contentinfo complementary alertdialog".split()
)


#: What a part is called that holds others' text; a name made of one of OTHER_WORDS and of these speaks of such a part ("share-buttons"), one that goes on otherwise ("form-of-government") may be a section's subject.
HOLDERS = frozenset("area article articles bar block body bottom box button buttons card cards col column container content default desktop first fixed frame global group head heading icon icons inner item items label last layout left line link links list lists mobile "
                    "module news outer overlay page panel part parts post posts primary right row secondary section site slot stories story sticky tab tabs text thread title toggle top unit view wrap wrapper zone".split())  # fmt: skip


def tags_of(source: str) -> Iterator[tuple[int, int, str, bool, bool, str]]:
    """Start, end, name, whether an end tag, whether empty by its slash (in svg only), and attributes of each tag; raw text, and source text of formulas, is inside its tag."""
    at, drawing, ahead = 0, 0, None
    while m := TAG.search(source, at):
        start, at = m.span()
        tag, end, rest = (m[2] or "").lower(), bool(m[1]), m[3] or ""
        empty = not end and rest.endswith("/") and (drawing > 0 or tag == "svg") and not VALUE_SLASH.search(rest)
        if tag == "svg" and not empty:
            drawing = max(0, drawing - 1) if end else drawing + 1
        elif tag in RAW and not end and not empty:
            close = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
        elif tag in ("annotation", "annotation-xml") and not end:
            if ahead is None or 0 <= ahead[0] < at:  # what was found ahead is good for all tags before it
                close = ANNOTATION.search(source, at)
                ahead = (close.start(), close.end(), close[0][:3].lower() == "</a") if close else (-1, -1, False)
            if ahead[2]:
                at = ahead[1]
        yield start, at, tag, end, empty, rest


def closed_in(tags: list[tuple[int, int, str, bool, bool, str]]) -> set[int]:
    """Starts of the embedded elements that an end tag closes; one that is never closed has no content, rather than all that follows."""
    open_: dict[str, list[int]] = {}
    out = set()
    for start, _, tag, end, empty, _ in tags:
        if tag in EMBEDDED and not empty:
            if not end:
                open_.setdefault(tag, []).append(start)
            elif open_.get(tag):
                out.add(open_[tag].pop())
    return out


class Page:
    """Block elements and runs of text of a page, as a tree: parents come before their children."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.text, self.links = [-1], ["#root"], [frozenset()], [""], [0]
        self.source = source
        self._read()

    def _add(self, parent: int, tag: str, words: frozenset = frozenset(), text: str = "", links: int = 0) -> int:
        for column, x in zip((self.parent, self.tag, self.words, self.text, self.links), (parent, tag, words, text, links), strict=True):
            column.append(x)
        return len(self.tag) - 1

    def _read(self) -> None:
        source, at, open_, run, links, anchor = self.source, 0, [0], [], 0, 0
        depths: dict[str, list[int]] = {}  # of the open elements of each name, the innermost last

        def enter(tag: str, words: frozenset) -> None:
            depths.setdefault(tag, []).append(len(open_))
            open_.append(self._add(open_[-1], tag, words))

        def nearest(names: Iterable[str]) -> int:
            return max((depths[n][-1] for n in names if depths.get(n)), default=0)

        tags = list(tags_of(source))
        closed = closed_in(tags)
        around: list[tuple[int, list[str], int, int]] = []  # of embedded elements: depth, and the run of text that goes on after them

        def flush() -> None:
            nonlocal links
            if run:
                text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
                if text:
                    self._add(open_[-1], "#text", text=text, links=min(links, len(text)))
                run.clear()
            links = 0

        def say(text: str) -> None:
            nonlocal links
            run.append(text)
            links += len(text) if anchor else 0

        def leave(depth: int) -> None:
            nonlocal run, links, anchor
            while len(open_) > depth:
                flush()
                depths[self.tag[open_.pop()]].pop()
                if around and around[-1][0] == len(open_):
                    _, run, links, anchor = around.pop()

        for start, stop, tag, end, empty, rest in tags:
            if start > at:
                say(source[at:start])
            at = stop
            if not tag or tag in RAW and not end or tag in ("annotation", "annotation-xml"):
                continue
            if tag in EMBEDDED:
                if end:
                    if k := nearest((tag,)):
                        leave(k)
                elif start in closed:
                    around.append((len(open_), run, links, anchor))
                    run, links, anchor = [], 0, 0
                    enter(tag, words_of(rest))
                continue
            if tag in INLINE:
                if tag == "a":
                    anchor = 0 if end else 1
                elif tag == "br":
                    run.append(" ")
                continue
            flush()
            anchor = 0
            if end:
                if k := nearest((tag,)):
                    leave(k)
                    flush()
                continue
            if tag not in ("head", "html", "body"):
                if self.tag[open_[-1]] == "p":
                    leave(len(open_) - 1)
            if tag in CLOSES:
                if (k := nearest(CLOSES[tag].split())) > nearest(SCOPES.get(tag, "").split()):
                    leave(k)
                    flush()
            elif tag == "body":
                while len(open_) > 1 and self.tag[open_[-1]] == "head":
                    leave(len(open_) - 1)
            if tag in VOID or empty:
                continue
            enter(tag, words_of(rest))
        if at < len(source):
            say(source[at:])
        leave(1)
        flush()


def words_of(attributes: str) -> frozenset:
    """What the names in class, id and role say: "other" if one is of OTHER_WORDS, alone or before HOLDERS only; "mention" if one has such a word elsewhere; "main" if one has one of MAIN_WORDS."""
    said = set()
    for name in " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        at = [k for k, w in enumerate(words) if w in OTHER_WORDS]
        if at:
            said.add("other" if all(w in HOLDERS for w in words[at[-1] + 1 :]) else "mention")
        elif not MAIN_WORDS.isdisjoint(words):
            said.add("main")
    return frozenset(said)


#: What the model looks at. The weights that training starts from and is drawn to.
FEATURES = {
    "bias": 0.0, "main tag": 6.0, "other tag": -8.0, "main word": 6.0, "other word": -8.0, "mention": -1.0, "text": 0.2,
    "long": 0.6, "short": -0.4, "linked": -2.5, "sentence": 0.6, "heading": 0.4, "paragraph": 0.4, "item": -0.3, "rights": -1.0,
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = list(FEATURES)
INDEX = {n: i for i, n in enumerate(NAMES)}


def features_of(page: Page, i: int) -> list[int]:
    """Features that hold at a node; each is 0 or 1."""
    tag, words, out = page.tag[i], page.words[i], [INDEX["bias"]]
    if tag == "#text":
        text = page.text[i]
        out.append(INDEX["text"])
        out.append(INDEX["long"] if len(text) > 80 else INDEX["short"])
        if 2 * page.links[i] > len(text):
            out.append(INDEX["linked"])
        if text[-1] in ".!?…\"”»:":
            out.append(INDEX["sentence"])
        if text[0] == "©":
            out.append(INDEX["rights"])
        return out
    if tag in MAIN_TAGS:
        out.append(INDEX["main tag"])
    elif tag in OTHER_TAGS:
        out.append(INDEX["other tag"])
    elif tag in HEADINGS:
        out.append(INDEX["heading"])
    elif tag == "p":
        out.append(INDEX["paragraph"])
    elif tag == "li":
        out.append(INDEX["item"])
    if "other" in words:
        out.append(INDEX["other word"])
    elif "main" in words:
        out.append(INDEX["main word"])
    elif "mention" in words:
        out.append(INDEX["mention"])
    return out


def labels_of(page: Page) -> list[int] | None:
    """1 for nodes that elements put in an article or main element and in no other part; None if the page has no such element. Names in class, id and role don't count here, so that what they say is learned."""
    out = [0] * len(page.tag)
    for i in range(1, len(out)):
        out[i] = int((page.tag[i] in MAIN_TAGS or out[page.parent[i]]) and page.tag[i] not in OTHER_TAGS)
    return out if any(out) else None


Model = tuple[list[float], list[list[float]]]


def marginals(page: Page, model: Model) -> list[float]:
    """Log odds of being content at each node, given the whole tree: messages up to the root, then down again."""
    weights, pair = model
    n = len(page.tag)
    own = [sum(weights[k] for k in features_of(page, i)) for i in range(n)]
    (p00, p01), (p10, p11) = pair
    exp, log = math.exp, math.log
    up = [0.0] * n  # from a node to its parent
    for i in range(n - 1, 0, -1):
        x = exp(max(-40.0, min(40.0, own[i])))
        if page.tag[i] not in EMBEDDED:  # an icon or a button says nothing of the paragraph that it stands in
            up[i] = log((p10 + p11 * x) / (p00 + p01 * x))
            own[page.parent[i]] += up[i]
    for i in range(1, n):
        x = exp(max(-40.0, min(40.0, own[page.parent[i]] - up[i])))
        own[i] += log((p01 + p11 * x) / (p00 + p10 * x))
    return own


def main_text(source: str | None, model: Model) -> str:
    page = Page(source or "")
    odds = marginals(page, model)
    return "\n".join(t for t, o in zip(page.text, odds, strict=True) if t and o > 0)


#: Probabilities, at least, of content in what is not, and of other parts in content: pages elsewhere mix them more than a training set may.
STRAY, INSET = 0.005, 0.25


def label_counts(pages: Iterable[str]) -> dict[tuple[int, ...], np.ndarray]:
    """Nodes of either label, by the parent's label and the node's features, on pages that name their main part."""
    rows: dict[tuple[int, ...], np.ndarray] = {}
    for source in pages:
        page = Page(source)
        if (labels := labels_of(page)) is None:
            continue
        for i in range(1, len(labels)):
            if page.tag[i] not in EMBEDDED:
                rows.setdefault((labels[page.parent[i]], *features_of(page, i)), np.zeros(2))[labels[i]] += 1
    return rows


def fit(pages: Iterable[str]) -> Model:
    """The model from whole pages."""
    return fitted(label_counts(pages))


def fitted(rows: dict[tuple[int, ...], np.ndarray], rounds: int = 40, ridge: float = 20.0) -> Model:
    """Node weights and parent-child potentials from counts of labels: smoothed counts of label pairs, and logistic regression, drawn to FEATURES, of each label given its parent's."""
    start = np.array([FEATURES[n] for n in NAMES])
    counts = np.array([[40.0, 2.0], [2.0, 40.0]])
    rows = dict(sorted(rows.items()))
    for at, n in rows.items():
        counts[at[0]] += 0 if INDEX["main tag"] in at[1:] else n
    shares = counts / counts.sum(1, keepdims=True)
    stray, inset = max(STRAY, shares[0, 1]), max(INSET, shares[1, 0])
    pair = np.array([[1 - stray, stray], [inset, 1 - inset]])
    w = start.copy()
    if rows:
        x = np.zeros((len(rows), len(NAMES)))
        for k, at in enumerate(rows):
            x[k, list(at[1:])] = 1
        given = np.log(shares[:, 1] / shares[:, 0])[[at[0] for at in rows]]  # what the parent's label says already
        n = np.array(list(rows.values()))
        n = n * min(1.0, 2000 / n.sum())
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w + given, -40, 40)))
            h = x.T @ (x * (n.sum(1) * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            w += 0.5 * np.linalg.solve(h, x.T @ (n[:, 1] - n.sum(1) * p) - ridge * (w - start))
    return w.tolist(), pair.tolist()


#: Pages that the model is fitted on at most, the first by a hash of page_id.
TRAINING_PAGES = 400
TRAINING_TASKS = 16


def train_extractor(pages: DataFrame, rows: int = TRAINING_PAGES) -> Model:
    """The model, from at most `rows` whole pages: the labels are where article and main elements, and named other parts, stand. Only counts reach the driver."""
    ids = F.broadcast(pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(rows).distinct())
    chosen = pages.join(ids, "page_id", "left_semi").where(F.col("html").isNotNull()).select("html").limit(rows).repartition(TRAINING_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = label_counts(part.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.int32())), *(pa.array([int(n[y]) for n in found.values()], pa.int64()) for y in (0, 1))], ["at", "other", "main"])

    counted = chosen.mapInArrow(run, "at array<int>, other long, main long").groupBy("at").agg(F.sum("other").alias("other"), F.sum("main").alias("main"))
    return fitted({tuple(r["at"]): np.array([r["other"], r["main"]], float) for r in counted.collect()})


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    text holds the blocks that the model finds likelier content than not, in page order, joined by newlines; within a block,
    white space is one space and character references are decoded. It is empty if there are none, and for null html. Cut-off
    markup is read as far as it goes. Repeated rows stay; other columns are ignored.
    """
    model = model or train_extractor(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(x, model) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
