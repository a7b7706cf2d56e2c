"""Main text of web pages as the maximum-scoring subsequence of their words and tags."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled_pages import PAGES

#: Elements that begin and end a block of text.
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul""".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not part of the page as it is read.  The first ones hold no tags, only their own end.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNREAD = frozenset("head template select option button svg math canvas audio video object label legend datalist".split())
#: What an open head can hold.  Its end can be left out: any other element, or text, is the first of the body.
HEAD_HOLDS = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: These end where a sibling begins.
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Tags that say nothing about what they hold.
PLAIN = frozenset("<" + x for x in "html body div p br hr table tbody tr td".split())
#: Their classes speak of the whole page, not of what is the article.
WHOLE = frozenset(("html", "body"))
#: Where an implied end stops looking.
SCOPE = frozenset("ul ol table td th div article section main body aside nav header footer form blockquote dl".split())
DOCS_PER_BATCH = 64
#: Words of a long block, and words that every block counts more, so that a short line is not lost among its tags.
LONG, SMOOTHING = 12, 3
#: Tags only part blocks: their share of the score beside the words'.
TAG_SHARE = 0.15
#: A path with a feature of this weight lies within an article: what does not belong there is an insertion, which is left
#: out but hardly counts against what follows it.
WITHIN, INSERTED = 1.5, 0.02

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?""",
                    re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]{2,}")


class Block:
    """A run of text without a block boundary: its pieces, its features, the tags since the block before."""

    __slots__ = ("features", "linked", "main", "pieces", "tags", "words")

    def __init__(self, tags: list[str], features: frozenset[str], main: bool) -> None:
        self.pieces: list[str] = []
        self.tags, self.features, self.main = tags, features, main
        self.words = self.linked = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page in order, and the tags after the last one.  One pass over the page."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = [("", frozenset(), False)]  # name, features of the path, wanted
    tags: list[str] = []
    now: Block | None = None
    unread = links = 0
    at = 0

    def take(text: str) -> None:
        nonlocal now, tags
        if stack[-1][0] == "head" and text.strip():
            close("head")
        if unread or not text:
            return
        words = len(text.split())
        if now is None:
            if not words:
                return
            now = Block(tags, stack[-1][1], stack[-1][2])
            found.append(now)
            tags = []
        now.pieces.append(text)
        now.words += words
        now.linked += words if links else 0

    def close(name: str) -> None:
        nonlocal unread, links
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                for x, _, _ in stack[k:]:
                    unread -= x in UNREAD
                    links -= x == "a"
                del stack[k:]
                return

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            take(page[at:])
            break
        token = _TOKEN.match(page, start)
        if not token:
            take(page[at:start + 1])
            at = start + 1
            continue
        take(page[at:start])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        ending, rest = token[1] or token[4], token[3] or token[6] or ""
        if name in BLOCK:
            now = None
        tags.append(name)
        if ending:
            close(name)
            continue
        if stack[-1][0] == "head" and name not in HEAD_HOLDS:
            close("head")
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        if name in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[name]:
                    close(stack[k][0])
                    break
                if stack[k][0] in SCOPE:
                    break
        _, features, main = stack[-1]
        if name in BLOCK and name not in WHOLE:
            own = {"<" + name} - PLAIN
            for value in _NAMES.findall(rest):
                own.update(_WORD.findall("".join(value).lower()))
            features |= own
        main = (main or "data-main" in rest) and "data-skip" not in rest
        stack.append((name, features, main))
        unread += name in UNREAD
        links += name == "a"
    return found, tags


def _of(block: Block) -> frozenset[str]:
    """The features of a block: what its path says, whether most of it is links, and its length if the path says nothing."""
    own = {"=linked"} if 2 * block.linked > block.words else {"=long"} if not block.features and block.words >= LONG else set()
    return block.features | own


@lru_cache(maxsize=1)
def weights(steps: int = 3000, rate: float = 8.0, penalty: float = 1e-4) -> tuple[dict[str, float], dict[str, float]]:
    """(of features, of tags), learned from the labelled pages.

    Features of a block's path get the weights of a logistic regression whose examples are blocks, each as heavy as the
    root of its words.  A tag's weight is negative: the logarithm of how much more often it stands outside wanted text.
    """
    examples, inside, outside = [], {}, {}
    for page in PAGES:
        found, _ = blocks(page)
        before = False
        for block in found:
            examples.append((_of(block), block.main, block.words ** 0.5))
            for tag in block.tags:
                count = inside if block.main and before else outside
                count[tag] = count.get(tag, 0) + 1
            before = block.main
    names = {f: k for k, f in enumerate(sorted(set().union(*(f for f, _, _ in examples))))}
    x = np.zeros((len(examples), len(names) + 1))
    for row, (features, _, _) in enumerate(examples):
        x[row, [names[f] for f in features]] = 1
        x[row, -1] = 1
    y, heavy = np.array([m for _, m, _ in examples], float), np.array([h for _, _, h in examples])
    heavy /= heavy.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (x.T @ (heavy * (1 / (1 + np.exp(-x @ w)) - y)) + penalty * w)
    of_tags = {t: -TAG_SHARE * max(0.2, float(np.log((outside.get(t, 0) + 1) / (inside.get(t, 0) + 1)))) for t in inside.keys() | outside.keys()}
    return {f: float(w[k]) for f, k in names.items()} | {"": float(w[-1])}, of_tags


def main_text(page: str | None) -> str:
    """The wanted blocks of the best contiguous region, joined by one space.

    A word scores 2 p - 1 for the probability p that its block is wanted, a tag its negative weight.  The region with the
    largest sum is found in one scan; blocks of it that score below zero (an advert within an article) are left out.
    """
    if not page:
        return ""
    of_features, of_tags = weights()
    unknown = min(of_tags.values()) / 4
    found, _ = blocks(page)
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    scores = []
    for k, block in enumerate(found):
        own = [of_features.get(f, 0.0) for f in _of(block)]
        score = (block.words + SMOOTHING) * math.tanh((of_features[""] + sum(own)) / 2)
        if score < 0 and max(own, default=0.0) > WITHIN:
            score *= INSERTED
        scores.append(score)
        total += sum(of_tags.get(t, unknown) for t in block.tags)
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, begin, end = total, start, k + 1
    return " ".join(t for k in range(begin, end) if scores[k] > 0 and (t := found[k].text))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page; nothing is shuffled.

    A null, empty or textless page has the empty text; null ids and addresses stay null; repeated rows are extracted
    each; an empty table gives an empty result; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(list(range(batch.num_rows)), DOCS_PER_BATCH):
                part = batch.slice(some[0], len(some))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())],
                    names=["page_id", "url", "text"])

    return pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(
        run, "page_id bigint, url string, text string")
