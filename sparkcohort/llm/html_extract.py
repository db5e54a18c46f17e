"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags; a block has its number of words, its link density, those of its two
neighbours, and what kind of elements it stands in.  A small decision tree, trained on the driver from the labelled blocks
of a few sample pages below, says for every block whether it is main text.  Pages are independent: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Shipped, q, text_of

# Elements of the markup language by their role, and words of class and id attributes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br".split())
UNSEEN = frozenset("script style noscript template iframe textarea title object svg math canvas audio video select head".split())
SECTIONS = frozenset("article main section div nav header footer aside form ul ol dl table figure fieldset dialog menu body html "
                     "blockquote details center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("form button fieldset input option legend".split())
NOTICE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                         "notice notices popup modal overlay newsletter subscribe subscription paywall alert".split())
MENU_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail related recommended trending "
                       "social share sharing toolbar topbar masthead widget footer copyright legal tags skip search login signup".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
BODY_WORDS = frozenset("article content post entry story main body text".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
                 r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in article",
            "page has article", "in menu", "in header", "in notice", "in comments", "in form", "heading", "list item")


def roles(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """(article, menu, header, notice, comments, form) as an element's tag and names say."""
    words: set[str] = set()
    for found in NAMES.finditer(attributes) if "=" in attributes else ():
        words.update(re.split(r"[^a-z]+", next(g for g in found.groups() if g is not None).lower()))
    body = tag in ("article", "main") or tag in ("div", "section", "td") and bool(words & BODY_WORDS)
    comments = bool(words & COMMENT_WORDS)
    notice = tag == "dialog" or bool(words & NOTICE_WORDS)
    menu = tag in ("nav", "footer", "aside", "menu") or bool(words & MENU_WORDS)
    return (body and not (comments or notice or menu), menu, tag == "header" or "header" in words, notice, comments, tag in CONTROLS)


def blocks(page: str) -> tuple[list[str], list[list[float]]]:
    """Texts and features of a page's blocks that have text, in page order."""
    texts: list[str] = []
    rows: list[list[float]] = []
    stack: list[tuple[str, tuple]] = []
    now = [0] * 6
    pieces: list[str] = []
    linked = 0
    link_depth = 0
    block_tag = ""
    has_article = False

    def close() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                size = sum(map(len, words))
                rows.append([len(words), min(linked / size, 1.0), 0, 0, 0, 0, now[0] > 0, 0, now[1] > 0, now[2] > 0, now[3] > 0, now[4] > 0,
                             now[5] > 0, block_tag in HEADINGS, block_tag in ("li", "dt", "dd")])
                texts.append(" ".join(words))
            pieces.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link_depth:
            linked += sum(map(len, text.split()))

    at = 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            if at < len(page):
                put(page[at:])
            break
        if found.start() > at:
            put(page[at:found.start()])
        at = found.end()
        slash, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag, end = tag.lower(), bool(slash)
        if tag in UNSEEN:
            if not end and not attributes.endswith("/"):
                closing = re.compile(rf"</{tag}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, at)
                at = closing.end() if closing else len(page)
            continue
        if tag == "a":
            link_depth = max(0, link_depth - 1) if end else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in INLINE:
            continue
        close()
        link_depth = 0
        block_tag = "" if end else tag
        if tag in SECTIONS or tag in CONTROLS:
            if end:
                if any(open_tag == tag for open_tag, _ in stack):
                    while stack:
                        open_tag, role = stack.pop()
                        now = [n - r for n, r in zip(now, role)]
                        if open_tag == tag:
                            break
            elif tag != "input" and not attributes.endswith("/"):
                role = roles(tag, attributes)
                stack.append((tag, role))
                now = [n + r for n, r in zip(now, role)]
                has_article |= role[0]
    close()
    for k, row in enumerate(rows):
        row[7] = has_article
        if k:
            row[2:4] = rows[k - 1][:2]
        if k + 1 < len(rows):
            row[4:6] = rows[k + 1][:2]
    return texts, rows


class Tree:
    """A binary decision tree by Gini impurity; ``nodes``: feature, cut, left, right, label (feature -1: leaf)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.nodes: list[list[float]] = []
        self.grow(x, y, depth)
        self.table = np.array(self.nodes, float)

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0, float(y.mean() >= 0.5)])
        if depth == 0 or y.min() == y.max():
            return at
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(y[order])
            for k in np.flatnonzero(v[1:] > v[:-1]):
                n, m, a, b = k + 1, len(y) - k - 1, left[k], left[-1] - left[k]
                impurity = 2 * (a * (n - a) / n + b * (m - b) / m)
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.nodes[at][:2] = [best[1], best[2]]
            self.nodes[at][2] = self.grow(x[low], y[low], depth - 1)
            self.nodes[at][3] = self.grow(x[~low], y[~low], depth - 1)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            feature = self.table[at, 0].astype(int)
            live = np.flatnonzero(feature >= 0)
            if not len(live):
                return self.table[at, 4] > 0.5
            low = x[live, feature[live]] <= self.table[at[live], 1]
            at[live] = np.where(low, self.table[at[live], 2], self.table[at[live], 3]).astype(int)


def words(n: int) -> str:
    return " ".join(["word"] * n)


def sample_pages() -> list[str]:
    """The labelled table: pages whose main blocks start with the mark #."""
    link = "<a href='/'>" + words(2) + "</a>"
    links = "<ul>" + f"<li>{link}</li>" * 5 + "</ul>"
    para = "".join(f"<p># {words(n)}</p>" for n in (60, 2, 25, 120, 1, 9))
    mixed = f"<p># {words(30)} {link} {words(12)}</p><p># {link}</p><ul><li># {words(12)}</li><li># {words(2)}</li><li># {link}</li></ul>"
    head = f"<h1># {words(6)}</h1>"
    quote = f"<blockquote># {words(20)}</blockquote><table><tr><td># {words(3)}</td></tr></table>"
    noise = [f"<div class='ad'>{words(n)}</div>" for n in (3, 18, 45)]
    notice = f"<div class='cookie-notice'><p>{words(25)}</p></div>"
    form = f"<form><p>{words(14)}</p><p>{words(2)}</p></form>"
    comments = f"<section class='comments'><h2>{words(1)}</h2><p>{words(40)}</p><div class='comment'><p>{words(8)}</p></div></section>"
    side = f"<aside><h3>{words(2)}</h3><p>{words(28)}</p>{links}</aside><div class='sidebar'><p>{words(33)}</p></div>"
    foot = f"<footer><p>{words(9)}</p><p>{words(50)}</p>{links}</footer>"
    top = f"<header><h1>{words(3)}</h1><p>{words(8)}</p></header>"
    menu = f"<nav>{links}<p>{words(7)}</p></nav>"
    share = f"<div class='share'><p>{words(4)}</p></div><div class='related'><h3>{words(2)}</h3><p>{words(16)}</p></div>"
    inner = f"<nav><p>{words(11)}</p></nav><aside><p>{words(24)}</p></aside><footer><p>{words(13)}</p></footer>{share}{notice}"
    return [
        f"{menu}{noise[0]}<article>{head}{para}{mixed}</article>{foot}",
        f"{top}{menu}<article><header>{head}<p># {words(5)}</p></header>{para}{noise[1]}{quote}{form}</article>{comments}{side}{foot}",
        f"{notice}{top}{menu}<main>{head}{mixed}{para}{comments}</main>{side}{foot}",
        f"{menu}<div>{noise[2]}</div><article>{head}<p># {words(3)}</p></article><p>{words(30)}</p><p>{words(2)}</p>{foot}",
        f"{menu}<article>{head}<p># {words(18)}</p>{inner}{para}{form}{comments}</article>{top}{foot}",
        f"<div class='content'>{head}<p># {words(18)}</p>{inner}{para}{noise[0]}{quote}</div>{form}{foot}{notice}",
        f"{top}{menu}{share}<h1># {words(5)}</h1>{noise[1]}{para}{notice}{quote}{form}{comments}{side}{foot}",
        f"{menu}<h1># {words(5)}</h1><p># {words(40)}</p><p># {words(15)}</p><p># {words(70)} {link}</p>{foot}",
        f"<div>{links}</div><p># {words(35)}</p><p># {words(8)}</p><p># {words(22)}</p><div>{links}{link}</div>",
        f"<p>{link}</p><p># {words(30)}</p><p># {words(3)}</p><p>{link}{link}{link}</p>",
    ]


def trained() -> Tree:
    x, y = [], []
    for page in sample_pages():
        texts, rows = blocks(page)
        for text, row in zip(texts, rows):
            main = text.startswith("#")
            x.append([row[0] - main, *row[1:]])
            y.append(main)
    return Tree(np.array(x, float), np.array(y, float))


def extract(pages: DataFrame, id: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns of ``keep``, ``text`` and ``n_chars``: one row per input row.

    ``text`` has the main blocks in page order, one a line, with character references decoded and white space inside a block
    turned into one space.  Null and empty pages and pages without main text give an empty text.
    """
    handle = Shipped(pages.sparkSession, trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = handle.value
        for batch in batches:
            source = batch.column(batch.num_columns - 1)
            for first in range(0, batch.num_rows, 256):
                part = [blocks(p.as_py()) for p in source.slice(first, 256)]
                rows = [r for _, rs in part for r in rs]
                main = iter(tree.predict(np.array(rows, float)) if rows else ())
                out = ["\n".join([t for t in texts if next(main)]) for texts, _ in part]
                head = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([*head.columns[:-1], pa.array(out, pa.string())], names=[*head.schema.names[:-1], "text"])

    columns = [id, *keep]
    rows = pages.select(*[q(c).alias(f"k{k}") for k, c in enumerate(columns)], text_of(page).alias("text"))
    shape = ", ".join([*[f"k{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(columns)], "text string"])
    got = rows.mapInArrow(run, shape)
    return got.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(columns)], "text", F.length("text").cast("long").alias("n_chars"))
