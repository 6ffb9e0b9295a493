"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks of text at block-level tags.  A block's features
are its own and its neighbours' word counts and link densities and what it
stands in (the article, page furniture).  A decision tree, trained on the
small labelled table below, says which blocks are the article's; they are joined by
one space, white space inside a block turned into one space, character
references decoded.

A name is furniture (menus, notices, comments) if all its words are furniture's or say what
part it is of; a name of which only some words are (``share-price-report``, ``letter-reply``) leaves
the decision to the tree, beside length and links.  An article inside an article is a
reader's comment, if the outer one has text of its own.  A page of which the tree
leaves nothing keeps its blocks outside of furniture that are not mostly links.

Defined cases: a null page is an empty one and gives an empty text; markup
that never closes (comments, scripts, tags) runs to the page's end, but for
drawings, menus and players; options end at the next tag; pages
without an article element are judged by length and links alone; repeated
rows give repeated rows; extra columns pass through, but for ``text`` and ``n_chars``,
which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices

# --- fixed values: HTML's vocabulary ---------------------------------------------------------

# elements whose content is no text, if never closed to the page's end
SILENT = "script style noscript template title textarea iframe"
# those that, if never closed, are no more than their tag
BOUNDED = "select svg canvas audio video"
# elements that do not break a block of text
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
          "small span strike strong sub sup time tt u var wbr button object math mrow mi mn mo ms mtext mspace mfrac "
          "msqrt mroot mstyle msub msup msubsup munder mover munderover semantics annotation").split()
# elements without content
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
# page furniture by element, and by words of class, id or role
FURNITURE = "nav footer aside form dialog menu header".split()
FURNITURE_WORDS = set(
    "nav navbar navigation menu menubar masthead header footer sidebar aside ad ads advert adverts advertisement "
    "advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup "
    "modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond widget "
    "toolbar copyright legal skip hidden alert complementary contentinfo disclaimer announcement toast adbox adslot "
    "adunit adsbygoogle optin paywall".split())
FURNITURE_STARTS = tuple("comment advert cookie breadcrumb sidebar footer newsletter sponsor promo popup navbar masthead "
                         "subscri".split())
# words that only begin like one of these
CONTENT_WORDS = set("commentary commentaries commentator commentators subscript subscripts promontory".split())
# a name that says whether the page has a part or in what state it is, not what the element is
LAYOUT_NAME = re.compile(r"(?:^|-)(?:has|have|no|not|with|without)-.*|.*-(?:enabled|disabled)$")
# what stands beside furniture words in an id; other words make it the id of a heading's text
PART_WORDS = set(
    "list box wrap wrapper container section area block bar row column col panel group holder inner outer top bottom left "
    "right main site page global primary secondary tertiary content form item items unit slot banner title button "
    "buttons icon icons links link posts post articles article stories story count meta info the".split())
ARTICLE_WORDS = set("article content post entry story main articlebody".split())

_ATTRIBUTE = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
_SILENT = "|".join(SILENT.split())
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"  # a comment
    rf"|<(?P<silent>{_SILENT})(?=[\s/>]){_ATTRIBUTE}>.*?(?:</(?P=silent)\s*>|\Z)"
    rf"|<option(?=[\s/>]){_ATTRIBUTE}>[^<]*(?:</option\s*>)?"  # an option holds text only, its end tag may lack
    rf"|<(?P<bounded>{'|'.join(BOUNDED.split())})(?=[\s/>])(?P<attributes3>{_ATTRIBUTE})>"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>{_ATTRIBUTE})>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attributes2>[^>]*)>"  # with a quote left open
    r"|<[!?/][^>]*>|<[a-z/!?][^>]*\Z",  # declarations, and a tag cut off at the end
    re.IGNORECASE | re.DOTALL)
BOUNDED_END = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in BOUNDED.split()}
NAMED = re.compile(r"""\b(class|id|role|itemprop|style|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)

# --- the labelled table ----------------------------------------------------------------------

# furniture of an uncertain name
DOUBT = 0.5
FEATURES = ("furniture", "article", "heading", "words", "links", "prev_words", "prev_links", "next_words", "next_links")
# furniture: 1 inside page furniture, 0.5 inside elements of uncertain names; article: 1 inside the article, -1 outside of it, 0 on a page that marks none;
# heading: 1 for headings; links: percent of the block's words inside links; label: 1 for main text
LABELLED = """
1 -1 0   6  90    0   0   1 100  0
1 -1 0   1 100    6  90   1 100  0
1 -1 0   9   0    1 100  12   0  0
1 -1 0  80   0    9   0  60   0  0
1  1 0   4   0   50   0  30   0  0
1  1 0  30   0   60   0  25   0  0
1  1 0  25  10   30   0   0   0  0
1  1 1   2   0   90   0  20   0  0
1  1 0   3 100   45   0   3 100  0
1  0 0   5 100    0   0   4 100  0
1  0 0  40   0   70   0   8   0  0
1  0 1   2   0   70   0  12   0  0
1  0 0 120   0  100   0  90   0  0
1 -1 0  15   0  100   0   0   0  0
0 -1 0   8   0    0   0   6   0  0
0 -1 0  45   0    9   0  10   0  0
0 -1 1   3   0    0   0  70   0  0
0 -1 0  70   0   20   0   0   0  0
0 -1 0   2 100    2 100   2 100  0
0 -1 0  12   0   80   0   0   0  0
0  1 1   8   0    4 100  60   0  1
0  1 1   1   0    0   0   1   0  1
0  1 0   1   0   60   0   1   0  1
0  1 0   1   0    1   0  90   0  1
0  1 0   2   0    0   0   0   0  1
0  1 0  60   0    8   0  40   0  1
0  1 0  40   5    1   0  60  10  1
0  1 0   7  60   30   0  40   0  1
0  1 0   5 100   80   0  30   0  1
0  1 0   3 100    3 100   3 100  1
0  1 0 400   0  200   0   0   0  1
0  1 0  90  20   90   0  10   0  1
0  1 0   3   0    3   0   3   0  1
0  0 0  60   0    0   0  50   0  1
0  0 0  80   4   60   0  70   0  1
0  0 0  35   0   80   4   2   0  1
0  0 0  30   8    3   0   1 100  1
0  0 0  25   0    5   0   4   0  1
0  0 0 200  10    8   0   0   0  1
0  0 0   2   0   60   0  55   0  1
0  0 0   1   0   40   0  70   0  1
0  0 0   6   0   90   0   3   0  1
0  0 0   4   0   28   0  30   0  1
0  0 0   9   0    2   0  45   0  1
0  0 0 400   0   30 100   0   0  1
0  0 0 150   2   12  90   3   0  1
0  0 0  90   0   40 100  20 100  1
0  0 0  60   5    3 100   4 100  1
0  0 0 300   0    8  60  25   0  1
0  0 0  45   0   10 100   0   0  1
0  0 1   5   0    1 100  60   0  1
0  0 1   3   0   45   0  70   0  1
0  0 1   9   0    0   0  30   0  1
0  0 0   5 100    0   0   6 100  0
0  0 0   1 100    1 100   1 100  0
0  0 0   2 100    2 100  60   0  0
0  0 0   3 100   90   0   2 100  0
0  0 0  30  90   20  95  25  90  0
0  0 0  40  70   50  80   3   0  0
0  0 0   4   0    0   0   3   0  0
0  0 0   3   0    4   0   2 100  0
0  0 0   6   0    2 100   0   0  0
0  0 0   5   0    1 100   3   0  0
0  0 0   6 100  400   0   0   0  0
0  0 0   8 100  120   0   4 100  0
0  0 0   5  90  200   0   6   0  0
0  0 0   2   0  300   0  20   0  1
0  0 0   5   0  150   0   0   0  1
0  0 0  12   0   10   0  12   0  1
0  0 0  15   0   12   0   0   0  1
0  0 0  14   0   30   0  10   0  1
0  0 0   8   0    9   0   9   0  1
0  0 0  10   0    0   0  14   0  1
0  0 0   7   0    7   0   7   0  1
0  0 0   7   0   60   0   2 100  1
0  0 0  12   8   40  20   3  60  1
0  0 1   1   0    0   0  60   0  1
0  0 1   4   0    0   0  35   0  1
0  0 0  60   0    0   0   0   0  1
0  0 0 300   0    0   0   5   0  1
0  0 0  20   0    0   0   3   0  1
0  0 0  11   0    0   0   0   0  1
0  0 0  15   0    8 100  28   0  1
0  0 0   8   0    3 100  30   0  1
0  0 0   3   0   20 100   0   0  0
0  0 0   8   0   30 100   0   0  0
0  0 0   5   0   25  90   4 100  0
0  0 0  10   0   20 100   3 100  0
0  0 1   2   0    3   0   2 100  0
0  0 1   2   0    2 100   4   0  0
0.5 0 0  60   0    0   0   0   0  1
0.5 0 0 300   2    0   0   5   0  1
0.5 0 0  40   0   20   0  30   0  1
0.5 0 0  25   0    4 100  40   0  1
0.5 0 0  80   5    9   0   8 100  1
0.5 0 1   3   0    0   0  60   0  1
0.5 1 0  60   0    8   0  40   0  1
0.5 1 0   5   0   30   0  30   0  1
0.5 1 0  30   0    5 100   5 100  1
0.5 0 0   3 100    3 100   3 100  0
0.5 0 0   2   0    4 100   1 100  0
0.5 0 0  12  90   40   0   0   0  0
0.5 -1 0  8   0   30   0   6   0  0
0.5 -1 0 45   0    9   0  10   0  0
0.5 0 0   6   0   60   0   2   0  0
0  1 0  25   0    5 100   5 100  1
0  1 0  40   0    6 100   4 100  1
0  1 0  12   0    4 100   5 100  1
0  1 0   8   0    3 100   6 100  1
0  1 0  25   0    5 100   0   0  1
0  1 0   4   0    6 100   6 100  1
0  1 1   5 100   25   0  25   0  1
0  1 1   4 100    0   0  30   0  1
"""


def grow(rows, labels):
    """A binary decision tree (CART, Gini): (feature, threshold, low branch, high branch) or a label."""
    if len(set(labels.tolist())) == 1:
        return int(labels[0])
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            cost = sum(len(y) * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
            if best is None or cost < best[0]:
                best = (cost, f, cut)
    if best is None:  # equal rows of both labels
        return int(labels.mean() >= 0.5)
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], labels[low]), grow(rows[~low], labels[~low])


def judge(tree, rows):
    """The tree's label of every row."""
    if not isinstance(tree, tuple):
        return np.full(len(rows), bool(tree))
    f, cut, low, high = tree
    out = np.empty(len(rows), bool)
    at = rows[:, f] <= cut
    out[at], out[~at] = judge(low, rows[at]), judge(high, rows[~at])
    return out


def train():
    table = np.array([line.split() for line in LABELLED.split("\n") if line], float)
    return grow(table[:, :-1], table[:, -1])


# --- blocks ----------------------------------------------------------------------------------


def _marks(name: str, attributes: str):
    """How far an element is furniture, whether it is hidden, and whether its names say that it holds the article."""
    if not attributes.strip(" /"):
        return float(name in FURNITURE), False, False
    words, hidden, marked = set(), False, 0.0
    for k, v in NAMED.findall(attributes):
        k = k.lower()
        if k == "style":
            hidden |= bool(HIDDEN_STYLE.search(v))
        elif k == "hidden":
            hidden |= not v or v.strip("\"'").lower() in ("hidden", "until-found")
        elif k != "id" or name not in HEADINGS:
            for part in v.strip("\"'").split():
                part = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower().replace("_", "-")
                if LAYOUT_NAME.match(part):
                    continue
                own = set(re.split(r"[^a-z]+", part)) - {""}
                words |= own
                mine = {w for w in own if w in FURNITURE_WORDS or w.startswith(FURNITURE_STARTS) and w not in CONTENT_WORDS}
                if mine:
                    # an alert is announced, not always a notice; the id of a heading's text says nothing
                    sure = own - mine <= PART_WORDS and not (k == "role" and mine == {"alert"})
                    marked = max(marked, 1.0 if sure else 0.0 if k == "id" else DOUBT)
    furniture = 1.0 if name in FURNITURE or hidden else marked
    return furniture, hidden, bool(words & ARTICLE_WORDS) and not furniture


def blocks(html: str):
    """(text, words, words in links, heading, furniture, article kind, furniture around the article, article in an
    article) of each block.

    Blocks are in page order. Furniture around the article counts the furniture elements that hold the
    article element (0: none, or the block is furniture by elements inside or hidden ones). The article kind is 3 inside <article>, 2 inside <main>, 1 inside an element named like one, 0 elsewhere.
    """
    out, open_, parts = [], [], []
    links = linked = at = 0
    # furniture, article kind, inside the head, furniture so far, around the article, hidden, articles around
    start = state = (0.0, 0, False, 0, 0, False, 0)
    heading = False

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not state[2]:
                around = state[4] if state[3] == state[4] and not state[5] else 0
                out.append((text, text.count(" ") + 1, linked, heading, state[0], state[1], around, state[6] > 1))
            parts.clear()
        linked = 0

    open_ended = set()  # BOUNDED names without a later end tag
    while m := TOKEN.search(html, at):
        if m.start() > at:
            text = html[at:m.start()]
            parts.append(text)
            if links:
                linked += len(unescape(text).split())
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            name = (m["bounded"] or "").lower()
            if name and name not in open_ended and not (name == "svg" and m["attributes3"].endswith("/")):
                if end := BOUNDED_END[name].search(html, at):
                    at = end.end()
                else:
                    open_ended.add(name)
            continue
        name, closing = name.lower(), bool(m["close"] or m["close2"])
        if name in VOID:
            if name in ("br", "hr"):
                if name == "hr":
                    flush()
                else:
                    parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if name != "span" or closing and not any(x[0] == "span" for x in open_):
                continue
        if not closing:
            furniture, hidden, named = _marks(name, m["attributes"] or m["attributes2"] or "")
            if name == "span" and furniture < 1:
                open_.append((name, state, heading))
                continue
            if name not in INLINE:
                flush()
                links = 0
            elif furniture == 1:
                flush()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", *HEADINGS):
                # these end an open one of their kind
                while open_ and open_[-1][0] in ("p", "span") or open_ and name in ("li", "tr", "td", "th", "dt", "dd") and open_[-1][0] == name:
                    _, state, heading = open_.pop()
            open_.append((name, state, heading))
            kind = {"article": 3, "main": 2}.get(name, 1 if named else 0)
            own = furniture == 1 and name in ("article", "main")
            if name in ("html", "body", "article", "main"):
                furniture = 0.0
            if name == "body":
                state = start
            if name == "header" and state[1] >= 2:  # the article's own header: its headings count
                furniture = 0.0
            marks = state[3] + (furniture == 1 or bool(own))
            state = (max(state[0], furniture), max(state[1], kind), state[2] or name == "head", marks,
                     marks if kind and not state[1] and not own else state[4], state[5] or hidden,
                     state[6] + (name == "article"))
            heading = heading or name in HEADINGS
        else:
            if name not in INLINE:
                flush()
                links = 0
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name == "span" and open_[k][1] != state:
                        flush()
                    _, state, heading = open_[k]
                    del open_[k:]
                    break
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def _reset(page):
    """``page`` without the furniture around its article, if the article is more than all outside of furniture."""
    if any(b[5] and b[4] < 1 for b in page) or not (least := min((b[6] for b in page if b[5] and b[6]), default=0)):
        return page
    inside = [b[4] == 1 and b[5] > 0 and b[6] == least for b in page]
    if sum(b[1] - b[2] for b, x in zip(page, inside) if x) <= sum(b[1] - b[2] for b in page if b[4] < 1):
        return page
    return [(*b[:4], 0.0 if x else b[4], *b[5:]) for b, x in zip(page, inside)]


def _without_comments(page):
    """``page`` with articles inside an article as furniture, if the outer ones have paragraphs of their own."""
    if not any(b[7] for b in page) or not any(b[5] == 3 and b[4] < 1 and not b[7] and not b[3] for b in page):
        return page
    return [(*b[:4], 1.0 if b[7] else b[4], *b[5:]) for b in page]


def main_texts(pages: list[str], tree) -> list[str]:
    """The main text of each page of a batch."""
    found = [_without_comments(_reset(blocks(p))) for p in pages]
    rows = []
    for page in found:
        best = max((b[5] for b in page if b[4] < 1), default=0)
        words = [0] + [b[1] for b in page] + [0]
        links = [0] + [100 * b[2] / b[1] for b in page] + [0]
        for k, (_, _, _, heading, furniture, kind, *_) in enumerate(page, 1):
            article = 0 if not best else 1 if kind >= best else -1
            rows.append((furniture, article, heading, words[k], links[k], words[k - 1], links[k - 1], words[k + 1],
                         links[k + 1]))
    keep = iter(judge(tree, np.array(rows, float).reshape(-1, len(FEATURES))).tolist())
    out = []
    for page in found:
        kept = [next(keep) for _ in page]
        if not any(kept):
            kept = [b[4] < 1 and 2 * b[2] < b[1] and any(map(str.isalnum, b[0])) for b in page]
        out.append(" ".join(b[0] for b, k in zip(page, kept) if k))
    return out


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text`` and ``n_chars``."""
    names = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("__html"))
    schema = StructType([pages.schema[c] for c in names] + [StructField("text", StringType()),
                                                            StructField("n_chars", LongType())])
    tree = train()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, len(names)):
                texts = main_texts(part.column(len(names)).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
