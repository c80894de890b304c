"""Operator 6: main text from flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks. Each has its number of words and its link
density, and those of the blocks before and after it. Its place is further evidence: whether its tag
is one of running text, whether it stands in an article or main element or outside of the one that
the page has, and how many of the elements around it are named as a menu, header, footer, sidebar,
notice, advert, form or comments, surely or perhaps. A decision tree over these numbers, grown on a
labelled table of pages, tells main text from the rest.

A page is read once, from left to right, and no part of it is looked at again.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag's attributes and end. A quote counts only as the start of a value.
QUOTED = re.compile(r"""(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+>""")
#: Elements whose content is no text of the page; the first ones run to the page's end if they are not closed.
RAW_TAGS = frozenset("script style textarea title".split())
SKIPPED_TAGS = RAW_TAGS | frozenset("noscript template svg iframe select button".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: Elements whose end is tracked; others may stay open.
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table td tr ul".split())
BOILER_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of parts of a page that are no main text; words that say nothing about an element's content; and words that speak of another element.
HINTS = frozenset("ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies copyright disqus footer form header login masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
NEUTRAL = frozenset("area bar block body box button buttons cell col column container content group holder inner item items left link links list outer panel right row section slot text unit wrap wrapper".split())
STATES = frozenset("has is no not show with without".split())
WHOLE_PAGE = frozenset("global main page site top".split())
VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)""")
UNSEEN = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none)""", re.IGNORECASE)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "prose", "in_main", "outside_main", "named", "perhaps")


@dataclass
class Block:
    text: str
    words: int
    links: float
    prose: bool
    in_main: bool
    named: int
    perhaps: int


def names_of(attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element's class, id or role surely, or only perhaps, names a part that is no main text.

    The last word of a name that is not neutral says what an element is; a word before it, or a name
    about another element, is only a hint. A header of an article is part of it.
    """
    sure = perhaps = False
    if not attributes:
        return False, False
    for groups in MARK.findall(attributes):
        for name in "".join(groups).split():
            parts = [p.lower() for p in PART.findall(name)]
            while len(parts) > 1 and parts[-1] in NEUTRAL:
                parts.pop()
            if not HINTS.intersection(parts):
                continue
            head = parts[-1] in HINTS and parts[0] not in STATES
            if parts[-1] == "header":
                head = not in_main and (len(parts) == 1 or parts[0] in WHOLE_PAGE)
            sure, perhaps = sure or head, perhaps or not head
    return sure, perhaps and not sure


def hidden(attributes: str) -> bool:
    """Whether an element has the attribute ``hidden``, or a style that shows nothing. A class of such a name says neither."""
    if not attributes or "hidden" not in (low := attributes.lower()) and "none" not in low:
        return False
    return "hidden" in VALUE.sub(" ", low).split() or UNSEEN.search(low) is not None


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(kind, name or text, whether it closes, attributes): kinds are text and tag, in the page's order."""
    at, size, unclosed, quotes = 0, len(page), set(), True
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : lt if lt >= 0 else size], False, ""
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else size
            continue
        m = NAME.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<", False, ""
                at = lt + 1
            continue
        end = QUOTED.match(page, m.end()) if quotes else None
        if end is not None:
            at = end.end()
        else:
            quotes = False  # a quote stays open to the page's end: from here on every > ends a tag
            end = page.find(">", m.end())
            if end < 0:
                return  # the page ends within a tag
            at = end + 1
        name, closes, attributes = m.group(1).lower(), page[lt + 1] == "/", page[m.end() : at - 1]
        if name in SKIPPED_TAGS and not closes:
            if name in unclosed or (attributes.endswith("/") and name not in RAW_TAGS):
                continue
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if stop is not None:
                at = page.find(">", stop.end()) + 1 or size
            elif name in RAW_TAGS:
                return
            else:
                unclosed.add(name)
            continue
        yield "tag", name, closes, attributes


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page, in its order."""
    out: list[Block] = []
    inner: list[int] = []  # for each block, the names within its article alone
    forms: list[int] = []  # and how many forms it is in
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]  # tag, articles around, sure names, hints, names within the article
    open_tags: Counter[str] = Counter()
    anchor, prose, own = False, False, False

    def flush() -> None:
        words = references.unescape("".join(text)).split()
        if words:
            n = len(references.unescape(" ".join(linked)).split())
            _, main, named, perhaps, within = stack[-1]
            out.append(Block(" ".join(words), len(words), n / len(words), prose, main > 0, named + own, perhaps))
            inner.append(within + own)
            forms.append(open_tags["form"])
        text.clear()
        linked.clear()

    for kind, name, closes, attributes in tokens(page or ""):
        if kind == "text":
            text.append(name)
            if anchor:
                linked.append(name)
        elif name == "a":
            anchor = not closes
        elif name == "br":
            text.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            prose = name in PROSE_TAGS and not closes
            own = False
            if name not in CONTAINERS:
                own = not closes and (names_of(attributes, stack[-1][1] > 0)[0] or hidden(attributes))
                continue
            if closes:
                if open_tags[name]:
                    anchor = False
                    while True:
                        last = stack.pop()[0]
                        open_tags[last] -= 1
                        if last == name:
                            break
            elif not attributes.rstrip().endswith("/"):
                _, main, named, perhaps, within = stack[-1]
                sure, hint = names_of(attributes, main > 0)
                article = name in ("article", "main") and not sure
                sure = name not in ("body", "main") and (sure or name in BOILER_TAGS or hidden(attributes) or (name == "header" and not main))
                stack.append((name, main + article, named + sure, perhaps + hint, 0 if article and not main else within + sure))
                open_tags[name] += 1
    flush()
    # a form around most of a page's words is a wrapper, as some servers put around every page
    if 2 * sum(b.words for b, n in zip(out, forms, strict=True) if n) > sum(b.words for b in out):
        for k, (b, n) in enumerate(zip(out, forms, strict=True)):
            b.named, inner[k] = max(0, b.named - n), max(0, inner[k] - n)
    # if names stand around all of a page's articles, they are about the page and not about the article
    if any(b.in_main for b in out) and not any(b.in_main and not b.named for b in out):
        for b, within in zip(out, inner, strict=True):
            if b.in_main:
                b.named = within
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(found)
    if not n:
        return np.empty((0, len(FEATURES)))
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.links for b in found), 0], float)
    own = np.array([(b.prose, b.in_main, b.named, b.perhaps) for b in found], float)
    outside = float(own[:, 1].any()) * (1 - own[:, 1])
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own[:, :2], outside, own[:, 2:]])


# ---- the labelled table: pages whose main blocks stand between {{ and }} -------------------------

LABELLED = (
    "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div class=ad>Buy two lamps and get a third one free today.</div><article><h1>{{The river in spring}}</h1><p>{{The water rose by two metres within a week, and the lower meadows were flooded until the end of April.}}</p><p>{{It fell.}}</p><p>{{Farmers moved the sheep to the hills, where they stayed for the rest of the month.}}</p></article><footer>&copy; river.example</footer></body>",
    "<body><header><h1>Daily Paper</h1><p>All the news of the valley and the towns around it since 1920</p></header><main><h2>{{Bridge closed}}</h2><p>{{The old bridge has been closed for repairs. Drivers have to use the ferry, which runs every half hour.}}</p><p>{{No date is known.}}</p><div class='related'><ul><li><a href=/1>Ferry timetable changed again</a></li><li><a href=/2>Bridge to be painted</a></li></ul></div></main><aside><p>Sign our letter and help us to keep the valley green for all who live there now.</p></aside></body>",
    "<body><div id=menu><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></div><div><p>{{A page without an article element still has long paragraphs of plain text, and these have hardly any links in them at all.}}</p><p>{{Another such paragraph follows the first one; it has a <a href=/x>link</a> in it, but most of its words stand outside of the link.}}</p></div><div><a href=/p>Privacy</a> | <a href=/t>Terms</a></div></body>",
    "<body><div><a href=/>Start</a></div><div>Search</div><p>{{Bees find their way by the sun. They also remember landmarks, and tell other bees about good places by a dance on the comb.}}</p><p>{{They fly far.}}</p><p>{{How far they fly depends on the season and on what is in flower, and may be several kilometres in a dry summer.}}</p><div>Share</div><div><a href=/1>More about bees and other insects</a></div><div><a href=/2>More about flowers</a></div></body>",
    "<body><nav><a href=/>Top</a></nav><article><h1>{{Bread}}</h1><p>{{Flour, water and salt are all that it takes.}}</p><ul><li>{{500 g flour}}</li><li>{{300 g water}}</li></ul><p>{{Bake it.}}</p><section class=comments><p>I tried this at the weekend and it came out very well, thank you so much for the recipe.</p><p>Great!</p></section></article><form><p>Leave your name and your address and we shall write to you once a week.</p></form><footer><p>Written by the village baker and his family, with photographs by a friend of theirs.</p></footer></body>",
    "<body><div class='cookie notice'><p>We use cookies to make this site work better for you and for all of our other visitors.</p></div><article><h1>{{A short note}}</h1><p>{{Gone.}}</p></article><div>Our partners also offer boats, tents and bicycles for the whole of the summer, at prices that are well below those of last year, to everyone who books before the end of the month.</div><div>Call us</div></body>",
    "<body><div class=sidebar><p>Weather: rain in the morning, then some sun, and wind from the west later on in the day.</p></div><main><p>{{See <a href=/m>the map of all the walks</a>.}}</p><p>{{The walk starts at the station and follows the stream up to the mill, from where a steep path leads to the ridge.}}</p></main><footer><ul><li><a href=/i>Imprint</a></li></ul></footer></body>",
    "<body><table><tr><td><a href=/1>Archive</a></td><td><a href=/2>Forum</a></td></tr></table><div>{{The archive of the society was begun in the year of its foundation and holds letters, maps and a great many drawings of ruins.}}</div><div>{{Readers are asked to write a week ahead, because most of the boxes are kept in another building at the far end of the town.}}</div><div>Page 3 of 12</div><div><a href=/n>Next</a></div></body>",
    "<body><p>{{Short text.}}</p><p>{{Another.}}</p></body>",
    "<body><h1>{{Notice board}}</h1><p>{{The hall is closed.}}</p><ul><li>{{Monday}}</li><li>{{Friday}}</li></ul></body>",
    "<body><div class=has-sidebar><article><div class=post-header><h1>{{Shares}}</h1><p>{{By a friend}}</p></div><p>{{The day was long.}}</p><div class=share-price><p>{{The share price rose.}}</p></div><div class=related-posts><a href=/1>Prices of last year</a><a href=/2>All prices</a></div></article></div></body>",
    "<body><article><h2>{{Mills of the valley}}</h2><p>{{There were nine mills on the stream, and six of them still stand. Two can be visited.}}</p><p>{{<a href=/list>A full list of all nine</a>}}</p><p>{{The oldest was built before the town had its walls.}}</p><ul><li>{{<a href=/u>Upper mill</a>: open on Sundays from May to September}}</li><li>{{<a href=/l>Lower mill</a>: closed for repairs until next year}}</li></ul></article></body>",
    "<body><article><h1>{{Rain}}</h1><p>{{It rained for nine days without a break, and on the tenth the sun came out over the hills and stayed until the evening.}}</p><ul><li><a href=/1>Snow in the hills above the town for the first time in years</a></li><li><a href=/2>Storm takes the roof of the old school</a></li><li><a href=/3>Fog</a></li></ul></article></body>",
    "<body><article><p>{{Ships went up the river as far as the lock in most years, but never beyond the second bridge, where the water is too low.}}</p><div><a href=/1>Read on about ships</a></div><div><a href=/2>Read on about locks and rivers</a></div></article><p>Tell us what you think about this page, and we shall answer within a few days of your letter.</p></body>",
    "<body><div><a href=/>Home</a></div><div><a href=/b>All books</a></div><h1>{{A book of birds}}</h1><p>{{<a href=/m>M. Field</a> has drawn every bird of the marsh, and describes where and when each of them can be seen.}}</p><p>{{Very good.}}</p><div class=comments-wrapper><p>I have it on my desk and look at it each day before work.</p></div></body>",
    "<body><div id=site-header><h1>The Gazette</h1></div><div class=ad-slot><p>Fresh bread every day at the corner shop, now also on Sundays and holidays.</p></div><h2>{{Council meets}}</h2><p>{{The council met on Monday and spoke about the harbour, the school and the price of water for most of the evening.}}</p><p>{{No vote was taken.}}</p><div class=site-footer><p>All rights reserved by the printers and their heirs in this town and everywhere else.</p></div></body>",
    "<body><main><h1>{{On comments}}</h1><div class=comment-policy><p>{{Our rules for comments are short.}}</p><p>{{Be kind.}}</p></div><div class=comment-list><p>Fine rules, and I hope that all who write here will keep them in mind as well.</p></div><div class=share-buttons>Send it to a friend</div></main></body>",
    "<body><div><a href=/a>Articles</a> <a href=/b>Authors</a></div><div class=story><div>{{The well was dug by hand in one summer, and it has never run dry since then, not even in the three years without rain.}}</div><div>{{Nobody knows who dug it, but the stones at its rim bear the marks of at least four masons from the hill towns.}}</div></div><div>Sponsored</div><div>Print</div></body>",
    "<body><section class=newsletter-signup><p>Get our letter once a week, with all the news of the coast and the islands.</p></section><main><p>{{Gulls nest on the roofs.}}</p><p>{{They are loud.}}</p></main><section><p>More than a hundred thousand readers trust us every day with their questions about birds.</p></section></body>",
    "<body><article><h1>{{Rain by year}}</h1><p>{{The gauge on the roof has been read every morning since the school was built.}}</p><table><caption>{{Sums}}</caption><tr><th>{{Year}}</th><th>{{Rain}}</th></tr><tr><td>{{1990}}</td><td>{{20 mm}}</td></tr></table><p class=ad>Buy two lamps, and a third one is yours for nothing until the end of the week.</p></article></body>",
    "<body><div><a href=/>Front</a></div><div>Print it</div><div><a href=/a>Almanac</a></div><div>{{The ferry has crossed the lake since the days of the old mill, and it still takes an hour when the wind is from the north.}}</div><div>{{It is slow.}}</div><div>{{In winter it stops at the island only on the days of the market, and then no later than four in the afternoon.}}</div><div>{{Dress warmly.}}</div><div>{{The last boat is often full, so that those who wish to be sure of a seat should come to the landing well before it sails.}}</div><div><a href=/b>Trains</a></div><div>Send it</div><div><a href=/c>Buses</a></div></body>",
    "<body><div><a href=/1>Maps</a></div><div>Listen now</div><div><a href=/2>Tides</a></div><div>{{Salt was made on this shore for eight hundred years, first from peat and later in wide pans that were heated with coal.}}</div><div>{{Little is left.}}</div><div>{{The last pan was broken up in the year in which the railway came, and its iron went into the rails of the harbour line.}}</div><div><a href=/3>Harbour</a></div><div>Top stories</div><div><a href=/4>Railway</a></div></body>",
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page)
        rows.append(features(found))
        labels.extend("{{" in b.text for b in found)
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> dict | bool:
    """A binary decision tree by Gini impurity: a leaf is a bool, an inner node has feature, cut, low and high."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = None
    # of equally good splits, the first: link densities come before places, and both before lengths
    for f in [FEATURES.index(c) for c in ("links", "links_before", "links_after", "named", "outside_main", "in_main", "perhaps", "prose", "words", "words_before", "words_after")]:
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            score = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(cut), low)
    if best is None:
        return bool(2 * y.sum() > len(y))
    _, f, cut, low = best
    return {"feature": f, "cut": cut, "low": grow(x[low], y[low], depth - 1), "high": grow(x[~low], y[~low], depth - 1)}


def classify(tree: dict | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    low = x[:, tree["feature"]] <= tree["cut"]
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(tree["low"], x[low]), classify(tree["high"], x[~low])
    return out


def main_text(page: str | None, tree: dict | bool) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, main in zip(found, classify(tree, features(found)), strict=True) if main)


def extract(pages: DataFrame, tree: dict | bool | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text, its blocks in order, one line each.

    A null html is an empty page; a page without main blocks has an empty text. Pages are handled
    one by one without a shuffle: repeated rows stay repeated, a null id or url is kept, other
    columns are ignored, an empty table gives an empty one.
    """
    tree = grow(*labelled_blocks()) if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t, tree) for t in common.column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.map_batches(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")), run, "page_id long, url string, text string, n_chars long")
