"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: an element's place is its path of
tags and classes, and each place keeps how it is presented (the run of child
elements) and which content it holds. Presentation that varies and content
that differs from page to page matter; what every page repeats does not. Pages
of a host with equal html count as one page, or copies would look like templates:

* a place that pages present in ways of shares p scores -sum(p log_m p), m
  being the pages that have it;
* a text that c of m pages hold at a place scores 1 - log_m c, and the place
  the mean over its texts;
* an inner place mixes both with its children's scores, children counting
  more the fewer there are.

Branches below ``LEAST`` go from every page of the host. The tree alone cannot
see menus and adverts whose words change from page to page, so elements that
say what they are (nav, footer, aside, form, script, ..., or such a word among
class, id and role, whole or as a part of a name like ``reader-comments``) go
as well. Such words never speak for html, body or main, nor for an element that
holds the main element or all of a page's articles. Inside an article, words
that also name plain sections (related, recommended, teaser) need ``LINKED`` of
the section's characters to be links. An article that is, or is inside, a
comment, reply, teaser or related item is no article of the page, and goes.

Where something of an article or main element stays, only that is text, but if
no main element is there and the text outside articles is ``OUTWEIGHS`` times
as long, articles are cards beside the main branch, and the other text is it.
Where the tree removes all of it, what else the page has is text, and where
nothing else stays either, the article does: an article that a whole site
repeats is still an article.

Scale. Places are counted with a partial aggregation per task, so a host with
a third of all pages is no bottleneck. A place that fewer than ``LEAST_PAGES``
pages have matters, and so do those around it; only that is remembered of it,
so the tree that one task weighs has the size of the host's templates (digits
in names are masked), not of its pages. Two narrow passes read the pages, and
one hashes them: only hashes that occur more than once are joined, and a page
of n copies counts 1/n in each. Places that go are broadcast while there are
few, and beyond that hosts are looked up so that no host lands in one task.

Defined cases. Null or blank html gives an empty text. A null or malformed url
counts as the host ''. Unclosed and stray tags are repaired as browsers do for
paragraphs, items and cells; as in browsers, elements nested deeper than
``DEPTH`` take the place of the one at that depth. Whole pages are read.
Repeated rows come back as often as they come in; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.llm.runtime import joinable, looked_up

#: Nesting that is told apart.
DEPTH = 512
#: Branches of lower importance go, where a host shows at least so many different pages.
LEAST, LEAST_PAGES = 0.2, 5
#: Links in a doubtful section of an article, and text outside articles, from which they decide.
LINKED, OUTWEIGHS = 0.3, 3
#: How fast children outweigh their parent.
GAMMA = 0.9
#: Places that are broadcast, at most.
MOST_PLACES = 2_000_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^\"'>]*+(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*+)*+|[^>]*)>", re.DOTALL
)
_NAME = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_NOISE_TAGS = frozenset(
    "nav footer aside form script style head noscript template iframe button select option textarea input dialog menu svg canvas object video audio map title".split()
)
_NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices
    alert popup modal overlay sidebar side-bar rail widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar
    comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription
    signup login search pagination pager copyright disclaimer skip cookie-banner cookie-notice cookie-consent share-buttons social-share
    related-posts comment-list comments-area site-footer site-nav main-nav ad-slot ad-container ad-banner""".split()
)
#: Words that say so as a part of a name too, unless the name begins with one of the second set.
_NOISE_PARTS = frozenset(
    """ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent newsletter sidebar breadcrumb breadcrumbs comment comments
    reply replies disqus related recommended share sharing subscribe footer nav navbar navigation pagination popup modal disclaimer teaser teasers""".split()
)
_SAYS_OTHERWISE = frozenset("has no not with without is category tag type status format template".split())
#: Words for what is not the page's own, and words that inside an article need links to tell.
_FOREIGN = frozenset("comment comments disqus reply replies respond teaser teasers related recommended recommendations comment-list comments-area related-posts".split())
_NEEDS_LINKS = frozenset("related recommended recommendations related-posts teaser teasers".split())
#: What class words never mark as noise.
_WHOLE = frozenset("html body main article".split())
#: Opening one of these closes an open element of the second set, within the third.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_DIGITS = re.compile(r"\d+")


def host(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


@lru_cache(maxsize=1 << 16)
def _said(name: str) -> str | None:
    """The noise word that a class, id or role is or has as a part."""
    if name in _NOISE_WORDS or name in _FOREIGN:
        return name
    parts = re.split("[-_]+", name)
    if len(parts) < 2 or parts[0] in _SAYS_OTHERWISE:
        return None
    return next((x for x in parts if x in _NOISE_PARTS), None)


def _names(attributes: str) -> tuple[str, bool, list[str]]:
    """The element's class, id and role, whether it is hidden, and the noise words among them."""
    words, hidden = [], False
    for name, *values in _NAME.findall(attributes):
        value = next(filter(None, values), "").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            hidden = True
        elif not name.lower().startswith("aria"):
            words += value.split()
    return ".".join(sorted(_DIGITS.sub("#", w) for w in words)), hidden, [x for x in map(_said, words) if x]


class Page:
    """Places and blocks of one page, in one pass over its tags.

    ``blocks``: (place, text, inside an article, noise). Elements that class
    words call noise are told by number until the page's end. ``shown``: the child
    elements of each place, once per element.
    """

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.shown: list[tuple[int, int]] = []
        self.parent: dict[int, int] = {}
        # Of each open element: tag, place, in article, noise, children, in the header of an article, doubtful elements around, foreign.
        self.stack: list[tuple] = [("", 0, False, False, [], False, (), False)]
        self.doubts: list[bool] = [False]  # of each doubtful element, whether links tell
        self.link, self.linked = False, 0
        self.mains: list[tuple[int, ...]] = []  # the doubtful elements around each main element
        self.articles: list[tuple[int, ...]] = []  # and around each article
        self.read: list[tuple[int, str, bool, bool, tuple[int, ...], float]] = []
        self.text: list[str] = []
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            self._add(html[at : m.start() if m else n])
            if not m:
                break
            at, tag = m.end(), (m.group(2) or "").lower()
            if not tag:
                continue
            if m.group(1):
                self._close(tag)
            else:
                self._open(tag, m.group(3))
                if tag in _RAW and not m.group(3).endswith("/"):
                    end = _RAW[tag].search(html, at)
                    self._close(tag)
                    at = end.end() if end else n
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        whole = {d for around in self.mains for d in around}
        if not self.mains and self.articles and all(self.articles):
            whole = set().union(*self.articles)
        whole |= self._plain()
        self.blocks = [(place, text, article, noise or not whole.issuperset(around)) for place, text, article, noise, around, _ in self.read]

    def _plain(self) -> set[int]:
        """Doubtful sections that links would have to tell, and do not."""
        links, chars = Counter(), Counter()
        for _, text, _, _, around, linked in self.read:
            for d in around:
                if self.doubts[d]:
                    links[d] += linked
                    chars[d] += len(text)
        return {d for d in chars if links[d] < LINKED * chars[d]}

    def _add(self, text: str) -> None:
        if text:
            self.text.append(text)
            if self.link:
                self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text = []
            if text:
                _, place, article, noise, _, _, around, _ = self.stack[-1]
                self.read.append((place, text, article, noise, around, self.linked))
        self.linked = 0

    def _pop(self) -> None:
        tag, place, _, _, children, *_ = self.stack.pop()
        if tag not in _INLINE:
            self.shown.append((place, xxhash.xxh64_intdigest(" ".join(children)) >> 1))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            self.link = self.link or tag == "a"
            return
        if tag == "br":
            self.text.append(" ")
            return
        self._flush()
        if tag in _VOID:
            return
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in within:
                    break
                if self.stack[i][0] in ends:
                    while len(self.stack) > i:
                        self._pop()
                    if tag != "tr":
                        break
        elif self.stack[-1][0] == "p":
            self._pop()
        names, noise, said = _names(attributes) if attributes else ("", False, [])
        _, parent, article, was, children, header, around, foreign = self.stack[-1]
        label = f"{tag}.{names}" if names else tag
        place = parent if len(self.stack) > DEPTH else xxhash.xxh64_intdigest(f"{parent}>{label}") >> 1
        if place != parent:
            self.parent[place] = parent
        if not children or children[-1] != label:
            children.append(label)
        noise = was or noise or tag in _NOISE_TAGS
        if tag == "header" and not noise:
            header, noise = article, not article
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        main = tag == "main" or "main" in names.split(".")
        foreign = not main and tag not in ("html", "body") and (foreign or not _FOREIGN.isdisjoint(said))
        noise = noise or (foreign and tag == "article")
        inside = article or tag == "article" or main
        if not noise and (main or tag == "article"):
            (self.mains if main else self.articles).append(around)
        if said and tag not in _WHOLE and not main and len(around) < DEPTH:
            around = (*around, len(self.doubts))
            self.doubts.append(article and _NEEDS_LINKS.issuperset(said))
        self.stack.append((tag, place, inside, noise or (header and not heading and tag != "header" and tag not in ("div", "hgroup")), [], header, around, foreign))
        if attributes.endswith("/") and tag in ("svg", "path"):
            self._pop()

    def _close(self, tag: str) -> None:
        if tag in _INLINE or tag in _VOID:
            self.link = self.link and tag != "a"
            return
        self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                break

    def main_text(self, unimportant: frozenset[int] = frozenset()) -> str:
        """The text that stays, blocks joined by two line feeds."""
        bad: dict[int, bool] = {0: False}

        def gone(place: int) -> bool:
            path = []
            while place not in bad and place not in unimportant:
                path.append(place)
                place = self.parent[place]
            found = bad.get(place, True)
            bad.update(dict.fromkeys(path, found))
            return found

        said = [b for b in self.blocks if not b[3]]
        stay = [b for b in said if not gone(b[0])]
        inside, outside = [b for b in stay if b[2]], [b for b in stay if not b[2]]
        size = lambda blocks: sum(len(b[1]) for b in blocks)
        cards = not self.mains and size(outside) > OUTWEIGHS * size(inside)
        kept = (outside if cards else inside) or stay or [b for b in said if b[2]]
        return "\n\n".join(b[1] for b in kept)


def importance(rows: list[tuple[int, int, int, int, int]]) -> dict[int, float]:
    """Of each place: its importance. ``rows``: (place, parent, kind, pages, times).

    Kind 0 counts the pages that have the place; 1 says that so many
    presentations, and 2 that so many texts, are each on so many pages. Kind 3
    says that the place holds one that too few pages have.
    """
    pages, parent, shown, texts, rare = {}, {}, defaultdict(list), defaultdict(list), set()
    for place, above, kind, n, times in rows:
        if kind == 3:
            rare.add(place)
            continue
        parent[place] = above
        if kind == 0:
            pages[place] = n
        else:
            (shown if kind == 1 else texts)[place].append((n, times))
    children = defaultdict(list)
    for place, above in parent.items():
        children[above].append(place)
    out: dict[int, float] = {}
    todo = [(p, False) for p in parent if parent[p] not in parent]
    while todo:
        place, ready = todo.pop()
        below = children[place]
        if below and not ready:
            todo += [(place, True), *[(c, False) for c in below]]
            continue
        if place in rare:
            out[place] = 1.0
            continue
        m = max(pages.get(place, 1), 1)
        log_m = math.log(m) if m > 1 else 1.0
        many = sum(k for _, k in texts[place])
        own = sum(k * (1.0 - math.log(min(n, m)) / log_m if m > 1 else 1.0) for n, k in texts[place])
        content = own / many if many else None
        if not below:
            out[place] = 1.0 if content is None and m == 1 else content or 0.0
            continue
        total = sum(n * k for n, k in shown[place]) or 1
        varied = -sum(k * n / total * math.log(n / total) for n, k in shown[place]) / log_m if m > 1 else 1.0
        share = GAMMA ** len(below)
        weight = sum(pages.get(c, 1) for c in below)
        inner = sum(out[c] * pages.get(c, 1) for c in below) / weight
        mixed = (1 - share) * min(1.0, varied) + share * inner
        out[place] = max(mixed, content or 0.0, max(out[c] for c in below))
    return out


def host_of(url: str) -> Column:
    """STRING host of the column ``url``."""

    @arrow_udf("string")
    def of(urls: pa.Array) -> pa.Array:
        return pa.array([host(u) for u in urls.to_pylist()], pa.string())

    return of(F.col(url))


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, places): the places of each host whose importance is too low."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        names = ["host", "place", "parent", "kind", "feature", "n"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]

        def emit() -> pa.RecordBatch:
            columns = list(zip(*[(*k, n) for k, n in sums.items()], strict=True)) or [[]] * 6
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for part in batches:
            for at, html, share in zip(*[part.column(c).to_pylist() for c in ("host", "html", "share")], strict=True):
                page = Page(html)
                seen = {(at, p, up, 0, 0) for p, up in page.parent.items()}
                seen.update((at, p, page.parent[p], 1, f) for p, f in page.shown if p)
                seen.update((at, p, page.parent[p], 2, xxhash.xxh64_intdigest(t) >> 1) for p, t, _, _ in page.blocks if p)
                for key in seen:
                    sums[key] += share
                if len(sums) > 200_000:
                    yield emit()
        yield emit()

    read = pages.select(host_of(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    hashed = read.withColumn("sha", F.sha2("html", 256))
    copies = hashed.groupBy("host", "sha").agg(F.count("*").alias("copies")).filter("copies > 1")
    rows = hashed.join(joinable(copies, rows=50_000), ["host", "sha"], "left").select("host", "html", F.coalesce(1.0 / F.col("copies"), F.lit(1.0)).alias("share"))
    schema = "host string, place bigint, parent bigint, kind int, feature bigint, n double"
    # Shares of copies add up to whole pages.
    counted = rows.mapInArrow(count, schema).groupBy("host", "place", "parent", "kind", "feature").agg(F.round(F.sum("n")).cast("bigint").alias("n"))
    # Of texts and presentations the tree needs only how many there are of each count.
    folded = counted.groupBy("host", "place", "parent", "kind", "n").agg(F.count("*").alias("times"))
    some = F.struct("kind", "n", "times")
    each = folded.groupBy("host", "place", "parent").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"), F.collect_list(some).alias("rows"))
    whole = each.filter(F.col("pages") >= LEAST_PAGES).select("host", "place", "parent", F.explode("rows").alias("r")).select("host", "place", "parent", "r.*")
    rare = each.filter(F.col("pages") < LEAST_PAGES).select("host", F.col("parent").alias("place")).distinct()
    rare = rare.select("host", "place", *[F.lit(x).cast(t).alias(n) for n, x, t in (("parent", 0, "bigint"), ("kind", 3, "int"), ("n", 0, "bigint"), ("times", 0, "bigint"))])

    def weigh(table: pa.Table) -> pa.Table:
        data = table.to_pydict()
        rows = list(zip(data["place"], data["parent"], data["kind"], data["n"], data["times"], strict=True))
        low = [p for p, x in importance(rows).items() if x < LEAST]
        return pa.table({"host": pa.array(data["host"][:1], pa.string()), "places": pa.array([sorted(low)], pa.list_(pa.int64()))})

    return whole.unionByName(rare).groupBy("host").applyInArrow(weigh, "host string, places array<bigint>").filter(F.size("places") > 0)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    @arrow_udf("string")
    def extract(htmls: pa.Array, places: pa.Array) -> pa.Array:
        known: dict[tuple, frozenset[int]] = {}
        out = []
        for html, low in zip(htmls.to_pylist(), places.to_pylist(), strict=True):
            key = tuple(low or ())
            if key not in known:
                known[key] = frozenset(key)
            out.append(Page(html or "").main_text(known[key]))
        return pa.array(out, pa.string())

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of("url"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    trees = style_trees(pages, url_col, html_col).join(sizes, "host")
    met = looked_up(rows, trees, "host", "n", bound=MOST_PLACES, weight=F.size("places"))
    text = met.select("id", "url", extract("html", "places").alias("text"))
    return text.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"))
