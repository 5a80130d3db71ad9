"""Main text of web pages as the maximum-scoring contiguous run of tokens.

A page is read once into tokens: tags, runs of words with the block (and link) they stand in, and named
regions (menu, header, footer, sidebar, notice, advert, form, reader comments, by element, role or class
name).  Each kind of token has a weight, the log-odds of lying inside the article, counted on pages whose
own markup labels it (exactly one ``article`` or ``main``) and drawn to a default where it is seldom seen.
Words add their weight each, so prose counts for and lists of links count against; tags never count for.
One linear scan finds the run of tokens with the largest sum; its blocks, widened to whole blocks, are the
text.  A region counts against the run, by its weight and the logarithm of its words, so that one long
region can't part an article, and a region of negative weight that the run passes over is left out.  What
holds no prose (scripts, styles, the head, embedded objects) gives no tokens at all.

Elements nest as in HTML: open ``p li dt dd option tr td th`` elements end where the next one or their
parent does, at any depth; an article inside a region is no part of it.

Weights are counted on ``max_labelled`` pages (expected number, chosen by a hash of the page and its
address).  Names of elements that are not listed here count as one kind, so there are few hundred kinds.

Cases: null or empty page - empty text; page without tags - all its words; page whose words all stand in
regions - read again by element names only; no labelled page - default weights; equal sums - the first and
longest run; very long or deeply nested pages - one linear pass; repeated rows - extracted alike; empty
table - empty result; other columns - ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import share, slices, text_bytes

MAX_LABELLED = 20_000
CLIP = 2.0
# tokens that a kind's default weight counts as
PRIOR = 20.0
# fixed values: element names, roles and class words
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo button cite code data del dfn em font i img input ins kbd label mark q s samp select small span strike strong sub sup template time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NO_PROSE = frozenset("head script style textarea title noscript iframe svg canvas object".split())
ELEMENTS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form"}
ROLES = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer",
    "complementary": "sidebar", "form": "form", "search": "form",
}
WORDS = {
    word: region
    for region, words in {
        "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination",
        "header": "header masthead",
        "footer": "footer",
        "sidebar": "sidebar",
        "notice": "consent cookie cookies gdpr notice notices",
        "advert": "ad ads adbox adslot advert adverts advertisement advertising promo promoted promotion sponsor sponsored",
        "comments": "comment comments disqus replies reply respond",
    }.items()
    for word in words.split()
}
PROSE = frozenset("p br b i em strong span h1 h2 h3 blockquote".split())
KEPT = frozenset("body main article".split())
# a start tag ends an open element of the second set, unless one of the third stands between
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
CELLS = frozenset("td th caption table".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _region(name: str, rest: str, inside: bool, by_class: bool) -> str | None:
    """The region an element opens; ``inside``: it stands within article or main, where headers are text."""
    found = {ELEMENTS.get(name)}
    if by_class and rest and name not in ("html", "body"):
        for attr, *values in _ATTR.findall(rest):
            value = next((v for v in values if v), "")
            if attr.lower() == "role":
                found.add(ROLES.get(value.lower()))
            else:
                found.update(WORDS.get(w.lower()) for w in _CAMEL.findall(value))
    return min((r for r in found if r and not (r == "header" and inside)), default=None)


class _Open:
    """The open elements; what is looked up of them takes the same time at any depth."""

    def __init__(self) -> None:
        # name, nearest block, region in force, whether the element itself opens the region
        self.stack: list[tuple[str, str, str | None, bool]] = [("html", "body", None, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, region: str | None, opens: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, name if name in BLOCKS else self.stack[-1][1], region, opens))

    def cut(self, place: int) -> None:
        """End the element at a place and all inside it."""
        while len(self.stack) > place:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def before(self, name: str) -> None:
        """End what a start tag implies the end of."""
        if name in BLOCKS and name not in VOID:
            place = self.last(("p",))
            if place > self.last(CELLS | {"button"}):
                self.cut(place)
        ended, between = ENDED_BY.get(name, ((), ()))
        place = self.last(ended)
        if place > self.last(between):
            self.cut(place)

    def end(self, name: str) -> None:
        place = self.last((name,))
        if place < 1 or (name not in CELLS and name not in ENDED_BY and place < self.last(CELLS)):
            return
        # an inline element that ends inside a later block leaves that open
        if name in BLOCKS or self.stack[place][3] or self.blocks[-1] < place:
            self.cut(place)


def tokens(page: str, by_class: bool = True) -> list[tuple[str, int, str | None]]:
    """(kind, words, text) of a page.

    Tags: kind ``<name`` or ``</name``; text: kind ``block`` or ``block a``, behind ``@region`` in a region,
    whose tags have no kind.  A block-level tag has the text
    ``\\n``: it stands between texts of different blocks; inline tags stand between parts of one.
    """
    out: list[tuple[str, int, str | None]] = []
    open_, link, at = _Open(), False, 0

    def text(to: int) -> None:
        if to > at:
            plain = entities.unescape(page[at:to]) if "&" in page[at:to] else page[at:to]
            _, block, region, _ = open_.stack[-1]
            kind = block + (" a" if link else "")
            out.append((f"@{region} {kind}" if region else kind, len(plain.split()), plain))

    for match in iter(lambda: _TAG.search(page, at), None):
        text(match.start())
        at = match.end()
        name = match["name"] or match["name2"]
        if name is None:
            continue
        name, end, rest = name.lower(), bool(match["end"] or match["end2"]), match["rest"] or match["rest2"] or ""
        line = "\n" if name in BLOCKS else None
        if not end and name in RAW:
            closing = _ENDS[name].search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if not end and name in NO_PROSE and not rest.endswith("/"):
            at = _past(page, name, at)
            continue
        if name == "a":
            link = not end
        left = open_.stack[-1][2] if end else None
        if end:
            open_.end(name)
        else:
            open_.before(name)
            if name not in VOID:
                inside = open_.last(("article", "main")) > 0
                own = _region(name, rest, inside, by_class)
                region = own or (None if name in KEPT else open_.stack[-1][2])
                if own or not rest.endswith("/"):
                    open_.push(name, region, own is not None)
        region = left or open_.stack[-1][2]
        known = name if name in BLOCKS or name in INLINE else "other"
        out.append(("" if region else ("</" if end else "<") + known, 0, line))
    text(len(page))
    return out


def _past(page: str, name: str, at: int) -> int:
    """Where an element without prose ends: after its end tag, for the head before the body."""
    depth = 1
    for match in _TAG.finditer(page, at):
        found = (match["name"] or match["name2"] or "").lower()
        end = bool(match["end"] or match["end2"])
        if name == "head" and not end and (found in BLOCKS and found != "title"):
            return match.start()
        if found == name:
            depth += -1 if end else 0 if (match["rest"] or "").endswith("/") else 1
            if depth == 0:
                return match.end()
    return len(page)


def default_weight(kind: str) -> float:
    """Before any page is seen: prose counts for, links and tags that part blocks against."""
    if not kind:
        return 0.0
    if kind[0] == "@":
        return -1.0
    if kind[0] == "<":
        return -0.05 if kind.lstrip("</") in PROSE else -1.0
    return -0.5 if kind.endswith(" a") else 1.0 if kind in PROSE else 0.5


def weight_of(kind: str, inside: float, outside: float) -> float:
    """Log-odds of the counts, drawn to the default; tags never count for a run, nor do named regions."""
    n, odds = inside + outside, np.log((inside + 1.0) / (outside + 1.0))
    weight = float(np.clip((n * odds + PRIOR * default_weight(kind)) / (n + PRIOR), -CLIP, CLIP))
    return min(weight, -0.05) if kind[0] in "<@" else weight


def labelled_counts(page: str) -> Counter | None:
    """(kind, inside the article) of the tokens of a page whose markup has exactly one article or main."""
    found = tokens(page)
    for name in ("article", "main"):
        opened = [i for i, t in enumerate(found) if t[0] == "<" + name]
        closed = [i for i, t in enumerate(found) if t[0] == "</" + name]
        if len(opened) == 1 and len(closed) == 1 and opened[0] < closed[0]:
            counts: Counter = Counter()
            for i, (kind, n, body) in enumerate(found):
                within = opened[0] < i < closed[0]
                if kind[:1] == "<":
                    counts[kind, within] += 1
                elif n:
                    region, _, plain = kind[1:].partition(" ") if kind[0] == "@" else ("", "", kind)
                    if region:
                        counts["@" + region, within] += n
                    # links tell what lists of links look like wherever they stand
                    if not region or plain.endswith(" a"):
                        counts[plain, within] += n
            return counts
    return None


def fit(pages: DataFrame, page: str = "html", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Weights by kind of token."""
    rows = pages.where(F.col(page).isNotNull())
    share_of = min(1.0, max_labelled / max(1, rows.count()))
    address = [F.col(c) for c in (page, "url") if c in pages.columns]
    sample = rows.where(F.pmod(F.xxhash64(*address), F.lit(1 << 20)) < share_of * (1 << 20)).select(text_bytes(page).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for body in batch.column("body").to_pylist():
                total.update(labelled_counts(body.decode()) or {})
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            names=["kind", "inside", "n"],
        )

    summed = sample.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")
    )
    return {r["kind"]: weight_of(r["kind"], r["i"], r["o"]) for r in summed.collect()}


def extract_text(page: str, weights: dict[str, float]) -> str:
    """The main text of one page."""
    found = tokens(page)
    if not any(n for kind, n, _ in found if kind[:1] != "@"):
        found = tokens(page, by_class=False)

    def weight(kind: str) -> float:
        if kind[:1] == "@":
            kind = kind.split(" ", 1)[0]
        known = weights.get(kind)
        return default_weight(kind) if known is None else known

    # the maximum-scoring run, in one scan; a region's words count by the logarithm of their number so far
    best, first, last, total, start, crossed = 0.0, 0, -1, 0.0, 0, 0
    for i, (kind, n, body) in enumerate(found):
        if kind[:1] == "@":
            total += weight(kind) * (np.log1p(crossed + n) - np.log1p(crossed))
            crossed += n
        elif kind:
            crossed = 0
            total += weight(kind) * (1 if kind[0] == "<" else n)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i
    if last < 0:
        return ""
    # whole blocks: out to the nearest block-level tags, past anything that carries no words
    while first > 0 and found[first - 1][2] != "\n":
        first -= 1
    while last + 1 < len(found) and found[last + 1][2] != "\n":
        last += 1
    kept = (body or "" for kind, _, body in found[first : last + 1] if kind[:1] != "@" or weight(kind) > 0)
    return " ".join("".join(kept).split())


def extract(pages: DataFrame, weights: dict[str, float], key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text and its length in code points of every page."""
    shared = share(pages.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared()
        for batch in slices(batches, 256):
            texts = [extract_text(x.decode(), weights) for x in batch.column("_body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(key, url, text_bytes(page).alias("_body")).mapInArrow(
        run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long"
    )
