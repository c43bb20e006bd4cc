"""Main text of web pages by deducing each host's template.

Tokens of a page are its tags and its runs of text, told apart by the elements around them. The pages
of a host on which a token stands, and how often, are its occurrence vector; tokens with one vector
form an equivalence class. Classes of at least two tokens that at least half of the host's pages have
(and ``LEAST_PAGES``) may belong to the template. A class is valid if its tokens stand in one order on
every page, again and again, and if its spans and those of the other valid classes nest on every page:
one lies in a gap between two tokens of the other, or beside it. Where two classes cross, that of more
pages stays. The valid classes are the template; their gaps are its slots.

A slot is content or boilerplate, and in an article or not, by what most pages of the host have open
there. Only what a page opens inside a slot by itself is judged by the page's own elements. A text of the
template is boilerplate outside articles; inside one if no page of the host has text of its own at that
path. A page without any template, or with nothing left in an article, is read by its own elements.

A vector is never collected: it is the sum of one hash for each page and count, so it is aggregated
before the shuffle however many pages a host has, and a page that is there several times changes no class.
A template has at most twice as many tokens as a page of its host has on average.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from laneflow.llm import shared
from laneflow.llm.shared import F

LEAST_PAGES = 3
SHARE = 0.5
#: Content with more than so much of its text in links is a list of links.
LINKS = 0.5

#: Fixed values of HTML: elements that end a block of text, that hold no text to read, that have no end.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav "
    "noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
UNREAD = frozenset(
    "head title nav footer aside form script style noscript template iframe button select textarea option svg "
    "dialog menu object canvas audio video datalist".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind, or a new block, ends where their own end is missing.
LOOSE = frozenset("p li dd dt option tr td th".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
#: Words of class, id and role that mark what isn't the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav "
    "navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice notices gdpr popup modal "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations comment "
    "comments disqus reply replies respond login search pagination pager widget toolbar skip copyright legal alert "
    "complementary contentinfo teaser teasers tags toc masthead topbar hidden".split()
)
#: Marks that hold outside an article only: inside one they frame its own heading.
OUTER = frozenset({"header"})
WHOLE = frozenset({"html", "body", "main", "article"})
REMARKS = frozenset("comment comments reply replies disqus teaser related".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?[a-zA-Z][^\s>/]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?[a-zA-Z][^\s>/]*+)([^>]*)>"
    r"|<[!?][^>]*>"
    r"|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
CONCEALED = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none""", re.IGNORECASE)
WORDS = re.compile("[a-z0-9]+")


class Element:
    """An open element: its path's hash, whether it hides its text, and the region it belongs to."""

    __slots__ = ("name", "path", "off", "region", "link")

    def __init__(self, name: str, path: int, off: bool, region: int, link: bool):
        self.name, self.path, self.off, self.region, self.link = name, path, off, region, link


#: Regions, the better the higher.
ANY, MAIN, ARTICLE = 0, 1, 2


def opened(name: str, attributes: str, parent: Element, memo: dict) -> Element:
    key = (name, attributes, parent.path, parent.off, parent.region, parent.link) if len(attributes) < 80 else None
    found = memo.get(key)
    if found:
        return found
    marks: dict[str, str] = {}
    for m in MARKS.finditer(attributes):
        marks[m.group(1).lower()] = (m.group(2) or m.group(3) or m.group(4) or "").lower()
    words = set(WORDS.findall(" ".join(marks.values())))
    off = parent.off or name in UNREAD or (bool(attributes) and bool(CONCEALED.search(attributes)))
    region = parent.region
    if not off:
        hints = REMARKS if name in ("article", "main") else frozenset() if name in WHOLE else HINTS
        off = bool(words & hints) or (region == ANY and (name in OUTER or (name not in WHOLE and bool(words & OUTER))))
    if not off:
        if name == "article" or "articlebody" in words:
            region = ARTICLE
        elif name == "main" or marks.get("role") == "main":
            region = max(region, MAIN)
    path = xxhash.xxh64_intdigest(f"{parent.path:x}<{name} {marks.get('class', '')}")
    element = Element(name, path, off, region, parent.link or name == "a")
    if key:
        if len(memo) > 20_000:
            memo.clear()
        memo[key] = element
    return element


def parse(source: str, memo: dict) -> Iterator[tuple[int, str | None, Element, bool]]:
    """(token, text or None, element that is open behind it, whether a block ends here) in page order.

    Unclosed elements end with the element around them; ends without a beginning are left out.
    """
    root = Element("", 0, False, ANY, False)
    stack = [root]
    for m in TOKEN.finditer(source):
        text = m.group(6)
        if text is not None:
            if not text.isspace():
                top = stack[-1]
                yield xxhash.xxh64_intdigest(text.strip(), top.path & 0xFFFFFFFF), text, top, False
            continue
        tag = m.group(2) or m.group(4)
        if not tag:
            continue
        attributes = m.group(3) or m.group(5) or ""
        name = tag.lower()
        if name[0] == "/":
            name = name[1:]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    element = stack[k]
                    del stack[k:]
                    yield element.path ^ 1, None, stack[-1], any_block(name)
                    break
            else:
                if any_block(name):
                    yield 0, None, stack[-1], True
            continue
        block = any_block(name)
        if name in LOOSE or block:
            for k in range(len(stack) - 1, 0, -1):
                n = stack[k].name
                if n == "p" or (n == name and name in LOOSE):
                    del stack[k:]
                    break
                if n not in INLINE:
                    break
        if name in VOID:
            yield 0, (" " if name == "br" else None), stack[-1], block
            continue
        element = opened(name, attributes, stack[-1], memo)
        if not attributes.endswith("/") or block:
            stack.append(element)
        yield element.path, None, stack[-1], block


def any_block(name: str) -> bool:
    return name in BLOCKS


def host_of(url: Column) -> Column:
    """Host name in lower case; null or unreadable addresses share the empty host."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(found)


TOKENS = "host string, token long, pages double, high long, low long, places double, off double, region double, path long"
#: An entry of a host's template: class, place in the class, size of the class, what is open behind the
#: token, and whether it is a text at a path that has template text alone.
ENTRY = "token long, class int, at int, size int, off boolean, region int, alone boolean"


class Spot(NamedTuple):
    group: int
    at: int
    size: int
    off: bool
    region: int
    alone: bool


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def occurrences(part: pa.RecordBatch) -> pa.RecordBatch:
    """Pages, sums of page hashes, of places and of what is open behind it, of each token of each host, over a
    batch. A page that the host has n times counts 1 / n each time. ``path`` is that of a text, else null."""
    memo: dict = {}
    found: dict[tuple[str, int], list] = {}
    for host, copies, source in zip(
        part.column("host").to_pylist(), part.column("copies").to_pylist(), shared.texts(part, "html"), strict=True
    ):
        counts: dict[int, list] = {0: [1, 0.0, False, ANY, None]}
        events = [e for e in parse(source, memo) if e[0]]
        for place, (token, text, element, _) in enumerate(events):
            known = counts.get(token)
            if known:
                known[0] += 1
            else:
                path = signed(element.path) if text is not None else None
                counts[token] = [1, place / len(events), element.off, element.region, path]
        page_hash = xxhash.xxh64_intdigest(source)
        weight = 1 / copies
        for token, (n, place, off, region, path) in counts.items():
            known = found.setdefault((host, token), [0.0, 0, 0, 0.0, 0.0, 0.0, path])
            vector = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), page_hash)
            known[0] += weight
            known[1] += vector >> 32
            known[2] += vector & 0xFFFFFFFF
            known[3] += weight * place
            known[4] += weight * off
            known[5] += weight * region
    names = [x.split()[0] for x in TOKENS.split(", ")]
    kinds = [pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _ in found], pa.string()),
            pa.array([signed(k) for _, k in found], pa.int64()),
            *(pa.array([v[i] for v in found.values()], kind) for i, kind in enumerate(kinds)),
        ],
        names,
    )


def numbered_copies(pages: DataFrame) -> DataFrame:
    """``host, html, copies``: how many rows of the host have the same html. Hosts' repeated pages are few or
    many, but a row of one hash each."""
    again = (
        pages.groupBy(F.col("host").alias("_host"), F.xxhash64("html").alias("_page"))
        .agg(F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    same = (F.col("host") == F.col("_host")) & (F.xxhash64("html") == F.col("_page"))
    again = shared.materialize(again, "page-copies")
    return pages.join(again, same, "left").select("host", "html", F.coalesce("_copies", F.lit(1)).alias("copies"))


def classes(pages: DataFrame, least_pages: int, share: float) -> DataFrame:
    """``at, classes``: the equivalence classes of each host, as lists of their tokens in order of mean places."""
    tokens = (
        shared.per_batch(numbered_copies(pages), occurrences, TOKENS)
        .groupBy("host", "token")
        .agg(*(F.sum(c).alias(c) for c in ("pages", "high", "low", "places", "off", "region")), F.max("path").alias("path"))
        .filter(F.col("pages") >= least_pages - 1e-6)
    )
    tokens = shared.materialize(tokens, "page-tokens")
    hosts = tokens.filter("token = 0").select(F.col("host").alias("at"), F.col("pages").alias("all"))
    mean = lambda c: F.col(c) / F.col("pages")
    entry = F.struct(
        mean("places").alias("place"),
        "token",
        "pages",
        (mean("off") > 0.5).alias("off"),
        F.round(mean("region")).cast("int").alias("region"),
        "path",
    )
    return (
        tokens.join(hosts, F.col("host") == F.col("at"))
        .filter((F.col("token") != 0) & (F.col("pages") >= share * F.col("all") - 1e-6))
        .groupBy("at", "high", "low")
        .agg(F.sort_array(F.collect_list(entry)).alias("tokens"))
        .filter(F.size("tokens") > 1)
        .groupBy("at")
        .agg(F.sort_array(F.collect_list("tokens")).alias("classes"))
    )


def crossings(tokens: list[int], spots: dict[int, tuple[int, int, int]]) -> set[tuple[int, int]]:
    """Pairs of classes of which spans cross on a page; a class that leaves its order crosses itself.

    ``spots``: class, place in it, and its size, of each token.
    """
    found: set[tuple[int, int]] = set()
    spans: list[list[int]] = []  # open spans, the innermost last: class, tokens so far
    for token in tokens:
        spot = spots.get(token)
        if not spot:
            continue
        group, at, size = spot
        k = next((k for k in range(len(spans) - 1, -1, -1) if spans[k][0] == group), None)
        if (spans[k][1] if k is not None else 0) != at:
            found.add((group, group))
            if k is not None:
                del spans[k]
        elif k is None:
            spans.append([group, 1])
        else:
            found.update((min(group, x[0]), max(group, x[0])) for x in spans[k + 1 :])
            spans[k][1] += 1
            if spans[k][1] == size:
                del spans[k]
    return found | {(group, group) for group, _ in spans}


def objections(part: pa.RecordBatch) -> pa.RecordBatch:
    """``host, x, y``: classes that aren't valid on a page of the batch, as ``crossings``; with a null ``x``
    paths ``y`` of template texts at which a page has a text of its own."""
    memo: dict = {}
    known: dict[str, tuple[dict, set]] = {}
    found: set[tuple[str, int | None, int]] = set()
    for k, (host, source) in enumerate(zip(part.column("host").to_pylist(), shared.texts(part, "html"), strict=True)):
        if host not in known:
            groups = part.column("classes")[k].as_py() or []
            spots = {t["token"] & (2**64 - 1): (g, i, len(group)) for g, group in enumerate(groups) for i, t in enumerate(group)}
            known[host] = spots, {t["path"] for group in groups for t in group if t["path"] is not None}
        spots, paths = known[host]
        if not spots:
            continue
        events = list(parse(source, memo))
        found.update((host, x, y) for x, y in crossings([e[0] for e in events], spots))
        for token, text, element, _ in events:
            if text is not None and token and token not in spots and signed(element.path) in paths:
                found.add((host, None, signed(element.path)))
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "x", "y"])


def nested(groups: list[list[dict]], against: list[dict]) -> list[dict]:
    """The template of a host: entries of its classes that are valid, those of more pages and tokens first."""
    crossing: dict[int, set[int]] = {}
    mixed = set()
    for o in against:
        if o["x"] is None:
            mixed.add(o["y"])
        else:
            crossing.setdefault(o["x"], set()).add(o["y"])
            crossing.setdefault(o["y"], set()).add(o["x"])
    kept: set[int] = set()
    for g in sorted(range(len(groups)), key=lambda g: (-groups[g][0]["pages"], -len(groups[g]), g)):
        others = crossing.get(g, set())
        if g not in others and not others & kept:
            kept.add(g)
    mixed |= {t["path"] for g, group in enumerate(groups) if g not in kept for t in group if t["path"] is not None}
    return [
        {
            "token": t["token"], "class": g, "at": i, "size": len(groups[g]), "off": t["off"], "region": t["region"],
            "alone": t["path"] is not None and t["path"] not in mixed,
        }
        for g in sorted(kept)
        for i, t in enumerate(groups[g])
    ]


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``at, template``: the ordered and nested classes of each host, one entry for each of their tokens."""
    found = shared.materialize(classes(pages, least_pages, share), "page-classes")
    tried = pages.join(found, F.col("host") == F.col("at")).select("host", "html", "classes")
    against = shared.per_batch(tried, objections, "host string, x long, y long").distinct()
    against = against.groupBy("host").agg(F.collect_list(F.struct("x", "y")).alias("against"))
    judged = found.join(against, F.col("host") == F.col("at"), "left").select("at", "classes", "against")

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(part.column("classes").to_pylist(), part.column("against").to_pylist(), strict=True)
        entry = pa.struct(
            [("token", pa.int64()), ("class", pa.int32()), ("at", pa.int32()), ("size", pa.int32())]
            + [("off", pa.bool_()), ("region", pa.int32()), ("alone", pa.bool_())]
        )
        found = pa.array([nested(groups, objected or []) for groups, objected in rows], pa.list_(entry))
        return pa.RecordBatch.from_arrays([part.column("at"), found], ["at", "template"])

    return shared.per_batch(judged, judge, f"at string, template array<struct<{ENTRY.replace(' ', ':').replace(',:', ', ')}>>")


def spots_of(template: list[dict] | None) -> dict[int, Spot]:
    return {
        t["token"] & (2**64 - 1): Spot(t["class"], t["at"], t["size"], t["off"], t["region"], t["alone"])
        for t in template or ()
    }


def main_text(source: str, template: dict[int, Spot] | None, memo: dict) -> str:
    """Blocks of the content slots of a page, joined by an empty line."""
    template = template or {}
    blocks: list[tuple[int, bool, str, int]] = []
    words: list[str] = []
    state = [ANY, True, 0]  # region, all of it boilerplate of the template, characters in links

    def close() -> None:
        block = " ".join(html.unescape("".join(words)).split())
        if block:
            blocks.append((state[0], state[1], block, state[2]))
        words.clear()
        state[:] = ANY, True, 0

    around = None
    slots: list[tuple[Spot, Element]] = []  # slots around, the innermost last, with what was open at their beginnings
    for token, text, element, ends in parse(source, memo):
        if ends:
            close()
        spot = template.get(token)
        if spot:
            while spot.at and slots and slots[-1][0].group != spot.group:
                slots.pop()
            if spot.at and slots:
                slots.pop()
            if spot.at < spot.size - 1:
                slots.append((spot, element))
        if text is None:
            continue
        off, region = element.off, element.region
        if slots:
            slot, begun = slots[-1]
            off = off or slot.off
            if element.path == begun.path:
                region = slot.region
        if off:
            continue
        if words and around != region:
            close()
        around = region
        words.append(text)
        state[0] = region
        if not text.isspace():
            state[1] = state[1] and bool(spot) and (spot.alone or region == ANY)
            state[2] += len(text) if element.link else 0
    close()
    own = [b for b in blocks if not b[1]]
    best = max((b[0] for b in own), default=ANY)
    if best > ANY:
        # The least region that the host's content slots lie in: text of ``main`` beside its article counts.
        floor = min((s.region for s in template.values() if s.region > ANY and not s.off), default=best)
        return "\n\n".join(b[2] for b in own if b[0] >= min(floor, best))
    best = max((b[0] for b in blocks), default=ANY)
    if best > ANY:
        return "\n\n".join(b[2] for b in blocks if b[0] == best)
    return "\n\n".join(text for _, _, text, linked in own if linked <= LINKS * len(text))


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Null html is an empty page and has the empty text. Pages without a host share one; a host of few
    pages has no template, so its pages are read by their own elements. Repeated rows stay repeated;
    extra columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    # Written, so that its size is known: a small table is broadcast, and beside a large one Spark can
    # split the pages of a host that has a great share of them.
    found = shared.materialize(templates(rows.select("host", "html"), least_pages, share), "page-templates")
    joined = rows.join(found, F.col("host") == F.col("at"), "left").select("page_id", "url", "html", "at", "template")

    def read(part: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict = {}
        known: dict[str | None, dict[int, Spot]] = {None: {}}
        texts = []
        for k, (source, at) in enumerate(zip(shared.texts(part, "html"), part.column("at").to_pylist(), strict=True)):
            if at not in known:
                known[at] = spots_of(part.column("template")[k].as_py())
            texts.append(main_text(source, known[at], memo))
        return pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return shared.per_batch(joined, read, "page_id long, url string, text string, n_chars long")


def op1_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extracted(shared.table(spark, sf_dir, "pages"))
