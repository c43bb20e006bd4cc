"""Templates of hosts: classes, their order and nesting against plain code, and what they decide on a page."""

import random
from collections import Counter

from laneflow.llm import templates

NOTE = "<div class=box>Read also our letters</div>"
POST = "<body><main><p>Lead %d of its own</p><article><h1>Title %d</h1><p>Words %d</p>" + NOTE + "<p>More %d</p><p>As ever</p></article></main></body>"


def plain_classes(pages):
    """Valid classes of one host's pages, as sets of tokens, from whole vectors and explicit spans."""
    rows = [[e[0] for e in templates.parse(page, {}) if e[0]] for page in dict.fromkeys(pages)]
    counts = [Counter(r) for r in rows]
    groups = {}
    for token in set().union(*rows):
        groups.setdefault(tuple(c[token] for c in counts), []).append(token)
    found = []
    for vector, group in groups.items():
        pages_of = sum(map(bool, vector))
        if len(group) > 1 and pages_of >= 3 and 2 * pages_of >= len(rows):
            first = rows[next(k for k, n in enumerate(vector) if n)]
            group.sort(key=first.index)
            if all([t for t in r if t in group] == group * n for r, n in zip(rows, vector, strict=True)):
                found.append((pages_of, len(group), group))

    def spans(row, group):
        at = [i for i, t in enumerate(row) if t in group]
        return [at[i : i + len(group)] for i in range(0, len(at), len(group))]

    def inside(x, y):
        """All of x between two neighbours of y, or beside y."""
        return len({sum(place < i for place in y) for i in x}) == 1

    kept = []
    for _, _, group in sorted(found, key=lambda f: (-f[0], -f[1])):
        if all(inside(x, y) or inside(y, x) for other in kept for r in rows for x in spans(r, group) for y in spans(r, other)):
            kept.append(group)
    return {frozenset(g) for g in kept}


def site(seed):
    """Pages with frames that nest, repeat, cross on some pages, or swap their order on one."""
    rng = random.Random(seed)
    tag = lambda name: f"<i class={name}></i>"
    out = []
    for k in range(12):
        parts = [tag("a1")]
        if k < 10:
            parts += [tag("b1"), f"own {k}", tag("b2")]
        parts += [tag("r1") + f"item {k}" + tag("r2")] * rng.randrange(1, 4)
        if k < 9:  # crosses the frame x1..x3 on one page
            parts += [tag("y1"), tag("x1"), tag("x2"), tag("x3"), tag("y2")] if k else [tag("x1"), tag("y1"), tag("x2"), tag("y2"), tag("x3")]
            if k == 5:
                parts[-5:] = [tag("x1"), tag("y1"), tag("x2"), tag("x3"), tag("y2")]
        if k < 8:
            parts += [tag("s1"), tag("s2")] if k != 3 else [tag("s2"), tag("s1")]
        out.append("<body>" + "".join([*parts, tag("a2")]) + "</body>")
    return out


def test_classes_equal_plain_code(spark):
    hosts = {f"h{seed}": site(seed) for seed in range(4)} | {"posts": [POST % (k, k, k, k) for k in range(6)]}
    rows = [(h, page) for h, pages in hosts.items() for page in pages] + [("h1", page) for page in hosts["h1"][:5] * 2]
    df = spark.createDataFrame(rows, "host string, html string").repartition(5)
    found = {r.at: r.template for r in templates.templates(df).collect()}
    dropped = 0
    for host, pages in hosts.items():
        groups = {}
        for t in found[host]:
            groups.setdefault(t["class"], []).append((t["at"], t["token"] & (2**64 - 1)))
        assert {frozenset(t for _, t in g) for g in groups.values()} == plain_classes(pages)
        assert all(sorted(at for at, _ in g) == list(range(len(g))) for g in groups.values())
        vectors = Counter(tuple(p.count(f"class={c}>") for p in pages) for c in ("x1", "y1", "s1", "b1", "r1"))
        dropped += len(vectors) > len(groups)
    assert dropped == 4


def test_crossings():
    spots = {1: (0, 0, 3), 2: (0, 1, 3), 3: (0, 2, 3), 7: (1, 0, 2), 8: (1, 1, 2)}
    assert templates.crossings([1, 7, 8, 7, 8, 2, 3, 1, 2, 7, 8, 3, 7, 8], spots) == set()
    assert templates.crossings([1, 7, 2, 8, 3], spots) == {(0, 1)}
    assert templates.crossings([1, 3, 2], spots) >= {(0, 0)}
    assert templates.crossings([7, 1, 2, 3], spots) == {(1, 1)}


def test_template_decides_in_articles(spark):
    """A note at a path of its own goes, a repeated paragraph among others' stays, text of ``main`` counts."""
    rows = [(k, "http://posts.example/", POST % (k, k, k, k)) for k in range(6)]
    rows += [(10 + k, "http://few.example/", POST % (k, k, k, k)) for k in range(2)]
    # Copies of one page: nothing varies, so the page's own elements count.
    rows += [(20 + k, "http://one.example/", POST % (7, 7, 7, 7)) for k in range(5)]
    df = spark.createDataFrame([*rows, *rows[:6]], "page_id long, url string, html string").repartition(4)
    out = {r.page_id: r.text for r in templates.extracted(df).collect()}
    for k in range(6):
        assert out[k] == f"Lead {k} of its own\n\nTitle {k}\n\nWords {k}\n\nMore {k}\n\nAs ever"
    whole = "Title %d\n\nWords %d\n\nRead also our letters\n\nMore %d\n\nAs ever"
    assert [out[10], out[11], out[20], out[24]] == [whole % (k, k, k) for k in (0, 1, 7, 7)]
    assert templates.extracted(df).count() == len(rows) + 6
