import random

import pytest

from lattika.operators.rounds import keep
from lattika.plans.invalidations import Site, affected_pages, invalidated

PAGES, ELEMENTS, TRANSITIONS = "page string, published_at string, title string", "element string, parent string, page string, pages array<string>, label string", "id string, source string, target string, n int"


def on_pages(elements):
    """element -> pages it is on: its own, those it is available on, and those of all it lies in; chains may loop."""
    rows, out = {e[0]: e for e in elements}, {}
    for e in rows:
        seen, at, found = set(), e, set()
        while at in rows and at not in seen:
            seen.add(at)
            found |= {p for p in [rows[at][2], *(rows[at][3] or [])] if p is not None}
            at = rows[at][1]
        out[e] = found
    return out


def contents(pages, elements, transitions):
    """page -> all that it holds, computed in full."""
    on = on_pages(elements)
    ids = {p[0] for p in pages} | {p for found in on.values() for p in found} | {p for t in transitions for p in t[1:3]}
    titles = {p[0]: p[2] for p in pages}
    return {p: (titles.get(p), p in titles, sorted((str(tuple(e)) for e in elements if p in on[e[0]])), sorted(str(tuple(t)) for t in transitions if p in t[1:3])) for p in ids if p is not None}


def edited(rnd, pages, elements, transitions, edits):
    pages, elements, transitions = ([list(r) for r in t] for t in (pages, elements, transitions))
    for _ in range(edits):
        kind = rnd.choice(["label", "parent", "page", "pages", "add", "remove", "move", "title", "publish"])
        e = rnd.choice(elements)
        if kind == "label":
            e[4] = f"new{rnd.random()}"
        elif kind == "parent":
            e[1] = rnd.choice([None, rnd.choice(elements)[0]])
        elif kind == "page":
            e[2] = rnd.choice([None, "p1", "p2"])
        elif kind == "pages":
            e[3] = rnd.choice([None, [], ["p3"], ["p4", "p5"]])
        elif kind == "add":
            elements.append([f"new{rnd.random()}", e[0], None, [], "l"])
        elif kind == "remove":
            elements.remove(e)
        elif kind == "move":
            rnd.choice(transitions)[rnd.choice([1, 2])] = rnd.choice(["p1", "p9", None])
        elif kind == "title":
            rnd.choice(pages)[2] += "!"
        else:
            rnd.choice(pages)[1] = rnd.choice([None, "now"])
    return pages, elements, transitions


@pytest.mark.parametrize("edits", [0, 1, 2, 12])
def test_affected_pages_equal_full_recomputation(spark, edits):
    rnd = random.Random(edits)
    pages = [(f"p{i}", rnd.choice([None, "then"]), "t") for i in range(12)]
    elements = [(f"e{i}", rnd.choice([None, f"e{rnd.randrange(40)}"]), rnd.choice([None, f"p{rnd.randrange(12)}"]), rnd.choice([None, [], [f"p{rnd.randrange(12)}"]]), "l") for i in range(40)]
    transitions = [(f"t{i}", f"p{rnd.randrange(12)}", f"p{rnd.randrange(12)}", 0) for i in range(15)]
    after = edited(rnd, pages, elements, transitions, edits)
    site = lambda t: Site(*(spark.createDataFrame([tuple(r) for r in rows], schema) for rows, schema in zip(t, (PAGES, ELEMENTS, TRANSITIONS))))
    before, now = site((pages, elements, transitions)), site(after)
    old, new = contents(pages, elements, transitions), contents(*after)
    want = {p for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    assert {r.page for r in affected_pages(before, now, keep).collect()} == want
    was = {p[0]: p[1] for p in pages}
    assert {r.page: r.published_at for r in invalidated(before, now, keep).collect()} == {p[0]: None if was.get(p[0]) and p[0] in want else p[1] for p in after[0]}
