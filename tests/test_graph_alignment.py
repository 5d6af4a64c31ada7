from __future__ import annotations

import random

import pytest
from helixframe.functions import sequences as S
from helixframe.operators import alignments, graph, graph_alignment


def _bubbles(r: random.Random, n: int, flank: int = 12) -> tuple[dict, list, list[str]]:
    """A chain of bubbles: replaced, inserted and skipped bases between pieces of reference."""
    base = lambda k: "".join(r.choice("ACGT") for _ in range(k))
    nodes, edges, last = {"r0": base(flank)}, [], ["r0"]
    for k in range(n):
        a, b, nxt = f"a{k}", f"b{k}", f"r{k + 1}"
        nodes[a], nodes[nxt] = base(r.choice([1, 1, 6])), base(r.randint(3, flank))
        edges += [(x, False, a, False) for x in last] + [(a, False, nxt, False)]
        if r.random() < 0.7:
            nodes[b] = base(r.choice([1, 1, 9]))
            edges += [(x, False, b, False) for x in last] + [(b, False, nxt, False)]
        else:
            edges += [(x, False, nxt, False) for x in last]
        last = [nxt]
    return nodes, edges, ["r0"]


def _all_walks(nodes, edges, sources):
    after: dict = {}
    for a, ar, b, br in edges:
        after.setdefault((a, ar), []).append((b, br))
        after.setdefault((b, not br), []).append((a, not ar))
    todo = [[(s, False)] for s in sources]
    while todo:
        walk = todo.pop()
        if not after.get(walk[-1]):
            yield walk
        todo += [[*walk, t] for t in after.get(walk[-1], []) if t not in walk]


def _spell(nodes, walk):
    return "".join(nodes[n].translate(str.maketrans("ACGT", "TGCA"))[::-1] if rev else nodes[n] for n, rev in walk)


def _noisy(r, seq, rate):
    return "".join(r.choice(["", c + r.choice("ACGT"), r.choice("ACGT")]) if r.random() < rate else c for c in seq)


@pytest.mark.parametrize("seed", range(25))
def test_walks_cost_as_the_best_of_all(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(graph_alignment, "BAND", r.choice([2, 5, 64]))
    nodes, edges, sources = _bubbles(r, 4)
    if seed % 3 == 0:  # a piece of reference walked backwards
        nodes["inv"] = "ACGGTTA"
        edges += [("r1", False, "inv", True), ("inv", True, "r3", False)]
    walks = list(_all_walks(nodes, edges, sources))
    g = graph_alignment.WindowGraph(nodes, edges, sources)
    for rate in (0.0, 0.1, 0.4):
        read = _noisy(r, _spell(nodes, r.choice(walks)), rate)
        cost, steps = g.best_walk(read)
        assert steps in walks
        assert cost == alignments.gap_affine(read, _spell(nodes, steps))[0] == min(alignments.gap_affine(read, _spell(nodes, w))[0] for w in walks)
    assert g.best_walk("")[0] == min(alignments.gap_affine("", _spell(nodes, w))[0] for w in walks)


def test_circles_raise():
    with pytest.raises(ValueError, match="circle"):
        graph_alignment.WindowGraph({"a": "A", "b": "C"}, [("a", False, "b", False), ("b", False, "a", False)], ["a"])


def test_forty_bubbles_in_one_window(spark):
    """2^40 walks; every read finds the one it was taken from."""
    r = random.Random(40)
    base = lambda k: "".join(r.choice("ACGT") for _ in range(k))
    nodes, edges = {"r0": base(150)}, []
    for k in range(40):
        one, two = r.sample("ACGT", 2)
        nodes |= {f"a{k}": one, f"b{k}": two, f"r{k + 1}": base(30)}
        edges += [(x, False, y, False) for v in "ab" for x, y in ((f"r{k}", f"{v}{k}"), (f"{v}{k}", f"r{k + 1}"))]
    truth = []
    for _ in range(12):
        walk = [("r0", False)]
        for k in range(40):
            walk += [(r.choice([f"a{k}", f"b{k}"]), False), (f"r{k + 1}", False)]
        truth.append(walk)
    frames = (
        spark.createDataFrame([("w", _spell(nodes, w)) for w in truth] + [("w", None), ("none", "ACGT")], "window_id string, seq string"),
        spark.createDataFrame([("w", n, s) for n, s in nodes.items()], "window_id string, node string, seq string"),
        spark.createDataFrame([("w", e) for e in edges], "window_id string, edge struct<a:string,a_rev:boolean,b:string,b_rev:boolean>"),
        spark.createDataFrame([("w", "r0")], "window_id string, node string"),
    )
    found = graph_alignment.best_walks(*frames).select("seq", "cost", S.path_text("path").alias("path")).collect()
    assert {(x.seq, x.cost, x.path) for x in found} == {(_spell(nodes, w), 0, "".join(">" + n for n, _ in w)) for w in truth}


def test_best_walks_are_among_all_walks(spark):
    r = random.Random(2)
    nodes, edges, sources = _bubbles(r, 3)
    walks = list(_all_walks(nodes, edges, sources))
    ndf = spark.createDataFrame([("w", n, s) for n, s in nodes.items()], "window_id string, node string, seq string")
    edf = spark.createDataFrame([("w", e) for e in edges], "window_id string, edge struct<a:string,a_rev:boolean,b:string,b_rev:boolean>")
    sdf = spark.createDataFrame([("w", s) for s in sources], "window_id string, node string")
    listed = {x.path for x in graph.walks(edf, sdf).select(S.path_text("path").alias("path")).collect()}
    reads = spark.createDataFrame([("w", _spell(nodes, w)) for w in walks], "window_id string, seq string")
    found = {x.path for x in graph_alignment.best_walks(reads, ndf, edf, sdf).select(S.path_text("path").alias("path")).collect()}
    assert found <= listed and len(found) == len({_spell(nodes, w) for w in walks})


def test_a_read_that_one_walk_spells_needs_no_numbers(monkeypatch):
    nodes = {"a": "ACGT", "x": "A", "y": "C", "z": "GG"}
    edges = [("a", False, "x", False), ("a", False, "y", False), ("x", False, "z", False), ("y", False, "z", False)]
    graph = graph_alignment.WindowGraph(nodes, edges, ["a"])
    tied = graph_alignment.WindowGraph(nodes | {"y": "A"}, edges, ["a"])
    steps = tied.best_walk("ACGTAGG")
    monkeypatch.setattr(graph_alignment.WindowGraph, "_banded", lambda *a: (9, []))
    assert graph.best_walk("acgtcgg") == (0, [("a", False), ("y", False), ("z", False)])
    assert graph.best_walk("ACGTGG") == (9, [])
    # two walks spell it, so the numbers decide as before
    assert steps == (0, [("a", False), ("x", False), ("z", False)]) and tied.best_walk("ACGTAGG") == (9, [])
