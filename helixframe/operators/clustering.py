"""Correlation clustering of a few reads, proven: reads that pull each other together against reads that push each other apart.

A clustering loses the pulls it cuts and the pushes it joins.  Two pulls a-b and b-c
against a push a-c lose the least of the three in any clustering, so triangles
that share no weight add up to a bound; the search joins or parts the reads of the
heaviest such triangle.
"""

from __future__ import annotations

import numpy as np


def _bound(pull: np.ndarray) -> tuple[float, tuple[int, int] | None]:
    """(sum of the least weights of triangles taken out one after another, a pull of the heaviest of them)."""
    left, total, most, at = pull.copy(), 0.0, 0.0, None
    for a, c in zip(*np.nonzero(np.triu(left < 0, 1))):
        while left[a, c] < 0:
            through = np.minimum(left[a], left[c])
            b = int(through.argmax())
            weight = min(through[b], -left[a, c])
            if weight <= 0:
                break
            if weight > most:
                most, at = weight, (int(a), b) if pull[a, b] >= pull[c, b] else (int(c), b)
            total += weight
            for x, y, w in ((a, b, -weight), (c, b, -weight), (a, c, weight)):
                left[x, y] += w
                left[y, x] += w
    return total, at


def _components(pull: np.ndarray) -> np.ndarray:
    """The first member of each node's component over pulls."""
    label = np.arange(len(pull))
    while True:
        near = np.where(pull > 0, label[None, :], len(pull)).min(1, initial=len(pull))
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def clusters(pull: np.ndarray) -> np.ndarray:
    """A label for each read; ``pull`` is symmetric, positive where two reads belong together, negative where apart."""
    n = len(pull)
    out = _components(pull)
    for first in np.unique(out):
        of = np.flatnonzero(out == first)
        if len(of) > 2:
            out[of] = of[_cluster(pull[np.ix_(of, of)])]
    return out[np.arange(n)]


def _cluster(pull: np.ndarray) -> np.ndarray:
    best, kept = np.inf, np.arange(len(pull))
    # nodes are groups of reads already joined; loss is what joining and parting has cost so far
    todo = [(0.0, pull, [(k,) for k in range(len(pull))])]
    while todo:
        loss, w, groups = todo.pop()
        more, at = _bound(w)
        if loss + more >= best - 1e-9:
            continue
        if at is None:  # nothing pulls across a push: components over pulls lose nothing
            best, label = loss, _components(w)
            for node, g in enumerate(groups):
                for read in g:
                    kept[read] = groups[label[node]][0]
            continue
        a, b = sorted(at)
        parted = w.copy()
        parted[a, b] = parted[b, a] = -np.inf
        todo.append((loss + max(w[a, b], 0.0), parted, groups))
        if np.isfinite(w[a, b]):
            joined = w.copy()
            sums = w[a] + w[b]
            # a third read that pulls one and pushes the other loses the smaller of both at once
            both = np.delete(np.arange(len(w)), [a, b])
            paid = np.where(np.sign(w[a, both]) * np.sign(w[b, both]) < 0, np.minimum(np.abs(w[a, both]), np.abs(w[b, both])), 0.0).sum()
            joined[a], joined[:, a] = sums, sums
            joined[a, a] = 0.0
            rest = np.delete(np.arange(len(w)), b)
            todo.append((loss + paid + max(-w[a, b], 0.0), joined[np.ix_(rest, rest)], [groups[a] + groups[b] if k == a else groups[k] for k in rest]))
    return kept
