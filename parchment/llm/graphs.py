"""Embedding near-duplicates over hierarchical navigable small-world graphs, one per label.

Equal vectors are collapsed first. A graph is fitted on a bounded sample of a label's vectors and grown by insertion: nodes
come in batches, each finds its neighbours by a search of the graph so far, keeps those the diversity rule allows, and is
linked back. Every vector is then searched in its label's graph: the node found nearest is its cell, and it visits the
cells of the ``visits`` nearest. Two vectors are compared when either visits the other's cell. Cells are packed into shards,
which are files of the shared folder; only paths travel after that, and every pair of shards of a label is looked at once.

Recall is measured. For each graph probes are made at just the least cosine from sampled vectors, and visits are raised by quarters until
all but a few thousandths meet their vector; where that takes so many that a scan is cheaper, all pairs are scanned. Each pair
of shards is measured again with some of its real vectors against a scan. Found pairs are decided by cosine in double
precision: products in single precision stand only where they are further from the threshold than their error can be. A task
returns counts and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

import io
import logging
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.components import components
from parchment.llm.store import dropped, new_path, open_fs, removed, written
from parchment.llm.text import mix

#: Bytes of a shard's vectors in memory (12 a component), so that shards of wide vectors hold fewer.
SHARD_BYTES = 48 << 20
#: Links of a node, those among them that are drawn at random (in the lowest level), and the share of nodes a level up.
LINKS, RANDOM, STEP_UP = 24, 2, 8
#: Beam of insertion, nodes inserted at once at most, and queries searched at once.
BUILD_BEAM, INSERTED, CHUNK = 40, 512, 256
#: First beam; probes of a graph, real queries audited a pair of shards, and the recall that both must reach.
BEAM, PROBES, AUDITED, RECALL = 24, 512, 48, 0.997
#: Vectors of a cell on average, and nodes of a graph, at most, on which a label's cells are fitted.
CELL, CELLS = 512, 16384
#: First visits and most of them, and nodes of a level that is scanned and not walked, in a graph of cells.
VISITS, MOST_VISITS, SCANNED = 4, 64, 4096
#: A pair of shards is scanned if so many real links, and this share of them, were missed.
MISSED, MISSED_SHARE = 2, 0.03
#: Rows and columns of similarities that are held at once.
ROWS, COLUMNS = 4096, 512
#: Shards whose vectors a task takes to one shard.
GROUP = 8

log = logging.getLogger(__name__)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one; the greatest component is divided out first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Graph:
    """A shard's vectors, scaled to length one, and the links of each level, lowest first (-1: none)."""

    ids: np.ndarray
    reps: np.ndarray
    weight: np.ndarray
    exact: np.ndarray  # float64
    levels: list[tuple[np.ndarray, np.ndarray]]  # members, links as positions among all vectors
    beam: int = 0  # 0: to be scanned
    probes: int = 0
    found: int = 0

    def __post_init__(self) -> None:
        self.unit = self.exact.astype(np.float32)
        n, (members, links) = len(self.ids), self.levels[0]
        row, slot = np.nonzero(links >= 0)
        node, other = members[row], links[row, slot].astype(np.int64)
        pair = np.unique(np.concatenate([node * n + other, other * n + node]))
        #: all links of the lowest level in both directions: where a node's begin, and their ends
        self.first = np.searchsorted(pair // max(n, 1), np.arange(n + 1))
        self.ends = (pair % max(n, 1)).astype(np.int32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        levels = {f"{k}{i}": x for i, pair in enumerate(self.levels) for k, x in zip("ml", pair, strict=True)}
        np.savez(out, ids=self.ids, reps=self.reps, weight=self.weight, exact=self.exact, state=np.array([len(self.levels), self.beam, self.probes, self.found]), **levels)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        n, beam, probes, found = x["state"].tolist()
        return Graph(x["ids"], x["reps"], x["weight"], x["exact"], [(x[f"m{i}"], x[f"l{i}"]) for i in range(n)], beam, probes, found)


def diverse(unit: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (-1: none), nearest first: those nearer to the row than to any kept before, then,
    for the places left, the nearest that this rule passed over."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    n, k = cand.shape
    out = np.full((n, keep), -1, np.int32)
    step = max(8, (1 << 21) // max(1, k * unit.shape[1]))
    for a in range(0, n, step):
        c, own = cand[a : a + step], sims[a : a + step]
        x = unit[c]
        among = x @ x.transpose(0, 2, 1)
        rows = np.arange(len(c))
        taken, count = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
        for j in range(k):
            blocked = (taken & (among[:, j, :] > own[:, j : j + 1])).any(1)
            use = rows[~blocked & (count < keep) & (c[:, j] >= 0)]
            out[a + use, count[use]] = c[use, j]
            taken[use, j] = True
            count[use] += 1
        for j in range(k):
            use = rows[~taken[:, j] & (count < keep) & (c[:, j] >= 0)]
            out[a + use, count[use]] = c[use, j]
            count[use] += 1
    return out


def link_back(unit: np.ndarray, links: np.ndarray, place: np.ndarray, new: np.ndarray) -> None:
    """Link the new nodes' neighbours to them; a node with too many links keeps those the diversity rule allows."""
    source, slot = np.nonzero(links[place[new]] >= 0)
    target = links[place[new]][source, slot].astype(np.int64)
    source = new[source]
    sims = np.einsum("pd,pd->p", unit[source], unit[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(begin, count)
    near = nth < LINKS  # of one batch's the nearest
    more = np.full((len(nodes), LINKS), -1, np.int64)
    more[np.repeat(np.arange(len(nodes)), count)[near], nth[near]] = source[near]
    old = links[place[nodes]].astype(np.int64)
    more[(more[:, :, None] == old[:, None, :]).any(2)] = -1  # linked already
    cand = np.concatenate([old, more], 1)
    full = (cand >= 0).sum(1) > links.shape[1]
    rest = np.flatnonzero(~full)
    packed = np.take_along_axis(cand[rest], np.argsort(cand[rest] < 0, axis=1, kind="stable"), 1)
    links[place[nodes[rest]]] = packed[:, : links.shape[1]]
    for a in range(0, full.sum(), 2048):
        at = np.flatnonzero(full)[a : a + 2048]
        s = np.einsum("ncd,nd->nc", unit[cand[at]], unit[nodes[at]])
        links[place[nodes[at]]] = diverse(unit, cand[at], np.where(cand[at] >= 0, s, -np.inf), links.shape[1])


def grown(unit: np.ndarray, members: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]], seed: int) -> np.ndarray:
    """Links of one level, whose ``members`` are ordered so that those of the levels above come first."""
    n, total = len(members), len(unit)
    links = np.full((n, LINKS), -1, np.int32)
    place = np.full(total, -1, np.int64)
    place[members] = np.arange(n)
    top = above[0][0] if above else members[:64]
    done = 0
    while done < n:
        batch = members[done : done + min(INSERTED, max(64, done))]
        x = unit[batch]
        own = x @ x.T
        np.fill_diagonal(own, -np.inf)
        k = min(16, len(batch) - 1)
        near = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(batch), 0), np.int64)
        cand, sims = batch[near], np.take_along_axis(own, near, 1)
        if done:
            start = descended(unit, x, above) if above else top[None, :].repeat(len(batch), 0)
            start = np.where((start >= 0) & (place[start] < done), start, top[0])
            found, s = beam_search(unit, x, links, place, start, BUILD_BEAM, np.zeros((len(batch), total), bool))
            cand, sims = np.concatenate([cand, found], 1), np.concatenate([sims, np.where(found >= 0, s, -np.inf)], 1)
        picked = diverse(unit, cand.astype(np.int64), sims, LINKS // 2)
        links[place[batch], : LINKS // 2] = picked
        done += len(batch)
        link_back(unit, links, place, batch)
    rng = np.random.default_rng(seed)
    return np.concatenate([links, rng.choice(members, (n, RANDOM)).astype(np.int32)], 1)


def beam_search(
    unit: np.ndarray, q: np.ndarray, links: np.ndarray, of: np.ndarray, start: np.ndarray, beam: int, seen: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` nodes of one level for each query, from the nodes in ``start``; all visited are set in ``seen``.

    ``of`` maps a node to its row of ``links``. Queries advance together: each step expands every query's best open
    node.
    """
    n = len(q)
    found = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    width = min(start.shape[1], beam)
    found[:, :width] = start[:, :width]
    again = (found[:, :width, None] == found[:, None, :width]) & np.tri(width, k=-1, dtype=bool)
    found[:, :width][again.any(2)] = -1
    rows = np.arange(n)
    valid = found >= 0
    sims[valid] = np.einsum("pd,pd->p", unit[found[valid]], q[np.nonzero(valid)[0]])
    seen[np.nonzero(valid)[0], found[valid]] = True
    done = ~valid
    live = rows
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        best = open_.argmax(1)
        going = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        near = links[of[found[live, best]]].astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        _, one = np.unique(live[r] * len(unit) + near[r, c], return_index=True)  # a node may be linked twice
        fresh[:] = False
        fresh[r[one], c[one]] = True
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("pd,pd->p", unit[near[r, c]], q[live[r]])
        all_sims = np.concatenate([sims[live], s], 1)
        all_found = np.concatenate([found[live], near], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live], found[live] = np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_found, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)


def descended(unit: np.ndarray, q: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where to begin in the level under ``above``: the nodes found nearest on the way down."""
    top = above[-1][0]
    start = top[np.argsort(-(q @ unit[top].T), axis=1, kind="stable")[:, :8]]
    place = np.full(len(unit), -1, np.int64)
    for members, links in reversed(above):
        place[members] = np.arange(len(members))
        start, _ = beam_search(unit, q, links, place, start, 8, np.zeros((len(q), len(unit)), bool))
    return start


def build(ids: np.ndarray, reps: np.ndarray, weight: np.ndarray, vectors: np.ndarray, least: float | None) -> Graph:
    """Levels are drawn from the ids' hashes, so a shard's graph is the same on every run. Without ``least`` its beam isn't set."""
    order = np.argsort(ids, kind="stable")
    exact = unit_rows(vectors[order])
    unit, draw = exact.astype(np.float32), mix(ids[order].view(np.uint64))
    height, level = np.zeros(len(ids), np.int64), draw
    while True:
        level = mix(level)
        up = (height == height.max()) & (level % np.uint64(STEP_UP) == 0)
        if (height == height.max()).sum() <= 64 or not up.any():
            break
        height[up] += 1
    members = np.lexsort((draw, -height))
    above: list[tuple[np.ndarray, np.ndarray]] = []
    for h in range(height.max(), -1, -1):
        own = members[height[members] >= h]
        above.insert(0, (own, grown(unit, own, above, h)))
    g = Graph(ids[order], reps[order], weight[order], exact, above)
    if least is not None:
        probed(g, least)
    return g


def made(exact: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """PROBES vectors at just the least cosine from rows of ``exact``, and the row of each."""
    n, d = exact.shape
    rng = np.random.default_rng(n)
    node = rng.choice(n, PROBES, replace=n < PROBES)
    x = exact[node]
    aside = rng.normal(size=(PROBES, d))
    aside[PROBES // 2 :] = exact[rng.integers(0, n, PROBES - PROBES // 2)]
    aside -= (aside * x).sum(1, keepdims=True) * x
    size = np.sqrt((aside * aside).sum(1, keepdims=True))
    sound = size[:, 0] > 1e-6
    node, x, aside = node[sound], x[sound], aside[sound] / size[sound]
    cosine = least + (1 - least) * 1e-6
    return node, unit_rows(cosine * x + np.sqrt(1 - cosine * cosine) * aside)


def probed(g: Graph, least: float) -> None:
    """Set the beam by probes: vectors at just the least cosine from nodes spread over the shard, half of them off in any
    direction and half towards another node. A probe is found if the search gives back its node."""
    n, d = g.exact.shape
    if d < 4 or not 0 < least < 1:
        return
    node, q = made(g.exact, least)
    g.probes, beam = len(q), BEAM
    while beam < n // 8:
        g.found = 0
        for a in range(0, len(q), CHUNK):
            r, c = search(g, q[a : a + CHUNK].astype(np.float32), q[a : a + CHUNK], least, beam)
            g.found += len(np.unique(r[c == node[a + r]]))
        if len(q) and g.found >= RECALL * len(q):
            g.beam = beam
            return
        beam *= 2
    g.found = len(q)  # a scan finds them all


def search(g: Graph, q: np.ndarray, exact_q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine of at least ``least``: descend, then spread from every node found close."""
    n = len(g.ids)
    above = g.levels[1:]
    start = descended(g.unit, q, above) if above else np.tile(g.levels[0][0][:64], (len(q), 1))
    seen = np.zeros((len(q), n), bool)
    found, sims = beam_search(g.unit, q, g.levels[0][1], np.argsort(g.levels[0][0]), start, beam, seen)
    near = 1 - (1 - least) * 1.8  # spread a little beyond the threshold, to cross gaps in a group
    spread = np.zeros((len(q), n), bool)
    r, c = np.nonzero((sims >= near) & (found >= 0))
    spread[r, found[r, c]] = True
    r, c = np.nonzero(spread)
    hits_r, hits_c = [r], [c]
    while len(r):
        more_r, more_c = [], []
        for a in range(0, len(r), 20_000):
            own_r, own_c = r[a : a + 20_000], c[a : a + 20_000]
            n_ends = g.first[own_c + 1] - g.first[own_c]
            take = np.arange(n_ends.sum()) + np.repeat(g.first[own_c] - (np.cumsum(n_ends) - n_ends), n_ends)
            rows, nodes = np.repeat(own_r, n_ends), g.ends[take].astype(np.int64)
            ok = ~spread[rows, nodes]
            flat = np.unique(rows[ok] * n + nodes[ok])
            rows, nodes = flat // n, flat % n
            close = np.einsum("pd,pd->p", g.unit[nodes], q[rows]) >= near
            rows, nodes = rows[close], nodes[close]
            spread[rows, nodes] = True
            more_r.append(rows)
            more_c.append(nodes)
        r, c = np.concatenate(more_r), np.concatenate(more_c)
        hits_r.append(r)
        hits_c.append(c)
    r, c = np.concatenate(hits_r), np.concatenate(hits_c)
    keep = np.zeros(len(r), bool)
    for a in range(0, len(r), 50_000):
        s = slice(a, a + 50_000)
        keep[s] = np.einsum("pd,pd->p", exact_q[r[s]], g.exact[c[s]]) >= least
    return r[keep], c[keep]


def scanned(g: Graph, exact_q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(exact_q @ g.exact.T >= least)


def looked_up(g: Graph, exact_q: np.ndarray, keys: np.ndarray, least: float, audit: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (query, node) of a block, chunk by chunk, a vector with itself apart.

    AUDITED queries, spread over the block, are also scanned: while too few of their links are found the beam is doubled,
    in the end to a scan. ``audit`` takes the links that were looked for and found.
    """
    q, beam = exact_q.astype(np.float32), g.beam
    picks = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(np.int64))
    others = lambda rows, r, c: {(a, b) for a, b in zip(rows[r].tolist(), c.tolist(), strict=True) if keys[a] != g.ids[b]}
    truth = others(picks, *scanned(g, exact_q[picks], least))
    got = truth
    while beam and truth:
        got = truth & others(picks, *search(g, q[picks], exact_q[picks], least, beam))
        if len(got) >= RECALL * len(truth):
            break
        beam = beam * 2 if beam * 2 < len(g.ids) // 8 else 0
        got = truth
    if audit is not None:
        audit |= {"beam": beam, "links": len(truth), "found": len(got)}
    for a in range(0, len(q), CHUNK):
        s = slice(a, a + CHUNK)
        r, c = search(g, q[s], exact_q[s], least, beam) if beam else scanned(g, exact_q[s], least)
        other = keys[a + r] != g.ids[c]
        yield a + r[other], c[other]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the links (a, b) join."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def top_of(sims: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` greatest of each row, greatest first (-1: none); equal ones in their order."""
    n, k = sims.shape
    least = np.full(n, -np.inf, np.float32)
    part = k // 16
    if part > 2 * most:  # the least of as many different strips' greatest bounds what has to be sorted
        strips = sims[:, : part * 16].reshape(n, 16, part).max(1)
        least = np.partition(strips, part - most, axis=1)[:, part - most]
    elif k > most:
        least = np.partition(sims, k - most, axis=1)[:, k - most]
    row, place = np.divmod(np.flatnonzero(sims >= least[:, None]), k)
    order = np.lexsort((-sims[row, place], row))
    row, place = row[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    out = np.full((n, most), -1, np.int32)
    near = nth < most
    out[row[near], nth[near]] = place[near]
    return out


def nearest(g: Graph, q: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` nodes for each query, nearest first (-1: none).

    Of the levels with SCANNED nodes at most the lowest is scanned, by one matrix product, which costs less than a walk and
    misses nothing; those under it are walked by beams.
    """
    out = np.full((len(q), most), -1, np.int32)
    top = next((h for h, (members, _) in enumerate(g.levels) if len(members) <= SCANNED), len(g.levels) - 1)
    of = [np.zeros(0, np.int64)] * len(g.levels)
    for h in range(top):
        of[h] = np.full(len(g.ids), -1, np.int64)
        of[h][g.levels[h][0]] = np.arange(len(g.levels[h][0]))
    members = g.levels[top][0]
    unit = g.unit[members]
    beam = max(BEAM, 2 * most)
    for a in range(0, len(q), CHUNK):
        own = q[a : a + CHUNK]
        found = top_of(own @ unit.T, min(beam if top else most, len(members)))
        found = np.where(found >= 0, members[found], -1)
        for h in range(top - 1, -1, -1):
            found, _ = beam_search(g.unit, own, g.levels[h][1], of[h], found, beam, np.zeros((len(own), len(g.ids)), bool))
        found = found[:, :most]
        out[a : a + CHUNK, : found.shape[1]] = found
    return out


def visits_for(g: Graph, exact: np.ndarray, least: float) -> tuple[int, int, int]:
    """Cells that a vector has to visit, probes made around the rows of ``exact``, and how many of them met their row.

    A probe meets its row if either visits the cell of the other. 0 visits: all pairs are to be scanned.
    """
    if exact.shape[1] < 4 or not 0 < least < 1 or not len(exact):
        return 0, 0, 0
    node, q = made(exact, least)
    visits = VISITS
    x, y = exact[node].astype(np.float32), q.astype(np.float32)
    while len(q) and visits <= MOST_VISITS and visits < len(g.ids) // 4:
        near_x, near_y = nearest(g, x, visits), nearest(g, y, visits)
        n_met = ((near_x == near_y[:, :1]).any(1) | (near_y == near_x[:, :1]).any(1)).sum()
        if n_met >= RECALL * len(q):
            return visits, len(q), int(n_met)
        visits += -(-visits // 4)
    return 0, len(q), len(q)


@dataclass
class Shard:
    """Vectors ordered by cell, with the cells that each visits (its own first; without columns: all pairs are scanned)."""

    ids: np.ndarray
    reps: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    cell: np.ndarray
    visits: np.ndarray

    def __post_init__(self) -> None:
        self.exact = unit_rows(self.vectors.astype(np.float64))
        self.unit = self.exact.astype(np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, reps=self.reps, weight=self.weight, vectors=self.vectors, cell=self.cell, visits=self.visits)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Shard:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        return Shard(*(x[k] for k in ("ids", "reps", "weight", "vectors", "cell", "visits")))


def linked(a: Shard, x: np.ndarray | slice, b: Shard, y: np.ndarray | slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places among the rows ``x`` of a and ``y`` of b whose cosine is ``least`` or more."""
    sims = a.unit[x] @ b.unit[y].T
    error = 2e-7 * (a.unit.shape[1] + 8)
    r, c = np.divmod(np.flatnonzero(sims >= least - error), sims.shape[1])
    unsure = np.flatnonzero(sims[r, c] < least + error)
    if len(unsure):
        sure = np.ones(len(r), bool)
        ends = [np.arange(len(s.ids))[k] for s, k in ((a, x), (b, y))]
        for i in range(0, len(unsure), 50_000):
            u = unsure[i : i + 50_000]
            sure[u] = np.einsum("pd,pd->p", a.exact[ends[0][r[u]]], b.exact[ends[1][c[u]]]) >= least
        r, c = r[sure], c[sure]
    return r, c


def visited(a: Shard, b: Shard, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of a, row of b) where the row of b visits the cell of that of a."""
    row, slot = np.nonzero((b.visits >= a.cell[0]) & (b.visits <= a.cell[-1]))
    at = b.visits[row, slot]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    cells, first = np.unique(at, return_index=True)
    first = np.append(first, len(at))
    begin, end = np.searchsorted(a.cell, cells), np.searchsorted(a.cell, cells, "right")
    for k in np.flatnonzero(end > begin):
        for j in range(first[k], first[k + 1], COLUMNS):
            own = row[j : min(j + COLUMNS, first[k + 1])]
            for i in range(begin[k], end[k], ROWS):
                r, c = linked(a, slice(i, min(i + ROWS, end[k])), b, own, least)
                if len(r):
                    yield i + r, own[c]


def every(a: Shard, b: Shard, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of a, row of b), each pair of one shard's rows once."""
    for j in range(0, len(b.ids), COLUMNS):
        for i in range(0, j + COLUMNS if a is b else len(a.ids), ROWS):
            stop = min(i + ROWS, j + COLUMNS) if a is b else i + ROWS
            r, c = linked(a, slice(i, stop), b, slice(j, j + COLUMNS), least)
            r, c = i + r, j + c
            own = r < c if a is b else slice(None)
            yield r[own], c[own]


def met(a: Shard, b: Shard, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of a, row of b) of which one visits the other's cell, each once."""
    visits = lambda s, row, t, other: (s.visits[row] == t.cell[other][:, None]).any(1)
    for r, c in visited(a, b, least):
        own = (r < c) | ((r > c) & ~visits(a, r, b, c)) if a is b else slice(None)
        yield r[own], c[own]
    if a is not b:
        for c, r in visited(b, a, least):
            own = ~visits(b, c, a, r)
            yield r[own], c[own]


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``least`` or more at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= least:
            yield np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held])
            held, n = [], 0
    if held:
        yield np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held])


def paired(a: Shard, b: Shard, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Weights of the links of a's and of b's rows (one array twice, if they are one shard), a forest (reps, reps) of the links, and
    how many real links of AUDITED rows of b there are and were found.

    Where too many of those were missed, all pairs are scanned.
    """
    same, n = a is b, len(a.ids)
    picks = np.unique(np.linspace(0, len(b.ids) - 1, min(AUDITED, len(b.ids))).astype(np.int64))
    truth = sum(len(linked(a, slice(i, i + ROWS), b, picks, least)[0]) for i in range(0, n, ROWS)) - same * len(picks)
    scan = not (a.visits.shape[1] and b.visits.shape[1])
    while True:
        n_a, n_b = np.zeros(n, np.int64), np.zeros(len(b.ids), np.int64)
        if same:
            n_b = n_a
        links = np.zeros(len(b.ids), np.int64)
        root = np.arange(n if same else n + len(b.ids))
        for r, c in gathered(every(a, b, least) if scan else met(a, b, least)):
            n_a += np.bincount(r, b.weight[c], n).astype(np.int64)
            n_b += np.bincount(c, a.weight[r], len(n_b)).astype(np.int64)
            links += np.bincount(c, minlength=len(links))
            if same:
                links += np.bincount(r, minlength=len(links))
            x, y = root[r], root[c if same else n + c]
            apart = x != y
            if apart.any():
                node, low = forest(x[apart], y[apart])
                lower = np.arange(len(root))
                lower[node] = low
                root = lower[root]
        found = int(links[picks].sum())
        if scan or truth - found < MISSED or truth - found <= MISSED_SHARE * truth:
            break
        scan = True
    reps = a.reps if same else np.concatenate([a.reps, b.reps])
    other = np.flatnonzero(root != np.arange(len(root)))
    return n_a, n_b, reps[other], reps[root[other]], int(truth), found


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def put(path: str, data: bytes) -> None:
    """A whole file at once; a task that runs again writes another."""
    fs, at = open_fs(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(data)


def read(path: str) -> bytes:
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        return f.read()


FOUND = ["key", "n", "a", "b", "audited", "audited_found"]


def said(fitted: DataFrame, found: DataFrame) -> None:
    """Log what the probes of graphs and the scans of real vectors found."""
    g = fitted.agg(F.count("*"), F.count_if(F.col("visits") == 0), F.max("visits"), F.min(F.try_divide("found", "probes"))).first()
    p = found.agg(F.sum("audited"), F.sum("audited_found")).first()
    log.info("%s graphs, %s without use, most visits %s, least recall of probes %s; real links audited %s, found %s", *g, *p)


def fitted(groups: DataFrame, sizes: DataFrame, least: float, folder: str) -> DataFrame:
    """``(label, dims, path, visits, probes, found)``: a graph for each row of ``sizes`` with more than one cell.

    Its nodes are the vectors of ``groups`` whose hash falls under ``cells / n``, and the one with the least key; as many as
    make PROBES more are drawn by the same hash to measure it, and are no nodes.
    """
    kind = groups.schema["label"].dataType.simpleString()
    drawn = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 40)) / F.lit(1 << 40) * F.col("n")
    sample = groups.join(sizes.where("cells > 1"), ["label", "dims"]).withColumn("drawn", drawn)
    sample = sample.withColumn("node", (F.col("drawn") < F.col("cells")) | (F.col("key") == F.col("least_key")))
    sample = sample.where(F.col("node") | (F.col("drawn") < F.col("cells") + PROBES)).select("label", "dims", "key", "vector", "node")

    def fit(t: pa.Table) -> pa.Table:
        node, key = t["node"].to_numpy(), t["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        vector = np.asarray(t["vector"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        own, rest = order[node[order]], order[~node[order]]
        g = build(key[own], key[own], np.ones(len(own), np.int64), vector[own], None)
        visits, probes, found = visits_for(g, unit_rows(vector[rest]), least) if len(rest) else (0, 0, 0)
        path = f"{folder}/{uuid.uuid4().hex}"
        put(path, g.dump())
        return pa.table({c: t[c][:1] for c in ("label", "dims")} | {"path": [path], "visits": [visits], "probes": [probes], "found": [found]})

    return sample.groupBy("label", "dims").applyInArrow(fit, f"label {kind}, dims int, path string, visits long, probes long, found long")


def packed(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def placed(groups: DataFrame, graphs: DataFrame, kind: type) -> DataFrame:
    """``groups`` with the ``cell`` of each vector and the cells it ``visits``; where all pairs are scanned cell 0 and none.

    Vectors and visits are bytes from here on (of ``kind`` and of int32), which Spark moves without looking at their elements.
    """
    found = groups.join(graphs.where("visits > 0").select("label", "dims", "path", F.col("visits").alias("most")), ["label", "dims"], "left")
    rows = found.select("label", "dims", "key", "rep", "copies", "vector", "path", "most")
    more = [T.StructField("vector", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("visits", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields[:5], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Graph] = {}
        for batch in batches:
            paths = batch.column(6)
            for path in paths.unique().to_pylist():
                part = batch.filter(pc.is_null(paths) if path is None else pc.equal(paths, path))
                n = part.num_rows
                near = np.zeros((n, 0), np.int32)
                vectors = part.column(5)
                if path is not None:
                    if path not in held:
                        if len(held) >= 4:
                            held.pop(next(iter(held)))
                        held[path] = Graph.load(read(path))
                    vector = np.asarray(vectors.flatten(), np.float64).reshape(n, -1)
                    near = nearest(held[path], unit_rows(vector).astype(np.float32), part.column(7)[0].as_py())
                cell = near[:, 0] if near.shape[1] else np.zeros(n, np.int32)
                # a batch may hold vectors of several lengths
                data, ends = np.asarray(vectors.flatten(), kind), np.concatenate([[0], np.cumsum(pc.list_value_length(vectors).to_numpy())])
                own = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                columns = [*part.columns[:5], own, pa.array(np.ascontiguousarray(cell)), packed(near)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    shard: int | None = None,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row.

    Vectors link when their labels and lengths are equal, the label isn't null, and their cosine is ``least`` or more.
    n_links counts the other vectors linked directly, component_id is the least id reachable, kept says whether it is
    the row's own. Vectors that are null, all zeros, or hold null or non-finite components, and rows with a null label or
    id, link with nothing; a null id's component is null and it is kept. Rows that repeat an id, label and vector are one
    vector and each get its result. Other columns are not read; an empty table gives an empty result.

    Shards hold about ``shard`` vectors, or else SHARD_BYTES; a cell that is larger is dealt over several. What the audits
    found is logged.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # kept as it is: half the bytes
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"),
        F.col(label_col).alias("label"),
    )
    keyed = rows.select(
        "id", F.when(_usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.xxhash64("label", "vector")).alias("key"), "label", "vector"
    )
    ids = written(keyed.select("id", "key"), "vector-keys")
    groups = (
        keyed.where("key is not null")
        .groupBy("key", "label", "vector")
        .agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
        .withColumn("dims", F.size("vector"))
    )
    groups = written(groups, "vector-groups")
    room = F.lit(shard) if shard else F.greatest(F.lit(SHARD_BYTES) / (12 * F.col("dims")), F.lit(1.0)).cast("long")
    cells = F.least(F.ceil(F.col("n") / CELL), F.lit(CELLS), F.greatest(F.lit(SHARD_BYTES) / (12 * F.col("dims")), F.lit(1.0)).cast("long"))
    sizes = written(groups.groupBy("label", "dims").agg(F.count("*").alias("n"), F.min("key").alias("least_key")).withColumn("cells", cells), "vector-sizes")
    folder = new_path(spark, "graphs")
    graphs = written(fitted(groups, sizes, least, folder), "graphs-fitted")
    kept = np.float32 if single else np.float64
    whole, groups = groups, written(placed(groups, graphs, kept), "vector-cells")
    dropped(whole)
    # cells in a row fill shards; one with more than a shard's vectors is dealt over several
    before = F.sum("n").over(Window.partitionBy("label", "dims").orderBy("cell")) - F.col("n")
    filled = groups.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"))
    filled = filled.select("label", "dims", "cell", F.floor(before / room).cast("int").alias("base"), F.ceil(F.col("n") / room).cast("int").alias("parts"))
    dealt = groups.join(filled, ["label", "dims", "cell"]).withColumn("shard", F.col("base") + F.pmod(F.xxhash64("key", F.lit(3)), "parts").cast("int"))
    kind = vectors.schema[label_col].dataType.simpleString()

    def make(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["key"].to_numpy(), t["cell"].to_numpy()))
        wide = lambda c, x: np.frombuffer(b"".join(t[c].to_pylist()), x).reshape(t.num_rows, -1)[order]
        own = Shard(*(t[c].to_numpy()[order] for c in ("key", "rep", "copies")), wide("vector", kept), t["cell"].to_numpy()[order], wide("visits", np.int32))
        path = f"{folder}/{uuid.uuid4().hex}"
        put(path, own.dump())
        return pa.table({c: t[c][:1] for c in ("label", "dims", "shard")} | {"path": [path], "nodes": [t.num_rows]})

    dealt = dealt.select("label", "dims", "shard", "key", "rep", "copies", "vector", "cell", "visits")
    built = written(dealt.groupBy("label", "dims", "shard").applyInArrow(make, f"label {kind}, dims int, shard int, path string, nodes long"), "shards-built")
    one, two = (built.select("label", "dims", F.col("shard").alias(f"{x}_shard"), F.col("path").alias(x)) for x in ("queries", "held"))
    turns = two.join(one, ["label", "dims"]).where("queries_shard <= held_shard")
    n_turns = int(built.groupBy("label", "dims").count().agg(F.sum(F.expr("count * (count + 1L) div 2"))).first()[0] or 0)
    by = ["label", "dims", "held_shard", (F.col("queries_shard") / GROUP).cast("int")]
    turns = turns.repartition(max(1, min(n_turns, 100_000)), *by).sortWithinPartitions("held", "queries_shard").select("held", "queries")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, None
        for batch in batches:
            for held_path, queries_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held_path != path:
                    path, held = held_path, Shard.load(read(held_path))
                own = queries_path == held_path
                q = held if own else Shard.load(read(queries_path))
                n_held, n_q, a, b, audited, audited_found = paired(held, q, least)
                keys, n = (held.ids, n_held) if own else (np.concatenate([held.ids, q.ids]), np.concatenate([n_held, n_q]))
                some = np.flatnonzero(n)
                blank = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(n[some]), *[blank(len(some))] * 4], names=FOUND)
                yield pa.RecordBatch.from_arrays([*[blank(len(a))] * 2, pa.array(a), pa.array(b), *[blank(len(a))] * 2], names=FOUND)
                yield pa.RecordBatch.from_arrays([*[blank(1)] * 4, pa.array([audited], pa.int64()), pa.array([audited_found], pa.int64())], names=FOUND)

    found = written(turns.mapInArrow(look, ", ".join(f"{x} long" for x in FOUND)), "vector-links")
    said(graphs, found)
    removed(spark, folder)
    counts = found.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    # an id with several vectors joins what each of them is linked to
    several = ids.where("key is not null").join(groups.select("key", "rep"), "key").where("id <> rep")
    several = several.join(ids.where("key is not null").groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("id"), "id")
    links = found.where("a is not null").select("a", "b").distinct().unionByName(several.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    joined = components(links)
    of_key = (
        groups.select("key", "rep", "copies")
        .join(counts, "key", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    out = ids.join(of_key, "key", "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
