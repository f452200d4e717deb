"""SentencePiece encoding and decoding, with distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has a node per character and an arc per piece. Characters that no piece holds side by side are cut
apart, and no piece has a space mark after another character, so the lattice is a chain of units, whose arcs' conditional
probabilities are worked out once per distinct unit. A text's samples come from an A* search over sets of segmentations,
each with the largest perturbed log-probability in it as its bound: a set is split at its best member, and the bounds of
the parts are Gumbel variables cut off at the set's own. The sets popped in turn are the top k of all segmentations'
perturbed log-probabilities. Going down to a set's best member is a draw by conditional probabilities, which runs for all
units of many texts at once, and so does the search for the parts of a set that can still matter.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import cache_of_worker, slices, take_worker
from urlsieve.llm.runs import Grown, Runs, code_points, mix, ranges

MARK = "▁"
#: Samples a text, noise seed, weight of a piece's log-probability.
SAMPLES, SEED, THETA = 3, 7, 1.0
#: Arcs remembered before all but the first ones are forgotten, and how many those are. Results depend on neither.
ARCS, KEEP = 3_000_000, 1_500_000
#: Texts and bytes sampled at once, and characters of new units compiled at once. Results depend on none of them.
TEXTS, BYTES, SLICE = 192, 1 << 19, 1 << 16
#: Log-probabilities are added up as multiples of this, so that sums don't depend on what else is in a batch.
GRAIN = 2.0**-32
#: The farthest that two of uniform()'s Gumbel variables can be apart, and what a scaled sum may sink to.
SPREAD, LOW = 42.0, 1e-150

ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _share(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def uniform(key: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the counters alone."""
    for c, odd in zip(counters, ODD, strict=False):
        key = key + (np.uint64(c * int(odd) & 2**64 - 1) if isinstance(c, int) else c.astype(np.uint64) * odd)
    return _share(key)


def below(g, bound):
    """A Gumbel variable g, made into one of the same location that is at most bound."""
    return -np.logaddexp(-g, -bound)


class Lattices:
    """Compiled units: arcs by node with conditional log-probabilities and cumulative probabilities."""

    def __init__(self, path: str, theta: float = THETA):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        usable = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        # a BPE model's scores are ranks: pieces get Zipf's law over them
        order = sorted(usable, key=lambda i: (-self.sp.get_score(i), i))
        self.id_of = {self.sp.id_to_piece(i): i for i in usable}
        self.lp = {i: -theta * math.log(k + 2.7) for k, i in enumerate(order)}
        if bad := [p for p in self.id_of if not re.fullmatch(f"{MARK}*[^{MARK}]*", p)]:
            raise ValueError(f"pieces such as {bad[0]!r} cross from one unit to the next")
        self.byte = {b: self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.fallback = -theta * math.log(len(order) + 2.7)
        self.base = n
        self.run_of: dict[int, int] = {}
        self.run_size, self.run_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._trie()
        self._parts()
        self.forget()

    def _trie(self) -> None:
        """Nodes by (parent << 21 | code point) in an open hash table, the root's by code point, and each node's piece or -1."""
        nodes: dict[int, int] = {}
        piece = [-1]
        for p, i in self.id_of.items():
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                at = nodes[key]
            piece[at] = i
        self.piece = np.array(piece, np.int32)
        self.longest = max(map(len, self.id_of))
        self.bits = (8 * len(nodes)).bit_length()
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.top = np.full(0x110000, -1, np.int32)
        keys = np.fromiter(nodes, np.int64, len(nodes))
        for key, to, s in zip(nodes, nodes.values(), self._slot(keys).tolist(), strict=True):
            if key < 1 << 21:
                self.top[key] = to
                continue
            while self.keys[s] >= 0:
                s = (s + 1) & (len(self.keys) - 1)
            self.keys[s], self.to[s] = key, to
        self.piece_p = np.zeros(self.base)
        for i, v in self.lp.items():
            self.piece_p[i] = math.exp(v)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * ODD[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, keys: np.ndarray) -> np.ndarray:
        """The nodes that the keys lead to, or -1."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.to[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _parts(self) -> None:
        """By code point: 0 for the space mark, 1 for a character that stands with no other in a piece, else its part.

        A part is a component of the characters that pieces hold side by side.
        """
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for p in self.id_of:
            body = p.lstrip(MARK)
            for a, b in zip(body, body[1:], strict=False):
                if (a := find(a)) != (b := find(b)):
                    root[a] = b
        number: dict[str, int] = {}
        self.part = np.ones(0x110000, np.uint16)
        for c in list(root):
            self.part[ord(c)] = number.setdefault(find(c), len(number) + 2)
        self.part[ord(MARK)] = 0

    def forget(self) -> None:
        self.node, self.arc_lp, self.arc_cum, self.arc_rest, self.arc_to, self.arc_id = Grown(np.int32), Grown(np.float32), Grown(np.float32), Grown(np.float32), Grown(np.int32), Grown(np.int32)
        self.node.add(np.zeros(1, np.int32))
        self.units, self.first = Runs(), Grown(np.int32)
        self.kept: tuple[int, ...] | None = None

    def _grown(self) -> list[Grown]:
        return [self.node, self.arc_lp, self.arc_cum, self.arc_rest, self.arc_to, self.arc_id, self.first]

    def forget_late(self) -> None:
        """Forgets what was learned after the first KEEP arcs, among which the frequent units' are."""
        for held, n in zip(self._grown(), self.kept, strict=True):
            held.n = n
        self.units.cut(self.first.n)

    def _run(self, point: int) -> int:
        if point not in self.run_of:
            self.run_of[point] = len(self.run_size)
            ids = [self.byte[b] for b in chr(point).encode("utf-8", "surrogatepass")]
            self.run_size = np.append(self.run_size, len(ids))
            self.run_ids = np.concatenate([self.run_ids, ids])
        return self.run_of[point]

    def units_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first nodes of all units of the texts, and the number of units of each text; learns new units."""
        joined = [self.normal(t) for t in texts]
        sizes = np.fromiter(map(len, joined), np.int64, len(joined))
        points = code_points("".join(joined))
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if self.arc_id.n > ARCS and self.kept:
            self.forget_late()
        part = self.part[points]
        cut = np.ones(len(points), bool)
        # marks go with what follows them
        cut[1:] = (part[:-1] > 0) & ((part[1:] != part[:-1]) | (part[1:] == 1))
        edges = np.cumsum(sizes) - sizes
        cut[edges[sizes > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(points)))
        n_units = np.searchsorted(start, edges + sizes) - np.searchsorted(start, edges)
        unit, new = self.units.number(points, start, size)
        self.learn(points, start[new], size[new])
        return self.first.of[unit].astype(np.int64), n_units

    def learn(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Compiles the lattices of new units, points[start : start + size], SLICE characters at a time."""
        at, ends = 0, np.cumsum(size)
        while at < len(size):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + SLICE, side="right")))
            self._compile(points, start[at:upto], size[at:upto])
            at = upto
        if self.kept is None and self.arc_id.n >= KEEP:
            self.kept = tuple(held.n for held in self._grown())

    @np.errstate(divide="ignore")
    def _compile(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Nodes are numbered by their distance from the unit's end, then by unit, the longest unit first.

        Sums over completions go from the ends on, in plain numbers; those of a unit are scaled up when they get small,
        since only their ratios count. arc_id is a piece's id, or base + k for the k-th byte run.
        """
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n, top = int(size.sum()), int(size[0])
        levels = np.searchsorted(-size, -np.arange(1, top + 1), side="right")
        off = np.concatenate([[0], np.cumsum(levels)])  # off[d - 1] + u: the node of unit u at distance d
        far = np.repeat(np.arange(1, top + 1), levels)
        unit = np.arange(n) - off[far - 1]
        point = points[(start + size)[unit] - far].astype(np.int64)
        live, at, arcs, count = np.arange(n), self.top[point], [], np.zeros(n, np.int64)
        for step in range(1, self.longest + 1):
            if step > 1:
                at = self._child(at.astype(np.int64) << 21 | point[off[far - step] + unit])
            piece = np.where(at >= 0, self.piece[at], -1)
            hit = piece >= 0
            lacks = np.flatnonzero(~hit) if step == 1 else ()
            ids, p = piece[hit], self.piece_p[piece[hit]]
            src = live[hit]
            if len(lacks):
                # a character of one byte is its piece, a longer one a run of them
                runs = np.array([self.byte[x] if x < 0x80 else self.base + self._run(x) for x in point[lacks].tolist()], np.int64)
                wide = np.ones(len(runs))
                wide[runs >= self.base] = self.run_size[runs[runs >= self.base] - self.base]
                src, ids, p = np.arange(n), piece.copy(), self.piece_p[piece]
                ids[lacks], p[lacks] = runs, np.exp(self.fallback * wide)
                hit = np.ones(n, bool)
            left = far[hit] - step
            arcs.append((src, np.where(left > 0, off[left - 1] + unit[hit], n + unit[hit]), ids, p, count[src]))
            count[src] += 1
            go = (at >= 0) & (far > step)
            live, at, far, unit = live[go], at[go], far[go], unit[go]
            if not len(live):
                break
        first = np.concatenate([[0], np.cumsum(count)])
        m = int(first[-1])
        dst, ids, p = np.empty(m, np.int64), np.empty(m, np.int32), np.empty(m)
        for a_src, a_dst, a_ids, a_p, slot in arcs:
            place = first[a_src + 1] - 1 - slot  # the longest first: it is the likeliest, and draws begin there
            dst[place], ids[place], p[place] = a_dst, a_ids, a_p
        del arcs
        total, whole, v = np.ones(n + len(size)), np.empty(n), p
        for d in range(1, top + 1):
            a, z = int(off[d - 1]), int(off[d])
            begin, end = int(first[a]), int(first[z])
            v[begin:end] *= total[dst[begin:end]]
            total[a:z] = whole[a:z] = sums = np.add.reduceat(v[begin:end], first[a:z] - begin)
            if sums.min() < LOW:
                for u in np.flatnonzero(sums < LOW).tolist():
                    total[[off[x - 1] + u if x else n + u for x in range(d, max(d - self.longest, -1), -1)]] /= LOW
        whole = np.repeat(whole, count)
        prob = v / whole
        run = np.cumsum(prob)
        cum = run - np.repeat(run[first[:-1]] - prob[first[:-1]], count)
        last = first[1:] - 1
        cum[last] = 2.0
        single = first[:-1][count == 1]
        prob[single] = 1.0
        # what the others at the node have; where one arc has most, their sum is taken without it
        big = prob > 0.5
        others = np.where(big, np.repeat(np.add.reduceat(np.where(big, 0.0, v), first[:-1]), count), whole - v)
        base, base_arc = self.node.n - 1, self.arc_id.n
        self.node.add(first[1:] + base_arc)
        self.arc_lp.add(np.log(prob))
        self.arc_cum.add(cum)
        self.arc_rest.add(np.log(others / whole))
        self.arc_to.add(np.where(dst < n, base + dst, -1))
        self.arc_id.add(ids)
        node = np.empty(len(size), np.int64)
        node[order] = base + off[size - 1] + np.arange(len(size))
        self.first.add(node)

    def descend(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws arcs from each node to its unit's end: (arcs, number of arcs of each lane), lanes one after another."""
        count, lane = np.zeros(len(node), np.int64), np.arange(len(node))
        taken, first, cum, next_ = [], self.node.of, self.arc_cum.of, self.arc_to.of
        while len(lane):
            u = _share(key)
            arc = first[node]
            late = np.flatnonzero(cum[arc] <= u)
            while len(late):
                arc[late] = more = arc[late] + 1
                late = late[cum[more] <= u[late]]
            taken.append((lane, arc))
            to = next_[arc]
            go = to >= 0
            count[lane] += 1
            lane, node, key = lane[go], to[go], key[go] + ODD[2]
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for step, (lanes, arc) in enumerate(taken):
            out[begin[lanes] + step] = arc
        return out, count

    def normal(self, text: str) -> str:
        return self.sp.normalize(text) if text else ""

    def sample(self, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k samples (ids, log-probability, perturbed log-probability, log inclusion), best first."""
        owner, ids, ends, *scores = self.samples(texts, keys, k)
        out: list[list[tuple]] = [[] for _ in texts]
        for d, a, z, *score in zip(owner.tolist(), ends[:-1].tolist(), ends[1:].tolist(), *(x.tolist() for x in scores), strict=True):
            out[d].append((ids[a:z], *score))
        return out

    @np.errstate(over="ignore", divide="ignore", invalid="ignore")
    def samples(self, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> tuple[np.ndarray, ...]:
        """(text, ids of all rows, the rows' ends, log-probability, perturbed log-probability, log inclusion), by text, best first."""
        first, n_units = self.units_of(texts)
        size, unit_at = len(texts), np.cumsum(n_units) - n_units
        arcs, owner, before = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # of each path: its text, place in the arrays above and size, log-probability and perturbed one
        paths: list[tuple[np.ndarray, ...]] = []
        heaps: list[list[tuple]] = [[] for _ in range(size)]
        # what to go down from: text, bound, start of the parent path, arcs of it kept, arc taken there
        d, bound, parent, at, arc = np.arange(size), -np.log(-np.log(uniform(keys, 0, 0, 0))), None, np.zeros(size, np.int64), None
        for draw in range(1, k + 1):
            begun, unit, head = np.full(len(d), -1), np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
            if parent is not None:
                begun, unit, head = self.arc_to.of[arc].astype(np.int64), owner[parent + at] + 1, at + 1
            lanes = n_units[d] - unit + (begun >= 0)
            lane = ranges(n_units[d] - lanes, lanes)
            node = first[np.repeat(unit_at[d], lanes) + lane] if len(lane) else np.zeros(0, np.int64)
            node[(np.cumsum(lanes) - lanes)[begun >= 0]] = begun[begun >= 0]
            key = np.repeat(keys[d] + np.uint64(draw) * ODD[0], lanes) + lane.astype(np.uint64) * ODD[1]
            tail, count = self.descend(node, key)
            edges = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(lanes)])]
            tails = np.diff(edges)
            sizes = head + tails
            begin = np.cumsum(sizes) - sizes
            spot = ranges(begin + head, tails)
            new_arcs, new_owner = np.empty(int(sizes.sum()), np.int64), np.empty(int(sizes.sum()), np.int64)
            new_arcs[spot], new_owner[spot] = tail, np.repeat(lane, count)
            if parent is not None:
                old, to = ranges(parent, at + 1), ranges(begin, at + 1)
                new_arcs[to], new_owner[to] = arcs[old], owner[old]
                new_arcs[begin + at] = arc
            steps = np.rint(self.arc_lp.of[new_arcs] / GRAIN).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(steps)])
            new_before = (upto[:-1] - np.repeat(upto[begin], sizes)) * GRAIN
            phi = (upto[begin + sizes] - upto[begin]) * GRAIN
            base = len(arcs)
            paths.append((d, base + begin, sizes, phi, bound))
            # each later arc could be left out: a set with the rest of its node's probability. Of this path's sets the frontier
            # needs no more than are still to be popped, and one for the threshold; among the first few sets so many are as
            # large that far smaller ones can't be among them, whatever their noise
            need = k + 1 - draw
            rest = new_before[spot] + self.arc_rest.of[tail]
            if len(rest):
                few = np.arange(min(32, int(tails.max())) + need)
                look = np.where(few < tails[:, None], rest[np.minimum(edges[:-1, None] + few, len(rest) - 1)], -np.inf)
                floor = -np.partition(-look, need - 1, axis=1)[:, need - 1] - SPREAD
                own = np.flatnonzero((rest >= np.repeat(floor, tails)) & (rest > -np.inf))
                which = np.searchsorted(edges, own, side="right") - 1
                place = head[which] + own - edges[which]
                g = rest[own] - np.log(-np.log(uniform(keys[d[which]], 1000 + draw, place)))
                for _ in range(need):
                    if not len(own):
                        break
                    runs = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                    best = np.repeat(np.maximum.reduceat(g, runs), np.diff(np.append(runs, len(g))))
                    hit = np.flatnonzero(g == best)
                    for i, x, p, a in zip(which[hit].tolist(), below(g[hit], bound[which[hit]]).tolist(), place[hit].tolist(), tail[own[hit]].tolist(), strict=True):
                        heapq.heappush(heaps[int(d[i])], (-x, base + int(begin[i]), p, (a,)))
                    left = g != best
                    own, which, place, g = own[left], which[left], place[left], g[left]
            arcs, owner, before = np.concatenate([arcs, new_arcs]), np.concatenate([owner, new_owner]), np.concatenate([before, new_before])
            if draw == k:
                break
            popped = [(x, *heapq.heappop(heaps[x])) for x in range(size) if heaps[x]]
            if not popped:
                break
            d, parent, at = (np.array([x[c] for x in popped], np.int64) for c in (0, 2, 3))
            bound, arc = np.array([-x[1] for x in popped]), np.zeros(len(popped), np.int64)
            # all arcs of the node at which the set branches off
            n = np.searchsorted(self.node.of[: self.node.n], arcs[parent + at], side="right") - 1
            picks, noise = uniform(keys[d], 2000 + draw, at).tolist(), uniform(keys[d], 3000 + draw, at).tolist()
            rows = zip(popped, self.node.of[n].tolist(), self.node.of[n + 1].tolist(), picks, noise, before[parent + at].tolist(), strict=True)
            for j, ((x, value, path, spot_of, gone), lo, hi, u, v, upon) in enumerate(rows):
                open_ = [(a, lp) for a, lp in zip(range(lo, hi), self.arc_lp.of[lo:hi].tolist(), strict=True) if a not in gone]
                top = max(lp for _, lp in open_)
                open_ = [(a, math.exp(lp - top)) for a, lp in open_]
                mark = u * math.fsum(p for _, p in open_)
                pick = 0
                while pick < len(open_) - 1 and mark >= open_[pick][1]:
                    mark -= open_[pick][1]
                    pick += 1
                arc[j] = open_[pick][0]
                left = math.fsum(p for y, (_, p) in enumerate(open_) if y != pick)
                if left > 0:
                    heapq.heappush(heaps[x], (-float(below(upon + top + math.log(left) - math.log(-math.log(v)), -value)), path, spot_of, (*gone, open_[pick][0])))
        kappa = np.array([-h[0][0] if h else -math.inf for h in heaps])
        text, start, sizes, phi, value = (np.concatenate(x) for x in zip(*paths, strict=True))
        order = np.argsort(text, kind="stable")
        text, start, sizes, phi, value = text[order], start[order], sizes[order], phi[order], value[order]
        x = phi - kappa[text]
        inclusion = np.where(x > 30, 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 30))))))
        ids, ends = self._ids(arcs[ranges(start, sizes)], np.concatenate([[0], np.cumsum(sizes)]))
        return text, ids, ends, phi, value, inclusion

    def _ids(self, arcs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these arcs, byte runs spelled out, and where the rows end among them."""
        ids = self.arc_id.of[arcs]
        if not len(ids) or ids.max() < self.base:
            return ids, ends
        runs = np.flatnonzero(ids >= self.base)
        which = ids[runs] - self.base
        size = np.ones(len(ids), np.int64)
        size[runs] = self.run_size[which]
        out = np.repeat(ids, size)
        upto = np.concatenate([[0], np.cumsum(size)])
        start = upto[runs]
        begin = (np.cumsum(self.run_size) - self.run_size)[which]
        for k in range(int(size.max())):
            some = self.run_size[which] > k
            out[start[some] + k] = self.run_ids[begin[some] + k]
        return out, upto[ends]


_lattices = cache_of_worker()


def lattices(path: str, theta: float = THETA) -> Lattices:
    """One per worker process and model."""
    if (path, theta) not in _lattices:
        _lattices[path, theta] = Lattices(path, theta)
    return _lattices[path, theta]


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    plain = np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64)
    null = np.array([x is None for x in ids], np.uint64)
    return mix(mix(plain + np.uint64(seed)) + null)


def sample(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, theta: float = THETA, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, ids, log_prob, perturbed, log_inclusion), and text, what the ids decode to, if `decoded`: up to k distinct segmentations of each text.

    rank 0 has the largest perturbed log-probability. log_inclusion is the log of the probability that a segmentation's
    noise lifts it above the threshold, the largest perturbed value not emitted. Decoding any of them gives the text
    as the library normalises it. A null or empty text has one segmentation, of no pieces. Noise depends on seed and
    id alone, so reruns and other partitionings agree; rows of equal id share their noise. A text with fewer
    segmentations than k gives all of them. Extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_lattices)
        lattice = lattices(model, theta)
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                doc = part.column(0).to_pylist()
                text, ids, ends, *scores = lattice.samples([t or "" for t in part.column(1).to_pylist()], row_keys(doc, seed), k)
                rank = np.arange(len(text)) - np.searchsorted(text, text)
                back = [pa.array([lattice.sp.decode(ids[a:z].tolist()) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text)), pa.array(rank, pa.int32()), pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32)), *map(pa.array, scores), *back],
                    ["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion", *["text"] * decoded],
                )

    kind = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + ", text string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the library's best segmentation as ids; null text: null ids, empty text: none.

    A column of that name is replaced. A row per row; equal texts get equal ids, an empty table gives no rows.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = lattices(model).sp
        for texts in batches:
            yield texts.map(lambda t: None if t is None else sp.encode(t))

    return docs.withColumn(ids_col, F.pandas_udf(run, "array<int>")(F.col(text_col).cast("string")))


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with the text that the ids stand for; null ids: null text, none: an empty one.

    A column of that name is replaced. A row per row, an empty table gives no rows.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = lattices(model).sp
        for ids in batches:
            yield ids.map(lambda x: None if x is None else sp.decode(np.asarray(x).tolist()))

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(ids_col))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
