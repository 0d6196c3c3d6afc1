"""A hierarchical navigable small-world graph over unit vectors, searched in batches.

Many queries walk the graph together: in each round every query expands the best
unexpanded entries of its beam, and all similarities of a round are one matrix
operation. Nodes are inserted in batches of growing size; nodes of one batch
see each other as candidates too.
"""

from __future__ import annotations

import io

import numpy as np

_EXPAND = 4


class Graph:
    """``vectors`` (n x d, unit length, float32); ``layers[k]``: links (n x width, -1: none) of layer k."""

    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 1):
        self.vectors, self.degree = np.ascontiguousarray(vectors, np.float32), degree
        n = len(vectors)
        random = np.random.default_rng(seed)
        height = np.floor(-np.log(np.maximum(random.random(n), 1e-12)) / np.log(degree)).astype(np.int64) if n else np.zeros(0, np.int64)
        if n:
            height[0] = max(1, height.max())
        self.height, self.entry = height, 0
        self.layers = [np.full((n, 2 * degree if k == 0 else degree), -1, np.int32) for k in range(int(height.max()) + 1 if n else 1)]
        done, size = 1, 1
        while done < n:
            self._insert(np.arange(done, min(n, done + size)), beam)
            done += size
            size = min(512, done)

    def _insert(self, new: np.ndarray, beam: int) -> None:
        q = self.vectors[new]
        near = np.full((len(new), 1), self.entry, np.int64)
        inner = q @ q.T
        for k in range(len(self.layers) - 1, -1, -1):
            here = self.height[new] >= k
            near, _ = self._walk(k, q, near, beam if here.any() else 1)
            if here.any():
                own = new[here]
                mates = np.where((self.height[new][None, :] >= k) & (new[None, :] != own[:, None]), inner[here], -2)
                take = min(16, mates.shape[1])
                best = np.argpartition(-mates, take - 1, axis=1)[:, :take]
                mate = np.where(np.take_along_axis(mates, best, 1) > -2, new[best], -1)
                self._connect(k, own, np.concatenate([near[here], mate], 1))

    def _select(self, nodes: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """Of each node's candidates (-1: none) those nearer to it than to any chosen before,
        then the nearest others, up to ``width``."""
        v = self.vectors[candidates]
        sims = np.where(candidates >= 0, np.einsum("qcd,qd->qc", v, self.vectors[nodes]), -2)
        order = np.argsort(-sims, axis=1, kind="stable")
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        twice = np.zeros(candidates.shape, bool)
        twice[:, 1:] = (candidates[:, 1:] == candidates[:, :-1]) & (candidates[:, 1:] >= 0)
        between = v @ v.transpose(0, 2, 1)
        valid = (candidates >= 0) & (candidates != nodes[:, None]) & ~twice
        chosen = np.zeros(candidates.shape, bool)
        nearest = np.full(candidates.shape, -2.0)
        count = np.zeros(len(nodes), np.int64)
        for c in range(candidates.shape[1]):
            good = valid[:, c] & (nearest[:, c] < sims[:, c]) & (count < width)
            chosen[:, c] = good
            count += good
            nearest = np.where(good[:, None], np.maximum(nearest, between[:, c]), nearest)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
        pick = np.argsort(rank, axis=1)[:, :width]
        out = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(candidates, pick, 1), -1)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out

    def _connect(self, k: int, nodes: np.ndarray, candidates: np.ndarray) -> None:
        links = self.layers[k]
        width = links.shape[1]
        links[nodes] = self._select(nodes, candidates, width if k else self.degree + self.degree // 2)[:, :width] if k else np.pad(self._select(nodes, candidates, self.degree), ((0, 0), (0, width - self.degree)), constant_values=-1)
        source = np.repeat(nodes, width)
        target = links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            # at most `width` new links of each target at a time
            first = np.searchsorted(target, target)
            place = np.arange(len(target)) - first
            now = place < width
            who, at = np.unique(target[now], return_inverse=True)
            extra = np.full((len(who), int(place[now].max()) + 1), -1, np.int64)
            extra[at, place[now]] = source[now]
            both = np.concatenate([links[who], extra], 1)
            for lo in range(0, len(who), 1024):
                links[who[lo : lo + 1024]] = self._select(who[lo : lo + 1024], both[lo : lo + 1024], width)
            source, target = source[~now], target[~now]

    def _walk(self, k: int, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes (-1: none) that each query meets in layer k, best first."""
        n, links, vectors = len(self.vectors), self.layers[k], self.vectors
        out = np.full((len(queries), beam), -1, np.int64)
        scores = np.full((len(queries), beam), -2.0, np.float32)
        step = max(1, min(512, 20_000_000 // max(1, n)))
        for lo in range(0, len(queries), step):
            q, first = queries[lo : lo + step], entries[lo : lo + step]
            rows = np.arange(len(q))
            seen = np.zeros((len(q), n + 1), bool)
            node = np.full((len(q), beam), -1, np.int64)
            sim = np.full((len(q), beam), -2.0, np.float32)
            open_ = np.zeros((len(q), beam), bool)

            def meet(active: np.ndarray, found: np.ndarray) -> None:
                """Adds nodes (-1: none) to the beams of the active queries."""
                found = np.sort(found, axis=1)
                fresh = found >= 0
                fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
                fresh &= ~seen[active[:, None], found]
                seen[active[:, None], np.where(fresh, found, n)] = True
                s = np.where(fresh, np.einsum("qcd,qd->qc", vectors[found], q[active]), np.float32(-2))
                all_node = np.concatenate([node[active], found], 1)
                all_sim = np.concatenate([sim[active], s], 1)
                all_open = np.concatenate([open_[active], fresh], 1)
                if all_sim.shape[1] > beam:
                    top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
                else:
                    top = np.broadcast_to(np.arange(all_sim.shape[1]), all_sim.shape)
                w = top.shape[1]
                node[active, :w] = np.take_along_axis(all_node, top, 1)
                sim[active, :w] = np.take_along_axis(all_sim, top, 1)
                open_[active, :w] = np.take_along_axis(all_open, top, 1) & (sim[active, :w] > -2)

            meet(rows, first)
            active = rows
            expand = min(_EXPAND, beam)
            while len(active):
                rank = np.where(open_[active], sim[active], -3)
                best = np.argpartition(-rank, expand - 1, axis=1)[:, :expand] if expand < beam else np.broadcast_to(np.arange(beam), rank.shape)
                real = np.take_along_axis(rank, best, 1) > -3
                more = real.any(1)
                active, best, real = active[more], best[more], real[more]
                if not len(active):
                    break
                chosen = node[active[:, None], best]
                at = open_[active[:, None], best] & ~real
                open_[active[:, None], best] = at
                near = links[np.where(real, chosen, 0)]
                near = np.where(real[:, :, None], near, -1).reshape(len(active), -1).astype(np.int64)
                meet(active, near)
            order = np.argsort(-sim, axis=1)
            out[lo : lo + step] = np.where(np.take_along_axis(sim, order, 1) > -2, np.take_along_axis(node, order, 1), -1)
            scores[lo : lo + step] = np.take_along_axis(sim, order, 1)
        return out, scores

    def search(self, queries: np.ndarray, beam: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities (n_queries x beam) met from the nodes ``near`` to each query (-1: none), which
        a narrower beam found, or else by a descent from the top layer."""
        queries = np.ascontiguousarray(queries, np.float32)
        if near is None:
            near = np.full((len(queries), 1), self.entry, np.int64)
            for k in range(len(self.layers) - 1, 0, -1):
                near, _ = self._walk(k, queries, near, 8)
        return self._walk(0, queries, near, beam)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, height=self.height, degree=self.degree, **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as found:
            own.vectors, own.height, own.degree, own.entry = found["vectors"], found["height"], int(found["degree"]), 0
            own.layers = [found[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in found.files))]
        return own
