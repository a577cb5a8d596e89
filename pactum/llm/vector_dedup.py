"""Near-duplicate vectors: navigable small-world graphs per shard, every shard queried, cosine verified in doubles.

Equal vectors are folded into one node with a count.  Nodes are dealt to
shards by a hash.  One task builds a shard's graph (a hierarchy of layers, each
a graph of near neighbours found by beam search in the graph so far; neighbours
are kept for their directions as well as their nearness, so that tight groups
stay joined to the rest, and what no upper node leads to becomes an entry of
its own) and then answers every node of the table against it, as they stream by
in blocks.  A query whose beam is full of links is widened until the beam
reaches beyond the threshold.  Some of every block of queries, which come from
all shards, are audited against brute force, each by its own recall, itself
left out: if nodes with few links or with many miss theirs, beams double and the
block is answered again; where beams would cost as much as brute force, that
answers, in blocks.  Answers leave a task as link counts per node and as a
forest of the links it saw, so a group of near copies costs its size in rows,
not its square.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pactum.llm.shared import broadcast_if_small, components, stash

THRESHOLD = 0.9
#: Bytes of a shard's vectors and links in memory, about 20 for each number of a vector.
SHARD_BYTES = 256 << 20
#: Shards of tables that fewer could hold: several tasks answer, and a vector is asked as often at every such size.
LEAST_SHARDS = 12
#: Neighbours kept per node, beam while building, beam to begin queries with, share of a layer that is in the next.
NEIGHBOURS, BUILD_BEAM, QUERY_BEAM, LAYER_SHARE = 12, 24, 16, 16
#: Layers up to this size are looked through whole; nodes of a beam whose neighbours are fetched at once; queries x nodes marked as seen at once.
SMALL_LAYER, SPREAD, SEEN_CELLS = 1024, 4, 1 << 25
#: One in so many of every block of queries is checked by brute force.
AUDIT_SHARE = 32
#: Mean recall of links that nodes with few and nodes with many must reach, and the least that a single one may have.
RECALL, WORST = 0.999, 0.9
BLOCK = 512
#: Cosines held at once by brute force.
BRUTE_CELLS = 1 << 22


def _diverse(cos: np.ndarray, among: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates (best first) each row keeps: those nearer to it than to any kept before, then the nearest of the others."""
    m, k = cos.shape
    crowd = np.full((m, k), -np.inf, dtype=np.float32)
    kept = np.zeros((m, k), dtype=bool)
    for j in range(k):
        ok = (cos[:, j] > crowd[:, j]) & (cos[:, j] > -2) & (kept.sum(axis=1) < keep)
        kept[:, j] = ok
        np.maximum(crowd, np.where(ok[:, None], among[:, :, j], -np.inf), out=crowd)
    spare = ~kept & (cos > -2)
    room = keep - kept.sum(axis=1)
    return kept | spare & (np.cumsum(spare, axis=1) <= room[:, None])


class Graph:
    """A hierarchical small-world graph over unit vectors, searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(LAYER_SHARE)).astype(int)
        # nodes of higher layers come first in each lower one, so a layer is a leading part of them
        self.order = np.argsort(-level, kind="stable")
        self.v = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        self.layers: list[tuple[int, np.ndarray, np.ndarray]] = []
        sizes = [int((level >= k).sum()) for k in range(level.max() + 1 if n else 0)]
        for size in sorted(set(sizes)):
            links = self._build(size)
            above = self.layers[-1][0] if self.layers else min(4, size)
            self.layers.append((size, links, self._islands(links, above)))

    def _build(self, n: int) -> np.ndarray:
        """Insert nodes in growing batches: each searches the graph so far and, by product, its own batch."""
        links = np.full((n, 2 * NEIGHBOURS), -1, dtype=np.int32)
        done = min(n, 256)
        self._connect(links, np.arange(done), None)
        while done < n:
            stop = min(n, done + min(done, 1024))
            batch = np.arange(done, stop)
            found = np.concatenate([self._beam(links, self.v[b], self._entries(self.v[b], done), BUILD_BEAM, done)[0] for b in np.array_split(batch, -(-len(batch) // BLOCK))])
            self._connect(links, batch, found)
            done = stop
        return links

    def _islands(self, links: np.ndarray, above: int) -> np.ndarray:
        """Entries for what can't be reached from the nodes of the layer above: one for each part that hangs together."""
        reached = np.zeros(len(links), dtype=bool)
        reached[:above] = True
        front, out = np.arange(min(above, len(links))), []
        at = 0
        while True:
            while len(front):
                near = links[front].ravel()
                near = np.unique(near[near >= 0])
                front = near[~reached[near]]
                reached[front] = True
            while at < len(links) and reached[at]:
                at += 1
            if at == len(links):
                return np.array(out, dtype=np.int32)
            out.append(at)
            reached[at], front = True, np.array([at])

    def _entries(self, q: np.ndarray, limit: int) -> np.ndarray:
        """Where to begin below the layers there are: the best nodes that they lead to (they come first there too)."""
        at = None
        for size, links, islands in self.layers:
            if size <= SMALL_LAYER:
                near = q @ self.v[:size].T
                at = np.argpartition(-near, min(4, size) - 1, axis=1)[:, :4].astype(np.int32)
                continue
            begin = np.tile(np.arange(min(4, size), dtype=np.int32), (len(q), 1)) if at is None else at
            at = self._beam(links, q, self._with_islands(q, begin, islands), 8, size)[0][:, :4]
            at = np.where(at < 0, at[:, :1], at)
        return np.tile(np.arange(min(4, limit), dtype=np.int32), (len(q), 1)) if at is None else np.minimum(at, limit - 1)

    def _with_islands(self, q: np.ndarray, begin: np.ndarray, islands: np.ndarray) -> np.ndarray:
        """The nearest few of a layer's islands beside the entries from above."""
        if not len(islands):
            return begin
        near = q @ self.v[islands].T
        best = np.argpartition(-near, min(4, len(islands)) - 1, axis=1)[:, :4]
        return np.concatenate((begin, islands[best]), axis=1)

    def _connect(self, links, batch, found) -> None:
        """Link each node of the batch to diverse near ones of the found and of the batch, both ways."""
        own = self.v[batch] @ self.v[batch].T
        own[np.arange(len(batch)), np.arange(len(batch))] = -3
        k = min(NEIGHBOURS * (2 if found is None else 1), max(len(batch) - 1, 0))
        near = batch[np.argpartition(-own, k - 1, axis=1)[:, :k]].astype(np.int32) if k else np.zeros((len(batch), 0), np.int32)
        del own
        if found is not None:
            near = np.concatenate((near, found), axis=1)
        for a in range(0, len(batch), BLOCK):
            self._choose(links, batch[a : a + BLOCK], near[a : a + BLOCK], NEIGHBOURS)
        src = np.repeat(batch, NEIGHBOURS)
        dst = links[batch, :NEIGHBOURS].ravel()
        src, dst = src[dst >= 0].astype(np.int32), dst[dst >= 0]
        if not len(dst):
            return
        # of the nodes that chose one, its nearest are looked at
        cos = np.concatenate([np.einsum("ij,ij->i", self.v[src[a : a + 65536]], self.v[dst[a : a + 65536]]) for a in range(0, len(src), 65536)])
        order = np.lexsort((-cos, dst))
        src, dst = src[order], dst[order]
        targets, begin = np.unique(dst, return_index=True)
        place = np.arange(len(dst)) - np.repeat(begin, np.diff(np.append(begin, len(dst))))
        wide = min(2 * NEIGHBOURS, int(place.max()) + 1)
        new = np.full((len(targets), wide), -1, dtype=np.int32)
        ok = place < wide
        new[np.searchsorted(targets, dst[ok]), place[ok]] = src[ok]
        for a in range(0, len(targets), BLOCK):
            t = targets[a : a + BLOCK]
            self._choose(links, t, np.concatenate((links[t], new[a : a + BLOCK]), axis=1), 2 * NEIGHBOURS)

    def _choose(self, links, nodes, near, keep) -> None:
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        vectors = self.v[np.maximum(near, 0)]
        cos = np.einsum("ijk,ik->ij", vectors, self.v[nodes])
        cos[(near < 0) | (near == nodes[:, None])] = -3
        best = np.argsort(-cos, axis=1, kind="stable")
        near, cos = np.take_along_axis(near, best, 1), np.take_along_axis(cos, best, 1)
        vectors = np.take_along_axis(vectors, best[:, :, None], 1)
        kept = _diverse(cos, vectors @ vectors.transpose(0, 2, 1), keep)
        first = np.argsort(~kept, axis=1, kind="stable")[:, :keep]
        links[nodes] = -1
        links[nodes, : first.shape[1]] = np.where(np.take_along_axis(kept, first, 1), np.take_along_axis(near, first, 1), -1)

    def _beam(self, links, q, entry, width, limit):
        """The `width` nearest found for each query, best first (-1 where fewer), with their cosines."""
        step = max(32, SEEN_CELLS // max(1, limit))
        if len(q) > step:
            parts = [self._beam(links, q[a : a + step], entry[a : a + step], width, limit) for a in range(0, len(q), step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        m, width = len(q), min(width, limit)
        # a node and, in the last bit, whether its neighbours are still to be looked at
        codes = np.full((m, width), -2, dtype=np.int32)
        cos = np.full((m, width), -3.0, dtype=np.float32)
        seen = np.zeros((m, limit), dtype=bool)

        def add(who, new):
            new = np.where((new >= 0) & ~seen[who[:, None], np.maximum(new, 0)], new, -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            some = new >= 0
            count = some.sum(axis=1)
            if not count.any():
                return
            seen[np.repeat(who, count), new[some]] = True
            new = -np.sort(-new, axis=1)[:, : count.max()]
            c = np.einsum("ijk,ik->ij", self.v[np.maximum(new, 0)], q[who])
            c[new < 0] = -3
            every_c, every = np.concatenate((cos[who], c), axis=1), np.concatenate((codes[who], np.where(new >= 0, 2 * new + 1, -2)), axis=1)
            top = np.argsort(-every_c, axis=1)[:, :width]
            codes[who], cos[who] = np.take_along_axis(every, top, 1), np.take_along_axis(every_c, top, 1)

        live = np.arange(m)
        add(live, np.where(entry < limit, entry, -1))
        while True:
            open_ = codes[live] & 1 == 1
            some = open_.any(axis=1)
            live, open_ = live[some], open_[some]
            if not len(live):
                return codes >> 1, cos
            # the best open ones of each query, a few at a time
            pick = open_ & (np.cumsum(open_, axis=1) <= SPREAD)
            row, col = np.nonzero(pick)
            nodes = np.full((len(live), SPREAD), -1, dtype=np.int32)
            nodes[row, np.cumsum(pick, axis=1)[row, col] - 1] = codes[live[row], col] >> 1
            codes[live[row], col] -= 1
            add(live, np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(live), -1))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices into the vectors and cosines of the nearest that a beam of this width finds."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        size, links, islands = self.layers[-1]
        last = self.layers.pop()
        try:
            entry = self._entries(q, size)
        finally:
            self.layers.append(last)
        found, cos = self._beam(links, q, self._with_islands(q, entry, islands), width, size)
        return np.where(found >= 0, self.order[np.maximum(found, 0)], -1), cos

    def within(self, unit: np.ndarray, own: Shard, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) for all pairs found with cosine >= least in doubles; full beams are widened until they reach past it."""
        slack = least - 1e-4
        todo, width, out = np.arange(len(unit)), beam, []
        while len(todo):
            if width * 2 * NEIGHBOURS >= len(self.v):
                who, which = own.brute_force(unit[todo], least)
                out.append((todo[who], which))
                break
            found, cos = self.search(unit[todo], width)
            short = (cos[:, -1] >= slack) & (found[:, -1] >= 0)
            r, c = np.nonzero((cos >= slack) & (found >= 0) & ~short[:, None])
            who, which = todo[r], found[r, c]
            sure = own.linked(unit, who, which, least)
            out.append((who[sure], which[sure]))
            todo, width = todo[short], width * 8
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


class Shard:
    """A shard's vectors as they came, with their lengths; cosines are verified in doubles for pairs alone."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, raw: np.ndarray):
        self.nodes, self.weights, self.raw = nodes, weights, raw
        self.norms = norms_of(raw)

    def singles(self) -> np.ndarray:
        return (self.raw / self.norms[:, None]).astype(np.float32)

    def linked(self, unit: np.ndarray, who: np.ndarray, which: np.ndarray, least: float) -> np.ndarray:
        out = np.zeros(len(who), dtype=bool)
        step = max(1, BRUTE_CELLS // max(1, self.raw.shape[1]))
        for a in range(0, len(who), step):
            x, y = who[a : a + step], which[a : a + step]
            out[a : a + step] = np.einsum("ij,ij->i", unit[x], self.raw[y].astype(np.float64)) / self.norms[y] >= least
        return out

    def brute_force(self, unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) for all pairs with cosine >= least in doubles, some queries at a time."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not hasattr(self, "_single"):
            self._single = self.singles()
        step = max(1, BRUTE_CELLS // max(1, len(self.raw)))
        for a in range(0, len(unit), step):
            who, which = np.nonzero(unit[a : a + step].astype(np.float32) @ self._single.T >= least - 1e-4)
            sure = self.linked(unit[a : a + step], who, which, least)
            out.append((who[sure] + a, which[sure]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def norms_of(raw: np.ndarray) -> np.ndarray:
    return np.sqrt((raw.astype(np.float64) ** 2).sum(axis=1))


def packed_vectors(column, single: bool) -> tuple[list[int], list[bytes]]:
    """Rows that have a direction, and their vectors as bytes: single ones as they are, others as units in doubles; rows may differ in length."""
    lengths: dict[int, list[int]] = {}
    for k, x in enumerate(column):
        if x is not None and len(x):
            lengths.setdefault(len(x), []).append(k)
    rows, out = [], []
    for own in lengths.values():
        raw = np.array([np.asarray(column[k], dtype=np.float64) for k in own])
        with np.errstate(all="ignore"):
            # scaled first, so that neither very large nor very small numbers overflow when squared
            scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
            unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
            sound = np.isfinite(unit).all(axis=1)
            # single numbers whose squares stay in range in doubles need no scaling
            kept = raw.astype("<f4") + np.float32(0) if single else unit.astype("<f8") + 0.0
        rows += [k for k, ok in zip(own, sound, strict=True) if ok]
        out += [x.tobytes() for x, ok in zip(kept, sound, strict=True) if ok]
    return rows, out


def link_counts(n: int, ids: np.ndarray, own_ids: np.ndarray, who: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Links of each of n queries, itself left out."""
    return np.bincount(who[ids[who] != own_ids[which]], minlength=n)


def recalled(found: np.ndarray, true: np.ndarray) -> bool:
    """Whether queries with few links and queries with many each find theirs on average, and every single one nearly all."""
    share = np.minimum(found, true)[true > 0] / true[true > 0]
    many = true[true > 0] > QUERY_BEAM
    return all(not len(x) or (x.mean() >= RECALL and x.min() >= WORST) for x in (share[many], share[~many]))


class Joined:
    """Which vectors of a shard hang together by way of queries that link with several of them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return int(x)

    def add(self, who: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join what each query links; returns each query with links, and one of them."""
        order = np.argsort(who, kind="stable")
        who, which = who[order], which[order]
        queries, begin = np.unique(who, return_index=True)
        for part in np.split(self.parent[which], begin[1:]):
            if len(part) > 1 and (part != part[0]).any():
                roots = {self._root(int(x)) for x in np.unique(part)}
                least = min(roots)
                for r in roots:
                    self.parent[r] = least
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return queries, which[begin]


FOUND = "kind int, a long, b long"


def _answer(least: float, single: bool):
    def answer(batches):
        """A partition holds shards one after another: a shard's own vectors, then the queries.

        Yields rows of kind 0 (node, weight of its links), 1 (two linked nodes), 2 (links found and there in audits that passed)
        and 3 (queries that the graph answered, and that brute force did).
        """
        import pandas as pd

        dtype = "<f4" if single else "<f8"
        shard, held, own, graph, joined, beam, audits, asked = None, [], None, None, None, QUERY_BEAM, [0, 0], [0, 0]

        def answered(ids, unit):
            """Pairs found for a block of queries: by the graph, with beams as wide as the audit asks for; by brute force where it
            fails and a wider beam would cost as much."""
            nonlocal beam
            audit = None
            while True:
                who, which = graph.within(unit, own, least, beam)
                got = link_counts(len(unit), ids, own.nodes, who, which)
                if audit is None:
                    # every so manyth query, and as many of those that link, of which there may be few
                    every, some = np.arange(0, len(ids), AUDIT_SHARE), np.flatnonzero(got)
                    audit = np.union1d(every, some[:: -(-len(some) // len(every))]) if len(some) else every
                    true = link_counts(len(audit), ids[audit], own.nodes, *own.brute_force(unit[audit], least))
                got = got[audit]
                if recalled(got, true):
                    audits[0] += int(np.minimum(got, true).sum())
                    audits[1] += int(true.sum())
                    asked[0] += len(ids)
                    return who, which
                if beam * 4 * NEIGHBOURS >= len(own.nodes):
                    asked[1] += len(ids)
                    return own.brute_force(unit, least)
                beam *= 2

        def queries(ids, unit):
            who, which = answered(ids, unit)
            other = ids[who] != own.nodes[which]
            who, which = who[other], which[other]
            if not len(who):
                return None
            weight = np.bincount(who, weights=own.weights[which], minlength=len(ids)).astype(np.int64)
            some, one = joined.add(who, which)
            a = np.concatenate((ids[some], ids[some]))
            b = np.concatenate((weight[some], own.nodes[one]))
            return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), len(some)), "a": a, "b": b})

        def closing():
            """Links among the shard's own vectors that its queries told, what its audits saw, and what answered."""
            low = np.flatnonzero(joined.parent != np.arange(len(own.nodes)))
            a, b = own.nodes[low], own.nodes[joined.parent[low]]
            kinds = np.concatenate((np.full(len(low), 1), [2, 3])).astype(np.int32)
            return pd.DataFrame({"kind": kinds, "a": np.concatenate((a, [audits[0], asked[0]])), "b": np.concatenate((b, [audits[1], asked[1]]))})

        for batch in batches:
            keys = batch["shard"].to_numpy() * 2 + batch["side"].to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            for part in np.split(np.arange(len(keys)), edges):
                s, side = int(keys[part[0]] // 2), int(keys[part[0]] % 2)
                if s != shard:
                    if own is not None:
                        yield closing()
                    shard, held, own, graph, joined, beam, audits, asked = s, [], None, None, None, QUERY_BEAM, [0, 0], [0, 0]
                for a in range(0, len(part), BLOCK):
                    rows = part[a : a + BLOCK]
                    ids = batch["node"].to_numpy()[rows]
                    raw = np.frombuffer(b"".join(batch["packed"].iloc[rows]), dtype=dtype).reshape(len(rows), -1)
                    if side == 0:
                        held.append((ids, batch["n"].to_numpy()[rows], raw))
                        continue
                    if own is None:
                        if not held:
                            continue
                        own = Shard(*(np.concatenate([h[k] for h in held]) for k in range(3)))
                        held, graph, joined = [], Graph(own.singles()), Joined(len(own.nodes))
                    out = queries(ids, raw.astype(np.float64) / norms_of(raw)[:, None])
                    if out is not None:
                        yield out
        if own is not None:
            yield closing()

    return answer


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Every usable row's (vec_id, key), and the distinct vectors: node, key, n (ids that have it), packed."""
    column = vectors.schema["embedding"].dataType
    single = isinstance(column, ArrayType) and isinstance(column.elementType, FloatType)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def pack(batches):
        import pandas as pd

        for batch in batches:
            at, blobs = packed_vectors(list(batch["embedding"]), single)
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[at], "packed": blobs})

    packed = stash(rows.where(sound).mapInPandas(pack, "vec_id long, packed binary").withColumn("key", F.md5("packed")), "vector-packed")
    folded = packed.groupBy("key", "packed").agg(F.count_distinct("vec_id").alias("n"))
    # written at once, so the numbers stay
    nodes = stash(folded.select(F.monotonically_increasing_id().alias("node"), "key", "n", "packed"), "vector-nodes")
    return packed.select("vec_id", "key").distinct(), nodes, single


def find_links(nodes: DataFrame, single: bool, least: float = THRESHOLD) -> DataFrame:
    """Rows of kind 0 (node, number of rows it links with), 1 (linked nodes), 2 (links found by audits, links there) and 3 (queries
    answered by graphs, by brute force), for distinct vectors."""
    size = nodes.agg(F.count("*").alias("n"), F.max(F.length("packed")).alias("bytes")).first()
    rows = max(1, SHARD_BYTES // max(1, 20 * (size["bytes"] or 4) // (4 if single else 8)))
    shards = max(LEAST_SHARDS, -(-size["n"] // rows))
    # vectors of one length at a time: the length is part of the shard's key
    length = F.length("packed").cast("long")
    deal = lambda df, k, side: df.select(k.cast("int").alias("place"), (k + length * shards).alias("shard"), F.lit(side).alias("side"), "node", "n", "packed")
    own = deal(nodes, F.pmod(F.xxhash64("node"), F.lit(shards)), 0)
    asked = nodes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    streamed = own.unionByName(deal(asked, F.col("k"), 1)).repartitionById(shards, F.col("place")).sortWithinPartitions("shard", "side")
    return stash(streamed.drop("place").mapInPandas(_answer(least, single), FOUND), "vector-links")


def audited_recall(found: DataFrame) -> float | None:
    """The share of links that were found of those that audits of graph answers saw; None if they saw none."""
    row = found.where("kind = 2").agg(F.sum("a").alias("found"), F.sum("b").alias("true")).first()
    return row["found"] / row["true"] if row["true"] else None


def brute_share(found: DataFrame) -> float:
    """The share of queries (a vector asked of a shard) that brute force answered after the graph's audit failed."""
    row = found.where("kind = 3").agg(F.sum("a").alias("graph"), F.sum("b").alias("brute")).first()
    return (row["brute"] or 0) / max(1, (row["graph"] or 0) + (row["brute"] or 0))


def dedup_vectors(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing.  Cosine is taken between vectors of equal length only.
    n_links counts the other ids' vectors that link with the row's own, equal
    ones included; a vec_id that has several different vectors gets their sum,
    and the same row each time.  Equal vectors under one vec_id count as one.
    Labels and further columns are not looked at.  A null vec_id links with
    nothing and keeps null.  An empty table gives an empty table.
    """
    pairs, nodes, single = _nodes(vectors)
    found = find_links(nodes, single, least)
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "node")
    placed = stash(pairs.join(nodes.select("key", "node", "n"), "key").select("vec_id", "node", "n"), "vector-places")
    # an id with several vectors ties them together
    several = placed.groupBy("vec_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("c")).where("c > 1")
    ties = placed.join(broadcast_if_small(stash(several, "vector-several"), 32), "vec_id").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    links = found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(ties)
    labels = components(links, "vector")
    known = stash(placed.join(counts, "node", "left").join(labels, "node", "left").select("vec_id", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "vector-known")
    least_id = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    told = known.join(least_id, "component").groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
        .join(told, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
