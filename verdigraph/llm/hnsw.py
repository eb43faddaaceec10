"""Embedding near-dedup: a hierarchical navigable small-world graph over pivots, and under each pivot the vectors that hang from it.

Pivots are a bounded sample of the vectors, none linked with another, so that a dense group has one of them. A search of their graph gives each
vector its nearest ones: it hangs in the first one's cell and visits the next ones'. What meets in a cell is compared, by 32-bit products and in
double precision where these are too near to the limit. Vectors so near to a pivot that any two of them are linked are counted, not compared. An
audit compares a sample of the vectors with all others, before any cell is, and tells how many cells each must go to for ``RECALL`` of its links,
and of all; all of them in a table of ``AUDIT_ROWS`` or less. Where ``CELLS`` cells are too few, pivots are made fewer, to a single one at last,
where all is compared with all. A cell of many vectors is dealt into blocks, in files, of which tasks read each two by path. Only counts and a
spanning forest leave a task, never all pairs of a dense group. Components come from the forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links and are their own component;
vectors of different lengths have none with each other; rows with one identifier are one vector (the greatest of them) and get equal
results; a null identifier has 0 links and a null component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, new_path, parts, release, released, save, scratch_path, stored, table
from .components import components, forest

COSINE = 0.9
RECALL, AUDIT, LINKS = 0.99, 64, 500
#: At least so many cells, and rows that a cell has on average where they are more.
SHARDS, CELL_ROWS, WHOLE = 6, 2048, 1 << 62
#: At most so many pivots, and so many bytes of them; cells that a vector goes to; the beam that finds them.
PIVOTS, PIVOT_BYTES, CELLS, PIVOT_BEAM = 1 << 14, 8 << 20, 8, 24
#: Vectors go to more cells than ``RECALL`` needs, up to ``FEW``, until the audit finds this part of the links.
SURE, FEW = 0.999, 4
#: Vectors that the audit asks, and those it asks where these hold few links.
AUDIT_ROWS = (1024, 4096)
#: Rows and bytes of a block; a cell with more is dealt into several.
BLOCK_ROWS, BLOCK_BYTES = 1 << 14, 8 << 20
M, BUILD_BEAM, BEAM = 16, 64, 48
TOGETHER = 4
QUERIES = 512
#: A beam of more than one TURN-th of a shard costs more than comparing with all its rows, so that is done instead.
TURN = 8


class Graph:
    """Layers of neighbours over the rows of x (unit length, 32 bit). Layer 0 has all rows; each layer above about 1 / M of those below."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.x = x
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list:
        n = len(self.x)
        u = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        layers: list = []
        for at in range(level.max(initial=0), -1, -1):
            rows = order[: int((level >= at).sum())]
            if len(rows):
                layers.insert(0, self._layer(rows, layers, 2 * M if at == 0 else M))
        return layers

    def _layer(self, rows: np.ndarray, above: list, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, neighbours as positions in rows): rows enter in growing batches; those of a batch also see each other."""
        x = self.x[rows]
        near = np.full((len(rows), width), -1, np.int32)
        entry = self._descend(x, above, rows)
        done = 0
        while done < len(rows):
            size = min(len(rows) - done, max(16, min(QUERIES, done // 2)))
            new = np.arange(done, done + size)
            inside = x[new] @ x[new].T
            np.fill_diagonal(inside, -2)
            k = min(M * 2, size - 1)
            ids = np.argpartition(-inside, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((size, 0), int)
            sims = np.take_along_axis(inside, ids, 1)
            ids = ids + done
            if done:
                got, sim = _search(x, near, x[new], np.where(entry[new] < done, entry[new], 0), BUILD_BEAM)
                ids, sims = np.concatenate([got, ids], 1), np.concatenate([sim, sims], 1)
            near[new] = self._choose(x, ids, sims, width)
            self._back(x, near, new, width)
            done += size
        return rows, near

    def _descend(self, q: np.ndarray, layers: list, rows: np.ndarray | None = None) -> np.ndarray:
        """For each query, the position in the next lower layer of the nearest row found in the layers above. A layer's rows begin with
        those of the layer above, so positions carry over."""
        at = np.zeros(len(q), np.int64)
        for own, near in reversed(layers):
            x = self.x[own]
            for first in range(0, len(q), QUERIES):
                some = slice(first, first + QUERIES)
                at[some] = _search(x, near, q[some], at[some], 4)[0][:, 0]
        return at

    def _choose(self, x, ids, sims, width) -> np.ndarray:
        """Diverse neighbours: a candidate stays if it is nearer to the row than to all that stayed; then the nearest others, to half the width."""
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), width), -1, np.int32)
        for first in range(0, len(ids), 64):
            i, s = ids[first : first + 64], sims[first : first + 64]
            valid = (s > -1.5) & (i >= 0)
            v = x[np.maximum(i, 0)]
            among = np.matmul(v, v.transpose(0, 2, 1))
            stay = np.zeros(i.shape, bool)
            for k in range(i.shape[1]):
                closest = np.where(stay, among[:, k, :], -2).max(axis=1)
                stay[:, k] = valid[:, k] & (s[:, k] > closest) & (stay.sum(axis=1) < width)
            rest = valid & ~stay
            room = np.maximum(width // 2 - stay.sum(axis=1), 0)
            stay |= rest & (np.cumsum(rest, axis=1) <= room[:, None])
            for k, (row, keep) in enumerate(zip(i, stay)):
                got = row[keep]
                out[first + k, : len(got)] = got
        return out

    def _back(self, x, near, new, width) -> None:
        """Neighbours learn of the new rows; those with too many choose again."""
        a = np.repeat(new, width)
        b = near[new].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        targets, starts, counts = np.unique(b, return_index=True, return_counts=True)
        for first in range(0, len(targets), 256):
            t, s, c = (z[first : first + 256] for z in (targets, starts, counts))
            extra = np.full((len(t), min(int(c.max()), 4 * width)), -1, np.int64)
            for k in range(extra.shape[1]):
                has = c > k
                extra[has, k] = a[s[has] + k]
            ids = np.concatenate([near[t].astype(np.int64), extra], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", x[np.maximum(ids, 0)], x[t]), -2)
            near[t] = self._choose(x, ids, sims, width)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x (-1: none) and their cosines, up to ``beam`` for each query."""
        entry = self._descend(q, self.layers[1:])
        own, near = self.layers[0]
        ids, sims = [], []
        for first in range(0, len(q), QUERIES):
            i, s = _search(self.x0(), near, q[first : first + QUERIES], entry[first : first + QUERIES], beam)
            ids.append(np.where(i >= 0, own[np.maximum(i, 0)], -1))
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def x0(self) -> np.ndarray:
        if getattr(self, "_x0", None) is None:
            self._x0 = self.x[self.layers[0][0]]
        return self._x0


def _search(x, near, q, entry, beam) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries in step: each expands its best unexpanded entries until its beam has none left."""
    n, none = len(q), len(x)
    links = np.concatenate([np.where(near < 0, none, near), np.full((1, near.shape[1]), none, near.dtype)])
    told, found = np.full((n, beam), -1, np.int64), np.full((n, beam), -2.0, np.float32)
    ids, sims, open_ = np.full((n, beam), none, np.int64), found.copy(), np.zeros((n, beam), bool)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("bd,bd->b", x[entry], q), True
    seen = np.zeros((n, none + 1), bool)
    seen[np.arange(n), entry] = seen[:, none] = True
    seen = seen.ravel()
    live = np.arange(n)
    together = min(TOGETHER, beam)
    while len(live):
        s = np.where(open_, sims, -3)
        top = np.argpartition(-s, together - 1, axis=1)[:, :together]
        nodes = np.where(np.take_along_axis(s, top, 1) > -3, np.take_along_axis(ids, top, 1), none)
        np.put_along_axis(open_, top, False, 1)
        nbrs = links[nodes].reshape(len(live), -1)
        nbrs.sort(axis=1)
        bad = seen.take(nbrs + (live * (none + 1))[:, None])
        bad[:, 1:] |= nbrs[:, 1:] == nbrs[:, :-1]
        r, c = np.nonzero(~bad)
        new = nbrs[r, c]
        seen[live[r] * (none + 1) + new] = True
        got = np.einsum("kd,kd->k", x[new], q[live[r]])
        better = got > sims.min(axis=1)[r]  # others would leave the beam at once
        r, new, got = r[better], new[better], got[better]
        count = np.bincount(r, minlength=len(live))
        if len(r):
            c = beam + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            wide = ((0, 0), (0, int(count.max())))
            all_i, all_s, all_o = np.pad(ids, wide, constant_values=none), np.pad(sims, wide, constant_values=-2), np.pad(open_, wide)
            all_i[r, c], all_s[r, c], all_o[r, c] = new, got, True
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids, sims, open_ = (np.take_along_axis(z, best, 1) for z in (all_i, all_s, all_o))
        more = open_.any(axis=1)
        if not more.all():
            told[live[~more]], found[live[~more]] = ids[~more], sims[~more]
            live, ids, sims, open_ = live[more], ids[more], sims[more], open_[more]
    order = np.argsort(-found, axis=1)
    told, found = np.take_along_axis(told, order, 1), np.take_along_axis(found, order, 1)
    return np.where(found > -1.5, told, -1), found


def exact(q: np.ndarray, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, row) by comparing with all rows, in double precision."""
    return np.nonzero(q @ x.T >= cosine)


def found_links(graph: Graph, x: np.ndarray, q: np.ndarray, q32: np.ndarray, cosine: float, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Links (query, row) that the graph gives, verified; the queries that must be answered exactly: a beam full of links; and of the
    audit, the true links and those that the graph missed. ``same``: the queries are the rows, so row i is no link of query i.

    Queries without a full beam are audited, AUDIT at a time, until they hold LINKS links. Where all are, the audit is the answer."""
    order = np.random.default_rng(len(q)).permutation(len(q))
    truth_a, truth_b, audited = np.zeros(0, int), np.zeros(0, int), np.zeros(len(q), bool)
    beam = BEAM
    while beam * TURN <= len(x):
        ids, sims = graph.search(q32, beam)
        near = (sims >= cosine - 1e-3) & (ids >= 0)
        full = near.all(axis=1)
        near[full] = False
        r, c = np.nonzero(near)
        rows = ids[r, c]
        ok = np.concatenate([np.einsum("kd,kd->k", q[r[i : i + 100_000]], x[rows[i : i + 100_000]]) >= cosine for i in range(0, len(r), 100_000)] or [np.zeros(0, bool)])
        r, rows = r[ok], rows[ok]
        links = int((~full[truth_a]).sum())
        left = order[~full[order] & ~audited[order]]
        for at in range(0, len(left), AUDIT):
            if links >= LINKS:
                break
            some = left[at : at + AUDIT]
            audited[some] = True
            a, b = exact(q[some], x, cosine)
            a = some[a]
            if same:
                a, b = a[a != b], b[a != b]
            truth_a, truth_b, links = np.concatenate([truth_a, a]), np.concatenate([truth_b, b]), links + len(a)
        counted = ~full[truth_a]
        missed = int((~np.isin(truth_a[counted] * len(x) + truth_b[counted], r * len(x) + rows)).sum())
        if (audited | full).all():
            return truth_a[counted], truth_b[counted], np.flatnonzero(full), links, missed
        if missed <= (1 - RECALL) * links:
            return r, rows, np.flatnonzero(full), links, missed
        beam *= 2
    return np.zeros(0, int), np.zeros(0, int), np.arange(len(q)), 0, 0


class Rows:
    """Vectors that meet in a cell: identifiers, unit rows in double and 32 bit, and the cells that each goes to, its own first. ``core``: so near to
    the cell's pivot that any two of them are linked; ``halo``: so near that a link with one of the core is possible."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray, pivot: np.ndarray, cosine: float) -> None:
        self.ids, self.x, self.cells = ids, x, cells
        self.x32 = x.astype(np.float32)
        half, sim = np.arccos(cosine) / 2, x @ pivot
        self.core = (sim >= np.cos(half) + 1e-9)
        self.halo = sim >= np.cos(min(3 * half, np.pi)) - 1e-9


def near_pairs(one: Rows, some: np.ndarray, two: Rows, others: np.ndarray, cosine: float):
    """Links between rows ``some`` of one and ``others`` of two, block by block: 32-bit products, those too near to the limit again in double."""
    band = np.float32(1e-5 + 4e-7 * one.x.shape[1])
    y = two.x32[others]
    for i in range(0, len(some), 1024):
        x = one.x32[some[i : i + 1024]]
        for j in range(0, len(others), 4096):
            sims = x @ y[j : j + 4096].T
            r, c = np.divmod(np.flatnonzero(sims >= cosine - band), sims.shape[1])
            if len(r):
                doubt = np.flatnonzero(sims[r, c] < cosine + band)
                r, c = some[i + r], others[j + c]
                out = np.zeros(len(r), bool)
                for k in range(0, len(doubt), 100_000):
                    d = doubt[k : k + 100_000]
                    out[d] = np.einsum("kd,kd->k", one.x[r[d]], two.x[c[d]]) < cosine
                yield r[~out], c[~out]


class Found:
    """Counts of links and a forest over the rows of a cell, of which ``two`` come after ``one``."""

    def __init__(self, one: Rows, two: Rows | None = None) -> None:
        self.ids = one.ids if two is None else np.concatenate([one.ids, two.ids])
        self.counts, self.root = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.counts += np.bincount(a, minlength=len(self.ids)) + np.bincount(b, minlength=len(self.ids))
            self.root = forest(np.concatenate([np.arange(len(self.root)), a]), np.concatenate([self.root, b]), len(self.root))

    def batch(self) -> pa.RecordBatch:
        some = self.counts > 0
        return _links(self.ids[some], self.ids[self.root[some]], self.counts[some])


def _links(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def meet_own(rows: Rows, cosine: float) -> Found:
    """Links among rows of one cell or block, but those of its core, which ``core_links`` counts."""
    found = Found(rows)
    rest, core = np.flatnonzero(~rows.core), np.flatnonzero(rows.core)
    for i in range(0, len(rest), 4096):  # each pair once: a block meets itself and what comes after it
        for a, b in near_pairs(rows, rest[i : i + 4096], rows, rest[i:], cosine):
            found.add(a[a < b], b[a < b])
    for a, b in near_pairs(rows, rest[rows.halo[rest]], rows, core, cosine):
        found.add(a, b)
    return found


def core_links(rows: Rows, total: int, least: int) -> pa.RecordBatch:
    """The core's links: each with all others of the cell's core, which are ``total`` rows with ``least`` the smallest of them."""
    ids = rows.ids[rows.core] if total > 1 else rows.ids[:0]
    return _links(ids, np.full(len(ids), least), np.full(len(ids), total - 1))


def meet_two(one: Rows, two: Rows, cosine: float, cell: int | None = None) -> Found:
    """Links between two blocks of a cell, but those between their cores. cell: two are visitors of it, from cells of their own; where the other one of
    a link visits that cell in turn, the link counts in the lower of the two."""
    found, m = Found(one, two), len(one.ids)
    core, rest = np.flatnonzero(one.core), np.flatnonzero(~one.core)
    other = np.arange(len(two.ids)) if cell is not None else np.flatnonzero(~two.core)
    meets = [(rest, other), (core, other[two.halo[other]])]
    if cell is None:
        meets.append((rest[one.halo[rest]], np.flatnonzero(two.core)))
    for left, right in meets:
        if len(left) and len(right):
            for b, a in near_pairs(two, right, one, left, cosine):
                if cell is not None:
                    home = two.cells[b, 0]
                    once = (home > cell) | ~(one.cells[a] == home[:, None]).any(axis=1)
                    a, b = a[once], b[once]
                found.add(a, b + m)
    return found


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # large or tiny components neither overflow nor vanish
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def pack(x: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * step).astype(np.int32)), pa.py_buffer(x)])


def unpack(column, dtype, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([unpack(c, dtype, width) for c in column.chunks] or [np.zeros((0, width), dtype)])
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, width), dtype)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(column), width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int32()))


def unlist(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([unlist(c, width) for c in column.chunks] or [np.zeros((0, width), np.int32)])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, width)


def each_length(batch: pa.RecordBatch):
    """For each length of vectors in a batch: the length, and its rows as a batch."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), batch if (dims == d).all() else batch.filter(pa.array(dims == d))


def thinned(x: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """Positions of at most ``most`` rows, in order, none linked with one before it: a dense group has one of them."""
    kept = np.zeros(0, int)
    for i in range(0, len(x), 512):
        new = np.arange(i, min(i + 512, len(x)))
        if len(kept):
            new = new[(x[new] @ x[kept].T).max(axis=1) < cosine]
        near = x[new] @ x[new].T >= cosine
        fresh = np.ones(len(new), bool)
        for k in range(len(new)):
            fresh[k] = not (near[k, :k] & fresh[:k]).any()
        kept = np.concatenate([kept, new[fresh]])
        if len(kept) >= most:
            break
    return kept[:most]


def nearest(pivots: Graph, x: np.ndarray, width: int) -> np.ndarray:
    """For each row, the ``width`` nearest pivots that a search of their graph finds, nearest first; -1 for none."""
    out = np.full((len(x), width), -1, np.int32)
    if len(pivots.x) == 1:
        out[:, 0] = 0
        return out
    beam = min(len(pivots.x), max(PIVOT_BEAM, 2 * width))
    for i in range(0, len(x), 4096):
        ids = pivots.search(x[i : i + 4096].astype(np.float32), beam)[0][:, :width]
        out[i : i + 4096, : ids.shape[1]] = ids
    return out


def write_pivots(path: str, x: np.ndarray) -> None:
    """Double unit vectors, and their graph."""
    layers = {f"{name}{i}": a for i, pair in enumerate(Graph(x.astype(np.float32)).layers) for name, a in zip(("own", "near"), pair)}
    save(path, x=x, size=np.array([len(x)]), **layers)


def read_pivots(path: str) -> tuple[np.ndarray, Graph]:
    f = load(path)
    x = f["x"].reshape(int(f["size"][0]), -1)
    layers, i = [], 0
    while f"own{i}" in f:
        layers.append((f[f"own{i}"], f[f"near{i}"].reshape(len(f[f"own{i}"]), -1)))
        i += 1
    return x, Graph(x.astype(np.float32), layers)


def _part(column: str, share):
    """Whether a value's hash is in this share of all."""
    return F.pmod(F.xxhash64(column, F.lit(29)), F.lit(1 << 40)) < (share * (1 << 40)).cast("long")


def _route(each: DataFrame, sizes: dict[int, int], rows: int, dtype, cosine: float) -> tuple[DataFrame, dict[int, str]]:
    """Every vector with its nearest cells, stored: vec_id, dim, v, cells; and the file of pivots for each length. rows: a cell has about so many."""
    spark = each.sparkSession
    folder, n = scratch_path(spark, "pivots"), parts(spark)
    most = {d: max(1, min(max(SHARDS, -(-n_ // rows)) if rows < WHOLE else 1, PIVOTS, PIVOT_BYTES // (4 * d))) for d, n_ in sizes.items()}
    share = F.create_map(*[F.lit(x) for d, n_ in sizes.items() for x in (d, min(1.0, (2.0 * most[d] + 64) / n_))])

    def build(key, group):
        d = key[0].as_py()
        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids)
        order = order[np.random.default_rng(len(ids)).permutation(len(ids))]
        x = unit(unpack(group.column("v"), dtype, d)[order])
        path = new_path(folder, "pivots")
        write_pivots(path, x[thinned(x.astype(np.float32), most[d], cosine)])
        release()
        return pa.table({"dim": pa.array([d], pa.int32()), "path": [path]})

    sample = each.where(_part("vec_id", share[F.col("dim")])).mapInArrow(released(_packed(dtype)), "vec_id long, dim int, v binary")
    paths = {r["dim"]: r["path"] for r in sample.repartition(min(n, len(sizes)), "dim").groupBy("dim").applyInArrow(build, "dim int, path string").collect()}
    if lost := sizes.keys() - paths.keys():  # the share held none of a length: all of it is the sample
        few = each.where(F.col("dim").isin(list(lost))).mapInArrow(released(_packed(dtype)), "vec_id long, dim int, v binary")
        paths |= {r["dim"]: r["path"] for r in few.groupBy("dim").applyInArrow(build, "dim int, path string").collect()}

    def route(batches):
        graphs: dict = {}
        for batch in _packed(dtype)(batches):
            for d, b in each_length(batch):
                if d not in graphs:
                    graphs[d] = read_pivots(paths[d])[1]
                cells = nearest(graphs[d], unit(unpack(b.column("v"), dtype, d)), CELLS)
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "dim": b.column("dim"), "v": b.column("v"), "cells": lists(cells)})

    return stored(each.mapInArrow(released(route), "vec_id long, dim int, v binary, cells array<int>"), "routed"), paths


def _packed(dtype):
    def run(batches):
        for batch in batches:
            for d, b in each_length(batch):
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(dtype)
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "dim": b.column("dim").cast(pa.int32()), "v": pack(x)})

    return run


def _audited(routed: DataFrame, total: int, rows: int, dtype, cosine: float) -> np.ndarray:
    """For each of about ``rows`` vectors that has links: how many links are found by the 1, 2, ... CELLS nearest cells first, and by none. The links
    are found by comparing with all vectors."""
    spark = routed.sparkSession
    folder = scratch_path(spark, "audits")

    def gather(batches):
        for b in (b for batch in batches for b in each_length(batch)):
            path = new_path(folder, "audit")
            save(path, ids=b[1].column("vec_id").to_numpy(zero_copy_only=False), x=unpack(b[1].column("v"), dtype, b[0]), cells=unlist(b[1].column("cells"), CELLS))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([b[0]], pa.int32()), "path": [path]})

    some = routed if rows >= total else routed.where(_part("vec_id", F.lit(rows / total)))
    paths = [(r["dim"], r["path"]) for r in some.coalesce(1).mapInArrow(released(gather), "dim int, path string").collect()]

    def count(batches):
        asked: dict = {}
        for d, path in paths:
            f = load(path)
            asked.setdefault(d, []).append((f["ids"], unit(f["x"].reshape(-1, d)), f["cells"].reshape(-1, CELLS)))
        asked = {d: Rows(*(np.concatenate(x) for x in zip(*fs)), np.zeros(d), cosine) for d, fs in asked.items()}
        told = {d: np.zeros((len(q.ids), CELLS + 1), np.int64) for d, q in asked.items()}
        for d, b in (x for batch in batches for x in each_length(batch)):
            if d not in asked:
                continue
            q = asked[d]
            rows = Rows(b.column("vec_id").to_numpy(zero_copy_only=False), unit(unpack(b.column("v"), dtype, d)), unlist(b.column("cells"), CELLS), np.zeros(d), cosine)
            for c, r in near_pairs(rows, np.arange(len(rows.ids)), q, np.arange(len(q.ids)), cosine):
                other = rows.ids[c] != q.ids[r]
                r, c = r[other], c[other]
                at = np.full(len(r), CELLS)
                for k in range(CELLS - 1, -1, -1):
                    at[(q.cells[r, k] == rows.cells[c, 0]) | (rows.cells[c, k] == q.cells[r, 0])] = k
                np.add.at(told[d], (r, at), 1)
        for d, n in told.items():
            r, at = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"q": pa.array(asked[d].ids[r], pa.int64()), "k": pa.array(at, pa.int32()), "n": pa.array(n[r, at], pa.int64())})

    if not paths:
        return np.zeros((0, CELLS + 1), np.int64)
    got = routed.mapInArrow(released(count), "q long, k int, n long").groupBy("q", "k").agg(F.sum("n").alias("n")).collect()
    at = {q: i for i, q in enumerate(sorted({r["q"] for r in got}))}
    out = np.zeros((len(at), CELLS + 1), np.int64)
    for r in got:
        out[at[r["q"]], r["k"]] = r["n"]
    return out


def recalls(told: np.ndarray) -> np.ndarray:
    """The audit's recall by each number of cells: of all links, or as the mean of the vectors that have some, whichever is less."""
    part = np.cumsum(told[:, :-1], axis=1)
    return np.minimum(part.sum(axis=0) / told.sum(), (part / told.sum(axis=1, keepdims=True)).mean(axis=0))


def near_duplicates(vectors: DataFrame, key: str, vector: str, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, and the audit's recall (null where it holds no link): a row for each row of vectors."""
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    dtype = np.dtype(np.float32 if single else np.float64)
    named = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    each = named.where(F.col("vec_id").isNotNull() & fine)
    if each.groupBy("vec_id").count().where("count > 1").limit(1).count():  # else no vector is shuffled for it
        each = stored(each.groupBy("vec_id").agg(F.max("v").alias("v")), "vectors")
    each = each.withColumn("dim", F.size("v"))
    sizes = {r["dim"]: r["n"] for r in each.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if not sizes:
        return _told(named, spark.createDataFrame([], "vec_id long, n_links long, component_id long"), None)
    total, rows, recall = sum(sizes.values()), CELL_ROWS, None
    while True:
        routed, paths = _route(each, sizes, rows, dtype, cosine)
        if rows >= WHOLE:  # a single cell for each length: all are compared
            width, recall = 1, 1.0
            break
        told = _audited(routed, total, AUDIT_ROWS[0], dtype, cosine)
        if (told.sum() < LINKS or len(told) < AUDIT) and total > AUDIT_ROWS[0]:
            told = _audited(routed, total, AUDIT_ROWS[1], dtype, cosine)
        every = total <= AUDIT_ROWS[1]
        if not len(told):
            width = 1 if every else CELLS
            break
        found = recalls(told)
        good = np.flatnonzero(found >= (1.0 if every else RECALL))
        if len(good):
            sure = np.flatnonzero(found >= SURE)
            width = 1 + max(int(good[0]), min(int(sure[0]) if len(sure) else CELLS, FEW - 1) if not every else 0)
            if not every and (told.sum() < LINKS or len(told) < AUDIT):
                width = CELLS
            recall = float(found[width - 1])
            break
        rows = rows * 8 if max(sizes.values()) > rows * 8 * SHARDS else WHOLE
    found = _compared(routed, paths, sizes, width, dtype, cosine)
    labels = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    told = counts.join(labels, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", F.col("component").alias("component_id"))
    return _told(named, told, recall)


def _compared(routed: DataFrame, paths: dict[int, str], sizes: dict[int, int], width: int, dtype, cosine: float) -> DataFrame:
    """a, b, n: a has n links with vectors that it met in a cell, and is connected with b."""
    spark = routed.sparkSession
    folder = scratch_path(spark, "blocks")
    visits = routed.select("vec_id", "dim", "v", F.slice("cells", 1, width).alias("cells"), F.posexplode(F.slice("cells", 1, width)).alias("rank", "cell")).where("cell >= 0")
    sized = visits.groupBy("dim", "cell").agg(F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).alias("own"), F.count(F.lit(1)).alias("all"))
    most = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    great = sized.withColumn("most", most).where("own > most or all - own > 4 * most")
    great = great.select("dim", "cell", F.ceil(F.col("own") / F.col("most")).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("own")) / F.col("most")).cast("int").alias("more"))
    great = stored(great, "great")  # at most a row for so many vectors as a block holds
    chosen = F.xxhash64("vec_id", F.lit(31))
    block = F.when(F.col("blocks").isNull(), -1).when(F.col("rank") == 0, F.pmod(chosen, F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(chosen, F.col("more"))).cast("int")
    dealt = visits.join(F.broadcast(great), ["dim", "cell"], "left").select("vec_id", "dim", "v", "cells", "cell", block.alias("block"), (F.col("rank") > 0).alias("visitor"))
    pivots: dict = {}

    def pivot(d, cell):
        if d not in pivots:
            f = load(paths[d])
            pivots[d] = f["x"].reshape(-1, d)
        return pivots[d][cell]

    shape = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "dim": pa.int32(), "cell": pa.int32(), "block": pa.int32(), "visitor": pa.bool_(), "path": pa.string()}

    def first(key, group):
        d, cell, block = (k.as_py() for k in key)
        visitor = group.column("visitor").to_numpy()
        ids, raw, cells = group.column("vec_id").to_numpy(), unpack(group.column("v"), dtype, d), unlist(group.column("cells"), width)
        if block < 0:
            one, two = (Rows(ids[at], unit(raw[at]), cells[at], pivot(d, cell), cosine) for at in (~visitor, visitor))
            out = [meet_own(one, cosine).batch()]
            if one.core.any():
                out.append(core_links(one, int(one.core.sum()), int(one.ids[one.core].min())))
            if len(two.ids) and len(one.ids):
                out.append(meet_two(one, two, cosine, cell).batch())
            got = pa.Table.from_batches(out)
            return pa.table({k: got.column(k) if k in "abn" else pa.nulls(len(got), t) for k, t in shape.items()})
        path = new_path(folder, "block")
        core = Rows(ids, unit(raw), cells, pivot(d, cell), cosine).core & ~visitor
        save(path, ids=ids, x=raw, cells=cells)
        release()
        told = {"a": None, "b": int(ids[core].min()) if core.any() else None, "n": int(core.sum()), "dim": d, "cell": cell, "block": block, "visitor": bool(visitor[0]), "path": path}
        return pa.table({k: pa.array([told[k]], t) for k, t in shape.items()})

    n = max(parts(spark), -(-sum(8 * d * m for d, m in sizes.items()) * width // (64 << 20)))
    told = "a long, b long, n long, dim int, cell int, block int, visitor boolean, path string"
    found = stored(dealt.repartition(n, "dim", "cell", "block").groupBy("dim", "cell", "block").applyInArrow(first, told), "links")
    links = found.where("path IS NULL").select("a", "b", "n")
    if not great.limit(1).count():
        return links
    blocks = found.where("path IS NOT NULL")
    cores = blocks.groupBy("dim", "cell").agg(F.sum("n").alias("core"), F.min("b").alias("least"))
    one = blocks.where("NOT visitor").select("dim", "cell", F.col("block").alias("i"), F.col("path").alias("i_path"))
    two = blocks.select("dim", "cell", F.col("block").alias("j"), F.col("path").alias("j_path"), "visitor")
    met = one.join(two, ["dim", "cell"]).where("i <= j").join(cores, ["dim", "cell"])

    def read(path, d, cell):
        f = load(path)
        return Rows(f["ids"], unit(f["x"].reshape(-1, d)), f["cells"].reshape(-1, width), pivot(d, cell), cosine)

    def then(batches):
        for batch in batches:
            for d, cell, i, path, j, other, visitor, core, least in zip(*(c.to_pylist() for c in batch.columns)):
                rows = read(path, d, cell)
                if i == j:
                    yield meet_own(rows, cosine).batch()
                    if rows.core.any():
                        yield core_links(rows, core, least)
                else:
                    yield meet_two(rows, read(other, d, cell), cosine, cell if visitor else None).batch()

    met = met.select("dim", "cell", "i", "i_path", "j", "j_path", "visitor", "core", "least").repartition(n, "dim", "cell", "i", "j")
    return links.union(stored(met.mapInArrow(released(then), "a long, b long, n long"), "links"))


def _told(named: DataFrame, found: DataFrame, recall: float | None) -> DataFrame:
    out = named.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept, F.lit(recall).cast("double").alias("audit_recall"))


def op4_hnsw_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").drop("audit_recall")


OP4_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, max(embedding::DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0 GROUP BY vec_id),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.9::DOUBLE * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
reach(node, root) AS (
  SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(r.root, e.vec_id) AS component_id, coalesce(r.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN roots r ON r.node = e.vec_id
"""
