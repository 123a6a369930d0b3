"""Exact cosine joins of two sets of vectors by cells and angles.

Angles between vectors obey the triangle inequality. Pivots, a bounded number that a sample of
vectors gives, cut the space into cells; a cell knows the least and the largest angle of its
members to its pivot and the few least ones. A vector meets a cell only if those bounds leave room
for a member within its reach: the angle of the least similarity asked for, or the angle within
which its k best must lie, whichever is smaller. What is skipped provably holds no result.

Equal vectors are folded first, so a vector that a third of all rows share is one row. Cells are
bundled and dealt into a grid of blocks of about ``block`` members and twice as many visitors, so a
heavy cell is many tasks and no group holds much more than that. ``block`` is a 16th of the members
between 2000 and 65 536, so where nothing can be skipped what is shipped grows with the vectors, not
with their square, up to a million of them. Within a block visitors meet cell by cell, ``_TILE`` at a
time, and hand on the k best of the whole block. Vectors travel packed, a row for what a batch sends
to a block. On the driver and in broadcasts lie the pivots and
the bounds and sizes of their cells, whatever the number of vectors; the plan has one form at any size.

Defined cases: rows with a null, empty or non-finite embedding have no neighbour; a vector too
short for its angle to be exact (norm below 0.01, zero among them) lies in a cell that everything
meets; an id pairs with each other id alone, so copies of a vector are neighbours of each other;
ties in similarity, rounded to nine digits, go to the smaller id; empty sides give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.files import stored

SHORT = 0.01
_TILE = 2000
_CANDIDATE = "rep long, id long, score double"
_CANDIDATE_ARROW = pa.schema([("rep", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_BEST = "array<struct<a:long,b:long,similarity:double>>"
_PART = f"n long, total double, top double, n_above long, best {_BEST}"
_PART_ARROW = pa.schema([("n", pa.int64()), ("total", pa.float64()), ("top", pa.float64()), ("n_above", pa.int64()), ("best", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])))])


@dataclass(frozen=True)
class Cells:
    """Pivots (unit rows), and of each cell: size, least and largest angle, least angles (k1 of them, infinite where there are fewer).

    The last cell is that of short vectors and has no pivot.
    """

    pivots: np.ndarray
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray
    near: np.ndarray


# --- vectors in Arrow batches -----------------------------------------------------------------
def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _norms(e: np.ndarray) -> np.ndarray:
    return np.sqrt((e * e).sum(1))


def _unit(e: np.ndarray) -> np.ndarray:
    return e / (_norms(e)[:, None] + 1e-10)


def _angles(e: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of rows to pivots; those of short rows mean nothing."""
    n = np.maximum(_norms(e), SHORT)
    return np.arccos(np.clip((e / n[:, None]) @ pivots.T, -1, 1))


def _cell_of(e: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and angle of each row; short rows lie in the last cell."""
    a = _angles(e, pivots)
    cell = a.argmin(1) if len(e) else np.zeros(0, np.int64)
    angle = a[np.arange(len(e)), cell]
    short = _norms(e) < SHORT
    return np.where(short, len(pivots), cell), np.where(short, 0.0, angle)


def _spread(rep: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A block below n for each row, by a hash of its id."""
    h = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# --- folding, cells, visits -------------------------------------------------------------------
def folded(vectors: DataFrame, k: int) -> DataFrame:
    """rep, embedding, ids, n: each different vector with its least id, its k least ids in order and its number of rows."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("id").isNotNull() & fine)
    n = v.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("embedding").orderBy("id")
    first = v.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return first.join(n, "embedding").select(F.col("ids")[0].alias("rep"), "embedding", "ids", "n")


def choose_pivots(members: DataFrame, n: int, per_cell: int, most: int, seen: int = 16) -> np.ndarray:
    """At most ``most`` unit vectors: means of a sample of ``seen`` vectors for each cell of about per_cell members."""
    p = int(np.clip(n // per_cell, 1, most))
    rows = members.select("embedding", F.xxhash64("rep").alias("_h")).orderBy("_h").limit(p * seen).collect()
    e = np.array([r.embedding for r in rows], np.float64)
    if not len(e):
        return np.ones((1, 1))
    e = e[_norms(e) >= SHORT]
    if not len(e):
        return np.eye(1, len(rows[0].embedding))
    e = _unit(e)
    pivots = e[:p].copy()
    for _ in range(3):
        home = (e @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, e)
        norm = _norms(sums)
        pivots[norm > 1e-6] = sums[norm > 1e-6] / norm[norm > 1e-6][:, None]
    return pivots


def measured(members: DataFrame, pivots: np.ndarray, k1: int) -> Cells:
    """Sizes and bounds of the cells; a task sends one row for each of its cells."""
    schema = pa.schema([("cell", pa.int32()), ("size", pa.int64()), ("least", pa.float64()), ("most", pa.float64()), ("near", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, near, most = {}, {}, {}
        for b in _parts(batches):
            cell, angle = _cell_of(_matrix(b.column(0)), pivots)
            for c in np.unique(cell).tolist():
                own = angle[cell == c]
                size[c] = size.get(c, 0) + len(own)
                most[c] = max(most.get(c, 0.0), float(own.max()))
                near[c] = np.sort(np.concatenate([near.get(c, own[:0]), own]))[:k1]
        if size:
            rows = [{"cell": c, "size": size[c], "least": float(near[c][0]), "most": most[c], "near": near[c].tolist()} for c in size]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    got = members.select("embedding").mapInArrow(run, "cell int, size long, least double, most double, near array<double>")
    each = got.groupBy("cell").agg(F.sum("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k1).alias("near"))
    p = len(pivots) + 1
    size, least, most, near = np.zeros(p, np.int64), np.zeros(p), np.zeros(p), np.full((p, k1), np.inf)
    for r in each.collect():  # a row for each pivot
        size[r.cell], least[r.cell], most[r.cell], near[r.cell, : len(r.near)] = r.size, r.least, r.most, r.near
    return Cells(pivots, size, least, most, near)


def visited(e: np.ndarray, cells: Cells, least: float, wider: bool = False) -> np.ndarray:
    """Whether each row may find a member of each cell within its reach.

    The reach is the angle of the similarity ``least`` or the angle that holds the k1 best members,
    whichever is smaller (wider: larger). It is taken a little wider than that, as similarities are
    rounded to nine digits and a small angle is less exact than its cosine.
    """
    if not cells.size.any():
        return np.zeros((len(e), len(cells.size)), bool)
    a = _angles(e, cells.pivots)
    bound = (a[:, :, None] + cells.near[None, :-1]).reshape(len(e), -1)
    k1 = cells.near.shape[1]
    best = np.partition(bound, k1 - 1, axis=1)[:, k1 - 1] if bound.shape[1] >= k1 else np.full(len(e), np.inf)
    tau = np.full(len(e), np.arccos(np.clip(least, -1, 1)))
    reach = np.minimum(np.maximum(tau, best) if wider else np.minimum(tau, best), np.pi)
    reach = np.arccos(np.clip(np.cos(reach) - 1e-7, -1, 1)) + 1e-6
    near = (a - cells.most[None, :-1] <= reach[:, None]) & (cells.least[None, :-1] - a <= reach[:, None])
    near[_norms(e) < SHORT] = True
    return np.concatenate([near, np.ones((len(e), 1), bool)], 1) & (cells.size > 0)[None]


def _visited(e: np.ndarray, cells: Cells, least: float, wider: bool) -> np.ndarray:
    return np.concatenate([visited(e[i : i + 250], cells, least, wider) for i in range(0, len(e), 250)])


def bundled(cells: Cells, block: int) -> np.ndarray:
    """The bundle of each cell: neighbours in order that hold about ``block`` members together."""
    before = np.cumsum(cells.size) - cells.size
    return np.unique(before // block, return_inverse=True)[1]


def _by_bundle(seen: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.logical_or.reduceat(seen, starts, axis=1)


def visit_counts(visitors: DataFrame, cells: Cells, least: float, wider: bool = False, starts: np.ndarray | None = None) -> np.ndarray:
    """Number of visitors of each cell, or of each bundle, of which starts holds the first cells."""
    starts = np.arange(len(cells.size)) if starts is None else starts
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(starts), np.int64)
        for b in _parts(batches):
            n += _by_bundle(visited(_matrix(b.column(0)), cells, least, wider), starts).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], schema=schema)

    out = np.zeros(len(starts), np.int64)
    for r in visitors.select("embedding").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


_PACKED = "reps binary, vectors binary, sizes binary, ids binary, ns binary, cell int, mb int, vb int"
_PACKED_ARROW = pa.schema([*((c, pa.binary()) for c in ("reps", "vectors", "sizes", "ids", "ns")), *((c, pa.int32()) for c in ("cell", "mb", "vb"))])


@dataclass(frozen=True)
class Block:
    """Vectors of one block: least ids, rows as they are and as units, the ids of each (ids[starts[i] : starts[i + 1]]) and numbers of rows."""

    reps: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    ns: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Block:
        """From packed rows."""
        held = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
        reps = held("reps", np.int64)
        e = held("vectors", np.float32).reshape(len(reps), -1)
        starts = np.concatenate([[0], np.cumsum(held("sizes", np.int32))])
        return Block(reps, e, starts, held("ids", np.int64), held("ns", np.int64))

    def some(self, rows: np.ndarray) -> Block:
        size = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(size)])
        own = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], size)
        return Block(self.reps[rows], self.vectors[rows], starts, self.ids[own], self.ns[rows])

    @cached_property
    def units(self) -> np.ndarray:
        return _unit(self.vectors.astype(np.float64))


def _grid(visitors: DataFrame, members: DataFrame, cells: Cells, least: float, block: int, wider: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides by block of the grid (bundle as cell, mb, vb); what a batch sends to a block is one packed row."""
    bundle = bundled(cells, block)
    starts = np.flatnonzero(np.r_[True, bundle[1:] != bundle[:-1]])
    n_visits = visit_counts(visitors, cells, least, wider, starts)
    n_mb, n_vb = np.maximum(1, (np.add.reduceat(cells.size, starts) + block // 2) // block), -(-n_visits // (2 * block))

    def steps(n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def packed(batches: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
        """places(reps, vectors) gives row, cell, mb, vb of every place that a row of the batch goes to."""
        for b in _parts(batches, 2000):
            if not b.num_rows:
                continue
            reps, vectors, ns = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(3).to_numpy()
            sizes = pc.list_value_length(b.column(2)).to_numpy().astype(np.int32)
            ids, ends = b.column(2).flatten().to_numpy(), np.cumsum(sizes)
            small = vectors.astype(np.float32)
            row, cell, mb, vb = places(reps, vectors)
            order = np.lexsort((row, vb, mb, cell))
            row, keys = row[order], np.stack([cell[order], mb[order], vb[order]])
            edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True]) if len(row) else []
            for i, j in itertools.pairwise(edges):
                r = row[i:j]
                own = np.repeat(ends[r] - sizes[r], sizes[r]) + steps(sizes[r])
                out = [x.tobytes() for x in (reps[r], small[r], sizes[r], ids[own], ns[r])]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in out), *(pa.array([int(x)], pa.int32()) for x in keys[:, i])], schema=_PACKED_ARROW)

    def of_member(reps: np.ndarray, vectors: np.ndarray) -> tuple:
        cell = bundle[_cell_of(vectors, cells.pivots)[0]]
        row = np.repeat(np.arange(len(cell)), n_vb[cell])
        return row, cell[row], _spread(reps, n_mb[cell])[row], steps(n_vb[cell])

    def of_visitor(reps: np.ndarray, vectors: np.ndarray) -> tuple:
        seen = _visited(vectors, cells, least, wider)
        at, cell = np.nonzero(_by_bundle(seen, starts))
        row = np.repeat(np.arange(len(at)), n_mb[cell])
        return at[row], cell[row], steps(n_mb[cell]), _spread(reps[at], n_vb[cell])[row]

    columns = ("rep", "embedding", "ids", "n")
    return visitors.select(*columns).mapInArrow(lambda x: packed(x, of_visitor), _PACKED), members.select(*columns).mapInArrow(lambda x: packed(x, of_member), _PACKED)


def _met(visitors: DataFrame, members: DataFrame, cells: Cells, least: float, block: int, wider: bool, meet, schema: str, empty: pa.Schema, cut=None) -> DataFrame:
    """meet(visitors, members) for each block of the grid, a tile of visitors and a cell of members at a time; cut(table) shortens what a tile has met."""
    keys = ("cell", "mb", "vb")

    def run(v: pa.Table, m: pa.Table) -> pa.Table:
        if not v.num_rows or not m.num_rows:
            return empty.empty_table()
        v, m, out = Block.of(v), Block.of(m), []
        home = np.concatenate([_cell_of(m.vectors[i : i + _TILE].astype(np.float64), cells.pivots)[0] for i in range(0, len(m.reps), _TILE)])
        own = [(c, m.some(r[i : i + _TILE])) for c in np.unique(home).tolist() for r in [np.flatnonzero(home == c)] for i in range(0, len(r), _TILE)]
        for i in range(0, len(v.reps), _TILE):
            tile, found = v.some(np.arange(i, min(i + _TILE, len(v.reps)))), []
            seen = _visited(tile.vectors.astype(np.float64), cells, least, wider)
            for c, part in own:
                at = np.flatnonzero(seen[:, c])
                if len(at):
                    found.append(meet(tile if len(at) == len(seen) else tile.some(at), part))
            if found:
                found = pa.concat_tables(found)
                out.append(cut(found) if cut else found)
        return pa.concat_tables(out) if out else empty.empty_table()

    v, m = _grid(visitors, members, cells, least, block, wider)
    return v.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(run, schema)


def _size_of_blocks(n: int) -> int:
    return int(np.clip(n // 16, 2000, 65_536))


def _k_best(found: pa.Table, k: int) -> pa.Table:
    """The k best candidates of each rep."""
    rep, ids, s = (found[c].to_numpy() for c in ("rep", "id", "score"))
    order = np.lexsort((ids, -np.round(s, 9), rep))
    rep = rep[order]
    return found.take(order[np.arange(len(rep)) - np.searchsorted(rep, rep) < k])


def _best(s: np.ndarray, first: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best entries of each row from least on, by value rounded to nine digits, then first."""
    bar = np.full(len(s), least - 1e-9)
    if s.shape[1] > k and np.count_nonzero(s >= least - 1e-9) > 8 * k * len(s):
        bar = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2e-9)
    row, col = np.nonzero(s >= bar[:, None])
    near = np.round(s[row, col], 9)
    row, col, near = row[near >= least], col[near >= least], near[near >= least]
    order = np.lexsort((first[col], -near, row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


# --- joins ------------------------------------------------------------------------------------
def best_pairs(left: DataFrame, right: DataFrame, least: float = 0.5, k: int = 8, block: int | None = None, per_cell: int = 2000, most_cells: int = 1024) -> DataFrame:
    """source_id, target_id, similarity, rank0: for each id of left (id, embedding) the k most similar other ids of right, from least on."""
    same = left is right
    members = stored(folded(right, k + 1))
    visitors = members if same else stored(folded(left, k + 1))
    n = members.count()
    cells = measured(members, choose_pivots(members, n, per_cell, most_cells), k + 1)

    def meet(v: Block, m: Block) -> pa.Table:
        s = v.units @ m.units.T
        row, col = _best(s, m.reps, k + 1, least)
        size = np.diff(m.starts)[col]
        of = np.repeat(np.arange(len(col)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + m.starts[col][of]
        return pa.table([v.reps[row][of], m.ids[place], s[row, col][of]], schema=_CANDIDATE_ARROW)

    found = _met(visitors, members, cells, least, block or _size_of_blocks(n), False, meet, _CANDIDATE, _CANDIDATE_ARROW, lambda x: _k_best(x, k + 1))
    near = F.round("score", 9).desc()
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(near, "id"))).where(F.col("_r") <= k + 1)
    lone = visitors.where("n = 1").select(F.col("rep").alias("source_id"), "rep")
    copies = left.select(F.col("id").cast("long").alias("source_id"), F.col("embedding").cast("array<float>").alias("embedding")).join(visitors.where("n > 1").select("embedding", "rep"), "embedding").select("source_id", "rep")
    each = lone.unionByName(copies).join(top, "rep").where("source_id <> id")
    w = Window.partitionBy("source_id").orderBy(near, "id")
    return each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("source_id", F.col("id").alias("target_id"), F.col("score").alias("similarity"), (F.col("_r") - 1).alias("rank0"))


def pair_parts(vectors: DataFrame, least: float, k: int = 10, block: int | None = None, per_cell: int = 2000, most_cells: int = 1024) -> DataFrame:
    """Parts of the distribution over all pairs a < b: number and sum of all, the largest similarity, n_above (from least on), and the k best pairs from least on.

    The sum needs no pair: it is half of the squared length of the sum of unit vectors less their
    own squares. The other figures come from the pairs within reach of least or of a vector's best.
    """
    members = stored(folded(vectors, k + 1))
    n_members = members.count()
    cells = measured(members, choose_pivots(members, n_members, per_cell, most_cells), 2)

    def part(n=None, total=None, s=None, weight=None, pairs=()) -> dict:
        """s: similarities; weight: number of pairs of ids of each."""
        some = s is not None and len(s)
        return {"n": n, "total": total, "top": float(s.max()) if some else None, "n_above": int(weight[s >= least].sum()) if some else 0, "best": [{"a": a, "b": b, "similarity": -x} for x, a, b in sorted(pairs)[:k]]}

    def crossing(ids_a: list, ids_b: list, s: float) -> list:
        return sorted((-s, min(a, b), max(a, b)) for a in ids_a for b in ids_b)[:k]

    def meet(v: Block, m: Block) -> pa.Table:
        upper = v.reps[:, None] < m.reps[None]
        s = np.round(v.units @ m.units.T, 9)[upper]
        if not len(s):
            return _PART_ARROW.empty_table()
        i, j = np.nonzero(upper)
        bar = max(least, float(np.partition(s, -k)[-k]) if len(s) > k else least)
        at = np.flatnonzero(s >= bar)
        pairs: list = []
        for x in at[np.lexsort((m.reps[j[at]], v.reps[i[at]], -s[at]))]:  # until k pairs of ids with a larger one are held
            if len(pairs) >= k and -pairs[k - 1][0] > s[x]:
                break
            own = (b.ids[b.starts[y] : b.starts[y + 1]].tolist() for b, y in ((v, i[x]), (m, j[x])))
            pairs = sorted(pairs + crossing(*own, float(s[x])))[:k]
        return pa.Table.from_pylist([part(s=s, weight=v.ns[i] * m.ns[j], pairs=pairs)], schema=_PART_ARROW)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of equal vectors."""
        for b in batches:
            n = b.column(3).to_numpy()
            some = np.flatnonzero(n > 1)
            if len(some):
                u = _unit(_matrix(b.column(1)))[some]
                s, n = np.round((u * u).sum(1), 9), n[some]
                pairs = [(-x, a, c) for x, at in zip(s.tolist(), some.tolist(), strict=True) if x >= least for a, c in itertools.combinations(b.column(2)[at].as_py(), 2)]
                yield pa.RecordBatch.from_pylist([part(s=s, weight=n * (n - 1) // 2, pairs=pairs)], schema=_PART_ARROW)

    sums = pa.schema([("rows", pa.int64()), ("own", pa.float64()), ("at", pa.int32()), ("x", pa.float64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, total = 0, 0.0, None
        for b in batches:
            u, n = _unit(_matrix(b.column(0))), b.column(1).to_numpy()
            if len(n):
                rows, own = rows + int(n.sum()), own + float(n @ (u * u).sum(1))
                total = n @ u if total is None else total + n @ u
        if rows:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([rows] + [0] * (d - 1)), pa.array([own] + [0.0] * (d - 1)), pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], schema=sums)

    at = members.select("embedding", "n").mapInArrow(summed, "rows long, own double, at int, x double").groupBy("at").agg(F.sum("rows").alias("rows"), F.sum("own").alias("own"), F.sum("x").alias("x"))
    one = at.agg(F.sum("rows").alias("rows"), ((F.sum(F.col("x") * F.col("x")) - F.sum("own")) / 2).alias("total")).where("rows > 1")
    whole = one.select((F.col("rows") * (F.col("rows") - 1) / 2).cast("long").alias("n"), "total", F.lit(None).cast("double").alias("top"), F.lit(0).cast("long").alias("n_above"), F.array().cast(_BEST).alias("best"))
    met = _met(members, members, cells, least, block or _size_of_blocks(n_members), True, meet, _PART, _PART_ARROW)
    copies = members.select("rep", "embedding", "ids", "n").mapInArrow(alone, _PART)
    return whole.unionByName(met).unionByName(copies)


def _nearest(v: Block, m: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows of v, rows of m, similarity in billionths: the k best others of m (by rep) for each vector of v, ties to the smaller id.

    Single precision finds what may be among them, and that is computed again in double.
    """
    small_v, small_m = v.units.astype(np.float32), m.units.astype(np.float32)
    slack, out = 2.5e-7 * max(small_m.shape[1], 16), []

    def exact(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        other = v.reps[row] != m.reps[col]
        row, col = row[other], col[other]
        parts = [np.einsum("ij,ij->i", v.units[row[i : i + 50_000]], m.units[col[i : i + 50_000]]) for i in range(0, len(row), 50_000)]
        s = np.rint(np.concatenate(parts or [np.zeros(0)]) * 1e9).astype(np.int64)
        order = np.argsort((row << 32) - s, kind="stable")  # what is equal stays by place, which is by id
        row, col, s = row[order], col[order], s[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], col[kept], s[kept].astype(np.int32)

    for i in range(0, len(v.reps), 1000):
        tile = small_v[i : i + 1000]
        bar, held, size = np.full(len(tile), -np.inf, np.float32), [], 0
        for j in range(0, len(m.reps), 4096):
            s = tile @ small_m[j : j + 4096].T
            if not j and s.shape[1] > k + 1:
                bar = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - np.float32(slack)
            row, col = np.divmod(np.flatnonzero(s >= bar[:, None]), s.shape[1])
            held.append((row + i, col + j))
            size += len(row)
            if size > 3 * k * len(tile) or j + 4096 >= len(m.reps):
                row, col, s = exact(*(np.concatenate(x) for x in zip(*held, strict=True)))
                full = np.flatnonzero(np.bincount(row - i, minlength=len(tile)) == k)
                bar[full] = s[np.searchsorted(row, full + i, "right") - 1] / 1e9 - slack
                held, size = [(row, col)], len(row)
        out.append((row, col, s))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_lists(members: DataFrame, k: int, most_visitors: int = 65_536, most_members: int = 262_144) -> DataFrame:
    """rep, near, billionths: for each row of members (rep, embedding; all different) the reps of the k most similar others
    and the similarities in billionths, packed, by falling similarity and then by rep.

    No similarity is asked for, so nothing can be skipped: all pairs are computed, in a grid of at most 16 blocks of
    visitors by 4 of members up to a million vectors, and of blocks of bounded size beyond.
    """
    n = members.count()
    n_vb = max(int(np.clip(n // 1000, 1, 16)), -(-n // most_visitors))
    n_mb = max(int(np.clip(n // 4000, 1, 4)), -(-n // most_members))
    schema = pa.schema([("vb", pa.int32()), ("mb", pa.int32()), ("reps", pa.binary()), ("vectors", pa.binary())])

    def packed(own: int, others: int, visits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _parts(batches, 2000):
                reps, vectors = b.column(0).to_numpy(), _matrix(b.column(1)).astype(np.float32)
                block = _spread(reps, np.full(len(reps), own))
                for x in np.unique(block).tolist():
                    held = [a[block == x].tobytes() for a in (reps, vectors)]
                    here, there = pa.array([x] * others, pa.int32()), pa.array(range(others), pa.int32())
                    yield pa.RecordBatch.from_arrays([*((here, there) if visits else (there, here)), *(pa.array([h] * others, pa.binary()) for h in held)], schema=schema)

        return members.select("rep", "embedding").mapInArrow(run, "vb int, mb int, reps binary, vectors binary")

    def of(rows: pa.Table) -> Block:
        reps, vectors = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("reps", np.int64), ("vectors", np.float32)))
        none, order = np.zeros(0, np.int64), np.argsort(reps, kind="stable")
        return Block(reps[order], vectors.reshape(len(reps), -1)[order], none, none, none)

    lists = pa.schema([("vb", pa.int32()), ("rep", pa.int64()), ("near", pa.binary()), ("billionths", pa.binary())])

    def listed(vb: int, rep: np.ndarray, near: np.ndarray, s: np.ndarray) -> pa.Table:
        edges = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1], True]) if len(rep) else np.zeros(1, np.int64)
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in itertools.pairwise(edges.tolist())], pa.binary())
        return pa.table([pa.array([vb] * (len(edges) - 1), pa.int32()), rep[edges[:-1]], cut(near), cut(s)], schema=lists)

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return lists.empty_table()
        v, m = of(x), of(y)
        row, col, s = _nearest(v, m, k)
        return listed(x["vb"][0].as_py(), v.reps[row], m.reps[col], s)

    def merged(x: pa.Table) -> pa.Table:
        near, s = (np.frombuffer(b"".join(x[c].to_pylist()), t) for c, t in (("near", np.int64), ("billionths", np.int32)))
        rep = np.repeat(x["rep"].to_numpy(), pc.binary_length(x["near"]).to_numpy() // 8)
        order = np.lexsort((near, -s, rep))
        rep = rep[order]
        order = order[np.arange(len(rep)) - np.searchsorted(rep, rep) < k]
        return listed(x["vb"][0].as_py(), *(np.repeat(x["rep"].to_numpy(), pc.binary_length(x["near"]).to_numpy() // 8)[order], near[order], s[order]))

    visitors, met = packed(n_vb, n_mb, True), packed(n_mb, n_vb, False)
    types = "vb int, rep long, near binary, billionths binary"
    # as many partitions as blocks, so that several rarely share one
    dealt = [d.repartition(n_vb * n_mb, "vb", "mb").groupBy("vb", "mb") for d in (visitors, met)]
    found = dealt[0].cogroup(dealt[1]).applyInArrow(meet, types)
    return found.groupBy("vb").applyInArrow(merged, types).select("rep", "near", "billionths")


def best_in_groups(left: DataFrame, right: DataFrame, key: str, keep: list[str], named: str = "id", block: int = 32_768) -> DataFrame:
    """keep, s, id (as named): the best row of right (key, id, embedding) with its key, for each row of left (key, keep, embedding).

    s is the cosine rounded to nine digits, null without vectors; ties go to the smaller id. Rows of a
    key are dealt to blocks of both sides, so a key of any size is many tasks, and each block gives one
    row for a row of left: the caller takes the best of them.
    """
    left = left.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *keep, F.col("embedding").cast("array<float>").alias("embedding"))
    right = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("id").cast("long").alias("_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    counted = lambda d, n: d.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    sizes = counted(left, "_nl").join(counted(right, "_nr"), "_key")
    own = lambda n, ids: F.pmod(F.xxhash64(*ids), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, "_key").select("_key", own("_nl", [*keep, "embedding"]).alias("_i"), each("_nr").alias("_j"), *keep, "embedding")
    b = right.join(sizes, "_key").select("_key", each("_nl").alias("_i"), own("_nr", ["_id", "embedding"]).alias("_j"), "_id", "embedding")
    types = dict(left.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "s double", f"`{named}` long"])

    def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(t["embedding"]), 0), False).to_numpy())
        return some, _unit(_matrix(t["embedding"].combine_chunks().take(pa.array(some)))) if len(some) else np.zeros((0, 0))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("_id")
        (at, u), (of, v) = vectors(x), vectors(y)
        s, ids = np.full(x.num_rows, np.nan), np.zeros(x.num_rows, np.int64)
        none = np.ones(x.num_rows, bool)
        if len(at) and len(of):
            known = y["_id"].to_numpy()[of]
            for i in range(0, len(at), 250):
                near = np.round(u[i : i + 250] @ v.T, 9)
                best = near.argmax(1)
                r = at[i : i + 250]
                s[r], ids[r], none[r] = near[np.arange(len(r)), best], known[best], False
        return pa.table([*(x[c] for c in keep), pa.array(s, mask=none), pa.array(ids, mask=none)], names=[*keep, "s", named])

    return a.groupBy("_key", "_i", "_j").cogroup(b.groupBy("_key", "_i", "_j")).applyInArrow(lambda x, y: run(x, y) if x.num_rows and y.num_rows else run(x.slice(0, 0), y.slice(0, 0)), schema)
