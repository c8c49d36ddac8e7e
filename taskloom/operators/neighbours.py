"""Exact nearest-neighbour joins between two tables of vectors.

The join never pairs rows in the JVM. Items are packed into blocks of similar vectors
(``blocks``). Queries are dealt to tasks by their own block; a task holds its queries and
reads every block that may hold something near enough to any of them, one matrix product a cell:

* ``top_k``: a task keeps the best ``k`` items of each of its queries, ranked again at the end;
* ``linked_components``: a task joins its rows over what it reads and emits one edge for each item
  and each of its rows, which keeps the connectivity without listing pairs.

So an item is copied to the tasks at most, whose number does not grow with the rows until their queries fill
``TASK_BYTES``, and what a task emits is independent of the number of blocks.
Bounds are exact. With a threshold they follow from it; without one a query looks into its own
block first, and the k-th score there is the bound for the others. Where queries and items are the same
rows, a pair of blocks is compared once for both directions. Queries of a crowded block are spread over many tasks.
Of several items with the same vector only the first ``k`` by key can be among a top k.
"""

from __future__ import annotations

import itertools
import logging
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.operators import blocks as B
from taskloom.session import stored

CELL_ROWS = 2048
#: Vectors of queries that one task holds, and items that it reads, at most.
TASK_BYTES = 1 << 25
TASK_ITEM_BYTES = 1 << 28
#: Copies of vectors that a dealing task holds at once.
_COPIED_BYTES = 1 << 22
_HASH = "pmod(xxhash64(id), 2147483648L)"
SCORE_DIGITS = 12
_NO_LIMIT = -2.0
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Match:
    """A per-pair condition: the query's list is empty or holds the item's value.

    ``query_list`` is an array column of the queries, ``item_value`` a string or array
    column of the items; an array matches when any of its elements is in the list.
    """

    query_list: str
    item_value: str


@dataclass(frozen=True)
class Between:
    """A per-pair condition: the item's number lies in the query's ``[low, high]``; null bounds are open."""

    query_low: str
    query_high: str
    item_value: str


# ---------------------------------------------------------------- cell kernels


def _allowed(left: pa.Table, right: pa.Table, n_conditions: int) -> np.ndarray | None:
    """Boolean matrix of the pairs that satisfy every condition, None if all do."""
    if n_conditions == 0:
        return None
    mask = np.ones((left.num_rows, right.num_rows), dtype=bool)
    for c in range(n_conditions):
        wanted, have = (t.column(f"m{c}").combine_chunks() for t in (left, right))
        mask &= _inside(wanted, have) if pa.types.is_struct(wanted.type) else _listed(wanted, have)
    return mask


def _elements(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, element) of the lists of an array, or of the values themselves."""
    if pa.types.is_list(values.type):
        return pc.list_parent_indices(values).to_numpy(zero_copy_only=False), values.flatten().cast(pa.string())
    return np.arange(len(values)), values.cast(pa.string())


def _listed(wanted: pa.Array, have: pa.Array) -> np.ndarray:
    """Whether a list is empty or shares a value with an item, over the codes of the listed values."""
    free = pc.fill_null(pc.equal(pc.list_value_length(wanted), 0), True).to_numpy(zero_copy_only=False)
    (row, value), (item, own) = _elements(wanted), _elements(have)
    known = pc.unique(value.drop_null())
    codes = [pc.fill_null(pc.index_in(x, value_set=known), -1).to_numpy(zero_copy_only=False) for x in (value, own)]
    # a null in a list matches nothing
    mask = np.repeat(free[:, None], len(have), axis=1)
    for start in range(0, len(known), 512):
        sides = []
        for rows, code, count in ((row, codes[0], len(wanted)), (item, codes[1], len(have))):
            side = np.zeros((count, 512), dtype=np.float32)
            here = (code >= start) & (code < start + 512)
            side[rows[here], code[here] - start] = 1
            sides.append(side)
        mask |= sides[0] @ sides[1].T > 0
    return mask


def _inside(bounds: pa.Array, values: pa.Array) -> np.ndarray:
    def numbers(x: pa.Array, missing: float) -> np.ndarray:
        return pc.fill_null(x, missing).to_numpy(zero_copy_only=False)

    low, high = numbers(pc.struct_field(bounds, "low"), -np.inf), numbers(pc.struct_field(bounds, "high"), np.inf)
    v = numbers(values, np.nan)
    inside = (v[None, :] >= low[:, None]) & (v[None, :] <= high[:, None])
    unbounded = np.isinf(low) & np.isinf(high)
    return inside | unbounded[:, None]


def _best(scores: np.ndarray, limit: float | np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of each row's k best scores >= limit, ties by column."""
    keep = scores >= limit
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep &= scores >= kth[:, None]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, rows, side="left")
    within = np.arange(len(rows)) - start < k
    return rows[within], cols[within]


def _width(t: pa.Table) -> int:
    return pc.list_value_length(t.column("v").slice(0, 1))[0].as_py()


def _cosines(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Scores of a cell, whose sides have one width each; those of different widths are 0."""
    if _width(left) != _width(right):
        return np.zeros((left.num_rows, right.num_rows))
    a, b = (B.matrix(t.column("v"), t.num_rows) for t in (left, right))
    return np.round(a @ b.T, SCORE_DIGITS)


_HIT_SCHEMA = "q string, i string, score double"
_HITS = pa.schema([("q", pa.string()), ("i", pa.string()), ("score", pa.float64())])


def _hit_table(left: pa.Table, right: pa.Table, scores: np.ndarray, limit: float, k: int) -> pa.Table:
    rows, cols = _best(scores, limit, k)
    ids = [t.column("id").combine_chunks().take(pa.array(x)).cast(pa.string()) for t, x in ((left, rows), (right, cols))]
    return pa.table([*ids, pa.array(scores[rows, cols])], schema=_HITS)


def _top_k_kernel(k: int, limit: float, n_conditions: int):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _HITS.empty_table()
        right = right.sort_by("id")
        s = _cosines(left, right)
        mask = _allowed(left, right, n_conditions)
        if mask is not None:
            s[~mask] = -np.inf
        return _hit_table(left, right, s, limit, k)

    return kernel


class _Hits:
    """The best ``k`` finds of each of ``rows`` rows so far; ``kth`` is what a further one has to reach."""

    def __init__(self, rows: int, k: int, limit: float):
        self.k, self.kth, self.held = k, np.full(rows, limit), []
        self.pending, self.room = 0, max(1 << 18, 2 * rows * k)

    def add(self, row: np.ndarray, score: np.ndarray, found: pa.Array) -> None:
        self.held.append(pa.table([pa.array(row, pa.int64()), pa.array(score, pa.float64()), found], names=["row", "score", "i"]))
        self.pending += len(row)
        if self.pending > self.room:
            self.best()

    def best(self) -> pa.Table:
        if not self.held:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.string())], names=["row", "score", "i"])
        t = pa.concat_tables(self.held).sort_by([("row", "ascending"), ("score", "descending"), ("i", "ascending")])
        row = t.column("row").to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        last = place == self.k - 1
        self.kth[row[last]] = np.maximum(self.kth[row[last]], t.column("score").to_numpy()[last])
        kept = t.filter(pa.array(place < self.k)).combine_chunks()
        self.held, self.pending = [kept], 0
        return kept


class _Asked:
    """The queries of a task, by id, with their vectors by width."""

    def __init__(self, rows: pa.Table, blocks: B.Blocks, n_conditions: int = 0):
        self.rows = rows.sort_by("id").combine_chunks()
        self.blocks = blocks
        self.id = self.rows.column("id").combine_chunks()
        self.home, self.bound, self.item = (self.rows.column(c).to_numpy() for c in ("block", "bound", "item"))
        self.wanted = self.rows.select([f"qm{c}" for c in range(n_conditions)]).rename_columns([f"m{c}" for c in range(n_conditions)])
        self.widths = {}
        width = self.rows.column("w").to_numpy()
        for w in np.unique(width):
            row = np.flatnonzero(width == w)
            m = _unpacked(self.rows.column("x").take(pa.array(row)), int(w))
            m = B.unit_rows(m) if blocks.metric == "cosine" else m
            frame = blocks.frames.get(int(w))
            self.widths[int(w)] = row, m, frame.coordinates(m) if frame else np.zeros((len(row), 1))

    def near(self, block: int, which: str, bound: np.ndarray, cell_rows: int):
        """(width, rows, vectors) of the queries that may find something in a block, a cell at a time."""
        for w, (row, m, at) in self.widths.items():
            can = np.flatnonzero(self.blocks.holds(at, w, bound[row], block) & B.may_visit(self.home[row], block, which))
            for k in range(0, len(can), cell_rows):
                part = can[k : k + cell_rows]
                yield w, row[part], m[part]


def _packed(column: pa.Array, rows: int, width: int) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing."""
    m = B.matrix(column, rows, unit=False)
    with np.errstate(over="ignore"):
        short = m.astype(np.float32)
    exact = (short == m).all(axis=1)
    return [a.tobytes() if e else d.tobytes() for e, a, d in zip(exact, short, m)]


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.empty((len(column), width))
    for i, x in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(x, dtype=np.float32 if len(x) == 4 * width else np.float64)
    return out


def _top_k_sweep(k: int, limit: float, n_conditions: int, which: str, cell_rows: int, blocks: B.Blocks):
    """Best ``k`` of each query; with ``once`` also the best ``k`` queries of each item that others visit."""

    def sweep(asked: pa.Table, cells):
        own = _Asked(asked, blocks, n_conditions)
        hits = _Hits(len(own.id), k, limit)
        for block, items in cells:
            items = items.sort_by("id").combine_chunks()
            ids, w = items.column("id").combine_chunks(), blocks.width_of(block)
            b = B.unit_rows(_unpacked(items.column("x"), w))
            flag = items.column("item").to_numpy()
            have = items.select([f"im{c}" for c in range(n_conditions)]).rename_columns([f"m{c}" for c in range(n_conditions)])
            back = _Hits(len(ids), k, limit)
            for wq, row, a in own.near(block, which, own.bound if which == "once" else np.maximum(own.bound, hits.kth), cell_rows):
                s = a @ b.T if wq == w else np.zeros((len(row), len(ids)))
                if n_conditions:
                    s[~_allowed(own.wanted.take(pa.array(row)), have, n_conditions)] = -np.inf
                r, c, score = _finds(s if flag.all() else np.where(flag[None, :], s, -np.inf), hits.kth[row], k)
                hits.add(row[r], score, ids.take(pa.array(c)))
                if which == "once":
                    guest = own.item[row] & (own.home[row] != block)
                    r, c, score = _finds(s[guest].T, back.kth, k)
                    back.add(r, score, own.id.take(pa.array(row[guest][c])))
            if which == "once":
                yield _named(back.best(), ids)
        yield _named(hits.best(), own.id)

    return sweep


def _finds(s: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of scores that reach the least one of their row, not many more than k of a row."""
    near = s >= least[:, None] - 1e-11
    if np.count_nonzero(near) > 2 * k * len(s):
        s = np.round(s, SCORE_DIGITS)
        r, c = _best(s, np.maximum(least, _NO_LIMIT)[:, None], k)
        return r, c, s[r, c]
    r, c = np.nonzero(near)
    score = np.round(s[r, c], SCORE_DIGITS)
    keep = (score >= least[r]) & (score > -np.inf)
    return r[keep], c[keep], score[keep]


def _named(best: pa.Table, ids: pa.Array) -> pa.Table:
    return pa.table([ids.take(best.column("row").combine_chunks()), best.column("i"), best.column("score")], schema=_HITS)


def _joined(label: np.ndarray, row: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
    """Labels of rows, each the least row of its set, after the rows with an entry in the same column are joined."""
    while True:
        least = np.full(columns, len(label))
        np.minimum.at(least, column, label[row])
        to = np.arange(len(label))
        np.minimum.at(to, label[row], least[column])
        while (to[to] != to).any():
            to = to[to]
        if (to[label] == label).all():
            return label
        label = to[label]


def _component_sweep(eps: float, cell_rows: int, blocks: B.Blocks):
    """One edge for each item near to a row of the task, and one for each row joined with another over items."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    cosine = blocks.metric == "cosine"

    def close(a: np.ndarray, b: np.ndarray, same_width: bool) -> tuple[np.ndarray, np.ndarray]:
        if not same_width:
            return np.nonzero(np.full((len(a), len(b)), cosine and 1.0 <= eps))
        s = a @ b.T
        if not cosine:
            s = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * s
        r, c = np.nonzero(s >= 1.0 - eps - 1e-9 if cosine else s <= (eps + 1e-9) ** 2)
        distance = 1.0 - np.round(s[r, c], SCORE_DIGITS) if cosine else np.sqrt(np.maximum(s[r, c], 0.0))
        keep = np.round(distance, SCORE_DIGITS) <= eps
        return r[keep], c[keep]

    def sweep(asked: pa.Table, cells):
        own = _Asked(asked, blocks)
        names, label = np.array(own.id.to_pylist(), dtype=object), np.arange(len(own.id))
        for block, items in cells:
            w = blocks.width_of(block)
            b = _unpacked(items.column("x"), w)
            b = B.unit_rows(b) if cosine else b
            ids, first = np.array(items.column("id").to_pylist(), dtype=object), np.full(len(b), -1)
            for wq, row, a in own.near(block, "once", own.bound, cell_rows):
                r, c = close(a, b, wq == w)
                r = row[r]
                other = names[r] != ids[c]
                r, c = r[other], c[other]
                known = np.flatnonzero(first >= 0)  # what other rows of the task have joined over the same items
                label = _joined(label, np.concatenate([r, first[known]]), np.concatenate([c, known]), len(b)) if len(r) else label
                first[c] = r
            some = first >= 0
            yield pa.table([pa.array(ids[some].tolist(), pa.string()), pa.array(names[first[some]].tolist(), pa.string())], schema=schema)
        moved = label != np.arange(len(label))
        yield pa.table([pa.array(names[moved].tolist(), pa.string()), pa.array(names[label[moved]].tolist(), pa.string())], schema=schema)

    return sweep


# ------------------------------------------------------------------- routing


def _in_slice(df: DataFrame, own, other, own_name: str, other_name: str) -> DataFrame:
    """Each row in one slice of its own side, copied to every slice of the other side."""
    df = df.withColumn(own_name, F.pmod(F.xxhash64("id"), own).cast("int"))
    return df.withColumn(other_name, F.explode(F.sequence(F.lit(0), other - 1)))


def _run_cells(left: DataFrame, right: DataFrame, keys: list[str], kernel, schema: str) -> DataFrame:
    # fresh attributes, so that a table can be joined with itself
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def _tasks(queries: int, items: int, width: int, cell_rows: int, cores: int) -> tuple[int, int]:
    """Groups of queries, and slices of the items that every group reads in tasks of their own."""
    groups = max(min(cores, math.ceil(queries / cell_rows)), math.ceil(8 * width * queries / TASK_BYTES), 1)
    slices = max(min(cores, math.ceil(items / cell_rows)) // groups, math.ceil(8 * width * items / TASK_ITEM_BYTES), 1)
    return groups, slices


def _dealt(df: DataFrame, side: int, copies: int, tasks_of) -> DataFrame:
    """Each row once for every task that ``tasks_of`` its block and hash names, its vector as bytes."""
    prefix = "im" if side else "qm"
    df = df.withColumns({"side": F.lit(side), "w": F.size("v"), "h": F.expr(_HASH)})
    df = df if "bound" in df.columns else df.withColumn("bound", F.lit(0.0))
    kept = ["side", "block", "id", "w", "bound", "item", *[c for c in df.columns if re.fullmatch(r"m\d+", c)]]
    df = df.select(*kept, "h", "v")

    def run(batches):
        for batch in batches:
            for w, rows in B.by_width(batch):
                step = max(16, _COPIED_BYTES // (8 * max(w, 1) * max(copies, 1)))
                for part in (rows.slice(k, step) for k in range(0, rows.num_rows, step)):
                    block, h = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("block", "h"))
                    row, task = tasks_of(block, h)
                    vectors = pa.array(_packed(part.column(len(kept) + 1), part.num_rows, w), pa.binary())
                    columns = [part.column(i).take(pa.array(row)) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), *columns, vectors.take(pa.array(row))], names=names)

    named = [prefix + c[1:] if re.fullmatch(r"m\d+", c) else c for c in kept]
    names = ["task", *named, "x"]
    fields = ", ".join(f"`{n}` {df.schema[c].dataType.simpleString()}" for n, c in zip(named, kept))
    return df.mapInArrow(run, f"task int, {fields}, x binary")


def _streamed(sweep, cell_rows: int):
    """The sweep over the rows of each task: its queries first, then its items by block, a cell at a time."""

    def pieces(batches):
        key, held, rows = None, [], 0
        for batch in batches:
            task, side, block = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("task", "side", "block"))
            block = np.where(side == 0, 0, block)
            edge = np.flatnonzero((np.diff(task) != 0) | (np.diff(side) != 0) | (np.diff(block) != 0)) + 1
            for low, high in zip([0, *edge], [*edge, batch.num_rows]):
                while low < high:
                    here = int(task[low]), int(side[low]), int(block[low])
                    if held and (here != key or (here[1] and rows >= cell_rows)):
                        yield key, pa.Table.from_batches(held)
                        held, rows = [], 0
                    n = min(high - low, cell_rows - rows) if here[1] else high - low
                    key, rows = here, rows + n
                    held.append(batch.slice(low, n))
                    low += n
        if held:
            yield key, pa.Table.from_batches(held)

    def run(batches):
        for _, found in itertools.groupby(pieces(batches), key=lambda p: p[0][0]):
            (_, side, _), asked = next(found)
            if side == 0:
                for out in sweep(asked, ((key[2], cell) for key, cell in found)):
                    yield from out.combine_chunks().to_batches()

    return run


def _sweep(queries: DataFrame, items: DataFrame, blocks: B.Blocks, which: str, cell_rows: int, sweep, schema: str) -> DataFrame:
    """The sweep over groups of queries and the items of all blocks that any of a group may reach.

    Both sides have their ``block`` and the flag ``item``, queries the ``bound`` that a find needs.
    """
    spark = queries.sparkSession
    count = np.zeros(blocks.count + 1, dtype=np.int64)  # a block -1 first
    for r in queries.groupBy("block").agg(F.count("*").alias("n")).collect():
        count[r["block"] + 1] = r["n"]
    total, start = int(count.sum()), np.cumsum(count) - count
    if not total:
        return spark.createDataFrame([], schema)
    cores = spark.sparkContext.defaultParallelism
    groups, slices = _tasks(total, int(blocks.size.sum()), max(blocks.frames), cell_rows, cores)

    def group_of(home: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (start[home + 1] + h % np.maximum(count[home + 1], 1)) * groups // total

    def reach(batches):
        needed, compared, number = np.zeros((groups, blocks.count), dtype=bool), 0, np.arange(blocks.count)
        for batch in batches:
            for w, rows in B.by_width(batch):
                for s in B.parts(rows.num_rows, blocks.count):
                    v, bound, home, h = rows.slice(s.start, s.stop - s.start).columns
                    bound, home, h = (x.to_numpy(zero_copy_only=False) for x in (bound, home, h))
                    frame = blocks.frames.get(w)
                    at = frame.coordinates(B.matrix(v, len(h), unit=blocks.metric == "cosine")) if frame else np.zeros((len(h), 1))
                    can = blocks.reachable(at, w, bound) & B.may_visit(home[:, None], number[None, :], which)
                    compared += int((can * blocks.size).sum())
                    group = group_of(home, h)
                    for g in np.unique(group):
                        needed[g] |= can[group == g].any(axis=0)
        g, b = np.nonzero(needed)
        columns = [np.append(g, -1).astype(np.int32), np.append(b, -1).astype(np.int32), np.append(np.zeros(len(g), np.int64), compared)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "block", "n"])

    found = queries.select("v", "bound", "block", F.expr(_HASH).alias("h")).mapInArrow(reach, "g int, block int, n long")
    pairs = found.groupBy("g", "block").agg(F.sum("n").alias("n")).collect()  # groups times blocks of the model
    log.info("%d blocks, %d pairs of a visitor and an item", blocks.count, sum(r["n"] for r in pairs))
    readers = [np.array(sorted(g), dtype=np.int64) for g in _gathered(((r["block"], r["g"]) for r in pairs if r["g"] >= 0), blocks.count)]

    def to_readers(block: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(block)), [len(readers[b]) for b in block])
        group = np.concatenate([readers[b] for b in block] or [np.zeros(0, np.int64)])
        return row, group * slices + h[row] % slices

    def to_slices(block: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(block)), slices)
        return row, group_of(block, h)[row] * slices + np.tile(np.arange(slices), len(block))

    both = _dealt(queries, 0, slices, to_slices).unionByName(_dealt(items, 1, groups, to_readers), allowMissingColumns=True)
    dealt = both.repartitionById(groups * slices, "task").sortWithinPartitions("task", "side", "block")
    return dealt.mapInArrow(_streamed(sweep, cell_rows), schema)


def _gathered(pairs, size: int) -> list[list]:
    out = [[] for _ in range(size)]
    for k, v in pairs:
        out[k].append(v)
    return out


def _prepare(df: DataFrame, id_col: str, vec_col: str, matches: list) -> DataFrame:
    cols = [F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v")]
    cols += [(F.col(m) if isinstance(m, str) else m).alias(f"m{i}") for i, m in enumerate(matches)]
    return df.select(*cols).where("id is not null and v is not null and size(v) > 0")


def _sizes(items: DataFrame) -> dict[int, int]:
    """Number of items of each width."""
    return {r["w"]: r["n"] for r in items.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}


def _copy_number(extra: list[str]):
    """Place of an item among those with the same vector, by id; vectors meet by 128 bits of hash."""
    same = [F.xxhash64("v"), F.xxhash64(F.lit("v"), "v"), F.size("v")]
    return F.row_number().over(Window.partitionBy(*same, *extra).orderBy("id"))


def first_copies(items: DataFrame, k: int, extra: list[str] = ()) -> DataFrame:
    """Of the items with the same vector keep the first ``k`` by id.

    Later copies can never be in a top k with ties broken by id. The rank limit is also
    applied before the shuffle, so a hot vector sends at most ``k`` rows per input task.
    """
    return items.withColumn("_copy", _copy_number(extra)).where(F.col("_copy") <= k).drop("_copy")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ public API


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    threshold: float | None = None,
    query_id: str = "query_id",
    item_id: str = "key",
    query_vector: str = "embedding",
    item_vector: str = "embedding",
    match: list[Match | Between] | None = None,
    group: str | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Exact top ``k`` items per query by cosine similarity.

    Returns ``(query_id, item_id, score, rank)``; scores are rounded to 12 digits, ties
    go to the smaller item id. ``threshold`` keeps scores >= it (None keeps all).
    ``match`` restricts pairs by metadata, ``group`` to equal values of one column that
    both tables have. Vectors of different widths score 0.
    """
    match = match or []
    limit = _NO_LIMIT if threshold is None else float(threshold)
    q_extra = [
        F.struct(F.col(m.query_low).cast("double").alias("low"), F.col(m.query_high).cast("double").alias("high"))
        if isinstance(m, Between)
        else m.query_list
        for m in match
    ] + ([group] if group else [])
    i_extra = [F.col(m.item_value).cast("double") if isinstance(m, Between) else m.item_value for m in match]
    i_extra += [group] if group else []
    left = _prepare(queries, query_id, query_vector, q_extra)
    right = _prepare(items, item_id, item_vector, i_extra)
    copies = [f"m{i}" for i in range(len(i_extra))]
    if group:
        kernel = _top_k_kernel(k, limit, len(match))
        hits = _grouped_hits(left, first_copies(right, k, copies), f"m{len(match)}", kernel, limit, cell_rows)
    else:
        hits = _hits(left, right, copies, k, limit, cell_rows)
    return _ranked(hits, k).select(
        F.col("q").alias(query_id), F.col("i").alias(item_id), "score", F.col("rank").cast("int").alias("rank")
    )


def self_top_k(
    items: DataFrame, k: int, threshold: float, item_id: str = "key", vector: str = "embedding", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``top_k`` of the items among themselves, each one's own hit included: ``(query_key, item_id, score, rank)``.

    With a threshold the blocks that a row can reach are those that can reach it, so each pair of
    blocks is compared once, for both directions.
    """
    rows = _prepare(items, item_id, vector, [])
    blocks = B.fit(rows, sizes := _sizes(rows), cell_rows, "cosine")
    if not sizes:
        hits = rows.select(F.col("id").alias("q"), F.col("id").alias("i"), F.lit(0.0).alias("score"))
    else:
        rows = B.place(rows.withColumn("item", _copy_number([]) <= k), blocks)
        rows = stored(rows) if blocks.count > 1 else rows
        B.measure(rows, blocks, sizes)
        sweep = _top_k_sweep(k, float(threshold), 0, "once", cell_rows, blocks)
        hits = _sweep(rows.withColumn("bound", F.lit(float(threshold))), rows, blocks, "once", cell_rows, sweep, _HIT_SCHEMA)
    return _ranked(hits, k).select(
        F.col("q").alias("query_key"), F.col("i").alias(item_id), "score", F.col("rank").cast("int").alias("rank")
    )


def _hits(left, right, copies, k, limit, cell_rows):
    sizes = _sizes(right)  # before copies go: an upper bound is enough
    if not sizes:
        return left.limit(0).select(F.col("id").alias("q"), F.col("id").alias("i"), F.lit(0.0).alias("score"))
    blocks = B.fit(right, sizes, cell_rows, "cosine")
    items = B.place(first_copies(right, k, copies).withColumn("item", F.lit(True)), blocks)
    items = stored(items) if blocks.count > 1 else items
    B.measure(items, blocks, sizes)

    def found(asked: DataFrame, which: str) -> DataFrame:
        sweep = _top_k_sweep(k, limit, len(copies), which, cell_rows, blocks)
        return _sweep(B.place(asked, blocks), items, blocks, which, cell_rows, sweep, _HIT_SCHEMA)

    asked = left.withColumns({"item": F.lit(True), "bound": F.lit(limit)})
    if blocks.count == 1 or limit > _NO_LIMIT:
        return found(asked, "all")
    # a first look at the query's own block: its k-th score is the bound for the others
    near = stored(_ranked(found(asked, "own"), k))
    kth = near.groupBy("q").agg(F.when(F.max("rank") >= k, F.min("score")).alias("kth"))
    bounded = asked.join(kth, asked.id == kth.q, "left").withColumn("bound", F.coalesce("kth", F.lit(limit))).drop("q", "kth")
    return near.drop("rank").unionByName(found(bounded, "others"))


def _grouped_hits(left, right, group, kernel, limit, cell_rows):
    """Search inside equal values of ``group``; large groups are split on both sides, and by width."""

    def sizes(df: DataFrame, width: str, slices: str) -> DataFrame:
        return df.groupBy(group, F.size("v").alias(width)).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(slices))

    both = sizes(left, "wq", "n_q").join(sizes(right, "wi", "n_i"), group)
    if limit > 0:
        both = both.where("wq = wi")

    def dealt(df: DataFrame, width: str, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        df = df.withColumn(width, F.size("v")).join(both, [group, width])
        return _in_slice(df, F.col(own), F.col(other), own_name, other_name).drop("n_q", "n_i")

    left, right = dealt(left, "wq", "n_q", "n_i", "qs", "is"), dealt(right, "wi", "n_i", "n_q", "is", "qs")
    return _run_cells(left, right, [group, "wq", "wi", "qs", "is"], kernel, _HIT_SCHEMA)


def linked_components(
    items: DataFrame,
    eps: float,
    item_id: str = "id",
    item_vector: str = "v",
    metric: str = "cosine",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Edges ``(a, b)`` with the connectivity of all pairs at a distance <= ``eps``.

    The distance is 1 - cosine or Euclidean; vectors of different widths have cosine 0 and no
    Euclidean distance. ``items`` must hold each vector once. At most one edge per row and cell
    is emitted, however many pairs are close, and each pair of blocks is compared once.
    """
    eps = round(float(eps), SCORE_DIGITS)
    rows = _prepare(items, item_id, item_vector, [])
    sizes = _sizes(rows)
    if not sizes:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    blocks = B.fit(rows, sizes, cell_rows, metric)
    placed = B.place(rows.withColumn("item", F.lit(True)), blocks)
    placed = stored(placed) if blocks.count > 1 else placed
    B.measure(placed, blocks, sizes)
    asked = placed.withColumn("bound", F.lit(1.0 - eps if metric == "cosine" else eps))
    sweep = _component_sweep(eps, cell_rows, blocks)
    return _sweep(asked, placed, blocks, "once", cell_rows, sweep, "a string, b string").distinct()
