"""Blocks of similar vectors and exact bounds on what a block can hold.

Vectors of one width are turned to their leading principal directions, and the length that is left
over is one more coordinate. By Cauchy-Schwarz, products of these short vectors are never less than
the true ones, and their distances never more. A vector belongs to the block with the closest
centre. A block keeps the box of its coordinates and the ball around its centre; either bounds
the similarity of a vector to anything in the block. Directions and centres come from a bounded
sample: any choice gives the same answers, a good one rules out more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leading directions that the boxes are kept in.
AXES = 32
#: Blocks for each cell of rows, sampled rows for each block, and rounds of moving the centres.
BLOCKS_PER_CELL = 4
SAMPLE_PER_BLOCK = 16
MOVES = 4
#: Blocks of a model at most; fuller blocks are dealt out in slices.
MODEL_BLOCKS = 4096
_SLACK = 1e-6
#: Products of vectors and centres that a task holds at once.
_PRODUCTS = 1 << 19
#: Vectors of a batch that are worked on at once.
_SLICE_BYTES = 1 << 21


def parts(rows: int, centres: int) -> list[slice]:
    """Slices of ``rows`` whose products with all centres stay small."""
    step = max(16, _PRODUCTS // max(centres, 1))
    return [slice(k, k + step) for k in range(0, rows, step)]


def matrix(column: pa.ChunkedArray | pa.Array, rows: int, unit: bool = True) -> np.ndarray:
    """Row vectors of an Arrow list column of one width, by default of length 1; zero vectors stay zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    elements = flat.flatten()
    if elements.null_count:
        elements = pc.fill_null(elements, 0.0)
    values = np.asarray(elements, dtype=np.float64)
    if rows == 0:
        return values.reshape(0, 0)
    m = values.reshape(rows, -1)
    return unit_rows(m) if unit else m


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


@dataclass
class Frame:
    """Directions and centres of the vectors of one width; its blocks are numbered from ``first``."""

    width: int
    first: int
    axes: np.ndarray
    centres: np.ndarray

    @property
    def blocks(self) -> int:
        return max(1, len(self.centres))

    def coordinates(self, m: np.ndarray) -> np.ndarray:
        """Leading coordinates of each row and, last, the length of the rest."""
        lead = m @ self.axes.T
        rest = np.sqrt(np.maximum((m * m).sum(axis=1) - (lead * lead).sum(axis=1), 0.0))
        return np.column_stack([lead, rest])

    def home(self, at: np.ndarray) -> np.ndarray:
        """Block of the closest centre."""
        if not len(self.centres):
            return np.full(len(at), self.first)
        return self.first + _closest(at, self.centres)


def _closest(at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(at[p] @ centres.T - half).argmax(axis=1) for p in parts(len(at), len(centres))] or [np.zeros(0, int)])


def _frame(sample: np.ndarray, width: int, first: int, wanted: int) -> Frame:
    """Centres by weighted random choice, each more likely the farther it is from those before, then
    moved to the means of what is closest."""
    plain = Frame(width, first, np.zeros((0, width)), np.zeros((0, 1)))
    if wanted < 2 or len(sample) < 2:
        return plain
    frame = Frame(width, first, np.linalg.svd(sample, full_matrices=False)[2][:AXES], plain.centres)
    at = frame.coordinates(sample)
    rng = np.random.default_rng(0)
    chosen = [int(rng.integers(len(at)))]
    far = ((at - at[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < wanted and far.max() > 1e-12:
        chosen.append(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum()).clip(0, len(at) - 1)))
        far = np.minimum(far, ((at - at[chosen[-1]]) ** 2).sum(axis=1))
    frame.centres = at[chosen]
    for _ in range(MOVES):
        home = _closest(at, frame.centres)
        count = np.bincount(home, minlength=len(chosen))
        total = np.zeros_like(frame.centres)
        np.add.at(total, home, at)
        frame.centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], frame.centres)
    return frame


@dataclass
class Blocks:
    """The blocks of a table of items, with their boxes and sizes once they are measured."""

    metric: str
    frames: dict[int, Frame]
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    radius: np.ndarray = field(default=None)
    size: np.ndarray = field(default=None)

    @property
    def count(self) -> int:
        return sum(f.blocks for f in self.frames.values())

    def located(self, column, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates, block) of vectors of one width; block -1 if no item has that width."""
        frame = self.frames.get(width)
        if frame is None:
            return np.zeros((rows, 1)), np.full(rows, -1)
        at = frame.coordinates(matrix(column, rows, unit=self.metric == "cosine"))
        return at, frame.home(at)

    def from_centres(self, frame: Frame, at: np.ndarray) -> np.ndarray:
        """Angle, or distance, of each row to each centre."""
        if self.metric == "cosine":
            return np.arccos(np.clip(unit_rows(at) @ unit_rows(frame.centres).T, -1.0, 1.0))
        squared = (at * at).sum(axis=1)[:, None] + (frame.centres**2).sum(axis=1) - 2 * at @ frame.centres.T
        return np.sqrt(np.maximum(squared, 0.0))

    def reachable(self, at: np.ndarray, width: int, bound: np.ndarray) -> np.ndarray:
        """Which blocks may hold something of similarity ``bound`` or more to each row, or, with the
        Euclidean metric, at distance ``bound`` or less. Vectors of other widths have cosine 0."""
        can = np.zeros((len(at), self.count), dtype=bool)
        if self.metric == "cosine":
            can |= (bound <= _SLACK)[:, None]
        frame = self.frames.get(width)
        if frame is None:
            return can & (self.size > 0)
        own = slice(frame.first, frame.first + frame.blocks)
        low, high = self.low[own, : at.shape[1]], self.high[own, : at.shape[1]]
        if self.metric == "cosine":
            most = np.maximum(at, 0) @ high.T + np.minimum(at, 0) @ low.T
            if len(frame.centres):
                angle = np.maximum(self.from_centres(frame, at) - self.radius[own], 0)
                most = np.minimum(most, np.cos(np.minimum(angle, np.pi)))
            can[:, own] = most >= bound[:, None] - _SLACK
            return can & (self.size > 0)
        least = np.zeros((len(at), frame.blocks))
        if len(frame.centres):
            least = np.maximum(self.from_centres(frame, at) - self.radius[own], 0)
        for k in range(frame.blocks):
            gap = np.maximum(np.maximum(low[k] - at, at - high[k]), 0)
            least[:, k] = np.maximum(least[:, k], np.sqrt((gap * gap).sum(axis=1)))
        can[:, own] = least <= bound[:, None] + _SLACK
        return can & (self.size > 0)

    def width_of(self, block: int) -> int:
        return next(w for w, f in self.frames.items() if f.first <= block < f.first + f.blocks)

    def holds(self, at: np.ndarray, width: int, bound: np.ndarray, block: int) -> np.ndarray:
        """``reachable`` for one block."""
        frame = self.frames.get(width)
        if frame is None or not frame.first <= block < frame.first + frame.blocks:
            return bound <= _SLACK if self.metric == "cosine" else np.zeros(len(at), dtype=bool)
        own = block - frame.first
        one = Frame(width, 0, frame.axes, frame.centres[own : own + 1])
        alone = Blocks(self.metric, {width: one}, *(x[block : block + 1] for x in (self.low, self.high, self.radius, self.size)))
        return alone.reachable(at, width, bound)[:, 0]


def may_visit(home: np.ndarray, block, which: str) -> np.ndarray:
    """Which blocks rows of a home block visit at all: ``all``, their ``own``, all ``others``, or ``once`` their own
    and of two blocks one the other, which is enough where rows and items are the same."""
    if which == "own":
        return home == block
    if which == "others":
        return home != block
    if which == "once":
        return (home == block) | (((home - block) % 2 == 0) == (home < block))
    return np.ones(np.broadcast_shapes(np.shape(home), np.shape(block)), dtype=bool)

def by_width(batch: pa.RecordBatch):
    """(width, slice of rows) of a batch, of bounded bytes; rows keep their order within a width."""
    width = pc.list_value_length(batch.column(batch.schema.get_field_index("v"))).to_numpy(zero_copy_only=False)
    for w in np.unique(width):
        rows = batch if (width == w).all() else batch.filter(pa.array(width == w))
        step = max(16, _SLICE_BYTES // (8 * max(int(w), 1)))
        for k in range(0, rows.num_rows, step):
            yield int(w), rows.slice(k, step)


def fit(items: DataFrame, sizes: dict[int, int], block_rows: int, metric: str) -> Blocks:
    """Frames for the vectors ``v`` of items, of which ``sizes`` has a number for each width.

    Reads about sixteen rows a block, by the hash of their id, and none while a width is one block.
    """
    total = sum(sizes.values())
    wanted = {w: math.ceil(min(BLOCKS_PER_CELL * n / block_rows, MODEL_BLOCKS * n / total)) if n > block_rows else 1 for w, n in sizes.items()}
    share = {w: min(1.0, SAMPLE_PER_BLOCK * wanted[w] / n) for w, n in sizes.items() if wanted[w] > 1}
    samples: dict[int, list[np.ndarray]] = {}
    if share:
        part = F.coalesce(*[F.when(F.size("v") == w, F.lit(s)) for w, s in share.items()])
        chance = F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / float(1 << 53)
        for batch in items.where(chance < part).select("v").toArrow().to_batches():
            for w, rows in by_width(batch):
                samples.setdefault(w, []).append(matrix(rows.column(0), rows.num_rows, unit=metric == "cosine"))
    frames, first = {}, 0
    for w in sorted(sizes):
        sample = np.concatenate(samples[w]) if w in samples else np.zeros((0, w))
        frames[w] = _frame(sample, w, first, wanted[w])
        first += frames[w].blocks
    return Blocks(metric, frames)


def place(df: DataFrame, blocks: Blocks) -> DataFrame:
    """Add the ``block`` of each row by its vector ``v``."""
    names = df.columns

    def assign(batches):
        for batch in batches:
            for w, rows in by_width(batch):
                _, home = blocks.located(rows.column(names.index("v")), rows.num_rows, w)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(home.astype(np.int32))], names=[*names, "block"])

    if blocks.count == 1:
        (only,) = blocks.frames
        return df.withColumn("block", F.when(F.size("v") == only, 0).otherwise(-1))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(assign, f"{fields}, block int")


def measure(placed: DataFrame, blocks: Blocks, sizes: dict[int, int]) -> None:
    """Fill in the boxes and sizes of the blocks from all placed items."""
    axes = 1 + max(len(f.axes) for f in blocks.frames.values())
    blocks.low, blocks.high = np.full((blocks.count, axes), np.inf), np.full((blocks.count, axes), -np.inf)
    blocks.radius = np.zeros(blocks.count)
    if blocks.count == len(blocks.frames):  # a block for each width: anything may be in it
        blocks.size = np.array([sizes[w] for w in sorted(sizes)])
        limit = 1.0 if blocks.metric == "cosine" else np.inf
        blocks.low[:], blocks.high[:] = -limit, limit
        return
    blocks.size = np.zeros(blocks.count, dtype=np.int64)

    def boxes(batches):
        low, high, radius, size = blocks.low.copy(), blocks.high.copy(), blocks.radius.copy(), blocks.size.copy()
        for batch in batches:
            for w, rows in by_width(batch):
                at, home = blocks.located(rows.column(0), rows.num_rows, w)
                k = at.shape[1]
                np.minimum.at(low[:, :k], home, at)
                np.maximum.at(high[:, :k], home, at)
                size += np.bincount(home, minlength=len(size))
                frame = blocks.frames[w]
                if len(frame.centres):
                    for part in parts(len(at), len(frame.centres)):
                        away = blocks.from_centres(frame, at[part])
                        np.maximum.at(radius, home[part], away[np.arange(len(away)), home[part] - frame.first])
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, axes), pa.int32()),
                pa.array(np.tile(np.arange(axes), len(some)), pa.int32()),
                pa.array(low[some].ravel()),
                pa.array(high[some].ravel()),
                pa.array(np.repeat(radius[some], axes)),
                pa.array(np.repeat(size[some], axes)),
            ],
            names=["block", "axis", "low", "high", "radius", "n"],
        )

    found = placed.select("v").mapInArrow(boxes, "block int, axis int, low double, high double, radius double, n long")
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("radius").alias("radius"), F.sum("n").alias("n")]
    for r in found.groupBy("block", "axis").agg(*ends).collect():  # blocks of the model times axes
        blocks.low[r["block"], r["axis"]], blocks.high[r["block"], r["axis"]] = r["low"], r["high"]
        blocks.radius[r["block"]], blocks.size[r["block"]] = r["radius"], r["n"]
    # axes that a narrow width does not have
    blocks.low[~np.isfinite(blocks.low)] = 0.0
    blocks.high[~np.isfinite(blocks.high)] = 0.0
