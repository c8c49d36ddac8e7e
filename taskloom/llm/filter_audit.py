"""Audit of interacting filters: what each removes in every order, from count-weighted decision diagrams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import own_columns, written

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
MARKS = r"[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]++"

STEP_SCHEMA = """part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,
    good_lost long, toxic_lost long, shapley long"""


class Diagram:
    """Decision diagram of failure masks: a level tests one filter, leaves hold counts.

    A node is its pair of children (passed, failed). Equal pairs are one node, as are equal leaves;
    node 0 stands for no documents at any level. ``total`` has the summed counts below each node.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: str):
        self.order = list(filters)
        self.none = (0,) * (len(next(iter(counts.values()))) if counts else 1)
        self.children, self.total = [(0, 0)], [self.none]
        self._nodes: dict[tuple[int, int], int] = {(0, 0): 0}
        self._leaves = {self.none: 0}
        self.root = self._build(counts, 0, 0)

    def _add(self, children: tuple[int, int], total: tuple[int, ...]) -> int:
        self.children.append(children)
        self.total.append(total)
        return len(self.total) - 1

    def _build(self, counts: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level == len(self.order):
            leaf = tuple(counts.get(mask, self.none))
            if leaf not in self._leaves:
                self._leaves[leaf] = self._add((0, 0), leaf)
            return self._leaves[leaf]
        return self._node(self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def _node(self, passed: int, failed: int) -> int:
        key = passed, failed
        if key not in self._nodes:
            self._nodes[key] = self._add(key, tuple(map(sum, zip(self.total[passed], self.total[failed]))))
        return self._nodes[key]

    def swap(self, level: int) -> None:
        """Exchanges the filters of ``level`` and the next one; nodes below both are untouched."""
        done: dict[int, int] = {}

        def moved(node: int, depth: int) -> int:
            if node not in done:
                passed, failed = self.children[node]
                if depth:
                    done[node] = self._node(moved(passed, depth - 1), moved(failed, depth - 1))
                else:
                    (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
                    done[node] = self._node(self._node(pp, fp), self._node(pf, ff))
            return done[node]

        self.root = moved(self.root, level)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts that pass it, counts that fail it) among what passed all filters before."""
        node = self.root
        for name in self.order:
            node, failed = self.children[node]
            yield name, self.total[node], self.total[failed]

    def only_failure(self, name: str) -> tuple[int, ...]:
        """Counts that fail this filter and no other."""
        node = self.root
        for other in self.order:
            node = self.children[node][other == name]
        return self.total[node]


def plain_changes(n: int) -> Iterator[int]:
    """Places to swap with their right neighbour so that all orders of ``n`` things occur once each."""
    if n < 2:
        return
    down, inner = True, plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down
        down = not down


def part_steps(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique fails, good lost, toxic lost, shapley) of one part.

    ``counts`` maps a mask (bit k: the k-th filter fails) to documents, good ones and toxic ones.
    """
    diagram = Diagram(counts, filters)
    fails = {f: sum(c[0] for mask, c in counts.items() if mask >> k & 1) for k, f in enumerate(filters)}
    alone = {f: diagram.only_failure(f)[0] for f in filters}
    shapley = dict.fromkeys(filters, 0)
    found = []

    def read() -> None:
        order = "".join(diagram.order)
        for step, (f, passed, failed) in enumerate(diagram.all_pass_path(), 1):
            shapley[f] += failed[0]
            found.append((order, step, passed[0], failed[0], fails[f] - failed[0], alone[f], failed[1], failed[2], f))

    read()
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        read()
    return [(*row[:-1], shapley[row[-1]]) for row in found]


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of every order of the filters in every part.

    ``masks (part, mask, n, good, toxic)`` has one row for each part and mask that occurs, at most
    2^filters of a part, so a part is a bounded group however many documents it has.
    """

    def steps(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        counts = dict(zip(rows["mask"], zip(rows["n"], rows["good"], rows["toxic"])))
        columns = list(zip(*part_steps(counts, filters)))
        kinds = [pa.string(), pa.int32()] + [pa.int64()] * 7
        arrays = [pa.array([rows["part"][0]] * len(columns[0]), pa.string())]
        arrays += [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in STEP_SCHEMA.split(",")])

    return masks.select("part", "mask", "n", "good", "toxic").groupBy("part").applyInArrow(steps, STEP_SCHEMA)


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone; E needs the other texts."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each source by the filters they fail.

    ``docs`` has ``doc_id``, ``text`` and ``source``, ``labels`` has ``doc_id``, ``quality`` and ``toxic``; other
    columns are not read. Null text and source count as empty. A document is good or toxic if any
    label row of its id says so; a null id has no label, no smaller id and is smaller than none.
    Repeated rows count as often as they occur; a row is no copy of another with its own id.
    An empty table gives no rows. Texts are read once and stay where they are: only their
    SHA-256 and the mask are shuffled, and copies meet as one row a text.
    """
    rows = own_columns(docs, "doc_id", "text", "source").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(text_failures(F.col("text")).values())]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    rows = written(rows.select("doc_id", "part", mask.alias("mask"), digest))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.where("copies > 1 and first is not null").select("digest", "first")
    marks = own_columns(labels, "doc_id", "quality", "toxic").where("quality = 1 or toxic = 1")
    marks = marks.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    marked = rows.join(firsts, "digest", "left").join(marks, "doc_id", "left")
    return (
        marked.withColumn("mask", F.col("mask").bitwiseOR(copy))
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
