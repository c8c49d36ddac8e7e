"""Label and component usage, similar labels and label hygiene."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.operators.ranks import with_totals
from taskloom.session import cut_lineage


def usage(items: DataFrame, column: str, name: str) -> DataFrame:
    """How often each element of an array column is used: ``(name, n)``."""
    return items.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def label_usage(items: DataFrame) -> DataFrame:
    return usage(items, "labels", "label")


def component_usage(items: DataFrame) -> DataFrame:
    return usage(items, "components", "component")


def top_labels(items: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most used labels, ties by name."""
    return label_usage(items).orderBy(F.desc("n"), "label").limit(k)


#: Characters of the needles that one automaton holds, about 50 bytes each.
BLOCK_CHARS = 2_000_000


def contains_pairs(texts: DataFrame, needles: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(needle_id, text_id)`` where the needle is a substring of the text, each pair once.

    ``texts`` has ``(text_id, text)``, ``needles`` ``(needle_id, needle)``. The needles go to the tasks in blocks
    of about ``block_chars`` characters; a task makes one automaton of a block and finds all its needles in
    one walk over each text, so only matches are written, however common a needle's parts
    are. Each block is a scan of the texts. Empty and null needles match nothing, nor do null texts.
    """
    sized = needles.where(F.length("needle") > 0).select("needle_id", "needle")
    chars = sized.agg(F.sum(F.length("needle").cast("long"))).first()[0] or 0
    types = [(c, d.schema[c].dataType) for c, d in (("needle_id", needles), ("text_id", texts))]
    schema = T.StructType([T.StructField(c, t) for c, t in types])
    blocks = -(-chars // block_chars)
    rows, found = texts.where(F.col("text").isNotNull()).select("text_id", "text"), None
    for k in range(blocks):
        block = sized.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == k).toArrow()
        part = _found_in(rows, block, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else needles.sparkSession.createDataFrame([], schema)


def _found_in(texts: DataFrame, block: pa.Table, schema: T.StructType) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(block)
    kind = block.schema.field("needle_id").type

    def run(batches):
        import ahocorasick

        ids = shared.value.column("needle_id").combine_chunks()
        rows_of: dict[str, list[int]] = {}
        for i, needle in enumerate(shared.value.column("needle").to_pylist()):
            rows_of.setdefault(needle, []).append(i)
        automaton = ahocorasick.Automaton()
        for needle, rows in rows_of.items():
            automaton.add_word(needle, tuple(rows))
        if rows_of:
            automaton.make_automaton()
        for batch in batches:
            needle_rows, text_rows = [], []
            for k, text in enumerate(batch.column(1)):
                if not rows_of:
                    break
                hits = {rows for _, rows in automaton.iter(text.as_py())}
                for rows in hits:
                    needle_rows += rows
                    text_rows += [k] * len(rows)
            columns = [ids.take(pa.array(needle_rows, pa.int64())).cast(kind), batch.column(0).take(pa.array(text_rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["needle_id", "text_id"])

    return texts.mapInArrow(run, schema).distinct()


def similar_labels(items: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Pairs of labels that could be merged: ``(label_a, label_b)`` with a < b.

    Labels are similar when one contains the other (ignoring case) or when they share at
    least one word and at least half of the first label's words. Shared words are found by
    an equi-join on the rarest words of the first label: with d distinct words of which c
    must be shared, one of its d - c + 1 rarest has to be among them.
    """
    # the vocabulary is written once, so the items are read once
    counts = counts if counts is not None else cut_lineage(label_usage(items))
    names = counts.select("label", F.lower("label").alias("low"))
    words = F.filter(F.split("low", r"(?U)\s+"), lambda w: w != "")
    named = names.select("label", "low", words.alias("words"), F.array_distinct(words).alias("dw"))
    inside = contains_pairs(
        names.select(F.col("label").alias("text_id"), F.col("low").alias("text")),
        names.select(F.col("label").alias("needle_id"), F.col("low").alias("needle")),
    ).where("needle_id <> text_id")
    by_contents = inside.select(F.least("needle_id", "text_id").alias("label_a"), F.greatest("needle_id", "text_id").alias("label_b"))

    exploded = named.select("label", F.explode("dw").alias("word"))
    frequency = exploded.groupBy("word").agg(F.count("*").alias("f"))
    need = F.greatest(F.lit(1), F.floor(F.size("words") / 2).cast("int"))
    rank = Window.partitionBy("label").orderBy("f", "word")
    firsts = (
        named.select("label", F.size("dw").alias("d"), need.alias("c"), F.explode("dw").alias("word"))
        .join(frequency, "word")
        .withColumn("rn", F.row_number().over(rank))
        .where(F.col("rn") <= F.col("d") - F.col("c") + 1)
        .select(F.col("label").alias("label_a"), "word")
    )
    seconds = exploded.select(F.col("label").alias("label_b"), "word")
    candidates = firsts.join(seconds, "word").where("label_a < label_b").select("label_a", "label_b").distinct()
    a = named.select(F.col("label").alias("label_a"), F.col("dw").alias("da"), need.alias("c"))
    b = named.select(F.col("label").alias("label_b"), F.col("dw").alias("db"))
    by_words = (
        candidates.join(a, "label_a")
        .join(b, "label_b")
        .where(F.size(F.array_intersect("da", "db")) >= F.col("c"))
        .select("label_a", "label_b")
    )
    return by_contents.unionByName(by_words).distinct()


def label_report(items: DataFrame, many: int = 50) -> DataFrame:
    """Suggestions as rows ``(kind, subject, message)``."""
    counts = cut_lineage(label_usage(items))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("labels"))
    shared = with_totals(counts, total)
    rare = F.col("n") / F.col("total") < 0.01
    cleanup = shared.where((F.col("n") == 1) | rare).select(
        F.lit("cleanup").alias("kind"),
        F.col("label").alias("subject"),
        F.when(F.col("n") == 1, F.format_string("'%s' (used only once)", "label"))
        .otherwise(F.format_string("'%s' (rarely used: %d times)", "label", "n"))
        .alias("message"),
    )
    merge = similar_labels(items, counts).select(
        F.lit("inconsistency").alias("kind"),
        F.col("label_a").alias("subject"),
        F.format_string("Similar labels: '%s' and '%s' - consider consolidating", "label_a", "label_b").alias("message"),
    )
    too_many = total.where(F.col("labels") > many).select(
        F.lit("optimization").alias("kind"),
        F.lit("labels").alias("subject"),
        F.lit("Large number of labels - consider label taxonomy review").alias("message"),
    )
    no_components = (
        items.agg(F.max(F.size("components")).alias("most"))
        .where(F.coalesce("most", F.lit(0)) <= 0)
        .select(
            F.lit("optimization").alias("kind"),
            F.lit("components").alias("subject"),
            F.lit("No components used - consider adding component structure").alias("message"),
        )
    )
    overused = shared.where(F.col("n") > F.col("total") * 0.5).select(
        F.lit("optimization").alias("kind"),
        F.col("label").alias("subject"),
        F.format_string("Label '%s' is overused - consider more specific labels", "label").alias("message"),
    )
    out = cleanup
    for part in (merge, too_many, no_components, overused):
        out = out.unionByName(part)
    return out
