"""Adaptors from the generated benchmark tables to the work-item schemas.

Tables are read with their Parquet schema; each adaptor is a projection, so column
pruning and filters still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TIME = "2024-01-01 00:00:00"


# tables whose rows are long texts: work on them is bound by the CPU, not by the scan
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a text table that fills fewer tasks than there are cores is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, TEXT_TABLES[name])
    return df


def _no_strings():
    return F.array().cast("array<string>")


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items with vectors: one per row of ``embeddings``, grouped by its label."""
    e = table(spark, sf_dir, "embeddings")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60)
    return e.select(
        F.concat(F.lit("V-"), F.col("vec_id").cast("string")).alias("key"),
        F.concat(F.lit("Vector item "), F.col("vec_id").cast("string")).alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.element_at(F.array(*map(F.lit, ["Story", "Task", "Bug"])), (F.col("vec_id") % 3 + 1).cast("int")).alias(
            "issue_type"
        ),
        F.element_at(F.array(*map(F.lit, ["Open", "Done"])), (F.col("vec_id") % 2 + 1).cast("int")).alias("status"),
        F.lit(None).cast("string").alias("parent_key"),
        F.concat(F.lit("E-"), F.col("label").cast("string")).alias("epic_key"),
        at.alias("created"),
        at.alias("updated"),
        F.lit(None).cast("string").alias("assignee"),
        F.lit("import").alias("reporter"),
        F.array(F.concat(F.lit("part-"), (F.col("vec_id") % 5).cast("string"))).alias("components"),
        F.array(F.concat(F.lit("tag-"), (F.col("vec_id") % 7).cast("string"))).alias("labels"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def document_items(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Work items with text: one per row of ``documents``; priority from ``labels``."""
    d = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "labels").select("doc_id", "quality")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    items = d.join(q, "doc_id", "left").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"),
        F.substring_index("text", "\n", 1).alias("summary"),
        F.col("text").alias("description"),
        F.element_at(
            F.array(*map(F.lit, ["Epic", "Story", "Task", "Bug"])), (F.col("doc_id") % 4 + 1).cast("int")
        ).alias("issue_type"),
        F.element_at(F.array(*map(F.lit, ["Open", "In Progress", "Done"])), (F.col("doc_id") % 3 + 1).cast("int")).alias(
            "status"
        ),
        F.lit(None).cast("string").alias("parent_key"),
        F.col("source").alias("epic_key"),
        at.alias("created"),
        at.alias("updated"),
        F.lit(None).cast("string").alias("assignee"),
        F.lit("import").alias("reporter"),
        F.array("lang").alias("components"),
        _no_strings().alias("labels"),
        F.when(F.col("quality") == 1, "High").when(F.col("quality") == 0, "Low").otherwise("Medium").alias("priority"),
    )
    return items.select(*columns) if columns else items


def tree_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epic > story > sub-task from customer > orders > lineitem."""
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    base = F.to_timestamp(F.lit(BASE_TIME))
    null = F.lit(None).cast("string")
    epics = c.select(
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("key"),
        F.col("c_name").alias("summary"),
        F.lit("Epic").alias("issue_type"),
        F.when(F.col("c_acctbal") < 0, "Closed").otherwise("Open").alias("status"),
        null.alias("parent_key"),
        null.alias("epic_key"),
        base.alias("created"),
        F.array("c_mktsegment").alias("components"),
        _no_strings().alias("labels"),
        null.alias("priority"),
    )
    stories = o.select(
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("key"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("summary"),
        F.lit("Story").alias("issue_type"),
        F.when(F.col("o_orderstatus") == "F", "Done")
        .when(F.col("o_orderstatus") == "O", "Open")
        .otherwise("In Progress")
        .alias("status"),
        null.alias("parent_key"),
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("epic_key"),
        F.col("o_orderdate").alias("created"),
        _no_strings().alias("components"),
        F.array("o_orderpriority", "o_orderstatus").alias("labels"),
        F.col("o_orderpriority").alias("priority"),
    )
    tasks = li.select(
        # order and line number alone are not unique in the generated table
        F.concat_ws(
            "-",
            F.lit("L"),
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("key"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("summary"),
        F.lit("Sub-task").alias("issue_type"),
        F.when(F.col("l_linestatus") == "F", "Closed").otherwise("Open").alias("status"),
        F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("parent_key"),
        null.alias("epic_key"),
        F.col("l_shipdate").alias("created"),
        _no_strings().alias("components"),
        F.array("l_returnflag").alias("labels"),
        null.alias("priority"),
    )
    return epics.unionByName(stories).unionByName(tasks)


def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-call log from ``events``."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("service"),
        F.concat_ws(".", "event_type", (F.col("user_id") % 5).cast("string")).alias("operation"),
        F.col("ts").cast("timestamp").alias("ts"),
        k.alias("input_tokens"),
        F.floor(k / 2).cast("bigint").alias("output_tokens"),
        (F.col("value") / 100).alias("cost"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version history from ``conversations``: one version per turn, a day apart."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")).alias("key"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 86400).alias("ts"),
        F.col("text").alias("description"),
        F.col("role").alias("author"),
    )


def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries from ``benchmark``; categories cycle over three names."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.concat(F.lit("Q-"), F.col("item_id").cast("string")).alias("id"),
        F.col("item_id"),
        F.col("text").alias("query_text"),
        F.element_at(
            F.array(*map(F.lit, ["functional", "technical", "business"])), (F.col("item_id") % 3 + 1).cast("int")
        ).alias("category"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the document items for change detection: (old, new).

    The old state lacks every tenth document; in the new one every seventh text has changed.
    """
    # Spark infers filters on other tables' keys from these on ``n``, where a key without a number must not fail
    items = document_items(spark, sf_dir).withColumn("n", F.substring("key", 5, 20).try_cast("bigint"))
    old = items.where(F.col("n") % 10 != 0).drop("n")
    new = items.withColumn(
        "description",
        F.when(F.col("n") % 7 == 0, F.concat("description", F.lit("!"))).otherwise(F.col("description")),
    ).drop("n")
    return old, new
