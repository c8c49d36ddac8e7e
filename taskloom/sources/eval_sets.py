"""Evaluation query sets: files and built-in sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.schema import EVAL_QUERY

DEFAULT_MINIMUM = 0.6
DEFAULT_COVERAGE = 3

# Built-in test queries (id, text, minimum similarity, category, description).
DEFAULT_TESTS = [
    ("auth_functionality", "user authentication and login functionality", 0.7, "functional",
     "Should find authentication-related work items"),
    ("user_management", "user account management and permissions", 0.7, "functional",
     "Should find user management-related work items"),
    ("reporting_features", "reporting and analytics features", 0.6, "functional",
     "Should find reporting-related work items"),
    ("database_migration", "database schema changes and migrations", 0.6, "technical",
     "Should identify database-related tasks"),
    ("performance_optimization", "application performance and speed optimization", 0.7, "technical",
     "Should identify performance-related tasks"),
    ("security_implementation", "security implementation and vulnerability fixes", 0.7, "technical",
     "Should identify security-related tasks"),
    ("api_documentation", "REST API documentation and endpoint specifications", 0.6, "business",
     "Should find documentation tasks"),
    ("business_rules", "business logic and workflow rules implementation", 0.6, "business",
     "Should find business logic tasks"),
]
# The small suite (id, text, expected keys, minimum similarity, category).
SUITE = [
    ("auth_functionality", "user authentication and login functionality", ["PROJ-123", "PROJ-456"], 0.7, "functional"),
    ("database_migration", "database schema changes and migrations", ["PROJ-789", "PROJ-012"], 0.6, "technical"),
    ("ui_improvements", "user interface and user experience improvements", ["PROJ-345", "PROJ-678"], 0.65, "functional"),
    ("performance_optimization", "application performance and speed optimization", ["PROJ-901", "PROJ-234"], 0.7,
     "technical"),
    ("api_documentation", "REST API documentation and endpoint specifications", ["PROJ-567", "PROJ-890"], 0.6, "business"),
]
# Plain query texts of the retrieval smoke test.
SMOKE_QUERIES = [
    "authentication and login functionality",
    "database migration and schema changes",
    "user interface improvements",
    "API endpoint documentation",
    "performance optimization tasks",
    "bug fixes and error handling",
    "integration testing",
    "security vulnerabilities",
    "mobile application features",
    "reporting and analytics",
]

_TEST = (
    "id:string,query_text:string,expected_work_items:array<string>,minimum_similarity:double,category:string,"
    "description:string"
)
_FILE = f"categories map<string, struct<name:string,description:string,min_coverage:int,tests:array<struct<{_TEST}>>>>"


def default_eval_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, [], m, c, d) for i, t, m, c, d in DEFAULT_TESTS], EVAL_QUERY)


def suite_eval_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, e, m, c, "") for i, t, e, m, c in SUITE], EVAL_QUERY)


def smoke_queries(spark: SparkSession) -> DataFrame:
    rows = [(f"smoke_{n}", t) for n, t in enumerate(SMOKE_QUERIES)]
    return spark.createDataFrame(rows, "id string, query_text string")


def read_eval_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tests and categories of a query-set file; it replaces any earlier set."""
    raw = spark.read.schema(_FILE).json(path, multiLine=True)
    cats = raw.select(F.explode("categories").alias("category", "c"))
    categories = cats.select(
        "category",
        F.col("c.description").alias("description"),
        F.coalesce("c.min_coverage", F.lit(DEFAULT_COVERAGE)).alias("min_coverage"),
    )
    tests = cats.select("category", F.explode("c.tests").alias("t")).select(
        "t.id",
        "t.query_text",
        F.coalesce("t.expected_work_items", F.array().cast("array<string>")).alias("expected"),
        F.coalesce("t.minimum_similarity", F.lit(DEFAULT_MINIMUM)).alias("minimum_similarity"),
        F.coalesce("t.category", "category").alias("category"),
        F.coalesce("t.description", F.lit("")).alias("description"),
    )
    return tests, categories


def write_eval_queries(tests: DataFrame, categories: DataFrame, path: str) -> None:
    """One JSON document; a query set is written and edited by people, so it is small."""
    t = tests.select(
        "category",
        F.struct(
            "id", "query_text", F.col("expected").alias("expected_work_items"), "minimum_similarity", "category", "description"
        ).alias("t"),
    )
    grouped = t.groupBy("category").agg(F.array_sort(F.collect_list("t")).alias("tests"))
    entry = F.struct(F.col("category").alias("name"), "description", "min_coverage", "tests")
    joined = categories.join(grouped, "category", "left").select(F.struct("category", entry.alias("e")).alias("kv"))
    doc = joined.agg(F.map_from_entries(F.array_sort(F.collect_list("kv"))).alias("categories"))
    doc.coalesce(1).write.mode("overwrite").json(path)
