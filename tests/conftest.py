import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from taskloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def items(spark):
    """Eight literal work items: a duplicate pair, debt items, an epic with children."""
    from pyspark.sql import functions as F

    rows = [
        ("PROJ-1", "Implement user login", "As a user, I want to log in", "Story", "Open", None, "PROJ-E1", ["auth"], ["login"]),
        ("PROJ-2", "Create user login feature", "Users need login", "Story", "Open", None, "PROJ-E1", ["auth"], ["login"]),
        ("PROJ-3", "Refactor legacy payment code", "critical security debt", "Task", "Open", None, "PROJ-E1", [], ["tech-debt"]),
        ("PROJ-4", "Cleanup deprecated API", "", "Task", "Done", "PROJ-1", None, ["api"], ["refactor"]),
        ("PROJ-5", "Sub task", None, "Sub-task", "Closed", "PROJ-4", None, [], []),
        ("PROJ-E1", "Login epic", "Goals: one login\n\nRest", "Epic", "Open", None, None, [], []),
        ("PROJ-E2", "Closed epic", None, "Epic", "Closed", None, None, [], []),
        ("OTHER-1", "Other", "text", "Bug", "Open", None, "PROJ-E2", [], []),
    ]
    df = spark.createDataFrame(
        rows,
        "key string, summary string, description string, issue_type string, status string, parent_key string, "
        "epic_key string, components array<string>, labels array<string>",
    )
    at = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    return df.withColumn("created", at).withColumn("updated", at).withColumn("reporter", F.lit("r")).withColumn(
        "assignee", F.lit(None).cast("string")
    )
