"""Epic > story > task > sub-task: children, trees, depth, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.operators.filters import for_project
from taskloom.session import stored
from taskloom.session import stored as cut_lineage  # what a round leaves

# Finished statuses and the issue types of each role, in lower case.
DONE = ["done", "closed", "resolved", "completed"]
ROLES = {"story": ["story", "user story"], "task": ["task", "improvement"], "subtask": ["sub-task", "subtask"]}
MAX_SHOWN_CHILDREN = 50


def _links(items: DataFrame) -> DataFrame:
    up = F.explode(F.array_distinct(F.array("parent_key", "epic_key"))).alias("parent")
    return items.select(up, F.col("key").alias("child")).where("parent is not null and parent <> ''")


def child_edges(items: DataFrame) -> DataFrame:
    """Direct children by parent or epic link: distinct ``(parent, child)``."""
    return _links(items).distinct()


def is_open_epic():
    return (F.col("issue_type") == "Epic") & (F.col("status") != "Closed")


def active_epics(items: DataFrame, project: str | None = None) -> DataFrame:
    """Epics that are not closed and have children."""
    epics = items.where(is_open_epic())
    if project:
        epics = for_project(epics, project)
    parents = child_edges(items).select(F.col("parent").alias("key")).distinct()
    return epics.join(parents, "key", "left_semi")


def epic_children(items: DataFrame, epics: DataFrame) -> DataFrame:
    """Children of each epic: by parent, or by epic link unless they are epics themselves.

    Two equi-joins and a union, since one join with OR would compare all pairs.
    ``epics`` has ``key``; the result has ``epic`` and the columns of the child.
    """
    keys = epics.select(F.col("key").alias("epic")).distinct()
    by_parent = items.withColumn("epic", F.col("parent_key")).join(keys, "epic")
    by_link = items.where(F.col("issue_type") != "Epic").withColumn("epic", F.col("epic_key")).join(keys, "epic")
    # a row found by both links has the same epic and key, so keep the second only if the first lacks it
    linked_only = by_link.where(~F.col("parent_key").eqNullSafe(F.col("epic")))
    return by_parent.unionByName(linked_only)


def ordered_children(items: DataFrame, epics: DataFrame) -> DataFrame:
    """Epic children sorted by epic, creation time and key."""
    return epic_children(items, epics).orderBy("epic", "created", "key")


def _least(links: DataFrame, inside: list[str]) -> DataFrame:
    return links.groupBy(*inside, "key", "up").agg(F.min("steps").alias("steps"), F.first("open").alias("open"))


def _joined(lower: DataFrame, upper: DataFrame, inside: list[str]) -> DataFrame:
    """Ways over two links; whether they are open is the upper link's matter."""
    above = upper.select(*inside, F.col("key").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"), F.col("open").alias("on"))
    ways = lower.join(above, [*inside, "up"])
    return ways.select(*inside, "key", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("open"))


def _climbed(links: DataFrame, inside: list[str]) -> DataFrame:
    """All ways up to a closed link by pointer doubling, with their least steps.

    ``links (key, up, steps, open)`` has a row for each key and place above it, apart for each value of the
    columns ``inside``; rows may come twice. Every round reads them several times, so they should be a table. A round replaces open links by the links of their upper end, so their length doubles,
    and what cannot end is left out; a way longer than there are keys runs in a circle, so the
    rounds are logarithmic in any case.
    """
    current, size, reach = links, None, 1
    while not current.where("open").isEmpty():
        size = size or current.count()  # no fewer than keys
        if reach > size:
            break
        done = current.where("not open")
        current = cut_lineage(_least(done.unionByName(_joined(current.where("open"), current, inside)), inside))
        reach *= 2
    # without a round the links are those given
    return current.where("not open") if reach > 1 else cut_lineage(_least(current.where("not open"), inside))


def _closed(links: DataFrame) -> DataFrame:
    """Least steps between all pairs that ways over the links connect, each round twice as long."""
    current, before = cut_lineage(_least(links, [])), None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum("steps")).first())
        if state == before or not state[0]:
            return current
        before = state
        ways = current.unionByName(_joined(current, current, [])).where("key <> up")
        current = cut_lineage(_least(ways, []))


def _placed(items: DataFrame, named: DataFrame, keep: list[str]) -> DataFrame:
    """``(key, up, n, is_parent, is_root)`` and the columns ``keep`` of each item and place above it; ``up`` is null where there is none.

    ``n`` is the number of rows of the key. The rows move once, by key.
    """
    above = F.filter(F.array_distinct(F.array("parent_key", "epic_key")), lambda x: x.isNotNull() & (x != ""))
    links = items.select("key", *keep, F.explode_outer(above).alias("up"))
    parents = _links(items).select(F.col("parent").alias("key")).distinct().withColumn("is_parent", F.lit(True))
    roots = named.select("key", F.lit(True).alias("is_root"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    counted = links.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    rows = counted.join(parents, "key", "left").join(roots, "key", "left")
    return stored(rows.select("key", "up", *keep, "n", flag("is_parent"), flag("is_root")))


def _inner(placed: DataFrame, named: DataFrame) -> DataFrame:
    """All items with children below each root: ``(root, key, level)``, each once at its first level."""
    edges = placed.where("is_parent and up is not null").select("key", "up", F.lit(1).alias("steps"))
    ends = named.select(F.col("key").alias("up"), F.lit(False).alias("open"))
    links = stored(edges.join(ends, "up", "left").withColumn("open", F.col("open").isNull()))
    first = _climbed(links, []).where("key <> up")
    between = _closed(first.join(named, "key", "left_semi"))
    found = first
    if not between.isEmpty():
        found = stored(_least(first.unionByName(_joined(first, between, [])).where("key <> up"), []))
    return found.select(F.col("up").alias("root"), "key", F.col("steps").alias("level"))


def _tree(items: DataFrame, roots: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The members below each root, ``(root, key, level, is_parent)`` and the columns ``keep`` of their items,
    and the items that are roots, ``(root)`` and ``keep``."""
    # tables of their own: the roots are read with their real size, the links more than once
    named = stored(roots.select("key").distinct())
    placed = _placed(items, named, keep)
    inner = _inner(placed, named)
    below = named.select(F.col("key").alias("up"), F.col("key").alias("root"), F.lit(0).alias("above"))
    below = below.unionByName(inner.select(F.col("key").alias("up"), "root", F.col("level").alias("above")))
    reached = placed.where("up is not null").join(below, "up").where("key <> root")
    level = (F.col("above") + 1).alias("level")
    if placed.where("n > 1").isEmpty():
        members = reached.select("root", "key", level, "is_parent", *keep)
        return members, placed.where("is_root").select(F.col("key").alias("root"), *keep)
    members = reached.select("root", "key", level).groupBy("root", "key").agg(F.min("level").alias("level"))
    kept = items.select("key", *keep)
    members = members.join(kept, "key").select("root", "key", "level", F.lit(True).alias("is_parent"), *keep) if keep else members
    return members, named.join(kept, "key").select(F.col("key").alias("root"), *keep)


def descendants(items: DataFrame, roots: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All items below each root: ``(root, key, level)``, each once at its first level.

    Items that have children climb to the first roots above them by pointer doubling, roots climb among themselves,
    and both are joined; so the rounds grow with the logarithm of the depth. Circles end. Every round
    is written to the shared checkpoint folder. All items take the roots of the places above them at last.
    With ``keep`` members also have these columns of their items, and ``is_parent`` where they may have children.
    """
    members, _ = _tree(items, roots, keep or [])
    return members.select("root", "key", "level", *([*keep, "is_parent"] if keep else []))


def depth(tree: DataFrame, items: DataFrame) -> DataFrame:
    """Depth of each root's tree along ``parent_key``: ``(root, hierarchy_depth)``.

    Items whose parent is not in the tree have depth 1, others one more than their parent; those in a
    circle have none. Found by pointer doubling inside each tree. A tree that has kept ``parent_key``
    needs no join with the items.
    """
    if not {"parent_key", "is_parent"} <= set(tree.columns):
        tree = tree.select("root", "key").join(items.select("key", "parent_key"), "key").withColumn("is_parent", F.lit(True))
    return _depth(stored(_folded(tree).distinct()))


def _folded(tree: DataFrame, *columns: str) -> DataFrame:
    """Members ``(root, key, up)`` with their parents; ``key`` is null for those without children, which no way up passes."""
    return tree.select("root", F.when(F.col("is_parent"), F.col("key")).alias("key"), F.col("parent_key").alias("up"), *columns)


def _depth(rows: DataFrame) -> DataFrame:
    """Depth of each root's tree from its members and their parents, ``(root, key, up)``."""
    inner = rows.where("key is not null")
    below = inner.where("up is not null and up <> ''")
    members = inner.select("root", F.col("key").alias("up"), F.lit(True).alias("open")).distinct()
    open_ = F.coalesce("open", F.lit(False)).alias("open")
    linked = below.join(members, ["root", "up"], "left").select("root", "key", "up", F.lit(1).alias("steps"), open_)
    top = inner.where("up is null or up = ''").select("root", "key", "up", F.lit(1).alias("steps"), F.lit(False).alias("open"))
    found = _climbed(stored(linked.unionByName(top)), ["root"]).groupBy("root", "key").agg(F.max("steps").alias("steps"))
    # members without children are one deeper than their parent, which has no depth in a circle
    ends = rows.where("key is null").select("root", "up").distinct()
    parents = inner.select("root", "key").distinct().join(found, ["root", "key"], "left")
    parents = parents.select("root", F.col("key").alias("up"), F.lit(True).alias("inside"), "steps")
    steps = F.when(F.col("inside"), F.col("steps") + 1).otherwise(1).alias("steps")
    ends = ends.join(parents, ["root", "up"], "left").select("root", steps).where("steps is not null")
    return found.select("root", "steps").unionByName(ends).groupBy("root").agg(F.max("steps").alias("hierarchy_depth"))


def is_done(status="status"):
    return F.lower(status).isin(DONE)


def completion(tree: DataFrame, items: DataFrame, roots: DataFrame) -> DataFrame:
    """Share of finished items among each root and its descendants, in percent."""
    members = tree.select("root", "key").unionByName(roots.select(F.col("key").alias("root"), "key").distinct())
    status = items.select("key", is_done().alias("done"))
    return (
        members.join(status, "key")
        .groupBy("root")
        .agg((100.0 * F.count_if("done") / F.count("*")).alias("completion_percentage"))
    )


def epic_tree(items: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per root: direct children, all descendants, total with the root, depth, completion."""
    members, own = _tree(items.select("key", "parent_key", "epic_key", is_done().alias("done")), roots, ["parent_key", "done"])
    folded = _folded(members, "level", "done").groupBy("root", "key", "up")
    rows = stored(
        folded.agg(
            F.count_if(F.col("level") == 1).alias("direct"), F.count("*").alias("n"), F.count_if("done").alias("done")
        )
    )
    counts = rows.groupBy("root").agg(
        F.sum("direct").alias("direct_children"), F.sum("n").alias("all_descendants"), F.sum("done").alias("finished")
    )
    own = own.select("root", "done")
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    finished = zero("finished") + F.col("done").cast("int")
    total = zero("all_descendants") + 1
    return (
        own.join(counts, "root", "left")
        .join(_depth(rows.select("root", "key", "up")), "root", "left")
        .select(
            "root",
            zero("direct_children").alias("direct_children"),
            zero("all_descendants").alias("all_descendants"),
            total.alias("total_items"),
            zero("hierarchy_depth", 1).alias("hierarchy_depth"),
            (100.0 * finished / total).alias("completion_percentage"),
        )
    )


def role(issue_type="issue_type"):
    low = F.lower(issue_type)
    expr = None
    for name, types in ROLES.items():
        expr = F.when(low.isin(types), name) if expr is None else expr.when(low.isin(types), name)
    return expr


def epic_hierarchy(items: DataFrame, epics: DataFrame) -> DataFrame:
    """Stories, tasks and sub-tasks per epic; other child types are not counted."""
    children = epic_children(items, epics).select("epic", role().alias("role"))
    counts = [F.count_if(F.col("role") == r).alias(n) for r, n in zip(ROLES, ["stories", "tasks", "subtasks"])]
    out = epics.select(F.col("key").alias("epic")).distinct().join(children, "epic", "left").groupBy("epic").agg(*counts)
    return out.withColumn("total_items", F.col("stories") + F.col("tasks") + F.col("subtasks"))


def hierarchy_edges(items: DataFrame, epics: DataFrame) -> DataFrame:
    """Flat hierarchy ``(epic, key, role)`` of the counted child types."""
    return epic_children(items, epics).select("epic", "key", role().alias("role")).where("role is not null")


def shown_children(items: DataFrame, roots: DataFrame, k: int = MAX_SHOWN_CHILDREN) -> DataFrame:
    """The first ``k`` children by key of each root that is an epic: ``(root, i, child_key)``."""
    epics = roots.where(F.col("issue_type") == "Epic").select(F.col("key").alias("root"))
    w = Window.partitionBy("root").orderBy("child_key")
    children = items.select(F.col("epic_key").alias("root"), F.col("key").alias("child_key"))
    return children.join(epics, "root").withColumn("i", F.row_number().over(w)).where(F.col("i") <= k)


def context_tree(keys: DataFrame, items: DataFrame) -> DataFrame:
    """Root, its parent (epic first) and its shown children: one row per known key.

    ``child_keys`` holds at most 50 keys, the size of a context tree; ``total_items`` counts
    the root and all of its children.
    """
    roots = items.join(keys.select("key").distinct(), "key", "left_semi")
    up = F.coalesce(F.when(F.col("epic_key") != "", F.col("epic_key")), F.when(F.col("parent_key") != "", F.col("parent_key")))
    named = roots.select("key", "issue_type", up.alias("up"))
    known = items.select(F.col("key").alias("up"), F.lit(True).alias("known"))
    children = (
        shown_children(items, roots)
        .groupBy(F.col("root").alias("key"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "child_key"))), lambda c: c["child_key"]).alias("child_keys"))
    )
    epics = roots.where(F.col("issue_type") == "Epic").select("key")
    sizes = items.groupBy(F.col("epic_key").alias("key")).agg(F.count("*").alias("n")).join(epics, "key", "left_semi")
    return (
        named.join(known, "up", "left")
        .join(children, "key", "left")
        .join(sizes, "key", "left")
        .select(
            "key",
            "issue_type",
            F.when(F.col("known"), F.col("up")).alias("parent_context"),
            F.coalesce("child_keys", F.array().cast("array<string>")).alias("child_keys"),
            (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("total_items"),
        )
    )
