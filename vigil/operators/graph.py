"""Task-dependency analytics (G1-G7) over tasks (dag_id, task_id) and
edges (dag_id, child, parent).

Levels come from contraction and Kahn steps in turn, over weighted edges (how many levels the child lies
below the parent at least).  A task with one parent hangs on it: such tasks form a forest, pointer doubling
brings each to the foot of its tree in a number of rounds logarithmic in the tree's depth, and its own edges move there.
Parallel edges that this makes become one, so ladders of diamonds collapse as chains do.  A Kahn step then
settles the tasks whose parents all are settled.  What is left shrinks with every pass; contracted tasks get
their levels from their feet at the end.  Edge sets only shrink: no pair of tasks is ever made that was not
an edge or a pointer.  Every state is written to the shared checkpoint folder (``session.Rounds``); folders that
nothing reads any more are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.session import Rounds

KEY = ["dag_id", "task_id"]


def _edges(edges: DataFrame) -> DataFrame:
    # Duplicate entries in depends_on would count a parent twice; edges are a set.
    return edges.select("dag_id", "child", "parent").distinct()


def missing_parents(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: every edge whose parent is not a task of the same DAG."""
    t = tasks.select("dag_id", F.col("task_id").alias("parent"))
    return _edges(edges).join(t, ["dag_id", "parent"], "left_anti")


def _hanging(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame | None, Rounds, int]:
    """Tasks with one parent, brought to the foot of their tree by pointer doubling.

    Returns (resolved pointers, pointers that lead into a ring or None, their folder, rounds): (dag_id, task_id, foot, down).
    """
    state = Rounds(spark, "pointers")
    single = (edges.groupBy("dag_id", "child").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("foot"), F.first("down").alias("down"))
              .where("n = 1 AND foot <> child").select("dag_id", F.col("child").alias("task_id"), "foot", "down"))
    now, k = state.write(0, single), 0
    count = now.count()
    while count:
        onward = now.select("dag_id", F.col("task_id").alias("foot"), F.col("foot").alias("next"), F.col("down").alias("more"))
        moving = now.join(onward, ["dag_id", "foot"], "left")
        if moving.where("next IS NOT NULL").isEmpty():
            return now, None, state, k
        if 1 << k > count:  # longer than any tree: what still moves goes round
            return moving.where("next IS NULL").drop("next", "more"), moving.where("next IS NOT NULL").drop("next", "more"), state, k
        k += 1
        now = state.write(k, moving.select(*KEY, F.coalesce("next", "foot").alias("foot"), (F.col("down") + F.coalesce("more", F.lit(0))).alias("down")))
        state.drop(k - 2)
    return now, None, state, k


def dag_levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, task_id, level) for every task that can run; runs its rounds when called.

    level 1 = no parents; level k = 1 + the deepest parent.  Tasks on a cycle, below a
    cycle or waiting on a missing parent never become ready and are absent (see
    ``blocked_tasks``).
    """
    spark = tasks.sparkSession
    nodes = tasks.select(*KEY).distinct()
    own = nodes.select("dag_id", F.col("task_id").alias("child"))
    up = nodes.select("dag_id", F.col("task_id").alias("parent"), F.lit(True).alias("here"))
    left, settled, levels = Rounds(spark, "edges"), Rounds(spark, "settled"), Rounds(spark, "levels")
    # a task that waits for a missing parent waits for itself: it never settles
    known = _edges(edges).join(own, ["dag_id", "child"], "left_semi").join(up, ["dag_id", "parent"], "left")
    e = left.write(0, known.select("dag_id", F.when(F.col("here"), F.col("parent")).otherwise(F.col("child")).alias("parent"), "child",
                                   F.lit(1).alias("down")).distinct())
    roots = nodes.join(e.select("dag_id", F.col("child").alias("task_id")).distinct(), KEY, "left_anti")
    settled.write(0, roots.select(*KEY, F.lit(1).alias("level")))
    contracted, k = [], 0
    while not e.isEmpty():
        k += 1
        hang, rings, state, _ = _hanging(spark, e)
        contracted.append((hang, state))
        foot = hang.select("dag_id", F.col("task_id").alias("parent"), "foot", F.col("down").alias("more"))
        rest = e.join(hang.select("dag_id", F.col("task_id").alias("child")), ["dag_id", "child"], "left_anti")
        moved = rest.join(foot, ["dag_id", "parent"], "left").select(
            "dag_id", F.coalesce("foot", "parent").alias("parent"), "child", (F.col("down") + F.coalesce("more", F.lit(0))).alias("down"))
        if rings is not None:  # rings and what hangs on them wait for themselves
            stuck = rings.select("dag_id", F.col("task_id").alias("child"), F.lit(True).alias("stuck"))
            moved = moved.join(stuck, ["dag_id", "child"], "left").select(
                "dag_id", F.when(F.col("stuck"), F.col("child")).otherwise(F.col("parent")).alias("parent"), "child", "down")
        e = left.write(2 * k - 1, moved.groupBy("dag_id", "parent", "child").agg(F.max("down").alias("down")))
        # a Kahn step: parents that are settled are counted per child
        done = settled.all().drop("round").withColumnRenamed("task_id", "parent")
        ready = (e.join(done, ["dag_id", "parent"], "left").groupBy("dag_id", F.col("child").alias("task_id"))
                 .agg(F.max(F.col("level") + F.col("down")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
                 .where("all").select(*KEY, "level"))
        new = settled.write(k, ready)
        shrunk = hang.isEmpty()
        e = left.write(2 * k, e.join(new.select("dag_id", F.col("task_id").alias("child")), ["dag_id", "child"], "left_anti"))
        left.drop(2 * k - 2, 2 * k - 1)
        if shrunk and new.isEmpty():
            break
    now = levels.write(0, settled.all().drop("round"))
    for n, (hang, state) in enumerate(reversed(contracted), 1):
        at_foot = now.select("dag_id", F.col("task_id").alias("foot"), F.col("level").alias("above"))
        below = hang.join(at_foot, ["dag_id", "foot"]).select(*KEY, (F.col("above") + F.col("down")).alias("level"))
        now = levels.write(n, now.union(below))
        levels.drop(n - 1)
        state.drop_all()
    left.drop_all()
    settled.drop_all()
    return now.select(*KEY, F.col("level").cast("int").alias("level"))


def blocked_tasks(tasks: DataFrame, edges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Tasks that can never run: on a cycle, downstream of one, or waiting on a missing
    parent (what the rounds never reach)."""
    levels = dag_levels(tasks, edges) if levels is None else levels
    return tasks.select(*KEY).distinct().join(levels, KEY, "left_anti")


def _spread(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(dag_id, task_id, label): the smallest task that reaches each task along ``edges`` (a -> b).

    Only labels that improved in a round travel in the next; all are kept as rounds.
    """
    state = Rounds(tasks.sparkSession, "labels")
    now, k = state.write(0, tasks.select(*KEY, F.col("task_id").alias("label"))), 0
    while not now.isEmpty():
        k += 1
        reached = (edges.join(now.withColumnRenamed("task_id", "a"), ["dag_id", "a"])
                   .groupBy("dag_id", F.col("b").alias("task_id")).agg(F.min("label").alias("label")))
        best = state.all().groupBy(*KEY).agg(F.min("label").alias("best"))
        now = state.write(k, reached.join(best, KEY).where("label < best").select(*KEY, "label"))
    return state.all().groupBy(*KEY).agg(F.min("label").alias("label"))


def cycle_members(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, cycle, task_id) for every task that reaches itself; ``cycle`` is the smallest
    task of its strongly connected group.  Runs its rounds when called.

    Tasks without a cyclic past (levels) and without a cyclic future (levels of the reversed
    rest) are stripped.  In what is left, a task whose smallest reaching task and smallest
    reached task are the same one lies on a cycle with it; those groups leave and the rest is
    stripped again, until nothing is left.
    """
    spark = tasks.sparkSession
    nodes = tasks.select(*KEY).distinct()
    own = nodes.withColumnRenamed("task_id", "parent")
    inner = _edges(edges).join(own, ["dag_id", "parent"], "left_semi")
    inner = inner.join(nodes.withColumnRenamed("task_id", "child"), ["dag_id", "child"], "left_semi")
    inner = Rounds(spark, "inner").write(0, inner)
    out, left, late, k = Rounds(spark, "cycles"), Rounds(spark, "rest"), Rounds(spark, "late"), 0
    rest = left.write(0, nodes)
    found = out.write(0, nodes.where("false").select("dag_id", F.col("task_id").alias("cycle"), "task_id"))

    def among(kept):
        a = inner.join(kept.withColumnRenamed("task_id", "parent"), ["dag_id", "parent"], "left_semi")
        return a.join(kept.withColumnRenamed("task_id", "child"), ["dag_id", "child"], "left_semi")

    while True:
        past = late.write(k, blocked_tasks(rest, among(rest)))
        flipped = among(past).select("dag_id", F.col("parent").alias("child"), F.col("child").alias("parent"))
        k += 1
        rest = left.write(2 * k - 1, blocked_tasks(past, flipped))
        if rest.isEmpty():
            return out.all().drop("round")
        e = among(rest).persist()  # read in every round of the two spreads
        down = _spread(e.select("dag_id", F.col("parent").alias("a"), F.col("child").alias("b")), rest)
        up = _spread(e.select("dag_id", F.col("child").alias("a"), F.col("parent").alias("b")), rest)
        both = down.join(up.withColumnRenamed("label", "reached"), KEY)
        loops = e.where("parent = child").select("dag_id", F.col("child").alias("task_id"), F.lit(True).alias("loop")).distinct()
        group = both.where("label = reached").join(loops, KEY, "left")
        several = group.groupBy("dag_id", F.col("label").alias("cycle")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.coalesce("loop", F.lit(False))).alias("loop")).where("n > 1 OR loop")
        found = out.write(k, group.select("dag_id", F.col("label").alias("cycle"), "task_id")
                          .join(several, ["dag_id", "cycle"], "left_semi"))
        rest = left.write(2 * k, rest.join(group, KEY, "left_anti"))
        e.unpersist()
        if rest.isEmpty():
            return out.all().drop("round")


def level_widths(levels: DataFrame) -> DataFrame:
    """G4 groups: (dag_id, level, width)."""
    return levels.groupBy("dag_id", "level").agg(F.count(F.lit(1)).alias("width"))


def dag_resolution(levels: DataFrame) -> DataFrame:
    """G3/G4 summary per DAG: tasks ordered, depth, max_width, can_parallelize.

    The topological order itself is ``levels.orderBy('dag_id', 'level', 'task_id')``.
    """
    w = level_widths(levels)
    return w.groupBy("dag_id").agg(
        F.sum("width").cast("bigint").alias("task_count"), F.max("level").alias("depth"),
        F.max("width").alias("max_width"), (F.max("width") > 1).alias("can_parallelize"))


def topological_order(levels: DataFrame) -> DataFrame:
    """A valid, deterministic linear order — tasks sorted by (dag_id, level, task_id).

    A global ``orderBy`` is range-partitioned from a sample of the keys, so one very large
    DAG is spread over many partitions (no per-DAG window that would put it in one task).
    Every parent has a smaller level than its children, so the order is topological.
    """
    return levels.select("dag_id", "level", "task_id").orderBy("dag_id", "level", "task_id")


def critical_path(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per DAG the longest chain (ties: smallest chain) and its length; runs its rounds when called.

    Edges between neighbouring levels are kept, backwards from the deepest tasks, as long as they lead
    there; then the smallest task of level 1 on such a chain is followed by its smallest kept
    child, one task per DAG and level.  No task carries its chain.
    """
    spark = levels.sparkSession
    up = levels.select("dag_id", F.col("task_id").alias("parent"), F.col("level").alias("above"))
    tight = Rounds(spark, "tight").write(0, (
        _edges(edges).join(levels.withColumnRenamed("task_id", "child"), ["dag_id", "child"])
        .join(up, ["dag_id", "parent"]).where("above = level - 1").select("dag_id", "parent", "child", "level")))
    deepest = levels.groupBy("dag_id").agg(F.max("level").alias("depth"))
    ends = Rounds(spark, "ends").write(0, levels.join(deepest, "dag_id").where("level = depth").select(*KEY, "level"))
    depth = ends.agg(F.max("level")).first()[0] or 0
    kept, leads, on_path = Rounds(spark, "kept"), {}, ends.where(F.col("level") == depth).select(*KEY)
    for k in range(depth, 1, -1):
        leads[k] = kept.write(k, tight.where(F.col("level") == k).join(
            on_path.withColumnRenamed("task_id", "child"), ["dag_id", "child"], "left_semi").select("dag_id", "parent", "child"))
        on_path = (leads[k].select("dag_id", F.col("parent").alias("task_id")).distinct()
                   .union(ends.where(F.col("level") == k - 1).select(*KEY)))
    chain = Rounds(spark, "chain")
    chosen = chain.write(1, on_path.groupBy("dag_id").agg(F.min("task_id").alias("task_id")))
    for k in range(2, depth + 1):
        chosen = chain.write(k, leads[k].join(chosen.withColumnRenamed("task_id", "parent"), ["dag_id", "parent"])
                             .groupBy("dag_id").agg(F.min("child").alias("task_id")))
    steps = chain.all().groupBy("dag_id").agg(F.sort_array(F.collect_list(F.struct("round", "task_id"))).alias("steps"))
    return steps.select("dag_id", F.array_join("steps.task_id", ">").alias("critical_path"),
                        F.size("steps").alias("critical_path_length"))


def adjacency(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per task n_parents and n_children (depends_on / depended_by sizes)."""
    e = _edges(edges)
    up = e.groupBy("dag_id", F.col("child").alias("task_id")).agg(F.count(F.lit(1)).alias("n_parents"))
    down = e.groupBy("dag_id", F.col("parent").alias("task_id")).agg(F.count(F.lit(1)).alias("n_children"))
    out = tasks.select("dag_id", "task_id").distinct().join(up, ["dag_id", "task_id"], "left") \
               .join(down, ["dag_id", "task_id"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("dag_id", "task_id", z("n_parents"), z("n_children"))


def dependency_tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """G6 tree: (dag_id, root, task_id, depth) for everything that depends on the requested
    ``roots`` (dag_id, root), with the smallest number of steps; runs its rounds when called.
    A root on a cycle is not listed under itself."""
    state = Rounds(edges.sparkSession, "tree")
    e = _edges(edges).persist()
    now = state.write(0, roots.select("dag_id", "root", F.col("root").alias("task_id")).distinct())
    k = 0
    while not now.isEmpty():
        k += 1
        step = (now.withColumnRenamed("task_id", "parent").join(e, ["dag_id", "parent"])
                .select("dag_id", "root", F.col("child").alias("task_id")).distinct())
        now = state.write(k, step.join(state.all().drop("round"), ["dag_id", "root", "task_id"], "left_anti"))
    e.unpersist()
    return state.all().where("round > 0").withColumnRenamed("round", "depth")


def children(edges: DataFrame) -> DataFrame:
    """G6 detail: (dag_id, parent, child) rows — the depended_by lists in tidy form."""
    return _edges(edges).select("dag_id", "parent", "child")


def dag_summary(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per DAG task_count, edge_count, root_count, leaf_count."""
    adj = adjacency(tasks, edges)
    return adj.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("task_count"), F.sum("n_parents").cast("bigint").alias("edge_count"),
        F.count_if(F.col("n_parents") == 0).alias("root_count"),
        F.count_if(F.col("n_children") == 0).alias("leaf_count"))
