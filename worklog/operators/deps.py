"""Task dependencies: summaries, readiness and cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklog.operators.components import parts
from worklog.sources.shared import stored

#: Rounds after which the pairs seen so far become one table again.
MERGE_EVERY = 8
#: Edges that a round goes at most, and ways for each edge that are worth it.
HOPS, WAYS = 8, 10
#: Rounds after which levels are taken as they are.
LEVEL_ROUNDS = 32
#: Edges and candidates of a connected part that is judged as one row; larger parts are walked in rounds.
GROUPED = 256
PAIR = ["project_id", "task_id", "prerequisite_task_id"]


def dependency_summary(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Per task depends_on and blocks: sorted lists of (id, title, status, kind)."""
    task = tasks.select("project_id", F.col("id").alias("_id"), "title", "status")

    def side(own: str, other: str, name: str) -> DataFrame:
        rows = deps.select("project_id", F.col(own).alias("task"), F.col(other).alias("_id"), "kind").join(task, ["project_id", "_id"])
        return rows.groupBy("project_id", "task").agg(F.sort_array(F.collect_list(F.struct(F.col("_id").alias("id"), "title", "status", "kind"))).alias(name))

    ids = tasks.select("project_id", F.col("id").alias("task"))
    rows = ids.join(side("task_id", "prerequisite_task_id", "depends_on"), ["project_id", "task"], "left").join(side("prerequisite_task_id", "task_id", "blocks"), ["project_id", "task"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<id:string,title:string,status:string,kind:string>>")).alias(c)
    return rows.select("project_id", F.col("task").alias("id"), empty("depends_on"), empty("blocks"))


def incomplete_prerequisites(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """project_id, task_id, prerequisite_task_id, status of strong prerequisites neither completed nor cancelled."""
    open_tasks = tasks.filter("status NOT IN ('completed', 'cancelled')").select("project_id", F.col("id").alias("prerequisite_task_id"), "status")
    return deps.filter("kind = 'strong'").select("project_id", "task_id", "prerequisite_task_id").join(open_tasks, ["project_id", "prerequisite_task_id"])


def propagate_unblocked(tasks: DataFrame, deps: DataFrame, completed: DataFrame) -> DataFrame:
    """project_id, id, status, unblocked_by: planned tasks without owner that become ready once the given tasks
    (project_id, id) are completed. Of several unblockers the last by id is named."""
    done = completed.select("project_id", F.col("id").alias("prerequisite_task_id")).distinct()
    now = tasks.join(completed.select("project_id", "id", F.lit(True).alias("_done")).distinct(), ["project_id", "id"], "left").withColumn("status", F.when(F.col("_done"), "completed").otherwise(F.col("status")))
    touched = deps.filter("kind = 'strong'").join(done, ["project_id", "prerequisite_task_id"]).groupBy("project_id", F.col("task_id").alias("id")).agg(F.max("prerequisite_task_id").alias("unblocked_by"))
    waiting = incomplete_prerequisites(deps, now).select("project_id", F.col("task_id").alias("id")).distinct()
    free = tasks.filter("status = 'planned' AND owner_agent_id IS NULL").select("project_id", "id")
    return free.join(touched, ["project_id", "id"]).join(waiting, ["project_id", "id"], "left_anti").select("project_id", "id", F.lit("ready").alias("status"), "unblocked_by")


def demote_on_new_dependency(tasks: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Tasks with status planned where a new strong edge leads from a ready task without owner to one not completed."""
    unfinished = tasks.filter("status <> 'completed'").select("project_id", F.col("id").alias("prerequisite_task_id"))
    hit = new_edges.filter("kind = 'strong'").join(unfinished, ["project_id", "prerequisite_task_id"], "left_semi").select("project_id", F.col("task_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    demoted = F.col("_hit") & (F.col("status") == "ready") & F.col("owner_agent_id").isNull()
    return tasks.join(hit, ["project_id", "id"], "left").withColumn("status", F.when(demoted, "planned").otherwise(F.col("status"))).select(*tasks.columns)


def would_cycle(edges: DataFrame, candidates: DataFrame, walked: list[int] | None = None) -> DataFrame:
    """Add verdict to candidate edges (project_id, task_id, prerequisite_task_id): self_dependency, cycle or ok.

    A candidate closes a cycle if its prerequisite already reaches its task. All kinds of edge count, and each candidate is
    judged by the edges alone; see would_cycle_in_order for candidates that see those before them.

    A candidate that leads from one connected part of the edges to another is ok. Parts of at most ``GROUPED`` edges and
    candidates are gathered, each as a row, and judged there. The others are judged by rounds of joins:

    1. Candidates whose task nothing leads to or whose prerequisite leads nowhere are ok.
    2. Tasks get levels: an edge leads to a lower level, but for some exceptions if the edges have cycles of their own or
       very long ways. So a prerequisite reaches its task only from a higher level, or if it reaches an exception; the
       others are ok.
    3. For what is left a frontier of (start, task) pairs, one for all candidates with that prerequisite, walks the edges
       until it is empty. Pairs below the levels of all the start's open goals, pairs seen before, and starts whose
       candidates are all closed go no further. Each round goes up to ``HOPS`` edges, as long as those ways are not many
       more than the edges.

    walked, if given, takes the number of pairs of each round.
    """
    links = stored(_different(edges).select(*PAIR, F.lit(None).cast("int").alias("_turn")).distinct(), "edges")
    asked = _different(candidates).select(*PAIR, F.lit(1).alias("_turn")).distinct()
    small, large = _dealt(links.unionByName(asked), links)
    closing = _judged(small).select(*PAIR)
    if large is not None:
        closing = closing.unionByName(_walked(large.filter("_turn IS NULL"), large.filter("_turn = 1"), walked))
    verdict = F.when(F.col("task_id") == F.col("prerequisite_task_id"), "self_dependency").otherwise(F.coalesce("_v", F.lit("ok")))
    return candidates.join(closing.withColumn("_v", F.lit("cycle")), PAIR, "left").withColumn("verdict", verdict).select(*candidates.columns, "verdict")


def _different(pairs: DataFrame) -> DataFrame:
    return pairs.filter("project_id IS NOT NULL AND task_id <> prerequisite_task_id")


def _dealt(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows both ends of which are in the same connected part of the links: those of parts of at most ``GROUPED`` rows,
    with their _part, and the others, if there are any."""
    node = lambda c: F.xxhash64("project_id", c)
    part = parts(links.select(node("task_id").alias("_a"), node("prerequisite_task_id").alias("_b")))
    inside = rows.withColumns({"_node": node("task_id"), "_far": node("prerequisite_task_id")}).join(part, "_node")
    if rows is not links:
        inside = inside.join(part.select(F.col("_node").alias("_far"), F.col("_part").alias("_far_part")), "_far").filter("_part = _far_part")
    dealt = stored(inside.select(*rows.columns, "_part"), "dealt-edges")
    keys = ["project_id", "_part"]
    large = stored(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUPED).select(*keys), "large-parts")
    if large.isEmpty():
        return dealt, None
    return dealt.join(large, keys, "left_anti"), stored(dealt.join(large, keys, "left_semi").drop("_part"), "large-edges")


def _judged(rows: DataFrame) -> DataFrame:
    """The candidates (pair, _turn) that close a cycle among the rows of their _part.

    Rows without a turn are edges. Candidates of a turn see these and what was accepted in earlier turns; so candidates of
    one turn only are judged by the edges alone.
    """
    keys = ["project_id", "_part"]
    place = F.when(F.col("_turn").isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy("_turn"))).otherwise(0)
    grouped = rows.withColumn("_place", place).groupBy(*keys).agg(F.collect_list(F.struct(*PAIR, "_turn", "_place")).alias("_rows"))
    return grouped.select("_rows").mapInArrow(_closing_rows, rows.select(*PAIR, "_turn").schema)


def _closing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list of rows those that close a cycle."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        ends = pa.concat_arrays([flat.field("task_id"), flat.field("prerequisite_task_id")]).dictionary_encode().indices.to_numpy()
        place = flat.field("_place").to_numpy()
        closing, begin = [], 0
        for n in lists.value_lengths().to_pylist():
            end = begin + n
            closing += [begin + k for k in _closing(ends[begin:end].tolist(), ends[len(flat) + begin : len(flat) + end].tolist(), place[begin:end].tolist())]
            begin = end
        found = flat.take(pa.array(closing, pa.int64()))
        yield pa.RecordBatch.from_arrays([found.field(c) for c in (*PAIR, "_turn")], [*PAIR, "_turn"])


def _closing(tasks: list[int], before: list[int], places: list[int]) -> list[int]:
    """Numbers of the candidates, in the order of their places, whose prerequisite reaches their task; place 0 is an edge."""
    ahead: dict[int, list[int]] = {}
    closing, accepted, reached, last = [], [], {}, 0
    for k in sorted(range(len(tasks)), key=places.__getitem__):
        if places[k] != last:
            for j in accepted:
                ahead.setdefault(tasks[j], []).append(before[j])
            accepted, reached, last = [], {}, places[k]
        if last:
            start = before[k]
            if start not in reached:
                seen, todo = {start}, [start]
                while todo:
                    new = {n for n in ahead.get(todo.pop(), ()) if n not in seen}
                    seen |= new
                    todo += new
                reached[start] = seen
            if tasks[k] in reached[start]:
                closing.append(k)
                continue
        accepted.append(k)
    return closing


def _walked(edges: DataFrame, candidates: DataFrame, walked: list[int] | None = None) -> DataFrame:
    """The candidates (project_id, task_id, prerequisite_task_id) that close a cycle, by levels and walks; see would_cycle."""
    step = stored(edges.select("project_id", F.col("task_id").alias("_at"), F.col("prerequisite_task_id").alias("_next")), "steps")
    asked = candidates.select("project_id", F.col("prerequisite_task_id").alias("_start"), F.col("task_id").alias("_goal"))
    ways = _ways(step)
    levels = _levels(step, ways)
    # A task that no edge touches has no level: nothing leads to it and it leads nowhere.
    met = asked.join(levels.select("project_id", F.col("_at").alias("_start"), F.col("_level").alias("_from"), F.col("_odd").alias("_odd")), ["project_id", "_start"])
    met = met.join(levels.select("project_id", F.col("_at").alias("_goal"), F.col("_level").alias("_to")), ["project_id", "_goal"])
    live = stored(met.filter("_from > _to OR _odd").select("project_id", "_start", "_goal", "_to"), "live-candidates")
    frontier = stored(live.groupBy("project_id", "_start").agg(F.min("_to").alias("_lowest")).select("project_id", "_start", F.col("_start").alias("_at"), F.lit(False).alias("_hit"), "_lowest"), "frontier")
    seen, hits = [frontier.drop("_lowest")], []
    goals = live.select("project_id", "_start", F.col("_goal").alias("_at"), F.lit(True).alias("_hit"))
    while not frontier.isEmpty():
        ahead = frontier.join(ways, ["project_id", "_at"]).select("project_id", "_start", F.col("_next").alias("_at"), "_lowest").distinct()
        near = ahead.join(levels, ["project_id", "_at"]).filter("_level >= _lowest OR _odd").select("project_id", "_start", "_at")
        fresh = near.join(reduce(DataFrame.unionByName, seen).drop("_hit"), ["project_id", "_start", "_at"], "left_anti")
        found = stored(fresh.join(goals, ["project_id", "_start", "_at"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))), "frontier")
        if walked is not None:
            walked.append(found.count())
        seen.append(found)
        hits.append(found.filter("_hit").select("project_id", "_start", F.col("_at").alias("_goal")))
        if len(seen) > MERGE_EVERY:
            seen, hits = [stored(reduce(DataFrame.unionByName, seen), "seen")], [stored(reduce(DataFrame.unionByName, hits), "closed")]
        waiting = live.join(reduce(DataFrame.unionByName, hits), ["project_id", "_start", "_goal"], "left_anti")
        frontier = found.join(waiting.groupBy("project_id", "_start").agg(F.min("_to").alias("_lowest")), ["project_id", "_start"])
    empty = edges.sparkSession.createDataFrame([], live.drop("_to").schema)
    return reduce(DataFrame.unionByName, hits, empty).select("project_id", F.col("_goal").alias("task_id"), F.col("_start").alias("prerequisite_task_id")).distinct()


def _ways(step: DataFrame) -> DataFrame:
    """The ways of a few edges and the length of each."""
    return _doubled(step.withColumn("_length", F.lit(1)), lambda own, onward: own + onward, F.max)


def _doubled(ways: DataFrame, along: Callable[[Column, Column], Column], best: Callable[[Column], Column]) -> DataFrame:
    """Ways of at most ``HOPS`` edges, doubled while they are at most ``WAYS`` times as many as the edges they begin as.

    along gives the value of two ways, one after the other; best chooses among the values of ways with the same ends.
    """
    hops, n = 1, ways.count()
    values = [c for c in ways.columns if c not in ("project_id", "_at", "_next")]
    while hops < HOPS and n:
        onward = ways.select("project_id", F.col("_at").alias("_next"), F.col("_next").alias("_far"), *[F.col(c).alias(f"{c}_onward") for c in values])
        twice = ways.join(onward, ["project_id", "_next"]).select("project_id", "_at", F.col("_far").alias("_next"), *[along(F.col(c), F.col(f"{c}_onward")).alias(c) for c in values])
        longer = stored(ways.unionByName(twice).groupBy("project_id", "_at", "_next").agg(*[best(F.col(c)).alias(c) for c in values]), "ways")
        hops *= 2
        if longer.count() > WAYS * n:
            break
        ways = longer
    return ways


def _levels(step: DataFrame, ways: DataFrame) -> DataFrame:
    """project_id, _at, _level and _odd of each end of an edge: whether it reaches, or is at, an edge that does not lead to a lower level.

    A level is the length of the longest way from there. Tasks whose level still grows when as many grew as the round
    before are on cycles or lead to some, and after ``LEVEL_ROUNDS`` rounds on very long ways: edges among them stay exceptions.
    """
    ends = step.select("project_id", F.explode(F.array("_at", "_next")).alias("_at")).distinct()
    levels, grown, last = stored(ends.withColumns({"_level": F.lit(0), "_grew": F.lit(True)}), "levels"), None, None
    for _ in range(LEVEL_ROUNDS):
        lower = levels.filter("_grew").select("project_id", F.col("_at").alias("_next"), "_level")
        above = ways.join(lower, ["project_id", "_next"]).groupBy("project_id", "_at").agg(F.max(F.col("_level") + F.col("_length")).alias("_new"))
        higher = F.coalesce(F.col("_new") > F.col("_level"), F.lit(False))
        levels = stored(levels.join(above, ["project_id", "_at"], "left").select("project_id", "_at", F.when(higher, F.col("_new")).otherwise(F.col("_level")).alias("_level"), higher.alias("_grew")), "levels")
        grown = levels.filter("_grew").count()
        if not grown or grown == last:
            break
        last = grown
    levels = levels.drop("_grew")
    if not grown:
        return levels.withColumn("_odd", F.lit(False))
    side = lambda end, name: levels.select("project_id", F.col("_at").alias(end), F.col("_level").alias(name))
    flat = step.join(side("_at", "_above"), ["project_id", "_at"]).join(side("_next", "_below"), ["project_id", "_next"]).filter("_above <= _below")
    odd = frontier = stored(flat.select("project_id", "_at").distinct(), "odd")
    back = ways.select("project_id", F.col("_next").alias("_at"), F.col("_at").alias("_before"))
    while not frontier.isEmpty():
        frontier = stored(frontier.join(back, ["project_id", "_at"]).select("project_id", F.col("_before").alias("_at")).distinct().join(odd, ["project_id", "_at"], "left_anti"), "odd-frontier")
        odd = stored(odd.unionByName(frontier), "odd")
    return stored(levels.join(odd.withColumn("_odd", F.lit(True)), ["project_id", "_at"], "left").withColumn("_odd", F.coalesce("_odd", F.lit(False))), "levels")


def would_cycle_in_order(edges: DataFrame, candidates: DataFrame, order: str) -> DataFrame:
    """Add verdict to candidates as if they were added one by one, in the order of a column: each sees those accepted before it.

    Candidates with equal places in the order do not see each other; one that repeats an edge is judged like the first.

    Candidates without a place are taken as edges. Connected parts of at most ``GROUPED`` edges and candidates are gathered,
    each as a row, and judged there. In the others an edge that is on no cycle of edges and candidates together decides
    nothing, so only those on some cycle are looked at, and parts that became small are gathered, too. What is left goes
    in rounds: each walks from every open candidate over the edges before it; one that gets to its task over accepted edges
    alone closes a cycle, and one that does not get there even over open ones is ok. A round settles at least the first
    open candidate of each cycle.
    """
    none = F.lit(None).cast(candidates.schema[order].dataType)
    rows = _different(edges).select(*PAIR, none.alias("_turn")).unionByName(_different(candidates).select(*PAIR, F.col(order).alias("_turn")))
    rows = stored(rows.distinct(), "ordered-edges")
    small, large = _dealt(rows, rows)
    closing = [_judged(small)]
    if large is not None:
        both = large.select(*PAIR).distinct()
        inside = stored(large.join(_walked(both, both), PAIR, "left_semi"), "edges-on-cycles")
        small, large = _dealt(inside, inside)
        closing.append(_judged(small))
    if large is not None:
        closing += _in_rounds(large)
    closed = reduce(DataFrame.unionByName, closing).withColumns({order: F.col("_turn"), "_v": F.lit("cycle")}).drop("_turn")
    verdict = F.when(F.col("task_id") == F.col("prerequisite_task_id"), "self_dependency").otherwise(F.coalesce("_v", F.lit("ok")))
    return candidates.join(closed, [*PAIR, order], "left").withColumn("verdict", verdict).select(*candidates.columns, "verdict")


def _in_rounds(rows: DataFrame) -> list[DataFrame]:
    """The candidates (rows with a _turn) of each round that close a cycle; see would_cycle_in_order."""
    waiting, accepted, closing = rows.filter("_turn IS NOT NULL"), [rows.filter("_turn IS NULL").withColumn("_open", F.lit(False))], []
    while not waiting.isEmpty():
        steps = stored(reduce(DataFrame.unionByName, accepted).unionByName(waiting.withColumn("_open", F.lit(True))), "ordered-steps")
        judged = stored(waiting.join(_reached(steps, waiting), [*PAIR, "_turn"], "left"), "judged")
        closing.append(judged.filter("NOT _over_open").select(*PAIR, "_turn"))
        accepted.append(judged.filter("_over_open IS NULL").select(*PAIR, "_turn", F.lit(False).alias("_open")))
        waiting = judged.filter("_over_open").select(*PAIR, "_turn")
    return closing


def _reached(steps: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates whose prerequisite reaches their task over steps before them, and whether only _over_open ones.

    A way is open to all candidates after its last turn. Of all ways between two ends, the least last turn counts
    (``_any``), and that of ways without open steps (``_sure``); so ways of several steps are gone at once. An edge that is
    there from the start has place 0, one that has a turn place 1, and what is never there place 2.
    """
    key = ["project_id", "task_id", "prerequisite_task_id", "_turn"]
    place = lambda n, turn: F.struct(n.cast("int").alias("place"), turn.alias("turn"))
    since = place(F.col("_turn").isNotNull(), F.col("_turn"))
    never = place(F.lit(2), F.lit(None).cast(steps.schema["_turn"].dataType))
    single = steps.select("project_id", F.col("task_id").alias("_at"), F.col("prerequisite_task_id").alias("_next"), since.alias("_any"), F.when(F.col("_open"), never).otherwise(since).alias("_sure"))
    ways = _doubled(stored(single.groupBy("project_id", "_at", "_next").agg(F.min("_any").alias("_any"), F.min("_sure").alias("_sure")), "ordered-ways"), F.greatest, F.min)
    own = place(F.lit(1), F.col("_turn"))
    frontier = stored(candidates.select(*key, F.col("prerequisite_task_id").alias("_at"), F.lit(False).alias("_over_open")), "ordered-frontier")
    seen = [frontier]
    while not frontier.isEmpty():
        ahead = frontier.join(ways, ["project_id", "_at"]).filter(F.col("_any") < own)
        ahead = ahead.groupBy(*key, F.col("_next").alias("_at")).agg(F.min(F.col("_over_open") | (F.col("_sure") >= own)).alias("_over_open"))
        before = reduce(DataFrame.unionByName, seen).groupBy(*key, "_at").agg(F.min("_over_open").alias("_was"))
        better = ahead.join(before, [*key, "_at"], "left").filter("_was IS NULL OR (_was AND NOT _over_open)").drop("_was")
        frontier = stored(better, "ordered-frontier")
        seen.append(frontier)
        if len(seen) > MERGE_EVERY:
            seen = [stored(reduce(DataFrame.unionByName, seen), "ordered-seen")]
    return reduce(DataFrame.unionByName, seen).filter("_at = task_id").groupBy(*key).agg(F.min("_over_open").alias("_over_open"))
