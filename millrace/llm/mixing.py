"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w from a hash u of its row and its quality weight w. Within a source, documents in key
order are prefix-summed to the source's word budget; whole epochs come first, the rest is the prefix up to the budget.

The prefix sum is never made over a whole source. Keys fall into slices of equal width on a logarithmic scale, SLICES to a
factor of two: whatever the weights, a slice of relative width d holds a share of d / e of the documents at most, as x w
exp(-x w) never exceeds 1 / e. Slice totals are pre-aggregated, and only the slice in which a budget ends is sorted. A source's
selection is then one comparison with its last chosen key.

Edge cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; an empty table
gives an empty result; long texts are counted whole; a null id is an id like any other; rows that repeat as a whole share a
key, and if the budget ends among them, just as many of them are taken as bring the source nearest to its budget; extra
columns pass through ``mixed`` unchanged, whatever their names; null or non-positive quality weighs LEAST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, fresh, n_space_words, row_mark

SLICES = 1024
RUN = 128
MAX_COPIES = 3
MANY_SOURCES = 20_000
SEED = 20
LEAST = 0.01


def _key(mark: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), mark), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.greatest(F.coalesce(weight.cast("double"), F.lit(LEAST)), F.lit(LEAST))


def _slice(key: Column) -> Column:
    return F.floor(F.log2(key) * SLICES).cast("int")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes``: source, source_size. Adds target: weights repeat ``cycle`` in source order and share all words, at most MAX_COPIES x a source's size.

    The shares are the level L with sum(min(cap, L x weight)) = all words, found from prefix sums in order of cap / weight.
    There is one row for each source, so these windows hold no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, cycle)), F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("double")
    x = sizes.withColumn("w", w).withColumn("limit", (F.col("source_size") * MAX_COPIES).cast("double"))
    by = Window.orderBy((F.col("limit") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rest = F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("limit").over(by), F.lit(0.0))
    weights = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by), F.lit(0.0))
    x = x.withColumn("level", rest / weights).withColumn("rank", F.row_number().over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # in that order, the first source whose limit isn't below the level left for it and all later ones
    first = F.min(F.when(F.col("limit") / F.col("w") >= F.col("level"), F.struct("rank", "level"))).over(everything)
    x = x.withColumn("level", first["level"])
    return x.select("source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("w")), F.col("limit")).alias("target"))


def plan(keyed: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``keyed``: source, size, mark, key. One row per source: source, source_size, target, epochs; last (the greatest chosen (key,
    mark)) with ties and taken (how many rows have it, and how many of them are chosen); or edge (the slice before which all is chosen)."""
    slices = cut(keyed.groupBy("source", _slice(F.col("key")).alias("slice")).agg(F.sum("size").alias("words")))
    goal = cut(targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), cycle))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    g = goal.select(F.col("source").alias("s"), "rest")

    def up_to(by: str) -> Column:
        return F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # the slice in which the budget ends, first among runs of RUN slices, then in the run: no window holds all slices of a source
    run, ends_here = F.floor(F.col("slice") / RUN).alias("run"), (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    runs = slices.groupBy("source", run).agg(F.sum("words").alias("words")).withColumn("before", up_to("run"))
    runs = runs.join(g, F.col("source").eqNullSafe(F.col("s"))).where(ends_here).select("s", F.col("run").alias("in_run"), F.col("before").alias("run_before"), "rest")
    there = slices.withColumn("run", run).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("in_run")))
    ends = there.withColumn("before", F.col("run_before") + up_to("slice")).where(ends_here)
    ends = cut(ends.select("s", F.col("slice").alias("edge"), "before", "rest"))
    inside = keyed.where("size > 0").join(ends, F.col("source").eqNullSafe(F.col("s")) & (_slice(F.col("key")) == F.col("edge")))
    inside = inside.groupBy("source", "key", "mark", "size", "before", "rest").agg(F.count("*").alias("ties"))
    own = F.col("ties") * F.col("size")
    upto = F.col("before") + F.sum(own).over(Window.partitionBy("source").orderBy("key", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # of the rows in which the budget ends, as many as come nearest to it
    taken = F.least(F.col("ties"), F.floor((F.col("rest") - (upto - own)) / F.col("size") + 0.5)).cast("long")
    chosen = inside.withColumn("taken", taken).where("taken > 0")
    last = chosen.groupBy(F.col("source").alias("s2")).agg(F.max(F.struct("key", "mark", "ties", "taken")).alias("last"))
    # no document chosen in the slice itself: all slices before it are taken
    out = goal.join(ends.select("s", "edge"), F.col("source").eqNullSafe(F.col("s")), "left").join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
    return cut(out.select("source", "source_size", "target", "epochs", F.struct("last.key", "last.mark").alias("last"), "last.ties", "last.taken", F.when(F.col("last").isNull(), F.col("edge")).alias("edge")))


def _with_plan(rows: DataFrame, source: Column, planned: DataFrame, name: str) -> DataFrame:
    """Joins each row's source's plan as a struct ``name``; broadcast only if a count shows few sources."""
    side = planned.select(F.struct(*planned.columns).alias(name))
    if planned.count() <= MANY_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, source.eqNullSafe(F.col(name)["source"]), "left")


def _before_last(key: Column, mark: Column, p: Column) -> tuple[Column, Column]:
    """Whether a row comes before the last chosen one, and whether it ties with it."""
    same = key == p["last"]["key"]
    before = (key < p["last"]["key"]) | (same & (mark < p["last"]["mark"])) | (_slice(key) < p["edge"])
    return F.coalesce(before, F.lit(False)), F.coalesce(same & (mark == p["last"]["mark"]), F.lit(False))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per document: doc_id, source, size, mark (a hash of the row), key, source_size, target, copies, taken. ``quality``: weights from ``docs``, 1 by default."""
    weight = F.lit(1.0) if quality is None else quality
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_space_words(F.col(f"`{text}`")).alias("size"), row_mark(docs).alias("mark"), weight.alias("weight"))
    keyed = cut(sized.select("doc_id", "source", "size", "mark", _key(F.col("mark"), F.col("weight")).alias("key"), F.monotonically_increasing_id().alias("row")))
    joined = _with_plan(keyed, F.col("source"), plan(keyed, cycle), "plan")
    before, tie = _before_last(F.col("key"), F.col("mark"), F.col("plan"))
    joined = joined.withColumn("tie", tie & (F.col("plan.taken") < F.col("plan.ties")))
    # rows that repeat as a whole are numbered if only some of them are taken: within a task that wrote them, then across tasks
    ties = joined.where("tie").withColumn("task", F.shiftright("row", 33))
    tasks = ties.groupBy("source", "task").agg(F.count("*").alias("n"))
    tasks = tasks.select(F.col("source").alias("s"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"))
    number = F.row_number().over(Window.partitionBy("source", "task").orderBy("row"))
    ties = ties.withColumn("number", number).join(tasks, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))
    extra = ties.withColumn("extra", F.col("number") + F.col("n_before") <= F.col("plan.taken")).drop("task", "number", "s", "t", "n_before")
    both = joined.where(~F.col("tie")).withColumn("extra", before | tie).union(extra)
    copies = F.when(F.col("size") > 0, F.col("plan.epochs") + F.col("extra").cast("long")).otherwise(F.lit(0)).cast("long")
    return both.select("doc_id", "source", "size", "mark", "key", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, columns unchanged. Texts aren't shuffled if sources are few."""
    n, m, k, p, r = (fresh(docs.columns, f"__{x}") for x in ("size", "mark", "key", "plan", "copies"))
    weight = F.lit(1.0) if quality is None else quality
    rows = docs.withColumns({n: n_space_words(F.col(f"`{text}`")), m: row_mark(docs)}).withColumn(k, _key(F.col(m), weight))
    keyed = cut(rows.select(F.col(f"`{source}`").alias("source"), F.col(n).alias("size"), F.col(m).alias("mark"), F.col(k).alias("key")))
    joined = _with_plan(rows, F.col(f"`{source}`"), plan(keyed, cycle), p).where(F.col(n) > 0)
    before, tie = _before_last(F.col(k), F.col(m), F.col(p))
    own = [F.col(f"`{c}`") for c in docs.columns]

    def repeated(df: DataFrame, copies: Column) -> DataFrame:
        return df.withColumn(r, copies).where(F.col(r) > 0).withColumn(r, F.explode(F.sequence(F.lit(1).cast("long"), F.col(r)))).select(*own)

    out = repeated(joined, F.col(p)["epochs"] + before.cast("long"))
    # rows that tie with the last chosen one are equal: one of them stands for as many as are chosen
    return out.unionAll(repeated(joined.where(tie).dropDuplicates([m]), F.col(p)["taken"]))
