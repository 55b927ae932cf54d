"""Mixing sources to target weights by weighted fair queueing.

Targets: each source gets its weight's share of the budget, but not more than a
multiple of its own size; what is over is shared again. Every document, in a fixed
shuffled order within its source, gets a virtual finish time: the source's
tokens up to and with it, divided by the source's target. All documents (each as often as the
cap allows) are range-sorted by finish time and cut where the tokens reach the budget.

Running sums over a source never meet in one task: a source's shuffled order is
cut into buckets by hash, sums of buckets are prefixed, and only a bucket's rows are
summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_scan, stored, unshielded, word_count

#: Rows that a bucket of the shuffled order holds on average, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order given, without a single task that sorts it all."""
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    offsets = parts.groupBy("_part").count().withColumn("_start", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(offsets.select("_part", "_start"), "_part").withColumn("rank", F.col("_start") + F.col("_inside") - 1).drop("_part", "_start", "_inside")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> tuple[DataFrame, float]:
    """sizes: source, source_size -> the same with target; and the budget.

    Sources by code point, null last, get ``weights`` in turn. A round caps every source
    whose share exceeds its cap and shares the rest anew, until none is above.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stored(ranked(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", w.alias("weight")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    full = F.lit(False)
    while True:
        row = s.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("long")).alias("n")
        ).first()
        if not row["open"] or row["n"] == capped:
            break
        capped, level = row["n"], (budget - most * row["full"]) / row["open"]
        full = most * F.col("source_size") < level * F.col("weight")
    cap = most * F.col("source_size")
    return s.withColumn("target", F.when(full, cap).otherwise(F.least(cap, level * F.col("weight"))).cast("double")), budget


def _key(doc_id: Column, seed: str) -> Column:
    """What orders a source's rows, shuffled."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def walked(docs: DataFrame, with_targets: DataFrame, buckets: int, seed: str) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target, _key and _upto: the source's tokens up to and with the row, in shuffled order."""
    keyed = docs.withColumn("_key", _key(F.col("doc_id"), seed))
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)
    keyed = keyed.withColumn("_bucket", F.floor(place).cast("int"))
    each = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(F.col("source").alias("_source"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    starts = stored(starts, "mix-starts")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumn("_run", F.sum("size").over(inside))
    t = with_targets.select(F.col("source").alias("_name"), "source_size", "target")
    return (
        run.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
        .join(t, F.col("source").eqNullSafe(F.col("_name")))
        .withColumn("_upto", F.col("_start") + F.col("_run"))
        .drop("_source", "_at", "_start", "_name", "_run", "_bucket")
    )


def _finish(epoch: int) -> Column:
    """Virtual finish time of a row's copy: tokens of the source served by then, over its target."""
    served = (F.lit(epoch) * F.col("source_size") + F.col("_upto")).cast("double")
    return F.coalesce(F.try_divide(served, F.col("target")), F.lit(0.0))


def _cut(slim: DataFrame, budget: float, epochs: int) -> tuple | None:
    """The last (finish, key, doc_id, size) within the budget in the global order, or None if none is."""
    order = ["finish", "_key", "doc_id", "size"]
    copies = slim.select("_key", "doc_id", "size", F.explode(F.array(*[_finish(e) for e in range(epochs)])).alias("finish"))
    queue = stored(copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "mix-queue")
    upto = queue.groupBy("_part").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("_part")))
    upto = stored(upto, "mix-parts")
    over = upto.where(F.col("upto") > budget).orderBy("_part").first()
    if over is None:
        row = queue.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
        return None if row is None else tuple(row)
    # Only the range partition that the budget ends in is summed row by row.
    cut = queue.where(F.col("_part") == over["_part"])
    running = F.sum("size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    inside = cut.withColumn("run", running).where(F.col("run") + (over["upto"] - over["n"]) <= budget)
    earlier = queue.where(F.col("_part") < over["_part"])
    row = inside.agg(F.max(F.struct(*order)).alias("m")).first()["m"] or earlier.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    return None if row is None else tuple(row)


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """docs: doc_id, source, text -> doc_id, size, source_size, target, taken, times, source and the columns of ``keep``, which are written between steps: keep what is small.

    * size counts words; a null text has none. A null source is a source, after all others.
    * taken is times * size. Documents without words never use budget; they are taken once.
    * Rows that repeat an id are separate rows, ordered by size. An empty table gives no rows.
    * The order of a source depends on ids and ``seed`` alone, so reruns agree.
    """
    columns = ["doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")]]
    sized = docs.select(*[F.col(f"`{c}`") for c in columns], word_count(F.col("text")).alias("size"))
    sized = stored(sized, "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_source = stored(by_source, "mix-by-source")
    rows = by_source.agg(F.sum("rows")).first()[0] or 0
    with_targets, budget = targets(by_source.drop("rows"), weights, share, float(epochs))
    run = walked(sized, stored(with_targets, "mix-targets"), max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)), seed)
    run = stored(run, "mix-walk")
    cut = _cut(run.select("_key", "doc_id", "size", "_upto", "source_size", "target"), budget, epochs)
    if cut is None:
        return run.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("times"), *columns[1:])
    kinds = ("double", "string", "long", "long")
    last = F.struct(*[F.lit(x).cast(t) for x, t in zip(cut, kinds, strict=True)])
    within = [(F.struct(_finish(e), F.col("_key"), F.col("doc_id").cast("long"), F.col("size")) <= last).cast("int") for e in range(epochs)]
    times = within[0]
    for x in within[1:]:
        times = times + x
    times = F.when(F.col("size") == 0, 1).otherwise(times)
    return run.withColumn("times", times).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", *columns[1:])


def _place(size: Column) -> Column:
    return F.struct("_key", F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))


def thresholds(run: DataFrame, epochs: int) -> DataFrame:
    """source, t1, t2, ...: the last (_key, doc_id, size) of a source that is taken at least once, twice, ...

    In a source's order finish times rise, so what is taken so often is all up to there. run: source, _key, doc_id, size, times.
    """
    last = [F.max(F.when((F.col("times") >= k) & (F.col("size") > 0), _place(F.col("size")))).alias(f"t{k}") for k in range(1, epochs + 1)]
    return run.groupBy("source").agg(*last)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "") -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken.

    How often is decided on ids and sizes alone. A source's taken rows are those up to a place in its order, so each text is held against its source's
    thresholds where it lies, and no text is shuffled. Only where rows that are equal in id and size stand on both sides of a threshold
    are rows told one by one, and joined to their texts by where they lie.
    """
    docs = as_scan(docs, "mix-docs")
    names = {c: c if c in ("doc_id", "source", "text") else f"_kept{i}" for i, c in enumerate(docs.columns)}
    where = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *where)
    run = stored(mix(rows, weights, share, epochs, seed, keep=["_file", "_row"]).withColumn("_key", _key(F.col("doc_id"), seed)), "mix-times")
    t = stored(thresholds(run, epochs), "mix-thresholds").withColumnRenamed("source", "_source")
    within = [F.coalesce(_place(F.col("size")) <= F.col(f"t{k}"), F.lit(False)) for k in range(1, epochs + 1)]
    wrong = F.lit(False)
    for k, inside in enumerate(within, 1):
        wrong = wrong | (inside & (F.col("size") > 0) & (F.col("times") < k))
    on = F.col("source").eqNullSafe(F.col("_source"))
    if run.join(t, on).where(wrong).isEmpty():
        empty = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        taken = rows.drop("_file", "_row").withColumn("_key", _key(F.col("doc_id"), seed)).join(t, on)
        own, times = F.struct("_key", F.col("doc_id").cast("long").alias("doc_id")), F.lit(0)
        for k in range(1, epochs + 1):
            last = F.struct(F.col(f"t{k}._key").alias("_key"), F.col(f"t{k}.doc_id").alias("doc_id"))
            # Sizes are counted anew only for rows with the id that a threshold ends with.
            tied = F.when(own.eqNullSafe(last), word_count(F.col("text")) <= F.col(f"t{k}.size")).otherwise(own < last)
            times = times + F.coalesce(tied, F.lit(False)).cast("int")
        taken = taken.withColumn("times", F.when(empty, 1).otherwise(times))
    else:
        taken = rows.join(run.where("times > 0").select("_file", "_row", "times"), ["_file", "_row"])
    copies = taken.where("times > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return unshielded(copies, names)
