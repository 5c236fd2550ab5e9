"""Training-data shapes and training metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import written


def framed(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    """begin + ids + end; -1 falls back to 1 and 2, None leaves it out."""
    front = [] if bos is None else [F.array(F.lit(1 if bos < 0 else bos))]
    back = [] if eos is None else [F.array(F.lit(2 if eos < 0 else eos))]
    return F.concat(*front, ids, *back)


def truncated(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def padded(ids: Column, width: Column | int, pad: int = 0, left: bool = False) -> Column:
    """Filled with ``pad`` up to ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    fill = F.array_repeat(F.lit(pad), F.greatest(w - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def mask(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, 0).otherwise(1))


def shifted(ids: Column) -> tuple[Column, Column]:
    """Inputs without the last id, labels without the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def batches(df: DataFrame, ids: str, size: int, shards: int = 1, max_len: int = 1024, pad: int = 0, label_pad: int = -100, left: bool = False, order: str = "doc_id") -> DataFrame:
    """Dynamically padded batches: the width is the longest of a batch, at most ``max_len``.

    Batches are numbered within ``shards`` shards of the rows, as data loaders
    do, so no row number over the whole table is needed.
    """
    shard = F.pmod(F.col(order), F.lit(shards))
    at = F.row_number().over(Window.partitionBy("shard").orderBy(order))
    out = df.withColumn("shard", shard).withColumn("batch", F.floor((at - 1) / size).cast("long"))
    out = out.withColumn("ids", truncated(F.col(ids), max_len)).withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("shard", "batch")))
    return out.select(
        order,
        "shard",
        "batch",
        "width",
        padded(F.col("ids"), F.col("width"), pad, left).alias("input_ids"),
        padded(F.col("ids"), F.col("width"), label_pad, left).alias("labels"),
        mask(padded(F.col("ids"), F.col("width"), pad, left), pad).alias("attention_mask"),
    )


def packed(df: DataFrame, ids: str = "ids", block: int = 64, order: str = "doc_id") -> DataFrame:
    """Ids laid end to end in order and cut into blocks: block, pos and id.

    Ranges of rows are written once; a range starts where the sizes of those
    before it end, so no window spans the table.
    """
    ranged = written(df.select(order, F.col(ids).alias("ids")).repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("range").agg(F.sum(F.size("ids")).alias("n"))
    # one row per range
    before = sums.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = F.sum(F.size("ids")).over(Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.size("ids")
    flat = ranged.join(F.broadcast(before), "range").withColumn("o", inner + F.col("before")).select("o", F.posexplode("ids").alias("p", "id"))
    at = F.col("o") + F.col("p")
    return flat.select(F.floor(at / block).alias("block"), (at % block).alias("pos"), "id")


def paired_first(df: DataFrame, batch: str = "batch", is_pair: str = "is_pair") -> DataFrame:
    """Within a batch that has a pair, unpaired rows go."""
    some = F.max(F.col(is_pair).cast("int")).over(Window.partitionBy(batch))
    return df.withColumn("__some", some).filter((F.col("__some") == 0) | F.col(is_pair)).drop("__some")


def mixed(natural: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both kinds of rows with a type tag."""
    return natural.withColumn("type", F.lit("natural")).unionByName(pairs.withColumn("type", F.lit("paired")), allowMissingColumns=True)


def proportions(df: DataFrame) -> DataFrame:
    """Rows and share per type."""
    counts = df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all"))), F.lit(True)).select("type", "n", (F.col("n") / F.col("all")).alias("share"))


def rolling_mean(log: DataFrame, step: str, value: str, window: int = 100, every: int = 100) -> DataFrame:
    """Mean of the last ``window`` values at each ``every``-th step.

    Steps are grouped into blocks of ``window``; a block's window needs only
    the block before it, so the log is not gathered in one task.
    """
    block = log.withColumn("block", F.floor((F.col(step) - 1) / window))
    # each row also goes to the next block, as history
    both = block.withColumn("own", F.lit(True)).unionByName(block.withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("block").orderBy(step).rangeBetween(-(window - 1), 0)
    return both.withColumn("mean", F.avg(value).over(w)).filter(F.col("own") & (F.col(step) % every == 0)).select(step, "mean")


def token_accuracy(rows: DataFrame, predicted: str, labels: str, ignore: int = -100) -> DataFrame:
    """Share of positions predicted right among those not ignored; 0 if there are none."""
    each = F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("y")), lambda x: x["y"] != ignore)
    right = F.size(F.filter(each, lambda x: x["p"] == x["y"]))
    return rows.agg(F.coalesce(F.sum(right) / F.nullif(F.sum(F.size(each)), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def task_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and F1 per task, and the headline: F1 for mrpc, accuracy elsewhere.

    ``rows`` has task, prediction and label (0 or 1).
    """
    p, y = F.col("prediction") == 1, F.col("label") == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.coalesce(2 * count(p & y) / F.nullif(2 * count(p & y) + count(p & ~y) + count(~p & y), F.lit(0)), F.lit(0.0)).alias("f1"),
    )
    return out.withColumn("metric", F.when(F.col("task") == "mrpc", F.col("f1")).otherwise(F.col("accuracy")))


def best_epochs(log: DataFrame, patience: int = 2) -> DataFrame:
    """Best epoch, its value and the epoch at which training stops, per run.

    ``log`` has run, epoch and value; only strict improvements reset patience.
    """
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.withColumn("better", before.isNull() | (F.col("value") > before))
    island = marked.withColumn("last", F.max(F.when(F.col("better"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    waited = island.withColumn("stop", F.col("epoch") - F.col("last") >= patience)
    stop = waited.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("epoch"))), F.max("epoch")).alias("stop_epoch"))
    seen = log.join(stop, "run").filter(F.col("epoch") <= F.col("stop_epoch"))
    best = seen.groupBy("run", "stop_epoch").agg(F.max(F.struct("value", (-F.col("epoch")).alias("neg"))).alias("b"))
    return best.select("run", (-F.col("b.neg")).alias("best_epoch"), F.col("b.value").alias("best_value"), "stop_epoch")


def epoch_means(log: DataFrame) -> DataFrame:
    """Mean of the batch losses of each epoch."""
    return log.groupBy("run", "epoch").agg(F.avg("loss").alias("loss"))


def required_vocab(vocab_size: int, special_ids: list[int | None]) -> int:
    """Size that covers the vocabulary and every special id."""
    return max([vocab_size, *[i + 1 for i in special_ids if i is not None]])


def first_rows(df: DataFrame, n: int, order: str, strict: bool = False) -> DataFrame:
    """The first n rows; ``strict`` raises if there are fewer."""
    if strict and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(order).limit(n)
