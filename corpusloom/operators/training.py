"""Training utilities on long-form parameter frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_batch(streams: DataFrame, length: int, start: Column, ids: str = "ids") -> DataFrame:
    """x and y (one later) of ``length`` ids from ``start`` (0-based) of each id array that is long enough."""
    rows = streams.filter(F.size(ids) > length).withColumn("_s", start.cast("int"))
    return rows.withColumn("x", F.slice(ids, F.col("_s") + 1, length)).withColumn("y", F.slice(ids, F.col("_s") + 2, length)).drop("_s")


def blocked(tokens: DataFrame, block: int = 4096) -> DataFrame:
    """(block, ids) of a stream given as (pos, token_id): runs of ``block`` ids, in order."""
    rows = tokens.groupBy(F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s"))
    return rows.select("block", F.col("s.token_id").alias("ids"))


def random_batch(stream: DataFrame, n: int, size: int, length: int, seed: int, block: int = 4096, device: str = "cpu") -> DataFrame:
    """(sample, x, y): ``size`` windows of a stream of ``n`` ids in blocks, starts drawn evenly from those with a label for each id.

    A window asks for the blocks it touches by an equi-join; the stream itself is not moved but for those.
    """
    if device != "cpu":
        raise RuntimeError(f"no device {device}: Spark's columns are in main memory")
    if n <= length or length < 1 or size < 1:
        raise ValueError("no window of that length has a label for each id")
    draws = spark_range(stream, size).select(F.col("id").alias("sample"), F.floor(F.rand(seed) * (n - length)).cast("long").alias("start"))
    # The draws are few and fixed before use, so that a repeated task joins the same starts.
    asked = draws.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + length) / block))).alias("block"))
    parts = asked.join(stream, "block").groupBy("sample", "start").agg(F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("p"))
    ids = F.slice(F.flatten(F.col("p.ids")), (F.col("start") - F.col("p")[0]["block"] * block + 1).cast("int"), length + 1)
    return parts.select("sample", ids.alias("w")).select("sample", F.slice("w", 1, length).alias("x"), F.slice("w", 2, length).alias("y"))


def spark_range(like: DataFrame, n: int) -> DataFrame:
    """0 to n - 1 in one partition for each 100,000, however many cores there are: ``rand`` draws by partition."""
    return like.sparkSession.range(0, n, 1, -(-n // 100_000))


def cross_entropy(logits: Column, target: Column) -> Column:
    """log-sum-exp less the target's logit, safe from overflow."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, target + 1)


def clip_gradients(grads: DataFrame, max_norm: float, value: str = "g") -> DataFrame:
    """All gradients scaled by max_norm / (norm + 1e-6) if the global norm exceeds it; nulls stay."""
    norm = grads.agg(F.sqrt(F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0)))).first()[0]  # one number
    return grads.withColumn(value, F.col(value) * (max_norm / (norm + 1e-6))) if norm > max_norm else grads


def adamw_step(frame: DataFrame, t: int, lr: float = 1e-3, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> DataFrame:
    """One step over rows with parameter v, gradient g and moments m, s."""
    b1, b2 = betas
    m, s = b1 * F.col("m") + (1 - b1) * F.col("g"), b2 * F.col("s") + (1 - b2) * F.col("g") * F.col("g")
    moved = frame.withColumns({"m": m, "s": s})
    step = lr / (1 - b1**t) * F.col("m") / (F.sqrt(F.col("s") / (1 - b2**t)) + eps)
    return moved.withColumn("v", F.col("v") * (1 - lr * decay) - step)


def cosine_lr(it: Column, max_lr: float, min_lr: float, warmup: int, cycle: int) -> Column:
    """Linear warm-up, then half a cosine down to min_lr."""
    falling = min_lr + 0.5 * (1 + F.cos((it - warmup) / (cycle - warmup) * math.pi)) * (max_lr - min_lr)
    return F.when(it < warmup, it / warmup * max_lr).when(it <= cycle, falling).otherwise(min_lr)


def save_checkpoint(params: DataFrame, iteration: int, path: str) -> None:
    """Parameters and optimiser state (a long-form frame) and the iteration."""
    params.write.mode("overwrite").parquet(f"{path}/params")
    params.sparkSession.createDataFrame([(iteration,)], "iteration long").coalesce(1).write.mode("overwrite").parquet(f"{path}/iteration")


def load_checkpoint(spark, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(f"{path}/params"), spark.read.parquet(f"{path}/iteration").first()[0]
