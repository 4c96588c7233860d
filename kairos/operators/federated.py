"""Aggregates of a federated training run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_loss(fit: DataFrame) -> DataFrame:
    """(round, train_loss) = sum(n * loss) / sum(n) per round."""
    return fit.groupBy("round").agg(
        (F.sum(F.col("num_examples") * F.col("train_loss")) / F.sum("num_examples")).alias("train_loss"))


CHUNK = 32  # elements a shuffled row holds: as many sums, and as many weights, in one aggregate


def weighted_vectors(params: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(round, param, chunk, values): element-wise sum(n * v) / sum(n) (A18), ``chunk`` elements a row.

    Vectors are cut into chunks and added up element by element before the
    shuffle, so what moves is a row per chunk and task, not one per element.
    An element counts the weights of the vectors that have it.
    """
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / chunk).cast("int")), lambda c: F.slice("values", c * chunk + 1, F.lit(chunk)))
    x = params.where(F.size("values") > 0).select("round", "param", "num_examples", F.posexplode(cut).alias("chunk", "v"))
    sums = x.groupBy("round", "param", "chunk").agg(
        *[F.sum(F.col("num_examples") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(chunk)],
        *[F.sum(F.when(F.size("v") > i, F.col("num_examples"))).alias(f"w{i}") for i in range(chunk)])
    means = F.array(*[F.struct((F.col(f"s{i}") / F.col(f"w{i}")).alias("mean"), F.col(f"w{i}").isNotNull().alias("used")) for i in range(chunk)])
    return sums.select("round", "param", "chunk", F.transform(F.filter(means, lambda m: m["used"]), lambda m: m["mean"]).alias("values"))


def weighted_vectors_long(params: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(round, param, pos, value): the same means, a row per element."""
    x = weighted_vectors(params, chunk).select("round", "param", "chunk", F.posexplode("values").alias("at", "value"))
    return x.select("round", "param", (F.col("chunk") * chunk + F.col("at")).cast("int").alias("pos"), "value")


def round_report(fit: DataFrame, params: DataFrame) -> DataFrame:
    """Per round: weighted loss, clients, examples, and size and sum of the averaged parameters.

    The averaged values stay in chunks (``weighted_vectors``): a whole
    parameter never becomes one row, nor each element a shuffled one.
    """
    counts = fit.groupBy("round").agg(F.countDistinct("client_id").alias("n_clients"),
                                      F.sum("num_examples").cast("long").alias("num_examples"))
    values = weighted_vectors(params).groupBy("round").agg(
        F.sum(F.size("values")).cast("long").alias("n_values"),
        F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("value_sum"))
    return weighted_loss(fit).join(values, "round").join(counts, "round").select(
        "round", "train_loss", "n_values", "value_sum", "n_clients", "num_examples")


def class_weights(examples: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    """(client, desirable_weight, undesirable_weight) from label balance.

    D = 3 * #true, U = 4 * #false; the smaller side gets the ratio. A missing
    side (D = 0 or U = 0) gives null instead of a division error.
    """
    agg = examples.groupBy(client_col).agg(
        (F.lit(3) * F.sum(F.col(label_col).cast("int"))).alias("D"),
        (F.lit(4) * (F.count("*") - F.sum(F.col(label_col).cast("int")))).alias("U"))
    d_lt_u = F.col("D") < F.col("U")
    return agg.select(
        client_col, "D", "U",
        F.when(d_lt_u, F.try_divide(F.col("U").cast("double"), F.col("D"))).otherwise(F.lit(1.0)).alias("desirable_weight"),
        F.when(d_lt_u, F.lit(1.0)).otherwise(F.try_divide(F.col("D").cast("double"), F.col("U"))).alias("undesirable_weight"))
