"""Answer-stability evaluation: sampling, conditions, summaries, paired comparison, and its statistics."""

import math
import random
import statistics
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import constants as K
from ..functions import kernels
from ..functions import text as X


RESULT = ("id long, condition string, gold double, predicted double, correct boolean, input_chars int, input_tokens int, "
          "token_method string, latency_s double, raw_response string, error string")


def normal_quantile(p: float) -> float:
    return statistics.NormalDist().inv_cdf(p)


# --- sampling ------------------------------------------------------------------------------------------------


def sample_by_hash(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows in the order of a seeded digest of their key: repeatable, and no shuffle but the top-n."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def sample_by_shuffle(records: DataFrame, n: int, seed: int, question: str = "question") -> DataFrame:
    """The sample of a Mersenne shuffle of the row numbers 0, 1, ... in the order of column ``id``, without questions that
    are JSON. The order is made on the driver, so this is for benchmark files, not corpora."""
    total = records.count()
    order = list(range(total))
    random.Random(seed).shuffle(order)
    places = records.sparkSession.createDataFrame([(i, p) for p, i in enumerate(order)], "_row long, _place long")
    is_json = F.pandas_udf("boolean")(_json_batch)(F.col(question))
    numbered = records.withColumn("_row", (F.row_number().over(W.orderBy("id", question)) - 1).cast("long"))
    good = numbered.join(places, "_row").where(~is_json)
    return good.orderBy("_place").limit(n).drop("_place", "_row").orderBy("id")


def _json_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: kernels.whole_json(t or ""))


# --- conditions ----------------------------------------------------------------------------------------------


def conditions(levels=tuple(K.LEVELS), repeat: bool = True, condensed: bool = False) -> list[str]:
    return ["baseline", *["baseline_repeat"] * repeat, *levels, *[f"{x}+tier2" for x in levels if condensed]]


def condition_table(spark: SparkSession, **options) -> DataFrame:
    return spark.createDataFrame(list(enumerate(conditions(**options))), "ord int, condition string")


def run_conditions(items: DataFrame, names: list[str], solver: Callable[[str], str] | None, retries: int = 3, wait: float = 0.01) -> DataFrame:
    """(id, question, answer) x conditions through ``solver`` in the tasks; an item that fails is tried again after
    min(2^k, 8) times ``wait`` seconds (1.0 for a remote solver), and then is a row with its error. Without a solver
    there are no rows: the run is skipped."""
    spark = items.sparkSession
    if solver is None:
        return spark.createDataFrame([], RESULT)
    items = items.select("id", "question", "answer", F.explode(F.array(*map(F.lit, names))).alias("condition"))
    items = items.withColumn("gold", X.gold_answer(F.col("answer")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        shrink = {n: kernels.reducer(K.level_named(n.split("+")[0])) if not n.startswith("baseline") else str for n in names}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                question, reply, error, began = shrink[r.condition](r.question), None, None, time.monotonic()
                for attempt in range(retries + 1):
                    try:
                        reply, error = solver(question), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if attempt < retries:
                            time.sleep(min(2**attempt, 8) * wait)
                words = len(question.split())
                rows.append((r.id, r.condition, r.gold, reply, error, len(question), round(words * K.WORD_FACTOR), time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["id", "condition", "gold", "raw_response", "error", "input_chars", "input_tokens", "latency_s"])

    got = items.select("id", "condition", "question", "gold").mapInPandas(
        run, "id long, condition string, gold double, raw_response string, error string, input_chars int, input_tokens int, latency_s double")
    predicted = X.predicted_answer(F.col("raw_response"))
    return (got.withColumn("predicted", predicted).withColumn("correct", X.answers_match(F.col("gold"), F.col("predicted")) & F.col("error").isNull())
            .withColumn("token_method", F.lit(K.METHOD)).select(*[c.split()[0] for c in RESULT.split(", ")]))


def status(api_available: bool) -> str:
    return "ran" if api_available else "skipped_no_api"


# --- statistics ----------------------------------------------------------------------------------------------


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """[low, high] of a binomial share; (0, 1) for no trials."""
    z2 = normal_quantile(0.5 + confidence / 2) ** 2
    p, m = k.cast("double") / n, n.cast("double")
    middle = (p + z2 / (m * 2)) / (z2 / m + 1)
    half = F.sqrt((p * (F.lit(1.0) - p) + z2 / (m * 4)) * z2 / m) / (z2 / m + 1)
    return F.when(n > 0, F.array(F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def pairs_for_two_proportions(p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return F.ceil((p1 * (F.lit(1.0) - p1) + p2 * (F.lit(1.0) - p2)) * z**2 / F.pow(p1 - p2, F.lit(2.0))).cast("long")


def pairs_for_mcnemar(psi: Column, d: Column, alpha: float = 0.05, power: float | Column = 0.8, z_power: Column | None = None) -> Column:
    """Pairs to find a paired difference ``d`` at discordance ``psi``; null where 0 < d and psi > d^2 do not hold."""
    za = normal_quantile(1 - alpha / 2)
    zb = z_power if z_power is not None else F.lit(normal_quantile(power))
    n = F.pow(F.sqrt(psi) * za + zb * F.sqrt(psi - d * d), F.lit(2.0)) / (d * d)
    return F.when((d > 0) & (psi > d * d), F.ceil(n)).cast("long")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: a fold over the binomial terms, each from the last, in
    logarithms so that many pairs do not underflow."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    none = n.cast("double") * -math.log(2)
    start = F.struct(none.alias("term"), none.alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double") / i)
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, start, step, lambda s: s["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(tail) * 2))


def least_detectable(psi: float, n: int, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """The smallest paired difference that ``n`` pairs can find.

    n d^2 = (a s + b sqrt(s^2 - d^2))^2 with s the root of psi; with t = d / s that is sqrt(n) t - a = b sqrt(1 - t^2),
    a quadratic in t whose larger root is wanted.
    """
    if not psi or psi <= 0 or not n or n <= 0:
        return None
    a, b = normal_quantile(1 - alpha / 2), normal_quantile(power)
    rest = b * b * (n + b * b - a * a)
    if rest < 0:
        return None
    t = (a * n**0.5 + math.copysign(rest**0.5, b)) / (n + b * b)
    return psi**0.5 * t if 0 < t < 1 else None


def least_detectable_column(psi: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([least_detectable(x, int(y)) if pd.notna(x) and pd.notna(y) else None for x, y in zip(a, b)], dtype="float64")

    return run(psi, n)


def summarize(results: DataFrame) -> DataFrame:
    """One row a condition: accuracy with its interval, mean size, errors, answers that could not be read."""
    g = results.groupBy("condition").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.avg("input_tokens").alias("mean_input_tokens"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.count_if(F.col("predicted").isNull() & F.col("error").isNull()).alias("n_unparseable"))
    return g.withColumn("accuracy", F.col("correct") / F.col("n")).withColumn("wilson_ci_95", wilson(F.col("correct"), F.col("n")))


def compare(results: DataFrame, baseline: str = "baseline", order: str | None = None) -> DataFrame:
    """Each other condition paired with the baseline by item: an equi-join, then one aggregation. Of a baseline
    item that is repeated the last by ``order`` counts (without one, as rows have no order, the slowest); pairs with an
    error on either side are left out and counted."""
    base = results.where(F.col("condition") == baseline)
    last = W.partitionBy("id").orderBy(F.col(order or "latency_s").desc_nulls_last(), F.col("correct").desc())
    base = base.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("id", F.col("correct").alias("b_ok"), F.col("error").isNotNull().alias("b_err"))
    both = results.where(F.col("condition") != baseline).join(base, "id")
    bad = F.col("b_err") | F.col("error").isNotNull()
    ok, was = F.col("correct"), F.col("b_ok")
    t = both.groupBy("condition").agg(
        F.count_if(~bad).alias("n_valid_pairs"), F.count_if(bad).alias("n_excluded_errors"),
        F.count_if(~bad & was & ~ok).alias("baseline_correct_treatment_wrong"), F.count_if(~bad & ~was & ok).alias("baseline_wrong_treatment_correct"),
        F.count_if(~bad & was & ok).alias("both_correct"), F.count_if(~bad & ~was & ~ok).alias("both_wrong"))
    b, c, n = (F.col(x) for x in ("baseline_correct_treatment_wrong", "baseline_wrong_treatment_correct", "n_valid_pairs"))
    t = t.withColumn("answer_stability_delta", F.when(n > 0, (c - b) / n).otherwise(0.0)).withColumn("discordant_rate_psi", F.when(n > 0, (b + c) / n).otherwise(0.0))
    return t.withColumn("mcnemar_exact_p", mcnemar_p(b, c))


def power_grid(spark: SparkSession) -> DataFrame:
    """Pairs needed over the fixed grid of discordance, difference and power."""
    grid = [(psi, d, power, normal_quantile(power)) for psi in (0.05, 0.10, 0.15, 0.20) for d in (0.03, 0.05) for power in (0.8, 0.9)]
    df = spark.createDataFrame(grid, "psi double, d double, power double, _z double")
    return df.withColumn("pairs", pairs_for_mcnemar(F.col("psi"), F.col("d"), z_power=F.col("_z"))).drop("_z")
