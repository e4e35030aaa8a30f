"""Taking companies in, step by step, from a stored state: a run goes on where an earlier one broke.

A step is a whole job (store, waiting symbols) that lands what it has to and gives the
symbols it is done with; it must be able to run again for the same symbols. What became
of each symbol in each step is appended to ``onboarding`` once the step is over, so a run
that is killed in a step repeats that step only. A symbol goes no further than the first
step it has not passed; others are not held up by it, but a step that fails keeps all its
symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store
from ..tables import cut

Step = tuple[str, Callable[[Store, DataFrame], DataFrame]]


def _last(store: Store) -> DataFrame:
    """(symbol, step, attempt, status, detail) of the last attempt at each step."""
    newest = F.row_number().over(Window.partitionBy("symbol", "step").orderBy(F.desc("attempt")))
    return store.read("onboarding").withColumn("_n", newest).where("_n = 1").drop("_n")


def standing(store: Store, symbols: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(symbol, n_done, next_step, detail, complete): the first step each symbol has not passed, and why, if it was tried."""
    order = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("step")) for k, s in enumerate(steps))))
    asked = symbols.select("symbol").where("symbol is not null").distinct()
    each = asked.select("symbol", order.alias("o")).select("symbol", "o.*").join(_last(store).select("symbol", "step", "status", "detail"), ["symbol", "step"], "left")
    open_ = F.coalesce(F.col("status"), F.lit("")) != "done"
    first = each.groupBy("symbol").agg(F.min(F.when(open_, F.struct("k", "step", "detail"))).alias("first"))
    return first.select("symbol", F.coalesce("first.k", F.lit(len(steps))).alias("n_done"), F.col("first.step").alias("next_step"), F.col("first.detail").alias("detail"), F.col("first").isNull().alias("complete"))


def _record(store: Store, symbols: DataFrame, step: str, status: str, detail: str | None, as_of: str) -> None:
    before = store.read("onboarding").where(F.col("step") == step).groupBy("symbol").agg(F.max("attempt").alias("n"))
    rows = symbols.select("symbol").join(before, "symbol", "left")
    store.append("onboarding", rows.select("symbol", F.lit(step).alias("step"), (F.coalesce("n", F.lit(0)) + 1).alias("attempt"), F.lit(status).alias("status"), F.lit(detail).cast("string").alias("detail"), F.lit(as_of).cast("date").alias("knowledge_date")))


def run(store: Store, symbols: DataFrame, steps: Sequence[Step], *, as_of: str, execute: bool = True) -> DataFrame:
    """``standing`` after the remaining steps; without ``execute`` nothing is run, and it says what would be next."""
    names = [n for n, _ in steps]
    for k, (name, step) in enumerate(steps if execute else ()):
        waiting = cut(standing(store, symbols, names).where(F.col("n_done") == k).select("symbol"), "waiting")
        if not waiting.head(1):
            continue
        try:
            done = cut(step(store, waiting).select("symbol").distinct(), "done")
        except Exception as e:  # the step's own failure: kept with the symbols, and the later steps have none of them
            _record(store, waiting, name, "failed", f"{type(e).__name__}: {e}"[:500], as_of)
            continue
        _record(store, waiting.join(done, "symbol", "left_semi"), name, "done", None, as_of)
        _record(store, waiting.join(done, "symbol", "left_anti"), name, "waiting", None, as_of)
    return standing(store, symbols, names)
