"""Calls to an external function from the executors: a bounded number at once, failures as rows, limits of time and money."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate

import pandas as pd
from pyspark.sql import DataFrame

#: Calls at once at most, and dollars that one call may cost.
MOST_AT_ONCE, CALL_LIMIT = 5, 2.0
RESULT = "text string, cost double, status string, error string"

Call = Callable[[Mapping[str, object]], Mapping[str, object]]


def tried(call: Call, item: Mapping[str, object], seconds: float, retries: int, wait: Callable[[int], float], retry: Callable[[str], bool]) -> tuple[str | None, float, str, str | None]:
    """text, cost, status and error of a call. What it costs counts even if it fails, where the error tells (cost)."""
    spent, n = 0.0, 0
    while True:
        pool = ThreadPoolExecutor(1)
        try:
            got = pool.submit(call, item).result(seconds)
            spent += float(got.get("cost") or 0.0)
            if spent > CALL_LIMIT:
                return None, spent, "failed", f"the call cost {spent:g}, over {CALL_LIMIT:g}"
            return got["text"], spent, "completed", None  # type: ignore[return-value]
        except TooLate:
            return None, spent, "failed", f"no answer for {seconds:g} s"
        except Exception as e:
            spent += float(getattr(e, "cost", 0.0) or 0.0)
            message = str(e) or type(e).__name__
            if n == retries or spent > CALL_LIMIT or not retry(message):
                return None, spent, "failed", message
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        time.sleep(wait(n))
        n += 1


def called(items: DataFrame, call: Call, folder: str, at_once: int = 2, spend: float | None = None, seconds: float = 1200, retries: int = 3, wait: Callable[[int], float] = lambda n: 2**n * 2.0, retry: Callable[[str], bool] = lambda m: False) -> DataFrame:
    """The items with text, cost, status (completed, failed, skipped) and error of a call for each, written to the folder.

    `at_once` (1 to 5) tasks call, one item after the other. Each may spend its share of `spend`: once calls have reported
    as much, its other items are skipped, so all calls together spend at most a call for each task more than the limit. A
    task that is lost with its executor is done again, its calls too."""
    n = max(1, min(MOST_AT_ONCE, at_once))
    share = None if spend is None else spend / n
    names = items.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = 0.0
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if share is not None and spent >= share:
                    out.append((None, 0.0, "skipped", "the spend limit is reached"))
                else:
                    out.append(tried(call, row, seconds, retries, wait, retry))
                    spent += out[-1][1]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(out, columns=["text", "cost", "status", "error"])], axis=1)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", " + RESULT
    made = items.repartition(n).mapInPandas(run, kind).select(*[f"`{c}`" for c in names], "text", "cost", "status", "error")
    made.write.mode("overwrite").parquet(folder)
    return items.sparkSession.read.schema(made.schema).parquet(folder)
