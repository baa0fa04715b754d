"""Evaluation of answers: execution with errors kept, comparison with the gold rows, resumable runs, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.dataset import same_rows
from quillgraph.sources.files import exists, resume

Answer = Callable[[], DataFrame]
_EXECUTED = "id string, rows array<string>, error string"
_EVALUATED = "id string, valid boolean, executed boolean, matched boolean, gold_rows bigint, rows bigint, error string"


def _message(x: Exception) -> str:
    return f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}"


def execute(spark: SparkSession, records: Sequence[tuple[str, Answer]]) -> DataFrame:
    """(id, rows, error): each answer's rows as JSON; of one that fails no rows, and what went wrong. Answers have a limit."""
    out = []
    for key, answer in records:
        try:
            out.append((key, answer().toJSON().collect(), None))
        except Exception as x:  # noqa: BLE001
            out.append((key, [], _message(x)))
    return spark.createDataFrame(out, _EXECUTED)


def judge(key: str, gold: Answer, answer: Answer | None) -> tuple:
    """Three levels: there is an answer that can be planned, it runs, its rows are those of the gold answer."""
    want = gold()
    n_gold = want.count()
    if answer is None:
        return key, False, False, False, n_gold, 0, None
    try:
        got = answer()
    except Exception as x:  # noqa: BLE001
        return key, False, False, False, n_gold, 0, _message(x)
    try:
        n = got.toJSON().count()  # of all columns, also those that a count needn't look at
    except Exception as x:  # noqa: BLE001
        return key, True, False, False, n_gold, 0, _message(x)
    return key, True, True, bool(same_rows(want, got)["same"]), n_gold, n, None


def evaluate(spark: SparkSession, records: Sequence[tuple[str, Answer, Answer | None]], path: str, every: int = 5) -> DataFrame:
    """The judgement of each record. They are written every so many records; a run that is started again goes on."""
    done = set()
    if exists(spark, path):
        todo = spark.createDataFrame([(r[0],) for r in records], "id string")
        done = {r[0] for r in records} - {r["id"] for r in resume(todo, spark.read.schema(_EVALUATED).json(path)).collect()}
    left = iter([r for r in records if r[0] not in done])
    while part := list(islice(left, every)):
        spark.createDataFrame([judge(*r) for r in part], _EVALUATED).coalesce(1).write.mode("append").json(path)
    return spark.read.schema(_EVALUATED).json(path)


def partial_matches(results: DataFrame) -> DataFrame:
    """Answers that run and give other rows than the gold answer."""
    return results.filter(F.col("valid") & F.col("executed") & ~F.col("matched"))


def extremes(metrics: DataFrame, model: str = "model") -> DataFrame:
    """(most_accurate, most_valid, fastest, slowest): models by name; ties go to the first by name."""
    most = lambda c: F.min_by(model, F.struct(-F.col(c), F.col(model)))
    least = lambda c: F.min_by(model, F.struct(F.col(c), F.col(model)))
    return metrics.agg(most("matched_pct").alias("most_accurate"), most("valid_pct").alias("most_valid"), least("avg_latency_ms").alias("fastest"), most("avg_latency_ms").alias("slowest"))


def by_accuracy(metrics: DataFrame, model: str = "model") -> DataFrame:
    return metrics.orderBy(F.desc("matched_pct"), model)


def write_results(results: DataFrame, metrics: DataFrame, directory: str) -> None:
    """metrics as JSON, a summary as CSV, and the partial matches as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{directory}/metrics")
    tick = lambda c: F.when(F.col(c), "✓").otherwise("✗").alias(c)
    results.select("id", tick("valid"), tick("executed"), tick("matched"), "gold_rows", "rows", "error").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{directory}/summary")
    partial_matches(results).write.mode("overwrite").json(f"{directory}/partial")
