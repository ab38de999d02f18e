"""Rules on streams. A rule about one row keeps no state, so it filters a stream as it filters a table; to-one relations are
stream-static joins. What would group the related rows of a streaming table has no meaning without a bound in time and is refused."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from gristmill.operators.relational import Planner
from gristmill.plans.engine import Engine
from gristmill.rules import RuleError


def _stateless(engine: Engine, stream: DataFrame | str, rule: Any, options: dict) -> None:
    planner, node = engine._planned(stream, rule, options.pop("bindings", None), options.pop("context", None), options)
    planner.compile(node)
    _refuse_streamed(planner)


def _refuse_streamed(planner: Planner) -> None:
    for child in planner.children.values():
        for _, relation in child.hops:
            if planner.catalog.table(relation.target).isStreaming:
                raise RuleError(f"{relation.target} is a stream: its rows can't be counted for a row of another one")


def where(engine: Engine, stream: DataFrame | str, rule: Any, **options: Any) -> DataFrame:
    """The rows of a stream that the rule passes."""
    _stateless(engine, stream, rule, dict(options))
    return engine.where(stream, rule, **options)


def evaluate(engine: Engine, stream: DataFrame | str, rule: Any, **options: Any) -> DataFrame:
    """The rows of a stream with rule_ok and rule_error."""
    _stateless(engine, stream, rule, dict(options))
    return engine.evaluate(stream, rule, **options)


def route(engine: Engine, stream: DataFrame, rule: Any, passed: str, failed: str, checkpoint: str, **options: Any):
    """A running query that writes each batch's passing and failing rows to two folders."""
    judged = evaluate(engine, stream, rule, **options)

    def write(batch: DataFrame, epoch: int) -> None:
        for ok, folder in ((True, passed), (False, failed)):
            rows = batch.where(batch["rule_ok"] if ok else ~batch["rule_ok"])
            rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")  # a batch that is run again replaces itself

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
