"""Plans over micro-batches.

The engine's semantics are those of whole states, so there is no streaming operator. ``foreach_case``
lets a stream of cases run through a plan, each batch a state of its own, in ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import Plan
from ..plans.runner import Run, run_plan
from ..state import GraphState


def foreach_case(stream: DataFrame, plan: Plan, to_state: Callable[[DataFrame], GraphState], done: Callable[[int, Run], None], checkpoint: str) -> StreamingQuery:
    """Runs the plan on the state that each micro-batch makes."""
    return stream.writeStream.foreachBatch(lambda rows, i: done(i, run_plan(plan, to_state(rows)))).option("checkpointLocation", checkpoint).start()
