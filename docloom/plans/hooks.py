"""Named hooks for embedding, reranking and language models, and pipelines of named steps over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docloom.functions.entities import hashed_embedding
from docloom.sources.shared import stored

#: name -> function from a text column to an embedding column; projects register their own models here.
EMBEDDERS: dict[str, Callable] = {"hashed": hashed_embedding}
#: name -> function from (query, text column) to a score column.
RERANKERS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]
    optional: bool = False
    fallback: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Report:
    """status: Complete, Partial (an optional step failed), or Aborted; trace: (step, outcome)."""

    status: str = "Complete"
    trace: list[tuple[str, str]] = field(default_factory=list)


def run_steps(frame: DataFrame, steps: list[Step], execute: bool = False) -> tuple[DataFrame, Report]:
    """Chains the steps' plans. A step that fails falls back, is skipped if optional, or ends the run with what there is. Plans are lazy, so only
    errors of planning show here, unless ``execute`` runs each step and stores its rows in the shared folder before the next one."""
    run = (lambda f, made: stored(made(f), "step")) if execute else (lambda f, made: made(f))
    report = Report()
    for step in steps:
        try:
            frame = run(frame, step.run)
            report.trace.append((step.name, "ok"))
        except Exception as error:  # noqa: BLE001  the trace keeps what went wrong
            if step.fallback:
                frame = run(frame, step.fallback)
                report.trace.append((step.name, f"fallback: {type(error).__name__}"))
            elif step.optional:
                report.status = "Partial"
                report.trace.append((step.name, f"skipped: {type(error).__name__}"))
            else:
                report.status = "Aborted"
                report.trace.append((step.name, f"failed: {type(error).__name__}"))
                break
    return frame, report
