"""The loop shared by fitting and fold-in: stop rule, trace, and taking up an interrupted run.

An iteration writes its tables to one of two alternating slots. Beside its sums it writes, as a note, the state
it started from and the trace so far. After a lost driver the newest complete slot therefore holds all that is
needed to redo the arithmetic on the driver and go on with the next iteration, at no further action.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from topicloom.operators.document_pass import SCHEMA, SUMS
from topicloom.session import RunFolder


def iterate_until(
    step: Callable[[int], float], trace: list[tuple], max_iter: int, tol: float | None, min_iter: int
) -> list[tuple]:
    """Runs ``step`` until ``max_iter`` or until the fractional change of its bound is below ``tol``.

    ``trace`` rows are (iteration, bound, fractional change, seconds); iterations it already lists are not run.
    """
    while len(trace) < max_iter and not settled(trace, tol, min_iter):
        began = time.monotonic()
        bound = step(len(trace) + 1)
        add_to_trace(trace, bound, time.monotonic() - began)
    return trace


def add_to_trace(trace: list[tuple], bound: float, seconds: float) -> None:
    bound = float(bound)
    change = abs((bound - trace[-1][1]) / trace[-1][1]) if trace else None
    trace.append((len(trace) + 1, bound, change, seconds))


def settled(trace: list[tuple], tol: float | None, min_iter: int) -> bool:
    return tol is not None and len(trace) >= max(min_iter, 2) and trace[-1][2] < tol


def note_of(step: int, trace: list[tuple], **state) -> str:
    return json.dumps({"step": step, "trace": trace, **state})


def newest_slot(run: RunFolder, names: tuple[str, ...]) -> tuple[int, dict] | None:
    """The last iteration whose slots ``names`` are all complete, and its note."""
    found = []
    for slot in (0, 1):
        if not all(run.complete(f"{name}-{slot}") for name in names):
            continue
        rows = run.read_slot("docs", slot, SCHEMA).where((F.col("part") == SUMS) & (F.col("note") != ""))
        first = rows.select("note").first()
        if first:
            note = json.loads(first["note"])
            found.append((note["step"], note))
    return max(found, key=lambda f: f[0]) if found else None
