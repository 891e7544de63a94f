"""Errors as data: what becomes of rows whose processing failed.

An operator gives each row an error message or null. A strategy routes the failed rows:

=================  ==========  ==================================
strategy           ``unless``  row
=================  ==========  ==================================
emit (default)     no match    the query fails
emit               matches     acknowledged and dropped
delegate           no match    nacked, to be delegated or refused
delegate           matches     acknowledged and dropped
=================  ==========  ==================================
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACK, NACK = "_ack", "_error"
OK, DROPPED, NACKED = "ok", "acked_dropped", "nacked"


@dataclass(frozen=True)
class FailureStrategy:
    delegates: bool = False
    unless: Callable[[Column], Column] | None = None

    def status(self, error: Column) -> Column:
        """Status of a row by its error message."""
        return F.when(error.isNull(), F.lit(OK)).when(self._ignored(error), F.lit(DROPPED)).otherwise(F.lit(NACKED))

    def survives(self, error: Column) -> Column | None:
        """A filter that fails the query at the first error to emit; None if none is emitted.

        It is a filter because a projection or a count would prune it from a column.
        """
        if self.delegates:
            return None
        return F.when(error.isNotNull() & ~self._ignored(error), F.raise_error(error).cast("boolean")).otherwise(F.lit(True))

    def _ignored(self, error: Column) -> Column:
        return F.coalesce(self.unless(error), F.lit(False)) if self.unless else F.lit(False)


def emit() -> FailureStrategy:
    return FailureStrategy()


def emit_unless(matches: Callable[[Column], Column]) -> FailureStrategy:
    return FailureStrategy(False, matches)


def delegate() -> FailureStrategy:
    return FailureStrategy(True)


def delegate_unless(matches: Callable[[Column], Column]) -> FailureStrategy:
    return FailureStrategy(True, matches)


def message_has(*parts: str) -> Callable[[Column], Column]:
    """Predicate on messages: contains any of the parts."""

    def of(error: Column) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(error, F.lit(p))
        return out

    return of


def route(df: DataFrame, error: Column, strategy: FailureStrategy) -> DataFrame:
    """``df`` with ``_error`` and ``_ack`` (ok, acked_dropped or nacked)."""
    routed = df.withColumn(NACK, error).withColumn(ACK, strategy.status(F.col(NACK)))
    survives = strategy.survives(F.col(NACK))
    return routed if survives is None else routed.where(survives)


def passing(df: DataFrame) -> DataFrame:
    """What goes on downstream: rows that are ok."""
    return df.where(F.col(ACK) == OK)


def process_failure(df: DataFrame, failed: Column, message: Column, strategy: FailureStrategy) -> DataFrame:
    """Value-level failures. As ``route``, but a delegated row is nacked and passes unchanged."""
    return route(df, F.when(F.coalesce(failed, F.lit(False)), message), strategy).where(F.col(ACK) != DROPPED)


def error_delegation(df: DataFrame, matches: Column | None = None, compose: dict[str, Column] | None = None, send_error: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nacked rows to a dead-letter table: (settled rows, letters).

    A letter is sent if its error matches; the row is then acknowledged. If sending fails
    (``send_error`` is not null) the row stays nacked with that error, the original one
    suppressed. What doesn't match stays nacked as it is.
    """
    wanted = (F.col(ACK) == NACKED) & (F.lit(True) if matches is None else F.coalesce(matches, F.lit(False)))
    lost = F.lit(None).cast("string") if send_error is None else send_error
    sent = wanted & lost.isNull()
    letters = df.where(sent)
    if compose:
        letters = letters.select(*[c.alias(n) for n, c in compose.items()])
    settled = df.withColumns({
        "_suppressed": F.when(wanted & lost.isNotNull(), F.col(NACK)),
        NACK: F.when(sent, None).when(wanted, lost).otherwise(F.col(NACK)),
        ACK: F.when(sent, F.lit("ack")).otherwise(F.col(ACK)),
    })
    return settled, letters
