"""Mutations as folds over an append-only log (M1, M2).

The original updates rows in place (``UPDATE alarms SET is_enabled=0``).
Here the alarm table is the fold of an event log: per alarm id the latest
action by ``(ts, seq)`` decides the flag, and an id that was never
registered produces no row (disabling an unknown id still "succeeds").
Both aggregates are ``max_by`` per id, which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = ["user_id", "medication_name", "time_hhmm", "days_of_week"]


def fold_alarms(log: DataFrame, ts: str = "ts", seq: str = "event_id",
                payload: list = PAYLOAD) -> DataFrame:
    """M1: ``log(alarm_id, ts, seq, action in {register, disable}, payload...)``
    -> ``(alarm_id, payload..., is_enabled)``."""
    order = F.struct(F.col(ts), F.col(seq))
    reg_order = F.when(F.col("action") == "register", order)      # null -> ignored by max_by
    agg = (log.where(F.col("alarm_id").isNotNull()).groupBy("alarm_id")
              .agg(F.max_by("action", order).alias("last_action"),
                   F.max_by(F.struct(*[F.col(c) for c in payload]), reg_order).alias("reg")))
    return agg.where(F.col("reg").isNotNull()).select(
        "alarm_id", *[F.col(f"reg.{c}").alias(c) for c in payload],
        (F.col("last_action") == "register").alias("is_enabled"))


def active_alarms(state: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """M2 + P14 + P15: enabled alarms, optionally only for a table of users
    (a semi join instead of one query per user)."""
    act = state.where(F.col("is_enabled"))
    return act.join(users, "user_id", "left_semi") if users is not None else act
