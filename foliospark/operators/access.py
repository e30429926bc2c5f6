"""Row-level access as semi-joins; a user without rows sees nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMINS = ("admin", "administrator")
LEVELS = {"read": 1, "write": 2, "admin": 3}


def is_admin(role: str | None) -> bool:
    return (role or "").strip().lower() in ADMINS


def open_at(start: Column, end: Column, now: str) -> Column:
    """Within the window; a null end or start leaves it open."""
    at = F.lit(now).cast("timestamp")
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def visible(rows: DataFrame, grants: DataFrame, user: int, on: str, role: str | None = None, flag: str | None = None, now: str | None = None) -> DataFrame:
    """The rows whose key the user was granted (with the flag, within the window); all of them for an admin."""
    if is_admin(role):
        return rows
    mine = grants.where(F.col("user_id") == user)
    mine = mine.where(F.col(flag)) if flag else mine
    mine = mine.where(open_at(F.col("starts"), F.col("ends"), now)) if now else mine
    return rows.join(mine.select(on).distinct(), on, "left_semi")


def at_least(level: Column, wanted: str) -> Column:
    order = F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(order, level) >= LEVELS[wanted], F.lit(False))


def without_empty(grants: DataFrame, flags: list[str]) -> DataFrame:
    """Grants that grant something."""
    return grants.where(F.exists(F.array(*[F.coalesce(F.col(f), F.lit(False)) for f in flags]), lambda x: x))


def granted_by_any(keys: list[DataFrame], on: str) -> DataFrame:
    """Keys that any of several sets of grants has."""
    out = keys[0].select(on)
    for k in keys[1:]:
        out = out.unionByName(k.select(on))
    return out.distinct()
