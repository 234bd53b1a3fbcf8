"""Roles of a panel's columns and the codes of the methods."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Method(StrEnum):
    DID = "did"
    STAGGERED_DID = "staggered_did"
    INTENSITY_DID = "intensity_did"
    DDD = "ddd"
    RDD = "rdd"
    IV = "iv"
    SCM = "scm"
    SYNTHETIC_DID = "synthetic_did"
    DML = "dml"
    CAUSAL_FOREST = "causal_forest"
    PSM = "psm"
    RANDOMIZATION = "randomization"
    UNKNOWN = "unknown"


@dataclass(frozen=True)
class PanelSpec:
    """Which column plays which role. ``first_treated`` is null for units that never are."""

    entity: str = "entity_id"
    time: str = "year"
    outcome: str = "y"
    treated: str | None = "treated"
    post: str | None = "post"
    first_treated: str | None = None
    controls: tuple[str, ...] = ()

    def check(self, df: DataFrame) -> DataFrame:
        """Only the columns that have a role; measures as doubles with NaN as null."""
        roles = [self.entity, self.time, *(c for c in (self.first_treated,) if c)]
        measures = [c for c in (self.outcome, self.treated, self.post, *self.controls) if c]
        missing = [c for c in (*roles, *measures) if c not in df.columns]
        if missing:
            raise ValueError(f"the panel lacks {', '.join(missing)}")
        return df.select(*roles, *(number(c).alias(c) for c in measures))


def number(col: str):
    """A column as a double; what isn't a number, and NaN, is null."""
    value = F.col(col).try_cast("double")
    return F.when(~F.isnan(value), value)


#: Column names taken for the entity and the time, in this order.
ENTITY_ALIASES = ("entity_id", "city_id", "city", "province", "region", "code", "行政区划代码", "城市代码", "地区", "编号", "id", "ID")
TIME_ALIASES = ("year", "yr", "Year", "年份", "时间", "period")


def sniff(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The first alias that is a column; else a column that equals one but for case."""
    lower = {c.lower(): c for c in reversed(columns)}
    return next((a for a in aliases if a in columns), next((lower[a.lower()] for a in aliases if a.lower() in lower), None))
