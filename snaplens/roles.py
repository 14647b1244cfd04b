"""Which column plays which part in a snapshot table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stage names and column names a snapshot table is expected to use.
STAGES = (
    "Lead",
    "Budget",
    "Proposal Development",
    "Proposal Submitted",
    "Negotiation",
    "Closed - WON",
    "Closed - LOST",
    "Canceled/deferred",
)
WON_STAGES = ("Closed - WON", "Won", "Closed Won", "WON")
LOST_STAGES = ("Closed - LOST", "Lost", "Closed Lost", "LOST")
OWNER_COLUMNS = ("Owner", "User", "Sales Rep", "Salesperson", "Rep")


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(df: DataFrame, name: str | None) -> str | None:
    """First column whose name matches when case is ignored."""
    if name is None:
        return None
    return next((c for c in df.columns if c.lower() == name.lower()), None)


@dataclass(frozen=True)
class Roles:
    """Column names by part; ``tie`` decides between rows of one id and date."""

    id: str | None = "Id"
    snapshot: str | None = "Snapshot Date"
    stage: str | None = "Stage"
    owner: str | None = None
    tie: tuple[str, ...] = ()
    stages: tuple[str, ...] = STAGES
    won: tuple[str, ...] = WON_STAGES
    lost: tuple[str, ...] = LOST_STAGES

    def bind(self, df: DataFrame) -> Roles:
        """Resolve every name against ``df``; a part with no column becomes None."""
        owners = (self.owner,) if self.owner else OWNER_COLUMNS
        found = [find_column(df, name) for name in owners]
        return replace(
            self,
            id=find_column(df, self.id),
            snapshot=find_column(df, self.snapshot),
            stage=find_column(df, self.stage),
            owner=next((name for name in found if name), None),
            tie=tuple(c for c in (find_column(df, name) for name in self.tie) if c),
        )

    def missing(self, parts: tuple[str, ...]) -> list[str]:
        return [part for part in parts if getattr(self, part) is None]

    def order_columns(self) -> list[Column]:
        return [col(name) for name in self.tie]

    def is_won(self, stage: Column) -> Column:
        return stage.isin(*self.won)

    def is_lost(self, stage: Column) -> Column:
        return stage.isin(*self.lost)
