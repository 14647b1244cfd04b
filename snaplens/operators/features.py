"""Derived columns that keep every row: entity history and owner performance.

Entity features are aggregates per id, computed map-side first and joined back; adaptive
execution splits the rows of a hot id in that join. The previous row of each row comes from
its id's rows in order. Sampled splitters over (id, date, tie) cut ids with many rows into ranges: these are
sorted one by one, and the last row of each is carried to the next, so an id may span any number of
tasks. Building the plan runs no job.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplens.functions.dates import days_between, newest_first, period_start
from snaplens.functions.numbers import ratio
from snaplens.operators.quantiles import long_quantiles
from snaplens.operators.semantics import Semantic
from snaplens.operators.skew import lookup_join
from snaplens.roles import Roles, col, find_column

PREVIOUS = "__previous"
SAMPLES = 16  # sampled rows per range


@dataclass(frozen=True)
class Feature:
    """How to derive one column.

    Either ``parts`` and ``value`` (aggregates per id and a row expression over
    them) or ``apply`` (any table-to-table function) is given. ``distinct`` names columns
    whose different values are counted per id, as further parts.
    """

    name: str
    description: str
    requires: tuple[str, ...]
    semantic: Semantic
    parts: Callable[[Roles], dict[str, Column]] | None = None
    value: Callable[[Roles], Column] | None = None
    distinct: Callable[[Roles], dict[str, str]] | None = None
    needs_previous: bool = False
    apply: Callable[[DataFrame, Roles], DataFrame] | None = None


_REGISTRY: dict[str, Feature] = {}
_ALIASES = {"time_in_stages": "days_in_current_stage"}


def register_feature(
    name: str,
    apply: Callable[[DataFrame, Roles], DataFrame],
    requires: Sequence[str] = (),
    semantic: Semantic = Semantic.NUMERICAL,
    description: str = "",
) -> None:
    """Add a feature of your own: ``apply(df, roles)`` returns ``df`` with column ``name``.

    ``requires`` lists parts (``id``, ``snapshot``, ``stage``, ``owner``) or column names.
    """
    _REGISTRY[name] = Feature(name, description, tuple(requires), semantic, apply=apply)


def features() -> dict[str, Feature]:
    return dict(_REGISTRY)


def available_features(df: DataFrame, roles: Roles) -> dict[str, Feature]:
    """Features whose required parts or columns exist, names matched ignoring case."""
    r = roles.bind(df)

    def present(need: str) -> bool:
        if need in ("id", "snapshot", "stage", "owner"):
            return getattr(r, need) is not None
        return find_column(df, need) is not None

    return {n: f for n, f in _REGISTRY.items() if all(present(need) for need in f.requires)}


def add_features(df: DataFrame, roles: Roles, names: Sequence[str]) -> DataFrame:
    """Append the named features in the order given; those that cannot be computed are skipped."""
    usable = available_features(df, roles)
    wanted: list[Feature] = []
    for name in dict.fromkeys(_ALIASES.get(n, n) for n in names):
        if name in usable:
            wanted.append(usable[name])
        else:
            warnings.warn(f"feature {name!r} cannot be computed from these columns", stacklevel=2)
    kept = [c for c in df.columns if c not in {f.name for f in wanted}]
    base = df.select(*map(col, kept))
    r = roles.bind(base)

    entity = [f for f in wanted if f.value is not None]
    out = _add_entity_features(base, r, entity) if entity else base
    for feature in wanted:
        if feature.apply is not None:
            out = feature.apply(out, r)
    return out.select(*map(col, kept), *[col(f.name) for f in wanted])


def _add_entity_features(df: DataFrame, r: Roles, wanted: Sequence[Feature]) -> DataFrame:
    values = [F.when(col(r.id).isNotNull(), f.value(r)).alias(f.name) for f in wanted]
    parts: dict[str, Column] = {}
    distinct: dict[str, str] = {}
    for feature in wanted:
        parts |= feature.parts(r) if feature.parts else {}
        distinct |= feature.distinct(r) if feature.distinct else {}
    rows = with_previous(df, r) if any(f.needs_previous for f in wanted) else df
    known = df.filter(col(r.id).isNotNull())
    tables = [known.groupBy(col(r.id)).agg(*[a.alias(n) for n, a in parts.items()])] if parts else []
    for name, column in distinct.items():  # different values first, so that a hot id's rows meet on several tasks
        pairs = known.filter(col(column).isNotNull()).select(col(r.id), col(column).alias(name)).distinct()
        tables.append(pairs.groupBy(col(r.id)).agg(F.count("*").alias(name)))
    for table in tables:
        rows = lookup_join(rows, table, [r.id])
    return rows.select(*map(col, df.columns), *values)


def _place(r: Roles) -> list[Column]:
    """What orders all rows: id, then date (undated last), then the tie columns."""
    return [col(r.id), col(r.snapshot).isNull(), col(r.snapshot), *r.order_columns()]


def with_previous(df: DataFrame, r: Roles, ranges: int | None = None) -> DataFrame:
    """``df`` with ``PREVIOUS``: date and stage of the same id's row before, null for its first.

    Splitters are taken from the rows with the smallest hashes, so they depend on the data alone and every pass
    over it makes the same ranges. An id is cut by the splitters that lie in it, which are many for a hot id and none
    for most; only rows of ids with splitters look for their range and hand a last row on. ``ranges`` defaults to four
    per shuffle partition. Rows equal in id, date and tie columns share a range.
    """
    ranges = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(_place(r))])
    sample = df.select(place.alias("p"), F.xxhash64(*_place(r)).alias("h")).orderBy("h", "p").limit(SAMPLES * ranges)
    listed = sample.agg(F.sort_array(F.collect_list("p")).alias("p"))
    step = F.greatest(F.ceil(F.size("p") / F.lit(ranges)).cast("int"), F.lit(1))
    several = listed.select(F.explode(F.filter("p", lambda _, i: i % step == step - 1)).alias("cut"))
    cuts = several.groupBy(F.col("cut.p0").alias("__of")).agg(F.sort_array(F.collect_list("cut")).alias("__cuts"))

    rows = df.withColumns({"__key": F.xxhash64(col(r.id)), "__place": place})
    rows = rows.join(F.broadcast(cuts), col(r.id).eqNullSafe(F.col("__of")), "left").withColumn("__range", F.lit(0))
    # The number of cuts up to the row, by halving. Steps are columns of their own: compiled, no array is copied.
    for step in reversed(range(ranges.bit_length())):
        passed = F.get("__cuts", F.col("__range") + ((1 << step) - 1)) <= F.col("__place")
        rows = rows.withColumn("__range", F.when(passed, F.col("__range") + (1 << step)).otherwise(F.col("__range")))
    cut = rows.filter("__cuts IS NOT NULL")
    rows = rows.drop("__of", "__cuts", "__place")

    state = F.struct(col(r.id).alias("id"), col(r.snapshot).alias("at"), col(r.stage).alias("stage"))
    tails = cut.groupBy("__of", "__range").agg(F.max_by(state, "__place").alias("__tail"))
    handed = F.lag("__tail").over(Window.partitionBy("__of").orderBy("__range"))  # a row per range of an id with cuts
    carried = tails.select("__of", F.col("__range").alias("__at"), handed.alias("__carried"))
    within = F.lag(state).over(Window.partitionBy("__key", "__range").orderBy(*_place(r)))  # ids may share a key
    same = [F.when(before["id"] == col(r.id), F.struct(before["at"].alias("at"), before["stage"].alias("stage")))
            for before in (F.col(PREVIOUS), F.col("__carried"))]
    return (
        rows.withColumn(PREVIOUS, within)
        .join(F.broadcast(carried), (col(r.id) == F.col("__of")) & (F.col("__range") == F.col("__at")), "left")
        .withColumn(PREVIOUS, F.coalesce(*same))
        .drop("__key", "__of", "__at")
        .drop("__range", "__carried")
    )


def _complete(r: Roles) -> Column:
    return col(r.snapshot).isNotNull() & col(r.stage).isNotNull()


def _oldest(r: Roles) -> Column:
    return F.struct(col(r.snapshot), *r.order_columns())


def _newest(r: Roles) -> Column:
    return F.struct(newest_first(col(r.snapshot)), *r.order_columns())


def _span_parts(r: Roles) -> dict[str, Column]:
    return {"__first_at": F.min(col(r.snapshot)), "__last_at": F.max(col(r.snapshot))}


def _won_parts(r: Roles) -> dict[str, Column]:
    won = _complete(r) & r.is_won(col(r.stage))
    return {
        "__first_complete": F.min(F.when(_complete(r), col(r.snapshot))),
        "__first_won": F.min(F.when(won, col(r.snapshot))),
    }


def _start_parts(r: Roles) -> dict[str, Column]:
    return {"__start": F.min_by(col(r.stage), F.when(_complete(r), _oldest(r)))}


def final_stage(r: Roles) -> Column:
    """Stage at the latest complete snapshot, as an aggregate over one id."""
    return F.min_by(col(r.stage), F.when(_complete(r), _newest(r)))


def _step_value(r: Roles) -> Column:
    """Days since the previous snapshot while the stage stays; 0 on the first row or a change."""
    before = F.col(PREVIOUS)
    unknown = col(r.snapshot).isNull() | col(r.stage).isNull()
    lost_track = before["at"].isNull() | before["stage"].isNull()
    stayed = F.greatest(days_between(col(r.snapshot), before["at"]), F.lit(0).cast("bigint"))
    return (
        F.when(unknown, None)
        .when(before.isNull(), F.lit(0).cast("bigint"))
        .when(lost_track, None)
        .when(col(r.stage) == before["stage"], stayed)
        .otherwise(F.lit(0).cast("bigint"))
    )


def _owner_win_rate(df: DataFrame, r: Roles) -> DataFrame:
    """Won share of each owner's closed entities; an entity belongs to its first known owner."""
    first_row = F.struct(col(r.snapshot).isNull(), col(r.snapshot), *r.order_columns())
    owned = F.min_by(col(r.owner), F.when(col(r.owner).isNotNull(), first_row))
    entity = (
        df.filter(col(r.id).isNotNull())
        .groupBy(col(r.id))
        .agg(owned.alias(r.owner), final_stage(r).alias("__stage"))
        .filter(col(r.owner).isNotNull() & F.col("__stage").isNotNull())
    )
    won, lost = F.count_if(r.is_won(F.col("__stage"))), F.count_if(r.is_lost(F.col("__stage")))
    named = F.trim(col(r.owner).cast("string")) != ""
    rates = entity.filter(named).groupBy(col(r.owner)).agg(
        ratio(won, won + lost, 100.0).alias("user_win_rate")
    )
    return lookup_join(df, rates, [r.owner])


def _owner_activity(df: DataFrame, r: Roles) -> DataFrame:
    """Low, Medium or High by the owner's mean number of entities per active month."""
    monthly = (
        df.filter(col(r.id).isNotNull() & col(r.snapshot).isNotNull() & col(r.owner).isNotNull())
        .select(col(r.owner), period_start(col(r.snapshot), "M").alias("__month"), col(r.id).alias("__id"))
        .distinct()
        .groupBy(col(r.owner), "__month")
        .agg(F.count("*").alias("__entities"))
        .groupBy(col(r.owner))
        .agg(F.avg("__entities").alias("__mean"))
    )
    # the tercile limits and the number of owners are scalar subqueries over the owner table
    limits = long_quantiles(monthly, ["__mean"], [0.33, 0.67]).select("q").scalar()
    owners = monthly.agg(F.count("*").alias("n")).scalar()
    mean = F.col("__mean")
    label = F.when(mean <= limits[0], "Low").when(mean <= limits[1], "Medium").otherwise("High")
    rated = monthly.select(col(r.owner), F.when(owners >= 3, label).alias("user_activity_rating"))
    return lookup_join(df, rated, [r.owner]).withColumn(
        "user_activity_rating", F.coalesce("user_activity_rating", F.lit("Unknown"))
    )


for _feature in (
    Feature(
        "days_in_pipeline", "Days between first and latest snapshot", ("id", "snapshot"),
        Semantic.NUMERICAL, _span_parts,
        lambda r: days_between(F.col("__last_at"), F.col("__first_at")),
    ),
    Feature(
        "days_to_close_won", "Days from first snapshot to the first won one",
        ("id", "snapshot", "stage"), Semantic.NUMERICAL, _won_parts,
        lambda r: days_between(F.col("__first_won"), F.col("__first_complete")),
    ),
    Feature(
        "starting_stage", "Stage at the earliest snapshot", ("id", "snapshot", "stage"),
        Semantic.CATEGORICAL, _start_parts, lambda r: F.col("__start"),
    ),
    Feature(
        "final_stage", "Stage at the latest snapshot", ("id", "snapshot", "stage"),
        Semantic.CATEGORICAL, lambda r: {"__final": final_stage(r)}, lambda r: F.col("__final"),
    ),
    Feature(
        "user_win_rate", "Won share of the owner's closed entities, in percent",
        ("id", "snapshot", "stage", "owner"), Semantic.NUMERICAL, apply=_owner_win_rate,
    ),
    Feature(
        "user_activity_rating", "Owner's monthly volume: Low, Medium or High",
        ("id", "snapshot", "owner"), Semantic.CATEGORICAL, apply=_owner_activity,
    ),
    Feature(
        "days_in_current_stage", "Days since the previous snapshot in the same stage",
        ("id", "snapshot", "stage"), Semantic.NUMERICAL, value=_step_value, needs_previous=True,
    ),
    Feature(
        "opportunity_age_days", "Days since the first snapshot", ("id", "snapshot"),
        Semantic.NUMERICAL, _span_parts,
        lambda r: days_between(col(r.snapshot), F.col("__first_at")),
    ),
    Feature(
        "stage_progression_count", "Number of different stages seen", ("id", "stage"),
        Semantic.NUMERICAL,
        value=lambda r: F.col("__stages"), distinct=lambda r: {"__stages": r.stage},
    ),
):
    _REGISTRY[_feature.name] = _feature
