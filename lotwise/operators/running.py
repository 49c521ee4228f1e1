"""Running totals that hold when one key owns a large part of all rows.

Every key is cut into tiers (say, account -> day -> block of ids): tier totals are
pre-aggregated map-side, windows run over the few totals of each tier, and the
row-level window only sees one lowest-tier group. NULL is a tier of its own and
comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import written

# Ids are grouped by 2**20, so a group of unique ids has at most a million rows.
ID_BLOCK_BITS = 20


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which NULLs are equal."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"_right_{k}" for k in keys])


def id_block(column: str) -> Column:
    """Block number of a unique integer id."""
    return F.shiftright(F.col(column), ID_BLOCK_BITS)


def _combined(how: str, parts: list[Column]) -> Column:
    if how == "sum":
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def _aggregate(how: str, column: Column) -> Column:
    return F.sum(column) if how == "sum" else F.max(column)


def running(
    df: DataFrame,
    keys: list[str],
    tiers: list[list[str]],
    order: list[str],
    totals: dict[str, tuple[str, str]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running totals per ``keys``, with or without the row itself.

    Rows are ordered by the tier columns, then by ``order``. ``totals`` maps a
    new column to ``("sum" | "max", source column)``.
    """
    last = 0 if inclusive else -1
    groups = [keys + [c for tier in tiers[: i + 1] for c in tier] for i in range(len(tiers))]
    level = df.groupBy(*groups[-1]).agg(
        *[_aggregate(how, F.col(source)).alias(name) for name, (how, source) in totals.items()]
    )
    levels = [level]
    for group in reversed(groups[:-1]):
        level = level.groupBy(*group).agg(
            *[_aggregate(how, F.col(name)).alias(name) for name, (how, _) in totals.items()]
        )
        levels.insert(0, level)

    carried = None
    for i, (group, tier, level) in enumerate(zip(groups, tiers, levels)):
        before = (
            Window.partitionBy(*[c for c in group if c not in tier])
            .orderBy(*tier)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        level = level.select(
            *group,
            *[
                _aggregate(how, F.col(name)).over(before).alias(f"_{name}_{i}")
                for name, (how, _) in totals.items()
            ],
        )
        carried = level if carried is None else _join(level, carried, groups[i - 1])

    inside = (
        Window.partitionBy(*groups[-1])
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    rows = df.withColumns(
        {f"_{name}": _aggregate(how, F.col(source)).over(inside) for name, (how, source) in totals.items()}
    )
    rows = _join(rows, carried, groups[-1])
    result = {
        name: _combined(how, [F.col(f"_{name}")] + [F.col(f"_{name}_{i}") for i in range(len(tiers))])
        for name, (how, _) in totals.items()
    }
    return rows.select(*df.columns, *[column.alias(name) for name, column in result.items()])


def row_numbers(
    df: DataFrame,
    keys: list[str],
    tiers: list[list[str]],
    order: list[str],
    name: str,
) -> DataFrame:
    """Number rows 1, 2, … per ``keys``, without holding a large key in one task."""
    if not keys:
        return _numbered(df, [column for tier in tiers for column in tier] + order, name)
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    return running(counted, keys, tiers, order, {name: ("sum", "_one")}).drop("_one")


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows 1, 2, … in ``order``: tasks sort ranges of rows, and each range starts where the one before ends.

    The sorted rows are written, so that numbers are given once.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The place holds the number of the range above 33 bits and that of the row below.
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    sizes = dict(placed.groupBy(part).count().collect())  # a number for each range, of which there are as many as tasks
    starts = [0]
    for number in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(number, 0))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.get(F.lit(starts).cast("array<long>"), part) + within + 1).alias(name))


def with_neighbours(
    df: DataFrame, key: str, number: str, previous: dict[str, str], following: dict[str, str]
) -> DataFrame:
    """Add columns of the row before and after, for rows numbered per ``key``.

    Windows run over blocks of row numbers; rows at a block edge are copied
    into the next block, so no window sees a whole key.
    """
    n = F.col(number)
    blocks = F.array_distinct(
        F.array(*[F.shiftright(n + step, ID_BLOCK_BITS) for step in (-1, 0, 1)])
    )
    window = Window.partitionBy(key, "_block").orderBy(number)
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumns(
            {
                **{name: F.lag(source).over(window) for name, source in previous.items()},
                **{name: F.lead(source).over(window) for name, source in following.items()},
            }
        )
        .filter(F.col("_block") == F.shiftright(n, ID_BLOCK_BITS))
        .drop("_block")
    )
