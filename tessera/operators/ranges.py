"""Numbers and running sums over a whole table in a given order, at any size, with one shuffle of its rows.

The order is cut into ranges by bounds that are sampled once and then fixed: they are constants of the plan, so a row's
range follows from the row alone, whatever columns ride along, however often and wherever a part is computed again. A row
finds its range by binary search among the bounds. Sums within a range (a window by range) and the small table of the
ranges' totals add up. No task holds more than a range, of about ROWS rows (more only beyond MOST ranges, and where
that many rows are equal in the order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, MOST, PER_RANGE = 250_000, 4096, 64


class Down:
    """A column of an order that falls, nulls last. Other columns rise, nulls first, as in SQL's defaults here."""

    def __init__(self, column: str | Column):
        self.column = F.col(column) if isinstance(column, str) else column


def _column(o: str | Column | Down) -> Column:
    return o.column if isinstance(o, Down) else F.col(o) if isinstance(o, str) else o


def sorting(order) -> list[Column]:
    return [_column(o).desc_nulls_last() if isinstance(o, Down) else _column(o).asc_nulls_first() for o in order]


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _ascending(c: Column, kind: T.DataType, down: bool) -> list[Column]:
    """Columns that rise as c rises (or falls), none of them null if c isn't, of types that JSON keeps exactly."""
    if isinstance(kind, T.BooleanType):
        c, kind = c.cast("long"), T.LongType()
    if isinstance(kind, T.DateType):
        c, kind = F.unix_date(c).cast("long"), T.LongType()
    if isinstance(kind, T.TimestampType):
        c, kind = F.unix_micros(c), T.LongType()
    if isinstance(kind, T.IntegralType):
        c = c.cast("long")
        return [F.bitwise_not(c) if down else c]
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # NaN is the largest
        c = c.cast("double")
        nan, plain = F.isnan(c).cast("int"), F.when(F.isnan(c), F.lit(0.0)).otherwise(c)
        return [-nan if down else nan, -plain if down else plain]
    if isinstance(kind, T.DecimalType):
        return [-c if down else c]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        if not down:
            return [F.hex(c)]  # digits in the order of bytes
        return [F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))]
    raise TypeError(f"no order by {kind.simpleString()}")


def _key(df: DataFrame, order) -> Column:
    """The place of a row in the order as a struct without nulls, compared field by field."""
    fields = []
    for o, field in zip(order, df.select(*[_column(o) for o in order]).schema.fields, strict=True):
        c, down = _column(o), isinstance(o, Down)
        fields.append(F.when(c.isNull(), F.lit(1 if down else 0)).otherwise(F.lit(0 if down else 1)))
        zero = {"string": F.lit("")}
        for p, kind in zip(_ascending(c, field.dataType, down), df.select(*_ascending(c, field.dataType, down)).dtypes, strict=True):
            fields.append(F.coalesce(p, zero.get(kind[1], F.lit(0)).cast(kind[1])))
    return F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields)])


def dealt(df: DataFrame, order, at_most: int | None = None) -> tuple[DataFrame, str, int]:
    """df with the number of each row's range in a new column, its name, and how many ranges there are.

    at_most: a bound of the number of rows, if one is known; else they are counted."""
    part = fresh(df, "_range")
    n = df.count() if at_most is None or at_most > ROWS else at_most
    ranges = max(1, min(MOST, -(-n // ROWS)))
    if ranges == 1:
        return df.withColumn(part, F.lit(0)), part, 1
    key = _key(df, order)
    some = df.select(key.alias("k")).sample(min(1.0, PER_RANGE * ranges / n), 17).agg(F.sort_array(F.collect_list("k")).alias("k"))  # about PER_RANGE * ranges rows
    picked = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / ranges).cast("int")))
    kind = T.ArrayType(some.schema["k"].dataType.elementType)
    bounds = F.from_json(F.lit(some.select(F.to_json(picked)).first()[0]), kind)
    steps = [1 << i for i in reversed(range((ranges - 1).bit_length()))]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))
    return df.withColumn(part, place), part, ranges


def _added(x: DataFrame, part: str, ranges: int, inside: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """x with the columns of `inside`, each plus the sum of its totals over the ranges before."""
    y = x.select("*", *[c.alias(k) for k, c in inside.items()])
    if ranges == 1:
        return y.drop(part)
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    t = x.groupBy(part).agg(*[c.alias(k) for k, c in totals.items()])
    t = t.select((F.col(part) + 1).alias("_of"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before_{i}") for i, k in enumerate(totals)])  # a row for each range
    # By a sum, not the column itself: from that Spark would infer a filter with the lambda of the search on the side of the totals.
    y = y.join(F.broadcast(t), F.col(part) + 1 == F.col("_of"))
    kept = [F.col(f"`{c}`") for c in x.columns if c != part]
    return y.select(*kept, *[(F.col(f"`{k}`") + F.col(f"_before_{i}")).alias(k) for i, k in enumerate(inside)])


def numbered(df: DataFrame, *order, name: str = "idx", at_most: int | None = None) -> DataFrame:
    """With the place of each row, from 0, in the given order."""
    x, part, ranges = dealt(df, order, at_most)
    if name in df.columns:
        x = x.drop(name)
    inside = F.row_number().over(W.partitionBy(part).orderBy(*sorting(order))) - 1
    return _added(x, part, ranges, {name: inside.cast("long")}, {name: F.count("*")})


def cumulative(df: DataFrame, order, values: tuple[str, ...]) -> DataFrame:
    """With <value>_0 for each value: its sum over the rows that come before in the order."""
    x, part, ranges = dealt(df, order)
    inside = W.partitionBy(part).orderBy(*sorting(order)).rowsBetween(W.unboundedPreceding, -1)
    sums = {f"{v}_0": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return _added(x, part, ranges, sums, {f"{v}_0": F.sum(v) for v in values})
