"""Column expressions shared by the operators. All run inside generated code, none is a UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

WORD = 4294967296  # 2^32: the high word of a log position counts these
MB = 1048576


def lsn_to_pos(lsn: Column) -> Column:
    """Byte position of a ``HI/LO`` hex pair. Decimal, since a high word from 2^31 on overflows a bigint."""

    def word(n: int) -> Column:
        return F.conv(F.split_part(lsn, F.lit("/"), F.lit(n)), 16, 10).cast("decimal(20,0)")

    return (word(1) * F.lit(WORD).cast("decimal(20,0)") + word(2)).cast("decimal(20,0)")


def pos_to_lsn(pos: Column) -> Column:
    """The ``HI/LO`` text of a byte position below 2^63."""
    p = pos.cast("bigint")
    return F.concat(F.hex(F.floor(p / WORD).cast("bigint")), F.lit("/"), F.hex(F.pmod(p, F.lit(WORD))))


def div(a: Column, b: Column | int) -> Column:
    """Integer division that drops the fraction, as the shell does; NULL when ``b`` is 0."""
    return F.call_function("div", a.cast("bigint"), F.nullif(F.lit(b).cast("bigint"), F.lit(0).cast("bigint")))


def clamp(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def tenths_text(tenths: Column) -> Column:
    """Print a count of tenths with one decimal place and no zero before the point (``.5``, ``12.0``, ``0``)."""
    whole = div(tenths, 10)
    head = F.when(whole == 0, F.lit("")).otherwise(whole.cast("string"))
    return F.when(tenths == 0, F.lit("0")).otherwise(F.concat(head, F.lit("."), (tenths % 10).cast("string")))


def age_text(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``."""
    h, m, s = div(seconds, 3600), div(seconds % 3600, 60), seconds % 60
    return (
        F.when(seconds >= 3600, F.format_string("%dh %02dm %02ds", h, m, s))
        .when(seconds >= 60, F.format_string("%dm %02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (zone of the session)."""
    return F.unix_timestamp(ts.cast("timestamp"))


def one_line(text: Column, length: int) -> Column:
    return F.substring(F.regexp_replace(text, r"[\n\r]+", " "), 1, length)


def all_equal(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """True when every pair is equal, NULL counting as equal to NULL."""
    result = F.lit(True)
    for a, b in pairs:
        result = result & a.eqNullSafe(b)
    return result


def row_hash(df: DataFrame, cols: list[str]) -> Column:
    """64-bit hash of the named columns; a NULL differs from an absent value and from its neighbour's NULL."""
    parts = []
    for name in cols:
        parts += [F.col(name), F.col(name).isNull()]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def hash_halves(hash_col: Column) -> tuple[Column, Column]:
    """Upper and lower half of a hash. Sums of either stay far below bigint overflow."""
    return F.shiftright(hash_col, 32), hash_col.bitwiseAND(F.lit(WORD - 1))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """A type that holds the values of both without loss; None if there is none."""
    if a == b:
        return a
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    if type(a) in whole and type(b) in whole:
        return max(a, b, key=lambda t: whole[type(t)])
    digits = lambda t: (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (whole[type(t)], 0) if type(t) in whole else None
    if digits(a) and digits(b):
        left, right = (max(x) for x in zip(digits(a), digits(b)))
        return T.DecimalType(left + right, right) if left + right <= 38 else None
    if {type(a), type(b)} == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if {type(a), type(b)} <= {T.StringType, T.VarcharType, T.CharType}:
        return T.StringType()
    if {type(a), type(b)} in ({T.DateType, T.TimestampType}, {T.DateType, T.TimestampNTZType}):
        return b if isinstance(a, T.DateType) else a
    return None


def _read_as(other: T.DataType) -> T.DataType:
    """The type in which a text is compared with a value of another type."""
    if isinstance(other, (T.DateType, T.TimestampType)):
        return T.TimestampType()
    if isinstance(other, T.DecimalType) or isinstance(other, T.IntegralType):
        return T.DecimalType(38, 18)
    return T.DoubleType() if isinstance(other, T.FloatType) else other


def alike(a: DataFrame, b: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """``cols`` of both tables in types that hold the values of either; as text where there is no such type.

    A text that reads as a value of the other side's type is written as that value would be, any other text stays.
    """
    sides: tuple[list[Column], list[Column]] = ([], [])
    for c in cols:
        types = [df.schema[c].dataType for df in (a, b)]
        wide = common_type(*types)
        for side, own, other in ((0, *types), (1, *types[::-1])):
            if wide is not None:
                value = F.col(c).cast(wide)
            elif isinstance(own, T.StringType):
                value = F.coalesce(F.col(c).try_cast(_read_as(other)).cast("string"), F.col(c))
            elif isinstance(other, T.StringType):
                value = F.coalesce(F.col(c).try_cast(_read_as(own)).cast("string"), F.col(c).cast("string"))
            else:
                value = F.col(c).cast("string")
            sides[side].append(value.alias(c))
    return a.select(*sides[0]), b.select(*sides[1])


def is_integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
