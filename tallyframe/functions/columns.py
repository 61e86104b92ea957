"""Column helpers shared by all operators: naming, null folding, key and type rules."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name):
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df, name):
    return df.schema[name].dataType


def is_numeric(dtype):
    return isinstance(dtype, (*INTEGRAL, *FLOATING, T.DecimalType))


def known(column, dtype):
    """NaN means missing, like null; every other value passes through."""
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def value_of(df, name):
    return known(col(name), dtype_of(df, name))


def blank(df, name):
    return value_of(df, name).isNull()


def text_of(df, name):
    """The displayed text of a cell; null stays null."""
    return value_of(df, name).cast("string")


def all_of(predicates):
    return reduce(lambda a, b: a & b, predicates)


def any_of(predicates):
    return reduce(lambda a, b: a | b, predicates)


def common_type(left, right):
    """The type both sides are cast to before values are compared or stacked.

    Numbers meet at the wider number, dates at the timestamp, anything else as text.
    """
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    if isinstance(left, INTEGRAL) and isinstance(right, INTEGRAL):
        return T.LongType()
    if is_numeric(left) and is_numeric(right):
        if isinstance(left, FLOATING) or isinstance(right, FLOATING):
            return T.DoubleType()
        scale = max(getattr(left, "scale", 0), getattr(right, "scale", 0))
        return T.DecimalType(38, scale)
    if isinstance(left, MOMENTS) and isinstance(right, MOMENTS):
        stamps = [t for t in (left, right) if not isinstance(t, T.DateType)]
        return stamps[0] if len(set(map(type, stamps))) == 1 else T.TimestampType()
    return T.StringType()


def strip(column):
    """Remove white space of any script at both ends; ``trim`` only knows the blank."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def match_key(df, name, dtype, ignore_case=False, ignore_whitespace=False):
    """A key column prepared for null-safe equality with the other side's key."""
    key = value_of(df, name)
    if ignore_case or ignore_whitespace:
        key = key.cast("string")
        if ignore_whitespace:
            key = strip(key)
        return F.lower(key) if ignore_case else key
    if dtype_of(df, name) != dtype:
        key = key.cast(dtype)
    # Adding zero turns -0.0 into 0.0, so equal keys also hash equally.
    return key + F.lit(0.0).cast(dtype) if isinstance(dtype, FLOATING) else key


def _whole_and_floating(a, b):
    return any(isinstance(x, INTEGRAL) and isinstance(y, FLOATING) for x, y in ((a, b), (b, a)))


def _exact_key(df, name):
    """A whole number or a double as text, equal only for equal numbers.

    As doubles, whole numbers beyond 2 ** 53 would meet their neighbours.
    """
    value = value_of(df, name)
    if isinstance(dtype_of(df, name), INTEGRAL):
        return value.cast("string")
    value = value.cast("double")
    whole = F.when((value % 1 == 0) & (F.abs(value) < 2.0**63), value).try_cast("bigint")
    return F.coalesce(whole.cast("string"), value.cast("string"))


def match_keys(left, right, names, ignore_case=False, ignore_whitespace=False):
    """``(left keys, right keys)`` as prepared columns of a common type per name."""
    pairs = []
    for name in names:
        types = dtype_of(left, name), dtype_of(right, name)
        if not (ignore_case or ignore_whitespace) and _whole_and_floating(*types):
            pairs.append((_exact_key(left, name), _exact_key(right, name)))
            continue
        dtype = common_type(*types)
        pairs.append(
            tuple(match_key(df, name, dtype, ignore_case, ignore_whitespace) for df in (left, right))
        )
    return [a for a, _ in pairs], [b for _, b in pairs]


def percent(part, whole):
    """``100 * part / whole`` in exact decimals; 0 for an empty table."""
    share = F.lit(100).cast("decimal(3,0)") * part.cast("decimal(18,0)") / whole.cast("decimal(18,0)")
    return F.when(whole > 0, share).otherwise(F.lit(0).cast("decimal(3,0)"))


def rounded_percent(part, whole, digits):
    return F.bround(percent(part, whole), digits).cast("double")
