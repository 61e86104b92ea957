"""Predicates that decide whether a text is a number, a date, or matches a pattern."""

import re
import unicodedata
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import MOMENTS, col, dtype_of, is_numeric, strip, value_of

# Fixed value: texts that count as numbers. Unlike a cast, it takes no "1d" or "nan".
NUMBER_PATTERN = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"

# Date formats accepted unless a rule names its own.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)

# Formats a column is voted to have, the earlier one of those that fit equally often.
VOTED_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd.MM.yyyy",
    "MM-dd-yyyy",
    "dd-MM-yyyy",
)


def is_number_text(column):
    return column.rlike(NUMBER_PATTERN)


def as_number(df, name):
    """The cell as a double, or null where it is empty or not a number."""
    dtype = dtype_of(df, name)
    if is_numeric(dtype):
        return value_of(df, name).cast("double")
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(is_number_text(col(name)), col(name)).try_cast("double")
    return F.lit(None).cast("double")


def is_not_numeric(df, name):
    """A filled cell that cannot be read as a number."""
    if isinstance(dtype_of(df, name), T.StringType):
        return F.coalesce(~is_number_text(col(name)), F.lit(False))
    numeric_like = (T.BooleanType, *MOMENTS)
    if is_numeric(dtype_of(df, name)) or isinstance(dtype_of(df, name), numeric_like):
        return F.lit(False)
    return col(name).isNotNull()


def shape_of(date_format):
    """A pattern every text in a Spark date format has; it says nothing about valid days."""
    shape = ""
    for run in re.finditer(r"'([^']*)'|([A-Za-z])\2*|.", date_format):
        text = run[0]
        if text.startswith("'"):
            shape += re.escape(run[1] or "'")
        elif text in "[]":
            shape += "(?:" if text == "[" else ")?"
        elif not text.isalpha():
            shape += re.escape(text)
        elif text[0] in "yudHhKkms" or (text[0] in "ML" and len(text) < 3):
            shape += rf"\d{{{len(text)}}}" if len(text) > 1 else r"\d+"
        elif text[0] == "S":
            shape += rf"\d{{1,{len(text)}}}"
        else:
            shape += ".+"
    return f"^{shape}$"


def is_not_date(df, name, formats=DATE_FORMATS):
    """A filled cell that fits none of the formats; numbers and date types always pass."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, MOMENTS) or is_numeric(dtype):
        return F.lit(False)
    text = strip(col(name).cast("string"))
    # Only texts of a format's shape are parsed; a failing parse costs an exception.
    parsed = F.coalesce(
        *[F.when(text.rlike(shape_of(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    )
    return col(name).isNotNull() & parsed.isNull()


def fitting_formats(df, name, formats):
    """A bit per format that the cell's text fits; 0 for empty cells."""
    text = strip(col(name).cast("string"))
    bits = [
        F.when(text.rlike(shape_of(f)) & F.try_to_timestamp(text, F.lit(f)).isNotNull(), 1 << i).otherwise(0)
        for i, f in enumerate(formats)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def spark_pattern(pattern):
    """A Python pattern, matched at the start of the text, as a Spark ``rlike`` pattern.

    Spelled differently in Java: named groups, ``\\Z``, ``\\N{...}``, ``{,n}``, braces that are no
    quantifier, and ``[`` or ``&&`` inside a class. The flags make ``\\d``, ``\\w``, ``\\s`` cover Unicode
    and ``$`` and ``.`` know only ``\\n``, as in Python. What Java lacks is rejected here, before any job.
    """
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"Invalid regex pattern {pattern!r}: {error}") from error
    out, at, in_class, class_start = [], 0, False, 0
    while at < len(pattern):
        rest = pattern[at:]
        if rest.startswith("\\"):
            named = re.match(r"\\N\{([^}]*)\}", rest)
            if named:
                piece, size = re.escape(unicodedata.lookup(named[1])), len(named[0])
            elif rest.startswith("\\Z") and not in_class:
                piece, size = r"\z", 2
            else:
                piece, size = rest[:2], 2
        elif in_class:
            first = at == class_start
            if rest[0] == "]" and not first:
                in_class, piece = False, "]"
            else:
                piece = "\\" + rest[0] if rest[0] in "[&]" else rest[0]
            size = 1
        elif rest[0] == "[":
            in_class = True
            piece = "[^" if rest.startswith("[^") else "["
            size = len(piece)
            class_start = at + size
        elif rest[0] == "{":
            quantifier = re.match(r"\{(\d*)(,?)(\d*)\}", rest)
            if quantifier and (quantifier[1] or quantifier[2]) and quantifier[0] != "{}":
                low, comma, high = quantifier.groups()
                piece, size = "{" + (low or "0") + comma + high + "}", len(quantifier[0])
            else:
                piece, size = r"\{", 1
        elif rest[0] == "}":
            piece, size = r"\}", 1
        elif rest.startswith("(?P<"):
            name = re.match(r"\(\?P<(\w+)>", rest)
            piece, size = f"(?<{_java_name(name[1])}>", len(name[0])
        elif rest.startswith("(?P="):
            name = re.match(r"\(\?P=(\w+)\)", rest)
            piece, size = rf"\k<{_java_name(name[1])}>", len(name[0])
        elif rest.startswith("(?("):
            raise ValueError(f"Conditional groups are not supported: {pattern!r}")
        elif flags := re.match(r"\(\?([aiLmsux]+)[:)-]", rest):
            if set(flags[1]) & set("aLu"):
                raise ValueError(f"Flags a, L and u are not supported: {pattern!r}")
            piece, size = rest[:2], 2
        else:
            piece, size = rest[0], 1
        out.append(piece)
        at += size
    return rf"(?dU)\A(?:{''.join(out)})"


def _java_name(name):
    return re.sub(r"[^A-Za-z0-9]", "U", name)


def _compiled(spark, pattern, java, known=set()):
    """Reject a pattern that Java cannot compile; one row tells."""
    if java not in known:
        try:
            spark.range(1).select(F.concat(F.col("id").cast("string")).rlike(java)).collect()
        except Exception as error:
            raise ValueError(f"Spark cannot compile the pattern {pattern!r}: {error}") from error
        known.add(java)


def does_not_match(df, name, pattern):
    """A filled cell whose text does not match ``pattern`` from its start."""
    java = spark_pattern(pattern)
    _compiled(df.sparkSession, pattern, java)
    text = value_of(df, name).cast("string")
    return F.coalesce(~text.rlike(java), F.lit(False))
