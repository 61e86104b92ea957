"""Errors raised while a plan is being built, before any Spark job runs."""


class ColumnNotFoundError(ValueError):
    """A named column is not part of the DataFrame's schema."""


class UnsupportedFileTypeError(ValueError):
    """The file suffix is not one the readers understand."""


class LoadError(ValueError):
    """A file exists but cannot be read as a table."""


def require_columns(df, names, what="Column"):
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ColumnNotFoundError(f"{what}(s) not found: {missing}; available: {df.columns}")


def require_some(values, message):
    if not values:
        raise ValueError(message)


def require_free(df, names, what="Column"):
    """The names an operator adds must not be taken; Spark's names ignore case."""
    taken = {c.lower() for c in df.columns}
    clash = [name for name in names if name.lower() in taken]
    if clash:
        raise ValueError(f"{what} name(s) already in use, rename them first: {clash}")


def require_distinct(names):
    """An operator's output names must differ, case aside."""
    seen, repeated = set(), []
    for name in names:
        if name.lower() in seen:
            repeated.append(name)
        seen.add(name.lower())
    if repeated:
        raise ValueError(f"The result would have columns of one name, rename them first: {repeated}")
