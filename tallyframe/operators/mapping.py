"""Select and rename columns to a destination schema."""

from typing import NamedTuple

from tallyframe.errors import require_columns, require_some
from tallyframe.functions.columns import col


class ColumnMapping(NamedTuple):
    source_column: str
    destination_column: str


def _reject_repeats(names, what):
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"{what} columns named twice: {repeated}")


def map_columns(df, mappings, keep_unmapped=False):
    """Mapped columns under their new names, in mapping order, then the unmapped ones if kept."""
    require_some(mappings, "The mapping is empty.")
    pairs = [ColumnMapping(*m) for m in mappings]
    sources = [p.source_column for p in pairs]
    require_columns(df, sources, "Source column")
    _reject_repeats(sources, "Source")
    leftover = [c for c in df.columns if keep_unmapped and c not in sources]
    _reject_repeats([p.destination_column for p in pairs] + leftover, "Destination")
    return df.select(
        *[col(p.source_column).alias(p.destination_column) for p in pairs], *map(col, leftover)
    )


def map_identical_names(source_columns, destination_columns):
    """Mappings for the names both schemas share exactly, in source order."""
    wanted = set(destination_columns)
    return [ColumnMapping(c, c) for c in source_columns if c in wanted]
