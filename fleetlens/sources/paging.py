"""Bounded reads: filters by name, half-open windows, pages that go on from a key, limits that fail and never cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalar import stable_id

PAGE, MOST_PAGE, MOST_ROWS = 100, 1_000, 100_000


class LimitExceeded(ValueError):
    """A result is larger than its bound; nothing of it is returned."""


def filtered(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose columns, as text, equal the given values; an unknown column is an error."""
    unknown = sorted(set(filters) - set(df.columns))
    if unknown:
        raise KeyError(f"no column named {', '.join(unknown)}")
    for name, value in sorted(filters.items()):
        df = df.where(F.col(name) == value if dict(df.dtypes)[name] == "string" else F.col(name).cast("string") == F.lit(str(value).lower() if dict(df.dtypes)[name] == "boolean" else str(value)))
    return df


def windowed(df: DataFrame, start: str, end: str | None, low, high) -> DataFrame:
    """Intervals that overlap [low, high), or points in it."""
    return df.where((F.col(end or start) > low if end else F.col(start) >= low) & (F.col(start) < high))


def table_page(df: DataFrame, *, key: list[str], filters: dict[str, str] | None = None, window: tuple | None = None, offset: int = 0, size: int = PAGE) -> DataFrame:
    """A page in order of the key, with the number of all rows that match as `total`."""
    rows = _asked(df, filters, window, size)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*key).offset(offset).limit(size).crossJoin(F.broadcast(total))


def _asked(df: DataFrame, filters: dict[str, str] | None, window: tuple | None, size: int) -> DataFrame:
    if not 0 < size <= MOST_PAGE:
        raise LimitExceeded(f"a page of {size} rows; at most {MOST_PAGE} are allowed")
    rows = filtered(df, filters or {})
    return windowed(rows, *window) if window else rows


def beyond(df: DataFrame, key: list[str], last: list[str]) -> DataFrame:
    """Rows whose key comes after `last`, given as text."""
    kinds, above = dict(df.dtypes), F.lit(False)
    for name, value in reversed(list(zip(key, last, strict=True))):
        own, limit = F.col(name), F.lit(value).cast(kinds[name])
        above = (own > limit) | ((own == limit) & above)
    return df.where(above)


def next_page(df: DataFrame, *, key: list[str], after: str | None = None, filters: dict[str, str] | None = None, window: tuple | None = None, size: int = PAGE) -> tuple[list, str | None]:
    """Up to `size` rows in order of a unique key, and the mark to go on from, null after the last page.

    A mark names the last key, so a later page is a range of the key, which the scan can be pruned by, and costs as
    much as the first. It also names the question; one of another question is an error. Nulls in a key are refused."""
    rows = _asked(df, filters, window, size)
    question = stable_id("page", [key, sorted((filters or {}).items()), [str(x) for x in window or ()]])
    if after is not None:
        rows = beyond(rows, key, _last_key(after, question, len(key)))
    page = rows.where(F.assert_true(F.expr(" and ".join(f"`{k}` is not null" for k in key)), F.lit("a key is null")).isNull()).orderBy(*key).limit(size + 1).collect()
    more = len(page) > size
    page = page[:size]
    return page, " ".join([question, *(str(page[-1][k]).encode().hex() or "-" for k in key)]) if more else None


def _last_key(mark: str, question: str, width: int) -> list[str]:
    """The key in a mark: the question's id, then each value's text in hex."""
    asked, *values = mark.split(" ")
    if asked != question:
        raise ValueError("the mark belongs to another question")
    if len(values) != width:
        raise ValueError("the mark has another key")
    return ["" if v == "-" else bytes.fromhex(v).decode() for v in values]


def bounded_rows(df: DataFrame, limit: int = MOST_ROWS) -> list:
    """All rows, or an error where there are more than limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise LimitExceeded(f"more than {limit} rows match")
    return rows
