"""Row filters shared by search, listing and coverage; all are combined with AND."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def live(trashed_at: Column) -> Column:
    return trashed_at.isNull()


def of_source(source: str, source_id: Column, name: Column) -> Column:
    return (source_id == source) | (name == source)


def in_folder(path: Column, scope: str) -> Column:
    """The folder itself or what lies below it; below it, letters compare without ASCII case."""
    return (path == scope) | F.startswith(F.lower(path), F.lit(scope.rstrip("/").lower() + "/"))


def in_folder_exact(path: Column, scope: str) -> Column:
    """Coverage's form: case counts."""
    return (path == scope) | F.startswith(path, F.lit(scope.rstrip("/") + "/"))


def in_drive_folder(identifier: str, external_id: Column, ancestors: Column) -> Column:
    return (external_id == identifier) | F.coalesce(F.array_contains(ancestors, identifier), F.lit(False))


def of_type(code: str, doc_no_key: Column) -> Column:
    """The document number has this group code as one of its parts."""
    key = re.sub(r"[^a-z0-9]+", "-", code.lower().replace("đ", "d")).strip("-")
    return F.contains(F.concat(F.lit("-"), doc_no_key, F.lit("-")), F.lit(f"-{key}-"))


def bound(value: str | None) -> datetime | None:
    """A day or moment in ISO form as a UTC moment; one without a zone is taken as UTC."""
    if value is None:
        return None
    try:
        moment = datetime.fromisoformat(value)
    except ValueError:
        raise ValueError(f"not an ISO date or time: {value!r}") from None
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def modified(at: Column, after: str | None = None, before: str | None = None) -> Column:
    """Strictly after and before; an unknown time never matches."""
    low, high = bound(after), bound(before)
    if low and high and not low < high:
        raise ValueError(f"no time lies after {after} and before {before}")
    out = at.isNotNull()
    for value, test in ((low, at.__gt__), (high, at.__lt__)):
        if value:
            out = out & test(F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
    return out


def valid_on(rows: DataFrame, validity: DataFrame, day: str, key: str) -> DataFrame:
    """Rows with a validity interval [from, to) that holds the day (left semi join)."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"not a day in the form YYYY-MM-DD: {day!r}")
    d = F.lit(day).cast("date")
    holds = validity.filter((F.col("effective_from") <= d) & (F.col("effective_to").isNull() | (F.col("effective_to") > d)))
    return rows.join(holds.select(key), key, "left_semi")


def folder_scope(scope: str) -> str:
    """A relative folder below the root in plain form, or ``id:X``; anything else is an error."""
    kind, colon, identifier = scope.partition(":")
    if kind == "id" and colon:
        if identifier:
            return scope
        raise ValueError("an id scope names no id")
    steps = [s for s in scope.split("/") if s not in ("", ".")]
    if scope.startswith("/") or ".." in steps or not steps:
        raise ValueError(f"not a folder below the root: {scope!r}")
    return "/".join(steps)


def accepted(path: Column, extensions: Iterable[str], excluded: Iterable[str]) -> Column:
    """Files with a known extension and no excluded path component."""
    parts = F.split(path, "/")
    suffix = F.lower(F.regexp_extract(F.element_at(parts, -1), r"[^.](\.[^.]*)$", 1))
    return suffix.isin(*extensions) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excluded]))


MODES, MATCHES = ("hybrid", "full_text", "semantic"), ("auto", "any", "all", "phrase")


def search_arguments(query: str, mode: str = "hybrid", match: str = "auto", limit: int = 10, per_document: int = 3) -> None:
    """Refuses a search that cannot be asked, whether or not the index holds anything."""
    rules = {
        f"mode is none of {MODES}": mode in MODES,
        f"match is none of {MATCHES}": match in MATCHES,
        "limit is not from 1 to 100": limit in range(1, 101),
        "per_document is not from 1 to 100": per_document in range(1, 101),
        "the query holds no word": re.search(r"\w", query) is not None,
    }
    for broken, holds in rules.items():
        if not holds:
            raise ValueError(broken)
