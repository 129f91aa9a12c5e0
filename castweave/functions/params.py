"""Request parameters to values: duplicates dropped in order, unusable ones left out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable


def _parts(values: Iterable[str | None]) -> list[str]:
    return [p.strip() for v in values if v for p in v.split(",") if p.strip()]


def int_list(values: Iterable[str | None]) -> list[int]:
    return list(dict.fromkeys(int(p) for p in _parts(values) if p.lstrip("-").isdigit()))


def text_list(values: Iterable[str | None]) -> list[str]:
    return list(dict.fromkeys(_parts(values)))


def iso_date(value: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat((value or "").strip())
    except ValueError:
        return None
