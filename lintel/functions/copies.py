"""Rows that a function makes of texts, in frames of bounded size; copies of a text are worked on once while a task remembers them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd

ROWS = 8192  # in a frame, at least; the rows of one text are never cut


def remembered(make: Callable[..., Iterable[tuple]], most: int = 1 << 24) -> Callable[..., list[tuple]]:
    """make(*texts) as a list, the same for equal arguments. What is remembered has `most` characters about, a row counting as 256; then it starts anew."""
    known: dict[tuple, list[tuple]] = {}
    held = 0

    def rows(*texts: str) -> list[tuple]:
        nonlocal held
        if (found := known.get(texts)) is None:
            found = list(make(*texts))
            size = sum(map(len, texts)) + 256 * len(found)
            if held + size > most:
                known.clear()
                held = 0
            if size <= most // 16:
                known[texts] = found
                held += size
        return found

    return rows


def framed(rows: Iterable[list[tuple]], names: list[str], kinds: dict[str, str] | None = None, least: int = ROWS) -> Iterator[pd.DataFrame]:
    """Frames of the lists' rows. Making a frame costs as much as some thousand rows, so a text has none of its own."""
    part: list[tuple] = []
    for found in rows:
        part += found
        if len(part) >= least:
            yield pd.DataFrame(part, columns=names).astype(kinds or {})
            part = []
    if part:
        yield pd.DataFrame(part, columns=names).astype(kinds or {})
