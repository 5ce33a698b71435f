"""Chunks of texts along a hierarchy of separators, for indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, OVERLAP = 1024, 128
#: Separators from the coarsest on; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts in chunks of at most ``size``, each begun by the last parts of the one before that fit ``overlap``."""
    held: list[str] = []
    length = 0
    for part in parts:
        if held and length + len(part) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        yield "".join(held)


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text: cut at the coarsest separator it holds, parts that are still too long at the next finer ones.

    Separators stay at the beginning of what follows them; chunks are stripped, blank ones left out. A part without any
    separator is kept whole if the empty one is not among ``separators``.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than size")
    out: list[str] = []
    todo: list[tuple[list[str], tuple[str, ...]]] = [([text], separators)]
    # A stack of runs of parts: a run is packed until a part too long, which is cut and goes on top of the rest.
    while todo:
        parts, finer = todo.pop()
        n = next((k for k, part in enumerate(parts) if len(part) > size), len(parts))
        out += _packed(parts[:n], size, overlap)
        if n == len(parts):
            continue
        if parts[n + 1 :]:
            todo.append((parts[n + 1 :], finer))
        at = next((k for k, s in enumerate(finer) if s in parts[n]), None)
        if at is None:
            out.append(parts[n])
        elif not finer[at]:
            out += _packed(list(parts[n]), size, overlap)
        else:
            first, *rest = parts[n].split(finer[at])
            todo.append(([x for x in (first, *(finer[at] + r for r in rest)) if x], finer[at + 1 :]))
    return [c for c in (chunk.strip() for chunk in out) if c]


def recursive_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """``recursive`` as a column of arrays; null has none."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [] if t is None else recursive(t, size, overlap, separators))

    return run(text)
