"""Problem 5: items above a size limit, cut at natural boundaries by recursive bisection.

A stretch that is too long is cut at its strongest boundary, of several the one nearest to the middle, and both parts
again, until every part fits the limit less the overlap. Neighbours that fit together are joined again, and each piece
takes in up to ``overlap`` characters of what precedes it. The weakest boundary at which a stretch over the limit had to be
cut is the level of the item.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.operators.nested import contents_of, paragraph_text
from estrado.sources.fallos import first_delivery, iter_rulings

LIMIT, OVERLAP = 1024, 128
#: Levels of boundaries from the strongest on; ``nada``: none of them suffices.
LEVELS = ("linea", "oracion", "palabra", "nada")
#: Abbreviations whose full stop ends no sentence; fixed values.
ABBREVIATIONS = frozenset("dr dra dres dras sr sra sres sras srta lic ing arq prof art arts inc incs expte exptes nro nros num no cfr conf cf fs fjs pág págs pag pags vta av ed edit vol tomo cap párr parr ss etc ej vs ob cit op ap sec secc ctes cte reg res dec dto ord ac acum ref ref tel depto prov bco cía cia col gral gob min pte vocal".split())
_END = re.compile(r"[.?!][\"'»”)\]]*\s+(?=[\"'«“(\[¿¡]*[A-ZÁÉÍÓÚÜÑ])")


def sentence_starts(text: str) -> list[int]:
    """Places where a sentence begins, but for the first."""
    out = []
    for m in _END.finditer(text):
        at = m.start()
        if text[at] == ".":
            begin = 1 + max(text.rfind(c, 0, at) for c in " \n\t")
            word = text[begin:at].lstrip("\"'«“([¿¡-—–")
            last = word.rpartition(".")[2]
            if last.lower() in ABBREVIATIONS or len(last) == 1 and last.isalpha() and (last.isupper() or "." in word):
                continue
        out.append(m.end())
    return out


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Starts of lines, of sentences and of words, each including the stronger ones."""
    lines = [m.end() for m in re.finditer(r"\n\s*", text) if m.end() < len(text)]
    sentences = sorted({*lines, *sentence_starts(text)})
    return lines, sentences, [m.end() for m in re.finditer(r"\s+", text) if m.end() < len(text)]


def bisection(text: str, room: int, limit: int, marks: tuple[list[int], ...] | None = None) -> tuple[list[int], str]:
    """(places of all cuts, level): cuts until no stretch is longer than ``room``.

    The level is that of the weakest cut of a stretch over ``limit``, white space at its end aside: such a stretch holds no
    stronger boundary, and a text whose stronger boundaries leave none over the limit is never cut at a weaker one there.
    """
    marks = marks or boundaries(text)
    cuts, weakest, todo = [], 0, [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            continue
        middle = (a + b) // 2
        cut, level = middle, len(marks)
        for n, starts in enumerate(marks):
            lo, hi = bisect_right(starts, a), bisect_left(starts, b)
            if lo < hi:
                at = bisect_left(starts, middle, lo, hi)
                cut, level = min((starts[i] for i in (at - 1, at) if lo <= i < hi), key=lambda x: (abs(x - middle), x)), n
                break
        if level > weakest and b - a > limit and len(text[a:b].rstrip()) > limit:
            weakest = level
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts), LEVELS[weakest]


def level_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The coarsest boundaries that leave no stretch over ``limit``, as the bisection finds them."""
    return bisection(text, limit - overlap if len(text) > limit else limit, limit)[1]


def bisect(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], str]:
    """((start with overlap, own start, end) of the pieces of ``text``, level); a text within the limit is one piece.

    Own parts follow each other without gaps, so they restore the text. Characters outside white space are never lost;
    between words longer than a piece a cut may fall inside a word.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap less than limit")
    if len(text) <= limit:
        return [(0, 0, len(text))], LEVELS[0]
    marks = boundaries(text)
    room, words = limit - overlap, marks[2]
    cuts, level = bisection(text, room, limit, marks)
    parts: list[list[int]] = []
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        if parts and b - parts[-1][0] <= room:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    out = []
    for a, b in parts:
        back = max(0, a - overlap)
        if a and back:
            i = bisect_left(words, back)
            back = words[i] if i < len(words) and words[i] < a else back if i >= len(words) or words[i] > a else a
        out.append((back, a, b))
    return out, level


PIECE = "level string, piece int, piece_start int, own_start int, piece_end int, piece_text string"


def pieces(items: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False, with_text: bool = True) -> DataFrame:
    """The rows of ``items`` as pieces: all other columns, then level, piece, piece_start, own_start, piece_end, piece_text.

    Null texts give no piece, empty and short ones a single piece of level ``linea``; ``only_long`` leaves out items
    within the limit. Equal rows give equal pieces; columns of ``items`` with the names of the new ones are replaced.
    """
    new = [c.split()[0] for c in PIECE.split(", ")]
    items = items.drop(*[c for c in new if c != text])
    kept = [c for c in items.columns if c != text]
    some = items.where(F.length(text) > limit) if only_long else items.where(F.col(text).isNotNull())
    source = some.select(*kept, F.col(text).alias("_text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for n, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                cut, level = bisect(value, limit, overlap)
                for k, (start, own, end) in enumerate(cut):
                    rows.append((level, k, start, own, end, value[start:end] if with_text else None))
                    owner.append(n)
            if rows:
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                keep = batch.select(list(range(batch.num_columns - 1))).take(pa.array(owner)) if kept else None
                yield pa.RecordBatch.from_arrays([*(keep.columns if keep else ()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=[*kept, *new])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"), PIECE])
    return source.mapInArrow(run, ddl)


def opinions(files: DataFrame, limit: int) -> DataFrame:
    """(row_id, obj_pos, section, para_pos, text): the paragraphs over ``limit`` of the judges' sections; all but nulls at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[Any, ...]] = []
            for file_id, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                for pos, ruling in iter_rulings(payload.as_py()):
                    for section, value in contents_of(ruling).items():
                        if section.endswith(" DIJO"):
                            for k, item in enumerate(value if isinstance(value, list) else [value]):
                                text = paragraph_text(item)
                                if text is not None and len(text) > limit:
                                    rows.append((file_id, pos, section, k, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()))], names=["row_id", "obj_pos", "section", "para_pos", "text"])

    return first_delivery(files).mapInArrow(run, "row_id bigint, obj_pos int, section string, para_pos int, text string")


def items(files: DataFrame, paragraphs: DataFrame, limit: int) -> DataFrame:
    """(tbl, row_id, obj_pos, section, para_pos, text): the paragraphs over ``limit`` of both tables; all but nulls at -1."""
    a = opinions(files, limit).select(F.lit("fallos_json").alias("tbl"), "row_id", "obj_pos", "section", "para_pos", "text")
    b = paragraphs.where(F.length("text") > limit).select(F.lit("paragraphs").alias("tbl"), F.col("para_uid").alias("row_id"), F.lit(0).alias("obj_pos"), "section", F.col("paragraph_id").cast("int").alias("para_pos"), "text")
    return a.unionByName(b)


def all_pieces(files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """p5_pieces: the pieces of the judges' paragraphs and of ``paragraphs``, with their place as in ``found``; short ones are one piece."""
    return pieces(items(files, paragraphs, -1))


def found(files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """p5_found: every oversize paragraph and the boundaries that suffice for it, as its bisection shows."""
    cut = pieces(items(files, paragraphs, LIMIT), only_long=True, with_text=False)
    return cut.where("piece = 0").select("tbl", "row_id", "obj_pos", "section", "para_pos", "level").distinct()
