"""Scalar functions over page text, paragraphs and headings, as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are page headers, footers, page numbers or time stamps; fixed values.
NOISE_LINES = (r"Superior Tribunal.*$", r"Sala Civil y Comercial.*$", r"\s*\d+\s*$", r"Poder Judicial.*$", r"Firmado digitalmente.*$", r"Página \s*\d+(\s*de\s*\d+)?", r"\s*\d{4}-\d{2}-\d{2}T\d{2}:")
#: Titles that a summary may begin a line with, in the order they are removed; fixed values.
HEADINGS = (
    r"^\*\*IDEA CENTRAL DEL FALLO\*\*\n\n",
    r"^### IDEA CENTRAL DEL FALLO\n\n",
    r"^\*\*IDEA CENTRAL DEL FALLO:\*\*\n\n",
    r"^### IDEA CENTRAL DEL FALLO:\n\n",
    r"^\*\*IDEA CENTRAL:\*\*\n\n",
    r"^### IDEA CENTRAL:\n\n",
    r"^\*\*IDEA CENTRAL DEL FALLO\*\*\n",
    r"^### IDEA CENTRAL DEL FALLO\n",
    r"^\*\*IDEA CENTRAL DEL FALLO JUDICIAL\*\*\n\n",
    r"^\*\*IDEA CENTRAL DEL FALLO JUDICIAL\*\*\n",
    r"^\*\*Decisión Judicial Principal:\*\*\n\n",
    r"^\*\*Decisión Judicial Principal:\*\*\n",
    r"^\*\*Decisión Judicial Principal:\*\*",
    r"^\*\*decisión judicial principal:\*\*\n",
    r"^\s+\*\*IDEA CENTRAL DEL FALLO\*\*\n\n",
    r"^\s+### IDEA CENTRAL DEL FALLO\n\n",
    r"^\s+\*\*IDEA CENTRAL DEL FALLO JUDICIAL\*\*\n\n",
    r"^\s+\*\*Decisión Judicial Principal:\*\*\n\n",
    r"^\s+\*\*Decisión Judicial Principal:\*\*\n",
    r"^\s+\*\*Decisión Judicial Principal:\*\*",
    r"^\s+\*\*decisión judicial principal:\*\*",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_upper(c: Column) -> Column:
    """Holds letters, none of them small."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def drop_noise_lines(c: Column) -> Column:
    """Text without its noise lines, stripped."""
    pattern = f"(?iu)^(?:{'|'.join(NOISE_LINES)})"
    return strip(F.array_join(F.filter(lines(c), lambda x: ~x.rlike(pattern)), "\n"))


def is_key_line(c: Column) -> Column:
    """A section title: capitals only, a colon at the end, under 50 characters."""
    return is_upper(c) & F.endswith(c, F.lit(":")) & (F.length(c) < 50)


def join_lines(c: Column) -> Column:
    """The paragraphs of a page's lines.

    A blank line ends a paragraph; a line goes on the one before it unless that ends in . : ? ! ; or it is a title itself.
    """
    stripped = F.transform(lines(c), strip)
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(state: Column, line: Column) -> Column:
        done, cur = state["done"], state["cur"]
        closed = F.when(cur == "", done).otherwise(F.concat(done, F.array(cur)))
        breaks = (cur == "") | cur.rlike(r"[.:?!;]$") | is_key_line(line)
        return (
            F.when(line == "", F.struct(closed.alias("done"), F.lit("").alias("cur")))
            .when(breaks, F.struct(closed.alias("done"), line.alias("cur")))
            .otherwise(F.struct(done.alias("done"), F.concat(cur, F.lit(" "), line).alias("cur")))
        )

    return F.aggregate(stripped, none, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def subject(c: Column) -> Column:
    """The subject in the first quoted caption that holds S/, up to a dash or comma, in capitals; null without one."""
    quoted = F.filter(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)), lambda q: q.rlike(r"(?iu)S/\s*[^\-,]"))
    return F.upper(strip(F.nullif(F.regexp_extract(F.get(quoted, F.lit(0)), r"(?iu)S/\s*([^\-,]+)", 1), F.lit(""))))


def clean_headings(c: Column) -> Column:
    for pattern in HEADINGS:
        c = F.regexp_replace(c, f"(?m){pattern}", "")
    return c


def cut(c: Column, size: int, mark: str = "...") -> Column:
    """At most ``size`` characters, and a mark where something was cut."""
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(mark))).otherwise(c)


def windows(c: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each beginning ``overlap`` before the end of the one before; none of an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(c) - overlap) / (size - overlap)).cast("int") - 1))
    return F.when(F.length(c) > 0, F.transform(starts, lambda k: F.substring(c, k * (size - overlap) + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column, mode: str = "raw") -> Column:
    """Words between white space: ``raw`` as they are, ``normalized`` small and of 3 to 19 characters."""
    if mode not in ("raw", "normalized"):
        raise ValueError(f"tokenizer {mode!r} is none of raw, normalized")
    words = F.split(c if mode == "raw" else F.lower(c), r"\s+")
    return F.filter(words, (lambda w: w != "") if mode == "raw" else (lambda w: (F.length(w) > 2) & (F.length(w) < 20)))


def rewrite_checks(original: Column, modified: Column, kind: Column) -> dict[str, Column]:
    """Length ratio, sameness, success and the flag of the kind of rewrite; the other kinds' flags are null."""
    ratio = F.coalesce(F.try_divide(F.length(modified), F.length(original)), F.lit(0.0))
    return {
        "length_change_ratio": ratio,
        "same_text": original == modified,
        "success": (F.length(modified) > 0) & (modified != original) & ~F.startswith(modified, F.lit("ERROR:")),
        "expected_similar_length": F.when(kind == "formato_citas", (ratio >= 0.8) & (ratio <= 1.2)),
        "significant_rewrite": F.when(kind == "redaccion_superficial", ratio > 0.7),
        "content_changed": F.when(kind == "cambio_contenido", original != modified),
    }
