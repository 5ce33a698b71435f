"""Problem 10: text that looks the same but is coded in different characters.

DuckDB runs inside the Arrow partitions: translate maps compatibility forms, spaces and look-alike letters, a regular
expression removes invisible characters, nfc_normalize composes accents. Letters of other scripts are mapped only in
words that hold no letter without a Latin double, so Greek, Cyrillic or Japanese words stay as they are.

Compatibility forms are those of Unicode that look like the plain characters: full and half width, letters and digits of
another style, ligatures, digraphs and Roman numerals. Circled, raised, lowered and squared ones, fractions and the long s
look different and stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.plans.pairs import pairs_within
from estrado.plans.scratch import materialize

#: Characters without a width of their own: soft hyphen, zero-width spaces and joiners, marks of direction; fixed values.
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF)))
#: Spaces of any width, read as a blank; fixed values.
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: Letters of other scripts and the Latin letters they look like; fixed values.
LOOKALIKE = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ӏ": "I",
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "ρ": "p", "σ": "o", "υ": "u", "γ": "y",
    # Latin letters of other alphabets, mapped in every word
    "ı": "i", "ɑ": "a", "ɡ": "g",
}
LATIN = "ıɑɡ"
#: Bytes of text, about, that a query inside a task looks at.
SLICE = 16_000_000
#: Marks that look alike: hyphens and dashes are told apart, quotes too.
MARKS = ("".join(map(chr, (0x2010, 0x2011, 0x2BC))), "--" + chr(0x2019))
FULL_WIDTH = ("".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def _compatible() -> dict[str, str]:
    """Compatibility forms and what they look like, by the rule of the module's docstring."""
    out = {}
    for start, end in ((0x100, 0x3400), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1FBF0, 0x1FBFA)):
        for c in map(chr, range(start, end)):
            kind = unicodedata.decomposition(c).split(" ")[0]
            plain = unicodedata.normalize("NFKC", c)
            one = kind in ("<wide>", "<narrow>", "<font>") and len(plain) == 1
            letters = kind == "<compat>" and plain.isascii() and plain.isalpha() and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Nl") and "\u017f" not in unicodedata.normalize("NFD", c) + unicodedata.decomposition(c).replace("017F", "\u017f")
            if (one or letters) and c not in SPACES:
                out[c] = plain
    return out


COMPATIBLE = _compatible()
#: Composed Greek and Cyrillic letters whose base looks Latin, as that letter and its marks.
MARKED = {c: LOOKALIKE[d[0]] + d[1:] for c in map(chr, range(0x370, 0x530)) if (d := unicodedata.normalize("NFD", c))[0] in LOOKALIKE and len(d) > 1}


def _class(chars: Iterable[str]) -> str:
    """A regular expression's class of ``chars``, neighbours as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def _mapped(text: str, table: dict[str, str]) -> str:
    """DuckDB expression that replaces characters by ``table``; only values that hold one of them are touched."""
    many = {c: to for c, to in table.items() if len(to) > 1}
    one = {c: to for c, to in table.items() if len(to) == 1}
    out = text
    for c, to in many.items():
        out = f"replace({out}, {_quoted(c)}, {_quoted(to)})"
    out = f"translate({out}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    return f"CASE WHEN regexp_matches({text}, '{_class(table)}') THEN {out} ELSE {text} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Characters beyond the plain Latin ones; a text without any is in its consistent form.
_ODD = r"[^\x00-\x9F\xA1-\xAC\xAE-\x{130}\x{134}-\x{17F}]"
_FOREIGN = r"[\p{Greek}\p{Cyrillic}]"


def normal_sql(table: str, text: str, out: str) -> str:
    """DuckDB query of ``out``, an expression of the column ``text`` of ``table`` and of its consistent form ``form``.

    Each step is a projection of its own and null where the text needs none, so that plain texts are only looked at once.
    """
    same = f"translate({text}, {_quoted(SPACES + MARKS[0] + LATIN)}, {_quoted(' ' * len(SPACES) + MARKS[1] + ''.join(LOOKALIKE[c] for c in LATIN))})"
    # Words that hold a letter of another script are mapped where all of them have a Latin double.
    parts = "regexp_extract_all(p, '\\s+|\\S+')"
    latin = f"list_transform({parts}, lambda w: CASE WHEN NOT regexp_matches(w, '{_FOREIGN}') THEN w ELSE {_mapped('w', LOOKALIKE | MARKED)} END)"
    words = f"list_transform(list_zip({parts}, {latin}), lambda z: CASE WHEN regexp_matches(z[2], '{_FOREIGN}') THEN z[1] ELSE z[2] END)"
    return f"""
SELECT {out} FROM (
  SELECT {text}, CASE WHEN p IS NULL THEN {text} WHEN regexp_matches(p, '{_FOREIGN}') THEN nfc_normalize(array_to_string({words}, '')) ELSE nfc_normalize(p) END AS form FROM (
    SELECT {text}, CASE WHEN s IS NOT NULL THEN regexp_replace({_mapped('s', COMPATIBLE)}, '[{INVISIBLE}]', '', 'g') END AS p FROM (
      SELECT {text}, CASE WHEN regexp_matches({text}, '{_ODD}') THEN {same} END AS s FROM {table})))
"""


def normalize(documents: DataFrame, text: str = "text", into: str = "normal", keep: tuple[str, ...] | None = None, hashed: bool = False) -> DataFrame:
    """``documents`` with the consistent form of ``text`` as ``into`` (or, ``hashed``, hashes of both forms instead).

    Null stays null, an empty text stays empty, a blank one stays blank; every row is kept; a column already named
    ``into`` is replaced; texts are read whole.
    """
    kept = [c for c in (keep or tuple(documents.columns)) if c != into]
    source = documents.select(*kept, F.col(text).alias("_text"))
    new = {"raw_hash": "string", "normal_hash": "string"} if hashed else {into: "string"}
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"), *(f"`{c}` {t}" for c, t in new.items())])
    query = normal_sql("part", "_text", "md5(_text) AS raw_hash, md5(form) AS normal_hash" if hashed else "form AS n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        for batch in batches:
            step = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                part = pa.table({"_text": some.column(some.num_columns - 1)})
                db.register("part", part)
                got = db.sql(query).to_arrow_table()
                cols = [c.combine_chunks().cast(pa.string()) for c in got.columns]
                cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *cols], names=[*kept, *new])
                db.unregister("part")

    return source.mapInArrow(run, ddl)


def alike(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(class_id, key, raw_hash): documents whose class holds at least two differently coded texts that look the same.

    The texts are normalised once; only their hashes are written and compared.
    """
    forms = materialize(normalize(documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()), text, keep=(key,), hashed=True))
    classes = forms.groupBy("normal_hash").agg(F.min("raw_hash").alias("lo"), F.max("raw_hash").alias("hi")).where("lo <> hi").select("normal_hash")
    return forms.join(classes, "normal_hash").select(F.col("normal_hash").alias("class_id"), key, "raw_hash").distinct()


def found(documents: DataFrame) -> DataFrame:
    """p10_found: every pair of documents that differ as stored but look the same throughout.

    Null ids and texts have no pairs, copies of the same stored text none with each other; repeated rows count once;
    an empty text and a blank one look different; empty input gives no rows. The stored texts of a class are paired first,
    then their documents, so that copies are never compared with each other.
    """
    rows = materialize(alike(documents))
    texts = pairs_within(rows.select("class_id", "raw_hash").distinct(), ["class_id"], "raw_hash")
    of = lambda side: rows.select("class_id", F.col("raw_hash").alias(side), F.col("doc_id").alias(f"doc_{side}"))
    pairs = texts.join(of("a"), ["class_id", "a"]).join(of("b"), ["class_id", "b"]).where("doc_a <> doc_b")
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b")).distinct()
