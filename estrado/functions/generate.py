"""The interface to text generators, with local stand-ins.

A generator takes a prompt and gives a text; it runs inside an Arrow UDF, so partitions are its parallelism, and its
retries stay within the partition. Registered generators need no network.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from estrado.functions.citations import mentioned

RETRIES = 3
EMPTY, FAILED = "Error: respuesta vacía", "Error: sin respuesta"
Generator = Callable[[str], str]


def first_sentences(prompt: str, words: int = 300) -> str:
    """The first whole sentences of a text within so many words; at least the first."""
    out, used = [], 0
    for sentence in re.split(r"(?<=[.?!])\s+", prompt.strip()):
        used += len(sentence.split())
        if out and used > words:
            break
        out.append(sentence)
    return " ".join(out)


def other_citation_format(prompt: str) -> str:
    """The spellings of articles and laws exchanged, nothing else."""
    forms = {"art.": "artículo", "arts.": "artículos", "artículo": "art.", "artículos": "arts."}
    return re.sub(r"(?i)\b(?:arts?\.|artículos?\b)", lambda m: forms[m[0].lower()], prompt)


#: Words of rulings and others of the same meaning; fixed values.
SYNONYMS = {"señala": "indica", "sostiene": "afirma", "manifiesta": "expresa", "resuelve": "dispone", "rechaza": "desestima", "presenta": "interpone", "solicita": "pide", "considera": "entiende", "además": "asimismo", "porque": "ya que", "luego": "después", "también": "igualmente"}
#: Outcomes and their opposites; fixed values.
OPPOSITES = {"confirmar": "revocar", "confirma": "revoca", "hacer lugar": "rechazar", "procedente": "improcedente", "admisible": "inadmisible", "favorable": "desfavorable", "con costas": "sin costas"}


def _swapped(text: str, pairs: dict[str, str]) -> str:
    both = pairs | {b: a for a, b in pairs.items()}
    words = "|".join(sorted(map(re.escape, both), key=len, reverse=True))
    keep = lambda new, old: new[:1].upper() + new[1:] if old[:1].isupper() else new
    return re.sub(rf"(?i)\b(?:{words})\b", lambda m: keep(both[m[0].lower()], m[0]), text)


def other_wording(prompt: str) -> str:
    """Some words exchanged for others of their meaning; the content stays."""
    return _swapped(prompt, SYNONYMS)


def other_content(prompt: str) -> str:
    """Outcomes turned into their opposites; citations stay."""
    return _swapped(prompt, OPPOSITES)


#: How questions of each specificity begin, and how many characters of the text they hold.
SPECIFICITIES = {"generic": 0, "specific": 80, "ultra_specific": 240}


def questions(prompt: str, specificity: str = "specific") -> str:
    """Three questions about a text, a line each: ``generic`` about its kind, ``specific`` about its first sentence,
    ``ultra_specific`` about its first sentences word by word."""
    size = SPECIFICITIES[specificity]
    about = first_sentences(prompt, 1 if size <= 80 else 40).rstrip(".?!")[:size] if size else "casos como este"
    return "\n".join(f"¿{start} {about}?" for start in ("Qué se resolvió sobre", "Con qué fundamento", "Qué normas rigen"))


_GENERATORS: dict[str, Generator] = {
    "echo": lambda p: p, "summary": first_sentences, "citation_format": other_citation_format, "wording": other_wording, "content": other_content, "questions": questions,
    **{f"questions_{s}": (lambda p, s=s: questions(p, s)) for s in SPECIFICITIES},
}
#: Kinds of rewriting and the generator of each.
REWRITES = {"formato_citas": "citation_format", "redaccion_superficial": "wording", "cambio_contenido": "content"}


def register(name: str, generator: Generator) -> None:
    _GENERATORS[name] = generator


def generator(name: str) -> Generator:
    if name not in _GENERATORS:
        raise ValueError(f"no generator {name!r}; there are {', '.join(sorted(_GENERATORS))}")
    return _GENERATORS[name]


def answer(call: Generator, prompt: str, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> str:
    """The reply, or an error text after so many tries or for an empty reply; waits 1, 2, 4, ... seconds between tries."""
    for n in range(retries):
        try:
            return call(prompt) or EMPTY
        except Exception:  # noqa: BLE001
            if n + 1 < retries:
                wait(2**n)
    return FAILED


def generate(prompt: Column, name: str = "summary", retries: int = RETRIES) -> Column:
    """The generator's reply to every prompt; null stays null."""
    call = generator(name)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: None if p is None else answer(call, p, retries))

    return run(prompt)


def verbatim_citations(text: Column) -> Column:
    """The stand-in for extraction by a model: the numbers the patterns find."""
    return mentioned(text)


def parse_questions(reply: Column) -> Column:
    """The list under ``questions`` of a JSON reply, or its lines that end as questions; empty if neither."""
    parsed = F.from_json(reply, "struct<questions:array<string>>")["questions"]
    lines = F.filter(F.split(reply, "\n"), lambda x: F.endswith(F.trim(x), F.lit("?")))
    return F.coalesce(parsed, lines, F.array().cast("array<string>"))


def structured_citations(quotation: Column, sources: list[tuple[str, str]]) -> Column:
    """struct(main_source, cited_articles) of a quotation: the stand-in for a model that maps to a closed list of sources.

    ``sources`` holds (name as it may stand in the text, listed name). The longest name in the quotation decides, of equal
    ones the greater; an orphan without any has a null source.
    """
    text = F.lower(quotation)
    listed = F.array(*[F.struct(F.lit(len(name)).alias("size"), F.lit(name.lower()).alias("name"), F.lit(full).alias("full")) for name, full in sources]) if sources else F.array().cast("array<struct<size:int,name:string,full:string>>")
    best = F.array_max(F.filter(listed, lambda s: F.contains(text, s["name"])))
    numbers = F.regexp_extract(text, r"\bart[a-zí]*\.?\s*((?:\d+\s*[°º]?\s*(?:,|;|y|e|/|-)?\s*)+)", 1)
    articles = F.array_sort(F.array_distinct(F.regexp_extract_all(numbers, F.lit(r"(\d{1,9})"), F.lit(1)).cast("array<int>")))
    return F.struct(best["full"].alias("main_source"), articles.alias("cited_articles"))
