"""Problem 3: values typed freely, mapped to the entries of a reference list.

Every reference entry gives a few keys (its name, short name, number and their usual combinations); the keys stand in
a BK-tree under the Levenshtein metric, and a typed value asks the tree for every key within its threshold. The
nearest key whose numbers are the value's own numbers wins: a law of another number is another law. Whose a key is gets
settled over the whole reference first; keys beyond a checked number are sharded, each shard answers every block of values
with its winners, and the winners merge.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from estrado.plans.scratch import materialize

#: Most keys that travel to every task as one tree.
SHARD = 20_000
#: Distinct values that one task asks one shard for.
BLOCK = 50_000
#: Distinct values and keys a task remembers.
MEMO = 200_000
UNLISTED = -1
#: Abbreviations of words in names of sources, as usual in Spanish legal writing; fixed values.
_SHORT = {
    "cod": "codigo", "proc": "procesal", "proces": "procesal", "civ": "civil", "unif": "unificado", "prov": "provincial", "conv": "convencion", "const": "constitucion", "contin": "continental",
    "gtias": "garantias", "gtia": "garantias", "ciud": "ciudadanas", "escr": "escritos", "dig": "digitales", "ord": "ordenanza", "ordenza": "ordenanza", "mun": "municipal", "munic": "municipal", "ac": "acuerdo",
    "gral": "general", "gen": "general", "dec": "decreto", "dto": "decreto", "decr": "decreto", "res": "resolucion", "resol": "resolucion", "acord": "acordada", "acda": "acordada", "pcial": "provincial", "pcia": "provincial", "constit": "constitucion", "regl": "reglamento", "rgto": "reglamento", "reglto": "reglamento", "trib": "tribunal",
    "crim": "criminal", "fed": "federal", "l": "ley", "ag": "acuerdo general", "om": "ordenanza municipal", "rat": "resolucion alto tribunal", "prot": "protegidos", "min": "minero",
}
#: Words that carry nothing in a name of a source; fixed values.
_IDLE = frozenset("el la los las de del sobre y e en n nro num numero no nr vigente modif mod modificatorias texto ordenado to concs concordantes cc".split())
_LEAD = re.compile(r"^\W*(?:(?:cfr|conf|ver|segun|conforme|vease|lo dispuesto (?:por|en)|en los terminos de)\b[.,:]?\s*)+")
_NO = r"\d+(?!\d|[.,]\d{3}(?!\d))\s*[°º]?"
_ARTICLES = rf"{_NO}(?:\s*(?:,|;|y|e|a|/|-)\s*{_NO})*"
_HEAD = re.compile(rf"^\W*(?:articulos?|arts?)\b\.?\s*{_ARTICLES}(?:\s*inc\.?\s*\w\)?)?\s*,?\s*(?:\bdel?\b\s*(?:\b(?:la|el|los|las)\b)?\s*)?")
_TAIL = re.compile(rf"[,;\s]*(?:\b(?:en (?:su|sus)|en el|en los)\s+)?\b(?:articulos?|arts?)\b\.?\s*{_ARTICLES}.*$|[,;\s]*\by conc(?:s|ordantes)?\b\.?\s*$|[,;\s]*\bin fine\b\W*$|[,;\s]*\binc\.?\s*\w\)?\W*$")


def fold(text: str) -> str:
    """Small letters without accents; spaces of any kind as one blank."""
    text = unicodedata.normalize("NFKD", text.replace("º", "°").lower())
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")).strip()


def source_part(text: str) -> str:
    """A quotation without its articles and turns of phrase."""
    for pattern in (_LEAD, _HEAD, _TAIL, _TAIL, _TAIL):
        rest = pattern.sub("", text)
        text = rest if re.search(r"\w", rest) else text
    return text


def key_of(text: str, idle: bool = False) -> str:
    """The words of a folded name in full, and its numbers as n or n/yy; ``idle``: with the words that carry nothing."""
    text = re.sub(r"(?<=\d)[.,\s](?=\d{3}(?!\d))", "", text)
    text = re.sub(r"(\d+)\s*(?:/|-|\bdel?\b)\s*(\d{4}|\d{2})(?!\d)", lambda m: f"{m[1]}/{m[2][-2:]}", text)
    text = re.sub(r"\b(?:t\.?\s?o\.?)(?=\W|$)", " ", text)
    text = re.sub(r"\bn\s?(?:ro|um|°|\.)*\s*(?=\d)", " ", text)
    words = re.findall(r"\d+(?:/\d+)?|[a-zñ]+", text)
    words = re.sub(r"\b[a-zñ](?: [a-zñ]\b)+", lambda m: m[0].replace(" ", ""), " ".join(words)).split()  # C. P. C. U.
    out: list[str] = []
    for k, word in enumerate(words):
        if word == "c" and k + 1 < len(words) and len(words[k + 1]) > 2:
            word = "codigo"
        if word == "prov" and out[-1:] == ["ley"]:
            word = ""
        if word and (idle or word not in _IDLE):
            out.append(_SHORT.get(word, word))
    return " ".join(out)


def numbers_of(key: str) -> list[str]:
    return sorted(n.lstrip("0") or n for n in re.findall(r"\d+(?:/\d+)?", key))


def reference_keys(name: str, short: str | None) -> set[str]:
    """The keys a reference entry is known by."""
    text = fold(name)
    inner = re.search(r"\(([^)]*)\)", text)
    plain = re.sub(r"\([^)]*\)", " ", text)
    keys = {key_of(plain, True)}
    base = key_of(plain)
    parts = [key_of(p) for p in re.split(r"\s-\s", inner[1])] if inner else []
    keys |= {key_of(p, True) for p in re.split(r"\s-\s", inner[1])} if inner else set()
    if short:
        parts.append(key_of(fold(short)))
    keys |= {base, *parts}
    for part in parts:
        keys |= {f"{base} {part}", f"{part} {base}"}
        if part.startswith("ley "):
            keys.add(part[4:])
    number = re.search(r"\d+(?:/\d+)?", base)
    if number and base.startswith("ley "):
        keys.add(number[0])
        for part in parts:
            keys |= {f"{number[0]} {part}", f"{part} {number[0]}"}
    words = base.split()
    if number and words[-1].isalpha() and len(words[-1]) <= 4:  # the mark of an issuing body, often left out
        keys.add(" ".join(words[:-1]))
    return {k for k in keys if k}


def metric(key: str) -> Callable[[str], int]:
    """The Levenshtein distance to ``key``, by bit vectors: one step for each character of the other string."""
    size = len(key)
    full, top = (1 << size) - 1, 1 << (size - 1) if size else 0
    at: dict[str, int] = {}
    for i, c in enumerate(key):
        at[c] = at.get(c, 0) | 1 << i

    def to(other: str) -> int:
        if not size:
            return len(other)
        plus, minus, score = full, 0, size
        for c in other:
            eq = at.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(across | plus))
            down = plus & across
            score += bool(up & top) - bool(down & top)
            up = up << 1 | 1
            plus, minus = full & (down << 1 | ~(eq | minus | up)), up & (eq | minus) & full
        return score

    return to


class BKTree:
    """Keys under the Levenshtein metric; a query visits a child only if the triangle inequality lets it hold a match."""

    def __init__(self) -> None:
        self.root: tuple[str, list[Any], dict[int, Any]] | None = None

    def add(self, key: str, value: Any) -> None:
        if self.root is None:
            self.root = (key, [value], {})
            return
        node, to = self.root, metric(key)
        while d := to(node[0]):
            if d not in node[2]:
                node[2][d] = (key, [value], {})
                return
            node = node[2][d]
        if value not in node[1]:
            node[1].append(value)

    def within(self, key: str, most: int) -> list[tuple[int, str, Any]]:
        out, todo, to = [], [self.root] if self.root else [], metric(key)
        while todo:
            at, values, children = todo.pop()
            d = to(at)
            if d <= most:
                out += [(d, at, v) for v in values]
            todo += [child for edge, child in children.items() if abs(edge - d) <= most]
        return out


def allowed(key: str) -> int:
    """Edits allowed: a swap of letters takes two; none in short names, more in long ones; numbers must agree anyway."""
    letters = sum(c.isalpha() for c in key)
    if letters < len(key.replace(" ", "")):
        return 0 if not letters else 2 if letters < 13 else 3
    return 0 if letters < 6 else 1 if letters < 10 else 2 if letters < 15 else 3 if letters < 25 else 4


class Linker:
    """Maps typed values to reference ids through one BK-tree of (key, reference id)."""

    def __init__(self, keys: list[tuple[str, int]]) -> None:
        self.tree = BKTree()
        self.memo: dict[str, list[tuple[int, str, int]]] = {}
        for key, source in sorted(keys):
            self.tree.add(key, source)

    def forms(self, value: str) -> list[str]:
        text = source_part(fold(value))
        keys = [key_of(text), key_of(text, True)]
        if "," in text:
            head, _, tail = text.rpartition(",")
            keys.append(key_of(f"{tail} {head}"))
        if inner := re.search(r"\(([^)]*)\)", text):
            keys.append(key_of(re.sub(r"\([^)]*\)", " ", text)))
            keys.append(key_of(inner[1]))
        return list(dict.fromkeys(k for k in keys if k))

    def nearest(self, value: str) -> tuple[int, int]:
        """(distance, reference id) of the nearest entry, UNLISTED if none is near enough; ties go to the smaller id."""
        best = (10_000, UNLISTED)
        forms = self.forms(value)
        numbers = numbers_of(forms[0]) if forms else []
        for key in forms:
            if numbers_of(key) != numbers:
                continue
            if key not in self.memo:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                self.memo[key] = self.tree.within(key, allowed(key))
            for d, at, source in self.memo[key]:
                if numbers_of(at) == numbers and d <= allowed(at) and (d, source) < best:
                    best = (d, source)
        return best


def owned_keys(reference: DataFrame) -> DataFrame:
    """(key, source_id): every key and the entry it means, over the whole reference.

    A key of several entries means the one whose whole name it is (the smallest id, if of several), else none.
    """
    entries = reference.where("source_id is not null and canonical_name is not null").select(F.col("source_id").cast("long"), F.col("canonical_name").cast("string"), F.col("short_name").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, name, short in zip(*(c.to_pylist() for c in batch.columns)):
                full = key_of(re.sub(r"\([^)]*\)", " ", fold(name)))
                rows += [(key, source, key == full) for key in reference_keys(name, short)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["key", "source", "is_full"])

    keys = entries.mapInArrow(run, "key string, source long, is_full boolean").groupBy("key")
    owners = keys.agg(F.min("source").alias("lo"), F.max("source").alias("hi"), F.min(F.when(F.col("is_full"), F.col("source"))).alias("named"))
    return owners.select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("named")).alias("source_id")).where("source_id is not null")


def link(values: DataFrame, reference: DataFrame, value: str = "value", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``values`` with source_id and distance: the entry meant, -1 and null if it is none of the list.

    ``reference`` has (source_id, canonical_name, short_name). Null and blank values are unlisted; an empty reference
    leaves all unlisted; values of any length are read whole; rows are kept one for one with all their columns, except
    that columns named source_id and distance are replaced. The answers are the same for every ``shard`` and ``block``.
    """
    values = values.drop("source_id", "distance")
    keys = materialize(owned_keys(reference))
    if keys.count() > shard:
        return _sharded(values, keys, value, shard, block)
    ready = [(r["key"], r["source_id"]) for r in keys.collect()]  # at most ``shard`` rows
    kept = values.columns
    schema = StructType([*(StructField(f.name, f.dataType) for f in values.schema), StructField("source_id", LongType()), StructField("distance", IntegerType())])
    at = kept.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, memo = Linker(ready), {}
        for batch in batches:
            ids, far = [], []
            for text in batch.column(at).to_pylist():
                hit = memo.get(text)
                if hit is None:
                    if len(memo) > MEMO:
                        memo.clear()
                    d, source = linker.nearest(text) if text and text.strip() else (0, UNLISTED)
                    hit = memo[text] = (source, None if source == UNLISTED else d)
                ids.append(hit[0])
                far.append(hit[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(far, pa.int32())], names=[*kept, "source_id", "distance"])

    return values.mapInArrow(run, schema)


def _sharded(values: DataFrame, keys: DataFrame, value: str, shard: int, block: int) -> DataFrame:
    """The same by shards of the keys: each answers the distinct values, block by block, with its winners, and the nearest winner stays."""
    shards = -(-keys.count() // shard)
    asked = materialize(values.select(F.col(value).alias("_v")).where("_v is not null and trim(_v) <> ''").distinct())
    blocks = max(1, -(-asked.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_b", F.pmod(F.xxhash64("_v"), F.lit(blocks)).cast("int")).withColumn("_s", every(shards))
    right = keys.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("_b", every(blocks))

    def run(key: tuple, ask: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        linker = Linker(list(zip(part["key"], map(int, part["source_id"]))))
        hits = [(v, *linker.nearest(v)) for v in ask["_v"]]
        return pd.DataFrame([(v, s, d) for v, d, s in hits if s != UNLISTED], columns=["_v", "s", "d"])

    won = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInPandas(run, "_v string, s long, d int")
    won = won.groupBy("_v").agg(F.min(F.struct("d", "s")).alias("_w"))
    out = values.join(won, values[value] == won["_v"], "left")
    return out.select(*[values[c] for c in values.columns], F.coalesce("_w.s", F.lit(UNLISTED)).cast("long").alias("source_id"), F.col("_w.d").alias("distance"))


def found(citations: DataFrame, quotations: DataFrame, reference: DataFrame) -> DataFrame:
    """p3_found: the entry meant by every freely typed source.

    Null and blank values are no cases; repeated rows give one row; null ids stay null; empty tables give no rows, an
    empty reference leaves every case unlisted; other columns are ignored.
    """
    listed = F.broadcast(reference.select(F.col("canonical_name").alias("main_source"))) if reference.limit(SHARD + 1).count() <= SHARD else reference.select(F.col("canonical_name").alias("main_source"))
    filled = lambda c: F.col(c).isNotNull() & (F.regexp_replace(c, r"(?U)\s+", "") != "")
    typed = citations.where(filled("main_source") & (F.col("main_source") != "Otro")).select("cit_id", "main_source").join(listed, "main_source", "left_anti")
    typed = typed.select(F.lit("main_source").alias("field"), F.col("cit_id").alias("row_id"), F.lit(0).alias("elem_pos"), F.col("main_source").alias("value"))
    extra = citations.where(filled("extra") & (F.col("main_source") == "Otro")).select(F.lit("extra").alias("field"), F.col("cit_id").alias("row_id"), F.lit(0).alias("elem_pos"), F.col("extra").alias("value"))
    quoted = quotations.select(F.lit("verbatim").alias("field"), F.col("sub_id").alias("row_id"), F.posexplode("verbatim_citations").alias("elem_pos", "value")).where(filled("value"))
    return link(typed.unionByName(extra).unionByName(quoted), reference).select("field", "row_id", "elem_pos", "source_id").distinct()
