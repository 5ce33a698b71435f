"""Problem 1: deeply nested rulings as related flat tables.

Structural-variant tables: a bottom-up tree automaton gives every JSON node a state from its kind, its field set and
the states of its children. ``ROUTES`` sends each ruling, section, paragraph, citation and article by its state to a
typed subtype table; the common keys (file_id, obj_pos and the places below it) stay in every subtype table and are the
link to the parent. A supertype table is the union of its subtypes. What no typed table has a column for goes to
``members``, a row for every node below it with the number of its parent, so nothing stays nested.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.plans.scratch import materialize
from estrado.sources.fallos import dumps, first_delivery, iter_rulings, parse

NODES = "table string, file_id bigint, obj_pos int, i int, j int, key string, variant string, val string, num bigint, parent bigint"
_ARROW = pa.schema([("table", pa.string()), ("file_id", pa.int64()), ("obj_pos", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.string()), ("variant", pa.string()), ("val", pa.string()), ("num", pa.int64()), ("parent", pa.int64())])
#: State of a list by the set of its elements' states, nulls aside; any other set is ``lista_otro``.
_LIST_RULES = {frozenset(): "lista_vacia", frozenset({"texto"}): "lista_texto", frozenset({"numero"}): "lista_numero", frozenset({"parrafo"}): "lista_objeto", frozenset({"texto", "parrafo"}): "lista_mixta", frozenset({"cita"}): "lista_cita"}
#: States of an object by the fields that tell it, the first that applies: (state, fields of which one must be there).
_OBJECT_RULES = (("cita", ("main_source", "cited_articles", "extra", "extras")), ("citas", ("citations",)), ("metadatos", ("ID_FALLO", "ARTICULOS_CITADOS", "MES")), ("fallo", ("METADATOS", "CONTENIDO")))


def _object_state(states: dict[str, str]) -> str:
    if states.get("texto") == "texto":
        return "parrafo"
    return next((state for state, fields in _OBJECT_RULES if any(f in states for f in fields)), "objeto")


def _list_state(states: set[str]) -> str:
    if states == {"nulo"}:
        return "lista_nula"
    return _LIST_RULES.get(frozenset(states - {"nulo"}), "lista_otro")


def state(node: Any) -> str:
    """The automaton's run on one node, children first and with a stack of its own, so that any depth will do.

    An object with a textual ``texto`` is a paragraph; the other objects' states follow from their field sets.
    """
    if node is None:
        return "nulo"
    if isinstance(node, str):
        return "texto"
    if isinstance(node, bool):
        return "logico"
    if isinstance(node, (int, float)):
        return "numero"
    open_: list[tuple[Any, Iterator[tuple[Any, Any]], dict[Any, str] | set[str]]] = []
    done: str | None = None

    def enter(value: Any) -> None:
        is_object = isinstance(value, dict)
        open_.append((value, iter(value.items() if is_object else ((None, v) for v in value)), {} if is_object else set()))

    enter(node)
    keys: list[Any] = []
    while open_:
        value, rest, states = open_[-1]
        for key, child in rest:
            if isinstance(child, (dict, list)):
                keys.append(key)
                enter(child)
                break
            of = state(child)
            if isinstance(states, dict):
                states[key] = of
            else:
                states.add(of)
        else:
            open_.pop()
            done = _object_state(states) if isinstance(states, dict) else _list_state(states)
            if open_:
                above, key = open_[-1][2], keys.pop()
                if isinstance(above, dict):
                    above[key] = done
                else:
                    above.add(done)
    return done or "objeto"


def scalar(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else dumps(value)


def paragraph_text(value: Any) -> str | None:
    """A paragraph's own text: the string, or the member ``texto`` of an object; JSON text of any other shape."""
    if isinstance(value, dict) and isinstance(value.get("texto"), str):
        return value["texto"]
    return scalar(value)


def citations_of(ruling: dict[str, Any]) -> list[Any]:
    """The citations of a ruling; one that stands without a list is the only one."""
    meta = ruling.get("METADATOS")
    cited = meta.get("ARTICULOS_CITADOS") if isinstance(meta, dict) else None
    found = cited.get("citations") if isinstance(cited, dict) else None
    return found if isinstance(found, list) else [found] if isinstance(found, dict) else []


def contents_of(ruling: dict[str, Any]) -> dict[str, Any]:
    found = ruling.get("CONTENIDO")
    return found if isinstance(found, dict) else {}


#: Subtype table by supertype and state; states without a rule go to the subtype under None.
ROUTES: dict[str, dict[str | None, str]] = {
    "rulings": {**dict.fromkeys(("objeto", "parrafo", *(s for s, _ in _OBJECT_RULES)), "rulings_secciones"), None: "rulings_otro"},
    "sections": {"nulo": "sections_vacia", "lista_vacia": "sections_vacia", "lista_nula": "sections_vacia", None: "sections_llena"},
    "paragraphs": {"texto": "paragraphs_texto", "lista_texto": "paragraphs_lista", "lista_objeto": "paragraphs_objeto", "lista_mixta": "paragraphs_objeto", "parrafo": "paragraphs_objeto", None: "paragraphs_otro"},
    "citations": {"nulo": "citations_sin_articulos", "lista_vacia": "citations_sin_articulos", "lista_nula": "citations_sin_articulos", None: "citations_articulos"},
    "articles": {"numero": "articles_numero", None: "articles_otro"},
    "members": {None: "members"},
    "rejects": {None: "rejects"},
}
SUBTYPES = {name: tuple(dict.fromkeys(rule.values())) for name, rule in ROUTES.items()}


def route(table: str, variant: str | None) -> str:
    rule = ROUTES[table]
    return rule.get(variant) or rule[None]


_TYPED = {"main_source", "cited_articles", "extra", "extras"}


def _others(ruling: dict[str, Any]) -> Iterator[tuple[str, int | None, int | None, Any]]:
    """(path, i, j, value) of what has no column in a typed table: i, j are the places of the row it belongs to."""
    for key, value in ruling.items():
        if key == "METADATOS" and isinstance(value, dict):
            for k, v in value.items():
                if k == "ARTICULOS_CITADOS" and isinstance(v, dict):
                    for c, w in v.items():
                        if c != "citations" or not isinstance(w, (list, dict)):
                            yield f"METADATOS.{k}.{c}", None, None, w
                elif k != "ID_FALLO" or isinstance(v, (dict, list)):
                    yield f"METADATOS.{k}", None, None, v
        elif key != "CONTENIDO" or not isinstance(value, dict):
            yield key, None, None, value
    for i, cited in enumerate(citations_of(ruling)):
        if not isinstance(cited, dict):
            if cited is not None:
                yield "citations", i, None, cited
            continue
        for k, v in cited.items():
            if k not in _TYPED or isinstance(v, dict) or isinstance(v, list) and k != "cited_articles":
                yield f"citations.{k}", i, None, v
    for i, (name, value) in enumerate(contents_of(ruling).items()):
        for j, item in enumerate(value if isinstance(value, list) else [value]):
            if isinstance(item, dict):
                for k, v in item.items():
                    if k not in ("texto", "orden") or k == "texto" and not isinstance(v, str) or k == "orden" and not isinstance(v, int):
                        yield f"CONTENIDO.{name}.{k}", i, j, v
            elif isinstance(item, list):
                yield f"CONTENIDO.{name}", i, j, item


def _emit(file_id: int | None, pos: int, ruling: dict[str, Any], tables: frozenset[str], rows: list[tuple]) -> None:
    def put(table: str, i: int | None, j: int | None, key: str | None, variant: str, val: str | None, num: int | None) -> None:
        rows.append((route(table, variant), file_id, pos, i, j, key, variant, val, num, None))

    if "rulings" in tables:
        meta = ruling.get("METADATOS")
        put("rulings", None, None, scalar(meta.get("ID_FALLO")) if isinstance(meta, dict) else None, state(ruling.get("CONTENIDO")), state(ruling), None)
    if "paragraphs" in tables or "sections" in tables:
        for i, (name, value) in enumerate(contents_of(ruling).items()):
            kind = state(value)
            if "sections" in tables:
                put("sections", i, None, name, kind, None, len(value) if isinstance(value, list) else None)
            if value is None or "paragraphs" not in tables:
                continue
            for j, item in enumerate(value if isinstance(value, list) else [value]):
                if item is not None:
                    orden = item.get("orden") if isinstance(item, dict) else None
                    put("paragraphs", i, j, name, kind, paragraph_text(item), orden if isinstance(orden, int) and abs(orden) < 2**63 else None)
    if "citations" in tables or "articles" in tables:
        for i, cited in enumerate(citations_of(ruling)):
            if not isinstance(cited, dict):
                continue
            source, articles = scalar(cited.get("main_source")), cited.get("cited_articles")
            if "citations" in tables:
                put("citations", i, None, source, state(articles), scalar(cited.get("extra", cited.get("extras"))), None)
            if articles is None or "articles" not in tables:
                continue
            for j, article in enumerate(articles if isinstance(articles, list) else [articles]):
                val = scalar(article)
                put("articles", i, j, source, state(article), val, int(val) if val and val.isascii() and val.isdigit() and len(val) < 19 else None)
    if "members" in tables:
        number = 0
        for path, i, j, value in _others(ruling):
            todo: list[tuple[str, int | None, Any]] = [(path, None, value)]
            while todo:
                at, parent, node = todo.pop()
                leaf = not isinstance(node, (dict, list))
                rows.append(("members", file_id, pos, i, j, at, state(node) if leaf else "objeto" if isinstance(node, dict) else "lista", scalar(node) if leaf else None, number, parent))
                if not leaf:
                    inner = list(node.items()) if isinstance(node, dict) else list(enumerate(node))
                    todo += [(str(k), number, v) for k, v in reversed(inner)]
                number += 1


def nodes(files: DataFrame, *tables: str) -> DataFrame:
    """One pass over the payloads; a row per node of the asked supertypes, ``table`` being the subtype it is routed to."""
    wanted = frozenset(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, payloads = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            for n in range(batch.num_rows):
                file_id, payload = ids[n].as_py(), payloads[n].as_py()
                for pos, ruling in iter_rulings(payload):
                    _emit(file_id, pos, ruling, wanted, rows)
                if "rejects" in wanted and (reason := _unreadable(payload)):
                    rows.append(("rejects", file_id, None, None, None, None, reason, payload, None, None))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows.clear()
            if rows:
                yield _batch(rows)

    return first_delivery(files).mapInArrow(run, NODES)


def _unreadable(payload: str) -> str | None:
    try:
        root = parse(payload)
    except (ValueError, TypeError):
        return "ilegible"
    return None if isinstance(root, dict) or isinstance(root, list) and all(isinstance(r, dict) for r in root) else "sin_objeto"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


_LINK = ["file_id", "obj_pos"]


def _typed(name: str, of: DataFrame) -> DataFrame:
    """The rows of one supertype or subtype under its own column names."""
    kind = next(s for s, subs in SUBTYPES.items() if name == s or name in subs)
    c = F.col
    if kind == "rulings":
        return of.select(*_LINK, c("key").alias("id_fallo"), c("variant").alias("contenido_variant"), c("val").alias("variant"))
    if kind == "sections":
        return of.select(*_LINK, c("i").alias("section_pos"), c("key").alias("section"), "variant", c("num").alias("n_elements"))
    if kind == "paragraphs":
        extra = [c("num").alias("orden")] if name == "paragraphs_objeto" else []
        return of.select(*_LINK, c("i").alias("section_pos"), c("j").alias("para_pos"), c("key").alias("section"), "variant", c("val").alias("text"), *extra)
    if kind == "citations":
        return of.select(*_LINK, c("i").alias("citation_pos"), c("key").alias("main_source"), c("variant").alias("articles_variant"), c("val").alias("extra"))
    if kind == "articles":
        return of.select(*_LINK, c("i").alias("citation_pos"), c("j").alias("article_pos"), c("key").alias("main_source"), c("val").alias("article"), c("num").alias("article_no"))
    if kind == "rejects":
        return of.select("file_id", c("variant").alias("reason"), c("val").alias("payload"))
    return of.select(*_LINK, c("i").alias("pos"), c("j").alias("sub_pos"), c("num").alias("node"), "parent", "key", "variant", c("val").alias("value"))


TABLES = tuple(dict.fromkeys([*ROUTES, *(s for subs in SUBTYPES.values() for s in subs)]))


def flat_tables(files: DataFrame, *names: str) -> dict[str, DataFrame]:
    """The related flat tables of ``files`` (file_id, payload, recibido_at), all of them or the named ones.

    ``rulings`` (file_id, obj_pos) is the root; ``sections`` and ``citations`` link to it; ``articles`` links to
    ``citations`` by i; ``paragraphs`` links to ``sections`` by i. Each is the union of its subtypes in ``ROUTES``, named
    ``paragraphs_texto`` and so on; ``paragraphs_objeto`` adds ``orden``. ``members`` holds the nodes below every other
    member, numbered within the ruling, with the number of their parent (null at the top, where ``key`` is the path) and
    the place (pos, sub_pos) of the citation or paragraph they belong to. ``rejects`` holds payloads that are no rulings.
    The payloads are read once and the nodes written in folders by subtype, of which each table reads its own.

    Null and empty sections have no paragraphs but keep their row in ``sections``; null elements of a section are no
    paragraphs and keep their place; a null article is a row with null val; a lone citation object is the only one of its
    list; values may be nested to any depth; unreadable and null payloads give no rows but in ``rejects`` (null ones none at
    all); a file counts once; empty input gives empty tables; other columns of ``files`` are ignored.
    """
    names = names or TABLES
    kinds = dict.fromkeys(s for n in names for s, subs in SUBTYPES.items() if n == s or n in subs)
    of = materialize(nodes(files, *kinds), "table")
    tables = {}
    for name in names:
        subs = SUBTYPES.get(name, (name,))
        parts = [_typed(name, of.where(F.col("table") == sub)) for sub in subs]
        tables[name] = functools.reduce(DataFrame.unionByName, parts)
    return tables


def found(files: DataFrame) -> DataFrame:
    """p1_found: every paragraph and every cited article with its place, from the flat tables; see ``flat_tables`` for nulls, repeats and the like."""
    tables = flat_tables(files, "paragraphs", "articles")
    a = tables["paragraphs"].select(*_LINK, F.lit("parrafo").alias("child"), F.col("section_pos").alias("i"), F.col("para_pos").alias("j"), F.col("section").alias("val"))
    b = tables["articles"].select(*_LINK, F.lit("articulo").alias("child"), F.col("citation_pos").alias("i"), F.col("article_pos").alias("j"), F.col("article").alias("val"))
    return a.unionByName(b)
