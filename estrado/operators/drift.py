"""Problem 4: schemas that drift between deliveries.

Every court's rulings are profiled by delivery and field: how many hold it, the types of its values, its place among
its siblings, and sketches of its content (the smallest hashes of its lines, counts of their shapes by hash bucket, mean
length), all of bounded size. Lasting changes follow from the shares by delivery. Fields that vanish and fields that appear
at the same delivery under the same parent are matched as a bipartite graph weighted by name, content and place; matched
pairs are renames, and the unified table reads both names as one field, its values brought to common types.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.operators.nested import citations_of, contents_of, scalar
from estrado.plans.scratch import materialize
from estrado.sources.fallos import dumps, first_delivery, iter_rulings

ABSENT, PRESENT, TYPED = 0.2, 0.8, 0.8
#: Hashes kept of a field's lines in each sketch.
SKETCH = 64
#: Least weight of a matched pair that counts as a rename.
RENAMED = 0.47
#: Lines of more characters have the shape of running text.
PROSE = 80
_CITED = "METADATOS.ARTICULOS_CITADOS.citations"
_PARENTS = frozenset({"METADATOS", "METADATOS.ARTICULOS_CITADOS", "CONTENIDO"})
#: Buckets that the shapes of lines are counted in, besides the one for running text.
BUCKETS = 63
#: Groups of tasks whose sketches are merged first.
SALT = 32
#: Most courts with renames that are broadcast.
COURTS = 100_000
_PROFILE = "organo string, lote int, field string, salt int, n long, place double, chars long, held long, sketch array<long>, tally map<string,long>"
_ARROW = pa.schema([("organo", pa.string()), ("lote", pa.int32()), ("field", pa.string()), ("salt", pa.int32()), ("n", pa.int64()), ("place", pa.float64()), ("chars", pa.int64()), ("held", pa.int64()), ("sketch", pa.list_(pa.int64())), ("tally", pa.map_(pa.string(), pa.int64()))])


def type_of(value: Any) -> str:
    """string, number, boolean, object, array<...> of the first element; '' for null and empty values."""
    if value is None or value == "" or value == [] or value == {}:
        return ""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, dict):
        return "object"
    depth = 0
    while isinstance(value, list) and value:
        value, depth = value[0], depth + 1
    return "array<" * depth + (type_of(value) or "null") + ">" * depth


def fields_of(ruling: dict[str, Any]) -> Iterator[tuple[str, int, list[Any]]]:
    """(path, place among its siblings, values) of a ruling's fields; of citations the values of all of them."""
    for pos, (key, value) in enumerate(ruling.items()):
        if key not in ("METADATOS", "CONTENIDO"):
            yield key, pos, [value]
    meta = ruling.get("METADATOS")
    for pos, (key, value) in enumerate(meta.items() if isinstance(meta, dict) else ()):
        if key != "ARTICULOS_CITADOS":
            yield f"METADATOS.{key}", pos, [value]
    pos = 0
    for key, value in contents_of(ruling).items():
        if not key.endswith(" DIJO"):
            yield f"CONTENIDO.{key}", pos, [value]
            pos += 1
    cited: dict[str, tuple[int, list[Any]]] = {}
    for citation in citations_of(ruling):
        for pos, (key, value) in enumerate(citation.items() if isinstance(citation, dict) else ()):
            cited.setdefault(key, (pos, []))[1].append(value)
    for key, (pos, values) in cited.items():
        yield f"{_CITED}.{key}", pos, values


def members_of(ruling: dict[str, Any]) -> Iterator[tuple[str, Any]]:
    """(path, value) of everything a ruling holds, for the unified table; ``fields_of`` leaves out what the report does.

    Judges' sections and the other members of ARTICULOS_CITADOS are members like any; an object that holds members has
    no row of its own, of any other shape (null, text, list, empty) it has one. Of the citations, each member holds the
    values of all of them; those that are no objects, or empty, are kept in a list under the path of the citations.
    """

    def walk(path: str, value: Any) -> Iterator[tuple[str, Any]]:
        if path == _CITED and isinstance(value, list):
            cited: dict[str, list[Any]] = {}
            for citation in value:
                for key, item in citation.items() if isinstance(citation, dict) else ():
                    cited.setdefault(f"{path}.{key}", []).append(item)
            rest = [c for c in value if not isinstance(c, dict) or not c]
            if rest or not value:
                yield path, rest
            yield from cited.items()
        elif path in _PARENTS and isinstance(value, dict) and value:
            for key, item in value.items():
                yield from walk(f"{path}.{key}", item)
        else:
            yield path, value

    for key, value in ruling.items():
        if key in ("METADATOS", "CONTENIDO"):
            yield from walk(key, value)
        else:
            yield key, value


def _lines(value: Any) -> Iterator[str]:
    """Lines of all texts of a value of any depth, in order, and the names of its members."""
    todo = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
        elif isinstance(node, dict):
            todo += [x for pair in reversed(node.items()) for x in reversed(pair)]
        elif node is not None:
            yield from scalar(node).split("\n")


def shape_of(line: str) -> str:
    """Runs of digits, capitals and small letters as one sign each; T for running text."""
    if len(line) > PROSE:
        return "T"
    line = re.sub(r"[^\W\d_a-záéíóúñü]+", "A", re.sub(r"\d+", "9", line))
    return re.sub(r"[a-záéíóúñü]+", "a", line)


def bucket_of(shape: str) -> str:
    return shape if shape == "T" else str(zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS)


def profile(files: DataFrame) -> DataFrame:
    """(organo, lote, field, n, place, chars, held, sketch, tally); the field '' counts the rulings themselves.

    ``tally`` counts types (``t:...``) and buckets of shapes (``s:...``). Combined within each task before the shuffle,
    counts as rows and sketches in two steps after it, so no row grows with the data. Rows without organo or lote hold no
    case and are left out.
    """

    def flush(acc: dict, salt: int) -> pa.RecordBatch:
        rows = [(o, l, f, salt, a[0], a[2], a[3], a[4], sorted(a[5])[:SKETCH], list(a[1].items())) for (o, l, f), a in acc.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALT
        acc: dict[tuple, list] = {}
        buckets: dict[str, str] = {}
        new = lambda: [0, defaultdict(int), 0.0, 0, 0, set()]
        for batch in batches:
            payloads, organos, lotes = batch.column("payload"), batch.column("organo"), batch.column("lote")
            for n in range(batch.num_rows):
                organo, lote = organos[n].as_py(), lotes[n].as_py()
                for _, ruling in iter_rulings(payloads[n].as_py()):
                    acc.setdefault((organo, lote, ""), new())[0] += 1
                    for field, pos, values in fields_of(ruling):
                        a = acc.get((organo, lote, field)) or acc.setdefault((organo, lote, field), new())
                        a[0] += 1
                        a[2] += pos
                        kind = next(filter(None, map(type_of, values)), "")
                        if kind:
                            a[1][f"t:{kind}"] += 1
                            a[4] += 1
                            sketch = a[5]
                            for line in _lines(values):
                                a[3] += len(line)
                                shape = shape_of(line)
                                a[1][buckets.get(shape) or buckets.setdefault(shape, f"s:{bucket_of(shape)}")] += 1
                                sketch.add(zlib.crc32(line.encode("utf-8", "surrogatepass")))
                            if len(sketch) > 16 * SKETCH:
                                a[5] = set(sorted(sketch)[:SKETCH])
            if len(acc) > 20_000:
                yield flush(acc, salt)
                acc.clear()
            if len(buckets) > 100_000:
                buckets.clear()
        if acc:
            yield flush(acc, salt)

    source = first_delivery(files.where("organo is not null and lote is not null"), "organo", "lote")
    parts = materialize(source.select("payload", "organo", F.col("lote").cast("int").alias("lote")).mapInArrow(run, _PROFILE))
    key = ["organo", "lote", "field"]
    numbers = [F.sum(c).alias(c) for c in ("n", "place", "chars", "held")]
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch")
    sums = parts.groupBy(*key, "salt").agg(*numbers, smallest).groupBy(*key).agg(*numbers, smallest)
    counts = parts.select(*key, F.explode("tally").alias("k", "m")).groupBy(*key, "k").agg(F.sum("m").alias("m"))
    tally = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("tally"))
    return sums.join(tally, key, "left")


def _changes(lotes: list[tuple[int, int]], found: dict[int, tuple[int, dict[str, int]]]) -> list[tuple[int, str]]:
    """(first lote of the new layout, kind) of one field of one court."""
    n = len(lotes)
    share = [found[l][0] / total if l in found else 0.0 for l, total in lotes]
    out: list[tuple[int, str]] = []
    for at in range(1, n):
        before, after = share[:at], share[at:]
        if max(before) <= ABSENT and min(after) >= PRESENT:
            out.append((lotes[at][0], "added"))
        if min(before) >= PRESENT and max(after) <= ABSENT:
            out.append((lotes[at][0], "removed"))
    if min(share) >= PRESENT:
        main = []
        for l, _ in lotes:
            types = found[l][1]
            kind, most = max(sorted(types.items()), key=lambda x: x[1], default=("", 0))
            main.append(kind if most and most >= TYPED * sum(types.values()) else None if most else "")
        for at in range(1, n):
            before, after = set(main[:at]) - {""}, set(main[at:]) - {""}
            if len(before) == len(after) == 1 and None not in before | after and before != after and main[at]:
                out.append((lotes[at][0], "retyped"))
    return out


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", unicodedata.normalize("NFD", name.lower()).encode("ascii", "ignore").decode())


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the character bigrams of the words, whole words counted too."""

    def grams(name: str) -> list[str]:
        return [g for w in _words(name) for g in [w, *(f" {w} "[i : i + 2] for i in range(len(w) + 1))]]

    x, y = grams(a), grams(b)
    rest = list(y)
    both = sum(1 for g in x if g in rest and (rest.remove(g) or True))
    return 2 * both / max(1, len(x) + len(y))


def _side(profiles: list[dict]) -> dict:
    total = {k: sum(p[k] for p in profiles) for k in ("n", "place", "chars", "held")}
    sums: dict[str, dict[str, int]] = {"types": defaultdict(int), "shapes": defaultdict(int)}
    for p in profiles:
        for c, to in sums.items():
            for k, v in p[c].items():
                to[k] += v
    return total | sums | {"sketch": sorted({h for p in profiles for h in p["sketch"]})[:SKETCH]}


def match_weight(old: str, new: str, a: dict, b: dict) -> float:
    """Weight of the edge between a vanished and a new field.

    Name similarity counts by its square, half; content up to 0.4: the share of common lines, or where values are
    never repeated the likeness of their shapes, types and lengths; running text has one shape only and tells little.
    The place among the siblings counts up to 0.2.
    """
    name = 0.5 * name_similarity(old, new) ** 2
    place = 0.2 / (1 + 0.5 * abs(a["place"] / a["n"] - b["place"] / b["n"]))
    if not a["held"] or not b["held"]:
        return name + place
    x, y = set(a["sketch"]), set(b["sketch"])
    cut = min(max(x), max(y))
    x, y = {h for h in x if h <= cut}, {h for h in y if h <= cut}
    common = len(x & y) / max(1, min(len(x), len(y))) if len(x | y) > 2 else 0
    na, nb = sum(a["shapes"].values()), sum(b["shapes"].values())
    alike = {s: min(n / na, b["shapes"].get(s, 0) / nb) for s, n in a["shapes"].items()}
    la, lb = a["chars"] / a["held"] + 1, b["chars"] / b["held"] + 1
    same_type = max(a["types"], key=a["types"].get) == max(b["types"], key=b["types"].get)
    likeness = sum(alike.values()) * same_type * min(la, lb) / max(la, lb)
    if not any(n for s, n in alike.items() if s != "T"):
        likeness *= 0.2
    return name + 0.4 * max(common, likeness) + place


def best_matching(weight: list[list[float]], least: float) -> list[tuple[int, int]]:
    """Pairs of a matching of greatest weight among the edges of at least ``least``.

    Augmenting by the assignment of the Hungarian method on the padded square matrix.
    """
    rows, cols = len(weight), len(weight[0]) if weight else 0
    size = max(rows, cols)
    cost = [[-(weight[r][c] if r < rows and c < cols and weight[r][c] >= least else 0.0) for c in range(size)] for r in range(size)]
    u, v, owner = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for r in range(1, size + 1):
        owner[0], col = r, 0
        low, via, done = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while owner[col]:
            done[col], row, delta, nxt = True, owner[col], float("inf"), 0
            for c in range(1, size + 1):
                if not done[c]:
                    slack = cost[row - 1][c - 1] - u[row] - v[c]
                    if slack < low[c]:
                        low[c], via[c] = slack, col
                    if low[c] < delta:
                        delta, nxt = low[c], c
            for c in range(size + 1):
                if done[c]:
                    u[owner[c]] += delta
                    v[c] -= delta
                else:
                    low[c] -= delta
            col = nxt
        while col:
            owner[col], col = owner[via[col]], via[col]
    return [(owner[c] - 1, c - 1) for c in range(1, size + 1) if owner[c] and owner[c] <= rows and c <= cols and weight[owner[c] - 1][c - 1] >= least]


def _parent(field: str) -> str:
    return field.rpartition(".")[0]


def court_changes(profiles: list[dict]) -> list[tuple[int, str, str, str]]:
    """(lote, change_kind, field_path, new_path) of one court from its profile rows."""
    lotes = sorted((p["lote"], p["n"]) for p in profiles if p["field"] == "")
    fields: dict[str, dict[int, dict]] = defaultdict(dict)
    for p in profiles:
        if p["field"]:
            fields[p["field"]][p["lote"]] = p
    out, moved = [], defaultdict(lambda: ([], []))
    for field, by in sorted(fields.items()):
        for lote, kind in _changes(lotes, {l: (p["n"], p["types"]) for l, p in by.items()}):
            if kind == "retyped":
                out.append((lote, kind, field, ""))
            else:
                moved[lote, _parent(field)][kind == "added"].append(field)
    for (lote, _), (gone, come) in moved.items():
        weight = [[match_weight(a.rpartition(".")[2], b.rpartition(".")[2], _side([p for l, p in fields[a].items() if l < lote]), _side([p for l, p in fields[b].items() if l >= lote])) for b in come] for a in gone]
        pairs = best_matching(weight, RENAMED) if gone and come else []
        out += [(lote, "renamed", gone[r], come[c]) for r, c in pairs]
        out += [(lote, "removed", a, "") for a in set(gone) - {gone[r] for r, _ in pairs}]
        out += [(lote, "added", b, "") for b in set(come) - {come[c] for _, c in pairs}]
    return out


def changes(files: DataFrame) -> DataFrame:
    """(organo, lote, change_kind, field_path, new_path): every lasting change of every court's layout.

    A group holds one court's profile: deliveries times fields, not rulings. Courts with a single delivery have no
    changes; null and empty payloads, missing members and unreadable files count as they are; empty input gives no rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.to_dict("records")
        for row in rows:
            tally = dict(row["tally"]) if row["tally"] is not None else {}
            for c in ("types", "shapes"):
                row[c] = {k[2:]: n for k, n in tally.items() if k[0] == c[0]}
            row["sketch"] = list(row["sketch"]) if row["sketch"] is not None else []
        organo = rows[0]["organo"]
        return pd.DataFrame([(organo, *r) for r in court_changes(rows)], columns=["organo", "lote", "change_kind", "field_path", "new_path"])

    return profile(files).groupBy("organo").applyInPandas(run, "organo string, lote int, change_kind string, field_path string, new_path string")


def newest_names(members: list[tuple[str, Any]], renames: list[tuple[int, str, str]]) -> list[str]:
    """The unified name of each member of a ruling: the end of its chain of renames, unless the ruling holds that too."""
    to = {old: new for _, old, new in sorted(renames)}
    taken = {path for path, _ in members}
    out = []
    for path, _ in members:
        seen = [path]
        while seen[-1] in to and to[seen[-1]] not in seen:
            seen.append(to[seen[-1]])
        new = seen[-1]
        if new != path and new not in taken:
            taken.add(new)
            out.append(new)
        else:
            out.append(path)
    return out


_PLAIN = re.compile(r"[+-]?\d{1,15}(?:\.\d{1,15})?$")


def typed(value: Any) -> tuple[str, list[str | None] | None, float | None]:
    """(type, items, number): the value's own type, its content as a list of texts, and its number.

    These are the same for a bare text and a list of one, a paragraph object and its text, a number and its digits, so
    deliveries of either type read alike.
    """

    def text(item: Any) -> str | None:
        return item["texto"] if isinstance(item, dict) and isinstance(item.get("texto"), str) else scalar(item)

    items = None if value is None else [text(v) for v in value] if isinstance(value, list) else [text(value)]
    only = items[0] if items and len(items) == 1 else None
    return type_of(value), items, float(only) if only and _PLAIN.match(only) else None


def unified(files: DataFrame) -> DataFrame:
    """All rulings in one consistent table: (file_id, obj_pos, organo, lote, field_path, type, items, number, value).

    Long form, so any court's layout fits. Renamed fields carry their newest name, once a ruling: where it holds the new
    name too, the old member keeps its own. ``items`` and ``number`` are of one type whatever the value's was (see
    ``typed``); ``value`` is the JSON text as delivered. The fields of citations hold the array of all citations' values.
    The table holds all that ``members_of`` finds, judges' sections included, more than the fields of the change report.
    Null members are rows with the text null; unreadable and null payloads give no rows; a file counts once; rows without
    organo or lote are kept.
    """
    names = ["file_id", "obj_pos", "organo", "lote", "field_path", "type", "items", "number", "value"]
    types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                renames = [(r["lote"], r["field_path"], r["new_path"]) for r in row["_to"] or ()]
                for pos, ruling in iter_rulings(row["payload"]):
                    members = list(members_of(ruling))
                    for field, (_, value) in zip(newest_names(members, renames), members):
                        rows.append((row["file_id"], pos, row["organo"], row["lote"], field, *typed(value), dumps(value)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    source = first_delivery(files, "organo", "lote").withColumn("lote", F.col("lote").cast("int"))
    renames = materialize(changes(files).where("change_kind = 'renamed'").groupBy("organo").agg(F.array_sort(F.collect_list(F.struct("lote", "field_path", "new_path"))).alias("_to")))
    few = F.broadcast(renames) if renames.count() <= COURTS else renames
    rows = source.join(few, "organo", "left").select("file_id", "organo", "lote", "payload", "_to")
    return rows.mapInArrow(run, "file_id bigint, obj_pos int, organo string, lote int, field_path string, type string, items array<string>, number double, value string")
