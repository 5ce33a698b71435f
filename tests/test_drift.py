import json
import random
from datetime import datetime

from estrado.operators import drift

SCHEMA = "file_id bigint, path string, organo string, lote int, recibido_at timestamp, payload string"
AT = datetime(2024, 1, 1)


def court(make, organo="A", lotes=4, each=10):
    n = hash(organo) % 1000 * 1000
    for lote in range(1, lotes + 1):
        for k in range(each):
            n += 1
            yield (n, f"{n}.json", organo, lote, AT, json.dumps(make(lote, k)))


def prose(seed):
    r = random.Random(seed)
    return [" ".join(r.choice("juez parte demanda costa recurso agravio prueba plazo".split()) for _ in range(30))]


def changes(spark, data):
    return {tuple(r) for r in drift.changes(spark.createDataFrame(list(data), SCHEMA)).collect()}


def test_added_removed_retyped_renamed(spark):
    def make(lote, k):
        meta = {"ID_FALLO": k if lote >= 2 else str(k), ("PERIODO" if lote < 3 else "MES"): f"{k % 12 + 1:02d}"}
        if lote >= 4:
            meta["SALA"] = "II"
        body = {"INICIO": prose(k), ("ACUERDO" if lote < 3 else "///CUERDO"): prose(k + 99), "Y VISTO": prose(k + 999)}
        if lote >= 3:
            del body["Y VISTO"]
        return {"METADATOS": meta, "CONTENIDO": body}

    assert changes(spark, court(make)) == {
        ("A", 2, "retyped", "METADATOS.ID_FALLO", ""),
        ("A", 3, "renamed", "METADATOS.PERIODO", "METADATOS.MES"),
        ("A", 4, "added", "METADATOS.SALA", ""),
        ("A", 3, "renamed", "CONTENIDO.ACUERDO", "CONTENIDO.///CUERDO"),
        ("A", 3, "removed", "CONTENIDO.Y VISTO", ""),
    }


def test_single_deviations_are_no_changes(spark):
    def make(lote, k):
        return {"METADATOS": {"ID_FALLO": str(k)}, "CONTENIDO": {"X": prose(k) if k else "bare"}} | ({"EXTRA": 1} if k == 0 else {})

    assert changes(spark, court(make)) == set()


def test_citation_members_and_empty_values(spark):
    def make(lote, k):
        member = "extras" if lote >= 3 else "extra"
        return {"METADATOS": {"ARTICULOS_CITADOS": {"citations": [{"main_source": "L", member: None}, {"main_source": "L", member: ["a", "b"][k % 2]}]}}, "CONTENIDO": {}, "VACIA": [] if lote < 3 else None}

    path = "METADATOS.ARTICULOS_CITADOS.citations."
    assert changes(spark, court(make)) == {("A", 3, "renamed", f"{path}extra", f"{path}extras")}


def test_nulls_repeats_and_empty_table(spark):
    assert changes(spark, []) == set()
    data = [(1, None, None, 1, AT, "{}"), (2, None, "A", None, AT, "{}"), (3, None, "A", 1, AT, None), (4, None, "A", 2, AT, "{x")]
    assert changes(spark, data) == set()
    one = list(court(lambda lote, k: {"A": 1} if lote > 2 else {}))
    assert changes(spark, one + one) == {("A", 3, "added", "A", "")}


def test_one_table_under_the_newest_names(spark):
    df = spark.createDataFrame(list(court(lambda lote, k: {"MATERIA_PRELIMINAR" if lote < 3 else "MATERIA": f"ASUNTO {k}"})), SCHEMA)
    out = drift.unified(df)
    assert out.count() == 40 and {r.field_path for r in out.select("field_path").distinct().collect()} == {"MATERIA"}


def test_unified_table_holds_every_member(spark):
    rulings = [
        {"CONTENIDO": {"INICIO": ["a"], "PAZ DIJO": ["b", {"texto": "c"}], "LUZ DIJO": None}, "METADATOS": {"MES": "01", "ARTICULOS_CITADOS": {"total": 3, "citations": [{"main_source": "L"}, None, {"main_source": None, "extra": "x"}]}}},
        {"CONTENIDO": ["suelto"], "METADATOS": "ilegible"},
        {"CONTENIDO": None, "METADATOS": {"ARTICULOS_CITADOS": ["L"]}},
        {"CONTENIDO": {}, "METADATOS": {"ARTICULOS_CITADOS": {"citations": "L"}}},
        {"CONTENIDO": "x", "METADATOS": {"ARTICULOS_CITADOS": {"citations": []}}},
    ]
    out = drift.unified(spark.createDataFrame([(1, "1.json", "A", 1, AT, json.dumps(rulings))], SCHEMA))
    cited = "METADATOS.ARTICULOS_CITADOS"
    assert sorted((r.obj_pos, r.field_path, r.value) for r in out.collect()) == sorted([
        (0, "CONTENIDO.INICIO", '["a"]'), (0, "CONTENIDO.PAZ DIJO", '["b", {"texto": "c"}]'), (0, "CONTENIDO.LUZ DIJO", "null"), (0, "METADATOS.MES", '"01"'),
        (0, f"{cited}.total", "3"), (0, f"{cited}.citations", "[null]"), (0, f"{cited}.citations.main_source", '["L", null]'), (0, f"{cited}.citations.extra", '["x"]'),
        (1, "CONTENIDO", '["suelto"]'), (1, "METADATOS", '"ilegible"'),
        (2, "CONTENIDO", "null"), (2, cited, '["L"]'),
        (3, "CONTENIDO", "{}"), (3, f"{cited}.citations", '"L"'),
        (4, "CONTENIDO", '"x"'), (4, f"{cited}.citations", "[]"),
    ])
    assert {f for ruling in rulings for f, _, _ in drift.fields_of(ruling)} == {"CONTENIDO.INICIO", "METADATOS.MES", f"{cited}.citations.main_source", f"{cited}.citations.extra"}


def test_unified_values_are_of_one_type(spark):
    def make(lote, k):
        return {"METADATOS": {"ID_FALLO": k if lote < 3 else str(k)}, "CONTENIDO": {"X": "p" if lote < 3 else ["p"], "Y": [{"texto": "q", "orden": 1}] if k else ["q"]}}

    out = drift.unified(spark.createDataFrame(list(court(make)), SCHEMA))
    one = {(r.field_path, tuple(r["items"]), r.number) for r in out.where("field_path <> 'METADATOS.ID_FALLO'").collect()}
    assert one == {("CONTENIDO.X", ("p",), None), ("CONTENIDO.Y", ("q",), None)}
    assert {r.number for r in out.where("field_path = 'METADATOS.ID_FALLO'").collect()} == set(map(float, range(10)))
    assert {r.type for r in out.where("field_path = 'CONTENIDO.X'").collect()} == {"string", "array<string>"}


def test_names_of_a_ruling_are_never_given_twice():
    renames = [(2, "A", "B"), (4, "B", "C"), (5, "D", "C")]
    name = lambda *fields: drift.newest_names([(f, 1) for f in fields], renames)
    assert name("A") == ["C"] and name("B", "X") == ["C", "X"] and name("A", "C") == ["A", "C"] and name("A", "D") == ["C", "D"]
    assert drift.newest_names([("A", 1)], [(2, "A", "B"), (3, "B", "A")]) == ["B"]


def test_unified_like_brute_force(spark):
    import os

    import duckdb
    import pytest

    path = "/root/testdata/sf0.001/fallos_json.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    files = spark.read.parquet(path)
    renames = {}
    for r in drift.changes(files).where("change_kind = 'renamed'").collect():
        renames.setdefault(r.organo, []).append((r.lote, r.field_path, r.new_path))
    want = []
    for file_id, organo, lote, payload in duckdb.sql(f"SELECT file_id, any_value(organo), any_value(lote), any_value(payload) FROM '{path}' WHERE json_valid(payload) GROUP BY file_id").fetchall():
        root = json.loads(payload)
        for pos, ruling in enumerate(root if isinstance(root, list) else [root]):
            flat = {}
            for key, value in ruling.items():
                for k, v in value.items() if key in ("METADATOS", "CONTENIDO") else [(None, value)]:
                    if k == "ARTICULOS_CITADOS":
                        for c in v["citations"]:
                            for m, w in (c or {}).items():
                                flat.setdefault(f"{key}.{k}.citations.{m}", []).append(w)
                        if None in v["citations"] or not v["citations"]:
                            flat[f"{key}.{k}.citations"] = [c for c in v["citations"] if not c]
                    else:
                        flat[key if k is None else f"{key}.{k}"] = v
            for _, old, new in sorted(renames.get(organo, [])):
                if old in flat and new not in flat:
                    flat[new] = flat.pop(old)
            want += [(file_id, pos, organo, lote, f, json.dumps(v, ensure_ascii=False)) for f, v in flat.items()]
    got = drift.unified(files).select("file_id", "obj_pos", "organo", "lote", "field_path", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_deep_values_are_profiled_and_unified(spark):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    data = [(1, "1.json", "A", 1, AT, f'{{"CONTENIDO": {{"X": {deep}}}, "HONDO": {deep}}}')]
    df = spark.createDataFrame(data, SCHEMA)
    assert drift.changes(df).count() == 0
    assert {(r.field_path, len(r.value)) for r in drift.unified(df).collect()} == {("CONTENIDO.X", 40_001), ("HONDO", 40_001)}


def test_types():
    for value, want in ((None, ""), ([], ""), ([[]], "array<null>"), ([None], "array<null>"), ([[1], 2], "array<array<number>>"), ([{"a": 1}], "array<object>"), (True, "boolean"), ([""], "array<null>"), ({}, "")):
        assert drift.type_of(value) == want


def test_matching_is_of_greatest_weight():
    assert sorted(drift.best_matching([[0.9, 0.8], [0.8, 0.1]], 0.3)) == [(0, 1), (1, 0)]
    assert drift.best_matching([[0.2]], 0.3) == []
    assert sorted(drift.best_matching([[0.5, 0.9, 0.0]], 0.3)) == [(0, 1)]


def test_changes_like_a_plain_count(spark):
    """Renames taken apart into what went and what came, against shares counted one by one on whole tables."""
    import os
    from collections import Counter, defaultdict

    import duckdb
    import pytest

    path = "/root/testdata/sf0.01/fallos_json.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    total, held, kinds = Counter(), Counter(), defaultdict(Counter)
    for organo, lote, payload in duckdb.sql(f"SELECT any_value(organo), any_value(lote), any_value(payload) FROM '{path}' WHERE json_valid(payload) GROUP BY file_id").fetchall():
        root = json.loads(payload)
        for ruling in root if isinstance(root, list) else [root]:
            total[organo, lote] += 1
            flat = {k: [v] for k, v in ruling.items() if k not in ("METADATOS", "CONTENIDO")}
            flat |= {f"METADATOS.{k}": [v] for k, v in ruling["METADATOS"].items() if k != "ARTICULOS_CITADOS"}
            flat |= {f"CONTENIDO.{k}": [v] for k, v in ruling["CONTENIDO"].items() if not k.endswith(" DIJO")}
            for c in ruling["METADATOS"]["ARTICULOS_CITADOS"]["citations"]:
                for k, v in (c or {}).items():
                    flat.setdefault(f"METADATOS.ARTICULOS_CITADOS.citations.{k}", []).append(v)
            for field, values in flat.items():
                held[organo, lote, field] += 1
                some = [v for v in values if v not in (None, "", [], {})]
                if some:
                    first = some[0]
                    kinds[organo, lote, field][f"list {type(first[0])}" if isinstance(first, list) else str(type(first))] += 1
    want = set()
    for organo in {o for o, _ in total}:
        lotes = sorted(l for o, l in total if o == organo)
        for field in {f for o, _, f in held if o == organo}:
            share = [held[organo, l, field] / total[organo, l] for l in lotes]
            for n in range(1, len(lotes)):
                if max(share[:n]) <= 0.2 and min(share[n:]) >= 0.8:
                    want.add((organo, lotes[n], "added", field))
                if min(share[:n]) >= 0.8 and max(share[n:]) <= 0.2:
                    want.add((organo, lotes[n], "removed", field))
                main = [kinds[organo, l, field].most_common(1) for l in lotes]
                sure = all(m and m[0][1] >= 0.8 * sum(kinds[organo, l, field].values()) for m, l in zip(main, lotes))
                if min(share) >= 0.8 and sure and len({m[0][0] for m in main[:n]}) == len({m[0][0] for m in main[n:]}) == 1 and main[0][0][0] != main[n][0][0]:
                    want.add((organo, lotes[n], "retyped", field))
    got = set()
    for r in drift.changes(spark.read.parquet(path)).collect():
        got |= {(r.organo, r.lote, "removed", r.field_path), (r.organo, r.lote, "added", r.new_path)} if r.change_kind == "renamed" else {(r.organo, r.lote, r.change_kind, r.field_path)}
    assert got == want and len(got) > 10
