import json
from datetime import datetime

import pytest

from estrado.operators import nested

SCHEMA = "file_id bigint, path string, organo string, lote int, recibido_at timestamp, payload string"
AT = datetime(2024, 1, 1)


def rows(*payloads):
    return [(n, f"{n}.json", "A", 1, AT, p if isinstance(p, str) or p is None else json.dumps(p)) for n, p in enumerate(payloads, 1)]


RULING = {
    "METADATOS": {"ID_FALLO": "7", "ARTICULOS_CITADOS": {"citations": [{"main_source": "Ley 1", "cited_articles": [3, "4", None]}, None, {"main_source": None, "cited_articles": None}, {"cited_articles": []}]}},
    "CONTENIDO": {"INICIO": "solo", "ACUERDO": ["a", {"texto": "b", "orden": 2}], "ANEXO": None, "VACIO": [], "///CUERDO": [None, "z"]},
}


def found(spark, data):
    return {tuple(r) for r in nested.found(spark.createDataFrame(data, SCHEMA)).collect()}


def test_places_of_paragraphs_and_articles(spark):
    assert found(spark, rows(RULING)) == {
        (1, 0, "parrafo", 0, 0, "INICIO"),
        (1, 0, "parrafo", 1, 0, "ACUERDO"),
        (1, 0, "parrafo", 1, 1, "ACUERDO"),
        (1, 0, "parrafo", 4, 1, "///CUERDO"),
        (1, 0, "articulo", 0, 0, "3"),
        (1, 0, "articulo", 0, 1, "4"),
        (1, 0, "articulo", 0, 2, None),
    }


def test_lists_unreadable_and_odd_payloads(spark):
    data = rows([RULING, 5, {"CONTENIDO": {"X": ["p"]}}], "{broken", None, "", "[]", "12", {"CONTENIDO": [1], "METADATOS": "no"})
    got = found(spark, data)
    assert {r[:2] for r in got} == {(1, 0), (1, 2)}
    assert (1, 2, "parrafo", 0, 0, "X") in got


def test_a_file_counts_once_and_other_columns_do_not_matter(spark):
    late = [(1, "1.json", "A", 1, datetime(2025, 1, 1), json.dumps(RULING))]
    df = spark.createDataFrame(rows(RULING) + late + rows(RULING), SCHEMA).selectExpr("*", "1 as i", "'x' as val", "2 as table", "3 as _k")
    out = nested.found(df)
    assert out.count() == out.distinct().count() == 7


def test_null_ids_are_told_apart_by_content(spark):
    data = [(None, None, None, None, None, json.dumps(RULING)), (None, None, None, None, AT, json.dumps({"CONTENIDO": {"X": ["p"]}}))]
    assert len(found(spark, data)) == 8


def test_empty_table(spark):
    tables = nested.flat_tables(spark.createDataFrame([], SCHEMA))
    assert all(t.count() == 0 for t in tables.values())


def test_children_link_to_parents_and_variants_split_the_paragraphs(spark):
    tables = nested.flat_tables(spark.createDataFrame(rows(RULING, [RULING, RULING]), SCHEMA))
    link = ["file_id", "obj_pos"]
    assert tables["rulings"].count() == 3
    for child, keys in (("sections", link), ("citations", link)):
        assert tables[child].join(tables["rulings"], keys, "left_anti").count() == 0
    assert tables["paragraphs"].join(tables["sections"], [*link, "section_pos"], "left_anti").count() == 0
    assert tables["articles"].join(tables["citations"], [*link, "citation_pos"], "left_anti").count() == 0
    parts = [tables[f"paragraphs_{v}"].count() for v in ("texto", "lista", "objeto", "otro")]
    assert parts == [3, 3, 6, 0] and sum(parts) == tables["paragraphs"].count()
    assert tables["citations_articulos"].count() + tables["citations_sin_articulos"].count() == tables["citations"].count()
    assert {r.orden for r in tables["paragraphs_objeto"].collect()} == {None, 2}
    assert {r.article_no for r in tables["articles"].collect()} == {3, 4, None}


@pytest.mark.parametrize(
    ("node", "state"),
    [(None, "nulo"), ("x", "texto"), (True, "logico"), (1.5, "numero"), ({}, "objeto"), ({"texto": "x"}, "parrafo"), ({"texto": 1}, "objeto"), ([], "lista_vacia"), (["a", None], "lista_texto"), ([{"texto": "a"}, "b"], "lista_mixta"), ([[1]], "lista_otro"), ([None], "lista_nula"), ([1, None], "lista_numero"), ({"cited_articles": [], "extra": None}, "cita"), ([{"extra": 1}], "lista_cita"), ({"CONTENIDO": {}}, "fallo"), ({"METADATOS": {"citations": [{}]}}, "fallo")],
)
def test_states_of_the_automaton(node, state):
    assert nested.state(node) == state


def test_long_text_is_kept_whole(spark):
    text = "palabra " * 200_000
    out = nested.flat_tables(spark.createDataFrame(rows({"CONTENIDO": {"X": text}}), SCHEMA), "paragraphs")["paragraphs"].first()
    assert out.text == text


def test_noise_lines_of_every_paragraph(spark, tmp_path):
    from estrado import queries

    page = "Poder Judicial de X\nEl texto"
    payload = json.dumps({"CONTENIDO": {"BARE": page, "LISTA": [page, None, "{sic"], "OBJETO": [{"texto": page, "orden": 1}], "MIXTA": [page, {"texto": page}], "NULA": None, "VACIA": []}})
    spark.createDataFrame([(1, None, payload)], "file_id bigint, recibido_at timestamp, payload string").write.parquet(f"{tmp_path}/fallos_json.parquet")
    got = {(r.section, r.para_pos, r.text) for r in queries.queries()["noise_line_filter_all"](spark, str(tmp_path)).collect()}
    assert got == {("BARE", 0, "El texto"), ("LISTA", 0, "El texto"), ("LISTA", 2, "{sic"), ("OBJETO", 0, "El texto"), ("MIXTA", 0, "El texto"), ("MIXTA", 1, "El texto")}


def test_nodes_nested_thousands_deep(spark):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    payload = f'{{"CONTENIDO": {{"X": {deep}, "Y": ["p"]}}, "METADATOS": {{"ID_FALLO": "9", "HONDO": {deep}}}}}'
    tables = nested.flat_tables(spark.createDataFrame(rows(payload, {"CONTENIDO": {"Z": "q"}}), SCHEMA))
    got = {(r.file_id, r.section, len(r.text)) for r in tables["paragraphs"].collect()}
    assert got == {(1, "X", 39_999), (1, "Y", 1), (2, "Z", 1)}
    assert tables["members"].where("key = 'METADATOS.HONDO'").count() == 1 and tables["members"].where("pos is null").count() == 20_001
    assert tables["rejects"].count() == 0


def test_members_keep_every_leaf_and_their_parents(spark):
    ruling = {"METADATOS": {"ID_FALLO": "7", "ORIGEN": {"sala": "II", "jueces": ["a", {"b": None}]}, "ARTICULOS_CITADOS": {"total": 2, "citations": {"main_source": "L", "cited_articles": [1], "extra": ["x", "y"], "nota": 5}}}, "FIRMADO": True, "CONTENIDO": {"A": [{"texto": "t", "folio": 3}, ["suelto"]]}}
    tables = nested.flat_tables(spark.createDataFrame(rows(ruling), SCHEMA))
    members = [r.asDict() for r in tables["members"].collect()]
    at = {r["node"]: r for r in members}
    path = lambda r: (path(at[r["parent"]]) + "/" if r["parent"] is not None else "") + r["key"]
    leaves = {(path(r), r["pos"], r["sub_pos"], r["value"]) for r in members if r["variant"] not in ("objeto", "lista")}
    assert leaves == {
        ("METADATOS.ORIGEN/sala", None, None, "II"), ("METADATOS.ORIGEN/jueces/0", None, None, "a"), ("METADATOS.ORIGEN/jueces/1/b", None, None, None), ("METADATOS.ARTICULOS_CITADOS.total", None, None, "2"),
        ("FIRMADO", None, None, "true"), ("citations.extra/0", 0, None, "x"), ("citations.extra/1", 0, None, "y"), ("citations.nota", 0, None, "5"), ("CONTENIDO.A.folio", 0, 0, "3"), ("CONTENIDO.A/0", 0, 1, "suelto"),
    }
    assert [r.article for r in tables["articles"].collect()] == ["1"]


def test_rejects_name_their_reason(spark):
    tables = nested.flat_tables(spark.createDataFrame(rows("{broken", "12", [RULING, 5], RULING, None, ""), SCHEMA), "rejects")
    assert {(r.file_id, r.reason) for r in tables["rejects"].collect()} == {(1, "ilegible"), (2, "sin_objeto"), (3, "sin_objeto")}


@pytest.mark.parametrize("text", ['{"a": [1, {"b": null}, "x\\"]"], "c": {}}', "[]", "[[], {}]", '"x"', " 1 "])
def test_deep_parser_agrees_with_the_plain_one(text):
    from estrado.sources import fallos

    assert fallos._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[1,]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "[", "]", '{"a":[}', "[1]]", "{1: 2}", "nul", '[1]{"a":2}'])
def test_deep_parser_refuses_what_is_no_json(text):
    from estrado.sources import fallos

    with pytest.raises(ValueError):
        fallos._parse_deep(text)


def test_first_delivery_by_either_way(spark):
    from estrado.sources import fallos

    late = datetime(2025, 1, 1)
    data = [(1, "a", AT), (1, "a", late), (2, "b", AT), (3, None, AT), (3, "c", late), (4, "", AT), (None, "x", AT), (None, "x", AT), (None, "y", None), (5, "d", None), (5, "e", AT), (6, "f", AT), (6, "f", AT)]
    df = spark.createDataFrame(data, "file_id bigint, payload string, recibido_at timestamp")
    want = sorted([("1", "a"), ("2", "b"), ("3", "c"), ("None", "x"), ("None", "y"), ("5", "d"), ("6", "f")])
    for most in (fallos.REPEATED, 1):
        assert sorted((str(r[0]), r[1]) for r in fallos.first_delivery(df, most=most).collect()) == want
