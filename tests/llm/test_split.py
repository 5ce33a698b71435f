import json
import os
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estrado.llm import split

SENTENCE = "El recurso del Dr. Paz fue rechazado con costas al vencido en todas las instancias. "


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\nÁ", max_size=400), st.integers(5, 60), st.data())
def test_pieces_restore_the_text_within_limits(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    out, _ = split.bisect(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in out) == text
    assert all(end - start <= limit and start <= own and own - start <= overlap for start, own, end in out)
    assert len(text) > limit or len(out) == 1


def test_cuts_at_the_strongest_boundary():
    lines = "\n".join(SENTENCE * 5 for _ in range(4))
    out, _ = split.bisect(lines, 1024, 128)
    assert all(lines[own - 1] in "\n " and (lines[own].isupper()) for _, own, _ in out[1:])
    assert all(lines[start - 1].isspace() for start, _, _ in out[1:])


@pytest.mark.parametrize(
    ("text", "level"),
    [(("x" * 500 + "\n") * 4, "linea"), (SENTENCE * 20, "oracion"), ("palabra sin fin " * 100, "palabra"), ("a" * 3000, "nada"), ("corto", "linea"), ("según el Dr. Paz y la Sra. Luz, " * 50, "palabra"), (("a" * 1025 + " ") * 2, "nada"), ("a" * 1024 + "\n" + "b" * 1024, "linea"), (("Votó J. Paz, " * 60 + "fin. ") * 2 + "Otra", "oracion")],
)
def test_levels(text, level):
    assert split.level_of(text, 1024) == level


@settings(max_examples=300, deadline=None)
@given(st.text("aB. \n", max_size=300), st.integers(5, 60), st.data())
def test_level_is_that_of_the_gaps_between_boundaries(text, limit, data):
    """The bisection's level against a plain look at all gaps."""

    def plain():
        if len(text) <= limit:
            return "linea"
        for level, starts in zip(split.LEVELS, split.boundaries(text)):
            edges = [0, *starts, len(text)]
            if all(len(text[a:b].rstrip()) <= limit for a, b in zip(edges, edges[1:])):
                return level
        return "nada"

    assert split.bisect(text, limit, data.draw(st.integers(0, limit - 1)))[1] == plain()


@pytest.mark.parametrize(("text", "starts"), [("Uno. Dos", [5]), ("el Sr. Paz", []), ("J. Paz", []), ("¿Sí? No", [5]), ("fin. ¿Qué", [5]), ("a. b", []), ("art. 5. La", [8]), ("N.N. Paz", []), ('dijo." Luego', [7])])
def test_sentence_starts(text, starts):
    assert split.sentence_starts(text) == starts


def test_bad_limits():
    with pytest.raises(ValueError, match="overlap"):
        split.bisect("x", 10, 10)


def test_rows_of_pieces(spark):
    rows = [(1, SENTENCE * 30, "a"), (1, SENTENCE * 30, "a"), (None, "corto", None), (3, None, "b"), (4, "", "c")]
    df = spark.createDataFrame(rows, "id int, text string, level string")
    out = split.pieces(df)
    assert set(out.columns) == {"id", "level", "piece", "piece_start", "own_start", "piece_end", "piece_text"}
    got = out.collect()
    assert {r.id for r in got} == {1, None, 4} and max(len(r.piece_text) for r in got) <= 1024
    assert out.where("id = 1").count() == 2 * out.where("id = 1").distinct().count()
    assert split.pieces(df.limit(0)).count() == 0
    assert [r.piece for r in split.pieces(df, only_long=True).where("id <> 1").collect()] == []


def test_found(spark):
    payload = json.dumps([{"CONTENIDO": {"PAZ DIJO": ["x", SENTENCE * 20, None], "LUZ DIJO": "a" * 2000, "INICIO": ["b" * 2000]}}])
    files = spark.createDataFrame([(1, datetime(2024, 1, 1), payload), (1, datetime(2024, 1, 2), payload), (2, None, "{")], "file_id bigint, recibido_at timestamp, payload string")
    paragraphs = spark.createDataFrame([(9, "S", 4, SENTENCE * 20), (9, "S", 4, SENTENCE * 20), (8, None, None, "a" * 1025), (7, "S", 1, None)], "para_uid bigint, section string, paragraph_id int, text string")
    got = {tuple(r) for r in split.found(files, paragraphs).collect()}
    assert got == {("fallos_json", 1, 0, "PAZ DIJO", 1, "oracion"), ("fallos_json", 1, 0, "LUZ DIJO", 0, "nada"), ("paragraphs", 9, 0, "S", 4, "oracion"), ("paragraphs", 8, 0, None, None, "nada")}


def test_pieces_of_both_tables(spark, tmp_path):
    from estrado.llm import queries

    long = SENTENCE * 30
    payload = json.dumps([{"CONTENIDO": {"PAZ DIJO": ["x", long, None, {"texto": long}], "LUZ DIJO": "", "INICIO": [long]}}])
    spark.createDataFrame([(1, datetime(2024, 1, 1), payload), (1, datetime(2024, 1, 2), payload)], "file_id bigint, recibido_at timestamp, payload string").write.parquet(f"{tmp_path}/fallos_json.parquet")
    spark.createDataFrame([(9, "S", 4, long), (8, None, None, "corto"), (7, "S", 1, None)], "para_uid bigint, section string, paragraph_id int, text string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    out = {}
    for r in queries.queries()["p5_pieces"](spark, str(tmp_path)).orderBy("piece").collect():
        assert r.piece_end - r.piece_start == len(r.piece_text) <= 1024 and r.own_start - r.piece_start <= 128
        key = (r.tbl, r.row_id, r.obj_pos, r.section, r.para_pos)
        out[key] = out.get(key, "") + r.piece_text[r.own_start - r.piece_start :]
    want = {("PAZ DIJO", 0): "x", ("PAZ DIJO", 1): long, ("PAZ DIJO", 3): long, ("LUZ DIJO", 0): ""}
    assert out == {("fallos_json", 1, 0, *k): v for k, v in want.items()} | {("paragraphs", 9, 0, "S", 4): long, ("paragraphs", 8, 0, None, None): "corto"}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pieces_restore_every_paragraph_of_both_tables(spark):
    """p5_pieces on whole tables: an exact round trip."""
    from estrado.llm import queries
    from estrado.sources.fallos import iter_rulings, read_table

    want = {}
    for r in read_table(spark, DATA, "fallos_json").select("file_id", "payload").collect():
        for pos, ruling in iter_rulings(r.payload):
            for section, value in (ruling.get("CONTENIDO") or {}).items():
                for k, item in enumerate(value if isinstance(value, list) else [value]) if section.endswith(" DIJO") else ():
                    text = item["texto"] if isinstance(item, dict) else item
                    if text is not None:
                        want["fallos_json", r.file_id, pos, section, k] = text
    paragraphs = read_table(spark, DATA, "paragraphs").select("para_uid", "section", "paragraph_id", "text").distinct().collect()
    want |= {("paragraphs", r.para_uid, 0, r.section, r.paragraph_id): r.text for r in paragraphs if r.text is not None}
    parts = {}
    for r in queries.queries()["p5_pieces"](spark, DATA).distinct().collect():
        assert len(r.piece_text) <= split.LIMIT and 0 <= r.own_start - r.piece_start <= split.OVERLAP
        parts.setdefault((r.tbl, r.row_id, r.obj_pos, r.section, r.para_pos), []).append((r.piece, r.piece_text[r.own_start - r.piece_start :]))
    assert {k: "".join(t for _, t in sorted(p)) for k, p in parts.items()} == want
