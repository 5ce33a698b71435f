import json
import os

import pytest
from pyspark.sql import functions as F

from estrado import streaming
from estrado.sources import files


@pytest.fixture
def folder(tmp_path):
    month = tmp_path / "in" / "2024" / "02"
    month.mkdir(parents=True)
    ruling = {"METADATOS": {"ID_FALLO": "9"}, "CONTENIDO": {"INICIO": ["  un párrafo largo ", "corto"], "X": "suelto", "Y": [1]}, "IDEA_CENTRAL": "i"}
    (month / "1.json").write_text(json.dumps(ruling), encoding="utf-8")
    (month / "2.json").write_bytes(json.dumps([ruling, {"CONTENIDO": {}}], ensure_ascii=False).encode("latin-1"))
    (month / "3.json").write_text("{roto")
    return tmp_path


def test_rulings_and_paragraphs(spark, folder):
    rulings, rejects = files.rulings(spark, str(folder / "in"))
    assert {(r.path, r.mes, r.stem, r.obj_pos) for r in rulings.collect()} == {("2024/02/1.json", "02", "1", 0), ("2024/02/2.json", "02", "2", 0), ("2024/02/2.json", "02", "2", 1)}
    assert [r.path for r in rejects.collect()] == ["2024/02/3.json"]
    rows, no_id = files.paragraphs(rulings)
    assert {(r.path, r.section, r.paragraph_id, r.text) for r in rows.collect()} == {(f"2024/02/{n}.json", "INICIO", 0, "un párrafo largo") for n in (1, 2)}
    assert files.paragraphs(rulings, strip=False)[0].first().text == "  un párrafo largo "
    assert [(r.path, r.obj_pos) for r in no_id.collect()] == [("2024/02/2.json", 1)]


def test_enriched_paragraphs(spark, tmp_path):
    (tmp_path / "in" / "02").mkdir(parents=True)
    cited = [{"main_source": "L", "cited_articles": [1, 2], "extra": "x"}, {"main_source": "M", "extra": ["y"]}]
    rulings = [{"METADATOS": {"ID_FALLO": "9", "MES": "02", "ARTICULOS_CITADOS": {"citations": cited}}, "CONTENIDO": {"A": ["  un párrafo largo "]}}, {"METADATOS": {"ID_FALLO": "8"}, "CONTENIDO": {"A": ["otro párrafo largo"]}}]
    (tmp_path / "in" / "02" / "1.json").write_text(json.dumps(rulings), encoding="utf-8")
    rows, _ = files.enriched_paragraphs(files.rulings(spark, str(tmp_path / "in"))[0])
    got = {r.expediente: r for r in rows.select("*", F.try_variant_get("metadatos", "$.MES", "string").alias("mes")).drop("metadatos").collect()}
    assert [(c.main_source, c.cited_articles, c.extra) for c in got["9"].articulos_citados] == [("L", [1, 2], ["x"]), ("M", None, ["y"])]
    assert got["9"].text == "  un párrafo largo " and got["9"].mes == "02" and got["8"].articulos_citados == []


def test_run_names(spark, tmp_path):
    from datetime import datetime

    at = spark.createDataFrame([(datetime(2024, 3, 5, 7, 8, 9),)], "t timestamp")
    assert at.select(files.run_id(at.t)).first()[0] == "20240305_070809"
    run = files.write_results(spark.createDataFrame([("t", 1.0)], "test string, accuracy double"), str(tmp_path))
    assert len(run) == 15 and files.read_results(spark, str(tmp_path), run).count() == 1


def test_question_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('["¿a?", "¿b?"]')
    assert [tuple(r) for r in files.query_list(spark, str(tmp_path / "q.json")).collect()] == [(0, "¿a?"), (1, "¿b?")]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        files.query_list(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "77.json").write_text('{"question_type": "generic", "questions": ["x", "y"]}')
    assert [tuple(r) for r in files.question_files(spark, str(tmp_path / "f")).collect()] == [("77", "generic", 1, "x"), ("77", "generic", 2, "y")]


def test_sinks_results_and_guards(spark, tmp_path):
    df = spark.createDataFrame([("t1", 0.5, "02"), ("t2", 0.7, "03")], "test string, accuracy double, mes string")
    files.write_json(df, str(tmp_path / "j"), "mes")
    assert sorted(os.listdir(tmp_path / "j"))[-2:] == ["mes=02", "mes=03"]
    files.write_text(df, str(tmp_path / "t"), "test", "mes")
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    files.write_results(df, str(tmp_path / "r"), "20240101_000000")
    files.write_results(df.limit(1), str(tmp_path / "r"), "20240102_000000")
    assert files.read_results(spark, str(tmp_path / "r"), "20240101_000000").count() == 2
    assert files.missing(df, df.limit(1), "test").count() == 1
    with pytest.raises(ValueError, match="empty"):
        files.require_rows(df.limit(0), "df")


def test_staleness(spark, folder):
    source, index = str(folder / "in"), str(folder / "ix")
    assert files.staleness(spark, str(folder / "none"), index) == "NO_JSON_FILES"
    assert files.staleness(spark, source, index) == "NO_INDEXES"
    spark.range(1).write.parquet(index)
    assert files.staleness(spark, source, index) == "UP_TO_DATE"
    os.utime(folder / "in" / "2024" / "02" / "1.json", (4e9, 4e9))
    assert files.staleness(spark, source, index) == "NEEDS_UPDATE"


def run(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    turns = str(tmp_path / "turns")
    spark.createDataFrame([(1, n, f"t{n}") for n in range(4)], "conv_id int, turn long, text string").coalesce(1).write.parquet(turns)
    stream = streaming.last_turns(spark.readStream.schema("conv_id int, turn long, text string").parquet(turns), 3)
    run(stream.writeStream.outputMode("update").format("memory").queryName("turns").start())
    assert spark.sql("select turns from turns").first()[0] == ["t1", "t2", "t3"]

    matches = str(tmp_path / "matches")
    spark.createDataFrame([("l", 1, "a", "b", 1.0)], "league string, match_no int, player_a string, player_b string, result double").write.parquet(matches)
    stream = streaming.elo(spark.readStream.schema("league string, match_no int, player_a string, player_b string, result double").parquet(matches))
    run(stream.writeStream.outputMode("update").format("memory").queryName("ratings").start())
    assert {r.player: r.rating for r in spark.sql("select * from ratings").collect()} == {"a": 1516.0, "b": 1484.0}

    landed = str(tmp_path / "landed")
    spark.createDataFrame([(1, "p", "o", 1, None, "{}")], streaming._FILES).write.parquet(landed)
    got = []
    streaming.index_new_files(spark, landed, lambda df, n: got.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert got == [1]
    counted = streaming.late_counts(spark.read.parquet(landed).withColumn("recibido_at", F.lit("2024-01-01").cast("timestamp")))
    assert counted.first().files == 1
