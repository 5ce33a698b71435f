import pytest
from pyspark.sql import functions as F

from estrado.operators import documents as D
from estrado.operators import pipeline as P
from estrado.operators import search

PAGE = 'En autos "A C/ B S/ DAÑOS - X"\nPoder Judicial\nse dicta sentencia.\nVISTO:\nLo pedido.\nRESUELVE:\nI.- Hacer\nlugar.\nVISTO:\nOtra vez.'


def test_page_to_sections_and_document(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, text string")
    rows = D.sections(D.page_paragraphs(pages, "id"), "id").collect()
    assert {(r.section, r.paragraph_id, r.text) for r in rows} == {("INICIO", 0, 'En autos "A C/ B S/ DAÑOS - X" se dicta sentencia.'), ("VISTO", 0, "Lo pedido."), ("RESUELVE", 0, "I.- Hacer lugar."), ("VISTO", 1, "Otra vez.")}
    doc = D.sectioned(pages, "id").first()
    assert doc.informacion.materia_preliminar == "DAÑOS" and doc.contenido["VISTO"] == ["Lo pedido.", "Otra vez."]
    text = D.full_text(D.sections(D.page_paragraphs(pages, "id"), "id").withColumn("i", F.lit("idea")), "id", "i", titles=True).first().full_text
    assert text.startswith("idea\nINICIO:\nEn autos") and "RESUELVE:\nI.- Hacer" in text


def test_resplit_and_ordinals(spark):
    shape = spark.createDataFrame([(1, "A", 0, 2), (1, "B", 1, 1), (1, "C", 2, 3)], "id int, section string, section_pos int, n_lines int")
    flat = spark.createDataFrame([(1, "x\ny\nz\nw")], "id int, text string")
    assert {r.section: r.texts for r in D.resplit(flat, shape, "id").collect()} == {"A": ["x", "y"], "B": ["z"], "C": ["w"]}
    rows = D.ordinals(spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7), "k").collect()
    assert all(r.k == r.para_id for r in rows) and len(rows) == 1000
    assert D.ordinals(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


def test_rewritten_paragraphs(spark):
    rows = [("ACUERDO", n, "conforme el art. 3 de la ley 7") for n in range(2)] + [("ACUERDO", 2, "corto"), ("OTRA", 0, "conforme el art. 3 de la ley 7"), ("ACUERDO", 4, None)]
    df = spark.createDataFrame(rows, "section string, paragraph_id int, text string")
    out = D.rewritten(df, "cambio_contenido", "citation_format", ("ACUERDO",)).collect()
    assert [r.accepted for r in out] == [True, False, False, False, False] and out[0].rewritten == "conforme el artículo 3 de la ley 7"
    assert not D.rewritten(df, "redaccion_superficial", lambda c: F.lit("nada")).where("accepted").count()


def test_citations_of_files(spark):
    assert D.citations_of_files(spark.createDataFrame([("a", "art. 9")], "path string, text string")).first().mentioned == ["9"]
    with pytest.raises(Exception, match="unreadable file b"):
        D.citations_of_files(spark.createDataFrame([("b", None)], "path string, text string")).collect()


@pytest.mark.parametrize("strategy", P.STRATEGIES)
@pytest.mark.parametrize("rerank", [True, False])
def test_questions_to_answers(spark, strategy, rerank):
    schema = "key long, expediente string, section string, text string, path string, idea_central string, materia_preliminar string, articulos_citados array<struct<main_source:string,cited_articles:array<int>>>"
    paragraphs = spark.createDataFrame([(1, "E1", "S", "costas del juicio al vencido", "p", "idea", "COSTAS", [("CPC", [3])]), (2, "E2", "S", "daños por accidente", "p", None, None, None), (3, None, None, None, None, None, None, None)], schema)
    index = search.build_indexes(paragraphs, "key", "text")
    encode = search.V.hashed(search.T.tokens(F.lower("question"), "normalized"))
    asked = spark.createDataFrame([(1, 7, "costas del juicio"), (2, 7, "costas del juicio"), (3, 8, "accidente")], "qid long, conv_id int, question string").withColumn("embedding", encode)
    turns = spark.createDataFrame([(7, 1, "antes", "dicho")], "conv_id int, turn int, question string, answer string")
    config = P.Config(strategy=strategy, rerank=rerank, top_n=1, generator="echo", tokenizer="raw")
    out = {r.qid: r for r in P.answer(asked, paragraphs, index, config, turns).collect()}
    assert "E1" in out[1].context and out[1].context == out[2].context and "E2" in out[3].context
    assert out[1].answer.endswith("Pregunta: costas del juicio")
    assert ("Pregunta 1: antes" in out[1].answer) == (strategy == "conversational")


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="standard, enriched"):
        P.answer(spark.range(1), spark.range(1), {}, P.Config(strategy="x"))


def test_structured_citations_and_orphans(spark):
    sources = spark.createDataFrame([("Ley 9418", None), ("Ley 94", None), ("Código Procesal", "CPC"), (None, "x")], "canonical_name string, short_name string")
    rows = [(1, "arts. 3, 29 y 30 de la LEY 9418"), (1, "art. 3 de la ley 9418"), (1, "artículo 7º del cpc"), (1, "art. 5"), (2, "ley 94"), (None, "ley 94"), (3, None)]
    known, orphans = D.structured_citations(spark.createDataFrame(rows, "k int, v string"), "k", "v", sources)
    assert sorted((r.k, r.main_source, r.cited_articles, r.n_verbatim) for r in known.collect()) == [(1, "Código Procesal", [7], 1), (1, "Ley 9418", [3, 29, 30], 2), (2, "Ley 94", [], 1)]
    assert [tuple(r) for r in orphans.collect()] == [(1, "art. 5")]
    assert D.structured_citations(spark.createDataFrame(rows, "k int, v string"), "k", "v", sources.limit(0))[0].count() == 0


def test_questions_of_every_specificity(spark):
    texts = spark.createDataFrame([(1, "La demanda se rechaza. Con costas al vencido."), (2, None), (3, "  ")], "id int, text string")
    rows = D.question_sets(texts, "id").collect()
    assert {(r.id, r.question_type, r.question_no) for r in rows} == {(1, k, n) for k in ("generic", "specific", "ultra_specific") for n in (1, 2, 3)}
    said = {r.question_type: r.question for r in rows if r.question_no == 1}
    assert "demanda" not in said["generic"] and "costas" not in said["specific"] and "costas" in said["ultra_specific"]


def test_data_sets_of_every_kind_resume(spark, tmp_path):
    import json

    folder = tmp_path / "in" / "02"
    folder.mkdir(parents=True)
    ruling = {"CONTENIDO": {"RESUELVE": ["Confirmar la sentencia conforme el art. 3", "corto", None, "El juez señala lo dicho además"], "SUELTO": "Confirmar la sentencia apelada hoy"}}
    for n in (1, 2):
        (folder / f"{n}.json").write_text(json.dumps(ruling, ensure_ascii=False), encoding="utf-8")
    (folder / "3.json").write_text("{roto")
    want = {
        "formato_citas": ["Confirmar la sentencia conforme el artículo 3", "corto", None, "El juez señala lo dicho además"],
        "redaccion_superficial": ["Confirmar la sentencia conforme el art. 3", "corto", None, "El juez indica lo dicho asimismo"],
        "cambio_contenido": ["Revocar la sentencia conforme el art. 3", "corto", None, "El juez señala lo dicho además"],
    }
    for kind, texts in want.items():
        out = str(tmp_path / kind)
        assert D.create_dataset(spark, str(tmp_path / "in"), out, kind) == {"total_files": 3, "processed": 2, "errors": 1, "skipped": 0}
        rows = spark.read.json(out).collect()
        assert {r.path for r in rows} == {"02/1.json", "02/2.json"} and all(json.loads(r.ruling)["CONTENIDO"] == {"RESUELVE": texts, "SUELTO": ruling["CONTENIDO"]["SUELTO"]} for r in rows)
        (folder / "4.json").write_text(json.dumps(ruling), encoding="utf-8")
        assert D.create_dataset(spark, str(tmp_path / "in"), out, kind) == {"total_files": 4, "processed": 1, "errors": 1, "skipped": 2}
        (folder / "4.json").unlink()
    with pytest.raises(ValueError, match="no kind"):
        D.create_dataset(spark, str(folder), str(tmp_path / "x"), "otro")


def test_groups_keep_their_summaries(spark):
    from estrado.operators import answers

    grouped = spark.createDataFrame([(1, "77", 3), (1, "78", 1)], "qid int, expte string, n int")
    said = answers.summaries(spark.createDataFrame([(1, "[77] «uno» [77] « dos »")], "qid int, markdown string"), "qid", "markdown")
    assert {(r.expte, r.llm_summary) for r in answers.with_summaries(grouped, said).collect()} == {("77", "dos"), ("78", "")}


def test_an_index_of_another_tokenizer_is_refused(spark):
    paragraphs = spark.createDataFrame([(1, "costas del juicio")], "key long, text string")
    index = search.build_indexes(paragraphs, "key", "text", tokenizer="normalized")
    with pytest.raises(ValueError, match="built with the tokenizer"):
        P.hits(spark.range(1), paragraphs, index, P.Config(tokenizer="raw"))
