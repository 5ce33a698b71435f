import math
import random
import re

import pytest
from pyspark.sql import functions as F

from estrado.functions import citations as C
from estrado.functions import generate as G
from estrado.functions import sets as S
from estrado.functions import text as T
from estrado.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * 9))).select(column).first()[0]


def paragraphs(text):
    done, cur = [], ""
    for line in map(str.strip, text.split("\n")):
        if not line:
            if cur:
                done.append(cur)
            cur = ""
        elif cur and cur[-1] not in ".:?!;" and not (line.isupper() and line.endswith(":") and len(line) < 50):
            cur += " " + line
        else:
            if cur:
                done.append(cur)
            cur = line
    return done + [cur] if cur else done


def test_lines_to_paragraphs_like_a_loop(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice(["uno dos", " tres.", "", "VISTO:", "cuatro;", "CINCO", "¿seis?", "V" * 48 + ":", "V" * 49 + ":"]) for _ in range(r.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.join_lines(F.col("t")).alias("p")).collect():
        assert row.p == paragraphs(row.t), row.t


def test_noise_lines_and_subject(spark):
    page = "Superior Tribunal X\nPODER JUDICIAL\n 12 \nPágina 3 de 9\n2024-01-02T10:00\nEl texto sigue 5"
    assert one(spark, T.drop_noise_lines(F.col("t")), t=page) == "El texto sigue 5"
    assert one(spark, T.subject(F.col("t")), t='"nada", y "A C/ B S/ daños - legajo"') == "DAÑOS"
    assert one(spark, T.subject(F.col("t")), t="sin comillas S/ x") is None


def test_headings_windows_tokens_and_cut(spark):
    assert one(spark, T.clean_headings(F.col("t")), t="**IDEA CENTRAL DEL FALLO**\n\nQue sí.") == "Que sí."
    assert one(spark, T.windows(F.col("t"), 10, 4), t="abcdefghijklmnop") == ["abcdefghij", "ghijklmnop"]
    assert one(spark, T.windows(F.col("t"), 10, 4), t="") == []
    assert one(spark, T.tokens(F.col("t")), t="  La Ley\t7 ") == ["La", "Ley", "7"]
    assert one(spark, T.tokens(F.col("t"), "normalized"), t="La Ley suprema " + "x" * 20) == ["ley", "suprema"]
    assert one(spark, T.cut(F.col("t"), 3), t="abcd") == "abc..."
    with pytest.raises(ValueError, match="tokenizer"):
        T.tokens(F.col("t"), "other")


def mentioned(text):
    found = set()
    for pattern, _ in C.MENTIONS:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            for g in m.groups():
                found.update(re.findall(C.NUMBER, g or ""))
    return sorted(found)


def test_mentions_like_the_patterns_in_python(spark):
    texts = ["arts. 3, 14 y 94 de la ley 7046", "ARTÍCULOS 1° y 2", "del art.114", "Art. 28, Artículo 45", "leyes 123 y 456/90", "sin cita 12", "", "ley nº 5678/90", "-arts. 1º y 4º Ac. 5", "artículo 9, inc. 2"]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.mentioned(F.col("t")).alias("m")).collect():
        assert row.m == mentioned(row.t), row.t
    assert one(spark, C.extraction_holds(F.col("t"), F.array(F.lit("29"), F.lit("3"))), t="arts. 3 y 29")


def test_normalised_citations(spark):
    data = [("a", "Otro", [28, 5, 33], "x"), ("a", "Ley 7046", [1], None), ("a", "Otro", None, "y"), ("b", "Otro", [114], "z"), ("b", None, [9], None), ("c", "CPC", None, None), ("d", "Otro", [], "q")]
    rows = C.normalize(spark.createDataFrame(data, "id string, main_source string, cited_articles array<int>, extra string"), "id").collect()
    assert {(r.id, r.main_source): (r.articles, r.extras) for r in rows} == {("a", "Otro"): ([5], ["x", "y"]), ("a", "Ley 7046"): ([1, 28], []), ("a", "Ley 10.704"): ([33], []), ("b", "Ley 7046"): ([114], []), ("c", "CPC"): ([], [])}


def test_frequency_of_empty_and_null_lists(spark):
    data = [("A", [1, 1, 2]), ("B", []), ("C", None), (None, [1])]
    rows = C.frequency(spark.createDataFrame(data, "main_source string, cited_articles array<int>")).collect()
    assert {tuple(r) for r in rows} == {("A", 1, 2), ("A", 2, 1), ("B", None, 0)}


def test_set_metrics(spark):
    df = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"]), (["a"], ["a", "a"])], "x array<string>, y array<string>")
    got = df.select(*[c.alias(n) for n, c in S.compare(F.col("x"), F.col("y")).items()], S.jaccard(F.col("x"), F.col("y")).alias("j"), S.overlap(F.col("x"), F.col("y")).alias("o")).collect()
    assert [(r.accuracy, r.precision, r.recall, r.f1, r.j, r.o) for r in got] == [(1.0, 0, 0, 0, 0, 0), (0.0, 0.5, 0.5, 0.5, pytest.approx(1 / 3), 0.5), (1.0, 1, 1, 1, 1, 1)]
    m = S.classification(F.lit(3), F.lit(1), F.lit(2), F.lit(0))
    assert spark.range(1).select(m["accuracy"]).first()[0] == 0.5


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e")).collect()
    assert got[0].c == pytest.approx(1 / math.sqrt(2)) and got[1].c == 0 and got[1].e == pytest.approx(math.sqrt(2))
    assert sum(map(abs, one(spark, V.hashed(T.tokens(F.col("t"))), t="a b c"))) in (1, 3)


def test_generators(spark):
    tries = []

    def failing(prompt):
        tries.append(prompt)
        raise OSError

    waits = []
    assert G.answer(failing, "p", wait=waits.append) == G.FAILED and len(tries) == 3 and waits == [1, 2]
    assert G.answer(lambda p: "", "p") == G.EMPTY
    with pytest.raises(ValueError, match="summary"):
        G.generator("none")
    df = spark.createDataFrame([("Uno. Dos.",), (None,)], "t string")
    assert [r[0] for r in df.select(G.generate(F.col("t"), "echo")).collect()] == ["Uno. Dos.", None]
    assert G.other_citation_format("el art. 3 y los artículos 4") == "el artículo 3 y los arts. 4"
    assert len(G.questions("El juez resolvió. Fin.").split("\n")) == 3
    assert one(spark, G.parse_questions(F.col("t")), t='{"questions": ["¿a?"]}') == ["¿a?"]
    assert one(spark, G.parse_questions(F.col("t")), t="1\n¿b?") == ["¿b?"]
