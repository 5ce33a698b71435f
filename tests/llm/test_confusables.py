import unicodedata

import pytest

from estrado.llm import confusables

SCHEMA = "doc_id bigint, text string"
BASE = "Acción niño 3 a"
WIDE = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in BASE)
SAME = [
    BASE,
    unicodedata.normalize("NFD", BASE),
    BASE.replace(" ", chr(0xA0)),
    BASE.replace(" ", chr(0x2009)),
    chr(0x200B).join(BASE),
    BASE.replace("cc", "c" + chr(0xAD) + "c"),
    BASE.replace(" ", chr(0x3000)),
    BASE.replace("A", chr(0x391)).replace("c", chr(0x441)).replace("i", chr(0x456)),
    WIDE,
    unicodedata.normalize("NFD", BASE).replace("o", chr(0x3BF)),
]


def pairs(spark, rows):
    return {tuple(r) for r in confusables.found(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as normal", "2 as class_id")).collect()}


def test_pairs_of_differently_coded_texts(spark):
    rows = list(enumerate(SAME, 1))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y}
    assert pairs(spark, rows) == want


@pytest.mark.parametrize("other", ["Accion niño 3 a", "Acción nino 3 a", "acción niño 3 a", "Acción niño 8 a", "Acción niño 3 a b", "Acción\nniño 3 a", "Acción  niño 3 a"])
def test_visible_differences_stay(spark, other):
    assert pairs(spark, [(1, SAME[0]), (2, other)]) == set()


def test_other_scripts_stay_as_they_are(spark):
    texts = ["Переводчик подтвердил", "διερμηνέας", "通訳は供述", "«cita» ¿qué?", "", " ", None, "x" * 500_000 + chr(0x200B)]
    got = [r.normal for r in confusables.normalize(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()]
    assert got == [*texts[:-1], "x" * 500_000]


def test_null_repeated_empty(spark):
    assert pairs(spark, []) == set()
    unseen = "a" + chr(0x200B)
    assert pairs(spark, [(None, unseen), (1, "a"), (1, "a"), (2, unseen), (3, None), (4, ""), (5, " ")]) == {(1, 2)}


@pytest.mark.parametrize(("typed", "form"), [("oﬁcio", "oficio"), ("𝗔rt. 𝟏", "Art. 1"), ("ｶﾞﾗｽ", "ガラス"), ("αrt", "art"), ("Αcción", "Acción"), ("reclamó".replace("ó", "ό"), "reclamó"), ("art. Ⅷ", "art. VIII"), ("dıce", "dice"), ("ɡuardia y ɑrte", "guardia y arte"), ("①", "①"), ("10º m²", "10º m²"), ("½ ﬅ", "½ ﬅ"), ("Ёлка", "Ёлка")])
def test_forms(spark, typed, form):
    rows = spark.createDataFrame([(1, typed), (2, form)], SCHEMA)
    assert {r.normal for r in confusables.normalize(rows).collect()} == {unicodedata.normalize("NFC", form)}


def test_a_class_held_by_copies(spark):
    rows = [(n, "casa") for n in range(40)] + [(100, "c" + chr(0x430) + "sa"), (101, "ca" + chr(0x200B) + "sa")]
    assert pairs(spark, rows) == {(n, m) for n in range(40) for m in (100, 101)} | {(100, 101)}
