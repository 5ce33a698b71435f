import json
import random
from datetime import datetime

import pytest

from estrado.llm import noise

SCHEMA = "file_id bigint, path string, organo string, lote int, recibido_at timestamp, payload string"
AT = datetime(2024, 1, 1)
WORDS = "la demanda costas juez parte recurso agravio prueba plazo sentencia tribunal hecho derecho actora demandado pericia honorarios resuelve confirmar rechazar".split()


def ruling(n, section, *paragraphs):
    return (n, f"{n}.json", "A", 1, AT, json.dumps({"CONTENIDO": {section: list(paragraphs)}}))


def clean(r, n=60):
    return [ruling(1000 + k, "INICIO", " ".join(r.choice(WORDS) for _ in range(80))) for k in range(n)]


def kinds(spark, rows):
    out = noise.found(spark.createDataFrame(rows, SCHEMA))
    return {(r.file_id, r.para_pos, r.line_no): r.kind for r in out.collect()}


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("- 3 -", "pageno"), ("[2]", "pageno"), ("//3", "pageno"), ("Pág. 4", "pageno"), ("pagina 1", "pageno"), ("Página 2 de 19", "pageno"), ("3/28", "pageno"), ("  2  ", "pageno"), ("fs. 12", "pageno"),
        ("CÁMARA DE APELAClONES DE VlLLA NORTE - SALA l", "header"), ("Poder Judicial - Cámara de Apelaciones", "header"), ("C Á M A R A   D E   A P E L A C I O N E S", "header"), ("Firmad0 digitalmente p0r Juzver0", "header"),
        ("Expte. N° 10438 - suces0ri0", "header"), ('"Irig c/ Brau s/ ejecución"', "header"), ("2020-09-22T12:14:07", "header"),
        ("la Cámara de Apelaciones de Villa", ""), ("autos \"Irig c/ Brau", ""), ("traslado.", ""), ("ley.", ""), ("736.624 tampoco", ""), ("", ""), ("N° 19590.", ""), ("de mora", ""),
    ],
)
def test_kinds_by_form(line, kind):
    assert noise.line_kind(line) == kind


@pytest.mark.parametrize(("line", "kind"), [("CORTE SUPREMA DE JUSTICIA DE LA NACIÓN", "header"), ("Fiscalía General - Paraná", "header"), ("JUZGADO CIVIL N° 3", "header"), ("tribunal de alzada en pleno", ""), ("Corte Suprema de Justicia", ""), ("FISCALÍA GENERAL.", "")])
def test_offices(line, kind):
    assert noise.line_kind(line) == kind


def test_a_number_the_line_before_asks_for_is_sound():
    assert noise.line_kinds(["conforme el art.", "3", "de la ley", "7", "y más"]) == ["", "", "", "pageno", ""]
    assert noise.line_kinds(["conforme el art.", "2", "578 del CPC y", "3", "fin"]) == ["", "pageno", "", "pageno", ""]
    assert noise.line_kinds(["12"]) == [""]


def test_divided_and_misread_words(spark):
    r = random.Random(1)
    rows = clean(r) + [ruling(1, "ACUERDO", "la senten-\nPágina 3 de 9\ncia rechaza la\nd3manda y el rccurso -\nhonor@rios\nzulú nada")]
    assert kinds(spark, rows) == {(1, 0, 0): "hyphen", (1, 0, 1): "pageno", (1, 0, 3): "misread", (1, 0, 4): "misread"}


def test_a_half_misread_after_the_break_counts_on_its_own_line(spark):
    rows = clean(random.Random(2)) + [ruling(1, "RESUELVE", "la dem-\nanda sigue\nla d3m-\nanda sigue\nla dem-\nand@ sigue")]
    got = kinds(spark, rows)
    assert got == {(1, 0, 0): "hyphen", (1, 0, 2): "hyphen", (1, 0, 4): "hyphen", (1, 0, 5): "misread"}


def test_held_out_accuracy_of_decoding(spark):
    r = random.Random(7)
    rows, want = clean(r, 80), {}
    for n in range(1, 41):
        lines = []
        for k in range(6):
            words = [r.choice(WORDS) for _ in range(7)]
            if r.random() < 0.5:
                at, (printed, misread) = r.randrange(7), r.choice(noise.CONFUSIONS[:30])
                if printed in words[at]:
                    words[at] = words[at].replace(printed, misread, 1)
                    if words[at] not in WORDS:
                        want[n, 0, k] = "misread"
            lines.append(" ".join(words))
        rows.append(ruling(n, "INICIO", "\n".join(lines)))
    got = kinds(spark, rows)
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.97 * len(want) and len(got) <= 1.03 * len(want)


def test_repaired_text(spark):
    rows = clean(random.Random(3)) + [ruling(1, "INICIO", "La Dem-\nCÁMARA DE APELACIONES DE X - SALA I\nanda rcchaza.\n[2]\nHONOR@RIOS, la prucba", "una línea")]
    got = {r.para_pos: r.text for r in noise.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "La Demanda rechaza. HONORARIOS, la prueba".replace("rechaza", "rcchaza"), 1: "una línea"}


def test_null_empty_repeated_and_clashing(spark):
    assert kinds(spark, []) == {}
    odd = [(None, None, None, None, None, None), (2, None, None, None, None, "{x"), (3, None, None, None, None, json.dumps({"CONTENIDO": {"INICIO": [None, "", "\n", {"texto": "a\nb"}, 5], "RESUELVE": None, "ACUERDO": "x\n- 2 -\ny"}}))]
    rows = clean(random.Random(4)) + odd
    df = spark.createDataFrame(rows + rows, SCHEMA).selectExpr("*", "1 as kind", "2 as line_no", "3 as a", "4 as tag")
    assert [tuple(r) for r in noise.found(df).collect()] == [(3, 0, "ACUERDO", 0, 1, "pageno")]


def test_long_text(spark):
    text = "\n".join(["la demanda costas"] * 20_000 + ["la dcmanda"])
    assert kinds(spark, [*clean(random.Random(5)), ruling(1, "INICIO", text)]) == {(1, 0, 20_000): "misread"}


def test_viterbi_uses_the_context():
    states = [[("la", 0.0)], [("costa", -1.0), ("corta", -0.9)], [("final", 0.0)]]
    assert noise.viterbi(states, {("la", "costa"): 2.0}, 0.0) == [0, 0, 0]
    assert noise.viterbi(states, {}, 0.0) == [0, 1, 0]


def test_confusable_strings_share_their_skeleton(spark):
    for printed, misread in noise.CONFUSIONS:
        assert noise.skeleton(printed) == noise.skeleton(misread)
    words = ["d3m@nda", "$entencia", "a|ba", "c1vil+", "ñandú", "x[y]^", "w´~"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(noise.skeleton_of(df.w)).collect()] == [noise.skeleton(w) for w in words]


def test_any_number_of_misreadings_is_explained():
    assert noise.explained("b@n@n@c@s@s@l@d@", "bananacasasalada") == [("a", "@")] * 8
    assert noise.explained("clemanda", "demanda") == [("d", "cl")] and noise.explained("lll", "iii") == [("i", "l")] * 3
    assert noise.explained("casa", "cosa") is None and noise.explained("casa", "casa") == []
    long = "acost" * 30
    assert len(noise.explained(long.replace("a", "@").replace("o", "0"), long)) == 60


def test_explanations_are_the_fewest():
    """Against all ways to misread short words."""
    r = random.Random(11)
    for _ in range(60):
        printed = "".join(r.choice("adeilmnorstu") for _ in range(r.randint(2, 6)))
        reached, front = {printed: 0}, {(printed, 0, "")}
        for step in range(1, 4):
            front = {(rest[k + len(p) :], step, done + rest[:k] + m) for rest, _, done in front for k in range(len(rest)) for p, m in noise.CONFUSIONS if rest.startswith(p, k)}
            for rest, _, done in front:
                reached.setdefault(done + rest, step)
        for word in r.sample(sorted(reached), min(30, len(reached))):
            used = noise.explained(word, printed)
            assert used is not None and len(used) <= reached[word]


def test_captions_and_page_numbers_of_any_length():
    assert noise.line_kind('"' + "Irig " * 60 + 'c/ Brau s/ ejecución"') == "header"
    assert noise.line_kind("-" * 30 + " 12 " + "-" * 30) == "pageno"


def test_lines_found_are_those_repaired(spark):
    """A roman numeral that no sound text holds is in doubt in both queries."""
    rows = clean(random.Random(8)) + [ruling(50, "INICIO", *["capítulo iii costas"] * 3), ruling(1, "INICIO", "la demanda\ncapítulo lll\nlas costas civii")]
    df = spark.createDataFrame(rows, SCHEMA)
    misread = {(r.file_id, r.line_no) for r in noise.found(df).collect() if r.kind == "misread"}
    fixes = noise.decode(noise._parts(df, every_line=True)).where("exists(fixes, f -> f.printed is not null)")
    assert misread == {(r.file_id, r.line_no) for r in fixes.collect()} == {(1, 1)}
