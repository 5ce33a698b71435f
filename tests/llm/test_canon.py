import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estrado.llm import canon

REFERENCE = [(1, "Ley 9418", None, "ley"), (2, "Ley 9481", None, "ley"), (3, "Ley 51.220 (LTV - Ley de Tránsito Vecinal)", "LTV", "ley"), (4, "Código Procesal Civil Unificado (CPCU)", "CPCU", "código"), (5, "Código Procesal Civil Unificado Provincial (CPCUP)", "CPCUP", "código"), (6, "Acordada 3/2009", None, "acordada"), (7, "Acuerdo General 17/18 SCE", None, "acuerdo"), (8, "Decreto 871/82", None, "decreto"), (9, "Convención sobre la Niñez Protegida (CNP)", "CNP", "convención")]
SCHEMA = "source_id bigint, canonical_name string, short_name string, kind string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcñ/1 ", max_size=12), st.text("abcñ/1 ", max_size=12))
def test_metric_is_levenshtein(a, b):
    assert canon.metric(a)(b) == levenshtein(a, b)


def test_tree_gives_every_key_within_the_threshold():
    r = random.Random(1)
    keys = ["".join(r.choices("abcd", k=r.randint(1, 8))) for _ in range(300)]
    tree = canon.BKTree()
    for n, key in enumerate(keys):
        tree.add(key, n)
    for _ in range(40):
        q, most = "".join(r.choices("abcd", k=6)), r.randint(0, 3)
        assert sorted(v for _, _, v in tree.within(q, most)) == [n for n, k in enumerate(keys) if levenshtein(q, k) <= most]


@pytest.fixture(scope="module")
def linker(spark):
    return canon.Linker([tuple(r) for r in canon.owned_keys(spark.createDataFrame(REFERENCE, SCHEMA)).collect()])


@pytest.mark.parametrize(
    ("typed", "source"),
    [
        ("ley 9418", 1), ("LEY N°9.418", 1), ("lye 9.418", 1), ("L. 9.418 y modif.", 1), ("9.481", 2), ("Ley 9.411", -1), ("ley 94181", -1), ("LTV", 3), ("L.T.V.", 3), ("tránsito vecinal", 3), ("51.220 - LTV", 3), ("Ley de Trnásito Vecinal", 3),
        ("C.P.C.U.", 4), ("Cód. Proc. Civ. Unif.", 4), ("Procesal Civil Unificado, Código", 4), ("codigo procesal civil unificao", 4), ("Cod. Proc. Civil Unif. Prov.", 5), ("(CPCUP)", 5), ("Acordada 3/09", 6), ("Acda. 3 del 2009", 6), ("Acordada 30/2009", -1), ("A.G. 17/2018", 7),
        ("Dec. nº871/1982", 8), ("Decreto 871/83", -1), ("convencion sobe la ninez protegida", 9), ("idem", -1), ("s/d", -1), ("conf. ley 9418", 1), ("(art. 395 L 9418)", 1), ("cfr. art. 227, 9.481, in fine", 2), ("arts. 135, 138 y 147 Ley 9418", 1), ("Ley 9.418, art. 92 inc. a)", 1), ("lo dispuesto por LTV en su art. 4", 3), ("artículo 131° CPCU y concs.", 4), ("ARTÍCULOS 3 Y 7 DEL cpcup", 5), ("Ley 9.418 arts. 132/139", 1),
    ],
)
def test_typed_values(linker, typed, source):
    assert linker.nearest(typed)[1] == source


AMBIGUOUS = [(10, "Código Penal (CP)", "CP"), (11, "Código Postal (CP)", "CP"), (12, "Ley 77", None), (13, "Ley 77 (Ley de Puertos)", None), (14, "Puertos", None), (15, "Ley 5 (Puertos)", "Puertos")]


def test_keys_of_several_entries_whatever_the_shards(spark):
    """CP is nobody's; Puertos is the entry's whose whole name it is; of two entries of one name the smaller id."""
    reference = spark.createDataFrame(AMBIGUOUS, "source_id bigint, canonical_name string, short_name string")
    typed = ["CP", "cp", "puertos", "Ley 77", "Código Penal", "codigo postal", "Ley 5", "Ley 78"]
    values = spark.createDataFrame([(v,) for v in typed * 2], "value string")
    want = {"CP": -1, "cp": -1, "puertos": 14, "Ley 77": 12, "Código Penal": 10, "codigo postal": 11, "Ley 5": 15, "Ley 78": -1}
    for shard, block in ((canon.SHARD, canon.BLOCK), (1, 3), (2, 1), (3, 100), (7, 2)):
        out = canon.link(values, reference, shard=shard, block=block).collect()
        assert len(out) == len(typed) * 2 and {r.value: r.source_id for r in out} == want


def test_shards_answer_as_one_tree(spark):
    reference = spark.createDataFrame(REFERENCE, SCHEMA)
    values = spark.createDataFrame([(n, v, 0, "x") for n, v in enumerate(["ley 9418", "LTV", "nada", None, "", " ", "cpcu", "ley 9418"])], "id int, value string, source_id int, distance string")
    one = sorted(map(tuple, canon.link(values, reference).collect()))
    assert one == sorted(map(tuple, canon.link(values, reference, shard=2).collect()))
    assert [r[2] for r in one] == [1, 3, -1, -1, -1, -1, 4, 1]


def test_found_takes_the_stated_fields(spark):
    citations = spark.createDataFrame([(1, "Ley 9418", "x"), (2, "ley 9418", "LTV"), (3, "Otro", "ltv"), (4, None, "ltv"), (5, " ", None), (6, "Otro", " "), (2, "ley 9418", "LTV"), (7, "otro más", None)], "cit_id bigint, main_source string, extra string").selectExpr("*", "1 as value", "2 as field")
    quotations = spark.createDataFrame([(1, ["conf. LTV", None, " ", "x 1"]), (2, None), (3, [])], "sub_id bigint, verbatim_citations array<string>")
    got = {tuple(r) for r in canon.found(citations, quotations, spark.createDataFrame(REFERENCE, SCHEMA)).collect()}
    assert got == {("main_source", 2, 0, 1), ("main_source", 7, 0, -1), ("extra", 3, 0, 3), ("verbatim", 1, 0, 3), ("verbatim", 1, 3, -1)}


def test_empty_tables_and_long_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    values = spark.createDataFrame([("ley 9418",), ("ley " * 20_000,)], "value string")
    assert [r.source_id for r in canon.link(values, none).collect()] == [-1, -1]
    assert canon.link(values.limit(0), spark.createDataFrame(REFERENCE, SCHEMA)).count() == 0
    assert [r.source_id for r in canon.link(values, spark.createDataFrame(REFERENCE, SCHEMA)).collect()] == [1, -1]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_found_like_a_scan_of_all_keys(spark):
    """p3_found on whole tables against a comparison of every form with every key."""
    from estrado.llm import queries
    from estrado.sources.fallos import read_table

    reference = [tuple(r) for r in read_table(spark, DATA, "fuentes_ref").select("source_id", "canonical_name", "short_name").collect()]
    owners, full = {}, {}
    for source, name, short in sorted(reference, reverse=True):
        full[canon.key_of(re.sub(r"\([^)]*\)", " ", canon.fold(name)))] = source
        for key in canon.reference_keys(name, short):
            owners.setdefault(key, set()).add(source)
    keys = {k: full[k] if len(s) > 1 else min(s) for k, s in owners.items() if len(s) == 1 or k in full}
    forms = canon.Linker([]).forms

    def meant(value):
        best = (99, -1)
        numbers = canon.numbers_of(forms(value)[0]) if forms(value) else []
        for form in forms(value):
            for key, source in keys.items():
                if canon.numbers_of(form) == numbers == canon.numbers_of(key):
                    d = levenshtein(form, key)
                    if d <= min(canon.allowed(form), canon.allowed(key)):
                        best = min(best, (d, source))
        return best[1]

    memo, want = {}, set()
    cases = [("main_source", r.cit_id, 0, r.main_source) for r in read_table(spark, DATA, "ruling_citations").collect() if r.main_source and r.main_source.strip() and r.main_source != "Otro" and r.main_source not in {n for _, n, _ in reference}]
    cases += [("extra", r.cit_id, 0, r.extra) for r in read_table(spark, DATA, "ruling_citations").collect() if r.main_source == "Otro" and r.extra and r.extra.strip()]
    cases += [("verbatim", r.sub_id, k, v) for r in read_table(spark, DATA, "subsection_citations").collect() for k, v in enumerate(r.verbatim_citations or []) if v and v.strip()]
    for field, row, pos, value in cases:
        if value not in memo:
            memo[value] = meant(value)
        want.add((field, row, pos, memo[value]))
    assert {tuple(r) for r in queries.queries()["p3_found"](spark, DATA).collect()} == want
