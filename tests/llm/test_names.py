import pytest

from estrado.llm import names

SPELLINGS = {
    "zammendi": ["CONCEPCIÓN EUGENIA ZAMMENDI DIJO", "CONCEPCION E. ZAMMENDI DIJO", "VOCAL ZAMMENDI DIJO", "CONCHITA ZAMMENDI DIJO", "ZAMMENDI, CONCEPCIÓN DIJO", "CE ZAMMENDI DIJO", "DRA. ZAMMEDNI DIJO"],
    "trescano 1": ["DR. IGNACIO TRESCANO DIJO", "SR. VOCAL DR. IGNACIO A. TRESCANO DIJO", "TRESCANO IGNACIO ANDRÉS DIJO"],
    "trescano 2": ["JOSÉ J TESCANO DIJO", "TRESCANO, JOSÉ DIJO", "PEPE TRESCANO DIJO"],
    "quilvero 1": ["LUIS O. QUILVERO DIJO", "DR. LUIS QUILVERO DIJO"],
    "quilvero 2": ["LUISA I. QUILVERO DIJO", "QUILVERO, LUISA DIJO"],
}
SCHEMA = "organo string, section string"


def people(spark, rows):
    out = names.link(spark.createDataFrame(rows, SCHEMA), "organo", "section")
    groups = {}
    for r in out.collect():
        groups.setdefault((r.organo, r.person), set()).add(r.section)
    return groups


def test_variants_of_one_judge_and_namesakes(spark):
    rows = [("A", s) for spellings in SPELLINGS.values() for s in spellings] * 3
    assert sorted(map(sorted, people(spark, rows).values())) == sorted(map(sorted, SPELLINGS.values()))


def test_courts_share_no_judges_and_pairs_are_whole(spark):
    rows = [(c, s) for c in "AB" for s in SPELLINGS["trescano 1"]]
    got = names.found(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as person", "2 as g", "3 as name")).collect()
    assert len(got) == 6 and all(r.section_a < r.section_b for r in got)


def test_nulls_titles_only_empty(spark):
    assert people(spark, [("A", "VOCAL DIJO"), ("A", ""), (None, "PAZ DIJO"), ("A", None)]) == {("A", "VOCAL DIJO"): {"VOCAL DIJO"}, ("A", ""): {""}}
    assert names.found(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "MARTÍN " * 5_000 + "ORONELLI DIJO"
    assert people(spark, [("A", long)]) == {("A", long): {long}}


@pytest.mark.parametrize(("a", "b", "want"), [("luis", "luisa", 0), ("chela", "graciela", 2), ("ter", "teresa", 2), ("j", "jose", 1), ("orosotto", "oosotto", 3), ("vallano", "valbato", 2), ("paz", "pez", 0), ("antonio", "antonia", 0), ("reni", "renata", 2), ("paz", "paz", 4)])
def test_words(a, b, want):
    assert names.explains(a, b) == names.explains(b, a) == want


def test_short_surnames_link(spark):
    one = ["Ana Paz DIJO", "PAZ ANA DIJO", "Ana Paz  DIJO", "PAZ, ANA DIJO", "A. PAZ DIJO"]
    two = ["ANTONIO GIL DIJO", "A. GIL DIJO", "GIL DIJO"]
    three = ["JUAN LI DIJO", "LI, JUAN DIJO"]
    rows = [("A", s) for s in one + two + three]
    assert sorted(map(sorted, people(spark, rows).values())) == sorted(map(sorted, (one, two, three)))


def test_familiar_forms_are_an_input(spark):
    df = spark.createDataFrame([("A", "PEPE GIL DIJO"), ("A", "JOSÉ GIL DIJO")], SCHEMA)
    count = lambda **more: names.link(df, "organo", "section", **more).select("person").distinct().count()
    assert count() == 1 and count(nicknames={}) == 2


def test_prefixes_lose_no_pair():
    import itertools
    import math
    import random
    from collections import Counter

    r = random.Random(5)
    own = [[("".join(r.choice("abcd") for _ in range(r.randint(1, 6)))) for _ in range(r.randint(1, 3))] for _ in range(80)]
    df = Counter(g for w in own for g in set(names.grams(w)))
    idf = {g: math.log(1 + len(own) / n) for g, n in df.items()}
    units = [names.vector(w, idf) for w in own]
    for least in (0.15, 0.4, 0.8):
        heads = [set(names.prefix(u, idf, least)) for u in units]
        for i, j in itertools.combinations(range(len(own)), 2):
            if names.cosine(units[i], units[j]) >= least:
                assert heads[i] & heads[j]


def test_rounds_over_tables_give_the_same_people(spark):
    rows = [("A", s) for spellings in SPELLINGS.values() for s in spellings] + [("B", s) for s in SPELLINGS["zammendi"]]
    df = spark.createDataFrame(rows, SCHEMA)
    people_of = lambda **more: {tuple(r) for r in names.link(df, "organo", "section", **more).collect()}
    group = lambda rows: sorted(sorted(s for o, s, q in rows if (o, q) == k) for k in {(o, q) for o, _, q in rows})
    assert group(people_of()) == group(people_of(big=0))


def brute_linkage(sims, n, least):
    label = list(range(n))
    while True:
        best = None
        for i in sorted(set(label)):
            for j in sorted(set(label)):
                if i < j:
                    x, y = [p for p in range(n) if label[p] == i], [p for p in range(n) if label[p] == j]
                    mean = sum(sims.get((min(p, q), max(p, q)), 0.0) for p in x for q in y) / (len(x) * len(y))
                    if mean >= least and (best is None or mean > best[0] + 1e-12):
                        best = (mean, i, j)
        if best is None:
            return label
        label = [best[1] if c == best[2] else c for c in label]


def test_linkage_agrees_with_brute_force():
    import random

    r = random.Random(3)
    for _ in range(40):
        n = r.randint(1, 9)
        sims = {(i, j): r.random() for i in range(n) for j in range(i + 1, n) if r.random() < 0.6}
        assert names.linkage(sims, n, 0.3) == brute_linkage(sims, n, 0.3)


def test_average_linkage():
    assert names.linkage({(0, 1): 0.9, (1, 2): 0.6}, 3, 0.45) == [0, 0, 2]
    assert names.linkage({(0, 1): 0.9, (1, 2): 0.6, (0, 2): 0.5}, 3, 0.45) == [0, 0, 0]
    assert names.linkage({}, 2, 0.4) == [0, 1]
