"""Problem 7: variant spellings of people's names, linked to one person per group (a court).

A name, cleaned of titles, is one vector of the character n-grams of its words, weighted by inverse document frequency;
n-grams don't cross words, so the order of the words is free. A sparse join over the n-grams finds every pair of names of
a group whose cosine reaches a threshold. An exact check then takes out pairs that contradict each other (both hold a
word the other can't explain, or their titles tell another gender): namesakes differ in a few letters only. Average-linkage
clustering over the cosines that are left yields the people.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.plans.pairs import pairs_within
from estrado.plans.scratch import materialize

#: Least cosine of two names that may be one person's; every pair above it is looked at.
COSINE = 0.15
#: Mean cosine between clusters down to which they are joined; pairs that contradict each other count 0.
LINKAGE = 0.22
#: Most linked pairs of a component that one task clusters; larger components are clustered by rounds over tables.
BIG = 200_000
#: Titles and what else stands around a name, with the gender they tell; fixed values.
TITLES = {"dr": "m", "dres": "m", "doctor": "m", "sr": "m", "senor": "m", "don": "m", "juez": "m", "dra": "f", "doctora": "f", "sra": "f", "srta": "f", "senora": "f", "dona": "f", "jueza": "f", "vocal": "", "vocales": "", "magistrado": "m", "magistrada": "f", "presidente": "", "presidenta": "f", "ministro": "m", "ministra": "f", "camarista": "", "lic": "", "el": "", "la": "", "dijo": "", "dice": "", "voto": "", "ponente": "", "de": "", "del": "", "los": "", "las": "", "y": ""}
#: Usual Spanish familiar forms that are no beginning of the given names they stand for; fixed values, a parameter of ``link``.
NICKNAMES = {
    "alita": "alicia", "beto": "alberto roberto norberto", "betty": "beatriz", "cacho": "carlos", "charo": "rosario", "chela": "graciela marcela", "chelo": "marcelo", "coca": "jorgelina", "concha": "concepcion", "conchita": "concepcion",
    "fito": "adolfo rodolfo", "isa": "isabel", "juanca": "juan", "lala": "laura", "lali": "laura", "lalo": "eduardo gonzalo", "lito": "carlos manuel", "lola": "dolores", "lolita": "dolores", "loli": "dolores", "lucho": "luis", "lucha": "lucia luisa", "luchi": "lucia luisa", "lula": "luisa", "luli": "lucia luisa",
    "manolo": "manuel", "mari": "maria marina marisa", "mariu": "maria", "panchita": "francisca", "martincho": "martin", "tincho": "martin agustin", "reni": "renata", "meche": "mercedes", "mecha": "mercedes", "memo": "guillermo", "mimi": "miriam", "nacho": "ignacio", "nando": "fernando",
    "pacho": "francisco", "paco": "francisco", "pancho": "francisco", "pepa": "josefa", "pepe": "jose", "pepito": "jose", "quico": "enrique francisco", "quique": "enrique", "rochi": "rocio", "susi": "susana", "tati": "tatiana", "tito": "alberto ernesto roberto", "toto": "antonio", "tono": "antonio", "tony": "antonio", "vicky": "victoria", "willy": "guillermo", "yago": "santiago", "jaco": "jacobo", "tiago": "santiago",
}
GRAM = 2


def words(name: str) -> tuple[list[str], str]:
    """The distinct words of a name without titles, and the gender its titles tell ('' if none or both)."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    found = re.findall(r"[^\W\d_]+", text)
    told = {TITLES[w] for w in found if w in TITLES} - {""}
    return list(dict.fromkeys(w for w in found if w not in TITLES)), told.pop() if len(told) == 1 else ""


def readings(own: list[str]) -> list[list[str]]:
    """The words as they stand and, where there are words of two letters, with these as initials."""
    split = list(dict.fromkeys(p for w in own for p in (w if len(w) == 2 else [w])))
    return [own] if split == own else [own, split]


def grams(own: list[str]) -> Counter:
    """n-grams of the words with a blank on both sides; an initial has the beginning only, a word of two letters counts as two initials too."""
    out: Counter = Counter()
    for w in dict.fromkeys(w for reading in readings(own) for w in reading):
        padded = f" {w} " if len(w) > 1 else f" {w}"
        out.update(padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1))
    return out


def vector(own: list[str], idf: Mapping[str, float]) -> dict[str, float]:
    """The unit vector of a name; empty if it has no words."""
    raw = {g: (1 + math.log(n)) * idf.get(g, 0.0) for g, n in grams(own).items()}
    size = math.sqrt(sum(x * x for x in raw.values()))
    return {g: x / size for g, x in raw.items()} if size else {}


def cosine(a: Mapping[str, float], b: Mapping[str, float]) -> float:
    return sum(x * b[g] for g, x in a.items() if g in b)


def prefix(unit: Mapping[str, float], idf: Mapping[str, float], least: float) -> list[str]:
    """The rarest n-grams of a vector, until what is left is shorter than ``least``.

    Two vectors of a cosine of ``least`` or more share an n-gram of both prefixes: the rarest they share, as all they
    share from there on would else lie in a rest that is too short.
    """
    order = sorted(unit, key=lambda g: (-idf[g], g))
    left = sum(x * x for x in unit.values())
    out = []
    for g in order:
        if left < least * least - 1e-9:
            break
        out.append(g)
        left -= unit[g] ** 2
    return out


def swaps(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours as one edit, or most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one, row = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def explains(a: str, b: str, nicknames: Mapping[str, str] = NICKNAMES) -> int:
    """Whether two words may be one word of a name: 4 equal, 3 a slip, 2 two slips or a short or familiar form, 1 an initial, 0 not."""
    if a == b:
        return 4
    short, long = sorted((a, b), key=lambda w: (len(w), w))
    if len(short) == 1:
        return int(long[0] == short)
    full = nicknames.get(short, "").split() + nicknames.get(long, "").split()
    if any(swaps(f, w, 1) <= 1 for f in full for w in (short, long)):
        return 2
    if long == short + "a" or len(a) == len(b) and a[:-1] == b[:-1] and {a[-1], b[-1]} == {"o", "a"}:
        return 0  # a man's and a woman's name
    begins = long.startswith(short) and len(short) <= 4
    diminutive = len(long) > 5 and long[-3:] in ("ita", "ito") and long[:-3] in (short, short[:-1])
    familiar = 4 <= len(short) <= 5 and short[-1] in "aeiouy" and len(long) > len(short) and long.startswith(short[:-1])
    if begins or diminutive or familiar:
        return 2
    if len(short) < 4:
        return 0
    slips = swaps(a, b)
    return 3 if slips == 1 else 2 if slips == 2 and len(short) >= 6 else 0


def agree(a: tuple[list[str], str], b: tuple[list[str], str], nicknames: Mapping[str, str] = NICKNAMES) -> bool:
    """Whether two names don't contradict each other: of their words, matched one to one, at most one name has some left
    over, a matched pair is more than an initial, and their titles tell no different genders."""
    if a[1] and b[1] and a[1] != b[1]:
        return False
    return any(_match(x, y, nicknames) for x in readings(a[0]) for y in readings(b[0]))


def _match(x: list[str], y: list[str], nicknames: Mapping[str, str]) -> bool:
    same = set(x) & set(y)
    strong = any(len(w) > 1 for w in same)
    x, y = [w for w in x if w not in same], [w for w in y if w not in same]
    scores = sorted(((explains(p, q, nicknames), -abs(i - j), p, q) for i, p in enumerate(x) for j, q in enumerate(y)), reverse=True)
    used_x: set[str] = set()
    used_y: set[str] = set()
    for score, _, p, q in scores:
        if score and p not in used_x and q not in used_y:
            used_x.add(p)
            used_y.add(q)
            strong = strong or score > 1
    return strong and (len(used_x) == len(x) or len(used_y) == len(y))


def spellings(names: DataFrame, group: str, name: str) -> DataFrame:
    """(g, name) distinct; null groups and names are left out."""
    rows = names.where(F.col(group).isNotNull() & F.col(name).isNotNull())
    return rows.select(F.col(group).cast("string").alias("g"), F.col(name).alias("name")).distinct()


def weights(rows: DataFrame) -> dict[str, float]:
    """The inverse document frequency of every n-gram; there are at most as many as pairs of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for name in batch.column(1).to_pylist():
                seen[""] += 1
                seen.update(set(grams(words(name)[0])))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    df = {r["gram"]: r["n"] for r in rows.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = df.pop("", 0)
    return {g: math.log(1 + total / n) for g, n in df.items()}


def similar(rows: DataFrame, least: float = COSINE, nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """(g, a, b, s): pairs a < b of a group's names with their cosine, from ``least`` on, that don't contradict each other."""
    idf = weights(rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(g, n, gram) for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for gram in prefix(vector(words(n)[0], idf), idf, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["g", "name", "gram"])

    met = pairs_within(rows.mapInArrow(index, "g string, name string, gram string"), ["g", "gram"], "name").select("g", "a", "b").distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[tuple[list[str], str], dict[str, float]]] = {}

        def of(name: str) -> tuple[tuple[list[str], str], dict[str, float]]:
            if name not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                own = words(name)
                memo[name] = (own, vector(own[0], idf))
            return memo[name]

        for batch in batches:
            out = []
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                (x, u), (y, v) = of(a), of(b)
                s = cosine(u, v)
                if s >= least and agree(x, y, nicknames):
                    out.append((g, a, b, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.float64()))], names=["g", "a", "b", "s"])

    return met.mapInArrow(score, "g string, a string, b string, s double")


def linkage(sims: dict[tuple[int, int], float], n: int, least: float) -> list[int]:
    """Average-linkage clusters of n points; pairs that are not in ``sims`` (i < j) have similarity 0. Of equal means the smallest labels join first."""
    members = {i: [i] for i in range(n)}
    between: dict[int, dict[int, float]] = defaultdict(dict)
    for (i, j), s in sims.items():
        between[i][j] = between[j][i] = s
    queue = [(-s, i, j, 1, 1) for (i, j), s in sims.items() if s >= least]
    heapq.heapify(queue)
    while queue:
        _, i, j, size_i, size_j = heapq.heappop(queue)
        if len(members.get(i, ())) != size_i or len(members.get(j, ())) != size_j:
            continue  # an older state of one of them
        members[i] += members.pop(j)
        for k, s in between.pop(j).items():
            between[k].pop(j)
            if k != i:
                between[i][k] = between[k][i] = between[i].get(k, 0.0) + s
        for k, s in between[i].items():
            mean = s / (len(members[i]) * len(members[k]))
            if mean >= least:
                x, y = min(i, k), max(i, k)
                heapq.heappush(queue, (-mean, x, y, len(members[x]), len(members[y])))
    label = [0] * n
    for i, points in members.items():
        for p in points:
            label[p] = i
    return label


def components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, name, c): the smallest name that each name of ``rows`` (g, name) reaches over ``edges`` (g, a, b).

    Labels spread to neighbours and from there to the label's own label, so the rounds grow with the logarithm of the
    longest chain; every round is written, and ends when no label changes.
    """
    both = materialize(edges.select("g", "a", "b").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = rows.select("g", "name", F.col("name").alias("c"))
    while True:
        near = both.join(labels.select("g", F.col("name").alias("b"), "c"), ["g", "b"]).groupBy("g", F.col("a").alias("name")).agg(F.min("c").alias("n"))
        spread = labels.join(near, ["g", "name"], "left").select("g", "name", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = labels.select("g", F.col("name").alias("c"), F.col("c").alias("far"))
        new = materialize(spread.join(jump, ["g", "c"]).select("g", "name", "old", F.least("c", "far").alias("c")))
        labels = new.select("g", "name", "c")
        if new.where("c <> old").isEmpty():
            return labels


def _cluster_parts(pairs: DataFrame, least: float) -> DataFrame:
    """(g, name, person) of components (g, c, a, b, s) of at most BIG pairs, each in one task."""

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for g, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                triples = [(x["a"], x["b"], x["s"]) for x in part.as_py()]
                known = sorted({n for a, b, _ in triples for n in (a, b)})
                at = {n: i for i, n in enumerate(known)}
                label = linkage({(at[a], at[b]): s for a, b, s in triples}, len(known), least)
                out += [(g, n, known[i]) for n, i in zip(known, label)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["g", "name", "person"])

    whole = pairs.groupBy("g", "c").agg(F.collect_list(F.struct("a", "b", "s")).alias("e")).select("g", "e")
    return whole.mapInArrow(cluster, "g string, name string, person string")


def _cluster_rounds(pairs: DataFrame, least: float) -> DataFrame:
    """The same clusters by rounds: all clusters that are each other's nearest join at once.

    Average linkage never brings a third cluster nearer than the two that join, so the order of such joins is free.
    """
    edges = materialize(pairs.select("g", "a", "b", "s", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    people = edges.select("g", F.col("a").alias("name")).union(edges.select("g", "b")).distinct().withColumn("person", F.col("name"))
    people = materialize(people)
    while True:
        rank = F.struct(F.round(-F.col("s") / (F.col("na") * F.col("nb")), 12).alias("m"), "a", "b")
        good = edges.where(F.col("s") / (F.col("na") * F.col("nb")) >= least).withColumn("r", rank)
        ends = good.select("g", F.col("a").alias("x"), "r").union(good.select("g", "b", "r"))
        best = ends.groupBy("g", "x").agg(F.min("r").alias("r"))
        twice = best.groupBy("g", "r").agg(F.count("*").alias("n")).where("n = 2").select("g", F.col("r.a").alias("into"), F.col("r.b").alias("gone"))
        joins = materialize(twice)
        if joins.isEmpty():
            return people
        moved = lambda df, c: df.join(joins.withColumnRenamed("gone", c), ["g", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")
        people = materialize(moved(people, "person").select("g", "name", "person"))
        sizes = people.groupBy("g", "person").agg(F.count("*").alias("n"))
        new = moved(moved(edges.select("g", "a", "b", "s"), "a"), "b").where("a <> b")
        new = new.groupBy("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"))
        size = lambda c: sizes.select("g", F.col("person").alias(c), F.col("n").alias(f"n{c}"))
        edges = materialize(new.join(size("a"), ["g", "a"]).join(size("b"), ["g", "b"]).select("g", "a", "b", "s", "na", "nb"))


def link(names: DataFrame, group: str, name: str, least: float = LINKAGE, nicknames: Mapping[str, str] = NICKNAMES, big: int = BIG) -> DataFrame:
    """(group, name, person): every distinct spelling with the person it names, the smallest spelling of its cluster.

    Names of different groups are never linked. Repeated rows count once, empty input gives no rows, and a name without
    words of its own (titles only) is a person by itself; words of any length count, names of any length are read whole.
    Names that no chain of similar pairs connects are clustered apart, as no linkage could join them; components of more
    than ``big`` pairs are clustered by rounds over tables, with the same result but for the order of equal means.
    """
    rows = materialize(spellings(names, group, name))
    scored = materialize(similar(rows, nicknames=nicknames))
    pairs = materialize(scored.join(components(rows, scored).withColumnRenamed("name", "a"), ["g", "a"]))
    sizes = materialize(pairs.groupBy("g", "c").agg(F.count("*").alias("n")).where(F.col("n") > big).select("g", "c"))
    if sizes.isEmpty():
        people = _cluster_parts(pairs, least)
    else:
        people = _cluster_parts(pairs.join(sizes, ["g", "c"], "left_anti"), least).unionByName(_cluster_rounds(pairs.join(sizes, ["g", "c"], "left_semi"), least))
    out = rows.join(people, ["g", "name"], "left").select("g", "name", F.coalesce("person", "name").alias("person"))
    return out.select(F.col("g").alias(group), F.col("name").alias(name), "person")


def found(votes: DataFrame) -> DataFrame:
    """p7_found: every pair of spellings of a court that name the same judge; see ``link`` for nulls, repeats and the like."""
    people = materialize(link(votes, "organo", "section"))
    pairs = pairs_within(people, ["organo", "person"], "section")
    return pairs.select("organo", F.col("a").alias("section_a"), F.col("b").alias("section_b"))
