"""Problem 2: page noise in the text of scanned rulings.

Noisy channel: a misread word is explained as a word of the corpus whose characters were confused on the page. Word
and word-pair counts of the whole corpus give the language model, the confusions found in the corpus itself give the
channel, and Viterbi over the candidate words of a line decides. Running headers, page numbers and divided words are
recognised by their form first, as they would break the word sequence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.operators.nested import contents_of
from estrado.plans.scratch import materialize
from estrado.sources.fallos import first_delivery, iter_rulings

SECTIONS = ("INICIO", "ACUERDO", "///CUERDO", "RESUELVE")
#: A word seen so often in rulings that are no scans is sound as it stands.
ATTESTED = 3
#: Rounds in which the channel is learned.
ROUNDS = 3
#: Counts kept in a task before they are handed on.
COUNTERS = 400_000
#: Characters as printed and as misread, of like shape on a scanned page (common knowledge of text recognition); fixed values.
CONFUSIONS = (
    ("o", "0"), ("o", "9"), ("a", "@"), ("a", "4"), ("e", "c"), ("e", "3"), ("r", "f"), ("t", "+"), ("t", "i"), ("t", "7"), ("i", "|"), ("i", "1"), ("i", "l"), ("i", "!"),
    ("l", "|"), ("l", "1"), ("l", "i"), ("d", "cl"), ("cl", "d"), ("s", "5"), ("s", "$"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("v", "y"), ("g", "q"), ("g", "9"), ("b", "8"), ("h", "8"), ("li", "b"), ("m", "fn"),
    ("b", "6"), ("ó", "6"), ("í", "ï"), ("á", "à"), ("é", "è"), ("ó", "ò"), ("h", "b"), ("b", "h"), ("li", "h"), ("h", "li"), ("á", "a´"), ("é", "e´"), ("í", "i´"), ("ó", "o´"), ("ú", "u´"),
    ("ñ", "fi"), ("ñ", "n~"), ("n", "ri"), ("w", "vv"), ("z", "2"), ("c", "e"), ("f", "r"),
)
#: Words that begin a running header or footer, or a signature; fixed values.
_HEADS = ("poderjudicial", "firmado")
#: Offices whose names begin one where they stand in capitals, set apart or with a dash; fixed values.
_OFFICES = ("camaradeape", "cortesuprema", "superiortribunal", "tribunal", "juzgado", "fiscalia", "defensoria", "ministeriopublico", "secretaria")
_FOLD = str.maketrans({"0": "o", "9": "o", "1": "i", "l": "i", "|": "i", "!": "i", "5": "s", "$": "s", "@": "a", "8": "b", "+": "t", "6": "o", "3": "e"})
_FOLDED_HEADS, _FOLDED_OFFICES = (tuple(w.translate(_FOLD) for w in words) for words in (_HEADS, _OFFICES))
_PAGENO = re.compile(r"(?i)^[\s\[\](){}/|\-–—=*.·~°ºN]*(?:(?:p[aá4@]g(?:ina|s)?|pg|p|fs?|fo[l1i|][i1l|]?[o0]?s?|fojas?|hoja|h)\b\.?\s*(?:n[°º.]\s*)?)?(?:\d{1,4}|[ivxlc]{1,7}(?=\W*$))(?:\s*(?:/|de|of|-)\s*\d{1,4})?[\s\[\](){}/|\-–—=*.·~]*$")
_STAMP = re.compile(r"^\s*\d{2,4}[-/.]\d{1,2}[-/.]\d{2,4}(?:[T ]\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:hs?\.?|Z))?)?\s*$|^\s*\d{1,2}:\d{2}(?::\d{2})?\s*$")
_CASE = re.compile(r'^\s*"[^"]{3,}?\s[cCeE]/\s?[^"]{2,}"\s*$')
_FILE = re.compile(r"(?i)^\s*exp[t+i]?[ecd]?[.,t+]*[ec]?\.?\s*n?[°º.]*\s*[\d0-9oOlI|.]+\s*[-–]\s*\S.*[^.,;]\s*$")
_HYPHEN = re.compile(r"[^\W\d_]['´@|+\w]*[-\u00AD\u2010\u2011\u00AC]\s*$")
_EDGE = "\"'“”«»()[]¿?¡!.,;:"
#: Words that are numbers and never in doubt.
NUMBER = r"^[\d.,/°ºª:\-$%]+$"
_NUMBER = re.compile(NUMBER)


def line_kind(line: str, inner: bool = True) -> str:
    """``header``, ``pageno``, or '' for text. ``inner``: the line is one of several of its paragraph."""
    bare = line.strip()
    if not bare or not inner:
        return ""
    if _PAGENO.match(bare) and (any(c.isdigit() for c in bare) or bare[0] in "-[(–—"):
        return "pageno"
    if _STAMP.match(bare) or _CASE.match(bare) or _FILE.match(bare):
        return "header"
    if bare[-1] not in ".,;:":
        key = unicodedata.normalize("NFD", bare.lower()).translate(_FOLD)
        key = "".join(c for c in key if c.isalnum())
        formal = " - " in bare or bare.isupper() or _spaced(bare)
        if key.startswith(_FOLDED_HEADS) or formal and key.startswith(_FOLDED_OFFICES):
            return "header"
        if _spaced(bare) or bare.upper() == bare and sum(c.isalpha() for c in bare) > 12 and " - " in bare:
            return "header"
    return ""


#: Words that a number goes with, at the end of the line before; fixed values.
_NUMBERED = re.compile(r"(?iu)(?:\b(?:[a@][rf][t+i][s5]?|[i|1]nc|nr[o0]|f[s5])\.|n[°º]|[$§])$")


def line_kinds(lines: list[str]) -> list[str]:
    """``line_kind`` of each line; a bare number that the text line before asks for is no page number, unless the next
    text line brings one."""
    kinds = [line_kind(line, len(lines) > 1) for line in lines]
    before = ""
    for k, line in enumerate(lines):
        if kinds[k] == "pageno" and line.strip().isdigit() and _NUMBERED.search(before):
            after = next((x.strip() for x, kind in zip(lines[k + 1 :], kinds[k + 1 :]) if not kind and x.strip()), "")
            if not after[:1].isdigit():
                kinds[k] = ""
        if not kinds[k] and line.strip():
            before = line.rstrip()
    return kinds


def _spaced(bare: str) -> bool:
    """Letters set apart: every other character is a space."""
    parts = bare.split()
    return len(parts) > 6 and sum(len(p) == 1 for p in parts) > 0.8 * len(parts)


def is_divided(line: str) -> bool:
    return bool(_HYPHEN.search(line))


def words_of(text: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in text.lower().split()) if w]


def sections_of(ruling: dict[str, Any], sections: tuple[str, ...] = SECTIONS) -> Iterator[tuple[str, int, str]]:
    contents = contents_of(ruling)
    for section in sections:
        value = contents.get(section)
        for pos, item in enumerate(value if isinstance(value, list) else [value]):
            item = item.get("texto") if isinstance(item, dict) else item
            if isinstance(item, str):
                yield section, pos, item


_PARTS = "tag string, file_id bigint, obj_pos int, section string, para_pos int, line_no int, kind string, a string, b string, n long, doubt array<string>"
_ARROW = pa.schema([("tag", pa.string()), ("file_id", pa.int64()), ("obj_pos", pa.int32()), ("section", pa.string()), ("para_pos", pa.int32()), ("line_no", pa.int32()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64()), ("doubt", pa.list_(pa.string()))])


def _parts(files: DataFrame, every_line: bool) -> DataFrame:
    """One pass over the payloads.

    tag ``line``: a line of a scanned ruling, its kind so far, its text (a) and the first half of the word that the line
    before left divided (b), and its words in doubt: all but numbers and words attested by the rulings of
    its own task, a lower bound of the corpus count. Without ``every_line``, lines without such words are left out.
    tag ``pair``: word a follows word b n times, in scans and elsewhere; tag ``word``: n times a, outside scans.
    """

    def flush(counts: Counter, tag: str) -> pa.RecordBatch:
        keys = list(counts)
        left, right = ([k[0] for k in keys], [k[1] for k in keys]) if tag == "pair" else (keys, [None] * len(keys))
        size, none = len(keys), [None] * len(keys)
        cols = [[tag] * size, none, none, none, none, none, none, left, right, list(counts.values()), none]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pairs: Counter = Counter()
        fresh: Counter = Counter()
        for batch in batches:
            scans = []
            for file_id, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                for pos, ruling in iter_rulings(payload.as_py()):
                    paragraphs = list(sections_of(ruling))
                    if any("\n" in text for _, _, text in paragraphs):
                        scans.append((file_id, pos, paragraphs))
                    else:
                        for _, _, text in paragraphs:
                            words = words_of(text)
                            fresh.update(words)
                            pairs.update(zip(words, words[1:]))
            seen.update(fresh)
            yield flush(fresh, "word")
            fresh.clear()
            out: list[tuple] = []
            for file_id, pos, paragraphs in scans:
                for section, para, text in paragraphs:
                    lines = text.split("\n")
                    kinds = line_kinds(lines)
                    body = [k for k, kind in enumerate(kinds) if not kind and lines[k].strip()]
                    half, flow = None, []
                    for place, k in enumerate(body):
                        line, lead = lines[k].rstrip(), half
                        half = None
                        if place + 1 < len(body) and is_divided(line):
                            kinds[k] = "hyphen"
                            half = line.split()[-1][:-1]
                        words = (lead or "") + line.lstrip()
                        if half is not None:
                            words = words[: len(words) - len(half) - 1]
                        words = words_of(words)
                        flow += words
                        doubt = list({w for w in words if seen[w] < ATTESTED and not _NUMBER.match(w)})
                        if every_line or doubt and kinds[k] == "":
                            out.append(("line", file_id, pos, section, para, k, kinds[k], line.lstrip(), lead, None, doubt))
                        elif kinds[k]:
                            out.append(("line", file_id, pos, section, para, k, kinds[k], None, None, None, None))
                    for k, kind in enumerate(kinds):
                        if kind in ("header", "pageno"):
                            out.append(("line", file_id, pos, section, para, k, kind, None, None, None, None))
                    pairs.update(zip(flow, flow[1:]))
                if len(out) > 50_000:
                    yield _rows(out)
                    out.clear()
            if out:
                yield _rows(out)
            if len(pairs) > COUNTERS:
                yield flush(pairs, "pair")
                pairs.clear()
            if len(seen) > COUNTERS:
                seen = Counter({w: n for w, n in seen.items() if n >= ATTESTED})
        if pairs:
            yield flush(pairs, "pair")

    return first_delivery(files).mapInArrow(run, _PARTS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


#: What confusable characters have in common: every confusion's two sides get the same string; fixed values.
SKELETON = (("d", "ci"), ("m", "rri"), ("nñ", "ri"), ("w", "vv"), ("o09gqub6h8óòúù", "ii"), ("tlíï|1!+7ì", "i"), ("f", "r"), ("eéè3", "c"), ("@4áà", "a"), ("5$", "s"), ("y", "v"), ("2", "z"), ("´~", ""))
_SKELETON = str.maketrans({c: to for chars, to in SKELETON for c in chars})


def skeleton(word: str) -> str:
    """A string that a word shares with all words it can be misread as, whatever the number of misreadings."""
    return word.translate(_SKELETON)


def skeleton_of(word: Any) -> Any:
    """``skeleton`` as a column."""
    for chars, to in SKELETON:
        word = F.regexp_replace(word, "[" + re.sub(r"([|$])", r"\\\1", chars) + "]", to)
    return word


_MISREAD: dict[str, list[str]] = defaultdict(list)
for _printed, _misread in CONFUSIONS:
    _MISREAD[_misread].append(_printed)


def explained(word: str, printed: str) -> list[tuple[str, str]] | None:
    """The fewest confusions by which ``printed`` was read as ``word``, None if none do; of any number and place."""
    n, m = len(word), len(printed)
    if abs(n - m) > max(n, m) // 2:
        return None
    best: dict[tuple[int, int], tuple[int, tuple | None]] = {(0, 0): (0, None)}
    for i in range(n + 1):
        for j in range(max(0, i // 2 - 1), min(m, 2 * i + 2) + 1):
            at = best.get((i, j))
            if at is None:
                continue
            steps = [((i + 1, j + 1), 0, None)] if i < n and j < m and word[i] == printed[j] else []
            for size in (1, 2):
                misread = word[i : i + size]
                if len(misread) == size:
                    steps += [((i + size, j + len(p)), 1, (p, misread)) for p in _MISREAD.get(misread, ()) if printed.startswith(p, j)]
            for to, cost, used in steps:
                if to not in best or best[to][0] > at[0] + cost:
                    best[to] = (at[0] + cost, ((i, j), used))
    if (n, m) not in best:
        return None
    out, place = [], (n, m)
    while best[place][1]:
        place, used = best[place][1]
        if used:
            out.append(used)
    return out[::-1]


def viterbi(states: list[list[tuple[str, float]]], pair: dict[tuple[str, str], float], start: float) -> list[int]:
    """Index of the chosen state at each place; ``pair`` holds log P(b | a) where known, ``start`` elsewhere."""
    best = [[s[1] for s in states[0]]]
    via: list[list[int]] = []
    for prev, cur in zip(states, states[1:]):
        row, back = [], []
        for word, emit in cur:
            scores = [best[-1][i] + pair.get((p[0], word), start) for i, p in enumerate(prev)]
            i = max(range(len(scores)), key=scores.__getitem__)
            row.append(scores[i] + emit)
            back.append(i)
        best.append(row)
        via.append(back)
    at = max(range(len(best[-1])), key=best[-1].__getitem__)
    path = [at]
    for back in reversed(via):
        at = back[at]
        path.append(at)
    return path[::-1]


def _models(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, clean) counts outside scans, and (a, b, n) counts of word pairs everywhere."""
    words = parts.where("tag = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("clean"))
    pairs = parts.where("tag = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return words, pairs


def _words(lines: DataFrame, *more: str) -> DataFrame:
    """(key..., kind, b, more..., words) of lines, the carried half joined to the first word."""
    flow = F.concat(F.coalesce("b", F.lit("")), F.col("a"))
    cut = F.when(F.col("kind") == "hyphen", F.regexp_replace(flow, r"\S+\s*$", "")).otherwise(flow)
    strip = lambda w: F.btrim(w, F.lit(_EDGE))
    words = F.filter(F.transform(F.split(F.lower(cut), r"(?U)\s+"), strip), lambda w: w != "")
    return lines.select(*KEY, "kind", "b", *more, words.alias("words"))


KEY = ["file_id", "obj_pos", "section", "para_pos", "line_no"]


def _candidates(doubtful: DataFrame, words: DataFrame) -> DataFrame:
    """(word, cand, clean, used): the sound words a doubtful one can be a misreading of, with the confusions that explain it."""
    of = lambda df, name: df.withColumn("_sk", skeleton_of(F.col(name)))
    met = of(doubtful, "word").join(of(words.withColumnRenamed("word", "cand"), "cand"), "_sk").select("word", "cand", "clean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = [explained(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if u is None else [f"{p}>{m}" for p, m in u] for u in used], pa.list_(pa.string()))], names=["word", "cand", "clean", "used"])
            yield found.filter(pa.array([u is not None for u in used]))

    return met.mapInArrow(run, "word string, cand string, clean long, used array<string>")


def channel_of(cands: DataFrame, corpus: int, rounds: int = ROUNDS) -> dict[str, float]:
    """log P of every confusion by expectation and maximisation over the candidates of all doubtful words.

    Each doubtful word counts once, shared by its candidates in proportion to their likelihood under the confusions'
    present weights and their own frequency; the first round knows the frequencies only.
    """
    lp: dict[str, float] = {}
    for _ in range(rounds):
        share = F.exp(_cost_of(lp, corpus) - F.max(_cost_of(lp, corpus)).over(_by("word")))
        part = cands.withColumn("w", share).withColumn("w", F.col("w") / F.sum("w").over(_by("word")))
        seen = {r["c"]: r["n"] for r in part.select(F.explode("used").alias("c"), "w").groupBy("c").agg(F.sum("w").alias("n")).collect()}  # at most as many as CONFUSIONS
        total = sum(seen.values())
        lp = {f"{p}>{m}": math.log((seen.get(f"{p}>{m}", 0.0) + 0.1) / (total + 1)) for p, m in CONFUSIONS}
    return lp


def _cost_of(lp: dict[str, float], corpus: int) -> Any:
    """log P(cand) + the sum of its confusions' log P."""
    weight = F.create_map(*[F.lit(x) for pair in lp.items() for x in pair]) if lp else None
    used = F.aggregate("used", F.lit(0.0), lambda s, u: s + F.coalesce(F.try_element_at(weight, u), F.lit(-12.0))) if lp else F.lit(0.0)
    return used + F.log(F.col("clean") / F.lit(float(max(1, corpus))))


def decode(parts: DataFrame) -> DataFrame:
    """(key..., kind, b, fixes): the misread words of every line, as array of (k, word, printed)."""
    words, pairs = _models(parts)
    words = materialize(words.where(F.col("clean") >= ATTESTED))
    corpus = words.agg(F.sum("clean")).first()[0] or 0
    lines = parts.where("tag = 'line' and size(doubt) > 0")
    tokens = lines.select(*KEY, F.explode("doubt").alias("word"))
    doubtful = tokens.select("word").distinct().join(words, "word", "left_anti")
    cands = materialize(_candidates(doubtful, words))
    lp = channel_of(cands, corpus)
    options = cands.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-_cost_of(lp, corpus)).alias("cost"), F.col("cand")))).alias("options"))
    # Words whose signs no sound word holds are misread even where no word of the corpus explains them.
    strange = F.col("word").rlike(r"\p{L}[@|+´]|[@|+]\p{L}")
    marked = doubtful.select("word", strange.alias("strange")).join(options, "word", "left").where("strange or options is not null")
    # Only words in doubt are joined with their candidates, and only lines that hold one of them go on.
    hits = tokens.join(marked, "word").groupBy(*KEY).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", F.struct("options", "strange"))))).alias("hits"))
    one = lambda w: F.try_element_at("hits", w)
    line = F.transform("words", lambda w, k: F.struct(k.alias("k"), w.alias("word"), one(w)["options"].alias("options"), F.coalesce(one(w)["strange"], F.lit(False)).alias("strange")))
    lines = _words(_beside(lines, hits, "inner"), "hits").withColumn("line", line).drop("words", "hits")
    lines = materialize(lines)
    edge = F.flatten(F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: _edges(F.element_at("line", i), F.element_at("line", i + 1))))
    wanted = lines.where(F.size("line") > 1).select(F.explode(edge).alias("e")).select("e.a", "e.b").distinct()
    known = wanted.join(pairs, ["a", "b"]).join(words.select(F.col("word").alias("a"), F.col("clean").alias("left")), "a")
    spread = lines.where(F.size("line") > 1).select(*KEY, F.explode(F.array_distinct(edge)).alias("e")).select(*KEY, "e.a", "e.b")
    of_line = spread.join(known, ["a", "b"]).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "n", "left")).alias("pairs"))
    return _choose(_beside(lines, of_line).select(*KEY, "kind", "b", "line", "pairs"))


def _beside(lines: DataFrame, more: DataFrame, how: str = "left") -> DataFrame:
    """``lines`` with the columns of ``more`` for the same line, null (or, ``inner``, left out) where there is none."""
    more = more.withColumnsRenamed({c: f"_{c}" for c in KEY})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    return lines.join(more, same, how).drop(*[f"_{c}" for c in KEY])


def _by(*cols: str) -> Any:
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _edges(x: Any, y: Any) -> Any:
    """Pairs of neighbouring words that may follow each other, where either is in doubt."""
    forms = lambda t: F.concat(F.array(t["word"]), F.transform(F.coalesce(t["options"], F.array().cast("array<struct<cost:double,cand:string>>")), lambda o: o["cand"]))
    both = F.flatten(F.transform(forms(x), lambda a: F.transform(forms(y), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.when(x["options"].isNotNull() | y["options"].isNotNull(), both).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def _choose(lines: DataFrame) -> DataFrame:
    out = "file_id bigint, obj_pos int, section string, para_pos int, line_no int, kind string, b string, fixes array<struct<k:int,word:string,printed:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix_type = pa.list_(pa.struct([("k", pa.int32()), ("word", pa.string()), ("printed", pa.string())]))
        for batch in batches:
            fixes = []
            for row in batch.select(["line", "pairs"]).to_pylist():
                # An unknown sound word: less likely the longer it is, as no letter of it is known.
                states = [[(t["word"], 0.0 if not t["options"] else -8.0 - 2.5 * len(t["word"]))] + [(o["cand"], -o["cost"]) for o in t["options"] or ()] for t in row["line"]]
                pair = {(p["a"], p["b"]): math.log(1 + 50 * p["n"] / p["left"]) for p in row["pairs"] or ()}
                path = viterbi(states, pair, 0.0)
                fixes.append([{"k": t["k"], "word": t["word"], "printed": states[i][at][0] if at else None} for i, (t, at) in enumerate(zip(row["line"], path)) if at or t["strange"]])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*KEY, "kind", "b")] + [pa.array(fixes, fix_type)], names=[*KEY, "kind", "b", "fixes"])

    return lines.mapInArrow(run, out)


def _is_own(fixes: Any, half: Any) -> Any:
    """Whether a line has a misread word of its own: the first may be misread in the half on the line before only."""
    cut = F.length(half)
    first = lambda f: (f["k"] == 0) & half.isNotNull()
    before = lambda f: F.substring(f["word"], 1, cut) == F.lower(half)
    tail = lambda f: F.when(f["printed"].isNull(), F.expr("false")).otherwise(F.endswith(f["printed"], F.substring(f["word"], cut + 1, F.length(f["word"]))))
    return F.exists(fixes, lambda f: ~(first(f) & before(f) & tail(f)))


def found(files: DataFrame) -> DataFrame:
    """p2_found: every flawed line of the scanned paragraphs with its kind.

    A ruling is a scan if any paragraph of the stated sections has several lines; a paragraph of one line can be misread
    only. Null, empty and non-text paragraphs, null and unreadable payloads give no rows; blank lines are no cases; a file
    counts once however often it came; lines and paragraphs of any length are read whole; empty input gives no rows;
    other columns of ``files`` are ignored, whatever their names.
    """
    parts = materialize(_parts(files, every_line=False), "tag")
    formal = parts.where("tag = 'line' and kind <> ''").select(*KEY, "kind")
    misread = decode(parts.where("tag <> 'line' or kind = ''")).where(_is_own(F.col("fixes"), F.col("b"))).select(*KEY, F.lit("misread").alias("kind"))
    return formal.unionByName(misread)


def repair(files: DataFrame) -> DataFrame:
    """(file_id, obj_pos, section, para_pos, text): the scanned paragraphs as continuous text of their own words.

    Headers, footers and page numbers go, divided words are joined, misread words are replaced by the decoded ones in
    the case they were typed in. Null, empty and blank paragraphs, unreadable payloads and rulings that are no scans
    give no rows; a file counts once; equal rows stay equal; other columns of ``files`` are ignored.
    """
    parts = materialize(_parts(files, every_line=True), "tag")
    fixes = decode(parts).select(*KEY, "fixes")
    lines = parts.where("tag = 'line' and kind not in ('header', 'pageno') and a is not null").select(*KEY, "kind", "a", "b")
    paragraphs = _beside(lines, fixes).groupBy(*KEY[:-1]).agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "a", "b", "fixes"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [continuous(p) for p in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in KEY[:-1]] + [pa.array(texts, pa.string())], names=[*KEY[:-1], "text"])

    return paragraphs.mapInArrow(run, "file_id bigint, obj_pos int, section string, para_pos int, text string")


def continuous(lines: list[dict[str, Any]]) -> str:
    """The words of a paragraph's lines in one line, with their fixes."""
    out: list[str] = []
    for line in lines:
        words = ((line["b"] or "") + line["a"]).split()
        if line["kind"] == "hyphen":
            words = words[:-1]
        fixes = {f["k"]: f["printed"] for f in line["fixes"] or () if f["printed"]}
        k = 0
        for word in words:
            core = word.strip(_EDGE)
            if core:
                if k in fixes:
                    word = word.replace(core, _cased(fixes[k], core))
                k += 1
            out.append(word)
    return " ".join(out)


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word
