"""Reading the delivered ruling files: one JSON payload per row, a lone ruling or a list of them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estrado.plans.repeats import REPEATED, split_repeats


#: Bytes below which a table of fewer files than cores is spread over the cores.
SMALL = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a folder. A small one of few files lies in few row groups, which one task each reads: its rows
    are dealt out to all cores. Others are read where they lie."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size, cores = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes(), spark.sparkContext.defaultParallelism
    if int(str(size)) < SMALL and len(table.inputFiles()) < cores:
        return table.repartition(cores)
    return table


def first_delivery(files: DataFrame, *keep: str, payload: str = "payload", file_id: str = "file_id", at: str = "recibido_at", most: int = REPEATED) -> DataFrame:
    """One row per file: (file_id, payload, *keep) of the earliest delivery that has a payload.

    The ids delivered more than once are counted first, from the id column alone. Files that came once are passed on
    where they lie; only the others, and rows without an id (told apart by their payload), are aggregated, which combines
    on the map side. Ties in time take the smallest payload hash; rows without a payload are dropped, as they hold no
    ruling. With more than ``most`` such ids all files are aggregated, with the same result.
    """
    cols = list(dict.fromkeys([payload, *keep]))
    once, more = split_repeats(files, file_id, most)
    out = ["file_id", *[F.col(f"_v.{'payload' if c == payload else c}") for c in cols]]

    def ready(rows: DataFrame) -> DataFrame:
        some = rows.where(F.col(payload).isNotNull() & (F.length(payload) > 0))
        key = F.when(F.col(file_id).isNull(), F.xxhash64(payload))
        values = F.struct(*[F.col(c).alias("payload" if c == payload else c) for c in cols])
        return some.select(F.col(file_id).alias("file_id"), key.alias("_k"), F.struct(F.col(at).alias("a"), F.xxhash64(payload).alias("h")).alias("_o"), values.alias("_v"))

    parts = [f(ready(rows)).select(*out) for f, rows in ((lambda r: r, once), (_earliest, more)) if rows is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_id", "_k").agg(F.min_by("_v", "_o").alias("_v"))


_TOKEN = re.compile(r'[ \t\r\n]*([\[\]{},:]|"(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+)', re.S)


def parse(text: str) -> Any:
    """The value of a JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """``parse`` with a stack of its own: open lists and objects, and the key a value is waited for."""
    root: list[Any] = []
    stack: list[tuple[Any, list[str]]] = [(root, [])]
    at, size, wants = 0, len(text.rstrip()), "value"
    while at < size:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at, token = m.end(), m[1]
        into, key = stack[-1]
        if token == ":" and wants == "colon":
            wants = "value"
        elif token == "," and wants == "end" and len(stack) > 1:
            wants = "key" if isinstance(into, dict) else "value"
        elif token in "]}" and len(stack) > 1 and (token == "}") == isinstance(into, dict) and (wants == "end" or not into and wants in ("key", "value") and not key):
            stack.pop()
            wants = "end"
        elif wants == "key" and token[0] == '"':
            key.append(json.loads(token))
            wants = "colon"
        elif wants == "value" and token not in ("]", "}", ",", ":"):
            new = [] if token == "[" else {} if token == "{" else json.loads(token)
            if isinstance(into, dict):
                into[key.pop()] = new
            else:
                into.append(new)
            wants = "end"
            if token in ("[", "{"):
                stack.append((new, []))
                wants = "key" if token == "{" else "value"
        else:
            raise ValueError("no JSON")
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("no JSON")
    return root[0]


def dumps(value: Any) -> str:
    """The JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[Any] = [(value, None)]
    while todo:
        node, literal = todo.pop()
        if literal is not None:
            out.append(literal)
        elif isinstance(node, dict):
            parts = [p for k, v in node.items() for p in ((None, ", "), (None, f"{json.dumps(k, ensure_ascii=False)}: "), (v, None))][1:]
            todo += [(None, "}"), *reversed(parts), (None, "{")]
        elif isinstance(node, list):
            parts = [p for v in node for p in ((None, ", "), (v, None))][1:]
            todo += [(None, "]"), *reversed(parts), (None, "[")]
        else:
            out.append(json.dumps(node, ensure_ascii=False))
    return "".join(out)


def iter_rulings(payload: str | None) -> Iterator[tuple[int, dict[str, Any]]]:
    """(place in the payload, ruling) of every ruling object; nothing for an unreadable payload."""
    try:
        root = parse(payload)
    except (ValueError, TypeError):
        return
    if isinstance(root, dict):
        yield 0, root
    elif isinstance(root, list):
        for pos, item in enumerate(root):
            if isinstance(item, dict):
                yield pos, item
