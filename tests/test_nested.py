"""Nested payloads against a recursive function."""

import json
import random

from barlake.sources import nested
from barlake.sources.shared import shared_path


def keep(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))


def walk(item, fields=None, path=""):
    fields = fields or {}
    if isinstance(item, dict):
        own = {k: text(v) for k, v in item.items() if not isinstance(v, (dict, list))}
        flat = {**fields, **own}
        if own:
            yield path, flat
        for k, v in item.items():
            if isinstance(v, (dict, list)):
                yield from walk(v, flat, f"{path}/{k}")
    elif isinstance(item, list):
        if len(item) > 1 and all(isinstance(x, list) for x in item) and item[0] and all(isinstance(x, str) for x in item[0]):
            names = [n if item[0][: i + 1].count(n) == 1 else f"{n}_{item[0][: i + 1].count(n)}" for i, n in enumerate(item[0])]
            for i, r in enumerate(item[1:], 1):
                yield f"{path}/{i}", {**{k: v for k, v in fields.items() if k not in names}, **dict(zip(names, map(text, r), strict=False))}
        else:
            for i, x in enumerate(item):
                yield from walk(x, fields, f"{path}/{i}")


PAYLOADS = [
    {"data": [{"name": "a", "rows": [["Key", "Value", "Key"], ["1", 2, "x"], ["3"], [4, None, {"q": 1}, "over"]]}, {"name": None, "rows": []}]},
    {"house": "H", "n": 3, "schemes": [{"code": "7", "detail": {"status": "ok", "house": "inner", "deep": {"more": [{"v": True}, {"w": {"x": {"y": 1}}}]}}}, {"code": "8"}]},
    [["a", "b", "a", "a"], [1, 2, 3, 4], [5, 6, 7, 8]], [["only"]], [[1, 2], [3, 4]], [1, [2, [{"z": "é \" ü"}]]], {}, [], "text", 5, None, {"a": {}, "b": []}, {"name": "outer", "t": [["name", "k"], ["inner", "1"], ["inner2"]]},
]


def shapes(n):
    rnd = random.Random(5)

    def make(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.3:
            return rnd.choice(["s", 1, True, None, ""])
        if kind < 0.6:
            return {rnd.choice("abcdef"): make(depth - 1) for _ in range(rnd.randrange(4))}
        if kind < 0.75:
            return [[rnd.choice("xyz") for _ in range(3)], *([rnd.choice(["u", 1, None]) for _ in range(rnd.randrange(1, 5))] for _ in range(rnd.randrange(3)))]
        return [make(depth - 1) for _ in range(rnd.randrange(4))]

    return [make(6) for _ in range(n)]


def test_any_shape_equals_a_recursive_walk(spark):
    payloads = PAYLOADS + shapes(200)
    rows = [(i, json.dumps(p, ensure_ascii=False), "x") for i, p in enumerate(payloads)] + [(900, None, "x"), (901, "", "x"), (902, "{broken", "x")]
    got = sorted((r.id, r.path, sorted(r.fields.items(), key=str)) for r in nested.flatten(spark.createDataFrame(rows, "id long, body string, path string"), "body", keep).collect())
    want = sorted((i, path, sorted(f.items(), key=str)) for i, p in enumerate(payloads) for path, f in walk(p))
    assert got == want and len(want) > 100
    assert nested.flatten(spark.createDataFrame([], "id long, body string"), "body", keep).count() == 0
