"""JSON functions with MySQL results. JSON is text; documents are read and changed in Arrow batches, where Spark has no function for it.

An argument that is SQL text becomes a JSON string; `document(c)` marks one that is JSON itself.
"""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

class _NOTHING:
    """Stands for what isn't there, as JSON null is a value; a class, so that it is the same one in every process."""


def _sorted(x):
    """Keys by length, then bytes."""
    if isinstance(x, dict):
        return {k: _sorted(x[k]) for k in sorted(x, key=lambda k: (len(k.encode()), k.encode()))}
    return [_sorted(v) for v in x] if isinstance(x, list) else x


def parse(text: str):
    return _json.loads(text)


def dump(x) -> str:
    return _json.dumps(_sorted(x), ensure_ascii=False)


_LEG = re.compile(r'\s*(?:\.\s*(?:(\*)|"((?:[^"\\]|\\.)*)"|([A-Za-z_$\u0080-￿][\w$\u0080-￿]*))|\[\s*(?:(\*)|(last)(?:\s*-\s*(\d+))?(?:\s+to\s+(?:(last)(?:\s*-\s*(\d+))?|(\d+)))?|(\d+)(?:\s+to\s+(?:(last)(?:\s*-\s*(\d+))?|(\d+)))?)\s*\]|(\*\*))')


def legs(path: str) -> list[tuple]:
    """The legs of a path: ('key', k), ('keys',), ('cell', place), ('range', a, b), ('cells',), ('deep',); a place is (from the end, n)."""
    path = path.strip()
    if not path.startswith("$"):
        raise ValueError(f"3143: Invalid JSON path expression: {path}")
    at, out = 1, []
    while at < len(path):
        m = _LEG.match(path, at)
        if m is None:
            raise ValueError(f"3143: Invalid JSON path expression: {path}")
        g = m.groups()
        if g[0]:
            out.append(("keys",))
        elif g[1] is not None or g[2] is not None:
            out.append(("key", _json.loads(f'"{g[1]}"') if g[1] is not None else g[2]))
        elif g[3]:
            out.append(("cells",))
        elif g[13]:
            out.append(("deep",))
        else:
            a = (True, int(g[5] or 0)) if g[4] else (False, int(g[9]))
            end = (g[6], g[7], g[8]) if g[4] else (g[10], g[11], g[12])
            b = (True, int(end[1] or 0)) if end[0] else (False, int(end[2])) if end[2] else None
            out.append(("cell", a) if b is None else ("range", a, b))
        at = m.end()
    return out


def wild(path: list[tuple]) -> bool:
    return any(x[0] in ("keys", "cells", "deep", "range") for x in path)


def _place(p, n: int) -> int:
    return n - 1 - p[1] if p[0] else p[1]


def find(doc, path: list[tuple]) -> list:
    """The values at a path; a value that isn't an array is its own first cell."""
    return [v for v, _ in walk(doc, path)]


def walk(doc, path: list[tuple], trail: tuple = ()):
    """(value, trail of keys and cells) at a path."""
    if not path:
        yield doc, trail
        return
    head, rest = path[0], path[1:]
    kind = head[0]
    if kind == "key":
        if isinstance(doc, dict) and head[1] in doc:
            yield from walk(doc[head[1]], rest, (*trail, head[1]))
    elif kind == "keys":
        if isinstance(doc, dict):
            for k, v in _sorted(doc).items():
                yield from walk(v, rest, (*trail, k))
    elif kind == "deep":
        yield from walk(doc, rest, trail)
        for k, v in doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ():
            yield from walk(v, path, (*trail, k))
    elif isinstance(doc, list):
        n = len(doc)
        if kind == "cells":
            some = range(n)
        elif kind == "cell":
            some = [_place(head[1], n)]
        else:
            some = range(max(0, _place(head[1], n)), min(n - 1, _place(head[2], n)) + 1)
        for i in some:
            if 0 <= i < n:
                yield from walk(doc[i], rest, (*trail, i))
    elif kind == "cell" and _place(head[1], 1) == 0 or kind == "range" and _place(head[1], 1) <= 0 <= _place(head[2], 1):
        yield from walk(doc, rest, trail)


def extract(doc, *paths: str):
    several, found = len(paths) > 1, []
    for p in paths:
        p = legs(p)
        several = several or wild(p)
        found += find(doc, p)
    return (found if several else found[0]) if found else _NOTHING


def put(doc, path: str, value, there: bool, absent: bool):
    """JSON_SET (both), JSON_REPLACE (there) and JSON_INSERT (absent)."""
    steps = legs(path)
    if wild(steps):
        raise ValueError("3149: In this situation, path expressions may not contain the * and ** tokens or an array range.")
    if not steps:
        return value if there else doc

    def at(node, k: int):
        kind, last = steps[k], k == len(steps) - 1
        if kind[0] == "key":
            if not isinstance(node, dict):
                return node
            if kind[1] in node:
                if not last:
                    return {**node, kind[1]: at(node[kind[1]], k + 1)}
                return {**node, kind[1]: value} if there else node
            return {**node, kind[1]: value} if last and absent else node
        cells = node if isinstance(node, list) else [node]
        i = _place(kind[1], len(cells))
        if 0 <= i < len(cells):
            new = at(cells[i], k + 1) if not last else value if there else cells[i]
            if not isinstance(node, list):
                return new
            return [*cells[:i], new, *cells[i + 1 :]]
        if not last or not absent:
            return node
        return [*cells, value] if i >= len(cells) else [value, *cells]

    return at(doc, 0)


def _change(doc, trail: tuple, change):
    """doc with change(parent, last key or cell) applied."""
    if len(trail) == 1:
        return change(doc, trail[0])
    new = doc.copy()
    new[trail[0]] = _change(doc[trail[0]], trail[1:], change)
    return new


def remove(doc, *paths: str):
    for p in paths:
        if not legs(p):
            raise ValueError("3153: The path expression '$' is not allowed in this context.")
        for _, trail in list(walk(doc, legs(p)))[:1]:
            if trail:
                doc = _change(doc, trail, lambda parent, k: {a: b for a, b in parent.items() if a != k} if isinstance(parent, dict) else parent[:k] + parent[k + 1 :])
    return doc


def array_append(doc, path: str, value):
    for old, trail in list(walk(doc, legs(path)))[:1]:
        new = [*old, value] if isinstance(old, list) else [old, value]
        doc = _change(doc, trail, lambda parent, k: _with(parent, k, new)) if trail else new  # noqa: B023
    return doc


def _with(parent, k, new):
    out = parent.copy()
    out[k] = new
    return out


def array_insert(doc, path: str, value):
    """Into the array before the path's cell; behind its end, at the end."""
    steps = legs(path)
    if not steps or steps[-1][0] != "cell":
        raise ValueError("3165: A path expression is not a path to a cell in an array.")
    for old, trail in list(walk(doc, steps[:-1]))[:1]:
        if isinstance(old, list):
            i = max(0, min(len(old), _place(steps[-1][1], len(old))))
            new = [*old[:i], value, *old[i:]]
            doc = _change(doc, trail, lambda parent, k: _with(parent, k, new)) if trail else new  # noqa: B023
    return doc


def merge_preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: merge_preserve(a[k], v) if k in a else v for k, v in b.items()}}
    return [*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])]


def merge_patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def contains(doc, candidate) -> bool:
    if isinstance(doc, list):
        if isinstance(candidate, list):
            return all(any(contains(x, c) for x in doc) for c in candidate)
        return any(contains(x, candidate) if isinstance(x, (list, dict)) == isinstance(candidate, (list, dict)) else _same(x, candidate) for x in doc)
    if isinstance(doc, dict):
        return isinstance(candidate, dict) and all(k in doc and contains(doc[k], v) for k, v in candidate.items())
    return not isinstance(candidate, (list, dict)) and _same(doc, candidate)


def overlaps(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return any(k in b and _same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) or isinstance(b, list):
        return any(_same(x, y) for x in (a if isinstance(a, list) else [a]) for y in (b if isinstance(b, list) else [b]))
    return _same(a, b)


def depth(x) -> int:
    inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return 1 + max(map(depth, inner), default=0)


def kind(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, int) and not isinstance(x, bool):
        return "INTEGER" if x < 1 << 63 else "UNSIGNED INTEGER"
    return {bool: "BOOLEAN", float: "DOUBLE", str: "STRING", list: "ARRAY", dict: "OBJECT"}[type(x)]


def _trail(trail: tuple) -> str:
    step = lambda k: f"[{k}]" if isinstance(k, int) else f".{k}" if re.fullmatch(r"[A-Za-z_$][\w$]*", k) else f".{_json.dumps(k, ensure_ascii=False)}"
    return "$" + "".join(map(step, trail))


def search(doc, every: bool, pattern: str, escape: str = "\\", *paths: str):
    """Paths of strings that are LIKE the pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    like, found = re.compile(out, re.S), []
    for p in paths or ("$",):
        for v, trail in walk(doc, [*legs(p), ("deep",)]):
            if isinstance(v, str) and like.fullmatch(v) and _trail(trail) not in found:
                found.append(_trail(trail))
    if not found:
        return _NOTHING
    return found[0] if not every or len(found) == 1 else found


def pretty(x) -> str:
    return _json.dumps(_sorted(x), ensure_ascii=False, indent=2)


def schema_errors(schema, x, where: str = "#") -> list[str]:
    """Violations of a JSON schema: type, enum, required, properties, items, bounds, lengths, pattern."""
    if not isinstance(schema, dict):
        return []
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def is_a(t: str) -> bool:
        if t == "number":
            return isinstance(x, (int, float)) and not isinstance(x, bool)
        if t == "integer":
            return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
        return isinstance(x, kinds[t])

    out = []
    t = schema.get("type")
    if t is not None and not any(map(is_a, t if isinstance(t, list) else [t])):
        out.append(f"{where}: type")
    if "enum" in schema and not any(_same(x, e) for e in schema["enum"]):
        out.append(f"{where}: enum")
    if isinstance(x, dict):
        out += [f"{where}: required" for k in schema.get("required", ()) if k not in x]
        for k, s in schema.get("properties", {}).items():
            if k in x:
                out += schema_errors(s, x[k], f"{where}/{k}")
    if isinstance(x, list):
        for i, v in enumerate(x):
            out += schema_errors(schema.get("items", {}), v, f"{where}/{i}")
        if len(x) < schema.get("minItems", 0) or len(x) > schema.get("maxItems", len(x)):
            out.append(f"{where}: items")
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        if x < schema.get("minimum", x) or x > schema.get("maximum", x):
            out.append(f"{where}: bounds")
    if isinstance(x, str):
        if len(x) < schema.get("minLength", 0) or len(x) > schema.get("maxLength", len(x)):
            out.append(f"{where}: length")
        if "pattern" in schema and not re.search(schema["pattern"], x):
            out.append(f"{where}: pattern")
    return out


# Columns
class Document:
    def __init__(self, c):
        self.c = c if isinstance(c, Column) else F.lit(c)


def document(c) -> Document:
    """Marks an argument that is JSON text, not a string value."""
    return Document(c)


def _applied(f, doc, *args, kind: str = "string") -> Column:
    """f(document, *arguments) row by row in Arrow batches; a NULL document gives NULL; arguments are constants, Columns or documents."""
    columns, plan = [doc.c if isinstance(doc, Document) else doc], []
    for a in args:
        if isinstance(a, (Document, Column)):
            plan.append((len(columns), isinstance(a, Document)))
            columns.append(a.c if isinstance(a, Document) else a)
        else:
            plan.append((None, a))

    @F.pandas_udf(kind)
    def run(*batch: pd.Series) -> pd.Series:
        out = []
        for row in zip(*(b.tolist() for b in batch)):
            if row[0] is None:
                out.append(None)
                continue
            own = []
            for at, x in plan:
                v = x if at is None else row[at]
                v = None if at is not None and not isinstance(v, str) and pd.isna(v) else v
                own.append(parse(v) if at is not None and x and v is not None else v)
            value = f(parse(row[0]), *own)
            out.append(None if value is _NOTHING else value)
        return pd.Series(out, dtype=object)

    return run(*columns)


def _text(f):
    def run(*a):
        v = f(*a)
        return v if v is _NOTHING else dump(v)

    return run


def json_extract(c, *paths: str) -> Column:
    return _applied(_text(extract), c, *paths)


def json_value(c: Column, path: str) -> Column:
    """A scalar as text; NULL for JSON null and for what isn't there."""
    return F.get_json_object(c, path)


def json_unquote(c: Column) -> Column:
    """The string of a JSON string; other text as it is."""
    return F.when(c.rlike(r'(?s)^".*"$'), F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]")).otherwise(c)


def json_quote(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.when(c.isNotNull(), text.substr(F.lit(2), F.length(text) - 2))


def _pairs(*args):
    return list(zip(args[::2], args[1::2]))


def _all(change):
    def run(doc, *args):
        for path, value in _pairs(*args):
            doc = change(doc, path, value)
        return doc

    return _text(run)


def json_set(c, *args) -> Column:
    return _applied(_all(lambda d, p, v: put(d, p, v, True, True)), c, *args)


def json_insert(c, *args) -> Column:
    return _applied(_all(lambda d, p, v: put(d, p, v, False, True)), c, *args)


def json_replace(c, *args) -> Column:
    return _applied(_all(lambda d, p, v: put(d, p, v, True, False)), c, *args)


def json_remove(c, *paths: str) -> Column:
    return _applied(_text(remove), c, *paths)


def json_array_append(c, *args) -> Column:
    return _applied(_all(array_append), c, *args)


def json_array_insert(c, *args) -> Column:
    return _applied(_all(array_insert), c, *args)


def json_merge_preserve(c, *others) -> Column:
    def run(doc, *more):
        for x in more:
            doc = merge_preserve(doc, x)
        return doc

    return _applied(_text(run), c, *(document(x) for x in others))


def json_merge_patch(c, *others) -> Column:
    def run(doc, *more):
        for x in more:
            doc = merge_patch(doc, x)
        return doc

    return _applied(_text(run), c, *(document(x) for x in others))


def json_contains(c, candidate, path: str = "$") -> Column:
    """1, 0, or NULL if there is nothing at the path."""
    def run(doc, x):
        found = find(doc, legs(path))
        return int(contains(found[0], x)) if found else _NOTHING

    return _applied(run, c, document(candidate), kind="int")


def json_contains_path(c, every: bool, *paths: str) -> Column:
    return _applied(lambda d: int((all if every else any)(bool(find(d, legs(p))) for p in paths)), c, kind="int")


def json_overlaps(a, b) -> Column:
    return _applied(lambda x, y: int(overlaps(x, y)), a, document(b), kind="int")


def member_of(value, c) -> Column:
    """value MEMBER OF(c); value is a constant, a Column or a document."""
    return _applied(lambda d, v: int(any(_same(x, v) for x in (d if isinstance(d, list) else [d]))), c, value, kind="int")


def json_search(c, every: bool, pattern: str, escape: str = "\\", *paths: str) -> Column:
    return _applied(_text(lambda d: search(d, every, pattern, escape, *paths)), c)


def json_keys(c, path: str = "$") -> Column:
    """NULL where there is no object."""
    def run(d):
        found = find(d, legs(path))
        return list(_sorted(found[0])) if found and isinstance(found[0], dict) else _NOTHING

    return _applied(_text(run), c)


def json_length(c, path: str = "$") -> Column:
    def run(d):
        found = find(d, legs(path))
        return (len(found[0]) if isinstance(found[0], (dict, list)) else 1) if found else _NOTHING

    return _applied(run, c, kind="int")


def json_type(c) -> Column:
    return _applied(kind, c)


def json_depth(c) -> Column:
    return _applied(depth, c, kind="int")


def json_pretty(c) -> Column:
    return _applied(pretty, c)


def json_valid(c: Column) -> Column:
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull().cast("int"))


def json_storage_size(c) -> Column:
    """Bytes of the text: there is no binary form here."""
    return _applied(lambda d: len(dump(d).encode()), c, kind="int")


def json_storage_free(c: Column) -> Column:
    return F.when(c.isNotNull(), 0)


def json_schema_valid(schema: str, c) -> Column:
    s = parse(schema)
    return _applied(lambda d: int(not schema_errors(s, d)), c, kind="int")


def json_schema_validation_report(schema: str, c) -> Column:
    s = parse(schema)

    def run(d):
        wrong = schema_errors(s, d)
        return {"valid": not wrong} if not wrong else {"valid": False, "reason": wrong[0]}

    return _applied(_text(run), c)


def json_array(*args: Column) -> Column:
    """NULLs become JSON nulls; elements are parted by a comma and a blank."""
    one = lambda a: F.coalesce(F.regexp_extract(F.to_json(F.array(a)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    return F.concat(F.lit("["), F.concat_ws(", ", *map(one, args)), F.lit("]"))


def json_object(**args: Column) -> Column:
    one = lambda a: F.coalesce(F.regexp_extract(F.to_json(F.array(a)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    keys = sorted(args, key=lambda k: (len(k.encode()), k.encode()))
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(_json.dumps(k, ensure_ascii=False) + ": "), one(args[k])) for k in keys)), F.lit("}"))


def json_table(df, c: Column, rows: str, columns: dict[str, tuple[str, str]], ordinality: str | None = None):
    """JSON_TABLE as a lateral join: a row per value at `rows` ('$' or '$[*]'), `columns` is name -> (path, type); missing values are NULL."""
    one = F.array(c) if rows == "$" else F.transform(F.from_json(c, "array<variant>"), lambda v: F.to_json(v))
    out = df.select("*", F.posexplode(one).alias("__n", "__v"))
    if ordinality:
        out = out.withColumn(ordinality, F.col("__n") + 1)
    for name, (path, kind_) in columns.items():
        out = out.withColumn(name, F.get_json_object("__v", path).try_cast(kind_))
    return out.drop("__n", "__v")


def _unquote(text: str) -> str:
    return parse(text) if len(text) > 1 and text[0] == text[-1] == '"' else text


#: Functions for SQL text: what they do with a document and further values, their type, and which further values are documents.
_NAMED = {
    "json_extract": (_text(extract), "string", ()), "json_set": (_all(lambda d, p, v: put(d, p, v, True, True)), "string", ()), "json_insert": (_all(lambda d, p, v: put(d, p, v, False, True)), "string", ()), "json_replace": (_all(lambda d, p, v: put(d, p, v, True, False)), "string", ()),
    "json_remove": (_text(remove), "string", ()), "json_array_append": (_all(array_append), "string", ()), "json_array_insert": (_all(array_insert), "string", ()), "json_merge_patch": (_text(merge_patch), "string", (1,)), "json_merge_preserve": (_text(merge_preserve), "string", (1,)), "json_merge": (_text(merge_preserve), "string", (1,)),
    "json_contains": (lambda d, c, p="$": (lambda found: int(contains(found[0], c)) if found else _NOTHING)(find(d, legs(p))), "int", (1,)), "json_contains_path": (lambda d, how, *ps: int((all if how.lower() == "all" else any)(bool(find(d, legs(p))) for p in ps)), "int", ()), "json_overlaps": (lambda a, b: int(overlaps(a, b)), "int", (1,)),
    "json_search": (_text(lambda d, how, text, escape=None, *ps: search(d, how.lower() == "all", text, escape or "\\", *ps)), "string", ()), "json_keys": (_text(lambda d, p="$": (lambda found: list(_sorted(found[0])) if found and isinstance(found[0], dict) else _NOTHING)(find(d, legs(p)))), "string", ()),
    "json_length": (lambda d, p="$": (lambda found: (len(found[0]) if isinstance(found[0], (dict, list)) else 1) if found else _NOTHING)(find(d, legs(p))), "int", ()), "json_type": (kind, "string", ()), "json_depth": (depth, "int", ()), "json_pretty": (pretty, "string", ()), "json_storage_size": (lambda d: len(dump(d).encode()), "int", ()),
    "json_schema_valid": (lambda s, d: int(not schema_errors(s, d)), "int", (1,)),
}


def register(spark) -> None:
    """Makes the functions known to SQL text in a session; numbers, strings and NULLs are values, as in `_applied`."""
    def made(f, documents, type_):
        @F.pandas_udf(type_)
        def run(*batch: pd.Series) -> pd.Series:
            out = []
            for row in zip(*(b.tolist() for b in batch)):
                row = [None if v is None or not isinstance(v, str) and pd.isna(v) else v for v in row]
                if row[0] is None:
                    out.append(None)
                    continue
                value = f(parse(row[0]), *(parse(v) if i in documents and v is not None else v for i, v in enumerate(row[1:], 1)))
                out.append(None if value is _NOTHING else value)
            return pd.Series(out, dtype=object)

        return run

    for name, (f, type_, documents) in _NAMED.items():
        spark.udf.register(name, made(f, documents, type_))

    @F.pandas_udf("string")
    def json_unquote_text(c: pd.Series) -> pd.Series:
        return c.map(lambda v: None if v is None else _unquote(v))

    spark.udf.register("json_unquote", json_unquote_text)
