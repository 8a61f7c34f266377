"""Document-style filters, projections and updates over a JSON column, compiled to Catalyst expressions (F, X).

A collection is a DataFrame with `id` and a JSON text column `data`. Paths are dotted. A text that is not JSON matches nothing."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doc(col: str) -> Column:
    return F.try_parse_json(F.col(col))


def json_path(path: str) -> str:
    """A variant path for a dotted name; numbers address list elements."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path.split("."))


def value(path: str, kind: str, col: str = "data") -> Column:
    """The value at a dotted path as a Spark type; null where it is absent or of another kind."""
    return F.try_variant_get(_doc(col), json_path(path), kind)


def exists(path: str, col: str = "data") -> Column:
    """whether the path is there; a JSON null counts as present."""
    return F.try_variant_get(_doc(col), json_path(path), "variant").isNotNull()


_COMPARE = {"$eq": "__eq__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
_REST = ("$ne", "$in", "$nin", "$exists", "$regex", "$options")


def _typed(path: str, v: Any, col: str) -> tuple[Column, Any]:
    if isinstance(v, bool):
        return value(path, "boolean", col), v
    if isinstance(v, (int, float)):
        return value(path, "double", col), float(v)
    if isinstance(v, str):
        return value(path, "string", col), v
    return F.to_json(value(path, "variant", col)), json.dumps(v, separators=(",", ":"))


def _one(path: str, op: str, v: Any, col: str, spec: dict) -> Column:
    is_id = path == "_id"
    if is_id and op not in ("$eq", "$ne", "$in", "$nin"):
        raise NotImplementedError(f"{op} on _id")
    if op in _COMPARE:
        if v is None and op == "$eq":
            return F.col("id").isNull() if is_id else F.is_variant_null(F.try_variant_get(_doc(col), json_path(path), "variant"))
        c, v = (F.col("id"), v) if is_id else _typed(path, v, col)
        return getattr(c, _COMPARE[op])(v)
    if op == "$ne":
        c, v = (F.col("id"), v) if is_id else _typed(path, v, col)
        return c != v
    if op in ("$in", "$nin"):
        if not v:
            return F.lit(op == "$nin")
        parts = [_one(path, "$eq", x, col, spec) for x in v]
        hit = parts[0]
        for p in parts[1:]:
            hit = hit | p
        return hit if op == "$in" else ~hit
    if op == "$exists":
        return exists(path, col) if v else ~exists(path, col)
    if op == "$regex":
        return value(path, "string", col).rlike(("(?i)" if "i" in spec.get("$options", "") else "") + v)
    raise NotImplementedError(f"unknown operator {op}")


def where(spec: dict, col: str = "data") -> Column:
    """F01..F10: a filter document as a Column. Its parts are joined by AND; an unknown operator is an error when the plan is built."""
    out = F.lit(True)
    for key, v in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [where(x, col) for x in v]
            both = parts[0] if parts else F.lit(key == "$and")
            for p in parts[1:]:
                both = (both & p) if key == "$and" else (both | p)
            out = out & (~both if key == "$nor" else both)
        elif key.startswith("$"):
            raise NotImplementedError(f"unknown operator {key}")
        elif isinstance(v, dict) and any(k.startswith("$") for k in v):
            for op, x in v.items():
                if op not in _COMPARE and op not in _REST:
                    raise NotImplementedError(f"unknown operator {op}")
                if op != "$options":
                    out = out & _one(key, op, x, col, v)
        else:
            out = out & _one(key, "$eq", v, col, {})
    return out


def find(df: DataFrame, spec: dict, sort: list[tuple[str, int]] | None = None, skip: int = 0, limit: int | None = None, col: str = "data") -> DataFrame:
    """Filtered documents, ordered by the text of their values (as the store does), with offset and limit."""
    out = df.where(where(spec, col))
    if sort:
        keys = [F.col("id") if p == "_id" else F.col(p) if p in df.columns else value(p, "string", col) for p, _ in sort]
        out = out.orderBy(*[F.asc_nulls_last(k) if way > 0 else F.desc_nulls_first(k) for k, (_, way) in zip(keys, sort)])
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def project(df: DataFrame, spec: dict[str, int], col: str = "data") -> DataFrame:
    """include some top-level keys, or exclude some; mixing the two is an error, but for `_id`."""
    ways = {bool(v) for k, v in spec.items() if k != "_id"}
    if len(ways) > 1:
        raise ValueError("a projection either includes or excludes")
    keys = [k for k in spec if k != "_id"]
    asked = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    doc = fields(col)
    kept = F.map_filter(doc, lambda k, _: F.array_contains(asked, k) if True in ways else ~F.array_contains(asked, k)) if ways else doc
    out = df.withColumn(col, F.to_json(kept))
    return out.drop("id") if spec.get("_id") == 0 else out


def fields(col: str = "data") -> Column:
    """The top-level keys of a document as map<string,variant>."""
    return F.try_variant_get(_doc(col), "$", "map<string,variant>")


def rebuild(paths: dict[str, Any]) -> dict:
    """{"a.b": 1, "a.c": 2} as {"a": {"b": 1, "c": 2}}; a path that runs through a value is an error."""
    out: dict = {}
    for path, v in paths.items():
        *above, last = path.split(".")
        at = out
        for k in above:
            at = at.setdefault(k, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path} runs through a value")
        if isinstance(at.get(last), dict):
            raise ValueError(f"{path} replaces an object")
        at[last] = v
    return out


def nest(columns: dict[str, Column]) -> Column:
    """A JSON text with each column at its dotted path; keys of an object are in order."""

    def tree(x) -> Column:
        return F.struct(*[tree(v).alias(k) for k, v in sorted(x.items())]) if isinstance(x, dict) else x

    return F.to_json(tree(rebuild(columns)), {"ignoreNullFields": "false"})


def _text(m: Column) -> Column:
    """The JSON text of a map of JSON texts, its keys in order."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(quoted(k), F.lit(":"), F.element_at(m, k))), ","), F.lit("}"))


def _at(m: Column, path: list[str], change, make: bool) -> Column:
    """m with `change`(object, key) applied at the path; objects on the way are made if they are not there (`make`)."""
    k = path[0]
    if len(path) == 1:
        return change(m, k)
    inner = F.transform_values(F.from_json(F.try_element_at(m, F.lit(k)), "map<string,variant>"), lambda _, v: F.to_json(v))
    new = F.map_concat(F.map_filter(m, lambda kk, _: kk != k), F.create_map(F.lit(k), _text(_at(F.coalesce(inner, F.create_map().cast("map<string,string>")), path[1:], change, make))))
    return new if make else F.when(inner.isNotNull(), new).otherwise(m)


def update(df: DataFrame, spec: dict, ops: dict, col: str = "data") -> DataFrame:
    """Apply `$set $unset $inc $push $pull $addToSet`, or a whole new document, to the matching rows.

    Keys are dotted paths; objects on the way are made where they are absent (but not to take something out). `$push` takes a
    value or {"$each": [...]}. Rows that don't match stay as they are; a rewritten object has its keys in order."""
    hit = F.coalesce(where(spec, col), F.lit(False))
    if not any(k.startswith("$") for k in ops):
        return df.withColumn(col, F.when(hit, F.lit(json.dumps(ops, sort_keys=True, separators=(",", ":")))).otherwise(F.col(col)))
    doc = F.transform_values(fields(col), lambda k, v: F.to_json(v))
    lit = lambda v: F.lit(json.dumps(v, separators=(",", ":")))

    def put(m: Column, k: str, v: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda kk, _: kk != k), F.create_map(F.lit(k), v))

    items = lambda m, k: F.coalesce(F.transform(F.from_json(F.try_element_at(m, F.lit(k)), "array<variant>"), lambda x: F.to_json(x)), F.array().cast("array<string>"))
    whole = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))

    def plus(v):
        kind = "bigint" if isinstance(v, int) else "double"
        return lambda m, k: put(m, k, (F.coalesce(F.try_element_at(m, F.lit(k)).cast(kind), F.lit(0).cast(kind)) + F.lit(v)).cast("string"))

    def push(v):
        new = v["$each"] if isinstance(v, dict) and "$each" in v else [v]
        return lambda m, k: put(m, k, whole(F.concat(items(m, k), F.array(*map(lit, new)))))

    changes = {
        "$set": lambda v: lambda m, k: put(m, k, lit(v)),
        "$unset": lambda v: lambda m, k: F.map_filter(m, lambda kk, _: kk != k),
        "$inc": plus,
        "$push": push,
        "$pull": lambda v: lambda m, k: put(m, k, whole(F.array_remove(items(m, k), json.dumps(v, separators=(",", ":"))))),
        "$addToSet": lambda v: lambda m, k: put(m, k, whole(F.array_union(items(m, k), F.array(lit(v))))),
    }
    out = df.withColumn("_doc", F.when(hit, doc))
    for op, args in ops.items():
        if op == "$setOnInsert":  # nothing is inserted here
            continue
        if op not in changes:
            raise NotImplementedError(f"unknown operator {op}")
        for path, v in args.items():  # one projection each: nested in one another they would take the analyser too long
            out = out.withColumn("_doc", _at(F.col("_doc"), path.split("."), changes[op](v), op not in ("$unset", "$pull")))
    return out.withColumn(col, F.when(F.col("_doc").isNotNull(), _text(F.col("_doc"))).otherwise(F.col(col))).drop("_doc")


def rule(clauses: dict, columns: list[str] | None = None) -> Column:
    """a rule `{operator: AND|OR, clauses: [{column, op, value}]}` as a Column; op is eq unless given."""
    parts = []
    for c in clauses["clauses"]:
        parts.append(rule(c) if "clauses" in c else clause(F.col(c["column"]), c.get("op", "eq"), c["value"]))
    both = parts[0]
    any_ = clauses.get("operator", "AND").upper() == "OR"
    for p in parts[1:]:
        both = (both | p) if any_ else (both & p)
    return both


def clause(c: Column, op: str, v: Any) -> Column:
    """One comparison of a rule."""
    if op in ("in", "not_in"):
        hit = c.isin(*v) if v else F.lit(False)
        return hit if op == "in" else ~hit
    if op == "between":
        return c.between(v[0], v[1])
    ops = {"eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v, "regex": lambda: c.rlike(v)}
    if op not in ops:
        raise NotImplementedError(f"unknown rule operator {op}")
    return ops[op]()
