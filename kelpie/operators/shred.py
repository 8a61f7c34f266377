"""Nested documents into flat tables, by columnar shredding.

A batch of documents is shredded leaf path by leaf path: every leaf path becomes a column of the values that are there, with
a repetition level (the depth of the innermost list that goes on) and a definition level for every entry (how many of the
repeated ancestors and optional steps of its path are there). Repetition levels come from the list lengths by array
arithmetic, so only what exists is visited. The table of a repeated ancestor is then put together from the leaf columns
directly below it: an entry whose definition level reaches the ancestor is a row, the running count of entries that open a
new parent is the link to the parent's row, and an entry at its path's highest level takes the next value.

Lists and keyed objects are both repetitions: a keyed object's key becomes the leaf `key` of its item. Field names compare
without case, `_`, `-` and blanks; names of items (nodes, columns, handles, labels) are data and stay as they are."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

Path = tuple[str, ...]


@dataclass
class Repeated:
    """A repeated part of a document. Paths are field names in their plain form (see `plain`), tried in this order.

    at: paths from the parent to the list or keyed object that holds the items; a name that ends in `[]` must be a list, and
    the empty path is the parent itself, names as they are.
    key: the field that names an item held in a list (a keyed object's key takes its place).
    leaves: leaf name -> (kind of value, its paths from the item; the empty one is the item itself).
    parts: the repetitions within an item; `recurse`, paths of more items of this kind under an item, to any depth."""

    name: str
    at: tuple[Path, ...]
    key: str | None = None
    leaves: dict[str, tuple[str, tuple[Path, ...]]] = field(default_factory=dict)
    parts: list[Repeated] = field(default_factory=list)
    recurse: tuple[Path, ...] = ()
    values_only: bool = False


@dataclass
class Leaf:
    """A shredded column of one leaf path: levels of every entry, in document order, and the values of those at level `top`."""

    rep: np.ndarray
    dfn: np.ndarray
    values: list
    top: int


_NAMES: dict[str, str] = {}


def plain(name: str) -> str:
    """A field name without case, `_`, `-` and blanks."""
    got = _NAMES.get(name)
    if got is None:
        if len(_NAMES) > 20_000:  # field names are few; whatever else came here is let go
            _NAMES.clear()
        got = _NAMES[name] = name.replace("_", "").replace("-", "").replace(" ", "").lower()
    return got


def fields(x: dict) -> dict:
    """The fields of an object that are not null, by plain name; of two spellings of one name the first counts."""
    out: dict = {}
    for k, v in x.items():
        if v is not None:
            out.setdefault(_NAMES.get(k) or plain(k), v)
    return out


def reach(view, path: Path) -> tuple[int, object]:
    """How many steps of the path are there from an item in plain form, and what lies at its end (None if it breaks off)."""
    at = view
    for i, step in enumerate(path):
        if not isinstance(at, dict):
            return i, None
        at = (at if not i else fields(at)).get(step.removesuffix("[]"))
        if at is None or (step.endswith("[]") and not isinstance(at, list)):
            return i, None
    return len(path), at


def _held(raw, view, paths: tuple[Path, ...]):
    """The first list or keyed object at one of these paths."""
    for p in paths:
        got = reach(view, p)[1] if p else raw
        if isinstance(got, (dict, list)):
            return got
    return None


def _items(held, key: str | None, values_only: bool) -> list[tuple]:
    """(key, item, place, item in plain form) of every item that is there; the place counts all entries of the list."""
    if isinstance(held, dict):
        got = [(k, v, i) for i, (k, v) in enumerate(held.items()) if v is not None]
    elif isinstance(held, list):
        got = [(None, v, i) for i, v in enumerate(held) if v is not None]
    else:
        return []
    if values_only:
        return [(k, v, i, v) for k, v, i in got if not isinstance(v, (dict, list))] if isinstance(held, dict) else []
    out = []
    for k, v, i in got:
        view = fields(v) if isinstance(v, dict) else v
        out.append((view.get(key) if k is None and key and isinstance(view, dict) else k, v, i, view))
    return out


def _expand(rep: np.ndarray, dfn: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels one repetition deeper. counts: for each entry at `level`-1 that is defined, how many items it holds."""
    live = dfn == level - 1
    each = np.zeros(len(rep), np.int64)
    each[live] = counts
    wide = np.maximum(each, 1)
    ends = np.cumsum(wide)
    out_rep = np.full(int(ends[-1]) if len(ends) else 0, level, rep.dtype)
    out_rep[ends - wide] = rep
    return out_rep, np.repeat(np.where(each > 0, level, dfn), wide)


def shred(values: list, spec: Repeated, want: set[str] | None = None) -> Iterator[tuple[tuple[str, ...], dict[str, list[Leaf]]]]:
    """Leaf columns of each repeated path, outermost first. values: one parsed document each (None: no document).

    want: names of the leaves to make (None: all); what is not wanted is not visited. `key` and `place` are always made."""
    rep, dfn = np.zeros(len(values), np.int16), np.zeros(len(values), np.int16)
    todo = [((), spec, values, [fields(v) if isinstance(v, dict) else v for v in values], rep, dfn, spec.at)]
    while todo:
        above, part, raws, views, rep, dfn, paths = todo.pop(0)
        level = len(above) + 1
        lists = [_items(_held(r, v, paths), part.key, part.values_only) if r is not None else () for r, v in zip(raws, views)]
        flat = [x for items in lists for x in items]
        if not flat:
            continue
        r, d = _expand(rep, dfn, np.fromiter(map(len, lists), np.int64, len(lists)), level)
        live = d == level
        path = (*above, part.name)
        leaves = {"key": [_leaf(r, d, live, level, [(x[0] is not None, x[0]) for x in flat], 1)], "place": [Leaf(r, d, [x[2] for x in flat], level)]}
        for name, (_, ways) in part.leaves.items():
            if want is None or name in want:
                leaves[name] = [_leaf(r, d, live, level, [reach(x[3], w) for x in flat], len(w)) for w in ways]
        yield path, leaves
        inner, plainly = [x[1] for x in flat], [x[3] for x in flat]
        todo += [(path, p, inner, plainly, r, d, p.at) for p in part.parts]
        if part.recurse:
            todo.append((path, part, inner, plainly, r, d, part.recurse))


def _leaf(rep: np.ndarray, dfn: np.ndarray, live: np.ndarray, level: int, found: list[tuple[int, object]], steps: int) -> Leaf:
    """The column of one leaf path: an item's definition level rises by one for each of the path's optional steps that is there."""
    own = dfn.copy()
    own[live] += np.fromiter((x[0] for x in found), np.int16, len(found))
    return Leaf(rep, own, [v for n, v in found if n == steps], level + steps)


def column(leaf: Leaf, level: int) -> list:
    """The values of a leaf path, one for each row of the repeated ancestor at `level` (None where the path breaks off)."""
    at = leaf.dfn[rows_of(leaf, level)] == leaf.top
    out = np.full(len(at), None, object)
    got = np.empty(len(leaf.values), object)
    got[:] = leaf.values
    out[at] = got
    return out.tolist()


def rows_of(leaf: Leaf, level: int) -> np.ndarray:
    """Which entries are items of the repeated ancestor at `level`."""
    return np.flatnonzero(leaf.dfn >= level)


def ordinal(leaf: Leaf, level: int) -> np.ndarray:
    """For each entry, the row of its ancestor at `level` (0: the document)."""
    return np.cumsum((leaf.rep <= level) & (leaf.dfn >= level)) - 1 if level else np.cumsum(leaf.rep == 0) - 1


def document(text: str | None):
    """The parsed document; a text that holds another text is parsed again. None unless it is complete."""
    try:
        got = json.loads(text) if text is not None else None
        while isinstance(got, str):
            got = json.loads(got)
    except (ValueError, RecursionError):
        return None
    return got


def _text(v):
    return v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)


def _number(v):
    if isinstance(v, str):
        try:
            return float(v)
        except ValueError:
            return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _numbers(v):
    return [float(x) for x in v if isinstance(x, (int, float)) and not isinstance(x, bool)] if isinstance(v, list) else []


_KINDS = {"text": _text, "number": _number, "numbers": _numbers}


def _one(kind: str, *names: str) -> tuple[str, tuple[Path, ...]]:
    return kind, tuple(tuple(n.split(".")) if n else () for n in names)


#: Where the documents of this store hold their parts, by plain field name.
_EDGE = {"source": _one("text", "source", "src"), "destination": _one("text", "destination", "dst", "target"), "position": _one("text", "position"), "output": _one("text", "output")}
_INNER_EDGES = Repeated("edge", (("internaledges",),), None, _EDGE)
_IO = Repeated("port", (("iomap",),), "name", {"direction": _one("text", "direction"), "node": _one("text", "internalnodeid"), "handle": _one("text", "internalhandle")})
NODES = Repeated("node", (("nodes",),), "id", {"class_type": _one("text", "classtype", "type"), "name": _one("text", "name"), "dtype": _one("text", "dtype"), "value": _one("text", "value"), "language": _one("text", "language"), "code": _one("text", "code")}, [_INNER_EDGES, _IO], recurse=(("children",),))
EDGES = Repeated("edge", (("edges",),), None, _EDGE)
_CATEGORY = Repeated("category", (("categories",), ("stats", "categories")), None, {"value": _one("text", "value"), "count": _one("number", "count")})
COLUMNS = Repeated("column", ((),), "name", {"inferred_type": _one("text", "inferredtype"), "null_count": _one("number", "nullcount"), "null_pct": _one("number", "nullpct"), "min": _one("number", "min", "stats.range.min"), "max": _one("number", "max", "stats.range.max")}, [_CATEGORY])
CLASSES = Repeated("class", (("classoccurences",),), "label", {"n": _one("number", "count", "")})
COMPONENTS = Repeated("component", (("pca", "components"), ("pca[]",)), None, {"ratio": _one("number", "ratio"), "loadings": _one("numbers", "loadings")})
SCALARS = Repeated("scalar", ((),), None, {"number": _one("number", "")}, values_only=True)

#: Which shapes a kind of text holds.
SHAPES = {"dag": [NODES, EDGES], "columns": [COLUMNS], "profile": [CLASSES, COMPONENTS, SCALARS]}


def tables(owners: list, values: list, spec: Repeated, want: set[str] | None = None) -> Iterator[tuple[str, dict[str, list]]]:
    """Flat rows of every repeated path of a batch: (kind, columns), with owner_id, parent (its path) and path.

    A node's path joins the keys of its groups and itself by `/`; an edge's is its group's path, `#` and its place; a port's its
    group's, `@` and its handle; a category's its column's, `#` and its place; a component's `#` and its place."""
    paths: dict[tuple, np.ndarray] = {}
    for path, leaves in shred(values, spec, want):
        kind, level, lead = path[-1], len(path), leaves["place"][0]
        at = rows_of(lead, level)
        doc = ordinal(lead, 0)[at]
        up = paths[path[:-1]][ordinal(lead, level - 1)[at]].tolist() if level > 1 else [""] * len(at)
        keys, places = column(leaves["key"][0], level), lead.values
        if kind == "node":
            own = [None if k is None else f"{u}/{k}" if u else str(k) for u, k in zip(up, keys)] if level > 1 else [None if k is None else str(k) for k in keys]
        elif kind == "port":
            own = [None if k is None else f"{u}@{k}" for u, k in zip(up, keys)]
        elif kind in ("edge", "category", "component"):
            own = [f"{u}#{i}" for u, i in zip(up, places)]
        else:
            own = [None if k is None else str(k) for k in keys]
        paths[path] = np.array(own, dtype=object)
        ids = [owners[i] for i in doc.tolist()]
        cols = {"owner_id": ids, "parent": up, "path": own, "place": places}
        for name, ways in leaves.items():
            if name not in ("key", "place"):
                cols[name] = _first([column(w, level) for w in ways], _KINDS[_kind_of(spec, kind, name)])
        yield kind, cols


def _kind_of(spec: Repeated, part: str, leaf: str) -> str:
    return spec.leaves[leaf][0] if spec.name == part else next(_kind_of(p, part, leaf) for p in spec.parts if part in _kinds(p))


def _first(ways: list[list], to) -> list:
    """For each row the first of these columns' values that is there, converted."""
    out = []
    for row in zip(*ways):
        v = next((x for x in row if x is not None), None)
        out.append(to(v))
    return out


_DOCS = 256  # documents parsed at a time; bounds the memory of a task whatever its batches hold


def _run(shapes: list[Repeated], kind: str | None, schema: pa.Schema, want: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _DOCS):
                part = b.slice(lo, _DOCS)
                owners, docs = part.column(0).to_pylist(), [document(t) for t in part.column(1).to_pylist()]
                for spec in shapes:
                    for what, cols in tables(owners, docs, spec, want):
                        if kind is not None and what != kind:
                            continue
                        cols["kind"] = [what] * len(cols["path"])
                        out = pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)
                        ok = out.column(schema.get_field_index("path")).is_valid()
                        yield out.filter(ok)

    return run


_TYPES = {"place": "int", "count": "double", "n": "double", "null_count": "double", "null_pct": "double", "min": "double", "max": "double", "ratio": "double", "loadings": "array<double>", "number": "double"}


def flatten(df, owner: str, text: str, shape: str, kind: str | None = None, leaves: list[str] | None = None):
    """The flat table of one kind of item held in the JSON column `text` (or, with kind None, of every kind's keys).

    Returns owner_id, kind, parent, path, place and the wanted leaves. shape: `dag`, `columns` or `profile`. Null, empty and
    incomplete texts and texts of another shape yield no rows; an item whose name is absent yields none, and neither do
    null entries of a list, though they count for the place of what follows. Repeated items all come out. Other columns of
    df are ignored."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = ["owner_id", "kind", "parent", "path", "place", *(leaves or [])]
    ddl = ", ".join(f"`{n}` {_TYPES.get(n, 'string')}" for n in names)
    specs = [s for s in SHAPES[shape] if kind is None or kind in _kinds(s)]
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    run = _run([_prune(s, kind) for s in specs], kind, arrow, set(leaves or []))
    return df.select(F.col(owner).alias("_o"), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).mapInArrow(run, schema)


def _kinds(s: Repeated) -> set[str]:
    return {s.name, *(k for p in s.parts for k in _kinds(p))}


def _prune(s: Repeated, kind: str | None) -> Repeated:
    """Without the parts that the wanted kind does not lie under."""
    return s if kind is None else Repeated(s.name, s.at, s.key, s.leaves, [p for p in s.parts if kind in _kinds(p)], s.recurse, s.values_only)
