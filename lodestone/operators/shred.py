"""Deeply nested records as related flat tables, by columnar shredding.

Every leaf of a record is written as a column of (repetition level, definition level, value): the
repetition level says which repeated field has just repeated, the definition level how much of the path
is present. A repeated field adds two levels, one for the entry and one for its not being null, so null
elements keep their position. The table of a repeated ancestor is then read off the level sequences of
its leaves: positions are running counts of repetition levels, and rows exist where the definition
level reaches the ancestor.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Group:
    """A (repeated) group: its scalar leaves and its repeated groups by name. ``lone`` names the leaf
    that a bare value stands for."""

    def __init__(self, leaves: tuple[str, ...], groups: dict[str, Group] | None = None, lone: str = "name"):
        self.leaves, self.groups, self.lone = leaves, groups or {}, lone


_ARGS = Group(("name", "type_annotation", "default"))
_FUNCTIONS = Group(("name", "docstring", "returns", "anchor.line", "end_line"), {"args": _ARGS})
_CLASSES = Group(("name", "docstring", "anchor.line", "end_line"), {"methods": _FUNCTIONS})
MODULE = Group(("path", "language", "docstring", "total_lines"), {"functions": _FUNCTIONS, "classes": _CLASSES})


def as_list(value):
    """A list as stored; a lone value is a list of one; a list stored as text is that list."""
    if value is None or isinstance(value, list):
        return value
    if isinstance(value, str) and value.lstrip()[:1] == "[":
        try:
            inner = json.loads(value)
            if isinstance(inner, list):
                return inner
        except ValueError:
            pass
    if isinstance(value, str) and not value.strip():
        return None
    return [value]


def _leaf(record, name: str):
    for part in name.split("."):
        if not isinstance(record, dict):
            return None
        record = record.get(part)
    return record


class Columns:
    """Level sequences and values of all leaves under a group, record after record."""

    def __init__(self, root: Group):
        self.root = root
        self.data: dict[tuple[str, ...], tuple[list, list, list]] = {}
        self._declare(root, ())

    def _declare(self, group, path):
        for leaf in group.leaves:
            self.data[(*path, leaf)] = ([], [], [])
        for name, sub in group.groups.items():
            self._declare(sub, (*path, name))

    def add(self, record: dict) -> None:
        self._write(self.root, (), record, 0, 0)

    def _write(self, group, path, record, rep, depth):
        """``depth`` repeated fields lie above; all of them are present (definition 2 * depth)."""
        if not isinstance(record, dict):
            record = {group.lone: record}
        for leaf in group.leaves:
            r, d, v = self.data[(*path, leaf)]
            value = _leaf(record, leaf)
            r.append(rep)
            d.append(2 * depth + (value is not None))
            v.append(value)
        for name, sub in group.groups.items():
            items = as_list(record.get(name))
            if not items:
                self._absent(sub, (*path, name), rep, 2 * depth)
                continue
            for i, item in enumerate(items):
                at = rep if i == 0 else depth + 1
                if item is None:
                    self._absent(sub, (*path, name), at, 2 * depth + 1)
                else:
                    self._write(sub, (*path, name), item, at, depth + 1)

    def _absent(self, group, path, rep, level):
        for leaf in group.leaves:
            r, d, v = self.data[(*path, leaf)]
            r.append(rep)
            d.append(level)
            v.append(None)
        for name, sub in group.groups.items():
            self._absent(sub, (*path, name), rep, level)

    def table(self, path: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray], dict[str, list]]:
        """Record number, the position at each repeated level and the leaves of the ancestor ``path``."""
        group = self.root
        for name in path:
            group = group.groups[name]
        r, d, _ = self.data[(*path, group.leaves[0])]
        rep, level = np.asarray(r, np.int64), np.asarray(d, np.int64)
        here = level >= 2 * len(path)
        record = np.cumsum(rep == 0) - 1
        positions = _positions(rep, here, len(path))
        keep = np.flatnonzero(here)
        leaves = {leaf: [self.data[(*path, leaf)][2][i] for i in keep] for leaf in group.leaves}
        return record[here], positions, leaves


class ArrowColumns:
    """The same level sequences of a batch of typed records, read off the offsets of its lists for all records
    at once. A place in a sequence knows its element in the values of its list, or -1 where there is none."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        n = batch.num_rows
        self.levels = {(): (np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n))}
        self.values: dict[tuple[str, ...], pa.Array] = {(): pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)) if n else None}

    def _load(self, path: tuple[str, ...]):
        if path in self.levels:
            return self.levels[path]
        rep, level, at = self._load(path[:-1])
        depth = len(path) - 1
        lists = pc.struct_field(self.values[path[:-1]], path[-1])
        offsets = np.asarray(lists.offsets, np.int64) if len(lists) else np.zeros(1, np.int64)
        none = np.append(lists.is_null().to_numpy(zero_copy_only=False), True)  # place -1 holds no list
        items = lists.values
        there = at >= 0
        size = np.where(there & ~none[at], offsets[at + 1] - offsets[at], 0)
        count = np.maximum(size, 1)
        of = np.repeat(np.arange(len(at)), count)
        within = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        some = size[of] > 0
        element = np.where(some, offsets[at[of]] + within, 0)
        null = items.is_null().to_numpy(zero_copy_only=False) if len(items) else np.ones(1, bool)
        valid = some & ~null[np.minimum(element, len(null) - 1)]
        found = (
            np.where(within == 0, rep[of], depth + 1),
            np.where(~there[of], level[of], np.where(~some, 2 * depth, np.where(valid, 2 * depth + 2, 2 * depth + 1))),
            np.where(valid, element, -1),
        )
        self.levels[path], self.values[path] = found, items
        return found

    def table(self, path: tuple[str, ...], leaves: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray], dict[str, pa.Array]]:
        """Record number, the position at each repeated level and the leaves of the ancestor ``path``; the
        leaf ``""`` is the element itself."""
        rep, level, at = self._load(path)
        here = level >= 2 * len(path)
        take = pa.array(at[here])
        got = {}
        for leaf in leaves:
            column = self.values[path]
            for part in leaf.split(".") if leaf else ():
                column = pc.struct_field(column, part)
            got[leaf] = column.take(take)
        return (np.cumsum(rep == 0) - 1)[here], _positions(rep, here, len(path)), got


def _positions(rep: np.ndarray, here: np.ndarray, depth: int) -> list[np.ndarray]:
    """Running counts of the repetition levels: the position at each repeated level."""
    out = []
    for k in range(1, depth + 1):
        count = np.cumsum(rep <= k)
        first = np.maximum.accumulate(np.where(rep < k, np.arange(len(rep)), 0)) if len(rep) else rep
        out.append((count - count[first] + 1)[here] if len(rep) else rep)
    return out


#: Repeated ancestors of a module, and which of class, function and argument each level of them counts.
_TABLES = {
    (): ("module", ()),
    ("classes",): ("class", (0,)),
    ("functions",): ("function", (1,)),
    ("classes", "methods"): ("function", (0, 1)),
    ("functions", "args"): ("argument", (1, 2)),
    ("classes", "methods", "args"): ("argument", (0, 1, 2)),
}
SCHEMA = (
    "module_id bigint, kind string, class_pos bigint, function_pos bigint, arg_pos bigint, name string, docstring string, "
    "type string, default string, path string, language string, line bigint, end_line bigint"
)


def _text(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _int(v):
    if isinstance(v, bool) or v is None:
        return None
    try:
        return int(v)
    except (TypeError, ValueError, OverflowError):
        return None


def flatten(ids: list, records: list[dict]) -> pa.RecordBatch:
    """The rows of all tables of a batch of records."""
    cols = Columns(MODULE)
    for rec in records:
        cols.add(rec)
    ids = np.asarray(ids, np.int64)
    out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
    for path, (kind, levels) in _TABLES.items():
        record, positions, leaves = cols.table(path)
        n = len(record)
        at = [np.zeros(n, np.int64)] * 3
        for level, pos in zip(levels, positions):
            at[level] = pos
        out["module_id"].extend(ids[record].tolist())
        out["kind"].extend([kind] * n)
        for key, values in zip(("class_pos", "function_pos", "arg_pos"), at):
            out[key].extend(values.tolist())
        none = [None] * n
        out["name"].extend(map(_text, leaves.get("name", none)))
        out["docstring"].extend(map(_text, leaves.get("docstring", none)))
        out["type"].extend(map(_text, leaves.get("returns", leaves.get("type_annotation", none))))
        out["default"].extend(map(_text, leaves.get("default", none)))
        out["path"].extend(map(_text, leaves.get("path", none)))
        out["language"].extend(map(_text, leaves.get("language", none)))
        out["line"].extend(map(_int, leaves.get("anchor.line", none)))
        out["end_line"].extend(map(_int, leaves.get("end_line", leaves.get("total_lines", none))))
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[x.split()[1]]) for x, v in zip(SCHEMA.split(", "), out.values())], list(out))


def flatten_typed(batch: pa.RecordBatch):
    """The rows of each table of a batch of typed records, a batch for each table."""
    cols = ArrowColumns(batch)
    ids = batch.column(batch.schema.get_field_index("module_id"))
    kinds = {x.split()[0]: {"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in SCHEMA.split(", ")}
    for path, (kind, levels) in _TABLES.items():
        group = MODULE
        for name in path:
            group = group.groups[name]
        record, positions, leaves = cols.table(path, group.leaves)
        n = len(record)
        at = [np.zeros(n, np.int64)] * 3
        for level, pos in zip(levels, positions):
            at[level] = pos
        none = pa.nulls(n)
        pick = lambda *names: next((leaves[x] for x in names if x in leaves), none)
        row = {
            "module_id": ids.take(pa.array(record)), "kind": pa.repeat(pa.scalar(kind), n), "class_pos": pa.array(at[0]), "function_pos": pa.array(at[1]), "arg_pos": pa.array(at[2]),
            "name": pick("name"), "docstring": pick("docstring"), "type": pick("returns", "type_annotation"), "default": pick("default"), "path": pick("path"),
            "language": pick("language"), "line": pick("anchor.line"), "end_line": pick("end_line", "total_lines"),
        }
        yield pa.RecordBatch.from_arrays([row[k].cast(t) for k, t in kinds.items()], list(kinds))


#: Lists of a module that hold no records of the tables above: their path, and whether an element is a value
#: or a pair of name and type.
LISTS = {
    ("imports",): False, ("external_imports",): False, ("exports",): False, ("classes", "bases"): False, ("classes", "decorators"): False, ("functions", "decorators"): False,
    ("classes", "methods", "decorators"): False, ("interfaces", "members"): True, ("components", "hooks"): False,
}
LIST_SCHEMA = "module_id bigint, list string, outer_pos bigint, inner_pos bigint, item_pos bigint, value string, type string"


def flatten_lists(batch: pa.RecordBatch):
    """The elements of each of ``LISTS``, a batch for each."""
    cols = ArrowColumns(batch)
    ids = batch.column(batch.schema.get_field_index("module_id"))
    for path, pairs in LISTS.items():
        record, positions, leaves = cols.table(path, ("name", "type") if pairs else ("",))
        n, zero = len(record), np.zeros(len(record), np.int64)
        outer, inner = (positions[0] if len(path) > 1 else zero), (positions[1] if len(path) > 2 else zero)
        value = leaves["name"] if pairs else leaves[""]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(record)), pa.repeat(pa.scalar(".".join(path)), n), pa.array(outer), pa.array(inner), pa.array(positions[-1]), value.cast(pa.string()), (leaves["type"] if pairs else pa.nulls(n)).cast(pa.string())],
            [x.split()[0] for x in LIST_SCHEMA.split(", ")],
        )


def parse_payload(payload):
    """The record of a JSON payload, or ``None`` if it cannot be read as one object."""
    if not payload:
        return None
    try:
        got = json.loads(payload)
        if isinstance(got, str):
            got = json.loads(got)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


_KEYS = ["module_id", "class_pos", "function_pos", "arg_pos"]


def one_version(rows: DataFrame, columns: list[str], key: str = "module_id") -> DataFrame:
    """One whole row per key: of several versions the one of the least hash. Rows are reduced in each task
    before they are shuffled."""
    whole = F.struct(*columns)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, F.xxhash64(whole)).alias("x")).select(key, "x.*")


def shred_modules(modules: DataFrame) -> DataFrame:
    """All rows of the tables of nested module records (columns ``module_id, path, language, docstring,
    total_lines, functions, classes``): one row per module, class, function or method and argument, with
    ``kind`` and the positions ``class_pos, function_pos, arg_pos`` (from 1, null elements counted, 0
    where a level does not apply), by which every row names its parent.

    Rows with a null id are dropped; of rows that repeat an id one is kept whole; null arrays are empty."""
    data = one_version(modules, ["path", "language", "docstring", "total_lines", "functions", "classes"])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from flatten_typed(b)

    return data.mapInArrow(run, SCHEMA)


def shred_lists(modules: DataFrame) -> DataFrame:
    """``module_id, list, outer_pos, inner_pos, item_pos, value, type``: the elements of the other lists of
    module records (imports, exports, bases, decorators, members, hooks) with the positions of their parents
    (0 where there is none) and their own. Null elements count but give no row."""
    data = one_version(modules, ["imports", "external_imports", "exports", "functions", "classes", "interfaces", "components"])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from flatten_lists(b)

    return data.mapInArrow(run, LIST_SCHEMA)


def shred_payloads(raw: DataFrame) -> DataFrame:
    """The same from JSON text (columns ``module_id, payload``). Fields may be absent, null or empty; a
    lone value where a list is expected is a list of one, a list stored as text is that list, blank text
    is no list; a bare value is the name of its element; an unreadable payload gives no row."""
    data = raw.where("module_id IS NOT NULL AND payload IS NOT NULL").select("module_id", "payload")

    def run(batches):
        for b in batches:
            got = [(m, parse_payload(p)) for m, p in zip(*(b.column(i).to_pylist() for i in range(2)))]
            got = [x for x in got if x[1] is not None]
            yield flatten([m for m, _ in got], [r for _, r in got])

    return data.mapInArrow(run, SCHEMA).dropDuplicates(_KEYS)


def tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The related tables: modules, classes, functions (of modules and classes) and arguments."""
    return {
        "modules": nodes.where("kind = 'module'").select("module_id", "path", "language", "docstring", F.col("end_line").alias("total_lines")),
        "classes": nodes.where("kind = 'class'").select("module_id", "class_pos", "name", "docstring", "line", "end_line"),
        "functions": nodes.where("kind = 'function'").select("module_id", "class_pos", "function_pos", "name", "docstring", F.col("type").alias("returns"), "line", "end_line"),
        "arguments": nodes.where("kind = 'argument'").select("module_id", "class_pos", "function_pos", "arg_pos", "name", F.col("type").alias("type_annotation"), "default"),
    }
