"""Nested values of unlike shapes as rows: every node of a tree, objects found anywhere, paths copied, and what one snapshot lost of another.

Trees come as JSON text or VARIANT. ``nodes`` walks each once and gives a row for each node; ``objects_with`` searches those rows by joins and groups. ``objects`` and ``shapes`` search and add
up while they walk, and make rows of what they find only.
``losses`` compares two snapshots of records by key: whatever the base holds must still be in the head, which may add freely.

A null or unreadable tree has no nodes and, as a base, nothing to lose. Paths are keys after slashes; list items stand by their place from 0.
Trees deeper than ``DEPTH`` are walked and compared down to it. An empty table gives no rows; equal rows are walked each.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 24
#: Trees that a task adds up at once.
PASS = 20_000
#: The keys that identify an item of a list, in order, and what else belongs to the identity that a key gives.
IDENTITIES = ("claimId", "id", "no", "year", "sourceId", "personId", "providerId", "date")
COMPANIONS = {"sourceId": ("page",), "personId": ("body", "observedTitle")}
#: A key that a later look at a source may change, and the changes of a status that are conclusions.
REFRESHED = ("retrievedAt",)
CONCLUDED = {"/status": ("scheduled", ("played", "abandoned", "awarded", "cancelled", "postponed"))}


_KINDS = {type(None): "null", bool: "boolean", int: "integer", float: "real", str: "text", list: "array", dict: "object"}
_quoted, _said = json.encoder.encode_basestring_ascii, json.encoder.encode_basestring


def _read(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def _plain(value) -> str:
    """One text for equal values: keys in order, whole numbers without a point."""
    if type(value) is str:
        return _said(value)
    if type(value) is int:
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{_plain(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def _kind(value) -> str:
    return _KINDS[type(value)]


def _walk(value, path: str, parent: str | None, name: str | None, depth: int) -> Iterator[tuple]:
    size = len(value) if isinstance(value, list | dict) else None
    yield path, parent, name, _kind(value), size, value if isinstance(value, str) else _plain(value)
    if depth:
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            yield from _walk(inner, f"{path}/{key}", path, str(key), depth - 1)


def _json(df: DataFrame, column: str) -> Column:
    return F.to_json(column) if isinstance(df.schema[column].dataType, T.VariantType) else F.col(column).cast("string")


def nodes(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, path, parent, name, type, size, value) of every node: the root has an empty path, size is that of arrays and objects, value the text of
    a string and the JSON of anything else."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, *[pa.string()] * 4, pa.int32(), pa.string()]
        for part, trees in _parsed(batches):
            kinds[0] = part.schema.field(0).type
            rows = [(k, *node) for k, value in trees for node in _walk(value, "", None, None, DEPTH)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "path", "parent", "name", "type", "size", "value"])

    return df.select(key, _json(df, tree).alias("_tree")).mapInArrow(run, f"`{key}` {kind}, path string, parent string, name string, type string, size int, value string")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Keys and readable trees of each piece of the batches."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield part, [(k, value) for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text is not None and ((value := _read(text)) is not None or text.strip() == "null")]


def _tally(value, at: tuple, depth: int) -> str:
    """Counts a value and all below it and gives its JSON, so that each value is written out once. A place is its path, what each type holds there, and
    the places below by name."""
    path, kinds, below = at
    kind, size = type(value), None
    if kind is str:
        shown, text = value, _said(value)
    elif kind is int:
        shown = text = str(value)
    elif kind is dict and depth:
        size, parts = len(value), []
        for name in sorted(value):
            inner = below.get(name)
            if inner is None:
                inner = below[name] = (f"{path}/{name}", {}, {})
            parts.append(f"{_quoted(name)}:{_tally(value[name], inner, depth - 1)}")
        shown = text = "{" + ",".join(parts) + "}"
    elif kind is list and depth:
        size = len(value)
        inner = below.get(None)
        if inner is None:
            inner = below[None] = (f"{path}/*", {}, {})
        shown = text = "[" + ",".join([_tally(v, inner, depth - 1) for v in value]) + "]"
    else:
        size = len(value) if kind is dict or kind is list else None
        shown = text = _plain(value)
    held = kinds.get(kind)
    if held is None:
        kinds[kind] = [1, size, shown]
    else:
        held[0] += 1
        if size is not None:
            held[1] += size
        if shown > held[2]:
            held[2] = shown
    return text


def _tallied(at: tuple) -> Iterator[tuple]:
    path, kinds, below = at
    yield from ((path, _KINDS[kind], *held) for kind, held in kinds.items())
    for inner in below.values():
        yield from _tallied(inner)


def shapes(df: DataFrame, tree: str) -> DataFrame:
    """(path, type, n, size, largest) over the nodes of all trees, list places as ``*``: how many, the sum of their sizes, the largest value. A task adds up
    what it walks before rows are made, so that few rows are shuffled; it holds the paths of ``PASS`` trees or so at once."""

    def rows(root: tuple) -> pa.RecordBatch:
        columns = list(zip(*_tallied(root), strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "type", "n", "size", "largest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, seen = ("", {}, {}), 0
        for _, trees in _parsed(batches):
            for _, value in trees:
                _tally(value, root, DEPTH)
            seen += len(trees)
            if seen >= PASS:
                yield rows(root)
                root, seen = ("", {}, {}), 0
        yield rows(root)

    found = df.select(F.lit(None).cast("int").alias("_key"), _json(df, tree).alias("_tree")).mapInArrow(run, "path string, type string, n long, size long, largest string")
    return found.groupBy("path", "type").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("largest").alias("largest"))


def _objects(value, path: tuple, depth: int, searches: list[list[tuple[str, str]]], out: list) -> None:
    """Adds (path, search, values) of the objects of a tree that a search asks for. A path is a chain of names, and written out where something is found."""
    if type(value) is dict:
        for nth, wanted in enumerate(searches):
            held = []
            for name, of in wanted:
                if name not in value:
                    break
                v = value[name]
                kind = _KINDS[type(v)]
                if kind != of and not (kind == "array" and of == f"array({len(v)})"):
                    break
                held.append(v if kind == "text" else str(v) if kind == "integer" else _plain(v))
            else:
                out.append((_path(path), nth, held))
        below = value.items()
    else:
        below = enumerate(value)
    if depth > 1:
        for name, inner in below:
            if type(inner) is dict or type(inner) is list:
                _objects(inner, (path, name), depth - 1, searches, out)


def _path(chain: tuple) -> str:
    names = []
    while chain:
        chain, name = chain
        names.append(f"/{name}")
    return "".join(reversed(names))


def objects(df: DataFrame, key: str, tree: str, *wanted: Mapping[str, str]) -> DataFrame:
    """(key, path, search, values) of the objects, anywhere in a tree, that have all keys of a search with a value of the stated type, as ``objects_with``
    asks for them; values stand in the order of its keys. Each tree is walked once for all searches, where it lies; equal rows are searched each."""
    kind, searches = dict(df.dtypes)[key], [list(w.items()) for w in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.string(), pa.int32(), pa.list_(pa.string())]
        for part, trees in _parsed(batches):
            kinds[0] = part.schema.field(0).type
            rows = []
            for k, value in trees:
                if isinstance(value, dict | list):
                    found: list = []
                    _objects(value, (), DEPTH, searches, found)
                    rows += [(k, *f) for f in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "path", "search", "values"])

    return df.select(key, _json(df, tree).alias("_tree")).mapInArrow(run, f"`{key}` {kind}, path string, search int, values array<string>")


def objects_with(walked: DataFrame, key: str, wanted: Mapping[str, str]) -> DataFrame:
    """(key, path, and each wanted value) of the objects, anywhere in a tree, that have all wanted keys with a value of the stated type;
    ``array(2)`` asks for an array of two."""
    typed = F.when((F.col("type") == "array"), F.concat(F.lit("array("), F.col("size"), F.lit(")"))).otherwise(F.col("type"))
    fits = lambda name, of: (F.col("name") == name) & ((typed == of) | (F.col("type") == of))
    held = walked.filter(F.col("name").isin(*wanted)).groupBy(key, "parent").agg(*[F.max(F.when(fits(n, of), F.col("value"))).alias(n) for n, of in wanted.items()])
    objects = walked.filter("type = 'object'").select(key, F.col("path").alias("parent"))
    found = held.filter(" AND ".join(f"`{n}` IS NOT NULL" for n in wanted)).join(objects, [key, "parent"], "left_semi")
    return found.withColumnRenamed("parent", "path")


def copied(df: DataFrame, source: str, target: str, paths: Sequence[str]) -> DataFrame:
    """The target struct with the values that the source has at dotted paths, nulls too. A path whose way leads through a null of the source is left as it
    is; a null on the target's way becomes a struct."""

    def put(to: Column, kind: T.StructType, of: Column, parts: Sequence[str]) -> Column:
        name, *rest = parts
        to = F.coalesce(to, F.from_json(F.lit("{}"), kind))
        if not rest:
            return to.withField(f"`{name}`", of[name])
        return to.withField(f"`{name}`", F.when(of[name].isNull(), to[name]).otherwise(put(to[name], kind[name].dataType, of[name], rest)))

    out = F.col(target)
    for path in paths:
        out = F.when(F.col(source).isNull(), out).otherwise(put(out, df.schema[target].dataType, F.col(source), path.split(".")))
    return df.withColumn(target, out)


def compact(entries: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


class Additivity:
    """What a base holds that a head doesn't, node by node."""

    def __init__(self, refreshed: Collection[str] = REFRESHED, concluded: Mapping[str, tuple[str, Collection[str]]] = CONCLUDED):
        self.refreshed, self.concluded = refreshed, concluded

    @staticmethod
    def empty(value) -> bool:
        return value is None or value == [] or (isinstance(value, str) and not value.strip())

    @staticmethod
    def identities(item) -> list[tuple[str, str]]:
        """(key, what identifies the item) for each identity key that it has."""
        said = lambda v: (v if isinstance(v, str) else _plain(v)).strip()
        if not isinstance(item, dict):
            return []
        own = [(k, said(item[k])) for k in IDENTITIES if item.get(k) is not None and said(item[k])]
        return [(k, ":".join([v, *(said(item[c]) for c in COMPANIONS.get(k, ()) if item.get(c) is not None)])) for k, v in own]

    def scalar_kept(self, base, head, path: str) -> bool:
        if (type(base) is type(head) and base == head and not isinstance(base, float)) or _plain(base) == _plain(head):
            return True
        if isinstance(base, str) and isinstance(head, str) and "�" in base and base.replace("�", "") == "".join(c for c in head if ord(c) < 128):
            return True  # letters that had been lost are back
        if path.rsplit("/", 1)[-1] in self.refreshed:
            return True
        before, after = self.concluded.get(path, (None, ()))
        return base == before and head in after if isinstance(head, str) else False

    def lost(self, base, head, path: str = "", depth: int = DEPTH) -> Iterator[tuple]:
        """(path, remove or mutate, base, head)."""
        if depth < 0 or self.empty(base):
            return
        if self.empty(head):
            yield path, "remove", base, head
        elif isinstance(base, dict | list) and type(base) is not type(head):
            yield path, "mutate", base, head
        elif isinstance(base, dict):
            for key, value in base.items():
                yield from self.lost(value, head.get(key), f"{path}/{key}", depth - 1)
        elif isinstance(base, list):
            yield from self.lost_items(base, head, path, depth)
        elif not self.scalar_kept(base, head, path):
            yield path, "mutate", base, head

    def lost_items(self, base: list, head: list, path: str, depth: int) -> Iterator[tuple]:
        """Items that name themselves meet those of the same name: the unchanged ones first, the others in order. All others must be there as they were,
        as often as they were."""
        shapes, waiting, gone = [_plain(x) for x in head], defaultdict(list), set()
        for place, item in enumerate(head):
            for name in self.identities(item):
                waiting[name].append(place)

        def candidates(names: list) -> tuple[tuple, list[int]]:
            """The first of an item's names that heads still wait under, and their places."""
            for name in names:
                if left := [p for p in waiting.get(name, ()) if p not in gone]:
                    return name, left
            return ("", ""), []

        named, shape = [self.identities(item) for item in base], list(map(_plain, base))
        unchanged = set()
        for i, item in enumerate(base):
            same = [p for p in candidates(named[i])[1] if shapes[p] == shape[i]] if named[i] else []
            if same:
                gone.add(same[0])
                unchanged.add(i)
        left = Counter(shapes)
        for i, item in enumerate(base):
            if i in unchanged:
                continue
            name, places = candidates(named[i])
            if places:
                gone.add(places[0])
                yield from self.lost(item, head[places[0]], f"{path}/{name[0]}={name[1]}", depth - 1)
            elif named[i]:
                yield f"{path}/{named[i][0][1]}", "remove", item, None
            elif left[shape[i]]:
                left[shape[i]] -= 1
            else:
                yield f"{path}[{i}]", "remove", item, None


def losses(base: DataFrame, head: DataFrame, key: str, tree: str, rules: Additivity | None = None) -> DataFrame:
    """(key, path, change, base, head) of everything that records of the base lost in the head; a record that is gone altogether has an
    empty path. Keys are unique in either snapshot; rows without one are left out."""
    rules = rules or Additivity()
    kind = dict(base.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda v: None if v is None else v if isinstance(v, str) else _plain(v)
        for batch in batches:
            rows = []
            for k, was, now, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = _read(was)
                found = rules.lost(value, _read(now)) if there else [("", "remove", value, None)] if not rules.empty(value) else []
                rows += [(k, path, change, text(a), text(b)) for path, change, a, b in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [batch.schema.field(0).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "path", "change", "base", "head"])

    now = head.select(key, _json(head, tree).alias("_now"), F.lit(True).alias("_there"))
    both = base.filter(F.col(key).isNotNull()).select(key, _json(base, tree).alias("_was")).join(now, key, "left")
    return both.select(key, "_was", "_now", F.coalesce("_there", F.lit(False)).alias("_there")).mapInArrow(run, f"`{key}` {kind}, path string, change string, base string, head string")
