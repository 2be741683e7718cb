"""Relational tables from deeply nested JSON by shared inlining.

The schema graph has a node for each kind of object (*element*) and an edge for each way one is reached. A node
becomes a table of its own if it is repeated below a parent, reached along more than one edge (shared), or reachable
from itself (recursive); every other node is inlined into the columns of its nearest ancestor table. A row's foreign
key is its parent row's key plus its own position, so tables join without generated ids.

Instances are cut out of the parsed VARIANT with array expressions and ``posexplode``, once per table level; no step
runs in Python and nothing is shuffled. Values that hold JSON as text are parsed where an object or array is expected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import measured_cut


@dataclass(frozen=True)
class Edge:
    """``parent`` reaches ``child`` along ``path``: member names joined by dots, each repeated step ending in ``[*]``; ``''`` is the value itself."""

    parent: str
    child: str
    path: str

    @property
    def repeated(self) -> bool:
        return "[*]" in self.path


@dataclass
class Element:
    """A node: its leaf columns (name -> (path, type)). A type ``flag`` accepts JSON booleans and the words true/false."""

    name: str
    leaves: dict[str, tuple[str, str]] = field(default_factory=dict)


class SchemaGraph:
    def __init__(self, root: str, elements: list[Element], edges: list[Edge]):
        self.root, self.elements, self.edges = root, {e.name: e for e in elements}, edges
        unknown = {x for e in edges for x in (e.parent, e.child)} - set(self.elements)
        if unknown or root not in self.elements:
            raise ValueError(f"edges name unknown elements: {sorted(unknown)}")

    def below(self, name: str) -> set[str]:
        seen: set[str] = set()
        todo = [name]
        while todo:
            for e in self.edges:
                if e.parent == todo[-1] and e.child not in seen:
                    seen.add(e.child)
                    todo.insert(0, e.child)
            todo.pop()
        return seen

    def tables(self) -> dict[str, str]:
        """Element -> why it has a table: root, repeated, shared or recursive."""
        out = {self.root: "root"}
        for name in self.elements:
            into = [e for e in self.edges if e.child == name]
            if name in self.below(name):
                out.setdefault(name, "recursive")
            elif any(e.repeated for e in into):
                out.setdefault(name, "repeated")
            elif len(into) > 1:
                out.setdefault(name, "shared")
        return out

    def columns(self, name: str, path: str = "", prefix: str = "") -> dict[str, tuple[str, str]]:
        """Leaf columns of a table with those of its inlined descendants."""
        has_table = self.tables()
        out = {prefix + c: (".".join(x for x in (path, p) if x), t) for c, (p, t) in self.elements[name].leaves.items()}
        for e in self.edges:
            if e.parent == name and e.child not in has_table:
                out |= self.columns(e.child, ".".join(x for x in (path, e.path) if x), f"{prefix}{e.child}_")
        return out

    def parents(self, name: str) -> list[tuple[str, str]]:
        """(parent table, path from it) for each way ``name`` is reached, inlined nodes in between folded into the path."""
        has_table = self.tables()
        out = []
        for e in self.edges:
            if e.child == name:
                if e.parent in has_table:
                    out.append((e.parent, e.path))
                else:
                    out += [(t, ".".join(x for x in (p, e.path) if x)) for t, p in self.parents(e.parent)]
        return out


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split(".") if p)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, _json_path(path), kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _list(v: Column, path: str) -> Column:
    """The array at ``path``, also if given as JSON text; null if there is none."""
    text = F.try_parse_json(_get(v, path, "string"))
    return F.coalesce(_get(v, path, "array<variant>"), F.try_variant_get(text, "$", "array<variant>"))


def instances(v: Column, path: str) -> Column:
    """All values at ``path`` in document order, as an array (empty if there is none). Null elements stay, so positions hold."""
    none = F.expr("cast(array() as array<variant>)")
    head, star, rest = path.partition("[*]")
    if not star:
        one = _get(v, path, "variant") if path else v
        return F.when(one.isNotNull() & is_object(one), F.array(one)).otherwise(none)
    found = F.coalesce(_list(v, head.strip(".")), none)
    if not rest:
        return found
    return F.flatten(F.transform(found, lambda x: instances(x, rest.strip("."))))


def leaf(v: Column, path: str, kind: str) -> Column:
    if kind == "flag":
        word = F.lower(F.trim(_get(v, path, "string")))
        return F.when(word.isin("true", "false"), word == "true")
    if kind == "json":
        return F.to_json(_get(v, path, "variant"))
    return _get(v, path, kind)


def shred(records: DataFrame, graph: SchemaGraph, keys: list[str], payload: str, choose_first: frozenset[str] = frozenset(), carried: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One frame per table of ``graph``.

    ``records`` has the key columns and the JSON text. Unreadable, empty and null payloads give no row. A table below
    the root has the keys, for each table above it ``<table>_pos`` (1-based position, the foreign key to that table), and
    its own ``<name>_pos``; positions count all elements, null and scalar ones too, but only objects become rows.
    ``carried`` (table -> one of its leaves) gives that leaf to the tables below too, so that they need no join for it.
    Elements reached along several edges from one parent are numbered through in the order of the edges; those in
    ``choose_first`` take only the first edge along which there is anything.
    An element shared by several parent tables has one table with the keys of each; those of the parents a row does not belong to are null.
    A recursive element gets ``<name>_path`` (positions from its first ancestor down) and is unrolled level by level until
    no row is left. Repeated records must be removed by the caller.
    """
    has_table = graph.tables()
    parsed = records.select(*keys, F.try_parse_json(payload).alias("_v")).where(F.col("_v").isNotNull())
    live: dict[str, tuple[list[str], DataFrame]] = {graph.root: (list(keys), parsed)}
    todo = [n for n in has_table if n != graph.root]
    while todo:
        ready = [n for n in todo if all(p in live for p, _ in graph.parents(n) if p != n) and any(p != n for p, _ in graph.parents(n))]
        if not ready:
            raise ValueError(f"no way from the root to {todo}, or they contain each other through tables of their own")
        for name in ready:
            todo.remove(name)
            ways: dict[str, list[str]] = {}
            for parent, path in graph.parents(name):
                ways.setdefault(parent, []).append(path)
            v, pos = F.col("_v"), f"{name}_pos"
            rows, above = None, []
            for parent in (p for p in ways if p != name):
                keys_above, frame = live[parent]
                found = [instances(v, p) for p in ways[parent]]
                if name in choose_first:
                    every = F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])
                else:
                    every = F.concat(*found) if len(found) > 1 else found[0]
                part = frame.select(*keys_above, F.posexplode(every).alias("_i", "_e")).select(*keys_above, (F.col("_i") + 1).cast("long").alias(pos), F.col("_e").alias("_v")).where(is_object(F.col("_v")))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
                above += [c for c in keys_above if c not in above]
            cols = [*above, pos]
            if has_table[name] == "recursive":
                path = f"{name}_path"
                cols.append(path)
                inner = [instances(v, p) for p in ways[name]]
                inner = F.concat(*inner) if len(inner) > 1 else inner[0]
                level, seen = measured_cut(rows.withColumn(path, F.array(F.col(pos))), "level")
                rows = level
                while seen["n"]:  # each level is written, so the next starts from it and none is made twice
                    deeper = level.select(*cols, F.posexplode(inner).alias("_i", "_e")).select(*above, pos, F.concat(F.col(path), F.array((F.col("_i") + 1).cast("long"))).alias(path), F.col("_e").alias("_v"))
                    level, seen = measured_cut(deeper.where(is_object(F.col("_v"))), "level")
                    if seen["n"]:
                        rows = rows.unionByName(level)
            if carried and name in carried:
                own = graph.elements[name].leaves[carried[name]]
                rows, cols = rows.withColumn(carried[name], leaf(F.col("_v"), *own)), [*cols, carried[name]]
            live[name] = (cols, rows)
    return {n: frame.select(*cols, *[leaf(F.col("_v"), p, t).alias(c) for c, (p, t) in graph.columns(n).items() if c not in cols]) for n, (cols, frame) in live.items()}


# What the schema of a VARIANT calls a value, and the type its column gets; of other values the JSON text is kept.
LEAF_TYPES = {"BIGINT": "bigint", "INT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean"}


def _schema(text: str):
    """``OBJECT<a: T, ...>`` as a dictionary, ``ARRAY<T>`` as a one-element list, anything else as its first word."""

    def value(at: int):
        word = re.compile(r"[A-Z_]+").match(text, at)[0]
        at += len(word)
        if word == "OBJECT":
            out, at = {}, at + 1
            while text[at] != ">":
                m = re.compile(r"(?:`((?:[^`]|``)*)`|([^:`]+)): ").match(text, at)
                name = m[1].replace("``", "`") if m[1] is not None else m[2]
                out[name], at = value(m.end())
                at += 2 if text[at] == "," else 0
            return out, at + 1
        if word == "ARRAY":
            inner, at = value(at + 1)
            return [inner], at + 1
        if at < len(text) and text[at] == "(":
            at = text.index(")", at) + 1
        return word, at

    return value(0)[0]


def analyse(records: DataFrame, payload: str, root: str = "record") -> SchemaGraph:
    """The schema graph of the data: an element per member name that holds objects, an edge per way it is reached, leaves with the types all payloads agree on.

    Objects under one name are one element wherever they stand, so what is reached from several parents becomes shared and what contains itself recursive. The schema
    is a mergeable aggregate over all payloads; it alone reaches the driver. Payloads that are lists are lists of the root element, unreadable ones add nothing. A
    member named like ``root`` counts as the root; names with dots or brackets cannot be paths and are left out.
    """
    v = F.try_parse_json(payload)
    kinds = records.select(v.alias("v")).where("v is not null").groupBy(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("kind")).agg(F.schema_of_variant_agg("v").alias("s")).collect()
    elements: dict[str, Element] = {root: Element(root)}
    edges: dict[tuple[str, str, str], None] = {}

    def visit(name: str, members: dict) -> None:
        element = elements.setdefault(name, Element(name))
        for member, kind in members.items():
            if re.search(r"[.\[\]']", member):
                continue
            stars, inner = "", kind
            while isinstance(inner, list):
                stars, inner = stars + "[*]", inner[0]
            if isinstance(inner, dict) and len(stars) <= 3:
                edges[name, member, member + stars] = None
                visit(member, inner)
            else:
                found = LEAF_TYPES.get(inner, "json") if not stars and isinstance(inner, str) else "json"
                before = element.leaves.get(member, (member, found))[1]
                if inner != "VOID" or stars or member not in element.leaves:
                    element.leaves[member] = (member, found if before == found else "json")

    for row in kinds:
        tree = _schema(row.s)
        if isinstance(tree, list) and isinstance(tree[0], dict):
            tree = tree[0]
        if isinstance(tree, dict):
            visit(root, tree)
    for e in elements.values():  # what holds objects somewhere is no leaf
        e.leaves = {c: x for c, x in e.leaves.items() if (e.name, c) not in {(p, q) for p, q, _ in edges}}
    return SchemaGraph(root, list(elements.values()), [Edge(*e) for e in edges])


#: Deliveries of samples. A payload is a sample, wraps one in an envelope, or lists several; tokens hang directly below a sample or below its phrases and words.
DELIVERY_GRAPH = SchemaGraph(
    "delivery",
    [
        Element("delivery", {"batch_id": ("batch_id", "string"), "queue": ("envelope.meta.queue", "bigint"), "attempt": ("delivery.attempt", "bigint")}),
        Element("sample", {"sample_id": ("sample_id", "string"), "schema_version": ("schema_version", "string"), "text": ("text", "string"), "normalized_text": ("normalized_text", "string")}),
        Element("engine", {"name": ("name", "string"), "version": ("version", "bigint")}),
        Element("token", {"phoneme": ("phoneme", "string"), "language": ("language", "string"), "surface_tone": ("surface_tone", "bigint"), "stress": ("stress", "bigint"), "syllable_role": ("syllable_role", "string")}),
        Element("articulatory", {**{c: (c, "string") for c in ("type", "height", "backness", "place", "manner")}, "voiced": ("voiced", "flag")}),
        Element("boundary", {**{c: (c, "flag") for c in ("word_start", "word_end", "phrase_start", "phrase_end")}, "type": ("boundary_type", "string")}),
        Element("labels", {"viseme_id": ("viseme_id", "bigint"), "strength": ("strength", "double"), "viseme_source": ("viseme_source", "string"), "strength_source": ("strength_source", "string")}),
        Element("teacher", {"shape": ("shape", "string")}),
        Element("alternative", {"viseme_id": ("viseme_id", "bigint"), "weight": ("weight", "double")}),
    ],
    [
        Edge("delivery", "sample", "samples[*]"),
        Edge("delivery", "sample", "envelope.sample"),
        Edge("delivery", "sample", "[*]"),
        Edge("delivery", "sample", ""),
        Edge("sample", "engine", "teacher_metadata.engine"),
        Edge("sample", "token", "tokens[*]"),
        Edge("sample", "token", "phrases[*].words[*].tokens[*]"),
        Edge("token", "articulatory", "articulatory"),
        Edge("token", "boundary", "boundary"),
        Edge("token", "labels", "labels"),
        Edge("token", "teacher", "teacher_metadata"),
        Edge("teacher", "alternative", "alternatives[*]"),
    ],
)


def delivery_tables(raw_records: DataFrame) -> dict[str, DataFrame]:
    """Tables delivery, sample, token and alternative of ``raw_records(raw_id, payload)``; repeated rows count once. ``sample_id`` is '' if missing or null.

    Empty input gives empty tables; columns of other names are ignored.
    """
    rows = raw_records.select("raw_id", "payload").where(F.col("payload").isNotNull() & (F.trim("payload") != "")).distinct()
    out = shred(rows, DELIVERY_GRAPH, ["raw_id"], "payload", choose_first=frozenset({"sample"}))
    out["sample"] = out["sample"].withColumn("sample_id", F.coalesce("sample_id", F.lit("")))
    return out


def delivered_tokens(raw_records: DataFrame) -> DataFrame:
    """``raw_id, sample_pos, sample_id, token_index`` of every token object: the token table joined to its parent sample on the foreign key (carried along instead of joined)."""
    rows = raw_records.select("raw_id", "payload").where(F.col("payload").isNotNull() & (F.trim("payload") != "")).distinct()
    g = DELIVERY_GRAPH
    key = SchemaGraph("delivery", [Element("delivery"), Element("sample", {"sample_id": ("sample_id", "string")}), Element("token")], [e for e in g.edges if {e.parent, e.child} <= {"delivery", "sample", "token"}])
    t = shred(rows, key, ["raw_id"], "payload", choose_first=frozenset({"sample"}), carried={"sample": "sample_id"})["token"]
    return t.select("raw_id", "sample_pos", F.coalesce("sample_id", F.lit("")).alias("sample_id"), F.col("token_pos").alias("token_index"))


def delivered_samples(rows: DataFrame) -> DataFrame:
    """``raw_id, sample, tokens`` of ``rows(raw_id, payload)``: each sample value the delivery graph cuts out as VARIANT, and its tokens from every path as an array, null if no path leads to a list.

    Values that are no objects stay, so that they can be checked. A readable payload without samples is its own sample; an unreadable or null one gives one row with a null sample.
    """
    v = F.col("_v")
    paths = {c: [p for _, p in DELIVERY_GRAPH.parents(c)] for c in ("sample", "token")}
    none = F.array(v)
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in (instances(v, p) for p in paths["sample"])], none)
    s = rows.select("raw_id", F.try_parse_json("payload").alias("_v")).select("raw_id", F.explode(found).alias("_v"))
    lists = [_list(v, p[: p.index("[*]")]) for p in paths["token"]]
    tokens = F.when(F.coalesce(*lists).isNotNull(), F.concat(*[instances(v, p) for p in paths["token"]]))
    return s.select("raw_id", v.alias("sample"), tokens.alias("tokens"))
