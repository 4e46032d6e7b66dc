"""Deeply nested records to flat tables that keep parent-child links.

Method: a depth-first traversal labels every node of a JSON value with its pre-order and post-order number, so a node lies
below another exactly when its interval lies within the other's. The nodes are emitted per type - objects, arrays, scalars -
and linked by interval containment: the parent of an array element is the nearest element whose interval holds its own.
Labelling and linking need one value at a time, so both run in the task that read the row, without a shuffle.

Defined results: unreadable or null JSON has no nodes; a value, and a tool_use part's input, may be a JSON string that holds
the object; positions count null elements; equal rows keep their own ids; depth and length are not limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.rawjson import opened, parse, result_value

OBJECT, ARRAY, SCALAR = "object", "array", "scalar"


def label(value, open_inputs: bool = False, scalars: bool = True) -> list[list]:
    """[pre, post, kind, path, key, position, value] of each node, in pre-order. key is the member name, position the place in an array (else None).

    post is the number of the node's last descendant in the same counting, so intervals nest: a holds b if a.pre < b.pre <= a.post.
    open_inputs: the input of tool_use parts of content is opened if it is a JSON string."""
    nodes: list[list] = []
    stack: list[tuple] = [(value, "", None, None, 0)]
    open_ends: list[list] = []
    while stack:
        x, path, key, position, depth = stack.pop()
        while len(open_ends) > depth:
            open_ends.pop()[1] = len(nodes) - 1
        if open_inputs and depth == 3 and key == "input" and isinstance(x, str) and path.startswith("content[") and path.endswith("].input") and open_ends[-1][6].get("type") == "tool_use":
            x = opened(x)
        if isinstance(x, dict):
            node = [len(nodes), 0, OBJECT, path, key, position, x]
            dot = path + "." if path else ""
            stack.extend([(v, dot + k, k, None, depth + 1) for k, v in reversed(x.items()) if scalars or isinstance(v, (dict, list)) or (open_inputs and k == "input")])
        elif isinstance(x, list):
            node = [len(nodes), 0, ARRAY, path, key, position, x]
            stack.extend([(x[i], f"{path}[{i}]", None, i, depth + 1) for i in range(len(x) - 1, -1, -1) if scalars or isinstance(x[i], (dict, list))])
        elif not scalars:
            continue
        else:
            node = [len(nodes), 0, SCALAR, path, key, position, x]
        nodes.append(node)
        open_ends.append(node)
    while open_ends:
        open_ends.pop()[1] = len(nodes) - 1
    return nodes


def elements(nodes: list[list]) -> list[tuple[list, list | None]]:
    """(node, parent) of each object that is an element of an array; parent is the nearest such object whose interval holds the node's."""
    found, holders = [], []
    for node in nodes:
        if node[2] == OBJECT and node[5] is not None:
            while holders and holders[-1][1] < node[0]:
                holders.pop()
            found.append((node, holders[-1] if holders else None))
            holders.append(node)
    return found


_FOUND = pa.schema(
    [
        ("entry_id", pa.int64()),
        ("root", pa.string()),
        ("node_path", pa.string()),
        ("parent_path", pa.string()),
        ("pre", pa.int64()),
        ("post", pa.int64()),
        ("parent_pre", pa.int64())
    ]
)


def roots(message: str | None, result: str | None) -> Iterator[tuple[str, object, bool]]:
    """(root name, value, whether tool inputs are opened)."""
    if message is not None:
        yield "message", opened(parse(message)), True
    if result is not None:
        yield "tool_use_result", result_value(result), False


def _element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _FOUND]
        for entry, message, result in zip(*(c.to_pylist() for c in batch.columns)):
            for root, value, inputs in roots(message, result):
                if isinstance(value, (dict, list)):
                    for node, parent in elements(label(value, inputs, scalars=False)):
                        for c, v in zip(cols, (entry, root, node[3], parent[3] if parent else "", node[0], node[1], parent[0] if parent else None)):
                            c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOUND.types)], schema=_FOUND)


def array_objects(log_entries: DataFrame) -> DataFrame:
    """entry_id, root, node_path, parent_path, pre, post, parent_pre: a row per object that is an element of an array."""
    held = log_entries.select("entry_id", "message", "tool_use_result").where("message like '%[%' or tool_use_result like '%[%'")
    return held.mapInArrow(_element_batches, "entry_id long, root string, node_path string, parent_path string, pre long, post long, parent_pre long")


_NODES = pa.schema(
    [
        ("entry_id", pa.int64()),
        ("root", pa.string()),
        ("pre", pa.int64()),
        ("post", pa.int64()),
        ("kind", pa.string()),
        ("node_path", pa.string()),
        ("key", pa.string()),
        ("position", pa.int64()),
        ("value_type", pa.string()),
        ("value", pa.string())
    ]
)


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    for batch in batches:
        cols: list[list] = [[] for _ in _NODES]
        for entry, message, result in zip(*(c.to_pylist() for c in batch.columns)):
            for root, value, inputs in roots(message, result):
                for pre, post, kind, path, key, position, x in label(value, inputs) if isinstance(value, (dict, list)) else []:
                    plain = kind == SCALAR and x is not None
                    shown = (x if isinstance(x, str) else json.dumps(x)) if plain else None
                    for c, v in zip(cols, (entry, root, pre, post, kind, path, key, position, type(x).__name__ if kind == SCALAR else None, shown)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _NODES.types)], schema=_NODES)


def nodes(log_entries: DataFrame) -> DataFrame:
    """Every node with its interval: entry_id, root, pre, post, kind (object, array, scalar), node_path, key, position, value_type, value."""
    return log_entries.select("entry_id", "message", "tool_use_result").where("message is not null or tool_use_result is not null").mapInArrow(
        _node_batches, "entry_id long, root string, pre long, post long, kind string, node_path string, key string, position long, value_type string, value string"
    )


def node_tables(found: DataFrame) -> dict[str, DataFrame]:
    """One relation per type; rows of the three are linked by containment of (pre, post) within entry_id and root."""
    place = ["entry_id", "root", "pre", "post", "node_path", "key", "position"]
    return {
        OBJECT: found.where(F.col("kind") == OBJECT).select(*place),
        ARRAY: found.where(F.col("kind") == ARRAY).select(*place),
        SCALAR: found.where(F.col("kind") == SCALAR).select(*place, "value_type", "value")
    }


def below(found: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Pairs of found's nodes and the given ancestors (entry_id, root, pre, post) that hold them, by interval containment within a value."""
    a = ancestors.select("entry_id", "root", F.col("pre").alias("above_pre"), F.col("post").alias("above_post"))
    return found.join(a, ["entry_id", "root"]).where("pre > above_pre and pre <= above_post")
