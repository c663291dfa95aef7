"""Values inherited along chains of parents that never leave their document: style sheets, and lengths that scale by nested groups."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import stream_groups, stream_tables

SHEET = "map<string,string>"


def inherited(parents: Mapping[str, str | None], own: Mapping[str, dict]) -> dict[str, dict]:
    """For every node its own values and, for what it doesn't state, those of the nearest ancestor that does. A walk ends where it would meet a
    node again or an unknown one; chains of any length cost one visit a node."""
    found: dict[str, dict] = {}
    for start in parents:
        path: list[str] = []
        place: dict[str, int] = {}
        at: str | None = start
        while at in parents and at not in found and at not in place:
            place[at] = len(path)
            path.append(at)
            at = parents[at]
        below = path
        if at in place:  # a cycle: twice around it, backwards, so that each of its nodes sees all others behind its own
            cycle, below = path[place[at] :], path[: place[at]]
            values: dict = {}
            for node in cycle[::-1] + cycle[::-1]:
                values = {**values, **own.get(node, {})}
                found[node] = values
        values = found.get(at, {}) if at is not None else {}
        for node in reversed(below):
            mine = own.get(node)
            values = {**values, **mine} if mine else values
            found[node] = values
    return found


def sheets(declared: DataFrame, part: str) -> DataFrame:
    """part, style, known, props: what each style of a document's sheet says, its own, inherited and default values together; a row without a
    style holds the defaults. declared: part, scope (style or default), id, parent, prop, value, a property stated at most once per style.

    One shuffle by document; the styles of many documents are resolved together, in as many steps as the logarithm of the longest chain. inherited() says the same of
    one sheet.
    """

    rows = declared.where("scope in ('style', 'default')").select(part, "scope", "id", "parent", "prop", "value")
    return stream_tables(rows, part, ["scope", "id", "prop"], lambda table: _resolved(table, part), f"{part} string, style string, props {SHEET}")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A column as numbers of its distinct values, null being one."""
    coded = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _resolved(table: pa.Table, part: str) -> pa.Table:
    """sheets() of whole documents, for the styles of all of them at once: what a style lacks it asks its ancestor 1, 2, 4, ... steps up, which by then knows the
    nearest value of as many styles from it on; so it meets the nearest one first, around a cycle, too."""
    doc, docs = _codes(table.column(part))
    ids, names = _codes(table.column("id"))
    prop, props = _codes(table.column("prop"))
    key = doc * len(names) + ids
    known = pc.is_valid(table.column("value")).to_numpy()
    style = pc.equal(table.column("scope"), "style").to_numpy()
    named = pc.is_valid(table.column("prop")).to_numpy()
    nodes, node_of = np.unique(key[style], return_inverse=True)
    at = np.flatnonzero(style)

    above = pc.index_in(table.column("parent"), value_set=names).to_numpy()
    above = np.where(pc.is_valid(table.column("parent")).to_numpy(), np.nan_to_num(above.astype(float), nan=-1), -1).astype(np.int64)[at]
    parent = np.full(len(nodes), -1, np.int64)
    said = pc.is_valid(table.column("parent")).to_numpy()[at]  # of different parents the last counts, also one that no style has
    parent[node_of[said]] = np.where(above[said] >= 0, doc[at][said] * len(names) + above[said], -1)
    place = np.minimum(np.searchsorted(nodes, parent), max(0, len(nodes) - 1))
    jump = np.where((parent >= 0) & (nodes[place] == parent), place, -1) if len(nodes) else parent
    most = int(np.bincount(nodes // len(names)).max()) if len(nodes) else 0
    jumps = []
    while (jump >= 0).any() and (1 << len(jumps)) <= most:
        jumps.append(jump)
        jump = np.where(jump >= 0, jump[jump], -1)

    stated = np.full((len(docs) + len(nodes), len(props)), -1, np.int32)  # the row that a document's defaults, and then a style, take a property's value from
    general = ~style & named
    for p in range(len(props)):
        mine = np.flatnonzero((prop == p) & named)
        if not len(mine):
            continue
        default = np.full(len(docs), -1, np.int32)
        of = mine[general[mine]]
        default[doc[of]] = of
        value = np.full(len(nodes), -1, np.int32)
        of = (prop[at] == p) & named[at] & known[at]
        value[node_of[of]] = at[of]
        for jump in jumps:
            open_ = np.flatnonzero((value < 0) & (jump >= 0))
            value[open_] = value[jump[open_]]
        stated[: len(docs), p] = default
        stated[len(docs) :, p] = np.where(value >= 0, value, default[nodes // len(names)] if len(nodes) else value)
    has = stated >= 0
    offsets = np.concatenate(([0], np.cumsum(has.sum(1)))).astype(np.int32)
    values = table.column("value").take(pa.array(stated[has])).combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    entries = pa.MapArray.from_arrays(pa.array(offsets), props.take(pa.array(np.nonzero(has)[1])), values)
    style_names = pa.concat_arrays([pa.nulls(len(docs), names.type), names.take(pa.array(nodes % len(names)))])
    return pa.table({part: docs.take(pa.array(np.concatenate((np.arange(len(docs)), nodes // len(names))))), "style": style_names, "props": entries})


def long_form(of: DataFrame, *names: str) -> DataFrame:
    """A row per property of props."""
    return of.select(*names, F.explode("props").alias("prop", "value"))



def scaled(nodes: DataFrame, part: str) -> DataFrame:
    """part, node, x, y, whole: the product of a node's scales and all its ancestors', and the nearest whole at or above it. nodes: part, node (int), parent (int or
    null; unknown ones end a chain), x, y, whole struct<width, height> (or null).

    One shuffle by document; each node is visited once, its products come from its parent's, at any depth.
    """

    def resolve(rows: list[tuple]) -> Iterator[tuple]:
        known = {r[1]: r for r in rows}
        found: dict[int, tuple] = {}
        for start in known:
            path, at = [], start
            while at in known and at not in found:
                path.append(at)
                found[at] = (1.0, 1.0, None)  # a cycle ends where it is met again
                at = known[at][2]
            x, y, whole = found.get(at, (1.0, 1.0, None))
            for node in reversed(path):
                _, _, _, own_x, own_y, own_whole = known[node]
                x, y, whole = x * own_x, y * own_y, own_whole or whole
                found[node] = (x, y, whole)
        for node, (x, y, whole) in found.items():
            yield rows[0][0], node, x, y, whole

    return stream_groups(nodes.select(part, "node", "parent", "x", "y", "whole"), [part], ["node"], resolve, f"{part} string, node int, x double, y double, whole struct<width:double,height:double>")
