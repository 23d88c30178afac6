"""Control trees as adjacency tables: traversal, visibility, validation, description, outline, display-scale repair.

A node is a row (capture, id, parent, depth, ord, ...). A capture has MAX_NODES nodes at most, so steps that carry state between parents
and children bring each capture together once, one exchange whatever the depth, and run on many captures at a time as arrays: a
level of all of them in one go. What needs neither parents nor children stays a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.functions.geometry import SCALES
from vitrail.functions.text import normalize
from vitrail.session import ship

#: Limits of a capture's tree.
MAX_DEPTH = 64
MAX_NODES = 5000
#: Roles that clip their descendants to their own box.
VIEWPORT_ROLES = ("list", "tree", "table", "datagrid")
#: Role names by control type, from 50000 upwards.
ROLES = (
    "button calendar checkbox combobox edit hyperlink image listitem list menu menubar menuitem progressbar radiobutton "
    "scrollbar slider spinner statusbar tab tabitem text toolbar tooltip tree treeitem custom group thumb datagrid dataitem "
    "document splitbutton window pane header headeritem table titlebar separator semanticzoom appbar"
).split()
#: Roles whose caption may repeat a container's text.
CAPTION_ROLES = ("button", "checkbox", "radiobutton", "hyperlink", "menuitem", "listitem", "treeitem", "tabitem", "headeritem", "text")


def role_of(role: Column, control_type: Column) -> Column:
    """The named role, else that of the control type, else custom."""
    names = F.array(*(F.lit(r) for r in ROLES))
    known = F.when(control_type.between(50000, 50000 + len(ROLES) - 1), F.get(names, control_type - 50000))
    return F.coalesce(F.when(role != "", role), known, F.lit("custom"))


#: Nodes that are worked on in one go, about: whole captures.
ROWS = 50_000


def whole_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive batches sorted by capture as tables that hold whole captures."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = pc.index(table["capture"], table["capture"][-1]).as_py()  # the last capture may go on in the next batch
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table


class Forest:
    """The trees of several captures as arrays: each node's parent (-1: none), and the rows of each level whose ancestors are all there.

    Rows are sorted by capture, depth, parent, ord and id, so that siblings follow one another in their order.
    """

    def __init__(self, table: pa.Table):
        said = table["capture"].cast(pa.string())
        name = lambda c: pc.binary_join_element_wise(said, table[c].cast(pa.string()), "\0")
        self.table, self.size = table, table.num_rows
        self.parent = pc.fill_null(pc.index_in(name("parent"), value_set=name("id").combine_chunks()), -1).to_numpy().astype(np.int64)

    def levels(self) -> list[np.ndarray]:
        depth = pc.fill_null(self.table["depth"], -1).to_numpy()
        if self.size and depth.max() > MAX_DEPTH:
            raise ValueError(f"the tree is deeper than {MAX_DEPTH}")
        there, out = np.zeros(self.size + 1, bool), []
        for d in range(int(depth.max(initial=-1)) + 1):
            rows = np.flatnonzero(depth == d)
            rows = rows[there[self.parent[rows]]] if d else rows
            there[rows] = True
            out.append(rows)
        return out

    def numbers(self, *names: str) -> np.ndarray:
        """Columns as doubles, nulls as NaN."""
        return np.column_stack([pc.fill_null(self.table[n].cast(pa.float64()), np.nan).to_numpy() for n in names])

    def flags(self, name: str, of_null: bool) -> np.ndarray:
        return pc.fill_null(self.table[name], of_null).to_numpy(zero_copy_only=False)

    def among(self, name: str, values: tuple[str, ...]) -> np.ndarray:
        return pc.fill_null(pc.is_in(self.table[name], value_set=pa.array(values)), False).to_numpy(zero_copy_only=False)


def over_captures(nodes: DataFrame, work: Callable[[Forest], pa.Table], schema: str) -> DataFrame:
    """Work on whole captures: one exchange by capture, one sort, and a function of arrays."""
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_captures(batches):
            yield from work(Forest(table)).to_batches()

    order = [c for c in ("capture", "depth", "parent", "ord", "id") if c in nodes.columns]
    return nodes.repartition("capture").sortWithinPartitions(*order).mapInArrow(run, schema)


def _schema(nodes: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields), *more])


def preorder_numbers(f: Forest, levels: list[np.ndarray]) -> np.ndarray:
    """Each node's number in preorder: its parent's, one, and the sizes of its elder siblings' subtrees."""
    size, number = np.ones(f.size + 1, np.int64), np.zeros(f.size + 1, np.int64)
    for rows in reversed(levels[1:]):
        np.add.at(size, f.parent[rows], size[rows])
    for d, rows in enumerate(levels):
        if not len(rows):
            break
        before = np.cumsum(size[rows]) - size[rows]  # of all rows of the level
        family = f.parent[rows] if d else np.arange(len(rows))
        first = np.concatenate([[True], family[1:] != family[:-1]])
        number[rows] = (number[f.parent[rows]] if d else 0) + 1 + before - before[first][np.cumsum(first) - 1]
    return number


def _numbered(table: pa.Table, numbers: np.ndarray, out: str) -> pa.Table:
    named = pa.array([f"n{k}" for k in numbers.tolist()], pa.string())
    return table.append_column(out, pa.array(numbers.astype(np.int32))).append_column("new_id", named)


def preorder(nodes: DataFrame, out: str = "preorder") -> DataFrame:
    """Number each capture's nodes from 1, parents first, children by ord; adds `out` and the renumbered id new_id (n1, n2, ...)."""

    def work(f: Forest) -> pa.Table:
        levels = f.levels()
        rows = np.sort(np.concatenate(levels)) if levels else np.zeros(0, int)
        return _numbered(f.table.take(pa.array(rows)), preorder_numbers(f, levels)[rows], out)

    return over_captures(nodes, work, _schema(nodes, f"`{out}` int", "new_id string"))


def visible(nodes: DataFrame, number: str | None = None) -> DataFrame:
    """Nodes that are seen: adds `shown` (false for nodes that are passed through for want of a box), and as `preorder` does `number` and new_id.

    An offscreen node hides its subtree. A node whose box lies outside the viewport hides its subtree; a node without a
    box is passed through. Lists, trees, tables and data grids become the viewport of what is below them.
    """

    def work(f: Forest) -> pa.Table:
        box = f.numbers("x", "y", "w", "h")
        low, high = box[:, :2], box[:, :2] + box[:, 2:]
        has = ~np.isnan(box[:, :2]).any(axis=1) & (box[:, 2:] > 0).all(axis=1)
        hidden, clips = f.flags("offscreen", True), f.among("role", VIEWPORT_ROLES)
        port = np.full((f.size + 1, 4), np.nan)  # corners of the viewport that each node hands down
        kept, shown = np.zeros(f.size + 1, bool), np.zeros(f.size, bool)
        levels = f.levels()
        for d, rows in enumerate(levels):
            up = f.parent[rows] if d else np.full(len(rows), -1)
            view = port[up]
            free = np.isnan(view).any(axis=1)
            meets = (np.minimum(high[rows], view[:, 2:]) > np.maximum(low[rows], view[:, :2])).all(axis=1)
            seen = has[rows] & (free | meets)
            shown[rows] = seen
            kept[rows] = ~hidden[rows] & (seen | ~has[rows]) & (kept[up] if d else True)
            port[rows] = np.where((has & clips)[rows, None], np.hstack([low, high])[rows], view)
        rows = np.flatnonzero(kept[:-1])
        table = f.table.take(pa.array(rows))
        table = _numbered(table, preorder_numbers(f, levels)[rows], number) if number else table
        return table.append_column("shown", pa.array(shown[rows]))

    return over_captures(nodes, work, _schema(nodes, *((f"`{number}` int", "new_id string") if number else ()), "shown boolean"))


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What the runtime validation rejects: capture, fault, n."""
    grouped = nodes.groupBy("capture", "id").agg(F.count("*").alias("n"))
    twice = grouped.where("n > 1").groupBy("capture").agg(F.count("*").alias("n")).withColumn("fault", F.lit("duplicate id"))
    shape = nodes.groupBy("capture").agg(
        F.count_if(F.col("id").isNull() | F.col("role").isNull()).alias("no id or role"),
        F.count_if((F.col("w") < 0) | (F.col("h") < 0) | F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull()).alias("bad rectangle"),
        F.greatest(F.count("*") - MAX_NODES, F.lit(0)).alias("too many nodes"),
        F.count_if(F.col("depth") > MAX_DEPTH).alias("too deep"),
    )
    long = shape.unpivot("capture", ["no id or role", "bad rectangle", "too many nodes", "too deep"], "fault", "n").where("n > 0")
    lost = edges.join(nodes.select("capture", F.col("id").alias("dst")), ["capture", "dst"], "left_anti").groupBy("capture").agg(F.count("*").alias("n"))
    lost = lost.withColumn("fault", F.lit("unresolved relationship"))
    return long.unionByName(twice).unionByName(lost).select("capture", "fault", F.col("n").cast("bigint").alias("n"))


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target was captured."""
    return edges.join(nodes.select("capture", F.col("id").alias("dst")), ["capture", "dst"], "left_semi").select(edges.columns)


def describe(label: Column, role: Column, **of: Column) -> Column:
    """The spoken description: its parts in a fixed order, joined by ', ', empty parts left out.

    of: protected, unredacted, value, checked, selected, expansion, enabled, read_only, focused, description, help,
    access_key, accelerator_key; those not given are absent.
    """
    said = lambda name, text: F.when(of[name], F.lit(text)) if name in of else F.lit(None).cast("string")
    text = lambda name: of.get(name, F.lit(None).cast("string"))
    hidden = of.get("protected", F.lit(False)) & ~of.get("unredacted", F.lit(False))
    value = F.when(~hidden & ~text("value").eqNullSafe(label), text("value"))
    checked = F.when(text("checked").isin("unchecked", "checked", "mixed"), text("checked"))
    opened = text("expansion")
    expansion = F.when(opened == "partial", "partly expanded").when(opened.isin("collapsed", "expanded", "leaf"), opened)
    parts = [
        label, role, said("protected", "password field"), value, checked, said("selected", "selected"), expansion,
        F.when(~of["enabled"], "disabled") if "enabled" in of else F.lit(None).cast("string"), said("read_only", "read only"), said("focused", "focused"),
        *(text(k) for k in ("description", "help", "access_key", "accelerator_key")),
    ]
    return F.array_join(F.filter(F.array(*(p.cast("string") for p in parts)), lambda p: p.isNotNull() & (p != "")), ", ")


def html_escape(s: Column, quote: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quote else ())):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def outline(nodes: DataFrame, label: str) -> DataFrame:
    """Each capture's nodes as a nested list: capture, html. Folded from the deepest level up.

    nodes: seen nodes and those passed through (`shown`), with the text `label`. A node that isn't shown is replaced by its children.
    """
    kind = nodes.schema["capture"].dataType.simpleString()

    def work(f: Forest) -> pa.Table:
        said, shown = f.table["said"].to_pylist(), f.flags("shown", False).tolist()
        inner: list[list[str]] = [[] for _ in range(f.size + 1)]
        tops: list[tuple[int, str]] = []
        for d, rows in reversed(list(enumerate(f.levels()))):
            for k, up in zip(rows.tolist(), f.parent[rows].tolist()):
                below = "".join(inner[k])
                html = f"<li>{said[k] or ''}{f'<ul>{below}</ul>' if below else ''}</li>" if shown[k] else below
                if d:
                    inner[up].append(html)
                else:
                    tops.append((k, html))
        rows = pa.array([k for k, _ in tops], pa.int64())
        return pa.table({"capture": f.table["capture"].take(rows), "html": pa.array([f"<ul>{h}</ul>" for _, h in tops], pa.string())})

    narrow = nodes.select("capture", "id", "parent", "depth", "ord", "shown", html_escape(F.col(label)).alias("said"))
    return over_captures(narrow, work, f"capture {kind}, html string")


def _keys(nodes: DataFrame) -> str:
    return f"capture {nodes.schema['capture'].dataType.simpleString()}, id {nodes.schema['id'].dataType.simpleString()}"


def repeated_below(nodes: DataFrame, label: str = "label") -> DataFrame:
    """Nodes whose text a descendant's caption repeats: capture, id."""
    texts = nodes.select("capture", "id", "parent", "depth", "ord", "role", normalize(F.col(label)).alias("said"))

    def work(f: Forest) -> pa.Table:
        code = pc.fill_null(f.table["said"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        blank = pc.fill_null(pc.equal(f.table["said"], ""), True).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(f.among("role", CAPTION_ROLES) & ~blank)
        at, hit = f.parent[rows], np.zeros(f.size, bool)
        while len(rows):
            rows, at = rows[at >= 0], at[at >= 0]
            same = code[at] == code[rows]
            hit[at[same]] = True
            at = f.parent[at]
        return f.table.select(["capture", "id"]).filter(pa.array(hit))

    return over_captures(texts, work, _keys(nodes))


def below_role(nodes: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Strict descendants of nodes with one of the roles (title bars for chrome, items for their edits): capture, id."""

    def work(f: Forest) -> pa.Table:
        top, below = f.among("role", roles), np.zeros(f.size + 1, bool)
        for d, rows in enumerate(f.levels()):
            if d:
                below[rows] = (top | below[:-1])[f.parent[rows]]
        return f.table.select(["capture", "id"]).filter(pa.array(below[:-1]))

    return over_captures(nodes.select("capture", "id", "parent", "depth", "ord", "role"), work, _keys(nodes))


def table_cells(nodes: DataFrame, rows: tuple[str, ...] = ("listitem", "dataitem"), cells: tuple[str, ...] = ("edit",)) -> DataFrame:
    """Cells of tables: controls of some roles below rows of lists and grids: capture, id."""
    below = below_role(nodes, rows)
    return nodes.where(F.col("role").isin(*cells)).select("capture", "id").join(below, ["capture", "id"], "left_semi")


def private(nodes: DataFrame) -> DataFrame:
    """Controls whose contents must not be told: protected ones, what is below them, and what lies in their boxes: capture, id."""
    from vitrail.operators.spatial import containing_pairs

    def work(f: Forest) -> pa.Table:
        own, below = f.flags("protected", True), np.zeros(f.size + 1, bool)
        for d, rows in enumerate(f.levels()):
            below[rows] = own[rows] | (below[f.parent[rows]] if d else False)
        return f.table.select(["capture", "id"]).filter(pa.array(below[:-1]))

    inherited = over_captures(nodes.select("capture", "id", "parent", "depth", "ord", "protected"), work, _keys(nodes))
    boxes = nodes.where((F.col("w") > 0) & (F.col("h") > 0))
    inside = containing_pairs(boxes.where("protected"), boxes, ["id"], ["id"], 2).select("capture", F.col("b_id").alias("id"))
    return inherited.unionByName(inside).distinct()


def hoist(nodes: DataFrame, dropped: DataFrame) -> DataFrame:
    """Nodes without the dropped ones; children of a dropped node go up to its nearest kept ancestor.

    nodes: capture, id, parent. dropped: capture, id.
    """
    marked = nodes.join(dropped.select("capture", "id").distinct().withColumn("_gone", F.lit(True)), ["capture", "id"], "left")

    def work(f: Forest) -> pa.Table:
        gone = np.append(f.flags("_gone", False), False)
        at = f.parent.copy()
        while gone[at].any():
            at = np.where(gone[at], f.parent[at], at)
        ids = f.table["id"].combine_chunks()
        kept = np.flatnonzero(~gone[:-1])
        # a parent that isn't among the nodes is kept as it was given
        lost = (f.parent < 0)[kept]
        new = ids.take(pa.array(np.where(at < 0, 0, at)[kept], mask=(at < 0)[kept]))
        new = pc.if_else(pa.array(lost), f.table["parent"].combine_chunks().take(pa.array(kept)), new)
        table = f.table.take(pa.array(kept))
        return table.set_column(table.column_names.index("parent"), "parent", new).select(given)

    given = nodes.columns
    return over_captures(marked, work, _schema(nodes))


def _scale(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For rows of sizes (w, h) the standard display scale by which `raw` comes within two pixels of `target`, the smallest; NaN if none."""
    scales = np.array(SCALES)
    fits = (np.abs(target[:, None] - raw[:, None] * scales[:, None]) <= 2).all(axis=2)
    may = (target.min(axis=1) > 0) & (raw[:, 0] >= 100) & (raw[:, 1] >= 12) & fits.any(axis=1)
    return np.where(may, scales[fits.argmax(axis=1)], np.nan)


def repair_scale(nodes: DataFrame) -> DataFrame:
    """Boxes of mixed display scales made one: adds rx, ry, rw, rh (double) and recovered.

    Scale and shift are handed down. Below a window or pane, a pane, list or custom control whose size is a standard
    scale away from its parent's takes the parent's box. Then list rows are scaled about the list's corner if all headers
    of the list agree on a scale: headers stand two below their list, in a window of it.
    """

    def work(f: Forest) -> pa.Table:
        raw = f.numbers("x", "y", "w", "h")
        may, under = f.among("role", ("pane", "list", "custom")), np.append(f.among("role", ("window", "pane")), False)
        window, is_list, item = (f.among("role", (r,)) for r in ("window", "list", "listitem"))
        scale, shift = np.ones(f.size + 1), np.zeros((f.size + 1, 2))
        out, factor = np.full((f.size, 4), np.nan), np.full(f.size, np.nan)
        levels = f.levels()
        for d, rows in enumerate(levels):
            up = f.parent[rows] if d else np.full(len(rows), -1)
            box = raw[rows] * scale[up, None]
            box[:, :2] += shift[up]
            fix = np.full(len(rows), np.nan)
            if d:
                fix = np.where(under[up] & may[rows], _scale(out[up, 2:], box[:, 2:]), np.nan)
            given = ~np.isnan(fix)
            scale[rows] = scale[up] * np.where(given, fix, 1)
            shift[rows] = shift[up]
            if d:
                shift[rows[given]] = out[up[given], :2] - raw[rows[given], :2] * scale[rows[given], None]
                box[given] = out[up[given]]
                told = given & window[up]
                factor[rows[told]] = fix[told]
            out[rows] = box
        reached = np.concatenate(levels) if levels else np.zeros(0, int)
        # lists whose headers agree
        heads = np.flatnonzero(~np.isnan(factor))
        owner = f.parent[f.parent[heads]]  # the header's window, then its list
        heads, owner = heads[owner >= 0], owner[owner >= 0]
        low, high = np.full(f.size + 1, np.inf), np.full(f.size + 1, -np.inf)
        np.minimum.at(low, owner, factor[heads])
        np.maximum.at(high, owner, factor[heads])
        agreed = np.append(is_list, False) & (high - low < 0.01) & (high > 0)
        rows = np.flatnonzero(item & agreed[f.parent] & (f.parent >= 0))
        corner, by = out[f.parent[rows], :2], low[f.parent[rows], None]
        out[rows] = np.hstack([corner + (out[rows, :2] - corner) * by, out[rows, 2:] * by])
        kept = np.sort(reached)
        table = f.table.take(pa.array(kept))
        for k, c in enumerate(("rx", "ry", "rw", "rh")):
            table = table.append_column(c, pa.array(out[kept, k], from_pandas=True))
        moved = (out != raw).any(axis=1)[kept]
        return table.append_column("recovered", pa.array(moved, mask=np.isnan(raw[kept]).any(axis=1)))

    return over_captures(nodes, work, _schema(nodes, *(f"{c} double" for c in ("rx", "ry", "rw", "rh")), "recovered boolean"))
