"""Collectors' raw trees as unified controls: renumbering, affine boxes, role tables, redaction, edges that resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions.geometry import Box, affine_box
from vitrail.operators.trees import preorder, prune_dangling

# Roles by a provider's own names, as published by the accessibility interfaces.
ROLE_TABLES = {
    "atspi": {
        "push button": "button", "toggle button": "button", "check box": "checkbox", "combo box": "combobox", "entry": "edit", "password text": "edit", "link": "hyperlink", "image": "image", "icon": "image",
        "list item": "listitem", "list": "list", "list box": "list", "menu": "menu", "menu bar": "menubar", "menu item": "menuitem", "progress bar": "progressbar", "radio button": "radiobutton", "scroll bar": "scrollbar",
        "slider": "slider", "spin button": "spinner", "status bar": "statusbar", "page tab list": "tab", "page tab": "tabitem", "label": "text", "text": "text", "static": "text", "tool bar": "toolbar", "tool tip": "tooltip",
        "tree": "tree", "tree item": "treeitem", "table": "table", "table cell": "dataitem", "document frame": "document", "frame": "window", "dialog": "window", "panel": "pane", "filler": "pane", "separator": "separator",
    },
    "ax": {
        "AXButton": "button", "AXCheckBox": "checkbox", "AXComboBox": "combobox", "AXPopUpButton": "combobox", "AXTextField": "edit", "AXTextArea": "edit", "AXLink": "hyperlink", "AXImage": "image", "AXList": "list",
        "AXMenu": "menu", "AXMenuBar": "menubar", "AXMenuItem": "menuitem", "AXProgressIndicator": "progressbar", "AXRadioButton": "radiobutton", "AXScrollBar": "scrollbar", "AXSlider": "slider", "AXTabGroup": "tab",
        "AXStaticText": "text", "AXToolbar": "toolbar", "AXOutline": "tree", "AXRow": "dataitem", "AXTable": "table", "AXWindow": "window", "AXGroup": "group", "AXSplitter": "separator",
    },
}


def role_table(spark: SparkSession) -> DataFrame:
    """The tables above as rows (provider, native, role): a dimension of fixed size."""
    return spark.createDataFrame([(p, n, r) for p, t in ROLE_TABLES.items() for n, r in t.items()], "provider string, native string, role string")


def with_roles(nodes: DataFrame, default: str = "custom") -> DataFrame:
    """Named roles for (provider, native); unknown ones get the default."""
    table = F.broadcast(role_table(nodes.sparkSession))
    return nodes.join(table, ["provider", "native"], "left").withColumn("role", F.coalesce("role", F.lit(default)))


def normalise(nodes: DataFrame, edges: DataFrame, to_pixels: Column, unredacted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw controls to unified ones: (nodes, edges).

    Ids become n1, n2, ... in preorder, boxes pixels under the affine map, and a protected control's (or, where that is
    unknown, a possibly protected one's) value and text are dropped. Edges are renamed, those without a captured target dropped.
    nodes: capture, id, parent, depth, ord, x, y, w, h, protected (null: unknown), value, text.
    """
    numbered = preorder(nodes)
    box = affine_box(Box.of(), to_pixels)
    hidden = F.lit(not unredacted) & F.coalesce("protected", F.lit(True))
    names = numbered.select("capture", F.col("id").alias("_old"), "new_id")
    parents = names.select("capture", F.col("_old").alias("parent"), F.col("new_id").alias("new_parent"))
    own = numbered.join(parents, ["capture", "parent"], "left").select(
        "capture", F.col("new_id").alias("id"), F.col("new_parent").alias("parent"), "depth", "ord", "preorder",
        box.x.alias("x"), box.y.alias("y"), box.w.alias("w"), box.h.alias("h"), "protected", F.when(~hidden, F.col("value")).alias("value"), F.when(~hidden, F.col("text")).alias("text"),
    )
    kept = prune_dangling(edges, nodes)
    src = names.select("capture", F.col("_old").alias("src"), F.col("new_id").alias("s"))
    dst = names.select("capture", F.col("_old").alias("dst"), F.col("new_id").alias("d"))
    renamed = kept.join(src, ["capture", "src"]).join(dst, ["capture", "dst"]).select("capture", F.col("s").alias("src"), "relation", F.col("d").alias("dst"))
    return own, renamed
