"""Every registered query against its SQL at the smallest scale, plans, and the parts' independence."""

import ast
import pathlib

import duckdb
import pytest

import vitrail
from vitrail import registry
from vitrail.functions import geometry
from vitrail.operators import spatial
from vitrail.plans import inputs

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(vitrail.__file__).parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(df, want):
    got = df.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).to_numpy().tolist() for x in (got, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]).df())


#: Queries that SQL can't state, and the test of the rule that they apply (tests/test_greedy.py, tests/test_reconcile.py).
TESTED = {"near_suppression", "ground_truth_match", "duplicate_lines", "text_recall_greedy", "second_pass_merge", "anchored_rows", "icon_groups_replay", "local_text_checks", "fidelity_regions", "caption_places"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == TESTED


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["box_overlap_pairs", "box_contains_pairs", "box_smallest_container", "box_anti_overlap", "caption_pairing", "icon_block_candidates"])
def test_spatial_joins_have_no_nested_loop(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tile_size_does_not_change_pairs(spark):
    boxes = inputs.boxes(spark, SF)
    counts = {t: sorted(map(tuple, spatial.box_pairs(boxes, boxes, ["id"], ["id"], tile=t, grow=g).select("a_id", "b_id").collect())) for t, g in ((32, 7), (128, 7), (700, 7))}
    assert len(set(map(str, counts.values()))) == 1
    brute = [(a.id, b.id) for a in boxes.collect() for b in boxes.collect() if a.capture == b.capture and a.x - 7 < b.x + b.w and b.x < a.x + a.w + 7 and a.y - 7 < b.y + b.h and b.y < a.y + a.h + 7] if boxes.count() < 2000 else None
    if brute is not None:
        assert sorted(brute) == counts[128]


def test_pairs_by_place_are_those_of_boxes_and_compare_places(spark):
    import random

    from pyspark.sql import functions as F

    from vitrail.functions.geometry import iou

    rnd = random.Random(5)
    spots = [(rnd.randrange(-100, 300), rnd.randrange(300), rnd.choice((0, 9, 60, 150)), rnd.choice((8, 40, 140))) for _ in range(25)]
    rows = [(k % 2, k // 2 if k % 9 else 7, *spots[rnd.randrange(25)]) for k in range(300)] + [(None, 1, 0, 0, 9, 9), (0, None, 0, 0, 9, 9), (1, 2, None, 0, 9, 9)]
    boxes = spark.createDataFrame(rows, "capture bigint, id bigint, x bigint, y bigint, w bigint, h bigint")
    measure = lambda a, b: F.round(iou(a, b), 6)
    slow = spatial.box_pairs(boxes, boxes, ["id"], ["id"]).where("a_id < b_id").select("capture", "a_id", "b_id", measure(*(geometry.Box.of(s) for s in ("a_", "b_"))).alias("iou")).where("iou > 0.1")
    fast = spatial.pairs_by_place(boxes, "id", measure, 0.1, "iou")
    want = sorted(map(tuple, slow.collect()))
    assert sorted(map(tuple, fast.collect())) == want and len(want) > 500 and any(r[3] == 1 for r in want)
    plan = registry.QUERIES["box_iou_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(a_keys") < plan.index("Join Inner") < plan.index("collect_list") and "NestedLoop" not in plan


def test_nothing_outside_llm_imports_it():
    for f in ROOT.rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), f


def test_svg_documents(spark):
    from pyspark.sql import functions as F

    from vitrail.operators import svg

    nodes = spark.createDataFrame(
        [("a", 0, "rect", 10, 10, 100, 60, "#101010", "", None), ("a", 1, "text", 20, 20, 40, 12, "#202020", "", "A & B"), ("a", 2, "radio", 70, 20, 13, 13, "#ff0000", "", None)],
        "capture string, ord int, kind string, x int, y int, w int, h int, color string, background string, text string",
    )
    doc = svg.to_svg(nodes, spark.createDataFrame([("a", 200, 100), ("b", 5, 5)], "capture string, width int, height int")).orderBy("capture").collect()
    assert "A &amp; B" in doc[0].svg and 'fill="#ffffff" data-kind="text"' in doc[0].svg and "<circle" in doc[0].svg
    assert doc[0].svg.index("<rect x") < doc[0].svg.index("<circle") < doc[0].svg.index("<text")
    assert doc[1].svg.endswith("</svg>\n")
    assert '"text":"A & B"' in svg.scene_json(nodes.withColumn("confidence", F.lit(0.12345))).first().json


def test_catalogue_feed_takes_each_row_once(spark, tmp_path):
    from vitrail.streaming import feed

    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(part, "hash string, v int").coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema("hash string, v int").parquet(source)
        feed.keep_catalogue(rows, out, mark).awaitTermination()
    got = feed.known(spark, out, "hash string, v int").collect()
    assert sorted(r.hash for r in got) == ["a", "b", "c"]
