from quillspark.operators import structure

NODES = "doc_id int, node int, parent int, child_pos int, role string, has_alt boolean, mcids array<int>"


def test_order_and_owned_content(spark):
    rows = [
        (1, 1, None, 0, "document", False, []), (1, 2, 1, 0, "Figure", False, [1]), (1, 3, 2, 0, "section", True, [2]), (1, 4, 3, 0, "span", True, [3]), (1, 5, 3, 1, "span", False, [4, 2]),
        (1, 6, 2, 1, "formula", False, [5]), (1, 7, 1, 1, "p", False, [6]), (1, 8, 9, 0, "loop", False, []), (1, 9, 8, 0, "loop", False, []), (2, 1, None, 0, "formula", False, None),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    order = [r["node"] for r in structure.reachable(nodes).where("doc_id = 1").orderBy("depth", "path").collect()]
    assert order == [1, 2, 7, 3, 6, 4, 5]
    owned = {(r["doc_id"], r["item"]): r["mcids"] for r in structure.owned_content(nodes).collect()}
    assert owned == {(1, 2): [1, 2, 4], (1, 6): [5], (2, 1): []}


def test_roles_follow_their_map_and_cycles_end(spark):
    pairs = spark.createDataFrame([(1, "/Pic", "Fig"), (1, "Fig", "/Figure"), (1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (2, "Pic", "Formula")], "doc_id int, role string, to string")
    rows = spark.createDataFrame([(1, "Pic"), (1, " /FIG"), (1, "P"), (1, "a"), (1, "b"), (1, None), (2, "Pic"), (3, "Pic")], "doc_id int, role string")
    from pyspark.sql import functions as F

    got = rows.join(structure.role_maps(pairs), "doc_id", "left").select("doc_id", "role", structure.standard_role(F.col("role"), F.col("mapped")).alias("s")).collect()
    assert {(r.doc_id, r.role, r.s) for r in got} == {(1, "Pic", "figure"), (1, " /FIG", "figure"), (1, "P", "p"), (1, "a", "b"), (1, "b", "b"), (1, None, ""), (2, "Pic", "formula"), (3, "Pic", "pic")}


def test_tree_inventory_without_content_or_nodes(spark):
    schema = "doc_id int, node int, parent int, child_pos int, role string, is_element boolean, alt string, page int, mcids array<int>, box struct<x0: double, y0: double, x1: double, y1: double>"
    box = (0.0, 0.0, 306.0, 396.0)
    rows = [(1, 1, None, 0, "Figure", True, " a\tb ", 1, [1], box), (1, 2, 1, 0, "Formula", True, None, 1, [2], None), (1, 3, 1, 1, None, False, "x", 1, [], None), (1, 4, 3, 0, "Figure", True, "", 1, [3], box), (2, 1, None, 0, None, True, None, None, None, None), (2, 2, 1, 0, "Figure", None, None, None, None, box)]
    content = spark.createDataFrame([(1, 1, 2, "paint", 0.0, 0.0, 61.2, 79.2), (1, 2, 2, "paint", 0.0, 0.0, 1.0, 1.0)], "doc_id int, page int, mcid int, kind string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id int, page int, width double, height double")
    pairs = spark.createDataFrame([], "doc_id int, role string, to string")
    got = {(r.doc_id, r.id, r.node, r.alt_text, r.label, tuple(r.preview_box) if r.preview_box else None) for r in structure.tree_inventory(spark.createDataFrame(rows, schema), pairs, content, pages).collect()}
    # node 4 is below a node that is no element, so it is no item; but a figure below a figure all the same
    assert got == {(1, 0, 2, "", "Formula", (0.0, 0.9, 0.1, 1.0)), (2, 0, 2, "", "Figure", None)}
    assert structure.tree_inventory(spark.createDataFrame([], schema), pairs, content, pages).collect() == []
