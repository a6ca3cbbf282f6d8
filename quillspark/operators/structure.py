"""Structure trees of tagged pages: order of the nodes, roles, the marked content that a node owns, and the inventory of what should be described.

Nodes: doc_id, node, parent (null at the top), child_pos, role, has_alt, mcids. All walks go level by level with one join a level, over all documents at once; trees are as
deep as a document's nesting, a few dozen levels at most, and a step that finds nothing new ends the walk, so cycles end it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.functions import visual
from quillspark.session import cut

#: Roles whose nodes are items of their own: fixed values.
TARGETS = ("figure", "formula")


def _walk(start: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """start and all that its rows reach. start has keys, at, depth, path; edges: doc_id, at, next, child_pos, passes (from the first level), passes_below."""
    seen = frontier = cut(start)
    while True:
        onward = frontier.join(edges, ["doc_id", "at"]).where(F.when(F.col("depth") == 0, F.col("passes")).otherwise(F.col("passes_below")))
        onward = onward.select(*keys, F.col("next").alias("at"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child_pos")).alias("path"))
        onward = onward.groupBy(*keys, "at").agg(F.min(F.struct("depth", "path")).alias("m")).select(*keys, "at", "m.depth", "m.path")
        frontier = cut(onward.join(seen.select(*keys, "at"), [*keys, "at"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def _edges(nodes: DataFrame) -> DataFrame:
    always = F.lit(True)
    return nodes.where("parent is not null").select("doc_id", F.col("parent").alias("at"), F.col("node").alias("next"), "child_pos", always.alias("passes"), always.alias("passes_below"))


def reachable(nodes: DataFrame) -> DataFrame:
    """doc_id, node, depth, path: what can be reached from the top, each node once. Breadth first is the order of (depth, path)."""
    top = nodes.where("parent is null").select("doc_id", F.col("node").alias("at"), F.lit(0).alias("depth"), F.array("child_pos").alias("path"))
    return _walk(top, _edges(nodes), ["doc_id"]).withColumnRenamed("at", "node")


def owned_content(nodes: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """doc_id, item, mcids: for each node of a target role the marked content of it and of what lies below it, without what lies below another target or, from the second level on, below a node with a text
    of its own."""
    role = F.lower(F.coalesce("role", F.lit("")))
    below = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("at"), F.col("node").alias("next"), "child_pos", (~role.isin(*targets)).alias("passes"), (~role.isin(*targets) & ~F.coalesce("has_alt", F.lit(False))).alias("passes_below"))
    start = nodes.where(role.isin(*targets)).select("doc_id", F.col("node").alias("item"), F.col("node").alias("at"), F.lit(0).alias("depth"), F.array("child_pos").alias("path"))
    found = _walk(start, below, ["doc_id", "item"]).select("doc_id", "item", F.col("at").alias("node"))
    content = found.join(nodes.select("doc_id", "node", "mcids"), ["doc_id", "node"])
    return content.groupBy("doc_id", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("mcids", F.array().cast("array<int>")))))).alias("mcids"))


def plain_role(role: Column) -> Column:
    return F.lower(F.ltrim(F.trim(F.coalesce(role, F.lit(""))), F.lit("/")))


def standard_role(role: Column, mapped: Column) -> Column:
    """A role followed through a map of roles until it isn't mapped, or comes round to one it has been. Null maps map nothing."""
    start = F.struct(plain_role(role).alias("now"), F.array().cast("array<string>").alias("seen"))

    def step(at: Column, _: Column) -> Column:
        to = F.get(F.map_values(F.map_filter(mapped, lambda k, v: k == at["now"])), 0)
        on = to.isNotNull() & ~F.array_contains(at["seen"], at["now"])
        return F.when(on, F.struct(to.alias("now"), F.array_append(at["seen"], at["now"]).alias("seen"))).otherwise(at)

    rounds = F.sequence(F.lit(0), F.coalesce(F.size(F.map_keys(mapped)), F.lit(0)))
    return F.aggregate(rounds, start, step, lambda at: at["now"])


def role_maps(pairs: DataFrame) -> DataFrame:
    """doc_id, mapped: a document's map of roles, from doc_id, role and to. A role that is mapped twice goes to the least."""
    rows = pairs.select("doc_id", plain_role(F.col("role")).alias("role"), plain_role(F.col("to")).alias("to")).groupBy("doc_id", "role").agg(F.min("to").alias("to"))
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "to"))).alias("mapped"))


def tree_inventory(nodes: DataFrame, pairs: DataFrame, content: DataFrame, pages: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """The figures and formulas of structure trees, in breadth-first order, with their texts and places.

    nodes: doc_id, node, parent, child_pos, role, is_element (else it and what lies below it only by way of it is no part of the tree), alt, page, mcids, box (declared, in points with y upwards);
    pairs: doc_id, role, to; content: doc_id, page, mcid, kind, x0, y0, x1, y1 (of content_streams.components()); pages: doc_id, page, width, height.

    An item is a node of a target role without a node of the same role below it. Its content is what it owns (owned_content) on its own page. Its preview is what is drawn, for a formula; for a
    figure the declared box, unless what is drawn tells its place better; else the other one. In parts of the page, y downwards, held within it."""
    nodes = nodes.join(role_maps(pairs), "doc_id", "left").withColumn("standard", standard_role(F.col("role"), F.col("mapped"))).drop("mapped")
    nodes = cut(nodes.withColumns({"alt": T.collapse(F.regexp_replace(F.coalesce("alt", F.lit("")), "\\x00", "")), "raw_role": plain_role(F.col("role"))}))
    tree = nodes.where(F.coalesce("is_element", F.lit(False)) | (F.col("raw_role") != ""))
    order = reachable(tree)

    with_targets = nodes.select("doc_id", "node", "parent", "child_pos", F.col("standard").alias("role"), (F.col("alt") != "").alias("has_alt"), "mcids")
    owned = owned_content(with_targets, targets).withColumnRenamed("item", "node")
    outer = _above_their_own(with_targets, targets)
    items = order.join(tree, ["doc_id", "node"]).where(F.col("standard").isin(*targets)).join(outer, ["doc_id", "node"], "left_anti")

    drawn = items.select("doc_id", "node", "page").join(owned, ["doc_id", "node"]).withColumn("mcid", F.explode("mcids")).join(content, ["doc_id", "page", "mcid"])
    boxes = drawn.groupBy("doc_id", "node").agg(G.union(F.struct("x0", "y0", "x1", "y1")).alias("drawn"))
    rows = items.join(boxes, ["doc_id", "node"], "left").join(pages, ["doc_id", "page"], "left")
    wide, high = F.col("width"), F.col("height")
    declared = F.when(G.area(F.col("box")) > 0, F.col("box"))
    rows = rows.withColumn("declared", declared)
    formula, declared = F.col("standard") == "formula", F.col("declared")
    rows = cut(rows.withColumn("better", visual.prefers_content(declared, F.col("drawn"), F.greatest(F.lit(1.0), wide * high))))  # else its terms are put into all four sides
    chosen = F.when(formula | F.col("better"), F.coalesce("drawn", declared)).otherwise(F.coalesce(declared, F.col("drawn")))
    rows = cut(rows.withColumn("chosen", chosen))
    chosen = F.col("chosen")
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    shown = G.from_pdf_space(chosen, wide, high)
    preview = F.when(chosen.isNotNull() & wide.isNotNull(), G.box(*(held(shown[c]) for c in ("x0", "y0", "x1", "y1"))))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("depth", "path")) - 1
    has = F.col("alt") != ""
    return rows.select(
        "doc_id", place.cast("long").alias("id"), "node", F.when(formula, "Formula").otherwise("Figure").alias("type"), F.when(formula, "equation").otherwise("image").alias("role"),
        F.col("raw_role").alias("struct_role"), F.col("standard").alias("standard_role"), "page", has.alias("has_alt_text"), F.col("alt").alias("alt_text"),
        F.when(has, "existing").otherwise("missing").alias("alt_source"), F.when(has, F.col("alt")).when(formula, "Formula").otherwise("Figure").alias("label"),
        F.col("declared").alias("declared_box"), F.col("drawn").alias("content_box"), preview.alias("preview_box"),
    )


def _above_their_own(nodes: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """doc_id, node: nodes of a target role with a node of the same role below. Targets look upwards, level by level, and a role looks at a node once."""
    up = nodes.where("parent is not null").select("doc_id", "node", "parent")
    roles = nodes.where(F.col("role").isin(*targets)).select("doc_id", "node", "role")
    looking = seen = cut(roles.join(up, ["doc_id", "node"]).select("doc_id", "role", F.col("parent").alias("node")).distinct())
    while True:
        looking = looking.join(up, ["doc_id", "node"]).select("doc_id", "role", F.col("parent").alias("node")).distinct()
        looking = cut(looking.join(seen, ["doc_id", "role", "node"], "left_anti"))
        if looking.isEmpty():
            return seen.join(roles, ["doc_id", "node", "role"], "left_semi").select("doc_id", "node").distinct()
        seen = cut(seen.unionByName(looking))
