"""Predicates over visual items and their boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions.text import collapse, has_section_word, is_effectively_empty


def is_package_visual(target: Column) -> Column:
    """A part of the package that holds media or an embedded object."""
    plain = F.lower(F.ltrim(F.replace(F.trim(F.coalesce(target, F.lit(""))), F.lit("\\"), F.lit("/")), F.lit("/")))
    return plain.startswith("word/media/") | plain.startswith("word/embeddings/")


def is_heading_label(label: Column) -> Column:
    text = F.lower(collapse(label))
    return has_section_word(text) & text.rlike(r"^[0-9]+(?:[-.][0-9]+)*\b")


def is_real_item(role: Column, label: Column, has_text: Column, m: Column) -> Column:
    """Whether an element is a visual item that belongs in the inventory. m: a struct of target, image_target, ole_target, rel_id, docpr_name, prog_id, math_source,
    width_pt, height_pt. Rejected are section headings, remains of conversions, images without any sign of one, and formulas that have no visual node."""
    named = collapse(m["docpr_name"]) != ""
    wide, high = F.coalesce(m["width_pt"] > 0, F.lit(False)), F.coalesce(m["height_pt"] > 0, F.lit(False))
    texted = F.coalesce(has_text, F.lit(False)) & ~is_effectively_empty(label)
    in_package = F.lower(F.ltrim(F.trim(F.coalesce(m["target"], F.lit(""))), F.lit("/"))).startswith("word/")
    signal = in_package | (F.trim(F.coalesce(m["rel_id"], F.lit(""))) != "") | named | wide | high
    bare = is_effectively_empty(label) | F.lower(collapse(label)).isin("image", "equation")
    metafile = F.lower(F.coalesce(m["target"], m["image_target"], F.lit(""))).endswith(".emf")
    dot = F.coalesce((m["width_pt"] <= 2) & (m["height_pt"] <= 2), F.lit(False))
    remains = (role == "image") & ~texted & ((metafile & ~named) | (bare & ~named & (~wide | ~high | dot)))
    image = ~(bare & ~texted & ~signal) & (is_package_visual(m["target"]) | is_package_visual(m["image_target"]) | is_package_visual(m["ole_target"]) | signal)
    equation = F.when(m["math_source"] == "omml", False).when(F.coalesce(m["prog_id"], F.lit("")) != "", True).otherwise(is_package_visual(m["image_target"]) | is_package_visual(m["ole_target"]) | signal)
    return ~is_heading_label(label) & ~remains & F.when(role == "image", image).when(role == "equation", equation).otherwise(False)


def is_rule(b: Column, page_width: Column, page_height: Column) -> Column:
    """A thin line across the page, or down it: at most 6 points thick."""
    return ((G.height(b) <= 6) & (G.width(b) >= page_width * 0.45)) | ((G.width(b) <= 6) & (G.height(b) >= page_height * 0.28))


def is_frame(b: Column, median_area: Column, page_width: Column, page_height: Column) -> Column:
    """A box of 18 times the median area or more that takes up most of the page."""
    return (median_area > 0) & (G.area(b) >= median_area * 18) & (G.width(b) >= page_width * 0.55) & (G.height(b) >= page_height * 0.4)


def prefers_content(declared: Column, content: Column, page_area: Column) -> Column:
    """Whether what is drawn tells a figure's place better than the declared box: little of it lies inside, or the box is much larger, or of another shape."""
    one = lambda x: F.greatest(F.lit(1.0), x)
    dw, dh, cw, ch = one(G.width(declared)), one(G.height(declared)), one(G.width(content)), one(G.height(content))
    da, ca = G.area(declared), G.area(content)
    shape = lambda w, h: F.greatest(w, h) / F.least(w, h)
    valid = lambda b: b.isNotNull() & (G.area(b) > 0)
    better = (
        (G.intersection_area(declared, content) < 0.7 * ca)
        | (dw <= cw * 0.72) | (dh <= ch * 0.72)
        | (shape(dw, dh) >= shape(cw, ch) * 2.5) | (shape(cw, ch) >= shape(dw, dh) * 2.5)
        | ((da / page_area >= 0.40) & (ca / page_area <= 0.32))
        | ((da >= ca * 3) & (ca >= 250))
    )
    return F.when(~valid(content), False).when(~valid(declared), True).otherwise(better)
