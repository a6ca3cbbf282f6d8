"""What repairs and styles cost as tables grow."""

import colorsys
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import colour
from quillspark.operators import contrast
from quillspark.plans import queries


def light(rgb):
    return float(np.where(rgb <= 0.03928, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4) @ np.array([0.2126, 0.7152, 0.0722]))


def plain_repair(a, b):
    start, below = (np.array([int(x[i : i + 2], 16) / 255 for i in (1, 3, 5)]) for x in (a, b))
    ratio = lambda x: (max(light(x), light(below)) + 0.05) / (min(light(x), light(below)) + 0.05)
    hue, lightness, strength = colorsys.rgb_to_hls(*start)
    way = -colour.STEP if light(below) > 0.5 else colour.STEP
    tones = [np.array(colorsys.hls_to_rgb(hue, min(1, max(0, lightness + way * k)), min(1, strength * part))) for part in colour.STRENGTHS for k in range(1, colour.STEPS + 1)]
    tones += [np.zeros(3), np.ones(3)]
    best = next((x for x in tones if ratio(x) >= colour.ENOUGH), None)
    return "".join(f"{int(c):02X}" for c in np.rint(best * 255))


def test_pairs_are_repaired_together():
    rng = random.Random(2)
    pairs = [tuple(f"#{rng.randrange(1 << 24):06X}" for _ in "ab") for _ in range(300)]
    assert colour._repaired([*pairs, ("zz", "#FFFFFF")]) == [*[plain_repair(*x) for x in pairs], "ZZ"]


def test_repairs_are_dealt_to_all_cores(spark, sf):
    assert queries.repaired_colours(spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_runs_without_styles_do_not_meet(spark):
    """No task of a join gets all runs that name no style."""
    runs = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("doc_id"), F.col("id").alias("run_no"), *[F.lit(None).cast("string").alias(c) for c in ("color", "highlight", "shading", "nested_shading", "run_style", "para_style", "table_style")])
    styles = spark.createDataFrame([(1, "a", None, "112233", "445566")], "doc_id int, style_id string, based_on string, color string, shading string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        sizes = contrast.effective(runs, styles).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
