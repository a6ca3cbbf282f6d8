"""Generation of missing texts in numbered batches: choose, batch, and, when the batches have been asked, join the recorded answers back by number and accept what is fit.

Who is asked is no part of this: batches() goes out as a table, answers come in as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import responses
from quillspark.functions.text import collapse
from quillspark.operators.ordered import numbered

BATCH, SMALL_BATCH, MANY_EQUATIONS = 24, 6, 0.4


def batches(items: DataFrame, by: str = "source") -> DataFrame:
    """items without text, with batch and number: at most 24 of a document, 6 if 40 % or more of them are equations."""
    left = items.where(collapse("alt_text") == "")
    share = left.groupBy(by).agg((F.avg((F.lower("role") == "equation").cast("double")) >= MANY_EQUATIONS).alias("__small"))
    left = left.join(share, by)
    left = numbered(left, by, "id").withColumn("__at", F.col("__number") - 1).drop("__number")
    size = F.when(F.col("__small"), SMALL_BATCH).otherwise(BATCH)
    left = left.withColumn("__size", size)
    return left.withColumns({"batch": F.floor(F.col("__at") / F.col("__size")).cast("long"), "number": (F.col("__at") % F.col("__size") + 1).cast("int")}).drop("__at", "__size", "__small")


def accepted(items: DataFrame, answers: DataFrame, by: str = "source") -> DataFrame:
    """by, id, text: what recorded answers say of every item without text, cleaned; items that an answer leaves out, or says nothing fit of, get none. answers: by, batch, said (the answer's text, as it came)."""
    told = answers.select(by, "batch", F.explode(responses.parse(F.col("said"))).alias("x")).select(by, "batch", "x.number", "x.text")
    asked = batches(items, by).select(by, "batch", "number", "id")
    return asked.join(told, [by, "batch", "number"]).select(by, "id", responses.cleaned(F.col("text")).alias("text")).where("text <> ''")
