"""Chat formatting in budgeted windows of whole turns, in DataFrame operations.

Turns are counted in tokens (by default a quarter of the UTF-8 bytes, rounded up, and four for the marks).
Prefix sums cut a conversation into spans of whole turns: a span takes the turns that begin within one half
of what the budget leaves beside history and system turn, so it stays within the budget unless one turn
alone exceeds that half; such a turn is a span by itself and is never cut. A window is a span after the
system turn (the first turn, if its role is ``system``), and after the last turns of the span before it, as
far as they fit the history budget. Repeated turns are masked: each assistant text is under the loss mask
once.

A turn is ``<s>[INST]role[/INST]text</s>``. In roles and texts ``&``, ``<`` and ``[`` are written ``&amp;``,
``&lt;`` and ``&#91;``, so no control string can occur in them. Null roles and texts are empty; turns are
ordered by turn (null first), then role, then text; repeated rows are turns of their own; a null conv_id is
a conversation. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, PART, CLOSE = "<s>[INST]", "[/INST]", "</s>"
BUDGET = 1024
HISTORY = 256
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escaped(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4) + 4


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """conv_id, window, formatted, n_repeated (leading turns), loss_spans (start from 0, length, in code points)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text"))).withColumn("r", F.row_number().over(order))
    rows = rows.withColumn("head", (F.col("r") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("head_tokens", F.max(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(whole))
    half = F.greatest(F.lit(budget - history) - F.col("head_tokens"), F.lit(budget // 4)) / 2
    rows = rows.withColumn("half", half).withColumn("body", F.when(F.col("head"), 0).otherwise(F.col("tokens")))
    rows = rows.withColumn("start", F.sum("body").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("body"))
    rows = rows.withColumn("block", F.floor(F.col("start") / F.col("half"))).withColumn("long", F.col("body") > F.col("half"))
    cut = F.coalesce((F.col("block") != F.lag("block").over(order)) | F.col("long") | F.lag("long").over(order) | False, F.lit(False))
    cut = F.when(F.col("head") | F.lag("head").over(order), F.lit(False)).otherwise(cut)
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("window", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy("conv_id", "window")
    rows = rows.withColumn("span_end", F.max(F.col("start") + F.col("body")).over(span)).withColumn("last", F.max("window").over(whole))
    again = ~F.col("head") & (F.col("window") < F.col("last")) & (F.col("span_end") - F.col("start") <= history)
    own = F.array(F.struct(F.col("window"), F.lit(2).alias("kind")))
    later = F.transform(F.sequence(F.lit(1).cast("long"), F.col("last")), lambda w: F.struct(w.alias("window"), F.lit(0).alias("kind")))
    places = F.when(F.col("head") & (F.col("last") > 0), F.concat(own, later)).when(again, F.concat(own, F.array(F.struct((F.col("window") + 1).alias("window"), F.lit(1).alias("kind"))))).otherwise(own)
    placed = rows.select("conv_id", "r", "role", "text", F.explode(places).alias("place")).select("conv_id", "r", "role", "text", "place.*")
    lead = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(PART))
    placed = placed.withColumn("segment", F.concat(lead, escaped(F.col("text")), F.lit(CLOSE)))
    along = Window.partitionBy("conv_id", "window").orderBy("kind", "r").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.sum(F.length("segment")).over(along) - F.length("segment"))
    loss = F.when((F.col("role") == "assistant") & (F.col("kind") == 2), F.struct((F.col("at") + F.length(lead)).alias("start"), F.length(escaped(F.col("text"))).alias("length")))
    parts = F.array_sort(F.collect_list(F.struct("at", "segment")))
    return placed.withColumn("loss", loss).groupBy("conv_id", "window").agg(
        parts.alias("parts"), F.sum((F.col("kind") < 2).cast("long")).alias("n_repeated"), F.array_sort(F.collect_list("loss")).alias("loss_spans")
    ).select("conv_id", "window", F.array_join(F.col("parts.segment"), "").alias("formatted"), "n_repeated", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, each turn once), loss_text, formatted_chars, from ``windows`` alone."""
    segments = F.split("formatted", CLOSE, -1)
    fresh = F.slice(segments, F.col("n_repeated").cast("int") + 1, F.size(segments) - 1 - F.col("n_repeated").cast("int"))

    def turn(segment):
        inner = F.substring(segment, F.lit(len(OPEN) + 1), F.length(segment))
        return F.struct(unescaped(F.substring_index(inner, PART, 1)).alias("role"), unescaped(F.substring(inner, F.length(F.substring_index(inner, PART, 1)) + F.lit(len(PART) + 1), F.length(inner))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    rows = formatted.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))
    parts = F.array_sort(F.collect_list(F.struct("window", "turns", "loss")))
    return rows.groupBy("conv_id").agg(parts.alias("parts"), F.sum("chars").alias("formatted_chars")).select(
        "conv_id", F.flatten("parts.turns").alias("turns"), F.array_join(F.col("parts.loss"), "").alias("loss_text"), "formatted_chars")
