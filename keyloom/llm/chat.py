"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns become training texts of at most ``budget`` tokens. Nothing is cut inside a turn and no turn
is left out:

1. turns are dealt by range in their order, and prefix sums of their tokens are taken in two steps, inside each
   range and over the sums of the ranges, so that no task needs a whole conversation;
2. a turn of more than ``half`` tokens is a span of its own; other turns stand in the span ``floor(before / stride)``,
   where ``before`` is the prefix sum. The stride leaves room for the longest such turn of the conversation, so a
   span is within what is left of the budget beside system turn and history;
3. each later window repeats the system turn (the first turn, if its role is ``system`` and it takes at most a
   quarter of the budget) and the turns that lie wholly within ``history`` tokens before its span. They meet their
   windows by an equi-join over places of the prefix sum;
4. the text of a window is put together turn by turn. Its loss mask has a span for each turn of the role ``target``
   that is no repetition: over all windows of a conversation each such text is under the mask once.

A turn is ``begin role body text end``. Control strings inside roles and texts are broken up by ``\\`` after their first
character, and ``\\`` is doubled; ``read_back`` undoes it, so a text can't end its turn or begin another.

Defined results: a null role or text is empty; rows with a null conversation id are one conversation; a null turn
number comes first; rows with equal turn numbers are ordered by role, then by the SHA-256 of their text, and
repeated rows all stay. A single turn that is longer than the budget has a window of its own beyond it. An empty table
gives no rows. A row costs ``overhead`` tokens and one for each four bytes of its text (or ``tokens``, if given).
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, shuffle_parts

ESCAPE = "\\"


@dataclasses.dataclass(frozen=True)
class Template:
    """Control strings around a turn: ``begin role body text end``."""

    begin: str = "[INST]"
    body: str = "[/INST]"
    end: str = "</s>"

    def __post_init__(self):
        controls = (self.begin, self.body, self.end)
        for c in controls:
            if len(c) < 2 or ESCAPE in c or len(set(controls)) < 3:
                raise ValueError(f"control strings must differ, have two characters at least and no {ESCAPE}: {controls}")
            if any(c[0] in other[1:] for other in controls):
                raise ValueError(f"{c[0]!r} may only stand first in a control string: {controls}")

    def escape(self, text: Column) -> Column:
        starts = "|".join(_literal(c) for c in (self.begin, self.body, self.end))
        doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        return F.regexp_replace(doubled, f"(?=(?:{starts}))(.)", "$1" + ESCAPE * 2)

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")


def _literal(text: str) -> str:
    """The text as a pattern that both Python's and Java's engines take."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokens: Column | None, overhead: int) -> DataFrame:
    """Turns in order: ``at`` grows along the whole table, and its high bits are the range that holds the row."""
    cost = tokens if tokens is not None else F.ceil(F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) / 4)
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), (F.greatest(F.coalesce(cost.cast("long"), F.lit(0)), F.lit(0)) + overhead).alias("cost"),
    )
    # equal rows are told apart by a number, so that any count of them can be dealt over several ranges
    rows = rows.withColumn("tie", F.sha2(F.col("text").cast("binary"), 256)).withColumn("copy", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shuffle_parts(turns.sparkSession), "conv", "turn", "role", "tie", "copy").sortWithinPartitions("conv", "turn", "role", "tie", "copy")
    return rows.select("conv", "role", "text", "cost").withColumn("at", F.monotonically_increasing_id())


def _placed(turns: DataFrame, budget: int, history: int, system: str) -> DataFrame:
    """For each turn its place in its conversation, the tokens before it, and its window's first place."""
    half = (budget - history - budget // 4) // 2
    small = F.when(F.col("cost") <= half, F.col("cost"))
    turns = turns.select("conv", "at", "role", "cost", F.shiftright("at", 33).alias("range"), (F.col("cost") > half).cast("long").alias("large"))
    inside = Window.partitionBy("conv", "range").orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    each = turns.withColumns({
        "pos": F.row_number().over(inside).cast("long") - 1, "before": F.coalesce(F.sum("cost").over(before), F.lit(0)), "larger": F.coalesce(F.sum("large").over(before), F.lit(0)),
    })
    sums = turns.groupBy("conv", "range").agg(
        F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("large").alias("large"), F.max(small).alias("top"), F.min_by(F.struct("at", "role", "cost"), "at").alias("head"),
    )
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv").alias("_conv"), F.col("range").alias("_range"),
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "cost", "large")),
        F.max("top").over(whole).alias("top"), F.min("head").over(whole).alias("head"),
    )
    kept = (F.col("head.role") == system) & (F.col("head.cost") <= budget // 4)
    sums = sums.withColumn("system_at", F.when(kept, F.col("head.at"))).withColumn("stride", budget - history - F.when(kept, F.col("head.cost")).otherwise(0) - F.coalesce("top", F.lit(0)))
    each = each.join(sums, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")))
    each = each.select("conv", "at", "large", "stride", "system_at", (F.col("pos") + F.col("_n")).alias("pos"), (F.col("before") + F.col("_cost")).alias("before"), (F.col("larger") + F.col("_large")).alias("larger"))
    span = F.when(F.col("large") == 1, F.lit(0)).otherwise(F.expr("before div stride"))
    own = Window.partitionBy("conv", "larger", "large", "span")
    return each.withColumn("span", span).withColumns({"window": F.min("pos").over(own), "begins": F.min("before").over(own)}).select("conv", "at", "pos", "before", "window", "begins", "system_at")


def _with_copies(placed: DataFrame, history: int) -> DataFrame:
    """Each turn in its own window, and the repeated ones in theirs: ``(at, conv, window, pos, copied)``."""
    own = placed.select("at", "conv", "window", "pos", F.lit(False).alias("copied"))
    later = placed.filter((F.col("pos") == F.col("window")) & (F.col("window") > 0)).select(F.col("conv").alias("_conv"), "window", "begins", "system_at")
    system = later.filter(F.col("system_at").isNotNull()).select(F.col("system_at").alias("at"), F.col("_conv").alias("conv"), "window", F.lit(0).cast("long").alias("pos"), F.lit(True).alias("copied"))
    if history < 1:
        return own.unionByName(system)
    buckets = F.array_distinct(F.array(F.expr(f"greatest(begins - {history}, 0) div {history}"), F.expr(f"begins div {history}")))
    asks = later.withColumn("_bucket", F.explode(buckets))
    had = placed.select("at", "conv", "pos", "before", F.expr(f"before div {history}").alias("bucket"), F.col("system_at").isNotNull().alias("has_system"))
    near = (F.col("before") >= F.col("begins") - history) & (F.col("pos") < F.col("window")) & ((F.col("pos") > 0) | ~F.col("has_system"))
    past = had.join(asks, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("bucket") == F.col("_bucket")) & near)
    return own.unionByName(system).unionByName(past.select("at", "conv", "window", "pos", F.lit(True).alias("copied")))


def format_conversations(
    turns: DataFrame, *, budget: int = 2048, history: int = 256, overhead: int = 4, template: Template = Template(), target: str = "assistant", system: str = "system",
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """A row for each window: conversation, ``window`` (place of its first new turn), ``n_turns, n_repeated, n_tokens``, the
    formatted ``text`` and ``loss``: spans ``(start, length)`` in characters of the text that are under the loss mask."""
    if not 0 <= history <= budget // 4 or overhead < 1 or budget < 8:
        raise ValueError("history may take a quarter of the budget at most, and a turn costs one token at least")
    stage = Stage(turns.sparkSession, "chat")
    ordered = stage.put("turns", _ordered(turns, conv_col, turn_col, role_col, text_col, tokens, overhead))
    placed = stage.put("placed", _placed(ordered, budget, history, system))
    uses = _with_copies(placed, history)
    lead = F.concat(F.lit(template.begin), template.escape(F.col("role")), F.lit(template.body))
    body = template.escape(F.col("text"))
    parts = ordered.select("at", "cost", F.char_length(lead).alias("lead"), F.char_length(body).alias("body"), F.concat(lead, body, F.lit(template.end)).alias("piece"), (F.col("role") == target).alias("target"))
    rows = uses.join(parts, "at")
    order = Window.partitionBy("conv", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(order), F.lit(0))
    rows = rows.withColumn("start", offset + F.col("lead"))
    masked = F.when(F.col("target") & ~F.col("copied"), F.struct("start", F.col("body").cast("long").alias("length")))
    out = rows.groupBy("conv", "window").agg(
        F.count("*").alias("n_turns"), F.count_if("copied").alias("n_repeated"), F.sum("cost").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.array_sort(F.collect_list(masked)).alias("loss"),
    )
    return out.select(F.col("conv").alias(conv_col), "window", "n_turns", "n_repeated", "n_tokens", F.array_join("pieces.piece", "").alias("text"), "loss")


def read_back(windows: DataFrame, *, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """From formatted windows alone: ``turns`` (role and text of each new turn, unescaped), ``targets`` (the texts under the
    loss mask, unescaped) and ``n_chars`` of the formatted text, for each window."""
    pieces = F.filter(F.split("text", _literal(template.end), -1), lambda p: p != "")
    fresh = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(pieces) - F.col("n_repeated").cast("int"), F.lit(0)))

    def turn(piece: Column) -> Column:
        two = F.split(piece, _literal(template.body), 2)
        role = F.substring(two[0], len(template.begin) + 1, 1 << 30)
        return F.struct(template.unescape(role).alias("role"), template.unescape(two[1]).alias("text"))

    masked = F.transform("loss", lambda s: template.unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.select(F.col(f"`{conv_col}`"), "window", F.transform(fresh, turn).alias("turns"), masked.alias("targets"), F.char_length("text").cast("long").alias("n_chars"))
