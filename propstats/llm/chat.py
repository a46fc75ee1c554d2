"""Chat formatting into budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans of a conversation. Each window starts with the
system turn, repeats the last turns of the window before it as history, and then holds its own span.
Text of the assistant in a window's own span is under the loss mask; repeated text never is, so
every target is trained on exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In texts a backslash becomes two and
``<|`` becomes ``<\\|``, so no control string can arise inside one; roles are URL-encoded.

Defined cases: null text and null role are empty; turns with equal numbers follow role and text,
null numbers come first; repeated rows are turns like others; a null conversation id is one
conversation; an empty table gives no windows; other columns are not read. A turn longer than the
window is kept whole in a window of its own, marked ``over_budget``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Counted as tokens: words and single marks. Each turn adds the template's own.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
TURN_TOKENS = 4
#: Prefix sums run within segments of so many turn numbers, packing within so many windows' worth.
SEGMENT_TURNS = 1024
CHUNK_WINDOWS = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where null keys match; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"r_{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"r_{k}" for k in keys])


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``p``, the tokens before them in their conversation, and ``total``, all its tokens.

    Sums run within segments first and segment sums are added, so a long conversation spreads.
    """
    parts = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select(
        "*",
        (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long").alias("tokens"),
        F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-(1 << 62))).alias("seg"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    running = F.sum("tokens").over(Window.partitionBy("conv_id", "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = parts.groupBy("conv_id", "seg").agg(F.sum("tokens").alias("seg_tokens"))
    conv = Window.partitionBy("conv_id")
    sums = sums.select(
        "conv_id",
        "seg",
        (F.sum("seg_tokens").over(conv.orderBy("seg")) - F.col("seg_tokens")).alias("before"),
        F.sum("seg_tokens").over(conv).alias("total"),
    )
    rows = parts.withColumn("p", running - F.col("tokens"))
    return _null_safe(rows, sums, ["conv_id", "seg"]).withColumn("p", F.col("p") + F.col("before")).drop("before", "seg")


def windows(turns: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """Rows conv_id, window, text, n_repeated, loss (spans of code points), tokens, over_budget.

    ``history`` tokens at most are repeated from the window before. A system turn that leaves less
    than a quarter of ``budget`` for a span does not shrink spans further; such windows are marked.
    """
    rows = _numbered(turns)
    is_system = (F.col("p") == 0) & (F.col("role") == "system")
    header = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    rows = rows.withColumn("head", F.length(header)).withColumn("body", escape(F.col("text")))
    rows = rows.select(
        "conv_id", "p", "tokens", "total", "head", F.length("body").alias("size"), (F.col("role") == "assistant").alias("target"),
        is_system.alias("is_system"), F.concat(header, "body", F.lit(END + "\n")).alias("piece"),
    )
    system = rows.where("is_system").select("conv_id", F.col("piece").alias("sys_piece"), F.col("tokens").alias("sys_tokens"))
    rows = _null_safe(rows, system.drop("sys_piece"), ["conv_id"]).na.fill({"sys_tokens": 0})
    room = F.greatest(F.lit(budget - history) - F.col("sys_tokens"), F.lit(max(1, budget // 4)))
    rows = rows.withColumn("room", room).withColumn("chunk", F.floor(F.col("p") / (F.col("room") * CHUNK_WINDOWS)))

    # Greedy spans within a chunk, from its turns' prefix sums alone (each turn has tokens, so they are few).
    sums = rows.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("p", "tokens"))).alias("sums"), F.first("room").alias("span_room")
    )
    starts = F.aggregate(
        "sums",
        F.struct(F.lit(None).cast("long").alias("start"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, x: F.when(
            acc["start"].isNull() | (x["p"] + x["tokens"] - acc["start"] > F.col("span_room")),
            F.struct(x["p"].alias("start"), F.concat(acc["starts"], F.array(x["p"])).alias("starts")),
        ).otherwise(acc),
        lambda acc: acc["starts"],
    )
    last = F.element_at("sums", -1)
    spans = sums.select("conv_id", "chunk", starts.alias("starts"), (last["p"] + last["tokens"]).alias("chunk_end"))
    rows = _null_safe(rows, spans, ["conv_id", "chunk"])
    rows = rows.withColumn("own", F.array_max(F.filter("starts", lambda s: s <= F.col("p"))))
    rows = rows.withColumn("next", F.coalesce(F.array_min(F.filter("starts", lambda s: s > F.col("p"))), "chunk_end"))
    again = (F.col("next") < F.col("total")) & (F.col("next") - F.col("p") <= history) & ~F.col("is_system")
    homes = F.when(again, F.array("own", "next")).otherwise(F.array("own"))
    placed = rows.select(
        "conv_id", "p", "piece", "head", "size", "target", "tokens", "sys_tokens", F.col("own"), F.explode(homes).alias("window")
    ).withColumn("repeated", F.col("own") != F.col("window"))

    turn = F.struct("p", "piece", "head", "size", (F.col("target") & ~F.col("repeated")).alias("target"))
    made = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.count_if("repeated").cast("int").alias("n_history"),
        F.sum("tokens").alias("turn_tokens"),
        F.first("sys_tokens").alias("sys_tokens"),
    )
    made = _null_safe(made, system.drop("sys_tokens"), ["conv_id"])
    kept_system = (F.col("window") > 0) & F.col("sys_piece").isNotNull()
    made = made.withColumn("lead", F.when(kept_system, F.col("sys_piece")).otherwise(F.lit("")))
    loss = F.aggregate(
        "turns",
        F.struct(F.length("lead").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.when(
                x["target"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["size"]).alias("end"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    tokens = F.col("turn_tokens") + F.when(kept_system, F.col("sys_tokens")).otherwise(0)
    return made.select(
        "conv_id",
        "window",
        F.concat(F.col("lead"), F.array_join(F.transform("turns", lambda x: x["piece"]), "")).alias("text"),
        (F.col("n_history") + kept_system.cast("int")).alias("n_repeated"),
        loss.alias("loss"),
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """What windows say, one row each: own turns as array<struct<role, text>>, and the text under the loss mask."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), F.col("n_repeated") + 2, F.greatest(F.size(F.split("text", r"<\|im_start\|>")), F.lit(1)))
    role = lambda x: F.url_decode(F.substring_index(x, "\n", 1))
    body = lambda x: F.substr(x, F.locate("\n", x) + 1)
    inner = lambda x: F.left(body(x), F.length(body(x)) - len(END) - 1)
    parsed = F.transform(pieces, lambda x: F.struct(role(x).alias("role"), unescape(inner(x)).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return made.select(
        "conv_id", "window", parsed.alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("text").alias("formatted_chars")
    )


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows. A digest needs the conversation in one row."""
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_back(made).select(
        "conv_id", "formatted_chars", F.size("turns").alias("n"), F.struct("window", turn_text.alias("said"), "loss_text").alias("part")
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("formatted_chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("parts", lambda x: x["said"]), "")
    whole = whole.withColumn("lost", F.array_join(F.transform("parts", lambda x: x["loss_text"]), ""))
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
