"""Chat formatting in budgeted windows, with built-in functions only.

A conversation becomes windows of at most ``budget`` tokens. Prefix sums of the turns' tokens choose the
spans: a window takes new turns, whole ones, until the next would pass its share. Every window opens with
the system turn, then repeats the last turns before its span as far as they fit ``history_turns`` and
``history_tokens``. The loss mask covers the texts of assistant turns in the span; repeated turns are
context and masked out, so each assistant text is a target exactly once.

Turns are numbered by a range sort and summed in pieces of ``CHUNK`` positions, so one endless conversation
is many tasks, whatever its turn numbers are; a window never reaches over a piece, except for its repeated
history. Spans are chosen without the texts, which join their windows at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import WORD_CLASS, prefix_sums, take
from fleetspectra.llm.ordering import chunked, spans, with_positions
from fleetspectra.sources.tables import materialize

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
CHUNK = 1024
# Characters of role and text by which turns of one number are ordered before a digest decides.
ROLE_KEY, TEXT_KEY = 64, 256

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"


def escape(text: Column) -> Column:
    """Puts one more backslash into every ``<|``, ``<\\|``, ... so that no mark is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on a line of its own and holds no mark."""
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    out = F.replace(out, F.lit("<"), F.lit("%3C"))
    return F.replace(out, F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("%3C"), F.lit("<"))
    out = F.replace(out, F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def word_tokens(text: Column) -> Column:
    """Tokens of a text by its words; any other column expression may be given instead."""
    return F.regexp_count(text, F.lit(WORD_CLASS))


def _texts(rows: DataFrame, tokens) -> DataFrame:
    """Turns in the order of their conversation, cut into slices: ``chunk`` and ``at`` are a turn's address.

    Sort keys are sampled on the driver, so they hold the first ``ROLE_KEY`` and ``TEXT_KEY`` characters
    only, then a digest of the whole.
    """
    turns = rows.select(
        "conv_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "turn",
    )
    # Marks and role count as four tokens.
    turns = turns.withColumn("tokens", tokens(F.col("text")).cast("long") + 4)
    order = [
        F.col("turn").asc_nulls_last(),
        F.left("role", F.lit(ROLE_KEY)),
        F.left("text", F.lit(TEXT_KEY)),
        F.xxhash64("role", "text"),
    ]
    return chunked(turns, "conv_id", order, "chat-texts").drop("turn")


def _turns(texts: DataFrame) -> DataFrame:
    """Turns without their texts: ``conv_id, chunk, at, tokens``, the position ``pos`` from 0, the number
    ``n`` of turns, ``system_tokens`` of the first turn if it is a system turn, else 0, and ``before``, the
    tokens of all turns that come earlier."""
    lead = texts.groupBy("conv_id").agg(
        F.min_by(
            F.when(F.col("role") == SYSTEM, F.col("tokens")).otherwise(0), F.struct("chunk", "at")
        ).alias("system_tokens")
    )
    reach = spans(texts, "conv_id").join(
        lead.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))
    )
    reach = materialize(reach.drop("c"), "chat-reach")
    slim = texts.select("conv_id", "chunk", "at", "tokens", F.struct("chunk", "at").alias("address"))
    placed = with_positions(slim, "conv_id", reach, reach.count())
    placed = placed.withColumn("piece", F.floor(F.col("pos") / CHUNK))
    return prefix_sums(placed, ["conv_id"], "piece", [F.col("pos")], before="tokens")


def _spans(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """Adds ``span``, the position of the first turn of its window; null for a system turn.

    Per piece of a conversation, a window is closed when the prefix sum behind the next turn is more
    than its share past the prefix sum where it began. A turn larger than the share stands alone.
    """
    is_system = (F.col("pos") == 0) & (F.col("system_tokens") > 0)
    kept = ["pos", "before", "tokens", "n", "system_tokens", "address"]
    pieces = (
        turns.filter(~is_system)
        .groupBy("conv_id", "piece")
        .agg(
            F.sort_array(F.collect_list(F.struct(*kept))).alias("turns"),
            F.first("system_tokens").alias("system_tokens"),
        )
        .withColumn(
            "share",
            F.greatest(F.lit(1), F.lit(budget) - F.col("system_tokens") - F.lit(history_tokens)),
        )
    )
    start = F.struct(
        F.lit(-1).cast("long").alias("first"),
        F.lit(0).cast("long").alias("base"),
        F.array().cast("array<bigint>").alias("spans"),
    )

    def step(state: Column, turn: Column) -> Column:
        closed = (state["first"] < 0) | (
            turn["before"] + turn["tokens"] - state["base"] > F.col("share")
        )
        first = F.when(closed, turn["pos"]).otherwise(state["first"])
        return F.struct(
            first.alias("first"),
            F.when(closed, turn["before"]).otherwise(state["base"]).alias("base"),
            F.concat(state["spans"], F.array(first)).alias("spans"),
        )

    spans_of = F.aggregate("turns", start, step, lambda s: s["spans"]).alias("spans")
    placed = pieces.select("conv_id", F.arrays_zip("turns", spans_of).alias("zipped")).select(
        "conv_id", F.explode("zipped").alias("x")
    )
    systems = turns.filter(is_system).select("conv_id", *kept, F.lit(None).cast("long").alias("span"))
    return placed.select(
        "conv_id", *[F.col(f"x.turns.{c}").alias(c) for c in kept], F.col("x.spans").alias("span")
    ).unionByName(systems)


def _places(turns: DataFrame, history_turns: int, history_tokens: int) -> DataFrame:
    """Which turn stands in which window: ``window, pos, old, tokens, address``."""
    new = turns.filter(F.col("span").isNotNull())
    fresh = new.select("conv_id", F.col("span").alias("window"), "pos", "tokens", "address", F.lit(False).alias("old"))
    # Each window looks back at the system turn and at its last turns before.
    has_system = F.col("system_tokens") > 0
    window = F.col("span")
    lowest = F.greatest(has_system.cast("long"), window - history_turns)
    recent = F.when((window > lowest) & F.lit(history_turns > 0), F.sequence(lowest, window - 1))
    none = F.array().cast("array<bigint>")
    lead = F.when(has_system, F.array(F.lit(0).cast("long"))).otherwise(none)
    back = new.filter(F.col("pos") == window).select(
        F.col("conv_id").alias("c"),
        window.alias("window"),
        F.col("before").alias("window_before"),
        F.explode(F.concat(lead, F.coalesce(recent, none))).alias("p"),
    )
    seen = turns.select("conv_id", "pos", "before", "tokens", "address", F.col("span").isNull().alias("lead"))
    old = (
        seen.join(back, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
        .filter(F.col("lead") | (F.col("window_before") - F.col("before") <= history_tokens))
        .select("conv_id", "window", "pos", "tokens", "address", (~F.col("lead") | (F.col("window") > 1)).alias("old"))
    )
    # A conversation of a system turn alone has no span; it is a window of that turn.
    alone = turns.filter(F.col("span").isNull() & (F.col("n") == 1)).select(
        "conv_id", F.lit(0).cast("long").alias("window"), "pos", "tokens", "address", F.lit(False).alias("old")
    )
    return fresh.unionByName(old).unionByName(alone).drop("conv_id")


def chat_windows(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    tokens=word_tokens,
) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, n_turns, n_repeated, n_tokens, loss``.

    ``formatted`` is the whole window; its first ``n_repeated`` turns are context that stands in an
    earlier window too (or the system turn, from the second window on). ``loss`` holds the masked spans as
    ``start, length`` in code points of ``formatted``, start from 0. The windows of a conversation are
    numbered by the position of their first new turn.

    The system turn is the first turn if its role says so; alone in its conversation it makes a window.
    A null role or text is empty, a null turn comes last, and turns of one number are ordered by the start
    of role and text, then by a digest, so repeated rows keep their place and nothing is lost. A null conversation is one of its own.
    A turn beyond the budget stands in a window that exceeds it. An empty table gives no windows; further
    columns are ignored.
    """
    rows = take(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    texts = _texts(rows, tokens)
    turns = materialize(_spans(_turns(texts), budget, history_tokens), "chat-turns")
    places = _places(turns, history_turns, history_tokens)
    piece = F.concat(
        F.lit(START),
        escape_role(F.col("role")),
        F.lit("\n"),
        escape(F.col("text")),
        F.lit(END + "\n"),
    )
    pieces = texts.select(
        "conv_id",
        "chunk",
        "at",
        piece.alias("piece"),
        F.length(escape(F.col("text"))).alias("chars"),
        (F.col("role") == TARGET).alias("target"),
    )
    # Only here do texts meet their windows, by address.
    filled = pieces.join(
        places, (F.col("chunk") == F.col("address.chunk")) & (F.col("at") == F.col("address.at"))
    )
    windows = filled.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "old", "piece", "chars", "target"))).alias("t"),
        F.sum("tokens").alias("n_tokens"),
    )
    # Where a turn begins in the window, by prefix sums over its bounded list.
    begin = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"),
    )
    tail = len(END) + 1

    def step(state: Column, turn: Column) -> Column:
        size = F.length(turn["piece"]).cast("long")
        chars = turn["chars"].cast("long")
        span = F.struct((state["at"] + size - tail - chars).alias("start"), chars.alias("length"))
        return F.struct(
            (state["at"] + size).alias("at"),
            F.when(turn["target"] & ~turn["old"], F.concat(state["loss"], F.array(span)))
            .otherwise(state["loss"])
            .alias("loss"),
        )

    return windows.select(
        "conv_id",
        "window",
        F.concat_ws("", F.col("t.piece")).alias("formatted"),
        F.size("t").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["old"])).alias("n_repeated"),
        "n_tokens",
        F.aggregate("t", begin, step, lambda s: s["loss"]).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """Reads windows back: ``conv_id, window, n_new, turns_text, loss_text, chars``.

    ``turns_text`` is role, line end, text, line end of each turn that is not repeated, so the windows of
    a conversation in order give each of its turns once; ``loss_text`` is all text under the mask.
    """
    pieces = F.split(F.col("formatted"), r"<\|im_start\|>", -1)
    fresh = F.slice(pieces, F.lit(2) + F.col("n_repeated"), F.size(pieces))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = piece.substr(F.length(role) + 2, F.length(piece) - F.length(role) - 2 - len(END))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(body), F.lit("\n"))

    targets = F.transform(
        "loss",
        lambda x: unescape(
            F.col("formatted").substr((x["start"] + 1).cast("int"), x["length"].cast("int"))
        ),
    )
    return windows.select(
        "conv_id",
        "window",
        F.size(fresh).alias("n_new"),
        F.concat_ws("", F.transform(fresh, turn)).alias("turns_text"),
        F.concat_ws("", targets).alias("loss_text"),
        F.length("formatted").alias("chars"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of whole conversations,
    each read back from its windows."""
    whole = read_turns(windows).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns_text", "loss_text"))).alias("w"),
        F.sum("n_new").cast("long").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    loss = F.concat_ws("", "w.loss_text")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.concat_ws("", "w.turns_text"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
