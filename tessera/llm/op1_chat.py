r"""Chat formatting in budgeted windows, in DataFrame expressions only.

Turns of a conversation are ordered, their token counts prefix-summed, and the sums choose
turn-aligned spans: a window closes where the sum since its start would pass the budget left by the
system turn and by the history.  Every window starts with the conversation's system turn (its first
turn, if its role is system), then repeats the turns before its span that fit `history` tokens and
`history_turns` turns, then gives the span.  The loss mask covers the assistant texts of the span only,
so a repeated target is masked and each assistant text is learned once.  A turn longer than the budget is
a window of its own, whole.

Template: `<|im_start|>role\ntext<|im_end|>\n`.  Control strings inside texts and roles are escaped with a
backslash form and come back exactly: `\` is `\e`, and the first character of a control string is `\l`
(for `<`) or `\b` (for `[`); a line break in a role is `\w`.

Conversations of up to CHARS times `block` code points are formatted from one array of their turns.  Longer
ones are cut into blocks of about `block` tokens by their own prefix sums: their turns are dealt by ranges of the
order, ranked and summed range by range, so no task gathers an unbounded conversation.  A window ends with its
block, whatever the turns' numbers; the first window of the next block starts with the system turn and repeats the
turns before it as history like any other.

Defined results: null text or role is empty; a null conv_id is a conversation; a null turn comes first;
equal turn numbers are ordered by role, then the first TIE code points of the text, then its hash; repeated
rows are turns of their own.  An empty table gives an empty one; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

BUDGET = 512
HISTORY = 128
HISTORY_TURNS = 2
BLOCK = 8192
CHARS = 8
TIE = 32
#: Long conversations are broadcast up to so many.
MOST_LONG = 100_000
START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens are words and single signs, plus the template's own.
TOKEN = r"\w+|[^\w\s]"
TURN_COST = 4
CONTROL = ((r"<(?=\||/?s>|<SYS>>|</SYS>>)", r"\\l"), (r"\[(?=/?INST\])", r"\\b"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for pattern, mark in CONTROL:
        text = F.regexp_replace(text, pattern, mark)
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\w"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\w"), F.lit("\n")))


def ordered(rows: DataFrame) -> DataFrame:
    """rows with `rank` (from 1) and `before` (tokens ahead) within each conversation, which may be of any length.

    Rows are dealt by ranges of the order and written once; ranges are ranked and summed inside, and the totals
    (one row a range and conversation) are prefix-summed.
    """
    keys = ("conv_id", "turn", "role", "tie", "hash", "row")
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "chat-turns")
    inside = Window.partitionBy("part", "conv_id").orderBy(*keys[1:])
    dealt = dealt.withColumn("r", F.row_number().over(inside)).withColumn("s", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t"))
    both = dealt.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return both.select(*rows.columns, (F.col("r") + F.col("n")).alias("rank"), (F.col("s") + F.col("t")).alias("before"))


def _blocks(rows: DataFrame, block: int, history_turns: int) -> DataFrame:
    """(conv_id, block, turns): each block's own turns in order, after the system turn and the turns of the block before, which have `own` false."""
    weighed = rows.groupBy("conv_id").agg(F.sum(F.length("text") + TURN_COST).alias("size")).where(F.col("size") > CHARS * block)
    found = written(weighed.select(F.col("conv_id").alias("long_conv")), "chat-long")
    n = found.count()
    tokens = (F.regexp_count("text", F.lit(TOKEN)) + TURN_COST).cast("long")

    def collected(of: DataFrame) -> DataFrame:
        body = F.struct("rank", F.col("turn").isNotNull().alias("numbered"), "turn", "role", "tie", "hash", "text", "tokens", "own")
        return of.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(body)).alias("turns"))

    def whole(of: DataFrame) -> DataFrame:
        return collected(of.select("*", tokens.alias("tokens"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("own")))

    if not n:
        return whole(rows)
    found = F.broadcast(found) if n <= MOST_LONG else found
    is_long = F.col("conv_id").eqNullSafe(F.col("long_conv"))
    long_ = ordered(rows.join(found, is_long, "left_semi").withColumn("tokens", tokens))
    long_ = written(long_.withColumn("block", F.floor(F.col("before") / block)).drop("before"), "chat-blocks")
    first = long_.groupBy("conv_id", "block").agg(F.min("rank").alias("first")).where("first > 1")
    # Rank 1 is wanted in every later block in case it is the system turn.
    ranks = F.array_distinct(F.concat(F.array(F.lit(1).cast("long")), *([F.sequence(F.greatest(F.col("first") - history_turns, F.lit(1)), F.col("first") - 1)] if history_turns else [])))
    wanted = first.select(F.col("conv_id").alias("of"), F.col("block").alias("to"), "first", F.explode(ranks).alias("wanted"))
    past = long_.join(wanted, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("wanted"))).where((F.col("rank") >= F.col("first") - history_turns) | (F.col("role") == "system"))
    past = past.select(*[F.col("to").alias("block") if c == "block" else F.col(c) for c in long_.columns], F.lit(False).alias("own"))
    return whole(rows.join(found, is_long, "left_anti")).unionByName(collected(long_.withColumn("own", F.lit(True)).unionByName(past)))


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, block: int = BLOCK) -> DataFrame:
    """A row for each window: conv_id, block, window, text, context (turns repeated at its start), and loss: spans (start, length) in code points."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tie", F.substring("text", 1, TIE)).withColumn("hash", F.xxhash64("text"))
    blocks = _blocks(rows, block, history_turns)
    head = F.col("turns")[0]
    leads = (head["role"] == "system") & ((F.col("block") == 0) | (~head["own"] & (head["rank"] == 1)))
    blocks = blocks.withColumn("lead", leads.cast("int")).withColumn("known", F.size(F.filter("turns", lambda t: ~t["own"])))
    free = F.greatest(F.lit(budget - history) - F.when(F.col("lead") == 1, head["tokens"]).otherwise(0), F.lit(1))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
    summed = F.aggregate("turns", zero, lambda a, t: F.struct((a["sum"] + t["tokens"]).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + t["tokens"])).alias("sums")), lambda a: F.concat(F.array(F.lit(0).cast("long")), a["sums"]))
    blocks = blocks.select("conv_id", "block", "turns", "lead", "known", free.alias("free"), summed.alias("sums"))
    # Starts of windows: the first turn whose prefix sum passes the last start's by more than the budget.
    begin = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, i: Column) -> Column:
        after, before = F.element_at("sums", i + 2), F.element_at("sums", i + 1)
        new = (F.size(acc["starts"]) == 0) | ((after - acc["base"] > F.col("free")) & (before > acc["base"]))
        return F.when(new, F.struct(before.alias("base"), F.concat(acc["starts"], F.array(i)).alias("starts"))).otherwise(acc)

    n = F.size("turns")
    starts = F.aggregate(F.sequence(F.col("known"), n - 1), begin, step, lambda a: a["starts"])
    blocks = blocks.withColumn("starts", starts)
    each = blocks.select("*", F.posexplode("starts").alias("window", "start"))
    stop = F.coalesce(F.try_element_at("starts", F.col("window") + 2), n)
    back = F.when(F.col("start") > F.col("lead"), F.sequence(F.greatest(F.col("lead"), F.col("start") - history_turns), F.col("start") - 1)).otherwise(F.array().cast("array<int>"))
    back = F.filter(back, lambda i: F.element_at("sums", F.col("start") + 1) - F.element_at("sums", i + 1) <= history)
    each = each.withColumn("past", F.size(back)).withColumn("stop", stop)
    system = F.slice("turns", F.lit(1), F.when(F.col("start") > 0, F.col("lead")).otherwise(0))
    shown = F.concat(system, F.slice("turns", F.col("start") - F.col("past") + 1, F.col("past")), F.slice("turns", F.col("start") + 1, F.col("stop") - F.col("start")))
    each = each.select("conv_id", "block", "window", (F.size(system) + F.col("past")).alias("context"), F.transform(shown, lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("target"))).alias("shown"))
    rendered = F.concat_ws("", F.transform("shown", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))))
    cost = len(START) + 1
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def mask(acc: Column, x: Column) -> Column:
        size = F.length(x["t"]["text"]).cast("long")
        begin = acc["at"] + cost + F.length(x["t"]["role"])
        one = F.array(F.struct(begin.cast("long").alias("start"), size.alias("length")))
        on = x["t"]["target"] & (x["i"] >= F.col("context"))
        return F.struct((begin + size + len(END)).cast("long").alias("at"), F.when(on, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate(F.transform("shown", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), nothing, mask, lambda a: a["spans"])
    return each.select("conv_id", "block", F.col("window").cast("long").alias("window"), rendered.alias("text"), F.col("context").cast("long").alias("context"), loss.alias("loss"))


def parsed(text: Column) -> Column:
    """Turns (role, text), unescaped, of a window's text."""
    parts = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda p, i: i > 0)

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        return F.struct(unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(p, cut + 1, F.length(p) - cut - len(END))).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read from the windows alone: its turns in order without repeats, its text under the mask, and its code points."""
    turns = F.filter(parsed(F.col("text")), lambda t, i: i >= F.col("context"))
    learned = F.concat_ws("", F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))))
    one = formatted.select("conv_id", F.struct("block", "window", turns.alias("turns"), learned.alias("learned"), F.length("text").cast("long").alias("chars")).alias("w"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.concat_ws("", F.transform("w", lambda x: x["learned"])).alias("learned"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("formatted_chars"))
