"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose turn-aligned spans. What the system turn and a limited history
leave of the budget is halved to a stride; a window takes the turns that begin within one stride of the
sum and are no longer than one, so that it keeps the budget, and a longer turn stands in a window of its
own. Every window starts with the conversation's system turn and repeats the turns just before its own;
what is repeated is marked and masked, so each target counts once. Sums run within chunks of turns, so a
long conversation is spread over tasks, and texts are shuffled once, by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import materialise

#: The template's control strings.
TURN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>"
#: What opens a control string, of this template or of common others, may hold backslashes.
OPENS = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
CHUNK_TURNS = 256


def escape(text: Column) -> Column:
    """One backslash more after the bracket of each control string; no control string remains."""
    return F.regexp_replace(text, OPENS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def turn_tokens(role: Column, text: Column, marks: int = 4) -> Column:
    """An estimate that needs no vocabulary: words and single other characters, and the marks."""
    return F.regexp_count(F.concat(role, F.lit(" "), text), F.lit(r"\w+|[^\w\s]")) + marks


def chunked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with the keys of their chunk: ck and cn for the conversation, neither null, and chunk."""
    conv = F.col(conv_col)
    return turns.select(
        conv.alias("conv"),
        F.coalesce(conv.cast("string"), F.lit("")).alias("ck"),
        conv.isNull().alias("cn"),
        F.coalesce(F.floor(F.col(turn_col) / F.lit(CHUNK_TURNS)), F.lit(-(2**62))).cast("bigint").alias("chunk"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def openings(slim: DataFrame, most: int) -> DataFrame:
    """A row per chunk: first_chunk of its conversation, and of the system turn that opens it the text and tokens.

    Those are null where no system turn opens the conversation, or one of more than `most` tokens. Of the
    texts only those of system turns are read.
    """
    nulls_first = F.col("turn").isNotNull()
    chunks = slim.groupBy("ck", "cn", "chunk").agg(F.min(F.struct(nulls_first, "turn", "role")).alias("first"))
    whole = Window.partitionBy("ck", "cn")
    chunks = chunks.select("ck", "cn", "chunk", F.min("chunk").over(whole).alias("first_chunk"), F.min("first").over(whole).alias("first"))
    system = slim.where(F.col("role") == "system").groupBy("ck", "cn").agg(F.min(F.struct(nulls_first, "turn", "role", "text")).alias("system"))
    system = system.withColumn("size", turn_tokens(F.col("system.role"), F.col("system.text"))).where(F.col("size") <= most)
    joined = chunks.join(system, ["ck", "cn"], "left")
    opens = F.col("first.role") == "system"
    return joined.select("ck", "cn", "chunk", "first_chunk", F.when(opens, F.col("system.text")).alias("system"), F.when(opens, F.col("size")).alias("size"))


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per window: the conversation's id, window (orders a conversation's), text, loss, own_turns, tokens.

    loss lists (start, length) in code points of `text`: the escaped texts of the window's own `target`
    turns. tokens is an estimate (turn_tokens) and at most `budget`, unless a single turn is longer than
    system and history leave: that one stands whole in a window of its own behind them. A system turn that
    opens the conversation is repeated in each window if it takes at most three quarters of what the
    history leaves; a longer one stands in the first window only, and the others have the whole budget.
    Repeated are also the turns before the window's own, as many as `history` tokens hold, from the same
    chunk of turns (256 turn numbers).

    Rows are ordered by turn, nulls first, ties by role and text; rows with one turn number are sorted in
    one task, and repeated rows are turns each. Null roles and texts are empty; a null conversation id is
    one conversation; an empty table gives an empty result; other columns are not read. Nothing is cut or
    dropped.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must lie between 0 and half the budget")
    room = budget - history
    slim = chunked(turns, conv_col, turn_col, role_col, text_col)
    keys = ["ck", "cn", "chunk"]
    opening = materialise(openings(slim, room * 3 // 4))  # used twice, and a row a chunk
    inside = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = slim.withColumn("tokens", turn_tokens(F.col("role"), F.col("text"))).withColumn("nth", F.row_number().over(inside))
    t = t.join(opening.drop("system"), keys)
    t = t.withColumn("opens", F.col("size").isNotNull() & (F.col("chunk") == F.col("first_chunk")) & (F.col("nth") == 1))
    t = t.withColumn("stride", F.floor((F.lit(room) - F.coalesce("size", F.lit(0))) / 2)).withColumn("cost", F.when(F.col("opens"), 0).otherwise(F.col("tokens")))
    t = t.withColumn("at", F.sum("cost").over(before) - F.col("cost"))
    t = t.withColumn("long", F.col("cost") > F.col("stride")).withColumn("step", F.floor(F.col("at") / F.col("stride")))
    span = Window.partitionBy(*keys, "step", "long")
    t = t.withColumn("begin", F.min("at").over(span)).withColumn("end", F.max(F.col("at") + F.col("cost")).over(span))
    # a window is known by the sum where it begins: the next one begins where this one ends
    repeated = ~F.col("opens") & (F.col("end") - F.col("at") <= history)
    own, again = (F.struct(F.col(c).cast("bigint").alias("begin"), F.lit(c == "end").alias("again")) for c in ("begin", "end"))
    spread = t.withColumn("p", F.explode(F.when(repeated, F.array(own, again)).otherwise(F.array(own))))
    head = F.concat(F.when(F.col("p.again"), F.lit(AGAIN)).otherwise(F.lit(TURN)), escape(F.col("role")), F.lit(TEXT))
    is_target = ~F.col("p.again") & (F.col("role") == target)
    piece = F.struct("nth", head.alias("head"), escape(F.col("text")).alias("body"), is_target.alias("target"), F.col("p.again").alias("again"), "opens", "tokens")
    windows = spread.withColumn("begin", F.col("p.begin")).groupBy(*keys, "begin").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    windows = windows.where(F.exists("pieces", lambda p: ~p["again"])).join(opening.where("size is not null").select(*keys, "system", "size"), keys, "left")
    system = F.struct(F.lit(0).alias("nth"), F.lit(f"{AGAIN}system{TEXT}").alias("head"), escape(F.col("system")).alias("body"), F.lit(False).alias("target"), F.lit(True).alias("again"), F.lit(False).alias("opens"), F.col("size").alias("tokens"))
    lacks = F.col("size").isNotNull() & ~F.exists("pieces", lambda p: p["opens"])
    windows = windows.withColumn("pieces", F.when(lacks, F.concat(F.array(system), "pieces")).otherwise(F.col("pieces")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        loss = F.array(F.struct(begin.cast("bigint").alias("start"), F.length(p["body"]).cast("bigint").alias("length")))
        return F.struct((begin + F.length(p["body"]) + len(END)).cast("bigint").alias("at"), F.when(p["target"], F.concat(acc["loss"], loss)).otherwise(acc["loss"]).alias("loss"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return windows.select(
        F.col("conv").alias(conv_col),
        F.struct("chunk", "begin").alias("window"),
        text.alias("text"),
        F.aggregate("pieces", start, step)["loss"].alias("loss"),
        F.size(F.filter("pieces", lambda p: ~p["again"])).alias("own_turns"),
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"]).alias("tokens"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns and targets recovered from formatted windows alone, one row per conversation.

    Columns: the id, turns (array of role, text, in order), loss (array of the unescaped target texts),
    formatted_chars. Repeated turns are left out. A conversation comes together in one row here, because
    its digest is one: its size is that of its turns.
    """
    pattern = r"(?s)^<\|(turn|again)\|>(.*?)<\|text\|>(.*)<\|end\|>$"
    parts = F.filter(F.split(F.col("text"), r"(?=<\|(?:turn|again)\|>)"), lambda x: x.startswith(TURN))
    turns = F.transform(parts, lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 2)).alias("role"), unescape(F.regexp_extract(x, pattern, 3)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    each = windows.select(F.col(conv_col).alias("conv"), "window", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("bigint").alias("chars"))
    whole = each.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(F.col("conv").alias(conv_col), F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.loss")).alias("loss"), "formatted_chars")


def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    target = F.array_join("loss", "")
    return read.select(conv_col, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(target).cast("bigint").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")
