"""Chat formatting by quotation linking, in DataFrame functions only.

Method: leading > signs give each line its quote level; consecutive lines of
one level are a passage. Quoted passages and their single lines are normalised
(lower case, white space collapsed) and hashed. The hashes join to those of
the unquoted texts, passages and lines of the same conversation; of several
messages with one passage, the earliest turn is its original. A message answers
the earlier turn of which its outermost quotes hold most characters (the later
turn on ties). Messages without such a link open a thread. Each thread's tour,
down to a message and up from it again, is ranked by pointer doubling, which
gives every message its place in reply order and its depth; quotes are cut from
the texts.

Partitioning: only conversations in which a message quotes have their lines
hashed. Originals are pre-aggregated by conversation and hash, so a passage
that is repeated in very many messages costs one row on that side of the join.
No conversation, thread or group of answers is gathered into one task, and a
row's size doesn't depend on its thread's: the result is one row per message.

Results: null text stays null and has no quotes. Turns are integers, or texts
that spell them. Messages without conv_id or such a turn have no links. Repeated rows of one (conv_id, turn) count as one message
for linking, with the texts of all, and each keeps its row. A message whose
lines are all quotes has the empty text. Columns of the result's names are
replaced; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused

QUOTED = r"(?m)^[ \t]*>"
SIGNS = r"^[ \t]*(?:>[ \t]?)*"
CUT = r"(?m)^[ \t]*>.*(?:\r?\n|\z)"
#: Answers to one message are put in order in groups of so many turns.
NEAR = 1024


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the hash and size of the normalised text t, without blank ones."""
    rows = rows.withColumn("t", _normal(F.col("t"))).where("t <> ''")
    return rows.select(*columns, F.sha2(F.col("t").cast("binary"), 256).alias("hash"), F.length("t").alias("size"))


def _quoting_lines(quoting: DataFrame) -> DataFrame:
    """(conv, turn, h, pos, level, t, run) of each line of the messages with quotes; run numbers the passages of a message."""
    lines = quoting.select("conv", "turn", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("signs", F.when(F.col("line").rlike(QUOTED), F.regexp_extract("line", SIGNS, 0)).otherwise(""))
    lines = lines.select("conv", "turn", "h", "pos", F.length(F.regexp_replace("signs", "[^>]", "")).alias("level"), F.expr("substring(line, length(signs) + 1)").alias("t"))
    order = Window.partitionBy("conv", "turn", "h").orderBy("pos")  # one message's lines
    return lines.withColumn("new", F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(order)).drop("new")


def quote_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, parent, n_linked): the turn that each message with linked quotes answers, and how many distinct quoted passages and lines link."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).try_cast("long").alias("turn"), F.col(text).alias("text")).where("conv is not null and turn is not null and text is not null")
    quoting = rows.where(F.col("text").rlike(QUOTED)).distinct()
    lines = _quoting_lines(quoting)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n")
    runs = lines.groupBy("conv", "turn", "h", "run", "level").agg(joined.alias("t"))
    passages = lines.select("conv", "turn", "level", "t").union(runs.select("conv", "turn", "level", "t"))
    # what nobody can quote from isn't hashed
    rows = rows.join(quoting.select("conv").distinct(), "conv", "left_semi")
    own = rows.select("conv", "turn", F.regexp_replace("text", CUT, "").alias("t"))
    own = own.union(own.select("conv", "turn", F.explode(F.split("t", r"\r?\n")).alias("t"))).union(passages.where("level = 0").select("conv", "turn", "t"))
    first = _keys(own, "conv", "turn").groupBy("conv", "hash").agg(F.min("turn").alias("parent"))
    quotes = _keys(passages.where("level > 0"), "conv", "turn", "level").groupBy("conv", "turn", "hash").agg(F.min("level").alias("level"), F.max("size").alias("size"))
    linked = quotes.join(first, ["conv", "hash"]).where("parent < turn")
    by_parent = linked.groupBy("conv", "turn", "parent").agg(F.min("level").alias("level"), F.sum("size").alias("size"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("outer"), "size", "parent"))
    return by_parent.groupBy("conv", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select("conv", "turn", F.col("best.parent").alias("parent"), "n_linked")


def _siblings(links: DataFrame) -> DataFrame:
    """links with prev: the turn before that answers the same message. Windows are over groups of at most NEAR turns, then over the groups."""
    rows = links.select("conv", "turn", "parent", F.floor(F.col("turn") / NEAR).alias("part"))
    inner, outer = Window.partitionBy("conv", "parent", "part").orderBy("turn"), Window.partitionBy("conv", "parent").orderBy("part")
    tops = rows.groupBy("conv", "parent", "part").agg(F.max("turn").alias("top")).select("conv", "parent", "part", F.lag("top").over(outer).alias("top"))
    rows = rows.withColumn("prev", F.lag("turn").over(inner))
    return rows.join(tops, ["conv", "parent", "part"]).select("conv", "turn", "parent", F.coalesce("prev", "top").alias("prev"))


def reply_order(links: DataFrame) -> DataFrame:
    """(conv, turn, thread_turn, reply_order, depth) of each message of a thread with answers; links: (conv, turn, parent), a row for each answer.

    reply_order counts the thread's messages before this one, answers following
    what they answer in order of their turns. A thread is a list of steps, one
    down to each message and one up from it; each round of pointer doubling
    joins every step to the one that its pointer shows.
    """
    child = cut(_siblings(links))
    last = child.groupBy("conv", F.col("parent").alias("turn")).agg(F.max("turn").alias("last"))
    opening = last.select("conv", "turn").join(child, ["conv", "turn"], "left_anti")
    none = F.lit(None).cast("long")
    # (t, up): the step; (to, to_up): the step before it
    down = child.select("conv", F.col("turn").alias("t"), F.lit(False).alias("up"), F.coalesce("prev", "parent").alias("to"), F.col("prev").isNotNull().alias("to_up"))
    down = down.union(opening.select("conv", "turn", F.lit(False), none, F.lit(None).cast("boolean")))
    nodes = child.select("conv", "turn").union(opening).join(last, ["conv", "turn"], "left")
    up = nodes.select("conv", F.col("turn").alias("t"), F.lit(True).alias("up"), F.coalesce("last", "turn").alias("to"), F.col("last").isNotNull().alias("to_up"))
    step = down.union(up).select("*", F.when(F.col("to").isNull(), F.col("t")).alias("head"), F.when(F.col("up"), 0).otherwise(1).cast("long").alias("n"), F.when(F.col("up"), -1).otherwise(1).cast("long").alias("deep"))
    step = cut(step)
    while not step.where("to is not null").isEmpty():
        before = step.select("conv", F.col("t").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("to2"), F.col("to_up").alias("to_up2"), F.col("head").alias("head2"), F.col("n").alias("n2"), F.col("deep").alias("deep2"))
        moved = step.where("to is not null").join(before, ["conv", "to", "to_up"]).select("conv", "t", "up", F.col("to2").alias("to"), F.col("to_up2").alias("to_up"), F.col("head2").alias("head"), (F.col("n") + F.col("n2")).alias("n"), (F.col("deep") + F.col("deep2")).alias("deep"))
        step = cut(step.where("to is null").unionByName(moved))
    return step.where("not up").select("conv", F.col("t").alias("turn"), F.col("head").alias("thread_turn"), (F.col("n") - 1).alias("reply_order"), (F.col("deep") - 1).alias("depth"))


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """messages without quotes, with parent_turn (null: opens a thread), thread_turn, reply_order, depth, n_quotes (quoted lines), n_linked and chat.

    Rows of a conversation sorted by thread_turn and reply_order are in reply
    order. chat is the message as a chat turn: the role between bars, a line
    feed and the text.
    """
    links = cut(quote_links(messages, conv, turn, text))
    order = reply_order(links).join(links, ["conv", "turn"], "left")
    new = ["parent_turn", "thread_turn", "reply_order", "depth", "n_quotes", "n_linked", "chat"]
    rows = messages.select(*[messages[c] for c in messages.columns if c not in new])
    kept = rows.columns
    own = {c: unused(rows, f"_{c}") for c in ("conv", "turn", "parent", "thread", "order", "depth", "linked", "body")}
    order = order.select(F.col("conv").alias(own["conv"]), F.col("turn").alias(own["turn"]), F.col("parent").alias(own["parent"]), F.col("thread_turn").alias(own["thread"]), F.col("reply_order").alias(own["order"]), F.col("depth").alias(own["depth"]), F.col("n_linked").alias(own["linked"]))
    quotes = F.coalesce(F.regexp_count(text, F.lit(QUOTED)), F.lit(0)).cast("long")
    rows = rows.select(*kept, quotes.alias("n_quotes"))
    # messages without quotes answer nothing, so only the others go through the join
    quoted = rows.where("n_quotes > 0")
    quoted = quoted.join(order, (quoted[conv] == order[own["conv"]]) & (quoted[turn].try_cast("long") == order[own["turn"]]), "left")
    found = [own[c] for c in ("parent", "thread", "order", "depth", "linked")]
    plain = rows.where("n_quotes = 0").select(*kept, "n_quotes", *[F.lit(None).cast("long").alias(c) for c in found])
    out = quoted.select(*kept, "n_quotes", *[F.col(c).cast("long").alias(c) for c in found]).unionByName(plain)
    body = F.regexp_replace(F.regexp_replace(text, CUT, ""), r"(?U)^\s+|\s+\z", "")
    out = out.withColumn(own["body"], F.when(F.col("n_quotes") > 0, body).otherwise(F.col(text)))
    zero = lambda c: F.coalesce(F.col(own[c]), F.lit(0)).cast("long")
    return out.select(
        *[F.col(own["body"]).alias(text) if c == text else F.col(c) for c in kept],
        F.col(own["parent"]).alias("parent_turn"),
        F.coalesce(F.col(own["thread"]), F.col(turn).try_cast("long")).alias("thread_turn"),
        zero("order").alias("reply_order"),
        zero("depth").cast("int").alias("depth"),
        "n_quotes",
        zero("linked").alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("")), F.lit("|>\n"), F.coalesce(own["body"], F.lit(""))).alias("chat"),
    )
