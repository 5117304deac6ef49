"""Quotation linking for chats, in DataFrame operations only.

Each message is split into passages of lines with one quote level (the number of
leading '>').  Quoted passages are normalised (white space, case) and hashed, as
are the unquoted passages and lines of all messages; a join on conversation and
hash finds the earliest message that wrote the words itself.  A message replies
to the earlier message that its outermost linked quote comes from.  Pointer
jumping along the replies gives each message its thread and depth, and messages
are ordered so that replies follow what they answer: by thread, then turn.

Positions come from counts of blocks of BLOCK turns, so that one conversation
may hold any share of all messages: no window or list spans a whole
conversation, but for one row a block.

Defined results: a null text is empty; a message whose quotes match nothing
earlier replies to nothing and starts a thread; rows with a null conversation or
turn are not linked and stand as threads of their own without a place; rows that
repeat a turn are ordered by role and text, rows alike in everything in any order;
extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 1024
#: Messages of one chunk of a rendered conversation.
CHUNK = 256
MARK = r"^(?:[ \t]*>)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def unmarked(line: Column) -> Column:
    return F.regexp_replace(line, MARK + "[ \t]?", "")


def normal(passage: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(passage, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, row (tells rows of one turn apart), body (unquoted lines), passages
    (array of level and normalised text, in order, without empty ones)."""
    text = F.coalesce(messages["text"], F.lit(""))
    df = messages.select("conv_id", "turn", "role", F.xxhash64("role", text).alias("row"), F.split(text, r"\r?\n").alias("lines"))
    levels = F.transform("lines", level)
    df = df.withColumn("levels", levels)
    plain = F.transform(F.filter(F.arrays_zip("lines", "levels"), lambda x: x["levels"] == 0), lambda x: x["lines"])
    body = F.regexp_replace(F.array_join(plain, "\n"), r"^(?:[ \t]*\n)+|\s+$", "")
    # A line that changes the level begins a passage: marked, joined and split again, which is linear. A line holds no line
    # end, and each is put in after one and a space, so one before > is a mark, whatever the message holds.
    before = F.concat(F.array(F.lit(-1)), F.slice("levels", 1, F.greatest(F.size("levels") - 1, F.lit(0))))
    marked = F.transform(
        F.arrays_zip("lines", "levels", before.alias("before")),
        lambda x: F.concat(F.when(x["levels"] == x["before"], F.lit("\n ")).otherwise(F.concat(F.lit("\n>"), x["levels"].cast("string"), F.lit("\n "))), unmarked(x["lines"])),
    )
    runs = F.transform(F.filter(F.split(F.array_join(marked, ""), "\n>"), lambda p: p != ""), lambda p: F.split(p, "\n "))
    passages = F.transform(runs, lambda p: F.struct(p[0].cast("int").alias("level"), F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), "\n").alias("text")))
    return df.select("conv_id", "turn", "role", "row", body.alias("body"), F.filter(passages, lambda p: normal(p["text"]) != "").alias("passages"))


def keys(own: Column) -> Column:
    """Hashes by which a passage is known: rank 0 the whole, rank 1 each of its lines."""
    whole = F.array(F.struct(F.lit(0).alias("rank"), F.sha2(normal(own["text"]), 256).alias("hash")))
    lines = F.transform(F.filter(F.split(own["text"], "\n"), lambda x: normal(x) != ""), lambda x: F.struct(F.lit(1).alias("rank"), F.sha2(normal(x), 256).alias("hash")))
    return F.concat(whole, lines)


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, row, level, place, rank, origin: the earliest earlier turn that wrote a quoted passage
    (or, rank 1, one of its lines)."""
    known = messages.where("conv_id is not null and turn is not null")
    quotes = known.where(F.exists("passages", lambda p: p["level"] > 0)).select("conv_id", "turn", "row", F.posexplode("passages").alias("place", "p")).where("p.level > 0")
    quotes = quotes.select("conv_id", "turn", "row", "place", F.col("p.level").alias("level"), F.explode(F.array_distinct(keys(F.col("p")))).alias("k")).select("conv_id", "turn", "row", "place", "level", "k.rank", "k.hash")
    wanted = quotes.select("conv_id", "hash").distinct()
    own = known.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] == 0)).alias("p"))
    wrote = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(keys(F.col("p")), lambda k: k["hash"]))).alias("hash"))
    first = wrote.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    return quotes.join(first, ["conv_id", "hash"]).where("origin < turn").select("conv_id", "turn", "row", "level", "place", "rank", "origin")


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the turn at the end of the replies), depth, by pointer jumping. replies: conv_id, turn, reply_to,
    one row for each turn that replies."""
    at = table(replies.select("conv_id", "turn", F.col("reply_to").alias("to"), F.lit(1).cast("long").alias("depth")), "jumps")
    while True:
        far = at.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("far"), F.col("depth").alias("more"))
        new = table(at.join(far, ["conv_id", "to"], "left").select("conv_id", "turn", F.coalesce("far", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")), "jumps")
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return at.select("conv_id", "turn", F.col("to").alias("thread"), "depth")


def placed(df: DataFrame) -> DataFrame:
    """The column position: 0, 1 … within each conversation by thread, turn, role and row."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    df = df.withColumn("tb", block("thread")).withColumn("ub", block("turn"))
    first = df.groupBy("conv_id", "tb").agg(F.count("*").alias("n"))
    before = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    first = first.select("conv_id", "tb", before(Window.partitionBy("conv_id").orderBy("tb")).alias("n1"))
    second = df.groupBy("conv_id", "tb", "thread", "ub").agg(F.count("*").alias("n"))
    second = second.select("conv_id", "tb", "thread", "ub", before(Window.partitionBy("conv_id", "tb").orderBy("thread", "ub")).alias("n2"))
    own = F.row_number().over(Window.partitionBy("conv_id", "tb", "thread", "ub").orderBy("turn", "role", "row"))
    return df.withColumn("n3", own).join(second, ["conv_id", "tb", "thread", "ub"]).join(first, ["conv_id", "tb"]).withColumn("position", (F.col("n1") + F.col("n2") + F.col("n3") - 1).cast("long"))


OUT = ["conv_id", "turn", "role", "reply_to", "thread", "depth", "position", "n_quotes", "n_linked", "body"]


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every message without its quotes: conv_id, turn, role, reply_to, thread, depth, position (in its conversation),
    n_quotes (quoted passages), n_linked (those of which the whole or a line is found), body."""
    rows = table(parsed(messages), "messages")
    found = table(links(rows), "links")
    # The outermost level, then whole passages, then the first place; the turn of the chosen one.
    best = found.groupBy("conv_id", "turn", "row").agg(F.min(F.struct("level", "rank", "place", "origin"))["origin"].alias("reply_to"), F.count_distinct("place").alias("n_linked"))
    of_turn = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "rank", "place", "origin"))["origin"].alias("reply_to"))
    thread = threads(of_turn)
    df = rows.join(best, ["conv_id", "turn", "row"], "left").join(thread, ["conv_id", "turn"], "left")
    df = df.withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long"), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "n_quotes": F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")})
    df = table(df.drop("passages"), "linked")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return placed(df.where(whole)).select(*OUT).unionByName(df.where(~whole).withColumn("position", F.lit(None).cast("long")).select(*OUT))


def conversations(linked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Reply-ordered conversations without quotes: conv_id, chunk, messages (array of role and body) of at most `chunk` messages."""
    each = linked.where("position is not null").withColumn("chunk", F.floor(F.col("position") / chunk))
    listed = F.sort_array(F.collect_list(F.struct("position", "role", "body")))
    return each.groupBy("conv_id", "chunk").agg(listed.alias("m")).select("conv_id", "chunk", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["body"].alias("body"))).alias("messages"))
