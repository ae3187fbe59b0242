"""Chat formatting by quotation linking. DataFrame functions only.

A message's lines are split into its own words and quotations by the nesting of the
marks before them ("> > text" is level 2). A passage is the lines of one level in one
quoted block, so that a reply which quotes a whole message that itself quotes has one
passage for each author. Passages are normalised (case, blanks) and hashed; originals
are indexed by the hash of their own words as a whole, of each paragraph and of each
line, and joined on (conversation, hash). A passage belongs to the latest earlier
turn that has it; where none has it as one unit, to the latest that has all its
paragraphs, each whole or by all its lines. A message replies to the original of its shallowest linked passage,
the latest of them on ties.

"The latest earlier" is one pass over passages and originals sorted together: in each
sorted run the last original seen, before it what earlier runs of the key ended with.
A passage that every turn of a conversation has costs a row for each turn and no pairs.
Passages in parts are looked up once for each distinct text of a conversation, by the
part of it that the fewest turns have.

Conversations come out in reply order: by the first turn of the reply chain, then by
turn. Positions come from one distributed sort, so that a conversation with a third
of all messages is still many tasks.

Null and empty texts are messages with an empty body. Rows with a null conversation
or turn stay; nothing links to or from them. Repeated (conversation, turn) rows are
messages of their own and share the reply of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserlog.llm.shared import written

MARKS = r"^([ \t]*>)+"
PARAGRAPH = r"\n[ \t\r]*\n"


def level_of(line: Column) -> Column:
    """How deep a line is quoted; 0 for the writer's own."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def body_of(text: Column) -> Column:
    """The writer's own lines."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: level_of(x) == 0)
    return F.regexp_replace(F.array_join(own, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, paras): the quoted passages of all messages; each paragraph as its hash ``p`` and those of its lines ``ls``."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"((?:^|\n)[ \t]*>[^\n]*)+"), 0)).alias("block")
    lines = messages.where(F.col("text").contains(">")).select("conv", "turn", block).select("conv", "turn", F.split("block", "\n").alias("lines"))
    deepest = F.array_max(F.transform("lines", level_of))
    each = lines.select("conv", "turn", "lines", F.explode(F.sequence(F.lit(0), deepest)).alias("level")).where("level > 0")
    raw = F.array_join(F.transform(F.filter("lines", lambda x: level_of(x) == F.col("level")), unquoted), "\n")

    def units(text: Column, cut: str) -> Column:
        return F.filter(F.split(text, cut), lambda x: normalised(x) != "")

    def digest(text: Column) -> Column:
        return F.sha2(normalised(text), 256)

    paras = F.transform(units(F.col("raw"), PARAGRAPH), lambda x: F.struct(digest(x).alias("p"), F.array_distinct(F.transform(units(x, "\n"), digest)).alias("ls")))
    found = each.select("conv", "turn", "level", raw.alias("raw")).where(normalised(F.col("raw")) != "")
    return found.select("conv", "turn", "level", digest(F.col("raw")).alias("hash"), paras.alias("paras")).distinct()


def originals(messages: DataFrame) -> DataFrame:
    """(conv, turn, hash) of every message's own words: whole, by paragraph and by line."""
    whole, parts, lines = F.array("body"), F.split("body", PARAGRAPH), F.split("body", "\n")
    units = F.array_distinct(F.filter(F.transform(F.concat(whole, parts, lines), normalised), lambda x: x != ""))
    return messages.select("conv", "turn", F.explode(units).alias("u")).select("conv", "turn", F.sha2("u", 256).alias("hash"))


def latest_before(asked: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``asked(by, turn, ...)`` with ``source``: the latest turn in ``held(by, at)`` under theirs with the same key, null without one."""
    rest = [c for c in asked.columns if c not in (*by, "turn")]
    both = asked.withColumn("at", F.lit(None).cast("long")).unionByName(
        held.select(*by, F.col("at").alias("turn"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest], "at")
    )
    # of one turn what asks comes first, so that it sees earlier turns only
    placed = both.orderBy(*by, "turn", F.col("at").isNotNull()).withColumn("place", F.monotonically_increasing_id()).withColumn("run", F.shiftright("place", 33))
    placed = written(placed, "chat-asof")
    ends = placed.where("at is not null").groupBy(*by, "run").agg(F.max("at").alias("end"))
    # a key has one row here for each run of the sort that holds some of it
    runs = placed.select(*by, "run").distinct().join(ends, [*by, "run"], "left")
    before = F.max("end").over(Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*by, "run", before.alias("earlier"))
    inside = F.last("at", ignorenulls=True).over(Window.partitionBy(*by, "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    seen = placed.withColumn("inside", inside).where("at is null").join(runs, [*by, "run"], "left")
    return seen.select(*by, "turn", *rest, F.coalesce("inside", "earlier").alias("source"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, source): the latest earlier turn with the passage, null without one. Input: conv, turn, text, body."""
    whole = messages.where("conv is not null and turn is not null")
    quoted = written(passages(whole), "chat-quoted")
    # only conversations with quotations are indexed
    index = originals(whole.join(quoted.select("conv").distinct(), "conv", "left_semi")).select("conv", "hash", F.col("turn").alias("at")).distinct()
    index = written(index, "chat-index")
    asked = quoted.select("conv", "turn", "level", "hash").distinct()
    # an original that no passage has is not sorted
    held = index.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    exact = written(latest_before(asked, held, ["conv", "hash"]), "chat-exact")
    key = ["conv", "turn", "level", "hash"]
    parted = quoted.where("size(paras) > 1 or size(paras[0].ls) > 1").join(exact.where("source is null"), key, "left_semi")
    if not parted.isEmpty():
        exact = exact.join(in_parts(parted, index), key, "left").withColumn("source", F.coalesce("source", "part"))
    return exact.select(*key, "source")


def in_parts(parted: DataFrame, index: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, part): the latest earlier turn that has every paragraph of the passage, whole or by all its lines."""
    form = ["conv", "form"]
    # one text may be quoted with other paragraph breaks, and by many turns
    parted = written(parted.withColumn("form", F.sha2(F.to_json("paras"), 256)), "chat-parted")
    forms = parted.groupBy(*form).agg(F.any_value("paras").alias("paras"))
    paras = forms.select(*form, F.size("paras").alias("n"), F.posexplode("paras").alias("i", "para"))
    line = F.transform("para.ls", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("h")))
    units = F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("para.p").alias("h"))), line)).alias("u")
    each = written(paras.select(*form, "n", "i", F.size("para.ls").alias("lines"), units).select("*", "u.*").drop("u"), "chat-units")
    by = index.select("conv", F.col("hash").alias("h"), "at")
    # how many turns could hold a paragraph: those that hold it whole, and those that hold its rarest line
    often = by.join(each.select("conv", "h").distinct(), ["conv", "h"], "left_semi").groupBy("conv", "h").agg(F.count("*").alias("turns"))
    sized = written(each.join(often, ["conv", "h"], "left").withColumn("turns", F.coalesce("turns", F.lit(0))), "chat-sized")
    line_of = F.when(~F.col("whole"), F.struct("turns", "h"))
    para = sized.groupBy(*form, "i").agg(F.sum(F.when(F.col("whole"), F.col("turns"))).alias("w"), F.max(F.when(F.col("whole"), F.col("h"))).alias("p"), F.min(line_of).alias("l"))
    least = para.groupBy(*form).agg(F.min(F.struct((F.col("w") + F.col("l.turns")).alias("turns"), "i", "p", "l.h")).alias("r"))
    start = least.where("r.turns > 0").select(*form, F.explode(F.array_distinct(F.array("r.p", "r.h"))).alias("h"))
    turns = written(start.join(by, ["conv", "h"]).select(*form, "at").distinct(), "chat-turns")
    met = turns.join(each, form).join(by.withColumn("here", F.lit(True)), ["conv", "h", "at"], "left_semi")
    have = met.groupBy(*form, "n", "at", "i", "lines").agg(F.max("whole").alias("whole"), F.sum((~F.col("whole")).cast("int")).alias("held"))
    full = have.where("whole or held = lines").groupBy(*form, "n", "at").agg(F.count("*").alias("have")).where("have = n").select(*form, "at")
    asked = parted.select(*form, "turn", "level", "hash").distinct()
    found = latest_before(asked, written(full, "chat-full"), form)
    return found.groupBy("conv", "turn", "level", "hash").agg(F.max("source").alias("part"))


def format_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, without quotations: conversation, turn, role, body, n_quoted, n_linked, reply_to, root_turn, position (from 1)."""
    rows = table.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), body_of(F.col(text_col)).alias("body")
    )
    links = written(link_quotations(rows), "chat-links")
    shallow = F.struct((-F.col("level")).alias("l"), F.col("source").alias("s"))
    replies = links.groupBy("conv", "turn").agg(
        F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"), F.max(F.when(F.col("source").isNotNull(), shallow))["s"].alias("reply_to")
    )
    # the first turn of each reply chain, by doubling the distance
    chain = written(replies.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("root")), "chat-chain")
    while True:
        up = chain.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        if chain.join(up, ["conv", "root"], "left_semi").isEmpty():
            break
        chain = written(chain.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("above", "root").alias("root")), "chat-chain")
    placed = (
        rows.select("conv", "turn", "role", "body", F.sha2(F.coalesce("text", F.lit("")), 256).alias("tie"))
        .join(replies, ["conv", "turn"], "left").join(chain, ["conv", "turn"], "left")
        .withColumn("root", F.coalesce("root", "turn"))
        .orderBy("conv", "root", "turn", "role", "tie")
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = written(placed, "chat-order")
    # a conversation has one row here for each task of the sort that holds some of it
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("conv", part).agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = runs.select("conv", "part", (before - F.col("least") + 1).alias("shift"))
    out = placed.withColumn("part", part).join(offset.where("conv is not null"), ["conv", "part"], "left")
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.col("root").alias("root_turn"), (F.col("at") + F.col("shift")).alias("position"),
    )


def transcripts(formatted: DataFrame, conv_col: str = "conv_id", size: int = 1024) -> DataFrame:
    """(conversation, segment, messages): reply-ordered messages in arrays of at most ``size``."""
    segment = F.floor((F.col("position") - 1) / size)
    message = F.struct("position", "role", "body")
    return formatted.groupBy(conv_col, segment.alias("segment")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
