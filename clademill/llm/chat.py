"""Chat formatting over reply trees, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clademill.llm.common import save

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>"


def escape(text: Column) -> Column:
    """Text without any control string of the template, reversibly.

    A backslash is doubled, ``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes
    ``#\\#``: a single backslash is then only ever part of an escape.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(CLOSE), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("##"), F.lit("#\\#"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    text = F.replace(text, F.lit("#\\#"), F.lit("##"))
    text = F.replace(text, F.lit("<\\/turn>"), F.lit(CLOSE))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # doubled backslashes pair up from the left, and no other escape holds one: what lies between them is read apart
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(parts, "\\")


def _key(name: str) -> Column:
    """A join key that is equal for equal values and for two nulls."""
    return F.struct(F.col(name).alias("id"))


def root_paths(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Every root-to-leaf path of reply trees, one row per message of a path.

    ``messages``: ``(conv_id, msg_id, parent_id)`` and more columns. A row whose
    parent is null or absent in its tree is a root. A null ``conv_id`` is one tree,
    a null ``msg_id`` one message of its tree that no row answers. The leaves'
    ancestors double in reach with each self-join, so depth ``d`` takes ``log2(d)``
    rounds, each of which goes to the shared folder; replies in a cycle are an
    error. Returns ``(conv_id, leaf_id, msg_id, up)`` with ``up`` 0 at the leaf.
    """
    keys = messages.select(_key("conv_id").alias("conv"), _key("msg_id").alias("msg"), "parent_id").groupBy("conv", "msg").agg(F.min("parent_id").alias("parent_id"))
    keys = keys.select("conv", "msg", F.when(F.col("parent_id").isNotNull(), _key("parent_id")).alias("parent"))
    known = keys.select("conv", F.col("msg").alias("parent"))
    up = keys.join(known.withColumn("known", F.lit(True)), ["conv", "parent"], "left")
    up = up.select("conv", "msg", F.when(F.col("known"), F.col("parent")).alias("parent"))
    jump = save(up.where("parent IS NOT NULL").select("conv", F.col("msg").alias("from"), F.col("parent").alias("to")), "replies")
    parents = jump.df.select("conv", F.col("to").alias("low")).distinct()
    leaves = up.select("conv", F.col("msg").alias("low")).join(parents, ["conv", "low"], "left_anti")
    pairs = leaves.select("conv", "low", F.col("low").alias("high"), F.lit(0).alias("up"))
    reach, rounds = 1, 0
    while not jump.df.isEmpty():
        # pairs hold the leaves' ancestors nearer than reach; jump leads exactly `reach` up
        far = pairs.join(jump.df.withColumnRenamed("from", "high"), ["conv", "high"]).select(
            "conv", "low", F.col("to").alias("high"), (F.col("up") + reach).alias("up"))
        pairs = save(pairs.unionByName(far), "ancestors").df
        onward = jump.df.select("conv", F.col("from").alias("to"), F.col("to").alias("next"))
        jump = save(jump.df.join(onward, ["conv", "to"]).select("conv", "from", F.col("next").alias("to")), "replies")
        reach, rounds = reach * 2, rounds + 1
        if rounds > max_rounds:
            raise ValueError("the replies form a cycle, or are deeper than max_rounds allows")
    return pairs.select(F.col("conv.id").alias("conv_id"), F.col("low.id").alias("leaf_id"), F.col("high.id").alias("msg_id"), "up")


def best_branches(messages: DataFrame, top: int = 1, max_rounds: int = 40) -> DataFrame:
    """The ``top`` branches of each tree by summed score, longer and then smaller leaf on ties.

    One row per message: ``conv_id, branch, leaf_id, turn`` (0 at the root) and
    the message's own columns; columns of the caller's named like the first four
    or ``parent_id`` are replaced. Of rows with one ``conv_id`` and ``msg_id`` the least
    parent, score and remaining values stay. A branch of null scores ranks last.
    """
    paths = root_paths(messages, max_rounds).select(_key("conv_id").alias("conv"), _key("leaf_id").alias("leaf"), _key("msg_id").alias("msg"), "up")
    held = [c for c in messages.columns if c not in ("conv_id", "msg_id", "parent_id", "branch", "leaf_id", "turn")]
    order = [F.col(c) for c in sorted(held, key=lambda c: c != "score")]
    own = messages.select(_key("conv_id").alias("conv"), _key("msg_id").alias("msg"), F.struct("parent_id", *order).alias("row")).groupBy("conv", "msg").agg(F.min("row").alias("row"))
    rows = paths.join(own, ["conv", "msg"])
    ranked = rows.groupBy("conv", "leaf").agg(F.sum("row.score").alias("total"), F.count(F.lit(1)).alias("length"))
    best = W.partitionBy("conv").orderBy(F.desc_nulls_last("total"), F.desc("length"), "leaf")
    ranked = ranked.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top)
    rows = rows.join(ranked, ["conv", "leaf"])
    turn = F.col("length") - 1 - F.col("up")
    return rows.select(F.col("conv.id").alias("conv_id"), F.col("msg.id").alias("msg_id"), "branch", F.col("leaf.id").alias("leaf_id"), turn.alias("turn"), *(F.col("row")[c].alias(c) for c in held))


def format_branches(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One formatted conversation per key, with its loss mask.

    ``turns``: the keys, ``turn``, ``role``, ``text`` (null: empty; a null role is
    the empty role). Rows with equal turns are ordered by role and text. Returns
    the keys, ``formatted`` and ``loss_mask``, an array of ``(start, end)`` code
    points that cover the assistants' escaped texts and nothing between.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), _escape_role(role), F.lit(MIDDLE))
    body = escape(text)
    row = F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    per = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    formatted = F.concat_ws("", F.transform("rows", lambda r: F.concat(r.head, r.body, F.lit(CLOSE + "\n"))))
    size = lambda r: F.length(r.head) + F.length(r.body) + len(CLOSE) + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r.head)
        span = F.array(F.struct(start.cast("int").alias("start"), (start + F.length(r.body)).cast("int").alias("end")))
        return F.struct((acc["at"] + size(r)).alias("at"), F.when(r.role == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return per.select(*keys, formatted.alias("formatted"), F.aggregate("rows", zero, step)["spans"].alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted conversation: array of ``(role, text)``."""
    parts = F.split(formatted, CLOSE + "\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        end = F.instr(p, MIDDLE)
        role = F.substring(p, F.lit(len(OPEN) + 1), end - 1 - len(OPEN))
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(p, end + len(MIDDLE), F.length(p))).alias("text"))

    return F.transform(parts, one)


def messages_of(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it.

    Rows are ordered by turn, then role and text; equal rows stay apart.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return rows.select("conv_id", "msg_id", parent.alias("parent_id"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text")


PROBE = "\\### Assistant: </turn> ok"


def chat_query(conversations: DataFrame) -> DataFrame:
    """Contract rows of op10, read back from the formatted conversations.

    All conversations plus conversation -7 (a user row, then an assistant row,
    both with ``PROBE``). No rows for an empty table but that of -7. Rows of a null
    id are one conversation, with a null id.
    """
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").cast("bigint").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    messages = save(messages_of(rows), "messages").df  # read again in every round of the self-joins
    chosen = best_branches(messages)
    out = format_branches(chosen, ["conv_id"]).withColumn("turns", parse(F.col("formatted")))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.end - s.start))))
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
