"""Chat formatting of reply trees.

Messages of a conversation form trees by parent. Every root-to-leaf path is a
branch. Branches are ranked by the sum of their messages' scores, and each
chosen one is formatted as one conversation with a loss mask over the
assistant's words.

Paths come from iterative self-joins that double the reach of each message's
link to its ancestor: 2, 4, 8, ... messages up, so a thread of n messages takes
log2(n) rounds, each written to the shared folder. Only the chosen leaves are
then expanded to the messages of their paths, in as many rounds, also written.

The template is

    ### <role>: <text></turn>\\n

for each turn. Inside roles and texts a backslash goes before each backslash,
each `###`, each `</turn>` and (in roles) each colon, so a text that holds
control strings is not taken for one, and removing those backslashes restores it.

Defined cases: null role or text: empty. A message without a parent in its
conversation, or whose parent does not come before it, is a root. Rows that
repeat a turn stay turns of their own, in order of role and text. Null conv_id
is a conversation of its own. Empty table: empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

TURN_END = "</turn>"
_ESCAPED = re.compile(r"\\|###|</turn>")
_ESCAPED_ROLE = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)  # possessive: no state is kept for each character
_BACK = re.compile(r"\\(.)", re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text, and the spans (code points, end exclusive) whose loss counts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {_ESCAPED_ROLE.sub(lambda m: chr(92) + m[0], role)}: "
        body = _ESCAPED.sub(lambda m: chr(92) + m[0], text)
        parts += [head, body, TURN_END, "\n"]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(TURN_END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((_BACK.sub(r"\1", m[1]), _BACK.sub(r"\1", m[2])))
        at = m.end()
    return turns


def reply_tree(conversations: DataFrame) -> DataFrame:
    """Rows by turn as messages (conv_id, msg, parent, role, text, score): each answers the one before it."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.select(
        "conv_id", F.row_number().over(by_turn).cast("long").alias("msg"), (F.row_number().over(by_turn) - 1).cast("long").alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, leaf, rank, place (messages below it on the path), msg for the `top` branches of each conversation by score, then by leaf."""
    nodes = saved(messages.select("conv_id", "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    ids = nodes.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"))
    here = F.col("conv_id").eqNullSafe(F.col("c"))
    up = saved(
        nodes.join(ids, here & (F.col("parent") == F.col("m")) & (F.col("m") < F.col("msg")), "left")
        .select("conv_id", "msg", F.col("m").alias("up"), "score"),
        "up",
    )
    reach = [up]  # up: the ancestor 2**k messages above; score: of the messages from msg up to it, or to the root if up is null
    at_root = lambda: reduce(DataFrame.unionByName, [x.where("up is null") for x in reach])
    while reach[-1].where("up is not null").limit(1).count():
        open_ended = reach[-1].where("up is not null")  # the others are done, and leave the rounds
        above = open_ended.unionByName(at_root()).select(
            F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("up").alias("next"), F.col("score").alias("more")
        )
        reach.append(
            saved(
                open_ended.join(above, here & (F.col("up") == F.col("m")), "left").select(
                    "conv_id", "msg", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
                ),
                "up",
            )
        )
    parents = up.where("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("m")).distinct()
    leaves = at_root().join(parents, here & (F.col("msg") == F.col("m")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "msg")))
    paths = ranked.where(F.col("rank") <= top).select("conv_id", F.col("msg").alias("leaf"), "rank", "msg", F.lit(0).cast("long").alias("place"))
    for k, step in enumerate(reach[:-1]):
        link = step.where("up is not null").select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "up")
        higher = paths.join(link, here & (F.col("msg") == F.col("m"))).select(
            "conv_id", "leaf", "rank", F.col("up").alias("msg"), (F.col("place") + 2**k).alias("place")
        )
        paths = saved(paths.unionByName(higher), "paths")
    return paths


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, leaf, rank, formatted, loss_spans: the chosen branches as conversations."""
    messages = saved(messages, "turns")
    words = messages.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (
        chosen_paths(messages, top)
        .join(words, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")))
        .groupBy("conv_id", "leaf", "rank")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("place"), "role", "text"))).alias("turns"))  # one conversation
    )

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column("turns")]
            texts = pa.array([text for text, _ in done], pa.string())
            masks = pa.array([[{"start": a, "end": b} for a, b in mask] for _, mask in done], spans)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), texts, masks], names=[*keys, "formatted", "loss_spans"])

    keys = ["conv_id", "leaf", "rank"]
    typed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("leaf").cast("long").alias("leaf"), F.col("rank").cast("int").alias("rank"), "turns")
    return typed.mapInArrow(write, "conv_id long, leaf long, rank int, formatted string, loss_spans array<struct<start:int,end:int>>")


def read_back(output: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted texts and masks alone."""

    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted"), batch.column("loss_spans"), strict=True):
                text = text.as_py()
                turns = parse_turns(text)
                loss = "".join(_BACK.sub(r"\1", text[s["start"] : s["end"]]) for s in spans.as_py())
                whole = "".join(f"{role}\n{words}\n" for role, words in turns)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha(whole), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            made = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made], names=["conv_id", *(name for name, _ in fields)])

    typed = output.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss_spans")
    return typed.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
