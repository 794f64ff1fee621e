"""Chat formatting as prefix trees: conversations that share their first turns are merged.

A node is a turn together with all turns before it; every node's tokens are emitted once, in depth-first order of
the trees. A node has the place of its first token in that order (``start``), position ids (its tokens' places in
the conversation), a loss mask over its tokens as an interval, and the intervals of the order that its tokens
attend to besides the node itself: those of its ancestors, merged where they touch.

Depth-first order is the order of the paths, so distinct conversations are ranged by their path of turn hashes;
a node belongs to the first conversation that has it. Places are running sums within a range over the ranges'
totals. No tree is ever in one task: a first turn that a third of all conversations share is one node and many
ranges, and joins with that node are cut into parts. Copies of a conversation are one path.

Template: ``<s>[INST] text [/INST]`` for user, `` text </s>`` for assistant, ``<<SYS>> text <</SYS>>`` for system and
``<<ROLE name>> text <</ROLE>>`` for others. In texts (and names) a backslash stands before every backslash, ``<``
and ``[`` (and ``>`` in names), so no text holds a control string, and removing them is exact.

Defined results: null text and null role are empty; rows of one conversation follow turn, then role, then text;
repeated rows are turns of their own; a very long text is one node; a null conversation id is a conversation; other
columns, whatever their names, are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.byte_bpe import encoder
from statuta.llm.common import join_salted, prepare, tidy, width, written

_BODY = r"([^\\<\[]*(?:\\.[^\\<\[]*)*)"
TURN = re.compile(rf"<s>\[INST\] {_BODY} \[/INST\]|<<SYS>> {_BODY} <</SYS>>|<<ROLE ((?:[^\\>]|\\.)*)>> {_BODY} <</ROLE>>| {_BODY} </s>", re.DOTALL)


def escape(text: str, marks: str = "\\<[") -> str:
    return re.sub(f"([{re.escape(marks)}])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands behind it."""
    body = escape(text)
    if role == "user":
        return "<s>[INST] ", body, " [/INST]"
    if role == "assistant":
        return " ", body, " </s>"
    if role == "system":
        return "<<SYS>> ", body, " <</SYS>>"
    return f"<<ROLE {escape(role, chr(92) + '<[>')}>> ", body, " <</ROLE>>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, system, name, other, assistant = m.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif system is not None:
            out.append(("system", unescape(system)))
        elif name is not None:
            out.append((unescape(name), unescape(other)))
        else:
            out.append(("assistant", unescape(assistant)))
        at = m.end()
    return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations to their nodes' ids (a digest of the turns so far) and sort key (a digest of each turn)."""
    for batch in batches:
        keys, nodes = [], []
        for turns in batch.column("turns").to_pylist():
            key, chain, own = b"", b"", []
            for t in turns:
                digest = hashlib.blake2b(f"{len(t['role'])}:{t['role']}{t['text']}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                chain = hashlib.blake2b(chain + digest, digest_size=16).digest()
                key += digest[:8]
                own.append(chain)
            keys.append(key)
            nodes.append(own)
        yield pa.record_batch({"conv": batch.column("conv"), "key": pa.array(keys, pa.binary()), "nodes": pa.array(nodes, pa.list_(pa.binary())), "turns": batch.column("turns")})


@tidy
def build(conversations: DataFrame, conv_col: str = "conv_id", ranks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and index.

    Nodes: node, tree (its root), depth, start, token_ids, position_ids, loss_from and loss_to (of its tokens),
    ancestors (intervals of the order). Index: the conversation's id and its nodes from the root on.
    """
    spark = conversations.sparkSession
    prepare(spark)
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = conversations.schema[conv_col].dataType.simpleString()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = "array<struct<turn:long,role:string,text:string>>"
    talks = written(talks.mapInArrow(_paths, f"conv {kind}, key binary, nodes array<binary>, turns {turns}"), "talks")

    distinct = talks.select(F.element_at("nodes", -1).alias("leaf"), "key", "nodes", "turns").dropDuplicates(["leaf"]).drop("leaf")
    ranged = distinct.repartitionByRange(width(spark), "key").sortWithinPartitions("key", "nodes")
    ordered = written(ranged.withColumn("g", F.monotonically_increasing_id()).drop("key"), "paths")
    steps = ordered.select("g", F.posexplode(F.arrays_zip("nodes", "turns")).alias("depth", "x")).select("g", "depth", F.col("x.nodes").alias("node"), "x.turns.role", "x.turns.text")
    owned = steps.groupBy("node").agg(F.min(F.struct("g", "depth", "role", "text")).alias("x")).select("node", "x.*")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, public_tokenizers.PATTERN)[0].encode_ordinary
        for batch in batches:
            ids, begin, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                a, b, c = map(enc, segments(role, text))
                ids.append(a + b + c)
                begin.append(len(a))
                end.append(len(a) + (len(b) if role == "assistant" else 0))
            sizes = pa.array(map(len, ids), pa.int64())
            yield pa.record_batch([batch.column("node"), batch.column("g"), batch.column("depth"), pa.array(ids, pa.list_(pa.int32())), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), sizes], ["node", "g", "depth", "token_ids", "loss_from", "loss_to", "n"])

    tokens = written(owned.mapInArrow(encode, "node binary, g long, depth int, token_ids array<int>, loss_from long, loss_to long, n long"), "tokens")
    part = F.shiftright("g", 33)
    totals = tokens.groupBy(part.alias("part")).agg(F.sum("n").alias("total"))  # a row for each range
    bases = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    running = Window.partitionBy("part").orderBy("g", "depth").rowsBetween(Window.unboundedPreceding, -1)
    places = tokens.select("node", "g", "depth", "n", part.alias("part")).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    places = written(places.join(bases, "part").select("node", F.col("g").alias("owner"), (F.col("base") + F.col("before")).alias("start"), "n"), "places")
    routes = join_salted(steps.select("g", "depth", "node"), places, ["node"], "g").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "start", "n", "owner"))).alias("steps"))

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, route in zip(batch.column("g").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                spans, position = [], 0
                for s in route:
                    if s["owner"] == g:
                        out.append((s["node"], route[0]["node"], s["start"], position, list(map(tuple, spans))))
                    if spans and spans[-1][1] == s["start"]:
                        spans[-1][1] += s["n"]
                    else:
                        spans.append([s["start"], s["start"] + s["n"]])
                    position += s["n"]
            spans = pa.array([[{"from": a, "to": b} for a, b in x[4]] for x in out], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), spans], ["node", "tree", "start", "position", "ancestors"])

    placed = routes.mapInArrow(attach, "node binary, tree binary, start long, position long, ancestors array<struct<from:long,to:long>>")
    nodes = tokens.join(placed, "node").select(
        "node", "tree", "depth", "start", "token_ids", F.transform("token_ids", lambda _, i: (F.col("position") + i).cast("int")).alias("position_ids"), "loss_from", "loss_to", "ancestors"
    )
    return nodes, talks.select(F.col("conv").alias(conv_col), "nodes")


@tidy
def read_back(nodes: DataFrame, index: DataFrame, conv_col: str = "conv_id", ranks: str | None = None) -> DataFrame:
    """One row per conversation, from the emitted nodes alone: digests of its turns and of the text under the loss mask."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = index.schema[conv_col].dataType.simpleString()
    steps = index.select(F.col(conv_col).alias("conv"), F.posexplode("nodes").alias("at", "node"))
    rows = join_salted(steps, nodes.select("node", "token_ids", "loss_from", "loss_to"), ["node"], "conv")
    talks = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "token_ids", "loss_from", "loss_to"))).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = encoder(path, public_tokenizers.PATTERN)[0].decode_bytes
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                formatted = "".join(text_of(p["token_ids"]).decode() for p in parts)
                loss = "".join(unescape(text_of(p["token_ids"][p["loss_from"] : p["loss_to"]]).decode()) for p in parts)
                turns = parse(formatted)
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.record_batch([batch.column("conv"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names)

    return talks.mapInArrow(decode, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)


def attended(nodes: DataFrame) -> DataFrame:
    """How many tokens each node's first token attends to: those of its ancestors and itself; equals its position + 1."""
    before = F.aggregate("ancestors", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return nodes.select("node", (before + 1).alias("attended"), (F.get("position_ids", F.lit(0)) + 1).alias("place"))
