"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns' tokens. A node is a turn after certain earlier turns,
known by a digest of its whole path; each node is one row, however many conversations go through it and wherever they
are. Conversations sorted by their paths stand in depth-first order: a node belongs to the first conversation that has
it, so owner and depth order the nodes of a tree, and running sums of token counts lay the tree out. Nodes, not trees,
are rows, so that a first turn which a third of all conversations share is still written once and no row grows with
the number of conversations.

The template: ``[INST]user[/INST]``, ``<<SYS>>system<</SYS>>``, ``<s>assistant</s>``, other roles
``[ROLE]role[/ROLE]text[/TURN]``. In texts and roles a backslash is doubled, and a control string gets a backslash
behind its first character; so formatted texts hold no control string, and this can be taken back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: The control strings.
CONTROL = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"\[INST\](.*?)\[/INST\]|<<SYS>>(.*?)<</SYS>>|<s>(.*?)</s>|\[ROLE\](.*?)\[/ROLE\](.*?)\[/TURN\]", re.S)
_AROUND = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}

TOKENS = "tree_id string, node_id string, parent_id string, depth int, owner long, n long, input_ids array<int>, loss_mask array<boolean>"
TOKEN_ROWS = pa.schema([("tree_id", pa.string()), ("node_id", pa.string()), ("parent_id", pa.string()), ("depth", pa.int32()), ("owner", pa.int64()), ("n", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
LAYOUT = "node_id string, begin long, position long, attend array<struct<begin: long, end: long>>"
LAYOUT_ROWS = pa.schema([("node_id", pa.string()), ("begin", pa.int64()), ("position", pa.int64()), ("attend", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
SAID = "node_id string, position long, n long, role string, text string, learnt string, chars long"
SAID_ROWS = pa.schema([("node_id", pa.string()), ("position", pa.int64()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learnt", pa.string()), ("chars", pa.int64())])
#: Rows that a task works on at a time.
ROWS = 64


class ChatTrees(NamedTuple):
    """``nodes``: tree_id, node_id, parent_id, depth, begin and end (token places in the depth-first order of the
    tree), input_ids, position_ids, loss_mask, attend (begin, end of ancestors' places). ``conversations``: conv_id,
    tree_id, path (node ids from the root to the leaf)."""

    nodes: DataFrame
    conversations: DataFrame


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def wrap(role: str, text: str) -> tuple[str, str, str]:
    """(before, escaped text, after) of a turn."""
    before, after = _AROUND.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]")
    return before, escape(text), after


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        user, system, assistant, role, text = m.groups()
        kind, said = ("user", user) if user is not None else ("system", system) if system is not None else ("assistant", assistant) if assistant is not None else (unescape(role), text)
        turns.append((kind, unescape(said)))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # what texts say is never a special token
    return t


def _in_parts(batches: Iterator[pa.RecordBatch], rows: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            out = rows(batch.slice(first, ROWS).to_pylist())
            yield pa.record_batch([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)


def _path(digests: list[str]) -> list[str]:
    """The node ids of a conversation: each turn's digest hashed onto the id of the turn before."""
    out, at = [], b""
    for digest in digests:
        at = hashlib.blake2b(at + digest.encode(), digest_size=16).digest()
        out.append(at.hex())
    return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_parts(batches, lambda rows: [{"_c": r["_c"], "path": _path(r["digests"])} for r in rows], pa.schema([("_c", pa.int64()), ("path", pa.list_(pa.string()))]))


def _tokens(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    tok = _tokenizer(tokenizer)

    def rows(turns: list[dict]) -> list[dict]:
        pieces = [x for t in turns for x in wrap(t["role"], t["text"])]
        ids = [e.ids for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]
        for t, before, text, after in zip(turns, ids[::3], ids[1::3], ids[2::3], strict=True):
            t["input_ids"] = before + text + after
            t["n"] = len(t["input_ids"])
            t["loss_mask"] = [False] * len(before) + [t["role"] == "assistant"] * len(text) + [False] * len(after)
        return turns

    return _in_parts(batches, rows, TOKEN_ROWS)


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's path (line: depth, node_id, begin, n) the nodes that it owns, with the places of all
    earlier nodes as intervals."""

    def rows(lines: list[dict]) -> list[dict]:
        out = []
        for row in lines:
            before: list[tuple[int, int]] = []
            position = 0
            for x in row["line"]:
                if x["depth"] >= row["shared"]:
                    out.append({"node_id": x["node_id"], "begin": x["begin"], "position": position, "attend": [{"begin": i, "end": j} for i, j in before]})
                first = before.pop()[0] if before and before[-1][1] == x["begin"] else x["begin"]
                before.append((first, x["begin"] + x["n"]))
                position += x["n"]
        return out

    return _in_parts(batches, rows, LAYOUT_ROWS)


def format_chat_trees(conversations: DataFrame, *, tokenizer: str) -> ChatTrees:
    """The nodes (turns) of all prefix trees, each once, with tokens, position ids, loss mask and the intervals of
    ancestors' tokens that they attend to besides their own earlier ones; and each conversation's path of nodes.

    ``conversations``: conv_id, turn, role, text, by turn; rows of one turn number stand in order of role and text,
    and repeated rows stay. Null role or text is empty; a null turn comes first; rows without conv_id make one
    conversation. The loss mask is on the texts of assistant turns. Other columns are ignored; an empty table gives
    empty results. One conversation's turns meet in one task, as its token sequence has to.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text"))))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    digest = F.transform("turns", lambda t: F.sha2(F.concat(F.length(t["role"]), F.lit(" "), t["role"], t["text"]).cast("binary"), 256))
    whole = cut(whole.select(F.monotonically_increasing_id().alias("_c"), "conv_id", "turns", digest.alias("digests")), "chat-turns")

    # conversations in depth-first order, and the first of them that has each node
    paths = whole.select("_c", "digests").mapInArrow(_paths, "_c long, path array<string>")
    paths = cut(paths.repartitionByRange("path", "_c").sortWithinPartitions("path", "_c").select("_c", "path", F.monotonically_increasing_id().alias("no")), "chat-paths")
    owners = paths.select("no", F.explode("path").alias("node_id")).groupBy("node_id").agg(F.min("no").alias("no"))
    own = paths.join(owners.groupBy("no").agg(F.count("*").cast("int").alias("n_own")), "no").withColumn("shared", F.size("path") - F.col("n_own"))

    tails = whole.join(own, "_c").select("no", "path", "shared", F.posexplode(F.expr("slice(turns, shared + 1, n_own)")).alias("_p", "t"))
    depth = F.col("_p") + F.col("shared")
    each = tails.select(F.get("path", F.lit(0)).alias("tree_id"), F.get("path", depth).alias("node_id"), F.get("path", depth - 1).alias("parent_id"), depth.alias("depth"), F.col("no").alias("owner"), "t.role", "t.text")
    tokens = cut(each.mapInArrow(lambda batches: _tokens(batches, tokenizer), TOKENS), "chat-tokens")

    # a tree's tokens before a node: those in earlier ranges of conversations, and those in its own range
    counts = tokens.select("tree_id", "node_id", "owner", "depth", "n", F.shiftright("owner", 33).alias("part"))
    inner = Window.partitionBy("tree_id", "part").orderBy("owner", "depth")
    over = Window.partitionBy("tree_id").orderBy("part")
    bases = counts.groupBy("tree_id", "part").agg(F.sum("n").alias("m")).select("tree_id", "part", (F.sum("m").over(over) - F.col("m")).alias("base"))
    placed = counts.withColumn("_in", F.sum("n").over(inner) - F.col("n")).join(bases, ["tree_id", "part"]).select("node_id", "n", (F.col("base") + F.col("_in")).alias("begin"))
    line = own.select("no", "shared", F.posexplode("path").alias("depth", "node_id")).join(placed, "node_id")
    line = line.groupBy("no", "shared").agg(F.sort_array(F.collect_list(F.struct("depth", "node_id", "begin", "n"))).alias("line"))
    nodes = tokens.join(line.mapInArrow(_layout, LAYOUT), "node_id")
    nodes = nodes.select("tree_id", "node_id", "parent_id", "depth", "begin", (F.col("begin") + F.col("n")).alias("end"), "input_ids", F.expr("transform(input_ids, (x, i) -> CAST(position + i AS INT))").alias("position_ids"), "loss_mask", "attend")
    return ChatTrees(nodes, whole.select("_c", "conv_id").join(paths, "_c").select("conv_id", F.get("path", F.lit(0)).alias("tree_id"), "path"))


def _said(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    tok = _tokenizer(tokenizer)

    def rows(nodes: list[dict]) -> list[dict]:
        whole = tok.decode_batch([x["input_ids"] for x in nodes], skip_special_tokens=False)
        learnt = tok.decode_batch([[i for i, on in zip(x["input_ids"], x["loss_mask"], strict=True) if on] for x in nodes], skip_special_tokens=False)
        out = []
        for x, formatted, part in zip(nodes, whole, learnt, strict=True):
            ((role, text),) = parse(formatted)
            out.append({"node_id": x["node_id"], "position": x["position"], "n": len(x["input_ids"]), "role": role, "text": text, "learnt": unescape(part), "chars": len(formatted)})
        return out

    return _in_parts(batches, rows, SAID_ROWS)


def read_chat_trees(trees: ChatTrees, *, tokenizer: str) -> DataFrame:
    """Per conversation what its path through the tree says: number of turns, digest of roles and texts, characters
    and digest of what is under the loss mask, characters of the formatted conversation. Each node is decoded once;
    a path whose positions have gaps is an error."""
    said = trees.nodes.select("node_id", "input_ids", "loss_mask", F.get("position_ids", F.lit(0)).cast("long").alias("position")).mapInArrow(lambda batches: _said(batches, tokenizer), SAID)
    steps = trees.conversations.select("conv_id", F.posexplode("path").alias("depth", "node_id")).join(said, "node_id", "left")
    read = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "position", "n", "role", "text", "learnt", "chars"))).alias("x"))
    whole = F.expr("aggregate(x, 0L, (at, t) -> if(t.position = at, at + t.n, CAST(NULL AS BIGINT)))").isNotNull()
    read = read.select("conv_id", F.when(whole, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("positions have gaps in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))).alias("x"))
    learnt = F.expr("array_join(transform(x, t -> t.learnt), '')")
    said_all = F.expr(r"array_join(transform(x, t -> concat(t.role, '\n', t.text, '\n')), '')")
    return read.select(
        "conv_id",
        F.size("x").cast("long").alias("n_turns"),
        F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.expr("aggregate(x, 0L, (at, t) -> at + t.chars)").alias("formatted_chars"),
    )
