"""Chat formatting as prefix trees.

Conversations that begin with the same turns share the nodes of these turns. A tree is written out depth
first, each node's text once; `position` restarts a node where its parent ended, and the ancestors' intervals
are what a token may attend to besides its own node. Every sequence is one row of the output:

    sequence    its number
    trunk       the sequence that this one goes on from, null if it begins with first turns
    path        the numbers of all sequences it goes on from, first turn first
    text        the formatted turns of all nodes, depth first
    nodes       start and end in text, parent (index, -1 for none), position (characters of the whole path before it),
                attends (start and end of its ancestors in text, neighbours merged), loss_start and loss_end (empty
                unless an assistant's); tokens attend to the sequences of `path` as well, as wholes
    leaves      conversation and the index of its last node (-1: it ends with the trunk, or has no turns)

Template: `<turn role>text</turn>` and a newline. In texts and roles a backslash goes before `\\`, `<` and `>`,
so no text can forge a mark, and taking it away gives the text back.

A turn that over `most` conversations share, with all turns before it, is a sequence of its own, a trunk, and written once however
many share it. What follows on trunks is dealt out by its first turn that no trunk holds; at most `most` conversations
share that, so no tree is too large for its task. Conversations that end with a trunk are dealt out in blocks.

Edge cases: a null or empty text is an empty turn; a null role is an empty role; turns with one number are ordered
by role and text, nulls first; rows of a null conv_id form one conversation with a null id; very long texts and conversations are
kept whole; equal conversations are leaves of one node; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .linking import sent_if_small

SEQUENCE = (
    "sequence long, trunk long, path array<long>, text string, nodes array<struct<start: long, end: long, parent: long, position: long, attends: array<array<long>>, loss_start: long, loss_end: long>>, "
    "leaves array<struct<conv_id: long, node: long>>"
)
SPECIAL = re.compile(r"[\\<>]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; a text that no turns make up is an error."""
    found, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def sequence(conversations: list[tuple[int | None, list[tuple[str, str]]]], before: int = 0) -> dict:
    """One tree or several, depth first, each node once; `before` characters of a trunk come first."""
    children: list[dict] = [{}]
    owners: list[list] = [[]]
    turns: list[tuple[str, str]] = [("", "")]
    for conv_id, path in conversations:
        node = 0
        for turn in path:
            if turn not in children[node]:
                children[node][turn] = len(children)
                children.append({})
                owners.append([])
                turns.append(turn)
            node = children[node][turn]
        owners[node].append(conv_id)
    text, nodes, leaves, at = [], [], [{"conv_id": c, "node": -1} for c in owners[0]], 0
    stack = [(child, -1, before, ()) for child in reversed(children[0].values())]
    while stack:
        node, parent, position, attends = stack.pop()
        role, said = turns[node]
        head, body = f"<turn {escape(role)}>", escape(said)
        formatted = f"{head}{body}</turn>\n"
        loss = (at + len(head), at + len(head) + len(body)) if role == "assistant" else (at, at)
        nodes.append({"start": at, "end": at + len(formatted), "parent": parent, "position": position, "attends": [list(a) for a in attends], "loss_start": loss[0], "loss_end": loss[1]})
        text.append(formatted)
        index = len(nodes) - 1
        leaves += [{"conv_id": c, "node": index} for c in owners[node]]
        past = at + len(formatted)
        # A first child stands right behind its parent: their intervals are one.
        inside = (*attends[:-1], (attends[-1][0], past)) if attends and attends[-1][1] == at else (*attends, (at, past))
        at = past
        stack += [(child, index, position + len(formatted), inside) for child in reversed(children[node].values())]
    return {"text": "".join(text), "nodes": nodes, "leaves": leaves}


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by shard and turns: one sequence for each shard."""
    shard, held, head = None, [], {}

    def made() -> pd.DataFrame:
        row = {"sequence": shard, **head, **sequence(held, head["before"])}
        row.pop("before")
        return pd.DataFrame([row]).astype({"trunk": "Int64"})

    for batch in batches:
        for key, trunk, path, before, conv_id, turns in zip(*(batch[c] for c in ("shard", "trunk", "path", "before", "conv_id", "turns"))):
            if held and key != shard:
                yield made()
                held = []
            shard, head = key, {"trunk": None if pd.isna(trunk) else int(trunk), "path": path, "before": int(before)}
            held.append((None if pd.isna(conv_id) else int(conv_id), [(t["role"], t["text"]) for t in turns]))
    if held:
        yield made()


def _trunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sequence of a single turn for each row."""
    for batch in batches:
        for key, path, before, role, text in zip(*(batch[c] for c in ("hash", "path", "before", "role", "text"))):
            row = {"sequence": key, "trunk": path[-1] if len(path) else None, "path": path, **sequence([(None, [(role, text)])], int(before)), "leaves": []}
            yield pd.DataFrame([row]).astype({"trunk": "Int64"})


def _special(c: Column) -> Column:
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\\<>]", ""))


def format_chats(conversations: DataFrame, most: int = 500) -> DataFrame:
    """One row per sequence, as described above, of conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # array_sort puts null turns last within the array; nulls first is wanted.
    numbered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text")
    whole = numbered.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    # For every turn the hash of all turns up to it, and the formatted characters before it.
    none = F.array().cast("array<struct<hash: long, before: long>>")

    def step(a: Column, t: Column) -> Column:
        hash_ = F.xxhash64(a["hash"], t["role"], t["text"])
        return F.struct(hash_.alias("hash"), (a["at"] + 15 + _special(t["role"]) + _special(t["text"])).alias("at"), F.concat(a["marks"], F.array(F.struct(hash_.alias("hash"), a["at"].alias("before")))).alias("marks"))

    marks = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("at"), none.alias("marks")), step)
    chats = materialise(whole.withColumn("m", marks).select("conv_id", "turns", F.col("m.marks").alias("marks"), F.col("m.at").alias("length")), "chats")

    each = chats.select(F.explode("marks.hash").alias("hash"))
    shared = materialise(each.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most), "trunks")
    if not shared.limit(1).count():
        dealt = chats.select(F.coalesce(F.get("marks.hash", 0), F.lit(0)).alias("shard"), F.lit(None).cast("long").alias("trunk"), F.array().cast("array<long>").alias("path"), F.lit(0).cast("long").alias("before"), "conv_id", "turns")
        return dealt.repartition("shard").sortWithinPartitions("shard", "turns", "conv_id").mapInPandas(_sequences, SEQUENCE)

    # Trunks are closed under going back a turn, so a conversation's are its first `depth` ones.
    few = sent_if_small(shared)
    placed = chats.select("conv_id", F.posexplode(F.arrays_zip("marks", "turns")).alias("k", "z")).select("conv_id", "k", F.col("z.marks.hash").alias("hash"), "z")
    met = placed.join(few, "hash")
    depth = materialise(met.groupBy("conv_id").agg(F.count("*").cast("int").alias("depth"), F.max_by("n", "k").alias("n")), "depths")
    keyed = chats.join(depth.select(F.col("conv_id").alias("other"), "depth", "n"), F.col("conv_id").eqNullSafe(F.col("other")), "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    hashes = F.transform("marks", lambda m: m["hash"])
    blocks = F.xxhash64(F.get(hashes, F.col("depth") - 1), F.pmod(F.xxhash64("conv_id"), F.ceil(F.col("n") / most)), F.lit("end"))
    ended = (F.col("depth") == F.size("turns")) & (F.col("depth") > 0)
    dealt = keyed.select(
        F.when(ended, blocks).otherwise(F.coalesce(F.get(hashes, F.col("depth")), F.lit(0))).alias("shard"), F.get(hashes, F.col("depth") - 1).alias("trunk"), F.slice(hashes, F.lit(1), F.col("depth")).alias("path"),
        F.coalesce(F.get("marks", F.col("depth"))["before"], F.col("length")).alias("before"), "conv_id", F.slice("turns", F.col("depth") + 1, F.size("turns")).alias("turns"),
    )
    rest = dealt.repartition("shard").sortWithinPartitions("shard", "turns", "conv_id").mapInPandas(_sequences, SEQUENCE)
    # Each trunk's turn is taken from one of its conversations.
    one = met.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id", "k")).alias("o")).select("hash", F.col("o.conv_id").alias("other"), F.col("o.k").alias("k"))
    source = materialise(one, "trunk-sources")
    trunk = chats.join(source, F.col("conv_id").eqNullSafe(F.col("other"))).select(
        "hash", F.slice(hashes, F.lit(1), F.col("k")).alias("path"), F.get("marks", F.col("k"))["before"].alias("before"), F.get("turns", F.col("k"))["role"].alias("role"), F.get("turns", F.col("k"))["text"].alias("text")
    )
    return rest.union(trunk.mapInPandas(_trunks, SEQUENCE))


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, nodes, leaves, before in zip(batch["text"], batch["nodes"], batch["leaves"], batch["before"]):
            before = [] if before is None else list(before)
            for leaf in leaves:
                conv_id, node = leaf["conv_id"], leaf["node"]
                path = []
                while node >= 0:
                    path.append(nodes[node])
                    node = path[-1]["parent"]
                path.reverse()
                formatted = "".join([b["text"] for b in before] + [text[n["start"] : n["end"]] for n in path])
                loss = unescape("".join([b["loss"] for b in before] + [text[n["loss_start"] : n["loss_end"]] for n in path]))
                turns = parse(formatted)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        yield frame


def read_chats(sequences: DataFrame) -> DataFrame:
    """Digests of every conversation, from the sequences alone: each with the turns of the trunks it goes on from."""
    node = F.get("nodes", 0)
    trunk = sequences.where(F.size("leaves") == 0).select("sequence", F.col("text"), F.substring("text", node["loss_start"].cast("int") + 1, (node["loss_end"] - node["loss_start"]).cast("int")).alias("loss"))
    ends = sequences.where((F.size("leaves") > 0) & F.col("trunk").isNotNull()).select("trunk", "path").dropDuplicates(["trunk"])
    steps = ends.select(F.col("trunk").alias("end"), F.posexplode("path").alias("k", "sequence"))
    before = steps.join(trunk, "sequence").groupBy("end").agg(F.array_sort(F.collect_list(F.struct("k", "text", "loss"))).alias("before"))
    rows = sequences.where(F.size("leaves") > 0).join(before, F.col("trunk") == F.col("end"), "left").select("text", "nodes", "leaves", "before")
    return rows.mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_chats(materialise(format_chats(rows.union(extra)), "sequences"))
