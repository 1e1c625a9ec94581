"""The trie of conversations that share their first turns, swept out of sorted containers of a burst trie.

A conversation is the sequence of the ids of its turns (128 bits of role and text, so equal ids stand for equal turns). Its
suffix below a trie head, at first the first turn, lies in the head's container. A container with too many turns for one task is
burst: the head grows by all that its members share and by the next turn's id, which gives a container to each next turn, until
every container is small or holds a single sequence. Copies of a conversation are counted before, so a group of copies is one
sequence, and what all members share is passed in one step, so the rounds are those of branching, not of depth. The remaining
containers are sorted and swept into nodes, each in one task and in memory; what a subtree sums up is handed to the heads above it,
from the last round of bursting to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.session import written

ID_BYTES = 16
CONTAINER_TURNS = 65_536  # turns below a head that one task takes; a single sequence is not split
ROWS_OUT = 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODES = NODE + ", up string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id`` with its turns in order: ``ids`` (hex) and ``chars``, the code points of each text.

    Texts become ids before the shuffle. Turns of the same number are ordered by role and id.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"),
        F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("id"),
        F.length(text).alias("chars"),
    )
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def rebuilt(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its hundred: ``conv_id``, ``seq``, ``chars``.

    The first ``h`` turns come from there, ``h`` being crc32 of the id in decimal modulo ``most``; its own follow after its first ``h``.
    """
    own = sequences.withColumns({
        "h": (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int"),
        "base": F.col("conv_id") - F.col("conv_id") % every,
    })
    # A few turns of one conversation in a hundred.
    heads = sequences.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("first_ids"), F.slice("chars", 1, most - 1).alias("first_chars")
    )
    joined = own.join(heads, "base", "left")

    def spliced(first: str, rest: str) -> Column:
        start = F.coalesce(F.slice(first, F.lit(1), F.col("h")), F.slice(rest, 1, 0))
        return F.concat(start, F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest) - F.col("h"), F.lit(0))))

    return joined.select(
        "conv_id", F.unhex(F.array_join(spliced("first_ids", "ids"), "")).alias("seq"), spliced("first_chars", "chars").alias("chars")
    )


def counted_copies(sequences: DataFrame) -> DataFrame:
    """One row per different sequence: members ``n``, smallest member ``least``, and the hash of their ids, ``ends``.

    The ids of a group stream by in order, so a group of any size takes no memory.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def closed():
            seq, chars, n, least, ends = held
            return seq, chars, n, least, ends.hexdigest()

        for batch in batches:
            ids, seqs, chars = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "seq", "chars"))
            for at, (conv, seq) in enumerate(zip(ids.to_pylist(), seqs.to_pylist())):
                if held is not None and held[0] == seq:
                    held[2] += 1
                    held[4].update(b",%d" % conv)
                    continue
                if held is not None:
                    out.append(closed())
                    if len(out) >= ROWS_OUT:
                        yield _batch(out, copies)
                        out = []
                held = [seq, chars[at].as_py(), 1, conv, hashlib.sha256(b"%d" % conv)]
        if held is not None:
            out.append(closed())
        if out:
            yield _batch(out, copies)

    schema = "seq binary, chars array<int>, n long, least long, ends string"
    copies = pa.schema([
        ("seq", pa.binary()), ("chars", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())
    ])
    return sequences.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(count, schema)


NODES_ARROW = pa.schema([(c, pa.int64()) for c in COLUMNS[:-1]] + [("ends_sha256", pa.string()), ("up", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common from their start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, np.uint64, n // 8) != np.frombuffer(b, np.uint64, n // 8))
    return (int(apart[0]) * 8 if len(apart) else n) // ID_BYTES


def swept(members: list[tuple], depth: int, parent: int, up: str) -> Iterator[tuple]:
    """The nodes of one container from its members in order (``seq``, ``chars``, ``n``, ``least``, ``ends``).

    Nodes are made in the order of the sweep, so a parent stands before its children and sums run backwards.
    """
    at_depth, above, n, least, ends, chars = [], [], [], [], [], []
    path: list[int] = []
    before = None
    for seq, lengths, count, smallest, hashed in members:
        common = depth - 1 if before is None else shared_turns(before, seq)
        del path[common - depth + 1:]
        for level in range(common, len(seq) // ID_BYTES):
            above.append(path[-1] if path else -1)
            path.append(len(n))
            at_depth.append(level + 1)
            chars.append(lengths[level])
            n.append(0)
            least.append(smallest)
            ends.append(NO_ENDS)
        n[path[-1]] += count
        ends[path[-1]] = hashed
        least[path[-1]] = min(least[path[-1]], smallest)
        before = seq
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for i in reversed(range(len(n))):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * chars[i]
        if above[i] >= 0:
            top = above[i]
            n[top] += n[i]
            least[top] = min(least[top], least[i])
            children[top] += 1
            leaves[top] += leaves[i]
            saved[top] += saved[i]
    for i in range(len(n)):
        over = least[above[i]] if above[i] >= 0 else parent
        yield least[i], at_depth[i], over, n[i], children[i], leaves[i], saved[i], ends[i], None if above[i] >= 0 else up


def sweep_containers(members: DataFrame) -> DataFrame:
    """Nodes of all containers; the top node of each names the head that it hangs below (``up``)."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("head", "up", "depth", "parent", "seq", "chars", "n", "least", "ends")]
            for head, up, depth, parent, *row in zip(*[c.to_pylist() for c in columns]):
                if held is None or held[0] != head:
                    if held is not None:
                        out.extend(swept(rows, *held[1:]))
                        if len(out) >= ROWS_OUT:
                            yield _batch(out, NODES_ARROW)
                            out = []
                    held, rows = (head, depth, parent, up), []
                rows.append(row)
        if held is not None:
            out.extend(swept(rows, *held[1:]))
        if out:
            yield _batch(out, NODES_ARROW)

    dealt = members.withColumns({"head": head_key(F.col("depth")), "up": head_key(F.col("depth") - 1)})
    return dealt.repartition("head").sortWithinPartitions("head", "seq").mapInArrow(sweep, NODES)


def head_key(depth: Column, seq: str = "seq") -> Column:
    """The first ``depth`` turns of a sequence, as a short key."""
    return F.md5(F.substring(F.col(seq), F.lit(1), (depth * ID_BYTES).cast("int")))


def oversized(active: DataFrame, turns: int) -> DataFrame:
    """The heads whose containers hold too many turns, with what all their members share (``shared`` turns).

    The least and the greatest sequence share just what all share. Aggregation combines before it shuffles, so a hot head is no
    single task's work.
    """
    below = F.length("seq") / ID_BYTES - F.col("depth") + 1
    heads = active.withColumn("head", head_key(F.col("depth"))).groupBy("head").agg(
        F.count(F.lit(1)).alias("members"), F.sum(below).alias("turns"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("seq").alias("seq"), F.max("seq").alias("last"),
        F.min_by("chars", "seq").alias("chars"), F.min_by("ends", "seq").alias("ends"), F.min_by("n", "seq").alias("ending"),
    ).filter((F.col("turns") > turns) & (F.col("members") > 1))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seq", "last"))
            yield batch.append_column("shared", pa.array([shared_turns(a, b) for a, b in zip(first, last)], pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads.schema)
    found = heads.mapInArrow(share, f"{schema}, shared long")
    return found.withColumns({
        "path": head_key(F.col("shared")), "up": head_key(F.col("depth") - 1),
        "ends": F.when(F.length("seq") == F.col("shared") * ID_BYTES, F.col("ends")).otherwise(F.lit(NO_ENDS)),
    })


def head_nodes(heads: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes of burst heads: one per turn that all members share, the last of which has the containers below it as children."""
    below = totals.groupBy(F.col("up").alias("path")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, saved = [], row["saved"]
                for depth in range(row["shared"], row["depth"] - 1, -1):
                    last, first = depth == row["shared"], depth == row["depth"]
                    saved += (row["n"] - 1) * row["chars"][depth - 1]
                    out.append((
                        row["least"], depth, row["parent"] if first else row["least"], row["n"], row["n_children"] if last else 1,
                        row["n_leaves"], saved, row["ends"] if last else NO_ENDS, row["up"] if first else None,
                    ))
                yield _batch(out, NODES_ARROW)

    return heads.drop("seq", "last", "head").join(below, "path").mapInArrow(spread, NODES)


def prefix_trie(sequences: DataFrame, turns: int = CONTAINER_TURNS) -> DataFrame:
    """All nodes of the trie of ``sequences`` (``conv_id``, ``seq``, ``chars``), the textless root included; see COLUMNS.

    No sequences give no nodes. A container of at most ``turns`` turns, or of one sequence, is held by one task.
    """
    spark = sequences.sparkSession
    different = written(counted_copies(sequences), "sequences")
    # The root's own figures: one row.
    whole = different.agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max(F.when(F.length("seq") == 0, F.col("ends"))).alias("ends")
    ).first()
    if whole.n is None:
        return spark.createDataFrame([], NODE)
    active = different.filter(F.length("seq") > 0).withColumns({"depth": F.lit(1).cast("long"), "parent": F.lit(whole.least).cast("long")})
    small: list[DataFrame] = []
    rounds: list[DataFrame] = []
    while True:
        heads = written(oversized(active, turns), "heads")
        if heads.isEmpty():
            small.append(active)
            break
        rounds.append(heads)
        at = active.withColumn("head", head_key(F.col("depth")))
        small.append(at.join(heads, "head", "left_anti").select(active.columns))
        grown = at.drop("depth", "parent").join(heads.select("head", "shared", F.col("least").alias("parent")), "head")
        active = written(
            grown.filter(F.length("seq") > F.col("shared") * ID_BYTES).withColumn("depth", F.col("shared") + 1).select(active.columns), "burst",
        )
    members = small[0]
    for more in small[1:]:
        members = members.unionByName(more)
    nodes = [written(sweep_containers(members), "nodes")]
    for heads in reversed(rounds):
        totals = nodes[0]
        for more in nodes[1:]:
            totals = totals.unionByName(more)
        nodes.append(written(head_nodes(heads, totals.filter(F.col("up").isNotNull())), "head_nodes"))
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    tops = every.filter(F.col("depth") == 1)
    root = tops.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).select(
        F.lit(whole.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(whole.n).cast("long").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), F.lit(whole.ends or NO_ENDS).alias("ends_sha256"),
    )
    return every.select(*COLUMNS).unionByName(root)


def conversation_trie(conversations: DataFrame, turns: int = CONTAINER_TURNS) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations (see ``rebuilt``).

    Null roles and texts are empty; null turns come first; rows without ``conv_id`` belong to no conversation and take no part;
    repeated rows are turns of their own; other columns are not read; an empty table gives no nodes. A conversation's turn ids (16
    bytes each) are one row, so it can have up to about a hundred million turns.
    """
    return prefix_trie(rebuilt(turn_sequences(conversations)), turns)
