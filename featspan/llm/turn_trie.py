"""A trie of conversations by their turns, built as a burst trie.

A turn is the 64-bit hash of its role and text, a conversation the sequence of its turns. Equal
sequences are one suffix with a count before anything else happens, so a conversation that a third
of all copy is one row. At first all suffixes lie in one container under the root. A container of
more than ``limit`` turns and more than one suffix bursts: its node becomes a trie head, and its
suffixes move on to containers by their next turn. One pass over the suffixes of oversized
containers bursts up to ``LEVELS`` levels, so the number of passes grows with the depth to which
many different conversations agree, not with their number or length.

The containers that are left are sorted by the turns of their suffixes and swept: neighbours share
the nodes of their common prefix, a stack holds the open path, and a node is complete when it is
closed. Trie heads get the sums of what lies under them from their containers and heads.

The ids of the conversations that end at a node are put together in ascending stretches of id, and
the stretches are fed to the hash one after another, so no list of ids is ever held whole.

``conv_id``, ``turn``, ``role`` and ``text`` are read; other columns are left alone. Turns are
ordered by turn, null first, equal ones by role and text; a null role or text is empty; repeated
rows are turns of their own; rows without a conversation id belong to none. An empty table has no
nodes. A conversation is put together in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featspan.llm.storage import materialise, shuffle_width
from featspan.llm.text import U64, mixed

LEVELS = 8
ROOT = 0
_STEP = U64(0x9E3779B97F4A7C15)
_NO_IDS = hashlib.sha256(b"").hexdigest()
#: A stretch of ids has so many bits.
_STRETCH = 12
_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, up long, path array<long>"
)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id and words of every turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), F.xxhash64("role", "text").alias("id"), words.alias("words"))


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id, pos, id, words of the rebuilt conversations: some first turns are those of the group's first one.

    Conversation c starts with the first h turns of conversation c - c % group, h = crc32(c) % most, and
    goes on with its own turns after its first h. One without any turn left has a row with a null id.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = turns.select("conv_id").distinct().withColumns({"h": h, "first": F.col("conv_id") - F.col("conv_id") % group})
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("first"), "pos", "id", "words")
    shared = convs.join(heads, "first").where("pos <= h").select("conv_id", "pos", "id", "words")
    own = turns.where(F.col("pos") > h).select("conv_id", (F.col("pos") + most).alias("pos"), "id", "words")
    none = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("words"))
    return shared.unionByName(own).unionByName(none)


def _sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, words and keys of each conversation; keys[d - 1] names its first d turns, key all of them."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id", "words")))).alias("said"))
    whole = whole.select("conv_id", F.col("said.id").alias("ids"), F.col("said.words").alias("words"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            lengths = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            starts = np.cumsum(lengths) - lengths
            keys, last = np.zeros(len(flat), U64), np.full(len(lengths), ROOT, U64)
            rows = np.flatnonzero(lengths > 0)
            at = 0
            while len(rows):
                last[rows] = mixed(last[rows] * _STEP + flat[starts[rows] + at] + U64(1))
                keys[starts[rows] + at] = last[rows]
                at += 1
                rows = rows[lengths[rows] > at]
            ends = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            keys = pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), ids, batch.column("words"), keys, pa.array(last.view(np.int64))], ["conv_id", "ids", "words", "keys", "key"]
            )

    return whole.mapInArrow(chain, "conv_id long, ids array<long>, words array<long>, keys array<long>, key long")


def _id_hashes(sequences: DataFrame) -> DataFrame:
    """key and the hash of the ascending ids of the conversations that are this sequence."""
    stretch = sequences.groupBy("key", F.shiftright("conv_id", _STRETCH).alias("stretch"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    parts = stretch.agg(F.array_join(ids, ",").alias("part"))
    parts = parts.repartition(shuffle_width(sequences.sparkSession), "key").sortWithinPartitions("key", "stretch")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            keys, out = [], []
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if key != own:
                    if state is not None:
                        keys.append(own)
                        out.append(state.hexdigest())
                    own, state = key, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([state.hexdigest()])], ["key", "ends"])

    return parts.select("key", "part").mapInArrow(digest, "key long, ends string")


def _suffixes(sequences: DataFrame) -> DataFrame:
    """One row per distinct sequence: key, smallest conv_id, n conversations, ids, words, keys, ends."""
    one = sequences.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    return sequences.join(one, ["key", "conv_id"]).join(_id_hashes(sequences), "key")


def _burst(suffixes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The trie heads, and the suffixes with the depth of their container.

    Heads are at (key), depth, up (key of the parent), words of the last turn, conv_id, n_convs. A
    suffix that ends at a head has a depth one greater than its length.
    """
    size = F.sum(F.size("ids") + 1)
    whole = suffixes.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.coalesce(size, F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n"))
    whole = materialise(whole.where((F.col("size") > limit) & (F.col("n") > 1)), "trie-root")
    columns = ["at", "depth", "up", "words", "conv_id", "n_convs"]
    heads = [whole.select(F.lit(ROOT).cast("long").alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")]
    if whole.isEmpty():
        return heads[0], suffixes.withColumn("depth", F.lit(0))
    deepest, active, low = [], suffixes, 1
    while True:
        high = low + LEVELS - 1
        spread = active.where(F.size("ids") >= low).select(
            "key", "conv_id", "n", "words", "keys", F.size("ids").alias("len"), F.explode(F.sequence(F.lit(low), F.least(F.size("ids"), F.lit(high)))).alias("d")
        )
        up = F.when(F.col("d") > 1, F.get("keys", F.col("d") - 2)).otherwise(F.lit(ROOT).cast("long"))
        spread = spread.select(
            "key", "conv_id", "n", "d", F.get("keys", F.col("d") - 1).alias("at"), up.alias("up"), F.get("words", F.col("d") - 1).alias("word"),
            (F.col("len") - F.col("d") + 1).alias("size"),
        )
        found = spread.groupBy("at").agg(
            F.max("d").alias("depth"), F.max("up").alias("up"), F.max("word").alias("words"), F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n_convs"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("many"),
        )
        found = materialise(found.where((F.col("size") > limit) & (F.col("many") > 1)).select(columns), "trie-heads")
        heads.append(found)
        deep = spread.select("key", "d", "at").join(found.select("at"), "at", "left_semi").groupBy("key").agg(F.max("d").alias("deepest"))
        deep = materialise(deep, "trie-depths")
        deepest.append(deep)
        active = suffixes.join(deep.where(F.col("deepest") == high).select("key"), "key", "left_semi")
        if deep.where(F.col("deepest") == high).isEmpty():
            break
        low = high + 1
    depths = reduce(DataFrame.unionByName, deepest).groupBy("key").agg(F.max("deepest").alias("deepest"))
    placed = suffixes.join(depths, "key", "left").withColumn("depth", F.coalesce("deepest", F.lit(0)) + 1).drop("deepest")
    return reduce(DataFrame.unionByName, heads), placed


def _swept(base: int, rows: list[tuple]) -> tuple[list, ...]:
    """The nodes of a container whose suffixes share their first ``base`` turns; the container's node comes first.

    ``rows`` are (ids, words, conv_id, n, ends), sorted by ids.
    """
    words = rows[0][1]
    depth, parent, least, n = [base], [-1], [rows[0][2]], [0]
    own, children, leaves, saved, ends = [words[base - 1] if base else 0], [0], [0], [0], [_NO_IDS]
    path, before = [0], rows[0][0][:base]

    def close() -> None:
        i = path.pop()
        saved[i] += (n[i] - 1) * own[i]
        if not children[i]:
            leaves[i] = 1
        if path:
            p = path[-1]
            n[p] += n[i]
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            if least[i] < least[p]:
                least[p] = least[i]

    for ids, words, conv_id, times, digest in rows:
        same, most = base, min(len(ids), len(before))
        while same < most and ids[same] == before[same]:
            same += 1
        while len(path) - 1 > same - base:
            close()
        for d in range(same, len(ids)):
            parent.append(path[-1])
            path.append(len(depth))
            depth.append(d + 1)
            least.append(conv_id)
            n.append(0)
            own.append(words[d])
            children.append(0)
            leaves.append(0)
            saved.append(0)
            ends.append(_NO_IDS)
        here = path[-1]
        n[here] += times
        ends[here] = digest
        if conv_id < least[here]:
            least[here] = conv_id
        before = ids
    while path:
        close()
    return least, depth, [least[p] if p >= 0 else None for p in parent], n, children, leaves, saved, ends


def _sweep(boxed: DataFrame) -> DataFrame:
    """The nodes of all containers; a container's own node has the key of its parent and the path down to it."""
    keys = F.when(F.col("depth") > 0, F.get("keys", F.col("depth") - 1)).otherwise(F.lit(ROOT).cast("long"))
    path = F.when(F.col("depth") > 0, F.concat(F.array(F.lit(ROOT).cast("long")), F.slice("keys", 1, F.col("depth") - 1)))
    rows = boxed.select(keys.alias("box"), "depth", path.alias("path"), "ids", "words", "conv_id", "n", "ends")
    rows = rows.repartition(shuffle_width(boxed.sparkSession), "box").sortWithinPartitions("box", "ids")

    def nodes(base: int, path: list | None, rows: list[tuple]) -> pa.RecordBatch:
        columns = _swept(base, rows)
        rest = len(columns[0]) - 1
        kinds = [pa.int64()] * 7 + [pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays += [pa.array([path[-1] if path else None] + [None] * rest, pa.int64()), pa.array([path] + [None] * rest, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, [c.strip().split(" ")[0] for c in _NODES.split(",")])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base, path, held = None, 0, None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("box", "depth", "path", "ids", "words", "conv_id", "n", "ends")), strict=True)
            for box, depth, way, *row in rows:
                if held and box != own:
                    yield nodes(base, path, held)
                    held = []
                own, base, path = box, depth, way
                held.append(tuple(row))
        if held:
            yield nodes(base, path, held)

    return rows.mapInArrow(sweep, _NODES)


def turn_trie(turns: DataFrame, limit: int = 4096) -> DataFrame:
    """A row per node of the trie of the conversations in ``turns`` (conv_id, pos, id, words).

    conv_id is the smallest member, parent_conv_id the parent's, n_convs the members, n_children and
    n_leaves the children and the childless nodes under it, saved_tokens the words that a cache of
    prefixes saves under it, ends_sha256 the hash of the ids of the members that end here.
    """
    sequences = materialise(_sequences(turns), "trie-sequences")
    suffixes = materialise(_suffixes(sequences), "trie-suffixes")
    heads, placed = _burst(suffixes, limit)
    placed = materialise(placed, "trie-placed")
    nodes = materialise(_sweep(placed.where(F.col("depth") <= F.size("ids"))), "trie-nodes")

    # what containers and heads add to every head above them
    own = (F.col("n_convs") - 1) * F.col("words")
    way = heads.join(suffixes.select("conv_id", "keys"), "conv_id").select(
        "at", "up", "depth", own.alias("saved"), F.concat(F.array(F.lit(ROOT).cast("long")), F.slice("keys", 1, F.col("depth"))).alias("path")
    )
    from_heads = way.select(F.explode("path").alias("a"), F.lit(0).cast("long").alias("leaves"), "saved", "up")
    from_tops = nodes.where("path IS NOT NULL").select(F.explode("path").alias("a"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), "up")
    # the path of a head ends with itself, so every part of it is counted once; a part is the parent if it is ``up``
    under = from_heads.unionByName(from_tops).groupBy(F.col("a").alias("at")).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.count_if(F.col("a") == F.col("up")).alias("n_children")
    )
    ended = placed.where(F.col("depth") > F.size("ids")).select(F.col("key").alias("at"), "ends")
    names = materialise(heads.select(F.col("at").alias("up"), F.col("conv_id").alias("above")), "trie-names")
    of_heads = heads.join(under, "at").join(ended, "at", "left").join(names, "up", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    of_heads = of_heads.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NO_IDS)).alias("ends_sha256"),
    )
    tops = nodes.where("up IS NOT NULL").join(names, "up", "left").withColumn("parent_conv_id", F.col("above"))
    return nodes.where("up IS NULL").select(columns).unionByName(tops.select(columns)).unionByName(of_heads)


def conversation_trie(conversations: DataFrame, limit: int = 4096) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = materialise(turns_of(conversations), "turns")
    return turn_trie(with_shared_heads(turns), limit)
