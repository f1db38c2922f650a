"""Prefix trie of conversations: every distinct sequence of first turns is a node.

Turns travel as a 128-bit digest of role and text and the size of the text. Conversations are cut into pieces of bounded
length, equal pieces behind equal beginnings are one, and pieces with the same beginning and first turn go to one shard.
Each shard packs its pieces into one double-array trie over dense turn ids and walks it for nodes and sums. Where a
beginning has more turns than a shard should hold, its pieces are dealt to several shards; the nodes these share are
merged by their paths, and a second walk adds up subtrees: a node's value counts in the one shard that holds its
smallest member, so nothing counts twice. What lies behind the end of a piece is carried to the piece through the same
smallest members, for all pieces at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import whole_div
from .common import hot_join, saved
from .double_array import DoubleArray, subtree_sums

#: At most so many beginnings are dealt to more than one shard; this bounds what is broadcast.
MOST_SPLIT = 100_000
#: Part numbers stand above this many bits in Spark's increasing ids.
PART_BITS = 33
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
EMPTY_PIECE = EMPTY_SHA256[:32]
PIECE = ["k", "q", "digest"]
NODE = ["k", "q", "node"]
NODES = ("shard long, k long, q string, open boolean, node string, id long, parent long, top boolean, depth long, n long, "
         "conv_id long, parent_conv_id long, size long, children long, leaves long, saved long, digest string, next_q string, more long")


def digest(*parts: Column) -> Column:
    """128 bits of SHA-256, as hexadecimal text."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def numbered(conversations: DataFrame, id_name: str = "conv_id", turn_name: str = "turn", role_name: str = "role",
             text_name: str = "text") -> DataFrame:
    """``conv_id, idx, key, size`` per turn: its number from 1 in its conversation, digest, and bytes of text.

    Turns stand by turn number, null first; equal numbers in the order of their digests. Rows without a conversation id
    take no part. Rows are numbered in ranges of (conversation, turn), so a conversation may be of any length; only for
    those on both sides of a border, at most one per border, earlier rows are counted.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_name, text_name))
    turns = conversations.select(
        F.col(f"`{id_name}`").cast("long").alias("conv_id"), F.col(f"`{turn_name}`").alias("turn"),
        digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    turns = saved(turns.filter("conv_id IS NOT NULL"), "turns")
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.select("conv_id", "key", "size", F.monotonically_increasing_id().alias("at")), "ranges")
    ranged = ranged.withColumn("part", F.shiftright("at", PART_BITS))
    edges = ranged.groupBy("part").agg(F.array_distinct(F.array(F.min("conv_id"), F.max("conv_id"))).alias("edge"))
    across = edges.select(F.explode("edge").alias("conv_id")).groupBy("conv_id").count().filter("count > 1").select("conv_id")
    counts = ranged.join(F.broadcast(across), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    placed = ranged.withColumn("idx", inside).join(F.broadcast(before), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("idx") + F.coalesce("before", F.lit(0))).cast("long").alias("idx"), "key", "size")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as they are: (``conv_id, pos, key, size, length``; ``conv_id, length``)."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    rows = hot_join(turns, lengths.withColumn("n_rows", F.col("length")), ["conv_id"], "n_rows")
    return rows.select("conv_id", F.col("idx").alias("pos"), "key", "size", "length"), lengths


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c begins with the first h turns of conversation c - c % family (those it has), then has its own turns after
    its first h; h = crc32(c) % heads. Results as those of ``plain``."""
    turns = saved(turns, "numbered")
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    most = heads - 1
    first = turns.filter((F.col("idx") <= most) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "key", "size"))).alias("first"))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n_rows"))
    counts = counts.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % family})
    joined = counts.join(first, "of", "left").withColumn(
        "head", F.expr("slice(coalesce(first, array()), 1, cast(h AS int))"))
    convs = saved(joined.select(
        "conv_id", "n_rows", "h", "head", F.size("head").alias("taken"),
        (F.size("head") + F.greatest(F.lit(0), F.col("n_rows") - F.col("h"))).cast("long").alias("length")), "conversations")
    own = hot_join(turns.filter(F.col("idx") > h), convs.select("conv_id", "n_rows", "h", "taken", "length"), ["conv_id"], "n_rows")
    own = own.select("conv_id", (F.col("taken") + F.col("idx") - F.col("h")).alias("pos"), "key", "size", "length")
    head = convs.select("conv_id", F.explode("head").alias("t"), "length").select(
        "conv_id", F.col("t.idx").alias("pos"), "t.key", "t.size", "length")
    return own.unionByName(head), convs.select("conv_id", "length")


@dataclass(frozen=True)
class Sizes:
    """Turns of a piece and of a shard, and bytes of joined ids that travel as one row. Results do not depend on them."""

    piece: int = 4096
    shard: int = 20_000
    chunk: int = 1 << 16


def _pieces(rows: DataFrame, convs: DataFrame, sizes: Sizes) -> DataFrame:
    """``conv_id, k, q, digest, turns, length, next_q`` per piece; q names all that stands before it (empty: nothing)."""
    cut = rows.withColumn("k", whole_div(F.col("pos") - 1, sizes.piece)).groupBy("conv_id", "k").agg(
        F.array_sort(F.collect_list(F.struct("pos", "key", "size"))).alias("turns"), F.max("length").alias("length"))
    empty = convs.filter("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("k"), F.expr("cast(array() AS array<struct<pos: bigint, key: string, size: bigint>>)").alias("turns"),
        "length")
    pieces = saved(cut.unionByName(empty).withColumn("digest", digest(F.array_join("turns.key", ""))), "pieces")
    none = F.lit(None).cast("string")
    one = pieces.filter(F.col("length") <= sizes.piece).withColumns({"q": F.lit(""), "next_q": none})
    # Names of beginnings are sums of hashes of numbered pieces: a window over one short row per piece gives them all.
    several = pieces.filter(F.col("length") > sizes.piece)
    mark = F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), F.col("digest")), 256)
    marks = several.select("conv_id", "k", *[F.conv(F.substring(mark, 1 + 10 * i, 10), 16, 10).cast("long").alias(f"m{i}") for i in range(3)])
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = marks.select("conv_id", "k", F.concat_ws("-", *[F.sum(f"m{i}").over(upto) for i in range(3)]).alias("next_q"))
    names = names.withColumn("q", F.coalesce(F.lag("next_q").over(Window.partitionBy("conv_id").orderBy("k")), F.lit("")))
    return one.unionByName(several.join(names, ["conv_id", "k"]))


def _shards(pieces: DataFrame, sizes: Sizes) -> DataFrame:
    """One row per distinct piece behind a distinct beginning, with its shard."""
    first = F.coalesce(F.get("turns.key", F.lit(0)), F.lit(""))
    more = F.count_if(F.col("length") > (F.col("k") + 1) * sizes.piece)
    groups = saved(pieces.groupBy(*PIECE).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"), F.max("next_q").alias("next_q"),
        more.alias("more")).withColumn("first", first), "distinct")
    on = ["k", "q", "first"]
    weights = groups.groupBy(*on).agg(F.sum(F.size("turns")).alias("weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    share = max(1, sizes.shard // 4, total // MOST_SPLIT)
    hot = weights.filter(F.col("weight") > share).select(*on, F.ceil(F.col("weight") / share).cast("long").alias("salts"))
    dealt = groups.join(F.broadcast(hot), on, "left")
    salt = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("salts")), F.lit(0))
    shard = F.pmod(F.xxhash64("k", "q", "first", salt), F.lit(max(1, math.ceil(total / max(1, sizes.shard)))))
    return dealt.select(shard.alias("shard"), F.col("salts").isNotNull().alias("split"), *PIECE, "n", "conv_id", "turns.key", "turns.size",
                        "next_q", "more")


def _pack(piece_turns: int, data: pa.Table) -> pa.Table:
    """Nodes of one shard. The first symbol of every sequence stands for what is before the piece.

    Beginnings that are whole in this shard and that nothing follows are done; nodes of others are ``open`` and carry names.
    """
    data = data.combine_chunks()
    n_pieces = data.num_rows

    def numbers(name: str) -> np.ndarray:
        return data.column(name).to_numpy(zero_copy_only=False)

    k, n, conv, more, split = (numbers(c) for c in ("k", "n", "conv_id", "more", "split"))
    keys = data.column("key").combine_chunks()
    lengths = np.diff(keys.offsets.to_numpy())
    coded = keys.flatten().dictionary_encode()
    texts, turn = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.zeros(len(texts), np.int64)
    sizes[turn] = data.column("size").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    q = data.column("q").to_pylist()
    befores: dict[tuple[int, str], int] = {}
    before = np.array([befores.setdefault((int(a), b), len(befores)) for a, b in zip(k, q)], np.int64)

    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    symbols = np.empty(offsets[-1], np.int64)
    heads = np.zeros(len(symbols), bool)
    heads[offsets[:-1]] = True
    symbols[heads], symbols[~heads] = before + len(texts), turn
    trie = DoubleArray(symbols, offsets, len(texts) + len(befores))

    states = trie.states()
    place = np.full(len(trie.check), -1, np.int64)
    place[states] = np.arange(len(states))
    paths, owner = place[trie.paths], np.repeat(np.arange(n_pieces), lengths + 1)
    members, smallest = np.zeros(len(states), np.int64), np.full(len(states), np.iinfo(np.int64).max)
    np.add.at(members, paths, n[owner])
    np.minimum.at(smallest, paths, conv[owner])
    symbol, piece = np.full(len(states), -1), np.full(len(states), -1)
    symbol[paths], piece[paths] = symbols, owner
    parent, depth = place[trie.check[states]], trie.depth[states]
    last = np.full(len(states), -1)
    last[paths[offsets[1:] - 1]] = np.arange(n_pieces)
    size = np.zeros(len(states), np.int64)
    turned = depth > 1
    size[turned] = sizes[symbol[turned]]
    parent[depth == 0] = -1

    # A beginning is the part below a state of depth 2: one (k, q) and one first turn.
    top = np.full(len(states), -1)
    for d in range(2, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        top[at] = at if d == 2 else top[parent[at]]
    opened = np.zeros(len(states), bool)
    second = paths[offsets[:-1][lengths > 0] + 1]
    opened[second[(split | (more > 0))[lengths > 0]]] = True
    is_open = np.where(top >= 0, opened[top], False)

    children = np.bincount(parent[parent >= 0], minlength=len(states)).astype(np.int64)
    goes_on = np.where(last >= 0, more[last], 0)
    leaf = ((children == 0) & (goes_on == 0)).astype(np.int64)
    saved_here = (members - 1) * size
    leaves, saved_tokens = subtree_sums(parent, depth, leaf, saved_here)
    names: list[str | None] = [None] * len(states)
    for i in np.flatnonzero(is_open)[np.argsort(depth[is_open], kind="stable")]:
        names[i] = hashlib.blake2b(((names[parent[i]] or "") + texts[symbol[i]]).encode(), digest_size=16).hexdigest()

    out = np.flatnonzero(turned)
    digests, following = data.column("digest").to_pylist(), data.column("next_q").to_pylist()
    at = piece[out]
    return pa.table({
        "shard": np.repeat(data.column("shard")[0].as_py(), len(out)), "k": k[at], "q": pa.array([q[i] for i in at], pa.string()),
        "open": is_open[out], "node": pa.array([names[i] for i in out], pa.string()), "id": out, "parent": parent[out],
        "top": depth[out] == 2, "depth": depth[out] - 1 + k[at] * piece_turns, "n": members[out], "conv_id": smallest[out],
        "parent_conv_id": pa.array([None if depth[i] == 2 else int(smallest[parent[i]]) for i in out], pa.int64()),
        "size": size[out], "children": children[out], "leaves": leaves[out], "saved": saved_tokens[out],
        "digest": pa.array([digests[last[i]] if last[i] >= 0 else None for i in out], pa.string()),
        "next_q": pa.array([following[last[i]] if last[i] >= 0 else None for i in out], pa.string()), "more": goes_on[out]})


def _add_up(data: pa.Table) -> pa.Table:
    """Subtree sums of the open nodes of one shard, of those values that count here; and their parents' smallest members."""
    data = data.combine_chunks()
    cols = {c: data.column(c).to_numpy(zero_copy_only=False) for c in ("id", "parent", "depth", "here", "own", "leaf", "top", "smallest")}
    order = np.argsort(cols["id"])
    at = np.searchsorted(cols["id"], cols["parent"], sorter=order)
    parent = np.where(cols["top"], -1, order[np.minimum(at, len(order) - 1)])
    here = cols["here"].astype(np.int64)
    kids = np.bincount(parent[parent >= 0], weights=here[parent >= 0], minlength=len(parent)).astype(np.int64)
    leaves, total = subtree_sums(parent, cols["depth"], cols["leaf"], cols["own"])
    above = [None if p < 0 else int(cols["smallest"][p]) for p in parent]
    return pa.table({**{c: data.column(c) for c in NODE}, "children": kids, "leaves": leaves, "saved": total,
                     "parent_conv_id": pa.array(above, pa.int64())})


def _carried(pieces: DataFrame, nodes: DataFrame, sizes: Sizes) -> DataFrame:
    """What lies behind each piece: sums over all nodes of later pieces, each counted with its smallest member."""
    totals = nodes.filter("k > 0").groupBy("conv_id", "k").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    several = pieces.filter(F.col("length") > sizes.piece).select("conv_id", *PIECE)
    later = Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    behind = several.join(totals, ["conv_id", "k"], "left").select(
        *PIECE, *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_behind") for c in ("own", "leaf")])
    return behind.groupBy(*PIECE).agg(*[F.sum(f"{c}_behind").alias(f"{c}_behind") for c in ("own", "leaf")])


def _merge(nodes: DataFrame, pieces: DataFrame, sizes: Sizes) -> DataFrame:
    """Open nodes, merged over shards."""
    opened = nodes.filter("open")
    merged = saved(opened.groupBy(*NODE).agg(
        F.max("top").alias("top"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("smallest"),
        F.max("size").alias("size"), F.sum("children").alias("kids"), F.max("digest").alias("digest"), F.max("next_q").alias("next_q"),
        F.sum("more").alias("more")), "merged")
    own = (F.col("n") - 1) * F.col("size")
    leaf = ((F.col("kids") == 0) & (F.col("more") == 0)).cast("long")
    worth = merged.withColumns({"own": own, "leaf": leaf})
    done = nodes.filter("NOT open").select("k", "conv_id", own.alias("own"), (F.col("children") == 0).cast("long").alias("leaf"))
    behind = _carried(pieces, done.unionByName(worth.select("k", F.col("smallest").alias("conv_id"), "own", "leaf")), sizes)
    here = F.col("conv_id") == F.col("smallest")
    # Nodes at which a piece ends get what lies behind it; a piece is in one shard.
    rows = opened.select("shard", *NODE, "id", "parent", "top", "depth", "conv_id", "digest").join(
        worth.select(*NODE, "smallest", "own", "leaf"), NODE).withColumn("here", here)
    ends = rows.filter("digest IS NOT NULL").join(behind, PIECE, "left")
    others = rows.filter("digest IS NULL").withColumns({f"{c}_behind": F.lit(None).cast("long") for c in ("own", "leaf")})
    rows = ends.unionByName(others).select(
        "shard", *NODE, "id", "parent", "depth", "top", "smallest", "here",
        *[(F.when(F.col("here"), F.col(c)).otherwise(0) + F.coalesce(f"{c}_behind", F.lit(0))).alias(c) for c in ("own", "leaf")])
    sums = rows.groupBy("shard").applyInArrow(
        _add_up, "k long, q string, node string, children long, leaves long, saved long, parent_conv_id long")
    sums = sums.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")], F.max("parent_conv_id").alias("parent_conv_id"))
    return merged.join(sums, NODE).select(
        "k", "q", "top", "depth", "n", F.col("smallest").alias("conv_id"), "parent_conv_id", "children", "leaves", "saved", "digest", "next_q")


def _end_hashes(pieces: DataFrame, sizes: Sizes) -> DataFrame:
    """SHA-256 over the ids of the conversations that end with a piece, in order.

    Ids are joined in ranges of (piece, id), so those of a very common conversation are joined by many tasks; the hash itself is
    a chain and takes the joined texts one by one.
    """
    ends = pieces.filter(F.col("length") <= (F.col("k") + 1) * sizes.piece).select(F.concat_ws("|", *PIECE).alias("end"), "conv_id")
    ranged = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, low, ids, size, out = None, 0, [], 0, []

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["end", "low", "ids"])
            out.clear()
            return batch

        for batch in batches:
            for e, c in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
                if e != end or size > sizes.chunk:
                    if ids:
                        out.append((end, low, ",".join(ids)))
                    end, low, ids, size = e, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) > 1000:
                yield rows()
        if ids:
            out.append((end, low, ",".join(ids)))
        yield rows()

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for e, text in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
                if e == end:
                    state.update(b"," + text.encode())
                    continue
                if end is not None:
                    out.append((end, state.hexdigest()))
                end, state = e, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["end", "sha"])
        if end is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end]), pa.array([state.hexdigest()])], names=["end", "sha"])

    chunks = ranged.mapInArrow(join_ids, "end string, low long, ids string")
    return chunks.repartition("end").sortWithinPartitions("end", "low").mapInArrow(hash_ids, "end string, sha string")


def _joined(found: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes on both sides of the cuts between pieces, with their children and their parents."""
    behind = tops.select((F.col("k") - 1).alias("k"), F.col("q").alias("next_q"), "kids")
    joints = saved(found.filter("next_q IS NOT NULL").join(behind, ["k", "next_q"], "left").withColumn(
        "children", F.col("children") + F.coalesce("kids", F.lit(0))).select(*found.columns), "joints")
    above = joints.select((F.col("k") + 1).alias("k"), F.col("next_q").alias("q"), F.col("conv_id").alias("above"),
                          F.col("children").alias("n_rows"))
    both = found.filter("next_q IS NULL").unionByName(joints)
    later = hot_join(both.filter("top AND k > 0"), above, ["k", "q"], "n_rows").withColumn("parent_conv_id", F.col("above"))
    return both.filter("NOT (top AND k > 0)").unionByName(later.select(*found.columns))


def prefix_trie(rows: DataFrame, convs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """All nodes of the trie of ``rows`` (conv_id, pos, key, size, length) and ``convs`` (conv_id, length; also those without turns).

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Without conversations there is no node, not even a root.
    """
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    pieces = saved(_pieces(rows, convs, sizes), "named")
    nodes = saved(_shards(pieces, sizes).groupBy("shard").applyInArrow(lambda shard: _pack(sizes.piece, shard), NODES), "nodes")
    columns = ["k", "q", "top", "depth", "n", "conv_id", "parent_conv_id", "children", "leaves", "saved", "digest", "next_q"]
    found = nodes.filter("NOT open").select(*columns)
    kinds = nodes.agg(F.max("open").alias("open"), F.max("k").alias("k")).first()
    if kinds["open"]:
        found = saved(found.unionByName(_merge(nodes, pieces, sizes)), "found")
    tops = found.filter("top").groupBy("k", "q").agg(
        F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    if kinds["k"]:
        found = _joined(found, tops).select(*columns)
    first = found.filter("top AND k = 0").withColumn("parent_conv_id", F.lit(root["low"]).cast("long"))
    later = found.filter("NOT (top AND k = 0)")
    # One row, also without any tops.
    start = tops.filter("k = 0").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")]).filter(F.lit(root["n"] > 0)).select(
        F.lit(0).cast("long").alias("k"), F.lit("").alias("q"), F.lit(False).alias("top"), F.lit(0).cast("long").alias("depth"),
        F.lit(root["n"]).cast("long").alias("n"), F.lit(root["low"]).cast("long").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.coalesce("kids", F.lit(0)).alias("children"),
        F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.lit(EMPTY_PIECE).alias("digest"),
        F.lit(None).cast("string").alias("next_q"))
    whole = later.unionByName(first).unionByName(start)
    ended = whole.filter("digest IS NOT NULL").withColumn("end", F.concat_ws("|", *PIECE)).join(_end_hashes(pieces, sizes), "end", "left")
    rest = whole.filter("digest IS NULL").withColumn("sha", F.lit(None).cast("string"))
    return ended.drop("end").unionByName(rest).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
