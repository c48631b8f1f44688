"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, one for each range of the sorted sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import chunked, release, settle

#: Bytes of a turn's id: the begin of the SHA-256 of its role and text, so equal turns and no others share one.
WIDTH = 16
#: Conversation ids whose numbers differ only below this are joined to one string before they meet the rest of their node.
IDS = 256
#: Children that the four layouts of a node hold.
SMALL, MIDDLE, INDEXED, FULL = 4, 16, 48, 256


class Node:
    """A node of an adaptive radix tree: the bytes that lead to it (after the branching byte), its children by their next byte, and the key that ends in it.

    Up to 16 children lie in a short sorted byte string beside their list, up to 48 behind a table of 256 slots, more in
    a list of 256. A node grows into the next layout when it is full.
    """

    __slots__ = ("path", "end", "labels", "slots")

    def __init__(self, path: bytes, end: int = -1) -> None:
        self.path, self.end = path, end
        self.labels: bytearray | None = bytearray()
        self.slots: list = []

    def child(self, byte: int) -> Node | None:
        if self.labels is None:
            return self.slots[byte]
        if len(self.labels) == FULL:
            at = self.labels[byte]
            return self.slots[at - 1] if at else None
        at = self.labels.find(byte)
        return self.slots[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Set the child of a byte, new or not."""
        if self.labels is None:
            self.slots[byte] = node
            return
        if len(self.labels) == FULL:
            if not self.labels[byte]:
                if len(self.slots) < INDEXED:
                    self.slots.append(node)
                    self.labels[byte] = len(self.slots)
                    return
                self.slots = [self.slots[at - 1] if at else None for at in self.labels]
                self.labels = None
                self.slots[byte] = node
                return
            self.slots[self.labels[byte] - 1] = node
            return
        at = self.labels.find(byte)
        if at >= 0:
            self.slots[at] = node
        elif len(self.labels) < MIDDLE:
            at = sum(x < byte for x in self.labels)
            self.labels.insert(at, byte)
            self.slots.insert(at, node)
        else:
            table = bytearray(FULL)
            for i, x in enumerate(self.labels):
                table[x] = i + 1
            self.labels = table
            self.put(byte, node)

    def children(self) -> list[tuple[int, Node]]:
        """The children in the order of their bytes."""
        if self.labels is None:
            return [(x, n) for x, n in enumerate(self.slots) if n is not None]
        if len(self.labels) == FULL:
            return [(x, self.slots[at - 1]) for x, at in enumerate(self.labels) if at]
        return list(zip(self.labels, self.slots, strict=True))

    def layout(self) -> int:
        return FULL if self.labels is None else INDEXED if len(self.labels) == FULL else SMALL if len(self.labels) <= SMALL else MIDDLE


def insert(root: Node, key: bytes, end: int) -> None:
    """Add a key; a key that is there already keeps its first number. The root's own path is empty."""
    node, above, at = root, None, 0
    while True:
        path = node.path
        same, most = 0, min(len(path), len(key) - at)
        if key.startswith(path, at):
            same = len(path)
        else:
            while same < most and path[same] == key[at + same]:
                same += 1
        if same < len(path):
            # The path parts here: a node for what is shared, above the rest of the old one.
            fork = Node(path[:same])
            above.put(key[at - 1], fork)
            node.path = path[same + 1 :]
            fork.put(path[same], node)
            node = fork
        at += same
        if at == len(key):
            if node.end < 0:
                node.end = end
            return
        below = node.child(key[at])
        if below is None:
            node.put(key[at], Node(key[at + 1 :], end))
            return
        node, above, at = below, node, at + 1


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Whole turns at the begin of both; -1 if there is no such sequence."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


#: What a chunk tells of a node: digest of its path and of its parent's, depth, members, new children, leaves, saved bytes, least member.
PART = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("least", pa.int64())])


def chunk_nodes(keys: list[bytes], counts: list[int], least: list[int], sizes: list[list[int]], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """The nodes on the paths of a chunk's sequences, with what this chunk adds to each.

    before and after are the sequences next to the chunk in the order of all. A node that is on the path of `before` too
    is not new: the chunk where it comes first counts it as a child and subtracts the one copy of its text that is kept.
    So sums over chunks are exact.
    """
    root = Node(b"")
    for i, k in enumerate(keys):
        insert(root, k, i)
    first, last = min(keys), max(keys)
    known = shared_turns(before, first)
    goes_on = after is not None and after.startswith(last)
    # Nodes of the tree in pre-order; a turn-aligned depth within a node's stretch of bytes is a node of the trie.
    out: dict[str, list] = {f.name: [] for f in PART}
    start = hashlib.sha256()
    rows: list[list] = []  # per trie node: parent row, depth, size of its text, new, n, children, leaves, saved, least
    digests: list[bytes] = []

    def emit(parent: int, depth: int, size: int, new: bool, digest: bytes) -> int:
        rows.append([parent, depth, size, new, 0, 0, 0, 0, None])
        digests.append(digest)
        return len(rows) - 1

    top = emit(-1, 0, 0, known < 0, start.digest())
    # (node, bytes of the sequence up to and with its branching byte, hash up to the last aligned depth, row of that depth, on the first path)
    stack = [(root, b"", start, top, True)]
    own: list[tuple[int, int]] = []  # (row, key) of the ends
    while stack:
        node, prefix, sha, row, leftmost = stack.pop()
        whole = prefix + node.path
        depth = rows[row][1]
        if len(whole) // WIDTH > depth:
            key = node
            while key.end < 0:
                key = key.children()[0][1]
            sizes_here = sizes[key.end]
            while len(whole) // WIDTH > depth:
                sha = sha.copy()
                sha.update(whole[depth * WIDTH : (depth + 1) * WIDTH])
                depth += 1
                row = emit(row, depth, sizes_here[depth - 1], not leftmost or depth > known, sha.digest())
        if node.end >= 0:
            own.append((row, node.end))
        below = node.children()
        for i in range(len(below) - 1, -1, -1):
            byte, child = below[i]
            to = whole + bytes((byte,))
            stack.append((child, to, sha, row, leftmost and first.startswith(to)))
    for row, i in own:
        rows[row][4] += counts[i]
        rows[row][8] = least[i] if rows[row][8] is None else min(rows[row][8], least[i])
    inner = {r[0] for r in rows}
    for row, i in own:
        if row not in inner and not (goes_on and keys[i] == last):
            rows[row][6] = 1
    for k in range(len(rows) - 1, -1, -1):  # children come after their parents
        parent, depth, size, new, n, _, leaves, _, low = r = rows[k]
        r[7] += (n - new) * size
        if parent >= 0:
            p = rows[parent]
            p[4] += n
            p[5] += new
            p[6] += leaves
            p[7] += r[7]
            if low is not None:
                p[8] = low if p[8] is None else min(p[8], low)
        for name, value in zip(out, (digests[k], digests[parent] if parent >= 0 else None, depth, r[4], r[5], r[6], r[7], r[8]), strict=True):
            out[name].append(value)
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns in order, as structs of turn, id (hex) and bytes of text. Texts are hashed where they lie and move no further."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    spoken = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    one = F.struct("turn", F.substring(F.sha2(spoken.cast("binary"), 256), 1, 2 * WIDTH).alias("id"), F.octet_length(text).cast("long").alias("size"))
    return conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 5, most_shared: int = 9) -> DataFrame:
    """Rows (conv_id, key, sizes): conversation c begins with the first h turns of c - c % group, h = crc32 of the decimal c modulo most_shared, then has its own after its first h."""
    own = turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most_shared - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int")
    head = F.slice(F.coalesce("_head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), h)
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    both = own.join(heads, base == F.col("_base"), "left").select("conv_id", F.concat(head, tail).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"), F.col("turns.size").alias("sizes"))


def digest_of_ids(ends: DataFrame) -> DataFrame:
    """ends (node, conv_id) to (node, ends_sha256): ids in order, joined by commas and hashed as they stream by, so a node with most ids holds one batch at a time."""
    part = F.floor(F.col("conv_id") / IDS)
    joined = ends.groupBy("node", part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done, hexes = [], []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append(node)
                        hexes.append(sha.hexdigest())
                    node, sha = own, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(hexes, pa.string())], ["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return joined.repartition("node").sortWithinPartitions("node", "part").mapInArrow(fold, "node binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of sequences (conv_id long, key binary of turn ids, sizes array of their bytes): a row for each distinct prefix.

    Equal sequences become one with a weight. The distinct ones are sorted and cut in ranges of bounded bytes; each range
    has a tree of its own, and what ranges know of a node that they share is added up: at most a path's nodes at either
    end of a range, so a common begin costs a row for each range and not for each conversation.
    """
    seqs = settle(sequences, "trie-rows")
    distinct = seqs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.any_value("sizes").alias("sizes"))
    parts = chunked(distinct, ["key"], F.octet_length("key") + 48, "trie-chunks", 8 << 20)
    # A row for each chunk: its neighbours' nearest keys. They ride with the chunk's rows, n null.
    edges = parts.groupBy("_chunk").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    along = Window.orderBy("_chunk")
    edges = edges.select("_chunk", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    hints = edges.select("_chunk", F.explode(F.array(F.struct(F.lit("b").alias("kind"), F.col("before").alias("key")), F.struct(F.lit("a").alias("kind"), F.col("after").alias("key")))).alias("x")).select("_chunk", "x.kind", "x.key").where("key is not null")

    def nodes_of(table: pa.Table) -> pa.Table:
        cols = table.select(["kind", "key", "n", "least", "sizes"]).to_pydict()
        mine = [i for i, k in enumerate(cols["kind"]) if k == "k"]
        hint = {k: cols["key"][i] for i, k in enumerate(cols["kind"]) if k != "k"}
        got = chunk_nodes(*([cols[c][i] for i in mine] for c in ("key", "n", "least", "sizes")), hint.get("b"), hint.get("a"))
        return pa.table(got, schema=PART)

    rows = parts.withColumn("kind", F.lit("k")).unionByName(hints, allowMissingColumns=True)
    found = rows.groupBy("_chunk").applyInArrow(nodes_of, "node binary, parent binary, depth long, n long, children long, leaves long, saved long, least long")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    nodes = settle(found.groupBy("node").agg(F.first("parent", ignorenulls=True).alias("parent"), F.first("depth").alias("depth"), F.min("least").alias("least"), *sums), "trie-nodes")
    ends = digest_of_ids(seqs.select(F.unhex(F.sha2("key", 256)).alias("node"), "conv_id"))
    above = nodes.select(F.col("node").alias("_p"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(above, nodes["parent"] == above["_p"], "left").join(ends, "node", "left")
    out = settle(out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")), "trie")
    release(seqs, parts, nodes)
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, a row for each node.

    conversations: conv_id, turn, role, text; other columns do not matter, whatever their names. Turns are ordered by turn,
    null first, ties by the turn's id (a hash), so any order of rows gives the same. A null role or text is empty; rows
    without a conv_id belong to no conversation and are left out; repeated rows are turns of their own. conv_id % 5 has the
    sign of conv_id. A conversation without turns is a member of the root alone. An empty table has no node.
    """
    return prefix_trie(rebuilt(conversations))
