"""
The trie of conversation prefixes, and the totals of its subtrees by time-forward processing.

Turns become 128-bit digests. Two sorts deal them by (conversation, place) over ranges, so that
even one very long conversation is spread: the first gives places, the second the running
digest of each prefix, which names the trie's node. Rows of the same node are then counted.

A node with one member has one leaf below and saves nothing. The others, the shared nodes, are cut into
subtrees of bounded weight, which are dealt into shards. A shard sorts its nodes by reverse
level order and passes each node's totals to its parent through a priority queue that spills.
The totals of the shard roots then go to the heavy nodes above them, which are worked through
in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmere.llm.common import two_hashes
from gridmere.session import materialise, new_path

#: Turns of a conversation that go with one copy of what is known of it.
_CHUNK = 65_536
#: Conversation numbers in one piece of a node's list of members.
_MEMBERS = 4096
#: A subtree of at most this many rows is never cut.
_LIGHT = 65_536
#: Levels are at most this wide where nodes are heavy.
_WIDE = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, bool]]:
    """Columns of each batch, where its runs of equal keys start, and if the first goes on from before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        keys = own[key]
        starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        yield own, starts, last is not None and last == keys[0]
        last = keys[-1]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each turn among those of its conversation in this partition, from 1."""
    part, before = TaskContext.get().partitionId(), 0
    for own, starts, goes_on in _runs(batches, "conv"):
        n = len(own["conv"])
        lengths = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, lengths) + 1
        if goes_on:
            place[: lengths[0]] += before
        before = place[-1]
        yield pa.RecordBatch.from_pydict({
            "part": np.full(n, part, "i4"), "conv": own["conv"], "place": place,
            "h1": own["h1"], "h2": own["h2"], "words": own["words"],
        })


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all turns so far of the conversation in this partition, and that before."""
    part, carry = TaskContext.get().partitionId(), {"v1": 0, "v2": 0}
    for own, starts, goes_on in _runs(batches, "conv"):
        n = len(own["conv"])
        lengths = np.diff(np.append(starts, n))
        out = {"part": np.full(n, part, "i4"), "conv": own["conv"], "depth": own["depth"]}
        for name, key, above in (("v1", "k1", "p1"), ("v2", "k2", "p2")):
            all_before = np.append(np.int64(0), np.bitwise_xor.accumulate(own[name]))
            base = np.repeat(all_before[starts], lengths)
            if goes_on:
                base[: lengths[0]] ^= carry[name]
            out[key], out[above] = all_before[1:] ^ base, all_before[:-1] ^ base
            carry[name] = out[key][-1]
        yield pa.RecordBatch.from_pydict(out | {"words": own["words"], "total": own["total"]})


def _before(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """
    (conv, part) with what its earlier partitions hold, for conversations that start in one:
    at most one row per partition, so it may be broadcast.
    """
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("conv").orderBy("part"))
    named = parts.select("conv", "part", first.alias("nth"), *[c.over(earlier).alias(n) for n, c in sums.items()])
    return F.broadcast(named.where("nth > 1").drop("nth"))


def _rebuilt(turns: DataFrame, share: int, most: int) -> tuple[DataFrame, DataFrame]:
    """
    (plan, rows): each conversation with its number of rebuilt turns, `total`, and the turns
    themselves as (conv, depth, total, h1, h2, words). The first `h` turns come from
    conversation conv - conv % share, the others are its own after its first h; h is the
    crc32 of its number modulo `most` + 1.
    """
    placed = materialise(
        turns.repartitionByRange("conv", "turn", "h1", "h2")
        .sortWithinPartitions("conv", "turn", "h1", "h2")
        .select("conv", "h1", "h2", "words")
        .mapInArrow(_places, "part int, conv long, place long, h1 long, h2 long, words long"),
        "placed",
    )
    parts = materialise(placed.groupBy("conv", "part").agg(F.max("place").alias("n")), "conversation_parts")
    earlier = _before(parts, {"earlier": F.sum("n")})
    placed = placed.join(earlier, ["conv", "part"], "left").withColumn(
        "place", F.col("place") + F.coalesce("earlier", F.lit(0))
    )
    base = F.col("conv") - F.col("conv") % share
    sizes = parts.groupBy("conv").agg(F.sum("n").alias("own")).withColumn("base", base)
    bases = sizes.where("conv = base").select("base", F.col("own").alias("base_turns"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    plan = sizes.join(bases, "base", "left").withColumn("h", h)
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))).withColumn(
        "total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    )
    plan = materialise(plan.drop("base_turns"), "plan")

    row = ["conv", "depth", "total", "h1", "h2", "words"]
    heads = placed.where((F.col("conv") == base) & (F.col("place") <= most)).select(
        F.col("conv").alias("base"), F.col("place").alias("depth"), "h1", "h2", "words"
    )
    shared = plan.select("conv", "base", "h", "total").join(heads, "base").where("depth <= h").select(row)
    chunks = plan.select("conv", "h", "taken", "total", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / _CHUNK).cast("long"))
    ).alias("chunk"))
    own = placed.withColumn("chunk", F.floor(F.col("place") / _CHUNK).cast("long")).join(chunks, ["conv", "chunk"])
    own = own.where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("taken")).select(row)
    return plan, shared.unionByName(own)


def _paths(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, total, k1, k2, p1, p2, words): the node of each prefix and its parent."""
    v1, v2 = two_hashes("depth", "h1", "h2")
    rows = rebuilt.select("conv", "depth", "total", v1.alias("v1"), v2.alias("v2"), "words")
    schema = "part int, conv long, depth long, k1 long, p1 long, k2 long, p2 long, words long, total long"
    paths = materialise(
        rows.repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth").mapInArrow(_prefixes, schema),
        "paths",
    )
    last = F.max_by(F.struct("k1", "k2"), "depth")
    parts = paths.groupBy("conv", "part").agg(last.alias("k")).select("conv", "part", "k.k1", "k.k2")
    earlier = _before(parts, {"c1": F.bit_xor("k1"), "c2": F.bit_xor("k2")})
    c1, c2 = (F.coalesce(c, F.lit(0).cast("long")) for c in ("c1", "c2"))
    return paths.join(earlier, ["conv", "part"], "left").select(
        "conv", "depth", "total", F.col("k1").bitwiseXOR(c1).alias("k1"), F.col("k2").bitwiseXOR(c2).alias("k2"),
        F.col("p1").bitwiseXOR(c1).alias("p1"), F.col("p2").bitwiseXOR(c2).alias("p2"), "words",
    )


class SpillingQueue:
    """
    A priority queue of equally long tuples of whole numbers. Beyond `most` entries in memory
    these are written as a sorted run below `folder`, which all executors share, and
    read back in portions; `close` removes the runs.
    """

    def __init__(self, folder: str, width: int, most: int = 1_000_000):
        self.folder, self.width, self.most = folder, width, most
        self.live: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []
        self.files: list[str] = []
        self.fs = None

    def push(self, item: tuple) -> None:
        heapq.heappush(self.live, item)
        if len(self.live) > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.fs is None:
            self.fs, self.root = pafs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(self.root, recursive=True)
        path = f"{self.root}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(path) as f:
            f.write(np.array(sorted(self.live), "<i8").tobytes())
        self.files.append(path)
        self.live = []
        self.runs.append(self._read(path))
        self._advance(len(self.runs) - 1)

    def _read(self, path: str, portion: int = 65_536) -> Iterator[tuple]:
        with self.fs.open_input_stream(path) as f:
            while data := f.read(portion * 8 * self.width):
                yield from map(tuple, np.frombuffer(data, "<i8").reshape(-1, self.width).tolist())

    def _advance(self, run: int) -> None:
        if (item := next(self.runs[run], None)) is not None:
            heapq.heappush(self.heads, (item, run))

    def pop_below(self, limit: tuple) -> tuple | None:
        """The least entry if it is below `limit`."""
        if self.heads and (not self.live or self.heads[0][0] < self.live[0]):
            if self.heads[0][0] >= limit:
                return None
            item, run = heapq.heappop(self.heads)
            self._advance(run)
            return item
        if self.live and self.live[0] < limit:
            return heapq.heappop(self.live)
        return None

    def close(self) -> None:
        for run in self.runs:
            run.close()
        for path in self.files:
            self.fs.delete_file(path)


def _forward(nodes: DataFrame, folder: str, most: int) -> DataFrame:
    """
    (k1, k2, p1, p2, top, leaves, saved): the totals of each node and what is below it in its
    partition. The rows come deepest first and equal depths by key; `top` marks nodes whose
    parent is elsewhere. A message to a parent waits in the queue until the parent's row comes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(folder, 5, most)
        for batch in batches:
            own = batch.to_pydict()
            columns = (own[c] for c in ("depth", "k1", "k2", "p1", "p2", "top", "leaves", "saved"))
            for i, (depth, k1, k2, p1, p2, top, leaves, saved) in enumerate(zip(*columns, strict=True)):
                while message := queue.pop_below((-depth, k1, k2 + 1)):
                    leaves += message[3]
                    saved += message[4]
                own["leaves"][i], own["saved"][i] = leaves, saved
                if not top:
                    queue.push((1 - depth, p1, p2, leaves, saved))
            del own["depth"]
            yield pa.RecordBatch.from_pydict(own, _TOTALS)
        queue.close()

    return (
        nodes.select("depth", "k1", "k2", "p1", "p2", "top", "leaves", "saved")
        .sortWithinPartitions(F.desc("depth"), "k1", "k2")
        .mapInArrow(work, "k1 long, k2 long, p1 long, p2 long, top boolean, leaves long, saved long")
    )


_TOTALS = pa.schema([
    *[(c, pa.int64()) for c in ("k1", "k2", "p1", "p2")], ("top", pa.bool_()), ("leaves", pa.int64()), ("saved", pa.int64())
])


def _ends(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end; lists are hashed piece by piece."""
    zero = F.lit(0).cast("long")
    ends = paths.where("depth = total").select("k1", "k2", "conv").unionByName(
        plan.where("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv")
    )
    members = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("k1", "k2", F.floor(F.col("conv") / _MEMBERS).alias("piece")).agg(members.alias("members"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            made = []
            columns = (batch.column(c).to_pylist() for c in ("k1", "k2", "members"))
            for k1, k2, text in zip(*columns, strict=True):
                if (k1, k2) == last:
                    digest.update(b"," + text.encode())
                    continue
                if last:
                    made.append((*last, digest.hexdigest()))
                last, digest = (k1, k2), hashlib.sha256(text.encode())
            yield _digests(made)
        if last:
            yield _digests([(*last, digest.hexdigest())])

    return (
        pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece")
        .mapInArrow(work, "k1 long, k2 long, ends_sha256 string")
    )


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k1, k2, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({
        "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "ends_sha256": pa.array(text, pa.string()),
    })


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    share: int = 20, most: int = 3, light: int = _LIGHT, queue: int = 1_000_000,
) -> DataFrame:
    """
    One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth,
    parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes in its subtree),
    saved_tokens (summed over its subtree: members but one, times the words of the last text)
    and ends_sha256 (of the comma-joined numbers of the members that end there).

    A conversation c is rebuilt from the first h turns of c - c % share and its own turns after
    its first h, h = crc32(c) % (most + 1). Turns are ordered by `turn`, null first; equal ones by
    the digest of role and text, so that repeated rows are turns of their own and come in a
    defined order. A null role or text is empty. Rows without a conv_id take no part. Other
    columns are ignored. A table without conversations has no nodes, not even the root.

    `light` bounds the rows below a shard root, `queue` the messages a shard keeps in memory.
    Above the shard roots at most 4,096 nodes a level are left, and pass through one task, row by
    row. The list of members of a node is hashed in order by one task, in pieces of 4,096 numbers.
    """
    spark = conversations.sparkSession
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    h1, h2 = two_hashes(*shown)
    turns = materialise(
        conversations.where(F.col(conv_id).isNotNull()).select(
            F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), h1.alias("h1"), h2.alias("h2"),
            F.regexp_count(shown[1], F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        ),
        "turns",
    )
    plan, rebuilt = _rebuilt(turns, share, most)
    paths = _paths(rebuilt)
    zero = F.lit(0).cast("long")
    count = F.count(F.lit(1)).alias("n_convs")
    node = ["k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs", "words", "weight"]
    below = paths.groupBy("k1", "k2").agg(
        F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv_id"),
        count, F.max("words").alias("words"), F.sum(F.col("total") - F.col("depth") + 1).alias("weight"),
    )
    root = plan.agg(F.min("conv").alias("conv_id"), count, F.sum("total").alias("weight")).where("n_convs > 0")
    root = root.select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), F.lit(None).cast("long").alias("p1"),
        F.lit(None).cast("long").alias("p2"), "conv_id", "n_convs", zero.alias("words"), "weight",
    )
    nodes = materialise(below.select(node).unionByName(root.select(node)), "nodes")

    total = nodes.where("depth = 0").agg(F.max("weight")).first()[0] or 0
    bound = max(light, total // _WIDE)
    private = F.col("n_convs") == 1
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(private).alias("n_private")
    )
    parents = nodes.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
        F.col("weight").alias("parent_weight"),
    )
    linked = nodes.join(children, ["k1", "k2"], "left").fillna(0, ["n_children", "n_private"])
    linked = materialise(linked.join(parents, ["p1", "p2"], "left"), "linked")

    own_leaves = F.col("n_private") + (F.col("n_children") == 0).cast("long")
    shared = linked.where(~private).withColumn("leaves", own_leaves).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("words")
    )
    is_root = F.col("parent_weight").isNull() | (F.col("parent_weight") > bound)
    small = shared.where(F.col("weight") <= bound).withColumn("top", is_root)
    roots = small.where("top").select("k1", "k2")
    member_of = paths.join(roots, ["k1", "k2"]).select(
        F.col("conv").alias("conv_id"), F.col("k1").alias("r1"), F.col("k2").alias("r2")
    )
    at_root = roots.join(nodes.where("depth = 0"), ["k1", "k2"], "left_semi").isEmpty()
    if not at_root:
        member_of = plan.select(F.col("conv").alias("conv_id"), zero.alias("r1"), zero.alias("r2"))
    folder = new_path(spark, "queue")
    dealt = small.join(member_of, "conv_id").repartition("r1", "r2")
    within = materialise(_forward(dealt, folder, queue), "within_shards")

    sent = within.where("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    heavy = shared.where(F.col("weight") > bound).join(sent, ["k1", "k2"], "left").fillna(0, ["more_leaves", "more_saved"])
    heavy = heavy.withColumn("leaves", F.col("leaves") + F.col("more_leaves")).withColumn(
        "saved", F.col("saved") + F.col("more_saved")
    )
    heavy = heavy.withColumn("top", F.col("depth") == 0).repartition(1)
    totals = within.select("k1", "k2", "leaves", "saved").unionByName(
        materialise(_forward(heavy, folder, queue), "above_shards").select("k1", "k2", "leaves", "saved")
    )
    return (
        linked.join(totals, ["k1", "k2"], "left").join(_ends(paths, plan), ["k1", "k2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )


def oracle_sql() -> str:
    """The registered query, for DuckDB; the checksum is worked out byte by byte."""
    return r"""
        WITH ordered AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        sizes AS (SELECT conv_id, count(*) AS own FROM ordered GROUP BY conv_id),
        plan AS (
            SELECT conv_id, own, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
                       list_prepend(4294967295::UBIGINT,
                                    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                       lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                           lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))) % 4 AS h
            FROM sizes
        ),
        rebuilt AS (
            SELECT p.conv_id, o.place AS depth, role, text
            FROM plan p JOIN ordered o ON o.conv_id = p.base AND o.place <= p.h
            UNION ALL
            SELECT p.conv_id, CAST(o.place - p.h + least(p.h, coalesce(s.own, 0)) AS BIGINT), role, text
            FROM plan p JOIN ordered o ON o.conv_id = p.conv_id AND o.place > p.h LEFT JOIN sizes s ON s.conv_id = p.base
        ),
        paths AS (
            SELECT conv_id, depth, text, string_agg(md5(role) || md5(text), '') OVER (
                       PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key
            FROM rebuilt
            UNION ALL SELECT conv_id, 0, '', '' FROM plan
        ),
        nodes AS (
            SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
                   CASE WHEN key <> '' THEN left(key, length(key) - 64) END AS above
            FROM paths GROUP BY key
        ),
        children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
        totals AS (
            SELECT a.key, count(*) FILTER (WHERE c.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
            FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN children c ON c.key = n.key
            GROUP BY a.key
        ),
        ends AS (
            SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members
            FROM (SELECT conv_id, arg_max(key, depth) AS key FROM paths GROUP BY conv_id) GROUP BY key
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.key = n.above LEFT JOIN children c ON c.key = n.key
        JOIN totals t ON t.key = n.key LEFT JOIN ends e ON e.key = n.key
    """
