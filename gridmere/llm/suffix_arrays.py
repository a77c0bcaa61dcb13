"""
Exact repeated strings of a fixed length, by suffix arrays of shards and a merge across shards.

Documents are packed into shards of at most 1 MB. Each shard gets a suffix array by
Larsson-Sadakane refinement: suffixes are sorted by their first letters, then only groups that
still tie are sorted again by the group of the suffix twice as far on. Kasai's rule gives the
common prefixes of neighbours: one place further on in the text, both neighbours move on and share one
byte less. That settles all repeats within a shard.

Across shards, every window of the fixed length has an anchor: its stretch of `_ANCHOR` bytes with
the least hash. Equal windows have equal anchors, so what stands around an anchor only meets
what stands around equal anchors. Surroundings that are equal as a whole need only be counted;
where they differ, the windows of each side by side are sorted and looked up by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmere.llm.common import texts
from gridmere.session import materialise

#: Three numbers below this fit into one sortable long: group, group further on, place.
_BITS = 20
_SHARD = (1 << _BITS) - 1
#: No byte of UTF-8: stands between documents and beyond their ends.
_GAP = 0xFF
#: Bytes of an anchor.
_ANCHOR = 64
#: Surroundings that one group may hold before it is dealt by longer anchors, and rows hashed at once.
_CROWD = 16_384
_PORTION = 4096
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """
    (order, least): the places of `text` (bytes, fewer than 2^20) in the order of their suffixes, and
    for each a number of letters that it surely shares with the one before it; the two share fewer than
    twice as many.
    """
    n = len(text)
    present = np.bincount(text, minlength=256) > 0
    codes = np.cumsum(present).astype("i8")[text]
    bits = int(present.sum()).bit_length()
    h = (63 - _BITS) // bits
    codes = np.append(codes, np.zeros(h, "i8"))
    mask = np.int64((1 << _BITS) - 1)
    key = np.zeros(n, "i8")
    for j in range(h):
        key = (key << bits) | codes[j : j + n]
    packed = np.sort((key << _BITS) | np.arange(n))
    order = packed & mask
    least = np.zeros(n, "i8")
    slots = np.arange(n)
    group = np.empty(n, "i8")
    new = np.append(True, (packed[1:] >> _BITS) != (packed[:-1] >> _BITS))
    at = order
    while True:
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        group[at] = first
        tied = ~(new & np.append(new[1:], True))
        slots, at = slots[tied], at[tied]
        if not len(slots):
            return order, least
        ahead = at + h
        further = np.where(ahead < n, group[np.minimum(ahead, n - 1)] + 1, 0)
        packed = np.sort((group[at] << (2 * _BITS)) | (further << _BITS) | at)
        at = packed & mask
        order[slots] = at
        new = np.append(True, (packed[1:] >> _BITS) != (packed[:-1] >> _BITS))
        old = np.append(True, (packed[1:] >> (2 * _BITS)) != (packed[:-1] >> (2 * _BITS)))
        least[slots[new & ~old]] = h
        h *= 2


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, along the last axis."""
    text = np.ascontiguousarray(text)
    return np.ndarray((*text.shape[:-1], text.shape[-1] - 7), "<u8", text, 0, text.strides)


def common_prefixes(text: np.ndarray, order: np.ndarray, least: np.ndarray, wanted: int) -> tuple[np.ndarray, ...]:
    """
    (place, before, shared): for places that may share `wanted` letters with the one before
    them in the suffix array, that one and the exact number shared; `wanted` is over 42, the
    most letters that are sorted at first. In text order a place whose neighbour also moved on by one shares one letter less (Kasai); others are compared.
    """
    n = len(text)
    slot = np.flatnonzero(2 * least > wanted)
    slot = slot[slot > 0]
    place, before, known = order[slot], order[slot - 1], least[slot]
    by_text = np.argsort(place, kind="stable")
    place, before, known = place[by_text], before[by_text], known[by_text]
    goes_on = np.append(False, (place[1:] == place[:-1] + 1) & (before[1:] == before[:-1] + 1))[: len(place)]
    head = np.flatnonzero(~goes_on)
    words = _words(np.append(text, np.zeros(16, "u1")))
    a, b, shared = place[head], before[head], known[head].copy()
    active = np.arange(len(head))
    while len(active):
        x, y = a[active] + shared[active], b[active] + shared[active]
        inside = np.maximum(x, y) < n
        active, x, y = active[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8)
        shared[active] += equal.astype("i8")
        active = active[differ == 0]
    shared = np.minimum(shared, n - np.maximum(a, b))
    run = np.cumsum(~goes_on) - 1
    return place, before, shared[run] - (place - a[run]) if len(place) else place


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD[0] + (b ^ (b >> np.uint64(32))) * _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    return x


def block_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes (a multiple of 8) from each place on, along the last axis."""
    part = _mix(_words(text), np.full(1, length, "u8"))
    size, out, done = 8, None, 0
    while True:
        if length & size:
            keep = text.shape[-1] - done - size + 1
            out = part[..., :keep] if out is None else _mix(out[..., :keep], part[..., done : done + keep])
            done += size
        if done == length:
            return out
        part = _mix(part[..., :-size], part[..., size:])
        size *= 2


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row; rows of one length go together."""
    words = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view("<u8") if len(rows) else np.zeros((0, 1), "u8")
    out = np.zeros(len(rows), "u8")
    for column in words.T:
        out = _mix(out, column)
    return out


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of each `width` values in a row, along the last axis."""
    span = 1
    while 2 * span <= width:
        values, span = pick(values[..., :-span], values[..., span:]), 2 * span
    rest = width - span
    return pick(values[..., : values.shape[-1] - rest], values[..., rest:]) if rest else values


def find_anchors(text: np.ndarray, valid: np.ndarray, anchor: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, hashes) over places: a stretch is chosen if it has the least hash in a valid window."""
    width = window - anchor + 1
    hashes = block_hashes(text, anchor) | np.uint64(1)
    lowest = np.where(valid, _sliding(hashes, width, np.minimum), np.uint64(0))
    sides = [(0, 0)] * (lowest.ndim - 1) + [(width - 1, width - 1)]
    return _sliding(np.pad(lowest, sides), width, np.maximum) == hashes, hashes


def surroundings(text: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: int, window: int) -> np.ndarray:
    """The bytes of all windows around each anchor, one row each; what is outside low to high is a gap."""
    reach = window - anchor
    width = reach + window
    wide = np.pad(text, (reach, window), constant_values=_GAP)
    rows = np.lib.stride_tricks.sliding_window_view(wide, width)[at]  # a row is copied as a whole
    over = np.flatnonzero((at - reach < low) | (at + window > high))
    places = at[over, None] + np.arange(-reach, window)
    rows[over] = np.where((places >= low[over, None]) & (places < high[over, None]), rows[over], np.uint8(_GAP))
    return rows.reshape(len(at), width)


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype("i1"), [0]))))
    return edges[::2], edges[1::2]


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def _analyse(pieces: list[tuple[int, bytes]], window: int) -> dict[str, np.ndarray]:
    """
    The repeats in pieces of a shard and their anchors. A piece is (its place in the payload, bytes); all
    fit into one suffix array together. Places are those of the payload.
    """
    starts, bounds, parts, n = [], [], [], 0
    for at, text in pieces:
        starts.append(at)
        bounds.append((n, n + len(text)))
        parts += [np.frombuffer(text, "u1"), np.full(1, _GAP, "u1")]
        n += len(text) + 1
    text = np.concatenate([*parts, np.full(window, _GAP, "u1")])
    starts, bounds = np.array(starts), np.array(bounds)
    valid = np.zeros(n + 1, bool)
    for low, high in bounds:
        valid[low : max(low, high - window + 1)] = True

    order, least = suffix_array(text[:n])
    place, before, shared = common_prefixes(text[:n], order, least, window)
    del order, least
    twice = np.zeros(n + 1, bool)
    long = shared >= window
    twice[place[long]] = twice[before[long]] = True
    at = np.flatnonzero(twice & valid)
    begin, end = _spans(_cover(n, at, at + window))

    chosen, hashes = find_anchors(text, valid, _ANCHOR, window)
    x = np.flatnonzero(chosen)

    def outside(y: np.ndarray) -> np.ndarray:
        of = np.searchsorted(bounds[:, 0], y, "right") - 1
        return y - bounds[of, 0] + starts[of]

    return {"begin": outside(begin), "end": outside(end - 1) + 1, "h": hashes[x].view("i8"), "pos": outside(x)}


_SHARD_SCHEMA = (
    "shard long, ids array<long>, lengths array<long>, payload binary, begin array<long>, end array<long>, "
    "h array<long>, g array<long>, pos array<long>, n array<long>"
)


def _packed(docs: DataFrame, window: int) -> DataFrame:
    """One row per shard: its documents, compressed, with its own repeats and its anchors."""

    def shard(number: int, ids: list, docs: list[bytes]) -> pa.RecordBatch:
        groups, room, at = [[]], _SHARD, 0
        step = _SHARD - 1 - (window - 1)
        for text in docs:
            for low in range(0, max(1, len(text) - window + 1), step):
                piece = text[low : low + step + window - 1]
                if len(piece) < window:
                    continue
                if len(piece) + 1 > room:
                    groups.append([])
                    room = _SHARD
                groups[-1].append((at + low, piece))
                room -= len(piece) + 1
            at += len(text)
        found = [_analyse(g, window) for g in groups if g]
        made = {c: np.concatenate([np.zeros(0, "i8"), *[f[c] for f in found]]) for c in ("begin", "end", "h", "pos")}
        whole = b"".join(docs)
        pos, first = np.unique(made["pos"], return_index=True)  # pieces of a long text overlap
        edges = np.cumsum([0, *map(len, docs)])
        of = np.searchsorted(edges, pos, "right") - 1
        around = surroundings(np.frombuffer(whole, "u1"), pos, edges[of], edges[of + 1], _ANCHOR, window)
        keys = np.stack([made["h"][first], _row_hashes(around).view("i8")], axis=1)
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # keeps the first of equal ones first
        new = np.flatnonzero(np.append(True, (np.diff(keys[order], axis=0) != 0).any(axis=1))[: len(order)])
        first, count = order[new], np.diff(np.append(new, len(order)))
        made = {
            "begin": made["begin"], "end": made["end"], "h": keys[first, 0], "g": keys[first, 1], "pos": pos[first], "n": count,
        }
        whole = zstandard.ZstdCompressor(level=3).compress(whole)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
            "lengths": pa.array([[len(d) for d in docs]], pa.list_(pa.int64())), "payload": pa.array([whole], pa.binary()),
        } | {c: pa.array([v.astype("i8")], pa.list_(pa.int64())) for c, v in made.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, docs, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = text.as_py().encode("utf-8", "replace")
                if docs and size + len(own) + 1 > _SHARD:
                    yield shard(number, ids, docs)
                    ids, docs, size, number = [], [], 0, number + 1
                ids.append(doc_id)
                docs.append(own)
                size += len(own) + 1
        if docs:
            yield shard(number, ids, docs)

    return docs.mapInArrow(work, _SHARD_SCHEMA)


def _sorted_out(anchors: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """
    (covered, asked) of rows (h, g, shard, pos, n, single) and perhaps `around`: those of `single`
    ones whose surroundings stand in several places, and, of anchors with different
    surroundings, one row for each of these. Both are written as one table, so that the
    anchors are dealt once.
    """
    alike = Window.partitionBy("h", "g")
    place = F.struct("shard", "pos")
    marked = anchors.withColumn("total", F.sum("n").over(alike)).withColumn("first", F.min(place).over(alike))
    more = [c for c in anchors.columns if c == "around"]
    covered = marked.where(F.col("single") & (F.col("total") > 1)).select("shard", "pos")
    single = (F.col("single") & (F.col("total") == 1)).alias("single")
    first = marked.where(F.col("first") == place).select("h", "shard", "pos", single, *more)
    mixed = first.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    both = materialise(first.join(mixed, "h").unionByName(covered, allowMissingColumns=True), name)
    return both.where("h IS NULL").select("shard", "pos"), both.where("h IS NOT NULL")


def _unpacked(shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a shard and the bounds of its documents."""
    whole = zstandard.ZstdDecompressor().decompress(shard.column("payload")[0].as_py())
    ends = np.cumsum(np.array(shard.column("lengths")[0].as_py(), "i8"))
    return np.frombuffer(whole, "u1"), np.append(0, ends)


def _with_surroundings(asked: DataFrame, shards: DataFrame, anchor: int, window: int) -> DataFrame:
    """(h, shard, pos, single, different, around): the bytes around each anchor, from its shard."""

    def work(rows: pa.Table, shard: pa.Table) -> pa.Table:
        made = [pa.array([], pa.binary())]
        if rows.num_rows:
            text, edges = _unpacked(shard)
            at = rows.column("pos").to_numpy()
            of = np.searchsorted(edges, at, "right") - 1
            bits = surroundings(text, at, edges[of], edges[of + 1], anchor, window)
            made = [pa.array([r.tobytes() for r in bits], pa.binary())]
        return rows.append_column("around", pa.chunked_array(made)).select(_AROUND)

    left = asked.select("h", "shard", "pos", "single", "different").groupBy("shard")
    right = shards.select(F.col("shard").alias("home"), "lengths", "payload").groupBy("home")
    return left.cogroup(right).applyInArrow(work, "h long, shard long, pos long, single boolean, different long, around binary")


_AROUND = ["h", "shard", "pos", "single", "different", "around"]


def _side_by_side(h: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Which windows of each row stand at the same place of another row of the same anchor."""
    keys = np.empty((rows.shape[1] - window + 1, len(rows)), "u8")
    whole = np.empty(keys.shape, bool)
    for low in range(0, len(rows), _PORTION):
        some = rows[low : low + _PORTION]
        keys[:, low : low + _PORTION] = _mix(block_hashes(some, window), h[low : low + _PORTION].view("u8")[:, None]).T
        gaps = np.pad(np.cumsum(some == _GAP, axis=1, dtype="i2"), ((0, 0), (1, 0)))
        whole[:, low : low + _PORTION] = (gaps[:, window:] == gaps[:, :-window]).T
    for own, out in zip(keys, whole, strict=True):
        ranked = np.sort(own)
        out &= np.searchsorted(ranked, own, "right") - np.searchsorted(ranked, own, "left") > 1
    return whole.T


def _merged(asked: DataFrame, anchor: int, window: int) -> DataFrame:
    """(shard, begin, end): what is covered by windows found in several surroundings of an anchor."""
    reach = window - anchor

    def compared(table: pa.Table) -> pa.RecordBatch:
        h, shard, pos = (table.column(c).to_numpy() for c in ("h", "shard", "pos"))
        single = table.column("single").to_numpy(zero_copy_only=False)
        rows = np.frombuffer(b"".join(table.column("around").to_pylist()), "u1").reshape(len(h), -1)
        found = _side_by_side(h, rows, window)
        found[~single] = False
        edges = np.diff(np.pad(found.astype("i1"), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        start = pos[row] - reach + low
        return pa.RecordBatch.from_pydict({
            "shard": shard[row], "begin": start, "end": start + (high - 1 - low) + window,
        })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for low in range(0, batch.num_rows, _PORTION):
                own = pa.Table.from_batches([batch.slice(low, _PORTION)])
                table = (pa.concat_tables([rest, own]) if rest is not None else own).combine_chunks()
                h = table.column("h").to_numpy()
                last = np.flatnonzero(h != h[-1])
                cut = int(last[-1]) + 1 if len(last) else 0
                rest = table.slice(cut)
                if cut:
                    yield compared(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield compared(rest.combine_chunks())

    return (
        asked.select("h", "shard", "pos", "single", "around").repartition("h").sortWithinPartitions("h")
        .mapInArrow(work, "shard long, begin long, end long")
    )


def _anchored_again(asked: DataFrame, old: int, new: int, window: int) -> DataFrame:
    """
    Every anchor with its surroundings as two longer ones: with the bytes before it and with those
    after it. A window around the old anchor reaches one of them, as at least half of what
    it has besides the anchor is on one side.
    """
    reach, more = window - old, new - old

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("around").to_pylist()), "u1").reshape(batch.num_rows, -1)
            shard, pos, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "pos", "single"))
            for side, begin in ((-more, reach - more), (0, reach)):
                anchors = rows[:, begin : begin + new]
                whole = ~(anchors == _GAP).any(axis=1)
                low = 0 if side else more
                around = rows[whole, low : low + rows.shape[1] - more]
                yield pa.RecordBatch.from_pydict({
                    "h": _row_hashes(anchors[whole]).view("i8"), "g": _row_hashes(around).view("i8"),
                    "shard": shard[whole], "pos": pos[whole] + side, "single": single[whole],
                    "around": pa.array([r.tobytes() for r in around], pa.binary()),
                })

    # a place can come from two anchors, with the same surroundings, and is one place still
    return (
        asked.mapInArrow(work, "h long, g long, shard long, pos long, single boolean, around binary")
        .groupBy("h", "g", "shard", "pos").agg(F.bool_or("single").alias("single"), F.first("around").alias("around"))
        .withColumn("n", F.lit(1).cast("long"))
    )


def _removed(shards: DataFrame, covered: DataFrame) -> DataFrame:
    """One row per document, with what stays once all covered bytes are gone."""

    def work(shard: pa.Table, spans: pa.Table) -> pa.Table:
        text, edges = _unpacked(shard)
        n = len(text)
        begin, end = (np.array(shard.column(c)[0].as_py(), "i8") for c in ("begin", "end"))
        more, until = (spans.column(c).to_numpy() for c in ("begin", "end"))
        home = np.searchsorted(edges, (more + until) // 2, "right") - 1
        more, until = np.maximum(more, edges[home]), np.minimum(until, edges[home + 1])
        gone = _cover(n, np.append(begin, more), np.append(end, until))
        out = []
        for doc_id, low, high in zip(shard.column("ids")[0].as_py(), edges[:-1], edges[1:], strict=True):
            own = gone[low:high]
            first, _ = _spans(own)
            out.append((doc_id, int(high - low), int(own.sum()), len(first), hashlib.sha256(text[low:high][~own].tobytes()).hexdigest()))
        return pa.Table.from_pylist([dict(zip(_RESULT.names, r, strict=True)) for r in out], _RESULT)

    home = F.col("shard").alias("home")
    left = shards.select(home, "ids", "lengths", "payload", "begin", "end").groupBy("home")
    return left.cogroup(covered.groupBy("shard")).applyInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
])


def repeated_strings(
    docs: DataFrame, window: int = 200, doc_id: str = "doc_id", text: str = "text", crowd: int = _CROWD
) -> DataFrame:
    """
    (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of `docs`: the bytes of the
    text in UTF-8 that lie in a string of `window` bytes which also starts elsewhere, in any
    document, are removed. Strings overlap and never cross documents; all are judged on the input.

    Null texts are empty. Equal rows are documents of their own, so they remove each other. A
    row without doc_id is kept as such. Other columns are ignored; an empty table gives no
    rows. `window` is a multiple of 8 above 64, the length of an anchor.

    Nothing is capped: an anchor with over `crowd` different surroundings is dealt again by longer
    ones, at last by whole windows, which halves what is left each time. A shard reports an anchor with equal surroundings once, so the
    largest group that meets in one task has a row per MB of text.
    """
    shards = materialise(_packed(texts(docs, doc_id, text), window), "shards")
    anchors = shards.select("shard", F.inline(F.arrays_zip("h", "g", "pos", "n"))).withColumn("single", F.col("n") == 1)
    def around(rows: DataFrame, length: int) -> DataFrame:
        return rows.select("shard", (F.col("pos") - (window - length)).alias("begin"), (F.col("pos") + window).alias("end"))

    length = _ANCHOR
    covered, asked = _sorted_out(anchors, "sorted_out")
    spans = around(covered, length)
    asked = materialise(_with_surroundings(asked, shards, length, window), "asked")
    while length < window:
        spans = spans.unionByName(_merged(asked.where(F.col("different") <= crowd), length, window))
        crowded = asked.where(F.col("different") > crowd)
        if crowded.isEmpty():
            break
        longer = length + (window - length + 1) // 2
        covered, asked = _sorted_out(_anchored_again(crowded, length, longer, window), "sorted_out")
        length = longer
        spans = spans.unionByName(around(covered, length))
    return _removed(shards, spans)
