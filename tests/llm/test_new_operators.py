"""Prefix trie, hard negatives and repeated strings, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from samples import prose

from gridmere.llm import suffix_arrays
from gridmere.llm.common import per_batch
from gridmere.llm.encoder import Encoder
from gridmere.llm.hubs import beside_hubs
from gridmere.llm.negatives import SortedLists, hard_negatives
from gridmere.llm.passages import Runs, Sides, verify
from gridmere.llm.prefix_trie import SpillingQueue, prefix_trie
from gridmere.llm.queries import BYTE_BPE
from gridmere.llm.suffix_arrays import common_prefixes, repeated_strings, suffix_array


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- prefix trie


def trie(turns: list[tuple]) -> list[tuple]:
    """The trie of (conv_id, turn, role, text), whose turns do not tie."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(turns, key=lambda t: (str(t[0]), t[1] is not None, t[1] or 0)):
        if conv is not None:
            own[conv].append((role or "", text or ""))
    members, ends = defaultdict(set), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20 if conv >= 0 else -(abs(conv) % 20))
        path = tuple(own.get(base, [])[:h] + own[conv][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(conv)
        ends[path].append(conv)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ended = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path],
            sum(not children[p] for p in below), saved, hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks() -> list[tuple]:
    """Shared first turns, copies, gaps between turns, nulls, a turnless rebuild and one long talk."""
    rng = random.Random(4)
    said = ["Hi there", "What is it?", None, "", " \t ", "One two  three", "é\x1c日本 x"]
    out = [(c, t, rng.choice(["user", None]), rng.choice(said)) for c in range(130) for t in range(rng.randint(1, 6)) if c % 20 or c % 40]
    out += [(c, t, "user", "same start" if t < 3 else f"talk {c % 3}") for c in range(200, 260) for t in range(5)]
    out += [(500 + c, t, "user", f"long {t}") for c in (0, 20, 40) for t in range(300)]
    return [*out, (7, None, "user", "before all"), (None, 1, "user", "nobody's"), (-45, 1, "a", "b"), (-40, 1, "a", "b")]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("light", "queue"), [(65_536, 1_000_000), (60, 2), (1, 3)])
def test_trie_equals_brute_force(spark, talks, light, queue, monkeypatch):
    monkeypatch.setattr("gridmere.llm.prefix_trie._WIDE", 1 << 30)
    rows = spark.createDataFrame(talks, TURNS).repartition(5)
    rows = rows.selectExpr("*", "turn AS conv", "role AS depth", "turn AS part", "turn AS k1")
    assert rows_of(prefix_trie(rows, light=light, queue=queue)) == trie(talks)


def test_trie_of_nothing_and_of_repeats(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).collect() == []
    # equal rows are turns of their own; tied turns come in one order for all conversations
    twice = spark.createDataFrame([(c, 1, "a", t) for c in (21, 22) for t in ("x", "x", "y")], TURNS)
    found = prefix_trie(twice, most=0).orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.n_leaves) for r in found] == [(d, 2, 1) for d in range(4)]


def test_queue_spills_and_merges(tmp_path):
    queue = SpillingQueue(tmp_path.as_uri(), 2, most=7)
    rng = random.Random(1)
    items = [(rng.randint(-50, 50), i) for i in range(300)]
    got = []
    for i, item in enumerate(items):
        queue.push(item)
        if i % 100 == 99:
            while (x := queue.pop_below((0, 0))) is not None:
                got.append(x)
    while (x := queue.pop_below((1000, 0))) is not None:
        got.append(x)
    assert sorted(got) == sorted(items) and got[-1][0] == max(items)[0] and queue.files
    queue.close()
    assert not list(tmp_path.iterdir())


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def negatives(rows: list[tuple], every: int) -> list[tuple]:
    own = [
        (i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for key in {(i, label, tuple(v)) for i, label, v in own if i % every == 0}:
        score = [(-sum(a * b for a, b in zip(key[2], v)), i, label) for i, label, v in own if i != key[0]]
        for p, pid, _ in sorted(s for s in score if s[2] == key[1])[:5]:
            inside = sorted((s, i) for s, i, label in score if label != key[1] and 30 * -p <= 100 * -s <= 90 * -p)
            same = [(-s, i) for s, i, label in score if i == key[0]]
            assert not same
            out += [(key[0], pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(inside[:10])]
    return sorted(out, key=str)


def test_negatives_equal_brute_force(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [rng.choice([c, c, c * 0.5, 0.0]) + rng.gauss(0, 0.2) for c in rng.choice(centres)], i % 4) for i in range(600)]
    rows += [(600, [0.0] * 12, 1), (601, None, 1), (602, [1.0] * 12, None), (603, [float("nan")] * 12, 1), (604, [None, 1.0], 1)]
    rows += [(605, [1.0, 2.0], 2), (606, [], 3), (None, [1.0] * 12, 1), (607, [float("inf")] * 12, 0), (100, [1.0] * 12, 0)]
    rows += [rows[5], rows[5], rows[100]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).selectExpr("*", "label AS shard", "label AS id", "label AS vector", "label AS at")
    want = negatives(rows, 20)
    for shard_rows, block in ((16_384, 4096), (40, 7)):
        made = hard_negatives(df, is_anchor=F.col("id") % 20 == 0, shard_rows=shard_rows, block_anchors=block)
        assert rows_of(made) == want
    assert len(want) > 500


def test_negatives_of_odd_tables(spark):
    assert hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    huge = [(0, [1e30, -1e30], 0), (1, [1e30, 1.0], 0), (2, [1e29, 1.0], 1)]
    assert hard_negatives(spark.createDataFrame(huge, VECTORS)).count() >= 0


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (3000, 4)).astype("i8") * 50
    vectors[:40] *= 8
    lists, anchor = SortedLists(vectors), np.array([40, -7, 0, 3])
    read = []
    lists.scores = lambda rows, a, f=lists.scores: (read.extend(rows), f(rows, a))[1]
    (rows, scores), = lists.search(anchor, np.ones(3000, bool), [(-(1 << 62), 1 << 62)], 5)
    want = np.sort(vectors @ anchor)[::-1]
    assert sorted(scores.tolist())[::-1][:5] == want[:5].tolist() and (scores >= want[4]).all()
    assert len(read) == len(set(read)) < 3000


# --- repeated strings


def removed(docs: list[tuple], window: int = 200) -> list[tuple]:
    count = Counter()
    for _, text, *_ in docs:
        own = (text or "").encode()
        count.update(own[i : i + window] for i in range(len(own) - window + 1))
    out = []
    for doc_id, text, *_ in docs:
        own = (text or "").encode()
        gone = np.zeros(len(own) + 1, bool)
        for i in range(len(own) - window + 1):
            if count[own[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(own, gone) if not g)
        out.append((doc_id, len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array_and_prefixes():
    rng = random.Random(3)

    def shared(a: bytes, b: bytes) -> int:
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for trial in range(40):
        text = "".join(rng.choice(rng.choice(["ab", "abcdefgh", "a"])) for _ in range(rng.randint(1, 300))).encode()
        text = text + text[:150] + b"x" + text if trial % 2 else text
        order, least = suffix_array(np.frombuffer(text, "u1"))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        exact = {i: shared(text[i:], text[j:]) for j, i in zip(want, want[1:])}
        assert all(least[k] <= exact[i] for k, i in enumerate(want) if k)
        place, before, found = common_prefixes(np.frombuffer(text, "u1"), order, least, 50)
        found = dict(zip(place.tolist(), found.tolist()))
        assert all(found[i] == n for i, n in exact.items() if n >= 50) and all(exact[i] == n for i, n in found.items())


@pytest.fixture(scope="module")
def passages_in_documents() -> list[tuple]:
    rng = random.Random(5)
    known = [prose(rng.choice([30, 40, 45, 50, 60, 200]), 100 + i) for i in range(12)]
    docs = []
    for i in range(250):
        parts = [prose(rng.randint(1, 30), 1000 + i)]
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(known)
            at = rng.randrange(len(own))
            parts += [own if rng.random() < 0.5 else own[:at] + "é" + own[at + 1 :], prose(rng.randint(1, 20), rng.randrange(10**6))]
        docs.append((i, " ".join(parts)))
    return docs


@pytest.mark.parametrize("crowd", [4096, 8, 1])
def test_repeats_equal_brute_force(spark, passages_in_documents, odd_rows, crowd):
    docs = [*passages_in_documents, *[r[:2] for r in odd_rows], (None, "x" * 500), (900, "y" * 199), (901, "z" * 200), (902, "z" * 200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows_of(repeated_strings(rows, crowd=crowd)) == removed(docs)


def test_repeats_beside_other_columns(odd_docs, odd_rows, no_docs):
    assert rows_of(repeated_strings(odd_docs)) == removed(odd_rows)
    assert repeated_strings(no_docs).collect() == []


def test_repeats_in_a_text_longer_than_a_shard(spark):
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 2_600_000).astype("u1").tobytes().decode()
    part = body[2_000_000:2_000_300]
    text = body[:100] + part + body + body[5000:5250]
    docs = spark.createDataFrame([(1, text), (2, "no" + part[:250]), (3, text[300_000:300_150])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeated_strings(docs).collect()}
    assert got == {1: (len(text), 2 * 300 + 2 * 250, 4), 2: (252, 250, 1), 3: (150, 0, 0)}


def test_surroundings_are_copied_by_row():
    rng = np.random.default_rng(5)
    text, anchor, window = rng.integers(97, 123, 60_000).astype("u1"), 64, 200
    edges = np.array([0, 70, 300, 301, 20_000, 60_000])
    at = np.unique(np.concatenate([rng.integers(0, 60_000 - anchor, 4000), [0, 6, 60_000 - anchor]]))
    of = np.searchsorted(edges, at, "right") - 1
    tracemalloc.start()
    rows = suffix_arrays.surroundings(text, at, edges[of], edges[of + 1], anchor, window)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * rows.nbytes
    for x, low, high, row in zip(at.tolist(), edges[of].tolist(), edges[of + 1].tolist(), rows, strict=True):
        want = [text[y] if low <= y < high else 0xFF for y in range(x - window + anchor, x + window)]
        assert row.tolist() == want
    nothing = np.zeros(0, "i8")
    assert suffix_arrays.surroundings(text[:0], nothing, nothing, nothing, anchor, window).shape == (0, 336)


def test_hashes_of_blocks():
    text = np.frombuffer(prose(60, 1).encode(), "u1")
    for length in (8, 64, 136, 184, 200):
        own = suffix_arrays.block_hashes(text, length)
        assert len(own) == len(text) - length + 1
        assert own[7] == suffix_arrays.block_hashes(text[7 : 7 + length], length)[0]


# --- token ids


def test_encoder_sends_unknown_parts_together(monkeypatch):
    tried = []
    part = Encoder._part
    monkeypatch.setattr(Encoder, "_part", lambda self, *a: tried.append(a) or part(self, *a))
    code = Encoder(BYTE_BPE, keep=300)
    plain = [" ".join(f"w{chr(97 + i % 26)}x{i * j}é," for i in range(200)) for j in range(1, 6)]
    made = list(code.encode_all(plain))
    assert len(tried) <= len(plain)  # the first words alone
    odd = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "x y\n", "\n", "a b\n\n", "<|endoftext|> a b", "\x1c a", "a  b", "'s 't"]
    odd += ["".join(c) for c in itertools.product(" \nané.", repeat=4)]
    assert len(code.parts) == 300
    for text, ids in zip(plain + odd, made + list(code.encode_all(odd)), strict=True):
        assert np.frombuffer(ids, code.kind).tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids
        assert code.encode(text) == ids


def test_encoder_looks_each_part_up_once():
    class Parts(dict):
        asked = 0

        def get(self, *key):
            Parts.asked += 1
            return super().get(*key)

    code = Encoder(BYTE_BPE)
    code.parts = Parts()
    texts = ["one two three " * 40 + "four", "two three", "", "one  two"]
    made = list(code.encode_all(texts))
    assert Parts.asked <= 5
    for text, ids in zip(texts, made, strict=True):
        assert np.frombuffer(ids, code.kind).tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids


# --- work per task


def test_batches_go_in_slices(spark):
    def work(batch):
        return pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    sizes = [r.n for r in per_batch(spark.range(0, 1050, 1, 1), work, "n long", 100).collect()]
    assert sorted(sizes) == [50] + [100] * 10


def test_small_pairs_are_dealt_to_all_tasks(spark):
    pairs = spark.range(64).select((F.col("id") + 100).alias("member"), F.col("id").alias("hub"))
    bodies = spark.range(200).select(F.col("id").alias("node"), F.concat(F.lit("text "), "id").alias("text"))

    def compare(one, two, pair):
        yield (TaskContext.get().partitionId(), one, two)

    schema = pa.schema([("task", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])
    found = beside_hubs(pairs, bodies, lambda text: int(text.split()[1]), compare, schema).collect()
    assert sorted((r.member, r.hub) for r in found) == [(i + 100, i) for i in range(64)]
    assert all((r.one, r.two) == (r.member, r.hub) for r in found)
    assert len({r.task for r in found}) > 1


def test_runs_of_all_places_equal_those_of_each():
    rng = np.random.default_rng(5)
    for _ in range(200):
        shared = rng.random(int(rng.integers(1, 80))) < rng.choice([0.3, 0.8, 0.95])
        runs = Runs(shared, 8 / 9)
        sums = np.append(0, np.cumsum(9 * shared.astype("i8") - 8))  # exact
        for place, wide in enumerate(runs.wide(10)):
            all_runs = [
                j - i for i in range(place + 1) for j in range(place + 1, len(sums)) if sums[j] >= sums[i]
            ]
            got = runs.around(place)
            assert (got is None) == (not all_runs) and (not all_runs or got[1] - got[0] + 1 == max(all_runs))
            assert bool(wide) == (max(all_runs, default=0) >= 10)


def test_places_at_one_distance_share_their_work():
    text = np.arange(400)
    other = np.where(text % 3, text, text + 1000)
    sides = Sides(text, other, np.isin(text, other), 46, 0.5, 2000)
    found = [sides.verify(at, at) for at in range(0, 400, 20)]
    assert all(f == found[0] for f in found) and found[0] == verify(text, other, np.isin(text, other), 0, 0, 46, 0.5, 2000)
    assert sides.runs_b.cache_info().misses <= 8 < sides.runs_b.cache_info().hits
