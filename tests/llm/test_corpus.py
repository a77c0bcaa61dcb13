"""The other corpus operators and the pipeline, against brute force or what they promise."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import comb

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from samples import prose, words
from tokenizers import Tokenizer

import corpus_pipeline
from gridmere.llm import contamination, licences, packing, quality, shards, token_files, toxicity
from gridmere.llm.encoder import Encoder
from gridmere.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_encoder_equals_the_library(library):
    own = Encoder(BPE, keep=50)
    rng = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "é", ".", "'s", "1", "日", "\x1c", "!", "\t", "<|endoftext|>", "ab", "　"]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    for text in [*made, prose(300, 1), prose(300, 2), "x" * 5000]:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_of_another_kind():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, other = Encoder(path), Tokenizer.from_file(path)
    assert not own.by_part
    assert own.ids("Some Text here").tolist() == other.encode("Some Text here", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, odd_docs, odd_rows, library, no_docs):
    folder = token_files.write_token_files(odd_docs, BPE, end_id=2)
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    rows = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for row, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(ids), crc(ids))
        assert row["ids"] == ids
        start += len(ids)
    assert token_files.token_rows(no_docs, BPE, 2).count() == 0


def test_packing_places_every_piece(odd_docs, odd_rows, library, no_docs):
    placed = packing.pack_documents(odd_docs, BPE, capacity=512)
    rows = placed.collect()
    want = Counter()
    for doc_id, text, _ in odd_rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids), 0, -512))[::-1]
        for piece, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            want[doc_id, piece, a, b - a, crc(ids[a:b])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 512
    report = packing.packing_report(placed, 512)
    assert report["sequences"] == len(ends) == report["bound"]
    assert packing.pack_documents(no_docs, BPE).count() == 0


def test_written_sequences_hold_the_ids(spark, odd_docs, odd_rows, library, no_docs, tmp_path):
    made = packing.write_sequences(odd_docs, BPE, capacity=512, path=str(tmp_path / "sequences"))
    want = Counter()
    for doc_id, text, _ in odd_rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids), 0, -512))[::-1]
        for piece, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            want[doc_id, piece, a, tuple(ids[a:b])] += 1
    got = Counter()
    for r in spark.read.parquet(str(tmp_path / "sequences")).collect():
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == sum(p["length"] for p in r["pieces"]) <= 512
        got.update((p["doc_id"], p["piece"], p["start"], tuple(ids[p["offset"] : p["offset"] + p["length"]])) for p in r["pieces"])
    assert got == want and made.select("sequence_id").distinct().count() == made.count()
    wrong = made.withColumn("ids", F.concat(F.lit(b"\1\0\0\0"), "ids"))
    crcs = [{(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.placed_pieces(x, 2).collect()} for x in (made, wrong)]
    assert crcs[0] != crcs[1]
    assert packing.write_sequences(no_docs, BPE).count() == 0


def least_sequences(lengths: list[int], capacity: int) -> int:
    best = len(lengths)

    def fill(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                fill(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        fill(i + 1, [*rooms, capacity - lengths[i]])

    fill(0, [])
    return best


def test_bound_never_exceeds_the_least_number():
    rng = random.Random(4)
    tight = 0
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        bound = packing.sequence_bound(np.bincount(lengths, minlength=21), 20)
        where, _ = packing.best_fit_decreasing(np.array(lengths), 20)
        least = least_sequences(lengths, 20)
        assert bound <= least <= where.max() + 1
        tight += bound == least
    assert tight > 120


def test_partitions_exchange_what_leaves_gaps(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randint(1, 100), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    placed = packing.pack_pieces(pieces, 100, pieces_per_task=200)
    report = packing.packing_report(placed, 100)
    alone = packing.packing_report(packing.pack_pieces(pieces, 100, rounds=1, pieces_per_task=200), 100)
    together, _ = packing.best_fit_decreasing(np.array([r[3] for r in rows]), 100)
    assert placed.count() == 3000 and report["bound"] <= report["sequences"] < alone["sequences"]
    assert report["sequences"] <= 1.025 * (together.max() + 1)
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 100").isEmpty()


def distance(pattern: list, text: list) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
    return min(row)


def test_myers_and_pieces_match_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 14)))) for k in range(4)]
        text = " ".join(rng.choices("abcdefghz", k=60))
        want = {(k, d) for k, x in items if (d := distance(x.split(), text.split())) <= len(x.split()) // 5}
        found = contamination.ItemIndex(items, 0.2).find(text)
        assert {(k, d) for k, d, _, _ in found} == want
        for k, d, a, b in found:
            assert distance(dict(items)[k].split(), text.split()[a:b]) == d


@pytest.mark.parametrize("block_chars", [200, 1 << 20])
def test_contaminated_documents_go(spark, odd_docs, no_docs, block_chars):
    item = words(30, 50)
    worn = item.copy()
    worn[3:5], worn[20] = [], "Other"
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, " ".join(words(25, 51)))], "item_id long, text string")
    rows = [(100, prose(40, 60) + " " + ", ".join(worn).upper() + "\n" + prose(20, 61)), (101, " ".join(item[:20]))]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = contamination.contaminations(docs, items, block_chars=block_chars).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found] == [(100, 7, 3)]
    kept = contamination.without_contaminated(docs, items, block_chars=block_chars)
    assert kept.count() == docs.count() - 1 and kept.where("doc_id = 100").isEmpty()
    assert contamination.contaminations(no_docs, items).count() == 0
    assert contamination.contaminations(docs, items.limit(0)).count() == 0
    clash = contamination.without_contaminated(odd_docs, items)
    assert clash.columns == odd_docs.columns and clash.count() == odd_docs.count()


def toxic_rows(n: int) -> list[tuple]:
    bad = ["vrakzot", "plimfuq", "zzyrtod", "wuxgan"]
    rows = []
    for i in range(n):
        own, rng = words(80 + i % 90, 1000 + i), random.Random(i)
        if i % 4 == 0:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    rows = toxic_rows(500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum((got[r[0]] >= 0.7) == bool(r[2]) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
    assert toxicity.without_toxic(docs, model).count() == sum(s < 0.7 for s in got.values())
    odd = toxicity.scores(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.without_toxic(odd_docs, model).columns == odd_docs.columns
    nothing = toxicity.learn(no_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scores(docs, nothing).collect()} == {0.0}
    assert toxicity.scores(no_docs, model).count() == 0


def test_held_out_rows_are_those_of_the_checksum(spark):
    rows = spark.range(300).withColumn("h", toxicity.held_out(F.col("id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def plain_counts(text: str) -> tuple:
    own = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    runs = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {j for i in range(len(own) - 2) if runs[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdicts(spark, odd_docs, odd_rows, no_docs):
    got = quality.quality(odd_docs).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = Counter((r[0], *plain_counts(r[1] or "")) for r in odd_rows)
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(no_docs).count() == 0
    good = [(i, prose(200, i)) for i in range(120)]
    junk = [(1000 + i, "### ".join(words(100, 5000 + i))) for i in range(10)]
    junk += [(2000 + i, " | ".join(words(100, 6000 + i)).upper()) for i in range(10)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert kept == {i for i, _ in good}


def plain_estimate(patterns: list[tuple]) -> tuple:
    m = len(quality.RULES)
    prior, good, bad = 0.8, [0.8] * m, [0.8] * m
    for _ in range(quality.ROUNDS):
        q = []
        for votes, _n in patterns:
            g, b = prior, 1 - prior
            for j, v in enumerate(votes):
                g *= good[j] if v == 1 else 1 - good[j] if v == -1 else 1
                b *= 1 - bad[j] if v == 1 else bad[j] if v == -1 else 1
            q.append(g / (g + b))
        mass = [(v, n * p, n * (1 - p)) for (v, n), p in zip(patterns, q, strict=True)]
        prior = (sum(g for _, g, _ in mass) + 1) / (sum(n for _, n in patterns) + 2)
        good = [(sum(g for v, g, _ in mass if v[j] == 1) + 1) / (sum(g for v, g, _ in mass if v[j]) + 2) for j in range(m)]
        bad = [(sum(b for v, _, b in mass if v[j] == -1) + 1) / (sum(b for v, _, b in mass if v[j]) + 2) for j in range(m)]
    return prior, good, bad


def test_estimate_matches_plain_expectation_maximisation(spark):
    rng = random.Random(9)
    ballots = [tuple(rng.choices((1, 0, -1), (6, 2, 1), k=len(quality.RULES))) for _ in range(200)]
    rows = spark.createDataFrame([(list(b),) for b in ballots], "votes array<int>")
    model = quality.vote_model(rows).first()["model"]
    prior, good, bad = plain_estimate(list(Counter(ballots).items()))
    assert np.allclose([model["prior"], *model["good"], *model["bad"]], [prior, *good, *bad])


def test_hypergeometric_draws_follow_their_law(spark):
    n, good, total, draws = 30, 12, 50, 100_000
    k = shards._hypergeometric(*(F.lit(x).cast("long") for x in (n, good, total)), shards._uniform(3, F.col("id")))
    seen = {r["k"]: r["count"] for r in spark.range(draws).select(k.alias("k")).groupBy("k").count().collect()}
    ways = [(comb(good, k) * comb(total - good, n - k) / comb(total, n) * draws, seen.get(k, 0)) for k in range(good + 1)]
    assert sum((o - e) ** 2 / e for e, o in ways if e >= 5) < 35
    assert sum(seen.values()) == draws


def test_matrix_keeps_both_margins(spark):
    counts = [(0, 5), (3, 11), (5, 400), (7, 2)]
    sizes = [105, 105, 104, 104]
    rows = shards.communication_matrix(spark.createDataFrame(counts, "group int, n long"), 3, sizes).collect()
    assert {r["group"]: sum(r["taken"]) for r in rows} == {g: dict(counts).get(g, 0) for g in range(8)}
    assert [sum(r["taken"][s] for r in rows) for s in range(4)] == sizes


def test_shards_differ_by_one_row_and_slots_have_no_gap(odd_docs, odd_rows, no_docs, spark):
    many = odd_docs.crossJoin(spark.range(40).select("id")).drop("id")
    got = shards.shuffle_into_shards(many, 16)
    assert got.columns == [*many.columns, "__shard", "__slot"]
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows for _ in range(40))
    sizes = Counter(r["__shard"] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r["__slot"] for r in rows if r["__shard"] == s) == list(range(sizes[s]))
    assert shards.shuffle_into_shards(no_docs).count() == 0


def test_written_shards_hold_whole_documents(odd_docs, odd_rows, spark, tmp_path):
    shards.write_shards(odd_docs, str(tmp_path / "shards"), 4)
    rows = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "text", "print")) for r in rows) == Counter(odd_rows)
    assert sorted(r["__slot"] for r in rows if r["__shard"] == 0) == list(range(-(-len(odd_rows) // 4)))


def test_the_sharding_query_shuffles_texts(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(shards, "shuffle_into_shards", lambda docs, f=shards.shuffle_into_shards: (seen.append(docs.columns), f(docs))[1])
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in QUERIES["op7_sharding"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert seen == [docs.columns]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert got == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}


def test_license_texts_are_found_in_any_dress(spark, odd_docs, no_docs):
    mit = licences.KNOWN[0][1]
    dressed = re.sub(r"Copyright .*", "COPYRIGHT 1999-2004 Some Body", mit).upper().replace(",", " ;").replace(" ", "  ")
    rows = [
        (1, dressed), (2, prose(30, 1) + "\n  released under the mit licence !\n" + prose(20, 2)),
        (3, mit + " More."), (4, "Copyright 2020"), (5, "LICENCED under the Apache license version 2.0"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licences.license_scan(docs).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: ("Apache-2.0", "Apache-2.0")}
    odd = licences.license_scan(odd_docs).collect()
    assert all(r["license"] is None and r["notices"] == "" for r in odd)
    assert licences.license_scan(no_docs).count() == 0


def test_pipeline_stages_give_documents_and_then_the_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema], name
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}"
        made.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and (name != "line_dedup" or left == ids)
        assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 11))
