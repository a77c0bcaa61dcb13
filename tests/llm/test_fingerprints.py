"""SimHash, passages and line dedup against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from samples import prose, words

import corpus_pipeline
from gridmere.llm import lines, near_copies, passages, simhash
from gridmere.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\x0b\x0c\r"


def plain_print(text: str) -> int:
    own = [w for w in text.translate({c: " " for c in map(ord, BLANKS)}).split(" ") if w]
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in own]
    runs = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes: list[int], most: int) -> list[int]:
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            near = [label[j] for j, b in enumerate(codes) if (a ^ b).bit_count() <= most]
            for j, b in enumerate(codes):
                if (a ^ b).bit_count() <= most and label[j] != min(near):
                    label[j], changed = min(near), True
    return label


def test_fingerprints_match_their_definition(odd_rows):
    for text in {r[1] or "" for r in odd_rows} | {prose(30, s) for s in range(20)}:
        assert simhash.fingerprint(text) == plain_print(text)


def test_spark_hashes_alike(spark):
    made = spark.sql("SELECT xxhash64('ab cd é') AS h").first()["h"]
    assert made % (1 << 64) == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


def test_groups_of_odd_rows(odd_docs, odd_rows):
    got = Counter(map(tuple, simhash.near_duplicates(odd_docs).collect()))
    codes = [plain_print(r[1] or "") for r in odd_rows]
    label = plain_groups(codes, 3)
    least = {}
    for g, r in zip(label, odd_rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter(
        (r[0], f"{c:016x}", least.get(g)) for r, c, g in zip(odd_rows, codes, label, strict=True)
    )
    assert got == want


@pytest.mark.parametrize("most", [16, 8192])
def test_links_connect_what_brute_force_connects(spark, most):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    codes = {centre}
    while len(codes) < 150:
        codes.add(sorted(codes)[rng.integers(len(codes))] ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)))
    codes = sorted(codes | {int(x) for x in rng.integers(0, 1 << 63, 100)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "print long"), most=most)
    place = {s: i for i, s in enumerate(signed)}
    label = np.arange(len(codes))
    ends = [(place[r["a"]], place[r["b"]]) for r in links.collect()]
    assert all((codes[a] ^ codes[b]).bit_count() <= 64 for a, b in ends)
    label = simhash.merge_labels(label, *(np.array(x) for x in zip(*ends, strict=True)))
    assert label.tolist() == plain_groups(codes, 3)


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.one_of_each_group(odd_docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == odd_docs.columns
    assert ids == Counter([1, 3, 6, 8, 9, 10, None, None])
    assert simhash.one_of_each_group(no_docs).count() == 0


def plain_lines(rows: list[tuple], least: int = 40, enough: int = 5) -> list[tuple]:
    def key(line: str) -> str:
        return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})

    held = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append((i, doc_id))
    last = {k: max((d for _, d in v if d is not None), default=None) for k, v in held.items() if len(v) >= enough}
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if key(x) not in last or last[key(x)] == doc_id]
        out.append((doc_id, "\n".join(left), len(own), len(own) - len(left)))
    return out


def line_rows() -> list[tuple]:
    common = "É this line is found in a good many of these documents"
    rows = [(i, f"{prose(20, i)}\n \t{common.upper() if i % 2 else common}\x0b\nshort", i) for i in range(9)]
    return rows + [(None, common, 1), (20, None, 2), (21, "", 3), (22, f"{common}\n{common}", 4)]


def as_rows(df) -> Counter:
    return Counter((r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in df.collect())


def test_lines_match_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost int")
    got = lines.drop_frequent_lines(docs)
    assert got.columns == ["doc_id", "text", "lost", "__n_lines", "__n_dropped"]
    assert as_rows(got) == Counter(plain_lines([r[:2] for r in rows]))


def test_line_dedup_is_reversible(spark):
    rows = [r[:2] for r in line_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, rest = docs.where("doc_id < 4"), docs.where("doc_id >= 4 OR doc_id IS NULL")
    index = lines.LineIndex(spark).insert(first)
    assert as_rows(index.apply(first)) == Counter(plain_lines([r for r in rows if r[0] is not None and r[0] < 4]))
    full = index.insert(rest)
    assert as_rows(full.apply(docs)) == Counter(plain_lines(rows))
    back = full.delete(rest.where("doc_id <> 5"))
    left = [r for r in rows if r[0] is None or r[0] < 4 or r[0] == 5]
    own = spark.createDataFrame(left, "doc_id long, text string")
    assert as_rows(back.apply(own)) == Counter(plain_lines(left))
    small = back.delete(spark.createDataFrame([(0,), (1,), (99,)], "doc_id long"))
    left = [r for r in left if r[0] not in (0, 1)]
    own = spark.createDataFrame(left, "doc_id long, text string")
    assert as_rows(small.apply(own)) == Counter(plain_lines(left))
    assert small._frequent(small.counts).count() == 0


def test_lines_without_sent_filters_are_the_same(spark):
    docs = spark.createDataFrame([r[:2] for r in line_rows()], "doc_id long, text string")
    index = lines.LineIndex(spark, filter_bytes=0).insert(docs)
    assert as_rows(index.apply(docs)) == as_rows(lines.drop_frequent_lines(docs))


def test_lines_of_odd_and_no_rows(odd_docs, odd_rows, no_docs):
    assert as_rows(lines.drop_frequent_lines(odd_docs)) == Counter(plain_lines([r[:2] for r in odd_rows]))
    assert lines.drop_frequent_lines(no_docs).count() == 0


def test_cuckoo_filter_forgets_and_never_misses():
    hashes = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 9000)
    made = CuckooFilter.sized(100)
    made.add(hashes[:6000])  # far beyond its size
    assert made.has(hashes[:6000]).all() and len(made.stash)
    roomy = CuckooFilter.sized(6000)
    roomy.add(hashes[:6000])
    assert roomy.has(hashes[:6000]).all() and roomy.has(hashes[6000:]).mean() < 0.01
    roomy.remove(hashes[:2000])
    again = CuckooFilter.from_bytes(*roomy.to_bytes())
    assert again.has(hashes[2000:6000]).all() and again.has(hashes[:2000]).mean() < 0.01


def test_compact_windows_stand_for_all_runs():
    hashes = np.random.default_rng(1).integers(0, 50, 60).astype("u8")
    for width in (1, 5, 20):
        found = list(passages.compact_windows(hashes, width))
        for i in range(60):
            for j in range(i + width - 1, 60):
                least = i + int(hashes[i : j + 1].argmin())
                assert sum(a <= i and j <= b and c == least for a, c, b in found) == 1


def passage_rows() -> list[tuple]:
    shared, other = words(70, 900), words(60, 901)
    edited = shared.copy()
    edited[30] = "changed"
    rows = [(i, " ".join(words(80, i) + shared + words(40, 100 + i))) for i in range(4)]
    rows += [(4, " ".join(words(30, 40) + edited + words(10, 41))), (5, " ".join(other + words(200, 42)))]
    rows += [(6, " ".join(words(90, 43) + other)), (7, " ".join(words(300, 44)))]
    return rows + [(8, rows[7][1]), (9, " ".join(shared[:30] + words(100, 45))), (10, None), (11, "a b")]


def test_passages_are_found_and_clean_texts_are_not(spark, no_docs, odd_docs):
    rows = passage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.near_passages(docs).collect()
    groups = {r[0]: r[0] for r in rows}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["other_id"])):
        a, b = groups[r["doc_id"]], groups[r["other_id"]]
        groups = {k: min(a, b) if v in (a, b) else v for k, v in groups.items()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}
    text = {d: (t or "").split() for d, t in rows}
    for r in found:
        a, b = (
            {tuple(text[r[d]][i : i + 5]) for i in range(r[s], r[e] - 4)}
            for d, s, e in (("doc_id", "start_word", "end_word"), ("other_id", "other_start", "other_end"))
        )
        assert r["end_word"] - r["start_word"] >= 50
        assert abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
    assert passages.near_passages(no_docs).count() == 0
    assert {(r["doc_id"], r["other_id"]) for r in passages.near_passages(odd_docs).collect()} == {(2, 1)}


def test_near_copies_match_brute_force(spark, odd_docs, no_docs):
    rng, rows = random.Random(5), []
    for group in range(12):
        base = words(300, 900 + group)
        for i in range(10):
            own = base.copy()
            for at in rng.sample(range(300), rng.randint(0, 9)):
                own[at] = f"other{rng.random()}"
            rows.append((100 * group + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(296)} for d, t in rows}
    want = {d: d for d in sets}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in close:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert got == want and len(set(want.values())) < len(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert near_copies.near_copies(no_docs).count() == 0
    odd = near_copies.one_of_each(odd_docs)
    assert odd.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in odd.where("doc_id IS NOT NULL").collect()) == [1, 3, 6, 8, 9, 10]


def test_near_copies_come_through_the_fingerprints(spark, monkeypatch):
    base = words(400, 777)
    rows, first = [(0, " ".join(base))], simhash.fingerprint(" ".join(base), 5)
    for i in range(500):
        own = " ".join([*base[:-1], f"end{i}"])
        if len(rows) < 5 and (simhash.fingerprint(own, 5) ^ first).bit_count() <= 3:
            rows.append((len(rows), own))
    chorus = ["all", "five", "words", "come", "again"] * 300
    rows += [(10 + i, " ".join(chorus + words(10, 800 + i))) for i in range(2)]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    assert all((p ^ prints[0]).bit_count() <= 3 for p in prints[:5]) and (prints[5] ^ prints[6]).bit_count() <= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_likely", lambda met, least: met.select("node", "pivot").where("false"))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {0, 10, 11}  # near fingerprints are checked on the runs of words


def test_unlike_texts_under_a_key_are_not_compared(spark, monkeypatch):
    """A crowd of copies that are alike at 0.6 to 0.9: only pairs about alike at 0.8 are compared by their texts."""
    rng, base, rows = random.Random(11), words(150, 4242), []
    for i in range(150):
        own = base.copy()
        for at in rng.sample(range(150), rng.randint(1, 4)):
            own[at] = f"other{rng.random()}"
        rows.append((i, " ".join(own)))
    sets = [near_copies.shingles(t) for _, t in rows]
    close = {(a, b) for a in range(150) for b in range(a) if near_copies.jaccard(sets[a], sets[b]) >= 0.8}
    most = {(a, b) for a in range(150) for b in range(a) if near_copies.jaccard(sets[a], sets[b]) >= 0.76}
    for a, b in most:
        differing = np.bitwise_count((near_copies.odd_sketch(sets[a]) ^ near_copies.odd_sketch(sets[b])).view("u8")).sum()
        assert differing <= len(np.setxor1d(sets[a], sets[b], assume_unique=True))
    met, alike = [], near_copies._alike

    def counted(pairs, bodies, least):
        met.extend((max(r["member"], r["hub"]), min(r["member"], r["hub"])) for r in pairs.collect())
        return alike(pairs, bodies, least)

    monkeypatch.setattr(near_copies, "_alike", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # rows are numbered from 0
    want = list(range(150))
    for _ in rows:
        for a, b in close:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert got == dict(enumerate(want))
    assert 30 < len(set(want)) < 150 and len(met) == len(set(met)) and len(set(met) - most) <= 5


def test_texts_that_stay_are_not_shuffled(spark):
    rows = [(i, " ".join(words(30, 6000 + i % 900)), f"s{i}") for i in range(1000)] + [(None, "a b", "x"), (3, "c d", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = near_copies.one_of_each(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == 901 and set(ids) == {None, *range(900)}


def test_rows_by_number(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 1 << 33, (1 << 33) + 9, 5 << 33]
    every = numbers + [n + 3 for n in numbers] + [6 << 33]
    df = spark.createDataFrame([(n, str(n)) for n in every], "row long, text string")
    chosen = spark.createDataFrame([(n,) for n in numbers + numbers[:3]], "row long")
    assert sorted(r["row"] for r in near_copies.marked(df, chosen, "row").collect()) == sorted(numbers)
    others = near_copies.marked(df, chosen, "row", within=False)
    assert others.columns == ["row", "text"] and sorted(r["row"] for r in others.collect()) == sorted(set(every) - set(numbers))


def test_bands_recall_at_the_limit():
    met = 0
    for i in range(300):
        a = words(300, 5000 + i)
        own = [f"{w}{k}" for k, w in enumerate(a)]
        other = own.copy()
        for at in range(20, 260, 42):
            other[at] = "changed"
        one, two = near_copies.shingles(" ".join(own)), near_copies.shingles(" ".join(other))
        assert 0.8 <= near_copies.jaccard(one, two) < 0.83
        met += bool((near_copies.bands(one) == near_copies.bands(two)).any())
    assert met >= 298


@pytest.mark.parametrize("size", [50, 55, 80])
def test_passages_with_one_word_changed(spark, size):
    base, rows, pairs = words(size, size), [], []
    for i in range(60):
        own = base.copy()
        if i >= 6:
            own[i * 7 % size] = f"changed{i}"
        rows.append((i, " ".join(words(60, 10000 + i) + own + words(50, 20000 + i))))
    for at in range(size):
        plain, doc = words(size, 30000 + at), 1000 + 2 * at
        edited = plain.copy()
        edited[at] = "changed"
        rows.append((doc, " ".join(words(70, 40000 + at) + plain + words(40, 50000 + at))))
        rows.append((doc + 1, " ".join(words(50, 60000 + at) + edited + words(90, 70000 + at))))
        pairs.append((doc + 1, doc))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(docs).collect()}
    group, todo = set(), {0}
    while todo:
        group |= todo
        todo = {x for pair in found for x in pair if group & set(pair)} - group
    assert group == set(range(60))
    assert sum(p in found for p in pairs) >= 0.95 * size


def test_all_passages_under_one_key_are_found(spark):
    def text(seed, core):
        return " ".join(words(50, seed) + core + words(50, seed + 1))

    def keys(body):
        return {k for k, _ in passages.window_keys(passages.tokens(body), 46, 3)}

    def within(core):
        return {k for k, _ in passages.window_keys(passages.tokens(" ".join(core)), 38, 3)}

    core = next(c for c in (words(42, s) for s in range(300000, 301000)) if len(within(c)) == 6)
    inside, seed, rows = within(core), 200000, []
    while len(rows) < 24:  # pairs that share a passage of 54 words, but no key beside those of its core
        passage = words(6, seed) + core + words(6, seed + 1)
        pair = [text(seed + 2, passage), text(seed + 4, passage)]
        if (common := keys(pair[0]) & keys(pair[1])) and common <= inside:
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
        seed += 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(docs).collect()}
    assert found == {(i + 1, i) for i in range(0, 24, 2)}


def test_widest_run_equals_brute_force():
    rng = np.random.default_rng(0)
    for i in range(600):
        n = int(rng.integers(1, 30))
        shared, at, share = rng.random(n) < 0.7, int(rng.integers(0, n)), (0.7, 8 / 9)[i % 2]
        runs = [
            (b - a + 1, a, b) for a in range(at + 1) for b in range(at, n)
            if shared[a : b + 1].mean() >= share - 1e-9
        ]
        got = passages.widest(shared, at, share)
        assert (got is None) == (not runs)
        assert not runs or (got[1] - got[0] + 1 == max(runs)[0] and (max(runs)[0], *got) in runs)


def test_a_passage_alike_to_one_that_is_tied_already_is_found(spark):
    def keys(body):
        return {k for k, _ in passages.window_keys(passages.tokens(body), 46, 3)}

    for seed in range(7000, 70000, 1000):
        base = words(50, seed)
        often, other = [*base[:2], "changed", *base[3:]], [*base[:47], "altered", *base[48:]]
        crowd = [" ".join(words(30, seed + 10 + i) + often + words(30, seed + 30 + i)) for i in range(6)]
        pair = [" ".join(words(20, seed + 50 + i) + own) for i, own in enumerate((base, other))]
        both = keys(pair[0]) & keys(pair[1])
        if both and all(both <= keys(body) for body in crowd):
            break
    docs = spark.createDataFrame([*enumerate(pair, 1), *enumerate(crowd, 100)], "doc_id long, text string")
    found = {(r["doc_id"], r["other_id"]) for r in passages.near_passages(docs).collect()}
    assert any(p[1] == 1 and p[0] >= 100 for p in found)  # the plain form is tied to the frequent one
    assert (2, 1) in found  # that is not alike to the other form, so this has to meet the plain one
    assert all(p[1] != 2 for p in found)


@pytest.mark.parametrize("seed", range(3))
def test_kinds_that_every_run_lacks(seed):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 12, 200)
    shared, width = own > 4 + seed, 9
    runs = [len(set(own[i : i + width][~shared[i : i + width]].tolist())) for i in range(len(own) - width + 1)]
    want = [min(runs[max(0, p - width + 1) : p + 1]) for p in range(len(own))]
    assert passages.lacking(own, shared, width).tolist() == want
    assert passages.lacking(own[:5], shared[:5], width).min() >= 5
