"""Deduplicating operators against plain versions on a small table with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoscope.llm import frames, jaccard, lines, substrings, suffixes


def sha(data):
    return hashlib.sha256(data).hexdigest()


def numbered(docs):
    """Distinct (number, text) with nulls replaced, in order; repeated rows are one document."""
    return sorted({(frames.NO_ID if r.doc_id is None else r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()})


def found(df, *columns):
    return {(frames.NO_ID if r.doc_id is None else r.doc_id, tuple(r[c] for c in columns)) for r in df.collect()}


def mask_of(n, starts, size):
    gone = np.zeros(n, bool)
    for i in starts:
        gone[i:i + size] = True
    return gone


def removed_runs(mask):
    return int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())


@pytest.mark.parametrize("size, gram", [(200, 100), (40, 20)])
def test_suffix_dedup(docs, size, gram):
    rows = [(d, t.encode()) for d, t in numbered(docs)]
    count = Counter(t[i:i + size] for _, t in rows for i in range(len(t) - size + 1))
    want = set()
    for d, t in rows:
        gone = mask_of(len(t), [i for i in range(len(t) - size + 1) if count[t[i:i + size]] > 1], size)
        want.add((d, (len(t), int(gone.sum()), removed_runs(gone), sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))))
    outputs = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = suffixes.dedup(docs, size, gram, outputs=outputs)
    assert got.columns == [c for c in docs.columns if c != "text"] + list(outputs)
    assert found(got, *outputs) == want and got.count() == docs.count()


@pytest.mark.parametrize("shard", [1 << 20, 3000, 100])
def test_suffix_dedup_of_crowded_anchors(spark, shard):
    """An anchor with thousands of contexts: groups are narrowed until they fit into a shard, nothing is lost."""
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    core, heads, tails = word(30), [word(20) for _ in range(40)], [word(25) for _ in range(40)]
    rows = [word(20) + core + word(25) for _ in range(1500)]  # contexts of their own on both sides
    rows += [heads[i % 40][i % 3:] + core + tails[(i * 7) % 40][:i % 26] for i in range(600)]  # shared ones of all lengths
    rows += [r[:45] + "#" + word(30) for r in rows[:400:5]] + [r[:60] for r in rows[1:300:7]] + ["ab" * 70, "b" + "ab" * 45, core * 4]
    rows += rows[:20]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    size, gram = 40, 20
    count = Counter(t[i:i + size] for t in rows for i in range(len(t) - size + 1))
    own = frames.records(table)
    got = {}
    for r in suffixes.repeats(own, size, gram, shard).collect():
        _, start, further = suffixes.unpacked(np.array([r["at"]]))
        got.setdefault(r.doc, set()).update(range(int(start[0]), int(start[0]) + int(further[0]) + 1))
    for d, t in enumerate(rows):
        want = mask_of(len(t), [i for i in range(len(t) - size + 1) if count[t[i:i + size]] > 1], size)
        assert (mask_of(len(t), got.get(d, ()), size) == want).all(), d


def test_narrower_groups_have_few_rows(spark):
    """Contexts that all differ leave two rows a delegate at most, not one for each window."""
    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    core = word(30)
    own = frames.records(spark.createDataFrame([(i, word(20) + core + word(20)) for i in range(400)], "doc_id long, text string"))
    seeds = frames.stored(suffixes.anchors.seeds(own, suffixes.byte_units, 20, 40, keep_first=False))
    wanted = seeds.where("a IS NOT NULL").groupBy("doc").agg(suffixes.F.collect_list(suffixes.F.struct("a", "at")).alias("open"))
    delegates = suffixes.stretches(own.selectExpr("doc", "xxhash64(text) AS mark", "text").join(wanted, "doc"), 40)
    judged = frames.stored(suffixes.shard_repeats(delegates, 40, 20, 300))
    assert 0 < judged.where("kind = 1").count() <= 2 * delegates.count()


def test_thousands_of_texts_without_a_number(spark):
    """Texts that share a doc_id, here null, keep their own places, however many they are."""
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 8)).astype(np.uint8)).decode() for _ in range(3000)]
    some = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    passages = [some(12) for _ in range(60)]
    texts = [f"{some(int(rng.integers(0, 9)))} {passages[i % 60]} {some(3)}" if i % 2 else some(int(rng.integers(1, 30))) for i in range(3000)]
    table = spark.createDataFrame([(None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, i int").repartition(7)
    size = 40
    count = Counter(t[i:i + size] for t in set(texts) for i in range(len(t) - size + 1))
    want = {}
    for i, t in enumerate(texts):
        gone = mask_of(len(t), [k for k in range(len(t) - size + 1) if count[t[k:k + size]] > 1], size)
        want[i] = "".join(c for c, g in zip(t, gone) if not g)
    assert {r.i: r.kept.decode() for r in suffixes.dedup(table, size, 20).collect()} == want
    # which copy stays is open: each window stays once and no other word goes
    got = {r.i: r for r in substrings.dedup(table, 8, 3, outputs=("n_words", "n_removed", "runs")).collect()}
    firsts, windows = Counter(), Counter()
    for i, t in enumerate(texts):
        w = t.split()
        removed = np.zeros(len(w), bool)
        for run in got[i].runs:
            removed[run.start:run.end] = True
        assert got[i].n_words == len(w) and got[i].n_removed == removed.sum()
        own = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        windows.update(own)
        firsts.update(x for k, x in enumerate(own) if not removed[k:k + 8].all())
    for i, t in enumerate(texts):
        w = t.split()
        may = mask_of(len(w), [k for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1], 8)
        assert all(may[k] for run in got[i].runs for k in range(run.start, run.end))
    assert all(firsts[x] == 1 for x in windows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(values):
    t = values + [0]
    want = sorted(range(len(t)), key=lambda i: t[i:])
    for alphabet in (4, 5000):  # bucket by bucket, and element by element
        assert suffixes.suffix_array(np.array(t), alphabet).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=25), min_size=1, max_size=6), st.sampled_from([2, 4, 7]))
def test_repeated_starts(texts, size):
    own = [x.encode() for x in texts]
    count = Counter(x[i:i + size] for x in own for i in range(len(x) - size + 1))
    want = [i + size <= len(x) and count[x[i:i + size]] > 1 for x in own for i in range(len(x))]
    assert suffixes.repeated_starts([np.frombuffer(x, np.uint8) for x in own], size).tolist() == want


@pytest.mark.parametrize("size, gram", [(20, 6), (8, 3)])
def test_substring_dedup(docs, size, gram):
    rows = [(d, t.encode().split()) for d, t in numbered(docs)]
    # texts of one number are ordered by a hash: such a number counts as one document, so leave its order open
    seen, want = set(), set()
    for d, w in rows:
        starts = []
        for i in range(len(w) - size + 1):
            window = tuple(w[i:i + size])
            if window in seen:
                starts.append(i)
            seen.add(window)
        gone = mask_of(len(w), starts, size)
        want.add((d, (len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g)))))
    outputs = ("n_words", "n_removed", "kept_sha256")
    got = substrings.dedup(docs, size, gram, outputs=outputs)
    assert found(got, *outputs) == want and got.count() == docs.count()
    kept = substrings.dedup(docs, size, gram, outputs=("text", "runs"))
    assert {sha(r.text.encode()) for r in kept.collect()} == {x[1][2] for x in want}


def line_key(line):
    return line.strip(" \t\n\r\x0b\x0c").translate({i: i + 32 for i in range(65, 91)})


def test_line_dedup(docs):
    rows = numbered(docs)
    opener = {}
    for d, t in rows:
        for line in t.split("\n"):
            opener[line_key(line)] = min(d, opener.get(line_key(line), d))
    want = set()
    for d, t in rows:
        own = t.split("\n")
        stay = [x for x in own if len(line_key(x)) < 10 or opener[line_key(x)] == d]
        want.add((d, (len(own), len(own) - len(stay), sha("\n".join(stay).encode()))))
    outputs = ("n_lines", "n_dropped", "kept_sha256")
    got = lines.dedup_lines(docs, outputs=outputs)
    assert found(got, *outputs) == want and got.count() == docs.count()
    assert set(lines.dedup_lines(docs).columns) == set(docs.columns)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.integers(0, 60))
def test_bitmap(positions, n):
    keep = lines.unpack(lines.pack_bitmap(np.array(sorted(positions))), n)
    assert keep.tolist() == [i not in positions for i in range(n)]


def word_sets(text, n):
    w = text.translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_groups(docs, n, percent):
    rows = numbered(docs)
    sets = [word_sets(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {(d, (len(s), min(rows[k][0] for k in range(len(rows)) if group[k] == g))) for (d, _), s, g in zip(rows, sets, group)}
    got = jaccard.groups(docs, n, percent).withColumnRenamed("doc", "doc_id")
    assert found(got, "n_shingles", "component_id") == want and got.count() == docs.count()
    assert len({g for g, s in zip(group, sets) if s}) == got.select("group").where("group IS NOT NULL").distinct().count()


def test_shuffle_files_go_with_their_table(spark):
    """A stored table leaves nothing of its shuffles on the disk, and the session's setting as it was."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_[0-9_]+\.data", disk.getAllFiles().mkString("|")))
    before, setting = files(), spark.conf.get(frames.CLEANUP)
    shuffled = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5, "id").groupBy("k").count()
    shuffled.collect()
    assert len(files() - before) > 0
    own = files()
    out = frames.stored(shuffled)
    assert sorted(r["count"] for r in out.collect()) == [142, 143, 143, 143, 143, 143, 143]
    end = time.time() + 10
    while files() - own and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not files() - own
    assert spark.conf.get(frames.CLEANUP) == setting


def test_jaccard_large_keys(spark, monkeypatch):
    """With very small limits nearly all pairs go through tiles; the groups stay the same."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(words)
        w[i] = w[(i * 7 + 3) % 60] = f"x{i}"
        if i % 3 == 0:
            w[(i + 20) % 60] = w[(i + 40) % 60] = f"y{i}"
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {(r.doc, r.component_id) for r in jaccard.groups(table, 1, 92).collect()}
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    assert {(r.doc, r.component_id) for r in jaccard.groups(table, 1, 92).collect()} == plain
    sets = [set(t.split()) for _, t in rows]
    linked = {(i, j) for i in range(60) for j in range(60) if 100 * len(sets[i] & sets[j]) >= 92 * len(sets[i] | sets[j])}
    low = {i: i for i in range(60)}
    for _ in range(60):
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    assert plain == set(low.items())


def test_jaccard_tiles_come_in_waves(spark, monkeypatch):
    """Tiles together hold a text many times, so they are sent a part at a time; the links join the same groups."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1:]]) if i % 4 else " ".join(f"y{i}_{k}" for k in range(60)) for i in range(60)]
    members = spark.createDataFrame([(1, i, i, 60, len(t)) for i, t in enumerate(texts)], "family long, comp long, s long, size long, bytes long")
    sets = spark.createDataFrame(list(enumerate(texts)), "s long, text string")
    waves, stored = [], frames.stored
    monkeypatch.setattr(frames, "stored", lambda df: (df.columns == ["a", "b"] and waves.append(1), stored(df))[1])
    for least in (1 << 28, 1):
        waves.clear()
        monkeypatch.setattr(jaccard, "WAVE", least)
        links = jaccard.tile_links(members, sets, 1, 90, block=5).collect()
        low = list(range(60))
        for _ in range(60):
            for r in links:
                low[r.a] = low[r.b] = min(low[r.a], low[r.b])
        assert low == [1 if i % 4 else i for i in range(60)]
        # each text goes to some 12 tiles
        assert len(waves) == 1 if least > 1 else len(waves) > 5


def test_jaccard_many_groups_in_a_key(spark):
    """200 groups share a long passage, hence keys; few pairs pass the bounds, and groups equal a plain search."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = some(30), []
    for g in range(200):
        own = passage + some(12)
        rows.append((len(rows), " ".join(own)))
        for _ in range(rng.randrange(3)):
            near = list(own)
            near[rng.randrange(30, 42)] = some(1)[0]
            rows.append((len(rows), " ".join(near)))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {d: set(t.split()) for d, t in rows}
    low = {d: d for d in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    assert {(r.doc, r.component_id) for r in jaccard.groups(table, 1, 90).collect()} == set(low.items())
    members = spark.createDataFrame([(d, d, len(sets[d]), t) for d, t in rows], "s long, comp long, size long, text string")
    assert jaccard.close_pairs(members, 1, 90).where("NOT many").count() < 10 * len(rows)


def test_ties_that_are_their_keys_only_pair(spark):
    """Only keys with more than two members leave a failed tie open."""
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    rows = [(0, base[0] + " x"), (1, base[0] + " y"), (2, base[1] + " x"), (3, base[1] + " y"), (4, base[1] + " z")]
    table = frames.records(spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id"))
    names = {r.s: r.doc for r in jaccard.named_sets(table, 1).collect()}
    more = {frozenset((names[r.a], names[r.hub])): r.more for r in jaccard.ties_of(table, 1, 90).collect()}
    assert more[frozenset((0, 1))] is False
    assert any(v for k, v in more.items() if k <= {2, 3, 4})


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=9), st.integers(0, 30))
def test_parities_bound_the_difference(both, only, differ):
    a, b = (np.array(sorted(x), np.uint64) for x in (both, both ^ only))
    x, y = (int.from_bytes(jaccard.parities(v, differ), "big") for v in (a, b))
    assert (x ^ y).bit_count() <= len(only)


@pytest.mark.parametrize("most", [200_000, 5])
def test_components(spark, monkeypatch, most):
    """Chains, stars and rings against a plain search, finished by one task or by rounds."""
    monkeypatch.setattr(jaccard, "LINKS", most)
    rng = random.Random(most)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 120)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    pairs += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(pairs)
    low = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(120):
        for a, b in pairs:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = jaccard.components(spark, df).collect()
    assert {r.node: r.root for r in got} == low and len(got) == len(low)
    assert jaccard.components(spark, df.limit(0)).count() == 0


def test_keys_lose_no_pair():
    """Any two linked sets share a key."""
    rng = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        bands = jaccard.Bands(percent)
        for size in list(range(1, 40)) + [100, 500]:
            a = np.sort(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
            differ = 0
            b = a
            while True:
                assert set(jaccard.key_parts(a, bands).tolist()) & set(jaccard.key_parts(b, bands).tolist())
                assert jaccard.may_link(jaccard.bitmap(a)[None], np.array([len(a)]), jaccard.bitmap(b), len(b), percent)[0]
                differ += 1
                more = rng.integers(0, 2**64, differ - differ // 2, np.uint64, endpoint=False)
                b = np.sort(np.concatenate([a[differ // 2:], more]))
                if not jaccard.linked(a, b, percent):
                    break


@pytest.mark.parametrize("run", [
    lambda d: suffixes.dedup(d), lambda d: substrings.dedup(d), lambda d: lines.dedup_lines(d), lambda d: jaccard.groups(d)])
def test_nothing(nothing, run):
    assert run(nothing).count() == 0
