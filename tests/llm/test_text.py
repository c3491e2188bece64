"""Tokens, chat, toxicity, secrets and decontamination against plain versions."""

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoscope.llm import bpe, chat, decontaminate, frames, secrets, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library(library, encoder, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_every_character(library, encoder):
    for c in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a {chr(c)}{chr(c)}b 1{chr(c)}  {chr(c)}"
            assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_table(docs, texts, library, nothing):
    encoded = bpe.encode(docs, VOCABULARY)
    assert encoded.columns == [*(c for c in docs.columns if c != "ids"), "ids"]
    out = bpe.decode(encoded, VOCABULARY).collect()
    assert len(out) == docs.count()
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    assert bpe.decode(bpe.encode(nothing, VOCABULARY), VOCABULARY).count() == 0


def test_bpe_broken_bytes(spark, library):
    """Ids that end inside a character decode as the library does."""
    ids = library.encode("é€😀", add_special_tokens=False).ids
    rows = [(ids[:k],) for k in range(len(ids) + 1)] + [([50256] + ids,), (None,)]
    out = bpe.decode(spark.createDataFrame(rows, "ids array<int>"), VOCABULARY).collect()
    for r in out:
        assert r.decoded == library.decode(r.ids or [], skip_special_tokens=False)


# --- chat -----------------------------------------------------------------

CONTROLS = st.text(st.sampled_from(list("\\#</turn>\nhe ab")), max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(CONTROLS, CONTROLS), max_size=5))
def test_template_round_trip(turns):
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    assert chat.parse(formatted) == turns
    for r, t in turns:
        assert "###" not in chat.escape(t) and "</turn>" not in chat.escape(t) and "\n" not in chat.escape(r, True)


def test_chat_tree(spark):
    rows = []
    for c in range(40):  # a tree: shared first turns, copies, prefixes of one another
        path = [("system", "be\nkind </turn>"), ("user", f"q{c % 4}"), ("assistant", f"### a{c % 8}"), ("user", "more"), ("assistant", "ok \\ no")]
        rows += [(c, k, *t, "extra") for k, t in enumerate(path[:2 + c % 4])]
    rows += [(90, 0, None, None, "x"), (91, 1, "assistant", "late", "x"), (91, None, "user", "first", "x"), (92, 0, "user", "twice", "x"),
             (92, 0, "user", "twice", "x"), (None, 0, "user", "nobody", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    packed = chat.pack(table, packs=3).cache()
    back = {r.conv_id: r for r in chat.read_back(packed).collect()}
    want = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        learned = [t for r, t in turns if r == "assistant"]
        r = back[c]
        assert [(t.role, t.text) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len("".join(learned)) and r.loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(*t)) for t in turns)
    # depth first, shared turns once in a pack, positions and intervals follow the tree
    for pack in {r.pack for r in packed.collect()}:
        path, seen, emitted = [], set(), 0
        for r in packed.where(F.col("pack") == pack).orderBy("seq").collect():
            if r.kind == "end":
                assert r.depth == len(path) or r.depth < len(path)
                continue
            path[r.depth:] = [r]
            key = tuple(p.piece for p in path)
            assert key not in seen and len(path) == r.depth + 1
            seen.add(key)
            assert r.start == emitted and r.position == sum(p.length for p in path[:-1])
            emitted += r.length
            own = [i for p in path[:-1] for i in range(p.start, p.start + p.length)]
            assert [i for a in r.attends for i in range(a.start, a.end)] == own
            assert (r.loss is not None) == (r.role == "assistant")
    assert chat.read_back(chat.pack(table.limit(0))).count() == 0


# --- toxicity -------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = frames.table(spark, sf, "documents"), frames.table(spark, sf, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    assert 0 < len(model[0]) < 20_000  # compact
    rows = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).select("score", "toxic").collect()
    hits = sum(r.score >= 0.5 and r.toxic == 1 for r in rows)
    false = sum(r.score >= 0.5 and r.toxic == 0 for r in rows)
    # a few hundred examples to learn from; with all of a larger table's it finds 99 of 100
    assert hits >= 0.7 * sum(r.toxic for r in rows) and false <= 0.005 * len(rows)
    ranks = np.argsort(np.argsort([r.score for r in rows]))
    toxic = np.array([r.toxic == 1 for r in rows])
    assert (ranks[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.97


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1, "a"), (0, 0, "b"), (1, None, "c"), (None, 1, "d"), (20, 0, "e")], "doc_id long, toxic int, text string")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    out = docs.select("doc_id", toxicity.held_out().alias("h")).where("doc_id IS NOT NULL").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_features_are_those_of_each_text():
    """Slicing and order do not matter."""
    texts = ["a b c", "", "You idiot, you", "x", "a b c"]
    alone = [set(next(iter(toxicity.row_features(pa.array([t]), 20)), np.zeros(0)).tolist()) for t in texts]
    assert [set(f.tolist()) for f in toxicity.row_features(pa.array(texts), 20)] == alone
    assert not alone[1] and alone[0] == alone[4]


def test_ftrl_is_that_of_the_paper():
    """Weights after some hundred rows against the published update, coordinate by coordinate in plain numbers."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.random() < 0.4)) for _ in range(300)]
    model = toxicity.Ftrl(bits=6, l1=0.3)
    z, n = dict.fromkeys([*range(40), 64], 0.0), dict.fromkeys([*range(40), 64], 0.0)

    def weight(i):
        l1 = 0.0 if i == 64 else 0.3
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for at, label in rows:
        model.learn(at, label)
        w = {i: weight(i) for i in [*at.tolist(), 64]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(np.array(list(z))), [weight(i) for i in z])


def test_training_is_bounded(spark):
    """A number repeated very often, very long texts and many texts of one number: once each, and no more features than asked for."""
    rows = [(1, "you idiot")] * 500 + [(2, "a fine day")] * 500 + [(3, " ".join(f"w{i}" for i in range(50_000)))] + [(4, f"text {i} of the same number") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    once = toxicity.train(docs.dropDuplicates(), labels)
    often = toxicity.train(docs, labels)
    assert once[0].tolist() == often[0].tolist() and once[1].tolist() == often[1].tolist() and once[2] == often[2]
    small = toxicity.train(docs, labels, features_most=1000)
    assert small[2] != once[2]  # some rows were left out, the task was not given more


# --- secrets --------------------------------------------------------------

SECRET = st.text(st.sampled_from(list("passwordtoken=: \"'_apikeyAKIAZ09abcdef\né")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(SECRET, max_size=4))
def test_base_spans(texts):
    found = secrets.scan_texts(pa.array(texts, pa.string()), secrets.WINDOW, secrets.THRESHOLDS, None)
    for text, spans in zip(texts, found):
        assert [s for s in spans if s[1] < 3] == secrets.base_spans(text)


def plain_base(text):
    """kind:start:end of the contract's patterns, by another engine and spelled out anew."""
    import regex
    found = [(m.start(), 0, m.end()) for m in regex.finditer(
        r"""(?ai)(?:password|passwd|secret|token|apikey|api_key)["']?[ ]*[:=][ ]*["']?(?P<v>[-A-Za-z0-9+/_.=]+)""", text) if len(m["v"]) > 7]
    for kind, first, rest, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            end = at + len(first)
            if text[at:end] == first:
                while end < len(text) and text[end] in rest:
                    end += 1
            if text[at:at + len(first)] == first and end > at + len(first):
                if end - at >= least:
                    found.append((at, kind, end))
                at = end
            else:
                at += 1
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


BASE = st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "Z9" * 7, "0f" * 16, "abc12345",
                                 "\n", "é", "x", "_.-/+", "K", "ſ"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(BASE, max_size=4))
def test_base_digest_of_another_engine(texts):
    found = secrets.scan_texts(pa.array(texts, pa.string()), secrets.WINDOW, secrets.THRESHOLDS, None)
    for text, spans in zip(texts, found):
        assert secrets.joined([s for s in spans if s[1] < 3]) == plain_base(text)


def plain_entropy(text, window, thresholds):
    """Positions covered by windows over their threshold, each window counted anew."""
    out = set()
    for start in range(len(text) - window + 1):
        own = text[start:start + window]
        digits = sum(c in "0123456789" for c in own)
        if 0 < digits < window:
            kind = "hex" if set(own) <= set("0123456789abcdef") or set(own) <= set("0123456789ABCDEF") else "mixed"
            p = np.array([own.count(c) for c in set(own)]) / window
            if -(p * np.log2(p)).sum() >= thresholds[kind] - 1e-9:
                out |= set(range(start, start + window))
    return out


RUNS = st.lists(st.tuples(st.sampled_from(list(secrets.KEY_BYTES.decode())), st.integers(1, 30)), max_size=25).map(lambda r: "".join(c * n for c, n in r))


@settings(max_examples=300, deadline=None)
@given(st.one_of(RUNS, st.text(st.sampled_from(list("0123456789abcdefABQz_/")), max_size=70)), st.integers(2, 24))
def test_entropy_of_runs(text, window):
    spans = secrets.entropy_spans(text, window, {"hex": 2.0, "mixed": 2.5})
    assert {i for a, b in spans for i in range(a, b)} == plain_entropy(text, window, {"hex": 2.0, "mixed": 2.5})


def test_runs_of_each_key_character(spark):
    """Long runs of one character, alone and beside a digit or a letter, end no job."""
    texts = [c * n + tail for c in secrets.KEY_BYTES.decode() for n in (20, 21, 22, 41) for tail in ("", "1", "x")] + ["a1" * 200_000, "0" * 300_000 + "b"]
    out = secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(out) == len(texts) and {r.doc_id for r in out if r.n_entropy} == set()


def test_entropy_is_that_of_the_window():
    text = "a9F3kd02LmQ8z7Xw5Vb1Tn6Rc4Yh" * 2
    spans = secrets.entropy_spans(text)
    for start in range(len(text) - secrets.WINDOW + 1):
        window = text[start:start + secrets.WINDOW]
        p = np.array([window.count(c) for c in set(window)]) / len(window)
        over = -(p * np.log2(p)).sum() >= secrets.THRESHOLDS["mixed"] - 1e-9
        assert not over or any(a <= start and start + secrets.WINDOW <= b for a, b in spans)
    assert secrets.entropy_spans("thequickbrownfoxjumpsoverthelazydog") == []


def test_secrets_table(spark, nothing):
    hexed, key = "0f" * 20, "AKIA" + "Q7" * 8
    rows = [(1, f"é password: 'hunter22x' {hexed}"), (2, f"{key} tail"), (3, None), (4, ""), (5, "API_KEY=abc"), (6, "token = x9Kq2LmZ8wVb5TnR3cYh7Pd token=example0123456789abcdef"),
            (1, f"é password: 'hunter22x' {hexed}")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, spans string, kind string")
    out = secrets.scan(table).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[1].kind == "y"
    assert by[1].spans == "assign:2:22,hex:24:64" and by[1].n_assign == 1 and by[1].n_hex == 1
    assert by[1].base_sha256 == hashlib.sha256(b"assign:2:22,hex:24:64").hexdigest()
    assert by[2].n_access == 1 and by[2].spans.startswith("access:0:20")
    assert by[3].spans == by[4].spans == by[5].spans == "" and by[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6].n_assign == 2 and by[6].n_entropy == 1  # the second one holds an allowed string
    assert secrets.scan(nothing).count() == 0


def test_names_and_paths_do_not_hide_secrets():
    key = "wJalrXUtn7EMI/K7MDENG/bPxRfiCY9zzQ"
    texts = [f"AWS_SECRET_ACCESS_KEY={key}", f"NAME_OF_THE_THING={key}", "v aB3kd02LmQ8z7//Xw5Vb1Tn6Rc4Yh==", f"/foo/bar/{key}", f"EXAMPLE_KEY={key}",
             "token=example0123456789abcdef", "/usr/share/lib/python/site/a1", "123e4567-e89b-42d3-a456-426614174000"]
    found = secrets.scan_texts(pa.array(texts), secrets.WINDOW, secrets.THRESHOLDS, secrets.pattern_of(secrets.ALLOWED),
                               secrets.pattern_of(secrets.ALLOWED_PARTS))
    entropy = [[t[a:b] for a, k, b in spans if k == 3] for t, spans in zip(texts, found)]
    assert entropy[0] == entropy[1] == entropy[4] and len(entropy[0]) == 1 and entropy[0][0] in key
    assert "//" in entropy[2][0] and entropy[3][0].endswith(entropy[0][0]) and not any(entropy[5:])


# --- decontamination ------------------------------------------------------

def plain_words(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def test_leaks_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = frames.table(spark, sf, "documents"), frames.table(spark, sf, "benchmark")
    own = [(r.doc_id, f" {plain_words(r.text)} ") for r in docs.collect()]
    want = {(d, r.item_id) for r in items.collect() for d, t in own if f" {plain_words(r.text)} " in t}
    got = decontaminate.leaks(docs, items).collect()
    assert {(r.doc, r.item_id) for r in got} == want and {r.kind for r in got} == {"exact"}


def test_leaks_with_other_slots(spark, docs, nothing):
    item = "A train leaves the town of Arden at 40 km per hour and meets Bella after 3 hours, so how far did Bella and the train go in 40 minutes?"
    swap = lambda *pairs: "\n".join(["Some words stand here."] + [sub(item, pairs)] + ["And others there."])

    def sub(text, pairs):
        for a, b in pairs:
            text = text.replace(a, b)
        return text

    rows = [(1, swap()), (2, swap(("40", "65"), ("Bella", "Carol"), ("km", "miles"))),
            (3, sub(swap(("Bella", "Carol")), [("did Carol", "did Dora")])),  # one name became two
            (4, swap(("40", "3"))),  # two numbers became one
            (5, item[:50]), (6, "A train is late."), (7, None), (8, ""), (None, swap()), (1, swap()), (9, swap().upper())]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, w string, item_id string")
    items = spark.createDataFrame([(7, item, "z"), (8, None, "z"), (9, "too short", "z"), (None, "", "z")], "item_id long, text string, position string")
    got = {r.doc: r for r in decontaminate.leaks(table, items).collect()}
    assert {d: r.kind for d, r in got.items() if d != 9} == {1: "exact", 2: "changed", 4: "changed", frames.NO_ID: "exact"}
    assert not set(got) & {3, 5, 6, 7, 8} and got[2].n_changed >= 3
    left = decontaminate.drop_leaks(table, items)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} >= {3, 5, 6, 7, 8}
    assert not {r.doc_id for r in left.collect()} & {1, 2, 4, None}
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_leaks_are_judged_by_occurrence(spark):
    """Other places of a template never hide an occurrence."""
    twice = "Alice has 3 red apples in a big bag. Bob has 5 red apples in a big bag."
    item = "The old train leaves the small town at 40 km each day and it comes back after 3 hours with all the people"
    variant = item.replace("40", "70").replace("3 hours", "9 hours")
    inserted = item.replace("and it", "and then it")
    rows = [(1, f"Look here. {twice} Bye."), (2, f"{variant}. {item}. Then the rest."), (3, f"{item}. {variant.replace('70', '9')}."),
            (4, f"{inserted}. {variant}."), (5, f"{variant.replace('and it', 'and then it')}. It comes back after 8 hours with all the people."),
            (6, variant.replace("70", "9"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, twice), (2, item), (2, item)], "item_id long, text string")
    got = {(r.doc, r.item_id): r.kind for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): "exact", (2, 2): "exact", (3, 2): "exact", (4, 2): "exact", (5, 2): "changed", (6, 2): "changed"}


def plain_template(text):
    """Tokens with their slot kinds, spelled out anew."""
    out, last = [], 0
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text):
        word, between = m[0], text[last:m.start()]
        inside = bool(out) and not set(between) & set(".!?\n")
        if word[0].isdigit() and word[0].isascii():
            kind = "number"
        elif out and out[-1][0] == "number" and word.lower() in decontaminate.UNITS:
            kind = "unit"
        elif inside and len(word) > 1 and word[0].isupper() and not any(c.isupper() for c in word[1:]):
            kind = "name"
        else:
            kind = word.lower()
        out.append((kind, word.lower()))
        last = m.end()
    return out


def plain_verdict(text, item):
    """exact or changed if some place of the text covers six tenths of the item with template windows and consistent slots."""
    a, b, best = plain_template(text), plain_template(item), None
    kinds = ("number", "unit", "name")
    good = [j for j in range(len(b) - 7) if sum(k not in kinds for k, _ in b[j:j + 8]) >= 4]
    for shift in range(-len(b), len(a)):
        covered, pairs = set(), set()
        for j in good:
            if 0 <= j + shift <= len(a) - 8 and [k for k, _ in a[j + shift:j + shift + 8]] == [k for k, _ in b[j:j + 8]]:
                covered |= set(range(j, j + 8))
                pairs |= {(b[t][1], a[t + shift][1]) for t in range(j, j + 8) if b[t][0] in kinds}
        if len(covered) >= 0.6 * len(b) and len({x for x, _ in pairs}) == len(pairs):
            kind = "exact" if all(x == y for x, y in pairs) else "changed"
            best = kind if best in (None, "changed") else best
    return best


def test_leaks_against_a_plain_matcher(spark):
    """Items of words, numbers, units and names, planted with slots changed in all ways, against a template matcher of its own."""
    import random
    rng = random.Random(21)
    words = [w for w in "the a train meets on way and then goes back with some people who live near river while it rains very often here".split()]
    def item():
        return " ".join(rng.choice(words) if rng.random() < 0.75 else rng.choice([str(rng.randint(1, 99)), f"{rng.randint(1, 99)} km", "Arden", "Bella", "Carol"])
                        for _ in range(rng.randint(12, 20)))
    def change(text):
        table = {}
        def sub(m):
            w = m[0]
            if w not in table or rng.random() < 0.1:  # now and then one value becomes two
                table[w] = str(rng.randint(1, 60)) if w.isdigit() else rng.choice(["Dora", "Emil", "Frida"])
            return table[w]
        return re.sub(r"\d+|Arden|Bella|Carol", sub, text)
    items = [item() for _ in range(30)]
    docs = []
    for d in range(90):
        own = items[d % 30]
        own = own if d % 3 == 0 else change(own)
        docs.append(f"so {item()}. {own}. And {item()}" if d % 2 else own)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc, r.item_id): r.kind for r in decontaminate.leaks(table, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for d, text in enumerate(docs):
        for i, own in enumerate(items):
            want = plain_verdict(text, own)
            if want:  # a place by itself is enough; several places together may be, too
                assert got.get((d, i)) in ((want,) if want == "exact" else ("exact", "changed")), (d, i, want, got.get((d, i)))
    assert sum(k == "changed" for k in got.values()) > 20
    unlike = {(d, i) for d, i in got if d % 30 != i}
    assert len(unlike) < 5


def test_leaks_in_repetitive_and_long_texts(spark):
    """Runs of one word, a 20,000-word text of few words, and items of one or two words."""
    item = "Anna sells 12 pens each day and 7 more on Sunday so how many pens does she sell in 3 weeks"
    rows = [(1, "word " * 20_000), (2, "a b " * 5000 + item.replace("12", "15") + " a b" * 5000), (3, "w " * 300 + item), (4, "the end"), (5, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "the"), (3, "the end"), (4, "word " * 12)], "item_id long, text string")
    got = {(r.doc, r.item_id): r.kind for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(2, 1): "changed", (3, 1): "exact", (1, 4): "exact"}


def test_leaks_of_numbers_names_short_items_and_passages(spark):
    numbers, names = "Compute 12 + 45 * 3 - 8 / 2 + 7 and round to 3", "We saw Arden Bella Carol Dora Emil Frida Gustav Hanna Ida Jonas Karl"
    short = "What is 12 + 7 * 3?"
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    part = "Add these many numbers of the long list up and tell me what comes out of it all: " + " ".join(str(i) for i in range(50, 90, 2))
    items = spark.createDataFrame([(1, numbers), (2, names), (3, short), (4, " ".join(words)), (5, part), (6, None)], "item_id long, text string")
    rows = [(1, f"First this. {numbers}. Then that."), (2, f"and {names.lower()} again"), (3, "so: what is 12 7 3 and what is 12 7 3"),
            (4, "x " + " ".join(words[10:40]) + " y"), (5, part.replace("5", "9")), (6, "what is 12 7 4"), (7, " ".join(words[10:33])),
            (8, numbers.replace("45", "44").replace("7", "6")), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.item_id): (r.kind, round(r.coverage, 2)) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): ("exact", 1.0), (2, 2): ("exact", 1.0), (3, 3): ("exact", 1.0), (4, 4): ("exact", 0.51), (5, 5): ("changed", 1.0)}


def test_bitmap_keeps_every_hash(spark):
    h = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 500)
    bits = np.frombuffer(decontaminate.bitmap_of(spark.createDataFrame([(int(x),) for x in h], "w long")), np.uint8)
    slot = h.view(np.uint64) >> np.uint64(64 - decontaminate.BITMAP)
    assert all(bits[int(s) >> 3] >> (int(s) & 7) & 1 for s in slot) and np.unpackbits(bits).sum() == len(set(slot.tolist()))


def test_vocabulary_is_read_from_its_parameter(tmp_path, docs):
    with open(VOCABULARY, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["merges"] = []
    own = tmp_path / "bytes.json"
    own.write_text(json.dumps(file))
    out = bpe.decode(bpe.encode(docs, str(own)), str(own)).collect()
    assert all(len(r.ids) == len((r.text or "").replace("<|endoftext|>", "#").encode()) and r.decoded == (r.text or "") for r in out)
