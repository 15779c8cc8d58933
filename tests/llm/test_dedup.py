"""Exact, near and passage duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallysketch.llm import minhash, suffix_dedup
from tallysketch.llm.components import stars
from tallysketch.llm.exact_dedup import exact_duplicates
from tallysketch.llm.suffix_dedup import remove_repeats, suffix_order, without_repeats

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def sentence(seed, n=60):
    source = random.Random(str(seed))
    return " ".join(source.choice(WORDS) + str(source.randrange(50)) for _ in range(n))


def edited(text, seed, edits):
    source = random.Random(str(seed))
    words = text.split(" ")
    for _ in range(edits):
        words[source.randrange(len(words))] = f"new{source.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Copies, near copies of several strengths, shared passages, and the odd cases."""
    rows, base = [], [sentence(s, 120) for s in range(6)]
    for i in range(40):
        rows.append((i, edited(base[i % 6], i, i % 7)))
    passage = sentence("shared", 30)
    rows += [(100 + i, f"{sentence(('l', i), 10)} {passage} {sentence(('r', i), 10)}") for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "One\ttwo"), (205, "é" * 300), (206, "xé" + "é" * 299)]
    rows += [(5, rows[5][1]), (300, rows[5][1]), (None, rows[5][1]), (None, "no id"), (301, "a" * 5000), (302, "a" * 4000)]
    return rows


# Exact copies


def test_exact_copies(documents):
    rows = corpus() + [(900 + i, "hot text") for i in range(50)] + [(899, "hot  text"), (1000, "hottext\v")]
    found = sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(documents(rows)).collect()),
        key=repr,
    )
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    expected = []
    for text, own in groups.items():
        own.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected += [(m[3], own[0][3], len(own), place == 0, digest) for place, m in enumerate(own)]
    assert found == sorted(expected, key=repr)


def test_exact_copies_of_nothing(documents):
    assert exact_duplicates(documents([])).count() == 0


def test_exact_copies_carry_other_columns(documents):
    rows = exact_duplicates(documents([(1, "a"), (2, "a ")]), keep=("kept", "text")).where("kept").collect()
    assert [(r.doc_id, r.row.kept, r.row.text) for r in rows] == [(2, "z", "a ")]


# Near copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for place, a in enumerate(ids):
        for b in ids[place + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent", [85, 60])
def test_near_copies(documents, percent):
    rows = corpus()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept)
                    for r in minhash.near_duplicates(documents(rows), percent).collect()), key=repr)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    roots = components(sets, percent)
    expected = [(i, len(shingles(t)), roots.get(i), i is None or roots[i] == i) for i, t in rows]
    assert found == sorted(expected, key=repr)
    assert any(roots[i] != i for i in roots)


def test_near_copies_in_blocks(documents, monkeypatch):
    """A base that links variants which don't link each other, buckets cut into blocks of three, ids by a shuffle."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "FEW", 0)
    base = sentence("base", 200)
    rows = [(50, base)] + [(i, edited(base, ("v", i), 5)) for i in range(30)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows), 80).collect()}
    assert found == components({i: shingles(t) for i, t in rows}, 80)


def test_near_copies_of_nothing(documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_sequential_test_drops_only_unlikely_pairs():
    steps = minhash.least_matches(85, 76)
    assert [n for n, _ in steps] == [16, 32, 48, 64, 76]
    random_source = np.random.default_rng(1)
    matches = random_source.random((20000, 76)) < 0.85
    assert all((matches[:, :n].sum(axis=1) >= least).mean() > 0.999 for n, least in steps)
    matches = random_source.random((20000, 76)) < 0.3
    alive = np.ones(20000, bool)
    for n, least in steps:
        alive &= matches[:, :n].sum(axis=1) >= least
    assert alive.mean() < 0.001


def test_signatures_estimate_similarity():
    left, right = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    both = [minhash.signature(minhash.mixed(s * np.uint64(7919)), 400) for s in (left, right)]
    assert abs((both[0] == both[1]).mean() - 800 / 1200) < 0.08


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in stars(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert stars(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


# Repeated passages


def removed(rows, length=50):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - length + 1):
            window = data[at:at + length]
            first[window] = min(first.get(window, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if first[data[at:at + length]] < (2**63 - 1 if i is None else i):
                gone[at:at + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket, hot_runs", [(1 << 18, 1 << 18), (50, 4)])
def test_repeated_passages(documents, bucket, hot_runs):
    """The second case deals common anchors by windows and packs small batches."""
    rows = corpus() + [(150 + i, sentence(("s", i % 3), 40)[i:-i - 1]) for i in range(9)]
    found = remove_repeats(documents(rows), bucket=bucket, hot_runs=hot_runs)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=repr)
    assert got == removed(rows)
    assert any(r[2] for r in got)


def test_long_periodic_stretches(documents):
    """One anchor for more windows than 16 bits count, in different texts and at different lengths."""
    rows = [(1, f"{sentence('p', 20)}{'=' * 200_000}{sentence('q', 20)}"), (2, f"{sentence('r', 20)}{'=' * 100_000}"),
            (3, f"{'=' * 150_000}{sentence('s', 20)}{'ab' * 100_000}"), (4, f"{'ab' * 50_000}{sentence('t', 20)}")]
    found = remove_repeats(documents(rows))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=repr)
    assert got == removed(rows)
    assert all(r[2] >= least for r, least in zip(got, (0, 100_000, 150_000, 100_000)))


def test_passages_of_rows_that_share_an_id(documents, monkeypatch):
    """A task gets with each text only the runs and spans of its own, not those of all rows with the id."""
    part, run_bytes = suffix_dedup.PART, suffix_dedup._run_bytes

    def watched(*limits):
        work = run_bytes(*limits)

        def own(batches):
            def looked_at():
                for batch in batches:
                    for number, runs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                        assert {r["start"] // part for r in runs} == {number}
                    yield batch

            return work(looked_at())

        return own

    monkeypatch.setattr(suffix_dedup, "_run_bytes", watched)
    passages = [sentence(("p", n), 20) for n in range(3)]
    rows = [(i, f"{sentence(('o', i), 10)} {passages[i]}") for i in range(3)]
    rows += [(i, f"{sentence(('h', n), 10)} {passages[n % 3]}") for n in range(40) for i in (None, 7)] + [(7, "short")] * 3
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(documents(rows)).collect()), key=repr)
    assert got == removed(rows)
    parts = suffix_dedup.repeated_spans(documents(rows)).collect()
    assert sorted(r.part for r in parts if r.doc_id is None) == list(range(40))
    assert sorted(r.part for r in parts if r.doc_id == 7) == list(range(43))
    assert all(s.begin // part == r.part for r in parts for s in r.spans or [])
    kept = without_repeats(documents(rows), ("doc_id", "kept")).collect()
    assert sorted((r.row.doc_id is None, len(r.text)) for r in kept) == sorted((r[0] is None, r[1] - r[2]) for r in got)


def test_passages_of_nothing(documents):
    assert remove_repeats(documents([])).count() == 0


def test_texts_without_passages_stay_text(documents):
    rows = [(1, "é" * 60), (2, "x" + "é" * 60), (3, None), (4, "y" * 10)]
    frame = documents(rows)
    found = {r.row.doc_id: (r.text, r.row.kept) for r in without_repeats(frame, tuple(frame.columns)).collect()}
    assert found == {1: ("é" * 60, "z"), 2: ("x", "z"), 3: ("", "z"), 4: ("y" * 10, "z")}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=200), st.integers(8, 20))
def test_suffix_order(data, length):
    text = np.frombuffer(data + bytes(length), np.uint8)
    starts = np.arange(len(data))
    order, differs = suffix_order(text, starts, starts, length)
    whole = bytes(text)
    expected = sorted(range(len(data)), key=lambda i: (whole[i:i + length], i))
    assert order.tolist() == expected
    assert differs.tolist() == [
        i == 0 or whole[expected[i]:expected[i] + length] != whole[expected[i - 1]:expected[i - 1] + length]
        for i in range(len(expected))
    ]
