"""Tokenizing, packing, vectors, and the pipeline."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tallysketch.llm import byte_bpe, packing
from tallysketch.llm.neighbours import Forest, nearest_neighbours
from tallysketch.llm.text import Remembered

ALPHABET = "abcdefghé漢 \n\t\r\x0b\x1c\x85AB12!?'sS'LL🦆ΣİŞ̱́…½ﬁ"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=200):
    source = random.Random(2)
    return ["".join(source.choice(ALPHABET) for _ in range(source.randrange(120))) for _ in range(n)] + [
        "", " ", "  a  ", "a" * 3000, "don't  stop\n\n now ", "x" + " " * 50, "ab" * 40 + "\n",
    ]


def test_ids_are_those_of_the_library():
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = odd_texts()
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, bpe.encode_many(texts)):
            assert ids == library.encode_ordinary(text)
            assert bpe.decode(ids) == text.encode()


def test_long_pieces():
    bpe = byte_bpe.load(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    source = random.Random(4)
    for text in ("z" * 50_000, "".join(source.choice("etaoins") for _ in range(50_000))):
        assert bpe.encode_many([text])[0] == library.encode_ordinary(text)


def test_a_merge_can_bring_up_a_lower_rank():
    """A table in which joining two symbols makes a pair that ranks before the one just joined."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"abcd": 301, b"bcd": 400, b"ab": 500}
    bpe = byte_bpe.ByteBpe(ranks, r"\S+|\s+")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcdabcd", "bcdbcd", "aabcd", "abcabcdab"):
        assert bpe.encode_many([text])[0] == library.encode_ordinary(text)


def test_rank_queue():
    queue, held = byte_bpe.RankQueue(70_000), collections.defaultdict(list)
    source = random.Random(0)
    for _ in range(3000):
        if held and source.random() < 0.4:
            assert queue.first() == min(held)
            assert queue.take(min(held)) == sorted(held.pop(min(held)))
        else:
            rank, place = source.randrange(70_000), source.randrange(1000)
            queue.push(rank, place)
            held[rank].append(place)
    while held:
        assert queue.take(queue.first()) == sorted(held.pop(min(held)))
    assert queue.first() == -1


def test_round_trip_of_odd_rows(documents):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "word " * 4000)]
    found = byte_bpe.round_trip(documents(rows), RANKS, public_tokenizers.PATTERN).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, r.decoded_sha256) for r in found), key=repr) == sorted(((i, digest(t)) for i, t in rows), key=repr)
    assert {r.n_tokens for r in found if r.doc_id in (1, 2)} == {0}
    ids = byte_bpe.encoded(documents(rows), RANKS, public_tokenizers.PATTERN).where("doc_id = 3").first().ids
    assert hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() == [r for r in found if r.doc_id == 3][0].ids_sha256
    assert byte_bpe.round_trip(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_memory_forgets_what_is_not_in_use():
    memory = Remembered(3, 5)
    for words in (["a", "b"], ["a", "c", "d"], ["e", "f"], ["a", "toolong"], ["a", "b", "toolong"]):
        new = memory.missing(set(words))
        known = memory.add(new, [w.upper() for w in new])
        assert [known[w] for w in words] == [w.upper() for w in words]
        assert len(memory.young) <= 3 + len(words)


# Packing


def test_word_ids_are_those_of_the_library():
    tokens = packing.load(WORDS)
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    texts = odd_texts()
    for text, ids in zip(texts, tokens.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """Fewest sequences, by trying everything."""
    best = len(lengths)

    def go(place, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if place == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[place]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[place]
                go(place + 1, rest)
        go(place + 1, [*rooms, capacity - lengths[place]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_fixed_sets_belong_to_a_best_packing():
    source = random.Random(6)
    for _ in range(400):
        capacity = source.choice([10, 20, 37])
        lengths = [source.randint(1 + capacity // source.choice([2, 4, 8]), capacity) for _ in range(source.randint(1, 9))]
        counts = collections.Counter(lengths)
        fixed, left = packing.dominating(dict(counts), capacity)
        rest = list(itertools.chain.from_iterable([length] * n for length, n in left.items()))
        assert sum(times for _, times in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


def test_patterns_hold_every_document():
    source = random.Random(7)
    for _ in range(200):
        capacity = source.choice([10, 64, 100])
        counts = {source.randint(1, capacity): source.choice([1, 2, 7, 40]) for _ in range(source.randint(1, 40))}
        fixed, left = packing.dominating(counts, capacity)
        patterns = fixed + packing.best_fit(left, capacity)
        held = collections.Counter()
        for pattern, times in patterns:
            assert sum(length * n for length, n in pattern.items()) <= capacity
            for length, n in pattern.items():
                held[length] += n * times
        assert held == counts


def check_packing(found, rows, capacity):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    expected = collections.Counter()
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start:start + capacity], "<u4")
            expected[i, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
        assert sum(n for _, n in own) <= capacity
    return len(sequences)


def test_packing(documents):
    source = random.Random(8)
    rows = [(i, "word " * source.randrange(60)) for i in range(80)]
    rows += [(None, "no id"), (90, None), (91, ""), (5, rows[5][1]), (92, "a b c " * 200)]
    found = packing.pack(documents(rows), WORDS, 64).collect()
    used = check_packing(found, rows, 64)
    assert used <= 1.1 * sum(r.length for r in found) / 64 + 1
    assert packing.pack(documents([]), WORDS).count() == 0


# Vectors


def brute(vectors, queries, k):
    out = set()
    for name, vector in queries:
        near = {}
        for other, own in vectors:
            if other != name:
                near[other] = min(near.get(other, np.inf), float(np.sqrt(((np.array(own) - np.array(vector)) ** 2).sum())))
        for rank, (score, other) in enumerate(sorted((s, o) for o, s in near.items())[:k], 1):
            out.add((name, rank, other, score))
    return out


def test_neighbours_of_odd_vectors(spark):
    """All leaves are visited, so the result is exact; equal vectors are more than are asked for."""
    source = np.random.default_rng(0)
    good = [(i, source.normal(size=4).round(2).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]),
           (204, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (205, [])]
    frame = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in good + bad + good[:3]],
                                  "vec_id LONG, embedding ARRAY<DOUBLE>, rank INT, score DOUBLE, id INT")
    asked = frame.where("vec_id % 7 = 0 or vec_id > 199")
    found = nearest_neighbours(frame, asked, 5, trees=3, leaf=4, visits=10**6, block=7).collect()
    queries = [(i, v) for i, v in good if i % 7 == 0]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == brute(good, queries, 5)
    assert len(found) == 5 * len(queries)
    assert nearest_neighbours(frame.limit(0), asked.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = nearest_neighbours(frame, frame.where("vec_id % 100 = 0"), visits=30, leaf=40).collect()
    truth = {(q, o) for q, _, o, _ in brute(rows, [r for r in rows if r[0] % 100 == 0], 10)}
    assert len(truth & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(truth)


def test_one_queue_over_all_trees():
    """Leaves come in the order of the largest margin crossed on the way to them."""
    source = np.random.default_rng(1)
    forest = Forest(source.normal(size=(300, 8)), trees=3, leaf=10)
    vector = source.normal(size=8)

    def reached(node, crossed):
        if node < 0:
            return {-1 - node: crossed}
        margin = forest.planes[node] @ vector - forest.shifts[node]
        near = int(margin > 0)
        return reached(forest.links[node, near], crossed) | reached(forest.links[node, 1 - near], max(crossed, abs(margin)))

    margins = {}
    for root in forest.roots:
        margins |= reached(root, 0.0)
    order = forest.nearest_leaves(vector, forest.leaves)
    assert sorted(order) == list(range(forest.leaves))
    assert [margins[leaf] for leaf in order] == sorted(margins.values())
    assert set(forest.leaf_of(vector[None, :])[0]) == set(order[:3])


# Pipeline


def test_pipeline(spark, documents, tmp_path):
    source = random.Random(9)
    fresh = lambda n: " ".join("".join(source.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    clean = [fresh(80) for _ in range(8)]
    passage = fresh(60)
    near = clean[0].split(" ")
    near[40] = "changed"
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(20, clean[1]), (21, clean[2].replace(" ", "  ")), (22, " ".join(near)), (23, None), (24, "123 !!"),
             (30, f"{fresh(30)} {passage} {fresh(30)}"), (31, f"{fresh(30)} {passage} {fresh(30)}"), (32, "é" * 100), (33, "é" * 80 + "x")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i for i, _ in rows} - {20, 2, 22, 23, 24}
    assert {r.doc_id for r in found} == kept
    by_id = {r.doc_id: r for r in found}
    lengths = {i: len(Tokenizer.from_file(WORDS).encode(t or "").ids) + 1 for i, t in rows}
    assert by_id[31].length < 0.6 * lengths[31] and by_id[30].length == lengths[30]
    assert all(by_id[i].length == lengths[i] for i in range(8) if i != 2)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]


def test_every_stage_of_an_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
        assert "text" not in out.columns or out.columns == documents([]).columns


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_stages_return_the_columns_of_documents(spark, documents, stage):
    frame = documents([(1, "some text"), (None, "other text"), (2, None), (3, "")])
    out = stage(spark, frame, "unused")
    assert out.dtypes == frame.dtypes
    assert {r.doc_id for r in out.collect()} >= {1, None}
