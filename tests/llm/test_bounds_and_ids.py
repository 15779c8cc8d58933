"""Ids that repeat or are extreme, bounds of samples, numbers out of range, and scores done again slowly."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import components, edited, removed, sentence, shingles
from test_models import words

import corpus_pipeline
from tallysketch.llm import language, language_model, minhash, quality, toxicity
from tallysketch.llm.neighbours import distances, nearest_neighbours
from tallysketch.llm.sampling import labelled_sample
from tallysketch.llm.suffix_dedup import remove_repeats
from tallysketch.llm.text import word_hashes

# Near copies with ids that repeat


def near_by_brute_force(rows, percent):
    """Rows are nodes; those that share an id, or a similar text, are linked."""
    sets = dict(enumerate(shingles(t) for _, t in rows))
    root = components({n: s for n, s in sets.items() if rows[n][0] is not None}, percent)
    changed = True
    while changed:
        changed = False
        for n in root:
            for m in root:
                if rows[n][0] == rows[m][0] and sets[n] and sets[m] and root[n] != root[m]:
                    low, high = sorted((root[n], root[m]))
                    root = {k: low if r == high else r for k, r in root.items()}
                    changed = True
    least = {r: min(rows[n][0] for n in root if root[n] == r) for r in set(root.values())}
    return sorted(((i, len(sets[n]), least.get(root.get(n))) for n, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block, few", [(1024, 1_000_000), (3, 0)])
def test_two_texts_of_one_id_keep_all_links(documents, monkeypatch, block, few):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FEW", few)
    rows = []
    for i in range(15):
        for part in "ab":
            text = sentence((part, i), 120)
            rows += [(i, text), (100 + 2 * i + (part == "b"), edited(text, (part, i), 2))]
    rows += [(3, ""), (3, None), (7, rows[0][1]), (None, rows[0][1]), (40, sentence("alone", 90))]
    found = minhash.near_duplicates(documents(rows), 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == near_by_brute_force(rows, 80)
    assert {r.component_id for r in found if r.doc_id in (130, 40)} == {40} | {r.component_id for r in found if r.doc_id == 130}
    assert all(r.component_id == r.doc_id % 100 // 2 if 100 <= r.doc_id < 130 and r.doc_id // 2 % 50 not in (0, 7) else True
               for r in found if r.doc_id is not None)


def test_the_stage_drops_rows_not_ids(spark, documents):
    text = sentence("near", 150)
    rows = [(3, text), (5, edited(text, 1, 2)), (5, sentence("other", 100)), (5, ""), (5, None), (None, edited(text, 2, 2)),
            (None, sentence("third", 80)), (2 ** 63 - 1, edited(text, 3, 2))]
    frame = documents(rows)
    kept = corpus_pipeline.drop_near_copies(spark, frame, "unused")
    assert kept.dtypes == frame.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((rows[n] for n in (0, 2, 3, 4, 6)), key=repr)


# Passages of the largest ids


def test_the_largest_ids_lose_their_repeats(documents):
    passage = sentence("passage", 30)
    last = 2 ** 63 - 1
    rows = [(1, passage), (last, f"x {passage} y"), (last - 1, f"z {passage} w"), (-last - 1, "short")]
    found = remove_repeats(documents(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == removed(rows)
    with_null = {r.doc_id: r.n_removed for r in remove_repeats(documents([(last, passage), (None, passage), (2, "a")])).collect()}
    assert with_null == {last: 0, None: 0, 2: 0}  # a null id is the largest


# Samples


def test_the_sample_bounds_rows_and_bytes(spark, documents):
    rows = [(1, f"text {n} " * 50) for n in range(500)] + [(2, "b" * 1000), (3, "c" * 1000), (4, None)]
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 5)], "doc_id LONG, toxic INT")
    bounded = labelled_sample(documents(rows), labels, "toxic", F.lit(True), {0: 7, 1: 2}).collect()
    assert collections.Counter(r.label for r in bounded) == {0: 7, 1: 2}
    small = labelled_sample(documents(rows), labels, "toxic", F.lit(True), {0: 400, 1: 400}, size=2000).collect()
    for label in (0, 1):
        sizes = [len(r.text or "") for r in small if r.label == label]
        assert sizes and sum(sizes) - max(sizes) < 2000
    again = labelled_sample(documents(rows[::-1]), labels, "toxic", F.lit(True), {0: 7, 1: 2}).collect()
    assert sorted(map(tuple, bounded), key=repr) == sorted(map(tuple, again), key=repr)


# Vectors out of range


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")


@pytest.mark.parametrize("scale", [1e160, 1e-170, 1.0])
def test_vectors_of_any_size_have_neighbours(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(120)]
    table = vectors_of(spark, rows)
    found = nearest_neighbours(table, table.where("vec_id % 30 = 0"), 3).collect()
    truth = []
    for i, v in rows[::30]:
        near = sorted((math.dist([x / scale for x in v], [x / scale for x in w]), j) for j, w in rows if j != i)[:3]
        truth += [(i, rank, j) for rank, (_, j) in enumerate(near, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == truth
    assert all(math.isfinite(r.score) and r.score > 0 for r in found)


def test_mixed_sizes_and_lengths(spark):
    rows = [(1, [1e160, 0.0]), (2, [1e160, 1e150]), (3, [1.0, 2.0]), (4, [1.0, 2.5]), (5, [1.0]), (6, [1.0, 2.0, 3.0])]
    table = vectors_of(spark, rows)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_neighbours(table, table, 1).collect()}
    assert found == {(1, 1): (2, 1e150), (2, 1): (1, 1e150), (3, 1): (4, 0.5), (4, 1): (3, 0.5)}
    assert distances(np.array([[3e-200, 4e-200]]), np.zeros(2))[0] == pytest.approx(5e-200)


# Words made to have one hash


def test_long_words_made_to_collide_differ():
    word = b"a"
    while len(word) < 2048:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + other, np.uint8)
    hashes = word_hashes(data, np.array([0, len(word)]), np.array([len(word), len(data)]))
    assert hashes[0] != hashes[1]


# Scores done again


def test_bigram_scores_are_those_of_the_weights(documents, monkeypatch):
    held = []
    learn_weights = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda *args: held.append(learn_weights(*args)) or held[-1])
    source = random.Random(2)
    rows = [(i, " ".join(source.choice(["a", "b", "c", "dd", "e"][:1 + i % 5]) for _ in range(source.randrange(12)))) for i in range(90)]
    rows += [(200, "zzz a"), (201, None), (202, "never seen words")]
    learn, out = (F.col("doc_id") < 80), F.col("doc_id") % 4 == 0
    found = {r.doc_id: r.score for r in language_model.score_texts(documents(rows), learn, out).collect()}
    token, pair = collections.Counter(), collections.Counter()
    for i, text in rows:
        if i < 80:
            own = words(text)
            token.update(own)
            pair.update(zip([None, *own[:-1]], own))
    n, v = sum(token.values()), len(token)
    weights = language_model.for_scoring(held[0], n)

    def chance(context, word):
        seen = token[context]
        bucket = int(language_model._context_bucket(np.array([seen]))[0])
        p, t, u = weights[bucket]
        return p * pair[context, word] / max(seen, 1) + t * token[word] / n + u / (v + 1)

    for i, text in rows:
        own = words(text)
        score = sum(math.log10(chance(c, w)) for c, w in zip([None, *own[:-1]], own))
        assert abs(score - found[i]) < 1e-9
    for context in [*token, "never seen"]:  # all known tokens, and one for the unknown
        assert abs(sum(chance(context, w) for w in [*token, "unknown"]) - 1) < 1e-9


def test_languages_by_phrases_counted_slowly(documents):
    source = random.Random(6)
    speak = lambda letters, n: " ".join("".join(source.choice(letters) for _ in range(4)) for _ in range(n))
    texts = {"one": [speak("abcde", 80)], "two": [speak("cdefg", 60)], "три": [speak("абвгд", 70)]}
    rows = [(i, speak(source.choice(["abcde", "cdefg", "абвгд", "xyz", "abxy"]), source.randrange(1, 30))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "123"), (103, "é")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(documents(rows), texts).collect()}
    parser = language.CrossParser(texts)
    samples = {name: bytes(np.concatenate([parser.alphabet.symbols(f" {t}") for t in own])[:language.REFERENCE]) for name, own in texts.items()}
    for i, text in rows:
        own = bytes(parser.alphabet.symbols(text or ""))
        if not any(own):
            assert found[i] == ("und", 0)
            continue
        costs = []
        for name in sorted(samples):
            sample, bits, most = samples[name], math.log2(1 + len(samples[name])), math.log2(1 + max(map(len, samples.values())))
            cost, at = 0.0, 0
            while at < len(own):
                block_end = (at // language.BLOCK + 1) * language.BLOCK
                end = at + 1
                while end < min(len(own), block_end) and own[at:end + 1] in sample:
                    end += 1
                cost += most if own[at:at + 1] not in sample else bits
                at = end
            costs.append(cost)
        if not any(any(own[k:k + 1] in s for s in samples.values()) for k in range(len(own)) if own[k]):
            assert found[i] == (sorted(samples)[0], 0)
            continue
        best = min(range(3), key=lambda c: costs[c])
        first, second = sorted(costs)[:2]
        assert found[i][0] == sorted(samples)[best] and abs(found[i][1] - (1 - first / second)) < 1e-9


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_are_dot_products_of_the_model(spark, documents, module, label):
    """Scores recomputed text by text, with plain dictionaries of features, from the fitted weights."""
    source = random.Random(4)
    docs = [(i, " ".join(source.choice(["Good", "bad", "x1", "y-z", "wörter", "horrid"]) for _ in range(20))) for i in range(60)]
    labels = spark.createDataFrame([(i, int("horrid" in t), int("Good" in t)) for i, t in docs], "doc_id LONG, toxic INT, quality INT")
    weights, bias = module.fit(labelled_sample(documents(docs), labels, label, F.lit(True), module.MOST))
    odd = docs + [(100, ""), (101, None), (102, "horrid"), (103, " \t")]
    score = module.toxicity if module is toxicity else module.quality
    found = {r.doc_id: r.score for r in score(documents(odd), (weights, bias)).collect()}
    for i, text in odd:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if module is toxicity:
            slots = set(toxicity.ngram_slots(raw).tolist())
            z = sum(float(weights[s]) for s in slots) / math.sqrt(100 + len(slots))
        else:
            (slots, values), = quality._vectors(np.array([0, len(raw)]), raw)
            z = sum(float(weights[s]) * x for s, x in zip(slots.tolist(), values.tolist()))
            assert not len(values) or abs(sum(x * x for x in values.tolist()) - 1) < 1e-9
        assert abs(found[i] - 1 / (1 + math.exp(-z - bias))) < 1e-6
