"""Classifiers, language identification and the language model on small made-up text and on the given tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysketch.llm import language, language_model, quality, toxicity
from tallysketch.llm.sampling import labelled_sample, remainder

ODD = [(None, None), (None, "text"), (1, None), (2, ""), (3, " \n "), (4, "word"), (4, "word"), (5, "é" * 9000), (6, "漢字 😀")]


def labelled(spark, n=120):
    source = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [source.choice(words) for _ in range(40)]
        if bad:
            text[source.randrange(40)] = "horrid"
            text[source.randrange(40)] = "vile"
        docs.append((1000 + i, " ".join(text)))
        labels.append((1000 + i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (1000, None, None), (99999, 0, 1)]
    return docs, spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")


@pytest.mark.parametrize("module, label, score", [
    (toxicity, "toxic", toxicity.toxicity), (quality, "quality", quality.quality),
])
def test_classifiers(spark, documents, module, label, score):
    docs, labels = labelled(spark)
    frame = documents(docs + ODD)
    held_out = remainder("__id", 3) == 1
    model = module.fit(labelled_sample(frame, labels, label, ~held_out, module.MOST))
    found = score(frame, model).collect()
    assert len(found) == len(docs) + len(ODD)
    assert all(0 <= r.score <= 1 for r in found)
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    unseen = [(r.score, truth[r.doc_id]) for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    high = [s for s, y in unseen if y == 1]
    low = [s for s, y in unseen if y == 0]
    assert np.mean([a > b for a in high for b in low]) > 0.95
    # Every row of one text has one score.
    assert len({r.score for r in found if r.doc_id == 4}) == 1


@pytest.mark.parametrize("module, score", [(toxicity, toxicity.toxicity), (quality, quality.quality)])
def test_classifiers_without_labels(spark, documents, module, score):
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    model = module.fit(labelled_sample(documents(ODD), none, "toxic", F.lit(True), module.MOST))
    assert {r.score for r in score(documents(ODD), model).collect()} == {0.5}
    assert score(documents([]), model).count() == 0


def test_sample_is_bounded_and_fixed(spark, documents):
    docs, labels = labelled(spark)
    rows = [labelled_sample(documents(docs), labels, "toxic", F.lit(True), {0: 7, 1: 5}).collect() for _ in range(2)]
    assert collections.Counter(r.label for r in rows[0]) == {0: 7, 1: 5}
    assert sorted(rows[0]) == sorted(rows[1])


def test_ngram_slots_see_every_byte():
    text = np.frombuffer(b"a" * 5000 + b"Zebra", np.uint8)
    other = np.frombuffer(b"a" * 5000 + b"zebra", np.uint8)
    assert toxicity.ngram_slots(text).tolist() == toxicity.ngram_slots(other).tolist()
    assert set(toxicity.ngram_slots(text)) - set(toxicity.ngram_slots(text[:-1]))
    assert not len(toxicity.ngram_slots(text[:0]))


# Language


def phrases(text, sample):
    """Longest matches, found by searching the sample."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        count += 1
    return count


def test_phrases_are_longest_matches():
    source = random.Random(1)
    samples = {name: ["".join(source.choice(letters + " ") for _ in range(300))]
               for name, letters in (("one", "abcde"), ("two", "defgh"))}
    parser = language.CrossParser(samples)
    texts = ["".join(source.choice("abcdefghz ") for _ in range(n)) for n in (0, 1, 7, 200, 1500)]
    symbols = [parser.alphabet.symbols(t) for t in texts]
    counts = parser.phrases(symbols)
    for place, name in enumerate(parser.languages):
        sample = parser.alphabet.symbols(" " + samples[name][0]).tobytes()
        assert counts[:, place].tolist() == [phrases(s.tobytes(), sample) for s in symbols]


def test_long_texts_are_read_in_blocks():
    parser = language.CrossParser({"one": ["abcab"], "two": ["xyzzy"]})
    text = parser.alphabet.symbols("ab" * (2 * language.BLOCK))
    assert parser.phrases([text])[0, 1] == 4 * language.BLOCK
    assert parser.phrases([text])[0, 0] == 4 * parser.phrases([text[:language.BLOCK]])[0, 0]


def test_languages_of_the_given_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = language.reference_texts(docs, remainder("__id", 4) != 2, "doc_id", "text", "lang")
    assert {len(t) <= language.DOCUMENTS for t in texts.values()} == {True}
    found = language.languages(docs, texts, keep=("lang",))
    held_out = found.where(remainder("doc_id", 4) == 2).collect()
    assert np.mean([r.lang_pred == r["__keep_0"] for r in held_out]) >= 0.95


def test_languages_of_odd_texts(spark, documents):
    texts = {"b": ["hello world this is text"], "a": ["hello world this is text"], "c": ["zzz"]}
    found = [(r.doc_id, r.lang_pred) for r in language.languages(documents(ODD), texts).collect()]
    got = sorted(found, key=repr)
    assert got == sorted([(None, "und"), (None, "a"), (1, "und"), (2, "und"), (3, "und"), (4, "a"), (4, "a"), (5, "a"),
                          (6, "a")], key=repr)
    assert {r.lang_pred for r in language.languages(documents(ODD), {}).collect()} == {"und"}
    assert language.languages(documents([]), texts).count() == 0
    nothing = language.reference_texts(documents([]), F.lit(True), "doc_id", "text", "lang")
    assert nothing == {}


def test_a_language_with_little_labelled_text(spark, documents):
    """A twentieth of the others' text, and words that share their stems with a large language."""
    source = random.Random(1)
    word = lambda: "".join(source.choice("abdeiklmnorstu") for _ in range(source.randrange(3, 8)))
    _, *own = ([word() for _ in range(2000)] for _ in range(4))
    known = dict(zip(("large", "other", "rare"), own))
    known["rare"] = [a if source.random() < 0.85 else b for a, b in zip(known["large"], known["rare"])]

    def text(name, n):
        return " ".join(known[name][(int(source.paretovariate(0.6)) - 1) % 2000] for _ in range(n))

    texts = {name: [text(name, n)] for name, n in (("large", 8000), ("other", 8000), ("rare", 350))} | {"tiny": ["deter"]}
    rows = [(1000 * place + i, text(name, 60)) for place, name in enumerate(known) for i in range(40)]
    names = {r.doc_id: r.lang_pred for r in language.languages(documents(rows), texts).collect()}
    right = [[names[1000 * place + i] == name for i in range(40)] for place, name in enumerate(known)]
    assert np.mean(right, axis=1).min() >= 0.9


def test_scripts_with_thousands_of_letters(spark, documents):
    source = random.Random(12)
    letters = {"ja": range(0x4E00, 0x5400), "ko": range(0xAC00, 0xB200), "ru": range(0x430, 0x450), "zh": range(0x5300, 0x5900)}

    def text(name, n):
        return "".join(chr(source.choice(letters[name])) for _ in range(n))

    texts = {name: [text(name, 8000)] for name in letters}
    rows = [(1000 * place + i, text(name, 40)) for place, name in enumerate(letters) for i in range(40)]
    names = {r.doc_id: r.lang_pred for r in language.languages(documents(rows), texts).collect()}
    assert np.mean([names[i] == list(letters)[i // 1000] for i, _ in rows]) >= 0.95


def test_the_sample_is_taken_from_all_of_the_text(spark):
    """Shared beginnings, copies and texts without a letter don't take the place of other text; a few long texts fill it."""
    source = random.Random(13)
    fresh = lambda n: " ".join("".join(source.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menu = " ".join("".join(source.choice("stuvwxyz") for _ in range(6)) for _ in range(300))
    rows = [(i, f"{menu} {fresh(400)}", "menu") for i in range(80)]
    rows += [(1000 + i, "menu menu", "copies") for i in range(2000)] + [(5000 + i, "123 !!", "copies") for i in range(2000)]
    rows += [(9000 + i, fresh(100), "copies") for i in range(100)]
    rows += [(20000 + i, fresh(10000), "few") for i in range(3)] + [(30000, "no letters follow", None), (30001, "12", "none")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(4)
    texts = language.reference_texts(docs, F.lit(True), "doc_id", "text", "lang")
    assert sorted(texts) == ["copies", "few", "menu"]
    assert texts == language.reference_texts(docs.repartition(3), F.lit(True), "doc_id", "text", "lang")
    sizes = {name: sum(len(t) + 1 for t in own) for name, own in texts.items()}
    assert all(0.95 * language.REFERENCE <= sizes[name] <= 1.05 * language.REFERENCE for name in ("few", "menu"))
    assert sizes["copies"] >= 0.95 * language.REFERENCE and " ".join(texts["copies"]).count("menu menu") <= 1
    assert sum(c in "stuvwxyz" for t in texts["menu"] for c in t) < 0.3 * sizes["menu"]


# Language model


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def test_language_model(documents):
    source = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(source.choice(vocabulary[:1 + i % 29]) for _ in range(source.randrange(40)))) for i in range(150)]
    rows += ODD + [(500, "unseen words only"), (7, "W1\tw1")]
    learn, held = F.col("doc_id") % 10 != 0, F.col("doc_id") % 10 == 1
    learn = F.coalesce(learn, F.lit(True))
    found = language_model.score_texts(documents(rows), learn, F.coalesce(held, F.lit(False))).collect()
    assert len(found) == len(rows)
    counts = collections.Counter(w for i, t in rows if i is None or i % 10 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, text in rows:
        own = words(text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        expected.append((i, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert all(r.score < 0 for r in found)


def test_the_model_is_a_distribution(documents):
    """After any context, the chances of all tokens and of an unknown one add up to 1."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c b", "a b"] * 5, 1)]
    everything = rows + [(100 + k, f"a {w}") for k, w in enumerate("abc")] + [(103, "a"), (104, "a zzz")]
    learn, held = F.col("doc_id") < 100, F.col("doc_id") % 5 == 0
    found = {r.doc_id: r.score for r in language_model.score_texts(documents(everything), learn, held).collect()}
    ends = {w: found[i] for i, w in ((100, "a"), (101, "b"), (102, "c"), (104, "zzz"))}
    # P(a | start) P(end | a) is known, and so P(w | a) P(end | w) of the others up to P(end | w).
    assert all(s < found[103] for s in ends.values())


def test_rows_without_an_id_are_spread_over_blocks(documents, monkeypatch):
    entries = language_model._entries

    def watched(layout):
        work = entries(layout)

        def few(table):
            assert table.num_rows <= 40
            return work(table)

        return few

    monkeypatch.setattr(language_model, "_entries", watched)
    monkeypatch.setattr(language_model, "BLOCK", 300)
    rows = [(i, f"text number {n} of {n % 7}") for n in range(100) for i in (None, 3)]
    found = language_model.score_texts(documents(rows), F.lit(True), F.lit(False)).collect()
    assert collections.Counter(r.doc_id for r in found) == {None: 100, 3: 100}
    assert {r.train_tokens for r in found} == {sum(len(words(t)) for _, t in rows)}


def test_language_model_of_nothing(documents):
    nothing = language_model.score_texts(documents([]), F.lit(True), F.lit(False))
    assert nothing.count() == 0
    unlearnt = language_model.score_texts(documents([(1, "a b")]), F.lit(False), F.lit(False)).first()
    assert (unlearnt.n_tokens, unlearnt.n_known, unlearnt.train_tokens) == (3, 0, 0)
    assert unlearnt.base_score == 0 and unlearnt.score < 0


def test_weights_follow_the_held_out_counts():
    pair, uniform = 1, 0
    cell = lambda bucket, a, b: (bucket * (language_model.DEEPEST + 1) + a) * (language_model.DEEPEST + 1) + b
    cells = np.array([cell(5, pair, 40), cell(1, uniform, 40)])
    weights = language_model.learn_weights(cells, np.array([1000.0, 1000.0]), 100)
    assert weights.shape == (language_model.CONTEXTS, 3) and np.allclose(weights.sum(axis=1), 1)
    assert weights[5, 0] > 0.9 > 0.1 > weights[1, 0]
    assert np.allclose(language_model.learn_weights(np.array([], np.int64), np.array([]), 0), 1 / 3)
