"""Language by cross-parsing: the language whose text needs the fewest phrases to spell a document.

For each language a suffix automaton of a bounded sample of labelled text is built. A document is read from left to right;
as long as what has been read since the last cut occurs in the sample, the phrase goes on, else a new one begins. A phrase
costs the bits that point into its language's sample, log2 of that sample's length, as longer samples have longer matches; a
symbol that the sample doesn't have costs what a phrase of the longest sample does. Bits over the document's length rank
languages by cross entropy; the fewest win. The automata are completed to tables (state, symbol) -> (state, whether a phrase has ended), and many documents step through
them at once. Symbols are the UTF-8 bytes of lower-case letters; anything else is one separator. A document is read in blocks of ``BLOCK``
symbols, each beginning a new phrase, so a very long document is many short walks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import query, read
from .sampling import remainder
from .text import give_back, slices, worker_table

#: Symbols learnt from for each language, and the number of texts that they come in.
REFERENCE, DOCUMENTS = 40_000, 64
#: Characters to a piece of a text.
PIECE = REFERENCE // DOCUMENTS
#: Steps to a factor of two in which hashes are counted.
STEPS = 4
BLOCK = 2048
SLICE = 2 << 20
UNKNOWN = "und"


def reference_texts(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """A sample of about ``REFERENCE`` symbols of each language's labelled text, or all of it; ``learn`` is over ``__id``.

    All texts are cut into pieces of ``PIECE`` letters, other characters being one space. Of the distinct pieces those
    with the smallest hashes are taken, from wherever in the texts they are; short ones are joined.
    """
    letters = F.trim(F.regexp_replace(F.lower(F.col("__text")), r"\P{L}+", " "))
    pieces = (
        docs.select(
            F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"),
        ).where(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & learn)
        .select("__lang", F.explode(F.regexp_extract_all(letters, F.lit(f"(.{{1,{PIECE}}})"), F.lit(1))).alias("__piece"))
        .where(F.trim("__piece") != "")
        .withColumn("__hash", F.shiftrightunsigned(F.xxhash64("__piece"), 1))
        .withColumn("__step", F.floor(F.log2(F.col("__hash") + 1.0) * STEPS).cast("int"))
    )
    # Sizes are added up over steps of the hash, a few hundred for each language, so no language's pieces meet in one task.
    sizes = (
        pieces.groupBy("__lang", "__hash", "__step").agg(F.max(F.octet_length("__piece") + 1).alias("__size"))
        .groupBy("__lang", "__step").agg(F.sum("__size").alias("__size")).collect()
    )
    last: dict[str, int] = {}
    held: dict[str, int] = {}
    for row in sorted(sizes, key=lambda r: (r["__lang"], r["__step"])):
        if held.get(row["__lang"], 0) < REFERENCE:
            last[row["__lang"]] = row["__step"]
            held[row["__lang"]] = held.get(row["__lang"], 0) + row["__size"]
    if not last:
        return {}
    steps = docs.sparkSession.createDataFrame(list(last.items()), "__lang STRING, __last INT")
    picked = (
        pieces.join(F.broadcast(steps), "__lang").where(F.col("__step") <= F.col("__last"))
        .groupBy("__lang", "__hash").agg(F.min("__piece").alias("__piece")).collect()
    )
    texts: dict[str, list[str]] = {}
    held = {}
    for row in sorted(picked, key=lambda r: (r["__lang"], r["__hash"])):
        name, piece = row["__lang"], row["__piece"]
        if held.get(name, 0) < REFERENCE:
            own = texts.setdefault(name, [])
            if own and len(own[-1]) < PIECE:
                own[-1] += f" {piece}"
            else:
                own.append(piece)
            held[name] = held.get(name, 0) + len(piece.encode()) + 1
    return texts


def _lower_letters() -> np.ndarray:
    """Code point of every letter in lower case; of anything else, the space."""
    # Surrogates can't stand in a text.
    points = map(chr, range(0x110000))
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in points), np.uint32, 0x110000)


class Alphabet:
    """Symbols of a text: the bytes of its letters. Bytes that no sample has are one symbol, as none tells them apart."""

    def __init__(self, texts: list[str]) -> None:
        self.letters = _lower_letters()
        own = sorted({*b"".join(self._bytes(text) for text in texts)} - {32})
        #: One for the separator and one for the other bytes, and an even number, as tables need.
        self.size = (len(own) + 3) // 2 * 2
        self.table = np.full(256, self.size - 1, np.uint8)
        self.table[own] = np.arange(1, len(own) + 1)
        self.table[32] = 0

    def _bytes(self, text: str) -> bytes:
        """UTF-8 of lower-case letters, runs of separators taken once."""
        codes = self.letters[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        keep = codes != 32
        keep[1:] |= codes[:-1] != 32
        return codes[keep].astype("<u4").tobytes().decode("utf-32-le").encode()

    def symbols(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(self._bytes(text), np.uint8)]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of a text; state 0 is the empty string."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves


class CrossParser:
    """Phrase counts of texts against each language's sample."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        self.alphabet = Alphabet([text for own in texts.values() for text in own])
        tables, sizes, self.starts, begin = [], [], [], 0
        width = self.alphabet.size
        self.unseen = np.ones((width, len(self.languages)), np.int64)
        for language in self.languages:
            sample = np.concatenate([self.alphabet.symbols(f" {text}") for text in texts[language]])[:REFERENCE].tolist()
            moves = suffix_automaton(sample)
            self.unseen[list(moves[0]), len(tables)] = 0
            sizes.append(len(sample))
            # One more state follows a symbol that the sample doesn't have: a phrase by itself.
            alone = (begin + len(moves)) * width
            table = np.empty((len(moves) + 1, width), np.int32)
            # Where nothing goes on, a phrase has ended (lowest bit) and the symbol begins the next one.
            table[:] = alone + 1
            table[0] = alone
            for symbol, state in moves[0].items():
                table[:, symbol] = (begin + state) * width + 1
            for state, own in enumerate(moves):
                for symbol, target in own.items():
                    table[state, symbol] = (begin + target) * width
            tables.append(table)
            self.starts.append(begin * width)
            begin += len(moves) + 1
        self.table = np.concatenate(tables).ravel()
        #: Bits of a phrase in each language.
        self.bits = np.log2(1 + np.array(sizes))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (symbols) in each language."""
        blocks, owners = [], []
        for owner, text in enumerate(texts):
            for at in range(0, len(text), BLOCK):
                blocks.append(text[at:at + BLOCK])
                owners.append(owner)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if not blocks:
            return counts
        sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
        order = np.argsort(-sizes, kind="stable")
        # One row for each step, one column for each block, longest first.
        grid = np.zeros((sizes.max(), len(blocks)), np.int32)
        for column, block in enumerate(order.tolist()):
            grid[:sizes[block], column] = blocks[block]
        active = np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left").tolist()
        states = np.repeat(np.array(self.starts, np.int32)[:, None], len(blocks), axis=1)
        ended = np.ones(states.shape, np.int32)
        for step, width in enumerate(active):
            moved = self.table[states[:, :width] + grid[step, :width]]
            ended[:, :width] += moved & 1
            states[:, :width] = moved & ~np.int32(1)
        np.add.at(counts, np.array(owners)[order], ended.T)
        return counts

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits of each text (symbols) in each language; the same where no language has any letter of the text."""
        width = self.alphabet.size
        letters = np.array([np.bincount(text, minlength=width) for text in texts], np.int64).reshape(-1, width)
        unseen = letters @ self.unseen
        known = letters[:, 1:] @ (1 - self.unseen[1:])
        bits = (self.phrases(texts) - unseen) * self.bits + unseen * self.bits.max()
        # Separators alone tell nothing.
        bits[~known.any(axis=1)] = self.bits.max()
        return bits


def languages(
    docs: DataFrame, texts: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, lang_pred and ``score`` (0 to 1: by how much the best needs fewer bits than the next) of every row.

    ``texts`` holds the sample of each language. Null text, text without a letter, and any text where no language was
    learnt are ``und`` with score 0. Ties go to the first name. Rows that repeat give repeated rows. ``keep`` names
    columns to carry along; they come first, as they are.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(texts)
    number = hash(tuple((name, *own) for name, own in sorted(texts.items())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sent.value
        parser = worker_table(("languages", number), lambda: CrossParser(texts)) if texts else None
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if parser:
                    symbols = [parser.alphabet.symbols(t or "") for t in part.column(1).to_pylist()]
                    costs = parser.costs(symbols)
                    ranked = np.sort(costs, axis=1)
                    best = np.argmin(costs, axis=1)
                    for row, own in enumerate(symbols):
                        if own.any():
                            names[row] = parser.languages[best[row]]
                            scores[row] = 1 - ranked[row, 0] / ranked[row, 1] if ranked.shape[1] > 1 else 1.0
                yield pa.record_batch(
                    [part.column(0), *[part.column(at) for at in places], pa.array(names, pa.string()), pa.array(scores)],
                    names=out_names,
                )
        give_back()

    kept = [f"__keep_{place}" for place in range(len(keep))]
    # Where the text is kept, it does not go to the workers twice.
    held = dict(docs.dtypes).get(text_col) == "string"
    own = [(new, name) for new, name in zip(kept, keep) if not (held and name == text_col)]
    rows = docs.select(
        F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"),
        *[F.col(name).alias(new) for new, name in own],
    )
    places = [1 if held and name == text_col else rows.columns.index(new) for new, name in zip(kept, keep)]
    out_names = ["doc_id", *kept, "lang_pred", "score"]
    types = dict(rows.dtypes) | {new: "string" for new, place in zip(kept, places) if place == 1}
    schema = ", ".join(["doc_id long", *[f"{name} {types[name]}" for name in kept], "lang_pred string", "score double"])
    return rows.mapInArrow(work, schema)


@query()
def op7_language(spark, folder):
    """Language of every document, learnt from labelled ones outside the held-out quarter."""
    docs = read(spark, folder, "documents")
    texts = reference_texts(docs, remainder("__id", 4) != 2, "doc_id", "text", "lang")
    return languages(docs, texts).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score",
    )
