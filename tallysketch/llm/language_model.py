"""Scores of texts under a bigram model by deleted interpolation.

P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1), with weights by how frequent the context v is (buckets by
powers of two). The weights are learnt by expectation-maximisation on held-out counts: each document of a tenth of the
training documents is predicted from the totals with its own counts deleted.

Documents are dealt into blocks. A block's distinct tokens and token pairs (sorted hashes with training counts) go to
buckets by hash range as packed arrays; a bucket adds up the blocks' counts and sends each block the totals of its own
entries, in the block's order. So a word that stands in every document is one entry of each block, and texts meet their
totals by block. Counts cover all training documents; only the weights, a few dozen numbers, and a histogram with a
fixed number of cells pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read
from .sampling import remainder
from .text import flat, mixed, packed, slices, unpacked, word_bounds, word_hashes

#: Bytes of text to a block, and to a bucket of tokens or of pairs.
BLOCK, TOKEN_BUCKET, PAIR_BUCKET = 6 << 20, 64 << 20, 8 << 20
SLICE = 2 << 20
#: The end of a text as a token; it is also the context of the first token.
END = np.uint64(0x9D8A7B3C5E1F2461)
#: Bits of a pair's hash. 48 tell all but one in 50,000 pairs apart among five billion different ones.
PAIR_BITS = 48
#: Context buckets: 0 for contexts that were never seen, then powers of two.
CONTEXTS = 48
#: Steps of the learning histogram to a factor of two, and its largest step.
STEPS, DEEPEST = 4, 200
ROUNDS = 200


# Tokens of a block


class Block:
    """Tokens of a block's texts: each text's words and then its end."""

    def __init__(self, table: pa.Table, text: str, learn: str) -> None:
        hashes, sizes = [], []
        place = table.schema.get_field_index(text)
        for batch in table.to_batches():
            for part in slices(batch, place, SLICE):
                offsets, data = flat(part.column(place))
                starts, ends, owner = word_bounds(offsets, data)
                number = np.bincount(owner, minlength=part.num_rows)
                own = np.full(len(starts) + part.num_rows, END)
                if len(starts):
                    own[np.arange(len(starts)) + owner] = word_hashes(data, starts, ends)
                hashes.append(own)
                sizes.append(number + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        self.tokens = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.roll(self.tokens, 1)
        before[self.begins] = END
        pairs = mixed(before * np.uint64(0x9E3779B97F4A7C15) + self.tokens) >> np.uint64(64 - PAIR_BITS)
        self.learnt = np.repeat(table[learn].to_numpy(), self.sizes) if len(self.sizes) else np.empty(0, bool)
        # The end comes with every block, so that the first context has an entry.
        self.words, self.word = np.unique(np.append(self.tokens, END), return_inverse=True)
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        end = self.word[-1]
        self.word = self.word[:-1]
        self.context = np.roll(self.word, 1)
        self.context[self.begins] = end

    def training_counts(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.bincount(self.word[self.learnt], minlength=len(self.words)),
                np.bincount(self.pair[self.learnt], minlength=len(self.pairs)))


def _ranges(keys: np.ndarray, bits: int, buckets: int) -> list[int]:
    """Where each bucket begins among sorted keys, and the end."""
    edges = [-(-(number << bits) // buckets) for number in range(1, buckets)]
    return [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]


def _planes(values: np.ndarray) -> bytes:
    return packed(values, "<u8")


def _numbers(raw: bytes) -> np.ndarray:
    return unpacked(raw, "<u8")


class Layout:
    """How many buckets tokens and pairs have; pairs come after tokens."""

    def __init__(self, size: int) -> None:
        self.tokens = int(1 + size // TOKEN_BUCKET)
        self.pairs = int(1 + size // PAIR_BUCKET)

    def cuts(self, block: Block) -> Iterator[tuple[int, int, int, bool]]:
        """Bucket, begin, end and whether of pairs, for all entries of a block in order."""
        for keys, bits, first, number, paired in (
            (block.words, 64, 0, self.tokens, False), (block.pairs, PAIR_BITS, self.tokens, self.pairs, True)
        ):
            edges = _ranges(keys, bits, number)
            for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:]), first):
                if a < b:
                    yield bucket, a, b, paired


def _entries(layout: Layout) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        block = Block(table, "text", "learn")
        counts = block.training_counts()
        rows = []
        for bucket, a, b, paired in layout.cuts(block):
            keys = (block.pairs if paired else block.words)[a:b]
            rows.append((bucket, _planes(np.diff(keys, prepend=np.uint64(0))), _planes(counts[paired][a:b])))
        buckets, keys, numbers = zip(*rows)
        return pa.table({
            "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int64()), "bucket": pa.array(buckets, pa.int64()),
            "keys": pa.array(keys, pa.binary()), "counts": pa.array(numbers, pa.binary()),
        })

    return work


def _totals(layout: Layout) -> Callable[[pa.Table], pa.Table]:
    """Add up a bucket: for each block the totals of its entries; in block -1, all training tokens and distinct ones."""

    def work(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        blocks = table["block"].to_pylist()
        keys = [np.cumsum(_numbers(raw)) for raw in table["keys"].to_pylist()]
        counts = np.concatenate([_numbers(raw) for raw in table["counts"].to_pylist()])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        # Exact up to 2^53 training tokens.
        totals = np.bincount(place, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys]).tolist()
        own = [_planes(totals[place[a:b]]) for a, b in zip([0, *ends], ends)]
        tokens = bucket < layout.tokens
        return pa.table({
            "block": pa.array([*blocks, -1], pa.int64()), "bucket": pa.array([bucket] * (len(blocks) + 1), pa.int64()),
            "totals": pa.array([*own, None], pa.binary()),
            "n": pa.array([*[0] * len(blocks), int(totals.sum()) if tokens else 0], pa.int64()),
            "v": pa.array([*[0] * len(blocks), int((totals > 0).sum()) if tokens else 0], pa.int64()),
        })

    return work


def _assembled(layout: Layout, block: Block, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Totals of all entries of a block, from the rows its buckets sent."""
    raw = dict(zip(found["bucket"].to_pylist(), found["totals"].to_pylist()))
    words, pairs = np.zeros(len(block.words), np.int64), np.zeros(len(block.pairs), np.int64)
    for bucket, a, b, paired in layout.cuts(block):
        (pairs if paired else words)[a:b] = _numbers(raw[bucket])
    return words, pairs


# Weights


def _context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], CONTEXTS - 1)


def _step(share: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 + the share's size in steps below 1."""
    with np.errstate(divide="ignore"):
        steps = np.round(-np.log2(share) * STEPS) + 1
    return np.where(share > 0, np.minimum(steps, DEEPEST), 0).astype(np.int64)


def _held_out_cells(layout: Layout, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        cells, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if texts.num_rows:
            block = Block(texts, "text", "learn")
            words, pairs = _assembled(layout, block, found)
            own_word = _own_counts(block.owner, block.word, len(words))
            own_pair = _own_counts(block.owner, block.pair, len(pairs))
            # A context occurs in a text as often as the token does, the end as first context once.
            first = np.zeros(len(block.word), bool)
            first[block.begins] = True
            previous = np.roll(own_word, 1)
            previous[first] = 1
            word, pair = words[block.word] - own_word, pairs[block.pair] - own_pair
            context = words[block.context] - previous
            left = np.maximum(n - block.sizes[block.owner], 1)
            cell = (_context_bucket(context) * (DEEPEST + 1) + _step(pair / np.maximum(context, 1))) * (DEEPEST + 1)
            cells, counts = np.unique(cell + _step(word / left), return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "tokens": pa.array(counts, pa.int64())})

    return work


def _own_counts(owner: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """For each token how often its entry stands in its own text."""
    _, place, counts = np.unique(owner * entries + entry, return_inverse=True, return_counts=True)
    return counts[place]


def learn_weights(cells: np.ndarray, tokens: np.ndarray, v: int) -> np.ndarray:
    """Weights (pair, token, uniform) of each context bucket by expectation-maximisation over the held-out histogram.

    A bucket starts from the weights of all buckets together, and those count as ten tokens in it, which also serves
    buckets without any. No weight falls below 1 in 10,000.
    """
    steps = np.stack([cells // (DEEPEST + 1) % (DEEPEST + 1), cells % (DEEPEST + 1)], axis=1)
    shares = np.where(steps > 0, 2.0 ** (-(steps - 1) / STEPS), 0.0)
    parts = np.column_stack([shares, np.full(len(cells), 1 / (v + 1))])
    bucket = cells // (DEEPEST + 1) ** 2

    def expectation(start: np.ndarray, own: np.ndarray, prior: np.ndarray) -> np.ndarray:
        weights = start
        for _ in range(ROUNDS):
            mixed_parts = parts[own] * weights
            mixed_parts /= mixed_parts.sum(axis=1, keepdims=True)
            weights = (mixed_parts * tokens[own][:, None]).sum(axis=0) + prior
            weights = np.maximum(weights / weights.sum(), 1e-4)
            weights /= weights.sum()
        return weights

    third = np.full(3, 1 / 3)
    if not len(cells):
        return np.tile(third, (CONTEXTS, 1))
    everywhere = expectation(third, np.ones(len(cells), bool), third)
    return np.stack([
        expectation(everywhere, bucket == b, 10 * everywhere) if (bucket == b).any() else everywhere for b in range(CONTEXTS)
    ])


def for_scoring(weights: np.ndarray, n: int) -> np.ndarray:
    """Weights with which the chances after any context add up to 1: a context that was never seen has no pairs to share
    out its weight among, and where nothing was learnt no tokens either."""
    weights = weights.copy()
    weights[0, 0] = 0
    if not n:
        weights[:, :2] = 0
    return weights / weights.sum(axis=1, keepdims=True)


# The whole


def _scores(layout: Layout, n: int, v: int, weights: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()),
                             "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()),
                             "score": pa.array([], pa.float64())})
        block = Block(texts, "text", "learn")
        words, pairs = _assembled(layout, block, found)
        word, pair, context = words[block.word], pairs[block.pair], words[block.context]
        own = weights[_context_bucket(context)]
        chance = own[:, 0] * pair / np.maximum(context, 1) + own[:, 1] * word / max(n, 1) + own[:, 2] / (v + 1)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        return pa.table({
            "doc_id": texts["doc_id"], "n_tokens": block.sizes.astype(np.int64),
            "n_known": np.add.reduceat((word > 0).astype(np.int64), block.begins),
            "base_score": np.add.reduceat(base, block.begins), "score": np.add.reduceat(np.log10(chance), block.begins),
        })

    return work


def score_texts(
    docs: DataFrame, learn: F.Column, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    ``learn`` and ``held_out`` are expressions over ``doc_id``: rows to count, and which of those the weights are learnt
    on. Null text is empty: one token, the end. Rows that repeat give repeated rows and count each time. An empty table
    gives no rows; where nothing is learnt, every token has the probability of an unknown one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("learn", learn).withColumn("held", held_out & F.col("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout, blocks = Layout(size), int(1 + size // BLOCK)
    # Held-out documents have blocks of their own, so that learning the weights reads no other totals.
    # The text is hashed too, so that rows which share an id or have none are spread.
    number = F.pmod(F.xxhash64("doc_id", "text"), F.when(F.col("held"), 1 + blocks // 10).otherwise(blocks))
    dealt = rows.select("doc_id", "text", "learn", F.when(F.col("held"), number + blocks).otherwise(number).alias("block"))
    folder = new_folder(spark, "totals")
    (
        dealt.groupBy("block").applyInArrow(_entries(layout), "block long, bucket long, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(_totals(layout), "block long, bucket long, totals binary, n long, v long")
        .write.parquet(folder)
    )
    totals = spark.read.schema("block long, bucket long, totals binary, n long, v long").parquet(folder)
    n, v = totals.where(F.col("block") == -1).agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0

    held = F.col("block") >= blocks
    cells = (
        dealt.where(held).groupBy("block").cogroup(totals.where(held).groupBy("block"))
        .applyInArrow(_held_out_cells(layout, n), "cell long, tokens long")
        .groupBy("cell").agg(F.sum("tokens").alias("tokens")).toPandas()
    )
    weights = for_scoring(learn_weights(cells["cell"].to_numpy(np.int64), cells["tokens"].to_numpy(np.float64), v), n)
    scored = dealt.groupBy("block").cogroup(totals.where(F.col("block") >= 0).groupBy("block")).applyInArrow(
        _scores(layout, n, v, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


@query()
def op10_language_model(spark, folder):
    """Probability of every document, learnt from those outside the held-out tenth."""
    scored = score_texts(
        read(spark, folder, "documents"), remainder("doc_id", 10) != 0, remainder("doc_id", 10) == 1
    )
    return scored.select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
