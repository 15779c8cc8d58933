"""Ranked lexical search over an index that is stratified by document length.

Documents with one length normaliser m are a stratum: inside it a term's impact depends on its frequency tf alone, so it is
computed once per tf, not per posting. A stratum is cut into blocks of a bounded number of documents; a block is one row of
the index: its documents, and for each term its runs of equal tf, highest first. The impact of the first run bounds what the
term can add to any document of the block, and the sum over an item's terms bounds the block. Each item first visits the
block with its highest bound, which gives a score to beat; then all blocks are visited in the order of their bounds, as far
as the bounds reach that score, and what is skipped cannot be among the best.

The index holds the terms that the items ask for. Items are taken in blocks of a bounded number of terms, each with its
own pass over the documents, so what goes to the workers does not grow with their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read

#: Bytes of terms: ASCII letters and digits, and every byte of a character beyond ASCII; all others part terms.
TERM_BYTES = bytes(
    b + 32 if ord("A") <= b <= ord("Z") else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)
#: Bytes of text whose terms are counted at once.
PIECE = 4 << 20
#: Documents of an index block, and item terms (and their bytes) of one pass over the documents.
BLOCK = 4096
ITEM_TERMS, ITEM_BYTES = 500_000, 64 << 20
#: Strata with several blocks are broadcast up to so many.
FEW = 100_000
#: A term of frequency tf adds weight * (SCALE * tf div (1000 * tf + 8 * m)).
SCALE = 1_000_000_000
_LAST = np.iinfo(np.int64).max


def term_counts(raw: bytes) -> Counter:
    """How often each term stands in a text of UTF-8 bytes."""
    clean = raw.translate(TERM_BYTES)
    if len(clean) <= PIECE:
        return Counter(clean.split())
    counts: Counter = Counter()
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        counts.update(clean[at:end].split())
        at = end
    return counts


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, term``, each once; an item without terms has no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.columns
            for row, text in enumerate(pc.fill_null(texts, b"")):
                terms = sorted(term_counts(text.as_py()))
                if terms:
                    yield pa.record_batch(
                        [names.take(pa.array([row] * len(terms))), pa.array(terms, pa.binary())], ["item", "term"]
                    )

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, "item long, term binary").distinct()


def _document_terms(docs: DataFrame, wanted, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: all its terms are in n, the wanted ones are listed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = wanted.value
        for batch in batches:
            rows, sizes, terms, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                counts = term_counts(text.as_py()) if text.is_valid else None
                if not counts:
                    continue
                rows.append(row)
                sizes.append(counts.total())
                for term in counts.keys() & numbers.keys():
                    terms.append(numbers[term])
                    tfs.append(counts[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
            ], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<int>")


def _impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 8 * m)


#: A block of the index. Runs are postings of one term and one tf: ``places`` are their documents' numbers in the block, run
#: after run, ``first`` is where each run begins; ``term_runs`` is where the runs of each term begin, the highest tf first.
INDEX = (
    "m long, block int, doc_ids array<long>, terms array<int>, term_runs array<int>, impacts array<long>, first array<int>, "
    "places array<int>"
)


def _index_block(table: pa.Table) -> pa.Table:
    m = table["m"][0].as_py()
    terms = table["terms"].combine_chunks()
    tf = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
    place = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy())
    term = terms.flatten().to_numpy()
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    first = np.flatnonzero(fresh)
    run_term = term[first]
    starts = np.flatnonzero(np.append(True, run_term[1:] != run_term[:-1]))
    distinct, which = np.unique(tf[first], return_inverse=True)
    impacts = _impacts(distinct, m)[which]

    def cell(values, kind):
        return pa.array([values], pa.list_(kind))

    return pa.table({
        "m": pa.array([m], pa.int64()), "block": table["block"].slice(0, 1).combine_chunks(),
        "doc_ids": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
        "terms": cell(run_term[starts], pa.int32()), "term_runs": cell(starts, pa.int32()),
        "impacts": cell(impacts, pa.int64()), "first": cell(first, pa.int32()), "places": cell(place, pa.int32()),
    })


class _Asked:
    """The items of a pass: their terms one after the other, and each term's weight."""

    def __init__(self, names: list, terms: list[np.ndarray], weights: np.ndarray) -> None:
        self.names = names
        self.terms = np.concatenate(terms)
        self.starts = np.cumsum([0] + [len(t) for t in terms])
        self.weights = weights
        # Sums of doubles are exact below 2^53; no impact reaches a million.
        self.exact = float(np.add.reduceat(weights[self.terms], self.starts[:-1]).max()) * 1e6 < 2 ** 53


class _Block:
    """One row of the index, ready for items."""

    def __init__(self, row: pa.RecordBatch, asked: _Asked) -> None:
        def numbers(name):
            return row.column(name)[0].values.to_numpy(zero_copy_only=False)

        self.asked = asked
        ids = row.column("doc_ids")[0].values
        self.ids, self.nameless = pc.fill_null(ids, _LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.terms, term_runs, impacts = numbers("terms"), numbers("term_runs"), numbers("impacts")
        first, self.places = numbers("first"), numbers("places")
        self.begins = first[term_runs]
        self.ends = np.append(self.begins[1:], len(self.places))
        self.impacts = np.repeat(impacts, np.diff(np.append(first, len(self.places))))
        highest = np.zeros(len(asked.weights), np.int64)
        highest[self.terms] = impacts[term_runs]
        self.bounds = np.add.reduceat((asked.weights * highest)[asked.terms], asked.starts[:-1])
        self.number = np.full(len(asked.weights), -1, np.int64)
        self.number[self.terms] = np.arange(len(self.terms))

    def best(self, item: int, k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the item's k best documents here, of those that reach ``beat`` and 1; equal ones by id."""
        own = self.asked.terms[self.asked.starts[item]:self.asked.starts[item + 1]]
        weights = self.asked.weights[own]
        here = self.number[own]
        weights, here = weights[here >= 0], here[here >= 0]
        sizes = self.ends[here] - self.begins[here]
        postings = np.arange(sizes.sum()) + np.repeat(self.begins[here] - np.cumsum(sizes) + sizes, sizes)
        places, added = self.places[postings], self.impacts[postings] * np.repeat(weights, sizes)
        if self.asked.exact:
            scores = np.bincount(places, added, minlength=len(self.ids)).astype(np.int64)
        else:
            scores = np.zeros(len(self.ids), np.int64)
            np.add.at(scores, places, added)
        found = np.flatnonzero(scores >= max(beat, 1))
        if len(found) > k:
            kth = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= kth]
        found = found[np.lexsort((self.ids[found], self.nameless[found], -scores[found]))[:k]]
        return scores[found], found


def _visited(index: DataFrame, asked, beats, k: int) -> DataFrame:
    """``item, doc_id, score``: all that may be among an item's k best, each task leaving out what it knows is not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Asked = asked.value
        beat = np.array(beats.value, np.int64)
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = [_Block(batch.slice(row, 1), items) for row in range(batch.num_rows)]
            bounds = np.array([block.bounds for block in blocks]).reshape(len(blocks), -1)
            for item in np.flatnonzero((bounds >= np.maximum(beat, 1)).any(axis=0)).tolist():
                names, found = [], []
                for number in np.argsort(-bounds[:, item], kind="stable"):
                    # A block whose bound is the score to beat may hold an equal score with a smaller id.
                    if bounds[number, item] < max(beat[item], 1):
                        break
                    block = blocks[number]
                    scores, places = block.best(item, k, int(beat[item]))
                    if len(scores):
                        found.append(scores)
                        names += [None if block.nameless[p] else int(block.ids[p]) for p in places]
                        seen = np.concatenate([kept.get(item, scores[:0]), scores])
                        kept[item] = np.sort(seen)[::-1][:k]
                        if len(kept[item]) == k:
                            beat[item] = max(beat[item], kept[item][-1])
                if found:
                    scores = np.concatenate(found)
                    live = np.flatnonzero(scores >= beat[item])
                    yield pa.record_batch([
                        pa.array([item] * len(live), pa.int32()), pa.array([names[at] for at in live], pa.int64()),
                        pa.array(scores[live]),
                    ], ["item", "doc_id", "score"])

    return index.mapInArrow(work, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(index: DataFrame, asked) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bounds = _Block(batch.slice(row, 1), asked.value).bounds
                items = np.flatnonzero(bounds)
                yield pa.record_batch([
                    pa.array(items.astype(np.int32)), pa.array(bounds[items]),
                    batch.column("m").take(pa.array([row] * len(items))),
                    batch.column("block").take(pa.array([row] * len(items))),
                ], ["item", "bound", "m", "block"])

    return index.mapInArrow(work, "item int, bound long, m long, block int")


def _index(found: DataFrame, documents: int, length: int, block: int) -> DataFrame:
    """The index as a stored table, one row per block of a stratum."""
    spark = found.sparkSession
    m = F.expr(f"10 + CAST((CAST(90 AS DECIMAL(2, 0)) * n * CAST({documents} AS DECIMAL(19, 0))) div {max(length, 1)}BD AS BIGINT)")
    rows = found.where(F.size("terms") > 0).withColumn("m", m)
    strata = rows.groupBy("m").agg((1 + F.floor((F.count(F.lit(1)) - 1) / block)).cast("int").alias("ways"))
    folder = new_folder(spark, "strata")
    strata.where("ways > 1").write.parquet(folder)
    large = spark.read.parquet(folder)
    large = F.broadcast(large) if large.count() <= FEW else large
    # Whatever the ids are, a stratum's rows are spread: the terms are hashed too, and rows equal in both by partition.
    place = F.xxhash64("doc_id", "terms", "tfs", F.spark_partition_id())
    dealt = rows.join(large, "m", "left").withColumn("block", F.pmod(place, F.coalesce("ways", F.lit(1))).cast("int"))
    folder = new_folder(spark, "lexical-index")
    dealt.select("m", "block", "doc_id", "terms", "tfs").groupBy("m", "block").applyInArrow(_index_block, INDEX).write.parquet(folder)
    return spark.read.parquet(folder)


def _one_pass(docs: DataFrame, terms: list[Row], k: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """``item`` (its id), ``doc_id, score, rank`` of the items whose terms are given, over all documents."""
    spark = docs.sparkSession
    numbers = {term: number for number, term in enumerate(sorted({bytes(row.term) for row in terms}))}
    of_item: dict = {}
    for row in terms:
        of_item.setdefault(row.item, []).append(numbers[bytes(row.term)])
    folder = new_folder(spark, "document-terms")
    _document_terms(docs, spark.sparkContext.broadcast(numbers), id_col, text_col).write.parquet(folder)
    found = spark.read.parquet(folder)
    documents, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = {row.term: row.df for row in  # one row for each term of the pass
               found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([
        math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(number, 0) + 1))) for number in range(len(numbers))
    ], np.int64)
    names = list(of_item)
    asked = spark.sparkContext.broadcast(_Asked(names, [np.array(of_item[name]) for name in names], weights))
    index = _index(found, documents, length, block)

    first = _bounds(index, asked).groupBy("item").agg(F.max_by(F.struct("m", "block"), "bound").alias("at"))
    first = F.broadcast(first.select("at.*").distinct())  # one row for each item of the pass at most
    tried = _best(_visited(index.join(first, ["m", "block"]), asked, spark.sparkContext.broadcast([0] * len(names)), k), k)
    beats = [0] * len(names)
    for row in tried.where(F.col("rank") == k).select("item", "score").collect():
        beats[row.item] = row.score
    best = _best(_visited(index, asked, spark.sparkContext.broadcast(beats), k), k)
    named = spark.createDataFrame([(number, name) for number, name in enumerate(names)], "item int, item_id long")
    return best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k documents with the highest scores above 0, equal ones by id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. Null texts and texts without a
    term are no documents and no items. Every row is a document of its own: rows that share an id are listed
    each, and rows without id come last among equals. Items that share an id are one, with the terms of all their rows; a
    null item id is an id like others. Whole texts are read and every document is indexed. Empty tables give no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "items")
    _item_terms(items, item_col, item_text_col).write.parquet(folder)
    asked = spark.read.parquet(folder)
    rows, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    passes = 1 + max(rows // item_terms, size // ITEM_BYTES)
    out = None
    for number in range(passes if rows else 0):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).orderBy("item", "term").collect()
        if own:
            part = _one_pass(docs, own, k, id_col, text_col, block)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


@query("""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS place,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms
    FROM documents
), docs AS (SELECT * FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*)::HUGEINT AS n, sum(len(terms))::HUGEINT AS l FROM docs),
postings AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM docs) GROUP BY ALL),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, totals GROUP BY term, n
), sizes AS (SELECT place, doc_id, (10 + (90 * len(terms) * n) // l)::BIGINT AS m FROM docs, totals),
scores AS (
    SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (place)
    GROUP BY item_id, place, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
""")
def op11_lexical_search(spark, folder):
    """The ten best documents of every benchmark item."""
    return search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
