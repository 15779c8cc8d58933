"""Main text of web pages, by the suffix array of each host.

The text of every page of a host is token streams, cut where it enters or leaves the article: for each block its mark and its
words. Streams of one host are put behind each other and their suffixes ordered as far as LONG tokens reach; neighbours that
agree so far are a substring repeated, and tokens it covers on distinct pages are boilerplate. What is left are the unique runs.

A host may hold a third of all pages, so its suffixes are dealt out: windows of LONG tokens go by the smallest hash of three
tokens in them, consecutive windows with the same smallest one as one run. Equal windows meet wherever they stand, and equal
runs of all pages, which boilerplate is full of, are one row before they are shuffled. A key that still has very many
different runs is dealt by single windows instead.

Repeats alone do not give the article: pages of a host share articles and passages, which stay, and have menus and
comments of their own, which go. So a check by the markup follows: text inside the article stays though it repeats, text that
repeats only what articles of other pages say stays too, and what the markup says stands around the article goes even where
it does not repeat. On pages that declare no article the order decides.

Marks of the article's own tokens would all be undone by that check, so only those outside are found. For them the article's
windows matter that some text outside has, which is one of a key that stands outside: the keys outside are put into a filter
of fixed size, and runs of articles are shuffled where it has their key. Keys it has wrongly cost time and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read
from .markup import AROUND, MAIN, blocks
from .text import mixed, released, squeezed, worker_table

#: Tokens of a repeated substring at least, marks of blocks among them.
LONG = 12
#: Hashes looked at for a window's key cover so many tokens.
KEY = 3
#: Windows of a run at most, and different runs of a key that one task orders at most.
RUN, MANY = 1024, 50_000
#: Repeated runs are broadcast up to so many bytes, keys with too many runs up to so many.
FEW_BYTES, FEW = 48 << 20, 200_000
#: Bits of the filter of keys outside articles (16 MB), and in one row of it.
FILTER, ROW = 1 << 27, 1 << 15
#: Tokens that no word hashes to by construction: the mark of a block and the filling behind a short stream.
BLOCK_MARK, FILLING = 1, 2
_WORDS = 500_000


def _hash_of(word: str, known: dict[str, int]) -> int:
    value = known.get(word)
    if value is None:
        if len(known) >= _WORDS:
            known.clear()
        value = known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 4
    return value


def _stretches(page: list[tuple[str, str]]) -> list[tuple[bool, list[tuple[int, str]]]]:
    """(whether inside the article, number and text of its blocks) for each stretch of blocks, in page order."""
    return [(inside, [(number, text) for number, (_, text) in stretch])
            for inside, stretch in groupby(enumerate(page), key=lambda block: block[1][0] == MAIN)]


def _stream(stretch: list[tuple[int, str]], known: dict[str, int]) -> tuple[np.ndarray, list[int]]:
    tokens, owners = [], []
    for number, text in stretch:
        words = text.split(" ")
        tokens += [BLOCK_MARK, *[known.get(word) or _hash_of(word, known) for word in words]]
        owners += [number] * (1 + len(words))
    tokens += [FILLING] * max(0, LONG - len(tokens))
    return np.array(tokens, np.uint64), owners


def streams(page: list[tuple[str, str]], known: dict[str, int]) -> list[tuple[np.ndarray, list[int]]]:
    """(tokens, number of the block of each) for each stretch of blocks inside or outside the article, in page order."""
    return [_stream(stretch, known) for _, stretch in _stretches(page)]


def _keys(tokens: np.ndarray) -> np.ndarray:
    """Hashes of KEY tokens from each place on."""
    return mixed(tokens[:-2] + mixed(tokens[1:-1] + mixed(tokens[2:])))


def runs(tokens: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, key) of each run: windows that follow each other and have their smallest hash in one place."""
    grams = _keys(tokens)
    inside = np.lib.stride_tricks.sliding_window_view(grams, LONG - KEY + 1)
    smallest = inside.argmin(axis=1) + np.arange(len(inside))
    cuts = np.flatnonzero(np.append(True, smallest[1:] != smallest[:-1])).tolist()
    for begin, end in zip(cuts, [*cuts[1:], len(smallest)]):
        for at in range(begin, end, RUN):
            yield at, min(RUN, end - at), int(grams[smallest[begin]].astype(np.int64))


def _parsed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Pages with ``__host``, the host of the url in small letters (none: empty), and ``__page``, the digest of the html."""
    url = F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(host.alias("__host"), F.unhex(F.md5(html.cast("binary"))).alias("__page"), html.alias("__html"), "*")


_RUNS = "host string, page binary, stretch int, first int, key long, tokens binary"


def _page_runs(pages: DataFrame, outside: Broadcast | None = None) -> DataFrame:
    """Runs of each page outside its article; with a filter of their keys, runs inside articles with such a key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_table(("html words",), dict)
        some = None if outside is None else np.frombuffer(released(outside.value), np.uint8)
        for batch in batches:
            hosts, names, texts, marks = batch.columns
            marks = marks.to_numpy().view(np.uint64)
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                for number, (inside, stretch) in enumerate(_stretches(blocks(texts[row].as_py()))):
                    if inside != (some is not None):
                        continue
                    tokens, _ = _stream(stretch, known)
                    if inside and not _among(_keys(tokens) ^ marks[row], some).any():
                        continue
                    found = [*runs(tokens)]
                    if inside:
                        keys = np.array([key for *_, key in found]).view(np.uint64)
                        found = compress(found, _among(keys ^ marks[row], some))
                    for first, count, key in found:
                        rows.append((row, number, first, key, tokens[first:first + count + LONG - 1].tobytes()))
                if len(rows) >= 20_000 or row == batch.num_rows - 1:
                    at, *columns = zip(*rows) if rows else ((),) * 5
                    at = pa.array(at, pa.int64())
                    yield pa.record_batch([hosts.take(at), names.take(at), *(
                        pa.array(values, kind) for values, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))
                    )], ["host", "page", "stretch", "first", "key", "tokens"])
                    rows = []

    return pages.select("__host", "__page", "__html", F.xxhash64("__host")).mapInArrow(work, _RUNS)


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys, each changed by its host's hash, the filter has."""
    places = keys & np.uint64(FILTER - 1)
    return (some[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filter(found: DataFrame) -> bytes:
    """One bit for each value of the last bits of a key changed by its host's hash, set where a key has it."""
    place = F.col("key").bitwiseXOR(F.xxhash64("host")).bitwiseAND(FILTER - 1)
    rows = found.groupBy(F.floor(place / ROW).cast("int").alias("row")).agg(
        F.bitmap_construct_agg((place % ROW).cast("long")).alias("bits"))
    some = np.zeros((FILTER // ROW, ROW // 8), np.uint8)
    for row in rows.toLocalIterator():
        some[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    return squeezed(some.tobytes())


def _repeated_windows(rows: list[np.ndarray], *bounds: np.ndarray) -> list[np.ndarray]:
    """Numbers of each run's windows that distinct pages have: suffixes in order as far as LONG tokens, then neighbours.

    ``bounds`` are the lowest and the highest page of each run; more such pairs give as many lists behind the first.
    """
    counts = np.array([len(tokens) - LONG + 1 for tokens in rows])
    begins = np.cumsum([0] + [len(tokens) for tokens in rows[:-1]])
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = np.lib.stride_tricks.sliding_window_view(np.concatenate(rows), LONG)[begins[owner] + inside]
    order = np.lexsort(suffixes.T[::-1])
    agree = (suffixes[order[1:]] == suffixes[order[:-1]]).all(axis=1)
    starts = np.flatnonzero(np.append(True, ~agree))
    out = []
    for low, high in zip(bounds[::2], bounds[1::2]):
        distinct = np.minimum.reduceat(low[owner[order]], starts) < np.maximum.reduceat(high[owner[order]], starts)
        repeated = np.zeros(len(owner), bool)
        repeated[order] = np.repeat(distinct, np.diff(np.append(starts, len(order))))
        out += [inside[(own := slice(end - count, end))][repeated[own]] for end, count in zip(np.cumsum(counts), counts)]
    return out


_MARKS = "host string, tokens binary, windows array<int>, quoted array<int>"


def _marked(table: pa.Table) -> pa.Table:
    """Marks of the runs that stand outside articles; those inside have no ``low`` and ``high``."""
    ends = np.iinfo(np.int64)
    outside = table["low"].is_valid().to_numpy()
    bounds = [pc.fill_null(table[name], value).to_numpy() for name, value in (
        ("low", ends.max), ("high", ends.min), ("all_low", ends.max), ("all_high", ends.min))]
    rows = [np.frombuffer(raw, np.uint64) for raw in table["tokens"].to_pylist()] if outside.any() else []
    found = _repeated_windows(rows, *bounds) if rows else []
    marks = [(found[row].tolist(), np.setdiff1d(found[len(rows) + row], found[row]).tolist()) for row in range(len(rows))]
    live = [row for row, mark in enumerate(marks) if outside[row] and any(mark)]
    taken = table.select(["host", "tokens"]).take(pa.array(live, pa.int64()))
    for at, name in enumerate(("windows", "quoted")):
        taken = taken.append_column(name, pa.array([marks[row][at] for row in live], pa.list_(pa.int32())))
    return taken


_PAGES = ["low", "high", "all_low", "all_high"]


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a run as a run of its own, with the run and the place it is from."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw = batch.column("tokens")[row].as_py()
            windows = [raw[at:at + 8 * LONG] for at in range(0, len(raw) - 8 * LONG + 1, 8)]
            same = pa.array([row] * len(windows))
            yield pa.record_batch([
                batch.column("host").take(same), pa.array(windows, pa.binary()), batch.column("tokens").take(same),
                pa.array(range(len(windows)), pa.int32()), *(batch.column(name).take(same) for name in _PAGES),
            ], ["host", "window", "tokens", "place", *_PAGES])


def repeated_runs(found: DataFrame, articles: DataFrame, many: int = MANY) -> DataFrame:
    """``host, tokens, windows, quoted``: runs outside articles with windows that stand on distinct pages of their host.

    ``windows`` numbers those that distinct pages have outside their articles, ``quoted`` those that otherwise only stand in
    articles of other pages.
    """
    spark = found.sparkSession
    page = F.xxhash64("page")
    different = found.select("host", "key", "tokens", page.alias("outside"), page.alias("page")).unionByName(
        articles.select("host", "key", "tokens", F.lit(None).cast("long").alias("outside"), page.alias("page"))
    ).groupBy("host", "key", "tokens").agg(
        F.min("outside").alias("low"), F.max("outside").alias("high"), F.min("page").alias("all_low"), F.max("page").alias("all_high"))
    folder = new_folder(spark, "html-runs")
    different.write.parquet(folder)
    different = spark.read.parquet(folder)
    folder = new_folder(spark, "html-keys")
    different.groupBy("host", "key").count().where(F.col("count") > many).select("host", "key").write.parquet(folder)
    heavy = spark.read.parquet(folder)
    some = heavy.count()
    heavy = F.broadcast(heavy) if some <= FEW else heavy
    usual = different.join(heavy, ["host", "key"], "left_anti") if some else different
    marks = usual.groupBy("host", "key").applyInArrow(_marked, _MARKS)
    if some:
        folder = new_folder(spark, "html-windows")
        different.join(heavy, ["host", "key"], "left_semi").select("host", "tokens", *_PAGES).mapInArrow(
            _single_windows, "host string, window binary, tokens binary, place int, low long, high long, all_low long, all_high long"
        ).write.parquet(folder)
        single = spark.read.parquet(folder)
        shared = single.groupBy("host", "window").agg(*(
            (F.min if name.endswith("low") else F.max)(name).alias(name) for name in _PAGES))
        shared = shared.where("low IS NOT NULL AND all_low != all_high").select("host", "window", F.expr("low != high").alias("outside"))
        marks = marks.unionByName(single.where("low IS NOT NULL").join(shared, ["host", "window"]).groupBy("host", "tokens").agg(
            F.collect_list(F.when(F.col("outside"), F.col("place"))).alias("windows"),
            F.collect_list(F.when(~F.col("outside"), F.col("place"))).alias("quoted")))
    return marks


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many: int = MANY,
) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated, n_around, n_quoted`` of every row.

    Text is the article's blocks, one a line. On a page that declares an article (or main part) that is it, without what
    the markup says stands around it; on others all text that is not marked so, less the tokens that distinct pages of the
    host repeat in substrings of LONG tokens or more (a shorter stretch: as a whole) outside their articles. ``n_repeated``
    counts the tokens outside the article that are repeated so, ``n_around`` those that only the markup removes, ``n_quoted``
    those that only articles of other pages repeat, which is no reason to remove them. Pages with equal html are no distinct
    pages. Null html is empty, empty text counts 0; a null or odd url is of the host without a name. Rows that repeat return each.
    """
    spark = pages.sparkSession
    given = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    parsed = _parsed(given, "url", "html")
    folder = new_folder(spark, "html-streams")
    _page_runs(parsed).write.parquet(folder)
    found = spark.read.parquet(folder)
    folder = new_folder(spark, "html-marks")
    outside = spark.sparkContext.broadcast(_filter(found))
    repeated_runs(found, _page_runs(parsed, outside), many).write.parquet(folder)
    marks = spark.read.parquet(folder)
    held = marks.agg(F.sum(F.length("host") + F.octet_length("tokens") + 4 * F.size("windows") + 4 * F.size("quoted"))).first()[0] or 0
    marks = F.broadcast(marks) if held <= FEW_BYTES else marks
    # Pages with equal html have the same marks.
    placed = found.join(marks, ["host", "tokens"]).select("host", "page", "stretch", "first", "windows", "quoted").groupBy(
        "host", "page").agg(F.collect_set(F.struct("stretch", "first", "windows", "quoted")).alias("marks"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], []
            for page, held in zip(batch.column("__html"), batch.column("marks")):
                text, *counts = _kept(blocks(page.as_py()), held.as_py() or [])
                texts.append(text)
                numbers.append((len(text), *counts))
            yield pa.record_batch([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                *(pa.array(values, pa.int64()) for values in (zip(*numbers) if numbers else ((),) * 4)),
            ], ["page_id", "url", "text", "n_chars", "n_repeated", "n_around", "n_quoted"])

    joined = parsed.join(
        placed.select(F.col("host").alias("__host"), F.col("page").alias("__page"), "marks"), ["__host", "__page"], "left")
    return joined.select("page_id", "url", "__html", "marks").mapInArrow(
        work, "page_id long, url string, text string, n_chars long, n_repeated long, n_around long, n_quoted long")


def _kept(page: list[tuple[str, str]], marks: list[dict]) -> tuple[str, int, int, int]:
    """Text of a page, tokens the host repeats, tokens that only the markup removes, tokens that only articles repeat."""
    known = worker_table(("html words",), dict)
    of: dict[int, list[dict]] = {}
    for mark in marks:
        of.setdefault(mark["stretch"], []).append(mark)
    left: dict[int, list[bool]] = {}
    told: dict[int, list[bool]] = {}
    declared = False
    for at, (inside, stretch) in enumerate(_stretches(page)):
        if inside:
            declared = True
            continue
        tokens, owners = _stream(stretch, known)
        gone, quoted = np.zeros((2, len(tokens)), bool)
        for mark in of.get(at, ()):
            for own, name in ((gone, "windows"), (quoted, "quoted")):
                for window in mark[name]:
                    own[mark["first"] + window:mark["first"] + window + LONG] = True
        for number, flag, also in zip(owners, gone.tolist(), (quoted & ~gone).tolist()):
            left.setdefault(number, []).append(not flag)
            told.setdefault(number, []).append(also)
    lines, repeated, around, quoting = [], 0, 0, 0
    for number, (says, text) in enumerate(page):
        if says == MAIN:
            lines.append(text)
            continue
        stays = left[number][1:]  # the block's mark is first
        repeated += len(stays) - sum(stays)
        quoting += sum(told[number][1:])
        if declared or says == AROUND:
            around += sum(stays)
        elif any(stays):
            lines.append(" ".join(word for word, stay in zip(text.split(" "), stays) if stay))
    return "\n".join(lines), repeated, around, quoting


@query()
def op13_html_extraction(spark, folder):
    """The article of every page."""
    return main_text(read(spark, folder, "pages"))
