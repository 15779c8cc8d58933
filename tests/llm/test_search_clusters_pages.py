"""Lexical search, centroid clustering and main texts against slow versions, with awkward rows."""

import hashlib
import html
import math
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
import check
from tallysketch.llm.centroids import Clusters, _gaps, cluster, squared_distances
from tallysketch.llm.html_extraction import LONG, _repeated_windows, main_text, runs, streams
from tallysketch.llm.lexical import search, term_counts
from tallysketch.llm.markup import AROUND, MAIN, SILENT, blocks

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("start", ["op11_", "op12_"])
def test_registered_against_sql(spark, tables, start):
    name = next(n for n in driver.queries() if n.startswith(start))
    other = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        other.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    mine = driver.queries()[name](spark, tables).toPandas()
    assert len(mine) and check.compare(mine, other.execute(driver.oracle_sql()[name]).df()) == "same"


# Search


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def ranked(docs, items, k=10):
    """Every document scored for every item with plain integers."""
    terms = [(i, TERM.findall(lower(t))) for i, t in docs if t is not None]
    terms = [(i, own) for i, own in terms if own]
    n, length = len(terms), sum(len(own) for _, own in terms)
    df = {}
    for _, own in terms:
        for term in set(own):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lower(text or "")))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, own in terms:
            m = 10 + 90 * len(own) * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10 ** 9 * own.count(term) // (1000 * own.count(term) + 8 * m))
                for term in wanted if term in own)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_documents(seed=1, count=150):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(40)] + ["Ünder", "straße", "İx", "A1"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 10, 10, 10, 60])))) for i in range(count)]
    docs += [(500, None), (501, ""), (502, " .,-\t"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (9, "w1 w2 w3"),
             (2 ** 63 - 1, "w1 w2 w3"), (503, "w5 " * 3000), (504, "\x00w1\x7fw2")]
    items = [(1, "w1 w2"), (2, "W1, w1; w1"), (3, None), (4, "?"), (5, "nothing here"), (6, "straße İx ünder w5"), (None, "w3 w9"),
             (8, "w7"), (8, "w8")]
    return docs, items


@pytest.fixture
def item_table(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id LONG, text STRING")


@pytest.mark.parametrize("block, item_terms", [(4096, 500_000), (5, 4)])
def test_search_is_brute_force(documents, item_table, block, item_terms):
    docs, items = some_documents()
    got = search(documents(docs), item_table(items), block=block, item_terms=item_terms)
    assert found(got) == ranked(docs, items)


def test_search_orders_ties_by_id(documents, item_table):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(1000, "other")]
    got = found(search(documents(docs), item_table([(0, "same here")]), k=5, block=16))
    assert [row[:3] for row in got] == [(0, n, n) for n in range(1, 6)]


def test_search_of_empty_tables(documents, item_table):
    assert found(search(documents([]), item_table([(1, "a")]))) == []
    assert found(search(documents([(1, "a")]), item_table([]))) == []
    assert found(search(documents([(1, None), (2, "")]), item_table([(1, "a")]))) == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = lower("Ab c" + "d" * 50 + " é, " * 200).encode()
    whole = term_counts(text)
    monkeypatch.setattr("tallysketch.llm.lexical.PIECE", 7)
    assert term_counts(text) == whole and whole["é".encode()] == 200


# Clustering


def clustered(rows, k=8, rounds=10, width=64, seed=3):
    """Lloyd's rounds with Python integers."""
    kept = [(i, [max(-2 ** 27, min(2 ** 27, math.floor(1024 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for number in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, of) if n == number]
            if own:
                centroids[number] = [sum(column) // len(own) for column in zip(*own)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in last if m == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, total[n], sum(total.values()), digest[n]) for i, d, n in last), key=repr)


def vectors_of(spark, rows, kind="FLOAT"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id LONG, embedding ARRAY<{kind}>, cluster INT, distance STRING")


def got(frame):
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_clusters_are_brute_force(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    rows = [(i, np.float32(middles[rng.integers(6)] + rng.normal(size=64) * 0.3).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(1000, 1200)]  # many equal vectors
    rows += [(5, rows[3][1]), (5, rows[9][1]), (None, rows[4][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64),
             (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64)]
    assert got(cluster(vectors_of(spark, rows))) == clustered(rows)


def test_few_and_large_vectors(spark):
    rows = [(1, [3e7] * 64), (2, [-1e30] * 64), (3, [1.5] * 64), (4, [-0.0001] * 64)]
    assert got(cluster(vectors_of(spark, rows, "DOUBLE"))) == clustered(rows)
    assert got(cluster(vectors_of(spark, rows[:1], "DOUBLE"))) == clustered(rows[:1])
    assert got(cluster(vectors_of(spark, []))) == []


def test_distances_and_bounds_are_exact_either_way():
    rng = np.random.default_rng(1)
    for scale in (100, 2 ** 27):
        vectors, centroids = rng.integers(-scale, scale, (50, 64)), rng.integers(-scale, scale, (8, 64))
        truth = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors]
        assert squared_distances(vectors, centroids).tolist() == truth
    squares = np.array([[9, 9], [4, 25]])
    gaps = _gaps(squares, np.array([0, 0]))
    assert gaps[0] <= 0 < gaps[1] <= 3


def test_drift_adds_own_and_largest_other_move():
    state = Clusters(np.array([[0, 0], [10, 0], [0, 10]]))
    state.sums, state.counts = [[6, 8], [10, 0], [0, 0]], [2, 1, 0]
    state.move()
    assert state.centroids.tolist() == [[3, 4], [10, 0], [0, 10]]
    assert np.allclose(state.drift, [5, 5, 5])
    state.sums, state.counts = [[-7, 8], [10, 0], [0, 0]], [2, 1, 0]
    state.move()
    assert state.centroids[0].tolist() == [-4, 4]  # the floor, not the nearest to zero


# Main texts


def test_blocks_of_odd_markup():
    page = (
        "<!doctype html><title>t</title><style>p{}</style><script>var t='</p>';</script><body><nav>Home</nav><!-- <p>no</p> -->"
        "<header>Top</header><article class=x><header><h1>One&amp;two</h1></header><p>a<br>b &lt;c&gt;\n d<p>e <span class='ad'>buy</span> f"
        "<article>comment</article><div id=comments>first!</div><form>send <input></form><footer>tags</footer></article>"
        "<div class=\"ad-box\">x</div>1 < 2 <p title='a>b'>loose</p><aside>side</aside>"
    )
    told = blocks(page)
    assert [t for s, t in told if s == MAIN] == ["One&two", "a b <c> d", "e f", "send"]
    assert [t for s, t in told if s == SILENT] == ["1 < 2", "loose"]
    assert {"Home", "Top", "buy", "comment", "first!", "tags", "x", "side"} == {t for s, t in told if s == AROUND}
    for odd in ("", "<", "<p", "</", "<!--", "<script>x", "<p a='", "&#0;&bogus;", "</div></p>x", "<a <a <a", "<<p>>"):
        assert all(text and text == " ".join(text.split()) for _, text in blocks(odd))


def repeated_by_brute_force(pages):
    """Per page its covered tokens: windows looked up in a table of all windows of the host."""
    seen, of = {}, []
    for host, page in pages:
        mine = streams(blocks(page), {})
        of.append((host, page, mine))
        for tokens, _ in mine:
            for at in range(len(tokens) - LONG + 1):
                seen.setdefault((host, tokens[at:at + LONG].tobytes()), set()).add(page)
    out = []
    for host, page, mine in of:
        told, gone = blocks(page), {}
        for tokens, owners in mine:
            covered = [False] * len(tokens)
            for at in range(len(tokens) - LONG + 1):
                if len(seen[host, tokens[at:at + LONG].tobytes()]) > 1:
                    covered[at:at + LONG] = [True] * LONG
            for owner, flag in zip(owners, covered):
                gone.setdefault(owner, []).append(flag)
        declared = any(s == MAIN for s, _ in told)
        lines = []
        for number, (says, text) in enumerate(told):
            if says == MAIN:
                lines.append(text)
            elif says == SILENT and not declared:
                words = [w for w, g in zip(text.split(" "), gone[number][1:]) if not g]
                lines += [" ".join(words)] if words else []
        out.append("\n".join(lines))
    return out


def some_pages():
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choices([f"v{k}" for k in range(400)], k=n))
    menu = "".join(f"<li>{w}" for w in words(9).split())
    promise = words(15)
    rows = []
    for n in range(40):
        host = f"h{n % 3}.example.org"
        body = f"<ul>{menu}</ul><div>{promise} {words(20)}</div><p>{words(30)}</p><p>{words(3)}</p><div>{promise}</div>"
        rows.append((n, f"https://u@{host.upper()}:80/{n}", body))
        rows.append((100 + n, f"//{host}/a", f"<div>{words(12)}</div><article>{promise}<p>{words(8)}</article><div>x</div>"))
    rows += [(200, None, "<p>" + words(30)), (201, None, None), (202, "", ""), (203, "no url", "<div></div>"), (None, "//h0.example.org", "a&amp;b"),
             (204, "//h0.example.org", rows[0][2]), (204, "//h0.example.org", rows[0][2]), (205, "//long", f"<p>{words(30_000)}"),
             (206, "//long", "<p>" + "tick " * 5000), (207, "//long", "<p>" + "tick " * 4000 + "tock")]
    return rows


@pytest.mark.parametrize("many", [50_000, 1])
def test_main_text_is_brute_force(spark, many):
    rows = some_pages()
    table = spark.createDataFrame([(*r, 1, "k", 0) for r in rows], "page_id LONG, url STRING, html STRING, n_chars INT, host STRING, __page INT")
    result = main_text(table, many=many).collect()
    host = lambda u: (re.search(r"//(?:[^/@]*@)?([^/:]*)", (u or "").lower()) or [0, ""])[1]
    truth = repeated_by_brute_force([(host(u), p or "") for _, u, p in rows])
    assert sorted(((r.page_id, r.url, r.text) for r in result), key=repr) == sorted(((i, u, t) for (i, u, _), t in zip(rows, truth)), key=repr)
    assert all(r.n_chars == len(r.text) for r in result)
    kept = {r.page_id: r.text for r in result}
    assert "v" in kept[0] and not any(rows[0][2].split("<div>")[-1].split("<")[0] in t for i, t in kept.items() if i is not None and i < 40)


def counts_by_brute_force(pages):
    """Per page its tokens outside the article that distinct pages repeat there, and those that only articles repeat."""
    of = [(host, page, [(ts, owners, blocks(page)[owners[0]][0] == MAIN) for ts, owners in streams(blocks(page), {})]) for host, page in pages]
    anywhere, outside = {}, {}
    for host, page, mine in of:
        for tokens, _, inside in mine:
            for at in range(len(tokens) - LONG + 1):
                name = host, tokens[at:at + LONG].tobytes()
                anywhere.setdefault(name, set()).add(page)
                if not inside:
                    outside.setdefault(name, set()).add(page)
    out = []
    for host, _, mine in of:
        repeated = quoted = 0
        for tokens, owners, inside in mine:
            flags = {id(seen): [False] * len(tokens) for seen in (anywhere, outside)}
            for seen in () if inside else (anywhere, outside):
                for at in range(len(tokens) - LONG + 1):
                    if len(seen[host, tokens[at:at + LONG].tobytes()]) > 1:
                        flags[id(seen)][at:at + LONG] = [True] * LONG
            words = [at for at in range(len(owners)) if at and owners[at] == owners[at - 1]]  # not the marks of blocks
            repeated += sum(flags[id(outside)][at] for at in words)
            quoted += sum(flags[id(anywhere)][at] and not flags[id(outside)][at] for at in words)
        out.append((repeated, quoted))
    return out


def test_streams_hold_the_whole_page():
    page = blocks("<nav>a b</nav><article><h1>c</h1><p>d e</article><div>f</div><main>g<nav>h</nav>i</main>")
    told = streams(page, {})
    assert [owners for _, owners in told] == [[0] * 3, [1, 1, 2, 2, 2], [3, 3], [4, 4], [5, 5], [6, 6]]
    assert [page[owners[0]][0] == MAIN for _, owners in told] == [False, True, False, True, False, True]
    assert all(len(tokens) == LONG for tokens, _ in told)


@pytest.mark.parametrize("many", [50_000, 1])
def test_articles_are_in_the_suffix_order(spark, many):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choices([f"v{k}" for k in range(400)], k=n))
    story, other, quote, menu = words(60), words(40), words(30), words(14)
    whole = lambda n, said: (n, "//h/a", f"<div>{menu}</div><article><p>{said}</p></article>")
    loose = lambda n, said, host="h": (n, f"//{host}/b", f"<div>{menu}</div><p>{said}</p>")
    rows = [whole(1, story), whole(2, f"{story} {words(5)}"), whole(3, quote), loose(4, story), loose(5, f"{other} {words(9)}"), loose(6, other),
            whole(7, other), loose(8, story, "elsewhere"), loose(9, f"{words(13)} {quote} {words(3)}"), whole(10, f"{words(9)} {menu}"),
            *some_pages()]
    table = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    host = lambda u: (re.search(r"//(?:[^/@]*@)?([^/:]*)", (u or "").lower()) or [0, ""])[1]
    truth = counts_by_brute_force([(host(u), p or "") for _, u, p in rows])
    result = main_text(table, many=many).collect()
    assert sorted(((r.page_id, r.url, r.n_repeated, r.n_quoted) for r in result), key=repr) == sorted(
        ((i, u, *t) for (i, u, _), t in zip(rows, truth)), key=repr)
    by_id = {r.page_id: r for r in result if r.url in ("//h/a", "//h/b", "//elsewhere/b")}
    assert by_id[1].text == story and by_id[7].text == other  # the check keeps what articles share
    assert by_id[6].text == "" and by_id[6].n_repeated >= 40  # distinct pages have it outside their articles
    assert by_id[8].text == f"{menu}\n{story}" and by_id[8].n_quoted == 0
    assert by_id[9].n_quoted == 30 and quote in by_id[9].text and by_id[4].n_quoted == 60 and story in by_id[4].text


def test_main_text_of_no_pages(spark):
    assert main_text(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")).collect() == []


def test_runs_hold_each_window_once():
    rng = np.random.default_rng(2)
    for size in (LONG, 40, 5000):
        tokens = rng.integers(0, 50, size).astype(np.uint64)
        assert [w for at, count, _ in runs(tokens) for w in range(at, at + count)] == list(range(size - LONG + 1))
    same = np.full(3000, 7, np.uint64)
    assert max(count for _, count, _ in runs(same)) <= 1024
    assert [len(w) for w in _repeated_windows([same[:20], same[:15]], np.array([1, 2]), np.array([1, 2]))] == [9, 4]


def test_registered_pages(spark, tables):
    result = {r.page_id: r for r in driver.queries()["op13_html_extraction"](spark, tables).collect()}
    pages = spark.read.parquet(f"{tables}/pages.parquet").collect()
    assert len(result) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?p>|</?h1>|<br>", article)]
        assert result[page.page_id].text == "\n".join(p for p in parts if p)
        assert result[page.page_id].url == page.url
