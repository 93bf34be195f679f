"""Operators on small tables against brute force, and the odd rows that each must bear."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm import embed_dedup, html_extract, licenses, minhash, mixing, piece_sampling, quality, quotes, repeats, token_store
from chronolith.llm.components import components
from chronolith.llm.minhash_core import shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size long, row string, `key` long, component string"


def odd_documents(spark, empty=False):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as operators name theirs."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f", "s", 1, "r", 5, "c"), (1, "a b c d e f", "s", 1, "r", 5, "c"), (1, "other text here", "s", 2, None, None, None), (2, None, None, None, None, None, None), (3, "", "t", 3, "x", 1, "y"), (None, "a b c d e f", "s", 4, "r", 2, "z"), (4, long, None, 5, "r", 3, "q"), (5, long, "t", 6, "r", 4, "q"), (6, " \n\t", "t", 7, "r", 4, "q")]
    return spark.createDataFrame([] if empty else rows, DOCS).repartition(3)


OPERATORS = {
    "mix": lambda d: mixing.mix(d),
    "mixed_documents": lambda d: mixing.mixed_documents(d),
    "token_store": lambda d: token_store.digest(token_store.write(d, token_store.tokenizer_path("word_bpe_49k.json"), 1)),
    "token_read": lambda d: token_store.read(token_store.write(d, token_store.tokenizer_path("word_bpe_49k.json"), 1)),
    "quotes": lambda d: quotes.linked(d.select("*", F.col("doc_id").alias("conv_id"), F.col("key").alias("turn"), F.col("source").alias("role"))),
    "pieces": lambda d: piece_sampling.encode(d, piece_sampling.model_path()),
    "repeats": lambda d: repeats.removed(d),
    "cleaned": lambda d: repeats.cleaned(d),
    "quality": lambda d: quality.assess(d),
    "quality_keep": lambda d: quality.keep(d),
    "pages": lambda d: html_extract.extract(d.select("*", F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))),
    "licenses": lambda d: licenses.scan(d),
    "minhash": lambda d: minhash.near_duplicates(d),
}


def by_id(rows, *names):
    return sorted(((r["doc_id"] if "doc_id" in r else r["page_id"]), *[r[n] for n in names]) for r in rows if (r["doc_id"] if "doc_id" in r else r["page_id"]) is not None)


LONG_BYTES = len(" ".join(f"word{i % 977}" for i in range(30_000)))
#: What the odd rows come to, by operator.
VALUES = {
    "mix": lambda rows: sorted((r.row.doc_id or 0, r["size"], r.taken <= 2 * r["size"]) for r in rows) == [(0, 6, True), (1, 3, True), (1, 6, True), (1, 6, True), (2, 0, True), (3, 0, True), (4, 30_000, True), (5, 30_000, True), (6, 0, True)],
    "mixed_documents": lambda rows: {r.doc_id for r in rows} <= {None, 1, 4, 5} and len(rows) > 0,
    "token_store": lambda rows: [n for i, n in by_id(rows, "n_tokens") if i in (2, 3, 6)] == [1, 1, 1] and len({r.ids_crc32 for r in rows if r.doc_id in (4, 5)}) == 1 and len({r.ids_crc32 for r in rows if r.doc_id in (1, None)}) == 2 and sorted(r.start for r in rows) == np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1].tolist(),
    "token_read": lambda rows: [ids for i, ids in by_id(rows, "ids") if i in (2, 3, 6)] == [[1]] * 3,
    "quotes": lambda rows: all(r.reply_conv is None and r.quote_depth == 0 for r in rows) and {r.thread_id for r in rows} == {None, 1, 2, 3, 4, 5, 6},
    "pieces": lambda rows: by_id(rows, "n_bytes", "round_trip") == [(1, 11, True), (1, 11, True), (1, 15, True), (2, 0, True), (3, 0, True), (4, LONG_BYTES, True), (5, LONG_BYTES, True), (6, 3, True)],
    "repeats": lambda rows: by_id(rows, "n_bytes", "n_removed", "n_spans") == [(1, 11, 0, 0), (1, 11, 0, 0), (1, 15, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, LONG_BYTES, 0, 0), (5, LONG_BYTES, LONG_BYTES, 1), (6, 3, 0, 0)],
    "cleaned": lambda rows: {r.doc_id: r.text for r in rows if r.doc_id in (2, 3, 5, 6)} == {2: None, 3: "", 5: "", 6: " \n\t"} and sorted(r.component or "" for r in rows) == ["", "", "c", "c", "q", "q", "q", "y", "z"],
    "quality": lambda rows: by_id(rows, "n_words", "kept") == [(1, 3, False), (1, 6, False), (1, 6, False), (2, 0, False), (3, 0, False), (4, 30_000, False), (5, 30_000, False), (6, 0, False)] and {r.longest_repeat for r in rows if r.doc_id == 4} == {30_000 - 977},
    "quality_keep": lambda rows: rows == [],
    "pages": lambda rows: by_id(rows, "n_chars") == [(1, 11), (1, 11), (1, 15), (2, 0), (3, 0), (4, LONG_BYTES), (5, LONG_BYTES), (6, 0)],
    "licenses": lambda rows: by_id(rows, "n_words", "n_base", "labels", "score", "first_word") == [(1, 3, 0, "", 0.0, None), (1, 6, 0, "", 0.0, None), (1, 6, 0, "", 0.0, None), (2, 0, 0, "", 0.0, None), (3, 0, 0, "", 0.0, None), (4, 30_000, 0, "", 0.0, None), (5, 30_000, 0, "", 0.0, None), (6, 0, 0, "", 0.0, None)],
    "minhash": lambda rows: by_id(rows, "n_shingles", "component_id", "kept") == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 977, 4, True), (5, 977, 4, False), (6, 0, 6, True)] and [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    docs = odd_documents(spark)
    out = OPERATORS[name](docs).collect()
    assert VALUES[name](out), [tuple(r) if len(str(r)) < 300 else str(r)[:300] for r in out]
    if name not in ("mixed_documents", "quality_keep"):
        assert len(out) == docs.count()
    assert OPERATORS[name](odd_documents(spark, empty=True)).collect() == []


def test_odd_vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("component", T.StringType())])
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, one, "x"), (1, one, "x"), (2, [2.0, 4.0, 6.0, 8.0], None), (3, None, "y"), (4, [], "y"), (5, [0.0] * 4, "y"), (6, [float("nan")] + one[1:], "y"), (7, [None, *one[1:]], "y"), (None, one, "y"), (8, [1.0, 2.0], "y"), (9, [-1.0, -2.0, -3.0, -4.0], None), (10, [1e38, 2e38, 3e38, 3.4e38], "z")]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert (1, 3, 1, True) in got and (2, 3, 1, False) in got and (3, 0, 3, True) in got and (None, 0, None, True) in got and (9, 0, 9, True) in got and (8, 0, 8, True) in got and (10, 3, 1, False) in got
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def water(sizes, weights, budget, most):
    """Targets by resharing until none is above its cap."""
    cap = {s: most * n for s, n in sizes.items()}
    target, open_sources, left = {}, set(sizes), budget
    while open_sources:
        total = sum(weights[s] for s in open_sources)
        over = {s for s in open_sources if left * weights[s] / total > cap[s]}
        if not over:
            target |= {s: left * weights[s] / total for s in open_sources}
            break
        for s in over:
            target[s] = float(cap[s])
            left -= cap[s]
        open_sources -= over
    return target


def test_mixing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["b", "a", "a", "a", "ü", None])) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["doc_id", "source"]).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(order, (5, 2, 1, 5), strict=True))
    target = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    words = {i: len(t.split()) for i, t, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == words[r.row.doc_id] and abs(r.target - target[r.row.source]) < 1e-6 * target[r.row.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.row.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1.5
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7), carry=["doc_id", "source"]).collect()
    assert {(r.row.doc_id, r.taken, r.position) for r in got} == {(r.row.doc_id, r.taken, r.position) for r in again}
    times = [r.position for r in got if r.position is not None]
    assert all(0 <= t <= 1 for t in times)
    # light sources grow over time, so the second in order begins later than the first on average
    mean = lambda s: np.mean([r.position for r in got if r.row.source == s and r.position is not None])
    assert mean("a") < mean("b") or mean("a") < mean("ü")


def test_schedule_inverse(spark):
    schedule = ((0.0, 1.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0))
    grid = np.linspace(0, 1, 20001)
    w = np.interp(grid, [t for t, _ in schedule], [v for _, v in schedule])
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
    shares = [0.01, 0.2, 0.4, 0.55, 0.8, 0.99]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.inverse(schedule, F.col("s")).alias("t")).collect()
    for s, r in zip(shares, got, strict=True):
        assert abs(np.interp(s * done[-1], done, grid) - r.t) < 1e-3


def test_token_store_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.tokenizer_path("word_bpe_49k.json"))
    start, want = 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    store = token_store.write(docs, token_store.tokenizer_path("word_bpe_49k.json"), 1)
    assert sorted(tuple(r) for r in token_store.digest(store).collect()) == want
    read = {r.doc_id: r.ids for r in token_store.read(store).collect()}
    assert all(zlib.crc32(np.array(read[i], "<u4").tobytes()) == c for i, _, _, c in want)


def brute_removed(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            s = b[p : p + least]
            first[s] = min(first.get(s, 2**63), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(5)
    pieces = lambda: [rng.choice(["a" * rng.randrange(0, 130), "ab" * 40, "The quick brown fox jumps over the lazy dog, again and again! ", "é" * 30, "common line that all of them have, sixty bytes or so here\n", "".join(rng.choice("abcdé \n") for _ in range(rng.randrange(0, 120)))]) for _ in range(rng.randrange(0, 6))]
    rows = [(rng.choice([i, i, i // 3]), rng.choice(["".join(pieces())] * 4 + [None])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in repeats.removed(df, hot=hot).collect()) == brute_removed(rows, 50)
    for r in repeats.cleaned(df, hot=hot).collect():
        assert r.text is None or r.text.encode().decode() == r.text


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(7, 7)]
    want = union_find({x for p in links if p[0] != p[1] for x in p}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash_against_brute_force(spark, size, percent):
    rng = random.Random(7)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(own)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B")]
    sets = {i: shingles((t or "").encode(), size) for i, t in rows}
    links = []
    for i in sets:
        for j in sets:
            if i < j and len(sets[i]) and len(sets[j]):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links.append((i, j))
    want = union_find(sets, links)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(8):
            own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t.encode(), 3) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and (lambda b: 100 * b >= 85 * (len(sets[i]) + len(sets[j]) - b))(len(np.intersect1d(sets[i], sets[j])))]
    want = union_find(sets, links)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def links_by_brute_force(vectors):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = x @ x.T >= 0.9
    np.fill_diagonal(grid, False)
    want = union_find(range(len(x)), np.argwhere(grid).tolist())
    return {i: (int(grid[i].sum()), want[i]) for i in range(len(x))}


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


@pytest.mark.parametrize(("width", "depth", "block"), [(64, None, 512), (64, 3, 8), (64, 4, 512), (384, 2, 512), (2048, 1, 512)])
def test_vectors_against_brute_force(spark, monkeypatch, width, depth, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(40 if width < 2048 else 15):
        c, spread = rng.normal(size=width), rng.choice([0.02, 0.1, 0.2, 0.35, 0.5])
        vectors += [(c + spread * rng.normal(size=width)).astype(np.float32) for _ in range(int(rng.choice([1, 3, 20, 60])))]
    vectors += [vectors[0]] * 30
    for _ in range(20):  # one large component and many small ones: 8 bits keep little of them
        head = np.zeros(width)
        head[0] = 0.3
        a, b = rng.normal(size=(2, width - 1))
        tail = (a, a + 0.3 * b)
        vectors += [np.concatenate([[np.linalg.norm(t) * rng.choice([1.0, 3.0])], t]).astype(np.float32) for t in tail]
    want = links_by_brute_force(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, depth=depth).collect()}
    assert sum(got[i] != want[i] for i in got) == 0


def test_crowd_with_strays_makes_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    counts = []
    for n in (400, 800, 1600):
        rows = [(7, i, 1 if i > 5 else i + 10, True, b"") for i in range(n)]
        entries = spark.createDataFrame(rows, "key long, rep long, grp long, own boolean, q binary")
        counts.append(embed_dedup._dealt(entries).count())
    assert counts[2] - counts[1] <= 2.2 * (counts[1] - counts[0])  # all pairs of blocks would make it four times
    assert counts[2] < 4 * 1600


def test_quotation_links(spark):
    first = "Shall we meet on Monday at noon?\n\nI will bring the cake."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", "> Shall we meet on Monday at noon?\nYes, Monday suits me well."),
        (1, 2, "user", "On Tuesday B wrote:\n> > Shall we meet on Monday at noon?\n> Yes, Monday suits me well.\n\nFine then, see you at the station."),
        (2, 0, "user", "> I will bring   the CAKE.\nWhat cake is it going to be?"),
        (3, 0, "user", "> Nobody ever wrote this line here\nReally nobody?"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    link = {k: (r.reply_conv, r.reply_turn) for k, r in got.items()}
    assert link == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 0), (3, 0): (None, None)}
    assert got[(2, 0)].thread_id == 1 and got[(3, 0)].thread_id == 3
    assert got[(1, 2)].text == "Fine then, see you at the station." and got[(1, 2)].quote_depth == 2
    assert got[(1, 1)].formatted == "<|assistant|>\nYes, Monday suits me well.\n"


def test_quotation_links_of_deep_short_and_part_quotes(spark):
    rows = [
        (1, 0, "user", "Where do we meet this time? I will bring the cake to the station."),
        (1, 1, "assistant", "ok, Monday"),
        (1, 2, "user", "> ok, Monday\nGood."),
        (1, 3, "user", "> > Where do we meet this time? I will bring the cake to the station.\nAt noon."),
        (2, 0, "user", "> I will bring the cake to the station.\nWhich cake is it?"),
        (3, 0, "user", "> ok, Monday\nNo answer to another conversation."),
        (1, 4, "user", "> ok, Monday\n> > Where do we meet this time? I will bring the cake to the station.\nFine."),
    ]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (None, None), (1, 1): (None, None), (1, 2): (1, 1), (1, 3): (1, 0), (2, 0): (1, 0), (3, 0): (None, None), (1, 4): (1, 1)}


def quotation_by_brute_force(rows):
    """Replies by comparing every quoted passage with all messages, in plain loops."""
    said = lambda text, level: {q for run in _runs(text, level) for q in _parts(run)}
    depth = lambda line: len(line) - len(line.lstrip("> ")) and line[: len(line) - len(line.lstrip("> "))].count(">")

    def _runs(text, level):
        out, last = [], None
        lines = text.split("\n")
        marked = any(depth(x) for x in lines)
        for i, line in enumerate(lines):
            k = depth(line)
            if k == level and not (level == 0 and marked and line.endswith("wrote:") and i + 1 < len(lines) and depth(lines[i + 1])):
                if level and last != k:
                    out.append([])
                elif not level and not out:
                    out.append([])
                out[-1].append(line.lstrip("> ") if level else line)
            last = k
        return out

    def _parts(run):
        flat = lambda x: " ".join(x.split()).lower()
        yield flat(" ".join(run))
        for paragraph in "\n".join(run).split("\n\n"):
            yield flat(paragraph)
            yield from (flat(line) for line in paragraph.split("\n"))
            yield from re.split(r"(?<=[.!?])\s+", flat(paragraph))

    own = [{p for p in said(t, 0) if p} for *_, t in rows]
    answers = {}
    for conv, turn, _, text in rows:
        votes, seen = {}, set()
        for level in (1, 2, 3):
            for p in said(text, level) - seen - {""}:
                seen.add(p)
                here = [t for (c, t, *_), o in zip(rows, own, strict=True) if c == conv and p in o]
                anywhere = [(c, t) for (c, t, *_), o in zip(rows, own, strict=True) if p in o and len(p) >= quotes.LEAST_CHARS]
                target = (conv, min(here)) if here and min(here) < turn else min(anywhere) if anywhere and min(anywhere) < (conv, turn) else None
                if target:
                    votes[(level, target)] = votes.get((level, target), 0) + len(p)
        best = min(votes, key=lambda v: (v[0], v[1][0] != conv, -votes[v], v[1]), default=None)
        answers[(conv, turn)] = best[1] if best else None
    return answers


def test_quotations_against_brute_force(spark):
    rng = random.Random(11)
    words = "red green blue big small old new cat dog bird tree house river road went came saw met".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9]))).capitalize() + rng.choice(".!?")
    rows, told = [], []
    for conv in range(12):
        for turn in range(rng.randrange(2, 9)):
            lines = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                if told:
                    quoted = rng.choice(told[-12:])
                    part = rng.choice([quoted, quoted.split("\n")[0], quoted.split("\n")[-1]])
                    level = rng.choice([1, 1, 2, 3])
                    if rng.random() < 0.3:
                        lines.append("On Monday Ann wrote:")
                    lines += ["> " * level + x for x in part.split("\n") if x]
            lines.append(" ".join(sentence() for _ in range(rng.choice([1, 2]))))
            if rng.random() < 0.3:
                lines += ["", sentence()]
            rows.append((conv, turn, "user", "\n".join(lines)))
            told.append("\n".join(x for x in lines if not x.startswith(">") and not x.endswith("wrote:")).strip())
    want = quotation_by_brute_force(rows)
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) if r.reply_conv is not None else None for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert sum(v is not None for v in want.values()) > 20 and got == want


def test_inclusion_scores_of_whole_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(12).union(spark.createDataFrame([(-1, "an"), (-2, ""), (-3, None)], "doc_id long, text string"))
    model = piece_sampling.model_path()
    two, three = ({r.doc_id: r.samples for r in piece_sampling.encode(docs, model, k=k).collect()} for k in (2, 3))
    import math

    lattices = piece_sampling.Lattices(model)
    for i, own in two.items():
        assert [s.ids for s in own] == [s.ids for s in three[i][:2]]
        weights = [sum(lattices.weight[x] for x in s.ids) for s in three[i]]
        for s, w in zip(three[i], weights, strict=True):  # the same normaliser for every segmentation of a text
            assert abs((s.log_prob - w) - (three[i][0].log_prob - weights[0])) < 1e-3 * max(1.0, abs(w))
        for s in own:  # the chance that its own variable exceeds the next in line
            want = -math.expm1(-math.exp(s.log_prob - three[i][2].perturbed)) if len(three[i]) > 2 else 1.0
            assert abs(s.inclusion - want) < 1e-9


def test_licences_of_whole_rows(spark):
    import math

    rng = random.Random(2)
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "LicenseRef-Proprietary", "Artistic-2.0", "OFL-1.1", "BSD-3-Clause"]

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names) + rng.choice(["", "", " WITH Classpath-exception-2.0"])
        inner = f"{expression(depth - 1)} {rng.choice(['AND', 'OR'])} {expression(depth - 1)}"
        return f"({inner})" if rng.random() < 0.5 else inner

    phrases = [*licenses.BASE, *licenses.NOTICES, "some words", "mit", "license", "copyright"]
    rows = []
    for i in range(120):
        parts = [rng.choice(phrases).title() for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.5:
            parts.append("SPDX-License-Identifier: " + expression(rng.randrange(0, 4)))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(200, "SPDX-License-Identifier: MIT AND LicenseRef-Proprietary"), (201, "SPDX-License-Identifier: Artistic-2.0 AND GPL-3.0-only"), (202, "SPDX-License-Identifier: OFL-1.1"), (203, "SPDX-License-Identifier: MIT OR Artistic-2.0"), (204, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND OFL-1.1")]

    def judged(text):
        """A recursive parser of the whole expression: labels and whether permissive terms may be chosen."""
        tokens = re.findall(r"[()]|[^\s()]+", text.lower())

        def atom():
            t = tokens.pop(0)
            if t == "(":
                out = either()
                assert tokens.pop(0) == ")"
                return out
            known = [(label, free) for start, label, free in licenses.FAMILIES if t == start or t.startswith(start + "-")]
            out = ({known[0][0]}, known[0][1]) if known else ({t}, False)
            if tokens[:1] == ["with"]:
                del tokens[:2]
            return out

        def both():
            out = atom()
            while tokens[:1] == ["and"]:
                tokens.pop(0)
                labels, free = atom()
                out = out[0] | labels, out[1] and free
            return out

        def either():
            out = both()
            while tokens[:1] == ["or"]:
                tokens.pop(0)
                labels, free = both()
                out = out[0] | labels, out[1] or free
            return out

        out = either()
        assert not tokens
        return out

    def brute(text):
        words = re.findall(r"[0-9a-z]+", text.lower())
        has = lambda p: any(words[k : k + len(p.split())] == p.split() for k in range(len(words)))
        base = {label for p, label in licenses.BASE.items() if has(p)}
        tags = [judged(m) for m in re.findall(r"SPDX-License-Identifier: (.*)", text)]
        labels = base | {label for p, (label, _) in licenses.NOTICES.items() if has(p)} | {x for own, _ in tags for x in own}
        doubt = math.prod([1 - licenses.BASE_WEIGHT for p in licenses.BASE if has(p)] + [1 - w for p, (_, w) in licenses.NOTICES.items() if has(p)] + [1 - licenses.TAG_WEIGHT for _ in tags])
        return ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6), all(free for _, free in tags) if tags else None

    got = {r.doc_id: (r.base_labels, r.labels, r.score, r.permissive) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == brute(text), text
    assert got[200][1:] == ("licenseref-proprietary,mit", 0.95, False) and got[203][3] is True and got[204][3] is False


def test_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(30)
    model = piece_sampling.model_path()
    encoded = piece_sampling.encode(docs, model, k=2)
    assert all(r.round_trip and len(r.samples) == 2 for r in encoded.collect())
    flat = encoded.select("doc_id", F.col("samples")[1]["ids"].alias("ids"))
    assert {(r.doc_id, r.text) for r in piece_sampling.decode(flat, model).collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_copies_of_a_row_have_samples_of_their_own(spark):
    text = "Several copies of one text, each sampled anew. ▁ stays ▁."
    docs = spark.createDataFrame([(1, text)] * 6 + [(None, text)] * 3 + [(2, None)] * 2, "doc_id long, text string")
    model = piece_sampling.model_path()
    got = [sorted((r.doc_id or 0, r.round_trip, str(r.samples)) for r in piece_sampling.encode(piece_sampling.numbered(docs.repartition(n)), model, copy="copy").collect()) for n in (1, 5)]
    assert got[0] == got[1] and all(ok for _, ok, _ in got[0])
    assert len({s for i, _, s in got[0] if i == 1}) == 6 and len({s for i, _, s in got[0] if i == 0}) == 3
    assert piece_sampling.numbered(docs.limit(0)).collect() == []
    plain = piece_sampling.encode(docs.filter("doc_id = 1"), model).collect()
    assert len({str(r.samples) for r in plain}) == 1


def test_near_duplicates_of_words_that_defeat_polynomial_hashes(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(1, "".join("ab"[x] for x in bits)), (2, "".join("ba"[x] for x in bits))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True)}


def test_made_words_are_told_apart(spark):
    """Words that collide under a known key: all documents keep their own ids, pieces and sets."""
    from tokenizers import Tokenizer

    texts = [" ".join([w] * 3 + ["of the same words as before and then some more of them"]) for w in ("il5pj3joabcdefgh", "qqpefcog1xok70eo")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    path = token_store.tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in token_store.read(token_store.write(docs, path)).collect()}
    assert got == {i: whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert [r.kept for r in minhash.near_duplicates(docs, size=1, percent=99).orderBy("doc_id").collect()] == [True, True]
    assert all(r.round_trip for r in piece_sampling.encode(docs, piece_sampling.model_path()).collect())


def test_repeats_send_a_row_a_group_and_bucket(spark):
    """Chunks in a row share what they send, so rows don't grow with chunks times buckets; answers find their chunk."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(10_000)) for _ in range(60)]
    rows = [(i, t + texts[i // 3][500 * (i % 7) : 500 * (i % 7) + 300] + t[:80]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    chunks = repeats.chunked(df).persist()
    assert chunks.count() >= 6
    asked = repeats._questions(chunks, 50, 8).groupBy("bucket").count().collect()
    assert len(asked) == 8 and {r["count"] for r in asked} == {1}
    chunks.unpersist()
    assert sorted(tuple(r) for r in repeats.removed(df).collect()) == brute_removed(rows, 50)
