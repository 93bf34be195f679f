"""Token counts, hard negatives and the Merkle manifest: whole tables and odd rows against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm import hard_negatives, merkle, queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = token_counts.tokenizer_path()
DOCS = "doc_id long, text string, source string, lang string, n_chars long, `row` string, pre_token string, pos long, grp string"


def odd_documents(spark, empty=False):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    long = " ".join(f"Word{i % 977}" for i in range(30_000))
    rest = ("r", "p", 5, "g")
    rows = [(1, "A b <|endoftext|> c", "s", "en", 1, *rest)] * 2 + [(1, "other TEXT", "s", "en", 2, None, None, None, None), (2, None, None, None, None, *rest), (3, "", "t", None, 3, *rest), (None, "A b", "s", "en", 4, *rest), (None, "B", "s", "en", 4, *rest), (4, long, None, "de", 5, *rest), (5, long, "t", "é", 6, *rest), (6, " \n\t", "t", "", 7, *rest), (7, "漢字\x85 ་", "t", "de", 8, *rest)]
    return spark.createDataFrame([] if empty else rows, DOCS).repartition(3)


# token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


def test_token_counts_of_whole_tables(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, len((r.text or "").encode()), n := library(r.text), n > 1024) for r in docs.collect())
    assert sorted(map(tuple, queries.op11_token_counts(spark, SF).collect())) == want
    for head in (0, 50):  # with no or few broadcast pre-tokens the rest is joined
        assert sorted(map(tuple, token_counts.token_counts(docs, PATH, head=head).collect())) == want


def test_token_counts_of_odd_rows(spark, library):
    docs = odd_documents(spark)
    out = token_counts.token_counts(docs, PATH, limit=5, head=3)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((r.doc_id, len((r.text or "").encode()), n := library(r.text), n > 5) for r in docs.collect()), key=key)
    assert token_counts.token_counts(odd_documents(spark, empty=True), PATH).collect() == []


@pytest.mark.parametrize("stretch", [1 << 22, 6])
def test_pre_tokens_are_the_librarys(monkeypatch, stretch):
    from tokenizers import Tokenizer, pre_tokenizers

    monkeypatch.setattr(token_counts, "STRETCH", stretch)
    tokens = token_counts.PreTokens(token_counts.special_strings(PATH), token_counts._odd())
    whole, special = pre_tokenizers.ByteLevel(add_prefix_space=False), "<|endoftext|>"
    letters = [" ", " ", "  ", "a", "b", "'s", "'", "1", "!", "\n", "\t", "　", "\xa0", "é", special, "<|", "₏", "漢", "\x1c", "\x85", "'ll", " the", "\U00010ec5", "\U000e0001", "꟎", "​", " "]
    draw = random.Random(5)
    for _ in range(8000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 14)))
        got = Counter()
        for part in tokens.parts(text):
            cut = tokens.words(part)
            got.update(tokens.whole(part) if cut is None else [x for i, w in enumerate(cut) for x in tokens.find(" " * (i > 0) + w)])
        want = Counter(part[a:b] for part in text.split(special) for _, (a, b) in whole.pre_tokenize_str(part))
        assert got == want and tokens.n_specials(text) == text.count(special), repr(text)
    bare = token_counts._bare(PATH)
    assert len(bare.encode(" the", add_special_tokens=False)) == len(Tokenizer.from_file(PATH).encode(" the", add_special_tokens=False)) == 1


def test_characters_that_are_sorted_in_two_ways_go_to_the_library():
    """Every character of the first four planes, in another setting than the one that finds the differences."""
    from tokenizers import pre_tokenizers

    tokens = token_counts.PreTokens([], token_counts._odd())
    whole = pre_tokenizers.ByteLevel(add_prefix_space=False)
    some = [c for c in range(0x80, 0x40000, 7) if not 0xD800 <= c < 0xE000 and not tokens.odd(chr(c))]
    for i in range(0, len(some), 500):
        text = "".join(f"x{chr(c)}{chr(c)} {chr(c)}9\n{chr(c)}?" for c in some[i : i + 500])
        assert tokens.whole(text) == Counter(text[a:b] for _, (a, b) in whole.pre_tokenize_str(text))


def test_only_plain_files_are_counted():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.special_strings(token_counts.tokenizer_path("word_bpe_49k.json"))


def test_long_texts_are_counted_in_stretches(library):
    tokens = token_counts.PreTokens(token_counts.special_strings(PATH), token_counts._odd())
    text = ("ab cd, efg 12\n" * 400_000) + "x" * 100_000
    parts = list(tokens.parts(text))
    assert len(parts) > 1 and "".join(parts) == text and all(p.startswith(" ") for p in parts[1:])


# hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("positives", T.StringType())])


def brute_negatives(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=10):
    taking = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(e is None or not math.isfinite(e) for e in x):
            continue
        own = ([math.floor(256 * float(e)) for e in x], (label + 1) % 10 if i % 7 == 0 else label)
        taking[i] = min(taking.get(i, own), own, key=lambda o: (len(o[0]), o[1], np.array(o[0], "<f8").tobytes()))
    score = lambda x, y: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True))))
    out = []
    for i, (x, label) in taking.items():
        if not anchor(i):
            continue
        others = sorted((-score(x, y), j, b) for j, (y, b) in taking.items() if j != i and len(y) == len(x))
        for s, p in [(-s, j) for s, j, b in others if b == label][:positives]:
            for r, (n, j) in enumerate([(-n, j) for n, j, b in others if b != label and 30 * s <= -100 * n <= 90 * s][:negatives]):
                out.append((i, p, r + 1, j, s, n))
    return sorted(out)


def test_negatives_of_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=6) / 2).tolist(), int(draw.integers(3))) for i in range(320)]
    rows += [(400, [0.0] * 6, 1), (500, [1e17] * 6, 1), (501, [1e17] * 6, 1), (502, [5e16] * 6, 2), (600, [3e3] * 6, 1), (601, [3e3] * 6, 1), (602, [2e3] * 6, 2)]  # zero, beyond 64 bits, large
    rows += [(700, [], 1), (701, [], 1), (703, [], 2), (800, [0.5, 0.5], 1), (801, [0.5, 0.4], 1), (802, [0.3, 0.2], 2)]  # other widths
    rows += [(900, None, 1), (1000, [None] * 6, 1), (1100, [math.nan] * 6, 1), (1200, [math.inf] * 6, 1), (1300, [0.1] * 6, None), (None, [0.1] * 6, 1)]  # no part
    rows += [(1400, [0.3] * 6, 1), (1400, [0.3] * 6, 1), (1400, [0.2] * 6, 1)]  # one id
    rows += [(2000 + i, [0.5] * 6, i % 2) for i in range(60)]  # ties
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    got = sorted(map(tuple, hard_negatives.mine(table, label=hard_negatives.shifted()).collect()))
    assert got == brute_negatives(rows) and {r[0] for r in got} >= {0, 100, 600, 700, 800, 1400, 2000}
    assert hard_negatives.mine(table.filter("vec_id < 0")).collect() == hard_negatives.mine(table.filter("vec_id % 100 > 0")).collect() == []


def test_negatives_over_many_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 4000)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    table = spark.createDataFrame([(i, x and [float(e) for e in x], b, "x", "y") for i, x, b in rows], VECTORS)
    got = sorted(map(tuple, hard_negatives.mine(table, "vec_id % 10 = 0", hard_negatives.shifted()).collect()))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(3000, 32)) * 40)
    cells, edges = hard_negatives.approximated(x)
    ids = np.arange(len(x)).astype("<i8")
    block = hard_negatives.Block(32, ids.tobytes(), ids.tobytes(), cells.tobytes(), edges.astype("<f8").tobytes(), x.astype("<f8").tobytes())
    a = x[:9]
    low, high = block.bounds(a)
    exact = a @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    cut = np.partition(low, -5, axis=1)[:, -5:].min(axis=1, keepdims=True)
    assert (high >= cut).mean() < 0.05  # few rows are scored for the first five
    assert block.bounds(a * 1e300)[1].min() >= -1e308


def test_windows_of_any_sign():
    for s in range(-50, 51):
        least, most = hard_negatives.window(s, 30, 90)
        assert [n for n in range(-60, 61) if 30 * s <= 100 * n <= 90 * s] == [n for n in range(-60, 61) if least <= n <= most]


# Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t if t is None else "".join(c.lower() if c.isascii() else c for c in t)
    leaf = lambda r, t: H("".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, t)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda x: x[0]) for g in order}
    trees = {g: climb([k[2] for k, _ in own[g]]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, ((_, _, digest), r) in enumerate(own[g]):
            fold = leaf(r, low(r.text)) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else digest
            proof = ""
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    first = at - at % 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    fold, proof, at = H(left + fold + right), proof + left + right, at // 8
            out.append((r.doc_id, digest, trees[g][-1][0], top[-1][0], H(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, top", [(4, 4096), (1, 5), (2, 9)])
def test_manifest(spark, monkeypatch, levels, top):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", merkle.ARITY**levels)
    monkeypatch.setattr(merkle, "TOP", top)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, merkle.tampered(docs).collect()), key=repr)
    assert got == brute_manifest(docs.collect()) and 0 < sum(r[-1] for r in got) < len(got)
    odd = odd_documents(spark)
    assert sorted(map(tuple, merkle.tampered(odd).collect()), key=repr) == brute_manifest(odd.collect())


def test_manifest_of_many_groups(spark, monkeypatch):
    """More groups than the driver's top: their order is numbered and reduced in tasks as well."""
    for name, value in (("LEVELS", 1), ("SPAN", 8), ("TOP", 6)):
        monkeypatch.setattr(merkle, name, value)
    rows = [(i, f"Text {i}", "s", f"l{i % 150}" if i % 2 else "en" if i % 3 else None, i, "r", "p", 1, "g") for i in range(260)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(map(tuple, merkle.tampered(docs).collect()), key=repr) == brute_manifest(docs.collect())


def test_manifest_of_nothing_one_row_and_one_group(spark):
    assert merkle.tampered(odd_documents(spark, empty=True)).collect() == []
    one = odd_documents(spark).filter("doc_id = 4")
    (row,) = merkle.tampered(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H("")
    plain = merkle.manifest(odd_documents(spark), fields=("doc_id", "text"), group="source").collect()
    assert all(r.verified for r in plain) and len({r.subroot for r in plain}) == 3


def test_manifest_finds_a_changed_field(spark):
    docs = odd_documents(spark)
    changed = F.when(F.col("doc_id") == 3, merkle.leaf({"doc_id": F.col("doc_id"), "source": F.lit("other"), "lang": F.col("lang"), "n_chars": F.col("n_chars"), "text": F.col("text")}))
    assert {r.doc_id for r in merkle.manifest(docs, changed).collect() if not r.verified} == {3}
