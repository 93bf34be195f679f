"""NumPy cores against brute force."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm import embed_dedup, html_extract, licenses, piece_sampling, quality, quotes, repeats, token_store
from chronolith.llm.common import HashIndex, span_hashes
from chronolith.llm.crosspolytope import codes, hadamard, met, rotate, tables_for
from chronolith.llm.minhash_core import shingles, sketches
from chronolith.llm.suffix_core import intervals, neighbour_lcp, suffix_array


def shared(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=3))
def test_suffix_array_lcp_and_intervals(docs):
    symbols = np.array([x for d in docs for x in d], np.int64)
    if not len(symbols):
        return
    ends = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
    order, levels = suffix_array(symbols, ends)
    suffixes = [tuple(symbols[i : ends[i]]) for i in range(len(symbols))]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    lcp = [0] + [shared(suffixes[order[i - 1]], suffixes[order[i]]) for i in range(1, len(order))]
    assert neighbour_lcp(order, levels, ends).tolist() == lcp
    found = list(intervals(np.array(lcp), 1))
    want = set()
    for i in range(len(order)):
        for j in range(i + 1, len(order)):
            m = min(lcp[i + 1 : j + 1])
            if m >= 1 and lcp[i] < m and (j + 1 >= len(order) or lcp[j + 1] < m):
                want.add((m, i, j))
    assert set(found) == want and len(found) == len(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=3))
def test_maximal_repeats(texts):
    data = [t.encode() for t in texts]
    found = {(n, tuple(places)) for n, places in repeats.maximal_repeats(data, 2)}
    places = defaultdict(list)
    for d, t in enumerate(data):
        for i in range(len(t)):
            for j in range(i + 2, len(t) + 1):
                places[t[i:j]].append((d, i))
    want = set()
    for s, own in places.items():
        if len(own) < 2:
            continue
        after = {data[d][i + len(s) : i + len(s) + 1] or (d, i) for d, i in own}
        before = {data[d][i - 1 : i] if i else (d, i) for d, i in own}
        if len(after) > 1 and len(before) > 1:
            want.add((len(s), tuple(sorted(own))))
    assert found == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab #\n\x0b é", max_size=60), max_size=3))
def test_quality_counts(texts):
    data = [t.encode() for t in texts]
    got = quality.assess_texts(data)
    for k, t in enumerate(texts):
        words = data[k].split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        longest = 0
        for i in range(len(words)):
            for j in range(i):
                longest = max(longest, shared(words[i:], words[j:]))
        assert got["n_words"][k] == len(words)
        assert got["word_chars"][k] == sum(len(w.decode()) for w in words)
        assert got["n_symbols"][k] == sum(c in "#*$%&|<>" for c in t)
        assert got["n_dup_lines"][k] == len(lines) - len(set(lines))
        assert got["n_repeat_words"][k] == len(repeated)
        assert got["longest_repeat"][k] == longest
        assert got["base_failed"][k] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_quality_rejects_long_repeats():
    part = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    got = quality.assess_texts([f"{part} x {part}".encode(), f"{part} {other}".encode()])
    assert got["longest_repeat"].tolist() == [60, 0]
    assert got["kept"].tolist() == [False, True]


def test_hash_index():
    rng = np.random.default_rng(0)
    index, known = HashIndex(4), {}
    for step in range(20):
        h = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64) | np.uint64(step % 3))
        h = h[[x not in known for x in h.tolist()]]
        index.insert(h, np.arange(len(known), len(known) + len(h)))
        known |= {int(x): len(known) + i for i, x in enumerate(h.tolist())}
        assert index.find(np.array(list(known), np.uint64)).tolist() == list(known.values())
    assert (index.find(rng.integers(0, 2**63, 100).astype(np.uint64)) == -1).all()


def thue_morse(n, a="a", b="b"):
    """Words that collide under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_span_hashes():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 99, 4000).astype(np.uint8))
    starts = rng.integers(0, 3900, 20_000)
    ends = starts + np.where(rng.random(20_000) < 0.9, rng.integers(0, 30, 20_000), rng.integers(0, 100, 20_000))
    seen = defaultdict(set)
    for s, e, h in zip(starts.tolist(), ends.tolist(), span_hashes(data, starts, ends).tolist(), strict=True):
        seen[data[s:e]].add(h)
    assert all(len(v) == 1 for v in seen.values())
    assert len({h for v in seen.values() for h in v}) == len(seen)
    assert span_hashes(b"", np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("n", [3, 6, 11, 12])
def test_words_that_defeat_polynomial_hashes(lattices, n):
    x, y = thue_morse(n)
    encoder = token_store.WordEncoder(token_store.tokenizer_path("word_bpe_49k.json"))
    for t in (x, y):
        assert encoder.encode([t.encode()])[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert not set(shingles(x.encode(), 3).tolist()) & set(shingles(y.encode(), 3).tolist())
    u, v = (" ".join(f"{'x' if c == 'a' else 'y'}" for c in t) for t in (x, y))
    assert len(shingles(u.encode(), len(x))) == 1 and shingles(u.encode(), len(x)).tolist() != shingles(v.encode(), len(x)).tolist()
    for own, t in zip(piece_sampling.sample(lattices, [x.encode(), y.encode()], [1, 2], 2, 1), (x, y), strict=True):
        assert all(lattices.decode(s[0]) == b" " + t.encode() for s in own)


ODD = ["", "  ", "a b c d\x1cE", "é ́x İ İSTANBUL", "it's we'll 'S ''s .,", "<|endoftext|>x <|startoftext|> y", "日本 語１２３ 𝟘 x²", "\u0085a\x0bb\x0cc", "ΣΑΣ Σ", "ﬁ ½ " * 50, "Straße, Élan. ÈÀ.", "\x01 a\x01b", "end.\n", "x" * 3000]


def test_word_encoder_is_exact():
    encoder = token_store.WordEncoder(token_store.tokenizer_path("word_bpe_49k.json"))
    for texts in (ODD, ODD[::-1], [""], []):
        ids, lengths = encoder.encode([t.encode() for t in texts])
        stops = np.cumsum(lengths)
        for t, stop, n in zip(texts, stops, lengths, strict=True):
            assert ids[stop - n : stop].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_directly_addressable_codes(values):
    ids = np.array(values, np.uint32)
    block = token_store.Block(token_store.pack([7, None], np.array([len(ids) // 2, len(ids) - len(ids) // 2]), ids))
    assert block.doc_ids == [7, None] and block.decode().tolist() == values
    assert [block.access(i) for i in range(len(ids))] == values


@pytest.fixture(scope="module")
def lattices():
    return piece_sampling.Lattices(piece_sampling.model_path())


def segmentations(lattices, text):
    vocabulary = {lattices.model.id_to_piece(i).replace("▁", " "): i for i in range(lattices.model.get_piece_size()) if lattices.text_length[i] and not lattices.model.is_byte(i)}

    def every(u):
        if not u:
            return [((), 0.0)]
        out = []
        for n in range(1, len(u) + 1):
            if u[:n] in vocabulary:
                out += [((vocabulary[u[:n]], *s), w + lattices.weight[vocabulary[u[:n]]]) for s, w in every(u[n:])]
        if u[0] not in vocabulary:
            ids = tuple(lattices.bytes_at[b] for b in u[0].encode())
            out += [(ids + s, w + sum(lattices.weight[i] for i in ids)) for s, w in every(u[1:])]
        return out

    found = every(" " + text)
    total = np.logaddexp.reduce([w for _, w in found])
    return {s: math.exp(w - total) for s, w in found}


def test_samples_follow_the_distribution(lattices):
    text, n = "then\nit", 3000
    p = segmentations(lattices, text)
    first, second, mass = Counter(), Counter(), 0.0
    for own in piece_sampling.sample(lattices, [text.encode()] * n, list(range(n)), 3, 1):
        seqs = [tuple(int(x) for x in s[0]) for s in own]
        assert len(set(seqs)) == len(seqs)
        assert all(abs(math.exp(s[1]) - p[q]) < 1e-4 for s, q in zip(own, seqs, strict=True))
        assert [s[2] for s in own] == sorted((s[2] for s in own), reverse=True)
        first[seqs[0]] += 1
        second[seqs[1]] += 1
        mass += sum(p[q] / s[3] for s, q in zip(own, seqs, strict=True))
    assert abs(mass / n - 1) < 0.02  # inclusion scores make the estimate of the whole unbiased
    for s in sorted(p, key=p.get, reverse=True)[:3]:
        assert abs(first[s] / n - p[s]) < 0.03
        assert abs(second[s] / n - sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)) < 0.04


def test_samples_do_not_depend_on_company(lattices):
    texts = [b"", b"abc\n", b"\n", b"", b"x y\n\n", b" ", b"foo, bar.\n", b"\x00a\x00", "é▁ü\n😀".encode(), b"\n\n a"]
    together = piece_sampling.sample(lattices, texts, list(range(len(texts))), 3, 1)
    for i, (t, own) in enumerate(zip(texts, together, strict=True)):
        alone = piece_sampling.sample(lattices, [t], [i], 3, 1)[0]
        assert [s[0].tolist() for s in own] == [s[0].tolist() for s in alone]
        assert all(lattices.decode(s[0]) == (b" " + t if t else b"") for s in own)


def test_all_segmentations_of_a_short_text(lattices):
    p = segmentations(lattices, "an")
    own = piece_sampling.sample(lattices, [b"an"], [1], 99, 1)[0]
    assert {tuple(int(x) for x in s[0]) for s in own} == set(p)
    assert all(s[3] == 1.0 for s in own)


def test_hadamard_rotation_keeps_lengths_and_hashes_agree():
    x = np.random.default_rng(1).normal(size=(50, 48))
    assert np.allclose(np.linalg.norm(rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    eye = hadamard(np.eye(8))
    assert np.allclose(eye @ eye.T, 8 * np.eye(8))
    assert (codes(x, 3, 2, 4) == codes(x, 3, 2, 4)).all()
    assert (codes(x, 3, 2, 4)[:, :, 0] == codes(2 * x, 3, 2, 1)[:, :, 0]).all()


@pytest.mark.parametrize(("width", "depth"), [(64, 2), (64, 3), (64, 4), (384, 2), (384, 3), (384, 4), (4096, 2)])
def test_pairs_at_the_threshold_meet(width, depth):
    probes, n = embed_dedup.PROBES[depth], 300 if width < 4096 else 40
    tables = tables_for(width, depth, probes, 0.9, embed_dedup.MISS)
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=(2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    assert met(codes(x, tables, depth, probes), codes(y, tables, depth, probes)).any(axis=1).all()


@pytest.mark.parametrize("width", [2, 64, 384, 4096])
def test_rounded_vectors_bound_the_cosine(width):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, width))
    x[::3, 0] *= 40  # one large component
    x[1::3] = x[::3] + 0.2 * rng.normal(size=(20, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, e = embed_dedup._rough(embed_dedup._small(x))
    assert (embed_dedup._at_most(a @ a.T, e[:, None], e[None, :], width) >= x @ x.T).all()
    assert (embed_dedup._at_most(a @ a.T, e[:, None], e[None, :], width) - x @ x.T).mean() < 2.5


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(base[:300]), np.unique(base[100:400]), base[:1], base[:0]]
    s = sketches(sets, 512)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08
    assert (s[2] > 0).all() and (s[3] == 0).all()
    assert (sketches(sets[2:3], 512) == s[2:3]).all()


def test_shingles():
    assert len(shingles(b"", 3)) == 0 and len(shingles(b" \n", 3)) == 0
    assert shingles(b"A b", 3).tolist() == shingles(b"a\tB", 3).tolist() != shingles(b"b a", 3).tolist()
    assert len(shingles(b"a b c d a b c", 3)) == 4


def test_licence_expressions():
    parse = licenses.postfix
    assert parse("mit or (apache-2.0 and gpl-2.0+ with classpath-exception-2.0)") == ["mit", "apache-2.0", "gpl-2.0+", "classpath-exception-2.0", "with", "and", "or"]
    assert parse("(mit") is None and parse("") is None and parse("or mit") is None
    assert parse("mit. The rest") == ["mit"]
    assert licenses.evaluate(parse("mit or gpl-3.0-only")) == ({"mit", "gpl"}, True)
    assert licenses.evaluate(parse("mit and gpl-3.0-only")) == ({"mit", "gpl"}, False)


def brute_licence(text):
    import regex

    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "License.", "apache", "cc", "by", "CC-BY", "GNU", "general", "public", "é", "—", "x1", "\n", "  "]), max_size=30).map(" ".join))
def test_licence_places(text):
    got = licenses.Scanner().scan(text.encode())
    assert got[:5] == brute_licence(text)
    assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))
    assert 0 <= got[6] <= 1


def test_licence_tag_adds_labels():
    got = licenses.Scanner().scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\nCC BY")
    assert got[4] == "cc-by" and got[5] == "apache,cc-by,mit" and got[7] is True


def test_licence_ids_of_no_known_family():
    scan = licenses.Scanner().scan
    for name in ("CDDL-1.0", "OFL-1.1", "Artistic-2.0", "EUPL-1.2", "LicenseRef-Own", "DocumentRef-a:LicenseRef-b"):
        got = scan(f"// SPDX-License-Identifier: {name} */".encode())
        assert got[5:] == (name.lower(), 0.95, False, [name.lower()]) and got[4] == ""
        assert scan(f"# SPDX-License-Identifier: MIT AND {name}".encode())[7:] == (False, [f"mit {name.lower()} and"])
        assert scan(f"# SPDX-License-Identifier: {name} OR MIT".encode())[7] is True
    assert scan(b"SPDX-License-Identifier: NOASSERTION")[5:] == ("", 0.95, None, [])


def test_pages():
    page = '<html><body class="has-sidebar"><header><div>Site</div></header><nav>Menu</nav><div id="cookie-notice">We use cookies.</div><main><article><h1>Title &amp; more</h1><p>First  para, with <a href=x>link</a> text.\n Yes.</p><p>Second one.<ul><li>item a<li>item b</ul><div class="ad">Buy now!</div><form>Email <input></form><script>var t="</p>";</script></article><section class="comments"><article class="comment"><p>Nice article, thanks a lot.</p></article></section></main><aside>More.</aside><footer>c</footer>'
    assert html_extract.main_text(page) == "Title & more\nFirst para, with link text. Yes.\nSecond one.\nitem a\nitem b"
    divs = '<body><div class="menu"><a href=1>Home</a></div><div class="wrap"><h1>Head line</h1><div class=post><p>Some text here, really long enough to be one.</p><p>Another, with commas, and so on. Yes.</p><p>Short</p></div></div><div class=sidebar><p>Related, stuff here.</p></div>'
    assert html_extract.main_text(divs) == "Head line\nSome text here, really long enough to be one.\nAnother, with commas, and so on. Yes.\nShort"
    for odd in ("", "   ", "<", "<p", "<script>", "<!-- x", "</p></p>", "<p>" * 2000, "&am", "<nav>x</nav>"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("plain words, only.") == "plain words, only."


def test_pages_keep_what_only_looks_like_boilerplate():
    para = "A sentence that is long enough, with commas, to be text of the article."
    for tag in ("h2 id=related-work", "h2 id=search-algorithms", "h2 id=comments", "section id=social-history"):
        page = f"<body><article><p>{para}</p><{tag}>Kept words</{tag.split()[0]}><p>{para}</p></article></body>"
        assert "Kept words" in html_extract.main_text(page), tag
    for open_, close in (("<article class=commentary>", "</article>"), ("<div class=promontory>", "</div>"), ("<form action=x>", "</form>"), ("<div class=notice>", "</div>")):
        assert html_extract.main_text(f"<body>{open_}<p>{para}</p><p>{para}</p>{close}</body>") == f"{para}\n{para}", open_
    assert "x + 1" in html_extract.main_text(f"<article><p>{para} <math><mi>x</mi> <mo>+</mo> <mn>1</mn></math></p></article>")
    assert html_extract.main_text(f"<body><div class=ad>{para}</div><article><p>{'words ' * 99}</p></article></body>") == ("words " * 99).strip()
    page = f"<body><article><p>{para}</p></article><div class=comments><p>{para * 3}</p><p>{para * 2}</p></div></body>"
    assert html_extract.main_text(page) == para


def test_pages_without_article_keep_all_selected_text():
    para = "A sentence that is long enough, with commas, to be text of the article."
    long = f"<p>{para}</p>" * 12
    for page, part in (
        (f"<body><h1>Title</h1><div id=content>{long}</div></body>", "Title"),
        (f"<body><div class=lead><p>The lead, which opens the story, is short.</p></div><div class=text>{long}</div></body>", "The lead, which"),
        (f"<body><p>{para}</p><div>{para}</div><p>{para}</p><ul><li>closing item<li>another item</ul></body>", "closing item\nanother item"),
        (f"<body><p>{para}</p><div>{para}</div><p>{para}</p><pre>x = 1</pre></body>", "x = 1"),
    ):
        assert part in html_extract.main_text(page), part
        assert html_extract.main_text(page).count(para) == page.count(para)


def test_pages_whose_names_say_little():
    para = "A sentence that is long enough, with commas, to be text of the article."
    two = f"<p>{para}</p><p>{para}</p>"
    for page in (f"<main class='social'>{two}</main>", f"<div class='content related-post'><article>{two}</article></div>", f"<form>{two}<div class=comments><p>{para}</p></div></form>"):
        assert html_extract.main_text(f"<body><nav>Menu</nav>{page}</body>") == f"{para}\n{para}", page
    inside = f"<article><p>{para}</p><ul class='menu-items'><li>soup<li>fish</ul><div id='notice'>{para} And some more words, it is long.</div>{two}</article>"
    assert "soup\nfish" in html_extract.main_text(inside)
    assert html_extract.main_text(f"<p>text <button>Share</button><span hidden>never</span>goes on</p><p>{para}</p>") == f"text goes on\n{para}"
    assert html_extract.main_text(f"<p><b>{para}<p>{para}</b> and more</p>") == f"{para}\n{para} and more"
    assert html_extract.main_text("&#" + "9" * 5000 + ";&#00000065;&#x000000042;") == "\ufffdAB"
    assert html_extract.main_text("<![CDATA[a &amp; b]]> &lt;") == "a &amp; b <"


@pytest.mark.parametrize("n", [1, 5, 200, 3000])
def test_comments_go_however_many(n):
    para = "A sentence that is long enough, with commas, to be text of the article."
    comments = f"<div class=comments>{f'<p>{para} {para} {para} Indeed.</p>' * n}</div>"
    for page in (f"<body><article><h1>T</h1>{f'<p>{para}</p>' * 5}{comments}</article></body>", f"<body><article><h1>T</h1>{f'<p>{para}</p>' * 5}</article>{comments}</body>"):
        assert html_extract.main_text(page) == "\n".join(["T"] + [para] * 5)


def brute_scores(path, chars, marks):
    """Ratios, sums and smoothing by plain loops."""
    rows = {}
    for p, c, m in zip(path, chars, marks, strict=True):
        rows.setdefault(p, []).append((c, m))
    mean = lambda v: sum(v) / len(v)
    score = [math.log(1 + mean([c for c, _ in rows[p]])) * math.log(2 + mean([m for _, m in rows[p]])) for p in path]
    weight = [math.exp(-(d**2) / 2) for d in (-2, -1, 0, 1, 2)]
    n = len(score)
    fused = [s * sum(w * score[min(max(i + d, 0), n - 1)] for w, d in zip(weight, (-2, -1, 0, 1, 2), strict=True)) / sum(weight) for i, s in enumerate(score)]
    by_path = {p: mean([f for f, q in zip(fused, path, strict=True) if q == p]) for p in path}
    m = mean(list(by_path.values()))
    least = min(max(0.6 * math.sqrt(mean([(f - m) ** 2 for f in by_path.values()])), 0.2 * m), max(by_path.values()))
    return score, [by_path[p] for p in path], least


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 400), st.integers(0, 9)), min_size=1, max_size=30))
def test_path_ratios_against_brute_force(rows):
    path, chars, marks = (list(c) for c in zip(*rows, strict=True))
    score = html_extract.path_scores(np.array(path), np.array(chars, float), np.array(marks, float))
    want, fused, least = brute_scores(path, chars, marks)
    assert np.allclose(score, want)
    for got, f in zip(html_extract.selected(score, np.array(path)).tolist(), fused, strict=True):
        assert got == (f >= least) or abs(f - least) < 1e-9 * max(1.0, least)


def test_paths_decide_where_no_element_is_the_article(monkeypatch):
    para = "A sentence that is long enough, with commas, to be text of the article; it goes on and on, as they do."
    page = f"<body><div>Short</div><div><span>By me</span></div><div class=x>{f'<p>{para}</p>' * 6}</div><div>Tail</div></body>"
    assert html_extract.main_text(page) == "\n".join([para] * 6)
    found = html_extract.parse(page)
    tags = lambda i: tags(found.parent[i]) + [found.tag[i]] if i else []
    assert [tags(h) for h in found.holder] == [["body", "div"]] * 2 + [["body", "div", "p"]] * 6 + [["body", "div"]]
    monkeypatch.setattr(html_extract, "selected", lambda score, path: np.ones(len(score), bool))
    assert html_extract.main_text(page) != "\n".join([para] * 6)


@pytest.mark.parametrize("page", ["a <b " * 200_000, "<div>" * 200_000, "<div>x" * 50_000, '<b ">" ' * 140_000, '<b x=">" ' * 100_000, "<div>" + "<b>" * 50_000 + "<p></p>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<b " + "a" * 1_000_000 + ">", "&#" + "9" * 1_000_000, "<a>x" * 50_000, '<b style="' + "display " * 100_000 + '">x'])
def test_long_and_deep_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 8


def test_quote_parsing():
    text = "Yes, I agree with that.\n\nOn Monday Ann wrote:\n> Shall we meet on Monday at noon?\n> > deeper quote here, old\n\nSee you."
    body, depth, lines, mine, theirs = quotes.parse(text)
    assert body == "Yes, I agree with that.\n\n\nSee you.".replace("\n\n\n", "\n\n")
    assert depth == 2 and lines == 2
    assert quotes._hash("shall we meet on monday at noon?") in theirs
    assert quotes._hash("deeper quote here, old") not in theirs
    assert quotes._hash("see you.") not in mine  # too short to link
    assert quotes.parse("no quotes\n\n\n\nhere")[0] == "no quotes\n\n\n\nhere"


def test_tokenizer_files_are_where_they_should_be():
    assert public_tokenizers.path("piece_bpe_32k.model")


def test_time_in_proportion_to_long_messages_and_expressions():
    import time

    from chronolith.llm import licenses, quotes

    began = time.thread_time()
    body, depth, quoted, mine, _ = quotes.parts("a\n" * 500_000)
    assert (len(body), depth, quoted) == (1_000_000, 0, 0) and mine
    _, depth, quoted, _, _ = quotes.parts("On Monday, Al wrote:\n\n> a\n" * 30_000)
    assert (depth, quoted) == (1, 30_000)
    steps = licenses.postfix(" and ".join(f"x{i}" for i in range(120_000)))
    assert len(steps) == 239_999 and len(licenses.evaluate(steps)[0]) == 120_000
    assert licenses.postfix("(" * 300_000 + "mit") is None
    assert licenses.postfix("mit or (gpl-2.0 and " * 2) == ["mit"]
    assert time.thread_time() - began < 30


STORY = "<h1>Title</h1><p>" + "A real sentence of the story, with commas, and a stop. " * 6 + "</p>" + "".join("<p>" + f"Paragraph {i} tells more of it, slowly, and at length. " * 5 + "</p>" for i in range(5))
#: What the page adds to its article, under names of several words.
ADDED = {
    "reader": '<section class="reader-comments"><p>Junk: I agree, it is so. Really, all of it.</p><p>Junk: No, not at all.</p></section>',
    "post": '<section id="post-comments"><p>Junk: I agree, it is so. Really, all of it.</p></section>',
    "header": '<header><a href="/">Junk site</a><p>Junk motto</p></header>',
    "related": '<div class="related-posts"><p>Junk: another story, told here.</p></div>',
    "ad": '<div class="ad-slot-1"><p>Junk: buy it, now.</p></div>',
    "newsletter": '<div class="newsletter-signup-form"><p>Junk: sign up, it is free.</p></div>',
    "teaser": '<article><h2><a href="/x">Junk, another</a></h2><p>Junk: it was so, they say.</p></article>',
    "card": '<div class="comment-card"><p>Junk: I agree, it is so.</p></div><div class="comment-card"><p>Junk: me too, a lot.</p></div>',
}


@pytest.mark.parametrize("page", ["<main>{0}{1}</main>", "<main><article>{0}</article>{1}</main>", "<main>{1}{0}</main>"])
@pytest.mark.parametrize("name", ADDED)
def test_what_a_page_adds_inside_main(name, page):
    text = html_extract.main_text(f"<html><body>{page.format(STORY, ADDED[name])}</body></html>")
    assert "Junk" not in text or (name, page) == ("teaser", "<main>{1}{0}</main>")
    assert "Title\nA real" in text and text.count("\n") >= 6


def test_what_a_page_adds_without_an_article():
    text = html_extract.main_text(f"<body><h1>Title</h1><div class=story>{STORY[14:]}</div>{ADDED['card']}</body>")
    assert "Junk" not in text and text.startswith("Title\nA real") and text.count("\n") == 6


@pytest.mark.parametrize("kept", ['<section id="social-history"><h2>Social history</h2><p>{0}</p></section>', '<h2 id="related-work">Related work</h2><p>{0}</p>', '<section id="search-algorithms"><p>{0}</p></section>', '<section id="how-we-read-comments"><p>{0}</p></section>', "<header><h1>Title</h1><p>{0}</p></header>", '<article class="commentary"><p>{0}</p></article>'])
def test_names_that_articles_have(kept):
    para = "Kept: a sentence of the article, with commas, and a stop."
    assert para in html_extract.main_text(f"<body><main>{STORY}{kept.format(para)}</main></body>")


def test_paths_decide_without_names(monkeypatch):
    """Generated pages without <article>, with no list of names: the headline and the paths leave out what stands apart."""
    import re

    import pyarrow.parquet as pq

    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()]
    want = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "NAMES", frozenset())
    monkeypatch.setattr(html_extract, "ENDS", frozenset())
    got = [html_extract.main_text(re.sub(r"</?(?:article|main)[^>]*>", "", p)) for p in pages]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(pages)
    monkeypatch.setattr(html_extract, "BEFORE", 1.0)  # the paths alone
    got = [html_extract.main_text(re.sub(r"</?(?:article|main)[^>]*>", "", p)) for p in pages]
    alone = sum(a == b for a, b in zip(got, want, strict=True))
    monkeypatch.setattr(html_extract, "path_scores", lambda path, chars, marks: chars * 0 + 1.0)
    got = [html_extract.main_text(re.sub(r"</?(?:article|main)[^>]*>", "", p)) for p in pages]
    assert alone >= 0.7 * len(pages) and sum(a == b for a, b in zip(got, want, strict=True)) < alone / 4


def test_made_words_share_no_hash():
    """Two words made to collide under a known key don't under another, long or short; equal ones always do."""
    pairs = [(b"il5pj3joabcdefgh", b"qqpefcog1xok70eo")]
    hashes = lambda words, key: span_hashes(b"".join(words), np.cumsum([0, *map(len, words[:-1])]), np.cumsum([*map(len, words)]), key).tolist()
    for a, b in pairs:
        assert len(set(hashes([a, b], 0))) == 1  # the attack
        for key in np.random.default_rng(1).integers(1, 2**63, 200).tolist():
            assert len(set(hashes([a, b], key))) == 2 and len(set(hashes([a, a], key))) == 1
    words = [f"w{i}".encode() * (1 + i % 40) for i in range(3000)]
    assert len(set(hashes(words, 12345))) == 3000 and hashes(words, 1) != hashes(words, 2)


def test_whole_pages_by_another_parser():
    """Generated pages through the standard library's parser: what their only <article> holds, cut at block elements."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.held, self.blocks = False, [], []

        def flush(self):
            words = " ".join("".join(self.held).split())
            self.held = []
            if words:
                self.blocks.append(words)

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.held.append(" ")
            elif tag in html_extract.BLOCK:
                self.flush()
            self.inside |= tag == "article"

        def handle_endtag(self, tag):
            if tag in html_extract.BLOCK:
                self.flush()
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.held.append(data)

    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()]
    for page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.flush()
        assert html_extract.main_text(page) == "\n".join(reader.blocks)
    assert len(pages) == 250
