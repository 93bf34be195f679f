"""Token counts by pre-tokens: pieces are counted once a distinct pre-token, never as ids of a text.

1. Every text is cut into pre-tokens; their frequencies are summed over the corpus, first in each task.
2. Each distinct pre-token is encoded once and its pieces are counted.
3. The most frequent pre-tokens, at most ``HEAD`` short ones, are broadcast; a document's frequencies of these are summed
   where its text is read. The others leave the task as rows (document, pre-token, frequency) and are joined.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import lean, materialize, prepare, slices

#: Pre-tokens that are broadcast, and the most bytes that one of them has: 13 MB of text.
HEAD, HEAD_BYTES = 200_000, 64
#: Distinct words that a task gathers before it passes them on, and that a worker remembers the pre-tokens of.
GATHERED = REMEMBERED = 400_000
#: Characters of a long text that are cut at once.
STRETCH = 1 << 22
#: Characters up to here are asked about one by one; any beyond go to the library (`_odd`).
ASKED = 0x40000
#: The pattern of byte-level pre-tokens, which the vocabulary's format fixes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_strings(path: str) -> list[str]:
    """The strings that the file counts as one token wherever they stand; other kinds of file are refused."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    pre = found.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if found.get("normalizer") or not plain or any(t[k] for t in found["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: only plain byte-level files are counted")
    return sorted((t["content"] for t in found["added_tokens"]), key=len, reverse=True)


@functools.cache
def _odd() -> str:
    """A class of the characters that the library and the ``regex`` module sort differently (they know Unicode of different
    years). Found by asking both: in ``a?1?!`` a letter, a digit, a space and any other character give different cuts."""
    import regex
    from tokenizers import pre_tokenizers

    library, pattern = pre_tokenizers.ByteLevel(add_prefix_space=False), regex.compile(PATTERN)

    def differs(some: list[int]) -> list[int]:
        s = "".join(f"a{chr(c)}1{chr(c)}!" for c in some)
        if [x[1] for x in library.pre_tokenize_str(s)] == [m.span() for m in pattern.finditer(s)]:
            return []
        half = len(some) // 2
        return some if len(some) == 1 else differs(some[:half]) + differs(some[half:])

    asked = [c for c in range(ASKED) if not 0xD800 <= c < 0xE000]
    ranges: list[list[int]] = []
    for c in [x for i in range(0, len(asked), 256) for x in differs(asked[i : i + 256])]:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*ranges, [ASKED, 0x10FFFF]])


class PreTokens:
    """Pre-tokens of texts, as the library cuts them.

    Most texts are cut at their spaces first: a space between two characters that are no white space begins a pre-token, so
    what follows it, up to the next such space, has the same pre-tokens in every text. These words are counted as they
    are and cut once each. Texts with longer white space are cut by the pattern as a whole, and those with a character
    that the ``regex`` module may sort in another way than the library, by the library.
    """

    def __init__(self, specials: list[str], odd: str) -> None:
        import re

        import regex
        from tokenizers import pre_tokenizers

        self.find = regex.compile(PATTERN).findall
        self.iterate = regex.compile(PATTERN).finditer
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.odd = re.compile(f"[{odd}]").search
        self.special = re.compile("|".join(map(re.escape, specials))).split if specials else lambda text: [text]
        self.specials = specials
        self.spaced = re.compile(r"\s | \s").search

    def parts(self, text: str) -> Iterator[str]:
        """The text without special strings, long stretches cut at single spaces; a part's own white space is whole."""
        for part in self.special(text):
            at = 0
            while len(part) - at > STRETCH:
                cut = part.find(" ", at + STRETCH)
                while cut >= 0 and (part[cut - 1].isspace() or part[cut + 1 : cut + 2].isspace() or cut + 1 == len(part)):
                    cut = part.find(" ", cut + 1)
                if cut < 0:
                    break
                yield part[at:cut]
                at = cut
            yield part[at:] if at else part

    def n_specials(self, text: str) -> int:
        return len(self.special(text)) - 1 if any(s in text for s in self.specials) else 0

    def words(self, part: str) -> list[str] | None:
        """The part cut at its spaces, the first word as it stands and the others without their space; None where words
        can't be cut one by one."""
        characters = set(part)
        if not part.isascii() and self.odd("".join(characters)):
            return None
        if "  " in part or any(map(str.isspace, characters - {" "})) and self.spaced(part):
            return None
        return part.split(" ")

    def whole(self, part: str) -> Counter:
        """Frequencies of a part's pre-tokens, by the pattern or the library."""
        if not part.isascii() and self.odd("".join(set(part))):
            return Counter(part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part))
        return Counter(m.group() for m in self.iterate(part)) if len(part) > STRETCH else Counter(self.find(part))


def _counted(tokens: PreTokens, texts: pa.Array, words: Counter, heads: Counter, others: Counter) -> None:
    for text in texts.to_pylist():
        for part in tokens.parts(text or ""):
            cut = tokens.words(part)
            if cut is None:
                others.update(tokens.whole(part))
            else:
                heads[cut[0]] += 1
                del cut[0]
                words.update(cut)


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """``pre_token, n``: every distinct pre-token of the corpus."""
    specials, odd = special_strings(path), _odd()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens(specials, odd)
        words, heads, others = Counter(), Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for counts, before in ((words, " "), (heads, "")):
                for word, n in counts.items():
                    for x in tokens.find(before + word):
                        others[x] += n
                counts.clear()
            items = list(others.items())
            others.clear()
            for i in range(0, len(items), 20_000):
                some = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["pre_token", "n"])

        for batch in batches:
            for piece in slices(batch, "text"):
                _counted(tokens, piece.column("text"), words, heads, others)
                if len(words) + len(heads) + len(others) > GATHERED:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def pieces(distinct: DataFrame, path: str) -> DataFrame:
    """``distinct`` with ``pieces``: how many tokens the vocabulary makes of each pre-token."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = None
        for batch in batches:
            if bare is None:
                bare = _bare(path)
            for some in slices(batch, "pre_token"):
                sizes = [len(e) for e in bare.encode_batch_fast(some.column("pre_token").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sizes, pa.int64())], [*some.schema.names, "pieces"])

    return distinct.mapInArrow(run, "pre_token string, n long, pieces long")


@functools.lru_cache(maxsize=1)
def _bare(path: str):
    """The file's merges alone: no added strings, and a pre-token is not cut again."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    bare = Tokenizer(Tokenizer.from_file(path).model)
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return bare


def _head(counted: DataFrame) -> dict[str, int]:
    """The pieces of the most frequent short pre-tokens: all that occur so often that at most HEAD do."""
    short = counted.filter(F.octet_length("pre_token") <= HEAD_BYTES)
    step = F.floor(F.log2("n") * 16)
    below, room = None, HEAD
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):  # 16 rows a doubling
        if row["count"] > room:
            break
        below, room = row["step"], room - row["count"]
    return {} if below is None else {r.pre_token: r.pieces for r in short.filter(step >= below).select("pre_token", "pieces").toLocalIterator()}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, head: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row: the tokens of its whole text without added ones.

    Null and empty texts have no tokens; a text of any length is counted whole, in stretches; special strings count as
    one token each, as the library's default is; repeated rows and null ids are counted like any other; only ``doc_id`` and
    ``text`` are read; an empty table gives no rows. ``head`` replaces HEAD in tests.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = materialize(pieces(frequencies(docs, path), path), "pre-tokens")
    known = spark.sparkContext.broadcast(_head(counted) if head is None else dict(list(_head(counted).items())[:head]))
    specials, odd = special_strings(path), _odd()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = PreTokens(specials, odd), known.value
        seen: dict[str, tuple[int, tuple[str, ...]]] = {}

        def summed(found: list[str]) -> tuple[int, tuple[str, ...]]:
            return sum(table.get(x, 0) for x in found), tuple(x for x in found if x not in table)

        for batch in batches:
            for piece in slices(batch, "text"):
                totals, lists, freqs, stops = [], [], [], [0]
                for text in piece.column("text").to_pylist():
                    text = text or ""
                    total, rest = tokens.n_specials(text), Counter()
                    for part in tokens.parts(text):
                        cut = tokens.words(part)
                        if cut is None:
                            for x, n in tokens.whole(part).items():
                                if x in table:
                                    total += n * table[x]
                                else:
                                    rest[x] += n
                            continue
                        first, others = summed(tokens.find(cut[0]))
                        total += first
                        rest.update(others)
                        del cut[0]
                        for word, n in Counter(cut).items():
                            if word not in seen:
                                if len(seen) > REMEMBERED:
                                    seen.clear()
                                seen[word] = summed(tokens.find(" " + word))
                            own, others = seen[word]
                            total += n * own
                            for x in others:
                                rest[x] += n
                    totals.append(total)
                    lists.extend(rest)
                    freqs.extend(rest.values())
                    stops.append(len(lists))
                rows = pa.StructArray.from_arrays([pa.array(lists, pa.string()), pa.array(freqs, pa.int64())], ["pre_token", "n"])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rows)], ["doc_id", "n_bytes", "known", "rest"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_bytes"))
    summed = sized.mapInArrow(run, "doc_id long, n_bytes long, known long, rest array<struct<pre_token: string, n: long>>")
    own = materialize(summed.withColumn("row", F.monotonically_increasing_id()), "token-sums")
    rest = own.select("row", F.explode("rest").alias("x")).select("row", "x.pre_token", F.col("x.n").alias("times"))
    joined = rest.join(counted.select("pre_token", "pieces"), "pre_token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = own.select("row", "doc_id", "n_bytes", "known").join(joined, "row", "left")
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
