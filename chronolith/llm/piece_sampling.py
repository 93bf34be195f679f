"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed A-star search over the lattice.

The lattice of a text has a node for every character and an edge for every piece. Summing backwards gives each edge its
probability given its node, so a segmentation's probability is the product over its edges. The search is top-down: the
root's largest perturbed log-probability is one Gumbel variable; the child that inherits it is drawn by probability, and
all its siblings together get one variable truncated at it. The siblings of a whole path wait in the queue; the largest
is expanded next (a child among the siblings not yet taken, then the rest of the text), so the k paths found are the k
largest perturbed log-probabilities: distinct, and sampled without replacement. With the (k+1)-th as threshold, a path's
inclusion score is the chance that its own variable exceeds it.

Pieces never cross from another character to a space, or from a letter a-z to a punctuation mark, or touch a line end, so
the lattice is a chain of units (a word with the spaces before it, or what stands between words); ``Lattices`` checks
this of its model. Units' lattices are built for many new units at once and remembered; paths are drawn for all
units of a chunk at once. Random numbers are hashes of (seed, row key, path, unit, step): reruns and other partitionings
give the same result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import HashIndex, carried, lean, mix64, prepare, slices, span_hashes, utf8

#: Units whose lattices a worker remembers; beyond it the memory is emptied and filled anew.
MEMORY = 150_000
LONGEST = 16
SPACE = "▁"
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_MARK = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ALL = 0xFFFFFFFFFFFFFFFF


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(x: int) -> int:
    """``mix64`` of one number."""
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & _ALL
    return x ^ x >> 32


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashed 64-bit keys."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """Pieces with their weights, and the lattices of known units.

    The model's scores are ranks (it was trained by merging), so a piece's weight follows Zipf's law of its rank; bytes
    and pieces without a rank weigh as the last.
    """

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_at = {}
        keys, ids, text = [], [], [b""] * n
        rank = np.full(n, float(n))
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                text[i] = piece.replace(SPACE, " ").encode("utf-8")
                keys.append(piece.replace(SPACE, " "))
                ids.append(i)
                score = self.model.get_score(i)
                if -n <= score < 0:
                    rank[i] = -score
        self.weight = -alpha * np.log((rank + 2.7) * math.log(n))
        self.text_flat = np.frombuffer(b"".join(text), np.uint8)
        self.text_length = np.array([len(t) for t in text], np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        crossing = [k for k in keys if re.search(r"[^ ] |\n|[A-Za-z][!-/:-@\[-`{-~]", k)]
        if crossing:
            raise ValueError(f"the model has pieces across units: {crossing[:3]}")
        lengths = np.array([len(k) for k in keys])
        stops = np.cumsum(lengths)
        flat = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        self.longest = int(lengths.max())
        h = np.full(len(keys), _GOLD)
        for k in range(self.longest):
            live = lengths > k
            h[live] = carried(h[live], flat[(stops - lengths)[live] + k].astype(np.uint64))
        self.pieces = HashIndex(1 << 17)
        self.pieces.insert(h, np.array(ids))
        self._reset()

    def _reset(self) -> None:
        self.known = HashIndex()
        self.nodes = self.edges = 0
        self.first = np.zeros(4096, np.int32)
        self.cum = np.zeros(4096, np.float32)
        self.logp = np.zeros(4096, np.float32)
        self.rest = np.zeros(4096, np.float32)
        self.token = np.zeros(4096, np.uint32)
        self.next = np.zeros(4096, np.int32)

    def _room(self, nodes: int, edges: int) -> None:
        more = lambda x, need: x if need <= len(x) else np.resize(x, max(need, len(x) * 5 // 4))
        self.first = more(self.first, self.nodes + nodes + 1)
        self.cum, self.logp, self.rest, self.token, self.next = (more(x, self.edges + edges) for x in (self.cum, self.logp, self.rest, self.token, self.next))

    def learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        """Build the lattices of new units: edges, backward sums by distance from the end, probabilities."""
        raw = b"".join(units)
        flat = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[np.cumsum([len(u) for u in units]) - 1]
        lengths = np.diff(begins, prepend=0).astype(np.int64)
        n = len(flat)
        ends = np.repeat(np.cumsum(lengths), lengths)
        left = ends - np.arange(n)
        at = np.arange(n)
        from_node, size, piece = [], [], []
        codes, h = flat.astype(np.uint64), np.full(n, _GOLD)
        single = np.zeros(n, bool)
        for k in range(1, self.longest + 1):
            starts = at[left >= k]
            if not len(starts):
                break
            h = carried(h, codes[starts + k - 1])
            found = self.pieces.find(h)
            hit = found >= 0
            from_node.append(starts[hit])
            size.append(np.full(int(hit.sum()), k))
            piece.append(found[hit])
            if k == 1:
                single[starts[hit]] = True
            h = h[left[starts] > k]
        # characters without a piece: their bytes, as a chain of nodes behind the others
        extra_from, extra_piece, extra_next = [], [], []
        for i in np.flatnonzero(~single).tolist():
            raw = chr(int(flat[i])).encode("utf-8")
            from_node.append(np.array([i]))
            size.append(np.array([1 if len(raw) == 1 else -(n + len(extra_from)) - 1]))
            piece.append(np.array([self.bytes_at[raw[0]]]))
            for k in range(1, len(raw)):
                extra_from.append(n + len(extra_from))
                extra_piece.append(self.bytes_at[raw[k]])
                extra_next.append(i + 1 if k == len(raw) - 1 else n + len(extra_from))
        node, size, piece = np.concatenate(from_node), np.concatenate(size), np.concatenate(piece)
        chain = size < 0
        weight = self.weight[piece]
        span = np.where(chain, 1, size)
        for e in np.flatnonzero(chain).tolist():
            weight[e] += sum(float(self.weight[self.bytes_at[b]]) for b in chr(int(flat[node[e]])).encode("utf-8")[1:])
        order = np.lexsort((span, node, left[node]))
        node, size, piece, weight, span, chain = (x[order] for x in (node, size, piece, weight, span, chain))
        beta = np.zeros(n + 1)
        after = node + span
        closed = after == ends[node]
        cuts = np.flatnonzero(np.append(True, np.diff(left[node]) != 0))
        total = np.empty(len(node))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(node)], strict=True):
            value = weight[a:b] + np.where(closed[a:b], 0.0, beta[after[a:b]])
            total[a:b] = value
            head = np.flatnonzero(np.append(True, np.diff(node[a:b]) != 0))
            beta[node[a:b][head]] = np.logaddexp.reduceat(value, head)
        logp = np.minimum(total - beta[node], 0.0)
        order = np.argsort(node, kind="stable")
        node, size, piece, logp, after, closed, chain = (x[order] for x in (node, size, piece, logp, after, closed, chain))
        follow = np.where(chain, -size - 1, np.where(closed, -1, after))
        head = np.flatnonzero(np.append(True, np.diff(node) != 0))
        p = np.exp(logp)
        running = np.cumsum(p)
        cum = running - np.repeat((running - p)[head], np.diff(np.append(head, len(node))))
        cum[np.append(head[1:], len(node)) - 1] = 2.0
        ext = len(extra_from)
        stop_of = np.array([-1 if x <= n and ends[x - 1] == x else x for x in extra_next], np.int64) if ext else np.zeros(0, np.int64)
        self._room(n + ext, len(node) + ext)
        with np.errstate(divide="ignore"):
            rest = np.where(logp < 0, np.log(-np.expm1(logp)), -np.inf)
        base, ebase = self.nodes, self.edges
        m = len(node)
        self.first[base : base + n] = ebase + np.searchsorted(node, at)
        self.first[base + n : base + n + ext + 1] = ebase + m + np.arange(ext + 1)
        for whole, own, chained in ((self.cum, cum, np.full(ext, 2.0)), (self.logp, logp, np.zeros(ext)), (self.rest, rest, np.full(ext, -np.inf)), (self.token, piece, np.array(extra_piece, np.int64)), (self.next, np.where(follow < 0, -1, follow + base), np.where(stop_of < 0, -1, stop_of + base))):
            whole[ebase : ebase + m] = own
            whole[ebase + m : ebase + m + ext] = chained
        self.known.insert(hashes, base + np.cumsum(lengths) - lengths)
        self.nodes, self.edges = base + n + ext, ebase + m + ext

    def roots(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first node of every unit of the texts, and the number of units of each. The model puts a space before
        each text; an empty one has no units."""
        if self.known.count > MEMORY:
            self._reset()
        live = [t for t in texts if t]
        data = b" " + b"\0 ".join(live)
        b = np.frombuffer(data, np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t) + 2 for t in live])]).astype(np.int64)
        space, line = b == 32, b == 10
        begin = np.empty(len(b), bool)
        begin[0] = True
        begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1] | (_LETTER[b[:-1]] & _MARK[b[1:]])
        between = edges[1:-1] - 1  # the byte between two texts is a unit of its own, left out
        begin[between] = begin[between + 1] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(b))
        own = np.ones(len(starts), bool)
        own[np.searchsorted(starts, between)] = False
        starts, ends = starts[own], ends[own]
        h = span_hashes(data, starts, ends)
        at = self.known.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing) and live:
            fresh, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            self.learn([data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], fresh)
            at[missing] = self.known.find(h[missing])
        sizes = np.zeros(len(texts), np.int64)
        if live:
            sizes[[i for i, t in enumerate(texts) if t]] = np.diff(np.searchsorted(starts, np.append(edges[:-1], len(b))))
        return at.astype(np.int64)[: int(sizes.sum())], sizes

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from every node to its unit's end: edges in order, and their number for every unit."""
        live = np.flatnonzero(nodes >= 0)
        node = nodes[live]
        counts = np.zeros(len(nodes), np.int64)
        steps = []
        step = 0
        while len(live):
            u = uniform(keys[live] + np.uint64(step * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)).astype(np.float32)
            edge = self.first[node].astype(np.int64)
            behind = np.flatnonzero(u >= self.cum[edge])
            while len(behind):
                edge[behind] += 1
                behind = behind[u[behind] >= self.cum[edge[behind]]]
            steps.append((live, edge))
            counts[live] += 1
            node = self.next[edge]
            on = node >= 0
            live, node = live[on], node[on]
            step += 1
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (where, edge) in enumerate(steps):
            out[begins[where] + k] = edge
        return out, counts

    def node_of(self, edge: int) -> int:
        return int(np.searchsorted(self.first[: self.nodes], np.int32(edge), side="right")) - 1

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of pieces, the leading space kept."""
        lengths = self.text_length[ids]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        return self.text_flat[np.repeat(self.text_start[ids] - (stops - lengths), lengths) + np.arange(total)].tobytes()


class _Path:
    """One drawn segmentation: edges and, before each, the log-probability of the path so far."""

    __slots__ = ("edges", "units", "before", "logp", "gumbel", "waiting")

    def __init__(self, edges: np.ndarray, units: np.ndarray, local: np.ndarray, gumbel: float) -> None:
        self.edges, self.units, self.gumbel = edges, units, gumbel
        total = np.cumsum(local, dtype=np.float64)
        self.before, self.logp = total - local, float(total[-1]) if len(total) else 0.0
        self.waiting: np.ndarray | None = None


def _truncated(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of log-mass ``mass`` given that they are below ``bound``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(mass > -np.inf, mass - np.log(np.exp(mass - bound) - np.log(u)), -np.inf)


def sample(lattices: Lattices, texts: list[bytes], keys: list[int], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For every text up to k distinct segmentations, by falling perturbed log-probability: (ids, log-probability,
    perturbed log-probability, inclusion score)."""
    roots, sizes = lattices.roots(texts)
    edge_to = np.cumsum(sizes)
    row_keys = mix64(np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64) + np.uint64(seed * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
    numbers = np.arange(int(sizes.sum())) - np.repeat(edge_to - sizes, sizes)
    unit_keys = mix64(np.repeat(row_keys, sizes) + numbers.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    edges, counts = lattices.walk(roots, mix64(unit_keys + np.uint64(1)))
    stops = np.concatenate([[0], np.cumsum(counts)])
    searches: list[_Search | None] = []
    for d in range(len(texts)):
        lo, hi = int(edge_to[d] - sizes[d]), int(edge_to[d])
        if lo == hi:
            searches.append(None)
            continue
        unit = np.repeat(np.arange(hi - lo), counts[lo:hi])
        searches.append(_Search(lattices, edges[stops[lo] : stops[hi]], unit, roots[lo:hi], unit_keys[lo:hi], int(row_keys[d]), k))
    live = [s for s in searches if s]
    while live:
        asked = [(s, w) for s in live if (w := s.choose())]
        if not asked:
            break
        more, counts = lattices.walk(np.concatenate([w[0] for _, w in asked]), np.concatenate([w[1] for _, w in asked]))
        cuts = np.concatenate([[0], np.cumsum([len(w[0]) for _, w in asked])])
        stops = np.concatenate([[0], np.cumsum(counts)])[cuts]
        for i, (s, _) in enumerate(asked):
            s.extend(more[stops[i] : stops[i + 1]], counts[cuts[i] : cuts[i + 1]])
        live = [s for s, _ in asked]
    return [s.result() if s else [(np.zeros(0, np.uint32), 0.0, 0.0, 1.0)] for s in searches]


class _Search:
    """The search over one text, in rounds: ``choose`` takes the best waiting node and says where to draw on from,
    ``extend`` takes what was drawn. All texts of a chunk draw together."""

    def __init__(self, lattices: Lattices, edges: np.ndarray, unit: np.ndarray, roots: np.ndarray, unit_keys: np.ndarray, key: int, k: int) -> None:
        self.lattices, self.roots, self.unit_keys, self.key, self.k = lattices, roots, unit_keys, key, k
        self.paths: list[_Path] = []
        #: (-variable, path, step, edges taken at that node)
        self.queue: list[tuple[float, int, int, tuple[int, ...]]] = []
        self.chosen: tuple[float, _Path, int, int] | None = None
        self._enter(_Path(edges, unit, lattices.logp[edges].astype(np.float64), -math.log(-math.log(self._draw(7)))), 0)

    def _draw(self, *salt: int) -> float:
        x = self.key
        for v in salt:
            x = _mixed(x ^ ((v * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _ALL))
        return ((x >> 11) + 0.5) * 2.0**-53

    def _enter(self, path: _Path, fresh_from: int) -> None:
        """Queue the best siblings of the path's own steps; no more than k + 1 of them can matter."""
        number, k = len(self.paths), self.k
        self.paths.append(path)
        mass = path.before[fresh_from:] + self.lattices.rest[path.edges[fresh_from:]]
        steps = np.arange(fresh_from, len(path.edges)).astype(np.uint64) * _GOLD
        u = uniform(mix64(np.uint64(self.key) + steps) + np.uint64(number + 101))
        waiting = _truncated(mass, path.gumbel, u)
        best = np.argsort(-waiting, kind="stable")[: k + 1] if len(waiting) <= 4 * k + 4 else np.argpartition(-waiting, k)[: k + 1]
        for t in best.tolist():
            if waiting[t] > -np.inf:
                heapq.heappush(self.queue, (-float(waiting[t]), number, fresh_from + t, (int(path.edges[fresh_from + t]),)))

    def choose(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Nodes and keys to draw from for the next path, None when there is none."""
        lattices, n = self.lattices, len(self.paths)
        while self.queue and n < self.k:
            value, number, step, taken = heapq.heappop(self.queue)
            parent = self.paths[number]
            node = lattices.node_of(int(parent.edges[step]))
            low, high = int(lattices.first[node]), int(lattices.first[node + 1])
            p = np.exp(lattices.logp[low:high].astype(np.float64))
            p[[t - low for t in taken]] = 0.0
            open_mass = float(p.sum())
            if open_mass <= 0:
                continue
            child = low + int(min(np.searchsorted(np.cumsum(p), self._draw(11, n, step) * open_mass, side="right"), high - low - 1))
            while p[child - low] == 0:
                child -= 1
            rest = open_mass - float(p[child - low])
            if rest > 1e-12:
                mass = np.array([parent.before[step] + math.log(rest)])
                again = float(_truncated(mass, -value, np.array([self._draw(13, n, step)]))[0])
                heapq.heappush(self.queue, (-again, number, step, (*taken, child)))
            self.chosen = -value, parent, step, child
            unit = int(parent.units[step])
            return np.concatenate([[lattices.next[child]], self.roots[unit + 1 :]]), mix64(self.unit_keys[unit:] + np.uint64(1 + n))
        return None

    def extend(self, more: np.ndarray, counts: np.ndarray) -> None:
        gumbel, parent, step, child = self.chosen
        unit = int(parent.units[step])
        whole = np.concatenate([parent.edges[:step], [child], more]).astype(np.int64)
        units = np.concatenate([parent.units[:step], [unit], np.repeat(np.arange(unit, len(self.roots)), counts)])
        self._enter(_Path(whole, units, self.lattices.logp[whole].astype(np.float64), gumbel), step + 1)

    def result(self) -> list[tuple[np.ndarray, float, float, float]]:
        threshold = -self.queue[0][0] if self.queue else -math.inf
        chance = lambda p: -math.expm1(-math.exp(min(p.logp - threshold, 700.0))) if threshold > -math.inf else 1.0
        return [(self.lattices.token[p.edges], p.logp, p.gumbel, chance(p)) for p in self.paths]


_LATTICES: tuple[str, float, Lattices] | None = None
DDL = "n_bytes long, round_trip boolean, samples array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"
_SAMPLE = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])


def encode(docs: DataFrame, model: str, k: int = 2, seed: int = 1, alpha: float = 1.0, copy: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, round_trip, samples`` of every row: up to k distinct segmentations of its whole text.

    ``round_trip`` tells that every segmentation decodes to the text, byte by byte (U+2581 is written in bytes, as no
    piece has it). Null and empty texts have one empty segmentation. A text with fewer segmentations than k gives them
    all, with inclusion score 1. Rows that repeat an id and a text get the same samples, unless ``copy`` names a column
    of copy numbers (see ``numbered``), which then is part of the row's key; a null id has a key of its own; only
    ``doc_id``, ``text`` and that column are read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", (F.col(copy) if copy else F.lit(0)).cast("long").alias("copy"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _LATTICES
        if _LATTICES is None or _LATTICES[:2] != (model, alpha):
            _LATTICES = model, alpha, Lattices(model, alpha)
        lattices = _LATTICES[2]
        for batch in batches:
            for part in slices(batch, "text", 250_000):
                texts = utf8(part.column("text"))
                keys = [(-1 if x is None else int(x)) + (c or 0) * int(_GOLD) for x, c in zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), strict=True)]
                found = sample(lattices, texts, keys, k, seed)
                same = []
                for t, own in zip(texts, found, strict=True):
                    want = b" " + t if t else b""
                    same.append(all(lattices.decode(ids) == want for ids, *_ in own))
                flat = [s for own in found for s in own]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)), pa.array(np.concatenate([s[0] for s in flat]).astype(np.int32)))
                rows = pa.StructArray.from_arrays([ids, *[pa.array([s[j] for s in flat], pa.float64()) for j in (1, 2, 3)]], fields=list(_SAMPLE))
                samples = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(same), samples], ["doc_id", "n_bytes", "round_trip", "samples"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {DDL}")


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, copy``: rows that repeat an id and a text numbered from 0, whatever the partitioning.

    Null ids and texts are equal to each other; an empty table gives no rows. Only rows that are the same in both meet
    in one task, which holds no more than a batch of them.
    """
    kinds = dict(docs.dtypes)
    prepare(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    ranged = keyed.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, number = None, 0
        for batch in batches:
            numbers = []
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                number = number + 1 if row == before else 0
                before = row
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(numbers, pa.int64())], ["doc_id", "text", "copy"])

    return ranged.mapInArrow(run, f"doc_id {kinds['doc_id']}, text string, copy long")


def decode(encoded: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """The input with ``text``: the pieces of ``column`` (array<int>) put together, without the model's leading space."""
    prepare(encoded.sparkSession)
    names = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*names).schema.add("text", "string")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(model)
        for batch in batches:
            texts = [None if not v.is_valid else lattices.decode(v.values.to_numpy().astype(np.int64))[1:].decode("utf-8", "replace") for v in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    return encoded.select(*names).mapInArrow(run, schema)
