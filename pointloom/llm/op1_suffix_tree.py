"""Language-model scoring with probabilistic suffix trees.

The normalised text is its words (runs without ASCII white space, A-Z lower-cased), each with one space after it, then an end
symbol, which also stands before the text. Two trees share the work, and both take the bytes just before as context, and every
possible text has a probability:
- the *next* tree predicts the next frequent word, or that the text ends, or an escape (contexts of up to ``NEXT_DEPTH`` bytes);
- the *spell* tree spells an escaped word byte by byte up to its space (contexts of up to ``SPELL_DEPTH`` bytes, which reach into the words before).
An escaped word gets its share of the escaped training words, less ``DISCOUNT`` of a word, plus what the discounts leave times its
spelling's probability; a word that training never saw has the latter alone. So the probabilities of all texts sum to 1 at most.
All contexts are counted over all training texts. One stays in its tree if it was seen often enough (``_least``: the number rises with
the root of the tree's positions, so what is kept grows with the corpus, and each count is the surer for it)
and its next-symbol distribution diverges from that of the context one byte shorter: by a likelihood-ratio test, and by at least
``gain`` bits a position. Distributions are smoothed towards the shorter context's, the empty one's by adding
one. Each symbol is scored in the state of the longest retained suffix before it.

Sizes: nothing that is frequent enough is left out. A tree of more than ``MAX_CONTEXTS`` contexts, or ``MAX_PAIRS`` pairs of context and
next symbol, is cut into parts of about that size by the bytes of the contexts, nearest first: a part has every context of the positions
that fall to it, so these get the probabilities of the whole tree. Parts are grown one after another and stored in the shared folder, and
scoring has one of them in memory at a time. The frequent words, of which there are at most 50,000 times the root of the tokens by 5e7,
are broadcast. The words' counts for the unigram base are exact and unbounded: those of frequent words and those of at least ``OFTEN`` of all
tokens (at most 1 / OFTEN words) are broadcast, and the rest, of which none is hot, are joined by their 64-bit hashes.

Defined results:
- null and empty texts are the end symbol alone (one token); very long texts are scored whole, in one row;
- repeated rows count and are scored each by itself; ids that are null are never held out;
- without training texts the trees are the empty context with equal probabilities and the base knows no token;
- an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm import flat, staging

END, NOTHING = 0xFF, 0xFE  # UTF-8 has neither byte
SPELL_DEPTH, NEXT_DEPTH = 5, 4
P_MIN, GAIN, SMOOTH = 1e-5, 1e-7, 12.0
HEAD, PAIR, OFTEN, DISCOUNT = 2e-5, 1e-6, 1e-6, 0.5
WORD, SPELL, NEXT, TEXTS = 0, 1, 2, 3
#: A stream, and the positions, rows and symbols that are scored in it.
Asked = tuple["Stream", np.ndarray, np.ndarray, np.ndarray]
#: At this many positions, ``p_min``, ``head`` and ``pair`` are shares of them.
EVEN = 5e7
#: Contexts and pairs of a part of a tree (its first context's suffixes come on top), and bytes of text that are scored with each part in turn.
MAX_CONTEXTS, MAX_PAIRS, BUNCH = 100_000, 2_000_000, 8 << 20


def _least(share: float, total: int, least: float) -> float:
    """How often something must be seen to be kept."""
    return max(least, share * (EVEN * total) ** 0.5)


class Stream:
    """The normalised symbols of a run of rows, after one end symbol; ``at``: where rows begin (without that symbol)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, finder: flat.Words):
        start, end, self.hashes, self.before = finder.find(data, offsets)
        size = end - start
        self.rows, words = len(offsets) - 1, len(start)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.before))
        letters = np.concatenate([[0], np.cumsum(size)])
        self.at = letters[self.before] + self.before + np.arange(self.rows + 1)
        self.symbols = np.full(self.at[-1] + 1, 32, np.uint8)
        self.start, self.size = letters[:-1] + np.arange(words) + self.row, size
        if words:
            folded = data[np.repeat(start - letters[:-1], size) + np.arange(letters[-1])]
            folded = np.where((folded >= 65) & (folded <= 90), folded + 32, folded).astype(np.uint8)
            self.symbols[1 + np.repeat(self.start - letters[:-1], size) + np.arange(letters[-1])] = folded
        self.symbols[0] = self.symbols[self.at[1:]] = END

    def tokens(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, row, symbol) of each token, and which words are escaped. Symbols: places in ``heads``, then escape, then end."""
        own = self.hashes.view(np.int64)
        place = np.searchsorted(heads, own)
        place[place == len(heads)] = 0
        known = heads[place] == own if len(heads) else np.zeros(len(own), bool)
        symbol = np.full(len(own) + self.rows, len(heads) + 1, np.int64)
        pos, row = np.empty(len(symbol), np.int64), np.empty(len(symbol), np.int64)
        mine, ends = np.arange(len(own)) + self.row, self.before[1:] + np.arange(self.rows)
        symbol[mine] = np.where(known, place, len(heads))
        pos[mine], row[mine], pos[ends], row[ends] = self.start, self.row, self.at[1:] - 1, np.arange(self.rows)
        return pos, row, symbol, ~known

    def spelled(self, escaped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row) of the bytes of the escaped words and their spaces."""
        size = self.size[escaped] + 1
        total = np.concatenate([[0], np.cumsum(size)])
        return np.repeat(self.start[escaped] - total[:-1], size) + np.arange(total[-1]), np.repeat(self.row[escaped], size)

    def contexts(self, pos: np.ndarray, row: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        """For k = 1 .. depth: the symbol k before each position, NOTHING beyond the start of its row."""
        place = pos - self.at[row]
        for k in range(1, depth + 1):
            yield np.where(k <= place + 1, self.symbols[np.maximum(pos + 1 - k, 0)], np.uint8(NOTHING))

    def codes(self, pos: np.ndarray, row: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
        """A number for each position: the bytes before it from the highest on, nearest first, and its own symbol in the lowest."""
        code = symbol.astype(np.uint64)
        for k, before in enumerate(self.contexts(pos, row, depth)):
            code |= before.astype(np.uint64) << np.uint64(56 - 8 * k)
        return code


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur."""
    if counts is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _counter(heads):
    """Counts words (``heads`` is None) or the contexts of both trees, combined within the task as far as ``limit`` distinct keys fit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, limit = flat.Words(flat.SOLID), 1_000_000
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], SPELL: [], NEXT: []}

        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for _, data, offsets in flat.pieces(batch.column(0)):
                stream = Stream(data, offsets, finder)
                if heads is None:
                    found = {WORD: stream.hashes}
                else:
                    pos, row, symbol, escaped = stream.tokens(heads.value)
                    at, of = stream.spelled(escaped)
                    found = {NEXT: stream.codes(pos, row, symbol, NEXT_DEPTH), SPELL: stream.codes(at, of, stream.symbols[at + 1], SPELL_DEPTH)}
                for kind, keys in found.items():
                    own = held[kind]
                    own.append(_tally(keys))
                    if sum(len(k) for k, _ in own) > limit:
                        own[:] = [_tally(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]))]
                        if len(own[0][0]) > limit // 2:
                            yield out(kind, *own.pop())
        for kind, own in held.items():
            if own:
                yield out(kind, *_tally(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own])))
        if heads is None:
            yield out(TEXTS, np.zeros(1, np.uint64), np.array([texts]))

    return work


def _counted(texts: DataFrame, text_col: str, heads, name: str) -> DataFrame:
    """``kind``, ``key``, ``n`` over all rows, kept in the shared folder."""
    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_counter(heads), "kind byte, key long, n long")
    return staging.keep(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), name)


def _columns(df: DataFrame) -> list[np.ndarray]:
    """A small table's columns, on the driver."""
    return [c.to_numpy() for c in df.toArrow().columns]


def _frequent(counts: DataFrame, kind: int, depth: int, p_min: float, pair: float) -> tuple[DataFrame, DataFrame, int]:
    """(k, ctx, n) of all frequent contexts, (k, ctx, next, n) of their frequent next symbols, and the number of positions. ``at``: the place of a context among all, in the order of their bytes, nearest first."""
    own = counts.where(F.col("kind") == kind)
    total = own.agg(F.sum("n")).first()[0] or 0
    low = (1 << (64 - 8 * depth)) - 1
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(0).cast("long") if not k else F.shiftrightunsigned("key", 64 - 8 * k)).alias("ctx")) for k in range(depth + 1)]))
    rows = own.select(levels.alias("c"), F.col("key").bitwiseAND(low).alias("next"), "n").select("c.k", "c.ctx", "next", "n")
    rows = rows.where((F.col("k") == 0) | (F.col("ctx").bitwiseAND(255) != NOTHING))
    each = staging.keep(rows.groupBy("k", "ctx", "next").agg(F.sum("n").alias("n")), "suffix-pairs")
    at = F.expr(f"shiftleft(ctx, 8 * ({depth} - k))").alias("at")
    contexts = staging.keep(each.groupBy("k", "ctx").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(_least(p_min, total, 2.0))).select("k", "ctx", "n", at), "suffix-frequent")
    # Spark broadcasts the contexts if they are few enough
    pairs = each.where(F.col("n") >= F.lit(_least(pair, total, 1.0))).join(contexts.select("k", "ctx"), ["k", "ctx"], "left_semi")
    return contexts, staging.keep(pairs.select("k", "ctx", "next", "n", at), "suffix-kept"), total


def _cuts(contexts: DataFrame, pairs: DataFrame) -> list[int]:
    """Where the parts begin: runs of places with at most ``MAX_CONTEXTS`` contexts and ``MAX_PAIRS`` pairs, or one place alone (that has a context of each length at most)."""
    first = [0]
    if contexts.count() <= MAX_CONTEXTS and pairs.count() <= MAX_PAIRS:
        return first
    one, none = F.lit(1).alias("c"), F.lit(0)
    sizes = contexts.select("at", one, none.alias("p")).union(pairs.select("at", none.alias("c"), F.lit(1).alias("p"))).groupBy("at").agg(F.sum("c"), F.sum("p"))
    held = wide = 0
    for at, c, p in sizes.orderBy("at").toLocalIterator():  # a partition at a time
        if held and (held + c > MAX_CONTEXTS or wide + p > MAX_PAIRS):
            first.append(at)
            held = wide = 0
        held, wide = held + c, wide + p
    return first


def _grown(counts: DataFrame, kind: int, depth: int, p_min: float, pair: float, symbols: int, gain: float, **how) -> Tree | Parts:
    """The tree of all frequent contexts of a kind, in parts if it is large."""
    contexts, pairs, total = _frequent(counts, kind, depth, p_min, pair)
    first = _cuts(contexts, pairs)
    if len(first) > 1:
        pairs = staging.keep(pairs.repartitionByRange("at").sortWithinPartitions("at"), "suffix-sorted")

    def part(i: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        mine = F.col("at") >= first[i]
        if i + 1 < len(first):
            mine &= F.col("at") < first[i + 1]
        for k in range(depth):
            mine |= (F.col("k") == k) & (F.col("ctx") == first[i] >> 8 * (depth - k))
        return _columns(contexts.where(mine).select("k", "ctx", "n").orderBy("k", "ctx")), _columns(pairs.where(mine).select("k", "ctx", "next", "n").orderBy("k", "ctx", "next"))

    if len(first) == 1:
        return grow(*part(0), total, symbols, gain=gain, **how)
    # contexts that belong to several parts are kept in all if a longer one in any of them is kept
    shared = {(k, at >> 8 * (depth - k)) for at in first for k in range(1, depth)}
    also = set().union(*(shared & _kept(*_listed(*part(i)), max(1, total), gain) for i in range(len(first))))
    folder = staging.folder(counts.sparkSession, "suffix-parts")
    for i in range(len(first)):
        staging.commit_file(f"{folder}/{i}", pickle.dumps(grow(*part(i), total, symbols, gain=gain, also=also, **how), protocol=5))
    return Parts(np.array(first, np.uint64), folder)


def _listed(contexts: list[np.ndarray], pairs: list[np.ndarray]) -> tuple[dict, dict]:
    """How often each context was seen, and its next symbols with their counts."""
    n = {(int(k), int(c)): float(v) for k, c, v in zip(*contexts, strict=True)}
    k, ctx, nxt, ns = (x.astype(np.int64) for x in pairs)
    cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (ctx[1:] != ctx[:-1])])) if len(k) else np.zeros(0, np.int64)
    return n, {(int(k[i]), int(ctx[i])): (nxt[i:j], ns[i:j].astype(float)) for i, j in pairwise([*cut.tolist(), len(k)])}


def _kept(n: dict, rows: dict, total: int, gain: float) -> set[tuple[int, int]]:
    """The contexts (k, ctx) that pass the divergence tests, with all their suffixes; symbols that are not listed one by one count as one more."""
    kept: set[tuple[int, int]] = set()
    for (k, ctx), size in n.items():
        if not k or (k - 1, ctx >> 8) not in n or (k, ctx) not in rows:
            continue
        short, wide = rows[k - 1, ctx >> 8], n[k - 1, ctx >> 8]
        own = rows[k, ctx]
        at = np.searchsorted(short[0], own[0])
        p, q = own[1] / size, short[1][np.minimum(at, len(short[0]) - 1)] / wide
        bits = float((p * np.log2(p / q)).sum())
        rest, other = max(0.0, 1 - p.sum()), max(1e-12, 1 - q.sum())
        bits += rest * np.log2(rest / other) if rest > 1e-12 else 0.0
        kinds = max(1, len(own[0]) - 1)
        if size / total * bits >= gain and 2 * size * bits * np.log(2) >= kinds + 3 * np.sqrt(2 * kinds):
            while k and (k, ctx) not in kept:
                kept.add((k, ctx))
                k, ctx = k - 1, ctx >> 8
    return kept


@dataclass(frozen=True)
class Tree:
    """Contexts by node (0 is the empty one): ``child`` by node and column, where ``column`` is that of a byte (0: seen in no retained context).
    Next-symbol log10 probabilities: ``logp`` for the pairs ``pair`` (node x ``symbols`` + symbol, sorted); a symbol without a pair gets the
    shorter context's, by ``up``, plus the node's ``rest``."""

    column: np.ndarray
    child: np.ndarray
    up: np.ndarray
    symbols: int
    pair: np.ndarray
    logp: np.ndarray
    rest: np.ndarray

    def states(self, contexts: Iterator[np.ndarray], size: int) -> np.ndarray:
        """The node of the longest retained context at each position."""
        node = np.zeros(size, np.int64)
        live = np.arange(size)
        width, flat_child = self.child.shape[1], self.child.reshape(-1)
        for before in contexts:
            deeper = flat_child[node[live] * width + self.column[before[live]]]
            going = deeper > 0
            live = live[going]
            node[live] = deeper[going]
        return node

    def score(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol in its state."""
        out = np.zeros(len(node))
        if not len(self.pair):  # all pairs are there
            return self.logp[node * self.symbols + symbol].astype(np.float64)
        left = np.arange(len(node))
        node = node.copy()
        while len(left):
            key = node[left] * self.symbols + symbol[left]
            at = np.searchsorted(self.pair, key)
            at[at == len(self.pair)] = 0
            hit = self.pair[at] == key
            out[left[hit]] += self.logp[at[hit]]
            left = left[~hit]
            out[left] += self.rest[node[left]]
            node[left] = self.up[node[left]]
        return out

    def logs(self, asked: list[Asked], depth: int) -> list[np.ndarray]:
        """log10 of the probability of each symbol after the bytes before it."""
        return [self.score(self.states(stream.contexts(pos, row, depth), len(pos)), symbol) for stream, pos, row, symbol in asked]


@dataclass(frozen=True)
class Parts:
    """A tree in parts. Part i, a ``Tree`` in the folder, is that of the positions whose bytes before, nearest first, make a number from ``first[i]`` up to the next part's."""

    first: np.ndarray
    folder: str

    def logs(self, asked: list[Asked], depth: int) -> list[np.ndarray]:
        out = [np.empty(len(pos)) for _, pos, _, _ in asked]
        own = [np.searchsorted(self.first, stream.codes(pos, row, np.zeros(len(pos)), depth) >> np.uint64(64 - 8 * depth), "right") - 1 for stream, pos, row, _ in asked]
        for i in range(len(self.first)):
            mine = [np.flatnonzero(x == i) for x in own]
            if any(map(len, mine)):
                tree = pickle.loads(staging.read_file(f"{self.folder}/{i}"))
                for log, at, (stream, pos, row, symbol) in zip(out, mine, asked, strict=True):
                    log[at] = tree.score(tree.states(stream.contexts(pos[at], row[at], depth), len(at)), symbol[at])
        return out


def grow(contexts: list[np.ndarray], pairs: list[np.ndarray], total: int, symbols: int, *, all_pairs: bool, gain: float = GAIN, smooth: float = SMOOTH, kindful: float = 1.0, also: frozenset | set = frozenset()) -> Tree:
    """The tree of the frequent contexts, with those in ``also``. With ``all_pairs`` every node has every symbol's probability; else a node has those of its pairs."""
    n, rows = _listed(contexts, pairs)
    nodes = {x: i for i, x in enumerate([(0, 0), *sorted(_kept(n, rows, max(1, total), gain).union(x for x in also if x in n))])}
    used = sorted({c & 255 for k, c in nodes if k})
    column = np.zeros(256, np.int64)
    column[used] = np.arange(1, len(used) + 1)
    child, up, rest = np.zeros((len(nodes), len(used) + 1), np.int32), np.zeros(len(nodes), np.int64), np.zeros(len(nodes))
    root = np.full(symbols, 1.0)
    if (0, 0) in rows:
        root[rows[0, 0][0]] += rows[0, 0][1]
    listed: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(symbols), root / root.sum())]

    def probability(node: int, which: np.ndarray) -> np.ndarray:
        of, p = listed[node]
        at = np.minimum(np.searchsorted(of, which), len(of) - 1)
        hit = of[at] == which
        out = np.where(hit, p[at], 0.0)
        if not hit.all():
            out[~hit] = 10.0 ** rest[node] * probability(int(up[node]), which[~hit])
        return out

    for (k, ctx), i in nodes.items():  # shorter ones first
        if not k:
            continue
        above = nodes[k - 1, ctx >> 8]
        child[above, column[ctx & 255]], up[i] = i, above
        which, count = rows[k, ctx]
        weight = max(smooth, kindful * len(which))  # Witten and Bell: as much as there are kinds of next symbols
        if all_pairs:
            mine = listed[above][1] * weight
            mine[which] += count
            listed.append((listed[0][0], mine / mine.sum()))
            continue
        before = probability(above, which)
        mine = (before * weight + count) / (n[k, ctx] + weight)
        rest[i] = np.log10(max(1e-9, 1 - mine.sum()) / max(1e-9, 1 - before.sum()))
        listed.append((which, mine))
    pair = np.zeros(0, np.int64) if all_pairs else np.concatenate([i * symbols + which for i, (which, _) in enumerate(listed)])
    return Tree(column, child, up, symbols, pair, np.concatenate([np.log10(p).astype(np.float32) for _, p in listed]), rest)


@dataclass(frozen=True)
class Model:
    heads: np.ndarray  #: hashes of the frequent words, sorted
    next: Tree | Parts
    spell: Tree | Parts
    often: np.ndarray  #: hashes of the words whose counts are broadcast, sorted
    often_n: np.ndarray
    escaped: int  #: escaped training words
    new: float  #: what the discounts leave, a share of them
    least: float  #: counts from here on are in ``often``
    total: int  #: training tokens
    kinds: int
    texts: int


def train(texts: DataFrame, *, text_col: str = "text", p_min: float = P_MIN, gain: float = GAIN, smooth: float = SMOOTH, head: float = HEAD, pair: float = PAIR, often: float = OFTEN) -> tuple[Model, DataFrame]:
    """The model, and the words' counts (``key``: hash, ``n``)."""
    counts = _counted(texts, text_col, None, "suffix-words")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = n_words + ends, kinds + (ends > 0)
    least = max(2.0, min(often * total, _least(head, total, 2.0)))
    often_key, often_n = (x.astype(np.int64) for x in _columns(words.where(F.col("n") >= least).orderBy("key")))
    is_head = often_n >= _least(head, total, 2.0)
    heads = often_key[is_head]
    below = _counted(texts, text_col, texts.sparkSession.sparkContext.broadcast(heads), "suffix-contexts")
    spell = _grown(below, SPELL, SPELL_DEPTH, p_min, 0.0, 256, gain, all_pairs=True, smooth=smooth)
    following = _grown(below, NEXT, NEXT_DEPTH, p_min, pair, len(heads) + 2, gain, all_pairs=False, smooth=smooth, kindful=2.0)
    escaped = n_words - int(often_n[is_head].sum())
    new = min(1.0, DISCOUNT * (kinds - (ends > 0) - len(heads)) / escaped) if escaped else 1.0
    return Model(heads, following, spell, often_key, often_n.astype(np.float64), int(escaped), new, least, int(total), int(kinds), int(ends)), words


def _bunches(pieces: Iterator[tuple[int, np.ndarray, np.ndarray]], most: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Runs of pieces that have ``most`` bytes or end there."""
    bunch, size = [], 0
    for piece in pieces:
        bunch.append(piece)
        size += len(piece[1])
        if size >= most:
            yield bunch
            bunch, size = [], 0
    if bunch:
        yield bunch


def score(documents: DataFrame, model: Model, words: DataFrame, *, text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """The columns in ``carry``, then ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = given.schema[:-1]
    more = {"n_tokens": T.LongType(), "head_known": T.LongType(), "head_log": T.DoubleType(), "head_score": T.DoubleType()}
    tail = T.StructType([T.StructField("key", T.LongType()), T.StructField("spelled", T.FloatType())])
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in more.items()], T.StructField("tail", T.ArrayType(tail))])
    escaped_words, new = max(1, model.escaped), max(model.new, 1e-300)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        finder, often_log = flat.Words(flat.SOLID), np.log10(m.often_n + 1)
        most = BUNCH if isinstance(m.next, Parts) or isinstance(m.spell, Parts) else 1
        for batch in batches:
            column = batch.num_columns - 1
            for bunch in _bunches(flat.pieces(batch.column(column)), most):
                firsts, streams = zip(*((first, Stream(data, offsets, finder)) for first, data, offsets in bunch), strict=True)
                tokens = [stream.tokens(m.heads) for stream in streams]
                nexts = m.next.logs([(stream, *x[:3]) for stream, x in zip(streams, tokens, strict=True)], NEXT_DEPTH)
                places = [stream.spelled(x[3]) for stream, x in zip(streams, tokens, strict=True)]
                spells = m.spell.logs([(stream, at, of, stream.symbols[at + 1].astype(np.int64)) for stream, (at, of) in zip(streams, places, strict=True)], SPELL_DEPTH)
                for first, stream, (_, row, _, escaped), following, logp in zip(firsts, streams, tokens, nexts, spells, strict=True):
                    rows = stream.rows
                    sums = np.bincount(row, weights=following, minlength=rows)
                    words_of = np.flatnonzero(escaped)
                    spelled = np.bincount(np.repeat(np.arange(len(words_of)), stream.size[words_of] + 1), weights=logp, minlength=len(words_of))
                    own = stream.hashes.view(np.int64)
                    place = np.searchsorted(m.often, own)
                    place[place == len(m.often)] = 0
                    known = m.often[place] == own if len(m.often) else np.zeros(len(own), bool)
                    logs = np.bincount(stream.row[known], weights=often_log[place[known]], minlength=rows) if known.any() else np.zeros(rows)
                    counted = known[words_of]
                    if counted.any():
                        share = (m.often_n[place[words_of[counted]]] - DISCOUNT) / escaped_words
                        sums += np.bincount(stream.row[words_of[counted]], weights=np.log10(share + new * 10.0 ** spelled[counted]), minlength=rows)
                    rest = np.concatenate([[0], np.cumsum(np.bincount(stream.row[~known], minlength=rows))]).astype(np.int32)
                    tails = pa.StructArray.from_arrays([pa.array(own[~known]), pa.array(spelled[~counted].astype(np.float32))], fields=[pa.field("key", pa.int64()), pa.field("spelled", pa.float32())])
                    columns = [np.diff(stream.before) + 1, np.bincount(stream.row[known], minlength=rows), logs, sums]
                    yield pa.RecordBatch.from_arrays([*[c.slice(first, rows) for c in batch.columns[:column]], *map(pa.array, columns), pa.ListArray.from_arrays(pa.array(rest), tails)], names=schema.names)

    # written, so that the row numbers and the tails come from files whatever is lost later
    half = staging.keep(given.mapInArrow(work, schema).withColumn("__row", F.monotonically_increasing_id()), "suffix-scores")
    rare = words.where(F.col("n") < model.least)
    of_known = F.log10((F.col("n") - F.lit(DISCOUNT)) / F.lit(float(escaped_words)) + F.lit(new) * F.pow(F.lit(10.0), F.col("spelled").cast("double")))
    tails = half.select("__row", F.inline("tail")).join(rare, "key", "left").groupBy("__row").agg(
        F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("tail_log"),
        F.count("n").alias("tail_known"),
        F.sum(F.coalesce(of_known, F.lit(float(np.log10(new))) + F.col("spelled").cast("double"))).alias("tail_score"),
    )
    none, zero, ends = F.lit(0).cast("long"), F.lit(0.0), float(np.log10(model.texts + 1.0))
    return half.join(tails, "__row", "left").select(
        *[F.col(f"`{f.name}`") for f in kept],
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", none) + F.lit(int(model.texts > 0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", zero) + F.lit(ends) - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.kinds + 1.0)))).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", zero)).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """``op1_suffix_tree``: learns from the documents that are not held out and scores all."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, words = train(documents.where(~held_out()))
    return score(documents, model, words, carry=(F.col("doc_id"), held_out().alias("held_out")))
