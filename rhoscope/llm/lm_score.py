"""Language-model scores of whole texts by a weighted backoff automaton.

The model is an n-gram model of any ``order`` (3 by default) with Dirichlet smoothing over an additive unigram model:
P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and for a context h of k - 1 words, with h' being h without its first,
Pk(w | h) = (c(h w) + mass_k P(k-1)(w | h')) / (c(h) + mass_k). As an automaton, every known context of up to
order - 1 words (the start of a text counts as one) is a state. A known n-gram is an arc from its context's state,
carries its smoothed log-probability and leads to the longest state that it ends in; a failure arc carries
log(mass_k / (c(h) + mass_k)) and leads from h to h'. The root has an arc for every word. A traversal from left to
right carries its state along: it follows failure arcs until the state has an arc for the token, and adds up weights.

The automaton of a whole corpus fits no machine, so it is cut by use. Texts are dealt into blocks by hash. A block
sends its distinct words and bigrams with its own training counts, packed, to the parts of the key space; a part
sums them and answers with corpus counts in the order in which it was asked. Longer n-grams follow, order by order:
one whose first or last words are in no other block has its block's own count, and isn't asked for. A
block then holds just the states and arcs that its texts can reach, and traverses them. What is sent grows with the
corpus; a word that is a third of all tokens is one key per block. Words are 64-bit hashes, n-grams 48-bit ones.

Cases: a null or empty text is one end token. Repeated rows are texts of their own and count as often. With no
training text all counts are 0. A null doc_id is held out or learned from as the caller's ``learn`` says; null
counts as not learned. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import BASE, U, discard, mix, pack, runs, settled, texts_of, trim, unpack, word_hashes
from rhoscope.llm.shared import HASHED_BYTES, planes, unplanes

#: Bytes of text of a block and keys of a part that are worked on at once, for executors of 3 GB.
BLOCK_BYTES, PART_KEYS = 8_000_000, 1_500_000
START, END = (int(x) for x in mix(np.array([1, 2], U)))
#: Of bigrams, trigrams and so on; longer ones take the last.
MASSES = (400.0, 4.0)
#: Tokens that a traversal follows at a stretch.
LANE = 256


def bits(order: int) -> int:
    """Highest bits that a key keeps."""
    return 64 if order == 1 else 48


class Tokens:
    """The tokens of a block of texts, words and one end each, and the n-grams that end at them.

    By order: ``keys``, the distinct n-grams in key order; ``ids``, that of each token (-1: it has none); ``suffix``
    and ``context``, each n-gram's last and first words as an n-gram of one order less.
    """

    def __init__(self, column: pa.ChunkedArray, order: int):
        offsets, data = texts_of(column)
        words, counts = [], []
        for a, b in runs(offsets, HASHED_BYTES):
            w, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            words.append(w)
            counts.append(np.diff(first))
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.order, self.first = order, np.r_[0, np.cumsum(count + 1)]
        token = np.full(self.first[-1], END, U)
        inner = np.ones(token.size, bool)
        inner[self.first[1:] - 1] = False
        if words:
            token[inner] = np.concatenate(words)
        self.texts = np.repeat(np.arange(count.size, dtype=np.int32), count + 1)
        begin = self.first[:-1]
        # The start is among the words.
        keys, ids = np.unique(np.r_[token, np.array([START], U)], return_inverse=True)
        self.start = int(ids[-1])
        self.keys, self.ids, self.suffix, self.context = {1: keys}, {1: ids[:-1].astype(np.int32)}, {}, {}
        place = np.arange(token.size) - begin[self.texts]
        gram = token
        for k in range(2, order + 1):
            longer = np.empty_like(gram)
            longer[1:] = gram[:-1]
            if k == 2:
                longer[begin] = START
            gram = mix(longer * U(BASE) + token)
            some = np.flatnonzero(place >= k - 2)
            self.keys[k], at, ids = np.unique(gram[some] >> U(64 - bits(k)), return_index=True, return_inverse=True)
            self.ids[k] = np.full(token.size, -1, np.int32)
            self.ids[k][some] = ids
            at = some[at]
            self.suffix[k] = self.ids[k - 1][at]
            self.context[k] = self.ids[k - 1][np.maximum(at - 1, 0)]
            if k == 2:
                self.context[k] = np.where(place[at] > 0, self.context[k], self.start)

    def own(self, learned: np.ndarray, k: int) -> np.ndarray:
        """How often the learned texts have each n-gram."""
        ids = self.ids[k][learned[self.texts]]
        return np.bincount(ids[ids >= 0], minlength=self.keys[k].size)

    def open(self, k: int, shared: dict[int, np.ndarray]) -> np.ndarray:
        """Which n-grams may be in other blocks too, given the shorter ones that are."""
        if k <= 2:
            return np.arange(self.keys[k].size)
        return np.flatnonzero(shared[k - 1][self.suffix[k]] & shared[k - 1][self.context[k]])

    def counted(self, learned: np.ndarray, answers: dict[int, np.ndarray], most: int) -> tuple[dict, dict]:
        """Corpus counts of the orders up to ``most``, and which n-grams other blocks have, from the answers."""
        counts, shared = {}, {}
        for k in range(1, most + 1):
            counts[k], shared[k] = self.own(learned, k), np.zeros(self.keys[k].size, bool)
            some = self.open(k, shared)
            if some.size:
                counts[k][some], shared[k][some] = answers[k] >> 1, answers[k] & 1
        return counts, shared


class Automaton:
    """States and arcs that one block's texts can reach."""

    def __init__(self, tokens: Tokens, counts: dict[int, np.ndarray], total: int, distinct: int, texts: int, masses: tuple[float, ...]):
        self.tokens, order = tokens, tokens.order
        self.known = counts[1][tokens.ids[1]] > 0
        p = {1: (counts[1] + 0.5) / (total + 0.5 * (distinct + 1))}
        self.root = np.log10(p[1])
        # A word is a context each time it is a token, the start once per text; no context ends in an end.
        seen = {1: counts[1].astype(np.float64)} | {k: counts[k].astype(np.float64) for k in range(2, order)}
        seen[1][tokens.start] = texts
        # State 0 is the root; the states of contexts of k words come behind those of fewer.
        sizes = [tokens.keys[k].size for k in range(1, order)]
        base = dict(zip(range(1, order), np.r_[1, 1 + np.cumsum(sizes)].tolist(), strict=False))
        n = 1 + sum(sizes)
        self.fail, self.failure = np.zeros(n, np.int64), np.zeros(n)
        self.start = base[1] + tokens.start if texts and order > 1 else 0
        names, leads, weights = [], [], []
        for k in range(2, order + 1):
            mass = masses[min(k - 2, len(masses) - 1)]
            own = slice(base[k - 1], base[k - 1] + sizes[k - 2])
            self.failure[own] = np.log10(mass / (seen[k - 1] + mass))
            if k > 2:
                self.fail[own] = base[k - 2] + tokens.suffix[k - 1]
            p[k] = (counts[k] + mass * p[k - 1][tokens.suffix[k]]) / (seen[k - 1][tokens.context[k]] + mass)
            some = np.flatnonzero(counts[k] > 0)
            word = tokens.suffix[k][some]
            for j in range(k - 1, 1, -1):
                word = tokens.suffix[j][word]
            names.append((base[k - 1] + tokens.context[k][some].astype(np.int64)) * tokens.keys[1].size + word)
            leads.append(base[k] + some if k < order else base[k - 1] + tokens.suffix[k][some])
            weights.append(np.log10(p[k][some]))
        if order > 1:
            names = np.concatenate(names)
            by_name = np.argsort(names)
            self.names, self.leads, self.weights = names[by_name], np.concatenate(leads)[by_name].astype(np.int32), np.concatenate(weights)[by_name]
        else:
            self.names, self.leads, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        # From the root a known word leads to its own state.
        self.enter = np.where(seen[1] > 0, base[1] + np.arange(sizes[0]), 0) if order > 1 else np.zeros(tokens.keys[1].size, np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each, and the weight of the way there."""
        weight, out = np.zeros(state.size), np.empty_like(state)
        left, at = np.arange(state.size), state
        while left.size:
            root = at == 0
            some = left[root]
            weight[some] += self.root[word[some]]
            out[some] = self.enter[word[some]]
            left, at = left[~root], at[~root]
            if not left.size:
                break
            name = at * self.tokens.keys[1].size + word[left]
            arc = np.minimum(np.searchsorted(self.names, name), self.names.size - 1) if self.names.size else np.zeros(left.size, np.int64)
            found = self.names[arc] == name if self.names.size else np.zeros(left.size, bool)
            weight[left[found]] += self.weights[arc[found]]
            out[left[found]] = self.leads[arc[found]]
            left, at = left[~found], at[~found]
            weight[left] += self.failure[at]
            at = self.fail[at]
        return out, weight

    def traverse(self) -> np.ndarray:
        """Weight of the way at every token.

        Texts are followed side by side in lanes of LANE tokens. A state is the longest known context among the last
        order - 1 tokens, so a lane within a text gets its state by following as many tokens before it.
        """
        first, word = self.tokens.first, self.tokens.ids[1]
        lengths = np.diff(first)
        lanes = -(-lengths // LANE)
        begin = np.repeat(first[:-1] - LANE * np.r_[0, np.cumsum(lanes)[:-1]], lanes) + LANE * np.arange(lanes.sum())
        end = np.minimum(begin + LANE, np.repeat(first[1:], lanes))
        opened = np.repeat(first[:-1], lanes)
        at = np.maximum(begin - (self.tokens.order - 1), opened)
        order = np.argsort(at - end, kind="stable")
        begin, end, at = begin[order], end[order], at[order]
        state = np.where(at == opened[order], self.start, 0).astype(np.int64)
        out = np.zeros(word.size)
        size = end - at
        for t in range(int(size.max(initial=0))):
            some = int(np.searchsorted(-size, -t, "left"))  # lanes with more than t tokens come first
            here = at[:some] + t
            state[:some], weight = self.step(state[:some], word[here])
            counts = here >= begin[:some]
            out[here[counts]] = weight[counts]
        return out


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if first.size > 1 else np.zeros(0)


def cuts(keys: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Edges of the parts of the key space in sorted keys."""
    inner = [((p << width) // parts) for p in range(1, parts)]
    return np.r_[0, np.searchsorted(keys, np.array(inner, U)), keys.size].astype(np.int64)


ASKED = "part int, block int, kind int, keys binary, counts binary"
ANSWER = "block int, part long, kind int, counts binary, total long, distinct long"


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    """What a block was told, by order: twice the count, and one more if other blocks have asked too."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "counts")), strict=True))
    return {k: np.concatenate([unnumbers(c) for kind, _, c in rows if kind == k]) for k in {r[0] for r in rows}}


def score_texts(documents: DataFrame, learn: Column, order: int = 3, masses: tuple[float, ...] = MASSES, block_bytes: int | None = None, part_keys: int | None = None) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score); log10, learning where ``learn`` holds.

    ``block_bytes`` and ``part_keys`` should follow the executors' memory: b blocks ask p parts in up to b p rows.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    rows = documents.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count("*")).first()[0]
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    parts = max(1, -(-size // (6 * (part_keys or PART_KEYS))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def asks(table: pa.Table, tokens: Tokens, orders, shared) -> pa.Table:
        block, out = table.column("block")[0].as_py(), []
        for k in orders:
            some = tokens.open(k, shared)
            keys, known = tokens.keys[k][some], tokens.own(table.column("learned").to_numpy(), k)[some]
            edges = cuts(keys, bits(k), parts)
            out += [(p, block, k, pack(keys[a:b]), planes(known[a:b])) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "kind", "keys", "counts"])

    def begin(table: pa.Table) -> pa.Table:
        tokens = Tokens(table.column("text"), min(order, 2))
        trim()
        return asks(table, tokens, tokens.keys, {})

    def go_on(k: int):
        def work(table: pa.Table, answered: pa.Table) -> pa.Table:
            tokens = Tokens(table.column("text"), k)
            _, shared = tokens.counted(table.column("learned").to_numpy(), _answers(answered), k - 1)
            trim()
            return asks(table, tokens, [k], shared)

        return work

    def answer(table: pa.Table) -> pa.Table:
        part, block, kind, keys, counts = (table.column(c).to_pylist() for c in ("part", "block", "kind", "keys", "counts"))
        out = []
        for k in set(kind):
            own = [i for i, x in enumerate(kind) if x == k]
            lists = [unpack(keys[i]) for i in own]
            distinct, place, asking = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            total = np.bincount(place, np.concatenate([unplanes(counts[i]) for i in own]), distinct.size).astype(np.int64)
            edges = np.cumsum([0, *(x.size for x in lists)])
            told = 2 * total + (asking > 1)
            out += [(block[i], part[i], k, numbers(told[place[a:b]]), None, None) for i, a, b in zip(own, edges[:-1], edges[1:], strict=True)]
            if k == 1:
                ends = np.searchsorted(distinct, np.array([END], U))[0]
                texts = int(total[ends]) if ends < distinct.size and distinct[ends] == END else 0
                out.append((-1, texts, 1, None, int(total.sum()), int((total > 0).sum())))
            trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "part", "kind", "counts", "total", "distinct"])

    asked = dealt.groupBy("block").applyInArrow(begin, ASKED)
    answers = [settled(asked.groupBy("part").applyInArrow(answer, ANSWER))]
    total, distinct, texts = (x or 0 for x in answers[0].filter("block < 0").agg(F.sum("total"), F.sum("distinct"), F.sum("part")).first())
    told = lambda: reduce(DataFrame.unionAll, answers).filter("block >= 0")
    for k in range(3, order + 1):
        asked = dealt.groupBy("block").cogroup(told().groupBy("block")).applyInArrow(go_on(k), ASKED)
        answers.append(settled(asked.groupBy("part").applyInArrow(answer, ANSWER)))

    def score(table: pa.Table, answered: pa.Table) -> pa.Table:
        tokens = Tokens(table.column("text"), order)
        counts, _ = tokens.counted(table.column("learned").to_numpy(), _answers(answered), order)
        machine = Automaton(tokens, counts, total, distinct, texts, masses)
        n = np.diff(tokens.first)
        columns = [
            table.column("doc_id"),
            table.column("learned"),
            pa.array(n, pa.int64()),
            pa.array(per_text(machine.known.astype(np.int64), tokens.first), pa.int64()),
            pa.array(np.full(n.size, total), pa.int64()),
            pa.array(per_text(machine.root[tokens.ids[1]], tokens.first), pa.float64()),
            pa.array(per_text(machine.traverse(), tokens.first), pa.float64()),
        ]
        del machine, tokens
        trim()
        return pa.table(columns, names=["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = settled(dealt.groupBy("block").cogroup(told().groupBy("block")).applyInArrow(score, shape))
    discard(*answers)
    return out


def numbers(values: np.ndarray) -> bytes:
    """Counts in as many byte planes as the largest needs."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if values.size else 1
    return bytes([wide]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unnumbers(packed: bytes) -> np.ndarray:
    wide = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(wide, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :wide] = raw.T
    return out.view("<u8").ravel().astype(np.int64)
