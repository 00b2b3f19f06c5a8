"""Language-model scoring with a weighted backoff automaton.

Model: n-grams of up to `order` tokens over all training documents, smoothed from the
bottom up.  A token is a word (A-Z lower-cased) or the end mark that closes every
document; a start mark is only ever context.

    P(w)         = (c(w) + 1) / (N + V + 1)                 N tokens, V distinct, one unknown
    P(w | h)     = (c(hw) + K * P(w | h')) / (c(h) + K)     if c(h) > 0; h' is h without its first token
                 = P(w | h')                                otherwise

The automaton: a state is a context that was seen, state 0 the empty one.  An arc of a state
h reads a token w that was seen after h, has the weight log10 P(w | h), and leads to the
longest suffix of hw that is a state.  The failure arc of h reads nothing, has the weight
log10 K / (c(h) + K), and leads to the state h'.  State 0 has an arc for every known token
and one for all others.  Each distribution sums to 1 over the V tokens and the unknown one.

A document is read once from left to right.  The walk carries the state; where the state has
no arc for the next token it follows failure arcs, adding their weights, until a state has
one.  All documents of a block walk in step, those that are over fall out.

Nothing of the corpus goes to the driver but N and V.  Counts grow with the input: a
block of documents sends its distinct n-grams with their training counts to the parts of
the hash space, a part adds them up, and answers each block with the totals of the
n-grams that the block has (see blocks.py).  So each block gets the piece of the
automaton that its documents can reach, and no process holds all of it.

N-grams are told apart by 64-bit hashes; a confusion changes two counts, nothing else.

Defined results: null or empty text is the end mark alone.  Held-out rows do not train.
Repeated rows all train and get equal scores.  Without training rows, N = V = 0 and
every token is unknown with probability 1.  Null ids are scored like others.  Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import blocks
from quillon.llm.common import column
from quillon.llm.textkit import U, plain, row_of, window_hashes, words

ORDER = 2
#: Strength of the shorter context, in counts.
K = 1024.0
START, END = U(0x5354415254), U(0x454E44)


def _sequences(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows in one array, each row as start, words, end; and where rows begin."""
    cut_rows, pieces = [np.zeros(1, np.int64)], []
    base = 0
    for w in words(text, lower=True):
        n = np.diff(w.first)
        row = row_of(w.first)
        begin = w.first + 2 * np.arange(len(w.first))
        seq = np.empty(len(w.hashes) + 2 * len(n), U)
        seq[begin[:-1]] = START
        seq[begin[1:] - 1] = END
        seq[np.arange(len(w.hashes)) + 1 + 2 * row] = w.hashes
        pieces.append(seq)
        cut_rows.append(begin[1:] + base)
        base += len(seq)
    return (np.concatenate(pieces) if pieces else np.zeros(0, U)), np.concatenate(cut_rows)


class _Grams:
    """For each order, the distinct n-grams of a block and where they end."""

    def __init__(self, text: pa.Array, order: int):
        seq, self.rows = _sequences(text)
        self.row = row_of(self.rows)
        self.seq = seq
        self.at, self.distinct, self.earliest, self.inverse = [], [], [], []
        for n in range(1, order + 1):
            h = seq if n == 1 else window_hashes(seq, n)
            ok = np.flatnonzero(self.row[: len(h)] == self.row[n - 1 : n - 1 + len(h)])
            u, begin, inv = np.unique(h[ok], return_index=True, return_inverse=True)
            self.at.append(ok + n - 1)  # place of the last token
            self.distinct.append(u)
            self.earliest.append(self.at[-1][begin])
            self.inverse.append(inv)


def _ask(t: pa.Table, order: int, n_parts: int) -> pa.Table:
    g = _Grams(plain(t["text"]), order)
    train = ~t["held_out"].to_numpy(zero_copy_only=False)
    counts = [np.bincount(g.inverse[n], train[g.row[g.at[n]]], len(g.distinct[n])).astype(np.int64) for n in range(order)]
    return pa.concat_tables([_questions(t["block"][0].as_py(), n + 1, g.distinct[n], counts[n], n_parts) for n in range(order)])


def _questions(block: int, n: int, u: np.ndarray, c: np.ndarray, n_parts: int) -> pa.Table:
    """Distinct n-grams and their counts, packed for each part that they reach."""
    full, cuts = blocks.part_spans(u, n_parts)
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.table(
        {
            "block": pa.array(np.full(len(full), block, np.int64)),
            "part": pa.array(full),
            "n": pa.array(np.full(len(full), n, np.int32)),
            "hashes": pa.array([blocks.sorted_packed(u[x:y]) for x, y in spans], pa.binary()),
            "counts": pa.array([blocks.counts_packed(c[x:y]) for x, y in spans], pa.binary()),
        }
    )


def _total(t: pa.Table) -> pa.Table:
    """Totals over all blocks, in the order in which each block asked."""
    hashes = [blocks.sorted_unpacked(x) for x in t["hashes"].to_pylist()]
    sizes = [len(h) for h in hashes]
    counts = np.concatenate([blocks.counts_unpacked(x, s) for x, s in zip(t["counts"].to_pylist(), sizes)])
    tag = np.repeat(t["n"].to_numpy(), sizes)
    h = np.concatenate(hashes)
    total = np.zeros(len(h), np.int64)
    for n in np.unique(tag):
        own = np.flatnonzero(tag == n)
        u, inv = np.unique(h[own], return_inverse=True)
        total[own] = np.bincount(inv, counts[own], len(u)).astype(np.int64)[inv]
    packed = [blocks.counts_packed(x) for x in np.split(total, np.cumsum(sizes)[:-1])]
    return pa.table({"block": t["block"], "part": t["part"], "n": t["n"], "totals": pa.array(packed, pa.binary())})


class Automaton:
    """States, arcs and failure arcs that the n-grams of some documents can reach.

    Arcs are numbered through all orders: arcs of order n leave states of n - 1 tokens.
    """

    def __init__(self, g: _Grams, totals: list[np.ndarray], order: int, k: float, n_train: int, n_types: int):
        self.unknown = -np.log10(n_train + n_types + 1.0)
        seen = [c > 0 for c in totals]
        # States: the empty context, then the contexts of 1 to order - 1 tokens that were seen.
        state, number = [np.zeros(1, np.int64)], 1
        for n in range(1, order):
            own = np.where(seen[n - 1], number + np.cumsum(seen[n - 1]) - 1, -1)
            state.append(own)
            number += int(seen[n - 1].sum())
        self.length = np.zeros(number, np.int64)  # tokens of each state's context
        self.fail = np.zeros(number, np.int64)
        self.fail_weight = np.zeros(number)
        self.arc_of = []  # by order, the arc of each distinct n-gram, -1 where none was seen
        target, weight, below, arcs = [], [], np.zeros(0), 0
        place_of = []  # by order, the distinct n-gram that ends at a place
        for n in range(1, order + 1):
            at = np.full(len(g.seq), -1, np.int64)
            at[g.at[n - 1]] = g.inverse[n - 1]
            place_of.append(at)
            last = g.earliest[n - 1]
            count = totals[n - 1].astype(float)
            if n == 1:
                p = (count + 1.0) / (n_train + n_types + 1.0)
            else:
                shorter = place_of[n - 2][last]  # the n-gram without its first token
                context = totals[n - 2][place_of[n - 2][last - 1]].astype(float)  # without its last one
                p = (count + k * below[shorter]) / (context + k)
            below = p
            yes = seen[n - 1] & (g.distinct[n - 1] != START) if n == 1 else seen[n - 1]
            own = np.where(yes, arcs + np.cumsum(yes) - 1, -1)
            arcs += int(yes.sum())
            self.arc_of.append(own)
            weight.append(np.log10(p[yes]))
            # An arc leads to its whole n-gram, or, at the highest order, to that without its first token.
            goal = state[n] if n < order else state[n - 1][place_of[n - 2][last]] if n > 1 else np.zeros(len(last), np.int64)
            target.append(np.where(g.seq[last] == END, 0, goal)[yes])
            if n < order:
                mine = state[n][seen[n - 1]]
                self.length[mine] = n
                self.fail_weight[mine] = np.log10(k / (count[seen[n - 1]] + k)) if k > 0 else -np.inf
                self.fail[mine] = state[n - 1][place_of[n - 2][last]][seen[n - 1]] if n > 1 else 0
        self.target, self.weight = np.concatenate(target), np.concatenate(weight)
        self.place_of = place_of
        start = np.flatnonzero(g.distinct[0] == START)
        self.start = int(state[1][start[0]]) if order > 1 and len(start) and state[1][start[0]] >= 0 else 0

    def walk(self, g: _Grams) -> tuple[np.ndarray, np.ndarray]:
        """Per document the sum of weights and the number of failure arcs that were followed."""
        # The arc that reads the token at each place, for a state of 0, 1, ... tokens that ends there.
        reads = np.stack([np.append(arc, -1)[at] for arc, at in zip(self.arc_of, self.place_of)])
        begin, size = g.rows[:-1] + 1, np.diff(g.rows) - 1
        order = np.argsort(-size, kind="stable")
        place, left = begin[order], size[order]
        state = np.full(len(order), self.start, np.int64)
        score, failures = np.zeros(len(order)), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")  # documents that have a next token
        for step, n in enumerate(alive.tolist()):
            s, at = state[:n], place[:n] + step
            arc = reads[self.length[s], at]
            stuck = np.flatnonzero((arc < 0) & (s > 0))
            while len(stuck):
                here = s[stuck]
                score[stuck] += self.fail_weight[here]
                failures[stuck] += 1
                s[stuck] = here = self.fail[here]
                arc[stuck] = reads[self.length[here], at[stuck]]
                stuck = stuck[(arc[stuck] < 0) & (here > 0)]
            known = arc >= 0
            score[:n] += np.where(known, self.weight[arc], self.unknown) if len(self.weight) else self.unknown
            s[:] = np.where(known, self.target[arc], 0) if len(self.target) else 0
        out, followed = np.empty(len(order)), np.empty(len(order), np.int64)
        out[order], followed[order] = score, failures
        return out, followed


def _score(t: pa.Table, answers: pa.Table, order: int, n_parts: int, k: float, n_train: int, n_types: int) -> pa.Table:
    if not len(t):
        return _SCHEMA.empty_table()
    g = _Grams(plain(t["text"]), order)
    totals = [np.zeros(len(u), np.int64) for u in g.distinct]
    spans = []
    for u in g.distinct:
        full, cuts = blocks.part_spans(u, n_parts)
        spans.append({p: (int(x), int(y)) for p, x, y in zip(full.tolist(), cuts[:-1], cuts[1:])})
    for part, n, raw in zip(answers["part"].to_pylist(), answers["n"].to_pylist(), answers["totals"].to_pylist()):
        a, b = spans[n - 1][part]
        totals[n - 1][a:b] = blocks.counts_unpacked(raw, b - a)
    score, failures = Automaton(g, totals, order, k, n_train, n_types).walk(g)
    count = totals[0][g.inverse[0]]  # of the token at each place
    token = np.ones(len(g.seq), bool)
    token[g.rows[:-1]] = False  # start marks are not scored
    add = lambda x: np.add.reduceat(np.where(token, x, 0), g.rows[:-1])
    return pa.table(
        {
            "id": t["id"],
            "held_out": t["held_out"],
            "n_tokens": np.diff(g.rows) - 1,
            "n_known": add((count > 0).astype(np.int64)),
            "train_tokens": np.full(len(t), n_train, np.int64),
            "base_score": add(np.log10((count + 1.0) / (n_train + n_types + 1.0))),
            "score": score,
            "n_failures": failures,
        },
        _SCHEMA,
    )


_SCHEMA = pa.schema(
    [("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_failures", pa.int64())]
)
_OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_failures long"
_ASKED = "block long, part long, n int, hashes binary, counts binary"
_TOTALS = "block long, part long, n int, totals binary"


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: texts to the distinct tokens of each batch and their counts."""
    for batch in batches:
        some, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for lo in range(0, batch.num_rows, 1024):  # few rows at a time, so that memory stays small
            seq, _ = _sequences(plain(batch.column(0).slice(lo, 1024)))
            u, c = np.unique(seq, return_counts=True)
            some.append(u)
            counts.append(c)
        u, inverse = np.unique(np.concatenate(some), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts), len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u[u != START].view(np.int64)), pa.array(c[u != START])], names=["token", "c"])


def vocabulary(rows: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the rows that train; counts are added up in each batch and task first."""
    got = rows.where("not held_out").select("text").mapInArrow(_token_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).agg(F.sum("c"), F.count(F.lit(1))).first()
    return int(got[0] or 0), int(got[1] or 0)


def lm_scores(docs: DataFrame, held_out: str = "held_out", order: int = ORDER, k: float = K, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = blocks.BLOCK_BYTES, part_entries: int = blocks.PART_ENTRIES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score, n_failures (failure arcs followed).

    Learns from rows where `held_out` is false.
    """
    n_blocks, n_parts = blocks.sizes(docs, text_col, block_bytes, part_entries, order)
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"), F.coalesce(column(held_out), F.lit(False)).alias("held_out"))
    n_train, n_types = vocabulary(rows)
    dealt = blocks.by_hash(rows, n_blocks, "id", "text")
    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask(t, order, n_parts), _ASKED)
    answers = asked.groupBy("part").applyInArrow(_total, _TOTALS)
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: _score(t, a, order, n_parts, k, n_train, n_types), _OUT)
    return out.withColumnRenamed("id", id_col)
