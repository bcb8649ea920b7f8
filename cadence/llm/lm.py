"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

The model: one layer of masked self-attention over the last pieces gives a distribution over groups of pieces and, from the
same state, over the pieces of a group, so every piece of the vocabulary is predicted from its context. A word's probability
mixes that of its pieces with its discounted share of all training tokens (absolute discounting; what the discount leaves
is spelt by the pieces): over all words and the end of a text it sums to one.

All is learnt from all training documents: words and pieces are counted over them, and the weights are fitted on every
piece of them. A bounded part starts the weights on the driver; executors then read every training text whole, each from
the same start, and their weights are averaged. The mixture is the one that suits all training tokens, each counted without itself.

Scoring reads overlapping context windows: each window scores its last pieces, so that every piece is scored
once with at least ``window - fresh`` pieces before it (or all there are), many windows at a time by masked matrix
products.

How the corpus flows: one narrow pass cuts the texts into blocks of documents, each a row with its words
coded by its own dictionary, and that table is written to the shared folder. The blocks' dictionaries (a word
once a block, however often it stands there) are counted over the corpus and joined back, so neither a
frequent word nor a long document gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import fold, hold, slices, staged, tokenizer_path, trim


@dataclass(frozen=True)
class Settings:
    """window, fresh: pieces of a window and those that it scores; width: of the model; heads: groups of pieces of like weight that the
    first softmax tells apart; widest: pieces of a group; inputs: pieces with an embedding of their own; the weights start on one word in
    ``share`` of training texts, in runs of ``run`` words, out of no less than ``least`` bytes of text or all there are; first: pieces of that
    which the driver reads at most; steps, batch, rate: of the start. All training texts follow: learner: pieces after which the next learner begins; gather: batches of one of its steps;
    slow: its rate. block: bytes of text in a block of documents."""

    model: str = "piece_bpe_32k.model"
    window: int = 32
    fresh: int = 24
    width: int = 24
    heads: int = 64
    widest: int = 2048
    inputs: int = 2048
    share: float = 24
    least: int = 8 << 20
    run: int = 36
    first: int = 1_500_000
    learner: int = 8_000_000
    gather: int = 4
    steps: int = 900
    batch: int = 256
    rate: float = 0.02
    slow: float = 0.002
    block: int = 6 << 20


@lru_cache(maxsize=4)
def library(model: str):
    """The sentencepiece library with a model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1 ... of every range."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


class Attention:
    """Weights of the model; fit() and score() in numpy.

    A piece's probability is that of its group times its own within the group, both from the same attended state. Groups hold pieces
    of like weight in the corpus, by descending frequency; a frequent piece is a group of its own.
    """

    def __init__(self, counts: np.ndarray, s: Settings):
        """counts: of every piece in the training corpus; the last is the end of a text."""
        self.s, self.size = s, len(counts)
        order = np.argsort(-counts, kind="stable")
        weight = counts[order] + 0.1
        target, groups, held, most = weight.sum() / s.heads, [0], 0.0, 0
        known = int((counts > 0).sum()) or self.size  # pieces that no training text has are alike: one group, whose shares nothing moves
        for k, w in enumerate(weight.tolist()):
            if most and (k == known or k < known and (held + w > target or most >= s.widest)):
                groups.append(k)
                held, most = 0.0, 0
            held, most = held + w, most + 1
        #: first place of each group in the order of frequency, and the end
        self.cut = np.array([*groups, self.size], np.int64)
        self.many = len(groups)
        self.place = np.empty(self.size, np.int64)
        self.place[order] = np.arange(self.size)
        self.group = np.repeat(np.arange(self.many), np.diff(self.cut))[self.place].astype(np.int32)
        self.wide = np.diff(self.cut) > 1
        total = np.add.reduceat(weight, self.cut[:-1])
        inputs = min(s.inputs, self.size)
        self.inp = (inputs + self.group).astype(np.int32)
        self.inp[order[:inputs]] = np.arange(inputs)
        self.begin = inputs + self.many
        d, rng = s.width, np.random.default_rng(61)

        def draw(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        inner = np.zeros((self.size, d + 1), np.float32)  # a piece's weights within its group; the last is its share
        inner[:, d] = np.log(weight / total[np.repeat(np.arange(self.many), np.diff(self.cut))])
        self.w = {"emb": draw(inputs + self.many + 1, d, scale=0.3), "pos": draw(s.window, d, scale=0.1), "q": draw(d, d), "k": draw(d, d), "v": draw(d, d), "o": draw(d, d), "u": draw(d, self.many), "b": np.log(total / total.sum()).astype(np.float32), "inner": inner}
        t = np.arange(s.window)
        seen = t[None, :] <= (s.window - s.fresh + np.arange(s.fresh))[:, None]
        self.later = np.where(seen, 0, -1e9).astype(np.float32)
        self.first = np.where(seen & (t[None, :] >= s.window - s.fresh), 0, -1e9).astype(np.float32)

    def inputs_of(self, pieces: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """What stands before each piece: the piece before, or the begin mark at a text's begin."""
        out = np.empty(len(pieces), np.int32)
        out[1:] = self.inp[pieces[:-1]]
        out[begins] = self.begin
        return out

    def windows(self, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first scored place, pieces scored, whether at a text's begin) of every window."""
        n = -(-sizes // self.s.fresh)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(begins, n) + k * self.s.fresh
        return start, np.minimum(self.s.fresh, np.repeat(begins + sizes, n) - start), k == 0

    def _products(self) -> tuple[np.ndarray, np.ndarray]:
        """The layer on its inputs: queries times keys as one form of two inputs, values times the output as one map."""
        w = self.w
        return w["q"] @ w["k"].T * w["q"].dtype.type(self.s.width**-0.5), w["v"] @ w["o"]

    def _forward(self, ins: np.ndarray, bias: np.ndarray):
        w, s = self.w, self.s
        form, through = self._products()
        x = w["emb"].take(ins, 0, mode="clip")
        x += w["pos"]
        own = np.ascontiguousarray(x[:, s.window - s.fresh :])
        q = (own.reshape(-1, s.width) @ form).reshape(own.shape)
        a = np.matmul(q, x.transpose(0, 2, 1))
        a += bias
        if a.size and a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a /= (a @ np.ones(s.window, a.dtype) + 1e-30)[..., None]
        c = np.matmul(a, x)
        more = (c.reshape(-1, s.width) @ through).reshape(own.shape)
        return x, own, q, a, c, more, more + own

    @staticmethod
    def _powers(logits: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Each row's softmax less one at its own place, times its weight; the logits' room is used up."""
        if logits.size and not (logits.max() < 80 and logits.min() > -80):  # else single precision holds all powers
            logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (weight / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
        logits[np.arange(len(own)), own] -= weight
        return logits

    def _gradients(self, i: np.ndarray, bias: np.ndarray, y: np.ndarray, live: np.ndarray | None = None, rows: int = 256) -> tuple[dict[str, np.ndarray], list[tuple[int, int, np.ndarray]]]:
        """Of the mean cross entropy of pieces y (those that are live): dense ones by name, and (first place, end, rows) of the groups that occur.
        rows: windows at a time, so that they stay in the cache; the pieces of a group go all at once."""
        s, w, d = self.s, self.w, self.s.width
        flat = lambda z: z.reshape(-1, z.shape[-1])
        kind, back, target = w["u"].dtype, s.window - s.fresh, y.reshape(-1)
        group, weight = self.group[target], np.full(len(target), 1 / max(1, len(target) if live is None else int(live.sum())), kind)
        if live is not None:
            weight *= live.reshape(-1)
        held, state = [], np.ones((len(target), d + 1), kind)  # the last is the bias' input
        for a in range(0, len(i), rows):
            x, _, q, e, c, _, h = self._forward(i[a : a + rows], bias[a : a + rows])
            state[a * s.fresh : (a + len(h)) * s.fresh, :d] = flat(h)
            held.append((x, q, e, c))
        # shares within groups
        inner, spot = [], np.flatnonzero(self.wide[group] & (weight > 0))
        order = spot[np.argsort(group[spot].astype(np.int16), kind="stable")]
        edge = np.searchsorted(group[order], np.arange(self.many + 1))
        own, place, part, back_in = state.take(order, 0), self.place[target[order]], weight[order], np.empty((len(order), d), kind)
        for n in np.flatnonzero(np.diff(edge)).tolist():
            e, f, lo, hi = int(edge[n]), int(edge[n + 1]), int(self.cut[n]), int(self.cut[n + 1])
            grad, most, side = 0, max(1, (1 << 18) // (hi - lo)), w["inner"][lo:hi]
            for e in range(e, f, most):
                g = min(f, e + most)
                z = self._powers(own[e:g] @ side.T, part[e:g], place[e:g] - lo)
                grad = grad + z.T @ own[e:g]
                np.matmul(z, side[:, :-1], out=back_in[e:g])
            inner.append((lo, hi, grad))
        dh_in = np.zeros((len(target), d), kind)
        dh_in[order] = back_in
        # groups, then back through the layer
        out, (form, through) = np.vstack([w["u"], w["b"][None]]), self._products()
        g, outer = {k: np.zeros_like(w[k]) for k in ("pos", "emb")}, np.zeros_like(out.T)
        of_form, of_through = np.zeros_like(form), np.zeros_like(through)
        for m, (x, q, a, c) in enumerate(held):
            part_of = slice(m * rows * s.fresh, m * rows * s.fresh + len(x) * s.fresh)
            p = self._powers(state[part_of] @ out, weight[part_of], group[part_of])
            outer += p.T @ state[part_of]
            dh = dh_in[part_of]
            dh += p @ w["u"].T
            of_through += flat(c).T @ dh
            dc = (dh @ through.T).reshape(c.shape)
            ds = np.matmul(dc, x.transpose(0, 2, 1))
            ds -= np.einsum("bij,bij->bi", dc, c)[..., None]
            ds *= a
            dx = np.matmul(a.transpose(0, 2, 1), dc)
            dx += np.matmul(ds.transpose(0, 2, 1), q)
            dq = flat(np.matmul(ds, x))
            of_form += x[:, back:].reshape(-1, d).T @ dq
            dh += dq @ form.T
            dx[:, back:] += dh.reshape(c.shape)
            g["pos"] += dx.sum(0)
            at = i[m * rows : m * rows + len(x)].reshape(-1)
            order = np.argsort(at.astype(np.int16) if len(w["emb"]) < 1 << 15 else at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            g["emb"][at[first]] += np.add.reduceat(flat(dx).take(order, 0), first)
        of_form *= kind.type(d**-0.5)
        g["q"], g["k"], g["v"], g["o"] = of_form @ w["k"], of_form.T @ w["q"], of_through @ w["o"].T, w["v"].T @ of_through
        g["u"], g["b"] = outer[:, :d].T, outer[:, d]
        return g, inner

    def fit(self, pieces: np.ndarray, sizes: np.ndarray, at_begin: np.ndarray, steps: int | None = None, rate: float | None = None, whole: bool = False, gather: int = 1) -> int:
        """Adam on the cross entropy of pieces over full windows of runs; at_begin: whether a run begins its text. Without steps
        every window is read once, in random order. whole: what is left at a run's end is learnt as well, so that every piece counts once;
        gather: batches whose gradients make one step. Gives the number of steps."""
        s, w = self.s, self.w
        back = s.window - s.fresh
        begins = np.cumsum(sizes) - sizes
        ins = self.inputs_of(pieces, begins)
        ins[begins[~at_begin]] = self.begin  # never read: such a run's first pieces are context only
        ins, targets = self._views(ins, pieces)
        skip = np.where(at_begin, 0, back)
        long = np.maximum(0, sizes - skip)
        n = -(-long // s.fresh) if whole else long // s.fresh
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(begins + skip, n) + k * s.fresh
        first, masks = ((k == 0) & np.repeat(at_begin, n)).astype(np.int8), np.stack([self.later, self.first])
        many = np.minimum(s.fresh, np.repeat(long, n) - k * s.fresh)
        if not len(start):
            return 0
        rng, batch = np.random.default_rng(62), s.batch * gather
        order = rng.permutation(len(start)) if steps is None else rng.integers(0, len(start), steps * batch)
        m1, m2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        steps, rate, fresh = -(-len(order) // batch), rate or s.rate, np.arange(s.fresh)
        for step in range(1, steps + 1):
            own = order[(step - 1) * batch : step * batch]
            live = fresh < many[own][:, None]
            g, inner = self._gradients(ins[start[own]], masks.take(first[own], 0), targets[start[own]], None if live.all() else live)
            now = rate * min(1, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / (steps + 1)))
            fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
            for own, own1, own2, grad in [*((w[k], m1[k], m2[k], g[k]) for k in g), *((w["inner"][a:b], m1["inner"][a:b], m2["inner"][a:b], x) for a, b, x in self._joined(inner))]:
                own1 += 0.1 * (grad - own1)
                own2 += 0.01 * (grad**2 - own2)
                own -= (now * (own1 / fix1) / (np.sqrt(own2 / fix2) + 1e-8)).astype(np.float32)
        return steps

    @staticmethod
    def _joined(inner: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray]]:
        """Groups that follow each other as one."""
        cut = [k for k, x in enumerate(inner) if not k or x[0] != inner[k - 1][1]]
        return [(inner[a][0], inner[b - 1][1], np.concatenate([x for *_, x in inner[a:b]])) for a, b in zip(cut, [*cut[1:], len(inner)])]

    def _views(self, ins: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the place of its first scored piece, a window's inputs and the pieces it scores; what is beyond the texts is never live."""
        from numpy.lib.stride_tricks import sliding_window_view

        s = self.s
        wide = np.concatenate([np.full(s.window - s.fresh, self.begin, ins.dtype), ins, np.full(s.fresh, self.begin, ins.dtype)])
        return sliding_window_view(wide, s.window), sliding_window_view(np.append(pieces, np.zeros(s.fresh, pieces.dtype)), s.fresh)

    def _scorer(self, rows: int):
        """Weights as scoring uses them: the layer's products, the output's bias as one more input, room for a batch."""
        w, s = self.w, self.s
        out = np.vstack([w["u"], w["b"][None]])
        room = (np.empty((rows, s.window, s.width), np.float32), np.empty((rows, s.fresh, s.window), np.float32))
        return *self._products(), out, np.ones((rows, s.fresh, s.width + 1), np.float32), np.empty((rows, s.fresh, self.many), np.float32), room

    def _states(self, ins: np.ndarray, bias: np.ndarray, ready) -> np.ndarray:
        """Attended states, with a one for the bias, of a batch of windows."""
        w, s = self.w, self.s
        form, through, h = ready[0], ready[1], ready[3][: len(ins)]
        x, a = (z[: len(ins)] for z in ready[5])
        w["emb"].take(ins, 0, out=x, mode="clip")
        x += w["pos"]
        own = x[:, s.window - s.fresh :].reshape(-1, s.width)
        np.matmul((own @ form).reshape(-1, s.fresh, s.width), x.transpose(0, 2, 1), out=a)
        a += bias
        if a.size and a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        c = np.matmul(a, x).reshape(-1, s.width)
        c /= (a.reshape(-1, s.window) @ np.ones(s.window, np.float32) + np.float32(1e-30))[:, None]
        np.add(own, c @ through, out=h.reshape(-1, s.width + 1)[:, :-1])
        return h

    @staticmethod
    def _log_share(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Logarithm of the share of one logit a row; the logits' room is used up."""
        got = logits[np.arange(len(own)), own]
        if not logits.size or logits.max() < 80 and logits.min() > -80:  # single precision holds all powers
            np.exp(logits, out=logits)
            return got - np.log(logits @ np.ones(logits.shape[1], np.float32))
        high = logits.max(-1)
        return got - high - np.log(np.exp(logits - high[:, None]).sum(-1))

    def score(self, pieces: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rows: int = 128, gather: int = 1 << 16) -> np.ndarray:
        """Natural log probability of each piece after those before it in its text."""
        s, out = self.s, np.zeros(len(pieces), np.float32)
        group, (start, n, first) = self.group[pieces], self.windows(begins, sizes)
        ins, groups = self._views(self.inputs_of(pieces, begins), group)
        fresh, ready = np.arange(s.fresh), self._scorer(rows)
        inner = self.w["inner"].T
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def within() -> None:
            """Pieces of groups of several: their shares within, one product a group."""
            spot = np.concatenate([x for x, _ in held])
            state = np.concatenate([x for _, x in held])
            held.clear()
            found = group[spot]
            order = np.argsort(found.astype(np.int16), kind="stable")
            edge = np.searchsorted(found[order], np.arange(self.many + 1))
            spot, state = spot[order], state.take(order, 0)
            place = self.place[pieces[spot]]
            for g in np.flatnonzero(np.diff(edge)).tolist():
                lo, hi = int(self.cut[g]), int(self.cut[g + 1])
                side = np.ascontiguousarray(inner[:, lo:hi])
                most = max(1, (1 << 20) // (hi - lo))
                if not side[:-1].any():  # nothing was learnt from: the same shares after any state
                    own = slice(int(edge[g]), int(edge[g + 1]))
                    out[spot[own]] += (side[-1] - np.log(np.exp(side[-1].astype(np.float64)).sum()))[place[own] - lo].astype(np.float32)
                    continue
                for a in range(int(edge[g]), int(edge[g + 1]), most):
                    b = min(a + most, int(edge[g + 1]))
                    out[spot[a:b]] += self._log_share(state[a:b] @ side, place[a:b] - lo)

        waiting = 0
        for kind, bias in ((True, self.first), (False, self.later)):
            chosen = np.flatnonzero(first == kind)
            for a in range(0, len(chosen), rows):
                pick = chosen[a : a + rows]
                h = self._states(ins[start[pick]], bias, ready)
                scored, own = np.flatnonzero(fresh < n[pick][:, None]), groups[start[pick]].reshape(-1)
                place = (start[pick][:, None] + fresh).reshape(-1)
                logits = ready[4][: len(pick)].reshape(-1, self.many)
                flat = h.reshape(-1, s.width + 1)
                np.matmul(flat, ready[2], out=logits)
                got = self._log_share(logits, own)
                out[place[scored]] = got[scored]
                more = scored[self.wide[own[scored]]]
                held.append((place[more], flat.take(more, 0)))
                waiting += len(more)
                if waiting >= gather:
                    within()
                    waiting = 0
        if held:
            within()
        return out


class Block:
    """Documents with their words as codes of the block's own dictionary; the end of a text is the last code."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, flat: np.ndarray, each: np.ndarray, end: int):
        self.sizes = sizes + 1
        k = len(each)
        ends = np.cumsum(self.sizes)
        self.codes = np.full(int(ends[-1]) if len(ends) else 0, k, np.int64)
        inside = np.ones(len(self.codes), bool)
        inside[ends - 1] = False
        self.codes[inside] = codes
        each = np.append(each, 1).astype(np.int64)
        flat = np.append(flat, end)
        self.each = each[self.codes]
        self.pieces = flat[ragged((np.cumsum(each) - each)[self.codes], self.each)]
        self.first_word = ends - self.sizes
        self.first_piece = np.cumsum(self.each) - self.each
        if len(self.sizes):
            self.piece_sizes = np.add.reduceat(self.each, self.first_word)
        else:
            self.piece_sizes = np.empty(0, np.int64)
        self.begins = np.cumsum(self.piece_sizes) - self.piece_sizes

    def words_logp(self, model: Attention) -> np.ndarray:
        """Natural log probability of each word by its pieces."""
        return np.add.reduceat(model.score(self.pieces, self.begins, self.piece_sizes).astype(np.float64), self.first_piece)


@dataclass(frozen=True)
class Tally:
    """What the training corpus has of words: tokens, distinct ones, ends of texts, the discount and the pieces' part of a known word."""

    total: int
    distinct: int
    ends: int
    discount: float
    mix: float = 0.6

    @staticmethod
    def discount_of(once: int, twice: int) -> float:
        """The usual estimate from how many words stand once and twice."""
        return once / (once + 2 * twice) if once else 0.0


#: parts of the pieces to choose from
MIXES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def mixed(by_pieces: np.ndarray, counts: np.ndarray, t: Tally, mixes: tuple[float, ...] | None = None) -> np.ndarray:
    """log10 of (1 - mix) (max(c - D, 0) / N + D V / N spelt) + mix spelt; spelt: the probability of the word's pieces. With mixes a row for each."""
    each = (t.mix,) if mixes is None else mixes
    out = np.repeat(by_pieces[None], len(each), 0)
    if t.total:
        share = (np.maximum(counts - t.discount, 0) / t.total).astype(by_pieces.dtype)
        some = np.flatnonzero(share)
        share, spelt = share[some], np.exp(by_pieces[some])
        for row, m in zip(out, each):
            left = m + (1 - m) * t.discount * t.distinct / t.total
            row += np.log(left)  # of what was never counted: spelt alone, however small
            row[some] = np.log(share * (1 - m) + spelt * left)
    out /= np.log(10)
    return out[0] if mixes is None else out


def choose_mix(by_pieces: np.ndarray, counts: np.ndarray, t: Tally) -> Tally:
    """The part of the pieces that suits tokens which are counted without themselves."""
    return replace(t, mix=MIXES[int(mixed(by_pieces, np.maximum(counts - 1, 0), t, MIXES).sum(1).argmax())])


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def coded(texts: list[pa.Array]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case (A-Z) words between ASCII white space of texts, the number of each word in order, and each text's words."""
    split = pa.chunked_array([pc.ascii_split_whitespace(pc.ascii_lower(t)) for t in texts], pa.list_(pa.string())).combine_chunks()
    split = pa.concat_arrays(split.chunks) if isinstance(split, pa.ChunkedArray) else split
    flat, sizes = split.flatten(), np.asarray(split.value_lengths(), np.int64)
    some = np.asarray(pc.binary_length(flat)) > 0  # white space at an end leaves an empty word
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
    found = flat.filter(pa.array(some)).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(found.indices, np.uint32), sizes.astype(np.int32)


def names_of(words: list[str]) -> np.ndarray:
    """64 bits that stand for each word where words are counted and joined: among 10 billion distinct ones about three pairs share theirs."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    """One row with a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))


def runs(sizes: np.ndarray, train: np.ndarray, s: Settings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, tokens) of runs that hold one token in s.share of the training texts, whatever their lengths; sizes: tokens of
    each text, its end included."""
    whole = np.minimum(sizes, s.run)
    many = np.floor(sizes / (whole * s.share) + rng.random(len(sizes))).astype(np.int64) * train
    text = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = np.floor((number + rng.random(len(text))) / many[text] * (sizes - whole + 1)[text]).astype(np.int64)  # spread over the text
    return text, first, whole[text]


class Spelling:
    """Pieces of a block's words. Words of the blocks before are not spelt again; when they become too many, those that recur stay."""

    def __init__(self, model: str, most: int = 250_000):
        self.model, self.most = model, most
        self.spelt: dict[str, int] = {}  # each word's number
        self.pieces, self.each = np.empty(0, np.uint32), np.empty(0, np.int32)

    def _of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = self.each[numbers]
        return self.pieces[ragged((np.cumsum(self.each, dtype=np.int64) - self.each)[numbers], each)], each

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.spelt.get, words, repeat(-1)), np.int64, len(words))
        new = [words[k] for k in np.flatnonzero(at < 0).tolist()]
        if len(self.spelt) + len(new) > self.most:
            again = np.flatnonzero(at >= 0)
            self.pieces, self.each = self._of(at[again])
            at[again] = np.arange(len(again))
            self.spelt = {words[k]: n for n, k in enumerate(again.tolist())}
        first = len(self.each)
        pieces, each = [self.pieces], [self.each]
        for a in range(0, len(new), 50_000):
            found = [x or [0] for x in library(self.model).encode(new[a : a + 50_000], num_threads=1)]
            each.append(np.fromiter(map(len, found), np.int32, len(found)))
            pieces.append(np.fromiter(chain.from_iterable(found), np.uint32, int(each[-1].sum())))
        self.pieces, self.each = np.concatenate(pieces), np.concatenate(each)
        self.spelt.update(zip(new, range(first, first + len(new))))
        at[at < 0] = np.arange(first, first + len(new))
        return self._of(at)


def _blocks(s: Settings, kind):
    """Rows (id, held, text) -> a row for each block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold()
        part, number = TaskContext.get().partitionId(), 0
        spell = Spelling(s.model)

        def give(ids, helds, texts):
            words, flat, sizes = coded(texts)
            texts.clear()
            taught = ~np.array(helds, bool)
            train = np.bincount(flat[np.repeat(taught, sizes)], minlength=len(words))
            pieces, each = spell(words)
            counted = np.bincount(pieces, np.repeat(train, each)) if len(pieces) else np.zeros(1)
            have = np.flatnonzero(counted)
            # runs to learn from: their pieces (the number after the last piece ends a text) and sizes (negative at a text's begin)
            text, first, tokens = runs(sizes + 1, taught, s, np.random.default_rng([part, number]))
            stop = first + tokens > sizes[text]
            spot = ragged((np.cumsum(sizes, dtype=np.int64) - sizes)[text] + first, tokens - stop)
            drilled = flat[spot].astype(np.int64)
            size = library(s.model).get_piece_size()
            spread = ragged((np.cumsum(each, dtype=np.int64) - each)[drilled], each[drilled].astype(np.int64))
            long = np.bincount(np.repeat(np.arange(len(text)), tokens - stop), each[drilled], len(text)).astype(np.int64)
            drill = np.insert(pieces[spread], np.cumsum(long)[stop], size) if len(text) else np.empty(0, np.uint32)
            signed = np.where(first == 0, -1, 1) * (long + stop)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([list(helds)], pa.list_(pa.bool_())),
                    pa.array([_pack(sizes)]), pa.array([_pack(flat)]), _lists(names_of(words)), _lists(train.astype(np.int64)),
                    pa.array([_pack(pieces)]), pa.array([_pack(each)]),
                    _lists(have.astype(np.int32)), _lists(counted[have].astype(np.int64)),
                    pa.array([drill.astype(np.uint32).tobytes()], pa.binary()), pa.array([signed.astype(np.int32).tobytes()], pa.binary()),
                ],
                ["block", "ids", "held", "sizes", "codes", "words", "train", "pieces", "each", "piece", "piece_n", "drill", "runs"],
            )

        ids, helds, texts, size = [], [], [], 0
        for batch in slices(batches, limit=s.block // 4):
            own = batch.column(2)
            ids += batch.column(0).to_pylist()
            helds += batch.column(1).to_pylist()
            texts.append(own.cast(pa.string()))
            size += pc.sum(pc.binary_length(own)).as_py()
            if size >= s.block:
                yield give(ids, helds, texts)
                ids, helds, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield give(ids, helds, texts)
        del spell
        trim()

    return run


def scores(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Learns from the rows whose crc32(id as text) mod 7 is not 2. Tokens are lower-case (A-Z) words between ASCII
    white space and then one end. base_score sums log10((c + 1) / (N + V + 1)); score is the model's log10
    probability. A null or empty text is its end alone. Repeated rows, ties and null ids keep one row each
    and count in training as often; with nothing to learn from every count is zero. An empty table gives none;
    other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), 7) == 2).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    size = rows.agg(F.sum(F.when(~F.col("held"), F.octet_length("text")))).first()[0] or 0
    s = replace(s, share=max(1.0, min(s.share, size / s.least)))
    shape = f"block long, ids array<{kind.simpleString()}>, held array<boolean>, sizes binary, codes binary, words array<long>, train array<long>, pieces binary, each binary, piece array<int>, piece_n array<long>, drill binary, runs binary"
    blocks = staged(rows.mapInArrow(_blocks(s, to_arrow_type(kind)), shape))

    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.train").alias("n"))
    counts = staged(words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")))
    seen = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    tally = Tally((seen[0] or 0) + ends, seen[1] + (1 if ends else 0), ends, Tally.discount_of(seen[2] + (ends == 1), seen[3] + (ends == 2)))
    # a row for each piece of the vocabulary at most
    pieces = blocks.select(F.explode(F.arrays_zip("piece", "piece_n")).alias("p")).groupBy("p.piece").agg(F.sum("p.piece_n").alias("n")).collect()
    held = spark.sparkContext.broadcast(_learn(blocks, s, {r["piece"]: r["n"] for r in pieces}, tally))

    known = words.join(counts, "word").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))
    joined = blocks.select("block", "ids", "held", "sizes", "codes", "pieces", "each").join(known, "block", "left").drop("block")
    price = tally.total + tally.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        m = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, flags = (batch.column(i)[k].values for i in (0, 1))
                block, each = _block(batch, k, 2, m.size - 1)
                c = np.zeros(len(each) + 1, np.float64)
                if batch.column(6)[k].is_valid:
                    c[batch.column(6)[k].values.to_numpy()] = batch.column(7)[k].values.to_numpy()
                c[-1] = tally.ends
                own = c[block.codes]
                base = np.add.reduceat(np.log10((c + 1) / price)[block.codes], block.first_word)
                by = block.words_logp(m).astype(np.float32)
                score = np.stack([np.add.reduceat(x, block.first_word, dtype=np.float64) for x in mixed(by, own, tally, MIXES)])
                # how each mixture suits the block's training tokens, each counted without itself: beside the block's first text
                taught = np.repeat(~np.asarray(flags), block.sizes)
                suits = mixed(by[taught], np.maximum(own[taught] - 1, 0), tally, MIXES).sum(1, dtype=np.float64)
                n, many = len(block.sizes), len(MIXES)
                met = np.add.reduceat((own > 0).astype(np.int64), block.first_word)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * many), pa.array(score.T.reshape(-1)))
                beside = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(n + 1, dtype=np.int32), 1) * many), pa.array(suits))
                yield pa.RecordBatch.from_arrays([ids, flags, pa.array(block.sizes), pa.array(met), pa.array(np.full(n, tally.total, np.int64)), pa.array(base), lists, beside], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "scores", "suits"])

    out = staged(joined.mapInArrow(run, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, suits array<double>"))
    suits = {r["pos"]: r["s"] for r in out.select(F.posexplode("suits")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    best = max(range(len(MIXES)), key=lambda k: suits.get(k, 0.0))
    return out.withColumn("score", F.col("scores")[best]).drop("scores", "suits").withColumnRenamed("id", id_col)


def _block(batch: pa.RecordBatch, k: int, at: int, end: int) -> tuple[Block, np.ndarray]:
    """Row k's block, and the pieces of each word of its dictionary, from the columns sizes, codes, pieces and each."""
    sizes, codes, flat, each = (_unpack(batch.column(at + i)[k].as_py(), t) for i, t in enumerate((np.int32, np.uint32, np.uint32, np.int32)))
    return Block(codes.astype(np.int64), sizes.astype(np.int64), flat.astype(np.int64), each, end), each


def _drilled(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, sizes of runs, whether a run begins its text) of rows' drill and runs."""
    pieces = np.concatenate([np.frombuffer(d, np.uint32) for d, _ in rows] or [np.empty(0, np.uint32)]).astype(np.int64)
    signed = np.concatenate([np.frombuffer(r, np.int32) for _, r in rows] or [np.empty(0, np.int32)]).astype(np.int64)
    return pieces, np.abs(signed), signed < 0


def _learn(blocks: DataFrame, s: Settings, pieces: dict[int, int], tally: Tally) -> Attention:
    """Groups and shares from the corpus counts, the start of the weights on the driver, the fit on all training texts by the executors."""
    number = np.zeros(library(s.model).get_piece_size() + 1, np.float64)
    for p, n in pieces.items():
        number[p] = n
    number[-1] = tally.ends
    model = Attention(number, s)
    drills = blocks.select("block", "drill", "runs").filter(F.octet_length("drill") > 0)
    size = drills.agg(F.count("*"), F.sum(F.octet_length("drill") / 4)).first()
    if size[0]:
        most = max(1, min(size[0], int(s.first * size[0] / size[1])))
        picked = [r["block"] for r in drills.select("block").orderBy(F.xxhash64("block"), "block").limit(most).collect()]
        start = drills.filter(F.col("block").isin(picked)).orderBy("block").collect()  # s.first pieces, or one block
        model.fit(*_drilled([(r["drill"], r["runs"]) for r in start]), steps=s.steps)
    return _go_on(model, blocks, s)


def _go_on(model: Attention, blocks: DataFrame, s: Settings) -> Attention:
    """Learners fit the started weights on every piece of the training texts, each on blocks of one partition in order, where they lie; their
    mean, by steps, is the model. What a learner reads depends on the blocks, not on the number of tasks."""
    context = blocks.sparkSession.sparkContext
    started, names = context.broadcast(model), list(model.w)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        m, done, total = deepcopy(started.value), 0, None
        pieces, sizes, held, part = [], [], 0, None

        def go() -> None:
            nonlocal done, total, held
            m.w = {k: started.value.w[k].copy() for k in names}
            long = np.concatenate(sizes)
            n = m.fit(np.concatenate(pieces), long, np.ones(len(long), bool), rate=s.slow, whole=True, gather=s.gather)
            pieces.clear()
            sizes.clear()
            held = 0
            x = np.concatenate([m.w[k].reshape(-1) for k in names]).astype(np.float64) * n
            done, total = done + n, x if total is None else total + x

        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py() >> 32
                if held and (own != part or held >= s.learner):
                    go()
                part = own
                block = _block(batch, k, 2, m.size - 1)[0]
                taught = ~np.asarray(batch.column(1)[k].values)
                pieces.append(block.pieces[np.repeat(taught, block.piece_sizes)].astype(np.int32))
                sizes.append(block.piece_sizes[taught])
                held += len(pieces[-1])
        if held:
            go()
        if done:
            yield _weights(done, total)
        trim()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, total = 0, 0.0
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                done, total = done + n, total + n * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
        if done:
            yield _weights(done, total)

    read = blocks.select("block", "held", "sizes", "codes", "pieces", "each")
    found, many = read.mapInArrow(fitted, "steps long, weights binary"), read.rdd.getNumPartitions()
    while many > 16:  # what reaches the driver doesn't grow with the corpus
        many = -(-many // 16)
        found = found.repartition(many).mapInArrow(mean, "steps long, weights binary")
    rows = found.collect()
    done = sum(r["steps"] for r in rows)
    if done:
        flat, at = sum(r["steps"] * np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in rows) / done, 0
        for k in names:
            n = model.w[k].size
            model.w[k] = flat[at : at + n].reshape(model.w[k].shape).astype(np.float32)
            at += n
    return model


def _weights(steps: int, total: np.ndarray) -> pa.RecordBatch:
    """A row with the mean of weights that are summed by steps."""
    return pa.RecordBatch.from_arrays([pa.array([steps], pa.int64()), pa.array([(total / steps).astype(np.float32).tobytes()], pa.binary())], ["steps", "weights"])
