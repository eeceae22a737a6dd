"""Language-model scores of whole documents by a small gated recurrent network.

Counts. Documents are turned into blocks of word hashes (of bounded size). Every block sends its distinct words with
their training counts to one aggregate. The most frequent words, up to a stated number, are then known to every task; of the others
each block gets the totals of its own words back, so a word crosses the network once a block, not once an occurrence, and no
frequent word is a hot key of the join.
Network. A gated recurrent unit in numpy over the most frequent words, one symbol for all others and an end symbol. Its output
is factored into classes of words of like frequency. All training documents are dealt whole to trainers, as many as
the tokens ask for, which stream them through truncated backpropagation through time from common weights, the state carried from
step to step of a document; weights are averaged after each round, by groups of trainers in as many levels as it takes.
Scores. All documents are scored whole, many side by side, with the state carried from window to window. A word outside the
network's vocabulary has the other-symbol's probability times its smoothed share of all such words' counts, so what
the corpus counts also enters the model's score, and the probabilities of seen words and one unseen word sum to one. The other-symbol's
odds are raised to those of the smoothed counts, as new texts have words that no training text has.

Defined results: a null text is empty and has only its end; a null doc_id counts as the empty string in the training rule; equal
rows score alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import U, Words, mix, signed, slices

VOCABULARY, CLASSES, HIDDEN, EMBEDDED = 4000, 40, 16, 16
#: Share of the training documents that the network is fitted on (all), its rounds, words in a truncated step, and documents side by side at most;
#: words of the documents that are dealt to lanes at once, which is all that a trainer gets unless the draw is very uneven.
SHARE, ROUNDS, STEPS, LANES, AHEAD = 1.0, 3, 48, 128, 8_000_000
#: Fewer documents go side by side, down to so many, where a trainer would not make so many updates.
FEWEST_LANES, UPDATES = 8, 600
#: One training document in so many only judges whether a round has helped, so many words of them in a task.
JUDGES, JUDGED_TOKENS = 32, 1_000_000
TRAINER_TOKENS, RATE, FAN_IN = 3_000_000, 0.3, 16
BLOCK_BYTES, SCORED_LANES, SCORED_STEPS = 16 << 20, 512, 32
#: Words whose counts every task knows: 16 bytes each, so 8 MB at most.
FREQUENT = 1 << 19
END_HASH = 0x656E64
OTHER, END = 0, 1


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte of all of them, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 32
    ids: list[int | None] = []
    hashes: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        lengths = np.array([len(h) for h in hashes], np.int32)
        local, distinct = pd.factorize(np.concatenate(hashes))  # by hashing: nothing is sorted but the distinct words
        order = np.argsort(-np.bincount(local), kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        distinct, local = distinct[order], rank[local]
        held = np.array([held_out(i) for i in ids])
        counts = np.bincount(local[np.repeat(~held, lengths)], minlength=len(distinct))
        row = {"block": made, "doc_ids": ids, "held": held.tolist(), "lengths": lengths.tobytes(), "local": packed_numbers(local), "hashes": signed(distinct), "counts": counts}
        return pa.RecordBatch.from_pylist([row], BLOCKS)

    for batch in batches:
        doc_ids, at = batch.column("doc_id").to_pylist(), 0
        for part in slices(batch.column("text")):
            w = Words(part, lower=True)
            own = np.split(w.hashes(), w.first[1:-1])
            hashes += [np.append(h, U(END_HASH)) for h in own]
            ids += doc_ids[at : at + len(part)]
            at += len(part)
            size += len(w.data)
            if size >= BLOCK_BYTES:
                yield block()
                made, ids, hashes, size = made + 1, [], [], 0
    if ids:
        yield block()


BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("local", pa.binary()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
BLOCKS_DDL = "block long, doc_ids array<long>, held array<boolean>, lengths binary, local binary, hashes array<long>, counts array<long>"


@dataclass
class Symbols:
    """The network's words: sorted hashes, their symbols, and the symbols' counts."""

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, top: list[tuple[int, int]], total: int) -> Symbols:
        """top: (hash, count) from the most frequent on; total: the count of all tokens."""
        words = [(h, c) for h, c in top if h != END_HASH]
        ends = sum(c for h, c in top if h == END_HASH) or 1
        order = sorted([*words, (END_HASH, ends)])
        rank = {h: i + 2 for i, (h, _) in enumerate(words)} | {END_HASH: END}
        counts = np.array([max(1, total - sum(c for _, c in order)), ends, *(c for _, c in words)], float)
        return cls(np.array([h for h, _ in order], np.int64), np.array([rank[h] for h, _ in order]), counts)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], OTHER)


def exponentials(x: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exp(x - top), its sums by row, top). top is 0, which takes no pass over x, unless a row's sum is then far from 1; else each row's greatest. out: where the first goes."""
    with np.errstate(over="ignore"):
        e = np.exp(x, out=out)
        sums = e @ np.ones(x.shape[1], x.dtype)
    if not len(sums) or (sums.min() > 1e-15 and sums.max() < 1e15):
        return e, sums, 0.0
    top = x.max(1)
    e = np.exp(x - top[:, None], out=out)
    return e, e.sum(1), top


class Room:
    """Arrays by name that are used again from call to call: fresh ones of some hundred kilobytes are new pages of memory each time, which cost as much as the arithmetic.

    What is in one is lost when its name is asked for again.
    """

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, own = math.prod(shape), self.held.get(name)
        if own is None or own.size < size or own.dtype != kind:
            own = self.held[name] = np.empty(size, kind)
        return own[:size].reshape(shape)


def dealt(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the shortest lane; the longest lane first, in each the documents in their order."""
    queue, own = [(0, i) for i in range(min(lanes, len(lengths)))], [[] for _ in range(min(lanes, len(lengths)))]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, lane = heapq.heappop(queue)
        own[lane].append(d)
        heapq.heappush(queue, (n + int(lengths[d]), lane))
    return sorted((sorted(x) for x in own), key=lambda x: -int(lengths[x].sum()))


def portions(documents: Iterable[np.ndarray], words: int) -> Iterator[list[np.ndarray]]:
    """Lists of documents that follow one another, each but the last with so many words at least."""
    own: list[np.ndarray] = []
    size = 0
    for d in documents:
        own.append(d)
        size += len(d)
        if size >= words:
            yield own
            own, size = [], 0
    if own:
        yield own


class Network:
    """A gated recurrent unit whose output is factored: first the class of a symbol, then the symbol in its class.

    Symbols are numbered from the most frequent on within the classes, so a class is a range of rows of the output weights.
    """

    NAMES = ("embed", "inner", "gates", "news", "bias", "to_class", "class_bias", "to_symbol", "symbol_bias")

    def __init__(self, counts: np.ndarray, seed: int = 1, hidden: int = HIDDEN, embedded: int = EMBEDDED, classes: int = CLASSES):
        order = np.argsort(-counts, kind="stable")
        share = np.cumsum(np.sqrt(counts[order]))
        cls_of = np.minimum((share / share[-1] * classes * (1 - 1e-9)).astype(int), classes - 1)
        _, cls_of = np.unique(cls_of, return_inverse=True)
        self.place = np.empty(len(counts), int)  # the row of each symbol in the output
        self.place[order] = np.arange(len(counts))
        self.bounds = np.searchsorted(cls_of, np.arange(cls_of.max() + 2))
        self.cls_of = cls_of
        rng = np.random.default_rng(seed)
        p = counts[order] / counts.sum()
        mass = np.add.reduceat(p, self.bounds[:-1])
        new = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        n, c = len(counts), len(mass)
        # with no input the output gives the symbols' frequencies
        self.w = {
            "embed": new(n, embedded), "inner": new(embedded, 3 * hidden), "gates": new(hidden, 2 * hidden), "news": new(hidden, hidden), "bias": np.zeros(3 * hidden, np.float32),
            "to_class": np.zeros((hidden, c), np.float32), "class_bias": np.log(mass).astype(np.float32), "to_symbol": np.zeros((n, hidden), np.float32), "symbol_bias": np.log(p / mass[cls_of]).astype(np.float32),
        }
        self.hidden, self.room = hidden, Room()

    def recurrent(self) -> np.ndarray:
        """What a state takes from update gate and reset gate and adds to the news, as rows."""
        return np.concatenate([-self.w["gates"], self.w["news"]], 1).T

    def advance(self, recurrent: np.ndarray, into: np.ndarray, h: np.ndarray, zr: np.ndarray, n: np.ndarray, back: np.ndarray, out: np.ndarray) -> None:
        """One step of many lanes, by columns, so that a gate is a run of rows: gates, news, what the state gives the news, and the next state are written to the last four.

        into: what the input adds to update gate, reset gate and news.
        """
        k = self.hidden
        np.matmul(recurrent[: 2 * k], h, out=zr)
        zr -= into[: 2 * k]
        np.exp(zr, out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        np.matmul(recurrent[2 * k :], h, out=back)
        np.multiply(zr[k:], back, out=n)
        n += into[2 * k :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[:k]
        out += n

    def step(self, into: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """As advance(), of lanes by rows: (next state, update gate, reset gate, news, what the state gives the news)."""
        k, kind = self.hidden, np.result_type(into, h)
        zr, (n, back, out) = np.empty((2 * k, len(h)), kind), np.empty((3, k, len(h)), kind)
        self.advance(self.recurrent(), into.T, h.T, zr, n, back, out)
        return out.T, zr[:k].T, zr[k:].T, n.T, back.T

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes (a column each) and of the symbols (a row each), the biases last."""
        w = self.w
        return np.concatenate([w["to_class"], w["class_bias"][None]]), np.concatenate([w["to_symbol"], w["symbol_bias"][:, None]], 1)

    def tame(self) -> bool:
        """Whether no symbol's logit can leave an exponential's range: states lie between -1 and 1, so its square is at most the weights' number by their sum of squares."""
        to_symbol = self.outputs()[1]
        return bool(np.einsum("ij,ij->i", to_symbol, to_symbol).max() * to_symbol.shape[1] < 60**2)

    def of_classes(self, s: np.ndarray, own: np.ndarray, weights: np.ndarray, tame: bool) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of the symbols' logits within each state's class, of states (with a 1) that lie class by class.

        (of each class with several symbols: its states, its symbols' rows, exponentials by state and symbol), all exponentials one after another, where each
        state's begin among them, their sums, and what was subtracted from the logits. A class of one symbol has neither, its sum is 1.
        """
        kind, bounds = s.dtype, self.bounds
        cuts, sizes = np.searchsorted(own, np.arange(len(bounds))), np.diff(bounds)
        sizes = np.where(sizes > 1, sizes, 0)
        ends = np.cumsum(np.diff(cuts) * sizes)
        begins = np.cumsum(sizes[own]) - sizes[own]
        every = self.room("of classes", (int(ends[-1]),), kind)
        sums, tops, ones = np.ones(len(s), kind), np.zeros(len(s), kind), np.ones(sizes.max(initial=1), kind)
        classes = []
        for c in np.flatnonzero(np.diff(cuts) * sizes).tolist():
            at, of, end = slice(cuts[c], cuts[c + 1]), slice(bounds[c], bounds[c + 1]), ends[c]
            x = every[end - (at.stop - at.start) * sizes[c] : end].reshape(-1, sizes[c])
            np.matmul(s[at], weights[of].T, out=x)
            classes.append((at, of, x))
        if tame:
            np.exp(every, out=every)
            for at, _, x in classes:
                np.matmul(x, ones[: x.shape[1]], out=sums[at])
        else:
            for at, _, x in classes:
                tops[at] = x.max(1)
                np.exp(x - tops[at][:, None], out=x)
                sums[at] = x.sum(1)
        return classes, every, begins, sums, tops

    def log_probs(self, states: np.ndarray, symbols: np.ndarray, odds: float = 1.0, outputs: tuple | None = None) -> np.ndarray:
        """The natural log-probability of each symbol after its state, the other-symbol's odds multiplied by a number. outputs: as outputs() and tame() give them."""
        (to_class, to_symbol), tame = outputs or (self.outputs(), self.tame())
        n, kind = len(symbols), np.result_type(states, to_class)
        rows = self.place[symbols]
        own = self.cls_of[rows]
        order = np.argsort(own.astype(np.int16), kind="stable")
        rows, own = rows[order], own[order]
        s = self.room("ordered", (n, self.hidden + 1), kind)
        s[:, :-1], s[:, -1] = states[order], 1
        logits = np.matmul(s, to_class, out=self.room("logits", (n, to_class.shape[1]), kind))
        _, sums, top = exponentials(logits, self.room("powers", logits.shape, kind))
        norm = np.log(sums) + top
        found = logits[np.arange(n), own] - norm
        _, _, _, sums, tops = self.of_classes(s, own, to_symbol, tame)
        found += np.where(np.diff(self.bounds)[own] > 1, np.einsum("ij,ij->i", s, to_symbol.take(rows, 0, out=self.room("own weights", s.shape, kind), mode="clip")), 0)
        found -= np.log(sums) + tops
        if odds != 1:
            place = self.place[OTHER]
            c = self.cls_of[place]
            other = logits[:, c] - norm
            if self.bounds[c + 1] - self.bounds[c] > 1:
                x = s @ to_symbol[self.bounds[c] : self.bounds[c + 1]].T
                _, sums, top = exponentials(x)
                other = other + x[:, place - self.bounds[c]] - (np.log(sums) + top)
            found = found + np.where(rows == place, np.log(odds), 0) - np.log1p(np.exp(other) * (odds - 1))
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, symbols: np.ndarray, lengths: np.ndarray, odds: float = 1.0, lanes: int = SCORED_LANES, steps: int = SCORED_STEPS) -> np.ndarray:
        """log_probs of whole documents that lie one after another, each starting from the zero state."""
        first = np.cumsum(lengths) - lengths
        before = np.empty_like(symbols)
        before[1:], before[first] = symbols[:-1], END
        new = np.zeros(len(symbols), bool)
        new[first] = True
        order = [np.concatenate([np.arange(first[d], first[d] + lengths[d]) for d in x]) for x in dealt(lengths, lanes)]
        long = np.array([len(x) for x in order])
        begins, place = np.cumsum(long) - long, np.concatenate(order)
        before, new, symbols = before[place], new[place], symbols[place]  # lane after lane
        table = self.w["embed"] @ self.w["inner"] + self.w["bias"]
        recurrent, outputs, k, kind = self.recurrent(), (self.outputs(), self.tame()), self.hidden, table.dtype
        found = np.empty(len(symbols), np.float32)
        h = np.zeros((k, len(order)), kind)
        for low in range(0, long[0], steps):
            going = int(np.searchsorted(-long, -low, "left"))
            t = np.arange(low, min(low + steps, int(long[0])))[:, None]
            live = t < long[:going]
            flat = (begins[:going] + t)[live]
            inputs, starts = before[flat], np.flatnonzero(new[flat])
            states = self.room("scored", (len(flat), k), kind)
            ends = np.cumsum(live.sum(1))
            end = 0
            for i, (to, zero) in enumerate(zip(ends.tolist(), np.split(starts, np.searchsorted(starts, ends[:-1])), strict=True)):
                n, at, end = to - end, end, to
                h = h[:, :n]  # lanes end from the last on
                if len(zero):
                    h[:, zero - at] = 0
                into = self.room("into", (3 * k, n), kind)
                into[:] = table.take(inputs[at:end], 0, out=self.room("rows", (n, 3 * k), kind), mode="clip").T
                zr, (news, back, after) = self.room("zr", (2 * k, n), kind), self.room(f"forward {i % 2}", (3, k, n), kind)
                self.advance(recurrent, into, h, zr, news, back, after)
                states[at:end] = after.T
                h = after
            h = h.copy()
            found[flat] = self.log_probs(states, symbols[flat], odds, outputs)
        out = np.empty_like(found)
        out[place] = found
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, new: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients and last state for inputs x and targets y of shape (steps, lanes), starting from the states h, and from zero where new. Targets under 0 count for nothing."""
        w, k, (steps, lanes) = self.w, self.hidden, x.shape
        kind, wide = w["embed"].dtype, w["embed"].shape[1]

        def room(name: str, *shape: int) -> np.ndarray:
            return self.room(name, shape, kind)

        flat_x = x.ravel()
        embedded = room("embedded", steps, wide, lanes)  # as all of a step's arrays: lanes by columns
        embedded[:] = w["embed"].take(flat_x, 0, out=room("rows", x.size, wide), mode="clip").reshape(steps, lanes, wide).transpose(0, 2, 1)
        into = np.matmul(w["inner"].T, embedded, out=room("into", steps, 3 * k, lanes))
        into += w["bias"][:, None]
        recurrent = self.recurrent()
        before, news, back, states = room("forward", 4, steps, k, lanes)
        zr = room("zr", steps, 2 * k, lanes)
        starts = {} if new is None else {t: np.flatnonzero(new[t]) for t in np.flatnonzero(new.any(1)).tolist()}
        after = h.T
        for t in range(steps):
            before[t] = after
            if t in starts:
                before[t][:, starts[t]] = 0
            self.advance(recurrent, into[t], before[t], zr[t], news[t], back[t], states[t])
            after = states[t]
        flat_y = y.ravel()
        live = np.flatnonzero(flat_y >= 0)
        n, rows = len(live), self.place[flat_y[live]]
        own = self.cls_of[rows]
        order = np.argsort(own.astype(np.int16), kind="stable")
        live, rows, own = live[order], rows[order], own[order]
        every = room("every", y.size, k + 1)
        every[:, k] = 1
        every.reshape(steps, lanes, k + 1)[:, :, :k] = states.transpose(0, 2, 1)
        s = every.take(live, 0, out=room("ordered", n, k + 1), mode="clip")
        to_class, to_symbol = self.outputs()
        # exponentials are yet to be divided by their sums, which is done to the narrow arrays they are multiplied with
        logits = np.matmul(s, to_class, out=room("logits", n, to_class.shape[1]))
        p, sums, _ = exponentials(logits, room("powers", *logits.shape))
        hit = np.arange(n), own
        of_class = p[hit] / sums
        p[hit] -= sums
        by, scaled = (1 / sums)[:, None], room("scaled", n, k + 1)
        both = np.multiply(s, by, out=scaled).T @ p
        g = {"to_class": both[:k], "class_bias": both[k]}
        ds = np.matmul(p, w["to_class"].T, out=room("ds", n, k))
        ds *= by
        classes, q, begins, sums, _ = self.of_classes(s, own, to_symbol, self.tame())
        several = np.flatnonzero(np.diff(self.bounds)[own] > 1)
        hit, of_symbol = begins[several] + (rows - self.bounds[own])[several], np.ones(n, kind)
        found = q[hit]
        q[hit] = found - sums[several]
        of_symbol[several] = found / sums[several]
        by, ds_symbol = (1 / sums)[:, None], room("ds_symbol", n, k)
        np.multiply(s, by, out=scaled)
        if len(several) < n:
            ds_symbol[:] = 0
        both = np.zeros(to_symbol.shape, kind)
        for at, of, x in classes:
            np.matmul(x.T, scaled[at], out=both[of])
            np.matmul(x, w["to_symbol"][of], out=ds_symbol[at])
        g["to_symbol"], g["symbol_bias"] = both[:, :k].copy(), both[:, k]
        ds_symbol *= by
        ds += ds_symbol
        loss = -np.log(of_class + 1e-30).sum() - np.log(of_symbol + 1e-30).sum()
        every_ds = room("every_ds", y.size, k)
        if n < y.size:
            every_ds[:] = 0
        every_ds[live] = ds
        ds = room("ds_by_lanes", steps, k, lanes)
        ds[:] = every_ds.reshape(steps, lanes, k).transpose(0, 2, 1)
        z, r = zr[:, :k], zr[:, k:]
        to_news, to_z, to_r, rest = room("backward", 4, steps, k, lanes)
        np.subtract(1, z, out=rest)
        np.multiply(news, news, out=to_news)
        np.subtract(1, to_news, out=to_news)
        to_news *= rest  # (1 - z) (1 - news ** 2)
        np.subtract(before, news, out=to_z)
        to_z *= z
        to_z *= rest  # (before - news) z (1 - z)
        np.subtract(1, r, out=to_r)
        to_r *= r
        to_r *= back  # back r (1 - r)
        # of each step: what the state gives the news, update gate, reset gate, news; the first three come from the state, the last three from the input
        d = room("d", steps, 4 * k, lanes)
        from_state = np.concatenate([w["news"], w["gates"]], 1)
        dh = np.zeros((k, lanes), kind)
        for t in reversed(range(steps)):
            dh += ds[t]
            dn = d[t, 3 * k :]
            np.multiply(dh, to_news[t], out=dn)
            np.multiply(dn, r[t], out=d[t, :k])
            np.multiply(dh, to_z[t], out=d[t, k : 2 * k])
            np.multiply(dn, to_r[t], out=d[t, 2 * k : 3 * k])
            dh *= z[t]
            dh += from_state @ d[t, : 3 * k]
            if t in starts:
                dh[:, starts[t]] = 0
        both = (before @ d[:, : 3 * k].transpose(0, 2, 1)).sum(0)
        g["news"], g["gates"] = both[:, :k], both[:, k:]
        dinto = d[:, k:]
        g["inner"], g["bias"] = (embedded @ dinto.transpose(0, 2, 1)).sum(0), (dinto @ np.ones(lanes, kind)).sum(0)
        columns = room("columns", wide, steps, lanes)  # of the inputs' embeddings: those of a symbol are added up
        np.matmul(w["inner"], dinto, out=columns.transpose(1, 0, 2))
        order = np.argsort(flat_x.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else flat_x, kind="stable")
        of = flat_x[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        g["embed"] = np.zeros(w["embed"].shape, kind)
        g["embed"][of[first]] = np.add.reduceat(columns.reshape(wide, -1).take(order, 1, out=room("by symbol", wide, len(of)), mode="clip"), first, axis=1).T
        return float(loss), g, after.T.copy()

    def train(self, documents: Iterable[np.ndarray], steps: int = STEPS, lanes: int = LANES, rate: float = RATE) -> float:
        """One pass over documents of symbols after the symbol before (-1 fills short ones) with AdaGrad; the mean loss a symbol.

        The state is zero at a document's start and carried on to its end. Documents are streamed: those of AHEAD words are dealt to lanes of like
        length, in which they keep their order, so that hardly a lane runs on alone at the end.
        """
        past = {name: np.full_like(v, 1.0) for name, v in self.w.items()}
        total, n = 0.0, 0
        for own in portions((d for d in (x[x >= 0] for x in documents) if len(d) > 1), AHEAD):
            order = dealt(np.array([len(d) - 1 for d in own]), lanes)
            long = np.array([sum(len(own[i]) - 1 for i in x) for x in order])
            begins, h = np.cumsum(long) - long, np.zeros((len(order), self.hidden), np.float32)
            xs, ys = (np.concatenate([own[i][low : low + len(own[i]) - 1] for x in order for i in x]) for low in (0, 1))
            new = np.zeros(len(xs), bool)
            new[np.cumsum([0] + [len(own[i]) - 1 for x in order for i in x][:-1])] = True
            for low in range(0, int(long[0]), steps):
                going = int(np.searchsorted(-long, -low, "left"))
                t = np.arange(low, min(low + steps, int(long[0])))[:, None]
                at, live = np.minimum(begins[:going] + t, len(xs) - 1), t < long[:going]
                loss, g, h = self.gradients(np.where(live, xs[at], END), np.where(live, ys[at], -1), h[:going], new[at] & live)
                for name, v in g.items():
                    v /= going
                    square = np.multiply(v, v, out=self.room("square", v.shape, v.dtype))
                    past[name] += square
                    v *= rate
                    v /= np.sqrt(past[name], out=square)
                    self.w[name] -= v
                total += loss
            n += len(xs)
        return total / max(n, 1)

    def packed(self) -> bytes:
        return np.concatenate([self.w[name].ravel() for name in self.NAMES]).astype(np.float32).tobytes()

    def unpack(self, values: np.ndarray) -> Network:
        at = 0
        for name in self.NAMES:
            size = self.w[name].size
            self.w[name] = values[at : at + size].reshape(self.w[name].shape).astype(np.float32)
            at += size
        return self


def block_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch one by one, their long lists as arrays."""
    for i in range(batch.num_rows):
        r = {c: batch.column(c)[i] for c in batch.schema.names}
        yield {
            c: v.values.to_numpy(zero_copy_only=False) if c == "hashes" else v.values if c == "totals" and v.is_valid else v.as_py()
            for c, v in r.items() if c != "counts"
        }


def texts_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each word within its block, each text's number of words)."""
    lengths = np.frombuffer(r["lengths"], np.int32).astype(np.int64)
    return unpacked_numbers(r["local"], int(lengths.sum())), lengths


def training_documents(batches: Iterator[pa.RecordBatch], symbols: Symbols, share: float) -> Iterator[pa.RecordBatch]:
    """The training documents (or a seeded share of them) whole, as symbols; draw is seeded by id and symbols."""
    small = np.uint16 if len(symbols.counts) <= 1 << 16 else np.int32
    for batch in batches:
        for r in block_rows(batch):
            local, lengths = texts_of(r)
            ids = symbols.look_up(r["hashes"])[local].astype(small)
            first = np.cumsum(lengths) - lengths
            own = [(d, ids[low : low + n].tobytes()) for d, held, low, n in zip(r["doc_ids"], r["held"], first.tolist(), lengths.tolist(), strict=True) if not held]
            draw = mix(np.array([zlib.crc32(str(d).encode()) << 24 ^ zlib.crc32(b) for d, b in own], U))
            rows = [(int(x >> U(40)), b, len(b) // ids.itemsize) for x, (_, b) in zip(draw, own, strict=True) if int(x >> U(11)) < int(share * (1 << 53))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.int64())], ["draw", "ids", "n"])


def trainer_of(counts: np.ndarray, weights, lanes: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.dtype(np.uint16 if len(counts) <= 1 << 16 else np.int32)
        n = 0

        def documents() -> Iterator[np.ndarray]:
            nonlocal n
            for batch in batches:
                for ids in batch.column("ids"):
                    own = np.frombuffer(ids.as_buffer(), small)
                    n += len(own)
                    yield np.append(np.int32(END), own.astype(np.int32))

        network = Network(counts).unpack(np.frombuffer(weights.value, np.float32))
        network.train(documents(), lanes=lanes)
        if n:
            yield pa.RecordBatch.from_pylist([{"trainer": TaskContext.get().partitionId(), "n": n, "weights": network.packed()}], WEIGHTS)

    return train


WEIGHTS = pa.schema([("trainer", pa.int64()), ("n", pa.int64()), ("weights", pa.binary())])
WEIGHTS_DDL = "trainer long, n long, weights binary"


def averaged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("trainer")
    total = int(rows["n"].sum())
    mean = sum(np.frombuffer(w, np.float32).astype(float) * (n / total) for n, w in zip(rows["n"], rows["weights"], strict=True))
    return pd.DataFrame({"trainer": [int(rows["trainer"].iloc[0]) // FAN_IN], "n": [total], "weights": [mean.astype(np.float32).tobytes()]})


def losses(batches: Iterator[pa.RecordBatch], counts: np.ndarray, candidates) -> Iterator[pa.RecordBatch]:
    """(candidate, loss): the sums of each candidate's losses over these documents."""
    small = np.dtype(np.uint16 if len(counts) <= 1 << 16 else np.int32)
    networks = [Network(counts).unpack(np.frombuffer(w, np.float32)) for w in candidates.value]
    for batch in batches:
        lists = [np.frombuffer(ids.as_buffer(), small).astype(np.int32) for ids in batch.column("ids")]
        lengths = np.array([len(x) for x in lists], np.int64)
        sums = [-float(n.score(np.concatenate(lists), lengths).sum()) for n in networks] if lists else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["candidate", "loss"])


def fit(documents: DataFrame, counts: np.ndarray, tokens: int, rounds: int = ROUNDS) -> Network:
    """The network after some rounds of training in parallel; each round's trainers see other documents, and together they see all but the judges.

    A trainer is a partition, which streams its documents; the driver gets the weights of FAN_IN averages at most. A round's average, or the mean of it and the
    weights before, takes their place only if it lowers the loss on the judges, so that the network is never worse on them than word counts, which it begins as.
    """
    spark = documents.sparkSession
    network = Network(counts)
    rounds = min(rounds, -(-tokens // TRAINER_TOKENS))  # what one trainer can take is one round: each begins its step sizes anew
    # written once: each round and the judges would otherwise unpack all blocks again
    written = store.write(documents, "training") if tokens else documents
    judges = store.write(written.where(F.col("draw") % JUDGES == JUDGES - 1).select("ids").repartition(max(1, tokens // (JUDGES * JUDGED_TOKENS))), "judges") if tokens else None
    documents = written.where(F.col("draw") % JUDGES != JUDGES - 1)

    def judged(candidates: list[bytes]) -> list[float]:
        sent = spark.sparkContext.broadcast(candidates)  # two networks of a fixed size
        found = judges.mapInArrow(lambda it: losses(it, counts, sent), "candidate int, loss double").groupBy("candidate").agg(F.sum("loss").alias("loss")).collect()
        sent.destroy()
        return [r["loss"] for r in sorted(found, key=lambda r: r["candidate"])] or [0.0] * len(candidates)

    best = judged([network.packed()])[0] if tokens else 0.0
    trainers = max(1, tokens // (rounds * TRAINER_TOKENS)) if tokens else 1
    lanes = min(LANES, max(FEWEST_LANES, tokens // (max(1, rounds) * trainers * STEPS * UPDATES)))
    for k in range(rounds if tokens else 0):
        weights = spark.sparkContext.broadcast(network.packed())  # a fixed size: it follows from the vocabulary and layers
        mine = documents.where(F.col("draw") % rounds == k).repartition(trainers, "draw").sortWithinPartitions("draw", "ids")
        got, left = mine.mapInArrow(trainer_of(counts, weights, lanes), WEIGHTS_DDL), trainers
        while left > FAN_IN**2:
            left = -(-left // FAN_IN)
            got = got.groupBy(F.floor(F.col("trainer") / FAN_IN)).applyInPandas(averaged, WEIGHTS_DDL)
        rows = got.groupBy(F.col("trainer") % FAN_IN).applyInPandas(averaged, WEIGHTS_DDL).collect()
        if rows:
            mean = np.frombuffer(averaged(pd.DataFrame(rows, columns=["trainer", "n", "weights"]))["weights"][0], np.float32)
            half = (mean + np.frombuffer(network.packed(), np.float32)) / 2
            loss, at = min((x, i) for i, x in enumerate(judged([mean.tobytes(), half.tobytes()])))
            if loss <= best:
                best = loss
                network.unpack((mean, half)[at])
        weights.destroy()
    if judges is not None:
        store.drop(judges, written)
    return network


def frequent(totals: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, by hash; the counts' histogram proves that there are not more than so many."""
    level = F.floor(F.log2("c") * 8)
    histogram = sorted(((r["level"], r["n"]) for r in totals.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = None, 0
    for at, own in histogram:
        n += own
        if n > most:
            break
        least = at
    top = totals.where(level >= least if least is not None else F.lit(False)).select("h", "c").toArrow()
    hashes, counts = (top.column(c).to_numpy() for c in ("h", "c"))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], counts[order]


def found_in(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each x is among the sorted values, where)."""
    if not len(sorted_):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x, at


def rare_words(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """(block, h) of the words of each block that are not among the known ones."""
    for batch in batches:
        for r in block_rows(batch):
            rest = r["hashes"][~found_in(known.value[0], r["hashes"])[0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), r["block"])), pa.array(rest)], ["block", "h"])


def unseen_odds(counts: np.ndarray, tokens: int, kinds: int) -> float:
    """How far the odds of a word outside the network's vocabulary rise from the training tokens, which have seen it, to other texts: to what the smoothed counts give such words."""
    seen, smoothed = float(counts[OTHER] / counts.sum()), max(1, tokens + kinds - int(counts[1:].sum()) - (len(counts) - 1) + 1) / (tokens + kinds + 1)
    return smoothed / (1 - smoothed) / (seen / (1 - seen)) if 0 < seen < 1 and 0 < smoothed < 1 else 1.0


def score_blocks(batches: Iterator[pa.RecordBatch], symbols: Symbols, counts: np.ndarray, weights, known, tokens: int, kinds: int) -> Iterator[pa.RecordBatch]:
    network = Network(counts).unpack(np.frombuffer(weights, np.float32))
    other_tokens = tokens - int(counts[1:].sum())
    other_kinds = kinds - (len(counts) - 1)
    odds = unseen_odds(counts, tokens, kinds)
    for batch in batches:
        for r in block_rows(batch):
            (local, lengths), hashes = texts_of(r), r["hashes"]
            hit, at = found_in(known.value[0], hashes)
            c = np.where(hit, known.value[1][at] if len(known.value[1]) else 0, 0)
            if r["totals"] is not None:
                h, n = (r["totals"].field(k).to_numpy(zero_copy_only=False) for k in ("h", "c"))
                order = np.argsort(hashes)
                c[order[np.searchsorted(hashes[order], h)]] = n
            first = np.cumsum(lengths) - lengths
            base = np.log10((c + 1) / (tokens + kinds + 1))[local]
            ids = symbols.look_up(hashes)
            log = network.score(ids[local], lengths, odds) / np.log(10)
            within = np.where(ids == OTHER, np.log10((c + 1) / max(1, other_tokens + other_kinds + 1)), 0.0)
            add = lambda v: np.add.reduceat(v, first)
            columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"]), pa.array(lengths, pa.int64()), pa.array(add((c > 0)[local].astype(np.int64))), pa.array([tokens] * len(first), pa.int64()), pa.array(add(base)), pa.array(add(log.astype(float) + within[local]))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = store.write(rows.mapInArrow(to_blocks, BLOCKS_DDL), "blocks")
    words = blocks.select("block", F.explode(F.arrays_zip("hashes", "counts")).alias("w")).select("block", F.col("w.hashes").alias("h"), F.col("w.counts").alias("c"))
    totals = store.write(words.where("c > 0").groupBy("h").agg(F.sum("c").alias("c")), "totals")
    seen = totals.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = seen["n"] or 0, seen["v"]
    hashes, known_counts = frequent(totals)
    top = np.lexsort((hashes, -known_counts))[:vocabulary]
    symbols = Symbols.of(list(zip(hashes[top].tolist(), known_counts[top].tolist(), strict=True)), tokens)
    training = blocks.select("doc_ids", "held", "lengths", "local", "hashes").mapInArrow(lambda it: training_documents(it, symbols, share), "draw long, ids binary, n long")
    counts = symbols.counts
    weights = fit(training, counts, tokens).packed()
    known = spark.sparkContext.broadcast((hashes, known_counts))  # FREQUENT words at most
    rare = blocks.select("block", "hashes").mapInArrow(lambda it: rare_words(it, known), "block long, h long")
    of_block = rare.join(totals, "h").groupBy("block").agg(F.collect_list(F.struct("h", "c")).alias("totals"))
    scored = blocks.select("block", "doc_ids", "held", "lengths", "local", "hashes").join(of_block, "block", "left")
    return scored.drop("block").mapInArrow(lambda it: score_blocks(it, symbols, counts, weights, known, tokens, kinds), SCORES)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(store.read(spark, sf_dir, "documents"))
