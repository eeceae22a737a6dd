"""Packing by lexical retrieval: a sharded BM25 index fills each seed document's window with its neighbours.

1. Every document is encoded once. Full windows are cut off its front and are sequences of their own; the
   rest (shorter than a window) waits to be packed.
2. Rests are range-partitioned by a MinHash of their token pairs, so that similar texts come to lie together (equal hashes
   are split by doc_id, so a large group of copies spreads), and each partition is streamed in shards of bounded size.
3. A shard is a BM25 inverted index over token ids. The next unused rest is the seed; all its tokens are the
   query; unused neighbours fill the window from the best on, and the best that no longer fits is cut to fill
   it exactly; what is cut off stays unused. Rests left in an unfilled window go on to the next shard.
So only the last sequence of a partition can be short, and padding is below one window a partition.

Ids come from a public tokenizer's file, whose path is a parameter. Texts are cut at its added tokens, which have ids of their
own, and between them at white space in the way of its own pre-tokenizer; each distinct piece is encoded once a worker.

Defined results: a null text is empty and has only its end id; equal rows are packed separately; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import U, Words, mix, slices

WINDOW, END_ID = 2048, 1
#: Rests and their tokens in one index, tokens in one partition.
SHARD_DOCS, SHARD_TOKENS, PARTITION_TOKENS = 2048, 1_500_000, 3_000_000
K1, B = 1.2, 0.75
#: White space as the pre-tokenizer has it (Unicode's property White_Space): fixed values.
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary as ranks; its ids are those of byte_bpe_50k.json, which the tests compare."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Spans:
    """Pieces of bytes as a list has them, without an object for each until it is asked for."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    @classmethod
    def of(cls, pieces: list[bytes]) -> Spans:
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self) -> Iterator[bytes]:
        raw = self.data.tobytes()
        return (raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True))

    def where(self, mask: np.ndarray) -> Spans:
        return Spans(self.data, self.starts[mask], self.ends[mask])

    def joined(self) -> bytes:
        sizes = self.ends - self.starts
        total = np.cumsum(sizes)
        return self.data[np.repeat(self.starts - (total - sizes), sizes) + np.arange(sizes.sum())].tobytes()

    def after_space(self) -> np.ndarray:
        """Which are one space and then something else."""
        long = np.flatnonzero(self.ends - self.starts > 1)
        out = np.zeros(len(self), bool)
        out[long] = (self.data[self.starts[long]] == 32) & (self.data[self.starts[long] + 1] != 32)
        return out


def load_tokenizer(path: str):
    """A function from pieces (a list of bytes, or Spans) to all their ids and each one's number of ids; ranks have no added tokens.

    path: a tokenizer's JSON, or a ranks file. Ranks encode the pieces that begin with a space as one text, in which
    each stays a pre-token of its own; the tokens' lengths in bytes tell where a piece ends.
    """
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda pieces: numbered([e.ids for e in tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False)])
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
    n_bytes[list(ranks.values())] = list(map(len, ranks))

    def ids_of(pieces: list[bytes] | Spans) -> tuple[np.ndarray, np.ndarray]:
        pieces = pieces if isinstance(pieces, Spans) else Spans.of(pieces)
        spaced = pieces.after_space()
        many = pieces.where(spaced)
        ids = np.array(own.encode_to_numpy(many.joined().decode(), disallowed_special=()), np.uint32)
        ends = np.cumsum(many.ends - many.starts)
        sizes = np.diff(np.searchsorted(np.cumsum(n_bytes[ids]), ends, "right"), prepend=0)
        rest, rest_sizes = numbered([own.encode_ordinary(p.decode()) for p in pieces.where(~spaced)])
        out = np.empty(len(pieces), np.int64)
        out[spaced], out[~spaced] = sizes, rest_sizes
        flat, of_spaced = np.empty(len(ids) + len(rest), np.uint32), np.repeat(spaced, out)
        flat[of_spaced], flat[~of_spaced] = ids, rest
        return flat, out

    return ids_of


def added_tokens(path: str) -> dict[str, int]:
    """The ids of the tokens that a tokenizer's JSON adds to its model; a ranks file's are those of the JSON beside it, if there is one."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}


def numbered(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


class Encoder:
    """The ids of texts; remembers the ids of distinct pieces, up to a bound."""

    def __init__(self, path: str, most: int = 800_000):
        self.ids_of = load_tokenizer(path)
        self.most = most
        self.added = added_tokens(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rank = np.zeros(0, U), np.zeros(0, np.int64)  # of the pieces, by hash
        self.codes, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)  # by rank

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; texts are cut at added tokens first, as each part is a text of its own to the pre-tokenizer."""
        if not any(pc.any(pc.match_substring(column, t)).as_py() for t in self.added):
            return self.parts(column)
        # of added tokens that begin at the same place the longest counts
        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        rows = [cut.split(t or "") for t in column.to_pylist()]
        found = iter(self.parts(pa.array([x for row in rows for x in row[::2]], column.type)))
        return [np.concatenate([np.array([self.added[x]], np.uint32) if k % 2 else next(found) for k, x in enumerate(row)]) for row in rows]

    def parts(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; pieces are cut, hashed and made distinct as arrays, and only new ones are encoded."""
        w = Words(column)
        starts, ends = pieces(w)
        row = np.searchsorted(w.offsets, starts, "right") - 1
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(column)
        hashes = w.spans(starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        distinct, some = ordered[head], order[head]
        if len(self.hashes) + len(distinct) > self.most:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = np.flatnonzero(at < len(self.hashes))
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            codes, sizes = self.ids_of(Spans(w.data, starts[some[new]], ends[some[new]]))
            begins = len(self.codes) + np.cumsum(sizes) - sizes
            self.hashes, self.rank = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.rank, at[new], np.arange(len(sizes)) + len(self.sizes))
            self.codes, self.begins, self.sizes = (np.concatenate(x) for x in ((self.codes, codes), (self.begins, begins), (self.sizes, sizes)))
            at += np.cumsum(new) - new
        rank = np.empty(len(starts), np.int64)
        rank[order] = self.rank[at][np.cumsum(head) - 1]
        n = self.sizes[rank]
        total = np.cumsum(n)
        flat = self.codes[np.repeat(self.begins[rank] - (total - n), n) + np.arange(total[-1])]
        per_row = np.bincount(row, n, len(column)).astype(np.int64)
        return np.split(flat, np.cumsum(per_row)[:-1])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that none loads the vocabulary again or encodes what an earlier one has."""
    return Encoder(path)


def pieces(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of all rows start and end: a word with the single space before it, and the other white space.

    Of white space before a word, all but its last character is one piece, and the last another unless it is a space; at a
    text's end all of it is one piece. That is what the pre-tokenizer's pattern does at white space.
    """
    bounds = w.offsets
    whole = white_space(w.data)
    inside = np.ones(len(w.data), bool)
    for at, n in whole:
        for k in range(int(n.max()) if len(n) else 0):
            inside[at[n > k] + k] = False
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(inside))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # white space runs
    gap_before, gap_after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    gap_before[1:], gap_after[:-1] = ~inside[:-1], ~inside[1:]
    gap_before[edges], gap_after[edges - 1] = False, False
    low, high = np.flatnonzero(~inside & ~gap_before), np.flatnonzero(~inside & ~gap_after) + 1
    at_bound = np.zeros(len(inside) + 1, bool)
    at_bound[bounds] = True
    at_end = at_bound[high]
    last = high - 1  # where each run's last character begins
    if len(whole) > 1:
        wide, size = (np.concatenate(x) for x in zip(*whole[1:], strict=True))
        ends_wide = np.zeros(len(inside) + 1, np.int64)
        ends_wide[wide + size] = size
        last = high - np.maximum(1, ends_wide[high])
    single = (w.data[last] == 32) & ~at_end if len(high) else np.zeros(0, bool)
    after_single = np.zeros(len(inside) + 1, bool)
    after_single[high[single]] = True
    joined_to = after_single[starts]
    cut = ~at_end & (low < last)
    alone = ~at_end & ~single
    all_starts = np.concatenate([starts - joined_to, low[at_end], low[cut], last[alone]])
    all_ends = np.concatenate([ends, high[at_end], last[cut], high[alone]])
    order = np.argsort(all_starts, kind="stable")
    return all_starts[order], all_ends[order]


def white_space(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where Unicode's white space characters begin, and their lengths in bytes."""
    ascii_ = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    found = [(ascii_, np.ones(len(ascii_), np.int64))]
    for c in (x.encode() for x in SPACE if ord(x) > 127):
        at = np.flatnonzero(data[: len(data) - len(c) + 1] == c[0])
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        if len(at):
            found.append((at, np.full(len(at), len(c))))
    return found


def encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Full windows as finished pieces; the rest of each document with its ids and its place in the order of similar texts."""
    encoder, made = encoder_of(path), 0
    base = (1 << 62) | (TaskContext.get().partitionId() << 34)
    for batch in batches:
        ids, done = batch.column("doc_id").to_pylist(), 0
        for part in slices(batch.column("text"), 1 << 20):
            rows = []
            for doc_id, code in zip(ids[done : done + len(part)], encoder(part), strict=True):
                code = np.append(code, np.uint32(end_id))
                n = len(code)
                full = n // WINDOW * WINDOW
                for start in range(0, full, WINDOW):
                    rows.append((doc_id, start, WINDOW, zlib.crc32(code[start : start + WINDOW].tobytes()), n, base + made, None, None))
                    made += 1
                if full < n:
                    rest = code[full:]
                    pairs = rest[:-1].astype(U) << U(32) | rest[1:].astype(U)
                    near = int(mix(pairs).min() >> U(1)) if len(pairs) else 0
                    rows.append((doc_id, full, n - full, None, n, None, rest.astype("<u4").tobytes(), near))
            done += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ENCODED.types, strict=True)], schema=ENCODED)


ENCODED = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id")] + [("ids", pa.binary()), ("near", pa.int64())])


class Shard:
    """A BM25 inverted index over some rests, each an array of ids."""

    def __init__(self, rests: list[np.ndarray]):
        n = len(rests)
        length = np.array([len(r) for r in rests])
        key = np.repeat(np.arange(n, dtype=np.int64), length) << 32 | np.concatenate(rests).astype(np.int64)
        key, times = np.unique(key, return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        _, rank, in_docs = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((n - in_docs + 0.5) / (in_docs + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1))
        weight = idf[rank] * times * (K1 + 1) / (times + norm[doc])
        order = np.argsort(rank, kind="stable")
        self.rank, self.docs, self.weights = rank, doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(in_docs)])
        self.idf = np.where(in_docs > 1, idf, 0)
        self.n = n
        # terms of many rests as whole rows: to add them up is one pass over memory
        often = in_docs >= max(2, n // 8)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), n))
        mine = np.repeat(often, in_docs)
        self.rows[np.repeat(self.row, in_docs)[mine], self.docs[mine]] = self.weights[mine]

    def scores(self, seed: int) -> np.ndarray:
        """Each rest's score for all the seed's tokens that others have too."""
        terms = self.rank[self.doc_at[seed] : self.doc_at[seed + 1]]
        terms = terms[self.idf[terms] > 0]
        if not len(terms):
            return np.zeros(self.n)
        row = self.row[terms]
        out = self.rows[row[row >= 0]].sum(0)
        few = terms[row < 0]
        if len(few):
            size = self.at[few + 1] - self.at[few]
            flat = np.repeat(self.at[few] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out += np.bincount(self.docs[flat], self.weights[flat], self.n)
        return out


def fill(rests: list[np.ndarray]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """(sequences, left): full windows as lists of (rest, from, to), and the (rest, from) that didn't fill a window."""
    shard = Shard(rests)
    total = np.array([len(r) for r in rests])
    begun = np.zeros(len(rests), np.int64)  # ids of each rest used so far
    room_for = int(total.sum())
    out: list[list[tuple[int, int, int]]] = []
    seed = 0
    while room_for >= WINDOW:
        while begun[seed] == total[seed]:
            seed += 1
        take, room = [(seed, int(begun[seed]), int(total[seed]))], WINDOW - int(total[seed] - begun[seed])
        begun[seed] = total[seed]
        score = shard.scores(seed)
        open_ = np.flatnonzero(begun < total)
        order = open_[np.argsort(-score[open_], kind="stable")]
        sizes = (total - begun)[order]
        first_skipped = None
        at = 0
        while room and at < len(order):
            # the next in order that fits
            fits = np.flatnonzero(sizes[at:] <= room)
            if first_skipped is None and (not len(fits) or fits[0]):
                first_skipped = order[at]
            if not len(fits) or (first_skipped is not None and score[order[at + fits[0]]] <= 0):
                break
            at += int(fits[0])
            d = int(order[at])
            take.append((d, int(begun[d]), int(total[d])))
            room -= int(sizes[at])
            begun[d] = total[d]
            at += 1
        if room:
            d = int(first_skipped)
            take.append((d, int(begun[d]), int(begun[d]) + room))
            begun[d] += room
        out.append(take)
        room_for -= WINDOW
    return out, [(i, int(begun[i])) for i in np.flatnonzero(begun < total)]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rests as pieces of sequences, shard by shard."""
    base, made = TaskContext.get().partitionId() << 34, 0
    held: list[tuple] = []  # (doc_id, start, doc_tokens, ids)

    def pieces(sequences: list[list[tuple[int, int, int]]]) -> Iterator[tuple]:
        nonlocal made
        for sequence in sequences:
            offset = 0
            for i, low, high in sequence:
                doc_id, start, n, ids = held[i]
                yield doc_id, start + low, high - low, zlib.crc32(ids[low:high].astype("<u4").tobytes()), n, base + made, offset
                offset += high - low
            made += 1

    def batch_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        if got := list(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], PIECE_COLUMNS)

    tokens = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            held.append((*row[:3], np.frombuffer(row[3], "<u4")))
            tokens += len(held[-1][3])
            if len(held) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                sequences, left = fill([h[3] for h in held])
                yield from batch_of(pieces(sequences))
                held = [(d, s + low, n, ids[low:]) for (d, s, n, ids), low in ((held[i], low) for i, low in left)]
                tokens = sum(len(h[3]) for h in held)
    if held:
        sequences, left = fill([h[3] for h in held])
        if left:
            sequences.append([(i, low, len(held[i][3])) for i, low in left])
        yield from batch_of(pieces(sequences))


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    schema = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in ENCODED)
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lambda it: encode(it, path, end_id), schema)
    encoded = store.write(encoded, "encoded")
    rests = encoded.where("ids is not null")
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-tokens // PARTITION_TOKENS))
    rests = rests.select("near", "doc_id", "start", "doc_tokens", "ids").repartitionByRange(parts, "near", "doc_id").sortWithinPartitions("near", "doc_id", "ids")
    packed = rests.mapInArrow(pack, PIECES)
    full = encoded.where("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(store.read(spark, sf_dir, "documents"))
