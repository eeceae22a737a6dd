"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each byte of a text has a label: 0 (no token ends there), 1 (one of A's ends), 2 (one of B's ends) or 3 (both). A regular expression
scans the label string for the spans up to each 3; the labels in a span say how many tokens of either side form a group. A link
is a pair of tokens with a byte in common: there is one for each label but 0.

Neither tokenizer has a token across a space that follows a letter, a digit or a mark (A's pattern breaks there, B has no such piece), so
a text is cut at these spaces and a segment is encoded and aligned once a task, however often it comes; both sides' last
tokens end with the segment, so that no span crosses a cut and a text's label string is that of its segments, joined.

How many links of the corpus hold a pair of ids is a sum over all documents. Tasks sum the pairs of a block of documents first and write the block with its documents
as one row; pairs are then shuffled once for each block that has them, summed, and sent back to their blocks, which add
them up by document. Only the highest count of each of B's ids is broadcast: B's vocabulary bounds it (LARGEST_B ids at most).

Defined results: texts that are null or empty, or that either tokenizer doesn't give back byte for byte (those with U+2581, B's mark of a space), have no tokens:
zeros and an empty digest, and count for no pair. Null ids and repeated rows stay, and each row's links count; extra columns are ignored; an empty
table gives an empty result. Special tokens' strings inside texts are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import slices

BLOCK_BYTES, PART_BYTES = 2 << 20, 1 << 18
#: Segments that a task keeps, and their characters; beyond either it begins anew with the next block.
MOST_SEGMENTS, MOST_CHARACTERS = 200_000, 8 << 20
LARGEST_B = 1 << 20
#: A space after a letter, a digit or a mark of ASCII or Latin script.
CUT = re.compile(r" (?<=[!-~À-ɏ] )")
#: Characters whose class is the same in all versions of Unicode; segments with others go to A's own file instead of its ranks.
SETTLED = re.compile(r"[\x00-ɏ]*\Z")
SPAN = re.compile(rb"[^3]*3")
DIGITS = bytes.maketrans(bytes(range(4)), b"0123")


def default_paths() -> tuple[str, str, str]:
    """A's tokenizer file, the ranks of the same vocabulary, and B's model."""
    import public_tokenizers

    return tuple(public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


class Vocabulary:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.name = [str(i) for i in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Segments:
    """Distinct segments, numbered as they come, with their tokens and links.

    Of segment k: n_a[k], n_b[k], n_groups[k], n_links[k]; good[k]: both sides give its bytes back; groups[k]: its groups as text; links(): the codes a << 32 | b of its links.
    """

    def __init__(self, json_path: str, ranks_path: str, model_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.ranks = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        by_id = {i: t for t, i in ranks.items()}
        self.a = Vocabulary([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.space = self.model.piece_to_id("▁")
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        if len(pieces) > LARGEST_B:
            raise ValueError(f"B has more than {LARGEST_B} ids")
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])
        self.sizes: dict[bytes, tuple[int, int]] = {}
        self.clear()

    @cached_property
    def whole(self):
        """A's own file, read when a text needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.json_path)
        out.encode_special_tokens = True
        return out

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.good = np.zeros(0, bool)
        self.codes, self.code_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, fresh: list[str]) -> None:
        """Encodes and aligns segments that have no number, each given without its first space."""
        if not fresh:
            return
        first = len(self.number)
        self.number.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        self.characters += sum(map(len, fresh))
        spaced = [" " + s for s in fresh]
        a_ids = [self.ranks.encode_ordinary(s) if SETTLED.match(s) else self.whole.encode(s, add_special_tokens=False).ids for s in spaced]
        # a space by itself, at a text's end: B gives nothing for an empty text
        b_ids = [ids or [self.space] for ids in self.model.encode(fresh, num_threads=1)]
        data = [s.encode() for s in spaced]
        size = np.fromiter(map(len, data), np.int64, len(data))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        good = np.ones(len(fresh), bool)
        for vocabulary, flat, n in ((self.a, flat_a, n_a), (self.b, flat_b, n_b)):
            ends = np.concatenate([[0], np.cumsum(vocabulary.length[flat])])[np.concatenate([[0], np.cumsum(n)])]
            good &= np.diff(ends) == size
        joined = [data[k] for k in np.flatnonzero(good)]
        want = np.frombuffer(b"".join(joined), np.uint8)
        row = np.repeat(np.flatnonzero(good), size[good])
        for vocabulary, flat, n in ((self.a, flat_a, n_a), (self.b, flat_b, n_b)):
            good[row[vocabulary.joined(flat[np.repeat(good, n)]) != want]] = False
            # the segments taken out stay out of the next comparison
            keep = good[row]
            want, row = want[keep], row[keep]
        self.align(good, size, n_a, n_b, flat_a, flat_b)

    def align(self, good: np.ndarray, size: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray) -> None:
        n = len(good)
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        labels = np.zeros(int(size[good].sum()), np.uint8)
        labels[np.cumsum(self.a.length[flat_a]) - 1] |= 1
        labels[np.cumsum(self.b.length[flat_b]) - 1] |= 2
        spans = SPAN.findall(labels.tobytes().translate(DIGITS))
        for s in set(spans) - self.sizes.keys():
            if len(self.sizes) > MOST_SEGMENTS:
                self.sizes = {x: self.sizes[x] for x in spans if x in self.sizes}
            self.sizes[s] = s.count(b"1") + 1, s.count(b"2") + 1
        in_group = np.array([self.sizes[s] for s in spans], np.int64).reshape(-1, 2)
        span_end = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        ends = np.cumsum(size[good])
        n_groups, n_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
        groups_at = np.searchsorted(span_end, ends, "right")
        n_groups[good] = np.diff(groups_at, prepend=0)
        # a link for each labelled byte, between the tokens of either side that it belongs to
        at = np.flatnonzero(labels)
        a = np.searchsorted(np.cumsum(self.a.length[flat_a]), at, "right")
        b = np.searchsorted(np.cumsum(self.b.length[flat_b]), at, "right")
        n_links[good] = np.diff(np.searchsorted(at, ends), prepend=0)
        a_name, b_name = [self.a.name[i] for i in flat_a.tolist()], [self.b.name[i] for i in flat_b.tolist()]
        a_end, b_end = np.cumsum(in_group[:, 0]), np.cumsum(in_group[:, 1])
        low_a, low_b, texts = 0, 0, []
        for high_a, high_b in zip(a_end.tolist(), b_end.tolist(), strict=True):
            texts.append(f"{','.join(a_name[low_a:high_a])}|{','.join(b_name[low_b:high_b])}")
            low_a, low_b = high_a, high_b
        low, of_good = 0, iter(groups_at.tolist())
        for ok in good.tolist():
            if ok:
                high = next(of_good)
                self.groups.append(";".join(texts[low:high]))
                low = high
            else:
                self.groups.append("")
        self.counts = np.concatenate([self.counts, np.where(good, [n_a, n_b, n_groups, n_links], 0).T])
        self.good = np.concatenate([self.good, good])
        self.codes = np.concatenate([self.codes, flat_a[a] << 32 | flat_b[b]])
        self.code_at = np.concatenate([self.code_at, self.code_at[-1] + np.cumsum(n_links)])

    def links(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of these segments' links, one after the other, and how many each has."""
        n = self.code_at[which + 1] - self.code_at[which]
        return self.codes[np.repeat(self.code_at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def tidy(self) -> None:
        """Forgets all segments if there are too many."""
        if len(self.number) > MOST_SEGMENTS or self.characters > MOST_CHARACTERS:
            self.clear()

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' segments, and how many each text has."""
        parts = [CUT.split(t) if t else [] for t in texts]
        self.add(list(set().union(*parts) - self.number.keys()))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum())), n


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: A block: its distinct pairs and how many links of it hold them; which pairs each of its segments has (pair_of, pairs_in); which segments each document has (segment_of, segments_in).
BLOCKS = "block long, code array<long>, times array<long>, pair_of array<int>, pairs_in array<int>, segment_of array<int>, segments_in array<int>, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>"
ALIGNED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_best long, count_sum long, groups_sha256 string"


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values (of the rows, where values has two dimensions)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    at = np.concatenate([[0], np.cumsum(n)])
    return total[at[1:]] - total[at[:-1]]


def block_part(known: Segments, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The segments of some texts, how many each has (none if it isn't given back byte for byte) and the digests of their groups."""
    flat, n = known.of_texts(texts.to_pylist())
    good = (sums((~known.good[flat]).astype(np.int64), n) == 0) & (n > 0)
    flat, n = flat[np.repeat(good, n)].astype(np.int32), np.where(good, n, 0)
    groups, low, digests = list(map(known.groups.__getitem__, flat.tolist())), 0, []
    for high in np.cumsum(n).tolist():
        digests.append(hashlib.sha256(";".join(groups[low:high]).encode()).hexdigest() if high > low else "")
        low = high
    return flat, n, digests


def make_blocks(batches: Iterator[pa.RecordBatch], paths: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    known, made = Segments(*paths), TaskContext.get().partitionId() << 34
    for batch in batches:
        done = 0
        for part in slices(batch.column("text"), BLOCK_BYTES):
            ids = batch.column("doc_id").slice(done, len(part))
            done += len(part)
            known.tidy()
            found = [block_part(known, few) for few in slices(part, PART_BYTES)]
            flat, n = (np.concatenate([f[k] for f in found]) for k in range(2))
            digests = [d for f in found for d in f[2]]
            counts = sums(known.counts[flat], n)
            present = np.flatnonzero(np.bincount(flat, minlength=len(known.good)))
            local = np.zeros(len(known.good), np.int32)
            local[present] = np.arange(len(present))
            codes, in_segment = known.links(present)
            code, pair_of = np.unique(codes, return_inverse=True)
            weight = np.repeat(np.bincount(local[flat], minlength=len(present)), in_segment)
            times = np.bincount(pair_of, weight, len(code)).astype(np.int64)
            row = [made, code, times, pair_of.astype(np.int32), in_segment.astype(np.int32), local[flat], n.astype(np.int32), ids, *counts.T, digests]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 4, *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
            names = ["block", "code", "times", "pair_of", "pairs_in", "segment_of", "segments_in", "doc_id", *COUNTS, "groups_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) if k == pa.int64() else one_list(x, k) for x, k in zip(row, kinds, strict=True)], names)
            made += 1


def one_list(values, kind: pa.ListType) -> pa.Array:
    values = values.cast(kind.value_type) if isinstance(values, pa.Array) else pa.array(values, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def count_links(block: pa.Table, counted: pa.Table) -> pa.Table:
    """A block's documents, with its pairs' counts over the corpus added up."""
    whole = {c: pc.list_flatten(block.column(c)).combine_chunks() for c in block.column_names if pa.types.is_list(block.schema.field(c).type)}
    of, inside, segment_of, segments_in = (whole[c].to_numpy() for c in ("pair_of", "pairs_in", "segment_of", "segments_in"))
    total, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
    at = counted.column("at").to_numpy()
    total[at], best[at] = counted.column("total").to_numpy(), counted.column("best").to_numpy()
    by_segment = np.stack([sums(best[of], inside), sums(total[of], inside)], 1)
    by_doc = sums(by_segment[segment_of], segments_in)
    return pa.table({"doc_id": whole["doc_id"], **{c: whole[c] for c in COUNTS}, "n_best": by_doc[:, 0], "count_sum": by_doc[:, 1], "groups_sha256": whole["groups_sha256"]})


def blocks_of(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """The written blocks of all documents."""
    paths = paths or default_paths()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a few blocks a row group, so that writer and readers hold no more: its size is looked at after each row, and not first after 100 or when the size of the rows so far lets expect it
    small = {"parquet.block.size": 4 * BLOCK_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    return store.write(rows.mapInArrow(lambda it: make_blocks(it, paths), BLOCKS), "alignment", **small)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """code (a << 32 | b), b and total: how many links of the corpus hold the pair of ids."""
    pairs = blocks.select(F.explode(F.arrays_zip("code", "times")).alias("p")).select("p.code", "p.times")
    return pairs.groupBy("code").agg(F.sum("times").alias("total")).withColumn("b", F.col("code").bitwiseAND((1 << 32) - 1))


def align_documents(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """A row for each document: its tokens, groups and links, with the counts of its links' pairs over all documents."""
    blocks = blocks_of(docs, paths)
    counts = store.write(pair_counts(blocks), "pairs")
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    judged = counts.join(F.broadcast(highest), "b").select("code", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    asked = blocks.select("block", F.posexplode("code").alias("at", "code"))
    counted = asked.join(judged, "code").select(F.col("block").alias("of_block"), "at", "total", "best")
    return blocks.drop("code", "times").groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(count_links, ALIGNED)


def group_rows(batches: Iterator[pa.RecordBatch], paths: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    known = Segments(*paths)
    for batch in batches:
        done = 0
        for part in slices(batch.column("text"), PART_BYTES):
            known.tidy()
            flat, n = known.of_texts(part.to_pylist())
            low, out = 0, []
            for high in np.cumsum(n).tolist():
                mine = flat[low:high]
                groups = [g.split("|") for k in mine.tolist() for g in known.groups[k].split(";")] if known.good[mine].all() else []
                out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in groups])
                low = high
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(part)), pa.array(out, kind)], ["doc_id", "groups"])
            done += len(part)


def token_groups(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id and its groups in order, each the ids of A and those of B that cover the same bytes; nothing is shuffled."""
    paths = paths or default_paths()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: group_rows(it, paths), "doc_id long, groups array<struct<a array<int>, b array<int>>>")


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(store.read(spark, sf_dir, "documents"))
