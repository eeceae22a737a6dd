"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with its leading space mark. Its best segmentation under a unigram model maximises the sum
of the pieces' log-probabilities. The best score of a prefix doesn't depend on what follows, so distinct
pre-tokens are inserted in a trie, whose nodes hold forward scores: each is computed once for all words
that share the prefix, and a word's last node holds its number of tokens. A document's count is
the sum over its words. Every task keeps a trie of the distinct pre-tokens it has met and the counts it has read off, up to a bound on
each; words longer than LONG_WORD share nothing and keep the scores of their last prefixes only.

Pieces come from a public SentencePiece file, whose path is a parameter. Where that holds BPE ranks (whole numbers) and not
unigram scores, rank r has the probability 1 / ((r + 1) H), H being the harmonic sum (Zipf's law). Characters outside the vocabulary are UTF-8
bytes, a token each.

Defined results: null and empty texts have 0 words and tokens; equal rows count alike; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SPACE_MARK, BYTE_SCORE = "▁", -30.0
MOST_NODES, MOST_WORDS = 600_000, 600_000
#: Words of more characters go past the trie, which would keep a node for each.
LONG_WORD = 512


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of the ordinary pieces of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = [model.get_score(i) for i in ids]
    if all(s == int(s) for s in scores):
        harmonic = sum(1 / (k + 1) for k in range(len(ids)))
        ids = [i for _, i in sorted(zip((-s for s in scores), ids, strict=True))]
        scores = [-log((k + 1) * harmonic) for k in range(len(ids))]
    return {model.id_to_piece(i): s for i, s in zip(ids, scores, strict=True)}


class ForwardTrie:
    """Prefixes of pre-tokens with the score and the number of tokens of their best segmentation."""

    def __init__(self, pieces: dict[str, float], most_nodes: int = MOST_NODES):
        self.pieces, self.longest, self.most = pieces, max(map(len, pieces), default=1), most_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The number of tokens of the word; adds the nodes of the prefixes that are new."""
        node, path, child = 0, [0], self.child
        for at, c in enumerate(word):
            below = child.get((node, c))
            if below is None:
                below = self.extend(word, at + 1, path)
                child[node, c] = below
            path.append(node := below)
        return self.count[node]

    def long(self, word: str) -> int:
        """insert() of a long word that keeps the scores of the last longest-piece prefixes only."""
        pieces, keep = self.pieces, self.longest + 1
        score, count = [0.0] * keep, [0] * keep  # of the prefix of length k at k % keep
        for end, c in enumerate(word, 1):
            n = len(c.encode())
            best, fewest = score[(end - 1) % keep] + n * BYTE_SCORE, count[(end - 1) % keep] + n
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                own = pieces.get(word[start:end])
                if own is not None:
                    s, k = score[start % keep] + own, count[start % keep] + 1
                    if s > best or s == best and k <= fewest:
                        best, fewest = s, k
            score[end % keep], count[end % keep] = best, fewest
        return count[len(word) % keep]

    def extend(self, word: str, end: int, path: list[int]) -> int:
        """A node for word[:end]; path: the nodes of its prefixes. Ties go to fewer tokens, then to the longer last piece."""
        pieces, score, count = self.pieces, self.score, self.count
        n = len(word[end - 1].encode())
        best, fewest = score[path[end - 1]] + n * BYTE_SCORE, count[path[end - 1]] + n
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            own = pieces.get(word[start:end])
            if own is not None:
                before = path[start]
                s, k = score[before] + own, count[before] + 1
                if s > best or s == best and k <= fewest:
                    best, fewest = s, k
        score.append(best)
        count.append(fewest)
        return len(score) - 1


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    trie, known = ForwardTrie(load_pieces(path)), {}
    for batch in batches:
        n_words, n_tokens, texts = [], [], batch.column("text")
        for low in range(0, len(texts), 128):
            cut = [(t or "").encode().split() for t in texts.slice(low, 128).to_pylist()]
            distinct = set().union(*cut)
            if len(known) + len(distinct) > MOST_WORDS:
                known = {}
            # in sorted order, words that share prefixes follow each other
            for word in sorted(distinct - known.keys()):
                if len(trie.score) > trie.most:
                    trie.clear()
                text = SPACE_MARK + word.decode()
                known[word] = trie.insert(text) if len(text) <= LONG_WORD else trie.long(text)
            get = known.__getitem__
            n_words += map(len, cut)
            n_tokens += [sum(map(get, words)) for words in cut]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every row; nothing is shuffled."""
    path = path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: count_batches(it, path), "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(store.read(spark, sf_dir, "documents"))
