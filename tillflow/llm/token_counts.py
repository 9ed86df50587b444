"""Token counts of a unigram segmentation, by dynamic programming shared along a trie.

A pre-token is a word with the mark of a word's start. Its segmentation is the one with the best sum of piece scores; of equal sums,
the one with fewer tokens. The score of the best segmentation of a prefix depends on the prefix alone, so words that share a prefix
share its scores: the distinct pre-tokens of an Arrow batch are walked in sorted order, which is a depth-first walk of their trie with
one branch in memory at a time, and each node is computed once. The counts at the terminals go back to the documents of the batch.

Nothing is shuffled: a document's count needs the vocabulary only (a fixed number of pieces, sent to the executors).
"""
from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillflow.llm.common import documents, text_chunks, words

MARK = "▁"                    # start of a word
UNKNOWN = 10.0                     # below the worst score, for each byte of a character without a piece
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """A vocabulary with unigram scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - UNKNOWN


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces of a sentencepiece model file; score: minus log of the rank, as word frequencies fall (the file holds ranks of merges)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Pieces({sp.id_to_piece(i): -math.log(k + 2) for k, i in enumerate(plain)})


def trie_counts(pretokens: Iterable[str], pieces: Pieces) -> list[int]:
    """Tokens of each of the sorted, distinct pre-tokens."""
    scores, longest, byte = pieces.scores, pieces.longest, pieces.byte
    best, count, out, before = [0.0], [0], [], ""
    for word in pretokens:
        shared = 0
        for a, b in zip(word, before):
            if a != b:
                break
            shared += 1
        del best[shared + 1:], count[shared + 1:]                # back up to the common node
        for end in range(shared + 1, len(word) + 1):             # and down the new branch
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, tokens = (-math.inf, 0) if word[end - 1] in scores else (best[end - 1] + n * byte, count[end - 1] + n)
            for start in range(max(0, end - longest), end):
                s = scores.get(word[start:end])
                if s is not None:
                    s += best[start]
                    t = count[start] + 1
                    if s > top + 1e-9 or (s > top - 1e-9 and t < tokens):
                        top, tokens = s, t
            best.append(top)
            count.append(tokens)
        out.append(count[-1])
        before = word
    return out


def _count(pieces_shared):
    def run(batches):
        pieces = pieces_shared.value
        for b in batches:
            n_words, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            texts: dict[int, str] = {}
            parts = []
            for first, end, data, offs in text_chunks(b.column("text")):
                h, rows, s, e = words(data, offs, fold=False)
                each, at, back = np.unique(h, return_index=True, return_inverse=True)
                raw = data.tobytes()
                for k, i in zip(each.tolist(), at.tolist()):
                    if k not in texts:
                        texts[k] = raw[s[i]:e[i]].decode("utf-8", "surrogatepass")
                parts.append((first, end, each, back, rows))
            keys = sorted(texts, key=texts.get)
            found = dict(zip(keys, trie_counts((MARK + texts[k] for k in keys), pieces)))
            for first, end, each, back, rows in parts:
                if len(rows):
                    n = np.array([found[k] for k in each.tolist()], np.int64)[back]
                    n_words[first:end] = np.bincount(rows, minlength=end - first)
                    n_tokens[first:end] = np.bincount(rows, n, end - first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])
    return run


def token_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of `docs` (doc_id, text). Null, empty and blank texts have none of either.

    Repeated rows are kept, other columns ignored. A character without a piece counts its UTF-8 bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    return docs.select("doc_id", "text").mapInArrow(_count(shared), "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), load_pieces())
