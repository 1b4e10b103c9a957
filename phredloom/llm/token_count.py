"""Token counts by a linear longest-match automaton.

A vocabulary trie gets failure links and, for each node, the number of tokens
popped when that link is followed, both computed once on the driver. A word is
then counted in one pass over its characters: no pieces are built and nothing
is scanned twice. The result equals greedy longest-match word-piece splitting.

A text is cut into words (runs of word characters, or one other visible
character each); each word is matched with a leading word mark, which only
pieces at a word's start carry. A word that the vocabulary cannot spell counts
as one unknown token. Counts of repeated words are remembered per task, in a
table of bounded size.

Defined results: null and empty texts have 0 tokens; a null doc_id is kept as
null; a very long text or word is one pass over its characters; repeated rows
are counted each for itself; other columns, whatever their names, are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from phredloom.llm.common import documents

MARK = "▁"
_WORD = re.compile(r"\w+|[^\w\s]")
_REMEMBER = 500_000


class Automaton:
    """Failure-link trie over marked (word-start) and unmarked (continuation) pieces."""

    START, REST = 0, 1

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for piece in pieces:
            if not piece or MARK in piece[1:]:
                continue
            at = self.START if piece[0] == MARK else self.REST
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = to
            final[at] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [self.START, self.REST]
        for u in queue:
            for c, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = self.REST, 1
                    continue
                z, pops = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    pops += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], pops

    def count(self, word: str) -> int:
        """Number of pieces of ``word``; -1 if it cannot be spelled."""
        at, n, step, fail, popped = self.START, 0, self.next, self.fail, self.popped
        for c in MARK + word:
            while (to := step[at].get(c)) is None:
                if fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = to
        while at != self.REST:
            if fail[at] < 0:
                return -1
            n += popped[at]
            at = fail[at]
        return n


def greedy_count(word: str, pieces: set[str]) -> int:
    """The defining rule, for tests: take the longest piece that fits, again and again."""
    rest, n = MARK + word, 0
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not size:
            return -1
        rest, n = rest[size:], n + 1
    return n


def piece_vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` of every text."""
    machine = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))  # of the vocabulary's size, not the data's

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, known = machine.value.count, {}
        for b in batches:
            rows = []
            for text in b["text"]:
                words = _WORD.findall(text)
                for w in [x for x in set(words) if x not in known]:
                    known[w] = count(w)
                sizes = list(map(known.__getitem__, words))
                bad = sizes.count(-1)
                rows.append((len(words), sum(sizes) + 2 * bad, bad))
                if len(known) > _REMEMBER:
                    known.clear()
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    rows = documents(docs).selectExpr("cast(doc_id as string) doc_id", "text")
    return rows.mapInPandas(run, "doc_id string, n_words long, n_tokens long, n_unknown long").selectExpr("cast(doc_id as long) doc_id", "n_words", "n_tokens", "n_unknown")
