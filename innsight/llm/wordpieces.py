"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one
for pieces that continue it. Each node knows where to go when no child fits (its
failure link) and how many pieces are complete by then (its popped count), both
computed once, level by level. A word is then read once, character by character,
and its number of greedy longest-match pieces is a sum of popped counts: no piece
is ever built. A word that cannot be covered is one unknown piece.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from innsight.llm.arrow import field, with_text_columns

SPACE = "▁"
REMEMBERED = 200_000  # words per task
SHORT = 60
NONE = -1
START, REST = 0, 1


class LongestMatch:
    def __init__(self, first: set[str], rest: set[str]):
        """``first``: pieces that begin a word; ``rest``: pieces that continue one."""
        self.children: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((START, first), (REST, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.children[node].get(c)
                    if child is None:
                        child = self.children[node][c] = len(self.children)
                        self.children.append({})
                        whole.append(False)
                    node = child
                whole[node] = whole[node] or bool(piece)
        self.link = [NONE] * len(self.children)
        self.popped = [0] * len(self.children)
        level = deque((root, c, node) for root in (START, REST) for c, node in self.children[root].items())
        while level:
            parent, c, node = level.popleft()
            if whole[node]:
                self.link[node], self.popped[node] = REST, 1
            else:
                at, popped = self.link[parent], self.popped[parent]
                while at != NONE and c not in self.children[at]:
                    popped += self.popped[at]
                    at = self.link[at]
                if at != NONE:
                    self.link[node], self.popped[node] = self.children[at][c], popped
            level.extend((node, d, child) for d, child in self.children[node].items())

    def length(self, word: str) -> int:
        """Pieces of one word; 1 if some part of it is in no piece, 0 if it is empty."""
        if not word:
            return 0
        node, count = START, 0
        children, link, popped = self.children, self.link, self.popped
        for c in word:
            while c not in children[node]:
                count += popped[node]
                node = link[node]
                if node == NONE:
                    return 1
            node = children[node][c]
        while node != REST:
            count += popped[node]
            node = link[node]
            if node == NONE:
                return 1
        return count


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """The automaton of a sentencepiece vocabulary: pieces with the space mark begin
    a word, the others continue it."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    first, rest = set(), set()
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        if piece.startswith(SPACE):
            first.add(piece[1:])
        else:
            rest.add(piece)
    return LongestMatch(first - {""}, rest)


def count_tokens(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with n_words and n_tokens (greedy word pieces of the whole text);
    columns of these names are replaced.

    Words are cut at ASCII white space. Null and empty texts have neither; every
    row stays. ``model`` is a path that every executor can open.
    """

    def make():
        length = automaton(model).length
        known: dict[bytes, int] = {}

        def work(texts):
            words_in, tokens_in = [], []
            for value in texts:
                words = (value or "").encode().split()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = length(word.decode())
                        if len(word) <= SHORT:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = n
                    total += n
                words_in.append(len(words))
                tokens_in.append(total)
            return [words_in, tokens_in]

        return work

    return with_text_columns(
        docs, text, [field("n_words", T.LongType()), field("n_tokens", T.LongType())], make
    )
