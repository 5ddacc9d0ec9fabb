"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one for each character; an agenda holds the adjacent
pairs that are pieces, best score first and leftmost among equals. The best pair
is joined and its new neighbours enter the agenda until none is left. Characters
that are no piece become their UTF-8 bytes.

No piece of the vocabulary has the space mark behind another character, so no
merge crosses such a place, nor one between a word and a mark that no piece holds
together. The agenda runs on each stretch between such places; short stretches are
remembered. A vocabulary without that property runs on whole
texts.

The ids are the agenda's. The sentencepiece library encodes each new stretch as well, an
Arrow batch in one call, and decodes every text; ``agrees`` tells whether both gave the
same for all of a text. A model whose pieces were not learned by merging, or whose
normaliser changes a text, would show there.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from functools import lru_cache
from itertools import chain

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from innsight.llm.arrow import field, with_text_columns

codecs.register_error("mark_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))

SPACE = "▁"
MARKS = ("\n", ",", ".")
#: Stretches remembered by a worker, twice: the last ones used and those before.
REMEMBERED = 250_000
LONG = 60  # longer ones are not remembered
LISTED = 24  # characters
AT_ONCE = 1 << 20  # bytes of text whose ids a task holds as numbers
NEVER = 1 << 29  # no rank


class Vocabulary:
    """Pieces, scores and bytes of a model, read through the library."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.byte_ids = [sp.unk_id()] * 256
        self.raw: list[bytes] = []
        self.is_byte = [sp.is_byte(i) for i in range(size)]
        for i, name in enumerate(self.names):
            if self.is_byte[i]:
                value = int(name[1:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.ids[name] = i
                scores[name] = sp.get_score(i)
                self.raw.append(name.replace(SPACE, " ").encode())
        order = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {name: order[score] for name, score in scores.items()}
        self.apart = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        # A mark is cut from what is before it where no piece holds both. Irregular are
        # texts in which that fails somewhere, a space or line end behind which no
        # word follows, and the space mark itself.
        before = {m: {x[i - 1] for x in self.ids for i in range(1, len(x)) if x[i] == m} for m in MARKS}
        free = [c for c in "aeionrst" if not any(c in x for x in before.values())]
        self.letter = free[0] if free else ""
        self.marks = MARKS if self.apart and self.letter and not before["\n"] else ()
        held = "|".join(
            f"[{re.escape(''.join(sorted(x - {SPACE})))}]{re.escape(m)}"
            for m, x in before.items()
            if x - {SPACE}
        )
        ends = re.escape("".join(MARKS))
        self.irregular = re.compile(f"^[ {ends}]|[ ](?=[ {ends}]|$)|{SPACE}" + (held and "|" + held))
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.lone = self.merge(SPACE)
        self.letter_ids = self.merge(SPACE + self.letter)
        self.disputed: set[str] = set()
        # ids as bytes, a sixth of the memory of lists of numbers
        self.code = "H" if size <= 1 << 16 else "I"
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a stretch by the agenda: a plain list of the pairs' ranks, searched
        for the best and leftmost, where that is short, and a heap beyond."""
        symbols = self._merged_by_list(text) if len(text) <= LISTED else self._merged(text)
        ids: list[int] = []
        for symbol in symbols:
            found = self.ids.get(symbol)
            if found is not None:
                ids.append(found)
            else:
                ids.extend([self.byte_ids[b] for b in symbol.encode()])
        return ids

    def _merged_by_list(self, text: str) -> list[str]:
        symbols, rank = list(text), self.ranks.get
        agenda = [rank(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i] = both = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + both, NEVER)
            if i < len(agenda):
                agenda[i] = rank(both + symbols[i + 1], NEVER)
        return symbols

    def _merged(self, text: str) -> list[str]:
        """By a heap.

        An entry is the rank of a pair's score and the place of its left symbol, in
        one number. It is stale, and skipped, when the pair that now stands there
        has another rank.
        """
        symbols = list(text)
        n = len(symbols)
        rank = self.ranks.get
        agenda = []
        for i in range(n - 1):
            found = rank(text[i : i + 2])
            if found is not None:
                agenda.append(found << 32 | i)
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            own = symbols[left]
            if right >= n or not own:
                continue
            both = own + symbols[right]
            if rank(both) != entry >> 32:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
                found = rank(both + symbols[follower])
                if found is not None:
                    heapq.heappush(agenda, found << 32 | left)
            leader = before[left]
            if leader >= 0:
                found = rank(symbols[leader] + both)
                if found is not None:
                    heapq.heappush(agenda, found << 32 | leader)
        return [x for x in symbols if x]

    def stretches_of(self, text: str) -> list[str]:
        """Parts of a text that no merge connects. Those of a regular text, which has
        single spaces only, come without the space before them."""
        if not text:
            return []
        if self.marks and not self.irregular.search(text):
            for mark in self.marks:
                text = text.replace(mark, " " + mark)
            return text.split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        return self.stretches.findall(marked) if self.apart else [marked]

    def learn(self, stretches: list[str]) -> None:
        """Runs the agenda on stretches and checks all of them with the library."""
        bare = {SPACE, *self.marks}
        marked = [x if x[0] in bare else SPACE + x for x in stretches]
        # the library puts a space mark before its input; behind the letter no piece
        # holds what precedes a mark
        asked = [x[1:] if x[0] == SPACE else self.letter + x for x in marked]
        for key, whole, answer in zip(stretches, marked, self.library.encode(asked)):
            made = self.merge(whole)
            if whole[0] != SPACE:
                answer = answer[len(self.letter_ids) :]
            elif len(whole) == 1:
                answer = self.lone
            if made != answer:
                self.disputed.add(key)
            self.recent[key] = array(self.code, made).tobytes()

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each text, and whether agenda and library agree on them."""
        if len(self.recent) >= REMEMBERED:
            self.older, self.recent = self.recent, {}
        cut = list(map(self.stretches_of, texts))
        recent, older, new = self.recent, self.older, []
        for key in {x for x in chain.from_iterable(cut) if x not in recent}:
            found = older.get(key)
            if found is None:
                new.append(key)
            else:
                recent[key] = found
        self.learn(new)
        out = []
        for stretches in cut:
            ids = array(self.code)
            ids.frombytes(b"".join(map(recent.__getitem__, stretches)))
            out.append((ids.tolist(), not self.disputed or self.disputed.isdisjoint(stretches)))
        for key in new:
            if len(key) > LONG:
                recent.pop(key, None)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0][0]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space put before the first piece. A run
        of byte pieces that is no UTF-8 gives one mark for each broken byte."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="mark_each_byte")
        first = next((i for i in ids if self.raw[i]), None)
        if first is not None and self.names[first].startswith(SPACE):
            return text[1:]
        return text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(
    docs: DataFrame, model: str, text: str = "text", with_ids: bool = True
) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, agrees and, if asked for,
    ids and decoded; columns of these names are replaced.

    Null and empty texts have no ids and decode to the empty text. Every row stays
    and repeated rows get equal answers. ``model`` is a path that every executor
    can open.
    """
    fields = [
        field("n_tokens", T.LongType()),
        field("ids_sha256", T.StringType()),
        field("decoded_sha256", T.StringType()),
        field("agrees", T.BooleanType()),
    ]
    if with_ids:
        fields += [
            field("ids", T.ArrayType(T.IntegerType(), False)),
            field("decoded", T.StringType()),
        ]

    def make():
        v = vocabulary(model)
        digits = [str(i) for i in range(len(v.names))]

        def work(texts):
            counts, id_hashes, text_hashes, agrees, all_ids, all_texts = [], [], [], [], [], []
            encoded = v.encode_all([value or "" for value in texts])
            backs = v.library.decode([ids for ids, _ in encoded])
            for (ids, agreed), back in zip(encoded, backs):
                decoded = v.decode(ids)
                counts.append(len(ids))
                joined = ",".join([digits[i] for i in ids])
                id_hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hashes.append(hashlib.sha256(back.encode()).hexdigest())
                agrees.append(agreed and decoded == back)
                if with_ids:
                    all_ids.append(ids)
                    all_texts.append(back)
            made = [counts, id_hashes, text_hashes, agrees]
            return made + [all_ids, all_texts] if with_ids else made

        return work

    def end():
        # idle workers stay for a while, and there may be more of them than cores
        vocabulary(model).older = {}

    return with_text_columns(docs, text, fields, make, limit=AT_ONCE, end=end)
