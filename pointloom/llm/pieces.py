"""SentencePiece encoding and decoding by prefix tables.

A merge-type model encodes a text as the only token sequence whose every adjacent pair is
compatible, that is, is the encoding of its own joined text.  So the last token of each
prefix's encoding is unique: of the tokens that an Aho-Corasick automaton finds to end at a
place, it is the one that is compatible with the last token of the prefix before it.  One
pass stores that token for every prefix, and walking back from the end recovers the ids.

Whether two tokens are compatible follows from how each was merged: along the right edge of
the left token and the left edge of the right token, in order of merging, no merge across
the border may come first.  Answers are remembered for pairs, up to ``PAIRS`` of them.

Texts are cut before each run of blanks, where no token crosses, and ids of short pieces are
remembered up to ``REMEMBERED`` bytes a worker; both only save work.  Characters that are
not in the model become the ids of their bytes, or the unknown id.

Each row is encoded by itself: repeated rows and ids do not matter, a null text is empty, an
empty text has no ids, an empty table gives an empty one, and columns other than doc_id and
text are not read.  Texts are taken whole; work and room grow in proportion to their length,
with or without blanks.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a blank in pieces (fixed value).
BLANK = "▁"
#: Pairs whose compatibility a worker remembers.
PAIRS = 1_000_000
#: Characters of a piece that is remembered, and bytes of all such pieces a worker.
SHORT, REMEMBERED = 48, 128 << 20
#: Ids in an output batch, at least.
BATCH_IDS = 1_000_000


class Model:
    """The tables of one model file; ``encode`` gives the ids of the sentencepiece library."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = lib.get_piece_size()
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(size)]
        self.piece = [lib.id_to_piece(i) for i in range(size)]
        self.id_of = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.rank = [-lib.get_score(i) for i in range(size)]
        self.unknown = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_byte = all(lib.is_byte(i) for i in self.bytes)
        self._check(lib)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self._merged(piece) == [piece]:  # one that merging never makes is no token of any text
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.edges: tuple[dict, dict] = {}, {}
        self.pairs: dict[int, bool] = {}
        #: Characters next to each other in some piece: no token crosses the border of any other two.
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        # No token crosses a line feed that is in no piece.
        apart = self.by_byte and not any("\n" in p for p in self.id_of)
        self.words = _Words(self, BLANK, _Words(self, "\n") if apart else None)

    def _check(self, lib) -> None:
        probe = "Ａ ﬁ  é▁x "
        if lib.decode(lib.encode(probe)) != probe.replace(BLANK, " ") or any(lib.is_unused(i) for i in self.id_of.values()):
            raise ValueError("only models that keep texts as they are and use all pieces are supported")
        if any(BLANK in p.lstrip(BLANK) or not all(c in self.id_of for c in p) for p in self.id_of):
            raise ValueError("pieces must have blanks in front only and be made of single-character pieces")

    def _merged(self, text: str, spans: bool = False) -> list[str]:
        """``text`` merged step by step, best pair first, leftmost of equals; used for single pieces only."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank[self.id_of[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.id_of]
            if not ranked or spans and len(parts) == 2:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens at one edge of ``token`` while it was merged, first to last; side 0 is left."""
        known = self.edges[side].get(token)
        if known is None:
            text = self.piece[token]
            part = self.id_of[self._merged(text, spans=True)[-side]] if len(text) > 1 else token
            known = self.edges[side][token] = [token] if part == token else [*self._edge(part, side), token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' joined text is these two tokens."""
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stays_apart(self._edge(left, 1), self._edge(right, 0))
        return known

    def _stays_apart(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        none = float("inf")
        while True:
            own = self.rank[left[i + 1]] if i + 1 < len(left) else none
            other = self.rank[right[j + 1]] if j + 1 < len(right) else none
            across = self.id_of.get(self.piece[left[i]] + self.piece[right[j]])
            # Of equal ranks the leftmost goes first: left's own merge, then the border, then right's.
            if across is not None and self.rank[across] < own and self.rank[across] <= other:
                return False
            if own is none and other is none:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def prefix_ids(self, text: str) -> list[int]:
        """Ids of ``text``, in which blanks are already ``BLANK``, from its prefix table."""
        n = len(text)
        table = [-1] * (n + 1)  # by last character, the last token; -1: a character outside the model, and the empty prefix (at the end)
        found = -1  # the place whose token is known
        pairs, compatible, many = self.pairs, self.compatible, self.size
        for end, (length, token) in self.automaton.iter(text):
            if end == found:
                continue
            before = table[end - length]
            if before >= 0:
                good = pairs.get(before * many + token)
                if good is None:
                    good = compatible(before, token)
                if not good:
                    continue
            table[end] = token
            found = end
        out, at = [], n - 1
        while at >= 0:
            token = table[at]
            if token < 0:
                out += [self.bytes[b] for b in reversed(text[at].encode())] if self.by_byte else [self.unknown]
                at -= 1
            else:
                out.append(token)
                at -= len(self.piece[token])
        if not self.by_byte:  # neighbouring unknown characters are one
            out = [t for k, t in enumerate(out) if t != self.unknown or not k or out[k - 1] != self.unknown]
        return out[::-1]

    def single(self, character: str) -> tuple[int, ...]:
        """Ids of a character that stands apart."""
        token = self.id_of.get(character)
        return tuple([self.bytes[b] for b in character.encode()] if token is None else [token])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, " ")
        words = text.split(" ")
        if "" in words:  # runs of blanks belong to the word behind them
            joined, run = [], 0
            for w in words[:-1]:
                if w:
                    joined.append(" " * run + w)
                    run = 0
                else:
                    run += 1
            words = [*joined, " " * run + words[-1]]
        found = self.words
        return list(chain.from_iterable([found[w] for w in words]))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


class _Words(dict):
    """Ids of a word and of ``front`` before it; short words are remembered, in bounded room.

    Words not met while half the room was filled are forgotten.  ``lines``, if given, takes
    what follows a line feed within a word.
    """

    def __init__(self, model: Model, front: str, lines: _Words | None = None):
        self.model, self.front, self.lines, self.room, self.old = model, front, lines, REMEMBERED // 2, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if self.lines is not None and "\n" in word:
            first, *rest = word.split("\n")
            return self[first] + tuple(chain.from_iterable([self.lines[x] for x in rest]))
        ids = self.old.get(word)
        if ids is None and 1 < len(word) <= SHORT and word[-2:] not in self.model.inside and " " not in word[-2:] and self.model.by_byte:
            ids = self[word[:-1]] + self.model.single(word[-1])
        elif ids is None:
            ids = tuple(self.model.prefix_ids(self.front + word.replace(" ", BLANK)))
        if len(word) <= SHORT:
            self.room -= 200 + 4 * len(word) + 8 * len(ids)
            if self.room < 0:
                self.old = dict(self)
                self.clear()
                self.room = REMEMBERED // 2
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _coded(path: str):
    def run(batches):
        own = model(path)

        def rows(docs, ids, texts):
            offsets = [0]
            for one in ids:
                offsets.append(offsets[-1] + len(one))
            flat = pa.array(chain.from_iterable(ids), pa.int32(), size=offsets[-1])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            docs, ids, texts, room = [], [], [], BATCH_IDS
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = own.encode(text.as_py())
                docs.append(doc)
                ids.append(one)
                texts += own.decode([one])
                room -= len(one)
                if room < 0:
                    yield rows(docs, ids, texts)
                    docs, ids, texts, room = [], [], [], BATCH_IDS
            if docs:
                yield rows(docs, ids, texts)

    return run


def code(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the ids of the model file at ``path`` and their decoded text.

    Every executor reads the file at that path.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_coded(path), "doc_id long, ids array<int>, decoded string")
