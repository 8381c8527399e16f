"""Operator 9: token counts at every prefix of a text, for byte-level BPE vocabularies; and the encoder that packing uses.

Prefix dynamic programming. Inside one piece of the pre-tokenizer, the last token of every prefix is unique: a token t
ending at byte i is the last one if it and the last token of the prefix before it stand next to each other in the
encoding of their concatenation. So count[i] = count[i - len(t)] + 1, and the table of a piece gives the exact count of
each of its prefixes. A text's table is that of its pieces, added up; truncation and budgets are look-ups in it.

A plain text is taken apart at its spaces: no piece of the pre-tokenizer crosses such a place, so that the parts can be
tabulated once and met again from a bounded cache. Texts for which this isn't known to hold (spaces after white space,
control characters or scripts outside the listed ranges, special strings) are cut into pieces by the library's own
pre-tokenizer, between special strings, and their pieces are tabulated in the same way. So every count comes from the
tables, and a table takes time in proportion to its text.

Defined results: a null text is empty and has 0 tokens; an empty table gives an empty result; one row comes out for each
row in; nothing is shuffled; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shipped

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of a cache, each of a key of at most LONG bytes or characters; with as many, a cache is emptied.
CACHE = 200_000
#: Longer pieces, in bytes, are tabulated on their own.
LONG = 64
NEVER = 1 << 60
#: The characters with the Unicode property White_Space, which the pre-tokenizer goes by.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Characters whose classes are the same in every Unicode version that a tokenizer may know.
_ODD = re.compile("[^\u0000-\u001b -ɏͰ-ͷЀ-ӿ‐-‧ぁ-ゖァ-ヺ一-龥]")
_SPACE_AFTER_SPACE = re.compile(r"\s ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """A byte-level BPE vocabulary with its merges, and bounded caches of what was worked out."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        word = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {word(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(word(a), word(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.library = Tokenizer.from_file(path)
        self.made_of = {a + b: (a, b, i) for (a, b), i in self.merges.items()}
        self._spines: tuple[dict, dict] = ({}, {})
        self._states: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._tables: dict[str, tuple[int, ...]] = {}
        self._spaced: dict[str, int] = {}  # of the last entries of tables, by the part without its leading space
        self._coded: dict[str, bytes] = {}
        self._fast = None
        #: tiktoken takes ids for merge ranks; where a vocabulary's ids don't follow its merges, only the library encodes.
        self.ranked = all(self.ids.get(a + b, -1) < self.ids.get(c + d, -2) for (a, b), (c, d) in itertools.pairwise(self.merges))
        self._special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")" if self.special else "(?!)()")
        self._bytes = {ord(c): chr(b) for c, b in letters.items()}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge (0: left, 1: right) of a token while it is put together, and the merge that ends each."""
        known = self._spines[side].get(token)
        if known is None:
            known, end = [], NEVER
            while True:
                known.append((token, end))
                if token not in self.made_of:
                    break
                left, right, end = self.made_of[token]
                token = right if side else left
            self._spines[side][known[0][0]] = known
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a: while both are put together, no merge across their border comes first.

        Of two merges of the same rank the left one comes first. With a empty: b is a token, which always stands alone."""
        if not a:
            return True
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            across = ((self.merges.get((x, y), NEVER), x_end, y_end) for x, x_end in self._spine(a, 1) for y, y_end in self._spine(b, 0))
            known = self._fits[a, b] = not any(m < x_end and m <= y_end and m < NEVER for m, x_end, y_end in across)
        return known

    def last_of(self, data: bytes) -> tuple[int, bytes]:
        """The number of tokens of a piece and its last one; the states of its prefixes are kept and shared by all pieces."""
        states = self._states
        if data in states:
            return states[data]
        if len(data) > LONG:
            return self.byte_table(data)[-1], b""
        if len(states) >= CACHE:
            states.clear()
            states[b""] = (0, b"")
        i = len(data) - 1
        while data[:i] not in states:
            i -= 1
        ids, longest = self.ids, self.longest
        for end in range(i + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                t = data[start:end]
                if t in ids:
                    n, before = states[data[:start]]
                    if self.fits(before, t):
                        states[data[:end]] = (n + 1, t)
                        break
        return states[data]

    def byte_table(self, data: bytes) -> list[int]:
        """The number of tokens of every prefix of a single piece: entry i is that of the first i bytes."""
        count, last = [0], [b""]
        for i in range(1, len(data) + 1):
            for start in range(max(0, i - self.longest), i):
                t = data[start:i]
                if t in self.ids and self.fits(last[start], t):
                    break
            count.append(count[start] + 1)
            last.append(t)
        return count

    def table(self, part: str) -> tuple[int, ...]:
        """The number of tokens of every prefix of a part, from 0 characters to all; cached."""
        known = self._tables.get(part)
        if known is not None:
            return known
        out = tuple(self._table_of(self.pieces(part)))
        if len(part) <= LONG:
            if len(self._tables) >= CACHE:
                self._tables.clear()
            self._tables[part] = out
        return out

    def _table_of(self, pieces: list[str]) -> list[int]:
        """The number of tokens of every prefix of the text that the pieces make up."""
        out, done, blank = [0], 0, ""
        for piece in pieces:
            if WHITE.issuperset(piece):  # a prefix that ends in white space has all of it in one piece
                blank += piece
                ends = self._by_character(blank)[len(blank) - len(piece) + 1 :]
                base = done - (self.byte_table(blank[: -len(piece)].encode())[-1] if len(blank) > len(piece) else 0)
                out += [base + n for n in ends]
                done += self.byte_table(piece.encode())[-1]
                continue
            ends = self._by_character(piece)[1:]
            if blank and piece[0] == " ":  # its space alone still belongs to the white space before
                before = self.byte_table(blank.encode())[-1]
                ends[0] = self.byte_table((blank + " ").encode())[-1] - before
            if piece[0] == "'" and len(piece) == 3:  # half a contraction is two pieces
                ends[1] = 2
            out += [done + n for n in ends]
            done += self._by_character(piece)[-1]
            blank = ""
        return out

    def cut(self, text: str) -> list[str]:
        """The pieces of any text without special strings, as the library's pre-tokenizer cuts it."""
        return [p.translate(self._bytes).encode("latin-1").decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _by_character(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        count = self.byte_table(data)
        if len(data) == len(piece):
            return count
        return [0] + [count[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]

    def plain(self, text: str) -> bool:
        """Whether the text may be taken apart at its spaces."""
        return not (any(s in text for s in self.special) or _ODD.search(text) or ("  " in text or "\n " in text) or _SPACE_AFTER_SPACE.search(text))

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text, taken apart before every space. A text that starts with a space has an empty first part."""
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def total(self, part: str) -> int:
        """The last entry of the part's table."""
        return sum(self.last_of(piece.encode("utf-8"))[0] for piece in self.pieces(part))

    def count(self, text: str) -> int:
        """The number of tokens of the whole text."""
        if not text:
            return 0
        if not self.plain(text):
            between = self._special.split(text)  # special strings stand at odd places
            return len(between) // 2 + sum(self.last_of(piece.encode("utf-8"))[0] for part in between[::2] for piece in self.cut(part))
        first, *rest = text.split(" ")
        n = self.total(first) if first else 0
        known = self._spaced
        try:
            return n + sum(map(known.__getitem__, rest))
        except KeyError:  # a part that wasn't met yet
            if len(known) >= CACHE:
                known.clear()
            for x in rest:
                if x in known:
                    n += known[x]
                    continue
                own = sum(self.last_of(piece.encode("utf-8"))[0] for piece in self.pieces(" " + x))
                n += own
                if len(x) <= LONG:
                    known[x] = own
            return n

    def prefix_counts(self, text: str) -> np.ndarray:
        """The number of tokens of every prefix of the text: entry i is that of the first i characters."""
        if not self.plain(text):
            return self._any_prefix_counts(text)
        out, done = [np.zeros(1, np.int32)], 0
        for part in self.parts(text):
            t = np.array(self.table(part), np.int32)
            out.append(t[1:] + done)
            done += int(t[-1])
        return np.concatenate(out)

    def _any_prefix_counts(self, text: str) -> np.ndarray:
        """The same for texts that aren't plain. A prefix that ends inside a special string has its start as ordinary text."""
        out, done = [0], 0
        between = self._special.split(text)
        for at, part in enumerate(between):
            if at % 2 == 0:
                pieces = self.cut(part)
                out += [done + n for n in self._table_of(pieces)[1:]]
                settled, tail = out[-1], "".join(pieces[-3:])  # what follows can change the last pieces only
                settled -= sum(self.byte_table(p.encode("utf-8"))[-1] for p in pieces[-3:])
                done = out[-1]
                continue
            for i in range(1, len(part)):
                out.append(settled + sum(self.byte_table(p.encode("utf-8"))[-1] for p in self.cut(tail + part[:i])))
            done += 1
            out.append(done)
        return np.array(out, np.int32)

    def encode(self, text: str) -> bytes:
        """The ids of the text, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.ranked or not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self._fast is None:
            import public_tokenizers
            import tiktoken

            self._fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ids, special_tokens={}).encode_ordinary
        first, *rest = text.split(" ")
        coded = self._coded
        head = np.array(self._fast(first), "<u4").tobytes() if first else b""
        try:
            return head + b"".join(map(coded.__getitem__, rest))
        except KeyError:
            if len(coded) >= CACHE:
                coded.clear()
            out = [head]
            for x in rest:
                own = coded.get(x)
                if own is None:
                    own = np.array(self._fast(" " + x), "<u4").tobytes()
                    if len(x) <= LONG:
                        coded[x] = own
                out.append(own)
            return b"".join(out)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path, once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, text: int, limit: int = 8 << 20):
    """(rows, texts) of a batch in runs of about limit bytes, so that very long texts never meet in numbers."""
    col = batch.column(text)
    sizes = np.maximum(np.asarray(pc.fill_null(pc.binary_length(col), 0)), 1)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(at, to - at)
        yield part, ["" if x is None else x for x in part.column(text).to_pylist()]
        at = to


def count_tokens(docs: DataFrame, path: str | None = None, prefixes: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens and, with prefixes, counts: the packed int32 table of all prefixes."""
    path = path or vocabulary_path()
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shipped(docs.sparkSession)
    names = ["doc_id", "n_bytes", "n_tokens"] + ["counts"] * prefixes
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                cols = [part.column(0), pa.array([len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], pa.int64())]
                if prefixes:
                    tables = [v.prefix_counts(t) for t in texts]
                    cols += [pa.array([int(t[-1]) for t in tables], pa.int64()), pa.array([t.astype("<i4").tobytes() for t in tables], pa.binary())]
                else:
                    cols.append(pa.array([v.count(t) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long" + ", counts binary" * prefixes)


def longest_prefix(counts: bytes, budget: int) -> int:
    """The most characters of a text that cost at most budget tokens, from its stored table."""
    return int(np.flatnonzero(np.frombuffer(counts, "<i4") <= budget)[-1])


def op9(spark, sf_dir):
    from tessera.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
