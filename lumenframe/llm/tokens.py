"""Encoding with a public byte-level BPE vocabulary by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can be the last token of the prefix's
encoding. The table of those last tokens is filled from left to right: a token ending at the
prefix is the one if the pair (last token of what stands before it, token) is itself the encoding of
the two tokens' joined bytes. The encoding is read backwards from the table. A prefix of the
table is the table of the prefix, so appending bytes continues it exactly, and after an edit only the
pieces around it are filled again.

The vocabulary's pattern first parts the text into pieces, which the merges never cross. Workers
keep the encodings of short pieces in a bounded memo; the vocabulary file is a parameter.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that comes with the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES = 400_000
MEMO_LENGTH = 64


def default_vocabulary() -> str:
    """Path of byte_bpe_50k: the variable PUBLIC_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


class PrefixTable:
    """The last token of every byte prefix of a text, piece by piece; ids() reads the encoding."""

    def __init__(self, encoder: "PrefixEncoder", text: str = ""):
        self.encoder, self.text = encoder, ""
        self.pieces: list[str] = []
        self.tables: list[list[int]] = []
        self.append(text)

    def _fill(self, pieces: list[str]) -> None:
        self.pieces += pieces
        self.tables += [self.encoder.last_tokens(p.encode("utf-8")) for p in pieces]

    def append(self, more: str) -> "PrefixTable":
        """Continue with ``more``: pieces that could change at the seam are parted again, and a grown piece continues its table."""
        self.text += more
        old: list[tuple[str, list[int]]] = []
        # a piece ends where the next one begins; only the last run of pieces can be parted otherwise once text follows
        while self.pieces and len(old) < 3:
            old.append((self.pieces.pop(), self.tables.pop()))
        seam = sum(len(p) for p in self.pieces)
        for piece in self.encoder.pattern.findall(self.text, seam):
            data, start = piece.encode("utf-8"), []
            for p, t in old:
                if piece.startswith(p):
                    start = t
                    break
            self.pieces.append(piece)
            self.tables.append(self.encoder.last_tokens(data, start))
        return self

    def edit(self, at: int, removed: int, inserted: str) -> "PrefixTable":
        """Replace ``removed`` characters at ``at``; pieces well before and after it keep their tables."""
        new = self.text[:at] + inserted + self.text[at + removed :]
        shift = len(inserted) - removed
        starts = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])]).astype(int)
        first = max(0, int(np.searchsorted(starts, at, "right")) - 1 - 3)
        known = {int(s) + shift: i for i, s in enumerate(starts[:-1]) if s > at + removed}
        pieces, tables = self.pieces[:first], self.tables[:first]
        pos = int(starts[first])
        while pos < len(new):
            piece = self.encoder.pattern.match(new, pos).group()
            i = known.get(pos)
            if i is not None and self.pieces[i] == piece:  # parted as before from here on
                pieces += self.pieces[i:]
                tables += self.tables[i:]
                break
            pieces.append(piece)
            tables.append(self.encoder.last_tokens(piece.encode("utf-8")))
            pos += len(piece)
        self.text, self.pieces, self.tables = new, pieces, tables
        return self

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.encoder.read_back(table)]


class PrefixEncoder:
    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.lengths = {i: len(b) for b, i in self.ranks.items()}
        self.pattern = regex.compile(PIECES)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.endings = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.endings.add_word(b.decode("latin-1"), (i, len(b)))
        self.endings.make_automaton()

    def _merged(self, data: bytes) -> list[int]:
        """Encoding of a few bytes by applying the merges in order of rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, joined, are encoded as just these two."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[(left, right)] = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    @lru_cache(maxsize=None)  # at most one entry for each token
    def stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        return self._merged(self.bytes_of[token]) == [token]

    def last_tokens(self, data: bytes, start: list[int] = ()) -> list[int]:
        """The last token of each prefix of ``data``; ``start`` is the table of a prefix of it."""
        table = list(start)
        done = len(table)
        ending: list[tuple[int, int]] = []
        at = done
        # no token is longer than 128 bytes, so matches that end beyond the start begin within them
        base = max(0, done - 128)

        def settle(end: int) -> None:
            for token, length in ending:
                before = end - length
                if self.fits(table[before - 1], token) if before else self.stands(token):
                    table.append(token)
                    return
            raise ValueError("the vocabulary cannot encode these bytes")

        for end, (token, length) in self.endings.iter(data[base:].decode("latin-1")):
            end += base
            if end < done or end - length + 1 < 0:
                continue
            if end != at:
                settle(at + 1)
                at, ending = end, []
            ending.append((token, length))
        if ending:
            settle(at + 1)
        return table

    def read_back(self, table: list[int]) -> list[int]:
        out, at = [], len(table)
        while at:
            t = table[at - 1]
            out.append(t)
            at -= self.lengths[t]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for piece in self.pattern.findall(text):
            got = memo.get(piece)
            if got is None:
                got = tuple(self.read_back(self.last_tokens(piece.encode("utf-8", "surrogatepass"))))
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = got
            ids += got
        return ids

    def count(self, text: str) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    return PrefixEncoder(path)


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without special tokens.

    An empty and a null text give an empty list; text that spells a special token is ordinary
    text. Every row of the input gives one row; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [enc.encode(t) if t else [] for t in pdf["text"]]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def encode_appended(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_before, ids): each text's table continued by a line break and the title, with the number of ids before.

    The ids equal those of the joined text. Null texts and titles count as empty.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            rows = []
            for d, text, title in zip(pdf["doc_id"], pdf["text"], pdf["title"]):
                table = PrefixTable(enc, text or "")
                before = len(table.ids())
                rows.append((d, before, table.append("\n" + (title or "")).ids()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_before", "ids"])

    return docs.select("doc_id", "text", "title").mapInPandas(run, "doc_id bigint, n_before int, ids array<int>")
