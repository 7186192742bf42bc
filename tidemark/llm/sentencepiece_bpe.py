"""SentencePiece (merge type) encoding and decoding with a prefix table.

For every prefix of a text the table holds the last token of that prefix's
encoding. It is unique: a token sequence is the encoding of its text exactly if
every two neighbours are the encoding of theirs, since merges inside two
neighbouring tokens run in the same order whatever stands around them, and the
first merge across a boundary is decided by the two tokens beside it. So a
token that ends at position e, found by the vocabulary's automaton, is the
prefix's last one if the token before it, in the table at its start, is
compatible with it. The ids are then read backwards from the end.

Compatibility is decided once per pair by merging the pair's text. A text is
encoded in chunks, cut where no piece can reach across: before a space mark that
follows another character, and around ASCII characters that no piece holds (both
checked against the vocabulary). Chunks recur, so their ids are kept in a
bounded table of two generations.

Defined cases: a null text is the empty text and has no ids; characters outside
the vocabulary become byte pieces; everything else is row by row, so repeated
rows, empty tables and other columns need nothing special.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
KEPT_CHUNKS = 300_000
KEPT_PAIRS = 1_000_000


class Encoder:
    def __init__(self, model: bytes) -> None:
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)
        self.pieces = {lib.id_to_piece(i): i for i in range(lib.vocab_size()) if not special(i)}
        self.score = {p: lib.get_score(i) for p, i in self.pieces.items()}
        self.byte = {bytes([b]): lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.unknown = lib.unk_id()
        self.has_bytes = lib.is_byte(self.byte[b"\0"])
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        held = set().union(*self.pieces)
        self.plain = {c for c in held if c in self.pieces}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in held))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            self.cut = re.compile(f"[{alone}]|[^{alone}]+")
        else:
            self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]")

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself, for the texts of one or two tokens."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        known = self.fits[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def tokens(self, text: str) -> list[str]:
        """The pieces of ``text``, by the prefix table."""
        last: list[str | None] = [None] * (len(text) + 1)
        last[0] = ""
        fits, known = self.fits, self.plain.issuperset(text)
        for end, piece in self.automaton.iter(text):
            if not known:
                self._unmatched(last, text, end)
            end += 1
            if last[end] is None:
                before = last[end - len(piece)]
                if before is not None:
                    fit = fits.get((before, piece))
                    if fit or (fit is None and self.compatible(before, piece)):
                        last[end] = piece
        if not known:
            self._unmatched(last, text, len(text))
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _unmatched(self, last: list[str | None], text: str, end: int) -> None:
        """Fills entries below ``end`` that no piece ends at: characters outside the vocabulary."""
        at = end
        while at > 0 and last[at] is None:
            at -= 1
        for i in range(at, end):
            last[i + 1] = text[i]

    def ids(self, token: str) -> tuple[int, ...]:
        known = self.pieces.get(token)
        if known is not None:
            return (known,)
        if not self.has_bytes:
            return (self.unknown,)
        return tuple(self.byte[bytes([b])] for b in token.encode())

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a chunk that ``recent`` does not hold."""
        found = self.older.get(text)
        if found is None:
            tokens = self.tokens(text)
            try:
                found = tuple([self.pieces[t] for t in tokens])
            except KeyError:
                found = tuple(chain.from_iterable(map(self.ids, tokens)))
        if len(text) <= 64:
            if len(self.recent) >= KEPT_CHUNKS:
                self.older, self.recent = self.recent, {}
            self.recent[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        known = self.recent.get
        return list(chain.from_iterable([known(p) or self.chunk(p) for p in self.cut.findall(self.library.normalize(text))]))


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = Encoder(model)
    return _ENCODERS[model]


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns at its end: ids array<int> and decoded string
    (the library's decode of the ids). Other columns are carried along. The model
    file is read here and sent to the tasks, at under a megabyte."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = docs.columns
    at = names.index(text_col)
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)] + ["ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [own.encode(t or "") for t in part.column(at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
                out = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([own.library.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*part.schema.names, "ids", "decoded"])

    done = plain.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "ids", "decoded")
