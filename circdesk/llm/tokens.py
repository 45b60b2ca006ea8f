"""Token ids of whole texts, fast enough for a corpus.

The byte-level pre-tokenizer's pattern marks the cuts of the texts inside Spark; a worker then encodes
each distinct piece once with the tokenizer's model and puts the ids of a text together from its pieces.
Texts with characters outside the well-established ranges below go through the tokenizer whole, so
that different Unicode tables cannot give different cuts, and so do texts with added tokens.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# The pattern of the byte-level pre-tokenizer, the most frequent branches first (no two match at the same
# place), and the ranges whose classes are settled, without the mark.
_PATTERN = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = r"[\x{1}-\x{58F}\x{2000}-\x{206F}\x{20A0}-\x{20BF}\x{2190}-\x{22FF}\x{3000}-\x{30FE}\x{4E00}-\x{9FA5}]*"
_MARK = "\0"
_CACHED, _LISTED = 50_000, 300_000
_ROWS, _PIECES = 10_000, 400_000


def cut(text: Column, path: str) -> Column:
    """``struct(marked string, whole string)``: the text with a mark after each piece, or as it is if it must stay whole.

    Texts that hold one of the tokenizer's added tokens, such as a written-out end mark, stay whole, and so do those
    that hold the mark itself.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_ = F.octet_length(text) == F.char_length(text)
    settled = F.when(ascii_, ~F.contains(text, F.lit(_MARK))).otherwise(text.rlike(rf"\A{_SETTLED}+\z"))
    for added in encoder(path).tokenizer.get_added_tokens_decoder().values():
        settled &= ~F.contains(text, F.lit(added.content))
    marked = F.regexp_replace(text, F.lit(f"(?U){_PATTERN}"), F.lit(f"$0{_MARK}"))
    return F.struct(F.when(settled, marked).alias("marked"), F.when(~settled, text).alias("whole"))


def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their column ``cut`` as ``struct(cuts array<string>, whole string)``, a few texts at a time."""
    for batch in batches:
        marked, whole = batch.column("cut").field("marked"), batch.column("cut").field("whole")
        size = pc.add(pc.fill_null(pc.binary_length(marked), 0), pc.fill_null(pc.binary_length(whole), 0))
        for start, stop in _runs(size, 4 * _PIECES):  # pieces have some three letters and a mark
            cuts = pc.split_pattern(marked.slice(start, stop - start), _MARK)  # the last piece is empty
            column = pa.StructArray.from_arrays([cuts, whole.slice(start, stop - start)], ["cuts", "whole"])
            yield batch.slice(start, stop - start).set_column(batch.schema.get_field_index("cut"), "cut", column)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with a column ``cut``, in slices of so many rows and about so many pieces at most, or of one row."""
    for batch in batches:
        for start, stop in _runs(pc.fill_null(pc.list_value_length(batch.column("cut").field("cuts")), 0), _PIECES):
            yield batch.slice(start, stop - start)


def _runs(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Starts and stops of runs of at most ``_ROWS`` rows that come to ``most`` together, or of one row."""
    ends, start = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(start + 1, min(stop, start + _ROWS))
        yield start, stop
        start = stop


class Encoder:
    """Encodes Arrow batches of ``cuts`` structs; remembers a bounded number of pieces, those used last.

    Pieces are looked up a slice at a time in a list of up to ``_LISTED``, which keeps its ids in one array; those not
    on it one by one.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in two bytes; this vocabulary is too large")
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.listed, self.used = pa.array([], pa.string()), np.zeros(0, bool)
        self.flat, self.at = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def ids(self, column: pa.StructArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch one after another (uint16), and where each text's ids start and end."""
        cuts, whole = column.field("cuts"), column.field("whole")
        place = self._places(cuts.flatten())
        lengths = np.diff(self.at)[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[place] - (ends - lengths), lengths) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        stop = np.array([] if end is None else [end], np.uint16)
        parts, starts = [], [0]
        for i, text in enumerate(whole.to_pylist()):
            own = ids[ends[bounds[i]]: ends[bounds[i + 1]]]
            if text is not None:
                own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
            parts += [own, stop]
            starts.append(starts[-1] + len(own) + len(stop))
        return np.concatenate(parts) if parts else ids, np.array(starts, np.int64)

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """Where on the list each piece is; new ones are encoded and put on it, those used least recently leave first."""
        if len(self.listed) > _LISTED:
            self._keep(self.used)
        place = pc.index_in(pieces, value_set=self.listed)
        new = pieces.filter(pc.is_null(place)).dictionary_encode()
        first = len(self.listed)
        if len(new):
            found = self._learn(new.dictionary.to_pylist())
            self.listed = pa.concat_arrays([self.listed, new.dictionary])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), np.uint16)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(f) // 2 for f in found])])
            self.used = np.concatenate([self.used, np.zeros(len(found), bool)])
        where = place.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        where[where < 0] = first + new.indices.to_numpy(zero_copy_only=False)
        self.used[where] = True
        return where

    def _keep(self, kept: np.ndarray) -> None:
        lengths = np.diff(self.at)
        self.flat = self.flat[np.repeat(kept, lengths)]
        self.at = np.concatenate([[0], np.cumsum(lengths[kept])])
        self.listed = self.listed.filter(pa.array(kept))
        self.used = np.zeros(len(self.listed), bool)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, from the model or as remembered; two bytes each."""
        raw = np.frombuffer(_MARK.join(pieces).encode(), np.uint8)
        out = []
        for piece, letters in zip(pieces, _BYTE_LETTERS[raw].tobytes().decode("utf-32-le").split(_MARK)):
            if len(self.known) >= _CACHED:
                self.known, self.older = {}, self.known
            found = self.older.get(piece)
            if found is None:
                found = array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self.known[piece] = found
            out.append(found)
        return out

    def _piece(self, piece: str) -> bytes:
        return self._learn([piece])[0]


def _byte_letters() -> np.ndarray:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the others from U+0100 on; the mark stays."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letters = [b if b in plain else next(others) for b in range(256)]
    letters[ord(_MARK)] = ord(_MARK)
    return np.array(letters, "<u4")


_BYTE_LETTERS = _byte_letters()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so that it keeps its pieces over the tasks it runs."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
