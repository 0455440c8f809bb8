"""Byte-level BPE ids of whole texts by the tokenizers library; each distinct piece of a slice of texts is looked up once.

The tokenizer cuts a text into pre-tokens and encodes each alone, and a pre-token holds white space only before its other
characters. So a text may be cut before any blank or line break that follows another kind of character, and each piece
encoded alone. The pieces of a slice are cut and numbered by Arrow (dictionary encoding); ids of the distinct ones come from
a dictionary of the worker or from the library, and are gathered in NumPy. Texts with other white space, or with two of it
in a row, go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from tokenizers import Tokenizer

#: Pieces in each of the worker's two dictionaries (about 170 bytes each). When the newer one is full it takes the older one's
#: place; pieces that are met again move over.
MOST_PIECES = 250_000
#: Pieces that the library encodes at a time; it holds about 100 bytes per id meanwhile.
LEARNED = 1 << 14
TOKENIZER = "byte_bpe_50k.json"
#: Two blanks in a row, and every white space besides blank and line break.
_ODD = ("  ", " \n", "\n ", "\n\n", "\0", *(c for c in map(chr, range(1, 0x3001)) if c.isspace() and c not in " \n"))
_LETTER, _SIGN, _AFTER_C3 = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Second bytes of the letters U+00C0 to U+00FF.
_AFTER_C3[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def _plain(text: str) -> bool:
    return not any(map(text.__contains__, _ODD))


class Encoder:
    def __init__(self, file: str) -> None:
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bare = {b" \0": b"", **dict(zip((b" ", b" \n"), self._whole([" ", "\n"]), strict=True))}
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose first byte is a blank or a line break
        self.opens[[i for token, i in vocab.items() if token[:1] in ("\u0120", "\u010a")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of pieces as they are cut: a blank and a word, a line break (after a blank) and a word, or without white space
        (or with \\0 in its place) what begins a text or follows a letter.

        The library encodes all of them as a few texts, with a line break before those that have none; each piece starts at an id
        with white space, which it has nowhere else. Pieces that are white space alone stand in `bare`."""
        older, known, new, spelled, skipped = self.older, self.known, [], [], []
        for piece in pieces:
            ids = older.get(piece)
            if ids is None:
                ids = self.bare.get(piece)
            if ids is not None:
                known[piece] = ids
                continue
            own = piece[0] == 32 and piece[1] != 0  # white space of its own
            new.append(piece)
            spelled.append((piece[1:] if piece[1] == 10 else piece) if own else b"\n" + piece.removeprefix(b" \0"))
            skipped.append(0 if own else 4)
        for x in range(0, len(new), LEARNED):
            part = slice(x, x + LEARNED)
            got = self._whole([b"".join(spelled[part]).decode()])[0]
            starts = np.flatnonzero(self.opens[np.frombuffer(got, "<u4")]) * 4
            ends = np.append(starts[1:], len(got)).tolist()
            for piece, a, b in zip(new[part], (starts + skipped[part]).tolist(), ends, strict=True):
                known[piece] = got[a:b]

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end) of texts without odd white space."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        raw = np.frombuffer((" \0" + " \0".join(texts)).replace("\n", " \n").encode(), np.uint8)
        cut = _SIGN[raw]  # a sign ends a run of letters
        cut[1:] &= _LETTER[raw[:-1]] | (_AFTER_C3[raw[:-1]] & np.append(False, raw[:-2] == 0xC3))
        at = np.append(np.flatnonzero(cut | (raw == 32)), len(raw)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        which, (_, cuts, data) = found.indices.to_numpy(), found.dictionary.buffers()
        cuts, data = np.frombuffer(cuts, np.int64)[: len(found.dictionary) + 1].tolist(), data.to_pybytes()
        pieces = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(self.known) > MOST_PIECES:
            self.older, self.known = self.known, {}
        ids = list(map(self.known.get, pieces))
        if None in ids:
            self._learn([p for p, i in zip(pieces, ids, strict=True) if i is None])
            ids = [self.known[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), np.uint32)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = (np.cumsum(length) - length)[which]
        length = length[which]
        end = np.cumsum(length)
        kind = np.int32 if int(end[-1]) < 1 << 31 else np.int64
        got = flat[np.repeat((first - end + length).astype(kind), length) + np.arange(int(end[-1]), dtype=kind)]
        heads = np.searchsorted(at, np.flatnonzero(raw == 0) - 1)
        return got, np.append((end - length)[heads], end[-1])

    def encode_flat(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): unsigned 32-bit ids of all texts in a row and the first id of each, one more at the end; `end` is
        appended to each text. A null is an empty text."""
        texts = [t or "" for t in texts]
        odd = [] if _plain("\x01".join(texts)) else [row for row, t in enumerate(texts) if not _plain(t)]
        whole = dict(zip(odd, self._whole([texts[r] for r in odd]), strict=True))
        ids, cuts = self._cut([t for row, t in enumerate(texts) if row not in whole] if odd else texts)
        if odd:
            plain = iter(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            each = [np.frombuffer(whole[r], np.uint32) if r in whole else ids[slice(*next(plain))] for r in range(len(texts))]
            ids, cuts = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
        if end is not None:
            ids, cuts = np.insert(ids, cuts[1:], end), cuts + np.arange(len(cuts))
        return ids, cuts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null is an empty text."""
        ids, cuts = self.encode_flat(texts)
        raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), (cuts * 4).tolist()
        return [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder for a file of public_tokenizers; it lives as long as the worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(public_tokenizers.path(name))
    return _encoders[name]


def slices(texts: pa.Array | list[str | None], most: int = 1 << 22):
    """Parts of a column or list of texts with about `most` bytes each, to bound what is held at a time."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = int(size[row - 1]) if row else 0
        end = min(len(texts), int(np.searchsorted(size, before + most)) + 1)
        yield texts.slice(row, end - row).to_pylist()
        row = end
