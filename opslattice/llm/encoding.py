"""Byte-level BPE ids through the tokenizers library, with a bounded memory of words met before."""

from __future__ import annotations

import re
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from struct import Struct, pack

import numpy as np
import pyarrow as pa

# Texts are cut into pieces wherever a byte-level BPE vocabulary cuts them whatever stands around: behind letters, digits and
# signs where another kind of character follows, and before white space; not behind white space, which goes with what follows,
# nor behind an apostrophe before a letter. Kinds of bytes:
_OTHER, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BLANK, _LINE_END, _NEVER = range(8)
# _OTHER is visible, but of a kind not looked up; no cut is made beside it but before white space, and none at all beside _NEVER.
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[:0x80] = _SIGN
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC3, 0xC9)]] = _LETTER
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[ord("'")] = _APOSTROPHE
_KIND[list(b" \t\v\f\r")] = _BLANK
_KIND[ord("\n")] = _LINE_END
_KIND[0x1C:0x20] = _NEVER  # regex engines disagree on whether these are white space
_CUT = np.zeros((8, 8), dtype=bool)  # by the kinds before and behind
_CUT[:_BLANK, _BLANK:_NEVER] = True
_CUT[_LETTER, [_DIGIT, _SIGN, _APOSTROPHE]] = _CUT[_DIGIT, [_LETTER, _SIGN, _APOSTROPHE]] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = _CUT[_APOSTROPHE, _DIGIT] = True
# U+00C0 to U+023F are letters but for two signs; _NEVER is white space beyond ASCII too, and a character on which the engines disagree.
_SPACES = [c.encode() for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_SPACES_2, _SPACES_3 = ([int.from_bytes(c) for c in _SPACES if len(c) == n] for n in (2, 3))
_FIRST = np.zeros(256, dtype=np.uint8)  # first bytes of characters whose kind depends on more than one byte
_FIRST[[*range(0xC3, 0xC9), *(c[0] for c in _SPACES)]] = 1
_KIND, _CUT, _FIRST = _KIND.tobytes(), _CUT.tobytes().ljust(256, b"\0"), _FIRST.tobytes()
# A piece that is one pre-token for sure.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
_UNSURE = re.compile("[\x1c-\x1f\u180e]")
# How the vocabulary shows bytes: those that are no printable Latin-1 character stand 256 and more places up.
_HIDDEN = [*range(0x00, 0x21), *range(0x7F, 0xA1), 0xAD]
_SHOWN = "".join(chr(256 + _HIDDEN.index(byte)) if byte in _HIDDEN else chr(byte) for byte in range(256))
_PACK = [Struct(f"<{n}I").pack for n in range(16)]
_LONGEST = 40  # bytes; longer pieces are not remembered
_GENERATION = 400_000  # pieces; two generations are kept
_BATCH_CHARS = 2 << 20


def _cuts(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Places where the pieces of joined UTF-8 texts begin, and the end of all; every text begins a piece."""
    n, kind = len(text), np.frombuffer(bytearray(text).translate(_KIND), dtype=np.uint8)
    first = np.flatnonzero(np.frombuffer(text.translate(_FIRST), dtype=bool))
    if len(first):
        ahead = np.frombuffer(text + bytes(2), dtype=np.uint8)
        latin = first[kind[first] == _LETTER]
        kind[latin + 1] = _LETTER
        sign = latin[(ahead[latin] == 0xC3) & ((ahead[latin + 1] == 0x97) | (ahead[latin + 1] == 0xB7))]
        kind[sign] = kind[sign + 1] = _OTHER
        wide = first[kind[first] == _OTHER]
        two = ahead[wide].astype(np.int32) << 8 | ahead[wide + 1]
        for width, blank in ((2, wide[np.isin(two, _SPACES_2)]), (3, wide[np.isin(two << 8 | ahead[wide + 2], _SPACES_3)])):
            for i in range(width):
                kind[blank + i] = _NEVER
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_CUT), dtype=bool)
    cut[0] = cut[starts] = cut[n] = True
    # A line end between visible characters is a piece, and so is what follows.
    ends = np.flatnonzero(kind[:-1] == _LINE_END)
    cut[ends[cut[ends] & (kind[ends + 1] < _BLANK)] + 1] = True
    return np.flatnonzero(cut)


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers. Strings of special tokens are these tokens, as is the library's default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._model = self._tokenizer.model
        self.largest_id = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        self._young: dict[bytes, bytes] = {b"\n": self._whole("\n")}
        self._old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new pieces. Plain ones go to the merges at once; the rest is cut by the vocabulary's own pre-tokenizer in one call."""
        out, cut, merged = {}, [], self._model.tokenize
        plain = list(filter(_PLAIN.fullmatch, pieces))
        for piece, shown in zip(plain, charmap_decode(b"\n".join(plain), "strict", _SHOWN)[0].split(_SHOWN[10])):
            ids = [token.id for token in merged(shown)]
            out[piece] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else pack(f"<{len(ids)}I", *ids)
        for piece in pieces if len(plain) < len(pieces) else []:
            if piece not in out:
                text = piece.decode()
                if text[0] in " \t\n\v\f\r" and not text[-1].isspace() and not _UNSURE.search(text):
                    cut.append((piece, text))
                else:
                    out[piece] = self._whole(text)
        ids, end, rest, piece = [], 0, iter(cut), None
        for part, (start, _) in self._tokenizer.pre_tokenizer.pre_tokenize_str("".join(text for _, text in cut)):
            if start >= end:
                if piece is not None:
                    out[piece] = pack(f"<{len(ids)}I", *ids)
                (piece, text), ids = next(rest), []
                end += len(text)
            ids += [token.id for token in merged(part)]
        if piece is not None:
            out[piece] = pack(f"<{len(ids)}I", *ids)
        return out

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of some different pieces."""
        if len(self._young) > _GENERATION:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        ids = list(map(young.get, pieces))
        new = [i for i, known in enumerate(ids) if known is None]
        learned = self._learn([pieces[i] for i in new if pieces[i] not in old])
        for i in new:
            piece = pieces[i]
            ids[i] = known = learned.get(piece) or old[piece]
            if len(piece) <= _LONGEST:
                young[piece] = known
        return ids

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that hold no special token: every different piece of them is looked up once, then its ids are put wherever it stands."""
        text, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        if not text:
            return [b""] * len(texts)
        cuts = _cuts(text, ends[:-1])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode()
        ids = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = pieces.indices.to_numpy()
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        before = np.cumsum(lengths) - lengths
        lengths = lengths[at]
        reached = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(reached[-1]) + np.repeat(before[at] - reached[:-1], lengths)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[places].tobytes()
        stops = (4 * reached[np.searchsorted(cuts, ends)]).tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if any(s in t for s in self._special)}
        out = self._batch([b"" if i in special else t.encode() for i, t in enumerate(texts)])
        for i in special:
            out[i] = self._whole(texts[i])
        return out

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; null is the empty text."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text if isinstance(text, str) else "")
            size += len(waiting[-1])
            if size >= _BATCH_CHARS:
                yield from self._encoded(waiting)
                waiting, size = [], 0
        yield from self._encoded(waiting)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
