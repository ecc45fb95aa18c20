"""Token ids of whole texts by the tokenizers library, with bounded caches of encoded words.

Both public vocabularies split a text at white space and at changes between letters, digits and other characters
before they merge anything, so a text's ids are those of its pieces one after another. Each distinct piece is merged by
the library's model once per worker process. Plain texts of the byte-level vocabulary are cut at white space many at a time:
each distinct stretch of a batch is looked up once, and those not met before are encoded by the library together. The splitting patterns below are the vocabularies' own, restricted to
characters below U+0300, where Python's classes agree with theirs and no normal form changes; words with any other
character, and texts with unusual white space, are encoded by the library as they are.

Ids are those of a plain ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: none is added, and where a
text itself spells a special token such as ``<|endoftext|>``, it has that token's id. With ``ordinary`` such strings are
encoded as the ordinary text that they are.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa

from .textcore import buffers, large_text


#: Characters on which ideas of white space might differ; each is looked for on its own, which is faster than a pattern.
ODD = tuple(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
ODD_ASCII = ODD[:4]
#: White space that does not stand for itself between two words of a text that is split at spaces.
TABS = "\t\r\x0b\x0c"
RUN = tuple(" " + c for c in TABS)
SIMPLE = re.compile("[^̀-\U0010ffff\xb2\xb3\xb9\xbc-\xbeİ]*")
#: Fixed by the vocabularies: how each splits a text into pieces.
PIECES = {
    "byte": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "word": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"),
}
#: Most cached words (of about 200 bytes each) by vocabulary, most cached other pieces, and the longest of either.
CACHE_WORDS, CACHE_PARTS, CACHE_CHARS = {"byte": 800_000, "word": 250_000}, 50_000, 48
#: Stretches not met before that the library encodes in one call.
TOGETHER = 250
#: Of bytes: white space; a letter 1, a digit 2, another 0; one that any ASCII piece of a word has (an apostrophe may begin a contraction); in lower case.
BLANK, CLASS = np.isin(np.arange(256), list(b" \n\t\r\x0b\x0c")), np.array([bytes([b]).isalpha() + 2 * bytes([b]).isdigit() for b in range(256)], np.int8)
PLAIN, LOWER = np.isin(np.arange(256), [b for b in range(33, 127) if b != 39]), np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Of bytes: a space or an end of line; an ASCII letter or digit; an ASCII sign other than that of contractions.
SPACE, ALNUM, SIGN = (np.isin(np.arange(256), list(chars)) for chars in (b" \n", (string.ascii_letters + string.digits).encode(), string.punctuation.replace("'", "").encode()))

_encoders: dict[str, Encoder] = {}


def has_odd(text: str) -> bool:
    return any(c in text for c in (ODD_ASCII if text.isascii() else ODD))


def _byte_letters() -> dict[int, str]:
    """Fixed: the printable character by which a byte-level vocabulary writes each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(rest)) for b in range(256)}


class Encoder:
    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for pieces, which never hold one whole
        self.plain = Tokenizer.from_file(path)
        self.special = () if ordinary else tuple(x.content for x in self.plain.get_added_tokens_decoder().values())
        self.kind = "byte" if '"normalizer":null' in self.tokenizer.to_str() else "word"
        self.pieces, self.merge, self.letters = PIECES[self.kind].findall, self.tokenizer.model.tokenize, _byte_letters()
        self.spaced = Tokenizer(self.tokenizer.model)  # the same model, for pieces spelled in its letters with spaces between
        self.spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.between = {b: x for b, x in self.letters.items() if b != 32}
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = _Words(self, " " if self.kind == "byte" else "", CACHE_WORDS[self.kind])
        self.parts: dict[str, bytes] = {}
        tokens = self.tokenizer.get_vocab()
        self.opens = np.zeros(len(self.bytes), bool)  # does a token begin with a space or an end of line
        self.opens[[i for token, i in tokens.items() if token.startswith((self.letters[32], self.letters[10]))]] = True
        self.closes = np.zeros(len(self.bytes), bool)  # does a token end a piece
        self.closes[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
        self.apart = not any(re.search(f"[A-Za-z]{self.letters[32]}", token) for token in tokens)  # words of letters never merge with each other

    def whole(self, text: str) -> bytes:
        """Ids of a text as the library gives them."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: str) -> bytes:
        """Ids of one piece, by the library's model."""
        spelled = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes[t.id] for t in self.merge(spelled)])

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of several, from the words met alone where it is spelled like one."""
        spaced = self.kind == "byte"
        if spaced and piece[0] != " ":
            store, key, most = self.parts, piece, CACHE_PARTS
        else:
            store, key, most = self.words, piece[spaced:], self.words.most
        got = store.get(key)
        if got is None:
            got = self.merged(piece)
            if len(piece) <= CACHE_CHARS:
                if len(store) >= most:
                    store.clear()
                store[key] = got
        return got

    def word(self, word: str) -> bytes:
        """Ids of a stretch of text that begins and ends where pieces do."""
        if word.isascii():
            if self.kind == "byte" and word[1:].isalpha() and word[0] == " ":
                return self.merged(word)
        elif not SIMPLE.fullmatch(word):
            return self.whole(word)
        found = self.pieces(word.lower() if self.kind == "word" else word)
        return self.merged(found[0]) if len(found) == 1 else b"".join(map(self.piece, found))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, get, plain = [], self.words.__getitem__, []
        for text in texts:
            if any(x in text for x in self.special):
                out.append(array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes())
            elif has_odd(text):
                out.append(self.whole(text))
            elif self.kind == "word":
                plain.append(len(out))
                out.append(b"")
            else:
                tabs = any(c in text for c in TABS)
                if "  " in text or " \n" in text or (tabs and any(r in text for r in RUN)):
                    out.append(self.word(text))
                elif tabs or "\n\n" in text or "\n " in text:
                    words = text.split(" ")
                    out.append(self.word(words[0]) + b"".join(map(get, words[1:])))
                else:
                    plain.append(len(out))
                    out.append(b"")
        if plain:
            together = self.by_pieces if self.kind == "word" else self.together
            for k, got in zip(plain, together([texts[k] for k in plain]), strict=True):
                out[k] = got
        return out

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose only white space is single spaces and ends of lines, none after another.

        Each text is put behind an end of line, which is a piece by itself. So all fall into stretches that begin with a space or an end of line, and
        are cut where an ASCII letter or digit is followed by a sign, as no piece holds both (contractions begin with their sign, which is left out).
        """
        data = ("\n" + "\n".join(texts)).encode()
        buf = np.frombuffer(data, np.uint8)
        blank, cut = SPACE[buf], np.zeros(len(buf), bool)
        cut[1:] = SIGN[buf[1:]] & ALNUM[buf[:-1]]
        starts = np.flatnonzero(blank | cut)
        bounds = pa.py_buffer(np.append(starts, len(buf)).astype(np.int64))
        met = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        ids, which = self.stretches(met.dictionary), np.asarray(met.indices)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, n, begin = np.frombuffer(b"".join(ids), "<u4"), size[which], (np.cumsum(size) - size)[which]
        blanks = np.zeros(len(texts), np.int64)  # before each text
        np.cumsum([1 + x.count(" ") + x.count("\n") for x in texts[:-1]], out=blanks[1:])
        heads = np.flatnonzero(blank[starts])[blanks]
        begin[heads] += 1  # without the end of line that it was put behind
        n[heads] -= 1
        return _joined(flat, begin, n, np.append(heads, len(n)))

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without unusual white space, by the vocabulary that drops it.

        Words of printable ASCII without an apostrophe are cut into their pieces: runs of letters, runs of signs, single digits. Other words stay whole.
        """
        coded = [x.encode() for x in texts]
        buf = np.frombuffer(b"\n".join(coded), np.uint8)
        solid = ~BLANK[buf]
        small, first = buf[solid], solid.copy()
        if not len(small):
            return [b""] * len(texts)
        first[1:] &= ~solid[:-1]
        first = first[solid]
        words, kind = np.flatnonzero(first), CLASS[small]
        whole = np.repeat(np.logical_or.reduceat(~PLAIN[small], words), np.diff(np.append(words, len(small))))
        first[1:] |= ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~whole[1:]
        starts = np.flatnonzero(first)
        bounds = pa.py_buffer(np.append(starts, len(small)).astype(np.int64))
        met = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.where(whole, small, LOWER[small]))]).dictionary_encode()
        ids, which = self.distinct_pieces(met.dictionary), np.asarray(met.indices)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.cumsum([len(x) + 1 for x in coded]).tolist()
        heads = np.cumsum([0, *(np.count_nonzero(solid[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True))])
        return _joined(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(size) - size)[which], size[which], np.searchsorted(starts, heads))

    def distinct_pieces(self, distinct: pa.Array) -> list[bytes]:
        """Ids of distinct pieces and words; those not met before are encoded many at once, but for words with characters beyond SIMPLE."""
        found = _binaries(distinct)
        out = list(map(self.words.get, found))
        fresh = [k for k, got in enumerate(out) if got is None]
        names = [found[k].decode() for k in fresh]
        simple = [(k, x) for k, x in zip(fresh, names, strict=True) if x.isascii() or SIMPLE.fullmatch(x)]
        for i in range(0, len(simple), TOGETHER):
            some, pieces = [k for k, _ in simple[i : i + TOGETHER]], [[low] if (low := x.lower()).isalpha() else self.pieces(low) for _, x in simple[i : i + TOGETHER]]
            spelled = " ".join([" ".join(x) for x in pieces])
            if not (spelled.isascii() and spelled.isprintable()):
                spelled = spelled.encode().decode("latin-1").translate(self.between)
            ids = np.array(self.spaced.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            # A piece's last token says so. Were pieces not those that were counted, each would be encoded alone.
            last, counted = np.flatnonzero(self.closes[ids]) + 1, np.cumsum([len(x) for x in pieces])
            if len(last) == counted[-1]:
                ends, got = [0, *(4 * last[counted - 1]).tolist()], ids.tobytes()
                for k, a, b in zip(some, ends[:-1], ends[1:], strict=True):
                    out[k] = got[a:b]
        if len(self.words) + len(fresh) > self.words.most:
            self.words.clear()
        for k, x in zip(fresh, names, strict=True):
            if out[k] is None:
                out[k] = self.word(x)
            if len(x) <= CACHE_CHARS:
                self.words[found[k]] = out[k]
        return out

    def merged_ids(self, words: str) -> list[int]:
        return [t.id for t in self.merge(words.replace(" ", self.letters[32]))]

    def library_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def stretches(self, distinct: pa.Array) -> list[bytes]:
        """Ids of distinct stretches; those with white space and more that were not met before are encoded many at once."""
        found = _binaries(distinct)
        out = list(map(self.words.get, found))
        fresh = [k for k, got in enumerate(out) if got is None]
        spaced = [k for k in fresh if len(found[k]) > 1 and found[k][0] in b" \n"]
        letters = [k for k in spaced if self.apart and found[k][0] == 32 and found[k][1:].isalpha()]  # ASCII ones: each is one piece
        others = sorted({*spaced}.difference(letters))
        for of, encode in ((letters, self.merged_ids), (others, self.library_ids)):
            for i in range(0, len(of), TOGETHER):
                some = of[i : i + TOGETHER]
                ids = np.array(encode(b"".join([found[k] for k in some]).decode()), "<u4")
                # White space is only met where a stretch begins, so a token that begins with it begins a stretch.
                at, got = np.append(np.flatnonzero(self.opens[ids]), len(ids)).tolist(), ids.tobytes()
                for k, a, b in zip(some, at[:-1], at[1:], strict=True):
                    out[k] = got[4 * a : 4 * b]
        if len(self.words) + len(fresh) > self.words.most:
            self.words.clear()
        for k in fresh:
            if out[k] is None:
                out[k] = self.whole(found[k].decode())
            if len(found[k]) <= CACHE_CHARS:
                self.words[found[k]] = out[k]
        return out


def _binaries(distinct: pa.Array) -> list[bytes]:
    data, ends = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1].tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _joined(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Runs of ids, n[k] of flat from begin[k], put together as texts: text i has those from cut[i] up to cut[i + 1]."""
    to = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=to[1:])
    got, ends = flat[np.repeat(begin - to[:-1], n) + np.arange(to[-1])].tobytes(), (4 * to[cut]).tolist()
    return [got[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Words(dict):
    """Ids of words met so far, with what stands before them; new ones are encoded on the way. Keys of bytes are whole stretches."""

    def __init__(self, encoder: Encoder, before: str, most: int):
        super().__init__()
        self.encoder, self.before, self.most = encoder, before, most

    def __missing__(self, word: str) -> bytes:
        got = self.encoder.word(self.before + word)
        if len(word) <= CACHE_CHARS and "\n" not in word:  # words on both sides of a line's end seldom meet again; their pieces are kept
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(column: pa.Array, size: int = 1 << 20):
    """(begin, end, texts) of runs of about that many bytes of a text column, null as empty."""
    arr = large_text(column)
    _, offsets = buffers(arr)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, arr.slice(i, j - i).to_pylist()
        i = j
