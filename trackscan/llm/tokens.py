"""Token ids of whole texts by the tokenizers library, with a memo of what lies between spaces."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: A piece starts with its white space. No token of the vocabularies here spans a border between
#: a character that is not white space and one that is, so pieces can be encoded one by one.
_PIECES = re.compile(r"\s*\S+|\s+").findall
#: White space of some library besides the plain kind; texts with it are encoded whole.
_ODD = "".join(
    map(
        chr,
        (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000),
    )
)
_HAS_ODD = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _ODD) + "]"
#: What a text doesn't have if single spaces and line ends are all that is between its words.
_UNEVEN = rf"\A[\x00-\x20]|[\x00-\x20]\z|\A\z|  |\n\n| \n|\n |[\t\r\x0b\x0c]|{_HAS_ODD}"
#: Letters up to U+00FF, and ASCII marks but for the apostrophe: a word of such letters and the marks
#: behind it are separate for every pre-tokenizer that direct accepts.
_WORD = "".join(c for c in map(chr, range(256)) if c.isalpha())
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: With these a Python worker that writes token files takes about 220 MB.
MEMO_PIECES, MEMO_PIECE_BYTES, MEMO_MARKS, GROUP_BYTES = 300_000, 64, 10_000, 1 << 22


class _Memo:
    """Ids by piece, where a piece without white space in front stands for one after a space.

    pieces and ids are Arrow arrays, so a group of texts looks up its distinct pieces at once. When
    they are too many, the half that was met last stays.
    """

    def __init__(self, library: Tokenizer) -> None:
        self.library = library
        self.direct = direct(library)
        self.pieces = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.uint32()))
        self.met = np.zeros(0, np.int64)
        self.groups = 0

    def __call__(self, pieces: pa.Array) -> pa.ListArray:
        """The ids of each piece; pieces may repeat."""
        coded = pieces.dictionary_encode()
        if not self.direct:
            return self._looked_up(coded.dictionary).take(coded.indices)
        distinct = coded.dictionary
        word, marks = pc.ascii_rtrim(distinct, _MARKS), pc.utf8_ltrim(distinct, _WORD)
        size = pc.binary_length(word)
        simple = pc.and_(
            pc.greater(size, 0),
            pc.equal(pc.add(size, pc.binary_length(marks)), pc.binary_length(distinct)),
        )
        word = pc.if_else(simple, word, distinct).dictionary_encode()
        marks = pc.if_else(simple, marks, "").dictionary_encode()
        tails = _lists([self.direct("", m) for m in marks.dictionary.to_pylist()])
        both = pa.concat_arrays([self._looked_up(word.dictionary), tails])
        # word, marks, word, marks ...: an even item begins a piece
        at = np.empty(2 * len(distinct), np.int32)
        at[::2] = word.indices
        at[1::2] = marks.indices.to_numpy() + len(word.dictionary)
        parts = both.take(pa.array(at))
        whole = pa.array(parts.offsets.to_numpy()[::2])
        return pa.ListArray.from_arrays(whole, parts.values).take(coded.indices)

    def _looked_up(self, distinct: pa.Array) -> pa.ListArray:
        at = pc.index_in(distinct, value_set=self.pieces)
        new = distinct.filter(at.is_null())
        made = _lists(list(map(self._made, new.to_pylist())))
        at = at.to_numpy(zero_copy_only=False).astype(np.float64)
        at[np.isnan(at)] = len(self.pieces) + np.arange(len(new))
        at = at.astype(np.int32)
        ids = pa.concat_arrays([self.ids, made])
        found = ids.take(pa.array(at))

        self.groups += 1
        pieces = pa.concat_arrays([self.pieces, new])
        met = np.append(self.met, np.zeros(len(new), np.int64))
        met[at] = self.groups
        kept = np.append(
            np.ones(len(self.pieces), bool), pc.binary_length(new).to_numpy() <= MEMO_PIECE_BYTES
        )
        if kept.sum() > MEMO_PIECES:
            last = np.argsort(np.where(kept, -met, 1), kind="stable")[: MEMO_PIECES // 2]
            kept = np.zeros(len(kept), bool)
            kept[last] = True
        if not kept.all():
            pieces, ids, met = pieces.filter(pa.array(kept)), ids.filter(pa.array(kept)), met[kept]
        self.pieces, self.ids, self.met = pieces, ids, met
        return found

    def _made(self, piece: str) -> bytes:
        if self.direct and not piece.strip(_WORD):
            return self.direct(piece, "")
        return encoded(self.library, piece if piece[0].isspace() else " " + piece)


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Ids as little-endian 32-bit bytes, as a list for each item."""
    ends = np.cumsum([0, *map(len, ids)]) // 4
    values = pa.array(np.frombuffer(b"".join(ids), "<u4"))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encoded(library: Tokenizer, text: str) -> bytes:
    return array("I", library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


def _byte_letters() -> list[str]:
    """A letter for each byte, as byte-level vocabularies write them: a visible Latin-1 character
    stands for itself, the others are U+0100 and on in the order of the bytes."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))


def _in_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


#: What a word after a space is in the model's own letters, by the kind of vocabulary.
_FORMS: tuple[Callable[[str], str], ...] = (
    lambda word: _LETTERS[32] + _in_letters(word),
    lambda word: _in_letters(word.lower()),
)


def direct(library: Tokenizer) -> Callable[[str, str], bytes] | None:
    """A function that gives the ids of a word after a space, and of the marks behind it.

    It asks the model itself, past normaliser and pre-tokenizer, which do nothing to such words
    but write them in the model's letters. Which letters is tried out on words of all lengths up
    to three; a vocabulary for which neither form gives the library's own ids has none.
    """
    model, tails = library.model, {"": b""}
    if any(t.content.isalpha() for t in library.get_added_tokens_decoder().values()):
        return None
    letters = _WORD
    words = [*letters, *(a + b for a, b in zip(letters, letters[1:], strict=False))]
    words += [letters[i : i + n] for n in (3, 5, 9, 30) for i in range(0, len(letters), 3)]
    words += ["the", "The", "WITH", "there", "understanding", "Straße", "différence", "niño"]
    for form in _FORMS:

        def ids(word: str, marks: str, form=form) -> bytes:
            tail = tails.get(marks)
            if tail is None:
                tail = encoded(library, marks)
                if len(tails) < MEMO_MARKS:
                    tails[marks] = tail
            if not word:
                return tail
            return array("I", [t.id for t in model.tokenize(form(word))]).tobytes() + tail

        if all(ids(w, m) == encoded(library, f" {w}{m}") for w in words for m in ("", ".", ",)")):
            return ids
    return None


class Encoder:
    """Whole-text encoding that gives the library's own ids, as little-endian 32-bit bytes.

    Natural text repeats its words, so many texts are cut up together and their distinct pieces
    encoded; the ids of up to MEMO_PIECES pieces are kept. Strings of
    special tokens in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        # the task is the unit of parallel work; threads of the library would compete with it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.memo = _Memo(self.library)

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: none). Work is for each distinct piece of all the texts."""
        texts = texts.cast(pa.string()).fill_null("")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        even = texts.filter(pc.invert(uneven))
        split = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        rest = texts.filter(uneven)
        whole = pc.match_substring_regex(rest, _HAS_ODD).to_pylist()
        found = [_pieces(x) if not odd else [] for x, odd in zip(rest.to_pylist(), whole, strict=True)]
        pieces = pa.concat_arrays([split, pa.array(found, split.type)])
        ids = self.memo(pieces.flatten())
        data, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        a, b = pieces.offsets.to_numpy()[:-1], pieces.offsets.to_numpy()[1:]
        # the first piece has no space before it
        first = pieces.flatten().take(pa.array(a[a < b])).to_pylist()
        heads = iter([encoded(self.library, x) for x in first])
        made = [
            next(heads) + data[ends[i + 1] : ends[j]].tobytes() if i < j else b""
            for i, j in zip(a.tolist(), b.tolist(), strict=True)
        ]
        n = len(even)
        for i, odd in enumerate(whole):
            if odd:
                made[n + i] = encoded(self.library, rest[i].as_py())
        at = uneven.to_numpy(zero_copy_only=False)
        place = np.where(at, n + np.cumsum(at) - 1, np.cumsum(~at) - 1)
        return [made[i] for i in place.tolist()]


def _pieces(text: str) -> list[str]:
    pieces = _PIECES(text)
    # a piece after one space is known without it
    pieces[1:] = [x[1:] if x[0] == " " and x[1:2] > " " else x for x in pieces[1:]]
    return pieces


def grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, as batches of about size bytes of texts, which are column 1.

    What Arrow took for a group is given back before the next; it would keep it for itself.
    """
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
        a, done = 0, 0
        while a < len(ends):
            b = int(np.searchsorted(ends, done + size - n)) + 1  # with the row that fills the group
            part = batch.slice(a, b - a)
            held.append(part)
            n += int(ends[a + part.num_rows - 1]) - done
            a += part.num_rows
            done = int(ends[a - 1])
            if n >= size:
                yield pa.concat_batches(held)
                held, n = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker.

    vocabulary: a path on every executor, or a file name of the installed public_tokenizers.
    """
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
