"""Token ids of whole texts with the tokenizers library, remembered word by word.

The two public tokenizers never let a token cross the gap between two words, so
a text's ids are the ids of its words in order. Arrow cuts a batch's texts into words and
numbers the distinct ones; a worker asks the library once for each word it meets,
keeps the answer, and a gather puts the ids of all words together. Texts whose white space is not
plain single blanks and line feeds are given to the library whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; further new words are encoded each time.
CACHE_WORDS = 400_000
#: Rows and bytes of text that are encoded at once (a longer text by itself).
TEXTS, BYTES = 4096, 12 << 20
#: Bytes at once in a worker that has other stages' memory beside it; with fewer remembered words, 40 MB beside the vocabulary.
FEW_BYTES = 1 << 20

_SPLIT = "\x00"
#: White space beyond ASCII.
_WIDE = "".join(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace())
#: Texts that stay whole: for vocabularies whose tokens carry the blank before a word, those with
#: white space other than lone blanks and line feeds; for others, those with controls that part no words.
_ODD_SPACED = rf"[ \n][ \n]|[\x00\t\r\x0b\x0c\x1c-\x1f{_WIDE}]"
_ODD_BARE = "[\\x1c-\\x1f\x85]"
#: How byte-level merges spell bytes: the printable as themselves, the others from U+0100 on.
_BYTES = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_SPELLED = {b: 0x100 + i for i, b in enumerate(_BYTES)}
_BLANK = chr(_SPELLED[0x20])
#: Letters that every Unicode version tells alike (the lower case of U+0130 is a letter and a mark), and signs that end a run of letters.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r".,;:!?*$&%#@~^=+_|()\[\]{}<>/-"
_GAP, _ALPHABETIC = f"([{_LETTERS}])([{_SIGNS}])", f"^ ?[{_LETTERS}]+$"
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit bytes (32-bit for vocabularies beyond 65,536)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        # For words of letters alone, which are never cut before the merges.
        self.merges = self.tokenizer.model.tokenize
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words
        # A token stands for the blank before its word, or white space vanishes.
        probe = [self._whole(x) for x in (" a", "a")]
        self.spaced = probe[0] != probe[1]
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD_SPACED if self.spaced else _ODD_BARE, *special])
        self.known[""] = b""

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _words(self, texts: pa.Array) -> pa.Array:
        """Each plain text's words, cut where no token can cross: also where signs follow letters."""
        if self.spaced:
            texts = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
            return pc.split_pattern(pc.replace_substring_regex(texts, _GAP, "\\1\x00\\2"), _SPLIT)
        return pc.utf8_split_whitespace(pc.replace_substring_regex(texts, _GAP, "\\1 \\2"))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if texts.nbytes > 1 << 28:
            texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd)
        if self.spaced:
            for x in " \n":
                odd = pc.or_(odd, pc.or_(pc.starts_with(texts, x), pc.ends_with(texts, x)))
        odd = odd.to_numpy(zero_copy_only=False)
        words = self._words(texts.filter(pa.array(~odd)) if odd.any() else texts)
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        own = self._known(coded.dictionary)
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.width.itemsize
        start = np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        kind = np.int32 if len(end) and end[-1] < 2**31 else np.int64
        place = np.repeat((start[which] - (end - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        ids = np.frombuffer(b"".join(own), self.width)[place]
        cut = words.offsets.to_numpy()
        plain = np.diff(np.concatenate(([0], end))[cut - cut[0]])
        if not odd.any():
            return ids, plain
        whole = [np.frombuffer(self._whole(x), self.width) for x in texts.filter(pa.array(odd)).to_pylist()]
        count = np.zeros(len(texts), np.int64)
        count[~odd], count[odd] = plain, [len(x) for x in whole]
        out = np.empty(int(count.sum()), self.width)
        at = np.repeat(odd, count)
        out[~at], out[at] = ids, np.concatenate(whole)
        return out, count

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``flat``, with the end id after each text."""
        ids, count = self.flat(texts)
        out = np.empty(len(ids) + len(count), self.width)
        last = np.cumsum(count + 1) - 1
        out[last] = end_id
        inside = np.ones(len(out), bool)
        inside[last] = False
        out[inside] = ids
        return out, count + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, count = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(count)[:-1])] if texts else []

    def _known(self, distinct: pa.Array) -> list[bytes]:
        """The ids of each distinct word; those not met before are asked for."""
        words = distinct.to_pylist()
        out = list(map(self.known.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        code = "H" if self.width.itemsize == 2 else "I"
        alphabetic = pc.match_substring_regex(distinct.take(pa.array(new, pa.int32())), _ALPHABETIC).to_pylist()
        merges, spaced, others = self.merges, self.spaced, []
        for i, plain in zip(new, alphabetic):
            if plain:  # one piece, nothing to normalize but case: the merges alone
                word = words[i] if spaced else words[i].lower()
                spelled = word.replace(" ", _BLANK) if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED)
                out[i] = array(code, [t.id for t in merges(spelled)]).tobytes()
            else:
                others.append(i)
        for at in range(0, len(others), 8192):
            part = others[at : at + 8192]
            for i, got in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[i] = array(code, got.ids).tobytes()
        room = self.cache_words - len(self.known)
        if room > 0:
            self.known.update((words[i], out[i]) for i in new[:room])
        return out


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """This worker's encoder for the vocabulary file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, cache_words)
    return _LOADED[path]


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BYTES) -> Iterator[pa.Table]:
    """Batches put together up to ``TEXTS`` rows or ``most`` bytes of ``column``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        each = batch[column].nbytes
        if held and (rows + batch.num_rows > TEXTS or size + each > most):
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + each
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def slices(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    """Each text's ids as bytes, without a copy."""
    ends = np.concatenate(([0], np.cumsum(count))) * ids.itemsize
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
    return pa.array([x.tobytes() for x in np.split(ids, np.cumsum(count)[:-1])], pa.binary())


def released(function):
    """A worker function that first lets go of the encoders that the worker holds from other tasks, and in the end of the memory it used."""

    def run(batches):
        release()
        yield from function(batches)
        trimmed()

    return run


def release() -> None:
    """Let go of this worker's encoders."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()
        trimmed()


def trimmed() -> None:
    """Give free memory back to the system: workers wait for their next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
