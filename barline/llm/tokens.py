"""Token ids of whole texts by a public byte-level BPE file, with a table of words that were met before.

The pre-tokenizer of such files starts a new piece at every space before a non-space, and cuts runs of letters from
other signs. So the ids of a text made of lines of words with one space between them are the ids of the words put
together, and a word of letters and signs after them is one piece of letters and one of signs. Such pieces go straight
to the library's BPE model; other words, and texts of another shape, go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

#: Words in a table before it is set aside; two tables are held, some 120 bytes a word in each. Smaller ones cost time.
REMEMBERED = 1 << 20
_OTHER = re.compile(r"[^\S \n]")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Signs that never join the letters before them, as the apostrophe does.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """word -> ids, filled on first use. A full table is set aside, and words that come up again are taken over from it."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.before, self.room = make, {}, room

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.room:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteLevelIds:
    """encode(texts) gives for each text its ids as little-endian 16-bit integers. Only for files with ids below 65536.

    The ids are those of the library's defaults without added special tokens: the string of a special token in a text
    is that token. With `special_as_text` such strings are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the tables here take its place, and a full cache only costs time
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {n: shown(chr(n))[0][0] for n in (32, *range(0xC0, 0x250))}  # how the model spells these signs
        self.space = self.shown[32]
        self.newline = self._whole(["\n"])[0]
        self.signs = _Words(lambda run: self._whole([run])[0], remembered)
        #: A word at the start of a line has the newline before it, any other a space that is not written.
        self.known = _Words(self._word, remembered)

    @classmethod
    @lru_cache(maxsize=1)
    def of_file(cls, path: str, remembered: int) -> ByteLevelIds:
        """One for all tasks of a worker process, which so share the words that they have met."""
        return cls(path, remembered=remembered)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        head = word[0] == "\n"
        letters = word[1:] if head else word
        if not letters.isalpha():
            core = word.rstrip(_SIGNS)
            if len(core) < len(word) and _LATIN.fullmatch(core, head):
                return self.known[core] + self.signs[word[len(core) :]]
        if letters.isascii() and letters.isalpha():
            spelled = letters if head else self.space + letters
        elif _LATIN.fullmatch(letters):
            spelled = (letters if head else " " + letters).translate(self.shown)
        else:
            return self.newline + self._whole([word[1:]])[0] if head else self._whole([" " + word])[0]
        ids = _packed([t.id for t in self.model.tokenize(spelled)])
        return self.newline + ids if head else ids

    def _is_plain(self, text: str) -> bool:
        """Lines of words with one space between them; no empty lines, no other white space, no added token's string."""
        flat = text.replace("\n", " ")
        if not flat or flat[0] == " " or flat[-1] == " " or "  " in flat or any(a in text for a in self.added):
            return False
        return flat.isprintable() or not _OTHER.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._is_plain(t) for t in texts]
        odd = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        get = self.known.__getitem__
        # A newline begins the first line too, and its id is taken off again.
        return [
            b"".join(map(get, ("\n" + t.replace("\n", " \n")).split(" ")))[len(self.newline) :] if p else next(odd)
            for t, p in zip(texts, plain, strict=True)
        ]


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()
