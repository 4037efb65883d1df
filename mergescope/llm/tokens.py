"""Token ids of many texts with a public tokenizer whose words don't depend on their neighbours."""

from __future__ import annotations

import json
import os
from array import array

import regex

from mergescope.llm.bpe import byte_letters

CACHED_WORDS = 400_000
CACHED_PARTS = 60_000
LONGEST_CACHED = 64


class WordTokenizer:
    """Ids of the tokenizers library, with each different word encoded once while it stays in a bounded cache.

    It is for tokenizers that lower-case, drop white space and split at it, so the ids of a text are those of its words,
    one after the other. Words of Latin-1 letters are in normal form already; they are lower-cased and split here by the
    file's own pattern and go to the library's BPE model part by part. All other words go through its whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("this vocabulary isn't split into lower-case words")
        self.parts_of = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.letter = {b: c for c, b in byte_letters().items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.parts: dict[str, bytes] = {}
        self.cache: dict[bool, dict[str, bytes]] = {True: {"": b""}, False: {"": b""}}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            letters = part if part.isascii() and part.isprintable() else "".join(map(self.letter.__getitem__, part.encode("utf-8")))
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.parts) >= CACHED_PARTS:
                self.parts.clear()
            if len(part) <= LONGEST_CACHED:
                self.parts[part] = found
        return found

    def _plain_word(self, word: str) -> bytes:
        """Ids of a word of lower-case Latin-1 letters and other characters."""
        if word.isalpha():
            return self._part(word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join(map(self._part, self.parts_of(word)))

    def _any_word(self, word: str) -> bytes:
        if self._is_plain(word):
            return self._plain_word(word.lower())
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _is_plain(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def all(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, as unsigned 32-bit little-endian numbers; none for a null text."""
        split: list[tuple[bool, list[str]]] = []
        new: dict[bool, set[str]] = {True: set(), False: set()}
        for text in texts:
            text = text or ""
            plain = self._is_plain(text)
            words = (text.lower() if plain else text).replace("\n", " ").split(" ")
            new[plain].update(words)
            split.append((plain, words))
        for plain, words in new.items():
            if len(self.cache[plain]) > CACHED_WORDS:
                self.cache[plain] = {"": b""}
            words.difference_update(self.cache[plain])
            learn = self._plain_word if plain else self._any_word
            self.cache[plain].update({word: learn(word) for word in words})
        out = [b"".join(map(self.cache[plain].__getitem__, words)) for plain, words in split]
        for plain, words in new.items():
            for word in [w for w in words if len(w) > LONGEST_CACHED]:
                del self.cache[plain][word]
        return out


class SharedTokenizer:
    """A tokenizer that is sent as its file and made once in each worker.

    Workers keep what is broadcast, so one tokenizer and one bounded cache serve all tasks of a worker, instead of a new one
    beside what is left of the last one's.
    """

    def __init__(self, tokenizer_json: str):
        self.spec, self.made = tokenizer_json, None

    def __getstate__(self) -> dict:
        return {"spec": self.spec, "made": None}

    def get(self) -> WordTokenizer:
        if self.made is None:
            self.made = WordTokenizer(self.spec)
        return self.made
