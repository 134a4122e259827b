"""Words of texts by number, and their tokens in one array: encode a word once, look it up after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words put together at once.
WORDS = 250_000


class Words(dict):
    """Number of each word; a new word gets the next number."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordStore:
    """Encodes texts word by word. Subclasses cut texts and encode new words."""

    #: Encoded words a worker remembers, and their characters.
    remembered, characters_remembered = 300_000, 8_000_000

    def __init__(self) -> None:
        self.forget()

    def cut(self, text: str) -> Iterator[list[str]]:
        """The text's words, in lists of bounded length."""
        raise NotImplementedError

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all the words, one behind the other, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        self.words = Words()
        self.characters = 0
        self.tokens = np.empty(0, dtype="<u4")  # of all known words
        self.starts, self.sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def numbers(self, text: str) -> np.ndarray:
        known = self.words.__getitem__
        parts = [np.array(list(map(known, words)), dtype=np.int32) for words in self.cut(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, dtype=np.int32), *parts])

    def learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        self.characters += sum(map(len, new))
        tokens, sizes = self.encode(new)
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.tokens = np.concatenate([self.tokens, tokens.astype("<u4")])

    def put_together(self, words: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            sizes = self.sizes[some]
            shift = self.starts[some] - (np.cumsum(sizes) - sizes)
            out.append(self.tokens[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out)

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.remembered or self.characters > self.characters_remembered:
            self.forget()
        split = list(map(self.numbers, texts))
        self.learn()
        return list(map(self.put_together, split))


def blocks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most so many characters together, if no text alone has more."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
