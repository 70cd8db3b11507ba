"""Public tokenizer files: found through the package that installs them, never copied."""

from __future__ import annotations

import json
import os

import numpy as np
import regex

from ._bpe import Merges, merge_all

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Chunks of these characters are stable under NFC, and every version of Unicode classes them alike.
PLAIN_LINES = regex.compile(r"(?m)^(?![^\n]*<\|)[\x21-\x7eÀ-įı-ňŊ-ž]{1,64}$")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of a word-level BPE file of ``tokenizers`` whose pieces never cross white space, memoised by word.

    Texts are split at the ASCII white space that the tokenizer drops anyway. New words of plain characters are
    merged together in numpy; all others, and very long ones, go through the tokenizer itself. The memo is emptied
    when it holds ``most`` words.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.most = most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        columns = [[vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], list(range(len(pairs))), [vocab[a + b] for a, b in pairs]]
        self.merges = Merges(*(np.array(c, np.int64) for c in columns))
        letters = _byte_letters()
        self.inner = np.array([vocab.get(x, -1) for x in letters], np.int32)
        self.last = np.array([vocab.get(x + suffix, -1) for x in letters], np.int32)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")

    def _learn(self, words: list[bytes]) -> None:
        plain = PLAIN_LINES.findall(b"\n".join(words).decode("utf-8", "replace"))
        # The parts of all plain words in one string: a zero byte between parts, a line end after each word.
        parts = self.split.findall("\n".join(plain).lower() + "\n") if plain else []
        data = np.frombuffer("\0".join(parts).encode(), np.uint8)
        if len(data):
            border = np.flatnonzero(data == 0)
            start, end = np.concatenate([[0], border + 1]), np.append(border, len(data))
            line = data[start] == 10
            word, start, end = (np.cumsum(line) - line)[~line], start[~line], end[~line]
            symbols = self.inner[data]
            symbols[end - 1] = self.last[data[end - 1]]
            solid = (data != 0) & (data != 10)
            ids, cut = merge_all(symbols[solid], np.concatenate([[0], np.cumsum(end - start)]), self.merges)
            coded, at = ids.astype("<u4").tobytes(), (4 * cut[np.searchsorted(word, np.arange(len(plain) + 1))]).tolist()
            self.memo.update(zip([w.encode() for w in plain], [coded[a:b] for a, b in zip(at, at[1:])]))
        other = [w for w in words if w not in self.memo]
        if other:
            for w, c in zip(other, self.model.encode_batch([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)):
                self.memo[w] = np.array(c.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of texts in UTF-8."""
        # A-Z are lower-cased first only where no added token, which is matched before lower-casing, can occur.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        new = set().union(*split) - self.memo.keys()
        if new:
            self._learn(list(new))
        get = self.memo.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > 64:
                del self.memo[w]
        return out
