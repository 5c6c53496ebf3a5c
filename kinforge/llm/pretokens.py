"""Exact token ids and counts through bounded caches of pre-tokens.

A text made of the characters in PLAIN splits the same way here as in the tokenizer library, whatever Unicode version
the library has; all other texts, and texts that may hold a special string, go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose classes and case mappings are settled: ASCII without controls, Latin-1 and Latin Extended-A without U+0130.
UNSURE = re.compile("[^\t\n\r -~¡-įı-ſ]")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
BLANK = "\t\n\r "
#: The byte-level pre-tokenizer's split, over PLAIN characters.
BYTE_LEVEL = re.compile(f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: The word-end pre-tokenizer's split, over lower-cased PLAIN characters without blanks.
WORD_LEVEL = re.compile(f"[{LETTER}]+|[{NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{BLANK}{LETTER}{NUMBER}]+")
SPACED_WORD = re.compile(f" [{LETTER}]+")
#: Entries that a worker's cache may hold, and how many it remembers as seen once: a pre-token is kept from its second miss on.
#: They bound memory and never touch results.
CACHE_ENTRIES, ONCE_ENTRIES = 150_000, 150_000
#: Words that are encoded in one call, whose result takes some hundred bytes a token.
TOGETHER = 20_000


class Recent(dict):
    """Values of pre-tokens that were missed at least twice, up to CACHE_ENTRIES of them."""

    def __init__(self):
        super().__init__()
        self.once: set[int] = set()

    def offer(self, found: dict) -> None:
        room = CACHE_ENTRIES - len(self)
        if room <= 0:
            return
        once = self.once
        for word, value in found.items():
            if (mark := hash(word)) in once:
                self[word] = value
            else:
                once.add(mark)
        if len(once) > ONCE_ENTRIES:
            once.clear()


@lru_cache(maxsize=4)
def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    return "<|" not in text and (text.isascii() and text.isprintable() or not UNSURE.search(text))


class Lengths:
    """Token counts of whole texts under a byte-level tokenizer: a frequent tier that is given, a recent tier that is bounded."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.tokenizer, self.frequent, self.recent = load(path), frequent or {}, recent(path)

    def _learn(self, missing: list[str]) -> dict[str, int]:
        words = [x for x in missing if SPACED_WORD.fullmatch(x)]
        rest = [x for x in missing if not SPACED_WORD.fullmatch(x)]
        found = {}
        if words:
            per_word = np.bincount(np.array(self.tokenizer.encode("".join(words), add_special_tokens=False).word_ids, dtype=np.int64), minlength=len(words))
            if len(per_word) == len(words):
                found.update(zip(words, per_word.tolist(), strict=True))
            else:
                rest += words
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[x] = len(e.ids)
        return found

    def counts(self, texts: list[str]) -> list[int]:
        out, waiting, missing = [0] * len(texts), [], set()
        frequent, recent = self.frequent, self.recent
        for i, text in enumerate(texts):
            if not text:
                continue
            if not plain(text):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            total, lost = 0, []
            for x in BYTE_LEVEL.findall(text):
                n = frequent.get(x) or recent.get(x)
                if n:
                    total += n
                else:
                    lost.append(x)
            out[i] = total
            if lost:
                waiting.append((i, lost))
                missing.update(lost)
        if missing:
            found = self._learn(list(missing))
            for i, lost in waiting:
                out[i] += sum(map(found.__getitem__, lost))
            recent.offer(found)
        return out


class Ids:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, under the lower-casing word-end tokenizer."""

    def __init__(self, path: str):
        self.tokenizer, self.cache = load(path), Recent()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """White space always ends a pre-token, so words of letters are encoded as one text and cut after their last tokens.

        All else is put together from its pre-tokens: words, and the few marks, digits and contractions that occur.
        """
        found, cache, marks, words, mixed = {}, self.cache, self.marks, {}, []
        for x in missing:
            if x.isalpha():
                words[x] = None
            else:
                parts = WORD_LEVEL.findall(x)
                mixed.append((x, parts))
                for part in parts:
                    if part.isalpha():
                        if part not in cache:
                            words[part] = None
                    elif part not in marks:
                        if len(marks) > CACHE_ENTRIES:
                            marks.clear()
                        marks[part] = self._whole(part)
        every = list(words)
        for at in range(0, len(every), TOGETHER):
            some = every[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some):
                ids = ids.tobytes()
                found.update((x, ids[a:b]) for x, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True))
            else:
                found.update((x, self._whole(x)) for x in some)
        for x, parts in mixed:
            found[x] = b"".join([found.get(y) or cache.get(y) or marks.get(y) or self._whole(y) for y in parts])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Each distinct word of the batch is looked up once."""
        out: list[bytes] = [b""] * len(texts)
        places = [i for i, text in enumerate(texts) if plain(text)]
        for i in {*range(len(texts))}.difference(places):
            out[i] = self._whole(texts[i])
        if not places:
            return out
        words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([texts[i] for i in places], pa.large_string())))
        coded = words.flatten().dictionary_encode()
        uniques, cache = coded.dictionary.to_pylist(), self.cache
        values = list(map(cache.get, uniques))
        gaps = [k for k, x in enumerate(values) if x is None]
        if gaps:
            found = self._learn([uniques[k] for k in gaps])
            for k in gaps:
                values[k] = found[uniques[k]]
            cache.offer(found)
        spread = pa.array(values, pa.large_binary()).take(coded.indices)
        if not len(spread):
            return out
        ends = np.frombuffer(spread.buffers()[1], dtype=np.int64)[: len(spread) + 1]
        data = memoryview(spread.buffers()[2] or b"")
        cuts = ends[words.offsets.to_numpy()].tolist()
        for i, a, b in zip(places, cuts, cuts[1:], strict=False):
            out[i] = bytes(data[a:b])
        return out


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    """The worker's own encoder: its cache outlives a task, so that later tasks find the words of earlier ones."""
    return Ids(path)


@lru_cache(maxsize=2)
def recent(path: str) -> Recent:
    """The worker's own recent tier of lengths, which outlives a task."""
    return Recent()
