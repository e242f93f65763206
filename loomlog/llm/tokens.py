"""Encoding whole texts with a public tokenizer, remembering what words encode to.

Where a vocabulary drops white space and marks the ends of its words, no token crosses white space or the end of a
lexed word, so a text's ids are its words' ids in order. Texts are lower-cased, split and made distinct piece by piece
as Arrow arrays; a batch's distinct pieces are cut into words by the lexer's own pattern, read from the vocabulary's
file; and the library's model encodes new words, thousands in one call. What words encode to is remembered in a store of
bounded size, which forgets what was used longest ago, and a text's ids are gathered from there.

Which characters are letters or numbers, and which the normaliser only lower-cases, is asked of the library, one
character at a time. Texts with any other character, or with the beginning of a special token, are split at ASCII white
space, and such pieces are encoded by the whole library as they are. For a vocabulary file of another shape (other
normalisers or lexers, no mark at word ends; see ``shape``) all texts go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenizer_class() -> type:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel
    from tokenizers import Tokenizer

    return Tokenizer


@functools.cache
def library(path: str):
    return tokenizer_class().from_file(path)


def shape(spec: dict) -> str | None:
    """The pattern of the words of a vocabulary that this module can cut by itself, or None."""
    normal = spec.get("normalizer") or {}
    before = spec.get("pre_tokenizer") or {}
    steps = [s.get("type") for s in normal.get("normalizers", [])]
    cuts = before.get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c.get("type") for c in cuts] != ["Split", "ByteLevel"]:
        return None
    if normal["normalizers"][1]["pattern"] != {"Regex": r"\s+"} or normal["normalizers"][1]["content"] != " ":
        return None
    split, level, model = cuts[0], cuts[1], spec["model"]
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"] or model["ignore_merges"] or spec["post_processor"]:
        return None
    return split["pattern"].get("Regex")


Encoded = tuple[np.ndarray, np.ndarray]  # ids one after another, and how many each string has


class Store:
    """What strings encode to, by a 64-bit hash of the string (Python's, keyed by process), in a few flat arrays.
    ``learn`` encodes new strings. At most ``limit`` strings are kept between calls."""

    def __init__(self, limit: int, learn: Callable[[list[str]], Encoded]) -> None:
        self.limit, self.learn, self.clock = limit, learn, 0
        self.hashes, self.slots = np.array([hash("")], np.int64), np.zeros(1, np.int32)  # ascending, and their slots
        self.start, self.size, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.ids, self.n_ids = np.empty(1 << 16, "<u4"), 0  # slot 0, the empty string, has none

    def _room(self, names: tuple[str, ...], n: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < n:
                new = np.empty(max(n, len(old) * 5 // 4), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _forget(self) -> None:
        """Keeps the half that was used last, and the empty string."""
        self.used[0] = np.iinfo(np.int32).max
        n = len(self.slots)
        keep = np.sort(np.argsort(self.used[:n], kind="stable")[n - max(1, self.limit // 2) :])
        to = np.full(n, -1, np.int32)
        to[keep] = np.arange(len(keep))
        self.ids, sizes = self.gather(keep)
        self.n_ids = len(self.ids)
        self.used[: len(keep)], self.size[: len(keep)], self.start[: len(keep)] = self.used[keep], sizes, np.cumsum(sizes) - sizes
        slots = to[self.slots]
        self.hashes, self.slots = self.hashes[slots >= 0], slots[slots >= 0]

    def of(self, strings: list[str]) -> np.ndarray:
        """The slots of distinct strings; they hold until the next call."""
        if len(self.slots) > self.limit:
            self._forget()
        wanted = np.fromiter(map(hash, strings), np.int64, len(strings))
        at = np.searchsorted(self.hashes, wanted)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != wanted)
        if len(new):
            new = new[np.argsort(wanted[new], kind="stable")]
            ids, sizes = self.learn([strings[i] for i in new.tolist()])
            n = len(self.slots)
            total = n + len(new)
            self._room(("start", "size", "used"), total)
            self._room(("ids",), self.n_ids + len(ids))
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.size[n:total], self.start[n:total] = sizes, self.n_ids + np.cumsum(sizes) - sizes
            self.n_ids += len(ids)
            self.slots = np.insert(self.slots, at[new], np.arange(n, total, dtype=np.int32))
            self.hashes = np.insert(self.hashes, at[new], wanted[new])
            at = np.searchsorted(self.hashes, wanted)
        found = self.slots[at]
        self.clock += 1
        self.used[found] = self.clock
        return found

    def gather(self, slots: np.ndarray) -> Encoded:
        return spread(self.ids, self.start[slots], self.size[slots])


def spread(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> Encoded:
    """The runs of ``ids`` that begin at ``start`` and have ``size`` ids, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(start - ends + size, size)], size


def _bounds(size: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Where lists begin and end, in ids, if their strings have ``size`` ids."""
    return np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``batch(texts)``: each text's little-endian unsigned 32-bit ids, as bytes, without added special tokens."""

    WORDS, ODD, CHARACTERS, AT_ONCE = 1_000_000, 100_000, 3_000_000, 10_000
    #: Characters asked of the library for the pattern: ASCII and the Latin letters after it.
    LATIN = range(0x21, 0x180)

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library_, found = tokenizer_class(), shape(spec)
        rules = library_.from_str(json.dumps(spec | {"model": spec["model"] | {"vocab": {}, "merges": []}})) if found else None
        self.pattern = self._pattern(found, rules)
        if self.pattern is None:
            return
        bare = {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.model = library_.from_str(json.dumps(spec | bare))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # how the model writes bytes as characters
        self.shown = dict(zip([*shown, *(b for b in range(256) if b not in set(shown))], [*map(chr, shown), *map(chr, range(256, 512))], strict=False))
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.specials = [t["content"][:2] for t in spec["added_tokens"]]
        self.words, self.odd = Store(self.WORDS, self._words), Store(self.ODD, self._odd)

    def _pattern(self, pattern: str | None, rules: object) -> str | None:
        """The file's pattern for texts of the characters in ``self.plain``, with a group around it; ``rules``: the
        library's tokenizer without its vocabulary."""
        if pattern is None:
            return None
        lexer, normaliser = rules.pre_tokenizer, rules.normalizer
        joins = lambda a, b: len(lexer.pre_tokenize_str(a + b)) == 1
        lowered = dict(zip(map(chr, self.LATIN), pc.utf8_lower(pa.array(map(chr, self.LATIN), pa.string())).to_pylist(), strict=True))
        kept = [c for c, low in lowered.items() if normaliser.normalize_str(c) == low and low in lowered and not c.isspace()]
        low = sorted({lowered[c] for c in kept})
        letters = [c for c in low if joins("a", c)]
        numbers = [c for c in low if c not in letters and not joins("!", c)]
        quoted = lambda cs: "".join(map(re.escape, cs))
        own = pattern.replace(r"\p{L}", quoted(letters)).replace(r"\p{N}", quoted(numbers))
        if r"\p" in own:
            return None
        self.plain = re.compile(f"[{quoted(kept)}\\x20\\x09\\x0a\\x0d]*").fullmatch
        return f"({own})"

    def _words(self, new: list[str]) -> Encoded:
        """Ids of lexed words, by the model alone."""
        ids = []
        for i in range(0, len(new), self.AT_ONCE):
            own = [w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in new[i : i + self.AT_ONCE]]
            ids.append(np.array(self.model.encode(own, is_pretokenized=True, add_special_tokens=False).ids, "<u4"))
        flat = np.concatenate(ids)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary does not end its words")
        return flat, np.diff(ends, prepend=0)

    def _odd(self, new: list[str]) -> Encoded:
        got = [np.array(e.ids, "<u4") for e in library(self.path).encode_batch_fast(new, add_special_tokens=False)]
        return np.concatenate(got), np.array([len(x) for x in got], np.int64)

    def _plain(self, texts: list[str]) -> Encoded:
        """Ids of plain texts, one after another, and how many each has: the batch's distinct pieces are cut into words,
        which recur more than pieces do and are remembered."""
        lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
        split = pc.ascii_split_whitespace(lowered).cast(pa.list_(pa.large_string()))
        pieces = split.flatten().dictionary_encode()
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pieces.dictionary, self.pattern, r"\1 ")).cast(pa.list_(pa.large_string()))
        words = cut.flatten().dictionary_encode()
        ids, size = self.words.gather(self.words.of(strings(words.dictionary))[words.indices.to_numpy()])
        per_piece = np.diff(_bounds(size, cut))
        ids, size = spread(ids, (np.cumsum(per_piece) - per_piece)[index := pieces.indices.to_numpy()], per_piece[index])
        return ids, np.diff(_bounds(size, split))

    def _is_plain(self, text: str) -> bool:
        return self.plain(text) is not None and not any(s in text for s in self.specials)

    def _other(self, text: str) -> bytes:
        """A text with characters or special tokens that only the library knows."""
        own = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        ids, size = self.odd.gather(self.odd.of(list(found := dict.fromkeys(own))))
        ends = (np.cumsum(size) * 4).tolist()
        blob = ids.tobytes()
        found = {p: blob[a:b] for p, a, b in zip(found, [0, *ends[:-1]], ends, strict=True)}
        return b"".join(map(found.__getitem__, own))

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        if self.pattern is None:
            for e in library(self.path).encode_batch_fast(texts, add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            return
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < self.CHARACTERS):
                size += len(texts[end])
                end += 1
            own = texts[at:end]
            plain = list(map(self._is_plain, own))
            ids, sizes = self._plain([t for t, p in zip(own, plain, strict=True) if p])
            blob, ends = ids.tobytes(), iter((np.cumsum(sizes) * 4).tolist())
            a = 0
            for text, p in zip(own, plain, strict=True):
                if p:
                    b = next(ends)
                    yield blob[a:b]
                    a = b
                else:
                    yield self._other(text)
            at = end
        pa.default_memory_pool().release_unused()  # a worker lives long, and others share its executor

    def ids(self, text: str) -> bytes:
        return next(self.batch([text]))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
