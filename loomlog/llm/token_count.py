"""Token counts by a finite-state transducer compiled from a byte-level pair encoding.

The library's encoding of a text is a lexer followed by merges inside each lexed word. Both are finite-state:

* The lexer's state is which kind of run it is in; a white-space run holds its last character back, because whether
  that joins the next word depends on what follows, and so does an apostrophe that may begin a contraction.
* Inside a word, the encoding of a prefix ends in exactly one token. A token t can end the encoding of the prefix if
  the encoding of the prefix before t ends in a token a such that the pair (a, t) encodes to itself. So the state
  needs only, for each place from which a token may still grow, the last token of the encoding up to that place and
  how many fewer tokens it has.

A transition is annotated with the number of tokens by which the encoding's length changes (it may be negative, when
tokens merge). The sum of the annotations along a text is its count. States and transitions are made when first met and
kept in a table over states and characters, as in lazy determinisation; when the table is full it is begun anew.

Texts of a batch are one stream, cut into chunks at synchronising places: after a text's end, and after white space
that follows a character that is none. There, the state does not depend on what came before, so a chunk's state map is
constant, and composing chunk maps adds their counts: a prefix sum over the chunks, read at the texts' ends. The chunks
advance through the table side by side, one array operation for a character of all of them.

Defined results for odd input: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside a text
are one token each, as by the library's default; rows with a null or repeated id are counted each; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import library

#: Fixed values of the lexer: the contractions it splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

LETTER, NUMBER, OTHER, SPACE, START, QUOTE = range(6)
END = 0x110000


class Merges:
    """The pair encoding inside a word, as a lazily made transducer over bytes."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.prefixes = {t[:n] for t in tokens for n in range(1, len(t))}  # what can still grow
        self.tokens = tokens
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}
        self.whole: dict[bytes, bool] = {}
        self.pair: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        first = ((b"", None, 0),)
        self.states, self.ids = [first], {first: 0}
        self.shared: dict[tuple, tuple] = {}  # states hold the same places over and over

    def encode(self, word: bytes) -> list[bytes]:
        """The encoding itself, by the definition: the lowest-ranked pair merges first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, i = (parts[best], parts[best + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, before: bytes | None, token: bytes) -> bool:
        if before is None:
            if (known := self.whole.get(token)) is None:
                known = self.whole[token] = self.encode(token) == [token]
            return known
        if (known := self.pair.get((before, token))) is None:
            known = self.pair[before, token] = self.stable(before, token)
        return known

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of ``a + b`` is the pair. Merges happen in the order of their ranks, so undo the later
        of the two tokens' last merges, again and again: at each stage the touching halves must not merge earlier than
        what has been undone (on the left side, at equal ranks, the left pair goes first)."""
        limit = 1 << 30
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or made_a is not None and made_a[0] > made_b[0]:
                limit, a = made_a[0], made_a[2]
            else:
                limit, b = made_b[0] + 1, made_b[1]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change in the number of tokens."""
        b, grown, change, last = bytes([byte]), [], None, None
        for grow, before, fewer in self.states[state]:  # longest first
            longer = grow + b
            if change is None and longer in self.tokens and self.follows(before, longer):
                change, last = 1 - fewer, longer
            if longer in self.prefixes:
                grown.append((longer, before, fewer))
        share = self.shared.setdefault
        new = tuple([share(x, x) for x in [*((g, a, fewer + change) for g, a, fewer in grown), (b"", last, 0)]])
        if (found := self.ids.get(new)) is None:
            found = self.ids[new] = len(self.states)
            self.states.append(new)
        return found, change


class Transducer:
    """Lexer and merges over characters, as one table: an entry holds the next state and the change in count."""

    ENTRIES = 32_000_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.lexer = library(path).pre_tokenizer
        self.symbol = np.full(END + 1, -1, np.int32)
        self.characters: list[int] = []
        self.kinds: list[int] = []
        self.width = 128
        self.fresh()
        self.symbol_of(END)

    def fresh(self) -> None:
        self.merges.reset()
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = np.full((1024, self.width), -1, np.int32)
        self.start = self.state((START, 0, ""))

    def state(self, key: tuple) -> int:
        if (found := self.ids.get(key)) is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.width), -1, np.int32)])
        return found

    def kind_of(self, c: str) -> int:
        """As the library's own lexer has it: the kind whose runs the character continues."""
        for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.lexer.pre_tokenize_str(probe + c)) == 1:
                return kind
        return SPACE

    def symbol_of(self, code: int) -> int:
        found = len(self.characters)
        self.characters.append(code)
        self.kinds.append(SPACE if code == END or 0xD800 <= code < 0xE000 else self.kind_of(chr(code)))
        self.symbol[code] = found
        if found >= self.width:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.width *= 2
        return found

    def run(self, kind: int, inner: int, word: str) -> tuple[tuple, int]:
        change = 0
        for byte in word.encode("utf-8"):
            inner, d = self.merges.step(inner, byte)
            change += d
        return (kind, inner, ""), change

    def begin(self, symbol: int) -> tuple[tuple, int]:
        """A character at the start of a word."""
        c, kind = chr(self.characters[symbol]), self.kinds[symbol]
        if kind == SPACE:
            return (SPACE, 0, c), 0
        if c == "'":
            return (QUOTE, 0, c), 0
        return self.run(kind, 0, c)

    def advance(self, key: tuple, symbol: int) -> tuple[tuple, int]:
        mode, inner, held = key
        if self.characters[symbol] == END:
            return (START, 0, ""), self.run(START, inner, held)[1]
        c, kind = chr(self.characters[symbol]), self.kinds[symbol]
        if mode == START:
            return self.begin(symbol)
        if mode == QUOTE:
            word = held + c
            if word in CONTRACTIONS:
                return (START, 0, ""), self.run(START, 0, word)[1]
            if any(x.startswith(word) for x in CONTRACTIONS):
                return (QUOTE, 0, word), 0
            (_, inner, _), change = self.run(OTHER, 0, "'")
            if len(held) == 1:
                if kind == OTHER:
                    key, more = self.run(OTHER, inner, c)
                else:
                    key, more = self.begin(symbol)
                return key, change + more
            key, more = self.run(LETTER, 0, held[1:])
            key, rest = self.advance(key, symbol)
            return key, change + more + rest
        if mode == SPACE:
            if kind == SPACE:
                key, change = self.run(SPACE, inner, held)
                return (SPACE, key[1], c), change
            if held == " ":
                return self.run(kind, 0, " " + c)
            change = self.run(SPACE, 0, held)[1]
            key, more = self.begin(symbol)
            return key, change + more
        return self.run(kind, inner, c) if kind == mode else self.begin(symbol)

    def fill(self, state: int, symbol: int) -> None:
        key, change = self.advance(self.states[state], symbol)
        to = self.state(key)
        self.table[state, symbol] = to << 8 | (change + 128)

    def counts(self, texts: list[str], grid: int = 256) -> np.ndarray:
        """Tokens of each text."""
        if self.table.size > self.ENTRIES:
            self.fresh()
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = [text]
            for special in self.specials:
                if special in text:
                    own = [x for y in own for x in y.split(special)]
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        sizes = np.array([len(p) for p in parts], np.int64)
        stream = np.full(int(sizes.sum()) + len(parts), END, np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(stream), bool)
        inside[ends] = False
        stream[inside] = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[stream]
        for code in np.unique(stream[symbols < 0]).tolist():
            self.symbol_of(code)
        symbols = self.symbol[stream] if (symbols < 0).any() else symbols
        kinds = np.array(self.kinds, np.int8)[symbols]
        blank = (stream == 32) | (stream == 10)
        safe = np.zeros(len(stream), bool)
        safe[1:] = blank[1:] & (kinds[:-1] != SPACE)
        safe[ends] = False
        at = np.flatnonzero(safe)
        at = at[np.unique(at // grid, return_index=True)[1]]
        cuts = np.unique(np.concatenate([at, ends])) + 1  # chunks begin after these
        starts = np.concatenate([[0], cuts[:-1]])
        entry = {END: self.start, 32: self.state((SPACE, 0, " ")), 10: self.state((SPACE, 0, "\n"))}
        before = np.concatenate([[END], stream[cuts[:-1] - 1]])
        state = np.select([before == 32, before == 10], [entry[32], entry[10]], entry[END]).astype(np.int64)
        total = self.walk(symbols, starts, cuts - starts, state)
        scanned = np.concatenate([[0], np.cumsum(total)])
        last = np.searchsorted(cuts, ends + 1)
        per_part = np.diff(np.concatenate([[0], scanned[last + 1]]))
        return extra + np.bincount(owner, weights=per_part, minlength=len(texts)).astype(np.int64)

    def walk(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], state[order]
        count = np.zeros(len(starts), np.int64)
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
        for i, n in enumerate(live.tolist()):
            if n <= 8:
                break
            symbol = symbols[starts[:n] + i]
            got = self.table[state[:n], symbol]
            if (new := np.flatnonzero(got < 0)).size:
                for s, c in set(zip(state[new].tolist(), symbol[new].tolist(), strict=True)):
                    self.fill(s, c)
                got = self.table[state[:n], symbol]
            state[:n] = got >> 8
            count[:n] += (got & 255) - 128
        else:
            i = len(live)
        for lane in range(int(live[i]) if i < len(live) else 0):  # few long chunks are left: one after the other
            s, c = int(state[lane]), 0
            for symbol in symbols[starts[lane] + i : starts[lane] + lengths[lane]].tolist():
                got = self.table[s, symbol]
                if got < 0:
                    self.fill(s, symbol)
                    got = self.table[s, symbol]
                got = int(got)
                s, c = got >> 8, c + (got & 255) - 128
            count[lane] += c
        out = np.empty_like(count)
        out[order] = count
        return out


@functools.cache
def transducer(path: str) -> Transducer:
    """One for each worker process."""
    return Transducer(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, batch_characters: int = 1_500_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            texts, tokens, at = batch.column(2).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_characters):
                    size += len(texts[end])
                    end += 1
                tokens.append(machine.counts(texts[at:end]))
                at = end
            n = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
