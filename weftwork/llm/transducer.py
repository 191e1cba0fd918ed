"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers run one after the other. The first reads classes of characters and
emits where words start; it has 11 states, and some outputs concern the character before, so each
transition is annotated with both. A text is cut into chunks; each chunk's map from state to state
is computed for all states at once, the maps are composed by a parallel prefix scan, and then
every chunk runs from its true start state. The second reads the bytes of a word: its states are
the prefixes met so far, each known by the last token of its encoding, and each transition adds
what its byte changes in the number of tokens; a state keeps the sum of the way to it. It is compiled as prefixes
turn up. A transition needs no look at the rest of a prefix: of the tokens that end it, exactly
one fits the last token before it, that is, byte pair encoding of both gives these two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, distinct_words, small
from .vocabulary import LIMIT, Vocabulary

# Classes of characters: the letters that contractions are made of apart.
LETTER, STMD, R, V, L, E, NUMBER, OTHER, QUOTE, BLANK, SPACE = range(11)
CLASSES = 11
# States: nothing read, what was read last, a quote that starts a word (then with r, v or l), and
# the end of a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = range(11)
STATES = 11
#: Outputs: a word starts at this character; one starts at the character before.
HERE, BACK = 1, 2
CHUNK = 128
#: Prefixes that the second transducer keeps, and words.
KEPT_STATES, KEPT_WORDS = 400_000, 400_000
#: Words of more bytes than this are counted by states of their own, which are not kept.
LONG_WORD = 4096


def compile_words() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class; class + CLASSES is the first character of a text."""
    after, output = np.zeros((STATES, 2 * CLASSES), np.uint8), np.zeros((STATES, 2 * CLASSES), np.uint8)
    letters = {LETTER, STMD, R, V, L, E}
    plain = {c: IN_LETTERS for c in letters} | {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: AT_QUOTE, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}
    for state in range(STATES):
        for c in range(CLASSES):
            to, out = plain[c], HERE
            white = c in (BLANK, SPACE)
            if state == IN_LETTERS and c in letters or state == IN_NUMBERS and c == NUMBER:
                out = 0
            elif state in (IN_OTHER, AT_QUOTE) and c in (OTHER, QUOTE):
                to, out = IN_OTHER, 0
            elif state == AFTER_BLANK:
                # The last of several white characters starts a word; a blank takes on what follows.
                to, out = (plain[c], 0) if white else (IN_OTHER if c == QUOTE else plain[c], BACK)
            elif state == AFTER_SPACE:
                out = 0 if white else HERE | BACK
            elif state == AT_QUOTE and c in (STMD, R, V, L):
                to, out = {STMD: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            elif (state, c) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
                to, out = DONE, 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):
                # No contraction: the letter before starts a word of its own.
                out = BACK | (0 if c in letters else HERE)
            after[state, c], output[state, c] = to, out
            after[state, c + CLASSES] = plain[c]
            output[state, c + CLASSES] = HERE | (BACK if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    return after, output


def class_table(classes: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    table = np.full(LIMIT, OTHER, np.uint8)
    for name, c in (("letter", LETTER), ("number", NUMBER), ("space", SPACE)):
        for a, b in classes[name]:
            table[a : b + 1] = c
    for c, own in ((STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (QUOTE, "'"), (BLANK, " ")):
        table[[ord(x) for x in own]] = c
    return table


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, one a row: ``then`` after ``first``."""
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def run_chunks(after: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from START, by chunk maps and a prefix scan."""
    n = len(symbols)
    chunks = -(-n // CHUNK)
    width = after.shape[1]
    padded = np.zeros(chunks * CHUNK, np.uint16)
    padded[:n] = symbols
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    table = (after.astype(np.uint16) * width).reshape(-1)  # states are kept times the width
    maps = np.tile(np.arange(STATES, dtype=np.uint16) * width, (chunks, 1)).T.copy()
    for t in range(CHUNK):
        maps = table[maps + steps[t]]
    scan = (maps.T // width).astype(np.uint8)
    hop = 1
    while hop < chunks:
        scan[hop:] = compose(scan[:-hop], scan[hop:])
        hop *= 2
    state = np.full(chunks, START * width, np.uint16)
    state[1:] = scan[:-1, START].astype(np.uint16) * width
    before = np.empty((CHUNK, chunks), np.uint16)
    for t in range(CHUNK):
        before[t] = state
        state = table[state + steps[t]]
    return before.T.reshape(-1)[:n] // width


class WordCounter:
    """The second transducer: tokens of a word, from its bytes."""

    def __init__(self, vocabulary: Vocabulary):
        special = set(vocabulary.specials.values())
        self.ids = {t: i for i, t in enumerate(vocabulary.token_bytes) if i not in special}
        #: All ends of tokens: going back from a place in a word, where to stop; by each the token that it is, or -1.
        self.ends = dict.fromkeys((t[i:] for t in self.ids for i in range(1, len(t))), -1) | self.ids
        self.size = [len(t) for t in vocabulary.token_bytes]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b, c) in enumerate(vocabulary.merges.tolist()):
            self.rank[a, b], self.parts[c], self.made[c] = r, (a, b), r
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        if len(self.fits) > KEPT_STATES:
            self.fits.clear()
        #: By state and byte the next state; by state its prefix's last token, tokens, and parent.
        self.step: dict[int, int] = {}
        self.last, self.tokens, self.parent = [-1], [0], [0]

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether a text that is token a, then token b, is encoded as these two."""
        found = self.fits.get((a, b))
        if found is None:
            rank = self.rank.get((a, b))
            found = self.fits[a, b] = rank is None and self._apart(a, b)
        return found

    def _apart(self, x: int, y: int) -> bool:
        """Whether no merge across the border of x and y comes before both are whole. Their merges
        are undone, latest first; at each step the two parts at the border were neighbours until
        one of them was taken up, at ``until_x`` or ``until_y``. At equal ranks the left one goes
        first."""
        until_x = until_y = 1 << 60
        while True:
            left, right = self.made.get(x, -1), self.made.get(y, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                until_x, x = left, self.parts[x][1]
            else:
                until_y, y = right, self.parts[y][0]
            rank = self.rank.get((x, y))
            if rank is not None and rank < until_x and rank <= until_y:
                return False

    def count(self, word: bytes) -> int:
        if len(word) > LONG_WORD:
            return self._count_long(word)
        step, state = self.step.get, 0
        for at, byte in enumerate(word):
            to = step(state << 8 | byte)
            if to is None:
                return self._compile(word, at, state)
            state = to
        return self.tokens[state]

    def _compile(self, word: bytes, at: int, state: int) -> int:
        """Adds the states of the prefixes of ``word`` from ``at`` bytes on."""
        if len(self.last) > KEPT_STATES:
            self.reset()
            at = state = 0
        last, tokens, parent = self.last, self.tokens, self.parent
        path = [state]
        while path[-1]:
            path.append(parent[path[-1]])
        path.reverse()
        before = [last[p] for p in path]
        for end in range(at + 1, len(word) + 1):
            token, start = self._token(word, end, before)
            before.append(token)
            to = len(last)
            last.append(token), tokens.append(tokens[path[start]] + 1), parent.append(state)
            self.step[state << 8 | word[end - 1]] = to
            state = to
            path.append(to)
        return tokens[state]

    def _count_long(self, word: bytes) -> int:
        """As ``count``, with the states of this word alone: they are not kept."""
        last, tokens = [-1], [0]
        for end in range(1, len(word) + 1):
            token, start = self._token(word, end, last)
            last.append(token)
            tokens.append(tokens[start] + 1)
        return tokens[-1]

    def _token(self, word: bytes, end: int, last: list[int]) -> tuple[int, int]:
        """(last token of the encoding of word[:end], where it starts); ``last``: those of shorter prefixes.
        Going back from the end, what is no end of any token is not looked at."""
        ends, fits, start, found = self.ends.get, self.fits.get, end - 1, []
        while start >= 0:
            token = ends(word[start:end])
            if token is None:
                break
            if token >= 0:
                found.append((start, token))
            start -= 1
        for start, token in reversed(found):
            if start == 0:
                fit = True
            else:
                fit = fits((last[start], token))
                if fit is None:
                    fit = self.pair_fits(last[start], token)
            if fit and self._whole(token):
                return token, start
        raise ValueError("a byte is no token")

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        found = self.whole.get(token)
        if found is None:
            a, b = self.parts.get(token, (-1, -1))
            found = self.whole[token] = a < 0 or self._whole(a) and self._whole(b) and self._apart(a, b)
        return found


class TextCounter:
    """Tokens of many texts at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.after, self.output = compile_words()
        self.flat_output = self.output.reshape(-1)
        self.table = class_table(vocabulary.classes)
        self.words = WordCounter(vocabulary)
        specials = sorted((s.encode() for s in vocabulary.specials if s), key=len, reverse=True)
        self.specials = re.compile(b"|".join(map(re.escape, specials))) if specials else None
        self.known: dict[bytes, int] = {}

    def _segments(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of stretches of plain or special text, which of them are special): the leftmost special
        string, of those that start there the longest, then from its end on; none across texts."""
        found: list[int] = []
        if self.specials:
            data = raw.tobytes()
            search = self.specials.search
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()) if search(data) else ():
                while m := search(data, i, j):
                    i = m.end()
                    found += m.span()
        bounds = np.array(found, np.int64)
        starts = np.unique(np.concatenate([at, bounds]))
        return starts, np.isin(starts[:-1], bounds[::2])

    def counts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text; ``at``: where the UTF-8 bytes of each start."""
        out = np.zeros(len(at) - 1, np.int64)
        if not len(raw):
            return out
        starts, special = self._segments(raw, at)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        symbols = self.table[points].astype(np.uint16)
        symbols[np.searchsorted(lead, starts[:-1])] += CLASSES
        emitted = self.flat_output[run_chunks(self.after, symbols) * (2 * CLASSES) + symbols]
        begins = (emitted & HERE) > 0
        begins[:-1] |= (emitted[1:] & BACK) > 0
        word = lead[begins]
        # The last of a text may be a quote and one letter: the letter starts a word.
        more = self._open_ends(raw, starts, word)
        if len(more):
            word = np.sort(np.concatenate([word, more]))
            word = word[np.append(True, word[1:] > word[:-1])]
        inside = special[np.searchsorted(starts, word, "right") - 1]
        end = np.append(word[1:], len(raw))
        plain, plain_end = word[~inside], end[~inside]
        which, _, distinct = distinct_words(raw, plain, plain_end)
        known, count = self.known, self.words.count
        if len(known) + len(distinct) > KEPT_WORDS:
            known.clear()
        tokens = np.empty(len(distinct), np.int64)
        for i, w in enumerate(distinct.to_pylist()):
            n = known.get(w)
            if n is None:
                n = count(w)
                if len(w) <= 64:
                    known[w] = n
            tokens[i] = n
        row = np.searchsorted(at, plain, "right") - 1
        out += np.bincount(row, tokens[which], len(out)).astype(np.int64)
        marks = starts[:-1][special]
        out += np.bincount(np.searchsorted(at, marks, "right") - 1, minlength=len(out))
        return out

    def _open_ends(self, raw: np.ndarray, starts: np.ndarray, word: np.ndarray) -> np.ndarray:
        ends = starts[1:]
        ends = ends[ends >= 2]
        ends = ends[(raw[ends - 2] == ord("'")) & np.isin(raw[ends - 1], np.frombuffer(b"rvl", np.uint8))]
        at = np.searchsorted(word, ends - 2)
        return ends[np.append(word, -1)[at] == ends - 2] - 1


SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether it has more than ``limit`` tokens.

    Special strings in a text count as their one token, as the tokenizer's library has it. A null
    text is empty. doc_id may be null or repeated: one row for each row. Extra columns are ignored;
    no rows give no rows. ``path``: a .json tokenizer file, read on the driver.
    """
    tables = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TextCounter(tables.value)
        for batch in small(batches, 1):
            raw, at = buffers(batch.column(1))
            n = counter.counts(raw, at)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
