"""Token counts by a compiled finite-state tokenizer.

The vocabulary's automaton is determinized over symbols into a transducer: a
state holds every open arc with the tokens emitted since it left, and a
transition carries the number of tokens that it emits in sum.  The end of a word
returns the transducer to its start, so a word maps the start to itself and to
one number.  The symbols of a long text are cut into chunks anywhere, inside
words too.  Each chunk becomes a map from the state before it to the state after
it and the tokens emitted, and the maps compose by a prefix scan.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.bpe import LAST, Automaton, Memo, automaton, default_vocabulary, splitter, symbols
from quillon.llm.common import pick, slices


class Transducer:
    """The determinized automaton, compiled as far as words have asked for it.

    State 0 is the start.  ``table[state][symbol]`` is (next state, emitted).
    """

    #: States kept before the table starts anew; it only saves time.
    MOST_STATES = 80_000

    def __init__(self, source: Automaton):
        self.source, self.epoch = source, 0
        self.reset()

    def reset(self) -> None:
        self.epoch += 1
        self.table: list[dict[str, tuple[int, int]]] = [{}]
        self.open: list[tuple[tuple[int, int, int], ...]] = [((0, 0, 0),)]
        self.known = {self.open[0]: 0}

    def compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition of a state: open arcs move on by the symbol, and the one token that ends here sets the emitted count."""
        arcs, ends, source = self.source.arcs, self.source.ends, self.source
        emitted, target, opened = 0, -1, []
        for node, left, since in self.open[state]:
            child = arcs[node].get(symbol)
            if child is None:
                continue
            token = ends[child]
            if token >= 0 and target < 0:
                target = source.arc(left, token)
                emitted = 1 - since
            if arcs[child]:
                opened.append((child, left, since))
        config = (*((n, s, x + emitted) for n, s, x in opened), (0, target, 0))
        nxt = self.known.get(config)
        if nxt is None:
            nxt = self.known[config] = len(self.open)
            self.open.append(config)
            self.table.append({})
        out = self.table[state][symbol] = (nxt, emitted)
        return out

    def count(self, word: str) -> int:
        """The tokens emitted along the path of a word's symbols."""
        if len(self.open) > self.MOST_STATES:
            self.reset()
        state, total, table = 0, 0, self.table
        for c in word:
            hit = table[state].get(c)
            if hit is None:
                hit = self.compile(state, c)
            state, emitted = hit
            total += emitted
        return total


    def state(self, config: Config) -> int:
        """The number of a state given by its open arcs."""
        found = self.known.get(config)
        if found is None:
            found = self.known[config] = len(self.open)
            self.open.append(config)
            self.table.append({})
        return found

    def run(self, config: Config, symbols_: str, trail: Trail | None = None) -> tuple[Config, int]:
        """The state after some symbols, and the tokens emitted.

        A trail keeps the states of the first run over these symbols.  A later
        run from another state stops as soon as it is in the same state at the
        same place: the rest is known.
        """
        state, total, table = self.state(config), 0, self.table
        known = trail.states if trail and trail.epoch == self.epoch else None
        states, sums = [], []
        for i, c in enumerate(symbols_):
            if known is not None and known[i] == state:
                return trail.end, total + trail.sums[-1] - (trail.sums[i - 1] if i else 0)
            hit = table[state].get(c)
            if hit is None:
                hit = self.compile(state, c)
            if trail is not None and known is None:
                states.append(state)
                sums.append(total + hit[1])
            state, emitted = hit
            total += emitted
        end = START if symbols_ and ord(symbols_[-1]) >= LAST else self.open[state]
        if trail is not None and known is None:
            trail.epoch, trail.states, trail.sums, trail.end = self.epoch, states, sums, end
        return end, total


#: The open arcs of a state: trie node, automaton state where the arc left, tokens emitted since.
Config = tuple[tuple[int, int, int], ...]
START: Config = ((0, 0, 0),)


class Trail:
    """States and sums along the first run over a chunk."""

    def __init__(self) -> None:
        self.epoch, self.states, self.sums, self.end = -1, [], [], START


class StateMap:
    """From the state before a stretch of symbols to the state after it and the tokens emitted.

    Kept for the states asked for so far.  ``make`` works out one more.
    """

    def __init__(self, make: Callable[[Config], tuple[Config, int]]):
        self.make, self.known = make, {START: make(START)}

    def __call__(self, state: Config) -> tuple[Config, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self.make(state)
        return found


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of two neighbouring stretches; associative."""

    def both(state: Config) -> tuple[Config, int]:
        middle, n = a(state)
        end, m = b(middle)
        return end, n + m

    return StateMap(both)


def scan(maps: list[StateMap]) -> list[StateMap]:
    """All prefixes of a row of maps, composed in pairs."""
    if len(maps) < 2:
        return maps
    pairs = scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i]))
    return out


class Chunk:
    """A stretch of symbols: the rest of a word, whole words by their tokens in sum, and the start of a word (null: the chunk ends inside the first)."""

    def __init__(self, head: str = ""):
        self.head, self.inside, self.tail = head, 0, ""

    def map(self, transducer: Transducer) -> StateMap:
        if len(transducer.open) > transducer.MOST_STATES:
            transducer.reset()
        if self.tail is None:
            trail = Trail()
            return StateMap(lambda state: transducer.run(state, self.head, trail))
        end, after = transducer.run(START, self.tail)

        def make(state: Config) -> tuple[Config, int]:
            return end, transducer.run(state, self.head)[1] + self.inside + after

        return StateMap(make)


class Counter:
    """Counts the tokens of texts."""

    #: Symbols of a chunk.
    CHUNK = 1 << 16
    MOST_RUNS, MOST_WORDS = 200_000, 100_000

    def __init__(self, path: str):
        self.transducer, self.split = Transducer(automaton(path)), splitter(path)
        self.words = Memo(lambda w: self.transducer.count(symbols(w)), self.MOST_WORDS)
        self.runs = Memo(lambda run: sum(map(self.words.__getitem__, self.split.words(run))), self.MOST_RUNS)
        gc.freeze()

    def whole(self, text: str) -> int:
        """Tokens of a text whose words are looked up one by one."""
        total = 0
        for k, part in enumerate(self.split.parts(text)):
            total += 1 if k % 2 else sum(map(self.runs.__getitem__, self.split.runs(part))) if part else 0
        return total

    def chunks(self, text: str) -> list[Chunk]:
        """The symbols of a text, cut into chunks of CHUNK symbols; a special string is a word of one token."""
        out = [Chunk()]
        room = self.CHUNK
        for k, part in enumerate(self.split.parts(text)):
            if k % 2:
                out[-1].inside += 1
                continue
            for run in self.split.runs(part) if part else ():
                size = len(run) if run.isascii() else 4 * len(run)
                if size <= room:
                    out[-1].inside += self.runs[run]
                    room -= size
                    continue
                for word in self.split.words(run):
                    left = symbols(word)
                    if len(left) <= room:
                        out[-1].inside += self.words[word] if len(left) < 100 else self.transducer.count(left)
                        room -= len(left)
                        continue
                    out[-1].tail, left = left[:room], left[room:]
                    while len(left) > self.CHUNK:
                        out.append(Chunk(left[: self.CHUNK]))
                        out[-1].tail, left = None, left[self.CHUNK :]
                    out.append(Chunk(left))
                    room = self.CHUNK - len(left)
        return out

    def count(self, text: str) -> int:
        self.words.renew()
        self.runs.renew()
        if len(text) <= self.CHUNK:
            return self.whole(text)
        return scan([c.map(self.transducer) for c in self.chunks(text)])[-1](START)[1]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null and empty texts have no bytes and no tokens.  Null ids and repeated
    rows stay as they are; an empty table gives no rows.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches, 4 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
