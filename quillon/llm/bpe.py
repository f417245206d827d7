"""BPE by a tokenization automaton.

The automaton reads and writes tokens.  It starts as one state with an arc for
every base symbol.  Each merge (a, b), in order of rank, adds one gadget: the
target of a's arcs is copied without its b arc, a's arcs lead to the copy, and
every state with an a arc gets an ab arc to where a, b led before.  What it
accepts are exactly the token sequences that the merges produce.  A state is
kept as the state it copies, the arc it lacks and its time of birth, so 48,894
merges take a few arrays.

Encoding walks the one accepted path that spells a pre-split word, arc by arc,
through a transition table that is filled as arcs are first asked for.  Decoding
emits the labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import pick, slices, trim

END = "</w>"
#: A word's last symbol is moved by this, as base symbols that end a word are symbols of their own.
LAST = 0xE000
#: White space as the vocabulary's patterns mean it.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Code points on which every Unicode version agrees about letters, numbers, case and composition.
SETTLED = f"\x00-\u0557\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bf"
UNSETTLED = re.compile(f"[^{SETTLED}]")
#: Numbers among the settled code points that ``\\d`` leaves out.
OTHER_NUMBERS = "\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"{CONTRACTIONS}|[^\W\d_{OTHER_NUMBERS}]+|[\d{OTHER_NUMBERS}]|(?:[^\w{WHITE}]|_)+")
SPACES = re.compile(f"[{WHITE}]+")
#: str.split() also splits on these.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTES = byte_symbols()
BYTE_OF = {c: b for b, c in enumerate(BYTES)}
VISIBLE = dict(enumerate(BYTES))


def normalized(text: str) -> str:
    """NFC, then lower case by character, for settled text; white space needs no change, as words never hold any."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # a final sigma is not told apart


def split_spaces(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [x for x in SPACES.split(text) if x]
    return text.split()


def symbols(piece: str) -> str:
    """One character for each byte, the last one marked."""
    chars = piece.encode().decode("latin-1").translate(VISIBLE)
    return chars[:-1] + chr(LAST + ord(chars[-1]))


class Splitter:
    """Cuts text into the vocabulary's words: first at white space, then by its pattern."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        strings = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.special_re = re.compile(f"({strings})") if strings else None

    def parts(self, text: str) -> list[str]:
        """Alternately text and special strings."""
        return self.special_re.split(text) if "<|" in text and self.special_re else [text]

    def runs(self, part: str) -> list[str]:
        """What lies between white space, normalized unless some code point is unsettled."""
        if not part.isascii() and UNSETTLED.search(part):
            return split_spaces(part)
        return split_spaces(normalized(part))

    def words(self, run: str) -> list[str]:
        """The words of one run; unsettled code points go by the tables of the tokenizer library."""
        if run.isascii() or not UNSETTLED.search(run):
            return SPLIT.findall(normalized(run))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return [bytes(BYTE_OF[c] for c in word).decode() for word, _ in found]


class Automaton:
    """The token automaton of one vocabulary file, and its transition table over symbols."""

    #: Arcs looked up and kept; more are looked up anew.
    MOST_ARCS = 400_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.label = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label |= {i: t for t, i in self.special.items()}
        size = len(vocab)
        self.created, self.left = [0] * size, [0] * size
        self.target = [0] * size
        self.base, self.owner, self.birth = [0], [-1], [0]
        self.chain: dict[int, list[int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in vocab.items():
            self._spell(token, i)
        self.lengths = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.table: dict[int, int] = {}

    def _gadget(self, time: int, a: int, b: int, ab: int) -> None:
        copied, after = self.target[a], self.target[b]
        self.base.append(copied)
        self.owner.append(a)
        self.birth.append(time)
        self.merged[a, b] = time
        self.chain.setdefault(a, []).append(len(self.base) - 1)
        self.target[ab], self.created[ab], self.left[ab] = after, time, a
        self.target[a] = len(self.base) - 1

    def _spell(self, token: str, i: int) -> None:
        if token.endswith(END) and token != END:
            token = token[: -len(END)]
            token = token[:-1] + chr(LAST + ord(token[-1]))
        node = 0
        for c in token:
            nxt = self.arcs[node].get(c)
            if nxt is None:
                nxt = self.arcs[node][c] = len(self.arcs)
                self.arcs.append({})
                self.ends.append(-1)
            node = nxt
        self.ends[node] = i

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a state has an arc for a token, by the gadgets in reverse.

        The copies made for one token a form a chain, each without one more arc;
        the chain is crossed in one step.
        """
        birth, created = self.birth, self.created
        while state:
            time = created[token]
            if birth[state] <= time:
                token = self.left[token]
                continue
            owner = self.owner[state]
            lost = self.merged.get((owner, token))
            if lost is not None and lost <= birth[state]:
                return False
            chain = self.chain[owner]
            at = bisect_right(chain, time, key=birth.__getitem__)
            state = chain[at - 1] if at else self.base[chain[0]]
        return True

    def arc(self, state: int, token: int) -> int:
        """The transition table: the state a token leads to, or -1."""
        key = state << 17 | token
        to = self.table.get(key)
        if to is None:
            to = self.target[token] if self.has_arc(state, token) else -1
            if len(self.table) < self.MOST_ARCS:
                self.table[key] = to
        return to

    def encode_word(self, piece: str) -> list[int]:
        """The labels along the one path of the automaton that spells the word.

        Every prefix of the word has one path too, so the token that ends at a
        symbol is settled as soon as an arc for it is found.
        """
        word = symbols(piece)
        n = len(word)
        ending, states = [-1] * (n + 1), [0] * (n + 1)
        arcs, ends, table = self.arcs, self.ends, self.table
        for j in range(n):
            node, state = 0, states[j]
            for i in range(j, n):
                node = arcs[node].get(word[i])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and ending[i + 1] < 0:
                    to = table.get(state << 17 | token)
                    if to is None:
                        to = self.arc(state, token)
                    if to >= 0:
                        ending[i + 1], states[i + 1] = token, to
        ids, lengths = [], self.lengths
        while n:
            ids.append(ending[n])
            n -= lengths[ending[n]]
        return ids[::-1]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class Memo(dict):
    """Results by key, in two generations of ``most`` each; keys in use come over from the old one, the rest go with it."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) < self.most:
            self[key] = out
        return out

    def renew(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts to ids and decodes ids by the labels of their arcs."""

    #: Runs kept in each generation; they only save time.
    MOST_RUNS = 240_000

    def __init__(self, path: str):
        trim()
        self.a, self.split = automaton(path), splitter(path)
        self.labels = {str(i): x for i, x in self.a.label.items()}
        self.runs = Memo(self._run, self.MOST_RUNS)
        gc.freeze()  # the tables live as long as the worker

    def _word(self, word: str) -> str:
        return " ".join(map(str, self.a.encode_word(word)))

    def _run(self, run: str) -> str:
        found = self.split.words(run)
        if len(found) == 1:
            return self._word(found[0])
        # a word of ASCII is a run that is not cut again
        return " ".join(map(self.runs.__getitem__ if run.isascii() else self._word, found))

    def encoded(self, text: str) -> str:
        """The ids of a text in decimal form, joined by one space."""
        self.runs.renew()
        out: list[str] = []
        for k, part in enumerate(self.split.parts(text)):
            if k % 2:
                out.append(str(self.split.special[part]))
            elif part:
                out.extend(map(self.runs.__getitem__, self.split.runs(part)))
        return " ".join(out)

    def decoded(self, ids: list[str]) -> str:
        """The labels of the arcs of ids in decimal form."""
        return " ".join(map(self.labels.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encoded(text).split()))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.a.label[i] for i in ids if i in self.a.label)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every whole text; null counts as empty, which has no ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in slices(batches, 1 << 20):
            ids = [np.fromstring(x, np.int32, sep=" ") if x else np.zeros(0, np.int32) for x in map(e.encoded, _texts(batch))]
            edges = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids count as none."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, without building the id arrays.

    The decoded digest is that of the labels of the encoded ids.  Null texts count as empty; repeated rows and null ids stay.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in slices(batches, 1 << 20):
            n, ids_hex, text_hex = [], [], []
            for text in _texts(batch):
                decimal = e.encoded(text)
                ids = decimal.split()
                n.append(len(ids))
                ids_hex.append(sha256(decimal.encode()).hexdigest())
                text_hex.append(sha256(e.decoded(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
