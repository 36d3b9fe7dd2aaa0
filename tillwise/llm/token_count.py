"""Token counts by a compiled finite-state tokenizer.

The byte-pair vocabulary is compiled, transition by transition as texts need them, into a deterministic transducer
over the bytes of a word: a state holds, for every place from which a token may still reach on, the token that ends
there and its count; a transition carries the change of the token count. Texts are read in chunks. A chunk's state
map is kept in closed form: white space resets the transducer whatever the state was, so a chunk is the text before its
first space, a count, and the text after its last space; maps compose associatively and are combined by a
balanced prefix reduction.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = 1 << 16
#: Sizes at which the word memo and the transition table are emptied: they only save work.
MEMO, STATES = 400_000, 150_000
_SPACE = re.compile(r"[ \t\r\n]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """Counts the tokens of one word, given as bytes; its last byte is the symbol 256 + byte."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        letters = byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end)
            codes = [letters[c] for c in (token[:-len(end)] if last else token)]
            return tuple(codes[:-1] + [codes[-1] + 256 * last])

        self.parts: dict[int, tuple[int, ...]] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in vocab.items():
            codes = symbols(token)
            self.parts[i] = codes
            node = 0
            for c in codes:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][c]
            self.token_at[node] = i
        self.base = {codes[0]: i for i, codes in self.parts.items() if len(codes) == 1}
        self.ranks = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states = {((0, -1, 0),): 0}
        self.entries = [((0, -1, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens."""
        known = self.fits.get((a, b))
        if known is None:
            tokens = [self.base[c] for c in self.parts[a] + self.parts[b]]
            while len(tokens) > 1:
                rank, at, new = min((*self.ranks.get(pair, (1 << 60, -1))[:1], i, self.ranks.get(pair, (0, -1))[1]) for i, pair in enumerate(zip(tokens, tokens[1:])))
                if new < 0:
                    break
                tokens[at:at + 2] = [new]
            known = self.fits[a, b] = tokens == [a, b]
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition from a state on a symbol: (next state, change of the count)."""
        reached, new = [], None
        for node, before, count in self.entries[state]:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            if self.trie[child]:
                reached.append((child, before, count))
            token = self.token_at[child]
            if token >= 0 and (before < 0 or self.adjacent(before, token)):
                new = (token, count + 1)
        token, change = new
        entries = tuple((node, before, count - change) for node, before, count in reached) + ((0, token, 0),)
        if entries not in self.states:
            self.states[entries] = len(self.entries)
            self.entries.append(entries)
            self.moves.append({})
        self.moves[state][symbol] = move = (self.states[entries], change)
        return move

    def count(self, word: bytes) -> int:
        if len(self.entries) > STATES or len(self.fits) > 4 * STATES:
            self.reset()
            self.fits.clear()
        state = total = 0
        moves = self.moves
        for symbol in (*word[:-1], word[-1] + 256):
            move = moves[state].get(symbol) or self.compile(state, symbol)
            state, total = move[0], total + move[1]
        return total


class _Memo(dict):
    def __init__(self, transducer: WordTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(word.encode())
        if len(self) >= MEMO:
            self.clear()
        if len(word) < 64:
            self[word] = n
        return n


class Counter:
    """Counts the tokens of whole texts for one tokenizer file with word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(splitter["pattern"]["Regex"]).findall
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        model = spec["model"]
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        self.memo = _Memo(WordTransducer(vocab, model["merges"], model["end_of_word_suffix"]))

    def closed(self, text: str) -> int:
        """Tokens of a text that starts and ends at white space or at an end of the whole text."""
        if not text:
            return 0
        if "<|" in text and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.closed, parts))
        text = text.lower() if text.isascii() else self.normal(text)
        return sum(map(self.memo.__getitem__, self.words(text)))

    def chunk_map(self, chunk: str) -> tuple:
        """(text before the first space, tokens between, text after the last space), or (text,) without space."""
        first = _SPACE.search(chunk)
        if first is None:
            return (chunk,)
        last = max(chunk.rfind(c) for c in " \t\r\n")
        return chunk[:first.start()], self.closed(chunk[first.start():last + 1]), chunk[last + 1:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if len(a) == 1:
            return (a[0] + b[0], *b[1:])
        if len(b) == 1:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.closed(text)
        maps = [self.chunk_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.closed(maps[0][0]) if len(maps[0]) == 1 else self.closed(maps[0][0]) + maps[0][1] + self.closed(maps[0][2])


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``, for the tokenizer file ``vocabulary`` that every
    executor can read.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text count as one token each. Every
    row returns a row, repeated or not; a null doc_id stays null; other columns are ignored. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        counter = _COUNTERS[vocabulary]
        for batch in batches:
            n = pa.array([counter.count(t) if t else 0 for t in map(lambda s: s.as_py(), batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary ``name`` lies; the package is installed alike on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)
