"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A BPE encoding is fixed by pairs of neighbouring tokens: a sequence is the encoding of its text exactly when
every token encodes to itself and every neighbouring pair encodes to that pair. So the last token of each
prefix, and with it the number of tokens, follows from a bounded window of earlier positions: a deterministic
machine. `BpeTransducer` builds it from the trie of the vocabulary as inputs ask for it; a transition reads
one byte and carries the change in emitted tokens, and a final weight closes the word.

Texts are cut into chunks, and pre-tokens of over PIECE symbols into pieces. The map of a piece (state before -> state after, tokens
emitted) is a `PieceMap`; that of a chunk is its text before the first blank, the count between, and its text after
the last blank, for at a blank every state falls back to the start. Both kinds of maps are associative monoids and are
composed as balanced trees.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm.common import Memo, bounded_batches, without_cycle_collection

CHUNK = 1 << 16  # characters
PIECE = 1 << 12  # symbols of a pre-token that are mapped at once
MEET = 64  # symbols within which runs from different states are expected to meet
MAX_STATES = 100_000  # machine states kept; beyond, it is built anew
MAX_PAIRS = 400_000  # pairs of tokens judged whose answer is remembered
MAX_WORDS = 600_000  # fragments, and pre-tokens, whose count is remembered
LIMIT = 2048
#: Fixed: the pre-token pattern of the vocabulary file that the short way for plain texts covers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORDS = regex.compile(WORDS.replace(r"\s", r"\t-\r \x85\xa0")).findall


START = ((0, None, 0),)  # content of the state at the start of a pre-token


class BpeTransducer:
    """The machine of one vocabulary: bytes of a pre-token in, number of tokens out.

    State: the trie nodes that tokens still open can be at (their start positions) together with the last
    token and the relative count at each of those positions.
    """

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.trie: list[dict[str, int]] = [{}]
        self.inner: list[str | None] = [None]  # token that ends at a trie node inside a word
        self.final: list[str | None] = [None]  # the same at the end of a word
        for token in vocab:
            body = token.removesuffix(suffix) if suffix else token
            if not body:
                continue
            node = 0
            for ch in body:
                if ch not in self.trie[node]:
                    self.trie[node][ch] = len(self.trie)
                    self.trie.append({})
                    self.inner.append(None)
                    self.final.append(None)
                node = self.trie[node][ch]
            (self.final if suffix and token.endswith(suffix) and token != suffix else self.inner)[node] = token
        if not suffix:
            self.final = self.inner
        self.pairs = Memo(lambda pair: self._stands(*pair, False), MAX_PAIRS)
        self.last_pairs = Memo(lambda pair: self._stands(*pair, True), MAX_PAIRS)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {START: 0}
        self.content: list[tuple] = [START]
        self.step: list[dict[str, tuple[int, int]]] = [{}]
        self.close: list[dict[str, int]] = [{}]

    def merged(self, symbols: list[str]) -> list[str]:
        """Apply the merges to symbols, lowest rank first and leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _symbols(self, token: str, last: bool) -> list[str]:
        if last and self.suffix:
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _stands(self, left: str, token: str, last: bool) -> bool:
        """Whether token can stand after left in an encoding (left empty: at the start)."""
        return self.merged([*left, *self._symbols(token, last)]) == ([left, token] if left else [token])

    def _advance(self, state: int, ch: str, last: bool) -> tuple[list[tuple[int, str | None, int]], str | None, int]:
        """Open positions after ch; the last token of the prefix and its count relative to the state."""
        return self._advance_from(self.content[state], ch, last)

    def _advance_from(self, content: tuple, ch: str, last: bool) -> tuple[list[tuple[int, str | None, int]], str | None, int]:
        opened, token, count = [], None, 0
        for node, left, n in content:  # longest first
            down = self.trie[node].get(ch)
            if down is None:
                continue
            opened.append((down, left, n))
            found = (self.final if last else self.inner)[down]
            if token is None and found is not None and (self.last_pairs if last else self.pairs)[left or "", found]:
                token, count = found, n + 1
        return opened, token, count

    def transition(self, state: int, ch: str) -> tuple[int, int]:
        opened, token, count = self._advance(state, ch, False)
        if token is None:  # no token of the vocabulary ends here: such bytes are dropped
            count = 0
            opened = []
        content = tuple((node, left, n - count) for node, left, n in opened) + ((0, token, 0),)
        if content not in self.states:
            if len(self.content) >= MAX_STATES:  # built anew; the state reached is the first to be kept
                self._reset()
            self.states[content] = len(self.content)
            self.content.append(content)
            self.step.append({})
            self.close.append({})
        return self.states[content], count

    def walk(self, content: tuple, text: str) -> Iterator[tuple[tuple, int]]:
        """State content and tokens emitted after each symbol of text, from a state given by its content."""
        for ch in text:
            state = self.states.get(content)
            if state is None:  # of a machine that was built anew since
                state = self.states[content] = len(self.content)
                self.content.append(content)
                self.step.append({})
                self.close.append({})
            found = self.step[state].get(ch)
            if found is None:
                step = self.step[state]
                found = step[ch] = self.transition(state, ch)
            content = self.content[found[0]]
            yield content, found[1]

    def count(self, word: str) -> int:
        """Tokens of one pre-token, its bytes written as the vocabulary writes them; a long one piece by piece."""
        if len(word) > PIECE:
            whole = composed([PieceMap(self, word[i : min(i + PIECE, len(word) - 1)]) for i in range(0, len(word) - 1, PIECE)])
            _, token, n = self._advance_from(whole.exit, word[-1], True)
            return whole.total + (n if token is not None else 0)
        state, total, step = 0, 0, self.step
        for ch in word[:-1]:
            found = step[state].get(ch)
            if found is None:
                found = step[state][ch] = self.transition(state, ch)
                step = self.step
            state, delta = found
            total += delta
        end = word[-1]
        delta = self.close[state].get(end)
        if delta is None:
            _, token, n = self._advance(state, end, True)
            delta = self.close[state][end] = n if token is not None else 0
        return total + delta


class PieceMap:
    """The state map of a piece of a pre-token: state before -> state after, tokens emitted.

    The piece is run from the start state and the states on its first MEET symbols are kept. Runs from other states nearly
    always fall in with it there, and go on alike from then; one that doesn't is run to its end.
    """

    def __init__(self, machine: BpeTransducer, text: str):
        self.machine, self.text, self.path, self.total = machine, text, [], 0
        self.exit = START
        for i, (self.exit, n) in enumerate(machine.walk(START, text)):
            self.total += n
            if i < MEET:
                self.path.append((self.exit, self.total))

    def apply(self, state: tuple) -> tuple[tuple, int]:
        if state == START:
            return self.exit, self.total
        total = 0
        for i, (state, n) in enumerate(self.machine.walk(state, self.text)):
            total += n
            if i < len(self.path) and state == self.path[i][0]:
                return self.exit, total + self.total - self.path[i][1]
        return state, total


class JointMap:
    """The map of two neighbouring stretches; composition is associative."""

    def __init__(self, left: PieceMap | JointMap, right: PieceMap | JointMap):
        self.left, self.right = left, right
        self.exit, n = right.apply(left.exit)
        self.total = left.total + n

    def apply(self, state: tuple) -> tuple[tuple, int]:
        middle, a = self.left.apply(state)
        if middle == self.left.exit:
            return self.exit, a + self.total - self.left.total
        after, b = self.right.apply(middle)
        return after, a + b


def composed(maps: list) -> PieceMap | JointMap:
    """All maps as one, by a balanced tree."""
    while len(maps) > 1:
        maps = [JointMap(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class TokenCounter:
    """Counts tokens as a tokenizers file defines them: special strings, normaliser, pre-tokens, BPE."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        self.library = Tokenizer.from_file(file)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.machine = BpeTransducer(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.known = Memo(self.fragment, MAX_WORDS)
        self.words = Memo(self.machine.count, MAX_WORDS)
        self.plain = self._plain_spec() == {k: spec[k] for k in ("normalizer", "pre_tokenizer")}

    @staticmethod
    def _plain_spec() -> dict:
        """The normaliser and pre-tokeniser for which `plain_words` is the same as the library."""
        parts = {"Split": {"pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, "ByteLevel": {"add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        return {
            "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": k} | v for k, v in parts.items()]},
        }

    def fragment(self, text: str) -> int:
        """Tokens of a text without blanks."""
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return sum(map(self.fragment, parts)) + len(parts) - 1
        if not text:
            return 0
        if self.plain and max(text) < "\u0180" and "\u0130" not in text:  # NFC leaves these alone, and lower() is the library's
            return sum([self.words[w.translate(BYTE_NAMES)] for w in PLAIN_WORDS(text.lower())])
        normal = self.library.normalizer.normalize_str(text)
        return sum(self.words[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w)

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(text before the first blank, tokens between, text after the last); between is None without a blank."""
        parts = chunk.translate(BLANKS).split(" ")
        if len(parts) == 1:
            return chunk, None, ""
        return parts[0], sum(map(self.known.__getitem__, parts[1:-1])), parts[-1]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of two neighbouring chunks; associative."""
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.known[a[2] + b[0]] + b[1], b[2])

    def scan(self, maps: list[tuple[str, int | None, str]]) -> tuple[str, int | None, str]:
        """Compose all maps as a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            head, between, tail = self.chunk_map(text)
        else:
            head, between, tail = self.scan([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
        return self.known[head] + (between or 0) + self.known[tail]


def _byte_names() -> dict[int, str]:
    """Characters below U+0180 as the byte-level alphabet writes their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0x180)}


BYTE_NAMES = _byte_names()
#: Blanks at which the machine is back at its start whatever stands around them.
BLANKS = {9: " ", 10: " ", 13: " "}
_COUNTERS: dict[str, TokenCounter] = {}


def _counter(name: str) -> TokenCounter:
    if name not in _COUNTERS:
        _COUNTERS[name] = TokenCounter(name if os.path.sep in name else public_tokenizers.path(name))
    return _COUNTERS[name]


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit. Narrow: no shuffle.

    tokenizer is a file name of the public set or a path. A null text counts as empty: 0 bytes, 0 tokens. Ids may
    be null or repeat; rows are independent of each other. Other columns are ignored; an empty table gives no
    rows. A very long text is counted chunk by chunk.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            with without_cycle_collection():
                n = pa.array([0 if t is None else counter.count(t) for t in map(pa.StringScalar.as_py, b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: tokens of word_bpe_49k.json in every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "word_bpe_49k.json")
