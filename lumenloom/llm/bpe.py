"""Byte-level BPE encoding of a corpus by a finite-state transducer, and its streaming decoding.

The merges are compiled into a transducer over bytes that is determinised
lazily: a state stands for every way in which the bytes read so far can still
end, and it emits a token as soon as all of them agree on it, which needs no
more lookahead than the longest token. Whole words that were seen before take a
remembered run of transitions in one step.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files, and the vocabulary used.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# Fixed value: the published pattern that splits a text before byte-level merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words, and stretches between blanks, whose ids a worker remembers, and the longest of them; so a memory holds
#: at most their product of characters and four bytes' worth of ids for each.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48


def read_ranks(path: str | Path) -> bytes:
    """The vocabulary file's content: a line of base64 token and rank each."""
    return Path(path).read_bytes()


class Transducer:
    """Lazily determinised transducer from bytes to BPE token ids.

    Two tokens may stand beside each other in an encoding if encoding their
    joined bytes gives back just these two; a sequence is the encoding of its
    bytes if all neighbours may. So for every prefix exactly one token can end
    it, and the prefixes at which a longer token may still begin are all that
    later bytes depend on. A state holds, for each of them, the place in the
    trie of tokens and the tokens not yet emitted.
    """

    def __init__(self, ranks: Mapping[bytes, int]) -> None:
        self.ranks = dict(ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.inner: set[int] = {0}
        nodes = 1
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                self.inner.add(node)
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = nodes
                    nodes += 1
                node = after
            self.ends[node] = rank
        self.beside: dict[int, bool] = {}
        self.edges: dict[tuple[bytes, bool], tuple[tuple[bytes, int], ...] | None] = {}
        self.restart()

    def restart(self) -> None:
        """Forgets all determinised states."""
        start = (None, ((0, ()),))
        self.number = {start: 0}
        self.states = [start]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, text: bytes, down_to: int = 1) -> list[bytes]:
        """BPE by its definition: the pair of lowest rank is merged until none is left, or `down_to` parts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > down_to:
            ranks = [self.ranks.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, right: bool) -> tuple[tuple[bytes, int], ...] | None:
        """The parts of a token that its merges leave at one end, from the whole token down to a byte.

        With each part comes the rank of the merge that takes it up (of none for
        the whole). None if merging the token's bytes doesn't give the token.
        """
        known = self.edges.get((token, right), 0)
        if known != 0:
            return known
        chain_: list[tuple[bytes, int]] = [(token, 1 << 60)]
        whole = token
        while len(whole) > 1:
            parts = self.merged(whole, 2)
            if len(parts) > 2 or parts[0] + parts[1] not in self.ranks:
                self.edges[token, right] = None
                return None
            taken = self.ranks[whole]
            whole = parts[1] if right else parts[0]
            chain_.append((whole, taken))
        self.edges[token, right] = result = tuple(chain_)
        return result

    def may_stand_beside(self, left: int | None, right: int) -> bool:
        """Whether the two tokens can be neighbours; with left None, whether right can be first.

        They can unless a merge across their border would come before the
        merges that take up its parts; of equal ranks the one further left comes first.
        """
        ours = self._edge(self.tokens[right], False)
        if left is None or ours is None:
            return ours is not None
        theirs = self._edge(self.tokens[left], True)
        if theirs is None:
            return False
        rank_of = self.ranks.get
        for x, x_taken in theirs:
            for y, y_taken in ours:
                across = rank_of(x + y)
                if across is not None and across < x_taken and across <= y_taken:
                    return False
        return True

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, live = self.states[state]
        child, ends, inner, beside = self.child.get, self.ends.get, self.inner, self.beside
        going: list[tuple[int, tuple[int, ...]]] = []
        ended: tuple[int, ...] | None = None
        for node, pending in live:
            after = child(node << 8 | byte)
            if after is None:
                continue
            if ended is None and (token := ends(after)) is not None:
                before = pending[-1] if pending else last
                pair = token if before is None else (before + 1) << 32 | token
                fits = beside.get(pair)
                if fits is None:
                    fits = beside[pair] = self.may_stand_beside(before, token)
                if fits:
                    ended = (*pending, token)
            if after in inner:
                going.append((after, pending))
        if ended is None:
            raise ValueError(f"the vocabulary can't encode byte {byte}")
        agreed = len(ended)
        for _, pending in going:
            common = 0
            for x, y in zip(pending, ended):
                if x != y:
                    break
                common += 1
            agreed = min(agreed, common)
        going.append((0, ended))
        emitted = ended[:agreed]
        if agreed:
            last = emitted[-1]
            going = [(n, p[agreed:]) for n, p in going]
        if all(pending for _, pending in going):
            last = -1  # what comes next stands beside a pending token, whatever came before
        after_state = (last, tuple(going))
        number = self.number.get(after_state)
        if number is None:
            number = self.number[after_state] = len(self.states)
            self.states.append(after_state)
            self.steps.append({})
        step = self.steps[state][byte] = (number, emitted)
        return step

    def _ending(self, state: int, byte: int) -> tuple[int, ...]:
        """The ids left to emit if `byte` is a word's last; no state is made for what can't follow."""
        last, live = self.states[state]
        child, ends, beside = self.child.get, self.ends.get, self.beside
        for node, pending in live:
            after = child(node << 8 | byte)
            if after is not None and (token := ends(after)) is not None:
                before = pending[-1] if pending else last
                pair = token if before is None else (before + 1) << 32 | token
                fits = beside.get(pair)
                if fits is None:
                    fits = beside[pair] = self.may_stand_beside(before, token)
                if fits:
                    return (*pending, token)
        raise ValueError(f"the vocabulary can't encode byte {byte}")

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word, byte by byte."""
        if not word:
            return ()
        state, out = 0, ()
        steps = self.steps
        for byte in word[:-1]:
            step = steps[state].get(byte) or self._determinise(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self._ending(state, word[-1])
        if len(self.states) > REMEMBERED:
            self.restart()
            self.beside.clear()
        return out


class _Memory(dict):
    """Remembers a function's results for short keys, at most REMEMBERED of them; long keys are worked out each time."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        if len(key) > LONGEST_REMEMBERED:
            return value
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts to ids: splits by the published pattern and runs the transducer over each word.

    A blank before a non-blank always begins a word, so a text is first cut
    there; stretches and words met before are looked up.
    """

    _cut = regex.compile(r" (?=[^\s\x1c-\x1f])")
    _odd = regex.compile(r" [\s\x1c-\x1f]| $")

    def __init__(self, ranks: bytes) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.transducer = Transducer({base64.b64decode(token): int(rank) for token, rank in pairs})
        self._split = regex.compile(SPLIT)
        self._words = _Memory(self._word)
        self._stretches = _Memory(self._stretch)
        self._after_blank = _Memory(lambda t: self._stretch(" " + t))

    def _word(self, word: str) -> bytes:
        return array("i", self.transducer.encode(word.encode("utf-8"))).tobytes()

    def _stretch(self, text: str) -> bytes:
        words = self._split.findall(text)
        # A stretch of one word is remembered as a stretch already.
        return self._word(words[0]) if len(words) == 1 else b"".join(map(self._words.__getitem__, words))

    def encoded(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit numbers side by side, without special tokens; none for a null or empty text."""
        if not text:
            return b""
        parts = self._cut.split(text) if self._odd.search(text) else text.split(" ")
        first = self._stretches[parts[0]] if parts[0] else b""
        return b"".join((first, *map(self._after_blank.__getitem__, parts[1:])))

    def ids(self, text: str | None) -> Iterator[int]:
        """The ids of a text."""
        return iter(array("i", self.encoded(text)))

    def batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets at which each text's begin."""
        each = list(map(self.encoded, texts))
        offsets = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) // 4, out=offsets[1:])
        return np.frombuffer(b"".join(each), dtype=np.int32), offsets.astype(np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """The encoder of a vocabulary, built once in a worker."""
    name = hashlib.sha256(ranks).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(ranks)
    return _ENCODERS[name]


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS, lengths_only: bool = False) -> DataFrame:
    """`id_column` and ids array<int> of every document (or n_tokens int, with `lengths_only`).

    Ids are without special tokens, whose strings are ordinary text here; a null
    or empty text has an empty list. The vocabulary (about 1 MB, a file of fixed
    size) is read once by the driver and broadcast. No shuffle; memory is that of
    an Arrow batch and of the bounded memories.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(Path(folder) / vocabulary))
    picked = documents.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    id_type = picked.schema[0].dataType.simpleString()
    if lengths_only:
        return picked.mapInArrow(lambda batches: _run(batches, ranks, True), f"`{id_column}` {id_type}, n_tokens int")
    return picked.mapInArrow(lambda batches: _run(batches, ranks, False), f"`{id_column}` {id_type}, ids array<int>")


def _run(batches: Iterator[pa.RecordBatch], ranks, lengths_only: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(ranks.value)
    gc.disable()  # the memories hold millions of tuples and no cycles
    for batch in batches:
        flat, offsets = coder.batch(batch.column(1).to_pylist())
        if lengths_only:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int32())], [batch.schema.names[0], "n_tokens"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], [batch.schema.names[0], "ids"])


class StreamingDecoder:
    """Ids to text piece by piece: an incremental UTF-8 state machine over the tokens' bytes.

    Its state is the at most three bytes of an unfinished character. `push`
    returns the text that is complete; bytes that can't be UTF-8 become U+FFFD.
    """

    def __init__(self, tokens: Mapping[int, bytes]) -> None:
        self.tokens = tokens
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many of the last bytes begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC2:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 0
                if need <= back:
                    return 0
                second = data[-back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                return back if second is None or low <= second <= high else 0
            if byte < 0x80:
                return 0
        return 0

    def push(self, ids: Iterable[int]) -> str:
        """The text completed by further ids."""
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", errors="replace")

    def close(self) -> str:
        """What an unfinished character leaves at the end."""
        rest, self.held = self.held.decode("utf-8", errors="replace"), b""
        return rest


def decode_corpus(encoded: DataFrame, id_column: str = "doc_id", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS, window: int = 512) -> DataFrame:
    """`id_column` and text of every list of ids, decoded `window` ids at a time; null ids give a null text."""
    spark = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(Path(folder) / vocabulary))
    picked = encoded.select(F.col(f"`{id_column}`"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in ranks.value.splitlines() if line)}
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = StreamingDecoder(tokens)
                texts.append(None if ids is None else "".join([*(decoder.push(ids[i : i + window]) for i in range(0, len(ids), window)), decoder.close()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    return picked.mapInArrow(run, f"`{id_column}` {picked.schema[0].dataType.simpleString()}, text string")
