"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

The encoding of every prefix of a piece is known from its last token: the one token that ends there
and fits the last token of the prefix in front of it. Two tokens fit if the merges leave them as they
are when they meet. So a left-to-right transducer can keep, for the bytes it has not yet settled, the
last token at each position. A token is emitted once every way the piece may go on agrees on it,
which the longest token of the vocabulary bounds. Its states (the settled token in front, the bytes
pending) are made when first met and kept with their transitions.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pkgaudit.llm.common import claim, collector_off, let_go, need, ship, table

VOCABULARY = "byte_bpe_50k.tiktoken"
# States, pairs and pieces a worker keeps, about 350 MB in all; beyond that it forgets them and goes on.
KEPT_STATES = 400_000
NEVER = 1 << 60
KEPT_PAIRS = 500_000
KEPT_PIECES = 300_000
KEPT_PIECE_CHARS = 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class State(dict):
    """byte -> (next state, tokens settled), made when first asked for.

    Its key: the token in front, the bytes pending and their last tokens.
    """

    __slots__ = ("key", "of")

    def __init__(self, key: tuple, of: Transducer):
        self.key, self.of = key, of

    def __missing__(self, byte: int) -> tuple[State, tuple]:
        after = self[byte] = self.of.step(self, byte)
        return after


class Transducer:
    """Merges compiled to a transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], kept_states: int = KEPT_STATES, kept_pairs: int = KEPT_PAIRS):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.kept_states, self.kept_pairs = kept_states, kept_pairs
        self.longest = max(map(len, ranks))
        self.fits: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.halves: dict[int, tuple[int, int]] = {}
        # Tokens that merges never make cannot occur.
        self.made = {token: rank for token, rank in ranks.items() if len(token) == 1 or self._is_made(token, rank)}
        self.prefixes = {token[:n] for token in self.made for n in range(1, len(token))}
        self.states: dict[tuple, State] = {}
        self.start = self._state((None, b"", ()))

    def _is_made(self, token: bytes, rank: int) -> bool:
        """Merge the bytes, lowest rank first, leftmost first; the last two parts are the token's halves."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            at, least = 0, NEVER
            for i in range(len(parts) - 1):
                here = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if here < least:
                    at, least = i, here
            if least == NEVER:
                return False
            if len(parts) == 2:
                self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return True

    def fit(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.kept_pairs:
                self.fits.clear()
            known = self.fits[key] = self._stay_apart(left, right)
        return known

    def _spine(self, rank: int, side: int) -> list[tuple[int, bytes]]:
        """The symbols at one edge of a token while it is merged, each with the rank of the merge that ends it."""
        spines = self.spines[side]
        known = spines.get(rank)
        if known is None:
            token, halves = self.tokens[rank], self.halves.get(rank)
            known = []
            if halves:
                known = [*self._spine(halves[side], side)]
                known[-1] = (rank, known[-1][1])
            known.append((NEVER, token))
            spines[rank] = known
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the end of one token to the start of the next before both are made, or then."""
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (a_ends, a_symbol), (b_ends, b_symbol) = a[i], b[j]
            joined = self.ranks.get(a_symbol + b_symbol, NEVER)
            if joined < a_ends and joined <= b_ends and joined != NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _last_tokens(self, before: int | None, pending: bytes, known: tuple) -> tuple:
        """The last token of each prefix of `pending`; `known` has those of all but the whole."""
        end = len(pending)
        for start in range(max(0, end - self.longest), end):
            token = self.made.get(pending[start:])
            if token is None:
                continue
            left = before if start == 0 else known[start - 1]
            if left is None or self.fit(left, token):
                return (*known, token)
        raise ValueError("a byte has no token")

    def _chain(self, last: tuple, end: int) -> list[int]:
        """The tokens of the first `end` pending bytes."""
        out = []
        while end:
            out.append(last[end - 1])
            end -= self.lengths[out[-1]]
        return out[::-1]

    def step(self, state: State, byte: int) -> tuple[State, tuple]:
        """The state after a byte, and the tokens it settles."""
        before, pending, last = state.key
        pending += bytes((byte,))
        last = self._last_tokens(before, pending, last)
        # A later token can begin at the end, or where what is pending from there on begins a longer token.
        # The prefix up to a position has one encoding, so two chains that share a cut share all before it:
        # the last cut on the chains of all these positions is settled.
        prefixes, lengths = self.prefixes, self.lengths
        cut = len(pending)
        for q in range(cut - 1, max(-1, cut - self.longest), -1):
            if pending[q:] in prefixes:
                other = q
                while cut != other:
                    if cut > other:
                        cut -= lengths[last[cut - 1]]
                    else:
                        other -= lengths[last[other - 1]]
                if not cut:
                    break
        settled = tuple(self._chain(last, cut))
        if cut:
            before, pending, last = settled[-1], pending[cut:], last[cut:]
        # The token in front counts only as long as a token that is still open can stand behind it.
        if pending and pending not in prefixes:
            before = None
        return self._state((before, pending, last)), settled

    def _state(self, key: tuple) -> State:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(key, self)
        return state

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        if len(self.states) > self.kept_states:
            self.states.clear()
            self.start = self._state((None, b"", ()))
            gc.collect()  # states point at each other
        out: list[int] = []
        state = self.start
        for byte in data:
            state, settled = state[byte]
            if settled:
                out += settled
        _, pending, last = state.key
        return (*out, *self._chain(last, len(pending)))


def look_up(keys: list, table) -> tuple:
    """table[key] for all keys, without a Python step for each."""
    return itemgetter(*keys)(table) if len(keys) > 1 else tuple(table[k] for k in keys)


class Decoder:
    """Ids to text, from the vocabulary alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(look_up(ids, self.tokens))

    def decode_stream(self, ids: Iterable[int], at_a_time: int = 4096) -> Iterator[str]:
        """Text as ids come in: an incremental UTF-8 machine keeps the bytes of a character still open."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        coming = iter(ids)
        while held := list(islice(coming, at_a_time)):
            yield machine.decode(self.decode_bytes(held))
        yield machine.decode(b"", final=True)


class Pieces(dict):
    """piece -> its ids as packed integers; those not met lately are looked up among older ones, or encoded."""

    def __init__(self, transducer: Transducer, older: dict[str, bytes]):
        super().__init__()
        self.transducer, self.older = transducer, older

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece) or array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= KEPT_PIECE_CHARS:
            self[piece] = packed
        return packed


class Codec(Decoder):
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str, kept: float = 1.0):
        ranks = read_ranks(path)
        super().__init__(ranks)
        self.transducer = Transducer(ranks, int(kept * KEPT_STATES), int(kept * KEPT_PAIRS))
        self.kept_pieces = int(kept * KEPT_PIECES)
        self.pieces = regex.compile(pattern).findall
        self.known = Pieces(self.transducer, {})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        packed = b"".join(look_up(self.pieces(text), self.known))
        if len(self.known) >= self.kept_pieces:
            older, self.known.older = self.known, {}
            self.known = Pieces(self.transducer, older)
        return np.frombuffer(packed, np.int32)


_CODECS: dict[tuple[str, str, float], Codec] = {}


def codec(path: str, pattern: str, kept: float = 1.0) -> Codec:
    """One codec a worker, with what it has learnt."""
    claim("byte_bpe", _CODECS.clear)
    if (path, pattern, kept) not in _CODECS:
        _CODECS[path, pattern, kept] = Codec(path, pattern, kept)
    return _CODECS[path, pattern, kept]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of `docs`, and input_ids; a null text is an empty one and has no ids.

    Rows stay where they are: nothing is shuffled. A given column `input_ids` is replaced.
    """
    need(docs, "text")
    ship(docs.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    docs = docs.drop("input_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with collector_off():
            yield from coded(codec(path, pattern), batches)

    def coded(coder: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t.as_py() or "") for t in part.column(place)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, np.concatenate(ids))],
                    [*part.schema.names, "input_ids"])

    schema = T.StructType([*docs.schema.fields, T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns but input_ids, and decoded: the text the ids stand for. Null ids give an empty text."""
    need(encoded, "input_ids")
    ship(encoded.sparkSession)
    path = path or vocabulary_path()
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        coder = Decoder(read_ranks(path))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("input_ids"))
            texts = ["".join(coder.decode_stream(i.values.to_numpy().tolist() if i.is_valid else ())) for i in ids]
            kept = [n for n in batch.schema.names if n != "input_ids"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(texts)], [*kept, "decoded"])

    schema = T.StructType([*encoded.drop("input_ids").schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = (),
               with_ids: bool = False, kept_tables: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, further columns and input_ids: every text
    encoded and its ids decoded again, in one pass. Smaller `kept_tables` take less memory and more time."""
    need(docs, "doc_id", "text", *keep)
    ship(docs.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with collector_off():
            yield from tripped(codec(path, pattern, kept_tables), batches)

    def tripped(coder: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, coded = [], []
                for text in part.column("text"):
                    packed = coder.encode(text.as_py() or "")
                    ids = packed.tolist()
                    decoded = hashlib.sha256()
                    for piece in coder.decode_stream(ids):
                        decoded.update(piece.encode())
                    named = " ".join(look_up(ids, coder.names))
                    rows.append((len(ids), hashlib.sha256(named.encode()).hexdigest(), decoded.hexdigest()))
                    if with_ids:
                        coded.append(packed)
                n, ids_digests, text_digests = zip(*rows, strict=True)
                columns = [*(part.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(ids_digests, pa.string()),
                           pa.array(text_digests, pa.string())]
                names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(coded)))
                    names.append("input_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [docs.schema[c] for c in kept] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("input_ids", T.ArrayType(T.IntegerType())))
    return docs.select(*kept, "text").mapInArrow(run, T.StructType(fields))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
