"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of them, whose size the capacity bounds,
holds all that a plan needs; the driver plans on histograms alone and never sees a row. Long pieces are put
into groups of equally many by falling length and rounded up to the longest of their group. Which numbers
of each group fill a sequence (a configuration) is optimised as a linear program over those few
sizes: columns come from a knapsack, and what rounding down leaves is packed by best fit. Spark then ranks the
real pieces of every length, which gives each its place in a configuration, counts what is really left in the
sequences, and the short pieces go by falling length to the sequences with the least room that holds them.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgaudit.llm.common import claim, collector_off, need, ship, stored, table

CAPACITY = 4096
# Numbers of groups tried: few leave larger rooms for short pieces, many waste less where there are none.
GROUPS = (16, 48)
# Pieces up to this share of a sequence are short: they fill what the configurations leave.
SHORT = 6
# Columns tried before the program is taken as it is; any basis gives a whole packing.
COLUMNS = 4000


# ---- the plan: histograms in, configurations and moves out -------------------------------------------------------

def linear_groups(counts: np.ndarray, above: int, groups: int) -> tuple[list[int], list[int]]:
    """Rounded sizes, falling, and how many pieces of more than `above` tokens have each.

    counts[l] is the number of pieces of length l. Pieces in falling order of length are dealt into `groups`
    groups of equally many; a group's size is its longest length. Groups of one size are one, and where there
    are no more lengths than groups, each length is a group.
    """
    long = counts.copy()
    long[:above + 1] = 0
    total = int(long.sum())
    if not total:
        return [], []
    lengths = np.flatnonzero(long)[::-1].tolist()
    if len(lengths) <= groups:
        return lengths, long[lengths].tolist()
    each = -(-total // groups)
    falling = np.cumsum(long[::-1])
    sizes: dict[int, int] = {}
    for first in range(0, total, each):
        size = len(counts) - 1 - int(np.searchsorted(falling, first, "right"))
        sizes[size] = sizes.get(size, 0) + min(each, total - first)
    return list(sizes), list(sizes.values())


def best_column(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence, numbers of each size: a knapsack over all capacities."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (size, value) in enumerate(zip(sizes, values, strict=True)):
        if value <= 1e-12:
            continue
        before = best.copy()
        for k in range(1, capacity // size + 1):
            with_k = before[:capacity + 1 - k * size] + k * value
            tail = best[k * size:]
            better = with_k > tail + 1e-13
            tail[better] = with_k[better]
            taken[i, k * size:][better] = k
    column, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        column[i] = taken[i, room]
        room -= column[i] * sizes[i]
    return float(best[capacity]), column


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fillings and how often each is used, so that every size is met exactly and few sequences are used.

    The linear program is solved by columns made on demand and rounded down; the rest (fewer sequences than
    there are sizes) is packed by best fit of falling sizes.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    demand = np.array(demands, float)
    for _ in range(COLUMNS):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, column = best_column(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        level, change = np.linalg.solve(basis, np.column_stack([demand, column])).T
        ratio = np.where(change > 1e-9, np.maximum(level, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    used = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-6).astype(np.int64)
    whole = basis.astype(np.int64)
    # Rounding errors may not make more of a size than there is.
    while ((whole @ used) > demands).any():
        over = int(np.argmax(whole @ used - np.array(demands)))
        used[int(np.argmax(np.where(used > 0, whole[over], 0)))] -= 1
    made = {tuple(whole[:, j]): int(used[j]) for j in range(m) if used[j] > 0}
    rest = (np.array(demands) - whole @ used).tolist()
    rooms: list[tuple[int, int]] = []
    fillings: list[np.ndarray] = []
    for i in sorted(range(m), key=lambda i: -sizes[i]):
        for _ in range(rest[i]):
            at = bisect_left(rooms, (sizes[i], -1))
            if at < len(rooms):
                room, filling = rooms.pop(at)
            else:
                room, filling = capacity, len(fillings)
                fillings.append(np.zeros(m, np.int64))
            fillings[filling][i] += 1
            insort(rooms, (room - sizes[i], filling))
    for filling in fillings:
        made[tuple(filling)] = made.get(tuple(filling), 0) + 1
    return [(np.array(f), n) for f, n in made.items()]


class Falling:
    """The pieces of more than `above` tokens in falling order of length, by rank, known from their histogram alone."""

    def __init__(self, counts: np.ndarray, above: int):
        self.lengths = np.flatnonzero(counts[above + 1:])[::-1] + above + 1
        self.ends = np.cumsum(counts[self.lengths])
        self.starts = self.ends - counts[self.lengths]
        self.tokens = np.concatenate([[0], np.cumsum(self.lengths * counts[self.lengths])])

    def tokens_before(self, rank: np.ndarray) -> np.ndarray:
        """Tokens of the first `rank` pieces."""
        at = np.searchsorted(self.ends, rank, "right")
        last = np.minimum(at, len(self.lengths) - 1)
        return np.where(at < len(self.lengths), self.tokens[at] + (rank - self.starts[last]) * self.lengths[last],
                        self.tokens[-1])


# A run puts pieces of one length into sequences, `each` into one and then the next:
# (length, first piece, `each` places already passed, each, first sequence).
Run = tuple[int, int, int, int, int]


def substitute(fillings: list[tuple[np.ndarray, int]], demands: list[int], falling: Falling,
               capacity: int) -> tuple[list[Run], list[tuple[int, int, int]], int]:
    """Real pieces in the places of the configurations.

    Returns the runs, the stretches of sequences with one room each (room, first, number), and the
    number of sequences. Pieces take the places of their group in falling order, so the room only changes where
    a length does: there are at most twice as many stretches as lengths times configurations, however many pieces.
    """
    group_start = np.concatenate([[0], np.cumsum(demands)]).astype(np.int64)
    passed = np.zeros(len(demands), np.int64)
    runs: list[Run] = []
    stretches: list[tuple[int, int, int]] = []
    first = 0
    for filling, times in fillings:
        used = np.flatnonzero(filling)
        steps = [np.array([0, times])]
        for i in used.tolist():
            each, begin = int(filling[i]), int(group_start[i] + passed[i])
            end = begin + each * times
            low, high = np.searchsorted(falling.ends, begin, "right"), np.searchsorted(falling.starts, end)
            for at in range(low, high):
                at_rank = max(begin, int(falling.starts[at]))
                runs.append((int(falling.lengths[at]), at_rank - int(falling.starts[at]), at_rank - begin, each, first))
            changed = (falling.starts[low + 1:high] - begin) // each
            steps += [changed, np.minimum(changed + 1, times)]
        steps = np.unique(np.concatenate(steps))
        filled = np.zeros(len(steps) - 1, np.int64)
        for i in used.tolist():
            each, begin = int(filling[i]), int(group_start[i] + passed[i])
            at = begin + each * steps[:-1]
            filled += falling.tokens_before(at + each) - falling.tokens_before(at)
            passed[i] += each * times
        stretches += [(capacity - int(f), first + int(a), int(b - a))
                      for f, a, b in zip(filled, steps[:-1], steps[1:], strict=True)]
        first += times
    return runs, stretches, first


def best_fit(stretches: list[tuple[int, int, int]], counts: dict[int, int], capacity: int,
             sequences: int) -> tuple[list[Run], int]:
    """Runs of short pieces into the rooms left, and the number of sequences then.

    `stretches` are sequences with equal room (room, first, number), `counts` how many pieces have each length.
    Pieces go by falling length, each to the least room that holds it, equal ones all at once; new sequences
    are numbered behind the `sequences` there are.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    runs: list[Run] = []

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((first, many))

    for stretch in stretches:
        put(*stretch)
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                many = -(-left // (capacity // length))
                put(capacity, sequences, many)
                sequences += many
            room = order[at]
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, done, 0, each, first))
                done, left = done + full * each, left - full * each
                put(room - each * length, first, full)
            if left and full < many:
                # The last of this length fill a part of one sequence.
                runs.append((length, done, 0, left, first + full))
                put(room - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            put(room, first + full, many - full)
    return runs, sequences


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS,
         short: int = SHORT) -> tuple[list[Run], int]:
    """Runs for all pieces and the number of sequences: the best packing among the numbers of groups."""
    above = capacity // short
    falling = Falling(counts, above)
    small = {length: int(n) for length, n in enumerate(counts[:above + 1].tolist()) if n}
    best: tuple[list[Run], int] | None = None
    for number in groups:
        sizes, demands = linear_groups(counts, above, number)
        runs, stretches, used = substitute(configurations(sizes, demands, capacity), demands, falling, capacity)
        more, used = best_fit(stretches, small, capacity, used)
        if best is None or used < best[1]:
            best = runs + more, used
    return best


def lay(lengths: np.ndarray, ranks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The sequence of each piece by its length and its rank among equal lengths; runs are in order of both."""
    at = np.searchsorted(runs[:, 0] << 48 | runs[:, 1], lengths << 48 | ranks, "right") - 1
    run = runs[at]
    return run[:, 4] + (run[:, 2] + ranks - run[:, 1]) // run[:, 3]


# ---- tokens ------------------------------------------------------------------------------------------------------

# A part of a text, or of many short texts, that is encoded at once.
SEGMENT_BYTES = 1 << 22
KNOWN_WORDS = 600_000
LONGEST_KNOWN = 64
# Words that are encoded together as one line.
LINE = 512
ENDINGS = b".,;:!?$#*%"
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


def _letters(word: bytes) -> bool:
    """Whether a word is nothing but Latin letters: the tokenizer takes such a one as a single part."""
    text = word.decode() if len(word) <= LONGEST_KNOWN else ""
    return text.isalpha() and max(text) < "\u0130"


class WordIds:
    """Ids of texts by the given tokenizer, word by word.

    The tokenizer never joins what ASCII blanks part, and takes upper-case ASCII letters as lower-case ones, so
    the ids of a text are those of its words; words met before are looked up. Texts that may hold
    one of its special strings keep their case. When the table of words is full it becomes the older one, of
    which words that are met again are taken over.
    """

    def __init__(self, path: str):
        # A task has one core: the tokenizer's own threads would only compete with other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        vocabulary = self.coder.get_vocab()
        # The last token of a part, and no other one, carries the suffix that tells its end.
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closing[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _coded(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each word encoded for itself."""
        texts = b" ".join(words).decode().split(" ")
        return (array("I", c.ids).tobytes() for c in self.coder.encode_batch_fast(texts, add_special_tokens=False))

    def _coded_lines(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words of letters with their ids: many of them in a line, taken apart behind the tokens that end a word."""
        for at in range(0, len(words), LINE):
            line = words[at:at + LINE]
            # A line at a time, so that the tokenizer's own records do not pile up.
            coded = self.coder.encode_batch_fast([b" ".join(line).decode()], add_special_tokens=False)
            ids = np.array(coded[0].ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
            if len(ends) == len(line) and ends[-1] == 4 * len(ids):
                raw = ids.astype("<u4").tobytes()
                yield from zip(line, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)
            else:
                yield from zip(line, self._coded(line), strict=True)

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not known: endings of punctuation behind an ASCII letter, or a word of letters, are encoded apart."""
        known, older = self.known, self.older
        made = {w: older[w] for w in words.intersection(older)}
        words = words.difference(made)
        asked = [w for w in words if w[-1] not in ENDINGS]
        ends = []
        parts = set()
        for word in words.difference(asked):
            stem = word.rstrip(ENDINGS)
            if stem and (stem[-1] in LETTERS or stem[-1] > 127 and _letters(stem)):
                ending = word[len(stem):]
                ends.append((word, stem, ending))
                parts.add(stem)
                parts.add(ending)
            else:
                asked.append(word)
        for part in parts.difference(asked, made):
            ids = known.get(part) or older.get(part)
            if ids is None:
                asked.append(part)
            else:
                made[part] = ids
        letters, others = [], []
        for word in asked:
            (letters if word.isalpha() and len(word) <= LONGEST_KNOWN or not word.isascii() and _letters(word) else others).append(word)
        if letters:
            made.update(self._coded_lines(letters))
        if others:
            made.update(zip(others, self._coded(others), strict=True))
        for word, stem, ending in ends:
            made[word] = made[stem] + made[ending]
        return made

    def _segments(self, text: bytes) -> Iterator[list[bytes]]:
        text = text if b"<|" in text else text.lower()
        if len(text) <= SEGMENT_BYTES:
            yield text.split()
            return
        at = 0
        while at < len(text):
            cut = next((i for i in range(at + SEGMENT_BYTES, len(text)) if text[i] in b" \t\n\v\f\r"), len(text))
            yield text[at:cut].split()
            at = cut

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; for texts of a few megabytes in all."""
        split = [list(self._segments(t)) for t in texts]
        asked = set().union(*(words for parts in split for words in parts))
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        fresh = self._learn(asked.difference(self.known))
        self.known.update(fresh)
        find = self.known.__getitem__
        made = [b"".join(map(find, parts[0] if len(parts) == 1 else chain.from_iterable(parts))) for parts in split]
        for word in fresh:
            if len(word) > LONGEST_KNOWN:
                del self.known[word]
        return made


_CODERS: dict[str, WordIds] = {}


def coder_of(path: str) -> WordIds:
    claim("packing", _CODERS.clear)
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- rows --------------------------------------------------------------------------------------------------------

def _slabs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about a segment together, one at least, each list with its first row."""
    first, slab, size = 0, [], 0
    for at in range(len(texts)):
        slab.append(texts[at].as_py())
        size += len(slab[-1])
        if size >= SEGMENT_BYTES:
            yield first, slab
            first, slab, size = at + 1, [], 0
    if slab:
        yield first, slab


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1,
               keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, nth and, if asked for, ids.

    A document is its ids and `end_id`; longer ones are cut after every `capacity` ids. `nth` counts the
    pieces of a length within the task that made them.
    """
    need(docs, "doc_id", "text")
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with collector_off():
            yield from cut(coder_of(path), TaskContext.get().partitionId(), batches)

    def cut(coder: WordIds, task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, slab in _slabs(batch.column(1).cast(pa.binary())):
                row, piece, length, crc, ids = [], [], [], [], []
                for at, coded in enumerate(coder.encode(slab), start=first):
                    coded += end
                    for number, begin in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[begin:begin + 4 * capacity]
                        row.append(at)
                        piece.append(number)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")
                nth = np.empty(len(lengths), np.int64)
                nth[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
                nth += seen[lengths]
                seen += np.bincount(lengths, minlength=capacity + 1)
                pieces = np.array(piece, np.int64)
                columns = [
                    batch.column(0).take(pa.array(row)), pa.array(pieces, pa.int32()), pa.array(pieces * capacity),
                    pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, "
              "ids_crc32 long, task int, nth long" + (", ids binary" if keep_ids else ""))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _sequence(runs: list[Run], length: Column, rank: Column) -> Column:
    """The plan's sequence for a piece; the runs (bounded by the capacity and the groups) travel with the expression."""
    ordered = np.array(sorted(runs), np.int64).reshape(-1, 5)

    @F.arrow_udf("long")
    def find(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        return pa.array(lay(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False), ordered))

    return find(length, rank)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1,
                   keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With `keep_ids` the pieces' ids follow (little-endian unsigned 32-bit). Null texts count as empty and are the
    end id alone; repeated rows are packed each for itself, rows without an id too; other columns are not read;
    an empty table gives an empty result. Sequences are numbered from 0, each has one piece at least, and
    pieces lie in it by falling length.
    """
    pieces = stored(cut_pieces(docs, path, capacity, end_id, keep_ids))
    tallies = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("many"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, many in tallies.groupBy("length").agg(F.sum("many")).collect():
        counts[length] = many
    runs, _ = plan(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tallies.select("length", "task", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.withColumn("sequence_id", _sequence(runs, F.col("length"), F.col("rank")))
    # A sequence has at most `capacity` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of `pack_documents(..., keep_ids=True)`: sequence_id, the lengths of its pieces and input_ids."""
    need(packed, "sequence_id", "offset", "length", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.length").alias("lengths"),
        F.aggregate("parts", F.lit(b""), lambda made, part: F.concat(made, part["ids"])).alias("input_ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_packing": op12_packing}
ORACLES: dict[str, str] = {}
