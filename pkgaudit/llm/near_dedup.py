"""Near-duplicate classes by bottom-k sketches of one hash function.

A row's set holds the 64-bit hashes of its distinct word shingles; its sketch, the 64 least values of
the set. Rows with the same set are one class and go on as one. Retained values are counted over all
classes and every sketch is put in order from rare to frequent; inverted lists are kept of pairs of neighbours
in the rare part of that order. Two sets with a Jaccard of 0.8 or more share such a pair (see `FIRST`),
while what many texts have in common (frequent words, a passage, a licence) is at the far end of the order.

A list names one of its members, and lists with the same member are one group. In some rounds all members of a
group meet that member alone, which joins large groups at once. Only groups that still hold different
components are looked at whole, in blocks of bounded size: bit maps of the sketches, where the overlap of
all pairs of a block is counted at once, tell the rows with a likely partner, and blocks of the full sets
of these give links between components. No pair is written that does not join components, and
all links are confirmed on words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm.common import claim, may_be_in, need, release, ship, stored, table

# Words of a shingle where no contract says otherwise.
SIZE = 5
SKETCH = 64
# Neighbours are taken from the first values of a sketch in order from rare to frequent. At a Jaccard of just 0.8, the
# share of links without a common pair among the first k falls by 0.45 for each value (1 in 5,000 at 12, measured):
# 1 link in 1e12 at 37, fewer above. A sketch that is a whole set gives all its neighbours: as the values that only one
# of two sets has are at most a quarter of those they share, they cannot part all of these.
FIRST = 37
# Two sketches share 28 values or more but for 1 link in 3e10; small ones, which are whole sets, 0.8 of theirs.
SHARED = 28
# Of 64 values at Jaccard 0.8, under 29 are shared for about one pair in 1e10.
LEAST_ESTIMATE = 0.45
THRESHOLD = 80
ROUNDS = 2
SALT_ROWS = 256
# Rows of a part of a group, of which two are compared at a time: as bit maps, and as full sets (and their values).
MAP_ROWS = 2048
SET_ROWS = 1024
SET_VALUES = 500_000
COLUMNS = 2048
KEPT_WORDS = 300_000
WORDS = 16

_WORDS: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes methods know only ASCII letters and the six blanks."""
    return (text or "").encode().lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle of another kind."""
    claim("near_dedup", _WORDS.clear)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    hashed = []
    for word in words:
        value = _WORDS.get(word)
        if value is None:
            value = _WORDS[word] = xxhash.xxh64_intdigest(word)
        hashed.append(value)
    values = np.array(hashed, np.uint64)
    if 0 < len(values) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=size)], np.uint64).view(np.int64)
    if not len(values):
        return values.view(np.int64)
    out = values[:len(values) - size + 1]
    for k in range(1, size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[k:len(values) - size + 1 + k])
    return np.unique(out.view(np.int64))


def shingle_set(words: list[bytes], size: int = SIZE) -> set:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, row, text_hash, n (set size), k1, k2 (128-bit hash of the set), sketch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sketches = [], [], [], []
            for text in batch.column("text"):
                values = shingle_hashes(words_of(text.as_py()), size)
                digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64)
                n.append(len(values))
                k1.append(int(digest[0]))
                k2.append(int(digest[1]))
                sketches.append(values[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("text_hash"), pa.array(n, pa.int64()),
                 pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "row", "text_hash", "n", "k1", "k2", "sketch"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64("text").alias("text_hash"), "text",
    ).mapInArrow(run, "doc_id long, row long, text_hash long, n long, k1 long, k2 long, sketch array<long>")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """row, n, key of the lists that more than one class is in: neighbours in the rare part of a sketch."""
    # Sets of under 4 shingles have no partner at 0.8 but themselves.
    values = reps.filter("n >= 4").select("row", "n", F.explode("sketch").alias("v"))
    # It grows with the rows: never sent to all tasks.
    frequency = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").hint("merge")
    # Values of one class alone come first in the order and are in no list: they only use up places.
    ordered = values.join(frequency, "v").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("o"))
    places = F.when(F.col("n") > SKETCH, F.greatest(FIRST - SKETCH + F.size("o"), F.lit(0))).otherwise(F.size("o"))
    rare = F.slice(F.col("o.v"), F.lit(1), places)
    keys = F.transform(
        F.slice(rare, F.lit(1), F.greatest(F.size(rare) - 1, F.lit(0))), lambda v, i: F.xxhash64(v, F.get(rare, i + 1)))
    entries = stored(ordered.select("row", "n", F.explode(keys).alias("key")))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    return entries.join(shared, "key", "left_semi")


def _near_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose union sketch says they may be similar."""
    # Written first: where the pairs are few, Spark then sends them to the sketches instead of dealing all out.
    pairs = stored(pairs)
    both = pairs.join(sketches.select(F.col("row").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("row").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.filter(shared >= F.size(union) * F.lit(LEAST_ESTIMATE)).select("a", "b")


def _verifier(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by a, its own text first: one set is held while the others of its part stream by."""
        held, base = None, set()
        for batch in batches:
            out_a, out_b = [], []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for a, b, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(),
                                      part.column("text"), strict=True):
                    found = shingle_set(words_of(text.as_py()), size)
                    if b is None:
                        held, base = a, found
                    elif held == a:
                        common = len(found & base)
                        if common * 100 >= THRESHOLD * (len(found) + len(base) - common):
                            out_a.append(a)
                            out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int = SIZE) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. A row in many pairs is dealt over parts, each with its text."""
    pairs = stored(pairs)
    texts = may_be_in(texts, pairs.select(F.explode(F.array("a", "b")).alias("row")), "row")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("parts"))
    firsts = texts.join(parts, texts["row"] == parts["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    others = texts.join(pairs.join(parts, "a"), F.col("row") == F.col("b")).select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "text")
    return (
        firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        .select("a", "b", "text").mapInArrow(_verifier(size), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """row, comp (least row reachable) of all rows in links (a, b).

    Every row points at its least neighbour, pointers are followed twice, and links are drawn anew
    between what they point at; loops vanish and the links left are fewer each time. All steps are
    joins and minima, written to the shared folder.
    """
    edges = stored(links.select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("row"), F.least("a", "low").alias("to"))
        for _ in range(2):
            up = stored(up)
            nxt = up.select(F.col("row").alias("to"), F.col("to").alias("nxt"))
            up = up.join(nxt, "to").select("row", F.col("nxt").alias("to"))
        up = stored(up)
        labels = stored(
            up.withColumnRenamed("to", "comp") if labels is None else
            labels.join(up.withColumnRenamed("row", "comp"), "comp", "left")
            .select("row", F.coalesce("to", "comp").alias("comp")))
        ends = [up.select(F.col("row").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b")]
        edges = stored(
            edges.join(ends[0], "a").join(ends[1], "b").filter("to_a <> to_b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
    if labels is None:
        labels = links.select(F.col("a").alias("row"), F.col("b").alias("comp"))
    return labels


def _with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("row"))
    return members.join(labels, "row", "left").withColumn("comp", F.coalesce("comp", "row"))


def groups(members: DataFrame, turn: int) -> DataFrame:
    """a (the chosen member), row, n, comp: the members of all lists that chose `a` and hold two components or more."""
    order = F.xxhash64("row", F.lit(turn))
    chosen = members.groupBy("key").agg(
        F.min_by("row", order).alias("a"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    return members.join(chosen.select("key", "a"), "key").select("a", "row", "n", "comp").distinct()


def _met_one(groups_of: DataFrame) -> DataFrame:
    """Pairs (a: the chosen member of a group, b: a member of another component)."""
    heads = groups_of.filter("a = row").select("a", F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
    return (
        groups_of.join(heads, "a").filter("comp <> comp_a").filter(_near_in_size(F.col("n"), F.col("n_a")))
        .select("a", F.col("row").alias("b")))


def must_share(n: np.ndarray) -> np.ndarray:
    """Values that the sketches of two similar sets share at least."""
    return np.minimum(SHARED, -(-n * THRESHOLD // 100))


def bit_maps(sketches: pa.Array) -> np.ndarray:
    """1,024 bits of every sketch, one for each value: 28 values in common make 20 bits in common but once in 1e10."""
    ends = np.cumsum([0, *(len(s) for s in sketches)])
    values = sketches.flatten().to_numpy()
    maps = np.zeros((len(sketches), WORDS), np.uint64)
    row = np.repeat(np.arange(len(sketches)), np.diff(ends))
    bit = np.uint64(1) << ((values >> 4) & 63).astype(np.uint64)
    np.bitwise_or.at(maps, (row, values & (WORDS - 1)), bit)
    return maps


def with_maps(sketches: DataFrame) -> DataFrame:
    """row, sketch and map: the bit map of the sketch, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [m.astype("<u8").tobytes() for m in bit_maps(batch.column("sketch"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.binary())], ["row", "sketch", "map"])

    return sketches.mapInArrow(run, "row long, sketch array<long>, map binary")


def in_parts(groups_of: DataFrame, rows: int, values: int | None) -> DataFrame:
    """The groups with the parts (x <= y) whose rows meet: a group of p parts gives every row p times.

    A part has about `rows` rows or, if set sizes count, `values` values in all.
    """
    size = F.ceil(F.count(F.lit(1)) / rows)
    if values:
        size = F.greatest(size, F.ceil(F.sum("n") / values))
    parts = groups_of.groupBy("a").agg(size.cast("int").alias("parts"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    own = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return (
        groups_of.join(parts.filter("low <> high"), "a").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("a", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "row", "n", "comp",
                F.col("parts")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other with the same (a, x, y), as one batch each."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("a", "x", "y")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if held and key != tuple(keys[:, start]):
                yield pa.concat_batches(held)
                held = []
            key = tuple(keys[:, start])
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.concat_batches(held)


def _sides(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two parts of a block; the same ones where a part meets itself."""
    own, x, y = (block.column(c).to_numpy() for c in ("own", "x", "y"))
    return np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0])


def _apart(block: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of the two sides are of different components and near enough in size."""
    comp, n = block.column("comp").to_numpy(), block.column("n").to_numpy()
    a, b = n[left][:, None], n[right][None, :]
    return (comp[left][:, None] != comp[right][None, :]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * THRESHOLD)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block whose sketch may have a partner's values in another component."""
    for block in _blocks(batches):
        left, right = _sides(block)
        n = block.column("n").to_numpy()
        maps = np.frombuffer(b"".join(block.column("map").to_pylist()), "<u8").reshape(-1, WORDS)
        shared = np.zeros((len(left), len(right)), np.uint16)
        for word in range(WORDS):
            shared += np.bitwise_count(maps[left, word][:, None] & maps[right, word][None, :])
        least = must_share(np.maximum(n[left][:, None], n[right][None, :])) * 6 / 7 - 4
        found = (shared >= least) & _apart(block, left, right)
        rows = np.union1d(left[found.any(1)], right[found.any(0)])
        yield pa.RecordBatch.from_arrays(
            [block.column(c).take(pa.array(rows)) for c in ("a", "row", "n", "comp")], ["a", "row", "n", "comp"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    found = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return found
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    for at in range(0, len(common), COLUMNS):
        part = common[at:at + COLUMNS]
        tables = []
        for values, rows in sides:
            column = np.minimum(np.searchsorted(part, values), len(part) - 1)
            here = part[column] == values
            table = np.zeros((len(left) if not tables else len(right), len(part)), np.float32)
            table[rows[here], column[here]] = 1
            tables.append(table)
        found += (tables[0] @ tables[1].T).astype(np.int64)
    return found


def _linker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a block between components, as few as join what its links join."""
        for block in _blocks(batches):
            left, right = _sides(block)
            sets = [shingle_hashes(words_of(t.as_py()), size) for t in block.column("text")]
            lengths = np.array([len(s) for s in sets], np.int64)
            shared = intersections([sets[i] for i in left], [sets[i] for i in right])
            union = lengths[left][:, None] + lengths[right][None, :] - shared
            i, j = np.nonzero((shared * 100 >= union * THRESHOLD) & _apart(block, left, right))
            comp, row = block.column("comp").to_numpy(), block.column("row").to_numpy()
            ends = np.sort(np.stack([comp[left[i]], comp[right[j]]], 1), 1)
            _, first = np.unique(ends, axis=0, return_index=True)
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            a, b = [], []
            for k in first.tolist():
                low, high = sorted((find(int(ends[k, 0])), find(int(ends[k, 1]))))
                if low != high:
                    root[high] = low
                    a.append(int(row[left[i[k]]]))
                    b.append(int(row[right[j[k]]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _met_all(groups_of: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links that join the components of a group as all its links do."""
    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.repartition("a", "x", "y").sortWithinPartitions("a", "x", "y")

    likely = stored(
        dealt(in_parts(groups_of, MAP_ROWS, None).join(sketches.select("row", "map"), "row"))
        .select("a", "x", "y", "own", "row", "n", "comp", "map")
        .mapInArrow(_likely, "a long, row long, n long, comp long").distinct())
    return (
        dealt(in_parts(likely, SET_ROWS, SET_VALUES).join(may_be_in(texts, likely, "row"), "row")).select("a", "x", "y", "own", "row", "n", "comp", "text")
        .mapInArrow(_linker(size), "a long, b long").distinct())


def near_classes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, row, text_hash, n_shingles, component_id, component of every row.

    Rows are linked if their sets of distinct `size`-word shingles have a Jaccard of 0.8 or more, and
    component_id is the least doc_id reachable. A text of fewer words is one shingle; a null or blank
    one has none and is linked with nothing. Rows that repeat a text are of one class. A null doc_id
    counts only where a component has no other. Ids may be null or repeated, so component_id does not
    tell components apart; `component`, a row of each, does. An empty table gives an empty result;
    other columns are not read.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    marks = stored(signatures(docs, size))
    classes = stored(marks.filter("n > 0").groupBy("n", "k1", "k2").agg(
        F.min("doc_id").alias("class_id"), F.min("row").alias("rep")))
    reps = marks.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    members = stored(inverted_lists(reps))
    release(spark)
    listed = stored(members.select("row").distinct())
    sketches = stored(with_maps(may_be_in(marks.select("row", "sketch"), listed, "row").join(listed, "row")))
    wanted = marks.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).join(listed, "row")
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    found = may_be_in(source, wanted, "_id", "_hash").alias("s").join(
        wanted.alias("w"), F.col("s._id").eqNullSafe(F.col("w._id")) & (F.col("s._hash") == F.col("w._hash")))
    # Rows may repeat an id and a text: of those, one is enough.
    texts = stored(found.select("row", "text").dropDuplicates(["row"]))
    release(spark)

    labels, links = None, None
    for turn in range(ROUNDS):
        pairs = _met_one(stored(groups(_with_components(members, labels), turn)))
        new = verified(estimated(pairs, sketches), texts, size)
        links = stored(new if links is None else links.unionByName(new))
        labels = components(links)
        release(spark)
    rest = stored(groups(_with_components(members, labels), ROUNDS))
    links = links.unionByName(stored(verified(_met_all(rest, sketches, texts, size), texts, size)))
    release(spark)
    labels = components(links)

    named = classes.join(labels.withColumnRenamed("row", "rep"), "rep", "left").withColumn(
        "comp", F.coalesce("comp", "rep"))
    least = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    by_class = named.join(least, "comp").select("n", "k1", "k2", "comp", "component_id")
    return marks.select("doc_id", "row", "text_hash", "n", "k1", "k2").join(by_class, ["n", "k1", "k2"], "left").select(
        "doc_id", "row", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("comp", "row").alias("component"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near copies they belong to, on two-word shingles."""
    return near_classes(table(spark, sf_dir, "documents"), size=2).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {"op4_near_dedup": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then ws
    else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
counted as (select g, doc_id, n, count(*) over (partition by g) as df from e),
ranked as (select *, row_number() over (partition by doc_id order by df, g) as r from counted),
-- Sets with a Jaccard of 0.8 share one of their first n - ceil(0.8 n) + 1 shingles, in any common order.
prefix as (select * from ranked where r <= n - ceil(0.8 * n) + 1),
pairs as (
  select distinct a.doc_id as a, b.doc_id as b from prefix a join prefix b
  on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
common as (select p.a, p.b, count(*) as c from pairs p join e x on x.doc_id = p.a join e y on y.doc_id = p.b and x.g = y.g group by 1, 2),
links as (
  select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b
  where 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
both_ways as (select a, b from links union select b, a from links),
reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select s.doc_id, len(sh)::bigint as n_shingles, m.c as component_id, s.doc_id = m.c as kept
from s join (select a, min(b) as c from reach group by a) m on m.a = s.doc_id
"""}
