"""Fill-in-middle transformation with cuts found in SWAR words.

A text's UTF-8 bytes are viewed as unsigned 64-bit words. Arithmetic on whole words marks the high bit
of every byte that ends a unit (blanks and the word behind them, or trailing blanks); bitwise_count gives
the units of a word, a running sum is searched for the word a unit ends in, and a multiplication
resolves the place inside that word. Only the places leave Python: form, output and the way back are
column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm.common import need, ship, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLAB_BYTES = 1 << 20
CUTS = "n long, prefix_chars long, middle_chars long"


def _spread(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


ONES, LOW, HIGH = _spread(0x01), _spread(0x7F), _spread(0x80)
SPACES, FROM_TAB, ABOVE_RETURN = _spread(0x20), _spread(0x80 - 0x09), _spread(0x80 - 0x0E)


class Marks:
    """Marked bytes, at most one per byte: how many lie before a place, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def before(self, place: np.ndarray) -> np.ndarray:
        word = place >> 3
        below = (np.uint64(1) << (place & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        inside = np.bitwise_count(self.marks[word] & below)
        return np.where(word > 0, self.upto[word - 1], 0) + inside

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte of the rank-th mark, from 1."""
        word = np.searchsorted(self.upto, rank)
        left = rank - np.where(word > 0, self.upto[word - 1], 0)
        # Byte j of the product counts the marks of bytes 0 to j; those that reach `left` keep their high bit.
        running = (self.marks[word] >> np.uint64(7)) * ONES
        reached = ((running | HIGH) - left.astype(np.uint64) * ONES) & HIGH
        return 8 * word + 8 - np.bitwise_count(reached)


def _mark(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Bytes that end a unit and bytes that begin a code point, of texts lying one behind the other."""
    # At least one whole word of blanks behind the last text.
    padded = np.full((len(data) // 8 + 2) * 8, 0x20, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    low = words & LOW
    other = words ^ SPACES
    blank = ~(((other & LOW) + LOW) | other) & HIGH
    blank |= (low + FROM_TAB) & ~(low + ABOVE_RETURN) & ~words & HIGH
    follows = blank >> np.uint64(8)
    follows[:-1] |= blank[1:] << np.uint64(56)
    units = ~blank & HIGH & follows
    last = ends[ends > starts] - 1
    np.bitwise_or.at(units, last >> 3, np.uint64(0x80) << (last & 7).astype(np.uint64) * np.uint64(8))
    points = ~(words & ~(words << np.uint64(1))) & HIGH
    return Marks(units), Marks(points)


def find_cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of every text, and the characters before the first cut and between the cuts.

    Text i is the bytes bounds[i] to bounds[i + 1]; its cuts are behind h1 % (n + 1) and h2 % (n + 1) units.
    """
    starts, ends = bounds[:-1], bounds[1:]
    units, points = _mark(data, starts, ends)
    first = units.before(starts)
    n = units.before(ends) - first
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        found = starts.copy()
        some = k > 0
        found[some] = units.select(first[some] + k[some]) + 1
        return found

    begun, near, far = (points.before(p) for p in (starts, place(np.minimum(a, b)), place(np.maximum(a, b))))
    return n, near - begun, far - near


def _cut_batch(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    bounds = bounds[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    keys = [h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2)]
    made, at = [], 0
    while at < len(texts):
        # As many texts as a slab holds, one at least: few words at a time stay in the processor's cache.
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLAB_BYTES, "right")) - 1)
        part = bounds[at:end + 1]
        made.append(find_cuts(data[part[0]:part[-1]], part - part[0], keys[0][at:end], keys[1][at:end]))
        at = end
    columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      ["n", "prefix_chars", "middle_chars"])


def unit_cuts(text: Column, h1: Column, h2: Column) -> Column:
    """Units and cut places of a text that is not null: a struct of n, prefix_chars, middle_chars."""

    @F.arrow_udf(CUTS)
    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return _cut_batch(texts, first, second)

    return cut(text, h1, h2)


def fill_in_middle(docs: DataFrame, seed: int = 42, moved: int = 50, suffix_first: int = 80) -> DataFrame:
    """Every document with its units, form, cuts and transformed text.

    Returns all columns of `docs` but the text (given columns of the names below are replaced) and n, form,
    prefix_chars, middle_chars, text (null counts as empty) and output. `moved` of 100 documents are cut, and
    `suffix_first` of 100 of those as suffix, prefix, middle; the draw depends on the seed and the id
    alone, so repeated ids draw alike and all null ids draw alike. Texts that are empty or hold a mark stay
    plain. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    ship(docs.sparkSession)
    made = ("n", "form", "prefix_chars", "middle_chars", "text", "output")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                    .cast("binary"), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= moved)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = docs.select(
        F.struct(*docs.columns).alias("given"), text.alias("text"), form.alias("form"),
        unit_cuts(text, h1, h2).alias("cuts"))
    before, inside = F.col("cuts.prefix_chars").cast("int"), F.col("cuts.middle_chars").cast("int")
    prefix = F.substring("text", F.lit(1), before)
    middle = F.substring("text", before + 1, inside)
    suffix = F.substring("text", before + inside + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text")))
    is_cut = F.col("form") != "plain"
    return cut.select(
        *[F.col("given")[c].alias(c) for c in docs.columns if c not in made],
        F.col("cuts.n").alias("n"), "form",
        F.when(is_cut, F.col("cuts.prefix_chars")).alias("prefix_chars"),
        F.when(is_cut, F.col("cuts.middle_chars")).alias("middle_chars"),
        "text", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from, by output and form alone; null stays null."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    body = F.substring(head, F.lit(4), F.length(head))

    def sides(mark: str) -> tuple[Column, Column]:
        return F.substring_index(body, mark, 1), F.substring_index(head, mark, -1)

    psm, spm = sides(SUFFIX), sides(PREFIX)
    return (F.when(form == "psm", F.concat(psm[0], middle, psm[1]))
            .when(form == "spm", F.concat(spm[1], middle, spm[0])).otherwise(output))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, half of them cut for filling in, and read back."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {"op13_fim": op13_fim}
ORACLES = {"op13_fim": r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
      or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
    array_to_string(units[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""}
