"""Chat formatting at the level of tokens.

Each turn is assembled from segments that are encoded apart: reserved ids of the template are spliced
around the encoded role and content, so no merge crosses a boundary and no text can make a reserved
id. The loss mask is the running sum of +1 where a trained segment begins and -1 where it ends.
Control strings inside a text are escaped, so the rendered text can be split again unambiguously too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pkgaudit.llm.byte_bpe import read_ranks, split_pattern, vocabulary_path
from pkgaudit.llm.common import claim, need, ship, table

# The template's own marks, in the order of their ids behind the vocabulary.
TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
MARKS = (TURN, SAYS, DONE)
# Strings that some template reads as control; each begins with < or [ and holds neither again.
CONTROLS = (*MARKS, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TRAINED = ("assistant",)


def _controls_pattern(controls: tuple[str, ...]) -> str:
    heads = {c[0] for c in controls}
    if any(h in c[1:] for c in controls for h in heads):
        raise ValueError("a control string may not hold a first character of one again")
    rests = sorted({c[1:] for c in controls}, key=lambda r: (-len(r), r))
    return f"([{re.escape(''.join(sorted(heads)))}])(\\\\*)({'|'.join(map(re.escape, rests))})"


class Template:
    """Ids, marks and escapes. A backslash behind the first character breaks a control string; one that
    is already broken gets one more, so taking one away undoes it."""

    def __init__(self, path: str, pattern: str, controls: tuple[str, ...] = CONTROLS, trained: tuple[str, ...] = TRAINED):
        ranks = read_ranks(path)
        self.first_free = max(ranks.values()) + 1
        self.mark_ids = {mark: self.first_free + i for i, mark in enumerate(MARKS)}
        self.marks = {i: mark for mark, i in self.mark_ids.items()}
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.trained = frozenset(trained)
        found = _controls_pattern(controls)
        self._escape = re.compile(found)
        self._unescape = re.compile(found.replace("(\\\\*)", "\\\\(\\\\*)", 1))

    def escape(self, text: str) -> str:
        return self._escape.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1\2\3", text)

    def assemble(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        role_ids = self.coder.encode_ordinary(self.escape(role))
        text_ids = self.coder.encode_ordinary(self.escape(text))
        ids = np.array([self.mark_ids[TURN], *role_ids, self.mark_ids[SAYS], *text_ids, self.mark_ids[DONE]], np.int32)
        change = np.zeros(len(ids) + 1, np.int8)
        if role in self.trained:
            change[len(role_ids) + 2] += 1
            change[len(role_ids) + 2 + len(text_ids)] -= 1
        return ids, np.cumsum(change[:-1], dtype=np.int8)

    def _text(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode()

    def read_back(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, the text under the mask, and the characters of the rendered turn, from ids alone."""
        says = int(np.flatnonzero(ids == self.mark_ids[SAYS])[0])
        role, text = self._text(ids[1:says]), self._text(ids[says + 1:-1])
        under = self.unescape(self._text(ids[mask.astype(bool)]))
        return self.unescape(role), self.unescape(text), under, len(role) + len(text) + sum(map(len, MARKS))

    def render(self, ids: np.ndarray) -> str:
        """The turn as text, marks written out."""
        says = int(np.flatnonzero(ids == self.mark_ids[SAYS])[0])
        return TURN + self._text(ids[1:says]) + SAYS + self._text(ids[says + 1:-1]) + DONE


_TEMPLATES: dict[tuple, Template] = {}


def template(*key) -> Template:
    claim("chat", _TEMPLATES.clear)
    if key not in _TEMPLATES:
        _TEMPLATES[key] = Template(*key)
    return _TEMPLATES[key]


def format_turns(turns: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, position, token_start, input_ids, loss_mask.

    A conversation is its turns' ids in order of position (by turn, then role and text; nulls first);
    token_start is the running sum of the lengths before. Null roles and texts count as empty; rows that
    repeat are turns of their own; rows without a conv_id form one conversation; an empty table gives
    an empty result; other columns are not read. Texts are encoded where they are read: what is put
    in order are lengths.
    """
    need(turns, "conv_id", "turn", "role", "text")
    ship(turns.sparkSession)
    key = (path or vocabulary_path(), pattern or split_pattern())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = template(*key)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [
                    used.assemble(role.as_py() or "", text.as_py() or "")
                    for role, text in zip(part.column("role"), part.column("text"), strict=True)]
                ends = np.cumsum([0, *(len(ids) for ids, _ in made)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("text_hash"),
                     pa.ListArray.from_arrays(ends, np.concatenate([ids for ids, _ in made])),
                     pa.ListArray.from_arrays(ends, np.concatenate([mask for _, mask in made]))],
                    ["conv_id", "turn", "role", "text_hash", "input_ids", "loss_mask"])

    rows = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("text_hash"))
    schema = T.StructType([
        *rows.drop("text").schema.fields, T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.ByteType()))])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text_hash")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.mapInArrow(run, schema).select(
        "conv_id", "turn", (F.row_number().over(order) - 1).alias("position"),
        F.coalesce(F.sum(F.size("input_ids")).over(before), F.lit(0)).cast("long").alias("token_start"),
        "input_ids", "loss_mask")


def digest_conversations(formatted: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """What the ids of each conversation say when read back, one row each.

    Turns stream by in order, conversation by conversation: running digests are held, never a whole
    conversation.
    """
    key = (path or vocabulary_path(), pattern or split_pattern())
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = template(*key)
        open_id, state = None, None

        def close() -> list:
            turns, loss = state["turns"], state["loss"]
            return [(open_id, state["n"], turns.hexdigest(), state["chars"], loss.hexdigest(), state["formatted"])]

        for batch in batches:
            done: list = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("input_ids"),
                                       batch.column("loss_mask"), strict=True):
                if state is None or conv != open_id:
                    if state is not None:
                        done += close()
                    open_id = conv
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
                role, text, under, chars = used.read_back(ids.values.to_numpy(), mask.values.to_numpy())
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(under.encode())
                state["chars"] += len(under)
                state["formatted"] += chars
            yield _digest_batch(done, batch)
        if state is not None:
            yield _digest_batch(close(), batch)

    def _digest_batch(rows: list, like: pa.RecordBatch) -> pa.RecordBatch:
        conv, n, turns, chars, loss, formatted = zip(*rows, strict=True) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, like.column("conv_id").type), pa.array(n, pa.int64()), pa.array(turns, pa.string()),
             pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(formatted, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = T.StructType([
        formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType())])
    return (
        formatted.select("conv_id", "position", "input_ids", "loss_mask")
        .repartition("conv_id").sortWithinPartitions("conv_id", "position")
        .select("conv_id", "input_ids", "loss_mask").mapInArrow(run, schema))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return digest_conversations(format_turns(given.unionByName(extra)))


QUERIES = {"op2_chat": op2_chat}
ORACLES = {"op2_chat": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|endoftext\|>|\|im_end\|>|\|turn\|>|\|says\|>|\|done\|>|/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g'))
    + length(role) + 24 as chars from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""}
