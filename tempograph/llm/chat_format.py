"""Chat formatting by token-level assembly.

Each turn's text is escaped and encoded by itself; reserved ids above the tokenizer's own mark turns, so no text can make one. The
loss mask is the prefix sum of +1 after an assistant mark and -1 at its end, over token ids. The rendered form writes the reserved
ids as control strings; where a text holds one, its k leading backslashes become 2k + 1, which reading back undoes.

Rows of a conversation are ordered by turn, ties by role and text, nulls first. A null text or role is empty. A conversation is one
row, so it is gathered in one task; rows of a null conv_id are one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table

#: Conversations that a task holds as Python values at once.
STEP = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Control strings of the reserved ids, in their order after the tokenizer's last id.
SYSTEM, USER, ASSISTANT, OTHER, NAMED, END = range(6)
CONTROLS = ["### System: ", "### User: ", "### Assistant: ", "### Turn: ", "</role>", "</turn>\n"]
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_CONTROL = r"(?:### (?:System|User|Assistant|Turn):|</role>|</turn>)"
# A run of backslashes is tried once, at its first one, so that long runs take linear time.
_PLAIN = re.compile(rf"(?<!\\)(\\*+)({_CONTROL})")
_ESCAPED = re.compile(rf"(?<!\\)(\\++)({_CONTROL})")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2], text)


class Codec:
    def __init__(self, definition: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[list[int], np.ndarray]:
        """Token ids and loss mask of (role, text) turns."""
        known = [r in ROLES for r, _ in turns]
        parts = self.encode([escape(x) for (role, text), k in zip(turns, known) for x in ((text,) if k else (role, text))])
        ids, at, opens, closes = [], 0, [], []
        for (role, _), k in zip(turns, known):
            ids.append(self.first + (ROLES[role] if k else OTHER))
            if not k:
                ids += parts[at]
                ids.append(self.first + NAMED)
                at += 1
            if role == "assistant":
                opens.append(len(ids))
            ids += parts[at]
            if role == "assistant":
                closes.append(len(ids))
            ids.append(self.first + END)
            at += 1
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, opens, 1)
        np.add.at(edges, closes, -1)
        return ids, np.cumsum(edges)[: len(ids)].astype(np.int8)

    @staticmethod
    def render(turns: list[tuple[str, str]]) -> str:
        """The text that the ids of these turns stand for."""
        head = lambda role: CONTROLS[ROLES[role]] if role in ROLES else CONTROLS[OTHER] + escape(role) + CONTROLS[NAMED]
        return "".join(head(role) + escape(text) + CONTROLS[END] for role, text in turns)

    def read(self, ids: list[int], mask: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
        """The turns, and the texts under the mask, from token ids."""
        turns, under, run, held, role = [], [], [], [], ""
        names = {v: k for k, v in ROLES.items()}
        for i, m in zip(ids, mask):
            mark = i - self.first
            if mark < 0:
                run.append(i)
                if m:
                    held.append(i)
                continue
            if mark == NAMED:
                role = unescape(self.decode(run))
            elif mark == END:
                turns.append((role, unescape(self.decode(run))))
                under.append(turns[-1][1] if held == run else unescape(self.decode(held)))
            else:
                role = names.get(mark, "")
            run, held = [], []
        return turns, under


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def format_chats(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, input_ids, loss_mask, formatted, from rows (conv_id, turn, role, text)."""
    definition = rows.sparkSession.sparkContext.broadcast(_definition(tokenizer))  # a vocabulary file
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def make():
        codec = Codec(definition.value)

        def work(batch: pa.RecordBatch) -> dict:
            chats = [list(zip(r, t)) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            made = [codec.assemble(c) for c in chats]
            return {"conv_id": batch.column(0), "input_ids": [np.array(i, np.int32) for i, _ in made], "loss_mask": [m for _, m in made], "formatted": [codec.render(c) for c in chats]}

        return work

    return map_batches(chats, make, "conv_id long, input_ids array<int>, loss_mask array<byte>, formatted string", STEP)


def read_chats(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Digests of what is read back from input_ids and loss_mask."""
    definition = formatted.sparkSession.sparkContext.broadcast(_definition(tokenizer))

    def make():
        codec = Codec(definition.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def work(batch: pa.RecordBatch) -> dict:
            back = [codec.read(i, m) for i, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return {
                "conv_id": batch.column(0), "n_turns": [len(t) for t, _ in back], "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t, _ in back],
                "loss_chars": [sum(map(len, u)) for _, u in back], "loss_sha256": [sha("".join(u)) for _, u in back], "formatted_chars": [len(f) for f in batch.column(3).to_pylist()],
            }

        return work

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(formatted.select("conv_id", "input_ids", "loss_mask", "formatted"), make, schema, STEP)


#: A conversation whose texts hold the template's own control strings.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_chats(format_chats(rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))))


_HEAD = "CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: ' ELSE '### Turn: ' || escaped_role || '</role>' END"
#: Escaping doubles the backslashes before a control string and adds one.
_ESCAPED_SQL = rf"regexp_replace({{0}}, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')"
OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)}) p(conv_id, turn, role, text)),
e AS (SELECT *, {_ESCAPED_SQL.format("text")} AS escaped, {_ESCAPED_SQL.format("role")} AS escaped_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_HEAD}) + length(escaped) + length('</turn>') + 1) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
