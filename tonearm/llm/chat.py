"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: ``[INST]role[/INST]text</s>`` for each turn. It is encoded once, with the code
point offsets of every token, and the sorted spans of the trained turns' texts are intersected with the sorted token
spans by binary search. The template's control strings are tokens of their own, so no token crosses the edge of a turn.
Inside roles and texts a backslash after the first character keeps control strings apart from the
template's; strings that have such backslashes already get one more, which makes the escape reversible.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), role and text, so ties and repeated rows
have a fixed order and all stay; a null conversation id is one conversation; an empty table gives no rows.
A conversation is one string, so its turns meet in one task. Only the named columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TRAINED = ("assistant",)
#: Conversations encoded at a time; the tokenizer holds their tokens as Python objects until they are packed.
ENCODED = 32
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/s>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/s>)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], trained=TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the sorted code point spans of its trained texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{OPEN}{escape(role)}{CLOSE}"
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns that :func:`render` made the text of."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (rows of sorted start, end) lie within the sorted spans."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        s = np.array(spans)
        first = np.searchsorted(offsets[:, 1], s[:, 0], side="right")
        last = np.searchsorted(offsets[:, 0], s[:, 1], side="left")
        for a, b in zip(first, last):
            mask[a:b] = True
    return mask


def tokenizer(path: str):
    """The tokenizer of a file that the driver can read."""
    return tokenizer_of(Path(path).read_text(encoding="utf-8"))


@lru_cache(maxsize=2)
def tokenizer_of(definition: str):
    """The tokenizer with the control strings as added tokens; its own special tokens are ordinary text."""
    from tokenizers import AddedToken, Tokenizer, decoders, pre_tokenizers

    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.decoder = decoders.ByteLevel()
    t.add_tokens([AddedToken(x, normalized=False, special=False) for x in (OPEN, CLOSE, END)])
    t.no_padding()
    t.no_truncation()
    return t


def format_chats(turns: DataFrame, tokenizer_path: str = TOKENIZER, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained=TRAINED) -> DataFrame:
    """``conv_id``, formatted text, input_ids, token offsets (start, end) and loss_mask, one row a conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    # A vocabulary of a few megabytes, whatever the input; executors need no copy of the file.
    definition = turns.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches):
        t = tokenizer_of(definition.value)
        for pdf in batches:
            for at in range(0, len(pdf), ENCODED):
                part = pdf.iloc[at : at + ENCODED]
                made = [render([(x["role"], x["text"]) for x in turns], trained) for turns in part["turns"]]
                codes = t.encode_batch([x[0] for x in made], add_special_tokens=False)
                offsets = [np.array(c.offsets, dtype=np.int64).reshape(-1, 2) for c in codes]
                yield pd.DataFrame({"conv": part["conv"].to_numpy(), "text": [x[0] for x in made], "input_ids": [c.ids for c in codes], "starts": [o[:, 0] for o in offsets], "ends": [o[:, 1] for o in offsets], "loss_mask": [loss_mask(o, x[1]) for o, x in zip(offsets, made)]})

    kind = turns.schema[conv_col].dataType.simpleString()
    out = whole.mapInPandas(run, f"conv {kind}, text string, input_ids array<int>, starts array<long>, ends array<long>, loss_mask array<boolean>")
    return out.withColumnRenamed("conv", conv_col)


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted chats: turns from the text, trained texts from the masked tokens' offsets."""

    def run(batches):
        for pdf in batches:
            out = []
            for text, starts, ends, mask in zip(pdf["text"], pdf["starts"], pdf["ends"], pdf["loss_mask"]):
                turns = parse(text)
                mask = np.asarray(mask, dtype=np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).reshape(-1, 2)
                under = "".join(unescape(text[starts[a] : ends[b - 1]]) for a, b in edges)
                out.append((len(turns), hexed("".join(f"{r}\n{x}\n" for r, x in turns)), len(under), hexed(under), len(text)))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).assign(conv=pdf["conv"].to_numpy())

    kind = chats.schema[conv_col].dataType.simpleString()
    rows = chats.select(F.col(conv_col).alias("conv"), "text", "starts", "ends", "loss_mask")
    out = rows.mapInPandas(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)


def hexed(text: str) -> str:
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op4_chat(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return digests(format_chats(turns.union(extra)))


#: The escape adds one character to each control string; markers add 17 to each turn.
OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text) + len(regexp_extract_all(role, '[\[<]\\*(/?INST\]|/s>)')) + len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/s>)')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
