"""Chat formatting with a compiled template (see :mod:`template`).

The rows of a conversation are dealt by conv_id and sorted by turn; a task streams
them through the template and writes *parts* of whole turns, about ``PART_CHARS``
characters each, with the spans under the loss mask.  So a conversation of any length
passes through a task in bounded memory (a turn at a time), and nothing is collected.

Control strings inside texts are escaped so that they can't be taken for marks and
come back exactly: every "<", backslashes and "|" in a row get one backslash more.
In roles, line ends and backslashes are escaped too, as a line end ends the role.

Cases: a null text or role counts as empty; rows of one conversation with the same
turn are ordered by role and text; a null turn comes first; rows with a null conv_id
are one conversation with that id; repeated rows are turns of their own; an empty
table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit, template

#: A turn: <|im_start|>role, line end, text, <|im_end|>, line end; assistant texts are generated.
TEMPLATE = """{% for m in messages %}<|im_start|>{{ m.role | role }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>
{% endfor %}"""
#: Characters after which a part ends with its turn.
PART_CHARS = 1 << 18
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: str | None) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text or "")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


FILTERS = {"escape": escape, "role": escape_role, "trim": lambda s: (s or "").strip()}


class Sink:
    """Collects a part: its text and the spans under the mask (places in the whole output)."""

    def __init__(self):
        self.base = self.size = 0
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.open = 0

    def text(self, s: str) -> None:
        self.pieces.append(s)
        self.size += len(s)

    def mark(self, begins: bool) -> None:
        if begins:
            self.open = self.size
        else:
            self.spans.append((self.open, self.size))

    def part(self) -> tuple[int, str, list[tuple[int, int]]]:
        got = self.base, "".join(self.pieces), self.spans
        self.base, self.pieces, self.spans = self.size, [], []
        return got


def _id(v):
    return None if pd.isna(v) else int(v)


def _conversations(frames):
    """(conv_id, iterator of turns) of sorted rows."""
    def rows():
        for f in frames:
            yield from zip(map(_id, f["conv_id"].tolist()), f["role"].tolist(), f["text"].tolist())
    it = rows()
    row = next(it, None)
    while row is not None:
        conv, box = row[0], [row]

        def turns():
            while box[0] is not None and box[0][0] == conv:
                _, role, text = box[0]
                box[0] = next(it, None)
                yield {"role": role if isinstance(role, str) else "", "text": text if isinstance(text, str) else ""}
        yield conv, turns()
        row = box[0]


def _formatted(source: str):
    """Parts of sorted rows, each handed on as soon as it is cut."""
    def parts(frames):
        render = template.compile_template(source, FILTERS, stream=True)
        for conv, turns in _conversations(frames):
            sink, n = Sink(), 0
            # The template stops between turns, so what the sink has are whole turns.
            for _ in render({"messages": turns}, sink):
                if sink.size - sink.base >= PART_CHARS:
                    yield conv, n, *sink.part()
                    n += 1
            yield conv, n, *sink.part()
            for _ in turns:  # what the template hasn't asked for
                pass

    def run(frames):
        out, size = [], 0
        for r in parts(frames):
            out.append(r)
            size += len(r[3])
            if size > kit.CHUNK_BYTES:
                yield _parts(out)
                out, size = [], 0
        yield _parts(out)
    return run


def format_conversations(rows: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, start, text, spans) of each conversation: the formatted text in
    parts of whole turns; spans: the places (of the whole text) under the mask."""
    template.compile_template(source, FILTERS)  # a wrong template fails here

    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    dealt = rows.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(_formatted(source), "conv_id long, part long, start long, text string, spans array<struct<a: long, b: long>>")


def _parts(rows) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["conv_id", "part", "start", "text", "spans"])
    f["conv_id"] = f["conv_id"].astype("Int64")
    f["spans"] = [[{"a": a, "b": b} for a, b in s] for s in f["spans"]]
    return f


def turns_of(text: str):
    """(role, text) of each turn of a formatted part."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        yield unescape_role(text[at + len(START):line]), unescape(text[line + 1:end])
        at = end + len(END)


def read_back(parts: DataFrame) -> DataFrame:
    """Turns and mask of each conversation, from the formatted parts (which lie in order
    in their partition, as ``format_conversations`` returns them)."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(frames):
        now, state = object(), None
        for f in frames:
            out = []
            for conv, start, text, spans in zip(map(_id, f["conv_id"].tolist()), f["start"].tolist(), f["text"], f["spans"]):
                if state is None or conv != now:
                    if state is not None:
                        out.append(_closed(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    loss = unescape(text[s["a"] - start:s["b"] - start])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield _states(out)
        if state is not None:
            yield _states([_closed(now, state)])
    return parts.mapInPandas(run, schema)


def _closed(conv, s):
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def _states(rows) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    f["conv_id"] = f["conv_id"].astype("Int64")
    return f


#: What both turns of conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, read back from their formatted texts."""
    rows = kit.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return read_back(format_conversations(rows.unionByName(more)))


def _sql_escape(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


SQL = f"""
WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
           SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{START}{END}') + 1 + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM a GROUP BY conv_id
"""
