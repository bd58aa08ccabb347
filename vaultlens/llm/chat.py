"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  The
formatter renders successive turn prefixes and compares consecutive outputs:
what the longer one adds is the turn's span.  A template whose longer output
does not begin with the shorter one rewrites history, which is reported.  The
text's place within a span is found by rendering the turn once more with a
probe for its text.  So masks are right for every template whose frame around a
text does not depend on that text, without parsing the template.

Every prefix is rendered whole, whatever its length, so time is quadratic in a
conversation's text.  Only a template that declares with ``append_only`` that a
turn's output depends on no other turn is rendered turn by turn behind an empty
history, in linear time; the whole conversation is then rendered once and must
give the same.  The default template does not declare it.

Defined cases: null text and null role are empty; turns of a conversation are
ordered by turn, role and text, null first; repeated rows are turns each; a
null conv_id is a conversation of its own (one task handles a conversation whole); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import arrow_schema, batch, picked, spark_type

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PROBE = "\U0010fffd"

Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str) -> str:
    """Put one more backslash between every ``<`` and ``|``, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def marked(turns: list[tuple[str, str]]) -> str:
    """The default template: each turn between marks, its role on a line of its own."""
    return "".join(f"{START}{escape(role).replace(chr(10), LINE)}\n{escape(text)}{END}\n" for role, text in turns)


def parse_marked(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``marked`` has formatted."""
    found = re.findall(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", formatted, re.DOTALL)
    return [(unescape(role.replace(LINE, "\n")), unescape(text)) for role, text in found]


@dataclass
class Span:
    role: str
    start: int
    end: int
    text_start: int
    text_end: int


def walk(turns: list[tuple[str, str]], template: Template, known: int = 0) -> tuple[str, list[Span], bool]:
    """(formatted text, span of each turn after the known ones, whether a longer prefix ever changed what a shorter one gave)."""
    before, spans, rewrites = template(turns[:known]), [], False
    for k in range(known + 1, len(turns) + 1):
        role, text = turns[k - 1]
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites, start = True, len(commonprefix([before, now]))
        probed = template([*turns[: k - 1], (role, PROBE)])
        at = probed.find(PROBE, min(start, len(probed)))
        tail = len(probed) - at - len(PROBE)
        spans.append(Span(role, start, len(now), *((at, len(now) - tail) if at >= 0 and now[:at] == probed[:at] else (start, start))))
        before = now
    return before, spans, rewrites


def append_only(template: Template) -> Template:
    """Declare that what template adds for a turn depends on that turn alone."""
    template.append_only = True
    return template


def render(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[Span], bool]:
    """walk(), turn by turn for templates that declare themselves append-only and keep to it."""
    if not getattr(template, "append_only", False):
        return walk(turns, template)
    done, spans, head = template([]), [], len(template([]))
    parts, at = [done], head
    for turn in turns:
        alone, (s,), rewrites = walk([turn], template)
        if rewrites:
            return walk(turns, template)
        shift = at - head
        spans.append(Span(s.role, s.start + shift, s.end + shift, s.text_start + shift, s.text_end + shift))
        parts.append(alone[head:])
        at += len(alone) - head
    done = "".join(parts)
    return (done, spans, False) if template(turns) == done else walk(turns, template)


CHAT = "conv_id long, formatted string, rewrites boolean, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"


def format_conversations(rows: DataFrame, template: Template = marked) -> DataFrame:
    """CHAT for every conversation of rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = picked(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = arrow_schema(CHAT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                got = [render([(t["role"], t["text"]) for t in turns], template) for turns in part.column("turns").to_pylist()]
                yield batch(out, part.column("conv_id").cast(pa.int64()), [g[0] for g in got], [g[2] for g in got], [[vars(s) for s in g[1]] for g in got])

    return grouped.mapInArrow(run, spark_type(CHAT))
