"""Chat formatting by incremental rendering: the template is a black box, and each turn's span is found by rendering.

Successive prefixes of a conversation are rendered and consecutive outputs compared. Where the longer output begins
with the shorter one, what it adds is the new turn's span; where it doesn't, the template rewrites history, and the
conversation is reported so. Inside a span, the text's place is found by rendering the same prefix with a probe in
place of the new text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import records

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a text in probes; neither escaping nor trimming changes it.
PROBE = "probe7Q"
#: Latest turns that a shortened context holds beside the first one, where a caller of spans() asks for it.
CONTEXT = 4
#: Characters of marked turns that are kept, as every prefix holds those of the one before; only speed depends on it.
KEPT_CHARS = 8_000_000


def escape(text: str) -> str:
    r"""Control strings can't occur in the result: a backslash is put before the bar of every ``<|``, and one more
    where there are some between the two already."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class _Marked(dict):
    """Turns between marks; emptied when they have come to KEPT_CHARS characters."""

    size = 0

    def __missing__(self, turn: Turn) -> str:
        out = f"{START}{_escape_role(turn[0])}\n{escape(turn[1])}{END}\n"
        if self.size + len(out) > KEPT_CHARS:
            self.clear()
            self.size = 0
        if len(out) <= KEPT_CHARS:
            self[turn] = out
            self.size += len(out)
        return out


_marked = _Marked()


def marked_turns(turns: list[Turn]) -> str:
    """The template of the query: every turn between marks, its texts escaped reversibly."""
    return "".join(map(_marked.__getitem__, turns))


def parsed(formatted: str) -> list[Turn]:
    """The turns of a text that marked_turns() has made."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        out.append((_unescape_role(role), unescape(text[: -len(END) - 1])))
    return out


def spans(turns: list[Turn], template: Template, full_chars: int | None = None) -> tuple[str, list[tuple[int, int, int, int]], bool | None, int]:
    """The whole rendering; for each turn its span and its text's span; whether the template rewrites history; and how
    many turns were checked by true prefixes.

    The rendering of all turns is always checked to be what the increments add up to. A template that rewrites
    history has no spans. All increments come from true prefixes, however long the conversation is, unless a caller
    gives full_chars: once these have come to so many characters, increments are rendered in a shortened
    context if the last of these prefixes gave the same increment with it as with the whole one; the verdict is then
    None where nothing speaks against the template, as a rewrite of a later prefix wouldn't have been seen. Where
    the final check fails, all increments are rendered again by true prefixes.
    """
    whole = template(turns)
    for most in (full_chars, None):
        pieces, found, checked = _increments(turns, template, most)
        if "".join(pieces) == whole and len(found) == len(turns):
            return whole, found, False if checked == len(turns) else None, checked
        if checked == len(found):
            break
    return whole, [], True, checked


def _increments(turns: list[Turn], template: Template, most: int | None) -> tuple[list[str], list[tuple[int, int, int, int]], int]:
    """What the turns add, after the rendering of none; the spans, as far as prefixes continue each other; and how many
    of them come from true prefixes, all but with a bound on the characters of these."""
    found: list[tuple[int, int, int, int]] = []
    before, checked, rendered = template([]), 0, 0
    pieces, length = [before], len(before)
    short, may_shorten = False, most is not None
    for i, (role, text) in enumerate(turns):
        context = [turns[0], *turns[i - CONTEXT : i]] if short else turns[:i]
        if short:
            before = template(context)
        now = template([*context, turns[i]])
        if not now.startswith(before):
            break
        added = now[len(before) :]
        probe = template([*context, (role, PROBE)])
        head, _, tail = probe[len(before) :].partition(PROBE)
        found.append((length, length + len(added), length + len(head), length + len(added) - len(tail)))
        pieces.append(added)
        length += len(added)
        if short:
            continue
        before, checked, rendered = now, i + 1, rendered + len(now)
        if may_shorten and rendered > most and i > CONTEXT and i + 1 < len(turns):
            few = [turns[0], *turns[i - CONTEXT : i]]
            short = template([*few, turns[i]]) == template(few) + added
            may_shorten = short
    return pieces, found, checked


def formatted(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """conv_id, n_turns, formatted, turn_spans, loss_spans (of assistant texts; code points, end exclusive),
    rewrites_history and checked_turns (how many turns continue the prefix before them; all, if no history is
    rewritten), one row for each conversation.

    Turns are in the order of turn (nulls first), ties by role, then text. Null text and null role: empty. A null
    conv_id is a conversation. Repeated rows are turns each. Other columns are dropped; empty table: no rows.
    Conversations are dealt out by conv_id and streamed in order, so a task holds one conversation at a time.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pair = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("turn_spans", pair), ("loss_spans", pair), ("rewrites_history", pa.bool_()), ("checked_turns", pa.int64())])

    def conversations_of(batches) -> Iterator[tuple[int | None, list[Turn]]]:
        current, turns = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv_id != current:
                    yield current, turns
                    turns = []
                current = conv_id
                turns.append((role, text))
        if turns:
            yield current, turns

    def render(batches):
        out: dict[str, list] = {f: [] for f in schema.names}
        size = 0
        for conv_id, turns in conversations_of(batches):
            text, found, rewrites, checked = spans(turns, template)
            loss = [[c, d] for (_, _, c, d), (role, _) in zip(found, turns) if role == "assistant"]
            for name, value in zip(schema.names, (conv_id, len(turns), text, [[a, b] for a, b, _, _ in found], loss, rewrites, checked)):
                out[name].append(value)
            size += len(text)
            if size > 4_000_000:
                yield records(schema, out)
                out, size = {f: [] for f in schema.names}, 0
        yield records(schema, out)

    ddl = "conv_id long, n_turns long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewrites_history boolean, checked_turns long"
    return rows.mapInArrow(render, ddl)


def digests(rendered: DataFrame) -> DataFrame:
    """What is read back from the formatted texts: turns parsed from the marks, and the texts under the loss mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def read(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            for conv_id, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                turns = parsed(text)
                learnt = "".join(unescape(text[a:b]) for a, b in loss)
                row = (conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text))
                for name, value in zip(schema.names, row):
                    out[name].append(value)
            yield records(schema, out)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rendered.select("conv_id", "formatted", "loss_spans").mapInArrow(read, ddl)
