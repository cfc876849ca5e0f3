"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Each rendered turn is reparsed by a deterministic parser and compared
with its source; as long as they differ, whatever in the content conflicts with the grammar is escaped once more: a
backslash after the ``<`` of a control string, in front of those that are there already, and in roles also backslash and
newline. The parser takes one of them off again. A turn ends only at its own end mark, so a conversation, which is its
rendered turns in order, parses exactly when every turn does.

Null texts and roles are empty; turns of equal number are ordered by role and text, a null number first; rows of a null
conversation form one conversation. Turns stream through a task in order, so a conversation of any length fits.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
MARK = re.compile(r"<\|im_(?:start|end)\|>")
MAX_ESCAPES = 3
LEARNED_ROLE = "assistant"


def escape_text(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, unescaped; start and end bound the escaped text. Raises on anything else."""
    turns, at = [], 0
    while at < len(rendered):
        head = rendered.find("\n", at)
        end = MARK.search(rendered, max(head, at + len(START)))
        role = rendered[at + len(START) : head]
        if not rendered.startswith(START, at) or head < 0 or MARK.search(role) or end is None:
            raise ValueError(f"no turn at {at}")
        if end[0] != END or not rendered.startswith("\n", end.end()):
            raise ValueError(f"a turn is not closed at {end.start()}")
        turns.append((unescape_role(role), unescape_text(rendered[head + 1 : end.start()]), head + 1, end.start()))
        at = end.end() + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn that parses back to its source, and the bounds of the text in it; escaped no more than needed."""
    shown_role, shown_text = role, text
    for _ in range(MAX_ESCAPES):
        rendered = f"{START}{shown_role}\n{shown_text}{END}\n"
        try:
            turns = parse(rendered)
        except ValueError:
            turns = []
        if [t[:2] for t in turns] == [(role, text)]:
            return rendered, turns[0][2], turns[0][3]
        # the parser takes off one level, so what conflicts is escaped from its source
        if CONTROL.search(text):
            shown_text = escape_text(text)
        if "\n" in role or "\\" in role or CONTROL.search(role):
            shown_role = escape_role(role)
    raise ValueError("a turn does not parse back to its source")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place (from 0), rendered, loss_start and loss_end (code points in it; -1: no loss).

    A conversation's formatted text is its rendered turns in order of place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        place = 0
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True):
                place = place + 1 if conv == last else 0
                last = conv
                rendered, start, end = render(role or "", text or "")
                out.append((rendered, place, *((start, end) if role == LEARNED_ROLE else (-1, -1))))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), arrays[0], pa.array(columns[0], pa.string()), *arrays[1:]],
                ["conv_id", "place", "rendered", "loss_start", "loss_end"],
            )

    return _ordered(conversations).mapInArrow(
        run, "conv_id bigint, place bigint, rendered string, loss_start bigint, loss_end bigint"
    )


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from formatted turns alone."""
    kind = pa.schema(
        [
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ]
    )

    class Tally:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, rendered: str, start: int, end: int) -> None:
            for role, text, _, _ in parse(rendered):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
            if start >= 0:
                learned = unescape_text(rendered[start:end])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode())
            self.chars += len(rendered)

        def row(self) -> list:
            return [self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Tally | None = None
        for batch in batches:
            done = []
            for conv, rendered, start, end in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Tally(conv)
                now.add(rendered, start, end)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in done], schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, now.row(), strict=True))], schema=kind)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "rendered", "loss_start", "loss_end")
    ddl = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(run, ddl)
