"""Chat formatting: a machine over roles checks the order of turns, a template turns each into segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import ROWS_PER_BUCKET, text_of

ESCAPE = "\\"
START, ERROR = "start", "error"


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a role, and whether the text is learned."""

    head: str
    tail: str
    learned: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks per role, marks for any other role (whose name stands between `head` and `named`), and the order of roles.

    `follows` is the machine: per state the state that each role leads to. Roles
    without an entry are out of order there; the machine then goes on from the
    state `recover` gives for that role, or from ERROR.
    """

    roles: dict[str, Marks]
    other: Marks
    named: str
    follows: dict[str, dict[str, str]]
    recover: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        marks = [m.strip() for marks in [*self.roles.values(), self.other] for m in (marks.head, marks.tail)]
        if not all([*marks, self.named.strip()]) or len(set(marks)) < len(marks):
            raise ValueError("each head and tail is a control string of its own")
        firsts = {c[0] for c in self.controls()}
        if any(set(c[1:]) & (firsts | {ESCAPE}) or re.search(r"\s", c) or c[0] == ESCAPE for c in self.controls()):
            raise ValueError("a control string has no white space, no escape character, and first characters only at its start")

    def controls(self) -> list[str]:
        """The control strings: heads and tails without the white space around them."""
        marks = [*self.roles.values(), self.other]
        return [m.strip() for mark in marks for m in (mark.head, mark.tail)] + [self.named.strip()]

    def states(self) -> list[str]:
        found = [START, ERROR, *self.follows, *self.recover.values()]
        return list(dict.fromkeys(found + [s for step in self.follows.values() for s in step.values()]))

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state, and whether the role may follow here."""
        after = self.follows.get(state, {}).get(role)
        return (self.recover.get(role, ERROR), False) if after is None else (after, True)


# Fixed values of the default template.
BRACKETS = ChatTemplate(
    roles={
        "system": Marks("[SYS] ", " [/SYS]\n"),
        "user": Marks("[INST] ", " [/INST]\n"),
        "assistant": Marks("<s>", "</s>\n", learned=True),
    },
    other=Marks("[ROLE] ", " [/ROLE]\n"),
    named=" [AS] ",
    follows={
        START: {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    recover={"system": "system", "user": "user", "assistant": "assistant"},
)


def control_pattern(template: ChatTemplate, escapes: str) -> str:
    """Control strings with `escapes` behind their first character, in three groups."""
    firsts = "".join(sorted({re.escape(c[0]) for c in template.controls()}))
    rests = "|".join(re.escape(c[1:]) for c in sorted(template.controls(), key=len, reverse=True))
    return f"([{firsts}])({escapes})({rests})"


def escaped(text: Column, template: ChatTemplate) -> Column:
    """The text with one escape character more inside each control string, behind its first character.

    Control strings that already hold escapes get one more too, so taking one from each gives the text back.
    """
    return F.regexp_replace(text, control_pattern(template, r"\\*"), r"$1\\$2$3")


def unescaped(text: str, template: ChatTemplate) -> str:
    return re.sub(control_pattern(template, r"\\+"), lambda m: m[1] + m[2][1:] + m[3], text)


def format_turns(
    conversations: DataFrame,
    conversation: str,
    turn: str,
    role: str,
    text: str,
    template: ChatTemplate = BRACKETS,
) -> DataFrame:
    """One row per turn: conv_id, turn, role, and segments, an array of (text, loss).

    A turn becomes its head, its escaped text and its tail; loss is true for the
    texts of learned roles alone. A row is formatted where it lies, so nothing is
    shuffled, however long a conversation is; put in order of (turn, role, segments),
    the segments of a conversation are its formatted text.

    Null roles and texts count as empty, roles the template does not have stand
    by name, null ids and turns stay null, repeated rows are turns of their own,
    an empty table gives an empty one; other columns are not read.
    """
    rows = conversations.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        text_of(F.col(role)).alias("role"),
        text_of(F.col(text)).alias("body"),
    )

    def chosen(pick, other: Column) -> Column:
        for name, marks in template.roles.items():
            other = F.when(F.col("role") == name, F.lit(pick(marks))).otherwise(other)
        return other

    named = F.concat(F.lit(template.other.head), escaped(F.col("role"), template), F.lit(template.named))
    pieces = [
        (chosen(lambda m: m.head, named), F.lit(False)),
        (escaped(F.col("body"), template), chosen(lambda m: m.learned, F.lit(template.other.learned))),
        (chosen(lambda m: m.tail, F.lit(template.other.tail)), F.lit(False)),
    ]
    segments = F.array(*[F.struct(piece.alias("text"), loss.alias("loss")) for piece, loss in pieces])
    return rows.select("conv_id", "turn", "role", segments.alias("segments"))


def check_order(
    conversations: DataFrame, conversation: str, turn: str, role: str, template: ChatTemplate = BRACKETS
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_bad and bad_turn (turns out of order, and the first), end_state.

    Only ids, turns and roles move, into ranges of (conversation, turn, role), so
    a long conversation is spread over many tasks. A task runs the machine over
    its rows. Where a range begins inside a conversation the state is not known
    there, so a run carries the outcome of every starting state; runs of a
    conversation are then chained in order, one small row per range.

    Turns are ordered by turn, a missing one first, then by role, null as empty. Rows without a
    conversation are one conversation with a null id. An empty table gives an empty one.
    """
    kinds = dict(conversations.dtypes)
    n_parts = max(
        int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), conversations.count() // ROWS_PER_BUCKET + 1
    )
    rows = conversations.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        text_of(F.col(role)).alias("role"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["conv_id", "turn", "role"]
    ranges = rows.repartitionByRange(n_parts, *order, "salt").sortWithinPartitions(*order)
    states = template.states()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, types, now, done = TaskContext.get().partitionId(), None, None, []

        def put(runs: list) -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*runs, strict=True), types.values(), strict=True)]
            return pa.RecordBatch.from_arrays(columns, list(types))

        for batch in batches:
            conv_type, turn_type = batch.schema.types[:2]
            types = {"conv_id": conv_type, "part": pa.int64(), "n_turns": pa.int64()}
            types |= {"after": pa.list_(pa.string()), "n_bad": pa.list_(pa.int64()), "bad_turn": pa.list_(turn_type)}
            for conv, at, name in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, part, 0, list(states), [0] * len(states), [None] * len(states)]
                now[2] += 1
                for i, state in enumerate(now[3]):
                    now[3][i], legal = template.step(state, name)
                    if not legal:
                        now[5][i] = at if now[4][i] == 0 else now[5][i]
                        now[4][i] += 1
            if done:
                yield put(done)
                done = []
        if now:
            yield put([now])

    kind = f"conv_id {kinds[conversation]}, part long, n_turns long, after array<string>, n_bad array<long>, bad_turn array<{kinds[turn]}>"
    runs = ranges.drop("salt").mapInArrow(run, kind)
    # One row per range and conversation; a conversation has as many as it fills ranges.
    chained = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n_turns", "after", "n_bad", "bad_turn"))).alias("runs"))
    names = F.array(*[F.lit(s) for s in states])

    def chain(state: Column, part: Column) -> Column:
        at = (F.array_position(names, state["end_state"]) - 1).cast("int")
        first = F.when(state["n_bad"] > 0, state["bad_turn"]).otherwise(F.get(part["bad_turn"], at))
        return F.struct(
            (state["n_turns"] + part["n_turns"]).alias("n_turns"),
            (state["n_bad"] + F.get(part["n_bad"], at)).alias("n_bad"),
            first.alias("bad_turn"),
            F.get(part["after"], at).alias("end_state"),
        )

    none = F.lit(None).cast(kinds[turn]).alias("bad_turn")
    zero = F.lit(0).cast("bigint")
    begin = F.struct(zero.alias("n_turns"), zero.alias("n_bad"), none, F.lit(START).alias("end_state"))
    return chained.select("conv_id", F.aggregate("runs", begin, chain).alias("end")).select("conv_id", "end.*")


class Reader:
    """Reads turns back from formatted text that comes piece by piece; holds one turn at most."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template, self.rest = template, ""
        self.heads = {m.head: (name, m) for name, m in template.roles.items()} | {template.other.head: (None, template.other)}

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The (role, text) of every turn that ends in the text so far."""
        self.rest += piece
        while self.rest:
            found = [(name, marks) for head, (name, marks) in self.heads.items() if self.rest.startswith(head)]
            end = self.rest.find(found[0][1].tail.strip()) if found else -1
            if not found:
                raise ValueError(f"no turn begins at {self.rest[:40]!r}")
            (name, marks), tail = found[0], found[0][1].tail
            start = end - tail.index(tail.strip())
            if end < 0 or len(self.rest) < start + len(tail):
                return
            inner, self.rest = self.rest[len(marks.head) : start], self.rest[start + len(tail) :]
            if name is None:
                name, _, inner = inner.partition(self.template.named)
                name = unescaped(name, self.template)
            yield name, unescaped(inner, self.template)


def read_back(turns: DataFrame, template: ChatTemplate = BRACKETS) -> DataFrame:
    """Digests of each conversation as its formatted segments give it back.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars and loss_sha256 (the text
    under the loss flags, unescaped), formatted_chars. The segments are all that is read.

    A digest needs the text of its conversation in order, so a conversation's
    rows meet in one task, which streams them: sorted on disk if need be, and
    one turn is held at a time. Turns are in the order of (turn, role, segments).
    """
    kind = dict(turns.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, ids = None, [], None

        def close(state: list) -> tuple:
            if state[1].rest:
                raise ValueError("the formatted text ends inside a turn")
            return state[0], state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6]

        def put(rows: list) -> pa.RecordBatch:
            conv, *others = zip(*rows, strict=True)
            columns = [pa.array(conv, ids), *[pa.array(c) for c in others]]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ids = batch.schema.field(0).type
            for conv, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    rows += [close(now)] if now else []
                    now = [conv, Reader(template), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for segment in segments:
                    piece = segment["text"]
                    now[6] += len(piece)
                    for role, text in now[1].feed(piece):
                        now[2] += 1
                        now[3].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if segment["loss"]:
                        learned = unescaped(piece, template)
                        now[4] += len(learned)
                        now[5].update(learned.encode("utf-8", "surrogatepass"))
            if rows:
                yield put(rows)
                rows = []
        if now:
            yield put([close(now)])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segments")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "segments").mapInArrow(digest, schema)
