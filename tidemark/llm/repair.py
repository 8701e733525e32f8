"""Conversation structure repair: the cheapest edits that give every conversation the form (system)? (user assistant)*.

Each conversation is a path through four states (nothing, system, user or assistant came last). Keeping a row costs 0, giving it the role that comes next 1, deleting it 2, inserting an
empty turn 5; a truncated row that stays costs 5 more; blank and duplicate rows are deleted. Of equally cheap edits the ASCII-least string of initials (D, I, K, R) wins.

Survivor-coalescence Viterbi: rows stream past, sorted by conversation and turn. Each state's survivor is a leaf of a tree of back pointers with reference counts; a
branch without survivors is freed at once, and so is a survivor that another one beats whatever follows (the start, for one, would be followed as long as the conversation). As soon as all survivors share an ancestor, the edits up to it are final: they leave the tree, and the texts that they keep leave the
buffer. Ties are decided by the complete unresolved suffixes behind the survivors' last common ancestor. Two strings that tie at one state never begin with each other (the second would have to insert an even number of
turns for nothing), so the lesser one stays the lesser whatever follows. Memory is that of the unresolved rows, not of the conversation; the digest of a repaired conversation is one
running SHA-256, which is why a conversation is one stream: sorting spills, and nothing is collected.

Duplicates are found before, by a window over (conversation, role, text) on the same partitioning.

Defined cases: after damage, a null role or text is one space, which is blank as a text; rows with the same turn are ordered by role and text; a null conv_id is a conversation of its own; repeated rows are
duplicates; null turns come first and count for no gap; roles are taken as they are, and their first character decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a turn whose role has this initial.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that may be given to, or inserted as, the next turn, and the state behind it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: DETOUR[x][y]: whatever follows costs at x at most so much more than at y. From a state one can insert a turn to be where another is; a system turn that only the start
#: could keep is deleted instead; what follows a system turn can follow an assistant turn, too.
DETOUR = {START: {SYSTEM: 0, ASSISTANT: 0, USER: 5}, USER: {START: 7, SYSTEM: 5, ASSISTANT: 5}, ASSISTANT: {START: 2, SYSTEM: 0, USER: 5}}


class Node:
    """An edit on the way to one or more survivors."""

    __slots__ = ("above", "refs", "edit", "row", "depth")

    def __init__(self, above: Node | None, edit: str, row: int):
        self.above, self.edit, self.row, self.refs = above, edit, row, 0
        self.depth = above.depth + 1 if above else 0
        if above:
            above.refs += 1


class Viterbi:
    """One conversation. emit(edit, role, text) is called for each edit once it is final, in order."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit = emit
        self.root = Node(None, "", -1)
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.root.refs = 1
        self.root_state = START
        self.rows: dict[int, tuple[str, str]] = {}
        self.next_row = 0
        self.largest = 0  # most unresolved rows so far

    def release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.above:
            node = node.above
            node.refs -= 1

    def less(self, left: tuple[Node, str], right: tuple[Node, str]) -> bool:
        """Whether the edits up to one node, with some more, are ASCII-less than those up to another; they are compared from the last common ancestor on."""
        (a, tail_a), (b, tail_b) = left, right
        one, two = [], []
        while a is not b:
            if a.depth >= b.depth:
                one.append(a.edit)
                a = a.above
            else:
                two.append(b.edit)
                b = b.above
        return "".join(reversed(one)) + tail_a < "".join(reversed(two)) + tail_b

    def candidates(self, role: str | None, must_go: bool, truncated: bool) -> dict[int, tuple[int, Node, str]]:
        """The best (cost, node, further edits) for each state behind a row; role None: behind the last row, where a turn may be inserted only."""
        found: dict[int, tuple[int, Node, str]] = {}

        def offer(state: int, cost: int, node: Node, edits: str) -> None:
            old = found.get(state)
            if old is None or cost < old[0] or (cost == old[0] and self.less((node, edits), old[1:])):
                found[state] = (cost, node, edits)

        for at, (cost, node) in self.best.items():
            for state, paid, first in ((at, cost, ""), (NEXT[at][1], cost + COST[INSERT], INSERT)):
                if role is None:
                    offer(state, paid, node, first)
                    continue
                offer(state, paid + COST[DELETE], node, first + DELETE)
                if must_go:
                    continue
                stays = paid + (TRUNCATED_COST if truncated else 0)
                kept = STEPS.get(role[:1], {}).get(state)
                if kept is not None:
                    offer(kept, stays + COST[KEEP], node, first + KEEP)
                offer(NEXT[state][1], stays + COST[REROLE], node, first + REROLE)
        return found

    @staticmethod
    def hopeless(found: dict[int, tuple[int, Node, str]], state: int) -> bool:
        """Whether another survivor is cheaper than this one whatever follows."""
        return any(other in DETOUR and state in DETOUR[other] and cost + DETOUR[other][state] < found[state][0] for other, (cost, _, _) in found.items())

    def grow(self, found: dict[int, tuple[int, Node, str]], row: int) -> None:
        grown, before = {}, [node for _, node in self.best.values()]
        for state, (cost, node, edits) in found.items():
            for edit in edits:
                node = Node(node, edit, row)
            node.refs += 1
            grown[state] = (cost, node)
        for node in before:
            self.release(node)
        self.best = grown

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self.rows[self.next_row] = (role, text)
        found = self.candidates(role, must_go, truncated)
        self.grow({state: x for state, x in found.items() if not self.hopeless(found, state)}, self.next_row)
        self.next_row += 1
        self.settle()

    def settle(self) -> None:
        """Emits what all survivors share and moves the root on."""
        leaves = {id(node): node for _, node in self.best.values()}
        low = list(leaves.values())
        # The survivors' last common ancestor: step up from the deepest until one is left.
        while len(low) > 1:
            low.sort(key=lambda n: n.depth)
            deepest = low.pop().above
            if all(deepest is not n for n in low):
                low.append(deepest)
        shared, at = [], low[0]
        while at is not self.root:
            shared.append(at)
            at = at.above
        for node in reversed(shared):
            self.finish(node.edit, node.row)
        if shared:
            self.root = low[0]
            self.root.above = None
        resolved = self.root.row if self.root.edit not in ("", INSERT) else self.root.row - 1
        for row in [k for k in self.rows if k <= resolved]:
            del self.rows[row]
        self.largest = max(self.largest, len(self.rows))

    def finish(self, edit: str, row: int) -> None:
        role, text = self.rows.get(row, ("", ""))
        if edit == INSERT:
            role, self.root_state = NEXT[self.root_state]
            text = ""
        elif edit == REROLE:
            role, self.root_state = NEXT[self.root_state]
        elif edit == KEEP:
            self.root_state = STEPS[role[:1]][self.root_state]
        self.emit(edit, role, text)

    def close(self) -> int:
        """Decides between the survivors of a whole conversation; the cost of its edits."""
        ends = {s: x for s, x in self.candidates(None, False, False).items() if s in (START, ASSISTANT)}
        best = None
        for x in ends.values():
            if best is None or x[0] < best[0] or (x[0] == best[0] and self.less(x[1:], best[1:])):
                best = x
        self.grow({START: best}, self.next_row)
        self.settle()
        return best[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault != 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def judged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), each conversation in one partition and sorted, with the first fault of each row: blank, duplicate, truncated or none."""
    blank: Column = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    found = rows.repartition("conv_id").withColumn("again", again)
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(cut, "truncated").otherwise("")
    return found.select("conv_id", "turn", "role", "text", fault.alias("fault"), "again").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again").drop("again")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


_NONE = object()
_EDITS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edit_rows(batches):
    """One row for each edit; an inserted turn has an empty text."""
    held: list[tuple] = []
    current, machine, place = _NONE, None, 0

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal place
        held.append((current, place, edit, role, text))
        place += 1

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), _EDITS.types, strict=True)], schema=_EDITS)
        held.clear()
        return out

    for conv_id, _, role, text, fault in _rows(batches):
        if conv_id != current:
            if machine:
                machine.close()
            current, machine, place = conv_id, Viterbi(emit), 0
        machine.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        if len(held) >= 4096:
            yield flushed()
    if machine:
        machine.close()
    if held:
        yield flushed()


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repair of each conversation, an edit a row; what is left without edit D is the repaired conversation."""
    return judged(rows).mapInArrow(_edit_rows, "conv_id long, position long, edit string, role string, text string")


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _SUMMARY.split(", ")]
LEGAL = ("su", "ua", "au")


class Summary:
    """Counts of one conversation, the audit of its edits, and a running digest of what they leave."""

    def __init__(self, conv_id):
        self.conv_id, self.machine = conv_id, Viterbi(self.emit)
        self.turns, self.first, self.last = 0, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.initial = 0, None
        self.audit, self.hash, self.started = [], hashlib.sha256(), False

    def emit(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != DELETE:
            self.hash.update(f"{chr(10) if self.started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.started = True

    def add(self, turn, role, text, fault) -> None:
        if turn is not None and turn != self.last:  # turns come sorted
            self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.machine.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        cost = self.machine.close()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def _summaries(batches):
    held: list[tuple] = []
    current: Summary | None = None

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k < 7 else pa.string()) for k, c in enumerate(zip(*held, strict=True))], names=_NAMES)
        held.clear()
        return out

    for conv_id, turn, role, text, fault in _rows(batches):
        if current is None or conv_id != current.conv_id:
            if current:
                held.append(current.row())
            current = Summary(conv_id)
            if len(held) >= 4096:
                yield flushed()
        current.add(turn, role, text, fault)
    if current:
        held.append(current.row())
        yield flushed()


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation in rows: faults, cost, audit and digest of its repair."""
    return judged(rows).mapInArrow(_summaries, _SUMMARY)


def repaired(conversations: DataFrame) -> DataFrame:
    """The contract's query: the damaged conversations repaired, one row for each original conv_id, also of those of which no row is left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = summaries(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = {c: 0 for c in _NAMES[1:7]} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.fillna(zero)
