"""Repair of conversations whose turns do not alternate, at the least cost.

The cheapest edits are the shortest path through the states of the role pattern, found by a
Viterbi pass from the last row to the first. Rows are sorted into ranges; what a range holds
of one conversation is a chunk, and chunks are passed over side by side. A chunk that goes on
in the next range starts from speculative cost vectors. Only differences within a vector
decide the edits, and few vectors differ by more than a constant, so all of them are run at
once, until those left differ only by constants (mostly after a few rows). Then the vectors
at the ends of ranges are stitched, one small row for each range, and edits are traced
forward through the costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_width, stored

# States of the pattern (s?(ua)+)? by the roles so far: none, s, ends with u, ends with a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Next state by state and role initial; a pair that is missing is not in the pattern.
NEXT = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
#: The only state that an added user or assistant turn leads to.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Kinds of rows: one that must be deleted, then role initials, whole and truncated.
INITIALS = "sua-"
FORCED = 0
KINDS = 1 + 2 * len(INITIALS)
LEGAL = {"su", "ua", "au"}

#: Rows and bytes of a range.
RANGE_ROWS, RANGE_BYTES = 1 << 17, 1 << 26
#: Characters of a text by which ranges are told; inside a range whole texts order the rows.
KEY_CHARS = 128


def kind_of(initial: str, truncated: bool) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else len(INITIALS) - 1) + truncated


def _closed(costs: list[int]) -> list[int]:
    """With turns inserted where that is cheaper."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return costs


def _steps(kind: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, cost) of what can be done with a row."""
    yield "D", state, DELETE
    if kind == FORCED:
        return
    initial, cut = INITIALS[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
    if (state, initial) in NEXT:
        yield "K", NEXT[state, initial], KEEP + cut
    yield "R", TURN[state], REROLE + cut


class Costs:
    """All cost vectors that can stand before a row, up to a constant, and what follows them.

    ``vectors[0]`` is that of a conversation's end. ``before[v, kind]`` is the vector before a
    row of that kind if ``v`` stands after it, and ``edits[v, kind, state]`` are the least
    edits in ASCII order among the cheapest, with the state after them.
    """

    def __init__(self) -> None:
        end = _closed([0, 1 << 20, 1 << 20, 0])
        self.vectors = [tuple(end)]
        known = {self.vectors[0]: 0}
        before, self.edits = [], {}
        while len(before) < len(self.vectors):
            after = self.vectors[len(before)]
            row = []
            for kind in range(KINDS):
                plain = [
                    min(cost + after[to] for _, to, cost in _steps(kind, state)) for state in range(4)
                ]
                costs = _closed(plain)
                vector = tuple(c - min(costs) for c in costs)
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append(known[vector])
                for state in range(4):
                    self.edits[len(before), kind, state] = self._least(costs, after, kind, state)
            before.append(row)
        self.before = np.array(before)
        self.last = []
        for state in range(4):
            added, at = [], state
            while end[at]:
                at = TURN[at]
                added.append(at)
            self.last.append(added)

    @staticmethod
    def _least(costs: list[int], after: tuple, kind: int, state: int) -> tuple[list[int], str, int]:
        added = []
        while True:
            best = [
                (edit, to)
                for edit, to, cost in _steps(kind, state)
                if cost + after[to] == costs[state]
            ]
            if INSERT + costs[TURN[state]] == costs[state]:
                best.append(("I", TURN[state]))
            edit, to = min(best)
            if edit != "I":
                return added, edit, to
            added.append(to)
            state = to


COSTS = Costs()


def damaged(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turn, role, text with one row in four damaged, chosen by CRC-32 of conv_id:turn.

    Of remainders by 20: 0 drops the row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3
    repeats it, 4 makes its role user. A NULL counts as one space, but ids and turns stay NULL.
    """
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)}
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        texts[role].alias("role"),
        texts[text].alias("text"),
        F.pmod(F.crc32(F.concat(texts[conv], F.lit(":"), texts[turn])), F.lit(20)).alias("how"),
    ).where("how <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.expr("IF(how = 4, 'user', role)").alias("role"),
        F.expr("CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.explode(F.expr("sequence(1, IF(how = 3, 2, 1))")).alias("copy"),
    ).drop("copy")


def _told(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, whether each is blank, truncated or seen earlier."""
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # the smallest turn (NULL first) of a role and text is the one that is not seen earlier
    first = rows.groupBy("conv_id", "role", "text").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first")
    ).select("conv_id", "role", "text", F.col("first.turn").alias("turn"), F.lit(True).alias("new"))
    same = [own[c].eqNullSafe(first[c]) for c in ("conv_id", "role", "text", "turn")]
    body = r"TRIM(TRAILING ' \t\n\u000B\u000C\r' FROM text)"
    return (
        own.join(first, same, "left")
        .select(*[own[c] for c in own.columns], F.coalesce("new", F.lit(False)).alias("new"))
        .withColumn("body", F.expr(body))
        .withColumn("blank", F.expr("body = ''"))
        .withColumn("truncated", F.expr("NOT blank AND right(body, 1) NOT IN ('.', '!', '?')"))
        .drop("body")
    )


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Written in ranges by conversation, turn (NULL first), role and text.

    Adds ``part``, the number of the range, and ``place``, which orders its rows.
    """
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text") + F.octet_length("role"))).first()
    parts = max(shuffle_width(rows), size[0] // RANGE_ROWS, (size[1] or 0) // RANGE_BYTES)
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ranged = _told(rows).repartitionByRange(parts, *by, F.substring("text", 1, KEY_CHARS))
    return stored(
        ranged.sortWithinPartitions(*by, "text").select(
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
            "*",
        )
    )


class Range:
    """The rows of a range in order, as kinds, and where its chunks begin."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.take(pc.sort_indices(table.column("place")))
        column = lambda c: self.table.column(c).to_numpy()
        self.initials = [(r or "-")[0] for r in self.table.column("initial").to_pylist()]
        self.blank, self.new, self.truncated = (column(c).astype(bool) for c in ("blank", "new", "truncated"))
        self.copies = column("copies")
        forced = self.blank | ~self.new
        self.kinds = [
            FORCED if f else kind_of(i, t)
            for f, i, t in zip(forced, self.initials, self.truncated, strict=True)
        ]
        conv = self.table.column("conv_id").combine_chunks().dictionary_encode("encode")
        codes = conv.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(codes)) + 1
        self.begins = [0, *cuts.tolist()]
        self.ends = [*cuts.tolist(), len(codes)]

    def vectors(self, begin: int, end: int, after: int) -> list[int]:
        """The vector after each row of a chunk, given the one after its last; then its first."""
        out, v = [], after
        for i in range(end - 1, begin - 1, -1):
            out.append(v)
            v = int(COSTS.before[v, self.kinds[i]])
        return out[::-1], v

    def response(self) -> list[int]:
        """For each vector after the range, the one before its first chunk.

        All vectors are run until those that are left differ only by constants.
        """
        begin, end = self.begins[0], self.ends[0]
        if len(self.begins) > 1:  # the first chunk ends here: no speculation
            return [self.vectors(begin, end, 0)[1]] * len(COSTS.vectors)
        runs = np.arange(len(COSTS.vectors))
        for i in range(end - 1, begin - 1, -1):
            runs = COSTS.before[runs, self.kinds[i]]
            if (runs == runs[0]).all():
                v = self.vectors(begin, i, int(runs[0]))[1]
                return [v] * len(runs)
        return runs.tolist()

    def walk(self, begin: int, end: int, after: int, state: int, ends: bool):
        """The edits of a chunk from ``state`` on: for each row turns to add, edit, new state."""
        steps = []
        for i, v in zip(range(begin, end), self.vectors(begin, end, after)[0], strict=True):
            step = COSTS.edits[v, self.kinds[i], state]
            state = step[2]
            steps.append(step)
        return steps, COSTS.last[state] if ends else [], state


LIGHT = ["part", "place", "conv_id", "initial", "copies", "blank", "new", "truncated"]
OPEN = "part int, first_conv {0}, last_conv {0}, through boolean, response array<int>"


def _stitched(rows: DataFrame, conv_type: str) -> tuple[dict[int, tuple[int, int]], dict[int, bool]]:
    """For each range whose ends cut a conversation: the vector after it, and the state before.

    One small row for each range is handled here.
    """

    def look(table: pa.Table) -> pa.Table:
        part = Range(table)
        row = {
            "part": table.column("part")[0].as_py(),
            "first_conv": part.table.column("conv_id")[0].as_py(),
            "last_conv": part.table.column("conv_id")[-1].as_py(),
            "through": len(part.begins) == 1,
            "response": part.response(),
        }
        return pa.Table.from_pylist([row], schema=_opened(table.schema.field("conv_id").type))

    light = rows.select(*LIGHT)
    looked = light.groupBy("part").applyInArrow(look, OPEN.format(conv_type)).orderBy("part").collect()
    cut = {a["part"] for a, b in pairwise(looked) if a["last_conv"] == b["first_conv"]}
    vector, after = {}, None
    for a, b in zip(reversed(looked), [None, *reversed(looked)], strict=False):
        if a["part"] in cut:
            vector[a["part"]] = after
        after = a["response"][vector.get(a["part"], 0)]
    if not cut:
        return {}, {}

    def trace(table: pa.Table) -> pa.Table:
        part = Range(table)
        number = table.column("part")[0].as_py()
        goes_on = number in vector
        begin, end = part.begins[-1], part.ends[-1]
        entries = range(4) if len(part.begins) == 1 else [START]
        to = [part.walk(begin, end, vector.get(number, 0), q, not goes_on)[2] for q in entries]
        return pa.table({"part": pa.array([number], pa.int32()), "to": pa.array([to], pa.list_(pa.int32()))})

    traced = {
        r["part"]: r["to"]
        for r in light.where(F.col("part").isin(sorted(cut)))
        .groupBy("part")
        .applyInArrow(trace, "part int, to array<int>")
        .collect()
    }
    state = {}
    for a, b in pairwise(looked):
        if a["part"] in cut:
            to = traced[a["part"]]
            state[b["part"]] = to[state.get(a["part"], START)] if a["through"] else to[0]
    return vector, state


def _opened(conv: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("part", pa.int32()),
            ("first_conv", conv),
            ("last_conv", conv),
            ("through", pa.bool_()),
            ("response", pa.list_(pa.int32())),
        ]
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def repaired(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations, one row for what each sorted range holds of one.

    conv_id, part (ranges in order), audit (initials of the edits Keep, Rerole, Delete,
    Insert), roles and texts of the repaired turns, blank, duplicate, truncated, illegal and
    cost of the rows here, first_initial, last_initial, first_turn, last_turn, least_turn (the
    first turn that is not NULL) and n_turns (different turns that are not NULL).

    Rows of a conversation are taken by turn (NULL first), then by role and text. A row is
    blank without a character outside white space, else a duplicate if role and text came
    earlier, else truncated if it does not end in ``.``, ``!`` or ``?``. Blank and duplicate
    rows are deleted (3); others are kept (0), get the role user or assistant (2) or are
    deleted, and empty turns are inserted (2), so that role initials are ``(s?(ua)+)?`` at the
    least cost; truncated rows that stay add 1. Among the cheapest, edits are least in ASCII.

    A NULL role or text counts as one space, a NULL conversation is one of its own. Equal rows
    are counted before they are sorted, and a conversation of any length is cut where ranges
    end. An empty table gives no rows; other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = sorted_rows(
        df.select(
            F.col(conv).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            space(role).alias("role"),
            space(text).alias("text"),
        )
    ).withColumn("initial", F.substring("role", 1, 1))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    vector, state = _stitched(rows, conv_type)

    def repair(table: pa.Table) -> pa.Table:
        part = Range(table)
        number = table.column("part")[0].as_py()
        convs = part.table.column("conv_id")
        turns = part.table.column("turn").to_pylist()
        roles, texts = (part.table.column(c).to_pylist() for c in ("role", "text"))
        out = []
        for k, (begin, end) in enumerate(zip(part.begins, part.ends, strict=True)):
            goes_on = k + 1 == len(part.begins) and number in vector
            entry = state.get(number, START) if k == 0 else START
            steps, added, _ = part.walk(begin, end, vector[number] if goes_on else 0, entry, not goes_on)
            audit, new_roles, new_texts = [], [], []
            counts = dict.fromkeys(COUNTS, 0)
            for i, (before, edit, to) in zip(range(begin, end), steps, strict=True):
                copies = int(part.copies[i])
                audit.append("I" * len(before) + edit + "D" * (copies - 1))
                counts["cost"] += INSERT * len(before) + DELETE * (copies - 1)
                new_roles += [ROLE[q] for q in before]
                new_texts += [""] * len(before)
                if edit == "D":
                    counts["cost"] += DELETE
                else:
                    new_roles.append(roles[i] if edit == "K" else ROLE[to])
                    new_texts.append(texts[i])
                    counts["cost"] += REROLE * (edit == "R")
                    counts["cost"] += TRUNCATED * bool(part.new[i] and part.truncated[i])
                if part.blank[i]:
                    counts["blank"] += copies
                else:
                    counts["duplicate"] += copies - bool(part.new[i])
                    counts["truncated"] += bool(part.new[i] and part.truncated[i])
                counts["illegal"] += copies - 1
                if i > begin:
                    counts["illegal"] += part.initials[i - 1] + part.initials[i] not in LEGAL
            audit.append("I" * len(added))
            counts["cost"] += INSERT * len(added)
            given = [t for t in turns[begin:end] if t is not None]
            out.append(
                {
                    "conv_id": convs[begin].as_py(),
                    "part": number,
                    "audit": "".join(audit),
                    "roles": new_roles + [ROLE[q] for q in added],
                    "texts": new_texts + [""] * len(added),
                    **counts,
                    "first_initial": part.initials[begin],
                    "last_initial": part.initials[end - 1],
                    "last_turn": given[-1] if given else None,
                    "least_turn": given[0] if given else None,
                    "n_turns": len(set(given)),
                }
            )
        return pa.Table.from_pylist(out, schema=_repairs(table.schema.field("conv_id").type))

    schema = (
        f"conv_id {conv_type}, part int, audit string, roles array<string>, texts array<string>, "
        + ", ".join(f"{c} long" for c in COUNTS)
        + ", first_initial string, last_initial string, last_turn long, least_turn long, n_turns long"
    )
    return rows.groupBy("part").applyInArrow(repair, schema)


def _repairs(conv: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("conv_id", conv),
            ("part", pa.int32()),
            ("audit", pa.string()),
            ("roles", pa.list_(pa.string())),
            ("texts", pa.list_(pa.string())),
            *((c, pa.int64()) for c in COUNTS),
            ("first_initial", pa.string()),
            ("last_initial", pa.string()),
            ("last_turn", pa.int64()),
            ("least_turn", pa.int64()),
            ("n_turns", pa.int64()),
        ]
    )


def _hashes(segments: DataFrame, conv_type: str) -> DataFrame:
    """SHA-256 of conversations in several ranges, read range by range in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, full = None, None, False

        def answer():
            return pa.RecordBatch.from_arrays(
                [held, pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0).slice(i, 1)
                if held is None or not now.equals(held):
                    if held is not None:
                        yield answer()
                    held, digest, full = now, hashlib.sha256(), False
                if batch.column(2)[i].as_py():
                    digest.update(b"\n" * full + batch.column(3)[i].as_py().encode())
                    full = True
        if held is not None:
            yield answer()

    read = segments.select("conv_id", "part", F.size("roles").alias("n"), "lines")
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, f"conv_id {conv_type}, repaired_sha256 string")


def repair_report(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    ``gaps`` are the turns missing between the first and the last; ``illegal`` are neighbours
    whose role initials are not su, ua or au; the hash is that of the repaired ``role:text``
    lines. Odd rows are treated as in ``repaired``.
    """
    segments = stored(repaired(df, conv, turn, role, text))
    conv_type = segments.schema["conv_id"].dataType.simpleString()
    in_order = Window.partitionBy("conv_id").orderBy("part")
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    met = segments.withColumns(
        {
            "pair": F.concat(F.lag("last_initial").over(in_order), F.col("first_initial")),
            "turn_before": F.max("last_turn").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
            "sha": F.sha2(F.encode(lines, "utf-8"), 256),
        }
    ).withColumns(
        {
            "illegal": F.col("illegal")
            + F.expr("IF(pair IS NULL OR pair IN ('su', 'ua', 'au'), 0, 1)"),
            "n_turns": F.col("n_turns") - F.expr("IF(turn_before <=> least_turn AND least_turn IS NOT NULL, 1, 0)"),
        }
    )
    whole = met.groupBy("conv_id").agg(
        F.coalesce(F.max("last_turn") - F.min("least_turn") + 1 - F.sum("n_turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit"),
        F.count("*").alias("n_parts"),
        F.max("sha").alias("sha"),
    )
    several = whole.where("n_parts > 1").select("conv_id")
    cut = segments.withColumn("lines", lines).join(
        several.withColumnRenamed("conv_id", "cut_id"), F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi"
    )
    hashes = _hashes(cut, conv_type).select(F.col("conv_id").alias("hashed_id"), "repaired_sha256")
    return whole.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left").select(
        "conv_id", "gaps", *COUNTS, "audit", F.coalesce("repaired_sha256", "sha").alias("repaired_sha256")
    )


def damage_and_repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The report of ``repair_report`` for every conversation of ``df`` after ``damaged``.

    One that lost all its rows has zeros, an empty audit and the hash of an empty string.
    """
    report = repair_report(damaged(df, conv, turn, role, text))
    every = df.select(F.col(conv).alias("given_id")).distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(report, F.col("given_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("given_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
