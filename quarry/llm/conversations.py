"""Conversation structure repair.

``repair`` takes turns and gives back conversations whose roles read ``(s?(ua)+)?``: blank,
repeated and surplus turns go, roles are changed and empty turns inserted, at the least cost.

Turns that are equal in all columns are counted before anything is shuffled. The rest is
range-partitioned and sorted by conversation and turn, so that a huge conversation spans many
tasks. A task cuts its stretch of each conversation into runs of bounded size and searches each
(``branch.search``). Where a conversation is one run, that is its repair. Otherwise each run is
searched from every state to every state, and the runs of a conversation are joined in order:
only their costs and audits meet, never their texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import branch
from .common import bound_batches, materialise

#: A run has at most so many distinct turns and, beyond its first turn, so many bytes of text.
RUN_TURNS, RUN_BYTES = 512, 4 << 20
SPACE = r" \t\n\x0B\f\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_TURN = "struct<role:string,text:string,kind:int,copies:bigint>"
_RUN = f"part int, run int, whole boolean, {', '.join(f'{c} bigint' for c in _COUNTS)}, head string, tail string, low bigint, high bigint, costs array<bigint>, audits array<string>, rows array<{_TURN}>"
_PATH = f"part int, run int, entry int, slice string, {', '.join(f'{c} bigint' for c in _COUNTS)}, low bigint, high bigint, cost bigint, audit string"


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) as a known crc32 of conversation and turn damages them, with ``copies``.

    0 drops a turn, 1 empties its text, 2 takes ``.!?`` out, 3 doubles it, 4 makes it the
    user's; of twenty. Nulls are hashed, and taken for a role or text, as one space. A dropped
    turn stays as a row of 0 copies and nulls, so that its conversation is known.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    code = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text)
    dropped = code == 0
    return turns.select(
        "conv", F.when(~dropped, F.col("turn").cast("bigint")).alias("turn"), F.when(~dropped, F.when(code == 4, "user").otherwise(role)).alias("role"),
        F.when(~dropped, text).alias("text"), F.when(dropped, 0).when(code == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def faults(turns: DataFrame) -> DataFrame:
    """Distinct turns with the sum of their ``copies`` and the ``kind`` of fault of the first copy.

    blank: no character but spaces; duplicate: role and text were there at an earlier turn
    (null turns come first); truncated: the last such character is not one of ``.!?``.
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", F.sha2("text", 256))
    seen = rows.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("key").alias("key_"))
    seen = seen.agg(F.count(F.lit(1)).alias("places"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unplaced")).filter("places > 1 and key_ is not null")
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("key") == F.col("key_")), "left")
    again = F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    kind = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(again, DUPLICATE).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(FINE)
    return rows.select("conv", "turn", "role", "text", "copies", F.when(F.col("copies") > 0, kind).otherwise(FINE).cast("int").alias("kind"))


def _items(rows: list) -> list:
    out = []
    for role, _, kind, copies in rows:
        if kind in (BLANK, DUPLICATE):
            out.append(branch.Forced(copies))
        elif copies:
            out.append(branch.Free(role[:1], int(kind == TRUNCATED)))
            if copies > 1:
                out.append(branch.Forced(copies - 1))
    return out


class _Run:
    """A stretch of one conversation while it is read."""

    def __init__(self, conv, number: int, opens: bool):
        self.conv, self.number, self.opens = conv, number, opens
        self.rows, self.bytes, self.counts, self.head, self.tail = [], 0, dict.fromkeys(_COUNTS, 0), None, None
        self.low = self.high = None

    def add(self, turn, role, text, copies, kind) -> None:
        if not copies:
            return
        self.rows.append((role, text, kind, copies))
        self.bytes += len(role) + len(text)
        c = self.counts
        if kind == BLANK:
            c["blank"] += copies
        else:
            c["duplicate"] += copies - (kind != DUPLICATE)
            c["truncated"] += kind == TRUNCATED
        initial = role[:1]
        pairs = [(self.tail, 1)] * (self.tail is not None) + [(initial, copies - 1)]
        c["illegal"] += sum(k for before, k in pairs if before + initial not in ("su", "ua", "au"))
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None:
            c["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, part: int, closes: bool) -> dict:
        whole, items = self.opens and closes, _items(self.rows)
        found = [branch.search(items)] if whole else [branch.search(items, e, g) for e in range(4) for g in range(4)]
        costs, audits = zip(*(x or (None, None) for x in found))
        return {"conv": self.conv, "part": part, "run": self.number, "whole": whole, **self.counts, "head": self.head, "tail": self.tail, "low": self.low, "high": self.high,
                "costs": costs, "audits": audits, "rows": [dict(zip(("role", "text", "kind", "copies"), r)) for r in self.rows]}


def _batches(rows, schema: pa.Schema, most: int = 256, size: int = 8 << 20):
    held, weight = [], 0
    for row, w in rows:
        held.append(row)
        weight += w
        if len(held) >= most or weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str, conv: T.DataType) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(ddl).fields])
    return struct, to_arrow_schema(struct)


def runs(turns: DataFrame, *, run_turns: int = RUN_TURNS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Searched runs of conversations, written to the shared folder; ``turns`` as ``faults`` returns them."""
    struct, schema = _arrow(_RUN, turns.schema["conv"].dataType)

    def cut(batches):
        part, first, run = TaskContext.get().partitionId(), True, None
        for batch in batches:
            for conv, turn, role, text, copies, kind in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "kind"))):
                same = run is not None and run.conv == conv
                if same and run.rows and (len(run.rows) >= run_turns or run.bytes >= run_bytes):
                    yield run.row(part, False), run.bytes
                    run = _Run(conv, run.number + 1, False)
                elif not same:
                    if run is not None:
                        yield run.row(part, not first), run.bytes
                        first = False
                    run = _Run(conv, 0, not first)
                run.add(turn, role, text, copies, kind)
        if run is not None:
            yield run.row(part, False), run.bytes  # it may go on in the next task

    # A beginning of the text is enough to deal by; rows that agree in it stay together and are sorted by the rest.
    dealt = turns.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    return materialise(dealt.mapInArrow(lambda batches: _batches(cut(batches), schema), struct), "conversation-runs")


class _Path:
    """The end of one way through the runs so far: its own slice, and the way before."""

    __slots__ = ("before", "part", "run", "entry", "slice")

    def __init__(self, before, part, run, entry, text):
        self.before, self.part, self.run, self.entry, self.slice = before, part, run, entry, text


def _lesser(a: _Path | None, x: str, b: _Path | None, y: str) -> bool:
    """Whether way ``a`` and then ``x`` reads less than ``b`` and then ``y``: only what they do not share is looked at."""
    left, right = [x], [y]
    while a is not b:
        left.append(a.slice)
        right.append(b.slice)
        a, b = a.before, b.before
    return "".join(reversed(left)) < "".join(reversed(right))


class _Joined:
    """The runs of one conversation, joined in order; ways that no state needs any more are freed."""

    def __init__(self, conv):
        self.conv, self.counts, self.low, self.high, self.tail = conv, dict.fromkeys(_COUNTS, 0), None, None, None
        self.heads: dict[int, tuple[int, _Path | None]] = {branch.START: (0, None)}

    def add(self, row: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += row[c]
        if row["head"] is not None:
            self.counts["illegal"] += self.tail is not None and self.tail + row["head"] not in ("su", "ua", "au")
            self.tail = row["tail"]
        if row["low"] is not None:
            self.counts["turns"] -= row["low"] == self.high
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        heads = {}
        for goal in range(4):
            best = None
            for entry, (cost, path) in self.heads.items():
                step = row["costs"][4 * entry + goal]
                if step is None:
                    continue
                text = row["audits"][4 * entry + goal]
                if best is None or cost + step < best[0] or cost + step == best[0] and _lesser(path, text, best[1], best[3]):
                    best = cost + step, path, entry, text
            if best:
                heads[goal] = best[0], _Path(best[1], row["part"], row["run"], best[2], best[3])
        self.heads = heads

    def rows(self):
        ends = {branch.START: "", branch.SYSTEM: "II", branch.USER: "I", branch.ASSISTANT: ""}
        best = None
        for state, (cost, path) in self.heads.items():
            cost += branch.PUT * len(ends[state])
            if best is None or cost < best[0] or cost == best[0] and _lesser(path, ends[state], best[1], best[2]):
                best = cost, path, ends[state]
        cost, path, end = best
        nothing = dict.fromkeys((*_COUNTS, "low", "high", "cost", "audit"))
        slices, after = [], end
        while path:
            text = path.slice + after
            yield {"conv": self.conv, "part": path.part, "run": path.run, "entry": path.entry, "slice": text, **nothing}, 64 + len(text)
            slices.append(text)
            path, after = path.before, ""
        audit = "".join(reversed(slices))
        yield {"conv": self.conv, "part": -1, "run": 0, "entry": 0, "slice": None, **self.counts, "low": self.low, "high": self.high, "cost": cost, "audit": audit}, 64 + len(audit)


def _by_conversation(batches, columns: list[str], joined):
    """The rows of a sorted stream, conversation by conversation: ``joined(conv)`` takes them one by one."""
    now = None
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            if now is None or now.conv != row["conv"]:
                if now is not None:
                    yield from now.rows()
                now = joined(row["conv"])
            now.add(row)
    if now is not None:
        yield from now.rows()


def paths(found: DataFrame) -> DataFrame:
    """For conversations of several runs: the slice of the audit that each run has, and one row (part -1) of the whole."""
    struct, schema = _arrow(_PATH, found.schema["conv"].dataType)
    columns = ["conv", "part", "run", *_COUNTS, "head", "tail", "low", "high", "costs", "audits"]
    several = found.filter("not whole").select(columns).repartition("conv").sortWithinPartitions("conv", "part", "run")
    return materialise(several.mapInArrow(lambda batches: _batches(_by_conversation(batches, columns, _Joined), schema, 4096), struct), "conversation-paths")


def apply_audit(rows: list[dict], state: int, audit: str) -> list[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves of a run, from the state in which it begins."""
    out, names = [], {"u": "user", "a": "assistant"}
    queue = [(r["role"], r["text"]) for r in rows for _ in (range(r["copies"]) if r["kind"] not in (BLANK, DUPLICATE) else ())]
    skip = [r["kind"] in (BLANK, DUPLICATE) for r in rows for _ in range(r["copies"])]
    seen, queue = 0, iter(queue)
    for letter in audit:
        wanted = "a" if state == branch.USER else "u"
        if letter == "I":
            out.append((names[wanted], "", letter))
        else:
            gone, seen = skip[seen], seen + 1
            role, text = (None, None) if gone else next(queue)
            if letter == "D":
                continue
            out.append((role if letter == "K" else names[wanted], text, letter))
            wanted = role[:1] if letter == "K" else wanted
        state = {"s": branch.SYSTEM, "u": branch.USER, "a": branch.ASSISTANT}[wanted]
    return out


def _edited(found: DataFrame, ways: DataFrame) -> DataFrame:
    """Runs with the state in which they begin and their slice of the audit."""
    columns = ["conv", "part", "run", "whole", "entry", "slice", "rows"]
    whole = found.filter("whole").withColumns({"entry": F.lit(0), "slice": F.col("audits")[0]}).select(columns)
    steps = ways.filter("part >= 0").select(F.col("part").alias("part_"), F.col("run").alias("run_"), F.col("conv").alias("conv_"), "entry", "slice")
    several = found.filter("not whole").join(steps, (F.col("part") == F.col("part_")) & (F.col("run") == F.col("run_")) & F.col("conv").eqNullSafe(F.col("conv_")))
    return whole.unionByName(several.select(columns))


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **sizes: int) -> DataFrame:
    """The repaired turns of every conversation: conv, part, run, place, role, text and edit (K, R or I), in order of part, run, place.

    Turns go by number (nulls first), then role, then text. Blank turns and repeats of role and
    text are deleted; others are kept, given another role, deleted, and empty ones inserted, so
    that all of a conversation costs least (keep 0, role 2, insert 2, delete 3, a cut-off turn
    that stays 1); of equal repairs that with the ASCII-least audit is taken. Null roles and
    texts are one space, null conversations one conversation, other columns are left out; an
    empty table gives an empty one.
    """
    columns = (F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"))
    texts = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    bound_batches(turns.sparkSession)
    found = runs(faults(turns.select(*columns, *texts, F.lit(1).cast("bigint").alias("copies"))), **sizes)
    struct, schema = _arrow("part int, run int, place int, role string, text string, edit string", found.schema["conv"].dataType)

    def lines(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for place, (role, text, edit) in enumerate(apply_audit(row["rows"], row["entry"], row["slice"])):
                    yield {"conv": row["conv"], "part": row["part"], "run": row["run"], "place": place, "role": role, "text": text, "edit": edit}, len(text)

    return _edited(found, paths(found)).mapInArrow(lambda batches: _batches(lines(batches), schema, 4096), struct)


class _Hashed:
    """SHA-256 of one conversation's lines, fed run by run."""

    def __init__(self, conv):
        self.conv, self.hash, self.empty = conv, hashlib.sha256(), True

    def add(self, row: dict) -> None:
        for role, text, _ in apply_audit(row["rows"], row["entry"], row["slice"]):
            self.hash.update(b"" if self.empty else b"\n")
            self.hash.update(f"{role}:{text}".encode())
            self.empty = False

    def rows(self):
        yield {"conv": self.conv, "sha": self.hash.hexdigest()}, 100


def report(conversations: DataFrame, **sizes: int) -> DataFrame:
    """One row for each conv_id: faults after damage, cost and audit of the repair, and the SHA-256 of its lines.

    A conversation's hash needs its lines in one sequence: those of several runs are sorted
    outside memory and fed to it as a stream. All else of a huge conversation is split. A null
    conv_id is a conversation; one of which no turn is left has zeros and the hash of nothing.
    """
    bound_batches(conversations.sparkSession)
    found = runs(faults(damage(conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))), **sizes)
    ways = paths(found)
    edited = _edited(found, ways)
    struct, schema = _arrow("sha string", found.schema["conv"].dataType)
    hashed = lambda df: df.mapInArrow(lambda batches: _batches(_by_conversation(batches, ["conv", "rows", "entry", "slice"], _Hashed), schema, 4096), struct)
    shas = hashed(edited.filter("not whole").repartition("conv").sortWithinPartitions("conv", "part", "run"))
    several = ways.filter("part < 0").join(shas.withColumnRenamed("conv", "conv_"), F.col("conv").eqNullSafe(F.col("conv_")))

    def one(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _Hashed(row["conv"])
                own.add({"rows": row["rows"], "entry": 0, "slice": row["audit"]})
                yield {k: row[k] for k in names} | {"sha": own.hash.hexdigest()}, 200

    names = ["conv", *_COUNTS, "low", "high", "cost", "audit"]
    struct_one, schema_one = _arrow(f"{', '.join(f'{c} bigint' for c in _COUNTS)}, low bigint, high bigint, cost bigint, audit string, sha string", found.schema["conv"].dataType)
    whole = found.filter("whole").select("conv", *_COUNTS, "low", "high", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), "rows")
    whole = whole.mapInArrow(lambda batches: _batches(one(batches), schema_one, 4096), struct_one)
    both = whole.unionByName(several.select(*names, "sha"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    return both.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
