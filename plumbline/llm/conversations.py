"""Conversation structure repair by a min-plus scan of matrices.

A conversation is sound if its role initials read `(s?(ua)+)?`. Edits of a turn are Keep, Rerole, Delete, and Insert of an empty turn before
or after it. A turn is a 4 x 4 matrix over the states start, system, user and assistant; its cells are (cost, audit), added by joining and
compared by cost, then by the audit's characters, and inserts are closed over on both sides. Products of matrices are associative, and two
audits of equal cost for the same turns are never prefixes of each other, so the least cell of a product comes from least cells of its
factors. Turns are dealt by ranges of (conversation, turn), each task multiplies its stretch of a conversation as a tree, and stretches of one
conversation in several tasks are multiplied in rounds of FAN neighbours each: a conversation of any length is spread over tasks. Only
the writing of the repaired turns, in order, streams a conversation through one task; of it the task holds its audit and a batch.

Defined cases: a null role or text is one space; a role's initial is its first character, and others than s, u and a fit nowhere, nor does an
empty role; null turns come first; rows of one turn are ordered by role, then by the SHA-256 of the text; equal rows are one run with a
number of copies; a null conversation is one like any other; a conversation without rows left costs nothing and has an empty audit. Blank
means no character but ASCII white space. Further columns, whatever their names, are left out; empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, materialise

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Stretches of a conversation that are multiplied in one group of a round.
FAN = 8
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which states a turn of a role leads between.
ARCS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
SPACES = " \t\n\x0b\x0c\r"

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]


def _least(cells: Iterable[Cell]) -> Cell:
    return min((c for c in cells if c is not None), default=None)


def _matrix(cells: Iterable[tuple[int, int, int, str]]) -> Matrix:
    """Of (from, to, cost, letters), the least of each place."""
    found: dict[tuple[int, int], Cell] = {}
    for i, j, cost, letters in cells:
        found[i, j] = _least([found.get((i, j)), (cost, letters)])
    return tuple(tuple(found.get((i, j)) for j in range(4)) for i in range(4))


def times(x: Matrix, y: Matrix) -> Matrix:
    rows = []
    for row in x:
        out: list[Cell] = [None] * 4
        for a, cells in zip(row, y, strict=True):
            if a is None:
                continue
            cost, letters = a
            for j, b in enumerate(cells):
                if b is None:
                    continue
                c, o = cost + b[0], out[j]
                if o is None or c < o[0] or (c == o[0] and letters + b[1] < o[1]):
                    out[j] = (c, letters + b[1])
        rows.append(tuple(out))
    return tuple(rows)


def tree(matrices: Iterable[Matrix]) -> Matrix:
    """Their product, neighbours first, so that each letter is copied once a level; ANY for none."""
    stack: list[tuple[int, Matrix]] = []
    for m in matrices:
        level = 0
        while stack and stack[-1][0] == level:
            m, level = times(stack.pop()[1], m), level + 1
        stack.append((level, m))
    out = ANY
    while stack:
        out = times(stack.pop()[1], out)
    return out


def _closed() -> Matrix:
    """Any number of inserts."""
    m = _matrix([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for r in "ua" for i, j in ARCS[r]])
    while (more := times(m, m)) != m:
        m = more
    return m


#: What can be inserted where there is no turn; neutral for matrices that are closed.
ANY = _closed()


@cache
def turn_matrix(initial: str, truncated: bool) -> Matrix:
    more = TRUNCATED if truncated else 0
    cells = [(i, i, DELETE, "D") for i in range(4)]
    cells += [(i, j, more, "K") for i, j in ARCS.get(initial, ())]
    cells += [(i, j, REROLE + more, "R") for r in "ua" for i, j in ARCS[r]]
    return times(times(ANY, _matrix(cells)), ANY)


@cache
def _gone(copies: int) -> Matrix:
    return times(times(ANY, _matrix((i, i, DELETE * copies, "D" * copies) for i in range(4))), ANY)


def run_matrix(initial: str, fresh: bool, truncated: bool, copies: int) -> Matrix:
    """Of equal adjacent turns. fresh: the first is neither blank nor a duplicate."""
    if not fresh:
        return _gone(copies)
    first = turn_matrix(initial, truncated)
    return first if copies == 1 else times(first, _gone(copies - 1))


# --- tables -----------------------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: turns harmed by the CRC-32 of `conv_id:turn`, modulo 20. 0 drops a turn (no copies), 1 empties its text,
    2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    return turns.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(text("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def runs(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Equal turns of a conversation put together, as a stored table: conv_id, turn, role, text, digest, initial, blank, truncated, copies.

    copies: a column that counts a row so many times; rows with 0 only say that the conversation exists.
    """
    n = F.lit(1).cast("long") if copies is None else F.col(copies)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    found = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), n.alias("copies"))
    found = found.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    return materialise(
        found.select(
            "conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"), F.substring("role", 1, 1).alias("initial"),
            (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "copies",
        ),
        "conversation-runs",
    )


def _fresh(found: DataFrame) -> DataFrame:
    """found with `fresh`: the earliest turn with this role and text, if that isn't blank.

    The earliest turn comes from an aggregation and is joined by all of its key, turn included, so that no key has two rows on either side.
    """
    there = found.filter(F.col("copies") > 0)
    early = there.groupBy("conv_id", "role", "digest").agg(F.bool_or(F.col("turn").isNull()).alias("any"), F.min("turn").alias("low"))
    early = early.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.when(~F.col("any"), F.col("low")).alias("t"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    return found.drop("text").join(early, same, "left").withColumn("fresh", F.coalesce("first", F.lit(False)) & ~F.col("blank"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_CELLS = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def _piece_schema(conv: T.DataType) -> T.StructType:
    """A stretch: low, high and days tell its first, last and different turns; head and tail its outer initials, null without turns."""
    fields = [("conv_id", conv), ("part", T.LongType()), ("open", T.BooleanType()), ("low", T.LongType()), ("high", T.LongType()), ("different", T.LongType())]
    fields += [(c, T.LongType()) for c in _COUNTS] + [("head", T.StringType()), ("tail", T.StringType()), ("cells", _CELLS)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _legal(a: str | None, b: str | None) -> bool:
    return a is None or b is None or a + b in ("su", "ua", "au")


def _joined(pieces: list[dict]) -> dict:
    """Neighbouring stretches as one."""
    out = dict(pieces[0])
    for p in pieces[1:]:
        out["illegal"] += not _legal(out["tail"], p["head"])
        if p["low"] is not None:
            out["different"] -= out["high"] == p["low"]
            out["low"] = p["low"] if out["low"] is None else out["low"]
            out["high"] = p["high"]
        for c in ("different", *_COUNTS):
            out[c] += p[c]
        out["head"] = p["head"] if out["head"] is None else out["head"]
        out["tail"] = p["tail"] if p["tail"] is not None else out["tail"]
    return out | {"cells": _flat(tree(_square(p["cells"]) for p in pieces))}


def _flat(m: Matrix) -> list[dict | None]:
    return [c and {"cost": c[0], "audit": c[1]} for row in m for c in row]


def _square(cells: list[dict | None]) -> Matrix:
    flat = [c and (c["cost"], c["audit"]) for c in cells]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    return chain.from_iterable(b.to_pylist() for b in batches)


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stretch(conv, rows: Iterable[dict]) -> dict:
    """A conversation's turns within one task, in order."""
    out = {"conv_id": conv, "part": 0, "open": False, "low": None, "high": None, "different": 0, "head": None, "tail": None} | dict.fromkeys(_COUNTS, 0)

    def matrices() -> Iterator[Matrix]:
        for r in rows:
            out["part"] = r["part"]
            n, x = r["copies"], r["initial"]
            if not n:
                continue
            if r["turn"] is not None and r["turn"] != out["high"]:
                out["low"] = r["turn"] if out["low"] is None else out["low"]
                out["high"] = r["turn"]
                out["different"] += 1
            out["illegal"] += n - 1 + (not _legal(out["tail"], x))
            out["head"] = x if out["head"] is None else out["head"]
            out["tail"] = x
            if r["blank"]:
                out["blank"] += n
            else:
                out["duplicate"] += n - r["fresh"]
                out["truncated"] += r["fresh"] and r["truncated"]
            yield run_matrix(x, r["fresh"], r["truncated"], n)

    product = tree(matrices())
    return out | {"cells": _flat(product)}


def audit(found: DataFrame) -> DataFrame:
    """Of each conversation of a runs() table: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (K, R, D and I in order)."""
    schema = _piece_schema(found.schema["conv_id"].dataType)
    shape = to_arrow_schema(schema)

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            """The first and the last of a task may go on in its neighbours."""
            held = None
            for k, (conv, rows) in enumerate(groupby(_rows(batches), lambda r: r["conv_id"])):
                if held is not None:
                    yield held
                held = _stretch(conv, rows) | {"open": k == 0}
            if held is not None:
                yield held | {"open": True}

        return _batches(made(), shape)

    def together(table: pa.Table) -> pa.Table:
        joined = _joined(sorted(table.to_pylist(), key=lambda p: p["at"]))
        return pa.Table.from_pylist([joined], shape)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv_id", "turn", "role", "digest")
    dealt = _fresh(found).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "initial", "blank", "truncated", "fresh", "copies", F.spark_partition_id().cast("long").alias("part"))
    pieces = materialise(dealt.mapInArrow(stretches, schema), "conversation-pieces")
    top = pieces.agg(F.max("part")).first()[0] or 0
    rest = pieces.filter("open")
    while True:
        groups = rest.withColumns({"at": F.col("part"), "part": F.floor(F.col("part") / FAN)}).groupBy("conv_id", "part")
        rest = groups.applyInArrow(together, schema)
        top //= FAN
        if not top:
            break
    best = F.least(F.col("cells")[4 * START + START], F.col("cells")[4 * START + ASSISTANT])
    whole = pieces.filter("not open").unionByName(rest).withColumn("best", best)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("different"), F.lit(0).cast("long"))
    return materialise(whole.select("conv_id", gaps.alias("gaps"), *_COUNTS, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")), "conversation-audits")


def _repaired(audit_of: str, rows: Iterable[dict]) -> Iterator[dict]:
    """The turns that the audit leaves and makes, in order. Roles of rewritten and inserted turns follow from those before."""
    state, at, i = START, 0, 0

    def wanted() -> tuple[str, int]:
        return ("assistant", ASSISTANT) if state == USER else ("user", USER)

    def edit(letter: str, turn, role: str, text: str) -> dict:
        nonlocal state, at
        if letter == "K":
            state = dict(ARCS[role[0]])[state]
        else:
            role, state = wanted()
        at += 1
        return {"position": at - 1, "edit": letter, "turn": turn, "role": role, "text": text}

    for r in rows:
        for _ in range(r["copies"]):
            while audit_of[i] == "I":
                yield edit("I", None, "", "")
                i += 1
            if audit_of[i] != "D":
                yield edit(audit_of[i], r["turn"], r["role"], r["text"])
            i += 1
    for letter in audit_of[i:]:
        yield edit(letter, None, "", "")


def _in_order(found: DataFrame, audits: DataFrame) -> DataFrame:
    """A conversation's audit, then its turns, in one task."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = audits.select("conv_id", F.lit(0).alias("after"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"), F.col("audit").alias("text"), none("long").alias("copies"))
    turns = found.filter(F.col("copies") > 0).select("conv_id", F.lit(1).alias("after"), "turn", "role", "digest", "text", "copies")
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "digest")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    for conv, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
        yield conv, _repaired(next(rows)["text"], rows)


def repair(found: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), turn (null for an inserted one), role, text."""
    schema = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    shape = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"conv_id": conv} | t for conv, turns in _conversations(batches) for t in turns), shape)

    return _in_order(found, audits).mapInArrow(run, schema)


def digests(found: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, over the repaired turns as `role:text`, joined by line feeds. The hash runs along with the turns."""
    schema = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    shape = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for conv, turns in _conversations(batches):
                h = hashlib.sha256()
                for t in turns:
                    h.update(("\n" * (t["position"] > 0) + t["role"] + ":" + t["text"]).encode())
                yield {"conv_id": conv, "repaired_sha256": h.hexdigest()}

        return _batches(made(), shape)

    return _in_order(found, audits).mapInArrow(run, schema)


def report(turns: DataFrame) -> DataFrame:
    """Of each conversation its audit() and digests(). turns: as damage() gives them."""
    found = runs(turns, "copies")
    audits = audit(found)
    hashed = digests(found, audits).select(F.col("conv_id").alias("c"), "repaired_sha256")
    out = materialise(audits.join(hashed, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), "conversation-report")
    discard(found)
    discard(audits)
    return out
