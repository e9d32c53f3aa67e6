"""Conversation structure: faults, and the cheapest repair by a forward Viterbi search over four grammar states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch

#: Grammar `(s?(ua)+)?`: nothing yet, after a system turn, after a user's, after an assistant's. Turns end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a turn of an initial may come, and where it leads.
MOVES = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Fixed value: white space.
BLANKS = " \t\n\x0b\x0c\r"
#: Turn numbers that one segment of a long conversation covers.
SPAN = 4096
COUNTS = "min_turn long, max_turn long, turns long, blank long, duplicate long, truncated long, illegal long"
FOUND = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Search:
    """States' cheapest repairs of the turns so far: (cost, audit, digest of the repaired turns), from one state on.

    Two repairs of the same turns that end in one state at one cost differ before either ends, so the smaller audit stays the smaller
    whatever follows, and the best of each state is all that a later turn can need."""

    def __init__(self, entry: int = START, hashed: bool = True):
        self.at = [None] * 4
        self.at[entry] = (0, "", hashlib.sha256() if hashed else None)
        if entry == START:
            self.close()

    def offer(self, to: int, state: int, cost: int, letter: str, role: str | None = None, text: bytes = b"", into: list | None = None) -> None:
        into, (paid, audit, digest) = self.at if into is None else into, self.at[state]
        if into[to] is not None and (paid + cost, audit + letter) >= into[to][:2]:
            return
        if role is not None and digest is not None:
            digest = digest.copy()
            digest.update(("" if state == START else "\n").encode() + role.encode("utf-8", "replace") + b":" + text)
        into[to] = (paid + cost, audit + letter, digest)

    def close(self) -> None:
        """Insert transitions: to a user's turn, then to an assistant's. Longer runs come back to a state at a price, and so never help."""
        for initial in "ua":
            sources, to = MOVES[initial]
            for state in sources:
                if self.at[state] is not None:
                    self.offer(to, state, INSERT, "I", ROLES[initial])

    def turn(self, role: str, text: bytes, fault: str | None) -> None:
        new: list = [None] * 4
        for state in range(4):
            if self.at[state] is not None:
                self.offer(state, state, DELETE, "D", into=new)
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            for initial, (sources, to) in MOVES.items():
                for state in sources:
                    if self.at[state] is not None:
                        if role[:1] == initial:
                            self.offer(to, state, more, "K", role, text, new)
                        elif initial in ROLES:
                            self.offer(to, state, more + REROLE, "R", ROLES[initial], text, new)
        self.at = new
        self.close()

    def best(self) -> int:
        return min((s for s in (START, ASSISTANT) if self.at[s] is not None), key=lambda s: self.at[s][:2])


class Tally:
    """Counts over turns in order."""

    def __init__(self):
        self.low = self.high = self.before = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None:
            self.turns += turn != self.before
            self.low, self.high, self.before = turn if self.low is None else self.low, turn, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is not None:
            self.illegal += self.last + role[:1] not in LEGAL
        self.first, self.last = role[:1] if self.first is None else self.first, role[:1]

    def join(self, later: dict) -> None:
        """A later segment's counts; no turn number is in both."""
        for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + later[k])
        if later["max_turn"] is not None:
            self.low, self.high = later["min_turn"] if self.low is None else self.low, later["max_turn"]
        if later["last"] is not None:
            self.illegal += self.last is not None and self.last + later["first"] not in LEGAL
            self.last = later["last"]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def fault_of(text: str, seen: bool) -> str | None:
    body = text.rstrip(BLANKS)
    return "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else None


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with null role and text as one space, `copies` (0 for a row that goes, 2 for a repeated one) and the damage of the row's place:
    crc32 of `conv_id:turn`, nulls as one space, by its remainder of 20: 0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its role user."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    out = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _turns(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("k", "seg", "conv_id", "gone", "turn", "role", "text", "seen")))


def _runs(rows: Iterator[tuple], size: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows of an equal head, one run after another; a run is read as it comes."""
    row = next(rows, None)
    while row is not None:
        head = row[:size]

        def run():
            nonlocal row
            while row is not None and row[:size] == head:
                yield row
                row = next(rows, None)

        yield head, run()


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _whole(id_type: pa.DataType):
    """Conversations that are one segment: counts, search and digest in one pass over their turns, which aren't held."""
    schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def found(batches):
        for _, rows in _runs(_turns(batches), 1):
            tally, search = Tally(), Search()
            for _, _, conv, gone, turn, role, text, seen in rows:
                if not gone:
                    fault = fault_of(text, seen)
                    tally.add(turn, role, fault)
                    search.turn(role, text.encode("utf-8", "replace"), fault)
            cost, audit, digest = search.at[search.best()]
            yield {"conv_id": conv, "gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}

    return lambda batches: _batched(found(batches), schema)


PIECE = "array<struct<entry int, exit int, cost long, audit string>>"


def _segments(id_type: pa.DataType):
    """Segments of long conversations: counts, and for each state before the segment the cheapest repairs to each state after it."""
    piece = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("k", pa.string()), ("seg", pa.int64()), ("conv_id", id_type), *[(c.split()[0], pa.int64()) for c in COUNTS.split(", ")], ("first", pa.string()), ("last", pa.string()), ("ways", piece)])

    def found(batches):
        for (k, seg), rows in _runs(_turns(batches), 2):
            tally, searches, any_ = Tally(), [Search(e, hashed=False) for e in range(4)], False
            for _, _, conv, gone, turn, role, text, seen in rows:
                if not gone:
                    fault, any_ = fault_of(text, seen), True
                    tally.add(turn, role, fault)
                    for s in searches:
                        s.turn(role, b"", fault)
            ways = [{"entry": e, "exit": x, "cost": w[0], "audit": w[1]} for e, s in enumerate(searches) for x, w in enumerate(s.at) if w is not None] if any_ else [{"entry": e, "exit": e, "cost": 0, "audit": ""} for e in range(4)]
            yield {"k": k, "seg": seg, "conv_id": conv, "min_turn": tally.low, "max_turn": tally.high, "turns": tally.turns, "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "first": tally.first, "last": tally.last, "ways": ways}

    return lambda batches: _batched(found(batches), schema, 8)


def _chained(id_type: pa.DataType):
    """Segments of a long conversation in order, joined state by state; the audit comes out cut by segment."""
    cut = pa.list_(pa.struct([("seg", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("k", pa.string()), ("conv_id", id_type), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("cuts", cut)])

    def rows_of(batches):
        for batch in batches:
            yield from ((r["k"], r) for r in batch.to_pylist())

    def found(batches):
        for (k,), rows in _runs(rows_of(batches), 1):
            tally, at = Tally(), [(0, "", ()), None, None, None]
            for _, r in rows:
                tally.join(r)
                new: list = [None] * 4
                for w in r["ways"]:
                    if at[w["entry"]] is not None:
                        cost, audit, cuts = at[w["entry"]]
                        way = (cost + w["cost"], audit + w["audit"])
                        if new[w["exit"]] is None or way < new[w["exit"]][:2]:
                            new[w["exit"]] = (*way, (cuts, r["seg"], w["audit"]))
                at, conv = new, r["conv_id"]
            best = min((s for s in (START, ASSISTANT) if at[s] is not None), key=lambda s: at[s][:2])
            cost, _, cuts = at[best]
            told = []
            while cuts:
                cuts, seg, audit = cuts
                told.append({"seg": seg, "audit": audit})
            yield {"k": k, "conv_id": conv, "gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost, "cuts": told[::-1]}

    return lambda batches: _batched(found(batches), schema, 8)


def _digests():
    """A long conversation's repaired turns, by each segment's audit. SHA-256 takes its input in order, so this reads a conversation in one task, turn by turn."""
    schema = pa.schema([("k", pa.string()), ("repaired_sha256", pa.string())])

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("k", "seg", "gone", "role", "text", "piece")))

    def found(batches):
        for (k,), rows in _runs(rows_of(batches), 1):
            digest, last, seg_now, piece, place = hashlib.sha256(), "", None, "", 0

            def put(initial: str, role: str, text: str) -> None:
                nonlocal last
                digest.update((("\n" if last else "") + f"{role}:{text}").encode("utf-8", "replace"))
                last = initial

            def inserts() -> None:
                nonlocal place
                while piece[place : place + 1] == "I":
                    initial = "a" if last == "u" else "u"
                    put(initial, ROLES[initial], "")
                    place += 1

            for _, seg, gone, role, text, own in rows:
                if seg != seg_now:
                    inserts()
                    seg_now, piece, place = seg, own, 0
                if gone:
                    continue
                inserts()
                letter, place = piece[place], place + 1
                initial = role[:1] if letter == "K" else "a" if last == "u" else "u"
                if letter != "D":
                    put(initial, role if letter == "K" else ROLES[initial], text)
            inserts()
            yield {"k": k, "repaired_sha256": digest.hexdigest()}

    return lambda batches: _batched(found(batches), schema)


def repair_conversations(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations(conv_id, turn, role, text, copies):
    a row for each conv_id, null counting as one.

    Turns are taken by number, those without one first, then by role and text. `copies` says how often a row stands, 0 for
    not at all. A turn's first fault counts: blank, duplicate of an earlier one of its conversation, truncated. The audit is the
    cheapest way to the grammar `(s?(ua)+)?`, of equals the least: Keep 0, Rerole 3, Delete 4, Insert 3, and 3 for a truncated turn
    that stays; blank and duplicate ones go. gaps counts missing numbers between the smallest and the largest.
    A conversation whose rows all go has zeros, an empty audit and the digest of nothing. Null role and text are one space, so such a
    turn can't be kept. Repeated rows are duplicates. Texts of any length pass once; an empty table gives none. Further columns aren't read.

    A conversation is grouped whole while its turn numbers lie from 0 to `span`; its turns stream past the search, which
    holds four repairs. A longer one is cut into segments of `span` numbers, so that no task has it all: each segment gives the cheapest way from
    every state to every state, and the ways are chained. Turns of one number are never cut apart."""
    spark = conversations.sparkSession
    id_type = to_arrow_schema(conversations.select("conv_id").schema).field("conv_id").type
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = conversations.select(key.alias("k"), "conv_id", "turn", "role", "text", (F.col("copies") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy")).drop("copy")
    scratch = Scratch(spark, "turns")
    beyond = (F.col("turn") < 0) | (F.col("turn") >= span)
    long_ones = scratch.save(conversations.where(beyond).select(key.alias("k")).distinct())
    kind = conversations.schema["conv_id"].dataType.simpleString()
    order = ["k", "seg", F.col("turn").asc_nulls_first(), "role", "text"]
    cut = not long_ones.isEmpty()
    short = rows.join(long_ones, "k", "left_anti") if cut else rows
    same = lambda: F.row_number().over(Window.partitionBy("k", "seg", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    short = short.withColumn("seg", F.lit(0).cast("long")).repartition("k").withColumn("seen", same()).sortWithinPartitions(*order)
    out = short.mapInArrow(_whole(id_type), FOUND.format(id=kind))
    if not cut:
        return out
    seg = F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62))).cast("long")
    long_rows = rows.join(long_ones, "k", "left_semi").withColumns({"seg": seg, "h": F.struct(F.xxhash64("role", "text"), F.hash("text", "role"), F.length("text"))})
    texts = long_rows.where("not gone").select("k", "seg", "h").distinct()
    firsts = texts.groupBy("k", "h").agg(F.min("seg").alias("first"))
    later = texts.join(firsts, ["k", "h"]).where("seg > first").select("k", "seg", "h", F.lit(True).alias("met"))
    long_rows = long_rows.join(later, ["k", "seg", "h"], "left").repartition("k", "seg").withColumn("seen", F.coalesce("met", F.lit(False)) | same())
    long_rows = scratch.save(long_rows.select("k", "seg", "conv_id", "gone", "turn", "role", "text", "seen"))
    ways = long_rows.repartition("k", "seg").sortWithinPartitions(*order).mapInArrow(_segments(id_type), f"k string, seg long, conv_id {kind}, {COUNTS}, first string, last string, ways {PIECE}")
    chained = scratch.save(ways.repartition("k").sortWithinPartitions("k", "seg").mapInArrow(_chained(id_type), f"k string, conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, cuts array<struct<seg long, audit string>>"))
    cuts = chained.select("k", F.explode("cuts").alias("c")).select("k", F.col("c.seg").alias("seg"), F.col("c.audit").alias("piece"))
    digests = long_rows.join(cuts, ["k", "seg"]).repartition("k").sortWithinPartitions(*order).mapInArrow(_digests(), "k string, repaired_sha256 string")
    told = chained.join(digests, "k").withColumn("audit", F.array_join(F.transform("cuts", lambda c: c["audit"]), ""))
    return out.unionByName(told.select(*out.columns))
