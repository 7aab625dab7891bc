"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, chosen by one integer minimum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of the audit by digit: Delete, Insert, Keep, Rerole. Digit 0 pads behind the end, so an audit sorts before its continuations.
LETTERS = b"\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
BITS = 3
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: What was put out last: nothing, system, user, assistant; and where a role initial leads from there. Legal ends: nothing, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {b"s": {NOTHING: SYSTEM}, b"u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, b"a": {USER: ASSISTANT}}
ROLES = {b"u": b"user", b"a": b"assistant"}
LEGAL = {b"su", b"ua", b"au"}
#: What one state can do another can for at most so much more: two inserts lead from any state to behind an assistant, and there a system row that only
#: the state nothing may keep is deleted. A path that costs more than this above the cheapest one can't win.
SLACK = 7
#: Digits of a weight at the start; it is widened where paths stay apart for longer.
WIDTH = 64
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Repair:
    """The cheapest paths through the rows of one conversation so far, one for each state.

    A path is (weight, letters, hash): weight = cost * 2**(BITS * width) + its audit as digits from the top down, zeros behind its end. So edges add to a
    weight and one integer comparison decides by cost, then by the audit. It may compare paths of unlike length: with equal costs neither audit
    begins the other, since what one of them has more could only be inserts, which cost. Digits that all paths share are put out and taken off,
    so that weights stay short in long conversations. The hash is that of the repaired text, so that no text is held.
    """

    def __init__(self) -> None:
        self.width = WIDTH
        self.audit = bytearray()
        self.paths: list[tuple | None] = [(0, 0, hashlib.sha256()), None, None, None]

    def step(self, path: tuple, letter: int, extra: int = 0) -> int:
        """Weight of the path with one edit more."""
        return path[0] + ((COST[letter] + extra) << (BITS * self.width)) + (letter << (BITS * (self.width - 1 - path[1])))

    @staticmethod
    def told(path: tuple, weight: int, state: int, role: bytes, text: bytes) -> tuple:
        digest = path[2].copy()
        digest.update((b"" if state == NOTHING else b"\n") + role + b":" + text)
        return weight, path[1] + 1, digest

    def insert(self) -> None:
        """Inserts before the next row or the end; a cheapest path enters no state twice, so three in a row are the most."""
        for _ in range(3):
            for initial in (b"u", b"a"):
                for a, b in MOVES[initial].items():
                    if (path := self.paths[a]) is not None:
                        weight = self.step(path, INSERT)
                        if self.paths[b] is None or weight < self.paths[b][0]:
                            self.paths[b] = self.told(path, weight, a, ROLES[initial], b"")

    def row(self, role: bytes, text: bytes, must_go: bool, truncated: bool) -> None:
        self.narrow()
        self.insert()
        best: list[tuple | None] = [None] * 4
        for state, path in enumerate(self.paths):
            if path is None:
                continue
            edges = [(self.step(path, DELETE), state, None)]
            if not must_go:
                kept = MOVES.get(role[:1], {}).get(state)
                if kept is not None:
                    edges.append((self.step(path, KEEP, truncated), kept, role))
                for initial, name in ROLES.items():
                    if (to := MOVES[initial].get(state)) is not None:
                        edges.append((self.step(path, REROLE, truncated), to, name))
            for weight, to, name in edges:
                if best[to] is None or weight < best[to][0]:
                    best[to] = (weight, state, name)
        old, most = self.paths, (min(b[0] for b in best if b is not None) >> (BITS * self.width)) + SLACK
        self.paths = [
            None if b is None or b[0] >> (BITS * self.width) > most else (b[0], old[b[1]][1] + 1, old[b[1]][2]) if b[2] is None else self.told(old[b[1]], b[0], b[1], b[2], text) for b in best
        ]

    def narrow(self) -> None:
        """Room for the letters of one more row: takes off the digits that all paths share, and widens the weights if that isn't enough."""
        alive = [p for p in self.paths if p is not None]
        if max(p[1] for p in alive) + 8 <= self.width:
            return
        size = BITS * self.width
        low = [p[0] & ((1 << size) - 1) for p in alive]
        apart = max(x ^ low[0] for x in low).bit_length()
        shared = min((size - apart) // BITS, min(p[1] for p in alive))
        self.audit += self.letters(low[0], shared)
        wider = 2 if (self.width - shared) * 2 > self.width else 1
        moved = lambda p: ((p[0] >> size) << (size * wider)) + (((p[0] << (BITS * shared)) & ((1 << size) - 1)) << (size * (wider - 1)))
        self.paths = [None if p is None else (moved(p), p[1] - shared, p[2]) for p in self.paths]
        self.width *= wider

    def letters(self, weight: int, n: int) -> bytes:
        return bytes(LETTERS[(weight >> (BITS * (self.width - 1 - k))) & ((1 << BITS) - 1)] for k in range(n))

    def done(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256) of the cheapest whole repair."""
        self.narrow()
        self.insert()
        weight, n, digest = min((p for p in (self.paths[NOTHING], self.paths[ASSISTANT]) if p is not None), key=lambda p: p[0])
        return weight >> (BITS * self.width), (bytes(self.audit) + self.letters(weight, n)).decode("ascii"), digest.hexdigest()


class Conversation:
    """Counts and repair of one conversation, whose rows come in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def row(self, turn: int | None, role: bytes, text: bytes, again: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        body = text.rstrip()  # of bytes: exactly the characters 9 to 13 and 32
        blank, duplicate = not body, bool(body) and again
        truncated = bool(body) and not again and body[-1:] not in (b".", b"!", b"?")
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit, digest = self.repair.done()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows with synthetic faults, by crc32 of "conv_id:turn" modulo 20: 0 drops the row (``gone``), 1 empties its
    text, 2 takes ``.!?`` from it, 3 repeats the row, 4 makes its role user. A null role or text, and a null in the hashed key, is one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id (null is one of its own): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. rows: conv_id, turn, role, text and
    ``gone`` (not part of the conversation, which is still returned); other columns are ignored.

    Rows stand by turn, nulls first; ties by role, then text, so equal rows are neighbours and any order of input gives the same result. A null role or
    text is one space. One exchange by conversation; duplicates are found there by 128 bits of role and text. The rows of a conversation are then
    streamed through its repair, of which the audit alone grows with it: whole texts, one conversation of any length in bounded memory. It is one
    task's stream, since its hash is one chain. An empty table gives an empty result.
    """
    held = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone").repartition("conv_id")
    alike = Window.partitionBy("conv_id", "gone", F.xxhash64("role", "text"), F.xxhash64(F.lit(7), F.col("text"), F.col("role"))).orderBy(F.asc_nulls_first("turn"))
    marked = held.withColumn("again", F.row_number().over(alike) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            out = []
            for conv_id, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv_id)
                if not gone:
                    now.row(turn, role, text, again)
            if out:
                yield packed(out)
        if now is not None:
            yield packed([now.result()])

    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=fields)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    lean = ordered.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "gone", "again")
    return lean.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
