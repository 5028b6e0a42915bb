"""Repair of conversations by lightest derivations.

A conversation is right if the initials of its roles read ``(s?(ua)+)?`` and no row is blank, repeated or cut. Repairing
is deduction with weights. An item says: the first i rows are done and the roles written so far leave the grammar in
state q. Each edit of the next row (keep, give another role, delete) or an inserted row deduces the next item; its value
is (cost, audit), where the audit spells the edits. Values grow along every deduction and keep their order when the same
edit follows (items of equal cost are never prefixes of one another, since only insertions make an audit longer), so
Knuth's agenda pops items in order of value, the first pop of an item is its lightest derivation, and the search ends
when the goal is popped.

Rows are sorted by conversation and turn over ranges, so a conversation of any length lies in as many tasks as it needs.
A task streams its rows and solves every conversation that lies within it. Those that may go over its ends, or over
``PIECE`` rows, become pieces: each is solved from every state to every state, the pieces' items are combined in order
(two antecedents: what came before, and the piece from where that ended), and the hash, which can only be computed in
order, streams the repaired pieces of a conversation without holding them together.

Defined results: null conversation ids are one conversation; null roles and texts count as one space; rows of one turn go by
the md5 of role and text, null turns come first; an empty role fits nowhere; a conversation without rows that are present
gives zeros, no audit and the hash of nothing; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .data import only, query, ship_package, store, table
from .sharding import _CRC, _CRC_TABLE

#: Rows, and bytes of text, that are solved at once.
PIECE, PIECE_BYTES = 256, 8 << 20
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States by what was written last: nothing, system, user, assistant. A conversation may end in FINAL.
STATES = range(4)
FINAL = (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {"su", "ua", "au"}
#: What an inserted or renamed row becomes, by the state before it.
ROLE = ("user", "user", "assistant", "user")
_TEXT = re.compile(r"[^\x20\x09-\x0D]")
_WHOLE = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

BLANK, DOUBLE, SHORT, CLEAN = "blank", "duplicate", "truncated", ""


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: no text, seen before, or no mark at its end."""
    if not _TEXT.search(text):
        return BLANK
    return DOUBLE if seen else CLEAN if _WHOLE.search(text) else SHORT


def derive(roles: list[str], faults: list[str], start: int = 0, goals: tuple[int, ...] = FINAL) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from ``start`` to the first goal that is popped, or, for all states, to each."""
    n, every = len(roles), goals == tuple(STATES)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and q in goals:
            found[q] = cost, audit
            if not every or len(found) == len(goals):
                break
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, NEXT[q, ROLE[q][0]]))
        if i == n:
            continue
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if faults[i] in (CLEAN, SHORT):
            extra = CUT if faults[i] == SHORT else 0
            kept = NEXT.get((q, roles[i][:1]))
            if kept is not None:
                heapq.heappush(agenda, (cost + extra, audit + "K", i + 1, kept))
            heapq.heappush(agenda, (cost + extra + RENAME, audit + "R", i + 1, NEXT[q, ROLE[q][0]]))
    return found


def rewrite(roles: list[str], texts: list[str], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """The rows that an audit leaves, with their roles."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = ("", "") if edit == "I" else (roles[i], texts[i])
        if edit != "K":
            role = ROLE[state]
        i += edit != "I"
        state = NEXT[state, role[0]]
        yield role, text


def _written(rows: Iterator[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


class Tally:
    """What is counted over the rows of a conversation in order, in one piece or several."""

    def __init__(self):
        self.faults = dict.fromkeys((BLANK, DOUBLE, SHORT), 0)
        self.illegal = self.turns = 0
        self.first = self.last = None  # initials of the first and the last role
        self.low = self.high = None

    def add(self, turn: int | None, role: str, found: str) -> None:
        if found:
            self.faults[found] += 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def follow(self, other: dict) -> None:
        """Append the tally of a later piece."""
        for name in self.faults:
            self.faults[name] += other[name]
        self.illegal += other["illegal"]
        if other["first"] is not None:
            self.illegal += self.last is not None and self.last + other["first"] not in LEGAL
            self.first = other["first"] if self.first is None else self.first
            self.last = other["last"]
        if other["turns"]:
            self.turns += other["turns"] - (other["low"] == self.high)
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]

    @property
    def gaps(self) -> int:
        return min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0

    def row(self) -> dict:
        return {**self.faults, "illegal": self.illegal, "first": self.first, "last": self.last, "turns": self.turns, "low": self.low, "high": self.high}


_SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      ("audit", pa.string()), ("repaired_sha256", pa.string())])
_PIECES = pa.schema([*_SUMMARY, ("part", pa.int64()), ("seq", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                     ("texts", pa.list_(pa.string()))])
_TABLES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), *[(c, pa.int64()) for c in (BLANK, DOUBLE, SHORT, "illegal")],
                     ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("turns", "low", "high")],
                     ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_CHOSEN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("state", pa.int64()), ("edits", pa.string()),
                     *[f for f in _SUMMARY if f.name not in ("conv_id", "repaired_sha256")]])
_HASHES = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
_SQL = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``size`` or, where they hold texts, of about PIECE_BYTES."""
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += sum(map(len, row.get("texts") or ()))
        if len(waiting) >= size or held > PIECE_BYTES:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def solve(turns: list, roles: list[str], texts: list[str]) -> dict:
    """Everything about a conversation that lies in one piece."""
    tally, seen, faults = Tally(), set(), []
    for turn, role, text in zip(turns, roles, texts):
        found = fault(text, (role, text) in seen)
        seen.add((role, text))
        faults.append(found)
        tally.add(turn, role, found)
    cost, audit = next(iter(derive(roles, faults).values()))
    digest = hashlib.sha256(_written(rewrite(roles, texts, audit))).hexdigest()
    return {**tally.faults, "gaps": tally.gaps, "illegal": tally.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _stream(rows: Iterator[dict], part: int, piece: int, keep: bool) -> Iterator[dict]:
    """Conversations that lie within a sorted task, solved; pieces of those that may go beyond it or are long."""
    held: list[dict] = []
    conv, size, seq, opened, first = None, 0, 0, False, True

    def cut() -> dict:
        return {"conv_id": conv, "part": part, "seq": seq, "turns": [r["turn"] for r in held], "roles": [r["role"] for r in held],
                "texts": [r["text"] for r in held]}

    started = False
    for row in rows:
        if started and row["conv_id"] != conv:
            if first or opened or keep:
                yield cut()
                seq += 1
            else:
                yield {"conv_id": conv, **solve(*([r[c] for r in held] for c in ("turn", "role", "text")))}
            held, size, opened, first = [], 0, False, False
        started, conv = True, row["conv_id"]
        if row["present"]:
            if len(held) >= piece or size > PIECE_BYTES:
                yield cut()
                seq += 1
                held, size, opened = [], 0, True
            held.append(row)
            size += len(row["text"])
    if started:
        yield cut()


def _table(row: dict) -> dict:
    """A piece solved from each state to each state."""
    double = set(row["doubles"] or ())
    tally, faults = Tally(), []
    for k, (turn, role, text) in enumerate(zip(row["turns"], row["roles"], row["texts"])):
        faults.append(fault(text, k in double))
        tally.add(turn, role, faults[-1])
    items = [derive(row["roles"], faults, start, tuple(STATES)) for start in STATES]
    cells = [items[p].get(q, (None, None)) for p in STATES for q in STATES]
    return {**{c: row[c] for c in ("conv_id", "part", "seq")}, **tally.row(), "costs": [c for c, _ in cells], "audits": [a for _, a in cells]}


def _later(x, y) -> tuple[str, str]:
    """Two chains of (earlier, edits, ...) of equal length as text, from where they part."""
    left, right = [], []
    while x is not y:
        left.append(x[1])
        right.append(y[1])
        x, y = x[0], y[0]
    return "".join(reversed(left)), "".join(reversed(right))


def _lighter(x, y) -> bool:
    if y is None or x[0] != y[0]:
        return y is None or x[0] < y[0]
    left, right = _later(x[1], y[1])
    return left < right


def _combine(rows: Iterator[dict]) -> Iterator[dict]:
    """Chosen edits of each piece, with the conversation's summary in its first piece; rows come in order."""
    conv, heads, tally, started = None, {}, Tally(), False

    def finish() -> Iterator[dict]:
        best = None
        for q in FINAL:
            if q in heads and _lighter(heads[q], best):
                best = heads[q]
        chain, node = [], best[1]
        while node is not None:
            chain.append(node)
            node = node[0]
        chain.reverse()
        summary = {**tally.faults, "gaps": tally.gaps, "illegal": tally.illegal, "cost": best[0], "audit": "".join(n[1] for n in chain)}
        for k, (_, edits, state, part, seq) in enumerate(chain):
            yield {"conv_id": conv, "part": part, "seq": seq, "state": state, "edits": edits, **(summary if k == 0 else {})}

    for row in rows:
        if not started or row["conv_id"] != conv:
            if started:
                yield from finish()
            conv, heads, tally, started = row["conv_id"], {0: (0, None)}, Tally(), True
        tally.follow(row)
        reached: dict[int, tuple] = {}
        for p, (cost, chain) in heads.items():
            for q in STATES:
                own = row["costs"][4 * p + q]
                if own is not None:
                    candidate = cost + own, (chain, row["audits"][4 * p + q], p, row["part"], row["seq"])
                    if _lighter(candidate, reached.get(q)):
                        reached[q] = candidate
        heads = reached
    if started:
        yield from finish()


def _hash(rows: Iterator[dict]) -> Iterator[dict]:
    conv, digest, lead, started = None, hashlib.sha256(), b"", False
    for row in rows:
        if started and row["conv_id"] != conv:
            yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
            digest, lead = hashlib.sha256(), b""
        started, conv = True, row["conv_id"]
        written = _written((r["role"], r["text"]) for r in row["repaired"])
        if row["repaired"]:
            digest.update(lead + written)
            lead = b"\n"
    if started:
        yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}


def _map(df: DataFrame, function, schema: pa.Schema) -> DataFrame:
    return df.mapInArrow(lambda batches: _batches(function(_rows(batches)), schema), _ddl(schema))


_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _repaired(pieces: DataFrame) -> DataFrame:
    """Pieces with their edits as the rows that remain."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("repaired", _LINES)])

    def write(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                lines = [{"role": r, "text": t} for r, t in rewrite(row["roles"], row["texts"], row["edits"], row["state"])]
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("conv_id", "part", "seq")}, "repaired": lines}], schema)

    return pieces.select("conv_id", "part", "seq", "roles", "texts", "edits", "state").mapInArrow(
        write, "conv_id long, part long, seq long, repaired array<struct<role: string, text: string>>")


class Repair:
    """A table of conversations, repaired.

    ``rows`` holds conv_id, turn, role and text, and perhaps ``present``: rows that are not present only name their
    conversation. ``summary`` has one row a conversation. ``lines`` has the repaired rows in the order of part, seq and pos;
    for them the texts must be kept (``keep``), else those of conversations solved within a task are hashed and let go.
    """

    def __init__(self, rows: DataFrame, piece: int = PIECE, keep: bool = False):
        self.spark = rows.sparkSession
        ship_package(self.spark)
        present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
        space = F.lit(" ")
        # rows that are alike in everything are told apart by where they stand, so that ranges can split them
        plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                            present.alias("present"), F.monotonically_increasing_id().alias("_row"))
        keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_tie"), F.col("_row")]
        tied = plain.withColumn("_tie", F.md5(F.concat("role", F.lit(":"), "text")))
        ordered = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_row")
        self._solved = store(_map(ordered, lambda r: _stream(r, TaskContext.get().partitionId(), piece, keep), _PIECES))
        self._keep = keep
        self._pieces = self._solved.where("part IS NOT NULL")
        self._edits = None

    def _chosen(self) -> DataFrame:
        if self._edits is None:
            each = self._pieces.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row"))
            named = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("row.roles").cast("string"), F.lit(":"),
                                   "row.roles", "row.texts"))
            each = each.select(named.alias("name"), F.struct("part", "seq", "pos").alias("at"))
            first = each.groupBy("name").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "first")
            # at most PIECE places a piece
            doubles = each.join(first, "name").where("at > first").groupBy("at.part", "at.seq").agg(F.collect_list("at.pos").alias("doubles"))
            marked = self._pieces.select("conv_id", "part", "seq", "turns", "roles", "texts").join(doubles, ["part", "seq"], "left")
            tables = store(_map(marked, lambda r: map(_table, r), _TABLES))
            in_order = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
            self._edits = store(_map(in_order, _combine, _CHOSEN))
        return self._edits

    def lines(self) -> DataFrame:
        if not self._keep:
            raise ValueError("the texts were not kept")
        return self._rewritten().select("conv_id", "part", "seq", F.posexplode("repaired").alias("pos", "row")).select("conv_id", "part", "seq", "pos", "row.*")

    def _rewritten(self) -> DataFrame:
        return _repaired(self._pieces.select("conv_id", "part", "seq", "roles", "texts").join(self._chosen().select("part", "seq", "edits", "state"), ["part", "seq"]))

    def summary(self) -> DataFrame:
        names = _SUMMARY.names
        hashes = _map(self._rewritten().repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), _hash, _HASHES)
        whole = self._chosen().where("audit IS NOT NULL").alias("c").join(hashes.alias("h"), F.col("c.conv_id").eqNullSafe(F.col("h.conv_id")))
        pieced = whole.select("c.conv_id", *[c for c in names if c not in ("conv_id", "repaired_sha256")], "repaired_sha256")
        return self._solved.where("part IS NULL").select(*names).unionByName(pieced.select(*names))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, doubled or given to the user by the crc32 of their place; dropped ones are not ``present``."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = only(conversations, "conv_id", "turn", "role", "text").withColumns({
        "role": F.coalesce("role", space), "text": F.coalesce("text", space), "_kind": F.pmod(F.crc32(place), F.lit(20))})
    kind = F.col("_kind")
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    doubled = rows.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return doubled.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"))


_ORACLE = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS x FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS n FROM damaged),
faults AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, max(n) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
inserts(p, q, cost, audit) AS (VALUES (0,0,0,''), (1,1,0,''), (2,2,0,''), (3,3,0,''), (0,2,5,'I'), (1,2,5,'I'), (2,3,5,'I'), (3,2,5,'I'),
                                      (0,3,10,'II'), (1,3,10,'II'), (2,2,10,'II'), (3,3,10,'II')),
edits(p, initial, q, cost, audit) AS (VALUES (0,'s',1,0,'K'), (0,'u',2,0,'K'), (1,'u',2,0,'K'), (2,'a',3,0,'K'), (3,'u',2,0,'K'),
                                      (0,NULL,2,1,'R'), (1,NULL,2,1,'R'), (2,NULL,3,1,'R'), (3,NULL,2,1,'R'),
                                      (0,NULL,0,2,'D'), (1,NULL,1,2,'D'), (2,NULL,2,2,'D'), (3,NULL,3,2,'D')),
items AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM counted
  UNION ALL
  SELECT conv_id, n, q, cost, audit FROM (
    SELECT t.conv_id, f.n, e.q, t.cost + i.cost + e.cost + CASE WHEN f.fault = 'truncated' AND e.audit <> 'D' THEN 5 ELSE 0 END AS cost,
           t.audit || i.audit || e.audit AS audit
    FROM items t JOIN faults f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.n = t.n + 1
    JOIN inserts i ON i.p = t.q
    JOIN edits e ON e.p = i.q AND coalesce(e.initial, f.initial) = f.initial AND (e.audit = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
goals AS (
  SELECT c.*, t.cost + i.cost AS cost, t.audit || i.audit AS audit
  FROM counted c JOIN items t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.n = c.n_rows JOIN inserts i ON i.p = t.q AND i.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY t.cost + i.cost, t.audit || i.audit) = 1),
letters AS (SELECT conv_id, unnest(range(1, strlen(audit) + 1)) AS k, audit FROM goals),
steps AS (
  SELECT conv_id, k, audit[k] AS edit, sum((audit[k] <> 'I')::INT) OVER w AS n, sum((audit[k] <> 'D')::INT) OVER w AS m
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (
  SELECT s.conv_id, s.k, s.m, s.edit, CASE WHEN s.edit = 'I' THEN '' ELSE f.text END AS text, f.role,
         max((s.m = 1 AND s.edit = 'K' AND f.initial = 's')::INT) OVER (PARTITION BY s.conv_id) AS lead
  FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n WHERE s.edit <> 'D'),
written AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole
  FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate,
       coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(g.cost, 0)::BIGINT AS cost,
       coalesce(g.audit, '') AS audit, sha256(coalesce(w.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN goals g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query(sql=_ORACLE)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(damage(table(spark, sf_dir, "conversations"))).summary()
