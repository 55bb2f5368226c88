"""Repair of conversation structure by generalised LR parsing of the roles.

A conversation is well formed if its roles read ``(s?(ua)+)?``: nothing, or an optional system row and
pairs of user and assistant. Rows stream in order of conversation and turn through the tasks. Per row, every
live top of a graph-structured stack is followed through each action that the tables allow: keep, rerole,
delete, and inserts before it. Actions that lead to the same top merge into the one of the smallest (cost,
audit), so a row costs the same however many edits came before, and a task holds one row and a few stack tops.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import fresh
from civicpulse.llm.merkle import CRC_SQL, crc32_sql

#: Costs of a rerole, a delete, an insert, and of leaving a truncated row in place.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Roles by the letter of the grammar.
ROLES = {"s": "system", "u": "user", "a": "assistant"}

#: The rules, by number: C -> L | s L, L -> T | L T, T -> u a; an empty conversation is rule 0. Per rule the symbol and its length.
RULES = [("C", 0), ("C", 1), ("C", 2), ("L", 1), ("L", 2), ("T", 2)]

#: States of the SLR automaton and what they have read: 0 nothing, 1 L, 2 s, 3 u, 4 T, 5 L T, 6 s L, 7 u a.
SHIFT = {(0, "s"): 2, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 7, (6, "u"): 3}
REDUCE = {(0, "$"): 0, (1, "$"): 1, (6, "$"): 2, **{(s, x): r for s, r in ((4, 3), (5, 4), (7, 5)) for x in "u$"}}
GOTO = {(0, "L"): 1, (0, "T"): 4, (1, "T"): 5, (2, "L"): 6, (2, "T"): 4, (6, "T"): 5}

#: From any top, what can follow another one can follow for this much: two inserts, and a delete of a system row.
SLACK = 2 * INSERT + DELETE

#: Rows after which the audits so far are put away and only their order is kept.
SETTLE = 512

#: What is trimmed to find the last character of a text.
BLANKS = " \t\n\x0b\x0c\r"

#: The columns that a repaired conversation has.
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def shifted(stack: tuple, letter: str) -> tuple | None:
    """The stack after the reductions that ``letter`` asks for and its shift, or None.

    A stack is (state, stack below); stacks that grew from one share it. ``$`` is accepted by the empty tuple.
    """
    while True:
        state = stack[0]
        if (state, letter) in SHIFT:
            return SHIFT[state, letter], stack
        rule = REDUCE.get((state, letter))
        if rule is None:
            return None
        symbol, size = RULES[rule]
        if symbol == "C":
            return ()
        for _ in range(size):
            stack = stack[1]
        stack = GOTO[stack[0], symbol], stack


class Path:
    """A stack top: its cost, the place of its put-away audit among those of the tops, and the audit since."""

    __slots__ = ("cost", "order", "audit", "stack", "chain", "digest")

    def __init__(self, cost, order, audit, stack, chain, digest):
        self.cost, self.order, self.audit, self.stack = cost, order, audit, stack
        self.chain, self.digest = chain, digest

    def key(self) -> tuple:
        return self.cost, self.order, self.audit


class Repair:
    """The cheapest edits of one conversation, fed row by row.

    Equal tops may have different states below them; as every state that can be below a top goes on alike,
    the merge loses nothing. Equal costs never have one audit as the beginning of the other, since both
    have a letter per row and inserts cost, so comparing beginnings first is right.
    """

    def __init__(self):
        start = (0, None)
        self.tops = {0: Path(0, 0, "", start, None, sha256())}
        self.rows = 0

    def _merge(self, tops: dict, before: Path, letter: str, cost: int, symbol: str | None) -> bool:
        stack = before.stack if symbol is None else shifted(before.stack, symbol)
        if stack is None:
            return False
        found = Path(before.cost + cost, before.order, before.audit + letter, stack, before.chain, (before, symbol))
        if stack[0] in tops and tops[stack[0]].key() <= found.key():
            return False
        tops[stack[0]] = found
        return True

    def _written(self, tops: dict, role: str | None, text: str) -> None:
        """Give each new top the digest of its repaired rows: that of the top it came from, and its own row."""
        for top in tops.values():
            if isinstance(top.digest, tuple):
                top.digest = self._digest(top.digest, role, text)

    def _digest(self, link: tuple, role: str | None, text: str):
        before, symbol = link
        if symbol is None:
            return before.digest
        own = before.digest.copy()
        named = role if role is not None and role[:1] == symbol else ROLES[symbol]
        own.update(("\n" if before.stack != (0, None) else "").encode() + f"{named}:{text}".encode())
        return own

    def _inserted(self) -> None:
        """Follow inserts from every top until no top gets cheaper."""
        waiting = list(self.tops.values())
        while waiting:
            before = waiting.pop()
            if self.tops[before.stack[0]] is not before:
                continue
            for symbol in "ua":
                if self._merge(self.tops, before, "I", INSERT, symbol):
                    top = self.tops[shifted(before.stack, symbol)[0]]
                    self._written({0: top}, None, "")
                    waiting.append(top)

    def feed(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self._inserted()
        best = min(top.cost for top in self.tops.values())
        tops: dict = {}
        for before in self.tops.values():
            if before.cost > best + SLACK:
                continue
            self._merge(tops, before, "D", DELETE, None)
            if must_go:
                continue
            left = TRUNCATED if truncated else 0
            if role[:1] in ROLES:
                self._merge(tops, before, "K", left, role[:1])
            for symbol in "ua":
                if symbol != role[:1]:
                    self._merge(tops, before, "R", REROLE + left, symbol)
        self._written(tops, role, text)
        self.tops, self.rows = tops, self.rows + 1
        if self.rows % SETTLE == 0:
            ordered = sorted(tops.values(), key=lambda top: (top.order, top.audit))
            for place, top in enumerate(ordered):
                top.order, top.audit, top.chain = place, "", (top.chain, top.audit)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the repaired rows."""
        self._inserted()
        best = min((top for top in self.tops.values() if shifted(top.stack, "$") == ()), key=Path.key)
        parts, chain = [best.audit], best.chain
        while chain:
            chain, part = chain
            parts.append(part)
        return best.cost, "".join(reversed(parts)), best.digest.hexdigest()


class Conversation:
    """The faults of one conversation and its repair, fed row by row in order."""

    def __init__(self):
        self.repair, self.seen = Repair(), set()
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def feed(self, turn: int | None, role: str, text: str, ends: str) -> None:
        """``ends`` is the text's last character that isn't blank, if any."""
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        name = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        blank = not ends
        duplicate = not blank and name in self.seen
        truncated = not blank and not duplicate and ends not in ".!?"
        self.seen.add(name)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.repair.feed(role, text, blank or duplicate, truncated)

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from rows in order; ``present`` is false for a row that only names one."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["conv_id", *(field.split()[0] for field in FIELDS.split(", "))]
    out, now, name, kind = [], None, None, None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, present, turn, role, text, ends in zip(*(batch.column(c).to_pylist() for c in ("conv", "present", "turn", "role", "text", "ends"))):
            if now is None or conv != name:
                if now is not None:
                    out.append((name, *now.row()))
                now, name = Conversation(), conv
            if present:
                now.feed(turn, role, text, ends)
        if out:
            yield batch_of(out)
            out = []
    if now is not None:
        yield batch_of([(name, *now.row())])


def repair(rows: DataFrame) -> DataFrame:
    """Per ``conv_id``: faults, the cheapest edits and a digest of what they leave.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``, and may have ``present``: false for rows that
    only say that there is such a conversation. Nulls of role and text are one space; a null conv_id is a
    conversation of its own. Rows are in order of turn, nulls first, then role and text, so repeated rows
    are neighbours. A role whose first letter is none of s, u, a can't be kept, an empty one neither. A conversation
    without rows has zeros, an empty audit and the digest of the empty text. No rows give no rows.

    A conversation is read by one task, as the digest of its repaired rows in order must be, but as a
    stream: the task keeps 16 bytes a row (to know duplicates) and the edits, never the texts.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    text = F.coalesce("text", F.lit(" "))
    ends = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    named = rows.select(
        F.col("conv_id").alias("conv"), present.alias("present"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), ends.alias("ends"),
    )
    ordered = named.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(_repaired, f"conv_id {kind}, {FIELDS}")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults put in by a hash of conv_id and turn; a dropped row stays with ``present`` false.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it
    the user's.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = fresh(rows.columns, "case")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    named = rows.withColumn(case, F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20)
    return named.select(
        "conv_id", "turn", F.when(F.col(case) == 4, "user").otherwise(role).alias("role"),
        F.when(F.col(case).isin(0, 1), "").when(F.col(case) == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col(case) != 0).alias("present"),
        F.explode(F.when(F.col(case) == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


#: What a top can insert before a row, the top it gets to, and the rows this writes; more inserts never pay.
_INSERTS_SQL = """(VALUES ('0', '', '0', ''), ('0', 'I', 'u', chr(10) || 'user:'), ('0', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
      ('s', '', 's', ''), ('s', 'I', 'u', chr(10) || 'user:'), ('s', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
      ('u', '', 'u', ''), ('u', 'I', 'a', chr(10) || 'assistant:'), ('a', '', 'a', ''), ('a', 'I', 'u', chr(10) || 'user:'))"""

#: The columns of the registered query for DuckDB, over the view ``conversations``: the last letter read is the state.
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_SQL},
  chosen AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS c FROM conversations, crc),
  damaged AS (SELECT conv, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
      CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM chosen WHERE c <> 0),
  placed AS (SELECT *, role[1:1] AS x, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
  marked AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, pos > min(pos) OVER (PARTITION BY conv, role, text) AS seen,
      NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(x) OVER (PARTITION BY conv ORDER BY pos) || x AS pair FROM placed),
  faults AS MATERIALIZED (SELECT conv, pos, turn, role, text, x, pair, is_blank, NOT is_blank AND seen AS repeats, NOT is_blank AND NOT seen AND cut AS cut FROM marked),
  counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
      count(*) FILTER (repeats) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv),
  every AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, '') AS conv, conv_id FROM conversations),
  inserts(top, made, mid, rows) AS {_INSERTS_SQL},
  steps(mid, letter, after) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
  acts(mid, letter, after, act) AS (SELECT mid, letter, after, 'step' FROM steps UNION ALL SELECT mid, '', mid, 'D' FROM (SELECT DISTINCT mid FROM inserts)),
  walk(conv, pos, top, best, rows) AS (
    SELECT conv, 0, '0', '0000000000', '' FROM every
    UNION ALL
    SELECT conv, pos, after, min(best), arg_min(rows, best) FROM (
      SELECT w.conv, f.pos, a.after,
        lpad((w.best[1:10]::BIGINT + {INSERT} * length(i.made) + CASE WHEN act = 'D' THEN {DELETE}
          ELSE CASE WHEN cut THEN {TRUNCATED} ELSE 0 END + CASE WHEN letter = x THEN 0 ELSE {REROLE} END END)::VARCHAR, 10, '0')
          || w.best[11:] || i.made || CASE WHEN act = 'D' THEN 'D' WHEN letter = x THEN 'K' ELSE 'R' END AS best,
        w.rows || i.rows || CASE WHEN act = 'D' THEN '' ELSE chr(10) || CASE WHEN letter = x THEN role WHEN letter = 'u' THEN 'user' ELSE 'assistant' END
          || ':' || text END AS rows
      FROM walk w JOIN faults f ON f.conv = w.conv AND f.pos = w.pos + 1 JOIN inserts i ON i.top = w.top JOIN acts a ON a.mid = i.mid
      WHERE act = 'D' OR (NOT is_blank AND NOT repeats AND (letter = x OR letter <> 's')))
    GROUP BY conv, pos, after),
  ends AS (SELECT w.conv, lpad((w.best[1:10]::BIGINT + {INSERT} * length(i.made))::VARCHAR, 10, '0') || w.best[11:] || i.made AS best, w.rows || i.rows AS rows
    FROM walk w JOIN inserts i ON i.top = w.top LEFT JOIN counts c ON c.conv = w.conv WHERE w.pos = coalesce(c.n, 0) AND i.mid IN ('0', 'a')),
  repaired AS (SELECT conv, min(best) AS best, arg_min(rows, best) AS rows FROM ends GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best[1:10]::BIGINT AS cost, best[11:] AS audit, sha256(rows[2:]) AS repaired_sha256
FROM every JOIN repaired USING (conv) LEFT JOIN counts USING (conv)"""
