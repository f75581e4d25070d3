"""Repair of conversations whose turns are missing, empty, doubled, cut short or out of turn.

Turns are sorted by ranges of (conversation, turn), so a conversation of any length is spread over tasks, and cut into parts of
bounded size. A conversation inside one part is repaired there. Those of several parts exchange only digests (to find turns seen
in an earlier part) and per part 16 costs and the order of its audits; the parts are then repaired on their own. Costs and
audits come from the matrices of ``turn_grammar``, whose rules are learnt from the distinct sequences of all conversations.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K
from stayloom.llm import turn_grammar as G
from stayloom.session import cut_lineage

PART_TURNS = 4096
PART_BYTES = 1 << 20
ROUNDS = 6
PAIRS = 48
REMEMBERED = 20_000
SPACE = "\t\n\v\f\r "
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
PART = ("conv_id bigint, part int, seq int, open boolean, symbols binary, first_turn bigint, last_turn bigint, turns bigint, blank bigint, "
        "duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, roles array<string>, texts array<string>")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
WAY = ("part int, seq int, state int, leave int, inserts int, head boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
       "illegal bigint, cost bigint")
DONE = ("conv_id bigint, part int, seq int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, turns array<struct<edit:string,role:string,text:string>>")
DIGEST = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The turns of ``conversations`` after damage by crc32 of ``conv_id:turn`` modulo 20; a NULL counts as one space.

    0 drops the turn (it stays as a row with ``present`` false, so that its conversation is not lost), 1 empties its text, 2
    removes its ``.``, ``!`` and ``?``, 3 doubles it, 4 gives it to the user.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


class _Part:
    """The turns of one conversation gathered so far."""

    def __init__(self, conv_id: int | None, open_: bool):
        self.conv_id, self.open = conv_id, open_
        self.roles, self.texts, self.symbols, self.size = [], [], bytearray(), 0
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen = set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        visible = text.rstrip(SPACE)
        blank = not visible
        again = not blank and (role, text) in self.seen
        cut = not blank and not again and visible[-1] not in ".!?"
        if not blank:
            self.seen.add((role, text))
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        self.illegal += bool(self.roles) and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        self.symbols.append(G.symbol(role[:1], blank or again, cut))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)


def _turn_order(messages: DataFrame) -> DataFrame:
    """Messages dealt and sorted by conversation and turn; ties by role, text start and hash, and equal rows may part."""
    present = F.col("present") if "present" in messages.columns else F.lit(True)
    rows = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], present.alias("present"))
    rows = rows.withColumns({"tie": F.substring("text", 1, 64), "hash": F.xxhash64("role", "text"), "place": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "hash", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "present")


def _parts(messages: DataFrame, part_turns: int, part_bytes: int) -> DataFrame:
    def work(batches):
        task, seq, held, out = TaskContext.get().partitionId(), 0, None, []

        def close(part: _Part) -> None:
            nonlocal seq
            out.append({"conv_id": part.conv_id, "part": task, "seq": seq, "open": part.open, "symbols": bytes(part.symbols),
                        "first_turn": part.first, "last_turn": part.last, **{c: getattr(part, c) for c in ("turns", *COUNTS)},
                        "first_role": part.roles[0][:1] if part.roles else None, "last_role": part.roles[-1][:1] if part.roles else None,
                        "roles": part.roles, "texts": part.texts})
            seq += 1

        for batch in batches:
            for conv_id, turn, role, text, present in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None:
                    held = _Part(conv_id, True)  # the conversation may have begun in the task before
                elif held.conv_id != conv_id:
                    close(held)
                    held = _Part(conv_id, False)
                elif present and held.roles and (len(held.roles) >= part_turns or held.size + len(text) > part_bytes):
                    held.open = True
                    close(held)
                    held = _Part(conv_id, True)
                if present:
                    held.add(turn, role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held is not None:
            held.open = True
            close(held)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = _arrow(PART)
    return K.map_arrow(_turn_order(messages), work, PART)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
             "array<struct<edit:string,role:string,text:string>>": pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _later_copies(parts: DataFrame) -> DataFrame:
    """(part, seq, later): places of turns of open parts whose role and text are in an earlier part of the conversation."""
    def work(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                seen = set()
                for at, (role, text) in enumerate(zip(r["roles"], r["texts"])):
                    if (role, text) not in seen and VISIBLE.search(text):
                        seen.add((role, text))
                        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                        rows.append({"conv_id": r["conv_id"], "key": key, "part": r["part"], "seq": r["seq"], "at": at})
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow("conv_id bigint, key binary, part int, seq int, at int"))

    keys = K.map_arrow(parts, work, "conv_id bigint, key binary, part int, seq int, at int")
    place = F.struct("part", "seq", "at")
    first = keys.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    on = keys.conv_id.eqNullSafe(first.conv_id) & (keys.key == first.key)
    later = keys.join(first, on).where(F.struct("part", "seq", "at") > F.col("first"))
    return later.groupBy("part", "seq").agg(F.sort_array(F.collect_list("at")).alias("later"))


def _without_copies(parts: DataFrame) -> DataFrame:
    """Open parts with the turns marked that an earlier part has too."""
    def work(batches):
        schema = _arrow(PART)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                symbols = bytearray(r["symbols"])
                for at in r.pop("later") or []:
                    r["truncated"] -= 4 <= symbols[at] < G.GONE
                    r["duplicate"] += 1
                    symbols[at] = G.GONE
                r["symbols"] = bytes(symbols)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = [f.name for f in parts.schema.fields]
    return K.map_arrow(parts.join(_later_copies(parts), ["part", "seq"], "left").select(*names, "later"), work, PART)


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> G.Grammar:
    """Re-Pair over the distinct values of ``symbols`` (one counting job per round): up to ``pairs`` rules a round.

    Rules are made while a pair comes twice. Their number is bounded, so the grammar can go to every task; sequences of
    any length are evaluated over the symbols it leaves.
    """
    distinct = cut_lineage(sequences.select("symbols").distinct(), "sequences")
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        known = list(rules)

        def work(batches, known=known):
            for batch in batches:
                codes = G.replace(G.joined([s for s in batch.column("symbols").to_pylist()]), known)
                pair, n = G.pair_counts(codes)
                yield pa.RecordBatch.from_pydict({"pair": pair, "n": n})

        counted = K.map_arrow(distinct, work, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        found = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(pairs).collect()
        if not found:
            break
        rules += [(r["pair"] >> 16, r["pair"] & 65535) for r in found]
    return G.Grammar(rules)


def _ways(parts: DataFrame, grammar: G.Grammar) -> DataFrame:
    """Per open part the states it is entered and left in, and with the first part the sums of the conversation."""
    described = ("conv_id bigint, part int, seq int, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, "
                 "truncated bigint, illegal bigint, first_role string, last_role string, costs array<bigint>, heads array<string>, ranks array<int>")
    names = [field.split(" ")[0] for field in described.split(", ")]

    def describe(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r, sequence in zip(rows, grammar.sequences([r.pop("symbols") for r in rows])):
                r["costs"], r["heads"], r["ranks"] = G.describe(grammar.part(sequence))
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(described))

    def solve(rows: list[dict]) -> list[dict]:
        cost, inserts, way = G.best_way([(r["costs"], r["heads"], r["ranks"]) for r in rows])
        turned = [r for r in rows if r["first_turn"] is not None]
        distinct = sum(r["turns"] for r in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
        gaps = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0
        spoken = [r for r in rows if r["first_role"] is not None]
        between = sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(spoken, spoken[1:]))
        sums = {c: sum(r[c] for r in rows) for c in COUNTS}
        whole = {"gaps": gaps, **sums, "illegal": sums["illegal"] + between, "cost": cost}
        return [{"part": r["part"], "seq": r["seq"], "state": p, "leave": q, "inserts": inserts if i == 0 else 0, "head": i == 0,
                 **(whole if i == 0 else dict.fromkeys(whole))} for i, (r, (p, q)) in enumerate(zip(rows, way))]

    def follow(batches):
        held: list[dict] = []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held and held[-1]["conv_id"] != r["conv_id"]:
                    done += solve(held)
                    held = []
                held.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow(WAY))
        if held:
            yield pa.RecordBatch.from_pylist(solve(held), schema=_arrow(WAY))

    light = K.map_arrow(parts.select(*names[:-3], "symbols"), describe, described)
    return K.map_arrow(light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), follow, WAY)


def _finish_closed(parts: DataFrame, grammar: G.Grammar) -> DataFrame:
    def work(batches):
        solved: dict[bytes, tuple[int, str]] = {}
        for batch in batches:
            rows = batch.to_pylist()
            fresh = sorted({r["symbols"] for r in rows} - solved.keys())
            if len(solved) > REMEMBERED:
                solved.clear()
                fresh = sorted({r["symbols"] for r in rows})
            solved.update(zip(fresh, map(grammar.whole, grammar.sequences(fresh))))
            out = []
            for r in rows:
                cost, audit = solved[r["symbols"]]
                gaps = 0 if r["first_turn"] is None else r["last_turn"] - r["first_turn"] + 1 - r["turns"]
                out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "gaps": gaps, **{c: r[c] for c in COUNTS}, "cost": cost, "audit": audit,
                            "turns": [{"edit": e, "role": a, "text": t} for e, a, t in G.repaired(audit, r["roles"], r["texts"])]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(DONE))

    return K.map_arrow(parts, work, DONE)


def _finish_open(parts: DataFrame, ways: DataFrame, grammar: G.Grammar) -> DataFrame:
    def work(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r, sequence in zip(rows, grammar.sequences([r["symbols"] for r in rows])):
                way = r["way"]
                entry = grammar.part(sequence)[way["state"]][way["leave"]]
                audit = "I" * way["inserts"] + str(entry[1])
                state = G.START if way["inserts"] else way["state"]
                out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "gaps": way["gaps"], **{c: way[c] for c in COUNTS},
                            "cost": way["cost"], "audit": audit,
                            "turns": [{"edit": e, "role": a, "text": t} for e, a, t in G.repaired(audit, r["roles"], r["texts"], state)]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(DONE))

    way = F.struct(*[F.col(c) for c in ways.columns if c not in ("part", "seq")]).alias("way")
    joined = parts.join(ways.select("part", "seq", way), ["part", "seq"]).select("conv_id", "part", "seq", "symbols", "roles", "texts", "way")
    return K.map_arrow(joined, work, DONE)


@dataclass
class Repair:
    """``closed``: one row per conversation of one part. ``spread``: one row per part of the others, ordered by part and seq.

    Both have conv_id, audit and ``turns`` (edit, role and text of every turn left or inserted); the counts and the cost of
    a conversation are in its row, or in the first row of its parts and NULL in the rest.
    """

    closed: DataFrame
    spread: DataFrame

    def messages(self) -> DataFrame:
        """conv_id, part, seq, place, edit, role, text of the repaired turns; part, seq and place give their order."""
        parts = self.closed.unionByName(self.spread).select("conv_id", "part", "seq", F.posexplode("turns").alias("place", "turn"))
        return parts.select("conv_id", "part", "seq", "place", "turn.*")

    def conversations(self) -> DataFrame:
        """One row per conversation: gaps, faults, cost, audit and the digest of its repaired ``role:text`` lines.

        The lines of a spread conversation are hashed as they come, part by part, so no task holds more than one part of it.
        """
        line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        names = ["conv_id", "gaps", *COUNTS, "cost", "audit"]
        closed = self.closed.select(*names, F.sha2(line, 256).alias("repaired_sha256"))

        def follow(batches):
            schema, held, digest, empty, audits = _arrow(DIGEST), None, None, True, []

            def close():
                return {**held, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

            for batch in batches:
                done = []
                for r in batch.to_pylist():
                    lines, some = r.pop("lines"), r.pop("some")
                    for c in ("part", "seq"):
                        r.pop(c)
                    if r["cost"] is not None:
                        if held is not None:
                            done.append(close())
                        held, digest, empty, audits = r, hashlib.sha256(), True, []
                    audits.append(r["audit"])
                    if some:
                        digest.update((b"" if empty else b"\n") + lines.encode())
                        empty = False
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
            if held is not None:
                yield pa.RecordBatch.from_pylist([close()], schema=schema)

        lined = self.spread.select(*names, "part", "seq", line.alias("lines"), (F.size("turns") > 0).alias("some"))
        streamed = lined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
        return closed.unionByName(K.map_arrow(streamed, follow, DIGEST))


def repair_conversations(messages: DataFrame, *, part_turns: int = PART_TURNS, part_bytes: int = PART_BYTES, rounds: int = ROUNDS,
                         pairs: int = PAIRS) -> Repair:
    """The cheapest edits of every conversation after which the initials of its roles read ``(s?(ua)+)?``.

    Keeping a turn costs 0, giving it to the user or assistant 1, deleting it 2, inserting an empty one 5; a truncated turn
    that stays costs 5 more. Blank turns and turns whose role and text came before must go. Of edits with one cost the audit
    (initials K, R, D, I in order) that is least in ASCII is taken. Turns are in order of ``turn`` (NULL first), then of
    role, the first 64 characters of the text and a hash of both. NULL roles and texts count as one space, a NULL conv_id is a
    conversation of its own. Rows with ``present`` false (where the column exists) only name their conversation, so one
    without turns has zeros and an empty audit. Other columns are ignored, whatever their names. Runs jobs.
    """
    parts = cut_lineage(_parts(messages, part_turns, part_bytes), "parts")
    closed, opened = parts.where("not open"), cut_lineage(_without_copies(parts.where("open")), "open")
    grammar = learn_grammar(closed.select("symbols").unionByName(opened.select("symbols")), rounds, pairs)
    return Repair(_finish_closed(closed, grammar), _finish_open(opened, _ways(opened, grammar), grammar))


# DuckDB SQL for ``repair_conversations(damage(table)).conversations()``: a plain walk over the four states, turn by turn.
SQL = r"""
with recursive step(p, letter, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, q, added) as (values (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')),
raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(
      list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::ubigint),
      lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::ubigint[],
        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end, xor(c, b)), 4294967295::ubigint), 4294967295::ubigint) % 20 as kind
  from conversations),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from raw, unnest(case when kind = 3 then [1, 2] when kind = 0 then [] else [1] end) as copies(c)),
turns as materialized (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, left(text, 64), text) as n from damaged),
judged as materialized (
  select *, left(role, 1) as initial, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    row_number() over (partition by conv_id, role, text order by n) > 1 as again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as cut,
    lag(left(role, 1)) over (partition by conv_id order by n) as before
  from turns),
action as materialized (
  select conv_id, n, p, p as q, 2 as cost, 'D' as edit, []::varchar[] as line from judged, (select unnest([0, 1, 2, 3]) as p)
  union all
  select conv_id, n, p, q, case when cut then 5 else 0 end, 'K', [role || ':' || text] from judged join step on letter = initial where not blank and not again
  union all
  select conv_id, n, p, q, case when cut then 6 else 1 end, 'R', [case letter when 'u' then 'user:' else 'assistant:' end || text]
  from judged, step where letter <> 's' and not blank and not again),
move as materialized (
  select conv_id, n, a.p, i.q, cost + 5 * length(added) as cost, edit || added as edit,
    line || case when added = '' then []::varchar[] when added = 'II' then ['user:', 'assistant:'] when i.q = 2 then ['user:'] else ['assistant:'] end as line
  from action a join ins i on i.p = a.q),
walk as (
  select conv_id, 0::bigint as n, q, {'cost': 5 * length(added), 'audit': added, 'lines': case added when '' then []::varchar[] when 'I' then ['user:'] else ['user:', 'assistant:'] end} as best
  from (select distinct conv_id from judged), ins where p = 0
  union all
  select w.conv_id, m.n, m.q, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edit, 'lines': w.best.lines || m.line})
  from walk w join move m on m.conv_id is not distinct from w.conv_id and m.n = w.n + 1 and m.p = w.q group by w.conv_id, m.n, m.q),
facts as (
  select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (not blank and again) as duplicate, count(*) filter (not blank and not again and cut) as truncated,
    count(*) filter (n > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id),
solved as (
  select f.conv_id, min(w.best) as best from facts f join walk w on w.conv_id is not distinct from f.conv_id and w.n = f.n where w.q in (0, 3) group by f.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join facts f on f.conv_id is not distinct from c.conv_id left join solved s on s.conv_id is not distinct from c.conv_id
"""
