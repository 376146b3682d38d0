"""Repair of conversation structure: the cheapest edits to turns in order, and of these the least audit.

A conversation is a path of turns through four states (nothing yet, after the system turn, after a user turn, after an
assistant turn); edits are arcs: keep (K), change the role (R) and delete (D) go on to the next turn, insert (I) stays.
A cost DP from the end gives each node its cheapest way out; the arcs on cheapest ways remain. Nodes are then ranked by
the audits (letters of the edits) that start from them, of length 1, 2, 4, ...: the rank of twice the length comes from
the node's rank and that of the node its pointer leads to, and of several pointers only those to the least rank stay.
Pointers of doubled length give the path of the least audit.

Turns are sorted over the whole cluster and cut into segments of bounded size, so a conversation of any length is
worked on by many tasks. What a segment costs from each state to each state is a 4 x 4 matrix; a scan of the matrices
from a conversation's end gives each segment the cost of what follows, a scan of the pointers from its start gives the
state in which it is entered. Scans read one short row a segment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stillwave.llm.common import stash

#: Turns and characters of a segment (a longer turn is a segment of its own).
SEGMENT_TURNS, SEGMENT_CHARS = 512, 1 << 20
#: Segments that are worked on at once, as places of their padded paths.
PLACES = 1 << 19
CHANGE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40
#: States, and where a turn leads from each: nothing, system, user, assistant. -1: nowhere.
STATES = ("", "system", "user", "assistant")
_BY_INITIAL = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
_NEXT = np.array([2, 2, 3, 2])  # the role that fits after each state
_KEEP = np.array([*_BY_INITIAL.values(), (-1, -1, -1, -1)])
_CODE = {"s": 0, "u": 1, "a": 2}
_LETTERS = "DIKR"
#: Cost from each state when all turns are done.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}

_SEGMENT = "key string, part int, no long, turns array<long>, roles array<string>, texts array<string>, copies array<long>"
_PIECE = ("key string, part int, no long, low long, high long, n_turns long, first string, last string, blank long, "
          "duplicate long, truncated long, illegal long, cost long, audit string, n_kept long, repaired binary")


def damaged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turn, role, text, copies): what a hash of conversation and turn does to each row; nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = turns.select(key_of(conv).alias("key"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"),
                        blank(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "key", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def key_of(conv: str) -> Column:
    """The conversation as text that sets null apart."""
    return F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit(""))


def segments(rows: DataFrame, most_turns: int, most_chars: int) -> DataFrame:
    """Turns in order, packed by conversation into segments of bounded size, numbered by partition and place."""
    ordered = (rows.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
               .sort("key", "turn", "role", "text"))

    def run(batches):
        part, no, own, chars = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            key, turns, roles, texts, copies = zip(*own)
            return {"key": key[0], "part": part, "no": no, "turns": turns, "roles": roles, "texts": texts, "copies": copies}

        for batch in batches:
            done = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if own and (own[0][0] != row[0] or len(own) >= most_turns or chars + len(row[3]) > most_chars):
                    done.append(packed())
                    no, own, chars = no + 1, [], 0
                own.append(row)
                chars += len(row[3])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow(_SEGMENT))
        if own:
            yield pa.RecordBatch.from_pylist([packed()], schema=_arrow(_SEGMENT))

    return ordered.mapInArrow(run, _SEGMENT)


def faults(roles: list, texts: list, seen: set) -> tuple[list, list]:
    """For each turn whether it must go (1 blank, 2 duplicate, else 0), and whether it breaks off."""
    gone, broken = [], []
    for role, text in zip(roles, texts):
        end = text.rstrip(" \t\n\x0b\x0c\r")
        mark = digest(role, text)
        gone.append(1 if not end else 2 if mark in seen else 0)
        broken.append(not gone[-1] and end[-1] not in ".!?")
        seen.add(mark)
    return gone, broken


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(role.encode() + b"\0" + hashlib.blake2b(text.encode(), digest_size=32).digest(), digest_size=16).digest()


class Network:
    """Nodes (turn, state) of several segments, ``at[g] + 4 i + state``; each has a last layer where it is left."""

    def __init__(self, groups: list[tuple[list, list, list]]):
        """Of each segment the roles, which turns must go and which break off."""
        self.sizes = np.array([len(roles) for roles, _, _ in groups])
        self.rows = np.cumsum(self.sizes + 1) - self.sizes - 1  # first layer of each segment
        total = int((self.sizes + 1).sum())
        self.code, self.gone, self.broken = np.full(total, 3), np.ones(total, bool), np.zeros(total, np.int64)
        self.last = np.zeros(total, bool)
        self.last[self.rows + self.sizes] = True
        inner = ~self.last
        self.code[inner] = [_CODE.get(role[:1], 3) for roles, _, _ in groups for role in roles]
        self.gone[inner] = np.concatenate([gone for _, gone, _ in groups]) > 0
        self.broken[inner] = np.concatenate([broken for _, _, broken in groups])

    def costs(self, end: np.ndarray) -> np.ndarray:
        """Cheapest cost from each layer and state, given those of the last layers (segment, state, ...)."""
        cost = np.full((len(self.last), *end.shape[1:]), FAR, np.int64)
        cost[self.rows + self.sizes] = end
        order = np.argsort(-self.sizes, kind="stable")
        sizes, lasts = self.sizes[order], (self.rows + self.sizes)[order]
        for back in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            at = lasts[:np.searchsorted(-sizes, -back, side="right")] - back
            after = cost[at + 1]
            here = after + DELETE
            fine, extra = ~self.gone[at], self.broken[at].reshape(-1, *[1] * (end.ndim - 2))
            keep = _KEEP[self.code[at]]
            for state in range(4):
                change = after[:, _NEXT[state]] + CHANGE + extra
                kept = np.take_along_axis(after, np.maximum(keep[:, state], 0).reshape(-1, *[1] * (end.ndim - 1)), axis=1)[:, 0]
                kept = np.where((keep[:, state] >= 0).reshape(extra.shape), kept + extra, FAR)
                here[:, state] = np.where(fine.reshape(extra.shape), np.minimum(np.minimum(change, kept), here[:, state]),
                                          here[:, state])
            user, assistant = here[:, 2].copy(), here[:, 3].copy()
            here[:, 2], here[:, 3] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
            for state in (0, 1):
                here[:, state] = np.minimum(here[:, state], here[:, 2] + INSERT)
            cost[at] = here
        return cost

    def arcs(self, cost: np.ndarray, closing: np.ndarray):
        """(node, letter, target) of all arcs on cheapest ways; a ``closing`` segment may insert in its last layer."""
        total, flat = len(self.last), cost.reshape(-1)
        layer, state = np.repeat(np.arange(total), 4), np.tile(np.arange(4), total)
        inner = ~self.last[layer]
        may_insert = inner.copy()
        may_insert.reshape(-1, 4)[(self.rows + self.sizes)[closing]] = True
        keep, extra = _KEEP[self.code[layer], state], self.broken[layer]
        free = inner & ~self.gone[layer]
        found = []
        for letter, (allowed, target, price) in enumerate((
                (inner, layer * 4 + 4 + state, DELETE), (may_insert, layer * 4 + _NEXT[state], INSERT),
                (free & (keep >= 0), layer * 4 + 4 + keep, extra), (free, layer * 4 + 4 + _NEXT[state], CHANGE + extra))):
            target = np.clip(target, 0, len(flat) - 1)
            on = np.flatnonzero(allowed & (flat < FAR // 2) & (flat[target] + price == flat))
            found.append((on, np.full(len(on), letter), target[on]))
        return [np.concatenate(x) for x in zip(*found)]


def ranked_pointers(n_nodes: int, node: np.ndarray, letter: np.ndarray, target: np.ndarray, most: int):
    """Pointers of length 1, 2, 4, ... up to ``most`` along the least audits, as arrays by node, and the nodes' letters.

    Nodes without arcs point to themselves and come first, as a string that has ended.
    """
    ended = np.setdiff1d(np.arange(n_nodes), node)
    node, target = np.append(node, ended), np.append(target, ended)
    key = np.append(letter + 1, np.zeros(len(ended), np.int64))
    pointers, rank, own = [], None, None
    length = 1
    while True:
        # Of a node's pointers those to the least continuation stay; a node's rank orders it by what they spell.
        order = np.lexsort((target, key, node))
        node, key, target = node[order], key[order], target[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        least = np.repeat(key[first], np.diff(np.append(first, len(node))))
        node, target = node[key == least], target[key == least]
        low = key[first]
        if rank is None:
            own = low - 1
            rank = np.unique(low, return_inverse=True)[1]
        else:
            rank = np.unique(np.stack([rank, low], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        start = np.searchsorted(node, np.arange(n_nodes))
        pointers.append(target[start])
        if length >= most:
            return pointers, own, rank
        length *= 2
        # Doubled: each pointer goes on with all pointers of the node it leads to.
        count = np.diff(np.append(start, len(node)))
        many = count[target]
        place = np.repeat(start[target], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = np.repeat(rank[target], many)
        node, target = np.repeat(node, many), target[place]


def least_paths(net: Network, cost: np.ndarray, closing: np.ndarray, entry: np.ndarray):
    """Nodes (segment, place) on the path of the least audit from the entry states, and the letter at each (-1: ended)."""
    node, letter, target = net.arcs(cost, closing)
    most = 3 * int(net.sizes.max()) + 4
    pointers, own, _ = ranked_pointers(4 * len(net.last), node, letter, target, most)
    path = (4 * net.rows + entry)[:, None]
    for pointer in pointers:
        path = np.concatenate([path, pointer[path]], axis=1)
    return path, own[path]


def in_groups(batch: pa.RecordBatch):
    """Lists of segments (as dicts) of similar size, few enough to be worked on at once."""
    rows = sorted(batch.to_pylist(), key=lambda row: len(row["roles"]))
    held = []
    for row in rows:
        if held and (len(held) + 1) * 4 * (3 * len(row["roles"]) + 4) > PLACES:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def network(group: list[dict]) -> Network:
    for row in group:
        if row.get("gone") is None:
            row["gone"], row["broken"] = faults(row["roles"], row["texts"], set(row.get("seen") or ()))
    return Network([(row["roles"], row["gone"], row["broken"]) for row in group])


def piece(row: dict, base: int, path, letters) -> tuple:
    """What a segment gives for its conversation's row: counts, its part of the audit, its repaired turns."""
    roles, texts, copies, gone, broken = (row[c] for c in ("roles", "texts", "copies", "gone", "broken"))
    turns = [t for t in row["turns"] if t is not None]
    initials = [role[:1] for role in roles]
    blank = sum(n for n, g in zip(copies, gone) if g == 1)
    duplicate = sum(n if g == 2 else n - 1 for n, g in zip(copies, gone) if g != 1)
    illegal = sum(copies) - len(copies) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    audit, kept, cost = [], [], 0
    for at, letter in zip(path, letters):
        if letter < 0:
            break
        turn, state = divmod(at - base, 4)
        audit.append(_LETTERS[letter])
        role = STATES[_NEXT[state]]
        if letter == 1:
            kept.append(f"{role}:")
            cost += INSERT
            continue
        if letter == 0:
            cost += DELETE
        else:
            kept.append(f"{roles[turn] if letter == 2 else role}:{texts[turn]}")
            cost += CHANGE * (letter == 3) + TRUNCATED * broken[turn]
        audit.append("D" * (copies[turn] - 1))
        cost += DELETE * (copies[turn] - 1)
    return (row["key"], row["part"], row["no"], min(turns, default=None), max(turns, default=None), len(set(turns)),
            initials[0], initials[-1], blank, duplicate, sum(broken), illegal, cost, "".join(audit), len(kept),
            "\n".join(kept).encode())


def _pieces(batches, names):
    for batch in batches:
        for group in in_groups(batch):
            net = network(group)
            end = np.array([row.get("togo") or END for row in group], np.int64)
            closing = np.array([row.get("closing", True) for row in group], bool)
            entry = np.array([row.get("entry", 0) for row in group])
            path, letters = least_paths(net, net.costs(end), closing, entry)
            rows = [piece(row, 4 * int(net.rows[g]), path[g].tolist(), letters[g].tolist()) for g, row in enumerate(group)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(_PIECE))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds |= {f"array<{name}>": pa.list_(kind) for name, kind in kinds.items()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def pieces(of: DataFrame) -> DataFrame:
    """The parts that segments give for their conversations' rows."""
    names = [c.split(" ")[0] for c in _PIECE.split(", ")]
    return of.mapInArrow(lambda batches: _pieces(batches, names), _PIECE)


def _scan(of: DataFrame, forward: bool, step, schema: str) -> DataFrame:
    """Rows of one short row a segment, in the order of each conversation, through ``step(key, row, before)``."""
    order = ["key", *(F.col(c) if forward else F.desc(c) for c in ("part", "no"))]

    def run(batches):
        key, before = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, before = row["key"], None
                made, before = step(row, before)
                out.append({"key": key, "part": row["part"], "no": row["no"], **made})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return of.repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema)


def _over_segments(segs: DataFrame) -> DataFrame:
    """Pieces of conversations of several segments."""
    ids = ["key", "part", "no"]

    # Which turns were seen in an earlier segment: one row for each different turn of a segment.
    def marks(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ids),
                 pa.array([list({digest(a, b) for a, b in zip(r["roles"], r["texts"])}) for r in rows], pa.list_(pa.binary()))],
                names=[*ids, "marks"])

    each = stash(segs.mapInArrow(marks, "key string, part int, no long, marks array<binary>")
                 .select(*ids, F.explode("marks").alias("mark")))
    first = each.groupBy("key", "mark").agg(F.min(F.struct("part", "no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = (each.join(first, ["key", "mark"]).where(F.struct("part", "no") != F.col("first"))
             .groupBy(*ids).agg(F.collect_list("mark").alias("seen")))
    known = segs.join(later, ids, "left")

    known_ddl = f"{_SEGMENT}, gone array<int>, broken array<boolean>, matrix array<long>"

    def judge(batches):
        for batch in batches:
            for group in in_groups(batch):
                net = network(group)
                end = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(group), axis=0)
                for row, matrix in zip(group, net.costs(end)[net.rows].reshape(-1, 16).tolist()):
                    row["matrix"] = matrix
                yield pa.RecordBatch.from_pylist(group, schema=_arrow(known_ddl))

    judged = stash(known.mapInArrow(judge, known_ddl))

    # From the end: what follows a segment costs so much from each state in which it may be left.
    def back(row, before):
        matrix = np.array(row["matrix"]).reshape(4, 4)
        own = END if before is None else before
        togo = (matrix + np.array(own)).min(axis=1).tolist()
        return {"togo": list(own), "closing": before is None}, togo

    togo = _scan(judged.select(*ids, "matrix"), False, back, "key string, part int, no long, togo array<long>, closing boolean")
    priced = stash(judged.drop("matrix").join(togo, ids))

    exit_ddl = "key string, part int, no long, exits array<long>"

    # From the start: in which state a segment is left, for each in which it may be entered.
    def leave(batches):
        for batch in batches:
            for group in in_groups(batch):
                net = network(group)
                cost = net.costs(np.array([row["togo"] for row in group], np.int64))
                closing = np.array([row["closing"] for row in group])
                exits = []
                for state in range(4):
                    path, _ = least_paths(net, cost, closing, np.full(len(group), state))
                    exits.append(path[:, -1] % 4)
                out = [{**{c: row[c] for c in ids}, "exits": own} for row, own in zip(group, np.stack(exits, axis=1).tolist())]
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(exit_ddl))

    exits = priced.mapInArrow(leave, exit_ddl)

    def enter(row, before):
        state = before or 0
        return {"entry": state}, row["exits"][state]

    entry = _scan(exits, True, enter, "key string, part int, no long, entry long")
    return pieces(priced.join(entry, ids))


def _join_pieces(batches):
    """Rows of conversations from their pieces in order; texts are hashed as they come."""
    key, total = None, None

    def row():
        _, low, high, n_turns, _, blank, duplicate, truncated, illegal, cost, audit, sha, _, _ = total
        return {"key": key, "gaps": 0 if low is None else high - low + 1 - n_turns, "blank": blank, "duplicate": duplicate,
                "truncated": truncated, "illegal": illegal, "cost": cost, "audit": "".join(audit),
                "repaired_sha256": sha.hexdigest()}

    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if p["key"] != key or total is None:
                if total is not None:
                    out.append(row())
                key = p["key"]
                total = [None, None, None, 0, None, 0, 0, 0, 0, 0, [], hashlib.sha256(), 0, None]
            if p["low"] is not None:
                total[1] = p["low"] if total[1] is None else total[1]
                total[3] += p["n_turns"] - (total[2] == p["low"])
                total[2] = p["high"]
            if total[4] is not None and total[4] + p["first"] not in LEGAL:
                total[8] += 1
            total[4] = p["last"]
            for i, c in ((5, "blank"), (6, "duplicate"), (7, "truncated"), (8, "illegal"), (9, "cost")):
                total[i] += p[c]
            total[10].append(p["audit"])
            if p["n_kept"]:
                total[11].update((b"\n" if total[12] else b"") + p["repaired"])
                total[12] += p["n_kept"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(_ROW))
    if total is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=_arrow(_ROW))


_ROW = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")


def repair(rows: DataFrame, most_turns: int = SEGMENT_TURNS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """A row for each conversation ``key`` of ``rows`` (key, turn, role, text, copies): counts, cost, audit, digest."""
    segs = stash(segments(rows, most_turns, most_chars))
    several = stash(segs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    short = pieces(segs.join(several, "key", "left_anti"))
    long = _over_segments(segs.join(several, "key", "left_semi"))
    return short.mapInArrow(_join_pieces, _ROW).union(
        long.repartition("key").sortWithinPartitions("key", "part", "no").mapInArrow(_join_pieces, _ROW))


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """Damage ``turns`` by a hash of conversation and turn, repair them, and give one row for each conversation.

    Columns: conversation, ``gaps`` in the turn numbers, ``blank``, ``duplicate`` and ``truncated`` turns (each by its
    first fault), ``illegal`` neighbours by role initials, the least ``cost``, the least ``audit`` and the SHA-256 of
    the repaired ``role:text`` lines. Turns go by number (nulls first), then role and text; rows that are equal in all
    of these are copies that follow each other. Null role, text and key parts are one blank, rows without a
    conversation are a conversation of their own. A conversation that lost all its rows has zeros, an empty audit and
    the digest of nothing. An empty table gives an empty one; other columns are not looked at.
    """
    kind = turns.schema[conv].dataType
    zero = F.lit(0).cast("long")
    named = turns.select(key_of(conv).alias("key")).distinct()
    found = named.join(repair(damaged(turns, conv, turn, role, text)), "key", "left")
    return found.select(
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(conv),
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
