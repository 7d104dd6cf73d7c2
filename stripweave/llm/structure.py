"""Conversation structure repair (11): cheapest edits over a suffix-shared automaton.

A conversation's role initials must read ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (2), Delete (3), Insert an empty
user or assistant turn (2); a truncated turn that stays adds 1, blank and duplicate turns must go. The cheapest edits win, among
equals the ASCII-least string of initials.

* **Signatures**: each row becomes one symbol (role initial, truncated or not; forced deletions as a counted run), each run of at most
  two to the ``RUN_BITS`` rows of a conversation one string. All this works on rows without texts.
* **Automaton**: equal signatures are solved once. Sorted from the end they meet in one task as neighbours, and a node stands
  for a suffix: (symbol, next node) is looked up, so what signatures have in common at the end is one path. Each node holds, once for every
  grammar state, the cost to go, the best next edit and the state after it; following these gives the best audit suffix.
* **Long conversations**: a run in the middle is solved for the costs that follow it. These come from the runs' (least sum) matrices of entry
  and exit states, which the same automaton gives, walked from the last run to the first with four numbers in hand.
* **Edits**: rows and solved runs stream by conversation, in order; ``edits`` gives one row per edit and holds one row at a time.

Rows go by turn (null first), then role, then MD5 of the text. Null role and text count as one space, null turns as a turn of their own, null
conv_ids as one conversation. Any role is allowed, by its initial; other columns are left out; an empty table gives no rows. A conversation's edits
come out of one task, since their order (and the report's digest) is the conversation's; a report row holds one letter per edit.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripweave.functions.ordered import join_on

from .common import saved

#: At most two to this many rows of one conversation make a signature.
RUN_BITS = 12
BLANKS = " \t\n\x0b\x0c\r"
_KEPT = 200_000
_FAR = 1 << 60
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = (USER, USER, ASSISTANT, USER)  # the turn that may be made in each state
_TOKEN = re.compile(r"x(\d+)|([suaoSUAO])")
KEY = ["conv_id", "turn", "role", "mark"]
_EDITS = "conv_id bigint, turn bigint, role string, fault string, edit string, new_role string, text string, cost bigint"


class Automaton:
    """Suffixes of signatures as nodes (costs, edits, states after), one per (symbol, next node)."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.known: dict = {}

    def _add(self, key, make) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(make())
        return self.known[key]

    def last(self, exits) -> int:
        """The end of a run: costs that follow by state, or the end of the conversation where they are None."""
        if exits is None:
            return self._add(None, lambda: ((0, 4, 2, 0, None), ("", "I", "I", ""), (START, USER, ASSISTANT, ASSISTANT)))
        return self._add(tuple(exits), lambda: ((*exits, None), ("",) * 4, tuple(range(4))))

    def before(self, symbol: str, run: int, then: int) -> int:
        return self._add((symbol, run, then), lambda: self._node(symbol, run, then))

    def _node(self, symbol: str, run: int, then: int):
        after = self.nodes[then][0]
        if run:
            return ((*[3 * run + after[s] for s in range(4)], then), ("D" * run if run < 64 else f"D{run}",) * 4, tuple(range(4)))
        cut, role = symbol.isupper(), symbol.lower()
        best = []
        for s in range(4):
            to = _AFTER[s]
            ways = [(3 + after[s], "D", s), (2 + cut + after[to], "R", to)]
            if role == ("a" if to == ASSISTANT else "u"):
                ways.append((cut + after[to], "K", to))
            elif s == START and role == "s":
                ways.append((cut + after[SYSTEM], "K", SYSTEM))
            best.append(min(ways))
        u, a = best[USER], best[ASSISTANT]
        best[USER], best[ASSISTANT] = min(u, (2 + a[0], "I", ASSISTANT)), min(a, (2 + u[0], "I", USER))
        for s in (START, SYSTEM):
            best[s] = min(best[s], (2 + best[USER][0], "I", USER))
        cost, edit, to = zip(*best)
        return ((*cost, then), edit, to)

    def read(self, signature: str, exits) -> int:
        """The node of a whole signature; its suffixes are shared with all signatures read before."""
        if len(self.nodes) > _KEPT:
            self.__init__()
        node = self.last(exits)
        for m in reversed(list(_TOKEN.finditer(signature))):
            node = self.before(m[2] or "x", int(m[1] or 0), node)
        return node

    def follow(self, node: int, state: int) -> tuple[str, int]:
        """Best edits from a node on and the state in which they end."""
        out = []
        while node is not None:
            cost, edit, to = self.nodes[node]
            own = edit[state]
            out.append("D" * int(own[1:]) if own[1:].isdigit() else own)
            if own == "I":
                state = to[state]
            elif cost[4] is None:  # the end of the run
                return "".join(out), state
            else:
                state, node = to[state], cost[4]
        raise AssertionError


def signed(turns: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """(conv_id, chunk, signature, head): every conversation's runs of symbols, ``head`` the key of the first row. Written; reads no text into a shuffle."""
    body = F.coalesce(F.col("text"), F.lit(" "))
    bare = F.rtrim(body, F.lit(BLANKS))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.md5(body.cast("binary")).alias("mark"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    rows = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    seen = rows.groupBy("conv_id", "role", "mark").agg(F.count(F.lit(1)).alias("turns"), F.min(F.struct("turn")).alias("first")).where("turns > 1").drop("turns")
    rows = join_on(rows, seen, ["conv_id", "role", "mark"], "left")
    gone = F.col("blank") | (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")))
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    symbol = F.when(F.col("cut"), F.upper(letter)).otherwise(letter)
    token = F.when(gone, F.concat(F.lit("x"), F.col("n"))).when(F.col("n") > 1, F.concat(symbol, F.lit("x"), F.col("n") - 1)).otherwise(symbol)
    rows = rows.select(*KEY, token.alias("token")).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()))  # the order of all rows, kept by the file
    runs = rows.groupBy("conv_id", F.shiftright("at", bits).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("own"), F.min(F.struct("at", "turn", "role", "mark")).alias("head"))
    return saved(runs.select("conv_id", "chunk", F.array_join(F.col("own.token"), "").alias("signature"), "head"))


def _solve(wanted: DataFrame) -> DataFrame:
    """(signature, exits) to one answer per entry state: costs, audits, states after. Each distinct pair once, sorted from the end."""

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            signature, exits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            nodes = []
            for s, e in zip(signature, exits):
                node = automaton.read(s, e)
                nodes.append((automaton.nodes[node][0][:4], [automaton.follow(node, state) for state in range(4)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signature, pa.string()), pa.array(exits, pa.list_(pa.int64())), pa.array([list(n[0]) for n in nodes], pa.list_(pa.int64())),
                 pa.array([[a for a, _ in n[1]] for n in nodes], pa.list_(pa.string())), pa.array([[s for _, s in n[1]] for n in nodes], pa.list_(pa.int32()))],
                ["signature", "exits", "costs", "audits", "after"])

    pairs = wanted.select("signature", "exits").distinct().repartitionByRange(F.col("exits"), F.reverse("signature")).sortWithinPartitions(F.col("exits"), F.reverse("signature"))
    return pairs.mapInArrow(run, "signature string, exits array<bigint>, costs array<bigint>, audits array<string>, after array<int>")


def _exits(runs: DataFrame) -> DataFrame:
    """The runs with the least costs that follow each by state (less their minimum); null for a conversation's last run."""
    several = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk").alias("end"))
    runs = join_on(runs, several, ["conv_id"])
    alone = runs.where("n = 1").select("conv_id", "chunk", "signature", "head", F.lit(None).cast("array<bigint>").alias("exits"))
    parts = runs.where("n > 1")
    units = F.explode(F.array(*[F.array(*[F.lit(0 if i == j else _FAR).cast("long") for j in range(4)]) for i in range(4)]))
    by_state = _solve(parts.select("signature").distinct().select("signature", units.alias("exits")))
    matrix = by_state.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct((-F.array_position("exits", F.lit(0).cast("long"))).alias("state"), "costs"))).alias("m"))
    rows = parts.select("conv_id", "chunk", "signature", "head", (F.col("chunk") == F.col("end")).alias("last")).join(matrix.select("signature", F.col("m.costs").alias("m")), "signature")

    def run(batches):
        follow = None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            exits = []
            for last, m in zip(column["last"].to_pylist(), column["m"].to_pylist()):
                if last:
                    follow = None
                exits.append(follow)
                then = follow or [0, 4, 2, 0]
                # m is sorted by falling exit state: m[3 - j][s] is the least cost from s to j
                own = [min(m[3 - j][s] + then[j] for j in range(4)) for s in range(4)]
                # a turn may also be made first, before this run's first row: the automaton's costs hold that already
                follow = [c - min(own) for c in own]
            out = {n: column[n] for n in ("conv_id", "chunk", "signature", "head")}
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(exits, pa.list_(pa.int64()))], [*out, "exits"])

    back = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
    return alone.unionByName(back.mapInArrow(run, alone.schema))


def edits(turns: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """One row per edit, in order within a conversation: conv_id, turn, role, fault (blank, duplicate, truncated), edit, new_role, text, cost.

    Kept and reroled rows have the role they end with in ``new_role``; deleted ones have null there, inserted ones null in ``turn``, ``role`` and ``fault``.
    """
    turns = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    runs = saved(_exits(signed(turns, bits)))
    heads = join_on(runs, _solve(runs), ["signature", "exits"])
    heads = heads.select("conv_id", *[F.col(f"head.{k}").alias(k) for k in KEY[1:]], F.lit(0).alias("kind"), F.lit("").alias("text"), "signature", "audits", "after")
    body = F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.md5(body.cast("binary")).alias("mark"), F.lit(1).alias("kind"), body.alias("text"),
                        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("array<int>").alias("after"))
    stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*KEY, "kind").select("conv_id", "turn", "role", "kind", "text", "signature", "audits", "after")

    def run(batches):
        conv, started, walk = None, False, None
        for batch in batches:
            own = [batch.column(i).to_pylist() for i in range(8)]
            out: list[list] = [[] for _ in range(8)]
            for conv_id, turn, role, kind, text, signature, audits, after in zip(*own):
                if not started or conv_id != conv:
                    if walk:
                        walk.rest(out)
                    conv, started, walk = conv_id, True, _Walk(conv_id)
                if kind == 0:
                    walk.load(signature, audits, after)
                else:
                    walk.row(turn, role, text, out)
            yield _edit_batch(out)
        if walk:
            out = [[] for _ in range(8)]
            walk.rest(out)
            yield _edit_batch(out)

    return stream.mapInArrow(run, _EDITS)


def _edit_batch(out) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["conv_id", "turn", "role", "fault", "edit", "new_role", "text", "cost"])


def _symbols(signature: str):
    for m in _TOKEN.finditer(signature):
        if m[2]:
            yield m[2]
        else:
            for _ in range(int(m[1])):
                yield "x"


class _Walk:
    """Rows of one conversation beside its audit."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.enter = conv_id, START, START
        self.audit, self.at, self.symbols = "", 0, iter(())

    def load(self, signature, audits, after):
        self.audit, self.at, self.symbols = audits[self.enter], 0, _symbols(signature)
        self.enter = after[self.enter]

    def _put(self, out, *row):
        for x, v in zip(out, (self.conv_id, *row)):
            x.append(v)

    def _made(self) -> str:
        self.state = _AFTER[self.state]
        return "assistant" if self.state == ASSISTANT else "user"

    def _inserts(self, out):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(out, None, None, None, "I", self._made(), "", 2)

    def row(self, turn, role, text, out):
        self._inserts(out)
        edit, symbol = self.audit[self.at], next(self.symbols)
        self.at += 1
        fault = ("duplicate" if text.strip(BLANKS) else "blank") if symbol == "x" else "truncated" if symbol.isupper() else None
        if edit == "D":
            self._put(out, turn, role, fault, "D", None, text, 3)
        elif edit == "R":
            self._put(out, turn, role, fault, "R", self._made(), text, 2 + (fault is not None))
        else:
            self.state = SYSTEM if symbol in "sS" else _AFTER[self.state]
            self._put(out, turn, role, fault, "K", role, text, int(fault is not None))

    def rest(self, out):
        self._inserts(out)


def summarize(edited: DataFrame) -> DataFrame:
    """Rows of ``edits``, as they stream, to one row per conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired text."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        conv, started, one = None, False, None
        for batch in batches:
            done = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if not started or row[0] != conv:
                    if one:
                        done.append(one.row())
                    conv, started, one = row[0], True, _Report(row[0])
                one.take(*row[1:])
            yield _report_batch(done, names)
        if one:
            yield _report_batch([one.row()], names)

    return edited.mapInArrow(run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _report_batch(rows, names) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class _Report:
    def __init__(self, conv_id):
        self.conv_id, self.hash, self.kept, self.audit, self.cost = conv_id, hashlib.sha256(), False, [], 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.most = self.before = None
        self.turns = self.illegal = 0

    def take(self, turn, role, fault, edit, new_role, text, cost):
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if fault:
                self.count[fault] += 1
            if turn is not None and turn != self.most:  # turns rise
                self.least = turn if self.least is None else self.least
                self.most, self.turns = turn, self.turns + 1
            initial = role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
        if new_role is not None:
            self.hash.update(f"{chr(10) if self.kept else ''}{new_role}:{text}".encode())
            self.kept = True

    def row(self):
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """Rows broken by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20).alias("fate")
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' repair, one row per conversation of the table; one of which nothing is left has zeros and empty texts."""
    found = summarize(edits(damage(conversations)))
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    whole = join_on(every, found, ["conv_id"], "left")
    number = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same rows by a recursion over each conversation's rows from the last to the first, with the best rest by grammar state.
REPORT_SQL = r"""
WITH RECURSIVE byte_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: unicode(ch)::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS fate
  FROM conversations, byte_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, n + 1 AS pos, [{c: 0::BIGINT, a: '', o: []::VARCHAR[]}, {c: 4::BIGINT, a: 'II', o: ['user:', 'assistant:']}, {c: 2::BIGINT, a: 'I', o: ['assistant:']}, {c: 0::BIGINT, a: '', o: []::VARCHAR[]}] AS w
  FROM counted
  UNION ALL
  SELECT conv_id, pos, [list_min([d[1], two]), list_min([d[2], two]), u, a] FROM (
    SELECT *, {c: 2 + u.c, a: 'I' || u.a, o: list_concat(['user:'], u.o)} AS two FROM (
      SELECT *, list_min([d[3], {c: 2 + d[4].c, a: 'I' || d[4].a, o: list_concat(['assistant:'], d[4].o)}]) AS u, list_min([d[4], {c: 2 + d[3].c, a: 'I' || d[3].a, o: list_concat(['user:'], d[3].o)}]) AS a FROM (
        SELECT j.conv_id, j.pos, list_transform([1, 2, 3, 4], lambda s: list_min([
          {c: 3 + w[s].c, a: 'D' || w[s].a, o: w[s].o},
          CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {c: 2 + (fault IS NOT NULL)::INT + w[if(s = 3, 4, 3)].c, a: 'R' || w[if(s = 3, 4, 3)].a, o: list_concat([if(s = 3, 'assistant:', 'user:') || text], w[if(s = 3, 4, 3)].o)} END,
          CASE WHEN fault IN ('blank', 'duplicate') OR i <> if(s = 3, 'a', 'u') THEN NULL ELSE {c: (fault IS NOT NULL)::INT + w[if(s = 3, 4, 3)].c, a: 'K' || w[if(s = 3, 4, 3)].a, o: list_concat([role || ':' || text], w[if(s = 3, 4, 3)].o)} END,
          CASE WHEN fault IN ('blank', 'duplicate') OR i <> 's' OR s <> 1 THEN NULL ELSE {c: (fault IS NOT NULL)::INT + w[2].c, a: 'K' || w[2].a, o: list_concat([role || ':' || text], w[2].o)} END])) AS d
        FROM walk JOIN judged j ON j.conv_id IS NOT DISTINCT FROM walk.conv_id AND j.pos = walk.pos - 1)))
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w[1].c, 0) AS cost, coalesce(w[1].a, '') AS audit, sha256(coalesce(array_to_string(w[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN (SELECT * FROM walk WHERE pos = 1) x ON x.conv_id IS NOT DISTINCT FROM e.conv_id
"""
