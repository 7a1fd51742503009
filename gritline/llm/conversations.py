"""Repair the turn structure of conversations by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
VISIBLE = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
ROLES = {"u": "user", "a": "assistant"}
# What the repaired initials so far allow next: nothing yet, a system turn, a user turn, an assistant turn.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
WANTED = ("u", "u", "a", "u")
THEN = {"u": AFTER_U, "a": AFTER_A}
NEVER = 1 << 60


def _after(state: int, initial: str) -> int:
    """The state after a row that keeps its role, -1 if it can't."""
    if initial == "s" and state == START:
        return AFTER_S
    return THEN[initial] if initial == WANTED[state] else -1


def estimates(initials: list[str], faults: list[int]) -> list[list[int]]:
    """For each place and state, a cost that the rows from there on need at least.

    It is the cost of a simpler task in which a conversation may also end after its system turn, so
    that this counts as one that ended well. That never costs more than the task itself.
    """
    after = [[0, 0, INSERT, 0]]
    for k in range(len(initials) - 1, -1, -1):
        below, cost = after[-1], []
        extra = KEEP_TRUNCATED if faults[k] == TRUNCATED else 0
        for state in range(4):
            best = DELETE + below[state]
            if faults[k] < BLANK:
                best = min(best, REROLE + extra + below[THEN[WANTED[state]]])
                kept = _after(state, initials[k])
                if kept >= 0:
                    best = min(best, extra + below[kept])
            cost.append(best)
        # An insertion goes on to another state at the same place.
        for _ in range(2):
            cost = [min(cost[s], INSERT + cost[THEN[WANTED[s]]]) for s in range(4)]
        after.append(cost)
    return after[::-1]


def plan(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """The least cost of edits that give role initials ``(s?(ua)+)?``, and the first such edits in ASCII order.

    D deletes a row, I inserts one, K keeps one and R gives one the role that must come next (the
    initials before always leave one choice). Blank and duplicate rows are deleted.

    The search goes down edits in the order D, I, K, R as long as cost and estimate stay within a
    bound; if it ends without a plan, the bound becomes the least sum that was over it. A place and
    state that failed are remembered with the cost that they need at least, which later visits, also
    those under higher bounds, use as their estimate. So the first plan found is the answer.
    """
    n = len(initials)
    need = estimates(initials, faults)  # estimates, raised where a search failed
    bound = need[0][START]
    while True:
        path = [[0, START, 0, 0, NEVER]]  # place, state, cost so far, edits tried, least need seen below
        edits: list[str] = []
        while path:
            top = path[-1]
            at, state, cost, tried, least = top
            if at == n and state in (START, AFTER_A):
                return cost, "".join(edits)
            if tried == 4:
                need[at][state] = max(need[at][state], least)
                path.pop()
                if path:
                    edits.pop()
                    above = path[-1]
                    above[4] = min(above[4], cost - above[2] + need[at][state])
                continue
            top[3] = tried + 1
            to, then, price = at + 1, state, DELETE
            if tried == 1:
                to, then, price = at, THEN[WANTED[state]], INSERT
            elif at == n:
                continue
            elif tried > 1:
                if faults[at] >= BLANK:
                    continue
                price = KEEP_TRUNCATED if faults[at] == TRUNCATED else 0
                if tried == 2:
                    then = _after(state, initials[at])
                    if then < 0:
                        continue
                else:
                    then = THEN[WANTED[state]]
                    price += REROLE
            if cost + price + need[to][then] > bound:
                top[4] = min(top[4], price + need[to][then])
                continue
            path.append([to, then, cost + price, 0, NEVER])
            edits.append("DIKR"[tried])
        bound = need[0][START]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copy`` and ``gone`` of each row, damaged by a hash of its place.

    The remainder of crc32(``conv_id:turn``) by 20 drops a row (0, it stays as ``gone``), empties its text
    (1), takes out its ends of sentences (2), repeats it (3) or gives it to the user (4). Nulls count as
    one blank, but the id and the turn themselves stay null.
    """
    pick = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    text = F.when(pick == 1, "").when(pick == 2, F.translate(_text("text"), ENDINGS, "")).otherwise(_text("text"))
    copies = F.explode(F.when(pick == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(pick == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"),
        copies.alias("copy"), (pick == 0).alias("gone"),
    )


ORDER = ("conv_id", "kind", "turn", "role", "digest", "copy")


def _gathered(rows: DataFrame) -> DataFrame:
    """The rows of each conversation next to each other in one partition, in order."""
    return rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with what their order needs: rows of one turn go by role, then by the text's SHA-256."""
    made = {"kind": F.lit(1), "digest": F.unhex(F.sha2("text", 256))}
    return df.withColumns(made | {c: F.lit(v) for c, v in {"copy": 0, "gone": False}.items() if c not in df.columns})


class _Seen:
    """What one conversation's rows tell, one short row after the other."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.initials: list[str] = []
        self.faults: list[int] = []
        self.known: set[tuple[str, bytes]] = set()
        self.turns: tuple[int, int, int] | None = None  # least, last, number of different ones

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, ended: bool) -> None:
        key = role, digest
        self.faults.append(BLANK if blank else DUPLICATE if key in self.known else SOUND if ended else TRUNCATED)
        self.known.add(key)
        self.initials.append(role[:1])
        if turn is not None:
            low, last, many = self.turns or (turn, turn, 1)
            self.turns = low, turn, many + (turn != last)

    def summary(self) -> dict:
        cost, audit = plan(self.initials, self.faults)
        low, high, many = self.turns or (0, 0, 1)
        pairs = zip(self.initials, self.initials[1:])
        return {
            "conv_id": self.conv, "gaps": min(high - low + 1 - many, 2**63 - 1), "blank": self.faults.count(BLANK),
            "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs), "cost": cost, "audit": audit,
        }


_SUMMARY = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(df: DataFrame) -> DataFrame:
    """``conv_id``, faults of its rows, and the ``cost`` and ``audit`` of its repair, for each conversation.

    ``df`` has ``conv_id``, ``turn``, ``role``, ``text`` and may have ``copy`` and ``gone``, as ``damage``
    makes them; null roles and texts count as one blank. The first fault of a row counts: ``blank``,
    ``duplicate`` (role and text seen before) or ``truncated`` (no end of a sentence). ``gaps`` are missing
    turns, ``illegal`` neighbours whose initials do not follow each other. Texts are not moved, only their digests. Rows
    come sorted, and a task holds a few bytes for each row of one conversation at a time; a very long one
    is searched in one task. Conversations without rows, other than gone ones, have zeros and an empty audit.
    """
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = _numbered(df.withColumns({"role": _text("role"), "text": _text("text")})).select(
        *ORDER, "gone", (bare == "").alias("blank"),
        F.coalesce(F.right(bare, F.lit(1)).isin(*ENDINGS), F.lit(False)).alias("ended"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Seen | None = None
        for batch in batches:
            done = []
            for conv, _, turn, role, digest, _, gone, blank, ended in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now:
                        done.append(now.summary())
                    now = _Seen(conv)
                if not gone:
                    now.add(turn, role, digest, blank, ended)
            yield pa.RecordBatch.from_pylist(done, _SUMMARY)
        if now:
            yield pa.RecordBatch.from_pylist([now.summary()], _SUMMARY)

    return _gathered(rows).mapInArrow(run, SUMMARY)


class _Rewrite:
    """Plays an audit back over the rows of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.next, self.state = audit, 0, START

    def _turn(self, initial: str) -> str:
        self.state = AFTER_S if initial == "s" else THEN[initial]
        return ROLES.get(initial, "")

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.next : self.next + 1] == "I":
            self.next += 1
            yield "I", self._turn(WANTED[self.state]), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.next]
        self.next += 1
        if edit == "K":
            self._turn(role[:1])
            yield edit, role, text
        elif edit == "R":
            yield edit, self._turn(WANTED[self.state]), text


def _replayed(df: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, as a row of kind 0, in front of its rows; one shuffle moves the texts."""
    lines = _numbered(df.withColumns({"role": _text("role"), "text": _text("text")})).where("NOT gone")
    heads = plans.withColumn("plan", F.struct(*plans.columns)).select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.lit(0).alias("copy"), F.lit("").alias("text"), "plan",
    )
    lines = lines.select(*ORDER, "text", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    return _gathered(heads.unionByName(lines)).select("kind", "role", "text", "plan")


def repaired(df: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows that stay or are new: ``conv_id``, ``place`` (from 0), ``edit`` (K, R or I), ``role`` and ``text``.

    ``plans`` is what ``audits`` gives for ``df``. Rows stream through a task, so it holds no conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64())] + [(c, pa.string()) for c in ("edit", "role", "text")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, play = None, 0, _Rewrite("")
        for batch in batches:
            out: list[tuple] = []
            for kind, role, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                made = list(play.inserts()) if kind == 0 else list(play.row(role, text))
                for row in made:
                    out.append((conv, place, *row))
                    place += 1
                if kind == 0:
                    conv, place, play = head["conv_id"], 0, _Rewrite(head["audit"])
            yield batch_of(out)
        yield batch_of([(conv, place + k, *row) for k, row in enumerate(play.inserts())])

    return _replayed(df, plans).mapInArrow(run, "conv_id bigint, place bigint, edit string, role string, text string")


def digests(df: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with ``repaired_sha256``, of the repaired rows as ``role:text`` with a line feed between them."""

    schema = _SUMMARY.append(pa.field("repaired_sha256", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, play, digest, empty = None, _Rewrite(""), hashlib.sha256(), True

        def update(rows: Iterator[tuple[str, str, str]]) -> None:
            nonlocal empty
            for _, role, text in rows:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        for batch in batches:
            done = []
            for kind, role, text, plan_row in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    update(play.row(role, text))
                    continue
                update(play.inserts())
                if head:
                    done.append({**head, "repaired_sha256": digest.hexdigest()})
                head, play, digest, empty = plan_row, _Rewrite(plan_row["audit"]), hashlib.sha256(), True
            yield pa.RecordBatch.from_pylist(done, schema)
        update(play.inserts())
        if head:
            yield pa.RecordBatch.from_pylist([{**head, "repaired_sha256": digest.hexdigest()}], schema)

    return _replayed(df, plans).mapInArrow(run, f"{SUMMARY}, repaired_sha256 string")
