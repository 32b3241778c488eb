"""Conversation structure repair: the cheapest edits to turns that alternate, by Four-Russians block tables.

A repaired conversation is empty or has role initials ``s?(ua)+``. Edits: keep a row (0), give it
the role user or assistant (2), delete it (3; required for blank rows and duplicates), insert an
empty user or assistant row (2); a truncated row that stays adds 1.

The costs of finishing from each of four states (nothing yet, after s, after u, after a) depend on
the rows that follow, and differ from the least of them by one of a few vectors. So:

1. ``tables``: every such normalised vector is found by closure, and for every block of ``BLOCK``
   row symbols the vector before it (and its states' exits) is precomputed from the vector after it.
2. A segment of at most ``SEGMENT`` rows is processed by lookup, block by block from its end. Of a conversation
   with several segments each is first mapped for all vectors, the maps are chained (a few hundred
   bytes for each 4,096 rows), and then each segment has its own right-hand vector and entry state.
3. To trace, each block is expanded backward, row by row, from the vector on its right. Then the first of
   D, I, K, R that keeps the least cost is taken at each step, so ties go to the ASCII-least audit.

Row numbers come from range-partitioned storage and duplicates from an aggregate, so no step up to the audit
gathers a conversation. Only its repaired text, whose digest is a serial chain, passes one task, as a
stream of sorted rows; that task holds two characters a row.

Cases: rows are ordered by turn (nulls first), then role and digest of the text; a null role or
text counts as one space; a null ``conv_id`` is a conversation of its own; repeated rows are duplicates; an
empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, written
from ledgerlens.operators.rank import exact_row_number

SPACES = "\\x20\\x09-\\x0D"
#: Costs of the edits (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK, SEGMENT = 4, 4096
#: What a row shows of itself: role initial, then fault. A letter for each: s u a o, then b d t or none.
INITIALS, FAULTS = "suao", ("", "truncated", "blank", "duplicate")
SYMBOLS = [(i, f) for f in FAULTS for i in INITIALS]
LETTERS = "ABCDEFGHIJKLMNOP"
#: States: nothing yet, after s, after u, after a; the row that can be added in each, and the state after it.
ADDED, AFTER = "uuau", (2, 2, 3, 2)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ROLE = {"u": "user", "a": "assistant"}
END = (0, 4, 2, 0)
LAST = ("", "II", "I", "")


class Tables:
    """Vectors, and transitions by symbol and by block of symbols.

    Symbols that allow the same edits share a class: 4 initials whole, 4 truncated, one that must go.
    """

    def __init__(self):
        self.classes = [min(i, 8) for i in range(len(SYMBOLS))]
        n = max(self.classes) + 1
        vectors, found = [END], {END: 0}
        steps: list[list[tuple]] = []
        for v in vectors:  # grows while it is read, until no symbol leads to a new vector
            row = []
            for c in range(n):
                g, moves = self.before(v, *SYMBOLS[c])
                least = min(g)
                new = tuple(x - least for x in g)
                if new not in found:
                    found[new] = len(vectors)
                    vectors.append(new)
                row.append((found[new], least, moves))
            steps.append(row)
        self.vectors = vectors
        self.back = [[s[0] for s in row] for row in steps]
        self.moves = [[s[2] for s in row] for row in steps]
        one_back = np.array(self.back, np.int32)
        one_exit = np.array([[[m[1] for m in s[2]] for s in row] for row in steps], np.int8)
        size = n ** BLOCK
        codes = np.arange(size)
        at = np.broadcast_to(np.arange(len(vectors))[:, None], (len(vectors), size)).copy()
        path = []
        for k in range(BLOCK):  # from the block's last symbol to its first
            symbol = codes // n ** k % n
            path.append((at, symbol))
            at = one_back[at, symbol]
        self.block_back = at
        exits = np.broadcast_to(np.arange(4, dtype=np.int8), (len(vectors), size, 4)).copy()
        for right, symbol in reversed(path):  # from its first to its last
            exits = np.take_along_axis(one_exit[right, symbol], exits.astype(np.int64), 2)
        self.block_exit = exits
        self.n, self.one_back, self.one_exit = n, one_back, one_exit

    @staticmethod
    def before(v: tuple, initial: str, fault: str) -> tuple[list[int], list[tuple[str, int]]]:
        """Costs from each state before a row, from those after it; and the edits that take the row, ASCII-least, with the state after them."""
        def options(q: int) -> list[tuple[int, str, int]]:
            out = [(DELETE + v[q], "D", q)]
            if fault in ("", "truncated"):
                more = TRUNCATED if fault else 0
                if (initial, q) in KEPT:
                    out.append((more + v[KEPT[initial, q]], "K", KEPT[initial, q]))
                out.append((more + REROLE + v[AFTER[q]], "R", AFTER[q]))
            return out

        taken = [min(options(q)) for q in range(4)]
        best = list(taken)
        for q in (2, 3, 0, 1):  # at most one insertion helps 2 and 3, and 0 and 1 go on from 2
            follow = best[AFTER[q]] if q < 2 else taken[AFTER[q]]
            best[q] = min(best[q], (INSERT + follow[0], "I" + follow[1], follow[2]))
        return [b[0] for b in best], [(b[1], b[2]) for b in best]

    def cut(self, symbols: str) -> tuple[list[int], np.ndarray]:
        """Symbol classes of the first rows, and the codes of the whole blocks behind them."""
        c = np.array([self.classes[LETTERS.index(x)] for x in symbols], np.int64) if len(symbols) < 64 else \
            np.array(self.classes, np.int64)[np.frombuffer(symbols.encode(), np.uint8) - ord("A")]
        rest = len(c) % BLOCK
        return c[:rest].tolist(), c[rest:].reshape(-1, BLOCK) @ self.n ** np.arange(BLOCK - 1, -1, -1)

    def trace(self, symbols: str, right: int, state: int) -> tuple[str, int]:
        """The audit of a segment and the state after it, given the vector on its right and the state before it."""
        first, codes = self.cut(symbols)
        borders = [right]
        for code in codes[::-1].tolist():
            borders.append(int(self.block_back[borders[-1], code]))
        audit: list[str] = []

        def expand(classes: list[int], v: int, state: int) -> int:
            rights = []
            for c in reversed(classes):
                rights.append(v)
                v = self.back[v][c]
            for c, r in zip(classes, reversed(rights), strict=True):
                edits, state = self.moves[r][c][state]
                audit.append(edits)
            return state

        state = expand(first, borders[-1], state)
        powers = [self.n ** k for k in range(BLOCK - 1, -1, -1)]
        for code, v in zip(codes.tolist(), reversed(borders[:-1]), strict=True):
            state = expand([code // p % self.n for p in powers], v, state)
        return "".join(audit), state

    def map_segment(self, symbols: str) -> tuple[np.ndarray, np.ndarray]:
        """For every vector on the right: the vector on the left, and the state after the segment for each state before it."""
        first, codes = self.cut(symbols)
        at = [np.arange(len(self.vectors))]
        for code in codes[::-1].tolist():
            at.append(self.block_back[at[-1], code])
        ones = [at[-1]]
        for c in reversed(first):
            ones.append(self.one_back[ones[-1], c])
        state = np.broadcast_to(np.arange(4), (len(self.vectors), 4))
        for c, r in zip(first, reversed(ones[:-1]), strict=True):
            state = np.take_along_axis(self.one_exit[r, c], state.astype(np.int64), 1)
        for code, r in zip(codes.tolist(), reversed(at[:-1]), strict=True):
            state = np.take_along_axis(self.block_exit[r, code], state.astype(np.int64), 1)
        return ones[-1], state


@lru_cache(1)
def tables() -> Tables:
    return Tables()


# ---------------------------------------------------------------- rows and segments

def conversation_key(c: str = "conv_id") -> Column:
    """A text key that tells a null id from every other."""
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))


def _role() -> Column:
    return F.coalesce(F.col("role"), F.lit(" "))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(" "))


def keyed(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, digest): nulls filled, in the order's columns."""
    return rows.select(conversation_key().alias("key"), "conv_id", "turn", _role().alias("role"), _text().alias("text"),
                       F.md5(_text().cast("binary")).alias("digest"))


def segments(rows: DataFrame) -> DataFrame:
    """(key, segment, symbols): each conversation's rows as letters, ``SEGMENT`` at most together."""
    spark = rows.sparkSession
    initial = F.substring("role", 1, 1)
    seen = rows.select("key", "turn", "role", "digest", F.rlike("text", F.lit(f"[^{SPACES}]")).alias("said"),
                       F.rlike("text", F.lit(f"[.!?][{SPACES}]*\\z")).alias("ended"))
    numbered = written(exact_row_number(seen, ["turn", "role", "digest"], ["key"], "n"), scratch(spark, "numbered-rows"))
    first = numbered.groupBy("key", "role", "digest").agg(F.min("n").alias("n")).select("key", "n", F.lit(True).alias("first"))
    fault = F.when(~F.col("said"), 2).when(F.col("first").isNull(), 3).when(~F.col("ended"), 1).otherwise(0)
    kind = F.coalesce(*[F.when(initial == x, i) for i, x in enumerate(INITIALS[:3])], F.lit(3))
    letter = F.substring(F.lit(LETTERS), fault * 4 + kind + 1, F.lit(1))
    marked = numbered.join(first, ["key", "n"], "left").select("key", "n", letter.alias("letter"), F.expr(f"(n - 1) div {SEGMENT}").alias("segment"))
    listed = marked.groupBy("key", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "letter"))).alias("rows"))
    return written(listed.select("key", "segment", F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("symbols")),
                   scratch(spark, "segments"))


def solve(found: DataFrame) -> DataFrame:
    """(key, segment, symbols, audit) from ``segments``: the audits of a conversation's segments, end to end, are its audit."""
    spark = found.sparkSession
    long = found.filter("segment > 0").select("key").distinct()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for b in batches:
            left, exits = zip(*[t.map_segment(x) for x in b.column("symbols").to_pylist()]) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("segment"), pa.array([x.astype("<i4").tobytes() for x in left], pa.binary()),
                                              pa.array([x.astype("<i1").tobytes() for x in exits], pa.binary())], ["key", "segment", "lefts", "exits"])

    def chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        right, at = [], 0
        for lefts in reversed(pdf["lefts"].tolist()):
            right.append(at)
            at = int(np.frombuffer(lefts, "<i4")[at])
        right.reverse()
        entry, state = [], 0
        for exits, r in zip(pdf["exits"], right, strict=True):
            entry.append(state)
            state = int(np.frombuffer(exits, "<i1")[4 * r + state])
        last = [False] * (len(pdf) - 1) + [True]
        return pd.DataFrame({"key": pdf["key"], "segment": pdf["segment"], "right": right, "entry": entry, "last": last})

    # a row of some 200 bytes for each segment of a conversation with more than one
    maps = found.join(long, "key", "left_semi").select("key", "segment", "symbols").mapInArrow(mapped, "key string, segment long, lefts binary, exits binary")
    placed = maps.groupBy("key").applyInPandas(chained, "key string, segment long, right int, entry int, last boolean")
    whole = found.join(placed, ["key", "segment"], "left").select(
        "key", "segment", "symbols", F.coalesce("right", F.lit(0)).alias("right"), F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("last", F.lit(True)).alias("last"))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for b in batches:
            audits = []
            for symbols, right, entry, last in zip(*[b.column(c).to_pylist() for c in ("symbols", "right", "entry", "last")], strict=True):
                audit, state = t.trace(symbols, right, entry)
                audits.append(audit + LAST[state] if last else audit)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("segment"), b.column("symbols"), pa.array(audits, pa.string())],
                                             ["key", "segment", "symbols", "audit"])

    return written(whole.mapInArrow(traced, "key string, segment long, symbols string, audit string"), scratch(spark, "audits"))


# ---------------------------------------------------------------- repaired rows

#: A repaired row, or a deleted one: its edit, the row's own turn, initial and fault (null for an
#: inserted one), and the role and text it has now. In each partition a conversation's rows follow each other in order.
REPAIRED = "key string, place long, edit string, turn long, initial string, fault string, role string, text string"
ROWS_A_BATCH, BYTES_A_BATCH = 4096, 4 << 20


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation, row by row (``REPAIRED``), deletions included."""
    spark = conversations.sparkSession
    rows = keyed(conversations)
    audits = solve(segments(rows))
    turn = rows.schema["turn"].dataType.simpleString()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("symbols", "string"), ("audit", "string"))]
    both = rows.select("key", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("segment"), "turn", "role", "digest", "text", *none).unionByName(
        audits.select("key", F.lit(0).alias("kind"), "segment", F.lit(None).cast(turn).alias("turn"),
                      *[F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")], "symbols", "audit"))
    dealt = both.repartition("key").sortWithinPartitions("key", "kind", "segment", "turn", "role", "digest")
    schema = REPAIRED.replace("turn long", f"turn {turn}")
    turn_type = spark.createDataFrame([], schema).schema["turn"].dataType

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [pa.string(), pa.int64(), pa.string(), to_arrow_type(turn_type), *[pa.string()] * 4]
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], [x.split()[0] for x in REPAIRED.split(", ")])

        key, symbols, audit, at, row, state = None, [], [], 0, 0, 0

        def inserted() -> tuple:
            return (key, at, "I", None, None, None, ROLE[ADDED[state]], "")

        for b in batches:
            for k, kind, s, a, t, role, text in zip(*[b.column(c).to_pylist() for c in ("key", "kind", "symbols", "audit", "turn", "role", "text")], strict=True):
                if k != key:
                    while at < len(audit):
                        out.append(inserted())
                        state, at = AFTER[state], at + 1
                    key, symbols, audit, at, row, state = k, "", "", 0, 0, 0
                if kind == 0:
                    symbols += s
                    audit += a
                    continue
                while audit[at] == "I":
                    out.append(inserted())
                    state, at = AFTER[state], at + 1
                initial, fault = SYMBOLS[LETTERS.index(symbols[row])]
                edit, row = audit[at], row + 1
                if edit == "R":
                    role, state = ROLE[ADDED[state]], AFTER[state]
                elif edit == "K":
                    state = KEPT[initial, state]
                out.append((key, at, edit, t, initial, fault, role, text))
                at += 1
                size += len(text)
                if len(out) >= ROWS_A_BATCH or size > BYTES_A_BATCH:
                    yield batch()
                    out, size = [], 0
        while at < len(audit):
            out.append(inserted())
            state, at = AFTER[state], at + 1
        if out:
            yield batch()

    return dealt.mapInArrow(edited, schema)


DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation from ``repair``'s rows, in its partitions as they are."""
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        now = None

        def close() -> None:
            if now:
                gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
                done.append((now["key"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"],
                             "".join(now["audit"]), now["hash"].hexdigest()))

        for b in batches:
            for k, edit, turn, initial, fault, role, text in zip(*[b.column(c).to_pylist() for c in ("key", "edit", "turn", "initial", "fault", "role", "text")], strict=True):
                if now is None or k != now["key"]:
                    close()
                    now = {"key": k, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                           "audit": [], "hash": hashlib.sha256(), "before": None, "any": False}
                now["audit"].append(edit)
                now["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "I":
                    if turn is not None:  # in ascending order
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["turns"] += turn != now["high"]
                        now["high"] = turn
                    if fault:
                        now[fault] += 1
                    if fault == "truncated" and edit != "D":
                        now["cost"] += TRUNCATED
                    if now["before"] is not None and now["before"] + initial not in LEGAL:
                        now["illegal"] += 1
                    now["before"] = initial
                if edit != "D":
                    now["hash"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                    now["any"] = True
            if len(done) > ROWS_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types, strict=True)], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types, strict=True)], names)

    return repaired.mapInArrow(digested, DIGEST)


# ---------------------------------------------------------------- the query's damage

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the query's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _role().alias("role"), _text().alias("text"), fate.alias("fate")).filter("fate <> 0")
    changed = rows.withColumns({
        "text": F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))})
    return changed.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .select("conv_id", "turn", "role", "text")


def repair_report(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conversation of the undamaged table."""
    found = digest(repair(damaged(conversations)))
    ids = conversations.groupBy(conversation_key().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "key", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                                                 F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The same report in SQL: costs and audits from the last row back, (cost, audit) least at each state."""
    def st(c: str, a: str, b: str) -> str:
        return f"struct_pack(c := {c}, a := {a}, b := {b})"

    def ins(role: str, g: str) -> str:
        return st(f"{g}.c + 2", f"'I' || {g}.a", f"chr(10) || '{role}:' || {g}.b")

    def take(q: int) -> str:
        nxt, role = f"g{AFTER[q]}", ROLE[ADDED[q]]
        out = [st(f"g{q}.c + 3", f"'D' || g{q}.a", f"g{q}.b")]
        for i, state in KEPT:
            if state == q:
                to = KEPT[i, state]
                out.append(f"CASE WHEN NOT x AND i = '{i}' THEN {st(f'g{to}.c + t', f'''chr(75) || g{to}.a''', f'''chr(10) || r.role || chr(58) || r.text || g{to}.b''')} END")
        out.append(f"CASE WHEN NOT x THEN {st(f'{nxt}.c + 2 + t', f'''chr(82) || {nxt}.a''', f'''chr(10) || '{role}:' || r.text || {nxt}.b''')} END")
        return f"list_min(list_filter([{', '.join(out)}], lambda z: z IS NOT NULL))"

    return rf"""WITH RECURSIVE
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ord(z) AS BIGINT) for z in
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f WHERE fate <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n, count(*) OVER (PARTITION BY conv_id) AS m,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
k AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup FROM n),
rws AS MATERIALIZED (SELECT conv_id, turn, role, text, n, m, i, blank, dup, blank OR dup AS x,
    CASE WHEN NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS t,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM k),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
    sum(t) AS truncated, count_if(p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rws GROUP BY conv_id),
w(conv_id, n, g0, g1, g2, g3) AS (
  SELECT conv_id, m + 1, {st('CAST(0 AS BIGINT)', "''", "''")}, {st('CAST(4 AS BIGINT)', "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")},
    {st('CAST(2 AS BIGINT)', "'I'", "chr(10) || 'assistant:'")}, {st('CAST(0 AS BIGINT)', "''", "''")} FROM rws WHERE n = m
  UNION ALL
  SELECT conv_id, n, least(c0, {ins('user', 'h2')}), least(c1, {ins('user', 'h2')}), h2, h3 FROM (
    SELECT conv_id, n, c0, c1, least(c2, {ins('assistant', 'c3')}) AS h2, least(c3, {ins('user', 'c2')}) AS h3 FROM (
      SELECT r.conv_id AS conv_id, r.n AS n, {take(0)} AS c0, {take(1)} AS c1, {take(2)} AS c2, {take(3)} AS c3
      FROM w JOIN rws r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n - 1)))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.g0.c, 0) AS BIGINT) AS cost,
  coalesce(w.g0.a, '') AS audit, sha256(coalesce(substr(w.g0.b, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = 1"""
