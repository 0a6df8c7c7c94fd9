"""Conversation structure repair by a rank-compressed dynamic programme.

Rows of a conversation are ordered by turn (nulls first), then role and a digest. Each has
one symbol: its role initial if that is s, u or a, in upper case if the text is truncated, ``x`` for blank
and duplicate rows, which must go, and ``o`` for other roles, ``O`` if truncated. The symbols
are all that the programme needs, one byte a row: they are gathered from ranges of the
sorted table, so a long conversation is many ranges, and its texts never meet there.

The programme reads the symbols in layers. A macro edit is a run of inserts and the edit
of one turn: as a code, ``I*`` and one of D, K, R. No code is the beginning of another, so two
audit strings of a layer are ordered by the rank of what came before and then by the
code: a layer keeps a cost, a rank and a parent for each of four states (nothing yet, after s, after u,
after a), and no strings. A layer depends only on costs relative to the least one,
ranks and a symbol, so equal layers are computed once. Parents are followed back from the end
to give the audit string.

Costs: Keep 0, Rerole 3, Delete 4, Insert 3; a truncated row that stays costs 3 more.
Runs of three inserts or more never pay: two fewer lead to the same state.

Defined cases: a null role or text is one blank; rows with a null turn come first; a row
whose role is empty or starts with no s, u or a is reroled or deleted; rows of a null conv_id
are one conversation; repeated rows are duplicates; a conversation without rows needs no
edits; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.shuffles import stage_written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where a kept turn or an insert leads.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the test damage that a hash of (conv_id, turn) chooses."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", F.when(case == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), case.alias("_case")).filter("_case <> 0")
    return rows.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_case") == 3, 2).otherwise(1)))).drop("_case", "_again")


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows of a turn: conv_id, turn, role, digest (of role and text), n, and whether they are blank,
    open (truncated) and late (an earlier turn says the same)."""
    clean = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    r = rows.select("conv_id", "turn", role, text)
    r = r.select("conv_id", "turn", "role", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), (~clean).alias("blank"), (clean & ~whole).alias("open"))
    # First turns of what a conversation says in several; a null turn comes before all others.
    said = r.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("untimed"))
    said = stage_written(said.filter("n > 1"), "said").select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "first", "untimed")
    r = r.join(said, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    late = F.coalesce(F.when(F.col("untimed"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    # Equal rows of a turn become one with their number, however many they are.
    return r.groupBy("conv_id", "turn", "role", "digest", "blank", "open", late.alias("late")).agg(F.count("*").alias("n"))


def segments(rows: DataFrame) -> DataFrame:
    """A row for each range of a conversation in order: part, its symbols, role initials, faults and turns."""
    marks, kind = marked(rows), rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: dict | None = None

        def flushed(s: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
            own = {k: pa.array([s[k]], t) for k, t in (("part", pa.int32()), ("symbols", pa.string()), ("first_role", pa.string()), ("last_role", pa.string()))}
            own |= {k: pa.array([s[k]], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
            own |= {k: pa.array([s[k]], batch.schema.field("turn").type) for k in ("least", "most")}
            return pa.RecordBatch.from_arrays([pa.array([s["conv_id"]], batch.schema.field("conv_id").type), *own.values()], ["conv_id", *own])

        batch = None
        for batch in batches:
            for r in batch.to_pylist():
                s = open_one
                if s is None or r["conv_id"] != s["conv_id"]:
                    if s is not None:
                        yield flushed(s | {"symbols": "".join(s["symbols"])}, batch)
                    s = open_one = {"conv_id": r["conv_id"], "part": r["part"], "symbols": [], "first_role": r["role"][:1], "last_role": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "least": None, "most": None}
                initial, n = r["role"][:1], r["n"]
                gone = n if r["blank"] or r["late"] else n - 1
                s["blank" if r["blank"] else "duplicate"] += gone
                s["truncated"] += r["open"] and gone < n
                symbol = initial if initial in ("s", "u", "a") else "o"
                s["symbols"].append((symbol.upper() if r["open"] else symbol) * (n - gone) + "x" * gone)
                # Equal rows follow each other, and no role may follow itself.
                s["illegal"] += n - 1 + (s["last_role"] is not None and s["last_role"] + initial not in ("su", "ua", "au"))
                s["last_role"] = initial
                if r["turn"] is not None and r["turn"] != s["most"]:
                    s["turns"] += 1
                    s["least"], s["most"] = r["turn"] if s["least"] is None else s["least"], r["turn"]
        if open_one is not None:
            yield flushed(open_one | {"symbols": "".join(open_one["symbols"])}, batch)
    order = ["conv_id", "turn", "role", "digest"]
    dealt = marks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    counts = ", ".join(f"{c} bigint" for c in ("blank", "duplicate", "truncated", "illegal", "turns"))
    return dealt.mapInArrow(run, f"conv_id {kind}, part int, symbols string, first_role string, last_role string, {counts}, least {turn}, most {turn}")


def _layer(ranked: tuple, symbol: str) -> tuple[tuple, int, bytes]:
    """From (cost, rank) of the four states, None if out of reach: the same after one row, what the costs
    were lowered by, and for each state its parent state and code (4 * code + parent; codes in ASCII order)."""
    truncated, kind = symbol in "SUAO", symbol.lower()
    found: dict[int, tuple] = {}
    for state, entry in enumerate(ranked):
        if entry is None:
            continue
        cost, rank = entry
        at = state
        for inserts in range(3):
            paid = cost + INSERT * inserts
            edits = [("D", at, DELETE)]
            if kind != "x":
                stay = TRUNCATED * truncated
                edits += [("K", _NEXT[kind, at], KEEP + stay)] if (kind, at) in _NEXT else []
                edits += [("R", _NEXT[c, at], REROLE + stay) for c in "ua" if (c, at) in _NEXT]
            for letter, to, price in edits:
                code = "I" * inserts + letter
                option = (paid + price, rank, code, state)
                if to not in found or option < found[to]:
                    found[to] = option
            at = _INSERTED[at]
    low = min(o[0] for o in found.values())
    ranks = {to: i for i, to in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
    after = tuple((found[t][0] - low, ranks[t]) if t in found else None for t in range(4))
    return after, low, bytes(4 * CODES.index(found[t][2]) + found[t][3] if t in found else 255 for t in range(4))


#: Macro edits in ASCII order; none is the beginning of another.
CODES = sorted("I" * n + e for n in range(3) for e in "DKR")
_known: dict[tuple, tuple] = {}


def least_edits(symbols: str) -> tuple[int, str]:
    """Cost and audit string of the cheapest edits; of equal costs the ASCII-least audit."""
    ranked, total, parents = ((0, 0), None, None, None), 0, []
    for symbol in symbols:
        step = _known.get((ranked, symbol))
        if step is None:  # few layers differ: costs stay close to the least one
            step = _known[ranked, symbol] = _layer(ranked, symbol)
        ranked, low, back = step
        total += low
        parents.append(back)
    ends = []
    for state, entry in enumerate(ranked):
        at = state
        for inserts in range(3):
            if entry is not None and at in (0, 3):
                ends.append((entry[0] + INSERT * inserts, entry[1], inserts, state))
            at = _INSERTED[at]
    extra, _, inserts, state = min(ends)
    codes = ["I" * inserts]
    for back in reversed(parents):
        codes.append(CODES[back[state] // 4])
        state = back[state] % 4
    return total + extra, "".join(reversed(codes))


def planned(rows: DataFrame) -> DataFrame:
    """Of each conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    parts = stage_written(segments(rows), "segments")
    kind = rows.schema["conv_id"].dataType.simpleString()
    kept = [c for c in parts.columns if c not in ("conv_id", "part")]
    # As many rows as a conversation has ranges; their symbols are as long as its audit string.
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *kept))).alias("parts"))
    counted = ("blank", "duplicate", "truncated", "illegal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("gaps", *counted, "cost", "audit")}
            for ranges in batch.column(1).to_pylist():
                sums = {c: sum(p[c] for p in ranges) for c in counted}
                timed = [p for p in ranges if p["turns"]]
                distinct = sum(p["turns"] for p in timed) - sum(a["most"] == b["least"] for a, b in zip(timed, timed[1:]))
                sums["illegal"] += sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(ranges, ranges[1:]))
                cost, audit = least_edits("".join(p["symbols"] for p in ranges))
                gaps = timed[-1]["most"] - timed[0]["least"] + 1 - distinct if timed else 0
                for c, v in (sums | {"gaps": gaps, "cost": cost, "audit": audit}).items():
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.string() if c == "audit" else pa.int64()) for c, v in out.items()]], ["conv_id", *out])

    return whole.mapInArrow(run, f"conv_id {kind}, gaps bigint, {', '.join(f'{c} bigint' for c in counted)}, cost bigint, audit string")


def _walked(rows: DataFrame, plan: DataFrame, digest: bool) -> DataFrame:
    """Rows of each conversation in order, behind its audit string: repaired turns, or their digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    own = rows.select("conv_id", F.lit(1).alias("_after"), "turn", blank("role"), blank("text"), F.lit(None).cast("string").alias("audit"))
    own = own.withColumn("_d", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ahead = plan.select("conv_id", F.lit(0).alias("_after"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", F.lit("").alias("_d"))
    # One task walks a conversation, row by row: its digest covers all of its texts in order.
    both = own.unionByName(ahead).repartition("conv_id").sortWithinPartitions("conv_id", "_after", "turn", "role", "_d").drop("_d", "_after", "turn")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, edit, role, text), and (conv_id, None, None, None) behind the last row of a conversation."""
        audit, at, last, who, begun = "", 0, "", None, False

        def inserts() -> Iterator[tuple]:
            nonlocal at, last
            while at < len(audit) and audit[at] == "I":
                last = "assistant" if last == "u" else "user"
                yield who, "I", last, ""
                last, at = last[0], at + 1

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True):
                if r[3] is not None:
                    if begun:
                        yield from inserts()
                        yield who, None, None, None
                    audit, at, last, who, begun = r[3], 0, "", r[0], True
                    continue
                yield from inserts()
                edit, role = audit[at], r[1]
                at += 1
                if edit == "R":
                    role = "assistant" if last == "u" else "user"
                if edit != "D":
                    last = role[0]
                    yield who, edit, role, r[2]
        if begun:
            yield from inserts()
            yield who, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type, out, sha, place = first.schema.field("conv_id").type, [], hashlib.sha256(), 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            if digest:
                return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"])
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], ["conv_id", "place", "edit", "role", "text"])

        size = 0
        for who, edit, role, text in turns(b for part in ([first], batches) for b in part):
            if edit is None:
                if digest:
                    out.append((who, sha.hexdigest()))
                sha, place = hashlib.sha256(), 0
            elif digest:
                sha.update(b"\n" * (place > 0) + f"{role}:{text}".encode())
                place += 1
            else:
                out.append((who, place, edit, role, text))
                place, size = place + 1, size + len(text)
            if len(out) >= 5000 or size > 4_000_000:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    return both.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string" if digest else f"conv_id {kind}, place bigint, edit string, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of rows(conv_id, turn, role, text): conv_id, place from 0, edit (I, K or R), role, text."""
    return _walked(rows, planned(rows), digest=False)


def audited(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``every`` (else of rows): faults, cost, audit and the digest of the repaired turns."""
    plan = stage_written(planned(rows), "plan")
    seen = (rows if every is None else every).select(F.col("conv_id").alias("_c")).distinct()
    digests = _walked(rows, plan, digest=True).withColumnRenamed("conv_id", "_w")
    out = seen.join(plan, F.col("_c").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("_c").eqNullSafe(F.col("_w")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audited(damaged(conversations), conversations)
