"""Lexical search, conversation repair and repeated passages against brute force, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from trailmesh.llm import conversation_repair as C
from trailmesh.llm import lexical_search as L
from trailmesh.llm import substring_dedup as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, key long, row long, term string, n long, spans string, lo int, score long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, "s", 4, 5) for i, t in rows], CLASH).repartition(3)


# --- conversation repair


def legal(roles):
    return re.fullmatch(r"(s?(ua)+)?", roles) is not None


def brute_audit(rows):
    """Least (cost, audit) of rows (initial, must go, truncated), over all edits with up to two inserts in a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(gone and e != "D" for e, (_, gone, _) in zip(edits, rows, strict=True)):
            continue
        price = sum({"D": 4, "K": 0, "R": 3}[e] + 3 * (cut and e != "D") for e, (_, _, cut) in zip(edits, rows, strict=True))
        for runs in itertools.product(range(3), repeat=len(rows) + 1):
            cost = price + 3 * sum(runs)
            if best is not None and cost > best[0]:
                continue
            audit = "".join("I" * n + e for n, e in zip(runs, [*edits, ""], strict=True))
            options = [["u", "a"] if e in "IR" else [] for e in audit]
            at = 0
            for i, e in enumerate(audit):
                if e != "I":
                    options[i] = [""] if e == "D" else [rows[at][0]] if e == "K" else ["u", "a"]
                    at += 1
            if any(legal("".join(o)) and ("t" not in o) for o in itertools.product(*options)):
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def test_least_edits_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        symbols = "".join("x" if gone else ("o" if r == "t" else r).upper() if cut else ("o" if r == "t" else r) for r, gone, cut in rows)
        assert C.least_edits(symbols) == brute_audit(rows), symbols


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            yield from [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)


def brute_repair(rows, conv):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
    own = sorted((r for r in damage(rows) if r[0] == conv), key=key)
    turns, seen, faults, marks = [r[1] for r in own if r[1] is not None], set(), Counter(), []
    for _, _, role, text in own:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    symbols = "".join("x" if gone else (r if r in "sua" and r else "o").upper() if cut else (r if r in "sua" and r else "o") for r, gone, cut in marks)
    cost, audit = C.least_edits(symbols)
    out, at = [], 0
    for e in audit:
        last = out[-1][0][:1] if out else ""
        other = "assistant" if last == "u" else "user"
        if e == "I":
            out.append((other, ""))
            continue
        _, _, role, text = own[at]
        at += 1
        if e != "D":
            out.append((role if e == "K" else other, text))
    assert legal("".join(r[:1] for r, _ in out))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha), out


@pytest.fixture(scope="module")
def talk():
    rng, rows = random.Random(11), []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([None, "", " \t", "Yes.", "Well", f"Turn {turn}!", "so? "])))
    rows += [(None, t, "user", "Same.") for t in (None, None, 1, 1, 3)] + [(50, None, "user", f"n{i}.") for i in range(3)] + rows[:6]
    rows += [(60, t, "user" if t % 2 else "assistant", f"Long {t}." if t % 7 else "Again.") for t in range(3000)] + [(61, 0, "user", "w" * 200_000 + ".")]
    return rows


def test_repair_equals_brute_force(spark, talk):
    table = spark.createDataFrame([(*r, "x", 1) for r in talk], "conv_id long, turn long, role string, text string, audit string, part int").repartition(5)
    got = {r.conv_id: tuple(r) for r in C.audited(C.damaged(table), table).collect()}
    convs = {r[0] for r in talk}
    assert set(got) == convs
    for conv in convs:
        assert got[conv] == brute_repair(talk, conv)[0]
    turns = {}
    for r in C.repair(C.damaged(table)).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert all([t[1:] for t in sorted(turns.get(c, []))] == brute_repair(talk, c)[1] for c in convs)
    assert C.audited(C.damaged(table.limit(0)), table.limit(0)).count() == 0 and C.repair(table.limit(0)).count() == 0


def test_conversation_over_many_ranges(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 900}.") for t in range(4000)] + [(2, 0, "assistant", "Hm")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        assert sum(p.conv_id == 1 for p in C.segments(table).collect()) > 1
        plan = {r.conv_id: r for r in C.planned(table).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (plan[1].duplicate, plan[1].audit, plan[1].gaps, plan[1].illegal) == (3100, "K" * 900 + "D" * 3100, 0, 0)
    assert (plan[2].truncated, plan[2].cost, plan[2].audit) == (1, 4, "D")


# --- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    with_terms = [b for _, b in bags if b]
    n_docs, total = len(with_terms), sum(b.total() for b in with_terms)
    df, out = Counter(t for b in with_terms for t in b), []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 75 + ((75 * b.total() * n_docs) // max(total, 1))
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, (i is not None, i or 0)))
        out += [(item, r, i[1] if i[0] else None, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("known", [200_000, 3])
def test_search_equals_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN_TERMS", known)
    monkeypatch.setattr(L, "BROADCAST_WEIGHTS", known)
    monkeypatch.setattr(L, "PIECE", 1000)
    rng = random.Random(2)
    words = ["the", "The", "élan", "x9", "zebra", "ÑAS", "a", "of", "b-c", "🙂"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "..."), (None, "zebra zebra"), (5, docs[5][1]), (5, "zebra crossing"), (70, "zebra " * 3000 + "q" * 5000)]
    items = [(1, "The zebra, the ÑAS"), (2, None), (3, "nothing here"), (4, "of of b c"), (5, "")]
    asked = spark.createDataFrame([(i, t, "t", 1) for i, t in items], "item_id long, text string, term string, weight long")
    got = sorted(L.search(docs_of(spark, docs), asked, 7).collect())
    assert [tuple(r) for r in got] == sorted(brute_search(docs, items, 7))
    if known > 3:
        none = docs_of(spark, docs).limit(0)
        assert L.search(none, asked).count() == 0 and L.search(docs_of(spark, docs), asked.limit(0)).count() == 0


def test_all_terms_are_indexed(spark):
    index = L.build_postings(docs_of(spark, [(1, "A b b"), (2, None)]))
    assert sorted((r.term, r.doc_id, r.tf, r.n) for r in index.rows.collect()) == [("a", 1, 1, 3), ("b", 1, 2, 3)]
    assert (index.n_docs, index.n_terms) == (1, 3)


# --- repeated passages


def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(v for i, v in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


@pytest.mark.parametrize(("window", "segment"), [(35, 2_000_000), (35, 700), (7, 300), (2, 2_000_000), (12, 2_000_000)])
def test_repeats_equal_brute_force(spark, monkeypatch, window, segment):
    monkeypatch.setattr(S.T, "SEGMENT", segment)
    rng = random.Random(window)
    prose = lambda n: [rng.choice(["ab", "é", "Zu", "x.", "\0", "q\0", "🙂"]) + str(rng.randint(0, 300)) for _ in range(n)]
    passage, other = prose(60), prose(36)
    texts = [
        " ".join(prose(80) + passage + prose(20)), "\t".join(prose(5) + passage[3:50] + prose(30)), " ".join(passage[:40]), " ".join(other) + "\n", " ".join(prose(10) + other[1:] + prose(3)),
        " ".join(prose(34)), None, "", " \n", "ha " * 50, "one two " * 40, " ".join(prose(3000) + passage + prose(500) + passage[10:]), "w" * 9000,
    ]
    edited = prose(200)
    texts += [" ".join(edited), " ".join(edited[:90] + ["changed"] + edited[91:]), " ".join(edited[:90] + ["changed"] + edited[91:])]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3]), (None, texts[6]), (4, "again " + " ".join(passage[20:58]))]
    want = sorted(zip([i for i, _ in rows], brute_repeats([t for _, t in rows], window), strict=True), key=str)
    table = docs_of(spark, rows)
    got = sorted(((r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in S.mark_repeats(table, window).collect()), key=str)
    assert got == sorted(((i, w[:3]) for i, w in want), key=str)
    if segment == 700:
        out = S.drop_repeats(table, window)
        assert out.columns == table.columns
        kept = sorted(((i, t if not w[1] else w[3]) for (i, t), w in zip(rows, brute_repeats([t for _, t in rows], window), strict=True)), key=str)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == kept
        assert S.mark_repeats(table.limit(0), window).count() == 0


def test_spans_cover_what_is_removed(spark):
    words = " ".join(f"w{i}" for i in range(50))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in S.mark_repeats(docs_of(spark, [(1, "a b " + words), (2, words + " c"), (3, "alone")])).collect()}
    assert got == {1: [(2, 52)], 2: [(0, 50)], 3: []}


# --- heavy keys


def test_a_third_of_the_rows_under_one_key(spark, monkeypatch):
    from trailmesh.llm import exact_dedup, secrets, skew

    monkeypatch.setattr(skew, "LEAST", 5)
    shared = "the same long text " * 40
    rows = [(i, shared) for i in range(60)] + [(i, f"token = secret{i % 3}abcdef of {i}") for i in range(60, 180)] + [(None, shared), (None, None)]
    table = docs_of(spark, rows).withColumn("source", (skew.F.col("doc_id") % 7).cast("string")).withColumn("lang", skew.F.lit("en"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_exact(table).collect() if r.doc_id is not None}
    assert got == {i: ((59, 61) if i < 60 else (i, 1)) for i in range(180)}
    spans = {r.doc_id: [(s.kind, s.n_owners, s.n_repositories) for s in r.spans] for r in secrets.scan_secrets(table).collect() if r.doc_id is not None}
    assert all(spans[i] == ([] if i < 60 else [("assign", 7, 7)]) for i in range(180))
    n = skew.heavy_keys(spark.createDataFrame([("a", 500), ("b", 3), ("c", 5)], "k string, n long"), "k", "n")
    assert sorted(n) == ["a", "c"]


def test_shuffled_windows_find_what_broadcast_ones_do(spark):
    from trailmesh.llm import decontaminate

    docs = docs_of(spark, [(i, f"a{i} b c d e f g h i j k l") for i in range(6)] + [(None, None), (7, "")])
    items = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "a1 b")], "item_id long, text string")
    both = [sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find_contamination(docs, items, broadcast_windows=n).collect()), key=str) for n in (1000, 0)]
    assert both[0] == both[1] and sum(r[2] > 0 for r in both[0]) == 6
