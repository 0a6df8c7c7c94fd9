"""Base spans of the secret and personal-data scans against brute force over a whole table."""

import hashlib
import random
import re

import pytest

from trailmesh.llm import pii, secrets

SECRETS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def luhn(text):
    digits = [int(c) for c in re.sub("[^0-9]", "", text)][::-1]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]


def brute(kinds, text):
    found = [(m.start(), rank, m.end(), name) for rank, (name, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text or "") if ok(m)]
    counts = [sum(f[3] == name for f in found) for name, _, _ in kinds]
    return counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)).encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "4012888888881881", "378282246310005", "6011 0009 9013 9424 1", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "a@b.c", "x.y+z@d-e.fg.h", "@b.c", "+1 (269) 555-3296", "+49 30 1234567", "+1 23", "12 34", "é", "🙂", ",", "(", "0" * 30]
    parts += ["password = hunter22", "API_KEY: 'abc123'", "secret:x", "AKIA" + "B" * 16, "AKIA" + "B" * 5, "deadbeef" * 3, "token==", "tokens = aaaaaa"]
    rows = base + [(10_000 + i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))) for i in range(400)] + [(20_000, None), (20_001, ""), (20_002, "".join(rng.choice(parts) for _ in range(3000)))]
    path = tmp_path_factory.mktemp("base")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src' AS source", "0L AS n_chars").repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_secret_base_spans(spark, table):
    got = {r.doc_id: ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in secrets.op2_secret_scan(spark, table[0]).collect()}
    assert all(got[i] == brute(SECRETS, t) for i, t in table[1])


def test_personal_base_spans(spark, table):
    out = pii.op4_pii(spark, table[0]).collect()
    got = {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in out}
    assert all(got[i] == brute(PERSONAL, t) for i, t in table[1])
    for r in out:  # nothing is added within a base span
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        own = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert not any(a <= x and y <= b for k, x, y in spans if k not in ("email", "ip", "card", "phone") for _, a, b in own)


def test_planted_numbers_are_told_from_part_numbers(spark):
    """Numbers after a cue or known from a phone are redacted, part numbers stay: precision and recall on rows by hand."""
    rng = random.Random(1)
    digits = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    true = [(i, f"please call me: {digits()} soon") for i in range(150)]
    false = [(1000 + i, f"the part {digits()} is on the list") for i in range(300)]
    got = {r.doc_id: any(s.kind == "number" for s in r.spans) for r in pii.scan_pii(spark.createDataFrame(true + false, "doc_id long, text string")).collect()}
    hits, wrong = sum(got[i] for i, _ in true), sum(got[i] for i, _ in false)
    assert hits / len(true) >= 0.95 and wrong / max(hits + wrong, 1) <= 0.02


def test_equal_scores_pass_together():
    tree = [(1.0,)]
    table = [((0,) * len(pii.FEATURES), 0.0, 9.0), ((0, 1) + (0,) * (len(pii.FEATURES) - 2), 9.0, 0.0)]
    assert pii.calibrate(table, tree, 0.9)[0] == float("inf") and pii.calibrate(table[:1], tree, 0.9)[0] == 1.0


def test_oracles_are_texts():
    from trailmesh.llm import queries

    assert all(isinstance(v, str) for v in queries.ORACLE_SQL.values()) and set(queries.ORACLE_SQL) <= set(queries.QUERIES) and all(map(callable, queries.QUERIES.values()))
