"""Personal data by candidate gradient boosting, Spark SQL functions only.

High-recall generators propose overlapping spans. Every candidate becomes a small
vector of binned format and context features, so the exact training table, counts
per feature vector over the whole corpus, has at most ``MAX_VECTORS`` rows whatever
the input. Boosted depth-2 trees are fitted on the driver to the counts of one half of the texts and applied as SQL
expressions; the threshold of each kind is calibrated on the other half, where candidates of equal score pass or fail together.
Weak labels are the validation rules of the formats; numbers and mail-like forms have none, so
theirs are the values that occur validated elsewhere in the corpus, and cue words before
the candidate. Redactions are all validated spans and all other candidates above the
threshold of their kind that do not lie within a validated base span.

Defined cases: null text is empty and has no spans; without any candidate no tree is
fitted; repeated rows get the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.llm.lineage import checkpointed
from trailmesh.llm.spans import Kind, candidate_rows, located, same_row, span_string

#: Possessive groups keep Java's matcher from recursing on very long texts.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", hint="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", hint=r"[0-9][\x20-]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    Kind("number", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    Kind("mailish", r"[A-Za-z0-9._-]{2,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,63}\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}", hint=r"[(\[]at[)\]]"),
]
N_BASE, CONTEXT = 4, 24
PHONE_CUE = r"(?i)(?<![a-z])(?:tele?|phone|telephone|call|fax|mobile|cell|dial|sms|whatsapp)(?![a-z])[^a-z0-9]*(?:(?:me|us|at|on|no|number|is)(?![a-z])[^a-z0-9]*){0,2}$"
MAIL_CUE = r"(?i)(?<![a-z])(?:e-?mail|mail|write|contact|reach)(?![a-z])[^a-z0-9]*(?:(?:me|us|at|to|is|address)(?![a-z])[^a-z0-9]*){0,2}$"
FEATURES = {"rank": len(KINDS), "digits": 6, "length": 6, "groups": 4, "signs": 4, "left": 4, "valid_shape": 2, "cue": 3, "before": 3, "after": 3}
MAX_VECTORS = math.prod(FEATURES.values())


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda a, d: a + d
    )
    return total % 10 == 0


def _valid(digits: Column) -> Column:
    parts = F.split("match", r"\.")
    small = F.forall(parts, lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.length(F.ltrim(p, F.lit("0"))) <= 0))
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", F.length(digits).between(14, 19) & luhn(F.when(F.length(digits) <= 19, digits).otherwise("1")))
        .when(F.col("kind") == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def _bin(c: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for k, cut in enumerate(cuts):
        out = F.when(c >= cut, k + 1).otherwise(out)
    return out


def _side(c: Column, letter: str) -> Column:
    """0 nothing, 1 no letter or digit, 2 a letter or digit next to the candidate."""
    return F.when(F.length(c) == 0, 0).when(c.rlike(letter), 2).otherwise(1)


def labelled(found: DataFrame) -> DataFrame:
    """Candidates with ``label``: valid, or for kinds without a rule a cue word or a value that is validated elsewhere."""
    known = found.filter(F.col("valid") & F.col("plain").isNotNull()).select("plain", F.lit(True).alias("known")).distinct()
    cue = (F.col("kind") == "number") & (F.col("cue") == 1) | (F.col("kind") == "mailish") & (F.col("cue") == 2)
    return found.join(known, "plain", "left").withColumn("label", F.col("valid") | cue | (F.col("rank") >= N_BASE) & F.coalesce("known", F.lit(False)))


def candidates(rows: DataFrame) -> DataFrame:
    """Located candidates with their binned features, ``valid`` and ``plain``, the value that is compared with validated ones."""
    c = located(rows, KINDS)
    digits = F.regexp_replace("match", "[^0-9]", "")
    c = c.withColumn("_digits", digits)
    signs = F.length(F.regexp_replace("match", r"[0-9A-Za-z\x20]", ""))
    return c.select(
        "doc_id", "_key", "kind", "start", "end", "rank",
        _bin(F.length("_digits"), [2, 4, 10, 14, 20]).alias("digits"),
        _bin(F.length("match"), [5, 8, 12, 16, 24]).alias("length"),
        _bin(F.size(F.split("match", r"[\x20.-]+")), [2, 3, 5]).alias("groups"),
        _bin(signs, [1, 2, 4]).alias("signs"),
        _bin(F.col("start"), [1, 200, 2000]).alias("left"),
        F.when((F.col("kind") == "email") & F.col("match").rlike(r"\.[A-Za-z]{2,24}$") | (F.col("kind") == "ip") & F.col("match").rlike(r"^[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}$") | (F.col("kind") == "phone") & F.col("match").rlike(r"\([0-9]{3}\)") | F.col("kind").isin("number", "mailish") | (F.col("kind") == "card") & F.col("match").rlike("^[0-9]{15,16}$"), 1).otherwise(0).alias("valid_shape"),
        F.when(F.col("before").rlike(PHONE_CUE), 1).when(F.col("before").rlike(MAIL_CUE), 2).otherwise(0).alias("cue"),
        _side(F.col("before"), "[A-Za-z0-9]$").alias("before"),
        _side(F.col("after"), "^[A-Za-z0-9]").alias("after"),
        _valid(F.col("_digits")).alias("valid"),
        F.when(F.col("kind").isin("phone", "number"), F.right("_digits", F.lit(10)))
        .when(F.col("kind") == "email", F.lower("match"))
        .when(F.col("kind") == "mailish", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("match"), r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", "."), r"\x20", ""))
        .alias("plain"),
    )


def fit_trees(table: list[tuple[tuple[int, ...], float, float]], rounds: int = 12, rate: float = 0.4) -> list:
    """Newton boosting of depth-2 trees on (features, weight of 0, weight of 1) rows."""
    names = list(FEATURES)[: len(table[0][0])]
    score = [0.0] * len(table)
    trees = []
    for _ in range(rounds):
        grad = []
        for (x, w0, w1), s in zip(table, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            grad.append((w1 * (1 - p) - w0 * p, (w0 + w1) * p * (1 - p)))

        def best(rows: list[int]) -> tuple[float, tuple[int, int] | None]:
            g, h = sum(grad[i][0] for i in rows), sum(grad[i][1] for i in rows)
            top, at = 1e-6, None
            for f, cut in ((f, c) for f, n in enumerate(names) for c in range(1, FEATURES[n])):
                a = [i for i in rows if table[i][0][f] < cut]
                ga, ha = sum(grad[i][0] for i in a), sum(grad[i][1] for i in a)
                gain = ga**2 / (ha + 1) + (g - ga) ** 2 / (h - ha + 1) - g**2 / (h + 1)
                if gain > top:
                    top, at = gain, (f, cut)
            return top, at

        def grow(rows: list[int], depth: int) -> tuple:
            at = best(rows)[1] if depth and rows else None
            if at is None:
                g, h = sum(grad[i][0] for i in rows), sum(grad[i][1] for i in rows)
                value = rate * g / (h + 1)
                for i in rows:
                    score[i] += value
                return (value,)
            f, cut = at
            return f, cut, grow([i for i in rows if table[i][0][f] < cut], depth - 1), grow([i for i in rows if table[i][0][f] >= cut], depth - 1)

        trees.append(grow(list(range(len(table))), 2))
    return trees


def _value(tree: tuple, x: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[0]


def _column(tree: tuple) -> Column:
    if len(tree) == 1:
        return F.lit(float(tree[0]))
    return F.when(F.col(list(FEATURES)[tree[0]]) < tree[1], _column(tree[2])).otherwise(_column(tree[3]))


def calibrate(table: list, trees: list, precision: float) -> dict[int, float]:
    """For each kind the lowest score from which on at least ``precision`` of the weight is valid."""
    out = {}
    for rank in range(len(KINDS)):
        blocks: dict[float, list[float]] = {}
        for x, w0, w1 in table:
            if x[0] == rank:
                block = blocks.setdefault(round(sum(_value(t, x) for t in trees), 9), [0.0, 0.0])
                block[0], block[1] = block[0] + w0, block[1] + w1
        bad = good = 0.0
        out[rank] = math.inf
        for s in sorted(blocks, reverse=True):
            bad, good = bad + blocks[s][0], good + blocks[s][1]
            if good and good / (good + bad) >= precision:
                out[rank] = s
    return out


def scan_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = 0.98) -> DataFrame:
    """One row per input row: doc_id and spans (start, rank, end, kind, score)."""
    rows = checkpointed(candidate_rows(docs, KINDS, doc_id, text, context=CONTEXT))
    found = checkpointed(candidates(rows))
    half = F.pmod(F.xxhash64("doc_id", "_key"), F.lit(2)).alias("half")
    counted = labelled(found).groupBy(*FEATURES, half).agg(F.sum((~F.col("label")).cast("int")).alias("w0"), F.sum(F.col("label").cast("int")).alias("w1"))
    table = sorted((r["half"], tuple(r[n] for n in FEATURES), float(r["w0"]), float(r["w1"])) for r in counted.collect())  # twice MAX_VECTORS rows at most
    one, other = ([r[1:] for r in table if r[0] == h] for h in (0, 1))
    trees = fit_trees(one or other) if table else []
    # The half that was not fitted decides; the other one may only raise a threshold.
    held, own = calibrate(other or one, trees, precision), calibrate(one or other, trees, precision)
    cuts = {rank: max(held[rank], own[rank]) for rank in held}
    score = F.lit(0.0)
    for tree in trees:
        score = score + _column(tree)
    limit = F.lit(None).cast("double")
    for rank, cut in cuts.items():
        if math.isfinite(cut):
            limit = F.when(F.col("rank") == rank, F.lit(cut)).otherwise(limit)
    picked = found.withColumn("score", score).filter(F.col("valid") | (F.col("score") >= limit - 1e-9))
    # The furthest end of the validated base spans that begin no later.
    so_far = W.partitionBy("doc_id", "_key").orderBy("start", F.desc("end"), F.desc("valid")).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("valid") & (F.col("rank") < N_BASE), F.col("end"))).over(so_far)
    picked = picked.withColumn("reach", reach).filter(F.col("valid") | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    per_doc = picked.groupBy("doc_id", "_key").agg(
        F.collect_list(F.struct("start", "rank", "end", "kind", "valid", (1 / (1 + F.exp(-F.col("score")))).alias("score"))).alias("spans")
    )
    empty = F.array().cast(per_doc.schema["spans"].dataType)
    out = rows.alias("r").join(per_doc.alias("p"), same_row("r", "p"), "left")
    return out.select("r.doc_id", F.coalesce(F.array_sort("p.spans"), empty).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with all (possibly overlapping) spans replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).cast("long").alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    return done


def _valid_of(kind: str):
    return lambda s: s["valid"] & (s["kind"] == kind)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = scan_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["valid"] & (s["rank"] < N_BASE))
    # A candidate that fails its base rule may be redacted too, but is no base span: it is listed as "maybe".
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.when(s["valid"] | (s["rank"] >= N_BASE), s["kind"]).otherwise(F.concat(F.lit("maybe_"), s["kind"])).alias("kind")))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _valid_of(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS[:N_BASE]],
        F.sha2(span_string(base), 256).alias("base_sha256"),
        span_string(named).alias("spans"),
    )
