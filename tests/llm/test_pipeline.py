"""The pipeline's stages on awkward rows: nulls, repeated rows, long texts, clashing columns and empty tables."""

import random
import re

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, key long, spans string, node long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tables(spark, path, rows, items, labels):
    spark.createDataFrame([(i, t, "en", "src", 0, 1, "s", 2) for i, t in rows], KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, key long").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def classes(texts):
    """Number of groups linked by five-word shingles at a similarity of 0.8 or more."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return len(set(group))


def test_stages_on_awkward_rows(spark, tmp_path):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["river", "Stone", "of", "the", "élan", "walks", "home,", "late."]) + str(rng.randint(0, 99)) for _ in range(n))
    good = [prose(rng.randint(40, 80)) for _ in range(12)]
    near = good[3].split(" ")
    near[20] = "changed"
    item = " ".join(f"bench{i} mark{i}" for i in range(8))
    rows = list(enumerate(good))
    rows += [(20, good[1].upper().translate(LOW)), (21, good[1]), (22, " ".join(near)), (23, f"{good[5]} {item} more"), (24, None), (25, ""), (None, good[7]), (None, None), (2, good[2]), (26, prose(20_000)), (27, "w" * 200_000)]
    tables(spark, tmp_path, rows, [(1, item, 0), (2, None, 0)], [(i, 1, 0) for i in range(28)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert out.columns == docs.columns
        docs, seen[name] = out, out.collect()
    text = {r: [x.text for x in seen[r]] for r in ("quality", "exact", "near", "benchmark")}
    assert len(seen["quality"]) == len(rows)
    folded = [(t or "").translate(LOW) for t in text["exact"]]
    assert len(folded) == len(set(folded)) == len({(t or "").translate(LOW) for _, t in rows})
    kept = {(t or "").translate(LOW): i for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))}
    assert {(r.text or "").translate(LOW): r.doc_id for r in seen["exact"]} == kept  # the largest number stays
    assert len(text["near"]) == classes(text["exact"])
    assert sum((t or "").startswith(good[3][:40]) for t in text["near"]) == 1
    assert all(item not in (t or "") for t in text["benchmark"]) and len(text["benchmark"]) == sum(item not in (t or "") for t in text["near"])
    assert len(seen["encode"]) == len(seen["benchmark"]) and sum(r.n_tokens > 0 for r in seen["encode"]) == sum(bool((t or "").strip()) for t in text["benchmark"])


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
