"""The corpus pipeline, stage by stage against plain Python, and on odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm.support import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ("grumblak", "zorpomi", "vexnard")


def passage(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark; and the documents as Python rows."""
    rng = random.Random(11)
    item = passage(rng, 20)
    rows: list[tuple] = []
    for i in range(160):
        words = passage(rng, 60)
        if i % 5 == 0:
            words[10], words[30] = rng.choice(BAD), rng.choice(BAD)
        rows.append((i, " ".join(words), "en", f"src{i % 3}"))
    for i, of in ((200, 1), (201, 1), (202, 3)):  # exact copies and a near copy
        rows.append((i, rows[of][1] if i < 202 else rows[of][1] + " end", "en", "src0"))
    rows.append((210, " ".join([*passage(rng, 30), *item, *passage(rng, 30)]), "en", "src1"))
    rows.append((220, "write to jo.doe@mail.example.com or +44 20 7946 0958 " + " ".join(passage(rng, 20)), "en", "src2"))
    rows += [(230, None, None, None), (231, "", "en", "src1"), (232, "x", None, None), (None, " ".join(passage(rng, 12)), "en", None), (6, rows[6][1], "en", "src0")]
    rows.append((240, " ".join(passage(rng, 40_000)), "en", "src2"))
    docs = [(*r, len(r[1] or "")) for r in rows]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).write.parquet(str(folder / "documents.parquet"))
    labels = [(r[0], 1, int(any(b in r[1] for b in BAD))) for r in docs[:160]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), docs


def test_stages_against_plain_python(spark, tables):
    folder, docs = tables
    extra = [F.lit("mine").alias(c) for c in ("score", "candidates", "near_dropped", "mix_cut", "decontamination_name")]
    at = spark.read.parquet(f"{folder}/documents.parquet").select("*", *extra)
    columns = at.columns
    kept = list(docs)
    for name, stage in corpus_pipeline.STAGES:
        at = materialise(stage(spark, at, folder), "test")
        assert at.columns[: len(columns)] == columns and (name == "mixing" or at.columns == columns)
        got = at.collect()
        found = sorted(((r.doc_id, r.text) for r in got), key=str)
        if name == "toxicity":
            kept = [d for d in kept if not any(b in (d[1] or "") for b in BAD)]
        if name == "near_dedup":
            label = {i: i for i, d in enumerate(kept)}
            sets = [shingles(d[1]) for d in kept]
            for i in range(len(kept)):
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if kept[i][0] is not None and kept[j][0] is not None and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                        old, new = label[i], label[j]
                        label = {k: new if v == old else v for k, v in label.items()}
            groups: dict[int, list[int]] = {}
            for i, v in label.items():
                groups.setdefault(v, []).append(i)
            kept = [kept[min(own, key=lambda i: (kept[i][0] is None, kept[i][0] or 0))] for own in groups.values()]
        if name == "decontamination":
            items = [s for s in map(shingles, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]) if s]
            kept = [d for d in kept if not any(5 * len(s & shingles(d[1])) >= 4 * len(s) for s in items)]
        if name == "pii":
            kept = [(d[0], re.sub(r"\+44 20 7946 0958", "[PHONE]", re.sub(r"jo\.doe@mail\.example\.com", "[EMAIL]", d[1])) if d[1] else d[1], *d[2:]) for d in kept]
            assert all(r.n_chars == len(r.text or "") for r in got)
        if name == "mixing":
            by_id = {(d[0], d[1]) for d in kept}
            assert {(r.doc_id, r.text) for r in got} <= by_id and all(0 < r.taken <= 3 * r.size for r in got)
            for source in {r.source for r in got}:
                own = [r for r in got if r.source == source]
                assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=1.5)
        else:
            assert found == sorted(((d[0], d[1]) for d in kept), key=str), name
    assert {None, 230, 231, 240} & {d[0] for d in kept}


def test_empty_documents(spark, tables):
    folder, _ = tables
    at = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = materialise(stage(spark, at, folder), "test-empty")
        assert at.count() == 0
