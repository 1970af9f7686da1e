"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, language_id, lm_scoring, mixing, near_dedup, pii, quality, spotsigs, tool_links, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of the {i}" for i in range(20000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "b", 57), (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57), (3, None, None, None, None), (4, "", "en", "b", 0),
    (5, "   \n\t ", None, "b", 6), (6, LONG, "en", "a", len(LONG)), (None, "no id here at all my friend", "en", None, 27), (7, "12345 678", "de", "c", 9), (7, "12345 678", "de", "c", 9), (8, "Über ärger éé 😀", "de", "c", 15),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_language_id(docs, none):
    net = language_id.train(["the and of word " * 30, "der die das wort " * 30] * 80, ["en", "de"] * 80)
    wide = docs.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = language_id.identify(wide, net)
    assert got.columns[-2:] == ["_lang_pred", "_score"] and got.count() == len(ROWS)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3]._lang_pred == by[4]._lang_pred == by[7]._lang_pred == "und" and by[3]._score == 0 and by[6]._lang_pred == "en"
    assert language_id.identify(none, net).count() == 0 and language_id.fit(none, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_quality(docs, none):
    model = quality.fit(docs)
    got = {r.doc_id: r.score for r in quality.score_texts(docs, model).collect()}
    assert got[3] == got[4] == got[5] == 0.0 and got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert quality.score_texts(none, quality.fit(none)).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 1), (99, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score_texts(docs.withColumn("score", F.lit(0)), model)
    assert "_score" in got.columns and got.count() == len(ROWS)
    assert toxicity.score_texts(none, toxicity.fit(none, labels.where("false"), F.lit(True))).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_learns_words_and_prefixes(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re") for b in ("na", "si", "to", "vu")]
    text = lambda bad: " ".join([*rng.choice(words, 30), *(["grumblak", "zorpo" + rng.choice(words)][int(rng.integers(2))] for _ in range(bad))])
    rows = [(i, text(1 if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert sum(got[i] == y for i, _, y in rows if i >= 400) >= 198


def test_mixing(docs, none):
    got = mixing.mix(docs.withColumn("size", F.lit("x")))
    assert "_size" in got.columns
    rows = got.collect()
    assert len(rows) == len(ROWS)
    total = sum(r._size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=len(own)) and all(r.taken <= 3 * r._size and r.target <= 3 * r.source_size + 1e-9 for r in own)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "quick brown FOX jumps over the lazy dog"), (2, None), (3, ""), (4, "12345 678"), (5, "quick brown fox jumps over the lazy dog"), (None, "the lazy dog and runs")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.containment) for r in decontamination.contained_items(docs, items).collect())
    assert got == [(1, 1, 1.0), (1, 5, 1.0), (2, 1, 1.0), (2, 5, 1.0), (7, 4, 1.0)]
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontamination.contained_items(none, items).count() == 0 and decontamination.contained_items(docs, items.where("false")).count() == 0


def test_decontamination_finds_every_item_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    docs, items = [], []
    for i in range(60):
        item = list(rng.choice(words, int(rng.integers(5, 60)), replace=False))
        items.append((i, " ".join(item)))
        cut = list(item)
        if len(cut) > 24:
            cut[-int(rng.integers(1, 3))] = "changed"
        docs.append((i, " ".join([*rng.choice(words, 50), *cut, *rng.choice(words, 50)])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sets = lambda t: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(max(1, len(w) - 4))}
    want = {(i, k) for i, t in docs for k, u in items if 5 * len(sets(t) & sets(u)) >= 4 * len(sets(u))}
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(d, b).collect()} == want and len(want) >= 40


def test_fingerprints(docs, none):
    got = spotsigs.edit_likeness(docs).collect()
    assert len(got) == len(ROWS)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        assert any(g.doc_id == r[0] and g.n_chars == len(text) and g.edited_sha256 == sha for g in got), r
    prints = {g.doc_id: g.fingerprint for g in got}
    assert prints[1] == prints[2] and prints[4] == "" and prints[7] != "" and all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert spotsigs.edit_likeness(none).count() == 0
    one = spotsigs.edit_likeness(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_pruned_jaccard_agrees_above_the_floor():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(2))
        full, cut = spotsigs.pruned_jaccard(a, b), spotsigs.pruned_jaccard(a, b, 0.5)
        assert cut == full if full >= 0.5 else cut in (0.0, full)


def test_near_dedup(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs).collect()}
    assert {(1, 8, 1, True), (2, 8, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 7, True), (None, 3, None, True)} <= got
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert near_dedup.near_components(none).count() == 0 and near_dedup.dedup(none).count() == 0


def test_near_dedup_large_group_is_exact(spark, monkeypatch):
    """Regions and blocks far smaller than the group of near copies: every adaptive step runs."""
    monkeypatch.setattr(near_dedup, "REGION", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for i in range(150):
        own = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 4))):
            own[k] = f"x{i}"
        texts.append(" ".join(own))
    texts += [" ".join(f"v{j}" for j in rng.integers(0, 5000, 80)) for _ in range(50)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got[i] for i in range(len(texts))] == label


def test_lm(docs, none):
    held = docs.withColumn("held_out", F.col("doc_id") == 2)
    model = lm_scoring.train(docs.where("doc_id <> 2"))
    got = lm_scoring.score(held, model).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts: dict = {}
    for r in ROWS:
        if r[0] is not None and r[0] != 2:
            for w in [*words(r[1]), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in ROWS}
    for r in got:
        want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words(text[r.doc_id]), None])
        assert r.base_score == pytest.approx(want) and r.train_tokens == n and np.isfinite(r.score)
    empty = lm_scoring.train(none)
    assert lm_scoring.score(held, empty).count() == len(ROWS) and lm_scoring.score(held.where("false"), model).count() == 0


def test_lm_scores_use_every_ngram(spark):
    """Scores equal brute-force interpolated discounting over all pairs and triples, rare words and singletons included."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 20000) for _ in range(300)]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.train(docs.where("NOT held_out"))).collect()}
    grams: list[dict] = [{}, {}, {}, {}]
    for _, t, held in rows:
        w = (*t.split(), None)
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if not held:
                    grams[n][w[i : i + n]] = grams[n].get(w[i : i + n], 0) + 1
    after: dict = {}
    for n in (2, 3):
        for g in grams[n]:
            after[g[:-1]] = after.get(g[:-1], 0) + 1
    total = sum(grams[1].values()) + len(grams[1]) + 1
    d = {n: (sum(c == 1 for c in grams[n].values()) + 1) / (sum(c == 1 for c in grams[n].values()) + 2 * sum(c == 2 for c in grams[n].values()) + 2) for n in (2, 3)}
    for i, t, _ in rows:
        w, want = (*t.split(), None), 0.0
        for j in range(len(w)):
            p = (grams[1].get(w[j : j + 1], 0) + 1) / total
            for n in (2, 3):
                h = w[j - n + 1 : j]
                if j >= n - 1 and grams[n - 1].get(h):
                    p = (max(grams[n].get((*h, w[j]), 0) - d[n], 0) + d[n] * after.get(h, 0) * p) / grams[n - 1][h]
            want += np.log10(p)
        assert got[i].score == pytest.approx(want), i


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (1000, 5000), (5000, 10**9), (300, 300)):
        values = np.sort(rng.choice(universe, min(n, universe), replace=False)) if n else np.zeros(0, dtype=int)
        code = lm_scoring.EliasFano.of(values, universe)
        assert (code.get(np.arange(len(values))) == values).all()
        asked = np.unique(np.concatenate([values, rng.integers(0, universe, 300)]))
        where = {int(x): i for i, x in enumerate(values)}
        assert code.find(asked).tolist() == [where.get(int(x), -1) for x in asked]


def test_elias_fano_misses_values_beyond_the_last():
    """A few searches, which select zero bits, beyond the last bucket, whose zero bits fill the sample for some sizes."""
    random = np.random.default_rng(5)
    for n in range(1, 200):
        values = np.unique(random.integers(0, n * 100, n))
        code = lm_scoring.EliasFano.of(values, int(values[-1]) + 1)
        asked = np.concatenate([values, values[-1] + np.array([1, 100, 10_000, 1 << 61])])
        assert code.find(asked).tolist() == [*range(len(values)), -1, -1, -1, -1]
        many = np.resize(asked, code.MANY)
        assert lm_scoring.EliasFano.of(values, int(values[-1]) + 1).find(many).tolist() == np.resize(code.find(asked), code.MANY).tolist()


def test_lm_shards_answer_from_a_mapped_trie(monkeypatch):
    """A shard's counts come from Elias-Fano levels that are mapped and searched, also where batches ask for unknown pairs."""
    rng = np.random.default_rng(2)
    plan, last = lm_scoring.Plan(1, 1), lm_scoring._LAST
    mapped, mapping = [], lm_scoring._mapped
    monkeypatch.setattr(lm_scoring, "_mapped", lambda raw: mapped.append(mapping(raw)) or mapped[-1])
    rows, sums, under = [], {}, {}
    for batch in range(6):
        keys = np.unique(rng.integers(0, 3000, 800)) << 40
        counts = rng.integers(0, 400, len(keys)) * (rng.random(len(keys)) < 0.6)
        lead = np.sort(rng.integers(0, len(keys), 900))
        lead = lead[counts[lead] > 0]
        triples = np.unique((lead << last) | rng.integers(0, 20, len(lead)))
        times = rng.integers(0, 3, len(triples))
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            sums[k] = sums.get(k, 0) + c
        for t, c in zip(triples.tolist(), times.tolist(), strict=True):
            at = int(keys[t >> last]), t & ((1 << last) - 1)
            under[at] = under.get(at, 0) + c
        wire = (lm_scoring._coded(keys), lm_scoring._bytes(counts), lm_scoring._coded(np.array([1])), lm_scoring._bytes(np.zeros(len(keys), dtype=np.int64)), lm_scoring._coded(triples), lm_scoring._bytes(times))
        rows.append((keys, triples, (0, batch, batch < 4, *wire)))
    got = lm_scoring._settle(plan)(lm_scoring._as_table(lm_scoring._WIRE, [r[2] for r in rows])).to_pylist()
    answers = {r["place"]: r for r in got if r["kind"] == "answer"}
    assert sorted(answers) == [0, 1, 2, 3]
    for batch, a in answers.items():
        keys, triples, _ = rows[batch]
        assert lm_scoring._numbers(a["first"]).tolist() == [sums[k] for k in keys.tolist()]
        assert lm_scoring._numbers(a["second"]).tolist() == [sum(c > 0 for (pair, _), c in under.items() if pair == k) for k in keys.tolist()]
        assert lm_scoring._numbers(a["third"]).tolist() == [under[int(keys[t >> last]), t & ((1 << last) - 1)] for t in triples.tolist()]
    ones = next(r for r in got if r["kind"] == "sums")
    assert [ones[x] for x in ("n1", "n2", "m1", "m2")] == [sum(c == k for c in of.values()) for of in (sums, under) for k in (1, 2)]
    assert len(mapped) == 1
    trie = lm_scoring.ShardTrie(mapped[0])
    assert trie.levels[0].n == sum(c > 0 for c in sums.values()) and trie.levels[2].n == sum(c > 0 for c in under.values())
    assert trie.codes[1].dtype == np.uint8 and trie.codes[0].dtype == np.uint16
    asked = np.array(sorted(sums) * 3)
    assert trie.levels[0].find(asked).tolist() == [trie.levels[0].find(asked[i : i + 1])[0] for i in range(len(asked))]


def test_lm_batches_of_megabytes_get_small_row_groups(spark, monkeypatch):
    """Readers and writers hold a row group in several copies, so it may not be all the wide rows of a file."""
    tables, real = [], lm_scoring.materialise

    def first(df, *more):
        tables.append(real(df, *more))
        raise StopIteration

    monkeypatch.setattr(lm_scoring, "materialise", first)
    text = " ".join(map(str, np.random.default_rng(3).integers(0, 10**9, 3 * lm_scoring.BATCH - 10).tolist()))
    with pytest.raises(StopIteration):
        lm_scoring.score_all(spark.createDataFrame([(1, False, True, True, text)], "doc_id long, held_out boolean, train boolean, asked boolean, text string").coalesce(1))
    about = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables[0].inputFiles()]
    groups = [m.row_group(i).num_rows for m in about for i in range(m.num_row_groups)]
    assert groups == [1, 1, 1]


def test_trie_probabilities_sum_to_one():
    counts = np.array([50, 30, 20, 10], dtype=np.int64)
    hashes = np.array([7, 3, 9, 5], dtype=np.uint64)
    pairs, pair_counts = np.array([1, 2, 4 + 2, 8 + 3]), np.array([20, 5, 9, 4])
    trie = lm_scoring.Trie.map_bytes(lm_scoring.Trie.build(hashes, counts, pairs, pair_counts, np.array([1 * 4 + 2]), np.array([3]), 4).to_bytes())
    base = counts / counts.sum()
    for before in range(4):
        ids = np.arange(4)
        prev = np.full(4, before)
        extra, mass = trie.probability(ids, np.full(4, -1), trie.pair_at(prev, ids, 4), prev, base, 4)
        assert (extra + mass * base).sum() == pytest.approx(1, abs=0.02)


PII = "mail jo.doe@mail.example.com or a@b.c_d@e.f, host 10.0.0.256 and 192.168.1.20 card 4111 1111 1111 1111, bad 4111111111111112; +1 (212) 555-0100 4111111111111111 ☎ +44 20 7946 0958. token = \"0123456789abcdef0123456789abcdef01234567\""


def test_pii(spark, none):
    cases = [(1, PII), (2, None), (3, ""), (4, "x" * 200_000), (5, "1" * 100_000), (6, "a@b" + ".c" * 20_000), (7, "+" + "1 " * 30_000), (1, PII)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    found = df.select("doc_id", "text", pii.candidates(F.col("text")).alias("c"))
    out = found.withColumn("s", pii.spans(F.col("c"), pii.fit(found, "c"))).select("doc_id", "text", pii.written(F.filter("s", lambda s: s["base"])).alias("base"), pii.written(F.col("s")).alias("all")).collect()
    for r in out:
        assert r.base == brute_force(r.text or ""), r.doc_id
        assert set(r.base.split(",")) <= set(r.all.split(",")) or not r.base
    got = pii.redact(spark.createDataFrame([(1, PII, 5), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert "jo.doe" not in got[0].text and "4111 1111" not in got[0].text and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2].text == "clean"
    assert pii.redact(none).count() == 0


def test_pii_finds_prefixed_and_long_secrets(spark):
    secrets = ["ghp_" + "aB3dE6gH9j" * 3, "sk-" + "a1B2c3D4e5" * 3, "xoxb-12345-" + "Ab9" * 8, "ab+/" + "Cd3_" * 7, "0123456789abcdef" * 12]
    df = spark.createDataFrame([(i, f'token = "{x}" end') for i, x in enumerate(secrets)], "doc_id long, text string")
    for r in df.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect():
        assert [(c.start, c.end) for c in r.c if c.kind == 4] == [(9, 9 + len(secrets[r.doc_id]))], r.doc_id
    got = pii.redact(df).orderBy("doc_id").collect()
    assert not [r.text for r, x in zip(got, secrets, strict=True) if x in r.text]


def brute_force(text: str) -> str:
    def luhn(s: str) -> bool:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    if "@" not in text:
        rules = rules[1:]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0]))


def test_tool_links(spark):
    calls = spark.createDataFrame(
        [("c", "a", 0, "answer", '{"turn": 1, "text": "x"}', []), ("c", "b", 1, "answer", '{"text": 5}', ["a"]), ("c", "d", 2, "other", "not json", ["b", "a", "zz"]), ("c", "p", 3, "other", "{}", ["q"]), ("c", "q", 4, "other", "{}", ["p"]), ("c", "a", 9, "answer", "{}", []), (None, "n", 1, "x", "{}", [])],
        "conv_id string, call_id string, position long, name string, arguments string, parents array<string>",
    )
    results = spark.createDataFrame([("c", "a", 5, "later"), ("c", "a", 1, "first"), ("c", "zz", 1, "lost"), (None, "a", 0, "x")], "conv_id string, call_id string, position long, content string")
    got = {r.call_id: r for r in tool_links.link_calls(calls, results, tool_links.CHAT_TOOLS).collect()}
    assert set(got) == {"a", "b", "d", "p", "q"} and [got[k].level for k in "abdpq"] == [0, 1, 2, -1, -1]
    assert got["a"].json == '{"arguments":{"text":"x","turn":1},"id":"a","name":"answer","result":"first"}' and got["a"].valid
    assert got["b"].errors == "text is no string; missing turn" and "unknown parent" in got["d"].errors and "not an object" in got["d"].errors and "cycle" in got["p"].errors
    assert tool_links.link_calls(calls.where("false"), results, {}).count() == 0
