"""Operators without SQL against plain versions of what they compute."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language_id, near_dedup, pii, quality, spotsigs, toxicity, weak_labels, wordcols
from glyphmill.llm.wordcols import Words, text_buffer

TEXTS = [
    "The house of the tall man is on the hill and it was old.", "the the the", "", None, "Das Haus und der Garten von dem Mann", "¡Qué día! el año 2020 \U0001f600", "x" * 700_000 + " tail of a very long word",
    " ".join(f"w{i % 61} of the v{i % 17}" for i in range(3000)), "one\ttwo\nthree", "A B C D E F",
]


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_words_and_shingles_agree_with_plain_sets():
    words = Words.of(pa.array(TEXTS, pa.string()))
    plain = [words_of(t) for t in TEXTS]
    assert np.diff(words.first).tolist() == [len(p) for p in plain]
    seen: dict[bytes, int] = {}
    for h, w in zip(words.hash.tolist(), itertools.chain(*plain), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    values, offsets = words.shingle_sets()
    assert np.diff(offsets).tolist() == [len({tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))}) if p else 0 for p in plain]


def test_long_spans_hash_like_short_ones(monkeypatch):
    text = " ".join(f"word{i}" * (1 + i % 5) for i in range(200)) + " " + "y" * 3000
    whole = Words.of(pa.array([text])).hash
    monkeypatch.setattr(wordcols, "HASH_BYTES", 64)
    assert (Words.of(pa.array([text])).hash == whole).all()


def test_language_net_equals_naive_convolution():
    net = language_id.train(["the and of word " * 30, "der die das wort " * 30] * 40, ["en", "de"] * 40)
    texts = ["the word and der die", "x", "the of and " * 60]
    got = language_id.probabilities(net, *text_buffer(pa.array(texts)))
    for text, p in zip(texts, got, strict=True):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total, size = np.zeros(len(net.langs)), 0
        for at in range(0, len(raw), language_id.WINDOW):
            part = raw[at : at + language_id.WINDOW]
            x = net.embedding[list(part) + [0] * (language_id.WINDOW - len(part))]
            pooled = []
            for w, s in zip(net.filters, net.shift, strict=True):
                responses = [sum(x[t + j] @ w[j] for j in range(len(w))) for t in range(len(x) - len(w) + 1)]
                pooled.append(np.maximum(np.max(responses, axis=0) + s, 0))
            z = np.concatenate(pooled) @ net.dense + net.bias
            total += len(part) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            size += len(part)
        assert p == pytest.approx(total / size, abs=1e-4)


def test_languages_tie_goes_to_the_first_in_order(spark):
    n = language_id.FILTERS
    net = language_id.ByteConvNet(["aa", "bb"], np.zeros((256, 2), np.float32), [np.zeros((2, 2, n), np.float32)], [np.zeros(n, np.float32)], np.zeros((n, 2), np.float32), np.zeros(2, np.float32))
    got = language_id.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), net).collect()[0]
    assert (got.lang_pred, got.score) == ("aa", 0.5)


def plain_em(votes, prior, believed, rounds, strength):
    n, m = votes.shape
    table = {(j, v, y): believed[j, v, y] for j in range(m) for v in range(3) for y in (0, 1)}
    code = [[2 if v < 0 else v for v in row] for row in votes.tolist()]
    for _ in range(rounds):
        p = []
        for row in code:
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[j, v, 1] / table[j, v, 0]) for j, v in enumerate(row) if v < 2)
            p.append(1 / (1 + np.exp(-odds)))
        for j in range(m):
            for y in (0, 1):
                mass = [sum(q if y else 1 - q for q, row in zip(p, code, strict=True) if row[j] == v) for v in range(3)]
                alone = [mass[v] + strength * believed[j, v, y] for v in range(3)]
                cell = [mass[v] + (strength + 1.0) * alone[v] / sum(alone) for v in range(3)]
                for v in range(3):
                    table[j, v, y] = max(1e-4, cell[v] / sum(cell))
        prior = sum(p) / n
    return p


def test_label_model_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(weak_labels, "LINK", 9.0)
    rng = np.random.default_rng(0)
    truth = rng.random(400) < 0.3
    votes = np.stack([np.where(rng.random(400) < 0.3, -1, np.where(rng.random(400) < right, truth, ~truth)) for right in (0.9, 0.8, 0.7)], axis=1).astype(int)
    believed = weak_labels.labelled_beliefs(votes, truth.astype(int))
    model = weak_labels.fit_label_model(votes, 0.3, believed, rounds=6, strength=5.0)
    want = plain_em(votes, 0.3, believed, 7, 5.0)
    assert np.abs(model.posterior(votes) - want).max() < 0.02
    merged, number = np.unique(votes, axis=0, return_counts=True)
    again = weak_labels.fit_label_model(merged, 0.3, believed, rounds=6, strength=5.0, number=number)
    assert np.abs(again.posterior(votes) - model.posterior(votes)).max() < 1e-6


def test_copies_of_a_voter_count_once():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.4
    one, two, three = (np.where(rng.random(3000) < right, truth, ~truth).astype(int) for right in (0.7, 0.85, 0.8))
    copies = np.stack([one, one, one, one, two, three], axis=1)
    model = weak_labels.fit_label_model(copies, 0.4, weak_labels.labelled_beliefs(copies, truth.astype(int)), strength=1.0)
    assert sum(p >= 0 and p < 4 for p in model.parent[:4]) == 3
    alone = np.stack([one, two, three], axis=1)
    plain = weak_labels.fit_label_model(alone, 0.4, weak_labels.labelled_beliefs(alone, truth.astype(int)), strength=1.0)
    assert ((model.posterior(copies) > 0.5) == (plain.posterior(alone) > 0.5)).mean() > 0.95


def test_toxicity_features_equal_plain_prefixes():
    texts = ["Ärger über GRUMBLAK grumblak", "no", None, "réeuxment"]
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    got: dict[int, set] = {i: set() for i in range(len(texts))}
    for doc, value in toxicity.features(data, offsets):
        for d, v in zip(doc.tolist(), value.tolist(), strict=True):
            got[d].add(v)
    plain = [{(w, "run") for w in re.findall(r"[^\W\d_]+", (t or "").lower())} | {(w[:k], "prefix") for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for k in toxicity.PREFIXES if k < len(w)} for t in texts]
    assert [len(got[i]) for i in got] == [len(p) for p in plain]
    lexicon = toxicity.Lexicon.of(np.array([sorted(got[1])[0], next(iter(got[0]))], dtype=np.uint64), np.array([1, 2]))
    doc, feature = lexicon.known(toxicity.features(data, offsets))
    assert (1, 0) in set(zip(doc.tolist(), feature.tolist(), strict=True))


def test_scores_of_empty_texts(spark):
    model = toxicity.ToxicityModel.constant(-1.0)
    got = toxicity.score_texts(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string"), model).collect()
    assert {round(r.score, 9) for r in got} == {round(float(1 / (1 + np.exp(1.0))), 9)} and {r.predicted for r in got} == {0}


def test_quality_patterns_count_every_text(spark):
    texts = ["GOOD GRIEF THIS IS ALL SHOUTING " * 5, "a a a a a a a a a a a a a a a a a a a a a a a", "The house of the man is on the hill, and it was old. " * 4, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    said, number = quality.vote_patterns(docs)
    plain = quality.votes(*text_buffer(pa.array(texts, pa.string())))
    want: dict[tuple, int] = {}
    for row in plain.tolist():
        want[tuple(row)] = want.get(tuple(row), 0) + 3
    assert {tuple(r): n for r, n in zip(said[:, :-1].tolist(), number.tolist(), strict=True)} == want
    got = quality.score_texts(docs.withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)), quality.fit(docs))
    assert got.columns[-2:] == ["_score", "_kept"]


def plain_print(text):
    """Spots as tuples of words, with words and runs of bytes for short texts."""
    runs = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    hashes = {w: int(Words.of(pa.array([w])).hash[0]) for w in set(runs)}
    content = [i for i, w in enumerate(runs) if w not in spotsigs.ANCHORS]
    spots = set()
    for i, w in enumerate(runs):
        after = [j for j in content if j > i][: spotsigs.CHAIN]
        if (w in spotsigs.ANCHORS or hashes[w] % spotsigs.EVERY == 0) and len(after) == spotsigs.CHAIN:
            spots.add((w, *(runs[j] for j in after)))
    if not spots:
        spots = {tuple((runs[i + k] if i + k < len(runs) else None) for k in range(spotsigs.CHAIN + 1)) for i in range(len(runs))}
    kinds = [spots, {(w,) for w in runs} if len(runs) < spotsigs.SHORT_WORDS else set(), set()]
    raw = (text or "").encode()
    if len(runs) < spotsigs.TINY_WORDS and raw.strip():
        padded = raw + b"\0\0"
        kinds[2] = {padded[i : i + 3] for i in range(len(raw))}
    return len(runs), kinds


def plain_likeness(a, b):
    (m, x), (n, y) = plain_print(a), plain_print(b)
    longer = max(m, n)
    use = 1 if longer >= spotsigs.SHORT_WORDS else 2 if longer >= spotsigs.TINY_WORDS else 3
    left, right = ({(k, *v) if isinstance(v, tuple) else (k, v) for k in range(use) for v in own[k]} for own in (x, y))
    if not left and not right:
        return 1.0
    return len(left & right) / len(left | right)


def test_fingerprints_equal_plain_spots(spark):
    rng = np.random.default_rng(4)
    vocabulary = [*spotsigs.ANCHORS[:40], *(f"{a}{b}{c}" for a in ("ba", "lo", "mi") for b in ("na", "si", "to") for c in ("ra", "pe", "vu"))]
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 120, 60)] + ["", None, "ab cd", "ab cd ef", "12 34", "Ab, cd!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.edit_likeness(docs).collect()}
    exact = 0
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        for have, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            want = plain_likeness(text, other)
            exact += have == pytest.approx(want)
            assert have == pytest.approx(want) or (have == 0 and want <= spotsigs.FLOOR), (i, text, other)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (plain_print(text) == plain_print(edited))
    assert exact > len(texts)
    clash = spotsigs.fingerprint(docs.withColumn("fingerprint", F.lit("x")))
    assert clash.columns[-2:] == ["fingerprint", "_fingerprint"]


def test_forest_recall_against_all_pairs(spark):
    """Candidates of the forest alone, before anything exact: at least 0.9 of the true links, at regions of full depth."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 4000, 100)]
        for _ in range(3):
            own = list(base)
            for k in rng.integers(0, 100, int(rng.integers(0, 2))):
                own[k] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and sets[i] != sets[j]]
    got = near_dedup.near_components(docs).collect()
    component = {r.doc_id: r.component_id for r in got}
    assert len(links) > 60 and all(component[i] == component[j] for i, j in links)
    single = near_dedup.signatures(*Words.of(pa.array(texts)).shingle_sets()).reshape(len(texts), near_dedup.TREES, near_dedup.DEPTH)
    deepest = sum(bool((single[i] == single[j]).all(axis=1).any()) for i, j in links) / len(links)
    assert deepest >= 0.9


def test_rows_of_one_id_with_different_texts(spark):
    rng = np.random.default_rng(8)
    a, b = (" ".join(f"{p}{i}" for i in rng.integers(0, 999, 40)) for p in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, "alone in the world of texts today")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    odd = near_dedup.near_components(docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text"))
    assert odd.count() == 5 and odd.where("kept").count() == 5


def test_added_pii_spans(spark):
    text = "a card 4111111111111111 4111111111111111 mail jane(at)mail.example.com call +49 30 123456 4111111111111111 key = 'A1b2C3d4E5f6G7h8I9j0' x"
    docs = spark.createDataFrame([(1, text), (2, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: {(c.kind, text[c.start : c.end]) for c in r.c if not c.base} for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    plain = set()
    for kind, (_, pattern) in pii.EXTRA.items():
        plain |= {(kind, m[0]) for m in re.finditer(pattern.replace("(?i)", "").replace("++", "+").replace("}+", "}"), text, re.I if kind == 0 else 0)}
    assert {(0, "jane(at)mail.example.com"), (4, "A1b2C3d4E5f6G7h8I9j0")} <= got[1] and {x for x in got[1] if x[0] in (0, 4)} == {x for x in plain if x[0] in (0, 4)} and not got[2]
    shown = pii.redact(docs.withColumn("candidates", F.lit("mine"))).orderBy("doc_id").collect()
    assert shown[0].candidates == "mine" and shown[1].text == "plain words only" and "jane" not in shown[0].text and "A1b2" not in shown[0].text
