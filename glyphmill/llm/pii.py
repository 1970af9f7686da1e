"""PII by weak supervision [native].

Candidates are all matches of one broad pattern per kind, those that fail the base
rules included, and of narrower extra patterns that find a value inside a failed match
(a card number that follows another, a phone number glued to a card number, an
obfuscated address, a secret in an assignment). Five labelers vote on each candidate:

* ``regex``: the text has a canonical form of its kind,
* ``checksum``: Luhn digit, octet limits, digit counts, mixed characters,
* ``gazetteer``: known top-level domain, issuer digit, country code, public first octet,
* ``context``: a keyword stands shortly before it (abstains otherwise),
* ``boundary``: it is not a part of a longer run.

Expectation-maximisation over the counts of vote patterns (at most 3^5 per kind, the
only rows that reach the driver) estimates each labeler's reliability per kind, and the
posterior labels train a logistic span classifier on the same votes. Spans of the base
rules always stay; the classifier decides on every other candidate.

All text work is one narrow scan: matches come from ``split`` and ``regexp_extract_all``
(gaps and match lengths give code-point positions), behind cheap guards, and nothing is
shuffled but pattern counts. Patterns use possessive quantifiers and ``\\G``, characters
are looked up in pieces of ``PIECE``, and running sums and maxima are taken in blocks of
about sqrt(matches) (``running``), so a text of n matches costs about n * sqrt(n) at most.

Defined results: null and empty texts have no spans (counts 0, SHA-256 of the empty
text); ``redact`` leaves them as they are; repeated rows are treated alike; an empty
table gives an empty result and a model of the priors; clashing added columns get a
leading underscore.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import fresh, materialise

KINDS = ("email", "ip", "card", "phone", "secret")
VOTERS = ("regex", "checksum", "gazetteer", "context", "boundary")
BASE_KINDS = 4
ACCEPT = 0.5
#: Characters of a piece of text in which neighbours of a match are looked up.
PIECE = 2048

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Matches of these before the base rules drop some, leftmost and non-overlapping.
BROAD = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[ -]?+[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: Cheap conditions without which a text has no match.
_GUARD = ("@", r"[0-9]\.[0-9]", r"[0-9][0-9 -]{14}", "+")
#: Extra candidates by kind: a guard and a pattern.
EXTRA = {
    0: (r"(?i)(?:\(at\)|\[at\]|\{at\})", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+)++"),
    2: (r"[0-9]{4}[ -]?[0-9]{4}", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    3: (r"[0-9]{3}[ .-][0-9]{4}", r"(?:\+[0-9]{1,3}[ .-]?|(?<![0-9+]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    4: (r"[=:] ?[\"'`]?[A-Za-z0-9_+/-]{16}", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"),
}
_STRICT = (
    rf"^[A-Za-z0-9]{_LOCAL}*+(?<![.])@{_LABEL}++(?:\.{_LABEL}++)*+(?<=\.[A-Za-z]{{2,18}})$",
    r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?)$",
    r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    r"^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|[A-Za-z0-9_+/-]{20,}+)$",
)
#: Words that announce a kind, and known endings, first digits and codes.
_CONTEXT = (
    "(?i)(?:mail|contact|write to|address|@)",
    "(?i)(?:\\bip\\b|host|server|addr|client)",
    "(?i)(?:card|visa|master|amex|payment|cc)",
    "(?i)(?:phone|\\btel|call|mobile|fax|cell)",
    "(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|\\bkey|bearer) ?[=:]+ ?[\"'`]?$",
)
_TLD = r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|eu|ch|at|nl)$"
_COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


@dataclass
class SpanModel:
    """Reliabilities by (kind, voter, vote, label) and the classifier's weights by ``kind:voter:vote``."""

    reliability: dict[tuple[int, int, str, int], float]
    prior: dict[int, float]
    weights: dict[str, float]
    bias: dict[int, float]


def _letting(value: Column, use) -> Column:
    """Names an expression, so that several uses evaluate it once."""
    return F.transform(F.array(value), use).getItem(0)


def running(items: Column, combine, zero: Column) -> Column:
    """For each element of an array, ``combine`` over those before it; ``combine`` is associative with ``zero``."""

    def fold(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocked(values: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(values))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(values), step), lambda at: F.slice(values, at, step))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda block: F.aggregate(block, zero, combine))
            return _letting(fold(totals, zero), lambda starts: F.flatten(F.transform(blocks, lambda block, i: fold(block, F.get(starts, i)))))

        return _letting(parts, joined)

    return _letting(items, lambda values: F.when(F.size(values) > 0, blocked(values)).otherwise(F.array().cast("array<int>")))


def in_pieces(text: Column) -> Column:
    """The text cut into pieces of ``PIECE`` characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0))


def cut_out(pieces: Column, start: Column, length: Column) -> Column:
    """Characters of a text in pieces; costs its length and two pieces, wherever it starts."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((start + length) / PIECE).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), start - first * PIECE + 1, length)


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches, in code points, end exclusive."""
    gaps, found = F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(b: Column) -> Column:
        steps = F.transform(b["found"], lambda w, i: F.get(b["gaps"], i) + F.length(w))
        spans = lambda before: F.transform(b["found"], lambda w, i: F.struct((F.get(before, i) + F.get(b["gaps"], i)).alias("start"), (F.get(before, i) + F.get(b["gaps"], i) + F.length(w)).alias("end"), w.alias("text")))
        return _letting(running(steps, lambda a, x: a + x, F.lit(0)), spans)

    return _letting(F.struct(gaps.alias("gaps"), found.alias("found")), place)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _checksum(kind: int, text: Column) -> Column:
    if kind == 0:
        return F.instr(text, "@").between(2, 65) | (F.instr(text, "@") == 0)
    if kind == 1:
        return F.forall(F.split(text, r"\."), lambda p: _letting(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= F.lit("255")))))
    if kind == 2:
        return _letting(_digits(text), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == 3:
        return F.length(_digits(text)).between(8, 15)
    return text.rlike("[0-9]") & text.rlike("[A-Za-z]")


def _gazetteer(kind: int, text: Column) -> Column:
    yes, no, silent = F.lit("1"), F.lit("0"), F.lit("-")
    if kind == 0:
        return F.when(text.rlike(_TLD), yes).otherwise(no)
    if kind == 1:
        return F.when(text.rlike(r"^(?:0|127|255)\."), no).otherwise(yes)
    if kind == 2:
        return F.when(text.rlike("^[3-6]"), yes).otherwise(silent)
    if kind == 3:
        return F.when(text.rlike(_COUNTRY), yes).otherwise(silent)
    return F.when(text.rlike("^(?:ghp_|sk-|AKIA|xox)"), yes).otherwise(silent)


def _vote(condition: Column, otherwise: str = "0") -> Column:
    return F.when(condition, "1").otherwise(otherwise)


def _candidate(kind: int, pieces: Column, m: Column, is_base: bool) -> Column:
    """One candidate with its votes as a string of ``1``, ``0`` and ``-`` (abstains)."""
    before = cut_out(pieces, F.greatest(m["start"] - 24, F.lit(0)), F.least(m["start"], F.lit(24)))
    after = cut_out(pieces, m["end"], F.lit(1))
    votes = F.concat(
        _vote(m["text"].rlike(_STRICT[kind])),
        _vote(_checksum(kind, m["text"])),
        _gazetteer(kind, m["text"]),
        _vote(before.rlike(_CONTEXT[kind]), "0" if kind == 4 else "-"),
        _vote(~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike(r"[A-Za-z0-9_]")),
    )
    base = _checksum(kind, m["text"]) if is_base and kind else F.lit(is_base)
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), votes.alias("votes"))


_CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string>>"


def candidates(text: Column) -> Column:
    """All candidates of a text: broad matches by kind, then extra ones that overlap no base span."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(_CANDIDATES)

    def found(kind: int, guard: Column, pattern: str, is_base: bool) -> Column:
        spans = match_spans(text, pattern)
        votes = lambda pieces: F.transform(spans, lambda m: _candidate(kind, pieces, m, is_base))
        return F.when(guard, _letting(in_pieces(text), votes)).otherwise(none).cast(_CANDIDATES)

    def guard(kind: int) -> Column:
        return text.contains(_GUARD[kind]) if len(_GUARD[kind]) == 1 else text.rlike(_GUARD[kind])

    broad = F.concat(*[found(k, guard(k), BROAD[k], True) for k in range(BASE_KINDS)])
    extra = F.concat(*[found(k, text.rlike(g), p, False) for k, (g, p) in EXTRA.items()])
    return _letting(broad, lambda b: _letting(extra, lambda e: F.when(F.size(e) == 0, b).otherwise(F.concat(b, _apart(e, b)))))


def _apart(extra: Column, broad: Column) -> Column:
    """The extra candidates that overlap no base span, by one sorted pass over both."""
    event = lambda c: F.struct(c["start"].alias("start"), F.when(c["base"], 0).otherwise(1).alias("late"), c["end"].alias("end"), c.alias("c"))
    events = F.array_sort(F.transform(F.concat(F.filter(broad, lambda c: c["base"]), extra), event))
    far = 1 << 30

    def free(v: Column) -> Column:
        ends = running(F.transform(v, lambda x: F.when(x["late"] == 0, x["end"]).otherwise(0)), lambda a, x: F.greatest(a, x), F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["late"] == 0, x["start"]).otherwise(far))), lambda a, x: F.least(a, x), F.lit(far)))

        def keep(both: Column) -> Column:
            marked = F.transform(v, lambda x, i: F.struct(x["c"].alias("c"), ((x["late"] == 1) & (F.get(both["ends"], i) <= x["start"]) & (F.get(both["starts"], i) >= x["end"])).alias("free")))
            return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: x["c"])

        return _letting(F.struct(ends.alias("ends"), starts.alias("starts")), keep)

    return _letting(events, free)


def fit(found: Column | DataFrame, column: str = "candidates", rounds: int = 50) -> SpanModel:
    """Estimates labeler reliabilities by expectation-maximisation and fits the span classifier.

    Only the counts of distinct (kind, votes) reach the driver: at most 5 * 3^5 rows.
    """
    counts = [(r["kind"], r["votes"], r["n"]) for r in found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    counts.sort()
    #: Prior reliabilities, worth as many votes; they also fix which class is which.
    strength, say = 50.0, {0: (0.9, 0.3), 1: (0.97, 0.03), 2: (0.8, 0.4), 3: (0.8, 0.05), 4: (0.95, 0.4)}
    options = ("0", "1", "-")

    def believed(k: int, j: int, v: str, y: int) -> float:
        yes = say[j][0] if y else say[j][1]
        talk = (0.3 if y else 0.1) if j == 3 and k != 4 else (0.7 if j == 2 and k in (2, 3, 4) else 1.0)
        return max(1e-3, {"1": talk * yes, "0": talk * (1 - yes), "-": 1 - talk}[v])

    reliability = {(k, j, v, y): believed(k, j, v, y) for k in range(len(KINDS)) for j in range(len(VOTERS)) for v in options for y in (0, 1)}
    prior = {k: 0.5 for k in range(len(KINDS))}
    posterior: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        for k, votes, _n in counts:
            p = [math.log((prior[k] if y else 1 - prior[k])) + sum(math.log(reliability[k, j, v, y]) for j, v in enumerate(votes)) for y in (0, 1)]
            posterior[k, votes] = 1 / (1 + math.exp(max(-500.0, min(500.0, p[0] - p[1]))))
        for k in range(len(KINDS)):
            own = [(votes, n, posterior[k, votes]) for kk, votes, n in counts if kk == k]
            total = sum(n for _, n, _ in own)
            prior[k] = min(0.99, max(0.01, (sum(n * p for _, n, p in own) + 5) / (total + 10)))
            for y in (0, 1):
                weight = [(votes, n * (p if y else 1 - p)) for votes, n, p in own]
                mass = sum(w for _, w in weight)
                for j in range(len(VOTERS)):
                    for v in options:
                        said = sum(w for votes, w in weight if votes[j] == v)
                        reliability[k, j, v, y] = max(1e-3, (said + strength * believed(k, j, v, y)) / (mass + strength))
    weights: dict[str, float] = {f"{k}:{j}:{v}": 0.0 for k in range(len(KINDS)) for j in range(len(VOTERS)) for v in options}
    bias = {k: 0.0 for k in range(len(KINDS))}
    for k in range(len(KINDS)):
        #: Every pattern also counts a little, so that unseen combinations are learnt from the label model.
        rows = [(votes, n, posterior[k, votes]) for kk, votes, n in counts if kk == k]
        for a in options[:2]:
            for b in options[:2]:
                for c in options:
                    for d in options:
                        for e in options[:2]:
                            votes = a + b + c + d + e
                            p = [math.log(prior[k] if y else 1 - prior[k]) + sum(math.log(reliability[k, j, v, y]) for j, v in enumerate(votes)) for y in (0, 1)]
                            rows.append((votes, 0.2, 1 / (1 + math.exp(max(-500.0, min(500.0, p[0] - p[1]))))))
        total = sum(math.log1p(n) for _, n, _ in rows)
        for _ in range(400):
            grad: dict[str, float] = {}
            grad_bias = 0.0
            for votes, n, p in rows:
                keys = [f"{k}:{j}:{v}" for j, v in enumerate(votes)]
                z = bias[k] + sum(weights[x] for x in keys)
                miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * math.log1p(n) / total
                grad_bias += miss
                for x in keys:
                    grad[x] = grad.get(x, 0.0) + miss
            bias[k] -= 2.0 * grad_bias
            for x, g in grad.items():
                weights[x] -= 2.0 * (g + 1e-4 * weights[x])
    return SpanModel(reliability, prior, weights, bias)


def spans(found: Column, model: SpanModel) -> Column:
    """Base candidates and those that the classifier accepts, by kind, then start."""
    table = F.create_map(*[F.lit(x) for key, w in sorted(model.weights.items()) for x in (key, round(w, 6))])
    bias = F.array(*[F.lit(round(model.bias[k], 6)) for k in range(len(KINDS))])

    def score(c: Column) -> Column:
        parts = [F.element_at(table, F.concat(c["kind"].cast("string"), F.lit(f":{j}:"), F.substring(c["votes"], j + 1, 1))) for j in range(len(VOTERS))]
        return sum(parts, F.get(bias, c["kind"]))

    limit = math.log(ACCEPT / (1 - ACCEPT))
    kept = F.filter(found, lambda c: F.when(c["base"], F.lit(True)).otherwise(score(c) > limit))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["kind"], c["start"], c["end"], c["base"])))


def written(spans_col: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_col, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans_col: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rewrite(b: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            last = F.get(b["ends"], i)
            return F.when(s["start"] >= last, F.concat(cut_out(b["pieces"], last, s["start"] - last), F.get(names, s["kind"]))).otherwise("")

        end = F.array_max(F.transform(b["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(b["spans"], piece), ""), cut_out(b["pieces"], end, F.length(text) - end))

    def ends(spans: Column) -> Column:
        return running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))

    parts = _letting(ordered, lambda spans: F.struct(spans.alias("spans"), ends(spans).alias("ends"), in_pieces(text).alias("pieces")))
    return F.when(F.size(spans_col) > 0, _letting(parts, rewrite)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in its texts and, where there is one, the length column corrected."""
    (name,) = fresh(docs, "candidates")
    found = materialise(docs.withColumn(name, candidates(F.col(text_col))), "pii-candidates")
    model = fit(found, name)
    out = found.withColumn(name, spans(F.col(name), model))
    out = out.withColumn(text_col, redacted(F.col(text_col), F.col(name)))
    if chars_col and chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.size(name) > 0, F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = materialise(docs.select("doc_id", candidates(F.col("text")).alias("candidates")), "pii-candidates")
    out = found.withColumn("all", spans(F.col("candidates"), fit(found)))
    base = F.filter(F.col("all"), lambda s: s["base"])
    count = lambda k: F.size(F.filter("all", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
