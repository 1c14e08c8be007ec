"""Personal data by weak supervision, in DataFrame operations alone.

Regular expressions propose spans. Five labelers (pattern, gazetteer, context,
diversity of characters, boundary) vote on each one; expectation-maximisation
over the counts of vote patterns estimates their accuracies; the resulting soft
labels train a naive Bayes span classifier, which decides on the spans that the
base patterns alone do not settle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import cut, let

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
# The patterns are the plain ones with possessive repeats and an anchor at the
# start of a run, which match the same spans without rescanning long runs.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
)
#: What a text must have for a pattern to be tried at all.
NEEDS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]", r"[0-9][A-Za-z_-]|[A-Za-z_-][0-9]")
#: Fixed gazetteers: top-level domains, private networks, card issuers' prefixes, calling codes, key prefixes.
GAZETTEER = (
    r"(?i)\.(com|org|net|edu|gov|io|info|biz|co|uk|de|fr|es|it|eu|us)$",
    r"^(10|127|169\.254|172|192\.168|0|255)\.",
    r"^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|62|35)",
    r"^\+(1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    r"^(sk|pk|rk|ghp|gho|xox[bp]|AKIA|ASIA|AIza|eyJ|glpat|npm|hf)",
)
CONTEXT = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|credit|payment|ip|host|server|addr|token|secret|passw|api|key|auth|ssn|account)\W*[=:\x22'\x20]*$"
AGAINST = r"(?i)(version|licen[cs]e|isbn|page|chapter|section|figure|table|no\.|nr\.)\W*$"
CONTEXT_CHARS = 24
CHUNK = 256
ROUNDS = 25
CANDIDATE = "array<struct<start:int,kind:int,end:int,text:string,before:string,after:string>>"


def _running(lens: Column, first: Column) -> Column:
    """The sum of ``first`` and the entries before each one, in order."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(lens, start, step, lambda s: s["out"])


def running_sums(lens: Column) -> Column:
    """Exclusive running sums of an ``array<int>``, a chunk at a time so that long arrays stay cheap."""

    def whole(xs):
        places = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(places, lambda k: F.slice(xs, k, CHUNK)), by_chunk)

    def by_chunk(chunks):
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(chunks, _running(sums, F.lit(0)), _running))

    return let(lens, whole)


def _of_kind(text: Column, kind: int) -> Column:
    """Candidates of one kind with their places, counted in code points."""

    def place(both):
        gaps, found = both["gaps"], both["found"]
        # gap k and match k alternate, so a match starts after all gaps up to its own and all matches before
        lens = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def span(at, k):
            gap, match = F.get(gaps, k), F.get(found, k)
            start = (at + F.length(gap)).cast("int")
            end = (start + F.length(match)).cast("int")
            before, after = F.right(gap, F.lit(CONTEXT_CHARS)), F.left(F.get(gaps, k + 1), F.lit(1))
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("text"), before.alias("before"), after.alias("after"))

        return F.transform(running_sums(lens), span)

    pattern = F.lit(PATTERNS[kind])
    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))
    return F.when(text.rlike(NEEDS[kind]), let(both, place)).otherwise(F.array().cast(CANDIDATE))


def candidates(text: Column) -> Column:
    """All spans that a pattern proposes, whether they hold or not."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_of_kind(text, k) for k in range(len(KINDS))])


def _luhn(digits: Column) -> Column:
    def step(total, d):
        x = d["d"].cast("int") * (d["k"] % 2 + 1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.struct(d.alias("d"), k.alias("k")))
    return F.aggregate(F.filter(each, lambda x: x["d"] != ""), F.lit(0), step) % 10 == 0


def holds(c: Column) -> Column:
    """Whether a candidate of a base kind is a valid span; false for other kinds."""
    text = c["text"]
    octets = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(octets, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = F.regexp_replace(text, "[^0-9]", "")
    card = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return (
        F.when(c["kind"] == 0, True).when(c["kind"] == 1, ip).when(c["kind"] == 2, card)
        .when(c["kind"] == 3, F.length(digits).between(9, 15)).otherwise(False)
    )


def votes(c: Column) -> Column:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 abstains."""
    text, kind = c["text"], c["kind"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    hexadecimal = text.rlike(r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$")
    pattern = F.when(kind < BASE, F.when(holds(c), 1).otherwise(-1)).otherwise(vote(hexadecimal, text.rlike(r"^[A-Za-z]+[0-9]{1,3}$|^[0-9-]+[A-Za-z]{1,3}$")))
    listed = F.lit(False)
    for k, p in enumerate(GAZETTEER):
        listed = F.when(kind == k, text.rlike(p)).otherwise(listed)
    gazetteer = F.when(kind == 1, vote(F.lit(False), listed)).when(kind == 4, vote(listed, F.lit(False))).otherwise(vote(listed, ~listed))
    context = vote(c["before"].rlike(CONTEXT), c["before"].rlike(AGAINST))
    chars = F.size(F.array_distinct(F.split(text, "")))
    diverse = F.when(kind == 4, vote(chars >= 10, chars < 8)).otherwise(vote(chars >= 5, chars < 3))
    boundary = vote(~(c["before"].rlike(r"[\p{L}0-9]$") | c["after"].rlike(r"^[\p{L}0-9]")), F.lit(True))
    return F.array(pattern, gazetteer, context, diverse, boundary)


LABELERS = 5


def features(c: Column, vs: Column) -> Column:
    """Names of a candidate's features for the span classifier, each with its kind."""
    text = c["text"]
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    shown = [
        F.concat(F.lit("length "), F.floor(F.log2(F.length(text))).cast("string")),
        F.concat(F.lit("digits "), F.floor(digits * 4 / F.length(text)).cast("string")),
        F.concat(F.lit("case "), text.rlike("[A-Z]").cast("string")),
        *[F.concat(F.lit(f"vote {k} "), F.get(vs, F.lit(k)).cast("string")) for k in range(LABELERS)],
    ]
    return F.array(*[F.concat(c["kind"].cast("string"), F.lit(" "), x) for x in shown])


def _logit(p):
    return F.log(p / (1 - p))


def _posterior(prior: Column, accuracy: Column, vs: Column) -> Column:
    evidence = F.zip_with(vs, accuracy, lambda v, a: v * _logit(a))
    return 1 / (1 + F.exp(-(_logit(prior) + F.aggregate(evidence, F.lit(0.0), lambda s, x: s + x))))


def expectation_maximisation(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row ``(prior array, accuracy array)`` from ``(kind, vs, n)`` counts of vote patterns.

    There are at most kinds x 3^labelers patterns, whatever the input. Every
    labeler errs alike on either class; a prior for each kind.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("kind", "vs", "n"))).alias("ps"))
    clamp = lambda x, lo: F.least(F.greatest(x, F.lit(lo)), F.lit(0.99))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    # one more than none of each kind keeps the ratios defined for kinds and labelers without data
    start = F.struct(F.array(*[F.lit(0.5)] * len(KINDS)).alias("prior"), F.array(*[F.lit(0.8)] * LABELERS).alias("accuracy"))

    def step(s, _):
        soft = F.transform("ps", lambda p: F.struct(p.alias("p"), _posterior(F.get(s["prior"], p["kind"]), s["accuracy"], p["vs"]).alias("q")))

        def update(ws):
            def prior(k):
                own = F.filter(ws, lambda w: w["p"]["kind"] == k)
                return clamp((total(F.transform(own, lambda w: w["p"]["n"] * w["q"])) + 1) / (total(F.transform(own, lambda w: w["p"]["n"].cast("double"))) + 2), 0.02)

            def accuracy(k):
                right = lambda w: F.when(F.get(w["p"]["vs"], k) > 0, w["q"]).when(F.get(w["p"]["vs"], k) < 0, 1 - w["q"]).otherwise(0.0)
                made = lambda w: F.abs(F.get(w["p"]["vs"], k)).cast("double")
                return clamp((total(F.transform(ws, lambda w: w["p"]["n"] * right(w))) + 4) / (total(F.transform(ws, lambda w: w["p"]["n"] * made(w))) + 5), 0.51)

            return F.struct(
                F.transform(F.array(*[F.lit(k) for k in range(len(KINDS))]), prior).alias("prior"),
                F.transform(F.array(*[F.lit(k) for k in range(LABELERS)]), accuracy).alias("accuracy"),
            )

        return let(soft, update)

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s")).select("s.*")


def fit(found: DataFrame) -> dict[str, float]:
    """Log-odds of the span classifier's features, from a table with a ``spans`` column of candidates.

    The model is a few hundred numbers; all candidates take part in it.
    """
    each = found.select(F.explode("spans").alias("c")).select("c", votes(F.col("c")).alias("vs"))
    each = cut(each.groupBy(F.col("c.kind").alias("kind"), "vs", features(F.col("c"), F.col("vs")).alias("fs")).agg(F.count("*").alias("n")))
    em = expectation_maximisation(each.groupBy("kind", "vs").agg(F.sum("n").alias("n"))).first()
    prior, accuracy = (F.array(*[F.lit(x) for x in xs]) for xs in (em["prior"], em["accuracy"]))
    soft = each.withColumn("q", _posterior(F.get(prior, F.col("kind")), accuracy, F.col("vs")))
    soft = soft.select(F.explode(F.concat("fs", F.array(F.concat(F.col("kind").cast("string"), F.lit(" all"))))).alias("f"), "n", "q")
    sums = soft.groupBy("f").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).orderBy("f").collect()
    of_kind = {r["f"].split()[0]: r for r in sums if r["f"].endswith(" all")}
    model = {}
    for r in sums:
        whole = of_kind[r["f"].split()[0]]
        odds = math.log((r["yes"] + 0.5) / (r["no"] + 0.5))
        base = math.log((whole["yes"] + 0.5) / (whole["no"] + 0.5))
        model[r["f"]] = base if r is whole else odds - base
    return model


def accept(found: Column, model: dict[str, float]) -> Column:
    """Of the candidates: the valid base spans and what the classifier adds, by start, then kind."""
    weights = F.create_map(*[F.lit(x) for kv in sorted(model.items()) for x in kv]) if model else F.create_map(F.lit(""), F.lit(0.0))

    def score(c):
        fs = F.concat(features(c, votes(c)), F.array(F.concat(c["kind"].cast("string"), F.lit(" all"))))
        return F.aggregate(fs, F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))

    return F.array_sort(F.filter(found, lambda c: holds(c) | (score(c) > 0)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` for every row: valid base spans, and these with the added ones.

    Both are arrays of structs with start, end (exclusive), kind (an index into
    KINDS) and text, in code points, by start and then kind. Null texts count as empty; repeated
    rows and null ids come out as they are; an empty table gives an empty one;
    other columns are not read.
    """
    found = cut(docs.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col)).alias("spans")))
    model = fit(found)
    return found.select("doc_id", F.array_sort(F.filter("spans", holds)).alias("base"), accept(F.col("spans"), model).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted ``spans``, overlapping ones as one, replaced by its kind in brackets."""
    name = lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)), F.lit("]"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        piece = F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), name(x))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], piece)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    whole = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, whole)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text`` masked; rows and columns as they were."""
    model = fit(docs.select(candidates(F.col(text_col)).alias("spans")))
    # no other name is taken, so that columns of docs cannot clash
    masked = let(accept(candidates(F.col(text_col)), model), lambda s: mask(F.col(text_col), s))
    return docs.withColumn(text_col, masked)
