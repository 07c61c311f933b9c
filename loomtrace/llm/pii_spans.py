"""Personal data by weak supervision, in DataFrame and SQL functions only.

Four base kinds (email, ip, card, phone) are found by their patterns and always stay. What the patterns and their
checks leave open are candidates of three more kinds: numbers that are not cards, long mixed
tokens (secret) and capitalised words (name). Six labelers vote on each, yes, no or not at all: its format,
its characters or digits, a gazetteer, the context before it and behind it, and the base kinds of its document.

The votes of all documents are counted by pattern (at most 3 * 3^6 rows). Expectation-maximisation on these
counts estimates per kind how many candidates are real and how often each labeler says so of real and of
other ones, without labels. The posteriors then are the targets of a logistic regression over votes and shape,
trained on counted patterns too; its weights (`SLOTS` numbers) score each candidate in its own row.

Nothing but counts leaves a row: no text, span or candidate is shuffled, so neither documents with very many
spans nor frequent values meet in one task.

Defined results: NULL and empty texts have no spans; positions count code points, ends exclusive; equal rows give
equal results; doc_id is passed on as it is; without candidates nothing is fitted and base spans are the result.
"""
from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "secret", "name")
LABELERS = 6
ROUNDS, NEAR, THRESHOLD = 12, 40, 0.5
_LENGTHS = (6, 8, 10, 13, 16, 20, 32, 64)
SLOTS = len(ADDED) * (1 + 2 * LABELERS) + len(_LENGTHS) + 1 + 4
_ABSTAIN = -1

# fixed values: the four base patterns. They are written without backtracking into what they have read
# (possessive), and start only where a longer match could not have started before; the matches are the same.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "name": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++\.?(?:\x20\p{Lu}\p{Ll}++){1,2}(?![\p{L}\p{N}])",
}

# fixed values: gazetteers and cues of the labelers
GIVEN = "Anna Anne Antonio Carlos Carmen Charles Claire Daniel David Elena Emily Emma Hans Heinrich Isabel James Jean Jennifer John Jorge Jose Juan Julia Karl Klaus Laura Linda Louis Lucia Manuel Maria Marie Mary Michael Michel Miguel Monika Nathalie Paul Pedro Peter Philippe Pierre Richard Robert Sabine Sarah Sophie Susan Thomas Ursula William Wolfgang".split()
OPENERS = "A An And As At But By For From He Her His How I If In It Its My No Not Of On Or Our She So That The Their There These They This Those To We What When Where Who Why With You Aus Bei Das Dem Den Der Die Ein Eine Er Es Für Ihr Im Ist Mit Nach Sie Und Von Wir Zu Au Aux Avec Ce Ces Dans De Des Du Elle En Et Il La Le Les Mais Nous Ou Par Pour Que Sur Un Une Vous Con Del El Ella Esta Este Las Lo Los Para Pero Por Si Sus Su Y".split()
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don)"
NUMBER_CUES = r"(?i)(?:phone|tel|telefon|call|fax|mobile|cell|handy|account|konto|cuenta|compte|iban|ssn|passport|social security)[^\p{L}]{0,6}$"
NUMBER_OTHERS = r"(?i)(?:isbn|issn|doi|page|version|year|chapter|figure|€|\$|£|usd|eur|#)[^\p{L}]{0,3}$"
SECRET_CUES = r"""(?i)(?:token|key|secret|passw[a-z]*|pwd|auth|bearer|credential)[a-z_]*["']?\x20?[=:]?\x20?["']?$"""
NAME_CUES = r"(?i)(?:contact|regards|signed|author|dear|sincerely|name|written by|named|called)[,:]?\x20$"


def _sums_before(lengths: Column) -> Column:
    """Exclusive running sums of an array, by chunks of 256: a running array is copied within a chunk only."""
    def run(values: Column, start: Column) -> Column:
        return F.slice(F.aggregate(values, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), F.lit(1), F.size(values))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda c: F.slice(lengths, c * 256 + 1, F.lit(256)))
    starts = run(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(chunks, starts, run))


def _matches(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Per kind an array column of (start, end, value, before, behind) of all matches, where its condition holds."""
    for kind, needed in kinds.items():
        df = df.withColumn(f"m_{kind}", F.when(needed, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))))
    for kind in kinds:
        df = df.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", PATTERNS[kind], -1)))
    for kind in kinds:
        outside = F.slice(f"p_{kind}", F.lit(1), F.size(f"m_{kind}"))
        lengths = F.zip_with(outside, F.col(f"m_{kind}"), lambda p, m: F.char_length(p) + F.char_length(m))
        df = df.withColumn(f"s_{kind}", F.when(F.col(f"p_{kind}").isNotNull(), _sums_before(lengths)))
    for kind in kinds:
        p, m, s = (F.col(f"{x}_{kind}") for x in "pms")

        def one(value: Column, i: Column) -> Column:
            outside = F.get(p, i)
            start = F.get(s, i) + F.char_length(outside)
            return F.struct(start.cast("long").alias("start"), (start + F.char_length(value)).cast("long").alias("end"), value.alias("value"),
                            F.right(outside, F.lit(NEAR)).alias("before"), F.left(F.get(p, i + 1), F.lit(NEAR)).alias("behind"))
        df = df.withColumn(kind, F.when(p.isNotNull(), F.transform(m, one)))  # `one` is read here, not later
    return df.drop(*[f"{x}_{kind}" for x in "pms" for kind in kinds])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """13 to 19 digits that pass the check sum."""
    digits = _digits(value)
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.when((n >= 13) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _low_parts(value: Column) -> Column:
    return F.forall(F.split(value, "[.]"), lambda x: F.regexp_replace(x, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _phone_digits(value: Column) -> Column:
    n = F.char_length(_digits(value))
    return (n >= 9) & (n <= 15)


_CHECKS = {"email": lambda v: F.lit(True), "ip": _low_parts, "card": _luhn, "phone": _phone_digits}


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v if no is None else v.when(no, 0)).otherwise(_ABSTAIN)


def _votes(kind: str, c: Column, personal: Column) -> list[Column]:
    """The six labelers on one candidate; `personal`: its document has base spans."""
    value, before, behind = c["value"], c["before"], c["behind"]
    never = F.lit(False)
    if kind == "number":
        digits = _digits(value)
        return [_vote(value.rlike(r"^(?:[0-9]{2,4}[\x20-])[0-9]{3,4}[\x20-][0-9]{2,4}(?:[\x20-][0-9]{2,4})?$"), value.rlike(r"^(?:19|20)[0-9]{2}[\x20-]?(?:0[1-9]|1[0-2])[\x20-]?[0-3][0-9]$")),
                _vote(never, F.char_length(digits).between(13, 19) | (F.size(F.array_distinct(F.split(digits, ""))) < 4)),  # a number of a card's length with a wrong check digit
                _vote(digits.rlike("^(?:00[1-9]|0[1-9])"), digits.rlike("^[2-9]0+$")),
                _vote(before.rlike(NUMBER_CUES), before.rlike(NUMBER_OTHERS)),
                _vote(never, behind.rlike(r"^\x20?(?:%|°|px|kg|km|cm|mm|€|\$|[.,][0-9])")),
                _vote(personal)]
    if kind == "secret":
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return [_vote(value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40})$"), ~mixed),
                _vote(mixed & (F.size(F.array_distinct(F.split(value, ""))) >= 10), F.size(F.array_distinct(F.split(value, ""))) < 8),
                _vote(value.rlike("^(?:gh[opsu]_|sk[-_]|xox[abp]-|AKIA|eyJ)"), value.rlike("^(?:[A-Za-z]+[-_])+[A-Za-z]+$")),
                _vote(before.rlike(SECRET_CUES), before.rlike(r"[/?&#.\\]$")),
                _vote(behind.rlike("""^["']"""), behind.rlike(r"^[/.][A-Za-z]")),
                _vote(personal)]
    words = F.split(F.regexp_replace(value, "[.]", ""), " ")
    return [_vote(value.rlike(rf"^{TITLES}\.?\x20"), F.exists(words, lambda w: F.char_length(w) > 14)),
            _vote(never, F.size(F.array_distinct(words)) < F.size(words)),
            _vote(F.array_contains(F.array(*map(F.lit, GIVEN)), F.element_at(words, 1)), F.exists(words, lambda w: w.isin(OPENERS))),
            _vote(before.rlike(NAME_CUES), before.rlike(r"(?:^|[.!?:\n|]\x20?)$")),
            _vote(behind.rlike(r"^(?:,?\x20(?:wrote|said|lives|born)|\x20?[<(])"), behind.rlike(r"^\x20?[|:]")),
            _vote(personal)]


def _candidate(kind: str, c: Column, personal: Column) -> Column:
    votes = _votes(kind, c, personal)
    k, value = ADDED.index(kind), c["value"]
    first = k * (1 + 2 * LABELERS)
    length = F.char_length(value)
    after = len(ADDED) * (1 + 2 * LABELERS)
    bucket = sum(((length > n).cast("int") for n in _LENGTHS), F.lit(after))
    shape = [F.when(value.rlike(p), F.lit(after + len(_LENGTHS) + 1 + i)) for i, p in enumerate((r"[0-9]", r"\p{Lu}", r"\p{Ll}", r"[^\p{L}\p{N}]"))]
    slots = F.array_compact(F.array(F.lit(first), *[F.when(v >= 0, v + (first + 1 + 2 * i)) for i, v in enumerate(votes)], bucket, *shape))
    return F.struct(F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.array(*votes).alias("votes"), slots.alias("slots"))


def _is_candidate(kind: str, c: Column) -> Column:
    if kind != "number":
        inside = c["before"].rlike(r"[@.]$") | c["behind"].rlike("^@")
        return ~inside if kind == "secret" else F.lit(True)
    n = F.char_length(_digits(c["value"]))
    part = c["before"].rlike(r"(?:\+[0-9\x20().-]*|[@._%A-Za-z-][0-9A-Za-z._-]*)$") | c["behind"].rlike("^(?:@|[A-Za-z_])")  # of a phone, an address, a token
    return (n >= 7) & ~part & ~_luhn(c["value"])


_NONE = "array<struct<start:bigint,end:bigint,value:string,before:string,behind:string>>"


def _spans(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_<kind>, base (array of kind:start:end) and candidates with votes and slots."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    found = _matches(read, {"email": F.contains("text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("text", F.lit("+")), "secret": digit, "name": F.col("text") != ""}).drop("text")
    for kind in (*BASE, "secret", "name"):
        found = found.withColumn(kind, F.coalesce(kind, F.array().cast(_NONE)))
    found = found.withColumn("number", F.filter("card", lambda c: _is_candidate("number", c)))
    for kind in BASE:
        found = found.withColumn(kind, F.filter(kind, lambda c: _CHECKS[kind](c["value"])))
    personal = sum((F.size(k) for k in BASE), F.lit(0)) > 0
    found = found.withColumn("personal", personal)
    written = [F.transform(k, lambda c: F.concat(F.lit(f"{k}:"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))) for k in BASE]
    lists = [F.transform(F.filter(k, lambda c: _is_candidate(k, c)), lambda c: _candidate(k, c, F.col("personal"))) for k in ADDED]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.concat(*written).alias("base"), F.concat(*lists).alias("candidates"))


_VOTES = ((_ABSTAIN, "none"), (0, "no"), (1, "yes"))
_START = {"real": {"yes": 0.5, "no": 0.1, "none": 0.4}, "other": {"yes": 0.1, "no": 0.3, "none": 0.6}}
_FIRST = 10  # pseudo-votes of the start rates that each labeler has


def _posterior(model: dict[int, dict]) -> Column:
    """Probability that a candidate of (kind, votes) is real."""
    shares = [math.log(model[k]["share"] / (1 - model[k]["share"])) for k in range(len(ADDED))]
    weights = [math.log(model[k]["real"][i][name] / model[k]["other"][i][name]) for k in range(len(ADDED)) for i in range(LABELERS) for _, name in _VOTES]
    w = F.array(*map(F.lit, weights))
    at = lambda i: (F.col("kind") * LABELERS + i) * len(_VOTES) + F.get("votes", i) + 1
    return 1 / (1 + F.exp(-F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.get(F.array(*map(F.lit, shares)), F.col("kind")), lambda acc, i: acc + F.get(w, at(i)))))


def reliabilities(counted: DataFrame, rounds: int = ROUNDS) -> dict[int, dict]:
    """Expectation-maximisation over counted patterns (kind, votes, n): per kind the share of real candidates and how often each labeler says yes, no or nothing of real and of other ones.

    A round is one aggregation of at most 3 * 3^6 rows to one row a kind, labeler and vote. Labelers start better than chance, and one
    that turns out to say yes more often of other candidates than of real ones, or no more often of real ones, counts for nothing in that.
    """
    model = {k: {"share": 0.2, "real": [dict(_START["real"]) for _ in range(LABELERS)], "other": [dict(_START["other"]) for _ in range(LABELERS)]} for k in range(len(ADDED))}
    for _ in range(rounds):
        each = counted.withColumn("q", _posterior(model)).select("kind", "n", "q", F.posexplode("votes").alias("i", "vote"))
        sums = each.groupBy("kind", "i", "vote").agg(F.sum(F.col("n") * F.col("q")).alias("real"), F.sum(F.col("n") * (1 - F.col("q"))).alias("other")).collect()  # one row a kind, labeler and vote
        for kind in {r["kind"] for r in sums}:
            here = [r for r in sums if r["kind"] == kind]
            row = {name: sum(r[name] for r in here if r["i"] == 0) for name in ("real", "other")}
            new = {"share": (row["real"] + 1) / (row["real"] + row["other"] + 5)}
            for name in row:
                cast = {(r["i"], r["vote"]): r[name] for r in here}
                new[name] = [{vote: (cast.get((i, value), 0.0) + _FIRST * _START[name][vote]) / (row[name] + _FIRST) for value, vote in _VOTES} for i in range(LABELERS)]
            for real, other in zip(new["real"], new["other"], strict=True):
                for vote, good in (("yes", real["yes"] >= other["yes"]), ("no", real["no"] <= other["no"])):
                    if not good:
                        real[vote] = other[vote] = (real[vote] * row["real"] + other[vote] * row["other"]) / (row["real"] + row["other"])
            model[kind] = new
    return model


def _classifier(shapes: DataFrame, model: dict[int, dict]) -> list[float]:
    """Weights of the slots and, last, the bias, trained towards the posteriors of counted (kind, votes, slots, n)."""
    p = F.least(F.greatest(_posterior(model), F.lit(1e-3)), F.lit(1 - 1e-3))
    rows = shapes.withColumn("p", p)
    dense = array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.when(F.array_contains("slots", i), 1.0).otherwise(0.0)))
    sided = rows.select(dense.alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("x"))
    fit = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=25, standardization=False).fit(sided.select("features", "x.label", "x.weight"))
    return [*fit.coefficients.toArray().tolist(), float(fit.intercept)]


def _scored(found: DataFrame, weights: list[float] | None) -> DataFrame:
    """`added`: the candidates that the classifier takes, as kind:start:end."""
    if weights is None:
        return found.withColumn("added", F.array().cast("array<string>"))
    w = F.array(*map(F.lit, weights[:-1]))
    odds = lambda c: F.aggregate(c["slots"], F.lit(weights[-1]), lambda acc, i: acc + F.get(w, i))
    taken = F.filter("candidates", lambda c: odds(c) > math.log(THRESHOLD / (1 - THRESHOLD)))
    name = lambda c: F.get(F.array(*map(F.lit, ADDED)), c["kind"])
    return found.withColumn("added", F.transform(taken, lambda c: F.concat(name(c), F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base and added (arrays of kind:start:end)."""
    work = base.new_work(docs.sparkSession)
    found = base.materialize(_spans(docs), f"{work}/found")
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.slots")
    shapes = base.materialize(each.groupBy("kind", "votes", "slots").agg(F.count("*").alias("n")), f"{work}/shapes")
    counted = base.materialize(shapes.groupBy("kind", "votes").agg(F.sum("n").alias("n")), f"{work}/votes")
    weights = None if counted.isEmpty() else _classifier(shapes, reliabilities(counted))
    return _scored(found, weights).drop("candidates")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans."""
    return find(docs).select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "added"), ",").alias("spans"))
