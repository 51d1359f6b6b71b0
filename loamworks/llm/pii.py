"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides on spans."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.spans import joined, masked, match_spans, untouched
from loamworks.session import Workspace

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive forms and look-behinds keep long runs linear; matches stay the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap signs without which a base pattern cannot match.
SIGN = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}

# Looser forms that only the labelers' vote can accept.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[a-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[a-z]{2,24}){1,4}",
    "ip": r"(?<![0-9.])(?=[0-9.]*(?:\[\.|\(\.|\[dot| \. ))[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\.| \. )[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\.| \. )[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\.| \. )[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[._/]|  )[0-9]{4}(?:[._/]|  )[0-9]{4}(?:[._/]|  )[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])",
}
LOOSE_SIGN = {"email": r"(?i)[\[(]at[\])]", "ip": r"[0-9](?:[\[(]\.[\])]|\[dot\]| \. )[0-9]", "card": r"[0-9]{4}(?:[._/]|  )[0-9]{4}(?:[._/]|  )[0-9]{4}", "phone": r"[0-9]{3}[-. ][0-9]{4}"}

# Gazetteers.
DOMAINS = r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|us|eu|ch|at)$"
PRIVATE_IP = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
CARD_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
COUNTRY_CODES = r"^\(?[2-9]|^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

# Words near a span that speak for each kind, and words that speak against any.
NEAR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|téléphone|teléfono)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|order|invoice|serial|sku|part|model|example|sample)\b"

#: Labelers that vote 1, -1 or 0 for abstention. Whether a span has the base form is no vote: it sets the prior.
LABELERS = ("gazetteer", "context", "against", "shape", "neighbours")
#: Characters on both sides of a span in which context labelers look; a match of the same kind ends them.
WINDOW = 40
CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,looks:array<int>>>"
#: What the classifier sees besides the votes, with the number of its values: character before, character after, length, share of digits.
LOOKS = (5, 5, 4, 4)
#: Counts that a labeler's table starts from: right votes, abstentions, wrong votes.
RIGHT, NONE, WRONG = 3.0, 3.0, 1.0
#: True and false spans that each prior starts from.
PRIOR = (8.0, 12.0)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of the base definition: leftmost non-overlapping matches, those that fail the test dropped."""
    found = F.when(text.rlike(SIGN[kind]), match_spans(text, BASE[kind], WINDOW)).otherwise(F.array())
    return F.filter(found, lambda s: _valid(kind, s["match"]))


def _loose_spans(text: Column, kind: str) -> Column:
    found = F.when(text.rlike(LOOSE_SIGN[kind]), match_spans(text, LOOSE[kind], WINDOW)).otherwise(F.array())
    if kind == "ip":
        return F.filter(found, lambda s: F.forall(F.split(s["match"], "[^0-9]+"), lambda p: (p == "") | (p.cast("int") <= 255)))
    return F.filter(found, lambda s: _luhn(_digits(s["match"]))) if kind == "card" else found


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


def _beside(c: Column) -> Column:
    """A character's class: none, white space, a bracket or mark that may stand beside a span, a letter or digit, another."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\[(\])\"'“”„<>.,:;!?]"), 2).when(c.rlike(r"[\p{L}\p{N}]"), 3).otherwise(4)


def _candidate(kind: str, base: bool):
    """For a span its candidate: a vote of each labeler, and how it looks."""

    def made(s: Column) -> Column:
        digits, m, around = _digits(s["match"]), s["match"], F.concat_ws(" | ", s["before"], s["after"])
        gazetteer = {
            "email": _vote(m.rlike(DOMAINS), ~m.rlike(DOMAINS)),
            "ip": _vote(~m.rlike(PRIVATE_IP), m.rlike(PRIVATE_IP)),
            "card": _vote(digits.rlike(CARD_ISSUER), ~digits.rlike(CARD_ISSUER)),
            "phone": _vote(m.rlike(COUNTRY_CODES), ~m.rlike(COUNTRY_CODES)),
        }[kind]
        odd = {
            "email": F.length(m) > 254,
            "ip": F.length(m) > 27,
            "card": F.length(digits).isin(17, 18),
            "phone": ~F.length(digits).between(10, 13),
        }[kind]
        left, right = _beside(F.right(s["before"], F.lit(1))), _beside(F.left(s["after"], F.lit(1)))
        share = F.length(digits) / F.length(m)
        votes = (gazetteer, _vote(s["before"].rlike(NEAR[kind])), F.when(around.rlike(AGAINST), -1).otherwise(0), F.when(odd, -1).otherwise(0), F.when((left > 2) | (right > 2), -1).otherwise(0))
        looks = (left, right, F.when(F.length(m) < 10, 0).when(F.length(m) < 16, 1).when(F.length(m) < 24, 2).otherwise(3), F.least(F.floor(share * 4), F.lit(3)))
        ints = lambda cs: F.array(*[c.cast("int") for c in cs])
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), ints(votes).alias("votes"), ints(looks).alias("looks"))

    return made


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns and __lw_pii: every candidate span by kind and start; base ones and loose ones that touch none."""
    c = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"__lw_{kind}", base_spans(c, kind))
    parts = []
    for kind in KINDS:
        part = F.transform(F.col(f"__lw_{kind}"), _candidate(kind, True))
        if kind in LOOSE:
            taken = F.concat(*[F.transform(F.col(f"__lw_{k}"), lambda s: F.struct(s["start"], s["end"])) for k in KINDS])
            free = untouched(_loose_spans(c, kind), taken)
            part = F.array_sort(F.concat(part, F.transform(free, _candidate(kind, False))))
        parts.append(part)
    return out.withColumn("__lw_pii", F.concat(*parts).cast(CANDIDATES)).drop(*[f"__lw_{k}" for k in KINDS])


def vote_patterns(found: DataFrame) -> list:
    """How often each kind, form, pattern of votes and look occurs: as many rows as there are patterns, whatever the corpus."""
    each = found.where(F.size("__lw_pii") > 0).select(F.explode("__lw_pii").alias("c"))
    of = [F.col(f"c.{n}").alias(n) for n in ("kind", "base", "votes", "looks")]
    return each.groupBy(*of).agg(F.count("*").alias("n")).orderBy("kind", "base", "votes", "looks").collect()


def reliabilities(patterns: list, rounds: int = 40) -> tuple[np.ndarray, dict, np.ndarray]:
    """Expectation-maximisation: P(vote | truth) of each labeler, a prior for each kind and form, each pattern's posterior.

    Labelers' tables are shared by kinds and forms; a prior belongs to a kind and to base or loose spans, so that many
    base spans make no loose one likely. Start: the sum of votes, half a vote short of even, so that loose spans need
    support. tables[labeler, truth, vote + 1].
    """
    n = np.array([p["n"] for p in patterns], float)
    votes = np.array([p["votes"] for p in patterns], int).reshape(len(patterns), len(LABELERS))
    names = sorted({(p["kind"], p["base"]) for p in patterns})
    group = np.array([names.index((p["kind"], p["base"])) for p in patterns], int)
    base = np.array([p["base"] for p in patterns], float)
    posterior = 1 / (1 + np.exp(-(votes.sum(axis=1) + 2 * base - 0.5)))
    start = np.array([[RIGHT, NONE, WRONG], [WRONG, NONE, RIGHT]])
    tables, prior = np.zeros((len(LABELERS), 2, 3)), np.zeros(len(names))
    for _ in range(rounds if patterns else 0):
        yes, every = np.bincount(group, n * posterior, len(names)), np.bincount(group, n, len(names))
        prior = (yes + PRIOR[0]) / (every + sum(PRIOR))
        for truth, weight in ((0, n * (1 - posterior)), (1, n * posterior)):
            for i in range(len(LABELERS)):
                counts = np.bincount(votes[:, i] + 1, weight, 3) + start[truth]
                tables[i, truth] = counts / counts.sum()
        score = np.log(prior / (1 - prior))[group]
        for i in range(len(LABELERS)):
            score = score + np.log(tables[i, 1] / tables[i, 0])[votes[:, i] + 1]
        posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return tables, dict(zip(names, prior.tolist(), strict=True)), posterior


def _slots() -> dict[tuple, int]:
    """The classifier's features by number: kind and form, labeler and vote, look and value."""
    names = [("form", k, b) for k in KINDS for b in (False, True)]
    names += [("vote", i, v) for i in range(len(LABELERS)) for v in (-1, 1)]
    names += [("look", i, v) for i, size in enumerate(LOOKS) for v in range(size)]
    return {name: at for at, name in enumerate(names)}


def classifier(patterns: list, posterior: np.ndarray, rounds: int = 4000, rate: float = 2.0, decay: float = 2e-4) -> dict[tuple, float]:
    """A logistic span classifier trained on the posteriors: kind and form, votes, and the span's own looks and neighbours.

    Each form of a kind weighs alike in all, so that rare loose forms are learned beside common base ones.
    """
    slots = _slots()
    x = np.zeros((len(patterns), len(slots)))
    for row, p in zip(x, patterns, strict=True):
        row[slots["form", p["kind"], p["base"]]] = 1
        for i, v in enumerate(p["votes"]):
            if v:
                row[slots["vote", i, v]] = 1
        for i, v in enumerate(p["looks"]):
            row[slots["look", i, v]] = 0.5
    n = np.array([p["n"] for p in patterns], float)
    form = x[:, : 2 * len(KINDS)]
    n = n / np.maximum(form @ (n @ form), 1) if len(patterns) else n
    weights = np.zeros(len(slots))
    for _ in range(rounds if patterns else 0):
        guess = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights -= rate * ((n * (guess - posterior)) @ x / max(n.sum(), 1e-9) + decay * weights)
    return {name: float(weights[at]) for name, at in slots.items()}


def _accepted(weights: dict[tuple, float], threshold: float):
    """Whether the classifier takes a candidate; base spans stay whatever it says."""

    def test(c: Column) -> Column:
        score = F.coalesce(*[F.when(c["kind"] == k, F.lit(weights["form", k, False])) for k in KINDS], F.lit(0.0))
        for i in range(len(LABELERS)):
            score = score + F.when(c["votes"][i] == 1, weights["vote", i, 1]).when(c["votes"][i] == -1, weights["vote", i, -1]).otherwise(0.0)
        for i, size in enumerate(LOOKS):
            score = score + 0.5 * F.element_at(F.array(*[F.lit(weights["look", i, v]) for v in range(size)]), c["looks"][i] + 1)
        return c["base"] | (score > math.log(threshold / (1 - threshold)))

    return test


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows of docs (the columns named in keep, or all) with __lw_spans: array of (kind, start, end, base) by kind, then start.

    Candidates are found once and written; votes are counted over all of them, and no text is shuffled. Null and
    empty texts have no spans; very long ones are searched whole; repeated rows stay, and count; columns with the
    names of a span's fields stay as they are; without any candidate the classifier adds nothing.
    """
    work = Workspace(docs.sparkSession, "pii")
    rows = candidates(docs, text).select(*(keep if keep is not None else docs.columns), "__lw_pii")
    found = work.table(rows, "candidates")
    patterns = vote_patterns(found)
    _, _, posterior = reliabilities(patterns)
    taken = F.filter("__lw_pii", _accepted(classifier(patterns, posterior), threshold))
    plain = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return found.withColumn("__lw_spans", plain).drop("__lw_pii")


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts and digests of its base spans, and all its spans; rows as in detect."""
    base = F.filter("__lw_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detect(docs, keep=("doc_id",)).select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__lw_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; all rows stay. length: a column of its characters."""
    found = detect(docs, text)
    labelled = F.transform("__lw_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    out = found.withColumn(text, masked(F.col(text), F.array_sort(labelled)))
    if length:
        out = out.withColumn(length, F.when(F.size("__lw_spans") > 0, F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(docs.columns)
