"""Safety, annotation, quality control and scenes of texts, as columns."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions import fixed, text as T
from loamworks.operators.relational import tier

# Fixed value: a letter of the languages that samples are in.
LETTER = r"[\x{4e00}-\x{9fff}a-zA-Z]"
VERDICT = "struct<risk:double,category:string,reason:string>"


def _verdict(risk: float, category: Column | str, reason: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(risk).alias("risk"), lit(category).alias("category"), lit(reason).alias("reason"))


def safety(text: Column, unsafe: dict[str, list[str]] = fixed.UNSAFE) -> Column:
    """The first rule that a text breaks: risk, category and reason, or null (SF-01 to SF-06).

    The words are looked for only where a character in the range of their first ones is, and unprintable characters
    are counted only where those beyond plain ASCII are many enough; both take one scan.
    """
    words = [(w, c) for c, ws in unsafe.items() for w in ws]
    found = F.coalesce(*[F.when(F.contains(text, F.lit(w)), _verdict(1.0, c, w)) for w, c in words], F.lit(None).cast(VERDICT))
    first = sorted(w[0] for w, _ in words)
    n = F.length(text)
    most = T.majority_char(text)
    share = (n - F.length(F.replace(text, most, F.lit("")))) / n
    length = lambda without: F.length(F.regexp_replace(text, without, ""))
    few = F.when((n - length(T.PLAIN)) / n < 0.6, length(T.UNPRINTABLE) / n < 0.6).otherwise(False)  # plain ones are printable
    return F.coalesce(
        F.when(text.rlike(rf"[\x{{{ord(first[0]):x}}}-\x{{{ord(first[-1]):x}}}]"), found) if words else F.lit(None).cast(VERDICT),
        F.when(n < 10, _verdict(0.3, "quality", "too short")),
        F.when(n > 100_000, _verdict(0.2, "quality", "too long")),
        F.when(F.when(n > 50, F.when(T.may_have_majority(text), (share > 0.5) & ~most.isin(" ", "\n")).otherwise(False)).otherwise(False), _verdict(0.6, "spam", "one character")),
        F.when(F.when(n > 20, few).otherwise(False), _verdict(0.5, "quality", "unprintable")),
        F.when(F.regexp_count(text, F.lit(r"https?://[^ \t\n\x0b\x0c\r]+")) > 5, _verdict(0.7, "spam", "links")),
        F.lit(None).cast(VERDICT),
    )


def checked(payload: Column, kind: Column, unsafe: dict[str, list[str]] = fixed.UNSAFE, model: Column | None = None) -> Column:
    """passed, risk, category, reason and layer of a payload by its kind (SF-09).

    Texts go through safety, all other kinds through media_safety, null payloads as empty ones. model: what a model
    says where the rules find nothing (risk, category, reason), or null, or left out for the way without one.
    """
    body = F.coalesce(payload, F.lit(""))
    text = F.coalesce(kind, F.lit("text")) == "text"
    rule = F.when(text, safety(body, unsafe)).otherwise(media_safety(body, kind))
    said = F.lit(None).cast(VERDICT) if model is None else model

    def told(both: Column) -> Column:
        v = F.coalesce(both["rule"], both["said"])
        layer = F.when(both["rule"].isNotNull(), F.when(text, "rule").otherwise("media")).when(both["said"].isNotNull(), "model").otherwise("pass")
        none = lambda c, z: F.coalesce(v[c], F.lit(z))
        return F.struct(v.isNull().alias("passed"), none("risk", 0.0).alias("risk"), none("category", "").alias("category"), none("reason", "").alias("reason"), layer.alias("layer"))

    return T.let(F.struct(rule.alias("rule"), said.alias("said")), told)


def media_safety(payload: Column, kind: Column) -> Column:
    """The first rule that a base64 payload or data URI breaks, or null (SF-07)."""
    uri = payload.startswith("data:")
    bad = uri & ~F.contains(payload, F.lit(","))
    raw = F.when(uri, F.regexp_extract(payload, r"(?s)^[^,]*,(.*)$", 1)).otherwise(payload)
    mime = F.when(uri, F.lower(F.regexp_extract(payload, r"^data:([^;,]*)", 1))).otherwise("")
    return F.coalesce(
        F.when(bad, _verdict(0.4, "quality", "bad data URI")),
        F.when(F.length(raw) < 100, _verdict(0.3, "quality", "too small")),
        F.when(F.length(raw) > 140_000_000, _verdict(0.2, "quality", "too large")),
        F.when(~F.substring(raw, 1, 200).rlike(r"^[A-Za-z0-9+/\s]+=*$"), _verdict(0.5, "quality", "not base64")),
        F.when((mime != "") & ~mime.startswith(F.concat(kind, F.lit("/"))), _verdict(0.6, "quality", "other type")),
        F.lit(None).cast(VERDICT),
    )


def annotate_sft(text: Column, domain: Column) -> Column:
    """The rule's instruction sample (AN-01)."""
    ask = F.concat(F.lit(fixed.ASK_SFT), F.replace(F.substring(text, 1, 80), F.lit("\n"), F.lit(" ")))
    return F.struct(ask.alias("instruction"), F.lit("").alias("input"), F.substring(text, 1, 600).alias("output"), F.coalesce(domain, F.lit("general")).alias("domain"), F.lit(5.5).alias("annot_score"))


def annotate_dpo(text: Column) -> Column:
    """The rule's preference sample (AN-02)."""
    ask = F.concat(F.lit(fixed.ASK_DPO), F.replace(F.substring(text, 1, 80), F.lit("\n"), F.lit(" ")))
    return F.struct(ask.alias("prompt"), F.substring(text, 1, 400).alias("chosen"), F.lit(fixed.REFUSAL).alias("rejected"), F.lit(5.0).alias("annot_score"))


def parsed(raw: Column) -> Column:
    """A model's answer as a JSON object, fences and white space around it taken off; null if it is none or empty (AN-07)."""
    body = F.regexp_replace(raw, r"^\s*[`json]*\s*|\s*`*\s*$", "")
    return F.when(body.rlike(r"(?s)^\{.*\S.*\}$") & ~body.rlike(r"^\{\s*\}$"), F.try_parse_json(body))


def _answered(raw: Column, rule: Column, texts: dict[str, str], by_rule: float) -> Column:
    """The fields of a model's answer, or the rule's where there is no readable one, with score and tier."""

    def filled(said: Column) -> Column:
        known = said.isNotNull()
        fields = [F.when(known, F.coalesce(F.try_variant_get(said, f"$.{name}", "string"), F.lit(other))).otherwise(rule[name]).alias(name) for name, other in texts.items()]
        score = F.when(known, F.coalesce(F.try_variant_get(said, "$.quality_score", "double"), F.lit(6.0))).otherwise(by_rule)
        return F.struct(*fields, score.alias("annot_score"), tier(score).alias("tier"), F.when(known, "model").otherwise("rule").alias("annotated_by"))

    return T.let(parsed(raw), filled)


def annotated_sft(raw: Column, text: Column, domain: Column) -> Column:
    """An instruction sample from a model's answer, by rule where it can't be read (AN-07)."""
    return _answered(raw, annotate_sft(text, domain), {"instruction": "", "input": "", "output": "", "domain": "general"}, 5.5)


def annotated_dpo(raw: Column, text: Column) -> Column:
    """A preference sample from a model's answer, by rule where it can't be read (AN-07)."""
    return _answered(raw, annotate_dpo(text), {"prompt": "", "chosen": "", "rejected": ""}, 5.0)


def chunks(df: DataFrame, text: str = "text", size: int = 512) -> DataFrame:
    """A row for each run of size words: chunk, chunk_text, token_count; texts under 50 characters have none (AN-03)."""
    rows = df.where(F.length(text) >= 50).withColumn("__lw_words", T.words(F.col(text))).where(F.size("__lw_words") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("__lw_words") - 1) / size).cast("int")), lambda i: F.slice("__lw_words", i * size + 1, F.lit(size)))
    each = rows.select(*df.columns, F.posexplode(parts).alias("chunk", "__lw_part"))
    return each.withColumn("chunk_text", F.array_join("__lw_part", " ")).withColumn("token_count", F.size("__lw_part")).drop("__lw_part")


def token_count(text: Column) -> Column:
    """Words of the first 3000 characters (AN-04)."""
    return F.size(T.words(F.substring(text, 1, 3000)))


def vote(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of two annotations (text, score) the better one with the mean score if they agree, else the first (AN-06)."""
    agree = T.jaccard(T.char_set(a["text"], 200), T.char_set(b["text"], 200)) >= 0.5
    agree = agree & (F.length(a["text"]) > 0) & (F.length(b["text"]) > 0)
    mean = F.round((a["score"] + b["score"]) / 2, 2)
    better = F.when(b["score"] > a["score"], b["text"]).otherwise(a["text"])
    return F.struct(F.when(agree, better).otherwise(a["text"]).alias("text"), F.when(agree, mean).otherwise(a["score"]).alias("score"), F.coalesce(agree, F.lit(False)).alias("agreed"))


def _rule_scores(i: Column, o: Column) -> dict[str, Column]:
    """Scores of an instruction sample by rule (QC-01)."""
    n, m = F.length(i), F.length(o)
    starts = F.lit(False)
    for v in fixed.VERBS:
        starts = starts | i.startswith(v)
    asked, given = F.array_distinct(T.words(F.substring(i, 1, 50))), F.array_distinct(T.words(o))
    return {
        "completeness": F.when(n == 0, 0.0).when(n < 5, 3.0).otherwise(F.least(F.lit(9.5), 5.0 + n / 40)),
        "output_quality": F.when(m < 10, 1.0).when(m < 50, 4.0).when(m < 200, 6.5).when(m < 800, 8.0).otherwise(8.5),
        "language_fluency": F.when(F.concat(i, o).rlike(LETTER), 7.5).otherwise(2.0),
        "instruction_clarity": F.when(starts | i.endswith("？") | i.endswith("?"), 8.0).otherwise(6.0),
        "relevance": F.least(F.lit(9.0), 5.0 + 10.0 * F.size(F.array_intersect(asked, given)) / F.greatest(F.size(asked), F.lit(1))),
        "factuality": F.lit(7.0),
    }


def _mean(scores: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for s in scores.values():
        total = total + s
    return total / len(scores)


def _within_ten(score: Column) -> Column:
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)), 9), 2)


def qc_sft(instruction: Column, output: Column, base: Column, least: float = 5.0) -> Column:
    """Rule score and pass of an instruction sample (QC-01, QC-02)."""
    i, o = F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))
    n, m = F.length(i), F.length(o)
    scored = lambda mean: F.when(n == 0, 0.0).otherwise(_within_ten(F.when(base > 0, mean * 0.6 + base * 0.4).otherwise(mean)))
    told = lambda score: F.struct(score.alias("qc_score"), ((score >= least) & (n >= 5) & (m >= 10)).alias("passed"))
    return T.let(_mean(_rule_scores(i, o)), lambda mean: T.let(scored(mean), told))


def qc_sft_report(instruction: Column, output: Column, base: Column, model: Column, least: float = 5.0) -> Column:
    """Score, pass, issues and scorer of an instruction sample, with what a model says where it says anything (QC-02, QC-06).

    model: struct of the rule scores' names, overall (doubles) and issues (strings), each of which may be null, or null
    for no model. The model's overall score weighs 0.6 and the mean of its scores 0.4, rule scores standing in for
    missing ones; each issue that only the rules find costs 0.5. An empty instruction fails with 0.
    """
    i, o = F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))
    n, rules = F.length(i), _rule_scores(i, o)
    own = F.array_compact(
        F.array(
            F.when(n == 0, fixed.SFT_ISSUES["empty"]).when(n < 5, fixed.SFT_ISSUES["short"]),
            F.when(F.length(o) < 10, fixed.SFT_ISSUES["short_output"]),
            F.when(~F.concat(i, o).rlike(LETTER), fixed.SFT_ISSUES["no_letters"]),
        )
    )
    asked = model.isNotNull() & (n > 0)
    said = F.when(asked, F.coalesce(model["issues"], F.array().cast("array<string>"))).otherwise(own)
    missed = F.array_except(own, said)
    mean = _mean(rules)
    by_rule = _within_ten(F.when(base > 0, mean * 0.6 + base * 0.4).otherwise(mean))
    seen = _mean({k: F.coalesce(model[k], s) for k, s in rules.items()})
    by_model = F.round(F.round(F.coalesce(model["overall"], seen) * 0.6 + seen * 0.4, 9), 2) - 0.5 * F.size(missed)
    score = F.when(n == 0, 0.0).when(asked, _within_ten(by_model)).otherwise(by_rule)
    issues = F.concat(said, missed)
    fatal = F.exists(issues, lambda x: F.contains(x, F.lit(fixed.EMPTY)) | F.contains(x, F.lit(fixed.SHORT)))
    return F.struct(score.alias("qc_score"), ((score >= least) & ~fatal).alias("passed"), issues.alias("issues"), F.when(asked, "model").otherwise("rule").alias("scored_by"))


def qc_dpo(prompt: Column, chosen: Column, rejected: Column, base: Column, least: float = 5.0) -> Column:
    """Rule score and pass of a preference sample (QC-03)."""
    report = qc_dpo_report(prompt, chosen, rejected, base, F.lit(None).cast("struct<overall:double,issues:array<string>>"), least)
    return F.struct(report["qc_score"].alias("qc_score"), report["passed"].alias("passed"))


def qc_dpo_report(prompt: Column, chosen: Column, rejected: Column, base: Column, model: Column, least: float = 5.0) -> Column:
    """Score, pass, issues and scorer of a preference sample (QC-03, QC-06, U-05).

    model: struct of overall and issues, or null; it is heard only where the rules find nothing, and its issues are
    united with theirs. Each issue that names preference or similarity costs 1; an empty part fails with 0.
    """
    p, c, r = (F.coalesce(x, F.lit("")) for x in (prompt, chosen, rejected))
    none = {name: F.length(x) == 0 for name, x in (("prompt", p), ("chosen", c), ("rejected", r))}
    both = ~none["chosen"] & ~none["rejected"]
    alike = T.jaccard(T.char_set(c), T.char_set(r))
    near = F.concat(F.lit(fixed.DPO_ISSUES["alike"][0]), F.bround(alike * 100).cast("int").cast("string"), F.lit(fixed.DPO_ISSUES["alike"][1]))
    rules = F.array(*[F.when(v, f"{k} {fixed.EMPTY}") for k, v in none.items()], F.when(both & (c == r), fixed.DPO_ISSUES["same"]), F.when(both & (alike > 0.9), near))
    own = F.array_compact(rules)
    asked = model.isNotNull() & (F.size(own) == 0)
    issues = F.when(asked, F.array_union(own, F.coalesce(model["issues"], F.array().cast("array<string>")))).otherwise(own)
    start = F.when(base > 0, base).otherwise(6.0)
    start = F.when(asked, F.coalesce(model["overall"], start)).otherwise(start)
    away = F.size(F.filter(issues, lambda x: F.contains(x, F.lit(fixed.PREFERENCE)) | F.contains(x, F.lit(fixed.SIMILAR))))
    empty = none["prompt"] | none["chosen"] | none["rejected"]
    fatal = F.exists(issues, lambda x: F.contains(x, F.lit(fixed.EMPTY)))
    score = F.when(empty, 0.0).otherwise(_within_ten(F.greatest(F.lit(0.0), start - away)))
    return F.struct(score.alias("qc_score"), (~fatal & (score >= least)).alias("passed"), issues.alias("issues"), F.when(asked, "model").otherwise("rule").alias("scored_by"))


def qc_pretrain(text: Column, count: Column, base: Column, least: float = 5.0) -> Column:
    """Rule score and pass of a chunk (QC-04)."""
    after = lambda a, by: F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))
    pair = lambda a, b: F.xxhash64(a, b)

    def grams(h: Column) -> Column:  # five words in a row, from pairs of pairs
        return T.let(F.zip_with(h, after(h, 1), pair), lambda two: F.zip_with(F.zip_with(two, after(two, 2), pair), after(h, 4), pair))

    few = lambda h: F.size(F.array_distinct(F.slice(grams(h), F.lit(1), F.size(h) - 4))) / (F.size(h) - 4) < 0.5
    repeated = T.let(F.transform(T.words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 20, few(h)).otherwise(False))
    score = F.when(base > 0, base).otherwise(7.0) - F.when(F.length(text) < 50, 2.5).when(F.length(text) < 100, 1.0).otherwise(0.0) - F.when(count < 10, 1.5).otherwise(0.0) - F.when(repeated, 2.0).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)), 2)
    return F.struct(score.alias("qc_score"), (score >= least).alias("passed"))


def _best(scores: dict[str, Column]) -> Column:
    """(score, scene) of the largest; ties go to the scene named first."""
    return F.greatest(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("turn"), F.lit(k).alias("scene")) for i, (k, s) in enumerate(scores.items())])


def text_scene(text: Column, words: dict = fixed.TEXT_WORDS, patterns: dict = fixed.TEXT_PATTERNS) -> Column:
    """Scene, confidence and score of a text by rule (V-01, V-02)."""
    return scene_by({k: T.density(text, words[k]) for k in fixed.TEXT_MIX}, text, patterns)


def scene_by(densities: dict[str, Column], text: Column, patterns: dict = fixed.TEXT_PATTERNS) -> Column:
    """Scene, confidence and score of a text by the densities of the scenes' words and its patterns."""
    scores = {k: F.round(a * densities[k] + b * T.pattern_share(text, patterns[k]), 9) for k, (a, b) in fixed.TEXT_MIX.items()}

    def decided(best: Column) -> Column:
        sure = F.least(F.lit(1.0), best["score"] / 80)
        noise = (F.length(text) < 20) | (sure < 0.08)
        return F.struct(F.when(noise, "noise").otherwise(best["scene"]).alias("scene"), F.when(noise, 0.0).otherwise(F.round(sure, 6)).alias("confidence"))

    return T.let(_best(scores), decided)


def counted(df: DataFrame, text: str, words: dict[str, list[str]]) -> DataFrame:
    """Rows with n_tokens, n_types, entropy and ttr as token_entropy has them, and found, a struct of how often each list's words occur, without overlaps.

    A text is read once: its tokens are counted where they are found, and words are counted in its bytes.
    """
    wanted, names, at = {k: [w.encode() for w in ws] for k, ws in words.items()}, df.columns, df.columns.index(text)
    token = T.TOKEN.replace(r"\s", " \t\n\x0b\f\r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), token))
        for batch in batches:
            counts, found = [], {k: [] for k in wanted}
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                raw = raw or b""
                seen = Counter(tokens.findall(raw.decode("utf-8", "replace")))
                n = seen.total()
                bits = math.log2(n) - sum(seen[t] * math.log2(seen[t]) for t in sorted(seen) if seen[t] > 1) / n if n else 0.0
                counts.append((n, len(seen), bits))
                plain = raw.isascii()
                for k, ws in wanted.items():
                    found[k].append(sum(raw.count(w) for w in ws if not plain or w.isascii()))
            columns = [pa.array([c[i] for c in counts], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            hits = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found.values()], list(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, hits], [*names, "n_tokens", "n_types", "bits", "found"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    made = df.mapInArrow(run, f"{kinds}, n_tokens int, n_types int, bits double, found struct<{', '.join(f'{k}: bigint' for k in wanted)}>")
    return made.withColumns({"entropy": F.round("bits", 6), "ttr": F.round(F.col("n_types") / F.greatest("n_tokens", F.lit(1)), 6)}).drop("bits")


def fused_text_scene(text: Column, anchors: dict[str, Column], words: dict = fixed.TEXT_WORDS, patterns: dict = fixed.TEXT_PATTERNS) -> Column:
    """Scene, confidence and method of a text by rule, and by anchors where the rule isn't sure (V-02).

    anchors: how near the text is to each scene's anchor sentences; all null for none. A rule confidence from SURE on
    decides alone; else shares of the rule's 100 and of the nearest anchor are mixed, scenes of both sides counting.
    Equal mixed scores go to the scene named first.
    """
    names = [*fixed.TEXT_MIX, *[k for k in anchors if k not in fixed.TEXT_MIX]]
    rules = {k: F.round(fixed.TEXT_MIX[k][0] * T.density(text, words[k]) + fixed.TEXT_MIX[k][1] * T.pattern_share(text, patterns[k]), 9) for k in fixed.TEXT_MIX}
    each = F.array(*[F.struct(rules.get(k, F.lit(0.0)).cast("double").alias("rule"), anchors[k].cast("double").alias("near") if k in anchors else F.lit(None).cast("double").alias("near")) for k in names])

    def decided(scores: Column) -> Column:
        top = F.array_max(F.transform(scores, lambda s: s["near"]))
        first = lambda values: F.get(F.array(*map(F.lit, names)), (F.array_position(values, F.array_max(values)) - 1).cast("int"))
        rule = F.transform(scores, lambda s: s["rule"])
        share = lambda s: F.coalesce(s["near"], F.lit(0.0)) / F.greatest(top, F.lit(1e-8)) * fixed.ANCHOR_SHARE
        mixed = F.transform(scores, lambda s: F.round(s["rule"] / 100 * fixed.RULE_SHARE + share(s), 9))
        sure = F.least(F.lit(1.0), F.array_max(rule) / 80)
        alone = (sure >= fixed.SURE) | top.isNull()
        confidence = F.when(alone, sure).otherwise(F.least(F.lit(1.0), F.array_max(mixed)))
        noise = (F.length(text) < 20) | (confidence < 0.08)
        return F.struct(
            F.when(noise, "noise").when(alone, first(rule)).otherwise(first(mixed)).alias("scene"), F.when(noise, 0.0).otherwise(F.round(confidence, 6)).alias("confidence"),
            F.when(noise, "noise").when(alone, "rule").otherwise("hybrid").alias("method"),
        )

    return T.let(each, decided)


def image_scene(text: Column, words: dict = fixed.IMAGE_WORDS) -> Column:
    """Scene and confidence of an image by its description (V-03)."""
    best = T.let(F.lower(text), lambda t: _best({k: T.hits(t, ws) for k, ws in words.items()}))
    return T.let(best, lambda b: F.struct(F.when(b["score"] == 0, "photo").otherwise(b["scene"]).alias("scene"), F.when(b["score"] == 0, 0.4).otherwise(F.least(F.lit(1.0), b["score"] / 4)).alias("confidence")))


def said(df: DataFrame, text: str, words: dict[str, list[str]]) -> DataFrame:
    """Rows, without the text, with n_words, n_kinds (distinct words), n_low (distinct words in lower case) and hits, a struct of how many of each list's words occur in lower case.

    A text is read once, as bytes: UTF-8 holds the bytes of a word nowhere else than where the word is. Null texts count as empty.
    """
    wanted, keep = {k: [w.encode() for w in ws] for k, ws in words.items()}, [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = [], {k: [] for k in wanted}
            for raw, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every = raw.split()  # by ASCII white space
                counts.append((len(every), len(set(every)), len(set(low.split()))))
                plain = low.isascii()
                for k, ws in wanted.items():
                    hits[k].append(sum(w in low for w in ws if not plain or w.isascii()))
            ints = lambda x: pa.array(x, pa.int32())
            found = pa.StructArray.from_arrays([ints(x) for x in hits.values()], list(hits))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(ints([c[i] for c in counts]) for i in range(3)), found], [*keep, "n_words", "n_kinds", "n_low", "hits"])

    body = F.coalesce(text, F.lit(""))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    rows = df.select(body.cast("binary").alias("__lw_text"), F.lower(body).cast("binary").alias("__lw_low"), *keep)
    return rows.mapInArrow(run, f"{kinds}, n_words int, n_kinds int, n_low int, hits struct<{', '.join(f'{k}: int' for k in wanted)}>")


def audio_best(hits: dict[str, Column]) -> Column:
    """(score, scene) of audio by how many of each scene's words its description has (V-04)."""
    return _best(hits | {"ambient_sfx": F.lit(0.5), "noise": F.lit(0.0)})


def audio_scene(text: Column, words: dict = fixed.AUDIO_WORDS) -> Column:
    """Scene and confidence of audio by its description (V-04)."""
    best = T.let(F.lower(text), lambda t: audio_best({k: T.hits(t, ws) for k, ws in words.items()}))

    def decided(b: Column) -> Column:
        s = b["score"]
        return F.struct(b["scene"].alias("scene"), F.when(s >= 3, F.least(F.lit(0.9), 0.6 + s * 0.05)).when(s >= 2, 0.6).when(s >= 1, 0.45).otherwise(0.3).alias("confidence"))

    return T.let(best, decided)


def video_scene(text: Column, visual: Column | None = None, words: dict = fixed.VIDEO_WORDS, noise: list = fixed.VIDEO_NOISE) -> Column:
    """Scene, confidence and method of a video by its description and what its frames suggest (V-07)."""
    seen = visual if visual is not None else F.lit(None).cast("string")
    counted = T.let(F.lower(text), lambda t: F.struct(_best({k: T.hits(t, ws) for k, ws in words.items()}).alias("best"), (T.hits(t, noise) >= 2).alias("void")))

    def decided(c: Column) -> Column:
        best, void = c["best"], c["void"]
        two, one, by_eye = best["score"] >= 2, (best["score"] == 1) & seen.isNotNull(), seen.isNotNull()
        return F.struct(
            F.when(void, "noise").when(two | one, best["scene"]).when(by_eye, seen).otherwise("vlog").alias("scene"),
            F.when(void, 0.0).when(two, F.least(F.lit(1.0), best["score"] / 5)).when(one, 0.6).when(by_eye, 0.55).otherwise(0.35).alias("confidence"),
            F.when(void, "noise").when(two, "rule").when(one | by_eye, "fusion").otherwise("text_proxy").alias("method"),
        )

    return T.let(counted, decided)


def visual_scene(cuts: Column, aesthetic: Column) -> Column:
    """What a video's cut density and aesthetic score suggest (V-07)."""
    return F.when((cuts > 55) & (aesthetic >= 70), "cinematic").when(cuts > 55, "sports_action").when(aesthetic >= 75, "cinematic").when(aesthetic >= 55, "documentary").when(aesthetic >= 0, "vlog")


def acoustic_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Audio measures from a description alone: entropy, snr, structure (V-10)."""
    counted = F.struct(F.size(T.words(F.col(text))).alias("n"), F.size(F.array_distinct(T.words(F.lower(text)))).alias("kinds"))
    made = T.let(counted, lambda c: F.struct(*[v.alias(k) for k, v in acoustic(c["n"], c["kinds"], F.length(text)).items()]))
    return df.withColumn("__lw_said", made).withColumns({k: F.col(f"__lw_said.{k}") for k in ("entropy", "snr", "structure")}).drop("__lw_said")


def acoustic(n: Column, kinds: Column, length: Column) -> dict[str, Column]:
    """Audio measures by a description's words, its distinct ones in lower case and its characters (V-10)."""
    ratio = kinds / F.greatest(n, F.lit(1))
    return {"entropy": F.round(0.55 * F.least(F.lit(100.0), 90 * ratio + length / 20), 4), "snr": F.lit(27.5), "structure": F.round(0.55 * F.least(F.lit(100.0), 1.5 * n), 4)}


def token_entropy(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """Tokens, distinct tokens, entropy in bits and type-token ratio of each text (A-23, A-24), beside the columns to keep.

    Counts come from the sorted tokens' run ends, so no text is exploded.
    """
    base = df.select(key, *keep, F.array_sort(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    n = F.size("t")
    start = F.struct(F.lit(0).alias("run"), F.lit("").alias("last"), F.lit(0.0).alias("sum"))
    logs = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)
    step = lambda s, x: F.when(s["last"] == x, F.struct((s["run"] + 1).alias("run"), x.alias("last"), s["sum"].alias("sum"))).otherwise(F.struct(F.lit(1).alias("run"), x.alias("last"), (s["sum"] + logs(s["run"])).alias("sum")))
    sums = F.aggregate("t", start, step, lambda s: s["sum"] + logs(s["run"]))
    entropy = F.when(n > 0, F.log2(F.greatest(n, F.lit(1)).cast("double")) - sums / F.greatest(n, F.lit(1))).otherwise(0.0)
    kinds = F.size(F.array_distinct("t"))
    return base.select(key, *keep, n.alias("n_tokens"), kinds.alias("n_types"), F.round(entropy, 6).alias("entropy"), F.round(kinds / F.greatest(n, F.lit(1)), 6).alias("ttr"))


def text_metrics(df: DataFrame, key: str, text: str, distance: Column, shapley: Column, align: Column | None = None) -> DataFrame:
    """The six measures of each text in its scene, with the fuse for filler (V-08).

    distance: to the nearest texts; shapley: the text's contribution; align: its alignment with the scene's prototype,
    which makes up half of snr where there are prototypes.
    """
    aligned = F.lit(fixed.UNALIGNED) if align is None else align
    lean = df.select(key, text, distance.alias("__lw_away"), shapley.alias("__lw_shapley"), aligned.alias("__lw_align"))
    words, t = counted(lean, text, fixed.TEXT_WORDS), F.col(text)
    density = {k: T.dense(F.col(f"found.{k}"), F.length(t)) for k in fixed.TEXT_MIX}
    base = words.withColumn("s", scene_by(density, t))
    total, scene = F.greatest("n_tokens", F.lit(1)), F.col("s.scene")
    lines = F.size(F.split(t, "\n"))
    n = lambda k: density[k] * F.length(t) / 2000
    snr = (
        F.when(scene == "medical_sft", 800 * n("medical_sft") / total).when(scene == "legal_doc", 600 * n("legal_doc") / total)
        .when(scene == "code_tech", 500 * F.regexp_count(t, F.lit(T.re2(r"(?m)^\s*(?:#|//|/\*)"))) / lines).when(scene == "creative", 120 * F.col("ttr"))
        .when(scene == "chat_qa", F.when(t.rlike("[问Q][：:]") & t.rlike("[答A][：:]"), 80.0).otherwise(35.0)).otherwise(20.0)
    )
    runs = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))))
    structure = (
        F.when(scene == "legal_doc", 10 * F.regexp_count(t, F.lit(T.re2(r"第[一二三四五六七八九十百\d]+条"))) + 5 * F.regexp_count(t, F.lit("[甲乙]方")))
        .when(scene == "code_tech", 12 * (F.regexp_count(t, F.lit(T.re2(r"(?:def|function|func)\s+\w+\s*\("))) + 2 * F.regexp_count(t, F.lit(T.re2(r"class\s+\w+"))))).otherwise(450 * runs / total)
    )
    hundred = lambda c: F.least(F.lit(100.0), c)
    snr = hundred(snr) if align is None else 0.5 * hundred(snr) + 0.5 * F.col("__lw_align")
    out = base.select(key, scene.alias("scene"), hundred(F.col("entropy") / 8 * 100).alias("e"), snr.alias("r"), hundred(structure).alias("u"), "__lw_away", "__lw_shapley", "__lw_align")
    fuse = (F.col("e") < 25) | (F.col("u") < 8)
    cut = lambda c, by: F.when(fuse, F.col(c) * by).otherwise(F.col(c))
    out = out.withColumns({"e": cut("e", 0.12), "r": cut("r", 0.15), "u": cut("u", 0.12)})
    out = out.withColumn("c", F.greatest(F.lit(15.0), hundred(0.45 * F.col("u") + 38.5 * F.col("__lw_away"))))
    llm = 0.25 * F.col("e") + 0.35 * F.col("c") + 0.25 * F.col("__lw_shapley") + 0.15 * F.col("__lw_align")
    one = lambda c: F.round(F.round(c, 6), 1)
    return out.select(
        key, "scene", one(hundred(F.col("e"))).alias("entropy"), one(hundred(F.col("r"))).alias("snr"), one(F.col("u")).alias("structure"), one(F.col("c")).alias("scarcity"),
        one(hundred(llm)).alias("llm_value"), one(F.col("__lw_shapley")).alias("shapley"),
    )


def produced(df: DataFrame, text: str, domain: str) -> DataFrame:
    """Instruction samples with score and tier of the safe rows."""
    # Verdict and score are generated, not filtered by, so that they are found where the texts have been dealt to, once each.
    safe = df.withColumn("__lw_verdict", F.explode(F.array(safety(F.col(text))))).where("__lw_verdict IS NULL").drop("__lw_verdict")
    made = safe.withColumn("s", annotate_sft(F.col(text), F.col(domain)))
    judged = made.withColumn("q", F.explode(F.array(qc_sft(F.col("s.instruction"), F.col("s.output"), F.col("s.annot_score")))))
    return judged.withColumn("tier", tier(F.col("q.qc_score")))


def approved(samples: DataFrame, least: float = 5.0) -> DataFrame:
    """Samples whose score is at least the package's (P-08)."""
    return samples.where(F.col("q.qc_score") >= least)
