"""Secrets by corpus-wide ownership: values that many owners share are examples, values of one owner look live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.skew import HOT, looked_up
from loamworks.llm.spans import joined, match_spans, untouched
from loamworks.session import Workspace

KINDS = ("assign", "access", "hex")

# The base patterns; a look-behind or a least length keeps runs linear and leaves the matches as they are.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
VALUE = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"

# Further forms of credentials.
MORE = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,255}+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,200}+",
    "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,128}+",
    "google": r"AIza[A-Za-z0-9_-]{35}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "private_key": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----",
    "url": r"[a-z][a-z0-9+]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]++",
}
MORE_SIGN = r"gh[pousr]_|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ|PRIVATE KEY|://[^\s:/@]{1,64}:"

# What placeholder values look like.
PLACEHOLDER = r"(?i)example|placeholder|changeme|change_me|dummy|sample|your[_-]|xxxx|1234567|abcdef|test|<|^(.)\1*$"
#: Owners, or distinct repositories of any owner, from which a value counts as widely copied.
COMMON, COMMON_REPOSITORIES = 3, 20
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,digest:string,placeholder:boolean>>"


def _found(text: Column, kind: str, pattern: str, rank: int) -> Column:
    spans = match_spans(text, pattern)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], VALUE, 1)) >= 6)
    value = lambda s: F.regexp_extract(s["match"], VALUE, 1) if kind == "assign" else s["match"]
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(value(s), 256).alias("digest"), value(s).rlike(PLACEHOLDER).alias("placeholder")))


def spans(text: Column) -> Column:
    """All spans by start, then kind: base ones, and other credentials that touch no base span. Null is empty.

    A span holds its value's SHA-256 digest and whether it looks like a placeholder, never the value.
    """
    c = F.coalesce(text, F.lit(""))
    base = F.concat(*[_found(c, k, BASE[k], i) for i, k in enumerate(KINDS)]).cast(SPANS)
    other = F.concat(*[_found(c, k, p, len(KINDS) + i) for i, (k, p) in enumerate(MORE.items())]).cast(SPANS)
    more = F.when(c.rlike(MORE_SIGN), untouched(other, base)).otherwise(F.array().cast(SPANS))
    return F.array_sort(F.concat(base, more))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value digest: rows, distinct repositories (per owner) and distinct owners; copies are counted before they are moved."""
    pairs = candidates.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return owners.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def places(candidates: DataFrame) -> DataFrame:
    """Per value digest its distinct repositories where all exact copies of a text are in one, the smallest of theirs."""
    homes = candidates.groupBy("digest", "print").agg(F.min("repository").alias("repository")).groupBy("digest", "repository").agg(F.lit(1).alias("n"))
    return homes.groupBy("digest").agg(F.count("*").alias("places"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, spans and verdicts: the digest, owners, repositories and class of each distinct value.

    Classes: "copied" from COMMON owners or COMMON_REPOSITORIES repositories on, for which exact copies of a text are
    one, "placeholder" by its looks, else "live". Null owners and repositories are one of their own. Null and empty
    texts, and others without candidates, get empty arrays; very long texts are searched whole; repeated rows stay
    and count as rows, not as owners. No value is written or returned, only SHA-256 digests.

    Rows with the same digests share a verdict; digests and sets of them that many rows have are looked up without
    a shuffle.
    """
    work = Workspace(docs.sparkSession, "secrets")
    owner = owner if owner is not None else F.lit(None).cast("string")
    repository = repository if repository is not None else F.col(key).cast("string")
    found = docs.select(F.col(key).alias("key"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.xxhash64(text).alias("print"), spans(F.col(text)).alias("spans"))
    found = work.table(found, "found")
    marked = found.where(F.size("spans") > 0).withColumn("digests", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["digest"]))))
    row_set = F.sha2(F.array_join("digests", ","), 256)
    marked = marked.withColumn("set", row_set)
    each = marked.select("owner", "repository", "print", F.explode("digests").alias("digest"))
    kind = F.when((F.col("owners") >= COMMON) | (F.col("places") >= COMMON_REPOSITORIES), "copied").when(F.col("placeholder"), "placeholder").otherwise("live")
    looks = found.select(F.explode("spans").alias("s")).groupBy("s.digest").agg(F.max("s.placeholder").alias("placeholder"))
    owned = ownership(each).withColumnRenamed("n", "rows").join(places(each), "digest").join(looks, "digest")
    sets = marked.groupBy("set").agg(F.count("*").alias("n"), F.first("digests").alias("digests"))
    total = work.table(sets, "sets").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    sets = work.spark.read.parquet(f"{work.at}/sets")
    owned = work.table(owned.select("digest", "owners", "repositories", kind.alias("class"), (F.col("rows") * HOT > total).alias("hot")), "owned")
    looked = looked_up(sets.select("set", F.explode("digests").alias("digest")), owned, "digest")
    verdicts = looked.groupBy("set").agg(F.array_sort(F.collect_set(F.struct("digest", "owners", "repositories", "class"))).alias("verdicts"))
    verdicts = work.table(verdicts.join(sets.select("set", (F.col("n") * HOT > total).alias("hot")), "set"), "verdicts")
    with_value = looked_up(marked.select("key", "spans", "set"), verdicts, "set").select("key", "spans", "verdicts")
    empty = F.array().cast("array<struct<digest:string,owners:bigint,repositories:bigint,class:string>>")
    return with_value.unionByName(found.where(F.size("spans") == 0).select("key", "spans", empty.alias("verdicts"))).withColumnRenamed("key", key)


def digest(docs: DataFrame) -> DataFrame:
    """Per document its counts, the digest of its base spans, all spans, and how many values are live or copied."""
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of = lambda name: F.size(F.filter("verdicts", lambda v: v["class"] == name)).cast("long").alias(f"n_{name}")
    found = scan(docs, owner=F.col("source"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *[of(n) for n in ("live", "copied", "placeholder")])
