"""Benchmark decontamination by template windows: numbers, names and units become typed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.session import Workspace

#: Tokens in a window; shorter items are one window of all their tokens. Windows under LEAST tokens match verbatim only.
WINDOW = 8
LEAST = 4
#: Share of an item's windows that a document must hold.
SHARE = 0.25
#: Rows of narrow columns (window hashes, flagged documents) that are sent to all tasks at most; more are joined by shuffle.
SENT = 500_000

# Words that begin sentences and are no names, number words, and units after a number.
OPENERS = [
    "a", "an", "the", "this", "that", "these", "those", "he", "she", "it", "they", "we", "you", "his", "her", "their", "its", "our", "your", "my", "what", "which", "who", "whose", "where", "when", "why", "how",
    "if", "after", "before", "then", "there", "in", "on", "at", "by", "for", "from", "of", "to", "with", "and", "or", "but", "as", "each", "every", "all", "both", "some", "let", "find", "compute", "calculate", "given",
    "suppose", "assume", "solve", "sort", "is", "are", "was", "were", "does", "do", "did", "can", "will", "has", "have", "not", "no", "so", "while", "during", "since", "until",
    "der", "die", "das", "ein", "eine", "und", "wie", "was", "wer", "wenn", "le", "la", "les", "un", "une", "des", "et", "si", "el", "los", "las", "una", "y", "que",
]
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
]
UNITS = [
    "km", "m", "cm", "mm", "mi", "mile", "miles", "foot", "feet", "ft", "inch", "inches", "yard", "yards", "kg", "g", "mg", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons", "tonne", "tonnes",
    "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "degree", "degrees", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
    "gram", "grams", "kilogram", "kilograms",
]
NUMBER, NAME, UNIT = "#", "@", "%"


def plain(text: Column) -> Column:
    """Letters, digits and underscores, one space between tokens; separators inside a number become underscores."""
    c = F.coalesce(text, F.lit(""))
    joined = F.when(c.rlike("[0-9][.,][0-9]"), F.regexp_replace(c, r"(?<=[0-9])[.,](?=[0-9])", "_")).otherwise(c)
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", " "))


def _slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _tokenised(table: DataFrame, text: Column, *keep: Column | str) -> DataFrame:
    """keep, raw and tokens: a text's tokens in lower case, and with typed slots for numbers, units after one, and names.

    A name is any token that begins with a capital, has a small letter and is none of OPENERS. That also takes
    ordinary words at the start of a sentence, which stand for themselves in a copy. A text without a token has an empty one.
    Lambdas use their own arguments only: a column inside one may be computed again for every token.
    """

    def one(low: Column, cased: Column) -> Column:
        number = (F.ascii(low).between(48, 57) & low.rlike("^[0-9_]+$")) | low.isin(NUMBER_WORDS)
        name = (cased != low) & (F.substring(cased, 1, 1) != F.substring(low, 1, 1)) & (cased != F.upper(cased)) & ~low.isin(OPENERS)
        return F.when(number, NUMBER).when(name, NAME).otherwise(low)

    words = table.select(*keep, plain(text).alias("plain"))
    words = words.select("*", F.split("plain", " ").alias("cased"), F.split(F.lower("plain"), " ").alias("raw")).drop("plain")
    words = words.withColumn("marked", F.zip_with("raw", "cased", one)).drop("cased")
    before = F.concat(F.array(F.lit("")), F.slice("marked", F.lit(1), F.size("marked") - 1))
    unit = lambda t, last: F.when((last == NUMBER) & t.isin(UNITS), UNIT).otherwise(t)
    return words.withColumn("tokens", F.zip_with("marked", before, unit)).drop("marked")


def _with_windows(table: DataFrame, tokens: str, sizes: list[int]) -> DataFrame:
    """The table with columns {tokens}_{n}: for each of the sizes a hash for each n tokens in a row, empty if there are fewer.

    Hashes of 2, 4 and 8 tokens come from pairs of shorter ones, other sizes from those: a few passes over the whole
    array, whatever the size.
    """
    out = table.withColumn(f"{tokens}__1", F.transform(tokens, lambda t: F.xxhash64(t)))
    pair = lambda a, b: F.xxhash64(a, b)
    shifted = lambda name, by: F.slice(name, F.lit(by + 1), F.greatest(F.size(name) - by, F.lit(0)))
    n = 1
    while 2 * n <= max(sizes, default=1):
        out = out.withColumn(f"{tokens}__{2 * n}", F.zip_with(f"{tokens}__{n}", shifted(f"{tokens}__{n}", n), pair))
        n *= 2
    for size in sizes:
        bits = [1 << i for i in reversed(range(size.bit_length())) if size >> i & 1]
        whole, done = F.col(f"{tokens}__{bits[0]}"), bits[0]
        for bit in bits[1:]:
            whole, done = F.zip_with(whole, shifted(f"{tokens}__{bit}", done), pair), done + bit
        out = out.withColumn(f"{tokens}_{size}", F.slice(whole, F.lit(1), F.greatest(F.size(tokens) - size + 1, F.lit(0))))
    return out


def item_windows(benchmark: DataFrame, work: Workspace, item: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """Each item's windows (item, size, pos, n_windows, n_template, fit, slotted, raw, tokens, and the hashes of both), and their sizes.

    fit: not under LEAST tokens and less than half of them slots; only those match as templates, and n_template counts
    them. All windows match by their raw tokens. Items without a token have no windows. numeric_hash is that of the
    template with its names as they are, which a text without capitals, or of capitals only, has; null where it is
    one of the other two.
    """
    base = _tokenised(benchmark.where(plain(F.col(text)) != ""), F.col(text), F.col(item).alias("item"))
    base = work.table(base.withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW))), "items")
    sizes = sorted(r["size"] for r in base.select("size").distinct().collect())
    named = F.zip_with("tokens", "raw", lambda t, r: F.when(t == NAME, r).otherwise(t))
    each = _with_windows(_with_windows(_with_windows(base, "raw", sizes), "tokens", sizes).withColumn("numeric", named), "numeric", sizes)
    hashes = lambda name: F.coalesce(*[F.when(F.col("size") == n, F.col(f"{name}_{n}")) for n in sizes]) if sizes else F.array().cast("array<long>")
    each = each.select("item", "size", "raw", "tokens", F.posexplode_outer(F.arrays_zip(hashes("raw").alias("raw_hash"), hashes("tokens").alias("hash"), hashes("numeric").alias("numeric"))).alias("pos", "h"))
    cut = lambda c: F.slice(c, F.col("pos") + 1, F.col("size"))
    each = each.select("item", "size", "pos", F.col("h.raw_hash").alias("raw_hash"), F.col("h.hash").alias("hash"), F.when(~F.col("h.numeric").isin(F.col("h.hash"), F.col("h.raw_hash")), F.col("h.numeric")).alias("numeric_hash"), cut("raw").alias("raw"), cut("tokens").alias("tokens"), (F.size("raw") - F.col("size") + 1).alias("n_windows"))
    each = each.withColumn("slots", F.size(F.filter("tokens", _slot)))
    fit = (F.col("size") >= LEAST) & (F.col("slots") * 2 < F.col("size"))
    each = each.withColumn("fit", fit).withColumn("slotted", F.col("fit") & (F.col("slots") > 0)).drop("slots")
    count = F.sum(F.col("fit").cast("int")).over(Window.partitionBy("item", "n_windows"))
    return work.table(each.withColumn("n_template", count), "windows"), sizes


def _sent(table: DataFrame) -> DataFrame:
    """The table, to be sent to all tasks if it has SENT rows at most."""
    return F.broadcast(table) if table.limit(SENT + 1).count() <= SENT else table


def _hits(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Every place of a document (key, text_hash, text) whose window equals an item's, raw or as template."""
    slots = {r["size"] for r in items.where("slotted").select("size").distinct().collect()}
    blocks = [(n, kind) for n in sizes or [WINDOW] for kind in (False, True) if not kind or n in slots]
    every = sizes or [WINDOW]
    lean = _with_windows(_tokenised(docs, F.col("text"), "key", "text_hash"), "raw", every)
    lean = _with_windows(lean.withColumn("tokens", F.when(F.exists("tokens", _slot), F.col("tokens")).otherwise(F.array().cast("array<string>"))), "tokens", every)
    parts = []
    for n, slotted in blocks:  # no hash where a window has no slot
        parts.append(F.zip_with(f"raw_{n}", f"tokens_{n}", lambda a, b: F.when(a != b, b)) if slotted else F.col(f"raw_{n}"))
    lean = lean.select("key", "text_hash", F.size("raw").alias("m"), F.flatten(F.array(*parts)).alias("windows"))
    right = None
    for i, (n, slotted) in enumerate(blocks):
        some = items.where((F.col("size") == n) & (F.col("slotted") if slotted else F.lit(True)))
        some = some.select(F.explode(F.array_compact(F.array("hash", "numeric_hash"))).alias("h") if slotted else F.col("raw_hash").alias("h"), "item", "pos", "fit", "n_windows", "n_template", F.lit(i).alias("block"))
        right = some if right is None else right.unionByName(some)
    each = lean.select("key", "text_hash", "m", F.posexplode_outer("windows").alias("p", "h"))  # outer: no filter that computes all of it again
    before, at = F.lit(0), F.lit(None).cast("int")
    for i, (n, _) in enumerate(blocks):
        at = F.when(F.col("block") == i, F.col("p") - before).otherwise(at)
        before = before + F.greatest(F.col("m") - n + 1, F.lit(0))
    slotted = F.col("block").isin([i for i, (_, s) in enumerate(blocks) if s])
    return each.join(_sent(right), "h").select("key", "text_hash", "item", "pos", "fit", "n_windows", "n_template", at.alias("at"), slotted.alias("slotted"))


def _lines(docs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """Template matches by diagonal: the windows that count there (places), and whether all their slots are the item's own (same).

    An item's value stands for the document's value that it has in most windows of the diagonal (ties: the least), and
    a name of the document for one name only, chosen alike. Windows in which a slot stands for something else don't
    count, and the diagonal only counts if such slots have less than half of its different values.
    """
    own = hits.where("slotted").groupBy("key", "text_hash").agg(F.collect_set(F.struct("item", "pos", "at")).alias("hits"))
    own = own.withColumnsRenamed({"key": "k", "text_hash": "x"})
    texts = docs.join(_sent(own), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("x")))
    texts = texts.select("key", "text_hash", "hits", F.split(F.lower(plain(F.col("text"))), " ").alias("words"))
    each = texts.select("key", "text_hash", "words", F.explode_outer("hits").alias("h")).select("key", "text_hash", "h.*", F.slice("words", F.col("h.at") + 1, F.lit(WINDOW)).alias("found"))
    each = each.join(_sent(items.where("slotted").select("item", "pos", "raw", "tokens", "n_windows", "n_template")), ["item", "pos"])
    pairs = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("kind"), F.get("raw", i).alias("a"), F.get("found", i).alias("b"))), lambda p: _slot(p["kind"]))
    each = each.select("key", "text_hash", "item", "n_windows", "n_template", "pos", (F.col("at") - F.col("pos")).alias("diagonal"), pairs.alias("pairs"))
    of = ["key", "text_hash", "item", "n_windows", "n_template", "diagonal"]
    slots = each.select(*of, "pos", F.explode("pairs").alias("p")).select(*of, "pos", "p.*").distinct()
    slots = slots.withColumn("less", -F.count("*").over(Window.partitionBy(*of, "kind", "a", "b")))
    best = lambda own, other: F.min(F.struct("less", F.col(other).alias("best"))).over(Window.partitionBy(*of, "kind", own))["best"]
    slots = slots.withColumn("good", (best("a", "b") == F.col("b")) & ((F.col("kind") != NAME) | (best("b", "a") == F.col("a"))))
    value = F.struct("kind", "a")
    place = slots.groupBy(*of, "pos").agg(F.min("good").alias("good"), F.min(F.col("a") == F.col("b")).alias("same"), F.collect_set(value).alias("values"), F.collect_set(F.when(~F.col("good"), value)).alias("bad"))
    number = lambda name: F.size(F.array_distinct(F.flatten(F.collect_set(name))))
    line = place.groupBy(*of).agg(F.collect_set(F.when(F.col("good"), F.col("pos"))).alias("places"), F.min(F.when(F.col("good"), F.col("same"))).alias("same"), number("values").alias("n_values"), number("bad").alias("n_bad"))
    return line.where((F.col("n_bad") * 2 < F.col("n_values")) & (F.size("places") > 0))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document and item that it leaks: key, text_hash, item_id, windows held, their share, and whether verbatim.

    Every window of every document is hashed twice, by its raw tokens in lower case and by its template, and joined
    with the items' windows; what is shuffled beyond SENT windows is keys, places and hashes. Template matches on one
    diagonal (document place less item place) belong together: there each slot value of the item stands for one
    value of the document, and two names for two names; two numbers may become one. Windows that break this don't
    count, and nothing on a diagonal does where half of the item's values or more break it. Text without capitals, or
    of capitals only, shows no names: there an item's names match as they are, its numbers and units as slots. The document leaks the item if it holds SHARE of the item's windows or more, or of those that can
    match as templates, so that numeric passages can't hide a changed copy; share is the greater of the two.

    Items of slots only, and short ones, match verbatim: an item of one word is leaked by every document with that
    word. Null and empty texts, and texts or items without a letter or digit, leak nothing; very long texts are cut by
    nothing; repeated rows give one result, as rows are told apart by key and text; equal items give one result each;
    an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "decontam")
    items, sizes = item_windows(benchmark, work)
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    hits = work.table(_hits(texts, items, sizes), "hits")
    of = ["key", "text_hash", "item", "n_windows", "n_template"]
    line = _lines(texts, items, hits)
    fit = items.where("fit AND slotted").select("item").distinct().isEmpty()
    raw = hits.where("NOT slotted").groupBy(*of).agg(F.collect_set("pos").alias("held"), F.collect_set(F.when(F.col("fit"), F.col("pos"))).alias("fitting"), F.lit(True).alias("same"))
    both = raw if fit else raw.unionByName(line.groupBy(*of).agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("held"), F.min("same").alias("same")).withColumn("fitting", F.col("held")))
    count = lambda places: F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long")
    whole = both.groupBy(*of).agg(count("held").alias("held"), count("fitting").alias("fitting"), F.min("same").alias("verbatim"))
    share = F.greatest(F.col("held") / F.col("n_windows"), F.when(F.col("n_template") > 0, F.col("fitting") / F.col("n_template")))
    return whole.where(share >= SHARE).select(F.col("key").alias(key), "text_hash", F.col("item").alias("item_id"), "held", share.alias("share"), "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that leak an item of the benchmark; what leaks is as in find, other rows and columns stay."""
    bad = find(docs, benchmark, key, text).select(F.col(key).alias("__lw_key"), F.col("text_hash").alias("__lw_hash")).distinct()
    bad = Workspace(docs.sparkSession, "decontam").table(bad, "leaks")  # counted and joined, but found once
    return docs.join(_sent(bad), F.col(key).eqNullSafe(F.col("__lw_key")) & (F.xxhash64(text) == F.col("__lw_hash")), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item that it leaks: doc_id, item_id, held, share, verbatim; documents that leak nothing have no row (find)."""
    return find(docs, benchmark).drop("text_hash")
