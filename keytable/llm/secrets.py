"""Secret scans: fixed patterns and a randomness test battery.

Base spans are the leftmost non-overlapping matches of three patterns (assign, access,
hex), less those that are too short. Beside them, every other token of ``LEAST``
characters or more, that is what base spans leave of it, is a candidate for the kind
``random``: its encoding is inferred (an alphabet of digits, letters, hex, base32, base36
or base64), and three tests ask whether it could be uniform noise in that alphabet:
chi-squared uniformity, Wald-Wolfowitz runs about the middle of the alphabet, and
lag-one serial correlation. The p-values are combined by Fisher's method.

Reports are controlled in both directions, within each class of lengths, since short
tokens say less. The Benjamini-Hochberg procedure drops the tokens that are not noise
(paths, counters) so that at most ``MISSED`` of what it drops is noise. And for every
candidate ``DECOYS`` pieces of ordinary text of the same document and length, without what
stands between its words, pass the same tests: how many of these look like noise tells
how many of the reports are false, and the p-value from which tokens are reported is the
lowest one for which that is at most ``rate`` of them. Without ordinary text to compare
with, the first procedure decides alone.

Only DataFrame functions. Positions come from splitting at the pattern and running
sums of piece lengths, so a text with very many matches costs in proportion. Both
procedures need only counts per length class and p-value bin, a table of bounded size.

Null texts are empty and have no spans; repeated rows each get a row; other columns
are ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, text_column

# The base patterns, the least length of a match (or of group 2), in order.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that are long enough
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
LEAST = 16
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "random")
RATE, MISSED, DECOYS = 0.1, 0.2, 8
BINS, PER_OCTAVE = 400, 4
# The alphabets of common encodings, the narrowest first.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("^[a-z]+$", LOWER), ("^[A-Z]+$", UPPER), ("^[A-Za-z]+$", UPPER + LOWER), ("^[0-9a-f]+$", DIGITS + "abcdef"), ("^[0-9A-F]+$", DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", UPPER + "234567"), ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[a-z0-9]+$", DIGITS + LOWER), ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER), ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
]
OTHER = UPPER + LOWER + DIGITS + "-_+/="


def _islands(spans: DataFrame) -> DataFrame:
    """(row, islands): per row its spans with overlapping and adjacent ones merged, as a
    sorted array of (s, e)."""
    own = W.partitionBy("row").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int")
    merged = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0))).groupBy("row", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("islands"))


def _without(islands: str, text: str, filler: str) -> str:
    """SQL: the text with ``filler`` (of the island x) in the place of each island."""
    begin = f"if(i = 0, 0, {islands}[i - 1].e)"
    end = f"if(i = size({islands}), length({text}), {islands}[i].s)"
    fill = f"if(i = size({islands}), '', transform(array({islands}[i]), x -> {filler})[0])"
    return f"array_join(transform(sequence(0, size({islands})), i -> concat(substring({text}, cast({begin} + 1 as int), cast({end} - {begin} as int)), {fill})), '')"


def _decoys(hits: DataFrame) -> DataFrame:
    """(value, decoy): per token and number one piece of the ordinary text of its row."""
    # as bytes, of which a piece is cut out without going through those before
    plain = F.encode(F.regexp_replace(F.regexp_replace("text", TOKEN, " "), "[^A-Za-z0-9]+", ""), "utf-8")
    rows = hits.where(F.col("text").rlike(TOKEN)).select(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"), plain.alias("plain"))
    at = "cast(pmod(conv(substr(md5(concat(v, ':', i, ':', k)), 1, 8), 16, 10)::bigint, octet_length(plain) - length(v) + 1) as int)"
    pieces = F.expr(f"flatten(transform(tokens, (v, i) -> if(octet_length(plain) < length(v), array(), transform(sequence(0, {DECOYS - 1}), k -> cast(substring(plain, {at} + 1, length(v)) as string)))))")
    return rows.select(F.explode(pieces).alias("value"))


def _matches(hits: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """(row, kind, start, end, value) of the matches whose group is long enough."""
    found = hits.where(F.col("text").rlike(pattern)).select(
        "row", "doc_id",
        F.posexplode(F.arrays_zip(
            F.split("text", pattern, -1).alias("before"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
        )).alias("i", "m"),
    )
    found = found.select("row", "i", "m.*").where(F.col("match").isNotNull())
    moved = F.sum(F.length("before") + F.length("match")).over(W.partitionBy("row").orderBy("i"))
    found = found.withColumn("end", moved.cast("long")).withColumn("start", F.col("end") - F.length("match"))
    return found.where(F.length("value") >= least).select("row", F.lit(kind).alias("kind"), "start", "end", "value")


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(1e-300), F.exp(-z * z / 2) * 0.3989422804014327 * poly)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.least(F.abs(z), F.lit(37.0))))


def test_battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` with column p: the combined p-value of noise in the inferred alphabet."""
    value = F.regexp_replace("value", "=+$", "")
    alphabet = F.lit(OTHER)
    for pattern, letters in reversed(ALPHABETS):
        alphabet = F.when(F.col("plain").rlike(pattern), F.lit(letters)).otherwise(alphabet)
    # stages, so that each array is made once
    t = tokens.withColumn("plain", value).withColumn("alphabet", alphabet).withColumn("n", F.length("plain").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    t = t.where(F.col("n") >= LEAST)
    t = t.withColumn("codes", F.expr("transform(filter(split(plain, ''), c -> c <> ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    t = t.withColumn("squares", F.expr("aggregate(array_distinct(codes), 0D, (s, d) -> s + pow(size(filter(codes, c -> c = d)), 2))"))
    t = t.withColumn("chi2", F.col("k") / F.col("n") * F.col("squares") - F.col("n"))
    t = t.withColumn("high", F.expr("transform(codes, c -> if(c >= k / 2, 1, 0))"))
    t = t.withColumn("n1", F.expr("cast(aggregate(high, 0, (s, h) -> s + h) as double)")).withColumn("n0", F.col("n") - F.col("n1"))
    t = t.withColumn("runs", F.expr("1D + size(filter(sequence(1, size(high) - 1), i -> high[i] <> high[i - 1]))"))
    t = t.withColumn("mean", F.expr("aggregate(codes, 0D, (s, c) -> s + c) / n"))
    t = t.withColumn("var", F.expr("aggregate(codes, 0D, (s, c) -> s + (c - mean) * (c - mean))"))
    t = t.withColumn("cov", F.expr("aggregate(sequence(1, size(codes) - 1), 0D, (s, i) -> s + (codes[i] - mean) * (codes[i - 1] - mean))"))
    df = F.col("k") - 1
    z_chi = (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    both = 2 * F.col("n1") * F.col("n0")
    spread = both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    z_runs = F.when(spread > 0, (F.col("runs") - 1 - both / F.col("n")) / F.sqrt(spread)).otherwise(F.sqrt("n"))  # one-sided codes: a strong sign
    z_serial = F.when(F.col("var") > 0, F.col("cov") / F.col("var") * F.sqrt("n")).otherwise(F.sqrt("n"))
    t = t.withColumn("fisher", -2 * sum((F.log(_two_sided(z)) for z in (z_chi, z_runs, z_serial)), F.lit(0.0)))
    h = F.col("fisher") / 2
    p = F.exp(-h) * (1 + h + h * h / 2)  # upper tail of chi-squared with 6 degrees of freedom
    return t.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p))).drop("codes", "high", "squares", "chi2", "n1", "n0", "runs", "mean", "var", "cov", "fisher")


def _binned(tested: DataFrame) -> DataFrame:
    return tested.withColumn("class", F.floor(2 * F.log2("n")).cast("int")).withColumn("bin", F.least(F.lit(BINS), F.floor(-F.log2("p") * PER_OCTAVE)).cast("int"))


def reported(tested: DataFrame, decoys: DataFrame, rate: float, missed: float) -> DataFrame:
    """The tokens that both procedures leave, per length class. A higher bin is a lower
    p-value."""
    binned = _binned(tested)
    each = binned.groupBy("class", "bin").agg(F.count("*").alias("c"))
    other = _binned(decoys).groupBy("class", "bin").agg(F.count("*").alias("d"))
    counts = each.join(other, ["class", "bin"], "full").na.fill(0, ["c", "d"])
    every = W.partitionBy("class")
    total, decoy_total = F.sum("c").over(every), F.sum("d").over(every)
    lower = F.sum("c").over(every.orderBy(F.col("bin").desc()))  # of lower p-values, with this bin
    upper, decoys_upper = F.sum("c").over(every.orderBy("bin")), F.sum("d").over(every.orderBy("bin"))
    largest = F.pow(F.lit(2.0), -F.col("bin") / PER_OCTAVE)  # of the p-values in a bin
    false = F.when(decoy_total > 0, (decoys_upper + 1) * total / decoy_total).otherwise(0.0)
    judged = counts.select("class", "bin", ((F.col("c") > 0) & (largest <= missed * lower / total)).alias("dropped"), (false <= rate * upper).alias("sure"))
    limits = judged.groupBy("class").agg(F.min(F.when(F.col("dropped"), F.col("bin"))).alias("limit"), F.max(F.when(F.col("sure"), F.col("bin"))).alias("upto"))
    # at most two classes per octave of length and one row each: a proven bound
    return binned.join(F.broadcast(limits), "class").where((F.col("limit").isNull() | (F.col("bin") < F.col("limit"))) & (F.col("bin") <= F.col("upto")))


def may_hold(text: Column) -> Column:
    """Whether any pattern matches; most texts end here."""
    return text.rlike(TOKEN) | text.rlike(HEX) | (text.contains("AKIA") & text.rlike(ACCESS)) | text.rlike(ASSIGN)


def find(docs: DataFrame, *, rate: float = RATE, missed: float = MISSED) -> DataFrame:
    """(doc_id, text of rows that may hold secrets, spans): spans is an array of
    (start, kind, end, order) sorted by start, then kind as listed in ``KINDS``."""
    text = text_column(docs)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(may_hold(text), text).alias("text")), "gated")
    hits = rows.where(F.col("text").isNotNull())
    base = None
    for kind, pattern, group, least in BASE:
        found = _matches(hits, kind, pattern, group, least)
        base = found if base is None else base.unionByName(found)
    base = materialize(base, "base")
    blank = F.expr(_without("islands", "text", "repeat(' ', cast(x.e - x.s as int))"))
    rest = materialize(hits.select("row", "doc_id", "text").join(_islands(base), "row", "left").select("row", "doc_id", F.when(F.col("islands").isNull(), F.col("text")).otherwise(blank).alias("text")), "rest")
    # both are tested together and once: the battery is the largest plan here, and the driver holds it each time it is used
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("kind", "string"), ("start", "long"), ("end", "long"))]
    asked = _matches(rest, "random", TOKEN, 0, LEAST).unionByName(_decoys(rest).select(*nothing, "value"))
    tested = materialize(test_battery(materialize(asked, "tokens")).select("row", "kind", "start", "end", "value", "n", "p"), "tested")
    random = reported(tested.where(F.col("kind").isNotNull()), tested.where(F.col("kind").isNull()), rate, missed).select("row", "kind", "start", "end", "value")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = base.unionByName(random).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("spans"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:long,order:int,kind:string,end:long>>")
    return rows.join(spans, "row", "left").select("doc_id", "row", "text", F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, *, rate: float = RATE, missed: float = MISSED, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping and adjacent ones merged) replaced by ``mark``. Texts
    that no pattern matches are not shuffled."""
    marked = docs.withColumn("__id", F.monotonically_increasing_id()).withColumn("__gate", F.coalesce(may_hold(F.col("text").cast("string")), F.lit(False)))
    marked = materialize(marked, "marked")
    tagged = marked.where("__gate")
    narrow = tagged.select(F.col("__id").alias("doc_id"), "text")
    found = find(narrow, rate=rate, missed=missed).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    each = found.select(F.col("__id").alias("row"), F.explode("__spans").alias("x")).select("row", "x.start", "x.end")
    joined = tagged.join(_islands(each).select(F.col("row").alias("__id"), F.col("islands").alias("__islands")), "__id", "left")
    clean = F.when(F.col("__islands").isNull(), F.col("text")).otherwise(F.expr(_without("__islands", "text", f"'{mark}'")))
    return marked.where("not __gate").select(*docs.columns).unionByName(joined.withColumn("text", clean).select(*docs.columns))
