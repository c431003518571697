"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

All of it is DataFrame functions. A pattern's spans come from two built-ins over the same pattern:
the matches, and the gaps that a split leaves between them; running sums of their lengths give the
code points where each match stands.

The Markov part looks at long runs of key characters. Two first-order models, one of random strings
and one of ordinary identifiers, are counted from a labelled table of samples; the log-likelihood
ratio of each transition becomes a constant matrix of fixed size in the plan, and a run whose summed
ratio exceeds THRESHOLD is a secret. The default samples are digests in the usual alphabets against words
of the corpus, joined as identifiers are, numbers and rules.

Defined results: null text counts as empty; texts without secrets have 0 counts, the digest of the
empty string and empty spans. Repeated rows are scanned each. Extra columns pass through ``scan``;
columns named like its results are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns, letters of the keyword in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kind, pattern, group whose length counts, least length; in the order in which kinds are listed.
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: What may hold a match that is long enough: the cheap test before the exact one.
_MAY = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MARKOV = "markov"
#: Nats by which the random model must win.
THRESHOLD = 12.0
#: Documents whose words teach the ordinary model by default: those with the smallest hashed ids.
SAMPLE_DOCUMENTS = 100
RANDOM_SAMPLES = 2000
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SIZE = len(ALPHABET) + 1  # the last class: any other character, and the beginning
MASK = "[SECRET]"


@dataclass(frozen=True)
class Model:
    """ratios[a * _SIZE + b]: log-likelihood ratio, random over ordinary, of class b behind class a."""

    ratios: tuple[float, ...]


def default_samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(sample, random): a bounded labelled table of random strings and ordinary identifiers."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    encoded = F.base64(F.unhex(digest))
    random = docs.sparkSession.range(RANDOM_SAMPLES).select(
        F.explode(F.array(digest, F.substring(digest, 1, 40), encoded, F.translate(encoded, "+/=", "-_"), F.regexp_replace(encoded, "[^A-Za-z0-9]", ""), F.upper(F.regexp_replace(encoded, "[^A-Za-z0-9]", "")))).alias("sample"),
        F.lit(1).alias("random"),
    )
    few = docs.select(doc_id, F.col(text).cast("string").alias("text")).orderBy(F.xxhash64(doc_id), doc_id).limit(SAMPLE_DOCUMENTS)
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "), " "), lambda w: F.length(w) > 0)
    four = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("words") / 4) - 1, F.lit(0))), lambda i: F.slice("words", (i * 4 + 1).cast("int"), 4))
    joined = few.select(words.alias("words")).where(F.size("words") >= 4).select(F.explode(four).alias("w"))
    camel = F.array_join(F.transform("w", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1000)))), "")
    ordinary = joined.select(F.explode(F.array(F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), F.array_join("w", ""), camel, F.upper(F.array_join("w", "_")))).alias("sample"), F.lit(0).alias("random"))
    rules = docs.sparkSession.range(len(ALPHABET)).select(F.explode(F.array_repeat(F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)), F.lit(40)), 20)).alias("sample"), F.lit(0).alias("random"))
    numbers = docs.sparkSession.range(RANDOM_SAMPLES).select(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).alias("sample"), F.lit(0).alias("random"))
    return random.union(ordinary).union(rules).union(numbers)


def _classes(sample: Column) -> Column:
    """Class of each character, behind the class of the beginning."""
    chars = F.split(sample, "")
    place = lambda c: F.when(F.length(c) == 0, _SIZE - 1).otherwise(F.pmod(F.call_function("instr", F.lit(ALPHABET), c) - 1, F.lit(_SIZE)))
    return F.concat(F.array(F.lit(_SIZE - 1)), F.transform(F.filter(chars, lambda c: F.length(c) > 0), place))


def train(samples: DataFrame) -> Model:
    """Count transitions over every row of ``samples`` (sample, random 0/1); nulls teach nothing."""
    pairs = samples.dropna().select("random", _classes(F.col("sample").cast("string")).alias("c"))
    steps = pairs.select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("s"))
    counts = steps.groupBy("random", F.col("s.a").alias("a"), F.col("s.b").alias("b")).count().collect()  # 2 * _SIZE**2 rows at most
    n = {(r["random"], r["a"], r["b"]): r["count"] for r in counts}
    of = {(k, a): sum(n.get((k, a, b), 0) for b in range(_SIZE)) for k in (0, 1) for a in range(_SIZE)}
    # a context that a model hardly saw falls back to the model's share of each character
    total = {k: sum(of[k, a] for a in range(_SIZE)) for k in (0, 1)}
    share = {(k, b): (sum(n.get((k, a, b), 0) for a in range(_SIZE)) + 1) / (total[k] + _SIZE) for k in (0, 1) for b in range(_SIZE)}
    log = lambda k, a, b: math.log((n.get((k, a, b), 0) + 20 * share[k, b]) / (of[k, a] + 20))
    return Model(tuple(log(1, a, b) - log(0, a, b) for a in range(_SIZE) for b in range(_SIZE)))


def ratio(sample: Column, model: Model) -> Column:
    """Summed log-likelihood ratio of a string."""
    table_ = F.split(F.lit(",".join(map(repr, model.ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(_SIZE - 1).alias("last"))
    step = lambda acc, c: F.struct((acc["sum"] + F.element_at(table_, (acc["last"] * _SIZE + c + 1).cast("int"))).alias("sum"), c.cast("int").alias("last"))
    return F.aggregate(F.slice(_classes(sample), 2, 1 << 30), start, step, lambda acc: acc["sum"])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, group: int, keep) -> Column:
    """Spans (start, kind, end) of the matches whose ``group`` passes ``keep``."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("groups"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["length"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def fold(p: Column) -> Column:
        measured = F.zip_with(
            F.zip_with(p["matches"], F.slice(p["gaps"], F.lit(1), F.size(p["matches"])), lambda m, g: F.struct(F.length(m).alias("length"), F.length(g).alias("gap"))),
            F.transform(p["groups"], keep),
            lambda x, k: F.struct(x["length"].alias("length"), x["gap"].alias("gap"), k.alias("keep")),
        )
        return F.aggregate(measured, start, step, lambda acc: acc["spans"])

    return _let(parts, fold)


def _base_spans(text: Column, number: int) -> Column:
    kind, pattern, group, least = BASE[number]
    found = _spans(text, pattern, number, group, lambda x: F.length(x) >= least)
    return F.when(text.rlike(_MAY[kind]), found).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``: all spans (start, kind, end) by start and kind, base ones first among equals."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.withColumn("__base", F.concat(*[_base_spans(whole, k) for k in range(len(BASE))]))
    runs = F.when(whole.rlike(RUN), _spans(whole, RUN, len(BASE), 0, lambda run: ratio(run, model) > THRESHOLD)).otherwise(F.array().cast(_SPAN))
    new = base.withColumn("__new", F.filter(runs, lambda r: ~F.exists("__base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"]))))
    return new.withColumn(out, F.array_sort(F.concat("__base", "__new"))).drop("__base", "__new")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each secret, or each overlapping group of them, replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.when(fresh, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], F.array(before)).alias("parts"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(default_samples(docs)))
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))
