"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import own_columns, written

KINDS = ("email", "ip", "card", "phone", "id")
#: Rounds of scoring patterns and instances by each other.
ROUNDS = 2
#: Distinct known instances that a pattern needs, and the confidence from which it counts.
LEAST_SEEDS = 3
LEAST_CONFIDENCE = 0.5
#: Score from which an unknown instance is taken for an identifier, and its least characters and digits.
LEAST_SCORE = 0.95
LEAST_CHARS = 8
LEAST_DIGITS = 4
#: Characters around an instance in which its context words are looked for.
CONTEXT_CHARS = 80

SPACE = r"\x20\x09-\x0D"
# the same matches as the plain patterns, but a match begins where the last one ended or where a
# run of its characters begins, and takes the run at once: linear on texts without spaces
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Digits and separators; two separators in a row part its card candidates.
DIGIT_RUN = r"[0-9][0-9\x20-]+[0-9]"
PARTED = r"[\x20-]{2,}"
#: Words with a digit.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value, before, after): places in code points, and the text
    between this match and its neighbours."""
    gaps = F.split(text, F.lit(pattern), -1)
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), gaps.alias("before"), F.slice(gaps, 2, F.size(gaps)).alias("after")
    )
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        row = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(row)).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])


def _spans(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"], m["end"], m["value"]))


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _small_parts(value: Column) -> Column:
    def fits(part):
        plain = F.regexp_replace(part, r"^0+(?=[0-9])", "")
        return (F.length(plain) <= 3) & (F.substring(plain, 1, 4).try_cast("int") <= 255)

    return F.forall(F.split(value, F.lit(r"\.")), fits)


def _cards(text: Column) -> Column:
    runs = F.filter(_matches(text, DIGIT_RUN), lambda m: _digits(m["value"]) >= 16)

    def parts(run):
        gaps = F.regexp_extract_all(run["value"], F.lit(PARTED), F.lit(0))
        pairs = F.arrays_zip(F.split(run["value"], F.lit(PARTED), -1).alias("value"), gaps.alias("gap"))
        empty = F.array().cast(_SPAN)

        def step(acc, x):
            end = acc["at"] + F.length(x["value"])
            row = F.struct(acc["at"].alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(
                (end + F.coalesce(F.length(x["gap"]), F.lit(0))).alias("at"), F.concat(acc["found"], F.array(row)).alias("found")
            )

        return F.aggregate(pairs, F.struct(run["start"].alias("at"), empty.alias("found")), step, lambda acc: acc["found"])

    def valid(span):
        return _digits(span["value"]).between(16, 19) & F.call_function("luhn_check", F.regexp_replace(span["value"], "[^0-9]", ""))

    return F.filter(F.flatten(F.transform(runs, parts)), valid)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that its fixed pattern finds and its rule accepts."""
    none = F.array().cast(_SPAN)
    email = _spans(_matches(text, EMAIL))
    ip = F.filter(_spans(_matches(text, IP)), lambda s: _small_parts(s["value"]))
    phone = F.filter(_spans(_matches(text, PHONE)), lambda s: _digits(s["value"]).between(8, 15))
    return {
        "email": F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][0-9\x20-]{14,}[0-9]"), _cards(text)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), phone).otherwise(none),
    }


def _tokens(text: Column, known: Column) -> Column:
    """Words with a digit: place, plain form, whether a known span covers them, and their patterns.

    Patterns are the word before, the two words before and the word after. Of the words of one
    known span only the first is taken.
    """

    def row(m):
        core = F.regexp_replace(m["value"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
        lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"^[^\p{L}\p{N}+]+", ""))
        start = m["start"] + lead
        end = start + F.length(core)
        before = F.lower(F.substring(m["before"], -CONTEXT_CHARS, CONTEXT_CHARS))
        after = F.lower(F.substring(m["after"], 1, CONTEXT_CHARS))
        two = F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)[{SPACE}]+$", 0)
        one = F.regexp_extract(before, rf"(?<![^{SPACE}])([^{SPACE}]+)[{SPACE}]+$", 1)
        following = F.regexp_extract(after, rf"^[{SPACE}]+([^{SPACE}]+)", 1)
        over = F.filter(known, lambda s: (s["start"] < end) & (s["end"] > start))
        patterns = F.filter(
            F.array(
                F.when(two != "", F.concat(F.lit("LL "), F.regexp_replace(F.trim(two), rf"[{SPACE}]+", " "))),
                F.when(one != "", F.concat(F.lit("L "), one)),
                F.when(following != "", F.concat(F.lit("R "), following)),
            ),
            lambda p: p.isNotNull(),
        )
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            F.lower(core).alias("core"),
            (F.size(over) > 0).alias("seed"),
            F.exists(over, lambda s: s["start"] < m["start"]).alias("inner"),
            patterns.alias("patterns"),
        )

    found = F.transform(_matches(text, TOKEN), row)
    return F.when(text.rlike("[0-9]"), F.filter(found, lambda t: ~t["inner"] & (t["core"] != ""))).otherwise(
        F.array().cast("array<struct<start:int,end:int,core:string,seed:boolean,inner:boolean,patterns:array<string>>>")
    )


def facts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, email, ip, card, phone, tokens)`` of every row, written once."""
    rows = own_columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")
    )
    based = rows.select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    known = F.concat("email", "ip", "card", "phone")
    return written(based.withColumn("tokens", _tokens(F.col("text"), known)).drop("text"))


def identifiers(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(core, score)`` of unknown words that high-confidence patterns extract.

    The graph has an edge for each distinct pattern and instance. A pattern's confidence is the
    mean score of its instances, known ones scoring 1; an instance's score is the chance that
    not all of its patterns are wrong. Both are aggregates that combine before the shuffle.
    """
    tokens = found.select(F.explode("tokens").alias("t")).select("t.core", "t.seed", "t.patterns")
    edges = tokens.select("core", "seed", F.explode("patterns").alias("pattern"))
    edges = written(edges.groupBy("pattern", "core").agg(F.max("seed").alias("seed")))
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = edges.withColumn("score", F.col("seed").cast("double"))
        else:
            joined = edges.join(scores, "core", "left")
            scored = joined.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds")
        )
        strong = patterns.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("confidence") >= LEAST_CONFIDENCE))
        unknown = edges.where("not seed").join(strong, "pattern")
        scores = unknown.groupBy("core").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = written(scores)
    core = F.col("core")
    shaped = (F.length(core) >= LEAST_CHARS) & (_digits(core) >= LEAST_DIGITS)
    return scores.where((F.col("score") >= LEAST_SCORE) & shaped)


def _with_identifiers(found: DataFrame, rounds: int) -> DataFrame:
    tokens = found.select("doc_id", "text_hash", F.explode("tokens").alias("t"))
    tokens = tokens.where("not t.seed").select("doc_id", "text_hash", "t.start", "t.end", "t.core")
    hits = tokens.join(identifiers(found, rounds).select("core"), "core")
    lists = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", F.col("core").alias("value")))).alias("id")
    )
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    none = F.array().cast(_SPAN)
    return found.drop("tokens").join(lists, same, "left").select(
        "doc_id", "text_hash", "email", "ip", "card", "phone", F.coalesce("id", none).alias("id")
    )


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, text_hash, email, ip, card, phone, id)`` of every row of ``docs (doc_id, text)``.

    Each kind is an array of (start, end, value) in code points, by start; ``id`` has the identifiers
    that contexts found, never on a span of the fixed kinds. Null and empty texts have none. Equal
    rows have equal results; a null ``doc_id`` stays. An empty table gives no rows. Other
    columns are not read.
    """
    return _with_identifiers(facts(docs), rounds)


def span_text(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans by kind as given, then start, with commas."""

    def named(kind):
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    base = F.sha2(span_text(KINDS[:4]).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, span_text(KINDS).alias("spans"), F.size("id").cast("long").alias("n_id"))


def mask(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with each span of its ``text`` replaced by its kind in angle brackets.

    Spans that overlap are replaced once, by the kind of the first. All columns stay, in order; null
    texts stay null. Equal rows stay as often as they occur.
    """

    def named(kind):
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind")))

    spans = F.concat(*map(named, KINDS))
    found = find_personal_data(docs, rounds).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.array_sort(spans).alias("_spans")
    )
    found = found.where(F.size("_spans") > 0).dropDuplicates(["_doc", "_hash"])
    same = (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    joined = docs.join(found, same, "left")
    text = F.col("text")

    def step(acc, s):
        free = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(free, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rebuilt = F.aggregate(
        "_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    )
    masked = F.when(F.col("_spans").isNull(), text).otherwise(rebuilt).alias("text")
    return joined.select(*[masked if c == "text" else F.col(f"`{c}`") for c in docs.columns])
