"""Secret scans: fixed patterns, and strings that look random to character Markov models.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are
counted from labelled samples.  A string's score is the sum of log-likelihood ratios of its
character pairs; strings, or their stretches between delimiters, above a fixed threshold become spans
of kind ``markov``.

Only DataFrame functions are used.  A pattern's matches and the pieces between them give all
positions: a match starts after all earlier pieces and matches.  Each pattern runs only in texts
that a plain search finds it in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in order, with patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs: the same as runs of [0-9a-f]+ of 16 characters or more
ACCESS_LEAST = 18
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: The last characters of the alphabet, which join words.
DELIMITERS = 5
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio (nats a character pair) from which a candidate, or a stretch of one, counts as random.
THRESHOLD = 0.35

_SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Words that ordinary identifiers of the labelled samples are put together from.
IDENTIFIER_WORDS = (
    "account address after array async background before block buffer build cache call change check class client code "
    "column compute config connection content context count create current data default delete description device "
    "directory document element enable error event example exception expected field file filter format function "
    "handler header height history image index information input instance integer interface internal item language "
    "length level library limit line list listener local location manager maximum memory message method minimum model "
    "module name network node number object option order output package page parameter parent password path pattern "
    "performance position previous process product project property protocol provider public query queue random range "
    "reader record reference register remove request resource response result return sample schema scope search "
    "section select sequence server service session setting simple source standard start state status storage stream "
    "string structure system table target task template test text thread time timeout token transaction transfer type "
    "update user utility validation value variable vector version view width window worker write"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled strings (s, label): 1 random (hexadecimal, base 64, digits with letters), 0 ordinary.

    Made from row numbers and digests, so every run has the same samples.
    """
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), "[^A-Za-z0-9+/=]", "")
    random = F.when(i % 4 == 0, F.substring(digest("c"), 1, 40)).when(i % 4 == 1, F.upper(F.substring(digest("d"), 1, 40))).otherwise(F.substring(b64, 1, 44))
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    word = lambda salt: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    many = F.array(*(word(k) for k in range(5)))
    plain = (
        F.when(i % 5 == 0, F.array_join(many, "_"))
        .when(i % 5 == 1, F.array_join(many, "-"))
        .when(i % 5 == 2, F.array_join(F.transform(many, F.initcap), ""))
        .when(i % 5 == 3, F.upper(F.array_join(many, "_")))
        .otherwise(F.array_join(many, "/"))
    )
    rows = spark.range(n)
    return rows.select(random.alias("s"), F.lit(1).alias("label")).unionByName(rows.select(plain.alias("s"), F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all character pairs, by (first, second) in the alphabet's order.

    The counts have ``len(ALPHABET) ** 2`` rows for each label at most; they come to the driver.
    Characters outside the alphabet are left out; a null string has no pairs.
    """
    k = len(ALPHABET)
    pairs = samples.select(
        "label",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda j: F.substring(F.col("s"), j, F.lit(2)))).alias("p"),
    )
    pairs = pairs.filter((F.length("p") == 2) & F.col("p").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    counts = {(r.label, r.p): r.n for r in pairs.groupBy("label", "p").agg(F.count("*").alias("n")).collect()}
    from math import log

    out = []
    for a in ALPHABET:
        total = {y: sum(counts.get((y, a + b), 0) for b in ALPHABET) + smoothing * k for y in (0, 1)}
        out += [log((counts.get((1, a + b), 0) + smoothing) / total[1]) - log((counts.get((0, a + b), 0) + smoothing) / total[0]) for b in ALPHABET]
    return out


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def random_stretches(s: Column, start: Column, ratios: Column, threshold: float) -> Column:
    """Spans of what looks random in a string over the alphabet that begins at ``start``.

    The whole string, if its pairs' mean reaches the threshold.  Otherwise the best stretches of LEAST
    characters or more between delimiters: one pass keeps the lowest sum (of ratios above the threshold)
    that a stretch could begin after, and closes the open stretch as soon as a later one without a
    common character reaches the threshold too.  So what stands before or behind takes nothing off.
    """
    zero, none = F.lit(0.0), F.array().cast(_SPAN)
    span = lambda a, b: F.array(F.struct((start + a).cast("int").alias("start"), F.lit(3).alias("kind"), (start + b + 1).cast("int").alias("end")))

    def of_places(place):
        over = lambda p, i: F.when(i == 0, zero).otherwise(F.element_at(ratios, ((place[i - 1] - 1) * len(ALPHABET) + p).cast("int")) - threshold)
        return bound(F.transform(place, over), lambda w: of_scores(place, w))

    def of_scores(place, w):
        n = F.size(w)
        cut = lambda i: place[i] > len(ALPHABET) - DELIMITERS

        def step(acc, b):
            i = b - (LEAST - 1)  # the last character that a stretch up to b can begin with
            p, lag = acc["p"] + w[b], F.when(i > 0, acc["lag"] + w[i]).otherwise(zero)
            begins = F.when(i < 0, False).when(i == 0, ~cut(i)).otherwise(~cut(i) & cut(i - 1))
            ends = (i >= 0) & ~cut(b) & F.when(b == n - 1, True).otherwise(cut(b + 1))
            now = F.struct(p.alias("p"), lag.alias("lag"), begins.alias("begins"), ends.alias("ends"))
            return bound(now, lambda x: lows(acc, x, b, i))

        def lows(acc, x, b, i):
            behind = (acc["first"] >= 0) & (i > acc["last"])  # of the open stretch
            low = x["begins"] & ~behind & (acc["low"].isNull() | (x["lag"] < acc["low"]))
            next_low = x["begins"] & behind & (acc["next_low"].isNull() | (x["lag"] < acc["next_low"]))
            kept = F.struct(
                F.when(low, x["lag"]).otherwise(acc["low"]).alias("low"),
                F.when(low, i).otherwise(acc["low_at"]).alias("low_at"),
                F.when(next_low, x["lag"]).otherwise(acc["next_low"]).alias("next_low"),
                F.when(next_low, i).otherwise(acc["next_at"]).alias("next_at"),
            )
            return bound(kept, lambda y: moved(acc, x, y, b))

        def moved(acc, x, y, b):
            later = x["ends"] & F.coalesce(x["p"] >= y["next_low"], F.lit(False))
            better = x["ends"] & F.coalesce(x["p"] - y["low"] >= F.greatest(acc["best"], zero), F.lit(False))
            pick = lambda one, two, three: F.when(later, one).when(better, two).otherwise(three)
            return F.struct(
                x["p"].alias("p"),
                x["lag"].alias("lag"),
                F.when(later, y["next_low"]).otherwise(y["low"]).alias("low"),
                F.when(later, y["next_at"]).otherwise(y["low_at"]).alias("low_at"),
                F.when(~(later | better), y["next_low"]).alias("next_low"),
                y["next_at"].alias("next_at"),
                pick(y["next_at"], y["low_at"], acc["first"]).alias("first"),
                pick(b, b, acc["last"]).alias("last"),
                pick(x["p"] - y["next_low"], x["p"] - y["low"], acc["best"]).alias("best"),
                F.when(later, F.concat(acc["out"], span(acc["first"], acc["last"]))).otherwise(acc["out"]).alias("out"),
            )

        no, null, at = F.lit(-1), F.lit(None).cast("double"), F.lit(0)
        begin = F.struct(
            zero.alias("p"), zero.alias("lag"), null.alias("low"), at.alias("low_at"), null.alias("next_low"), at.alias("next_at"),
            no.alias("first"), no.alias("last"), null.alias("best"), none.alias("out"),
        )
        parts = F.aggregate(F.sequence(F.lit(0), n - 1), begin, step, lambda acc: F.when(acc["first"] >= 0, F.concat(acc["out"], span(acc["first"], acc["last"]))).otherwise(acc["out"]))
        whole = F.aggregate(w, zero, lambda acc, x: acc + x) >= 0
        return F.when(whole, span(F.lit(0), n - 1)).when(F.exists(place, lambda p: p > len(ALPHABET) - DELIMITERS), parts).otherwise(none)

    letters = F.slice(F.split(s, "", -1), F.lit(1), F.length(s))
    return bound(F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c)), of_places)


#: Items of an array that one inner pass takes.
FOLD = 256


def fold(items: Column, begin: dict[str, Column], step, out_type: str) -> Column:
    """All that ``step(state, item) -> (new state, items to emit)`` emits, in order.

    Appending copies an array, so what is emitted is gathered for FOLD items at a time.
    """
    none = F.array().cast(out_type)

    def one(acc, x):
        state, emitted = step(acc, x)
        return F.struct(*(c.alias(k) for k, c in state.items()), F.when(F.size(emitted) > 0, F.concat(acc["out"], emitted)).otherwise(acc["out"]).alias("out"))

    def block(acc, i):
        inner = F.aggregate(F.slice(items, i + 1, F.lit(FOLD)), F.struct(*(acc[k].alias(k) for k in begin), none.alias("out")), one)
        return bound(inner, lambda x: F.struct(*(x[k].alias(k) for k in begin), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(*(c.alias(k) for k, c in begin.items()), F.array().cast(f"array<{out_type}>").alias("out"))
    cuts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(FOLD))
    return F.aggregate(cuts, start, block, lambda acc: F.flatten(acc["out"]))


def apart(looks: Column, base: Column) -> Column:
    """Parts (start, piece) of LEAST characters or more of spans (start, end, hit) that no base span covers.

    One pass over both kinds of spans by start; the spans of ``looks`` do not overlap each other.
    """
    none, last = F.array().cast("array<struct<start:int,piece:string>>"), F.lit((1 << 31) - 1)
    event = lambda start, is_look, end, hit: F.struct(start.alias("start"), F.lit(is_look).alias("look"), end.alias("end"), hit.alias("hit"))
    events = F.concat(
        F.transform(looks, lambda x: event(x["start"], 1, x["end"], x["hit"])),
        F.transform(base, lambda x: event(x["start"], 0, x["end"], F.lit(""))),
        F.array(event(last, 1, last, F.lit(""))),
    )

    def step(acc, x):
        look = x["look"] == 1
        inside = ~look & (x["start"] < acc["end"])
        to = F.when(look, acc["end"]).otherwise(x["start"])
        piece = F.struct(acc["at"].alias("start"), F.substring(acc["hit"], acc["at"] - acc["from"] + 1, to - acc["at"]).alias("piece"))
        emitted = F.when((look | inside) & (to - acc["at"] >= LEAST), F.array(piece)).otherwise(none)
        state = {
            "covered": F.when(look, acc["covered"]).otherwise(F.greatest(acc["covered"], x["end"])),
            "at": F.when(look, F.greatest(x["start"], acc["covered"])).when(inside, F.greatest(acc["at"], x["end"])).otherwise(acc["at"]),
            "from": F.when(look, x["start"]).otherwise(acc["from"]),
            "end": F.when(look, x["end"]).otherwise(acc["end"]),
            "hit": F.when(look, x["hit"]).otherwise(acc["hit"]),
        }
        return state, emitted

    zero = F.lit(0)
    begin = {"covered": zero, "at": zero, "from": zero, "end": zero, "hit": F.lit("")}
    return bound(F.array_sort(events), lambda all_of: fold(all_of, begin, step, "array<struct<start:int,piece:string>>"))


def pattern_spans(text: Column, pattern: str, kind: int, good) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches that ``good`` holds for."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_SPAN)

    def step(acc, x):
        start = acc["at"] + x["before"]
        end = start + x["long"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return {"at": end}, F.when(x["good"], F.array(span)).otherwise(none)

    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("before"), F.length(h).alias("long"), good(h).alias("good")))
    found = bound(zipped, lambda z: fold(z, {"at": F.lit(0)}, step, _SPAN))
    return F.when(text.rlike(pattern), found).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, samples: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, base_spans, spans, arrays of (start, kind, end), sorted.

    Positions are code points, the end exclusive; kind is the place in KINDS.  A null text counts as
    empty; repeated rows are scanned each; an empty table gives an empty table; further columns are
    left out.  Texts and strings of any length are scanned whole, in time about in proportion to them;
    of overlapping kinds all spans are returned, ties sorted by kind.  ``markov`` spans are candidates without what base spans cover, whole or in stretches that look random
    (see random_stretches).
    """
    spark = docs.sparkSession
    ratios = F.array(*(F.lit(round(x, 6)) for x in train(labelled_samples(spark) if samples is None else samples)))
    text = F.col("text")
    group2 = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns(
        {
            "assign": pattern_spans(text, ASSIGN, 0, lambda h: group2(h) >= ASSIGN_LEAST),
            "access": pattern_spans(text, ACCESS, 1, lambda h: F.length(h) >= ACCESS_LEAST),
            "hex": pattern_spans(text, HEX, 2, lambda h: F.lit(True)),
            "looks": F.zip_with(
                pattern_spans(text, CANDIDATE, 3, lambda h: F.lit(True)),
                F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
                lambda x, h: F.struct(x["start"].alias("start"), x["end"].alias("end"), h.alias("hit")),
            ),
        }
    ).drop("text")
    base = reduce(F.concat, [F.col("assign"), F.col("access"), F.col("hex")])
    rows = rows.withColumn("base_spans", F.array_sort(base))
    pieces = apart(F.col("looks"), F.col("base_spans"))
    markov = F.flatten(F.transform(pieces, lambda x: random_stretches(x["piece"], x["start"], ratios, threshold)))
    return rows.select("doc_id", "base_spans", F.array_sort(F.concat("base_spans", markov)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts a kind, digest of the base spans, all spans as a string."""
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
