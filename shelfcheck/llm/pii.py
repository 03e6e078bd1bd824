"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the contract's base matches (email, ip, card, phone), which always stay, and
looser matches of the same kinds. Regex, gazetteer and context labelers vote for (1), against
(-1) or abstain (0) on every candidate. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is real. These
likelihoods are the soft labels of a logistic span classifier per kind, which sees no vote but
the span itself: its length, the grouping of its digits and whether their check sum holds, the
classes of its characters, the word before it and the character after it. The classifier decides the candidates beside the
base ones.

The corpus enters the estimation as counts of (kind, votes) over all documents: at most
4 * 3^5 rows, whatever the input. The classifier is fitted on all candidates, reduced to sums
per combination of features, by Newton steps of one feature at a time; each step is one
aggregate, of which one sum per kind and value of the feature (at most 4 * 65) reaches the driver.
Weights return to the plan as literals.

Positions are code points, ends exclusive. A pattern's matches and the pieces between them
(``split`` by the same pattern) give the positions as running sums of lengths. The patterns
are written so that Java's matcher neither recurses nor tries a start inside a run of
characters twice; each finds what the contract's form of it finds.

Defined cases: a null or empty text has no spans; repeated rows and repeated doc_ids keep
one result row each; of overlapping spans all are reported, and ``redact`` replaces their
union once, by the tag of the first; an empty table gives no rows and trains nothing.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcheck.llm.util import materialize

KINDS = ["email", "ip", "card", "phone"]

# (kind, base?, pattern). \G lets a match start where the last one ended.
SOURCES = [
    ("email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", True, r"[0-9](?:[ -]?[0-9])++"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[a-z0-9-]++ ?(?:(?:\.|\[dot\]|\(dot\)) ?[a-z0-9-]++)++"),
    ("ip", False, r"(?i)(?<![0-9a-z:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-z:])"),
    ("phone", False, r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[ -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
]

# Labeler word lists.
TLDS = ["com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "de", "fr", "es", "uk", "eu", "it", "nl"]
CALLING_CODES = ["1", "7", "20", "27", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48",
                 "49", "52", "55", "61", "81", "82", "86", "91"]
FOR_WORDS = {
    "email": "e-?mail|mail|contact|write|correo|courriel|kontakt",
    "ip": "ip|ipv4|ipv6|host|server|address|login|servidor|serveur",
    "card": "card|credit|debit|visa|mastercard|amex|payment|tarjeta|carte|karte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|dial|telefon|anruf|llame|appelez",
}
AGAINST_WORDS = "version|isbn|order|invoice|id|no|nr|build|page|chapter|section|sha|hash"
LABELERS = ["v_format", "v_check", "v_gazetteer", "v_context", "v_border"]
NEAR = 32  # characters of context before a candidate

# Span features and their numbers of values; the last value of f_before means no word.
FEATURES = {"f_length": 12, "f_digits": 32, "f_chars": 16, "f_sum": 2, "f_before": 65, "f_after": 4}

EM_ROUNDS, FIT_CYCLES, RIDGE, ACCEPT = 30, 4, 1.0, 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _candidates_of(text: Column, source: int) -> Column:
    """All matches of one pattern with the pieces around them."""
    kind, base, pattern = SOURCES[source]
    return F.when(_gate(text, kind, base), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _gate(text: Column, kind: str, base: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@")) if base else F.lower(text).rlike(r"[\[(]at[\])]")
    if kind == "ip":
        return F.contains(text, F.lit("." if base else ":"))
    return F.contains(text, F.lit("+")) if kind == "phone" and base else text.rlike("[0-9]")


def matches(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` plus ``__found``: per pattern the matches with their surroundings, in order."""
    names = [f"__m{i}" for i in range(len(SOURCES))]
    pieces = [f"__p{i}" for i in range(len(SOURCES))]
    out = rows.select("*", *[_candidates_of(F.col(text), i).alias(n) for i, n in enumerate(names)])
    out = out.select("*", *[F.when(F.size(m) > 0, F.split(F.col(text), SOURCES[i][2], -1)).alias(p)
                            for i, (m, p) in enumerate(zip(names, pieces))])
    parts = []
    for i, (m, p) in enumerate(zip(names, pieces)):
        n = F.size(m)
        z = F.arrays_zip(F.col(m).alias("m"), F.slice(p, F.lit(1), n).alias("b"), F.slice(p, F.lit(2), n).alias("a"))
        parts.append(F.when(n > 0, F.transform(z, _entry(i))))
    return out.withColumn("__found", F.flatten(F.array_compact(F.array(*parts)))).drop(*names, *pieces)


def _entry(source: int):
    return lambda x, k: F.struct(
        F.lit(source).alias("src"), k.alias("nth"), x["m"].alias("value"),
        F.length(x["b"]).alias("gap"), F.right(x["b"], F.lit(NEAR)).alias("before"),
        F.left(x["a"], F.lit(1)).alias("after"))


def spans(found: DataFrame) -> DataFrame:
    """Valid candidates of ``found`` (``__row``, ``__found``): kind, base, start, end, votes, features."""
    c = found.where(F.size("__found") > 0).select("__row", F.explode("__found").alias("c")).select("__row", "c.*")
    upto = Window.partitionBy("__row", "src").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    c = c.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in SOURCES]), F.col("src") + 1)
    c = c.select("*", kind.alias("kind"), F.element_at(F.array(*[F.lit(b) for _, b, _ in SOURCES]), F.col("src") + 1)
                 .alias("strict"), _digits(F.col("value")).alias("digits"))
    n = F.length("digits")
    octets = F.col("value").rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    valid = (F.when(F.col("kind") == "ip", ~F.col("strict") | octets)
             .when(F.col("kind") == "card", n.between(13, 19))
             .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(True)))
    luhn = F.expr("luhn_check(digits)")
    base = F.col("strict") & ((F.col("kind") != "card") | luhn)
    c = c.where(valid).withColumn("base", base)
    return c.select("__row", "kind", "base", F.col("start").cast("int"), F.col("end").cast("int"), *_votes(luhn),
                    *_features(luhn))


def _features(luhn: Column) -> list[Column]:
    """What the classifier sees of a span: small numbers, the same for the same text around it."""
    value, after = F.col("value"), F.col("after")
    has = lambda pattern, bit: F.when(value.rlike(pattern), bit).otherwise(0)
    groups = F.array_join(F.transform(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g).cast("string")), "-")
    word = F.regexp_extract(F.lower("before"), r"(\p{L}+)[^\p{L}]*$", 1)
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    out = {"f_length": F.least(F.floor(F.length("value") / 3), F.lit(FEATURES["f_length"] - 1)),
           "f_digits": bucket(groups, FEATURES["f_digits"]),
           "f_chars": has(r"\p{L}", 1) + has(r"\s", 2) + has(r"[()\[\]]", 4) + has("[.:-]", 8),
           "f_sum": F.when(luhn, 1).otherwise(0),
           "f_before": F.when(word != "", bucket(word, FEATURES["f_before"] - 1)).otherwise(FEATURES["f_before"] - 1),
           "f_after": F.when(after.rlike(r"[\p{L}\p{N}]"), 0).when(after.rlike(r"\s"), 1).when(after == "", 2).otherwise(3)}
    return [c.cast("int").alias(n) for n, c in out.items()]


def _votes(luhn: Column) -> list[Column]:
    """The labelers: 1 for, -1 against, 0 abstains."""
    kind, value, digits = F.col("kind"), F.lower("value"), F.col("digits")
    vote = lambda c: F.when(c, 1).otherwise(-1)
    before, after = F.lower("before"), F.col("after")
    any_of = lambda words: rf"(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}]*$"
    fmt = vote(F.col("base"))
    check = (F.when(kind == "card", vote(luhn))
             .when(kind == "email", vote(value.rlike(rf"(?:\.|dot[\])]) ?(?:{'|'.join(TLDS)})$")))
             .when(kind == "phone", vote(F.length(digits).between(10, 13)))
             .otherwise(vote(~value.rlike("^(?:0|255)[.]"))))
    gazetteer = (F.when(kind == "card", vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")))
                 .when(kind == "email", F.when(value.rlike(r"^(?:info|sales|admin|support|contact|[a-z]+[._-][a-z0-9]+) ?[@\[(]"), 1).otherwise(0))
                 .when(kind == "phone", F.when(F.col("strict"), vote(digits.rlike(f"^(?:{'|'.join(CALLING_CODES)})"))).otherwise(0))
                 .otherwise(F.when(value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))[.]"), 1).otherwise(0)))
    said = F.lit(False)
    for k, words in FOR_WORDS.items():
        said = F.when(kind == k, before.rlike(any_of(words))).otherwise(said)
    context = F.when(said, 1).when(before.rlike(any_of(AGAINST_WORDS)), -1).otherwise(0)
    border = vote(~before.rlike(r"[\p{L}\p{N}_=#/-]$") & ~after.rlike(r"[\p{L}\p{N}_=#/]"))
    return [c.cast("int").alias(n) for n, c in zip(LABELERS, [fmt, check, gazetteer, context, border])]


def estimate(counts: list[tuple]) -> dict:
    """EM for one kind over [(votes, count)]: prior and per labeler P(vote | real or not)."""
    likely = {v: 1 / (1 + exp(-sum(v))) for v, _ in counts}
    prior, table = 0.5, []
    for _ in range(EM_ROUNDS):
        total = sum(n for _, n in counts)
        real = sum(n * likely[v] for v, n in counts)
        prior = (real + 1) / (total + 2)
        table = []
        for j in range(len(LABELERS)):
            seen = {(x, y): 1.0 for x in (-1, 0, 1) for y in (0, 1)}
            for v, n in counts:
                seen[v[j], 1] += n * likely[v]
                seen[v[j], 0] += n * (1 - likely[v])
            whole = [sum(seen[x, y] for x in (-1, 0, 1)) for y in (0, 1)]
            table.append({k: c / whole[k[1]] for k, c in seen.items()})
        for v, _ in counts:
            odds = log(prior / (1 - prior)) + sum(log(t[x, 1] / t[x, 0]) for t, x in zip(table, v))
            likely[v] = 1 / (1 + exp(-max(-35.0, min(35.0, odds))))
    return {"prior": prior, "reliability": table, "likely": likely}


def _by_kind(values: dict[tuple, float], key: list[str]) -> Column:
    """The literal that belongs to a row's ``key`` columns, 0 where there is none."""
    entries = [x for k, v in sorted(values.items()) for x in (F.lit(":".join(map(str, k))), F.lit(float(v)))]
    if not entries:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.concat_ws(":", *[F.col(c).cast("string") for c in key])), F.lit(0.0))


def _score(weights: dict[tuple, float]) -> Column:
    """Log-odds of a span: its kind's intercept and one weight per feature."""
    z = _by_kind({(k,): w for (k, f, _), w in weights.items() if f == "one"}, ["kind"])
    for name in FEATURES:
        z = z + _by_kind({(k, v): w for (k, f, v), w in weights.items() if f == name}, ["kind", name])
    return z


def fit(cells: DataFrame) -> dict[tuple, float]:
    """Logistic regression of soft labels on one-hot features: {(kind, feature, value): weight}.

    ``cells``: kind, features, n candidates, s the sum of their likelihoods. One feature at a
    time takes a Newton step: its values exclude each other, so each has a curvature of its own.
    """
    weights: dict[tuple, float] = {}
    cells = cells.withColumn("one", F.lit(0))
    for feature in ("one", *FEATURES) * FIT_CYCLES:
        p = 1 / (1 + F.exp(-_score(weights)))
        sums = (cells.select("kind", F.col(feature).alias("value"), (F.col("n") * p - F.col("s")).alias("g"),
                             (F.col("n") * p * (1 - p)).alias("h"))
                .groupBy("kind", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
        for r in sums:
            key = (r["kind"], feature, r["value"])
            ridge, w = (0.0 if feature == "one" else RIDGE), weights.get(key, 0.0)
            step = (r["g"] + ridge * w) / (r["h"] + ridge + 1e-3)
            weights[key] = w - max(-2.0, min(2.0, step))
    return weights


def train(candidates: DataFrame) -> dict:
    """Per kind with candidates the reliabilities (``kinds``), and the classifier's weights."""
    counts = candidates.groupBy("kind", *LABELERS).count().collect()  # at most 4 * 3^5 rows
    kinds, likely = {}, {}
    for kind in KINDS:
        own = sorted((tuple(r[n] for n in LABELERS), r["count"]) for r in counts if r["kind"] == kind)
        if own:
            kinds[kind] = estimate(own)
            likely |= {(kind, *v): p for v, p in kinds[kind]["likely"].items()}
    if not kinds:
        return {"kinds": {}, "weights": {}}
    soft = candidates.withColumn("likely", _by_kind(likely, ["kind", *LABELERS]))
    cells = materialize(soft.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("likely").alias("s")), "cells")
    return {"kinds": kinds, "weights": fit(cells)}


def classify(candidates: DataFrame, model: dict) -> DataFrame:
    """``candidates`` with the classifier's ``p``; base ones and those it accepts stay."""
    p = 1 / (1 + F.exp(-_score(model["weights"])))
    return candidates.withColumn("p", p).where(F.col("base") | (F.col("p") >= ACCEPT))


def find(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): written ``keep`` columns with a row number ``__row``, and one row per
    span with ``__row``, kind, base, start, end, votes and p."""
    rows = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__scan"),
                       F.monotonically_increasing_id().alias("__row"))
    rows = materialize(matches(rows, "__scan").drop("__scan"), "matches")
    candidates = materialize(spans(rows), "candidates")
    return rows.drop("__found"), classify(candidates, train(candidates))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Contract columns, one row per document row."""
    rows, found = find(docs, [doc_id], text)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct(order.alias("o"), F.col("start").alias("s"), F.col("end").alias("e"), name.alias("t"))
    text_of = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), ",")
    once = found.groupBy("__row", "kind", "start", "end").agg(F.max("base").alias("base"))
    per_row = once.groupBy("__row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), entry)).alias("b"), F.collect_list(entry).alias("a"))
    return rows.join(per_row, "__row", "left").select(
        doc_id, *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(text_of(F.col("b")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(text_of(F.col("a")), F.lit("")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document row with its personal data replaced by ``<KIND>`` tags, all columns
    kept; a column ``n_chars`` is set to the new length where the text changed."""
    cols = docs.columns
    inner = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(cols)], docs[text].alias("__doc"))
    names = [f"__k{i}" for i in range(len(cols))]
    rows, found = find(inner, [*names, "__doc"], "__doc")
    before = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    union = (found.withColumn("fresh", fresh.cast("int")).withColumn("g", F.sum("fresh").over(upto))
             .groupBy("__row", "g").agg(F.min("start").alias("s"), F.max("end").alias("e"),
                                        F.min_by("kind", F.struct("start", "end")).alias("kind")))
    last = F.coalesce(F.lag("e").over(Window.partitionBy("__row").orderBy("g")), F.lit(0))
    cuts = (union.withColumn("from", last).groupBy("__row")
            .agg(F.array_sort(F.collect_list(F.struct("s", "e", "from", "kind"))).alias("cuts")))
    doc = F.col("__doc")
    body = F.concat(
        F.array_join(F.transform("cuts", lambda c: F.concat(
            F.substring(doc, c["from"] + 1, c["s"] - c["from"]), F.lit("<"), F.upper(c["kind"]), F.lit(">"))), ""),
        F.substring(doc, F.element_at("cuts", -1)["e"] + 1, F.length(doc)))
    out = rows.join(cuts, "__row", "left").withColumn("__new", F.when(F.col("cuts").isNotNull(), body).otherwise(doc))
    new_length = F.when(F.col("cuts").isNotNull(), F.length("__new"))
    back = []
    for c, n in zip(cols, names):
        if c == text:
            back.append(F.col("__new").alias(c))
        elif c == "n_chars":
            back.append(F.coalesce(new_length.cast(docs.schema[c].dataType), n).alias(c))
        else:
            back.append(F.col(n).alias(c))
    return out.select(*back)
