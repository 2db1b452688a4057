"""Secret scans (operator 1), in DataFrame functions only.

Patterns find credentials with a known shape. A battery of randomness tests
finds tokens without one: per inferred encoding, how evenly the alphabet is
used, how often the character class changes, and the serial correlation of the
symbols. The p-values are combined and a length-weighted Benjamini-Hochberg
step over all tested tokens of the corpus keeps the share of false discoveries low.
Only tokens with a digit and a letter are tested: random keys without a digit (of
20 characters, 3.3 % in base64 and 1.6 % in base32) or without a letter are missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: kind -> (pattern, group whose length counts, least length); fixed by contract.
PATTERNS = {
    "assign": (
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    # the runs of [0-9a-f]+ with 32 or more; a match can only begin where a run does
    "hex": ("(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
RANDOM = "random"
#: Tokens that the battery tests: long enough for the tests to have power.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Aimed share of false discoveries.
FALSE_DISCOVERY = 0.01

#: encoding -> (pattern, alphabet). The first that fits is inferred.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
}
#: Under the hypothesis "ordinary text": chance that two symbols agree, that
#: three agree, that neighbours differ in class, and the serial correlation.
ORDINARY = {"pair": 0.066, "triple": 0.0054, "change": 0.2, "serial": 0.35}
ORDINARY_HEX = {"pair": 0.105, "triple": 0.0145, "change": 0.3, "serial": 0.35}

_CHUNK = 512
_BIN = 0.05
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches ``found`` of ``pattern``.

    The text between the matches comes from split(); offsets are running sums,
    summed in chunks so that a text with very many matches stays linear.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))
    )
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / F.lit(_CHUNK)).cast("int")),
        lambda c: F.slice(pairs, c * _CHUNK + 1, F.lit(_CHUNK)),
    )
    width = lambda chunk: F.aggregate(chunk, F.lit(0), lambda a, p: a + p["g"] + F.length(p["m"]))
    empty = F.lit(None).cast("array<int>")
    offsets = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<int>")).alias("to")),
        lambda a, c: F.struct((a["at"] + width(c)).alias("at"), F.concat(a["to"], F.array(a["at"])).alias("to")),
    )["to"]
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def inside(chunk: Column, offset: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(offset.alias("at"), nothing.alias("to")),
            lambda a, p: F.struct(
                (a["at"] + p["g"] + F.length(p["m"])).alias("at"),
                F.concat(
                    a["to"],
                    F.array(
                        F.struct(
                            (a["at"] + p["g"]).alias("start"),
                            (a["at"] + p["g"] + F.length(p["m"])).alias("end"),
                            p["m"].alias("value"),
                        )
                    ),
                ).alias("to"),
            ),
        )["to"]

    return F.when(F.size(found) > 0, F.flatten(F.zip_with(chunks, offsets, inside))).otherwise(nothing)


def _spans(text: Column, found: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    placed = _placed(text, found, pattern)
    value = lambda s: s["value"] if group == 0 else F.regexp_extract(s["value"], pattern, group)
    return F.transform(
        F.filter(placed, lambda s: F.length(value(s)) >= least),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["value"].alias("value"),
        ),
    )


def _normal(z: Column) -> Column:
    """The normal distribution function, by a logistic curve."""
    return F.greatest(F.lit(1e-15), 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z))))


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (value) with columns n, encoding and p. p is small where
    ordinary text would hardly look as random; it combines (Fisher) three
    one-sided tests:

    - uniformity: the chi-squared statistic of the symbol counts against the
      uniform alphabet, k/n * sum(c^2) - n, is linear in the number of equal
      pairs; few equal pairs speak against ordinary text;
    - runs: many changes between lower case, upper case, digits and signs;
    - serial correlation at lag one: near zero.
    """
    col = F.col
    encoding = F.lit("base64")
    for name, (pattern, _) in reversed(list(ENCODINGS.items())[:-1]):
        encoding = F.when(col("body").rlike(pattern), F.lit(name)).otherwise(encoding)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(col("body"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    classes = F.regexp_replace(classes, "[^aA0]", "-")
    sizes = F.create_map(*(F.lit(x) for k, (_, alphabet) in ENCODINGS.items() for x in (k, min(64, len(alphabet)))))
    ordinary = F.when(col("encoding") == "hex", F.struct(*(F.lit(v).alias(k) for k, v in ORDINARY_HEX.items()))).otherwise(
        F.struct(*(F.lit(v).alias(k) for k, v in ORDINARY.items()))
    )
    shown = F.when(col("encoding") == "hex", F.lower("body")).otherwise(col("body"))
    n, pair, change = col("n"), col("h0.pair"), col("h0.change")
    squares = F.aggregate(
        F.array_distinct("symbols"),
        F.lit(0.0),
        lambda a, c: a + F.pow((n - F.length(F.replace(col("body"), c, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    codes = F.transform("symbols", lambda c: F.instr(F.lit(ENCODINGS["base64"][1]), c).cast("double"))
    mean = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x) / n
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    serial = product(F.slice("around", F.lit(1), n - 1), F.slice("around", F.lit(2), n - 1)) / col("variance")
    pairs = n * (n - 1) / 2
    spread = pairs * pair * (1 - pair) + n * (n - 1.0) * (n - 2.0) * (col("h0.triple") - pair * pair)
    chi2 = col("k") / n * col("squares") - n
    equal = (n * (col("chi2") + n) / col("k") - n) / 2
    steps = [
        {"body": F.rtrim("value", F.lit("="))},
        {"n": F.length("body"), "encoding": encoding, "classes": classes},
        {"k": sizes[col("encoding")], "h0": ordinary, "symbols": F.filter(F.split(shown, ""), lambda c: c != "")},
        {"squares": squares, "codes": codes},
        {"chi2": chi2, "mean": mean},
        {"around": F.transform("codes", lambda x: x - col("mean"))},
        {"variance": product(col("around"), col("around")), "changes": F.length(F.regexp_replace("classes", "(.)\\1+", "$1")) - 1},
        {"serial": F.when(col("variance") > 0, serial).otherwise(F.lit(1.0))},
        {
            "p1": _normal((equal - pairs * pair) / F.sqrt(spread)),
            "p2": _normal(-(col("changes") - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))),
            "p3": _normal((F.abs("serial") - col("h0.serial")) * F.sqrt(n)),
        },
        {"x": -(F.log("p1") + F.log("p2") + F.log("p3"))},  # half of Fisher's statistic
        {"p": F.exp(-col("x")) * (1 + col("x") + col("x") * col("x") / 2)},
    ]
    out = tokens
    for step in steps:
        out = out.withColumns(step)
    return out.select(*tokens.columns, "n", "encoding", "p")


def _threshold(tokens: DataFrame, q: float) -> tuple[float, float]:
    """(largest p / weight that is a discovery, mean length). Weights are length
    over mean length, mean 1. p-values are counted in bins of -log10, so that
    only some hundred rows are ordered; a bin counts with its upper end."""
    stats = tokens.agg(F.avg("n").alias("mean"), F.count("*").alias("m")).first()
    if not stats["m"]:
        return -1.0, 1.0
    weighted = F.col("p") * F.lit(float(stats["mean"])) / F.col("n")
    bins = tokens.groupBy(F.floor(-F.log10(F.greatest(weighted, F.lit(1e-60))) / _BIN).alias("bin")).count()
    upper = F.pow(F.lit(10.0), -F.col("bin") * _BIN)
    found = F.sum("count").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    best = (
        bins.select(upper.alias("p"), found.alias("found"))
        .where(F.col("p") <= q * F.col("found") / F.lit(float(stats["m"])))
        .agg(F.max("p"))
        .first()[0]
    )
    return (-1.0 if best is None else best), float(stats["mean"])


def scan(docs: DataFrame, q: float = FALSE_DISCOVERY, rows: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base and spans, arrays of
    struct<start, rank, end, kind, value> in order of start, then kind.
    ``rows``: with the whole row as the struct ``_row``.

    base holds the spans of :data:`PATTERNS`; spans adds tokens that the battery
    discovers and that overlap no base span. Offsets are in code points, ends
    exclusive. Null text is empty and has no spans; repeated rows are scanned
    each; the rate of false discoveries is over the tokens of ``docs`` that are
    tested, those with a digit and a letter outside base spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if rows else []
    keep = ["_row"] if rows else []
    patterns = {k: p for k, (p, _, _) in PATTERNS.items()} | {RANDOM: TOKEN}
    found = docs.select(
        "doc_id",
        *kept,
        text.alias("_text"),
        *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()),
    ).withColumn("_likely", F.exists("_random", lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")))
    base = F.concat(
        *(
            _spans(F.col("_text"), F.col(f"_{k}"), k, i, p, group, least)
            for i, (k, (p, group, least)) in enumerate(PATTERNS.items())
        )
    )
    tokens = F.when(
        F.col("_likely"), _spans(F.col("_text"), F.col("_random"), RANDOM, len(PATTERNS), TOKEN, 0, 0)
    ).otherwise(F.array().cast(f"array<{_SPAN}>"))
    tokens = F.filter(tokens, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    # the spans only, without the texts: the corpus is scanned once. The row
    # number is fixed by writing it.
    spans = write_table(
        found.select("doc_id", *keep, F.array_sort(base).alias("base"), tokens.alias("tokens")).withColumn(
            "_uid", F.monotonically_increasing_id()
        ),
        "spans",
    )
    base = F.col("base")
    tested = write_table(
        battery(
            spans.select("_uid", "base", F.explode("tokens").alias("t"))
            .where(~F.exists(base, lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"])))
            .select("_uid", "t", F.col("t.value").alias("value"))
        ).select("_uid", "t", "n", "p"),
        "tokens",
    )
    best, mean = _threshold(tested, q)
    more = (
        tested.where(F.col("p") * F.lit(mean) / F.col("n") <= F.lit(best))
        .groupBy("_uid")
        .agg(F.collect_list("t").alias("more"))
    )
    return spans.join(more, "_uid", "left").select(
        "doc_id",
        *keep,
        "base",
        F.array_sort(F.concat(base, F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))).alias("spans"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_spans(docs: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """Digest of :func:`scan`: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs, q)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in PATTERNS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == RANDOM)).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, q: float = FALSE_DISCOVERY, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced by ``mark``; overlapping
    spans are replaced as one. Rows without spans, and null texts, are unchanged;
    n_chars, where there is one, follows the text. No row is dropped."""
    found = scan(docs, q, rows=True)
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        F.col("spans"),
        nothing,
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, F.greatest(F.size(a), F.lit(1)))["end"] > s["start"]),
            F.concat(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(a, F.greatest(F.size(a), F.lit(1)))["start"].alias("start"),
                        F.greatest(F.element_at(a, F.greatest(F.size(a), F.lit(1)))["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    text = F.col("_row.text")
    pieces = F.transform(
        F.col("_merged"),
        lambda s, i: F.concat(
            F.substring(
                text,
                F.when(i > 0, F.get(F.col("_merged"), i - 1)["end"]).otherwise(F.lit(0)) + 1,
                s["start"] - F.when(i > 0, F.get(F.col("_merged"), i - 1)["end"]).otherwise(F.lit(0)),
            ),
            F.lit(mark),
        ),
    )
    last = F.element_at(F.col("_merged"), -1)["end"]
    clean = F.when(
        F.size("_merged") > 0,
        F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text) - last)),
    ).otherwise(text)
    out = found.withColumn("_merged", F.when(F.size("spans") > 0, merged).otherwise(nothing)).withColumn("_clean", clean)
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_merged") > 0, F.length("_clean").cast("long")).otherwise(
            F.col("_row.n_chars")
        )
    return out.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
