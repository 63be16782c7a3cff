"""Secret scans with DataFrame functions only.

Three base patterns are matched leftmost and without overlap, each kind on its own: assignments of passwords, keys and
tokens, access keys, and long hexadecimal runs.  The method adds spans of kind `entropy`: maximal runs of key
characters are candidates; in each, windows of `window` characters slide over the run while the counts of
characters (a few bits each, in machine words) are kept up by one character in and one out, and the sum of c log2 c with them, in integers.  A run's class (hexadecimal, alphanumeric, base 64) fixes the
entropy that a window has to reach; the span is the union of the run's windows that do.  A run on the allow list
(words, checksums in prose, repeated patterns: `ALLOW`) is suppressed.  Of a run with a `/`, the allow list judges the parts
between: a path is suppressed if the parts that are no words have fewer than `window` characters together, any other such
run if all its parts are allowed too; else the windows of the run and of its longer parts count.  Base spans are found already, so
what is left of a run before, between and after them is judged as runs of their own.

Positions are in code points, the end exclusive.  They come from the lengths of the parts between matches, so no
text leaves the JVM.  Texts without a possible match are turned away by one test of a pattern.

Scale: rows are mapped where they are read; nothing is shuffled.  Memory is one text and its matches.  Runs are measured `STEP` windows at
a time, and places of matches are summed up in groups, so scanning takes time in proportion to a text's length, long runs included; `redact` takes
the length of a text with secrets once for each span.

Defined cases: a null text counts as empty; a text without secrets has empty lists, zero counts and the checksum of an empty string; very long texts
and runs are scanned whole; repeated rows are scanned each; an empty table gives no rows; extra columns are ignored by `digest` and kept by `scan` and
`redact`, whatever their names, but that `scan` puts its two columns in the place of columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import text_of

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group to measure, least length.  A shorter access key or hexadecimal run holds no longer one, so the
#: least length can be part of the pattern; a short assignment takes up its text.
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RANGE = "struct<start:bigint,end:bigint>"
SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"
#: matches whose places are summed up together, windows of a run that are measured together, and what stands for 1 in sums of c log2 c
GROUP, STEP, SCALE = 512, 4096, 1 << 40
#: least length of a candidate run
LEAST = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: class of a run, its pattern, and the entropy in bits that a window of 20 characters must reach
CLASSES = (("hexadecimal", "^[0-9a-fA-F]+$", 3.15), ("alphanumeric", "^[A-Za-z0-9]+$", 3.75), ("base64", "", 3.75))
#: runs that are no secrets: without a digit, without a letter, one case and one number, names with marks, UUIDs
ALLOW = ("^[^0-9]*$", "^[^A-Za-z]*$", "^[A-Za-z][a-z]*[0-9]+$", "^[a-z0-9]+([/_=-][a-z0-9]+){2,}$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh")
PATH = "^/?[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)+/?$"
#: besides `ALLOW`, a part of a run with `/` that is no secret: words, each with a number or none, and numbers, joined by marks
NAME = "^([A-Za-z][a-z]*[0-9]*|[0-9]+)([_=-]([A-Za-z][a-z]*[0-9]*|[0-9]+))*$"


def once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column) -> Column:
    """For each of an array of longs the sum of those before it, group by group, so that no long array is copied for each."""
    begin = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    add = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before"))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / GROUP).cast("int")), lambda k: F.aggregate(F.slice(a, k * GROUP + 1, F.lit(GROUP)), begin, add))

    def joined(groups: Column) -> Column:
        above = F.aggregate(F.transform(groups, lambda g: g["sum"]), begin, add)["before"]
        return F.flatten(F.zip_with(groups, above, lambda g, o: F.transform(g["before"], lambda x: x + o)))

    return once(values, lambda a: once(cut(a), joined))


def found(text: Column, pattern: str) -> Column:
    """Array of (start, match) of a pattern that matches at least one character."""

    def placed(x: Column) -> Column:
        lens = F.zip_with(x["parts"], x["matches"], lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        starts = F.zip_with(running(lens), x["parts"], lambda a, p: a + F.length(p))
        return F.zip_with(F.slice(starts, 1, F.size(x["matches"])), x["matches"], lambda a, m: F.struct(a.alias("start"), m.alias("match")))

    return once(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")), placed)


def none(kind: str) -> Column:
    return F.array().cast(kind)


def base_spans(text: Column) -> Column:
    """Array of (start, place of kind, kind, end) of the base patterns, each kind's in order."""
    return F.concat(*[_kind(text, i, *b) for i, b in enumerate(BASE)])


def _kind(text: Column, place: int, kind: str, pattern: str, group: int, least: int) -> Column:
    spans = found(text, pattern)
    if group:
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["match"], pattern, group)) >= least)
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(none(SPANS))


def entropy_threshold(run: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, pattern, least in reversed(CLASSES[:-1]):
        out = F.when(run.rlike(pattern), F.lit(least)).otherwise(out)
    return out


def dense(run: Column, window: int) -> Column:
    """Array of (start, end) of the union of the windows of run that reach its class's entropy; counted from 0, in order and apart."""
    bits = window.bit_length()
    each = 62 // bits
    words, ones = -(-len(ALPHABET) // each), (1 << bits) - 1
    power = [round(c * math.log2(c or 1) * SCALE) for c in range(window + 2)]
    more = F.array(*[F.lit(power[c + 1] - power[c]).cast("long") for c in range(window + 1)])
    most = F.lit(window) * (F.lit(math.log2(window)) - entropy_threshold(run)) * SCALE
    windows = F.greatest(F.length(run) - window, F.lit(0))
    chunks = lambda top: F.transform(F.sequence(F.lit(0), F.floor(windows / STEP).cast("int")), lambda k: once(
        F.transform(F.split(F.substring(run, k * STEP + 1, F.lit(STEP + window - 1)), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda p: within(p, k * STEP, top)))

    def count(state: Column, place: Column) -> Column:
        word = F.element_at(state["words"], F.floor(place / each).cast("int") + 1)
        return F.call_function("shiftright", word, F.pmod(place, F.lit(each)) * bits).bitwiseAND(F.lit(ones))

    def bit(place: Column, k: Column) -> Column:
        return F.when(F.floor(place / each) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(each)) * bits)).otherwise(F.lit(0).cast("long"))

    def within(place: Column, at: Column, top: Column) -> Column:
        leaves = F.slice(F.concat(F.array_repeat(F.lit(-1), window), place), 1, F.size(place))

        def step(s: Column, x: Column) -> Column:
            come, go = x["come"], x["go"]
            plus = F.element_at(more, count(s, come).cast("int") + 1)
            minus = F.when(go >= 0, F.element_at(more, F.greatest(count(s, go), F.lit(1)).cast("int"))).otherwise(F.lit(0).cast("long"))
            same = come == go
            total = F.when(same, s["sum"]).otherwise(s["sum"] + plus - minus)
            counts = F.when(same, s["words"]).otherwise(F.transform(s["words"], lambda w, k: w + bit(come, k) - F.when(go >= 0, bit(go, k)).otherwise(F.lit(0).cast("long"))))
            return F.struct((s["at"] + 1).alias("at"), counts.alias("words"), total.alias("sum"), s["open"].alias("open"), s["out"].alias("out"))

        def both(s: Column, x: Column) -> Column:
            return once(step(s, x), settle)

        def settle(s: Column) -> Column:
            start = (s["at"] - window + at).cast("long")
            yes = (s["at"] >= window) & (s["sum"] <= top)
            joins = s["open"].isNotNull() & (start <= s["open"]["end"])
            fresh = F.struct(start.alias("start"), (start + window).alias("end"))
            longer = F.struct(s["open"]["start"].alias("start"), (start + window).alias("end"))
            opened = F.when(~yes, s["open"]).when(joins, longer).otherwise(fresh)
            closed = F.when(yes & ~joins & s["open"].isNotNull(), F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"])
            return F.struct(s["at"].alias("at"), s["words"].alias("words"), s["sum"].alias("sum"), opened.alias("open"), closed.alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0).cast("long"), words).alias("words"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast(RANGE).alias("open"), F.array().cast(f"array<{RANGE}>").alias("out"))
        end = lambda s: F.when(s["open"].isNotNull(), F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"])
        return F.aggregate(F.zip_with(place, leaves, lambda a, b: F.struct(a.alias("come"), b.alias("go"))), begin, both, end)

    return united(once(most, lambda top: F.flatten(chunks(top))))


def united(ranges: Column) -> Column:
    """Ranges (start, end) in order and apart: those that overlap or touch are one."""

    def add(s: Column, x: Column) -> Column:
        joins = s["open"].isNotNull() & (x["start"] <= s["open"]["end"])
        longer = F.struct(s["open"]["start"].alias("start"), F.greatest(s["open"]["end"], x["end"]).alias("end"))
        closed = F.when(~joins & s["open"].isNotNull(), F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"])
        return F.struct(F.when(joins, longer).otherwise(x).alias("open"), closed.alias("out"))

    begin = F.struct(F.lit(None).cast(RANGE).alias("open"), F.array().cast(f"array<{RANGE}>").alias("out"))
    return F.aggregate(F.array_sort(ranges), begin, add, lambda s: F.when(s["open"].isNotNull(), F.concat(s["out"], F.array(s["open"]))).otherwise(s["out"]))


def allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out |= run.rlike(pattern)
    return out


def open_parts(run: Column) -> Column:
    """Array of (at, part) of the parts of a run between `/` that are not allowed; at counts from 0."""
    parts = F.aggregate(
        F.split(run, "/"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,part:string>>").alias("out")),
        lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), x.alias("part")))).alias("out")),
    )["out"]
    return F.filter(parts, lambda x: ~(allowed(x["part"]) | x["part"].rlike(NAME)))


def uncovered(x: Column, base: Column) -> Column:
    """Array of (start, match) of what base spans leave of a run x, without what is too short for a candidate."""
    end = x["start"] + F.length(x["match"])
    piece = lambda a, z: F.struct(a.alias("start"), F.substring(x["match"], (a - x["start"] + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int")).alias("match"))
    own = F.array_sort(F.filter(base, lambda b: (b["start"] < end) & (b["end"] > x["start"])))
    begin = F.struct(x["start"].alias("at"), F.array().cast("array<struct<start:bigint,match:string>>").alias("out"))
    cut = F.aggregate(own, begin, lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["out"], F.array(piece(s["at"], b["start"]))).alias("out")), lambda s: F.concat(s["out"], F.array(piece(s["at"], end))))
    return F.filter(F.when(F.size(own) > 0, cut).otherwise(F.array(x)), lambda y: F.length(y["match"]) >= LEAST)


def measured(run: Column, window: int) -> Column:
    """Array of (at, part) of what is measured of a run: nothing if it is no secret, else the whole and, with `/`, its longer parts."""
    whole = F.array(F.struct(F.lit(0).alias("at"), run.alias("part")))

    def with_parts(parts: Column) -> Column:
        rest = F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x["part"]))
        fine = F.when(run.rlike(PATH), rest < window).otherwise(allowed(run) & (rest == 0))
        return F.when(~fine, F.concat(whole, F.filter(parts, lambda x: F.length(x["part"]) >= window)))

    out = F.when(run.contains("/"), F.element_at(F.transform(F.array(open_parts(run)), with_parts), 1)).otherwise(F.when(~allowed(run), whole))
    return F.coalesce(out, F.array().cast("array<struct<at:int,part:string>>"))


def entropy_spans(text: Column, base: Column, window: int) -> Column:
    """Array of (start, place, kind, end) of dense runs that are not on the allow list, outside base spans."""
    runs = F.flatten(F.transform(found(text, CANDIDATE), lambda x: uncovered(x, base)))
    shifted = lambda x: F.flatten(F.transform(measured(x["match"], window), lambda y: F.transform(dense(y["part"], window), lambda d: F.struct((x["start"] + y["at"] + d["start"]).alias("start"), (x["start"] + y["at"] + d["end"]).alias("end")))))
    spans = F.flatten(F.transform(runs, lambda x: united(shifted(x))))
    out = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("place"), F.lit("entropy").alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(CANDIDATE), out).otherwise(none(SPANS))


def scan(docs: DataFrame, *, text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with the columns base_spans and secret_spans (arrays of start, place, kind, end in order of start, then kind)."""
    names = [c for c in docs.columns if c.lower() not in ("base_spans", "secret_spans")]
    row = F.col("row")
    return _scanned(docs, text_col, window).select(*[row.getField(c).alias(c) for c in names], F.array_sort("base").alias("base_spans"), F.col("spans").alias("secret_spans"))


def _scanned(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """row (the columns of docs), text, base and spans; a row's columns go as one, so their names can't clash with those in use here."""
    out = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    out = out.withColumn("base", base_spans(text_of()))
    return out.withColumn("spans", F.array_sort(F.concat("base", entropy_spans(text_of(), F.col("base"), window))))


def named(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    out = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), window=window)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(named("base_spans"), 256).alias("base_sha256"), named("secret_spans").alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", window: int = 20) -> DataFrame:
    """docs with each secret (overlapping spans as one) in the text replaced by mark; null texts stay null."""
    text = F.col("text")

    def cut(s: Column, x: Column) -> Column:
        apart = x["start"] >= s["at"]
        piece = F.when(apart, F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    kept = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text).cast("long"))))
    new = F.when(text.isNotNull() & (F.size("spans") > 0), kept).otherwise(text)
    return _scanned(docs, text_col, window).select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
