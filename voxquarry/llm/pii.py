"""Personal data as format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass their validation are permuted within their format by a keyed Feistel network, so equal
values get equal pseudonyms in every document, different values get different ones, and the holder of the key can go back:

* card: 13 to 19 digits with a valid Luhn sum; the first digit stays, the others but the last are permuted and the last is made anew.
* iban: country code and 11 to 30 digits and capitals with a valid remainder modulo 97; digits are permuted, letters stay, the check digits are made anew.
* ssn: ddd-dd-dddd with an area, group and serial that are given out; permuted among those.
* phone: + and country code, or (ddd) or ddd- at the start, 8 to 15 digits in all, grouped or not; the digits after the country code are permuted.
* ip: four numbers up to 255; permuted among all addresses.
* date: yyyy-mm-dd, dd.mm.yyyy and mm/dd/yyyy (dd/mm/yyyy with day_first) in the calendar of 1900 to 2099; the day is permuted among those.
* email: `user` and 16 digits at example.invalid; the digits are a keyed hash of the lower-case address, for an address is no number to permute.

The network: a value in [0, a * b) is split into a part below a and one below b; in each of `ROUNDS` rounds one part is
added a keyed SHA-256 of the round, the kind and the other part, modulo its own size.  That is a permutation for any a and b, and
no walk out of the range is needed.  Punctuation and grouping stay where they are.

Scale: rows are mapped where they are read; nothing is shuffled, no text leaves the JVM.  A pattern test turns away texts
without candidates.  Patterns have bounded lengths and start at borders, so time is linear in a text's length.

The key is a literal of the plan, so plans and event logs are to be kept as safe as the key.

Defined cases: null texts stay null and have no spans; empty texts stay; very long texts are treated whole; repeated rows are treated each; an empty table gives no
rows; extra columns, whatever their names, are ignored by `digest` and kept by `pseudonymised`.  Values that fail validation stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import once, running
from .util import text_of

ROUNDS = 8
NO = r"(?<![\p{L}\p{N}])"
END = r"(?![\p{L}\p{N}])"
#: kind and pattern; where two could start at one place the earlier stands
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", NO + r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?" + END),
    ("iban", NO + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + END),
    ("date", NO + r"(?<![./-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?!-?[\p{L}\p{N}])"),
    ("date", NO + r"(?<![./-])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?!\.?[\p{L}\p{N}])"),
    ("date", NO + r"(?<![./-])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?!/?[\p{L}\p{N}])"),
    ("ssn", NO + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[\p{L}\p{N}])"),
    ("ip", NO + r"(?<!\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[\p{L}\p{N}])"),
    ("card", NO + r"(?<!\.)[0-9]{13,19}" + END),
    ("card", NO + r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}" + END),
    ("card", NO + r"[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}" + END),
    ("phone", r"(?<![\p{L}\p{N}+])\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}" + END),
    ("phone", r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\)|[\x20.-][0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,4}" + END),
    ("phone", r"(?<![\p{L}\p{N}+])\+[0-9]{8,15}" + END),
    ("phone", r"(?<![\p{L}\p{N}+(])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}" + END),
    ("phone", NO + r"(?<!-)[0-9]{3}-[0-9]{3}-[0-9]{4}(?!-?[\p{L}\p{N}])"),
)
NAMES = ("card", "iban", "ssn", "phone", "ip", "date", "email")
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: what every match has; texts without it are turned away
HINT = r"[0-9]{4}|[0-9][./-][0-9]|@[A-Za-z0-9-]+\.|\+[0-9]|[A-Z]{2}[0-9]{2}"
#: the country code at the start of a number's digits, however they are grouped (ITU-T E.164: those not listed have three digits)
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: given-out area numbers: 001 to 899 without 666; groups 01 to 99; serials 0001 to 9999
AREAS, GROUPS, SERIALS = 898, 99, 9999
#: days from 1900-01-01 to 2099-12-31 as 319 times 229
DAYS = (319, 229)
FIRST_DAY = "1900-01-01"
SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string,pseudonym:string>>"


def prf(key: str, label: Column, below: Column) -> Column:
    """A keyed hash of label, at most below - 1."""
    digest = F.sha2(F.concat(F.lit(key + "|"), label, F.lit("|" + key)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def feistel(value: Column, a: Column, b: Column, key: str, kind: Column | str) -> Column:
    """The pseudonym in [0, a * b) of a value in it (longs); each kind has a permutation of its own."""

    def one(s: Column, i: Column) -> Column:
        # the parts and their sizes change places, so each round changes what stands left
        label = F.concat_ws(":", kind, s["n"].cast("string"), s["m"].cast("string"), i.cast("string"), s["r"].cast("string"))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + prf(key, label, s["m"]), s["m"]).alias("r"), s["n"].alias("m"), s["m"].alias("n"))

    kind = F.lit(kind) if isinstance(kind, str) else kind
    a, b = a.cast("long"), b.cast("long")
    begin = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"), a.alias("m"), b.alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, one, lambda s: s["l"] * s["n"] + s["r"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def filled(shape: Column, values: Column) -> Column:
    """shape with its digits replaced, in order, by those of values."""

    def put(s: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct((s["at"] + own.cast("int")).alias("at"), F.concat(s["out"], F.when(own, F.substring(values, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), put, lambda s: s["out"])


def power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(d: Column, key: str, kind: Column) -> Column:
    """Up to 18 digits (as a string) permuted; one digit is permuted as itself."""
    n = F.length(d)
    low = F.floor(n / 2).cast("int")
    out = feistel(d.cast("long"), power10((n - low).cast("int")), power10(low), key, kind)
    return F.lpad(out.cast("string"), n, "0")


def long_digits(d: Column, key: str, kind: str) -> Column:
    """Any number of digits: 18 at a time, the later ones under a label of those before."""
    places = F.sequence(F.lit(0), F.floor((F.length(d) - 1) / 18).cast("int"))
    label = lambda i: F.concat(F.lit(kind), F.when(i > 0, F.concat(F.lit("|"), F.substring(d, F.lit(1), i * 18))).otherwise(""))
    return F.array_join(F.transform(places, lambda i: permuted_digits(F.substring(d, i * 18 + 1, F.lit(18)), key, label(i))), "")


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    ds = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5).cast("int") + F.pmod(c.cast("int") * 2, F.lit(10))))
    return F.pmod(F.aggregate(ds, F.lit(0), lambda s, x: s + x), F.lit(10))


def mod97(text: Column) -> Column:
    """The remainder of an account number (letters count from 10) modulo 97."""

    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, F.pmod(s * 10 + code - 48, F.lit(97))).otherwise(F.pmod(s * 100 + code - 55, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    d = digits(m)
    first, rest = F.substring(d, 1, 1), F.substring(d, F.lit(2), F.length(d) - 2)
    body = F.concat(first, permuted_digits(rest, key, F.lit("card")))
    check = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when((luhn(d) == 0) & F.length(d).between(13, 19), filled(m, F.concat(body, check.cast("string"))))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, "\x20", "")
    body, land = F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2)
    inner = F.substring(m, F.lit(5), F.length(m))
    new = F.when(F.length(digits(body)) > 0, filled(inner, long_digits(digits(body), key, "iban"))).otherwise(inner)
    check = F.lpad((98 - mod97(F.concat(F.regexp_replace(new, "\x20", ""), land, F.lit("00")))).cast("string"), 2, "0")
    valid = (mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    return F.when(valid, F.concat(land, check, new))


def _ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    index = (F.when(area > 666, area - 2).otherwise(area - 1) * GROUPS + group - 1) * SERIALS + serial - 1
    new = feistel(index, F.lit(AREAS * GROUPS), F.lit(SERIALS), key, F.lit("ssn"))

    def written(v: Column) -> Column:
        high = F.floor(v / SERIALS).cast("long")
        a = F.floor(high / GROUPS).cast("long") + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(F.pmod(high, F.lit(GROUPS)) + 1, 2), pad(F.pmod(v, F.lit(SERIALS)) + 1, 4))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, once(new, written))


def _phone(m: Column, key: str) -> Column:
    d = digits(m)
    n = F.when(m.startswith("+"), F.length(F.regexp_extract(d, COUNTRY, 0))).otherwise(0)
    own = F.substring(d, n + 1, F.length(d))
    new = F.concat(F.substring(d, F.lit(1), n), permuted_digits(own, key, F.lit("phone")))
    return F.when(F.length(d).between(8, 15) & (F.length(own) >= 5), filled(m, new))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel(value, F.lit(65536), F.lit(65536), key, F.lit("ip"))
    written = lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / 256**i).cast("long"), F.lit(256)).cast("string") for i in (3, 2, 1, 0)])
    return F.when(F.forall(parts, lambda x: x <= 255), once(new, written))


def _date(m: Column, key: str, day_first: bool) -> Column:
    slashed = "dd/MM/yyyy" if day_first else "MM/dd/yyyy"

    def shaped(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        new = feistel(day, F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.lit("date"))
        return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form))

    return F.when(m.contains("-"), shaped("yyyy-MM-dd")).when(m.contains("."), shaped("dd.MM.yyyy")).otherwise(shaped(slashed))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.lpad(prf(key, F.concat(F.lit("email:"), F.lower(m)), F.lit(10**16)).cast("string"), 16, "0"), F.lit("@example.invalid"))


def _of(m: Column, key: str, day_first: bool) -> Column:
    """(kind, pseudonym) of a match; null where it fails validation."""
    made = {"card": _card(m, key), "iban": _iban(m, key), "ssn": _ssn(m, key), "phone": _phone(m, key), "ip": _ip(m, key), "date": _date(m, key, day_first), "email": _email(m, key)}
    forms = {
        "email": m.contains("@"),
        "iban": m.rlike("^[A-Z]{2}"),
        "date": m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"),
        "ssn": m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "ip": m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"),
        "phone": m.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-"),
    }
    out = F.struct(F.lit("card").alias("kind"), made["card"].alias("pseudonym"))
    for kind, is_ in reversed(forms.items()):
        out = F.when(is_, F.struct(F.lit(kind).alias("kind"), made[kind].alias("pseudonym"))).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", day_first: bool = False, spans_col: str = "pii_spans") -> DataFrame:
    """docs with pseudonyms in the text, and spans_col, in the place of a column of its name: start, end (code points of the given text), kind, value and pseudonym of each."""
    text = text_of()
    parts, matches = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    pieces = F.zip_with(parts, matches, lambda p, m: F.struct(p.alias("before"), m.alias("match"), F.when(m.isNotNull(), _of(m, key, day_first)).alias("new")))
    some = text.rlike(HINT) & text.rlike(ANY)
    # a row's columns go as one, so their names can't clash with those in use here
    out = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")).withColumn("pieces", F.when(some, pieces))
    ends = running(F.transform("pieces", lambda x: (F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0))).cast("long")))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["before"])
        return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["new"]["kind"].alias("kind"), x["match"].alias("value"), x["new"]["pseudonym"].alias("pseudonym"))

    spans = F.coalesce(F.filter(F.zip_with("pieces", ends, span), lambda x: x["pseudonym"].isNotNull()), F.array().cast(SPANS))
    new = F.array_join(F.transform("pieces", lambda x: F.concat(x["before"], F.coalesce(x["new"]["pseudonym"], x["match"], F.lit("")))), "")
    new = F.when(F.col("pieces").isNull(), F.col("text")).otherwise(new)
    kept = [c for c in docs.columns if c.lower() != spans_col.lower()]
    return out.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept], spans.alias(spans_col))


def digest(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", day_first: bool = False) -> DataFrame:
    """doc_id, text (with pseudonyms), a count of each kind and spans (kind:start:end, joined by commas) of every row."""
    out = pseudonymised(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key, day_first=day_first)
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", *[count(k) for k in NAMES], named.alias("spans"))
