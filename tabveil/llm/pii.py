"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers are cut into two halves of digits and passed through a keyed Feistel network modulo powers of ten, so a number
becomes another of the same length, and the same one everywhere: equal values stay linked across texts. Punctuation
stays where it is. Card numbers and IBANs count only if they pass their check, and pass it afterwards; IPv4 octets stay
below 256; dates become other dates of the same format; letters of mail names and of secrets stay in their alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROUNDS = 4
#: Fixed formats, in which nothing repeats without a bound, so that no text is too long; at each place the first that fits counts. Those of cards and IBANs take in neighbours; see narrowed.
FORMATS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,16}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,15}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9]|[./-][0-9])|(?<![0-9./-])(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./][0-9]{4}(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[ .-]?[0-9]{2,4}(?:[.-]?[0-9]{2,4}| (?!OTHER)[0-9]{2,4}){0,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,75}(?![0-9A-Za-z]|[.-][0-9])",
}
#: A phone number ends before a space and one of these.
OTHER = [FORMATS["date"], FORMATS["ip"], FORMATS["ssn"], r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9]{13,19}(?![0-9])", r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9]|[ -][0-9]{4}(?![0-9]))", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"]
FORMATS["phone"] = FORMATS["phone"].replace("OTHER", "|".join(OTHER))
ANY = "|".join(FORMATS.values())
#: How card numbers are grouped; a part of a longer run of digits counts only in these shapes.
CARD_SHAPES = "^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
LOWER_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
HEX = "0123456789abcdef"
EPOCH, SIDE = "1000-01-01", 855  # dates from 1000 on: SIDE * SIDE days, to the year 3001


def keyed(key: str, label: Column, i: Column, x: Column) -> Column:
    """A number below 2**60 from the key, the kind of value, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), label, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, label: Column, left: Column, right: Column, m: Column, n: Column) -> Column:
    """A permutation of the pairs l < m, r < n, as a struct of l and r."""

    def both(s: Column, i: Column) -> Column:
        head = F.pmod(s["l"] + F.pmod(keyed(key, label, i, s["r"]), m), m)
        tail = F.struct(head.alias("l"), s["r"].alias("r"), F.lit(0).alias("half"))
        # a struct of its own, so that the first half is computed once
        return F.transform(F.array(tail), lambda t: F.struct(t["l"].alias("l"), F.pmod(t["r"] + F.pmod(keyed(key, label, i + ROUNDS, t["l"]), n), n).alias("r")))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), both)


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.transform(F.array(x), f)[0]


def permuted_digits(key: str, label: str, digits: Column) -> Column:
    """Another string of as many digits (1 to 36)."""
    size = F.length(digits)
    a = (size / 2).cast("int")
    b = size - a
    power = lambda e: F.rpad(F.lit("1"), e + 1, F.lit("0")).cast("long")
    left = F.coalesce(F.substring(digits, F.lit(1), a).try_cast("long"), F.lit(0).cast("long"))
    right = F.coalesce(F.substring(digits, a + 1, b).try_cast("long"), F.lit(0).cast("long"))
    out = feistel(key, F.concat(F.lit(label), size.cast("string")), left, right, power(a), power(b))
    return let(out, lambda o: F.concat(F.when(a > 0, F.lpad(o["l"].cast("string"), a, F.lit("0"))).otherwise(""), F.lpad(o["r"].cast("string"), b, F.lit("0"))))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def into_format(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), start, put)["out"]


def luhn_sum(digits: Column, odd: int) -> Column:
    """The sum of the digits from the right, those whose number is odd (or even: 0) doubled."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == odd, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), part), F.lit(0), lambda a, b: a + b)


def card(key: str, value: Column) -> Column:
    """Another card number in the same format; the value itself where it fails the Luhn check."""

    def of(digits: Column) -> Column:
        body = let(permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1)), lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.when((F.length(digits) <= 19) & (luhn_sum(digits, 1) % 10 == 0), let(body, lambda d: into_format(value, d))).otherwise(value)

    return let(only_digits(value), of)


def is_card(value: Column) -> Column:
    return let(only_digits(value), lambda d: F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0))


def mod97(text: Column) -> Column:
    """The number that digits (and letters as 10 to 35) spell, modulo 97."""

    def step(s: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.pmod(F.when(v > 9, s * 100 + v).otherwise(s * 10 + v), F.lit(97)).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban(key: str, value: Column) -> Column:
    """Another IBAN of the country in the same format; the value itself where it fails its check."""

    def of(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
        new = let(letters(key, "iban", F.lower(account), LOWER_DIGITS), lambda a: F.upper(a))
        whole = let(new, lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        spaced = lambda w: F.aggregate(
            F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(w, s["at"], F.lit(1)))).alias("out"), (s["at"] + (c != " ").cast("int")).alias("at"))
        )["out"]
        valid = (F.length(plain) <= 34) & (mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, let(whole, spaced)).otherwise(value)

    return let(F.regexp_replace(value, " ", ""), of)


def is_iban(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    return let(plain, lambda w: w.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod97(F.concat(F.substring(w, F.lit(5), F.length(w) - 4), F.substring(w, 1, 4))) == 1))


def letters(key: str, label: str, value: Column, alphabet: str) -> Column:
    """Characters of the alphabet permuted within it; others stay where they are and key the rest.

    The characters fall into two halves; each round shifts one half's by a digest of the other half and of the places
    of the others, so the map can be undone and keeps length and alphabet.
    """
    n = len(alphabet)

    def of(codes: Column) -> Column:
        half = (F.size(codes) / 2).cast("int")

        def shifted(x: Column, other: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), i.cast("string"), F.size(codes).cast("string"), F.array_join(other, ",")), 512)
            return let(digest, lambda d: F.transform(x, lambda v, j: F.when(v < 0, v).otherwise(F.pmod(v + F.conv(F.substring(d, (j * 2) % 127 + 1, F.lit(2)), 16, 10).cast("int"), F.lit(n)).cast("int"))))

        def both(s: Column, i: Column) -> Column:
            return let(F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r")), lambda t: F.struct(t["l"].alias("l"), shifted(t["r"], t["l"], i + ROUNDS).alias("r")))

        start = F.struct(F.slice(codes, F.lit(1), half).alias("l"), F.slice(codes, half + 1, F.size(codes) - half).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, both, lambda s: F.concat(s["l"], s["r"]))

    marks = F.split(value, "")
    codes = F.transform(marks, lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("int"))
    return F.array_join(F.zip_with(marks, let(codes, of), lambda c, v: F.when(v < 0, c).otherwise(F.substring(F.lit(alphabet), v + 1, F.lit(1)))), "")


def ip(key: str, value: Column) -> Column:
    """Another IPv4 address."""
    parts = F.split(value, r"\.").cast("array<long>")
    out = feistel(key, F.lit("ip"), parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536))
    return let(out, lambda o: F.concat_ws(".", *[(x.cast("string")) for x in (F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256)]))


def date(key: str, value: Column) -> Column:
    """Another date in the same format; the value itself where there is no such day, or none of the years 1000 to 2999."""
    iso = value.substr(5, 1) == "-"
    text = F.when(iso, value).otherwise(F.concat_ws("-", value.substr(7, 4), value.substr(4, 2), value.substr(1, 2)))
    mark = value.substr(3, 1)
    day = F.datediff(text.try_cast("date"), F.lit(EPOCH).cast("date"))
    last = 730_485  # days of the years 1000 to 2999

    def once(s: Column, i: Column) -> Column:  # again while outside these years: such a walk ends at another such day
        return F.when((i > 0) & (s < last), s).otherwise(let(feistel(key, F.lit("date"), F.floor(s / SIDE), s % SIDE, F.lit(SIDE), F.lit(SIDE)), lambda o: (o["l"] * SIDE + o["r"]).cast("int")))

    new = F.aggregate(F.sequence(F.lit(0), F.lit(15)), day, once)
    form = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(d, "dd"), mark, F.date_format(d, "MM"), value.substr(6, 1), F.date_format(d, "yyyy")))
    return F.when(day.isNull() | (day < 0) | (day >= last), value).otherwise(let(F.date_add(F.lit(EPOCH).cast("date"), new), form))


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one found value; the value itself where it fails its check."""
    kind = lambda name: value.rlike(f"^(?:{FORMATS[name]})$")
    numbers = lambda label: let(only_digits(value), lambda d: let(permuted_digits(key, label, d), lambda p: into_format(value, p)))
    as_written = lambda new: F.array_join(F.zip_with(F.split(value, ""), F.split(new, ""), lambda c, v: F.when(c != F.lower(c), F.upper(v)).otherwise(v)), "")
    mail = let(F.split(F.lower(value), "@"), lambda p: F.concat(letters(key, "mail", p[0], LOWER_DIGITS), F.lit("@"), letters(key, "host", F.regexp_replace(p[1], r"\.[a-z]+$", ""), LOWER_DIGITS), F.lit("."), F.regexp_extract(p[1], r"\.([a-z]+)$", 1)))
    mail = let(mail, as_written)
    return (
        F.when(F.instr(value, "@") > 0, mail)
        .when(kind("iban"), iban(key, value))
        .when(kind("secret"), let(letters(key, "secret", F.lower(value), HEX), lambda x: F.when(value == F.upper(value), F.upper(x)).otherwise(x)))
        .when(kind("date"), date(key, value))
        .when(kind("ip"), ip(key, value))
        .when(value.startswith("+") | kind("phone"), numbers("phone"))
        .when(kind("ssn"), numbers("ssn"))
        .when(kind("card"), card(key, value))
        .otherwise(value)
    )


def pieces(text: Column) -> Column:
    """Structs of gap and value that make up the text in order: each value that a format fits, after what lies before it; the last value is empty."""
    return F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1), lambda g, v: F.struct(g.alias("gap"), F.coalesce(v, F.lit("")).alias("value")))


def unsure(value: Column) -> Column:
    """Whether a value has the format of a card or an IBAN, and more than one group, but isn't plainly one."""
    earlier = "|".join(FORMATS[name] for name in ("secret", "date", "ip", "ssn"))
    fits = (F.instr(value, " ") > 0) & value.rlike(f"^(?:{FORMATS['card']}|{FORMATS['iban']})$") & ~value.rlike(f"^(?:{earlier})$")
    return fits & ~(value.rlike(CARD_SHAPES) & is_card(value)) & ~is_iban(value)


def narrowed(piece: Column) -> Column:
    """The pieces of a piece whose value fits the format of a card or an IBAN but fails its check, else that piece alone.

    Formats take in the groups around a number: the first run of whole groups that passes counts, and of those with
    the same begin the longest, IBANs and cards in one of CARD_SHAPES before others; where none does, the first group is no part of a value. What follows is searched again.
    """
    value = piece["value"]

    def cut(groups: Column) -> Column:
        def run(i: Column, j: Column) -> Column:
            before = F.aggregate(F.slice(groups, F.lit(1), i), F.lit(0), lambda n, g: n + F.length(g) + 1)
            size = F.aggregate(F.slice(groups, i + 1, j - i + 1), F.lit(-1), lambda n, g: n + F.length(g) + 1)
            return F.struct((~F.substring(value, before + 1, size).rlike(f"{CARD_SHAPES}|^[A-Z]")).alias("odd"), before.alias("before"), (-size).alias("less"), F.substring(value, before + 1, size).alias("run"))

        last = F.size(groups) - 1
        runs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: run(i, j))))
        best = F.get(F.array_sort(F.filter(runs, lambda r: r["less"].between(-50, -13) & (((~r["odd"] | (r["run"] == value)) & is_card(r["run"])) | (r["run"].rlike("^[A-Z]") & is_iban(r["run"]))))), F.lit(0))
        space = F.instr(value, " ")

        def split(b: Column) -> Column:
            head = F.struct(F.concat(piece["gap"], F.substring(value, F.lit(1), b["before"])).alias("gap"), b["run"].alias("value"))
            rest = F.substring(value, b["before"] - b["less"] + 1, F.length(value))
            start = F.struct(F.concat(piece["gap"], F.substring(value, F.lit(1), space - 1)).alias("gap"), F.lit("").alias("value"))
            return F.when(b.isNotNull(), F.concat(F.array(head), pieces(rest))).otherwise(F.concat(F.array(start), pieces(F.substring(value, space, F.length(value)))))

        return let(best, split)

    return F.when(unsure(value), let(F.split(value, "[ -]"), cut)).otherwise(F.array(piece))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by pseudonyms, and n_found, the number of values replaced.

    Equal values get equal pseudonyms in all texts under one key, which must be kept secret (mail addresses regardless
    of case, which is kept where a letter becomes a letter). Host names count up to 16 parts. Numbers that fail
    their check, and texts without personal data, stay as they are; a null text stays null with n_found 0. Rows are
    independent: repeated rows get the same result, an empty table none, other columns stay (an n_found among them is
    replaced). One map over the rows, no shuffle and no Python.
    """
    text = F.col(text_column)
    some = text.rlike("[0-9@]")
    some = F.when(some, pieces(text)).otherwise(F.array().cast("array<struct<gap:string,value:string>>"))
    x = docs.drop("n_found").withColumn("_found", some)
    some_unsure = lambda found: F.exists(found, lambda v: unsure(v["value"]))
    # what is left of a value has fewer groups after each search, so as many searches as the longest has groups end it
    groups = F.array_max(F.transform("_found", lambda v: F.size(F.split(v["value"], "[ -]"))))
    again = F.aggregate(F.sequence(F.lit(1), groups), F.col("_found"), lambda found, _: F.when(some_unsure(found), F.flatten(F.transform(found, narrowed))).otherwise(found))
    x = x.withColumn("_found", F.when(some_unsure(F.col("_found")), again).otherwise(F.col("_found")))
    x = x.withColumn("_new", F.transform("_found", lambda v: pseudonym(key, v["value"])))
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a["value"] != b), lambda c: c))
    new = F.concat_ws("", F.flatten(F.zip_with("_found", "_new", lambda g, v: F.array(g["gap"], v))))
    out = F.when(F.coalesce(F.size("_found"), F.lit(0)) > 0, new).otherwise(text)
    columns = [out.alias(c) if c == text_column else F.col(c) for c in docs.columns if c != "n_found"]
    return x.select(*columns, F.when(text.isNull(), 0).otherwise(changed).cast("long").alias("n_found"))
