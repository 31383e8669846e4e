"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers, dates, addresses and keys are found by patterns and validated (Luhn digit, octets, calendar, forbidden areas). A
value becomes a list of small numbers, each with its radix, and a Feistel network permutes the list: the halves take
turns, each element is shifted, modulo its radix, by a keyed hash of the other half. This is a bijection on the values
of a format, so equal values get equal pseudonyms in all documents, however they are spaced, and different ones stay
different. Layout, length, letter case, country code, domain and first card digit stay; the Luhn digit is computed anew.

Cards are looked for in whole runs of digit groups, since other numbers (a count, an expiry, a check number) may stand on either side: every
succession of groups with 13 to 19 digits is tried that is set like a card (at least 4 digits, then 3, the last group any number), and the first
groups of the run however they are set. An issuer's number of its usual length goes first, then the leftmost, then the longest. What is
left of a run is searched for the other kinds.

Defined results: null and empty texts stay as they are; texts without findings stay unchanged; values that fail
validation are left alone; repeated values and rows are replaced alike; an empty table gives no rows; other columns
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.fingerprints import bound
from corpusflow.llm.tables import fresh

KEY = "corpusflow-demonstration-key"  # a deployment passes its own
ROUNDS = 8
FIRST_DAY, DAY_RADICES = "1900-01-01", (150, 487)  # 73 050 days, up to 2100-01-01

# What counts as personal data. No pattern matches an empty string.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi_?[Kk]ey|API_?KEY)[\"']?[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9_./+-]{8,}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
DOTTED = r"(?=[0-9]{3}(?:[ -][0-9]{3})?\.)" + KINDS["phone"]
# A run of digit groups, up to what has other characters of its own. Possessive: no backtracking in long tables of numbers.
KINDS["card"] = rf"(?<![0-9])[0-9](?:(?![ -](?:{KINDS['email']}|{KINDS['ip']}|{DOTTED}))[ -]?[0-9]){{12,}}+"
IN_RUN = "|".join(f"(?:{KINDS[k]})" for k in ("date", "ssn", "phone"))  # kinds that a run can contain
CARD_LENGTH = "^(?:[0-9] ?){13,19}$"
CARD_LAYOUT = "^[0-9]{4,}(?: [0-9]{3,})*(?: [0-9]+)?$"
ISSUED = "^(?:4[0-9]{15}|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|[245][0-9]{2})[0-9]{12})$"
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
HINT = "[0-9@=:]"  # every kind has one of these
HEX = "0123456789abcdef"


def kind_of(value: Column) -> Column:
    out = F.lit("card")
    for kind, p in reversed(list(KINDS.items())[:-1]):
        bare = p.split("(?<!")[0] or p[p.index(")") + 1:]  # a value alone has nothing around it
        bare = bare.rsplit("(?!", 1)[0] if "(?!" in bare else bare
        out = F.when(value.rlike(f"^(?:{bare})$"), kind).otherwise(out)
    return out


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(number: Column, first: int) -> Column:
    """Sum of digits from the right; every second one is doubled, beginning with place ``first``."""
    return F.aggregate(F.transform(F.split(F.reverse(number), ""), lambda c, i: bound(
        c.cast("int") * F.when(i % 2 == first, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))), F.lit(0), lambda a, b: a + b)


def luhn_valid(number: Column) -> Column:
    return _luhn_sum(number, 1) % 10 == 0


def luhn_digit(payload: Column) -> Column:
    return F.pmod(10 - _luhn_sum(payload, 0) % 10, F.lit(10)).cast("string")


def valid(kind: Column, value: Column) -> Column:
    octets = F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)
    day = F.try_to_date(value, "yyyy-MM-dd")
    area = F.substr(value, F.lit(1), F.lit(3))
    return (F.when(kind == "card", luhn_valid(digits(value))).when(kind == "ip", octets)
            .when(kind == "date", F.coalesce(day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False)))
            .when(kind == "ssn", ~area.isin("000", "666") & ~area.startswith("9")).otherwise(F.lit(True)))


def core(kind: Column, value: Column) -> Column:
    """The characters of a value that are permuted."""
    d = digits(value)
    return (F.when(kind == "email", F.regexp_extract(value, "^[^@]+", 0)).when(kind == "secret", F.regexp_extract(value, "[A-Za-z0-9_./+-]+$", 0))
            .when(kind == "access_key", F.substr(value, F.lit(5), F.lit(16))).when(kind == "card", F.substr(d, F.lit(2), F.length(d) - 2))
            .when(kind == "phone", F.substr(d, F.length(d) - 9, F.lit(10))).when(kind == "ssn", d).otherwise(value))


def _number(kind: Column, text: Column, hexadecimal: Column) -> tuple[Column, Column]:
    """Elements and radices of what is permuted: octets, a day, hexadecimal digits, or letters and digits of their class."""
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_RADICES
    chars = F.split(text, "")
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))
    radix = lambda c: F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)
    # an area code and an exchange begin with 2 to 9, or with 0 or 1
    lead = lambda c: F.when(c >= "2", 50).otherwise(48)
    leads = lambda i: (kind == "phone") & ((i == 0) | (i == 3))
    x = (F.when(kind == "ip", F.transform(F.split(text, r"\."), lambda o: o.cast("int")))
         .when(kind == "date", F.array(F.floor(day / b).cast("int"), day % b))
         .when(hexadecimal, F.transform(chars, lambda c: F.instr(F.lit(HEX), c) - 1))
         .otherwise(F.transform(chars, lambda c, i: F.ascii(c) - F.when(leads(i), lead(c)).otherwise(base(c)))))
    r = (F.when(kind == "ip", F.transform(F.split(text, r"\."), lambda o: F.lit(256))).when(kind == "date", F.array(F.lit(a), F.lit(b)))
         .when(hexadecimal, F.transform(chars, lambda c: F.lit(16)))
         .otherwise(F.transform(chars, lambda c, i: F.when(leads(i), F.when(c >= "2", 8).otherwise(2)).otherwise(radix(c)))))
    return x, r


def permute(x: Column, r: Column, tweak: Column, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """The Feistel network on numbers ``x`` below the radices ``r``; ``tweak`` and ``key`` choose the permutation."""

    def shift(k, i, other, radix):
        h = F.sha2(F.concat_ws("|", F.lit(key), tweak, k.cast("string"), i.cast("string"), F.concat_ws(",", other.cast("array<string>"))), 256)
        return F.pmod(F.conv(F.substr(h, F.lit(1), F.lit(12)), 16, 10).cast("long"), radix.cast("long")).cast("int")

    def turn(state, k):
        half = F.floor(F.size(state) / 2).cast("int")
        first = k % 2 == 0
        other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))
        return bound(other, lambda o: F.transform(state, lambda v, i: F.when(
            (i < half) == first, F.pmod(v + shift(k, i, o, F.get(r, i)), F.get(r, i))).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, turn)


def _refill(template: Column, number: Column) -> Column:
    """``template`` with its last digits replaced by those of ``number``, in order."""
    ahead = F.length(digits(template)) - F.length(number)
    return F.array_join(F.transform(F.split(template, ""), lambda c, i: bound(
        F.length(digits(F.substr(template, F.lit(1), i + 1))) - ahead, lambda n: F.when(
            c.between("0", "9") & (n >= 1), F.substr(number, n, F.lit(1))).otherwise(c))), "")


def pseudonym(value: Column, key: str = KEY) -> Column:
    """What stands for a found value; the value itself where it isn't valid."""

    def replace(kind: Column) -> Column:
        text = core(kind, value)
        hexadecimal = (kind == "secret") & text.rlike("^[0-9a-f]+$")
        x, r = _number(kind, text, hexadecimal)
        chars = F.split(text, "")

        def render(y: Column) -> Column:
            code = lambda v, i: bound(F.get(chars, i), lambda c: F.char(v + F.when(
                (kind == "phone") & ((i == 0) | (i == 3)), F.when(c >= "2", 50).otherwise(48)).when(
                c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))))
            new = (F.when(kind == "ip", F.array_join(y.cast("array<string>"), ".")).when(
                kind == "date", F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), y[0] * DAY_RADICES[1] + y[1]), "yyyy-MM-dd"))
                .when(hexadecimal, F.array_join(F.transform(y, lambda v: F.substr(F.lit(HEX), v + 1, F.lit(1))), ""))
                .otherwise(F.array_join(F.transform(y, code), "")))
            return bound(new, lambda s: F.when(kind.isin("ip", "date"), s).when(kind == "email", F.concat(s, F.regexp_extract(value, "@.*$", 0))).when(
                kind.isin("secret", "access_key"), F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(s)), s)).when(
                kind == "card", bound(F.concat(F.substr(digits(value), F.lit(1), F.lit(1)), s), lambda p: _refill(value, F.concat(p, luhn_digit(p))))).otherwise(_refill(value, s)))

        return F.when(valid(kind, value), bound(permute(x, r, kind, key), render)).otherwise(value)

    return bound(kind_of(value), replace)


def _cards(value: Column) -> Column:
    """First and last character (from 1) of the valid cards in a run of digit groups, from left to right."""

    def within(groups: Column) -> Column:
        n = F.size(groups)
        text = lambda i, j: F.array_join(F.slice(groups, i + 1, j - i), " ")

        def tried(i: Column, j: Column) -> Column:
            def ranked(t: Column) -> Column:
                first = (i == 0) & ((j == n) | ~text(i, j + 1).rlike(CARD_LENGTH))
                fits = t.rlike(CARD_LENGTH) & (t.rlike(CARD_LAYOUT) | first)
                rank = F.when(fits, F.when(luhn_valid(digits(t)), F.when(digits(t).rlike(ISSUED), 0).otherwise(1)))
                return F.struct(rank.alias("rank"), i.alias("start"), (-j).alias("end"))

            return bound(text(i, j), ranked)

        spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, F.least(n, i + 19)), lambda j: tried(i, j))))

        def free(spans: Column) -> Column:
            taken = F.aggregate(spans, F.slice(spans, 1, 0), lambda a, c: F.when(
                F.exists(a, lambda t: (t["start"] < -c["end"]) & (c["start"] < -t["end"])), a).otherwise(F.concat(a, F.array(c))))
            return F.array_sort(F.transform(taken, lambda c: F.struct(
                (F.length(text(F.lit(0), c["start"])) + F.when(c["start"] > 0, 2).otherwise(1)).alias("start"), F.length(text(F.lit(0), -c["end"])).alias("end"))))

        return bound(F.array_sort(F.filter(spans, lambda c: c["rank"].isNotNull())), free)

    return bound(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), within)


def findings(value: Column) -> Column:
    """Pieces of what a pattern found, with whether each is a finding: runs of digit groups are taken apart, other values stay whole."""
    piece = lambda v, hit: F.struct(v.alias("v"), F.lit(hit).alias("hit") if isinstance(hit, bool) else hit.alias("hit"))

    def others(rest: Column) -> Column:
        return bound(F.regexp_extract_all(rest, F.lit(IN_RUN), F.lit(0)), lambda found: F.flatten(F.transform(F.split(rest, IN_RUN, -1), lambda p, i: F.array(
            piece(p, False), piece(F.coalesce(F.get(found, i), F.lit("")), i < F.size(found))))))

    def apart(cards: Column) -> Column:
        end = lambda k: F.coalesce(F.get(cards, k)["end"], F.lit(0))
        cut = lambda a, b: F.substr(value, a, b - a + 1)
        ahead = F.flatten(F.transform(cards, lambda c, k: F.concat(
            bound(cut(end(k - 1) + 1, c["start"] - 1), others), F.array(piece(cut(c["start"], c["end"]), True)))))
        return F.concat(ahead, bound(cut(end(F.size(cards) - 1) + 1, F.length(value)), others))

    whole = F.array(piece(value, True))
    invalid = lambda got: F.when(F.exists(got, lambda g: g["hit"]), got).otherwise(
        F.array(piece(value, F.length(digits(value)) <= 19)))
    return F.when(kind_of(value) == "card", bound(bound(_cards(value), apart), invalid)).otherwise(whole)


def pseudonymise(docs: DataFrame, text_column: str, key: str = KEY, counts: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text_column`` replaced; ``counts`` adds the number of findings of each kind."""
    text = F.col(text_column)
    found_column, new_column = fresh(docs, "found", "new")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(found_column, F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn(found_column, F.transform(found_column, findings))
    replaced = lambda g: F.when(g["hit"], pseudonym(g["v"], key)).otherwise(g["v"])
    out = out.withColumn(new_column, F.transform(found_column, lambda v: F.array_join(F.transform(v, replaced), "")))
    parts = F.split(text, PATTERN, -1)
    joined = F.array_join(F.flatten(F.transform(parts, lambda p, i: F.array(p, F.coalesce(F.get(F.col(new_column), i), F.lit(""))))), "")
    out = out.withColumn(text_column, F.when(F.size(found_column) > 0, joined).otherwise(text))
    if counts:
        kinds = F.transform(F.filter(F.flatten(found_column), lambda g: g["hit"]), lambda g: kind_of(g["v"]))
        names = fresh(docs, "kinds")[0]
        out = out.withColumn(names, kinds)
        out = out.withColumns({f"n_{k}": F.size(names) - F.size(F.array_remove(names, k)) for k in KINDS}).drop(names)
    return out.drop(found_column, new_column)


def protect(docs: DataFrame) -> DataFrame:
    """The query: all texts with pseudonyms, and the number of findings by kind."""
    return pseudonymise(docs.select("doc_id", "text"), "text", counts=True)
