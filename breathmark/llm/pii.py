"""Format-preserving Feistel pseudonyms of personal data, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of each Feistel network, an even number.
ROUNDS = 8
#: Days from EPOCH on that dates are permuted within: 1900-01-01 to 2099-12-31, 17 * 4297 of them.
EPOCH, DAY_WHEELS = "1900-01-01", (17, 4297)

# What may stand between two digits of a telephone number; after a space another kind of number may begin instead.
_OTHER = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[0-9]{13}"
_JOIN = rf"(?:[ .-]?\(|\)[ .-]?|[.-]| (?!{_OTHER}))?"

#: What is looked for, in the order in which it is tried at each place. None ends or begins within a longer number or word.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key))\s*[:=]\s*[\"']?[A-Za-z0-9_-]{16,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b",
    "ip": r"(?<![0-9.]|[vV]|[vV]ersion )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": rf"(?<![0-9])\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])|(?<![0-9])\+[0-9](?:{_JOIN}[0-9]){{8,14}}(?![0-9])|(?<![0-9])(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: First digits and lengths of payment cards by issuer (fixed values): Visa, Mastercard, American Express, Discover, JCB, Diners, UnionPay, Maestro.
ISSUED = (
    r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}"
    r"|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12}(?:[0-9]{3})?|35(?:2[89]|[3-8][0-9])[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11}|62[0-9]{14,17}"
    r"|(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15})$"
)
#: Groups of an account number of which the last ones may be words that follow it.
LEAST_GROUPS = 4
#: Characters that 128 hex digits turn, three for each.
TURNED = 42


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Pseudonyms:
    """Column expressions of one key. Every method maps its domain onto itself, so different values stay different."""

    def __init__(self, key: str):
        self.key = key

    def _drawn(self, *parts: Column) -> Column:
        """128 hex digits that depend on the key and the parts."""
        return F.sha2(F.concat_ws("|", F.lit(self.key), *parts), 512)

    def number(self, n: Column, wheels: tuple[int, int], tweak: str) -> Column:
        """A permutation of 0 .. wheels[0] * wheels[1] - 1: two wheels turn by turn, each by what the other shows."""
        a, b = wheels

        def turn(state: Column, i: Column) -> Column:
            def by(x: Column, size: int) -> Column:
                drawn = self._drawn(F.lit(tweak), i.cast("string"), x.cast("string"))
                return F.pmod(F.conv(F.substring(drawn, 1, 14), 16, 10).cast("long"), F.lit(size))

            first = F.when(i % 2 == 0, F.pmod(state.x + by(state.y, a), F.lit(a))).otherwise(state.x)
            second = F.when(i % 2 == 1, F.pmod(state.y + by(state.x, b), F.lit(b))).otherwise(state.y)
            return F.struct(first.alias("x"), second.alias("y"))

        n = n.cast("long")
        start = F.struct(F.floor(n / F.lit(b)).cast("long").alias("x"), F.pmod(n, F.lit(b)).cast("long").alias("y"))
        steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(steps, start, turn, lambda s: s.x * F.lit(b) + s.y)

    def _turn(self, text: Column, drawn: Column, hexadecimal: Column) -> Column:
        """Each digit and letter moved on within its own kind; other characters stay. Large and small letters alike.

        ``drawn`` turns the first TURNED characters, and what is drawn from it and their number each further so many.
        """
        more = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / TURNED).cast("int")), lambda n: F.when(n == 0, drawn).otherwise(F.sha2(F.concat_ws("|", drawn, n.cast("string")), 512)))
        return let(more, lambda streams: self._turned(text, streams, hexadecimal))

    @staticmethod
    def _turned(text: Column, streams: Column, hexadecimal: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            code = F.ascii(c)
            stream = F.get(streams, F.floor(i / TURNED).cast("int"))
            by = F.conv(F.substr(stream, i % TURNED * 3 + 1, F.lit(3)), 16, 10).cast("int")

            def within(first: int, size: Column | int) -> Column:
                return F.char((F.pmod(code - first + by, size if isinstance(size, Column) else F.lit(size)) + first).cast("long"))

            letters = F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
            out = F.when(code.between(48, 57), within(48, 10))
            for first in (97, 65):
                out = out.when(code.between(first, first + 25), within(first, letters))
            for first in (224, 192):  # accented Latin-1 letters
                out = out.when(code.between(first, first + 22), within(first, 23))
            return out.otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def string(self, text: Column, tweak: str) -> Column:
        """A permutation of the strings with the same kinds of characters at the same places, as a Feistel network.

        Halves change places each round and the one that leaves is turned by what the key draws from the other.
        Letters that differ in case only are turned alike.
        """
        return let(text, lambda t: let(t.rlike("^[0-9a-f]{16,}$|^[0-9A-F]{16,}$"), lambda h: self._string(t, h, tweak)))

    def _string(self, text: Column, hexadecimal: Column, tweak: str) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")

        def swap(state: Column, i: Column) -> Column:
            drawn = self._drawn(F.lit(tweak), i.cast("string"), F.length(state.x).cast("string"), F.lower(state.y))
            return F.struct(state.y.alias("x"), let(drawn, lambda d: self._turn(state.x, d, hexadecimal)).alias("y"))

        start = F.struct(F.substr(text, F.lit(1), half).alias("x"), F.substr(text, half + 1).alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, swap, lambda s: F.concat(s.x, s.y))

    def email(self, s: Column) -> Column:
        """The local part; the domain stays."""
        return F.concat(self.string(F.substring_index(s, "@", 1), "email"), F.lit("@"), F.substring_index(s, "@", -1))

    def secret(self, s: Column) -> Column:
        value = F.regexp_extract(s, r"([A-Za-z0-9_-]+)$", 1)
        return F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(value)), self.string(value, "secret"))

    def ip(self, s: Column) -> Column:
        """Any address for any other; null if a part is over 255."""
        parts = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
        whole = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)

        def show(new: Column) -> Column:
            return F.array_join(
                F.transform(F.array(*[F.lit(n) for n in (24, 16, 8, 0)]), lambda n: F.floor(new / F.pow(F.lit(2.0), n)).cast("long") % 256),
                ".",
            )

        shown = let(self.number(whole, (1 << 16, 1 << 16), "ip"), show)
        return F.when(F.forall(parts, lambda x: x <= 255), shown)

    def date(self, s: Column) -> Column:
        """A day for a day in the same form; null if it isn't one. Month first where a slashed date can be read so."""
        digits = F.when(s.contains("-"), F.try_to_date(s, "yyyy-MM-dd")).when(s.contains("."), F.try_to_date(s, "dd.MM.yyyy"))
        month_first = F.try_to_date(s, "MM/dd/yyyy")
        day = F.coalesce(digits, month_first, F.try_to_date(s, "dd/MM/yyyy"))
        a, b = DAY_WHEELS
        nth = F.datediff(day, F.lit(EPOCH).cast("date"))

        def show(new: Column) -> Column:
            return (
                F.when(s.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(s.contains("."), F.date_format(new, "dd.MM.yyyy"))
                .when(month_first.isNotNull(), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
            )

        shown = let(F.date_add(F.lit(EPOCH).cast("date"), self.number(nth, DAY_WHEELS, "date").cast("int")), show)
        return F.when(nth.between(0, a * b - 1), shown)

    def ssn(self, s: Column) -> Column:
        """Among numbers that can be given out: area 001-899 but 666, group and serial not zero."""
        part = [F.substr(s, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4))]
        area = part[0] - F.when(part[0] > 666, 2).otherwise(1)
        n = (area * 99 + part[1] - 1) * 9999 + part[2] - 1

        def show(new: Column) -> Column:
            area = F.floor(new / F.lit(99 * 9999)).cast("long")
            area = area + F.when(area >= 665, 2).otherwise(1)
            return F.format_string("%03d-%02d-%04d", area, F.floor(new / F.lit(9999)).cast("long") % 99 + 1, new % 9999 + 1)

        shown = let(self.number(n, (898, 99 * 9999), "ssn"), show)
        return F.when(part[0].between(1, 899) & (part[0] != 666) & (part[1] > 0) & (part[2] > 0), shown)

    def _into(self, form: Column, new: Column, kind: str = "0-9") -> Column:
        """``form`` with its digits, or characters of ``kind``, replaced in order."""
        places = F.transform(
            F.split(form, ""),
            lambda c, i: F.when(
                c.rlike(f"[{kind}]"),
                F.substr(new, F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), f"[^{kind}]", "")), F.lit(1)),
            ).otherwise(c),
        )
        return F.array_join(places, "")

    def phone(self, s: Column) -> Column:
        """The last digits, seven at most; what stands before, country and area, stays. Null outside 9 to 15 digits."""

        def made(digits: Column) -> Column:
            n = F.length(digits)
            new = F.concat(F.substr(digits, F.lit(1), n - 7), self.string(F.substr(digits, n - 6), "phone"))
            return F.when(n.between(9, 15), let(new, lambda x: self._into(s, x)))

        return let(F.regexp_replace(s, "[^0-9]", ""), made)

    @staticmethod
    def _luhn(digits: Column) -> Column:
        """The Luhn sum; every second digit from the one before the last counts double."""
        n = F.length(digits)

        def worth(i: Column) -> Column:
            d = F.substr(digits, i, F.lit(1)).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return F.when((n - i) % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)

    def card(self, s: Column) -> Column:
        """All digits but the issuer's first six and the check digit, which is made anew; null if the number fails its own or no issuer has such."""

        def made(digits: Column) -> Column:
            account = self.string(F.substr(digits, F.lit(7), F.length(digits) - 7), "card")
            body = F.concat(F.substr(digits, F.lit(1), F.lit(6)), account)
            whole = let(body, lambda b: F.concat(b, F.pmod(-self._luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
            return F.when(digits.rlike(ISSUED) & (self._luhn(digits) % 10 == 0), let(whole, lambda w: self._into(s, w)))

        return let(F.regexp_replace(s, "[^0-9]", ""), made)

    @staticmethod
    def _mod97(s: Column) -> Column:
        """Of the digits, a letter counting as two from 10 on."""

        def step(a: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code <= 57, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

        return F.aggregate(F.split(s, ""), F.lit(0), step)

    def iban(self, s: Column) -> Column:
        """The account; country stays and check digits are made anew. Null if they don't fit.

        In groups, the longest run of them that fits is the number, and what follows stays.
        """

        def made(form: Column) -> Column:
            whole = F.replace(form, F.lit(" "), F.lit(""))
            country, account = F.substr(whole, F.lit(1), F.lit(2)), F.substr(whole, F.lit(5))

            def show(new: Column) -> Column:
                check = F.lit(98) - self._mod97(F.concat(new, country, F.lit("00")))
                return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

            return let(let(self.string(account, "iban"), show), lambda new: F.concat(self._into(form, new, "A-Z0-9"), F.substr(s, F.length(form) + 1)))

        def fits(form: Column) -> Column:
            whole = F.replace(form, F.lit(" "), F.lit(""))
            return F.length(whole).between(15, 34) & (self._mod97(F.concat(F.substr(whole, F.lit(5)), F.substr(whole, F.lit(1), F.lit(4)))) == 1)

        groups = F.split(s, " ")
        fewest = F.least(F.size(groups), F.lit(LEAST_GROUPS))
        forms = F.transform(F.sequence(F.size(groups), fewest, F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return let(F.get(F.filter(forms, fits), F.lit(0)), lambda form: F.when(form.isNotNull(), made(form)))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``text`` with its personal data replaced, a count ``n_<kind>`` of each kind.

    Kinds: PATTERNS. E-mail addresses, telephone numbers, addresses of the internet protocol, payment cards (Luhn),
    account numbers (mod 97), social security numbers, dates, and values given to words such as token or password.
    A number or date that fails its check stays, and so does all other text, version numbers and cards of no issuer too. The replacement is a permutation of the
    values of one format under ``key``: equal values get equal pseudonyms in all documents, written as the original
    was, different values different ones, and pseudonyms pass the check that the originals passed; one value in its
    format's many may get itself. A null text stays null with counts of 0, an empty one empty. Very long texts and values
    are worked on whole: no pattern repeats a group without a bound, so none runs deeper with its text. Rows are independent:
    repeated rows give repeated results, an empty table none. Other columns of ``df`` are not read.

    The text is cut at its matches by one pattern; only the matches are looked at again, and texts without a
    digit or such a sign pass by.
    """
    p = Pseudonyms(key)
    exact = {k: f"^(?:{v})$" for k, v in PATTERNS.items()}
    make = {k: getattr(p, k) for k in PATTERNS}

    def judge(found: Column) -> Column:
        """struct<kind, new>: the first kind that the match has the form of and whose check it passes."""
        tried = [
            F.when(found.rlike(exact[k]), F.struct(F.lit(k).alias("kind"), make[k](found).alias("new"))) for k in PATTERNS
        ]
        tried = [let(t, lambda x: F.when(x.new.isNotNull(), x)) for t in tried]
        return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), found.alias("new")))

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    text = F.col("_t")
    some = text.rlike("[0-9@=:]")  # what every pattern has
    found = F.when(some, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1))
    rows = rows.withColumn("_m", F.when(F.size(found) > 0, F.transform(found, judge)))
    between = F.split(text, ANY, -1)
    joined = F.concat(
        F.array_join(
            F.transform(F.col("_m"), lambda m, i: F.concat(F.get(F.col("_b"), i), m.new)), ""
        ),
        F.get(F.col("_b"), F.size("_m")),
    )
    rows = rows.withColumn("_b", F.when(F.col("_m").isNotNull(), between))
    kinds = F.transform(F.col("_m"), lambda m: m.kind)
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))) for k in PATTERNS]
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_m").isNull(), text).otherwise(joined).alias("text"),
        *[F.coalesce(F.greatest(c, F.lit(0)), F.lit(0)).cast("long").alias(f"n_{k}") for k, c in zip(PATTERNS, counts, strict=True)],
    )
