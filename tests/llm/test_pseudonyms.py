"""Pseudonyms against a plain twin that reads the same patterns, and on long and odd texts."""

import datetime
import hashlib
import random
from calendar import monthrange

import pytest
import regex

from breathmark.llm import pii

KEY = "twin"
DOCS = "doc_id long, text string"


def drawn(*parts):
    return hashlib.sha512("|".join([KEY, *map(str, parts)]).encode()).hexdigest()


def number(n, wheels, tweak):
    x, y = divmod(n, wheels[1])
    for i in range(pii.ROUNDS):
        turn = lambda v, size, i=i: int(drawn(tweak, i, v)[:14], 16) % size
        if i % 2 == 0:
            x = (x + turn(y, wheels[0])) % wheels[0]
        else:
            y = (y + turn(x, wheels[1])) % wheels[1]
    return x * wheels[1] + y


def string(s, tweak):
    hexadecimal = regex.fullmatch("[0-9a-f]{16,}|[0-9A-F]{16,}", s)
    x, y = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(pii.ROUNDS):
        first, out = drawn(tweak, i, len(x), y.lower()), []
        for k, c in enumerate(x):
            block, at = divmod(k, pii.TURNED)
            stream = hashlib.sha512(f"{first}|{block}".encode()).hexdigest() if block else first
            by = int(stream[3 * at : 3 * at + 3], 16)
            kinds = [(48, 10), (97, 6 if hexadecimal else 26), (65, 6 if hexadecimal else 26), (224, 23), (192, 23)]
            own = [(a, n) for a, n in kinds if a <= ord(c) < a + (26 if a in (97, 65) else n)]
            out.append(chr((ord(c) - own[0][0] + by) % own[0][1] + own[0][0]) if own else c)
        x, y = y, "".join(out)
    return x + y


def into(form, new, kind):
    new = iter(new)
    return "".join(next(new) if regex.match(kind, c) else c for c in form)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day_of(s, form):
    try:
        return datetime.datetime.strptime(s, form).date()
    except ValueError:
        return None


def replaced(kind, s):
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "email":
        return string(s[: s.index("@")], "email") + s[s.index("@") :]
    if kind == "secret":
        value = regex.search("[A-Za-z0-9_-]+$", s)[0]
        return s[: -len(value)] + string(value, "secret")
    if kind == "iban":
        groups = s.split(" ")
        for n in range(len(groups), min(len(groups), 4) - 1, -1):
            form = " ".join(groups[:n])
            whole = form.replace(" ", "")
            if 15 <= len(whole) <= 34 and mod97(whole[4:] + whole[:4]) == 1:
                new = string(whole[4:], "iban")
                return into(form, f"{whole[:2]}{98 - mod97(new + whole[:2] + '00'):02}{new}", "[A-Z0-9]") + s[len(form) :]
        return None
    if kind == "ip":
        parts = list(map(int, s.split(".")))
        if max(parts) > 255:
            return None
        new = number(int.from_bytes(bytes(parts)), (1 << 16, 1 << 16), "ip")
        return ".".join(map(str, new.to_bytes(4)))
    if kind == "date":
        forms = ["%Y-%m-%d"] if "-" in s else ["%d.%m.%Y"] if "." in s else ["%m/%d/%Y", "%d/%m/%Y"]
        for form in forms:
            if (day := day_of(s, form)) and 0 <= (n := (day - datetime.date(1900, 1, 1)).days) < 17 * 4297:
                return (datetime.date(1900, 1, 1) + datetime.timedelta(number(n, (17, 4297), "date"))).strftime(form)
        return None
    if kind == "ssn":
        a, b, c = map(int, s.split("-"))
        if not (0 < a < 900 and a != 666 and b and c):
            return None
        new = number(((a - (2 if a > 666 else 1)) * 99 + b - 1) * 9999 + c - 1, (898, 99 * 9999), "ssn")
        a = new // (99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03}-{new // 9999 % 99 + 1:02}-{new % 9999 + 1:04}"
    if kind == "phone":
        return into(s, digits[:-7] + string(digits[-7:], "phone"), "[0-9]") if 9 <= len(digits) <= 15 else None
    if not regex.match(pii.ISSUED, digits) or luhn(digits) % 10:
        return None
    body = digits[:6] + string(digits[6:-1], "card")
    return into(s, body + str(-luhn(body + "0") % 10), "[0-9]")


def plain(text):
    counts = dict.fromkeys(pii.PATTERNS, 0)

    def new(found):
        for kind, pattern in pii.PATTERNS.items():
            if regex.fullmatch(pattern, found[0]) and (made := replaced(kind, found[0])) is not None:
                counts[kind] += 1
                return made
        return found[0]

    return (None if text is None else regex.sub(pii.ANY, new, text)), counts


def checked(body, check):
    return next(f"{body}{d}" for d in range(10) if check(f"{body}{d}"))


def test_pseudonyms_equal_a_plain_twin(spark):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban():
        account = rng.choice(["", "NWBK", "BNPA"]) + digits(rng.choice([12, 14, 18]))
        country = rng.choice(["DE", "GB", "FR"])
        whole = f"{country}{98 - mod97(account + country + '00'):02}{account}"
        return whole if rng.random() < 0.3 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def card():
        whole = checked(rng.choice(["4", "51", "2221", "34", "9", "62"]) + digits(rng.choice([11, 13, 14])), lambda x: luhn(x) % 10 == 0)
        return whole if len(whole) != 16 or rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, 16, 4))

    def date():
        y, m = rng.randint(1890, 2110), rng.randint(1, 13)
        d = rng.randint(1, monthrange(y, min(m, 12))[1] + 1)
        return rng.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y}", f"{d:02}/{m:02}/{y}"])

    makers = [
        iban, card, date, lambda: ".".join(str(rng.randint(0, 280)) for _ in range(4)), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: rng.choice([f"({digits(3)}){digits(3)}-{digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+44 {digits(2)} {digits(4)} {digits(4)}"]),
        lambda: f"{rng.choice(['Jo', 'été', 'a.b+c', 'x' * 90])}{digits(2)}@{rng.choice(['a.example.com', 'b-c.org', 'x.y'])}",
        lambda: f"{rng.choice(['token', 'API-Key', 'password'])}{rng.choice(['=', ': ', ' = '])}{rng.choice(['', chr(34)])}{hashlib.sha256(digits(3).encode()).hexdigest()[: rng.choice([8, 16, 40])]}",
        lambda: rng.choice(["version 10.20.30.40", "v1.2.3.4", "NEXT WORD", "word", "7", "12.5", "(a)", "-", "\n"]),
    ]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", " ", "\n", ", ", "; "]) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    texts += ["DE89 3704 0044 0532 0130 00 NEXT WORD", "BE68 5390 0754 7034 NEXT", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    changed = dict.fromkeys(pii.PATTERNS, 0)
    for r in pii.pseudonymise(df, KEY).collect():
        want, counts = plain(texts[r["doc_id"]])
        assert (r["text"], {k: r[f"n_{k}"] for k in pii.PATTERNS}) == (want, counts), texts[r["doc_id"]]
        changed = {k: n + counts[k] for k, n in changed.items()}
    assert min(changed.values()) > 30


@pytest.mark.parametrize("unit", ["a.", "a", "a-", ".", "1", "1 ", "+1 ", "A1", "token=", "DE89 3704 ", "x@", "1.", "é"])
def test_very_long_runs(spark, unit):
    text = "x@" + unit * (1_000_000 // len(unit))
    (row,) = pii.pseudonymise(spark.createDataFrame([(1, text)], DOCS), KEY).collect()
    assert len(row["text"]) == len(text)


def test_long_values_have_no_period(spark):
    text = "a" * 3000 + "@example.com"
    (row,) = pii.pseudonymise(spark.createDataFrame([(1, text)], DOCS), KEY).collect()
    assert row["n_email"] == 1 and len({row["text"][i : i + 6] for i in range(0, 2994, 42)}) > 60


def test_what_is_no_private_value_stays(spark):
    texts = ["version 10.20.30.40", "v10.20.30.40", "id 9177399536541146 and 1683436113538827", "5.5.5", "2024-13-01"]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOCS), KEY).collect()}
    assert [got[i] for i in range(len(texts))] == texts
