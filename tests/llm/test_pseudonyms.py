import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import pseudonyms as p

KEY = "a key for tests"


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def rewrite(spark, texts, **kw):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return [r["text"] for r in sorted(p.pseudonymise(frame, **{"key": KEY} | kw).collect(), key=lambda r: r["doc_id"])]


def test_feistel_is_a_permutation(spark):
    a, b = 7, 11
    pairs = spark.range(a * b).select((F.col("id") % a).alias("l"), F.floor(F.col("id") / a).alias("r"))
    out = pairs.select(p.feistel("k", "test", F.col("l"), F.col("r"), F.lit(a).cast("long"), F.lit(b).cast("long")).alias("x"))
    got = {(r["x"]["l"], r["x"]["r"]) for r in out.collect()}
    assert got == {(i, j) for i in range(a) for j in range(b)}
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert numbers.select(p.permuted_digits("k", "test", F.col("d")).alias("x")).distinct().count() == 1000


def test_formats_are_kept(spark):
    shapes = {
        "card 4845168114407329 end": r"card \d{16} end", "4845-1681-1440-7329": r"\d{4}-\d{4}-\d{4}-\d{4}", "4845 1681 1440 7329.": r"(\d{4} ){3}\d{4}\.",
        "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}", "212-555-0199": r"\d{3}-\d{3}-\d{4}", "123-45-6789": r"\d{3}-\d{2}-\d{4}",
        "at 97.51.17.173, ok": r"at \d{1,3}(\.\d{1,3}){3}, ok", "1984-02-29": r"\d{4}-\d\d-\d\d", "31.12.1999": r"\d\d\.\d\d\.\d{4}",
        "12/31/1999": r"\d\d/\d\d/\d{4}", "a.b@mail7.example.com": r"u[0-9a-f]+@mail7\.example\.com",
        'token = "04dbebab91ab85687d33"': r'token = "[0-9a-f]{20}"'}
    for (before, shape), after in zip(shapes.items(), rewrite(spark, list(shapes))):
        assert before != after and re.fullmatch(shape, after), (before, after)
        if "4845" in before:
            assert luhn(after)
        if "97.51" in before:
            assert all(int(x) < 256 for x in re.findall(r"\d+", after))


def test_equal_values_stay_linked_and_keys_differ(spark):
    one, two, spaced = rewrite(spark, ["a 4845168114407329", "b 4845168114407329 c", "4845 1681 1440 7329"])
    assert one[2:] == two[2:-2] == spaced.replace(" ", "")
    assert rewrite(spark, ["a 4845168114407329"], key="other")[0] != one


def test_values_beside_other_digits(spark):
    """Cards beside digits that a longest run takes in, and other kinds that such a run would take in."""
    card = "4845168114407329"
    new = rewrite(spark, [card])[0]
    shapes = {f"{card} 123": f"{new} 123", f"line 7 {card}": f"line 7 {new}", "12 4845 1681 1440 7329": "12 " + " ".join(new[i:i + 4] for i in range(0, 16, 4)),
              f"{card}-2": f"{new}-2", f"{card} 12b": f"{new} 12b", f"{card} 12/27": f"{new} 12/27", f"{card} {card}": f"{new} {new}",
              "1234 4845 1681 1440 7329": "1234 " + " ".join(new[i:i + 4] for i in range(0, 16, 4))}
    assert rewrite(spark, list(shapes)) == list(shapes.values())
    kinds = ["1235 123-45-6789", "12345 1234 12 97.51.17.173", "123 212-555-0199", "12345 1984-02-29", "123456 12345 31.12.1999", "123456 123456 77@x.org"]
    alone = rewrite(spark, [k.split(" ")[-1] for k in kinds])
    assert rewrite(spark, kinds) == [" ".join([*k.split(" ")[:-1], a]) for k, a in zip(kinds, alone)]
    assert all(a != k.split(" ")[-1] for k, a in zip(kinds, alone))
    long = ["1" * 100_000, "11 " * 5_000, "1-" * 20_000 + "x"]
    assert rewrite(spark, long)[0] == long[0] and [len(t) for t in rewrite(spark, long)] == [len(t) for t in long]


def test_all_else_stays(spark):
    texts = [None, "", "plain", "9807915762804490", "0000000000000000", "300.1.1.1 01.2.3.4", "2001-02-30 1850-01-01 13/45/2000", "000-12-1234 666-12-1234",
             "é4845168114407329", "x4845168114407329 48451681144073291234567", "1.2.3.4.5", "user@host", 'token = "short"', "\x00 $1 \\1", "a" * 200_000]
    assert rewrite(spark, texts) == texts


def test_columns_and_report(spark, edge_docs):
    out = p.pseudonymise(edge_docs, key=KEY)
    assert out.columns == edge_docs.columns and out.count() == 12
    assert p.pseudonymise(edge_docs.limit(0), key=KEY).count() == 0
    clash = edge_docs.select("doc_id", "text", F.lit(7).alias("_found"), F.lit("y").alias("_new"), F.lit(2.5).alias("_New_"))
    rows = p.pseudonymise(clash, key=KEY)
    assert rows.dtypes == clash.dtypes and {(r["_found"], r["_new"], r["_New_"]) for r in rows.collect()} == {(7, "y", 2.5)}
    text = spark.createDataFrame([(1, "4845168114407329 x@y.org 9807915762804490"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: [(v["kind"], v["value"]) for v in r["f"]] for r in p.pseudonymise(text, key=KEY, found="f").collect()}
    assert found == {1: [("card", "4845168114407329"), ("email", "x@y.org")], 2: []}


def test_dates_stay_dates(spark):
    days = spark.range(0, 73050, 997).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r["text"] for r in p.pseudonymise(days, key=KEY).collect()]
    assert len(set(out)) == len(out) and all("1900-01-01" <= t <= "2100-01-01" for t in out)


def test_ssn_stay_valid(spark):
    dice = random.Random(2)
    numbers = sorted({f"{dice.choice([a for a in range(1, 900) if a != 666]):03d}-{dice.randint(1, 99):02d}-{dice.randint(1, 9999):04d}" for _ in range(2000)}
                     | {"001-01-0001", "899-99-9999", "665-01-0001", "667-01-0001"})
    out = rewrite(spark, numbers)
    assert all(re.fullmatch(r"(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}", t) for t in out) and len(set(out)) == len(numbers)
    assert out == [plain_value(n) for n in numbers]
    assert sum(a == b for a, b in zip(numbers, out)) < 5


def test_a_key_must_be_given(spark):
    frame = spark.createDataFrame([(1, "123-45-6789")], "doc_id long, text string")
    with pytest.raises(ValueError):
        p.pseudonymise(frame)
    spark.conf.set(p.KEY_SETTING, KEY)
    try:
        assert p.pseudonymise(frame).first()["text"] == rewrite(spark, ["123-45-6789"])[0]
    finally:
        spark.conf.unset(p.KEY_SETTING)


# -- the same by whole numbers and strings, one value at a time

def digest(*parts, key=KEY):
    inner = hashlib.sha256("|".join([key, *parts]).encode()).hexdigest()
    return hashlib.sha256("|".join([key, inner]).encode()).hexdigest()


def plain_feistel(kind, l, r, a, b):
    for turn in range(p.ROUNDS):
        shift = int(digest(kind, f"{a}x{b}", str(turn), str(r if turn % 2 == 0 else l))[:15], 16)
        if turn % 2 == 0:
            l = (l + shift) % a
        else:
            r = (r + shift) % b
    return l, r


def plain_digits(kind, d):
    cut = len(d) // 2
    l, r = plain_feistel(kind, int(d[:cut]), int(d[cut:]), 10 ** cut, 10 ** (len(d) - cut))
    return str(l).zfill(cut) + str(r).zfill(len(d) - cut)


def into(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in shape)


def plain_value(m):
    """Pseudonym of one valid value standing alone."""
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        l, r = plain_feistel("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{l + (2 if l >= 665 else 1):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    if "@" in m:
        name, host = m.split("@")
        text = "".join(digest("email", str(i), m.lower()) for i in range(3))
        return "u" + text[:max(len(name) - 1, 11)] + "@" + host
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m):
        o = list(map(int, m.split(".")))
        l, r = plain_feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return ".".join(map(str, (l >> 8, l & 255, r >> 8, r & 255)))
    for shape in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
        try:
            day = (dt.datetime.strptime(m, shape).date() - dt.date(1900, 1, 1)).days
        except ValueError:
            continue
        l, r = plain_feistel("date", day // 487, day % 487, 150, 487)
        return (dt.date(1900, 1, 1) + dt.timedelta(l * 487 + r)).strftime(shape)
    digits = "".join(c for c in m if c.isdigit())
    if len(digits) < 13:
        country = re.match(r"(\+1[ -]?)?", m).group()
        rest = m[len(country):]
        return country + into(rest, plain_digits("phone", "".join(c for c in rest if c.isdigit())))
    body = plain_digits("card", digits[:-1])
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(body)))
    return into(m, body + str(-total % 10))


def test_agrees_with_brute_force(spark):
    """Values of every kind, alone and inside text, against the permutation written out with whole numbers."""
    dice = random.Random(12)

    def card():
        body = "".join(dice.choice("0123456789") for _ in range(dice.randint(12, 18)))
        total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def number(*sizes):
        return tuple("".join(dice.choice("0123456789") for _ in range(n)) for n in sizes)

    values = [card() for _ in range(40)]
    values += ["%s-%s-%s" % number(3, 3, 4) for _ in range(20)] + ["+1 (%s) %s-%s" % number(3, 3, 4) for _ in range(20)]
    values += [".".join(str(dice.randint(0, 255)) for _ in range(4)) for _ in range(20)]
    values += [(dt.date(1900, 1, 1) + dt.timedelta(dice.randrange(73050))).strftime(s) for s in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y") for _ in range(15)]
    values += [f"{dice.choice(['a', 'Long.name+x'])}{k}@host{k}.example.org" for k in range(10)]
    texts = values + [f"before {a}, and {b}; end" for a, b in zip(values, values[::-1])]
    want = [plain_value(v) for v in values]
    assert rewrite(spark, texts) == want + [f"before {a}, and {b}; end" for a, b in zip(want, want[::-1])]
