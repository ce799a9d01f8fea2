"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass validation are permuted within their format by a keyed Feistel network over the
product of two residue rings (no cycle walking): a card number becomes another card number with a right check
digit, a phone number keeps its layout, a network address stays four octets, a date stays a date. Equal values
get equal pseudonyms under one key in every document, so they stay linked. E-mail names and credentials have no
fixed number format: a credential becomes a keyed digest of its length, an e-mail name one of 12 characters or more.

Kinds and validation:
* card: 13 to 19 digits, single blanks or hyphens allowed between them, Luhn check digit right, not one digit repeated;
  in a longer or failing run of digits, every stretch between separators is tried from the left, the longest first, and
  what is left of the run is searched for the other kinds
* ssn: ddd-dd-dddd, area not 000, 666 or 9dd, group not 00, serial not 0000; the valid numbers are permuted among themselves
* phone: a ten-digit number with a marked area code, ``(ddd) ddd-dddd`` or ``ddd-ddd-dddd``; a leading +1 is kept
* ip: four octets of at most 255 without leading zeros
* date: yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy, a real day from 1900-01-01 to 2100-01-01
* email: a name, ``@`` and a host with a dot; the name is replaced and the host kept
* secret: a quoted value of 16 characters or more after token, key, secret or password

Defined cases: a null text stays null, an empty text stays empty; text without such values comes back unchanged,
byte for byte. Values that fail validation are left alone. Repeated rows are each rewritten. Extra columns are
kept, whatever their names; the text column is replaced in place. An empty table gives an empty result.

The key is a secret: whoever has it can turn pseudonyms back. It is given by the caller or by the session's setting
``spark.tallygrid.pseudonymKey``; without either, ``pseudonymise`` fails. Only the registered queries, which must run on
any session, fall back to ``SAMPLE_KEY``, which protects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import free_name

ROUNDS = 10
KEY_SETTING = "spark.tallygrid.pseudonymKey"
SAMPLE_KEY = "known to all: for sample data only"

# Digits, and letters of any alphabet, on either side would make a value part of something longer.
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PATTERNS = {
    "secret": r"(?i:\b(?:token|key|secret|password))\s*[=:]\s*\"[A-Za-z0-9_+/=-]{16,}\"",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?:(?<![\p{L}\p{N}_+])\+1[ -]?)?(?<![\p{L}\p{N}_(])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}" + _END,
    "date": _EDGE + r"(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    # a whole run of digit groups, without a group that begins an address or a date; possessive, so that long runs don't recurse
    "card": r"(?<![\p{L}\p{N}_.+-])(?=(?:\d[ -]?){12}\d)\d++" + _END + r"(?:[ -](?!(?:\d{1,3}\.){3}\d|\d\d[./]\d\d[./]\d{4}"
            r"|[A-Za-z0-9._%+-]{1,64}@)\d++" + _END + ")*+",
    "ip": r"(?<![\p{L}\p{N}_.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}_]|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
IN_RUNS = "|".join(f"(?:{PATTERNS[k]})" for k in ("phone", "date", "ssn"))
LONGEST_CARD = 19
SSN_AREAS = 898  # 001 to 899 without 666
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1900-01-01", 150, 487  # 150 * 487 days


def _digest(key: str, *parts: Column) -> Column:
    """Nested keyed SHA-256, as hex."""
    message = F.concat_ws("|", F.lit(key), *parts)
    return F.sha2(F.concat_ws("|", F.lit(key), F.sha2(message, 256)), 256)


def _round(key: str, kind: str, sizes: Column, turn: Column, half: Column) -> Column:
    digest = _digest(key, F.lit(kind), sizes, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of pairs (left < a, right < b); struct of l and r."""
    sizes = F.concat_ws("x", a.cast("string"), b.cast("string"))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(state: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        other = F.when(even, state["r"]).otherwise(state["l"])
        shift = _round(key, kind, sizes, turn, other)
        return F.struct(
            F.when(even, F.pmod(state["l"] + F.pmod(shift, a), a)).otherwise(state["l"]).cast("long").alias("l"),
            F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(shift, b), b)).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many digits (2 to 36)."""
    def use(d: Column) -> Column:
        n = F.length(d)
        cut = (n / 2).cast("int")
        a, b = F.pow(F.lit(10.0), cut).cast("long"), F.pow(F.lit(10.0), n - cut).cast("long")
        halves = feistel(key, kind, d.substr(F.lit(1), cut).cast("long"), d.substr(cut + 1, n - cut).cast("long"), a, b)
        return _with(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), cut, "0"),
                                                F.lpad(h["r"].cast("string"), n - cut, "0")))
    return _with(digits, use)


def luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """Luhn sum; the digit ``doubled_from_end`` places before the last, and every second one before it, is doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == doubled_from_end % 2, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def layout(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced in turn by those of ``digits``."""
    def put(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, digits.substr(state["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(is_digit, state["at"] + 1).otherwise(state["at"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(shape, ""), start, put)["out"]


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_card(m: Column) -> Column:
    return _with(_only_digits(m), lambda d: F.length(d).between(13, LONGEST_CARD) & (luhn_sum(d, 1) % 10 == 0)
                 & ~d.rlike(r"^(\d)\1*$"))


def _card(key: str, m: Column) -> Column:
    def use(d: Column) -> Column:
        def finish(body: Column) -> Column:
            check = F.pmod(F.lit(10) - luhn_sum(body, 0) % 10, F.lit(10))
            return layout(m, F.concat(body, check.cast("string")))
        changed = _with(permuted_digits(key, "card", d.substr(F.lit(1), F.length(d) - 1)), finish)
        return F.when(_is_card(m), changed).otherwise(m)
    return _with(_only_digits(m), use)


def _ssn(key: str, m: Column) -> Column:
    good = ~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$")
    area, group, serial = (F.try_to_number(m.substr(lo, n), F.lit("9" * n)).cast("long") for lo, n in ((1, 3), (5, 2), (8, 4)))
    # valid numbers are ranked, the ranks permuted, and the new rank read as a number
    rank = F.struct((area - F.when(area > 666, 2).otherwise(1)).alias("l"), ((group - 1) * 9999 + serial - 1).alias("r"))

    def use(own: Column) -> Column:
        def show(h: Column) -> Column:
            to = h["l"] + F.when(h["l"] >= 665, 2).otherwise(1)
            return F.concat(F.lpad(to.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(h["r"] / 9999) + 1).cast("string"), 2, "0"),
                            F.lit("-"), F.lpad((h["r"] % 9999 + 1).cast("string"), 4, "0"))
        return _with(feistel(key, "ssn", own["l"], own["r"], F.lit(SSN_AREAS).cast("long"), F.lit(99 * 9999).cast("long")), show)
    return F.when(good, _with(rank, use)).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    country = F.regexp_extract(m, r"^(\+1[ -]?)?", 1)
    rest = m.substr(F.length(country) + 1, F.length(m))
    return F.concat(country, layout(rest, permuted_digits(key, "phone", _only_digits(rest))))


def _ip(key: str, m: Column) -> Column:
    def use(o: Column) -> Column:
        octets = [o[i].cast("int") for i in range(4)]
        good = ~m.rlike(r"(?:^|\.)0\d")
        for octet in octets:
            good &= octet <= 255
        size = F.lit(65536).cast("long")
        pair = feistel(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], size, size)
        text = _with(pair, lambda h: F.concat_ws(".", *[x.cast("string") for x in (
            F.shiftright(h["l"], 8), h["l"] % 256, F.shiftright(h["r"], 8), h["r"] % 256)]))
        return F.when(good, text).otherwise(m)
    return _with(F.split(m, r"\."), use)


def _date(key: str, m: Column) -> Column:
    shape = (F.when(m.substr(5, 1) == "-", F.lit("yyyy-MM-dd")).when(m.substr(3, 1) == ".", F.lit("dd.MM.yyyy"))
             .otherwise(F.lit("MM/dd/yyyy")))
    iso = (F.when(shape == "yyyy-MM-dd", m)
           .when(shape == "dd.MM.yyyy", F.concat(m.substr(7, 4), F.lit("-"), m.substr(4, 2), F.lit("-"), m.substr(1, 2)))
           .otherwise(F.concat(m.substr(7, 4), F.lit("-"), m.substr(1, 2), F.lit("-"), m.substr(4, 2))))

    def use(day: Column) -> Column:
        good = day.isNotNull() & day.between(0, DAY_ROWS * DAY_COLUMNS - 1)
        pair = feistel(key, "date", F.floor(day / DAY_COLUMNS), day % DAY_COLUMNS,
                       F.lit(DAY_ROWS).cast("long"), F.lit(DAY_COLUMNS).cast("long"))

        def show(h: Column) -> Column:
            to = F.date_add(F.to_date(F.lit(FIRST_DAY)), (h["l"] * DAY_COLUMNS + h["r"]).cast("int"))
            return (F.when(shape == "yyyy-MM-dd", F.date_format(to, "yyyy-MM-dd"))
                    .when(shape == "dd.MM.yyyy", F.date_format(to, "dd.MM.yyyy")).otherwise(F.date_format(to, "MM/dd/yyyy")))
        return F.when(good, _with(pair, show)).otherwise(m)
    return _with(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.to_date(F.lit(FIRST_DAY))), use)


def _keyed_text(key: str, kind: str, value: Column, size: Column) -> Column:
    """``size`` lower-case hex characters of a keyed digest of ``value``."""
    blocks = F.transform(F.sequence(F.lit(0), ((size - 1) / 64).cast("int")),
                         lambda i: _digest(key, F.lit(kind), i.cast("string"), value))
    return F.array_join(blocks, "").substr(F.lit(1), size)


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    name = m.substr(F.lit(1), at - 1)
    return F.concat(F.lit("u"), _keyed_text(key, "email", F.lower(m), F.greatest(F.length(name) - 1, F.lit(11))),
                    m.substr(at, F.length(m)))


def _secret(key: str, m: Column) -> Column:
    first = F.instr(m, '"')
    value = m.substr(first + 1, F.length(m) - first - 1)
    return F.concat(m.substr(F.lit(1), first), _keyed_text(key, "secret", value, F.length(value)), F.lit('"'))


def kind_of(m: Column) -> Column:
    """Kind of a match of ``ANY``: the first pattern, in their order, that the match has the shape of."""
    return (F.when(m.endswith('"'), "secret").when(m.contains("@"), "email")
            .when(m.rlike(r"^(?:\+1[ -]?)?(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}$"), "phone")
            .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), "date")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").otherwise("card"))


def pseudonym(key: str, m: Column) -> Column:
    """What stands for one match; the match itself if it fails validation."""
    kind = kind_of(m)
    return (F.when(kind == "secret", _secret(key, m)).when(kind == "email", _email(key, m))
            .when(kind == "phone", _phone(key, m)).when(kind == "date", _date(key, m)).when(kind == "ssn", _ssn(key, m))
            .when(kind == "ip", _ip(key, m)).otherwise(_card(key, m)))


def _piece(key: str, m: Column) -> Column:
    return F.struct(kind_of(m).alias("kind"), m.alias("value"), pseudonym(key, m).alias("pseudonym"))


def _plain(text: Column) -> Column:
    return F.struct(F.lit("card").alias("kind"), text.alias("value"), text.alias("pseudonym"))


def _run_pieces(key: str, m: Column) -> Column:
    """Pieces of a run of digit groups: the cards in it, from the left and the longest first, and the rest."""
    def rest_pieces(rest: Column) -> Column:
        found = F.zip_with(F.split(rest, IN_RUNS, -1), F.regexp_extract_all(rest, F.lit(IN_RUNS), F.lit(0)),
                           lambda p, f: F.when(f.isNull(), F.array(_plain(p))).otherwise(F.array(_plain(p), _piece(key, f))))
        return F.when(rest.rlike(IN_RUNS), F.flatten(found)).otherwise(F.array(_plain(rest)))

    def use(groups: Column) -> Column:
        def joined(first: Column, n: Column) -> Column:
            return F.array_join(F.slice(groups, first, n), "")

        def longest(i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_CARD), F.size(groups) - i + 1))
            return F.array_max(F.filter(lengths, lambda n: _is_card(joined(i, n))))

        def pick(state: Column, i: Column) -> Column:
            return _with(F.when(i >= state["next"], longest(i)), lambda n: F.when(n.isNotNull(), F.struct(
                (i + n).alias("next"), F.concat(state["cards"], F.array(F.struct(i.alias("first"), n.alias("n")))).alias("cards")))
                .otherwise(state))

        none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<first:int,n:int>>").alias("cards"))

        def cut(cards: Column) -> Column:
            def part(j: Column) -> Column:
                begin = F.when(j == 0, F.lit(1)).otherwise(F.get(cards, j - 1)["first"] + F.get(cards, j - 1)["n"])
                end = F.coalesce(F.get(cards, j)["first"], F.size(groups) + 1)
                rest = _with(joined(begin, end - begin), rest_pieces)
                card = _with(joined(end, F.get(cards, j)["n"]), lambda c: F.array(
                    _piece(key, F.regexp_replace(c, "[ -]$", "")), _plain(F.regexp_extract(c, "[ -]?$", 0))))
                return F.when(j < F.size(cards), F.concat(rest, card)).otherwise(rest)
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cards)), part))
        return _with(F.aggregate(F.sequence(F.lit(1), F.size(groups)), none, pick)["cards"], cut)
    return _with(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), use)


def pieces(key: str, m: Column) -> Column:
    """Structs of kind, value and pseudonym whose values make up the match; what stays is its own pseudonym."""
    return F.when((kind_of(m) == "card") & ~_is_card(m), _run_pieces(key, m)).otherwise(F.array(_piece(key, m)))


def session_key(spark: SparkSession) -> str | None:
    return spark.conf.get(KEY_SETTING, None) or None


def pseudonymise(docs: DataFrame, text_column: str = "text", key: str | None = None, found: str | None = None) -> DataFrame:
    """Rewrite ``text_column``; ``found`` names an added column with structs of kind, value and pseudonym of what was replaced.

    No shuffle: every row is rewritten where it is read. Texts are matched once, and only rows with a match are rebuilt.
    """
    key = key or session_key(docs.sparkSession)
    if not key:
        raise ValueError(f"give a secret key, or set {KEY_SETTING}")
    if found and found in docs.columns:
        raise ValueError(f"docs has a column {found}; name the added column otherwise")
    matched, made = free_name(docs.columns, "_found"), free_name(docs.columns, "_new")
    text = F.col(f"`{text_column}`")
    matches = F.when(text.rlike("[0-9@\"]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    new = F.transform(F.col(f"`{matched}`"), lambda m: pieces(key, m))
    parts = F.split(text, ANY, -1)
    ends = F.concat(F.transform(F.col(f"`{made}`"), lambda v: F.array_join(F.transform(v, lambda x: x["pseudonym"]), "")), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(parts, ends, lambda p, e: F.concat(p, e)), "")
    held = docs.withColumn(matched, matches).withColumn(made, F.when(F.size(F.col(f"`{matched}`")) > 0, new))
    rows = [F.when(F.col(f"`{made}`").isNull(), text).otherwise(rebuilt).alias(c) if c == text_column else F.col(f"`{c}`")
            for c in docs.columns]
    if found:
        changed = F.filter(F.flatten(F.col(f"`{made}`")), lambda v: v["value"] != v["pseudonym"])
        rows.append(F.coalesce(changed, F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")).alias(found))
    return held.select(*rows)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document: its rewritten text's digest and length, and how many values of each kind were replaced."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(docs, key=session_key(spark) or SAMPLE_KEY, found="_replaced")

    def count(kind: str) -> Column:
        return F.size(F.filter("_replaced", lambda v: v["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("_replaced").cast("long").alias("n_replaced"),
                       *[count(k) for k in PATTERNS], F.col("_replaced.pseudonym").alias("pseudonyms"))
