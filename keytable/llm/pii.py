"""Personal data: format-preserving Feistel pseudonyms.

Card numbers (Luhn), bank accounts (IBAN, modulo 97), IPv4 addresses, social security and
telephone numbers, calendar dates and mail addresses are validated and then permuted,
under a key, within the values of their own format: a card number becomes another one
that passes the Luhn check, a date another date, with the separators it had. The
permutation is a Feistel network of ``ROUNDS`` rounds whose halves are added modulo the
sizes of the two parts, so it is a bijection: equal values have equal pseudonyms in all
documents, different ones different, and whoever holds the key can invert it. Text
(mail addresses, account numbers with letters) is permuted letter by letter and digit by
digit; a mail address is put under the reserved domain ``invalid``, since its pseudonym
could be someone's.

Only DataFrame functions and no shuffle: each text is split at the matches of one
pattern and put together again. The pattern is linear in the text: its runs are
possessive and start only where no like character stands before.

Null texts stay null, texts without personal data stay as they are, repeated rows are
treated alike, other columns are carried through. Numbers in an address that are
written with leading zeros keep their width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "date", "ip", "phone", "ssn", "iban", "card")
# The formats. A match stands alone among letters and digits.
EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
DATE = "(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\1[0-9]{4})(?!(?!T[0-9])[0-9A-Za-z/-])"
_PLAIN_DATE = DATE.replace("([./])[0-9]{2}\\1", "[./][0-9]{2}[./]")  # a group less, to stand in another pattern
IP = "(?<![0-9A-Za-z.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\\.[0-9])"
NATIONAL = "(?<![0-9A-Za-z])(?:\\+?1[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
ABROAD = "(?<![0-9A-Za-z+])\\+[1-9][0-9]{0,14}(?:[ .-]?\\([0-9]{1,4}\\)[ .-]?[0-9]{1,8})?(?:[ .-][0-9]{2,8}){0,5}(?![0-9A-Za-z])"
PHONE = f"{NATIONAL}|{ABROAD}"
SSN = "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
# a whole run of digit groups up to other data; the cards in it are found by ``cut_sql``
RUN = f"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:(?![ -](?:{'|'.join((EMAIL, _PLAIN_DATE, IP, NATIONAL, SSN))}))[ -][0-9]++(?![A-Za-z]))*+"
ANY = "|".join((EMAIL, DATE, IP, PHONE, SSN, IBAN, RUN))
GATE = "@|[0-9][ .-]?[0-9]"
_SHAPES = (("email", "@"), ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), ("ip", "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"), ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("phone", f"^(?:{PHONE})$"), ("iban", "^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,40}$"), ("card", "^[0-9](?:[ -]?[0-9]){12,18}$"))
PRINTED = "^([0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}([ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: A mail address ends with a name of letters.
_MAIL = "^.+\\.[A-Za-z]{2,}(?![A-Za-z0-9])"
#: Days permuted together: 270 * 270 of them, from 1900-01-01 on, before, and after.
_DAYS = 270
# Country calling codes of one and of two digits; all others have three.
_CODES_1, _CODES_2 = "1 7", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def _quote(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def kind_sql(value: str) -> str:
    """The kind of a match if it is valid, else null."""
    digits, plain = f"regexp_replace({value}, '[^0-9]', '')", f"replace({value}, ' ', '')"
    valid = {
        "email": f"{value} rlike '{_quote(_MAIL)}$'",
        "date": f"{day_sql(value)} is not null",
        "ip": f"forall(split({value}, '[.]'), o -> cast(o as int) < 256)",
        "ssn": f"not ({value} rlike '^(000|666|9)|-00-|-0000$')",
        "phone": f"({digits} rlike '^1?[0-9]{{10}}$' or {value} like '+%' and length({digits}) between 8 and 15)",
        "iban": f"(length({plain}) between 15 and 34 and {mod97_sql(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1)",
        "card": luhn_sql(digits) + " = 0",
    }
    cases = " ".join(f"when {value} rlike '{_quote(shape)}' then if({valid[kind]}, '{kind}', null)" for kind, shape in _SHAPES)
    return f"(case {cases} end)"


def luhn_sql(digits: str) -> str:
    """The Luhn sum of a digit string, modulo 10."""
    return f"(aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> if(i % 2 = 1, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (s, d) -> s + d) % 10)"


def mod97_sql(text: str) -> str:
    """A string of digits and capitals (A is 10, Z is 35) as a number modulo 97."""
    code = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (s, c) -> (s * if(c rlike '[0-9]', 10, 100) + {code}) % 97)"


def cut_sql(match: str) -> str:
    """A match in pieces. A mail address ends with a name of letters; what the match holds
    beyond it is a piece of its own. A run of digit groups that is no card as a whole is cut into the
    cards that it holds (13 to 19 digits that pass the Luhn check, from the start of a
    group to the end of one; the leftmost first, then the longest; one grouped as cards are
    printed goes before others) and the groups and separators between."""
    text = "array_join(slice(toks, i, j - i + 1), '')"
    valid = lambda v: f"(length(regexp_replace({v}, '[^0-9]', '')) between 13 and 19 and {luhn_sql(f"regexp_replace({v}, '[^0-9]', '')")} = 0)"
    ends = f"transform(sequence(1, size(toks)), i -> if(i % 2 = 0, array(), filter(sequence(i, least(size(toks), i + 36), 2), j -> {valid(text)})))"
    # a card as it is printed goes before others that would take some of its groups
    first = f"transform(ends, (js, x) -> transform(array(x + 1), i -> coalesce(array_max(filter(js, j -> {text} rlike '{PRINTED}')), 0))[0])"
    other = "transform(ends, (js, x) -> coalesce(array_max(filter(js, j -> j = x + 1 or not exists(sequence(x + 3, j, 2), k -> first[k - 1] > 0))), 0))"
    picks = "aggregate(sequence(1, size(toks), 2), named_struct('upto', 0, 'picks', array(named_struct('i', 0, 'j', 0))), (s, i) -> if(i > s.upto and last[i - 1] > 0, named_struct('upto', last[i - 1], 'picks', array_append(s.picks, named_struct('i', i, 'j', last[i - 1]))), s), s -> array_append(s.picks, named_struct('i', size(toks) + 1, 'j', 0)))"
    between = "slice(toks, cards[x - 1].j + 1, cards[x].i - cards[x - 1].j - 1)"
    card = "if(cards[x].j > 0, array(array_join(slice(toks, cards[x].i, cards[x].j - cards[x].i + 1), '')), filter(toks, y -> false))"
    chosen = f"transform(array({ends}), ends -> transform(array({first}), first -> zip_with(first, {other}, (f, o) -> if(f > 0, f, o)))[0])"
    pieces = f"transform({chosen}, last -> transform(array({picks}), cards -> flatten(transform(sequence(1, size(cards) - 1), x -> concat({between}, {card}))))[0])[0]"
    cut = f"transform(array(regexp_extract_all({match}, '[ -]|[0-9]+', 0)), toks -> {pieces})[0]"
    mail = f"transform(array(regexp_extract({match}, '{_quote(_MAIL)}', 0)), x -> if(x = '', array({match}), filter(array(x, substr({match}, length(x) + 1)), y -> y <> '')))[0]"
    return f"case when contains({match}, '@') then {mail} when not {match} rlike '[^0-9 -]' and length({match}) > 12 and {kind_sql(match)} is null then {cut} else array({match}) end"


def format_sql(value: str) -> str:
    """How a date is written: year first, day first with dots, or with slashes month
    first where that is a date, else day first."""
    return f"(case when {value} like '____-%' then 'yyyy-MM-dd' when {value} like '__.%' then 'dd.MM.yyyy' when try_to_date({value}, 'MM/dd/yyyy') is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end)"


def day_sql(value: str) -> str:
    """The date, or null if there is no such day."""
    slashes = f"coalesce(try_to_date({value}, 'MM/dd/yyyy'), try_to_date({value}, 'dd/MM/yyyy'))"
    return f"(case when {value} like '____-%' then try_to_date({value}, 'yyyy-MM-dd') when {value} like '__.%' then try_to_date({value}, 'dd.MM.yyyy') else {slashes} end)"


def feistel_sql(left: str, right: str, left_size: str, right_size: str, key: str, invert: bool = False) -> str:
    """A struct (l, r): two numbers below the given sizes, permuted together. In each
    round one part, in turn, moves by a keyed hash of the other."""
    sign, order = ("-", f"sequence({ROUNDS}, 1, -1)") if invert else ("+", f"sequence(1, {ROUNDS})")
    hashed = lambda part: f"conv(substr(md5(concat('{_quote(key)}', ':', n, ':', {part})), 1, 14), 16, 10)::bigint"
    return (
        f"aggregate({order}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, n) -> if(n % 2 = 1,"
        f" named_struct('l', pmod(s.l {sign} {hashed('s.r')} % ({left_size}), {left_size}), 'r', s.r),"
        f" named_struct('l', s.l, 'r', pmod(s.r {sign} {hashed('s.l')} % ({right_size}), {right_size}))))"
    )


def _digits_sql(digits: str, key: str, invert: bool) -> str:
    """A string of 2 to 19 digits permuted among those of its length."""
    a, b = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
    net = feistel_sql(f"substr({digits}, 1, {a})", f"substr({digits}, {a} + 1)", f"cast(pow(10, {a}) as bigint)", f"cast(pow(10, {b}) as bigint)", key, invert)
    return f"transform(array({net}), x -> concat(lpad(cast(x.l as string), cast({a} as int), '0'), lpad(cast(x.r as string), cast({b} as int), '0')))[0]"


def text_sql(text: str, key: str, invert: bool = False) -> str:
    """A text with its letters permuted among letters (of their case) and its digits among
    digits. In each round the letters of one half, in turn, move by a keyed hash of the
    other half; other characters stay."""
    sign, order = ("-", f"sequence({ROUNDS}, 1, -1)") if invert else ("+", f"sequence(1, {ROUNDS})")
    classes = (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10))
    step = "cast(conv(substr(h, 1 + 2 * (i % 64), 2), 16, 10) as int)"
    cases = " ".join(f"when c between '{a}' and '{z}' then char({ord(a)} + pmod(ascii(c) - {ord(a)} {sign} {step}, {n}))" for a, z, n in classes)
    moved = lambda part, other: f"transform(array(sha2(concat('{_quote(key)}', ':', n, ':', array_join({other}, '')), 512)), h -> transform({part}, (c, i) -> case {cases} else c end))[0]"
    net = (
        f"aggregate({order}, transform(array(filter(split({text}, ''), c -> c <> '')), cs -> named_struct('l', slice(cs, 1, size(cs) div 2), 'r', slice(cs, size(cs) div 2 + 1, size(cs))))[0], (s, n) -> if(n % 2 = 1,"
        f" named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')})))"
    )
    return f"transform(array({net}), x -> concat(array_join(x.l, ''), array_join(x.r, '')))[0]"


def _spread_sql(shape: str, digits: str) -> str:
    """The digits put into the digit places of ``shape``, last to last."""
    return (
        f"aggregate(filter(split(reverse({shape}), ''), c -> c <> ''), named_struct('out', '', 'left', {digits}), (s, c) -> if(c rlike '[0-9]',"
        " named_struct('out', concat(right(s.left, 1), s.out), 'left', substr(s.left, 1, length(s.left) - 1)), named_struct('out', concat(c, s.out), 'left', s.left)), s -> s.out)"
    )


def pseudonym_sql(value: str, kind: str, key: str, invert: bool = False) -> str:
    """The pseudonym of a valid value of a kind (or, inverted, the value again)."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "email":
        return text_sql(f"regexp_replace(lower({value}), '\\\\.invalid$', '')", f"{key}:email", True) if invert else f"concat({text_sql(f'lower({value})', f'{key}:email')}, '.invalid')"
    if kind == "date":
        day = f"datediff({day_sql(value)}, date'1900-01-01')"
        block, within = f"floor({day} / {_DAYS * _DAYS})", f"pmod({day}, {_DAYS * _DAYS})"
        net = feistel_sql(f"{within} div {_DAYS}", f"{within} % {_DAYS}", str(_DAYS), str(_DAYS), f"{key}:date", invert)
        return f"transform(array({net}), x -> date_format(date_add(date'1900-01-01', cast({block} * {_DAYS * _DAYS} + x.l * {_DAYS} + x.r as int)), {format_sql(value)}))[0]"
    if kind == "ip":
        o = f"split({value}, '[.]')"
        net = feistel_sql(f"cast({o}[0] as int) * 256 + cast({o}[1] as int)", f"cast({o}[2] as int) * 256 + cast({o}[3] as int)", "65536", "65536", f"{key}:ip", invert)
        wide = lambda number, i: f"lpad(cast({number} as string), greatest(length(cast({number} as string)), if({o}[{i}] like '0_%', length({o}[{i}]), 1)), '0')"
        return f"transform(array({net}), x -> concat_ws('.', {wide('x.l div 256', 0)}, {wide('x.l % 256', 1)}, {wide('x.r div 256', 2)}, {wide('x.r % 256', 3)}))[0]"
    if kind == "iban":  # the country stays, letters and digits move, the check digits follow
        plain = f"replace({value}, ' ', '')"
        check = f"98 - {mod97_sql(f"concat(b, substr({plain}, 1, 2), '00')")}"
        moved = f"transform(array({text_sql(f'substr({plain}, 5)', f'{key}:iban', invert)}), b -> concat(substr({plain}, 1, 2), lpad(cast({check} as string), 2, '0'), b))[0]"
        # blanks stand after every fourth character, as they did
        return f"transform(array({moved}), w -> if(contains({value}, ' '), trim(regexp_replace(w, '(.{{4}})', '$1 ')), w))[0]"
    if kind == "card":  # the check digit follows from the others
        body = _digits_sql(f"substr({digits}, 1, length({digits}) - 1)", f"{key}:card", invert)
        full = f"transform(array({body}), b -> concat(b, cast(pmod(10 - {luhn_sql("concat(b, '0')")}, 10) as string)))[0]"
        return _spread_sql(value, full)
    if kind == "ssn":  # among the valid numbers: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999
        area, group, serial = (f"cast(substr({digits}, {a}, {n}) as int)" for a, n in ((1, 3), (4, 2), (6, 4)))
        net = feistel_sql(f"({area} - if({area} < 666, 1, 2)) * 99 + {group} - 1", f"{serial} - 1", str(898 * 99), "9999", f"{key}:ssn", invert)
        back = "x.l div 99 + if(x.l div 99 < 665, 1, 2)"
        return f"transform(array({net}), x -> concat(lpad(cast({back} as string), 3, '0'), '-', lpad(cast(x.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(x.r + 1 as string), 4, '0')))[0]"
    # phone: the country code stays
    listed = lambda codes: ", ".join(f"'{c}'" for c in codes.split())
    code = f"if({value} like '+%', case when substr({digits}, 1, 1) in ({listed(_CODES_1)}) then 1 when substr({digits}, 1, 2) in ({listed(_CODES_2)}) then 2 else 3 end, length({digits}) - 10)"
    rest = f"substr({digits}, 1 + {code})"
    return _spread_sql(value, f"concat(substr({digits}, 1, {code}), {_digits_sql(rest, f'{key}:phone', invert)})")


def _replaced(match: str, key: str, invert: bool) -> str:
    cases = " ".join(f"when '{kind}' then {pseudonym_sql(match, kind, key, invert)}" for kind in KINDS)
    return f"coalesce(case {kind_sql(match)} {cases} end, {match})"


def pseudonymize(docs: DataFrame, *, key: str) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced under the secret ``key``, and
    columns n_<kind> in place of any of these names."""
    docs = docs.drop(*[f"n_{kind}" for kind in KINDS])
    gate = F.col("text").rlike(GATE) & F.col("text").rlike(ANY)
    found = docs.withColumn("__found", F.when(gate, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    found = found.withColumn("__between", F.when(F.col("__found").isNotNull(), F.split("text", ANY, -1)))
    found = found.withColumn("__cut", F.expr(f"transform(__found, f -> {cut_sql('f')})"))
    found = found.withColumn("__kinds", F.expr(f"transform(flatten(__cut), m -> {kind_sql('m')})"))
    found = found.withColumn("__names", F.expr(f"transform(__cut, p -> array_join(transform(p, m -> {_replaced('m', key, False)}), ''))"))
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(F.expr("array_join(zip_with(__between, __names, (b, n) -> concat(b, coalesce(n, ''))), '')"))
    counts = [F.coalesce(F.size(F.filter("__kinds", _is(kind))), F.lit(0)).alias(f"n_{kind}") for kind in KINDS]
    return found.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], *counts)


def _is(kind: str):
    return lambda k: F.coalesce(k == kind, F.lit(False))


def count_all() -> Column:
    return sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).cast("long")
