"""XPath's conversions, arithmetic and string functions as Catalyst columns. No value is ever NULL: absent text is ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
SPACES = " \t\r\n"
DATE = r"^-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(Z|[+-](0\d|1[0-4]):[0-5]\d)?$"
TIME = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?"
ZONE = r"(Z|[+-](0\d|1[0-4]):[0-5]\d)?"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: as a lambda's argument it isn't copied into each of its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nan() -> Column:
    return F.lit(NAN)


def parse_number(s: Column) -> Column:
    """Blanks around it, a minus sign, digits and a point; anything else (exponents, a plus sign) is NaN."""
    t = F.trim(F.translate(s, "\t\r\n", "   "))
    return F.when(t.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), t.try_cast("double")).otherwise(nan())


def format_number(x: Column) -> Column:
    """Whole numbers below 1e21 without a point; otherwise the shortest digits, never with an exponent."""
    return let(x, _format)


def _format(x: Column) -> Column:
    whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
    raw = x.cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(raw, r"^-?([\d.]+)", 1), r"\.0$", "")
    power = F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    head = F.regexp_extract(digits, r"^(\d+)", 1)
    tail = F.regexp_extract(digits, r"\.(\d+)$", 1)
    up = F.concat(head, F.rpad(tail, F.greatest(power, F.length(tail)), F.lit("0")))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), head, F.when(tail == "0", "").otherwise(tail))
    small = F.when(power.isNull(), F.concat(sign, digits)).when(power < 0, F.concat(sign, down)).otherwise(F.concat(sign, up))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, "0").when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(small)


def number_true(x: Column) -> Column:
    return ~F.isnan(x) & (x != 0)


def compare(op: str, a: Column, b: Column) -> Column:
    """Numbers, with NaN unequal to everything."""
    ok = ~F.isnan(a) & ~F.isnan(b)
    if op == "=":
        return ok & (a == b)
    if op == "!=":
        return ~ok | (a != b)
    return ok & {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def negative(x: Column) -> Column:
    """Also of -0."""
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    bad = F.isnan(a) | F.isnan(b)
    if op == "div":
        zero = F.when(a == 0, nan()).when(negative(a) == negative(b), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(bad, nan()).when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
    endless = F.abs(a) == float("inf")
    return F.when(bad | endless | (b == 0), nan()).when(F.abs(b) == float("inf"), a).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def _whole(fn, x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(fn(F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), 0.0).otherwise(x)).cast("double"))


def floor(x: Column) -> Column:
    return _whole(F.floor, x)


def ceiling(x: Column) -> Column:
    return _whole(F.ceil, x)


def round_(x: Column) -> Column:
    return floor(x + 0.5)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """By code points from 1, with both bounds rounded."""
    first = round_(start)
    stop = F.lit(float("inf")) if length is None else first + round_(length)
    n = F.length(s).cast("double")
    a, b = F.greatest(first, F.lit(1.0)), F.least(stop, n + 1)
    ok = ~F.isnan(first) & ~F.isnan(stop) & (a < b)
    return F.when(ok, F.substr(s, F.when(ok, a).otherwise(1.0).cast("int"), F.when(ok, b - a).otherwise(0.0).cast("int"))).otherwise("")


def substring_before(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when((t != "") & (at > 0), F.substr(s, F.lit(1), at - 1)).otherwise("")


def substring_after(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(t == "", s).when(at > 0, F.substr(s, at + F.length(t))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def translate(s: Column, a: Column, b: Column) -> Column:
    return F.call_function("translate", s, a, b)


def regex(pattern: str, flags: str = "") -> str:
    """For Java, as the reference's dialect has it: Unicode classes, `.` stops at line feeds alone, $ is the very end."""
    if set(flags) - set("imsx"):
        raise ValueError(f"unknown flag in {flags!r}")
    end = "$" if "m" in flags else "\\z"
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2].isdigit():
                raise ValueError("back references are not supported")
            out += pattern[i : i + 2]
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i) and not inside:
            raise ValueError("lookaround is not supported")
        out += end if c == "$" and not inside else c
        i += 1
    return f"(?dU{flags})" + out


CASTABLE = {
    "xs:integer": r"^\s*[+-]?\d+\s*$", "xs:int": r"^\s*[+-]?\d+\s*$", "xs:long": r"^\s*[+-]?\d+\s*$", "xs:short": r"^\s*[+-]?\d+\s*$", "xs:byte": r"^\s*[+-]?\d+\s*$",
    "xs:decimal": r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$", "xs:double": r"^\s*(-?INF|NaN|[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)\s*$", "xs:float": r"^\s*(-?INF|NaN|[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)\s*$",
    "xs:boolean": r"^\s*(true|false|0|1)\s*$", "xs:time": rf"^{TIME}{ZONE}$", "xs:string": r"(?s)^.*$", "xs:untypedAtomic": r"(?s)^.*$", "xs:anyAtomicType": r"(?s)^.*$",
    "xs:dayTimeDuration": r"^-?P(?=.)(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$", "xs:yearMonthDuration": r"^-?P(?=.)(\d+Y)?(\d+M)?$",
}


def castable(s: Column, kind: str) -> Column:
    """Whether text has a type's lexical form; dates must exist."""
    if kind in ("xs:date", "xs:dateTime"):
        form = DATE if kind == "xs:date" else DATE.replace(ZONE + "$", f"T{TIME}{ZONE}$")
        parts = [F.regexp_extract(s, r"^-?(\d+)-(\d\d)-(\d\d)", i).try_cast("int") for i in (1, 2, 3)]
        leap = ((parts[0] % 4 == 0) & (parts[0] % 100 != 0)) | (parts[0] % 400 == 0)
        last = F.when(parts[1].isin(4, 6, 9, 11), 30).when(parts[1] != 2, 31).when(leap, 29).otherwise(28)
        return F.coalesce(s.rlike(form) & (parts[2] <= last), F.lit(False))
    if kind not in CASTABLE:
        return F.lit(False)
    return s.rlike(CASTABLE[kind])
