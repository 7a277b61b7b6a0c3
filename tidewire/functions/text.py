"""Values as text, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mac_text(b: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(b)), "(..)(?!$)", "$1:")


def ip4_text(b: Column) -> Column:
    octet = lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10)
    return F.when(F.length(b) >= 4, F.concat_ws(".", *(octet(i) for i in (1, 2, 3, 4))))


def ip6_text(b: Column) -> Column:
    """The short form: lower case, no leading zeros, the first longest run of at least two zero groups as ::."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.conv(F.hex(F.substring(b, i * 2 + 1, F.lit(2))), 16, 16)))
    plain = F.array_join(groups, ":")
    runs = [(n, i) for n in range(8, 1, -1) for i in range(9 - n)]
    short = F.coalesce(*(F.when(F.forall(F.slice(groups, i + 1, n), lambda g: g == "0"), F.concat(F.array_join(F.slice(groups, 1, i), ":"), F.lit("::"), F.array_join(F.slice(groups, i + n + 1, 8), ":"))) for n, i in runs))
    mapped = F.when((F.length(b) == 16) & (F.substring(b, 1, 12) == F.lit(bytes(10) + b"\xff\xff")), F.concat(F.lit("::ffff:"), ip4_text(F.substring(b, 13, 4))))
    return F.when(F.length(b) == 16, F.coalesce(mapped, short, plain))


def addr_text(b: Column) -> Column:
    return F.when(F.length(b) == 4, ip4_text(b)).when(F.length(b) == 6, mac_text(b)).otherwise(ip6_text(b))


def ascii_text(b: Column) -> Column:
    """Printable ASCII, other bytes as dots."""
    return F.regexp_replace(F.decode(b, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")


def hex_line(b: Column, at: int, width: int = 16) -> Column:
    """A line of a hex dump: offset, bytes, ASCII."""
    part = F.substring(b, at + 1, width)
    return F.concat(F.lit(f"{at:08x}  "), F.rpad(F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")), 3 * width, " "), F.lit(" "), ascii_text(part))


def hex_dump(b: Column) -> Column:
    """All of the bytes, sixteen a line: offset, bytes with a wider gap after the eighth, printable ASCII; empty for none."""

    def row(i: Column) -> Column:
        part = F.substring(b, i * 16 + 1, F.lit(16))
        pairs = F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")
        half = lambda at: F.rpad(F.substring(pairs, at, 24), 24, " ")
        return F.concat(F.lpad(F.lower(F.hex(i * 16)), 8, "0"), F.lit("  "), half(1), F.lit(" "), half(25), F.lit(" "), ascii_text(part), F.lit("\n"))

    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.call_function("div", F.length(b) - 1, F.lit(16)), F.lit(0)).cast("int")), row)
    return F.when(F.length(b) > 0, F.array_join(rows, "")).when(b.isNotNull(), "")


def payload_text(b: Column, view: str = "ascii") -> Column:
    """Followed bytes as a reader sees them: ascii (line ends and tabs stay, what is not printable is a dot), hex (a dump) or utf8
    (sequences that are not UTF-8 become U+FFFD)."""
    if view == "ascii":
        return F.regexp_replace(F.decode(b, "ISO-8859-1"), "[^\\x20-\\x7e\n\t\r]", ".")
    if view == "utf8":
        return F.make_valid_utf8(b.cast("string"))
    if view == "hex":
        return hex_dump(b)
    raise ValueError("a view is ascii, hex or utf8")


def byte_size(n: Column) -> Column:
    """Decimal units: 999 B, 1.5 kB, 2.0 MB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((3, "kB"), (6, "MB"), (9, "GB"), (12, "TB")):
        out = F.when(n >= 10**power, F.concat(F.format_string("%.1f", n / 10**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """One decimal; a dash where the whole is zero."""
    return F.when(whole > 0, F.concat(F.format_string("%.1f", part * 100.0 / whole), F.lit("%"))).otherwise("—")


def number_text(v: Column, base: str, size: int = 1) -> Column:
    """An unsigned number by base: dec, hex, or both; hexadecimal digits fill the field's size in bytes."""
    h = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(v)), 2 * size, "0"))
    return {"dec": v.cast("string"), "hex": h, "hexdec": F.concat(h, F.lit(" ("), v.cast("string"), F.lit(")"))}[base]


def sequence_offset(a: Column, b: Column) -> Column:
    """How far a is ahead of b in 32-bit sequence space, negative if behind."""
    return F.pmod(a - b + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
