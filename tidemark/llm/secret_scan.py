"""Secret scan: fixed patterns and a sliding-window entropy, in row-local SQL expressions.

Positions are code points. Matches are leftmost and do not overlap within a kind: the text is split
at the matches, and the lengths of pieces and matches add up to positions. Time grows in proportion to the text,
however many matches it has or however long a candidate is.

A window within a run of hexadecimal digits is judged as such wherever the run stands, so a name, path or sign
before a key does not raise its limit. Runs of decimal digits alone are no such runs.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
# The runs themselves are maximal, so their least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20  # characters
PIECE = 4096  # windows of a candidate that are scanned from one list of characters
CHUNK = 256  # entries of a list that are scanned by appending
# Candidates: maximal runs of these characters that hold a digit.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
# Character class -> (pattern, least bits per character in some window). A window takes the limit of its
# candidate's class, and that of "hex" if it lies in a run of HEX_DIGIT that is not of decimal digits alone.
CLASSES = {"hex": (r"^[0-9A-Fa-f]+$", 3.0), "alnum": (r"^[A-Za-z0-9]+$", 3.8), "base64": (r"^", 3.8)}
HEX_DIGIT = "[0-9A-Fa-f]"
# Each digit of such a run of decimal digits alone.
DECIMAL = rf"(?:(?!^)\G|(?<!{HEX_DIGIT})(?=[0-9]+(?!{HEX_DIGIT})))[0-9]"
# Candidates that are no secrets: digits alone, UUIDs, words and numbers joined by signs, examples.
# Possessive, as a long candidate has many words.
ALLOWED = (r"^[0-9]+$",
           r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
           r"^([A-Za-z]++|[0-9]++)([+/_=-]++([A-Za-z]++|[0-9]++))*+[+/_=-]*$",
           r"(?i:example|sample|dummy|placeholder|changeme|0123456789|abcdefghij)")

def scaled(count: int) -> int:
    """count * log2(count) as a whole number of 1/65536 bits."""
    return round(count * math.log2(count) * 65536) if count else 0


def most(bits: float) -> int:
    """The largest sum of ``scaled`` counts of a window with at least ``bits`` per character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 65536)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each of ``items`` the ``value`` of all before it joined (0 at first).

    Appending to an array copies it, so items go in chunks: one scan over the chunks' totals, one within each chunk."""
    def appended(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda state, v: F.struct(
            join(state["at"], v).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")), lambda state: state["out"])

    def scanned(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), join))
        return F.flatten(F.zip_with(chunks, appended(totals, F.lit(0)), appended))

    def chunked(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK)),
                           lambda k: F.slice(values, k + 1, F.lit(CHUNK)))

    return let(F.transform(items, value), lambda values: let(chunked(values), scanned))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, part>>: every match; ``part`` is the text of ``group``."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def length(x: Column) -> Column:  # one more piece than matches: the last entry has no match
        return F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def placed(found: Column) -> Column:
        return let(running(found, length, lambda a, b: a + b), lambda at: F.transform(
            F.slice(found, F.lit(1), F.size(found) - 1), lambda x, i: F.struct(
                (F.get(at, i) + F.length(x["gap"])).alias("start"), (F.get(at, i) + length(x)).alias("end"), x["part"].alias("part"))))

    none = F.array().cast("array<struct<start:int,end:int,part:string>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), F.lit(None).cast("string").alias("part")))


def _apart(spans: Column, base: Column, touches: Callable[[Column, Column, Column], Column]) -> Column:
    """Of ``spans``, which do not overlap each other, those for which ``touches`` does not hold, given the span, the
    last end of the base spans that begin no later, and the first base span's start after it (or null).

    Both come from one sorted list: a base span that begins within a span is the next entry behind it."""
    own = KINDS.index("entropy")

    def kept(all_spans: Column) -> Column:
        ends = running(all_spans, lambda s: F.when(s["kind"] < own, s["end"]).otherwise(F.lit(0)), lambda a, b: F.greatest(a, b))

        def judged(before: Column) -> Column:
            rows = F.transform(all_spans, lambda s, i: let(F.get(all_spans, i + 1), lambda after: F.struct(
                s.alias("span"), touches(s, F.get(before, i), F.when(after["kind"] < own, after["start"])).alias("touched"))))
            return F.transform(F.filter(rows, lambda r: (r["span"]["kind"] == own) & ~F.coalesce(r["touched"], F.lit(False))),
                               lambda r: r["span"])

        return let(ends, judged)

    return F.when(F.size(spans) > 0, let(F.sort_array(F.concat(base, spans)), kept)).otherwise(spans)


def _window_scan(piece: Column, hexes: Column, limit: Column) -> Column:
    """struct<first, last>: the ends of the windows of ``piece`` whose sum is within ``limit``, or within that of
    "hex" where all their ``hexes`` are '#'.

    ``counts`` has one letter per character of ALPHABET, "A" for none in the window. A step changes the counts of
    the character that enters and of the one that leaves, and the sum of count * log2(count) by table differences."""
    hex_limit = F.lit(most(CLASSES["hex"][1]))
    table = F.array(*[F.lit(scaled(c)) for c in range(WINDOW + 2)])
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code, F.lit(1))) - ord("A")

    def counted(counts: Column, code: Column, n: Column) -> Column:
        return F.overlay(counts, F.chr(n + ord("A")), code, F.lit(1))

    def scanned(at: Column) -> Column:
        def step(state: Column, i: Column) -> Column:  # i counts from 1
            new = F.element_at(at["codes"], i)
            old = F.when(i > WINDOW, F.element_at(at["codes"], i - WINDOW))

            def left(s: Column) -> Column:
                n = count(s["counts"], new)
                run = F.when(F.element_at(at["hexes"], i) == "#", state["run"] + 1).otherwise(F.lit(0))
                return let(s["total"] + F.element_at(table, n + 2) - F.element_at(table, n + 1), lambda total: let(
                    (i >= WINDOW) & ((total <= limit) | ((run >= WINDOW) & (total <= hex_limit))), lambda hit: F.struct(
                        counted(s["counts"], new, n + 1).alias("counts"), total.alias("total"), run.alias("run"),
                        F.when(hit & state["first"].isNull(), i - WINDOW).otherwise(state["first"]).alias("first"),
                        F.when(hit, i).otherwise(state["last"]).alias("last"))))

            n = count(state["counts"], old)
            return let(F.when(old.isNull(), F.struct(state["counts"].alias("counts"), state["total"].alias("total"))).otherwise(F.struct(
                counted(state["counts"], old, n - 1).alias("counts"),
                (state["total"] - F.element_at(table, n + 1) + F.element_at(table, n)).alias("total"))), left)

        none = F.lit(None).cast("int")
        start = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0).alias("total"), F.lit(0).alias("run"),
                         none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(at["codes"])), start, step, lambda s: F.struct(
            s["first"].alias("first"), s["last"].alias("last")))

    return let(F.struct(codes.alias("codes"), F.split(hexes, "").alias("hexes")), scanned)


def candidates(text: Column) -> Column:
    """Candidates that are not on the allow-list, as spans with their text."""
    allowed = lambda m: F.array_contains(F.array(*[m["part"].rlike(p) for p in ALLOWED]), True)
    return F.transform(F.filter(located(text, CANDIDATE), lambda m: ~allowed(m)), lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), m["end"].alias("end"), m["part"].alias("part")))


def dense_spans(found: Column) -> Column:
    """Of candidates those with a window of high entropy, each from its first such window to its last.

    A candidate is scanned in pieces, each with all windows that begin in its first PIECE characters."""
    cut = F.lit(f"(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}")

    def scanned(m: Column) -> Column:
        limit = F.lit(None).cast("int")
        for pattern, bits in reversed(CLASSES.values()):
            limit = F.when(m["part"].rlike(pattern), F.lit(most(bits))).otherwise(limit)
        hexes = F.regexp_replace(F.regexp_replace(m["part"], DECIMAL, "."), HEX_DIGIT, "#")
        pieces = F.arrays_zip(F.regexp_extract_all(m["part"], cut, F.lit(1)).alias("piece"),
                              F.regexp_extract_all(hexes, cut, F.lit(1)).alias("hexes"))
        scans = let(limit, lambda bound: F.transform(pieces, lambda p, k: let(
            _window_scan(p["piece"], p["hexes"], bound), lambda s: F.struct(
                (s["first"] + k * PIECE).alias("first"), (s["last"] + k * PIECE).alias("last")))))
        return let(scans, lambda s: F.struct(
            (m["start"] + F.array_min(F.transform(s, lambda x: x["first"]))).alias("start"), m["kind"].alias("kind"),
            (m["start"] + F.array_max(F.transform(s, lambda x: x["last"]))).alias("end"), F.lit(None).cast("string").alias("part")))

    return F.filter(F.transform(found, scanned), lambda c: c["start"].isNotNull())


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of struct<start, kind, end>, kinds as in ``KINDS``.

    An added span that touches a base span is left out, as the base span says it already; so a candidate that lies
    in a base span need not be scanned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_LENGTH)
    base = F.sort_array(F.concat(_spans(assign, "assign"), _spans(located(text, ACCESS), "access"),
                                 _spans(located(text, HEX), "hex")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"), candidates(text).alias("found"))
    open_ones = _apart(F.col("found"), F.col("base"), lambda s, before, after: before >= s["end"])
    rows = rows.select("doc_id", "base", dense_spans(open_ones).alias("dense"))
    added = _apart(F.col("dense"), F.col("base"), lambda s, before, after: (before > s["start"]) | (after < s["end"]))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end")]))
    return rows.select("doc_id", bare(F.col("base")).alias("base"), bare(added).alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans: counts 0, the digest of the empty string, an empty list.
    Whole texts are read, each row by itself, so repeated rows give equal results; an empty table
    gives no rows."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found_spans(docs).select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "added"))).alias("spans"))
